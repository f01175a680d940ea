"""The queries of this package over the given tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import Registry
from tidewatch.llm import (
    alignment,
    codebooks,
    exact,
    graphs,
    licenses,
    lines,
    packing,
    pieces,
    quality,
    secrets,
    simhash,
    substrings,
    topk,
)
from tidewatch.llm.common import table
from tidewatch.session import lasting_path

QUERIES = Registry()


@QUERIES.add(
    r"""
WITH found AS (
  SELECT doc_id, 'assign' AS kind, 1 AS k, regexp_extract_all(t, p, 0) AS hit, string_split_regex(t, p) AS gap
  FROM (SELECT doc_id, coalesce(text, '') AS t,
               '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+' AS p FROM documents)
  UNION ALL
  SELECT doc_id, 'access', 2, regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+', 0), string_split_regex(coalesce(text, ''), 'AKIA[A-Z0-9]+') FROM documents
  UNION ALL
  SELECT doc_id, 'hex', 3, regexp_extract_all(coalesce(text, ''), '[0-9a-f]+', 0), string_split_regex(coalesce(text, ''), '[0-9a-f]+') FROM documents),
each AS (
  SELECT doc_id, kind, k, hit[i] AS hit,
         list_sum(list_transform(gap[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM found)),
kept AS (
  SELECT *, kind || ':' || CAST(s AS BIGINT) || ':' || (CAST(s AS BIGINT) + length(hit)) AS span FROM each
  WHERE CASE k WHEN 1 THEN length(regexp_extract(hit, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 8
             WHEN 2 THEN length(hit) >= 16 ELSE length(hit) >= 32 END),
summed AS (
  SELECT doc_id, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
         string_agg(span, ',' ORDER BY s, k) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN summed USING (doc_id)"""
)
def op1_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = secrets.scan(docs, lasting_path(spark, "blob-ledger"))
    spans = secrets.as_text(F.col("found"))
    return found.select(
        "doc.doc_id",
        *[secrets.count_of(F.col("found"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
    )


@QUERIES.add()
def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf, "documents")))


@QUERIES.add()
def op3_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    both = pieces.round_trip(table(spark, sf, "documents"))
    return both.select(
        "doc_id",
        "n_ids",
        "ids_crc32",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@QUERIES.add(
    r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM w"""
)
def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.groups(table(spark, sf, "documents")).drop("_h")


@QUERIES.add()
def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = lines.per_document(table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


@QUERIES.add()
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@QUERIES.add()
def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.classes(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@QUERIES.add(
    r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""
)
def op8_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


@QUERIES.add(
    r"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
w AS (SELECT r, unnest(range(0, octet_length(raw) - 399)) AS p, raw FROM b WHERE octet_length(raw) >= 400),
n AS (SELECT r, p, count(*) OVER (PARTITION BY md5(raw[p + 1 : p + 400])) AS n FROM w),
s AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 400, true) AS new FROM n WHERE n > 1),
i AS (SELECT r, p, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r ORDER BY p) AS island FROM s),
span AS (SELECT r, min(p) AS s, max(p) + 400 AS e FROM i GROUP BY r, island),
total AS (SELECT r, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY r),
edge AS (SELECT r, s, e FROM span UNION ALL SELECT r, octet_length(raw), octet_length(raw) FROM b),
piece AS (SELECT r, s, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s, e), 0) AS a FROM edge),
rest AS (SELECT r, string_agg(CASE WHEN s > a THEN hex(raw[a + 1 : s]) ELSE '' END, '' ORDER BY s) AS rest FROM piece JOIN b USING (r) GROUP BY r)
SELECT doc_id, octet_length(raw) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(rest)) AS kept_sha256, octet_length(raw) - coalesce(n_removed, 0) AS n_kept
FROM b JOIN rest USING (r) LEFT JOIN total USING (r)"""
)
def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf, "documents"), texts=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
        (F.col("n_bytes") - removed).alias("n_kept"),
    )


@QUERIES.add()
def op10_licenses(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scan(table(spark, sf, "documents").select("doc_id", "text"))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["coverage"], m["license"])))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["s"], m["e"], F.round(m["coverage"], 4)))
    return found.select(
        "doc.doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        best["license"].alias("license"),
        F.round(best["coverage"], 4).alias("coverage"),
        F.concat_ws(",", spans).alias("spans"),
    )


def _codebook_sql(rounds: int = codebooks.ROUNDS) -> str:
    """Rounds of assigning and averaging written out one after the other."""

    def assigned(book: str) -> str:
        away = "list_sum(list_transform(list_zip(p.part, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"""(SELECT r, pos, first(part) AS part, min(d) AS d, arg_min(e, d * 16 + e) AS e
  FROM (SELECT p.r, p.pos, p.part, b.e, CAST({away} AS BIGINT) AS d FROM p JOIN {book} b USING (pos)) GROUP BY r, pos)"""

    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """p AS MATERIALIZED (
  SELECT r, pos, w[pos * (len(w) // 8) + 1 : (pos + 1) * (len(w) // 8)] AS part
  FROM (SELECT *, unnest(range(8)) AS pos FROM v))""",
        "b0 AS MATERIALIZED (SELECT pos, r - 1 AS e, part AS c FROM p WHERE r <= 16)",
    ]
    for n in range(1, rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED {assigned(f'b{n - 1}')}")
        steps.append(f"""m{n} AS MATERIALIZED (
  SELECT pos, e, list(mean ORDER BY place) AS c
  FROM (SELECT pos, e, place, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS mean
        FROM (SELECT pos, e, unnest(part) AS x, generate_subscripts(part, 1) AS place FROM a{n}) GROUP BY pos, e, place) GROUP BY pos, e)""")
        steps.append(f"""b{n} AS MATERIALIZED (
  SELECT pos, e, coalesce(m.c, b.c) AS c FROM b{n - 1} b LEFT JOIN m{n} m USING (pos, e))""")
    steps.append(f"f AS MATERIALIZED {assigned(f'b{rounds}')}")
    steps.append("""coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY r)""")
    steps.append(f"sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (r), sha"""


@QUERIES.add(_codebook_sql())
def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return codebooks.compress(table(spark, sf, "embeddings"))


@QUERIES.add()
def op12_nearest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return graphs.nearest(graphs.index(vectors), vectors.where("vec_id % 100 = 0"))


@QUERIES.add()
def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.measure(table(spark, sf, "documents"))
