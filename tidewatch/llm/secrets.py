"""Secret scan over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds one row per blob
and rule version that has been scanned, with the spans found (often none), so a scan reads only pairs of
blob and rule version that the ledger lacks, and an interrupted scan goes on where its last committed
files end. A rule's version is a hash of all that decides what it finds, so a changed rule never takes over what
another one has found. A scan leaves files behind only if something was due. `compact` merges the files of many
scans. Findings are joined back to all paths that hold a blob.

Spans are code points of the text, end exclusive. Matches are leftmost and do not overlap within a kind;
a match that is too short is dropped after matching. Null text counts as empty; a null doc_id is kept;
repeated rows each get their findings; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import packed, text_or_empty
from tidewatch.sources.tables import drop_path, path_exists


# Goes up whenever `find` itself changes.
MATCHING = 1


@dataclass(frozen=True)
class Rule:
    """A kind of secret."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False

    @property
    def version(self) -> str:
        """Stands for what the rule finds: pattern, length, group, case, and the rules of matching."""
        told = repr((MATCHING, self.pattern, self.least, self.group, self.any_case))
        return hashlib.sha256(told.encode()).hexdigest()[:16]


# The three kinds of secrets and their least lengths.
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=8,
        group=2,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)

LEDGER = "blob binary, kind string, rule string, spans array<struct<s:int,e:int>>"


def find(rule: Rule, text: str) -> list[tuple[int, int]]:
    pattern = re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scanner(rules: Sequence[Rule]):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {(r.kind, r.version): r for r in rules}
        for batch in batches:
            out = [
                (blob, kind["kind"], kind["rule"], find(known[kind["kind"], kind["rule"]], text))
                for blob, text, due in zip(batch.blob, batch.content, batch.due)
                for kind in due
            ]
            yield pd.DataFrame(out, columns=["blob", "kind", "rule", "spans"])

    return scan


def read_ledger(spark, path: str) -> DataFrame:
    """What has been scanned so far; a folder that does not exist yet is an empty ledger."""
    try:
        return spark.read.schema(LEDGER).parquet(path).drop("scan")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def update_ledger(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> None:
    """Scan what is unseen among `versions` (blob, content) and append it to the ledger, in a folder of its own, as others may scan too."""
    pair = F.struct(F.col("kind"), F.col("rule"))
    seen = read_ledger(versions.sparkSession, ledger).groupBy("blob").agg(F.collect_set(pair).alias("seen"))
    wanted = F.array(
        *[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule")) for r in rules]
    )
    unseen = (
        # One row per blob, dealt by blob only: the join needs no second shuffle of the contents.
        versions.groupBy("blob").agg(F.first("content").alias("content"))
        .join(seen, "blob", "left")
        .withColumn("due", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<struct<kind:string,rule:string>>"))))
        .where(F.size("due") > 0)
        .select("blob", "content", "due")
    )
    spark, folder = versions.sparkSession, f"{ledger}/scan={uuid.uuid4().hex}"
    unseen.mapInPandas(_scanner(rules), LEDGER).write.parquet(folder)
    if spark.read.schema(LEDGER).parquet(folder).isEmpty():
        drop_path(spark, folder)


def compact(spark, ledger: str) -> None:
    """Merge the files of all scans so far into one folder, each pair once. No scan may run meanwhile."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path_exists(spark, ledger):
        return
    scans = [s.getPath() for s in hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path)]
    scans = [str(p.toString()) for p in scans if p.getName().startswith("scan=")]
    if len(scans) > 1:
        # A crash in between leaves pairs twice, which every reader takes once.
        rows = spark.read.schema(LEDGER).parquet(*scans).dropDuplicates(["blob", "kind", "rule"])
        rows.write.parquet(f"{ledger}/scan={uuid.uuid4().hex}")
        for old in scans:
            drop_path(spark, old)


def scan(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger up to date with `docs`; each row as `doc`, and `found` by start, then by rule.

    `found` is an array of (s, e, kind); null where a text holds nothing.
    """
    content = text_or_empty()
    blob = F.unhex(F.sha2(content, 256))
    update_ledger(docs.select(blob.alias("blob"), content.alias("content")), ledger, rules)
    current = F.array(*[F.concat_ws(":", F.lit(r.kind), F.lit(r.version)) for r in rules])
    place = F.array(*[F.lit(r.kind) for r in rules])
    found = (
        read_ledger(docs.sparkSession, ledger)
        .where((F.size("spans") > 0) & F.array_contains(current, F.concat_ws(":", "kind", "rule")))
        # A pair is there twice only if two scans ran at once; both found the same.
        .groupBy("blob", "kind")
        .agg(F.first("spans").alias("spans"))
        .groupBy("blob")
        .agg(F.collect_list(F.struct("kind", "spans")).alias("kinds"))
        .select(
            F.col("blob").alias("_blob"),
            F.expr("flatten(transform(kinds, k -> transform(k.spans, x -> (x.s, x.e, k.kind))))").alias("spans"),
            place.alias("place"),
        )
        .select(
            "_blob",
            F.expr(
                "transform(array_sort(transform(spans, x -> struct(x.s as s, array_position(place, x.kind) as p, x.e as e, x.kind as kind))),"
                " x -> struct(x.s, x.e, x.kind))"
            ).alias("found"),
        )
    )
    rows = packed(docs).select("doc", F.unhex(F.sha2(text_or_empty("doc.text"), 256)).alias("_blob"))
    return rows.join(found, "_blob", "left").drop("_blob")


def as_text(found):
    """Spans as kind:start:end, joined by commas."""
    return F.coalesce(
        F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"]))), F.lit("")
    )


def count_of(found, kind: str):
    return F.coalesce(F.size(F.filter(found, lambda x: x["kind"] == kind)), F.lit(0)).cast("long")


def _redact(text: str, starts, ends, mark: str) -> str:
    out, at = [], 0
    for s, e in zip(starts, ends):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, ledger: str, mark: str = "[removed]", rules: Sequence[Rule] = RULES) -> DataFrame:
    """`docs` with every secret replaced by `mark`; columns as they were."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series(
            [
                t if t is None or f is None else _redact(t, [x["s"] for x in f], [x["e"] for x in f], mark)
                for t, f in zip(text, found)
            ],
            dtype=object,
        )

    hit = scan(docs, ledger, rules)
    clean, dirty = hit.where("found is null"), hit.where("found is not null")
    dirty = dirty.withColumn("doc", F.col("doc").withField("text", cut("doc.text", "found")))
    return clean.select("doc.*").unionByName(dirty.select("doc.*"))
