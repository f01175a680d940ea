"""Which breaches fire when a fired one silences the next for a while.

Firing is a chain: each fired breach decides the earliest time of the next. Inside one ordered bucket
of a key the chain is followed directly. When a key is larger than one task, each bucket first says,
for every state the chain can enter it with, in which state it leaves. With a cooldown longer than a bucket
these are as many rows as there are distinct times, so they stay rows: each looks up the row where the chain goes
on, and those on the chain are marked by joins that double the step. Each bucket is then replayed from its
known entry state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import order
from tidewatch.session import stage

_START = -(2**62)
_NEVER = 2**62


def _follow(times: np.ndarray, allowed_from: int, cooldown: int) -> np.ndarray:
    """Mask of the fired breaches among sorted times."""
    fired = np.zeros(len(times), dtype=bool)
    at = int(np.searchsorted(times, allowed_from, side="left"))
    while at < len(times):
        fired[at] = True
        at = int(np.searchsorted(times, times[at] + cooldown, side="left"))
    return fired


def _exits(times: np.ndarray, cooldown: int, first: int = _START) -> tuple[np.ndarray, np.ndarray]:
    """(latest entry, exit) pairs: entering with allowed_from <= latest entry leaves with exit."""
    following = np.searchsorted(times, times + cooldown, side="left")
    leaves = times + cooldown
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            leaves[i] = leaves[following[i]]
    # The chain enters no later than one cooldown after the bucket begins, or where the key's first firing is allowed.
    reachable = int(np.searchsorted(times, max(times[0] + cooldown, first), side="left")) + 1
    entry, leave = times[:reachable], leaves[:reachable]
    last_of_run = np.append(leave[1:] != leave[:-1], True)
    return entry[last_of_run], leave[last_of_run]


def fire(
    breaches: DataFrame,
    time: str,
    tie: str,
    cooldown_seconds: float,
    by: Sequence[str] = (),
    rows_per_task: int | None = None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Add `fired` to breach rows: at least `cooldown_seconds` since the last fired one of its key.

    A cooldown of zero lets every breach fire. Rows of equal time are taken in the order of `tie`. `earlier`
    holds, per key, when it last fired before these rows (`last_fired`, may be null).
    """
    if cooldown_seconds <= 0:
        return breaches.withColumn("fired", F.lit(True))
    columns = breaches.columns
    rows, by = order.keyed(breaches, by)
    rows_per_task = rows_per_task or order.ROWS_PER_TASK
    cooldown = int(cooldown_seconds * 1_000_000)
    rows = rows.withColumn("_t", F.unix_micros(time))
    if earlier is None:
        rows = rows.withColumn("_first", F.lit(_START).cast("long"))
    else:
        allowed = (F.unix_micros("last_fired") + cooldown).alias("_first")
        rows = order.join_on(rows, order.keyed(earlier, [b for b in by if b in columns])[0].select(*by, allowed), by, "left")
        rows = rows.fillna(_START, subset=["_first"])
    sizes = order.measure(rows, by)
    if sizes.largest <= rows_per_task:
        bucketed = rows.withColumn("_bucket", F.lit(0)).withColumn("_entry", F.col("_first"))
    else:
        bucketed = order.add_bucket(rows, by, ["_t"], sizes, rows_per_task)
        bucketed = order.join_on(bucketed, _entries(bucketed, by, cooldown, rows_per_task), [*by, "_bucket"], "left")
        bucketed = bucketed.fillna(_NEVER, subset=["_entry"])

    group = [*by, "_bucket"]
    sorted_rows = (
        bucketed.withColumn("_group", F.xxhash64(*group))
        .repartition(*group)
        .sortWithinPartitions(*group, "_t", tie)
        .select(*columns, "_t", "_group", "_entry")
    )
    schema = T.StructType([*breaches.schema.fields, T.StructField("fired", T.BooleanType())])

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by group and time; only the state of the last group is carried over.
        open_group, state = None, _START
        for pdf in batches:
            groups, times, entries = (pdf[c].to_numpy() for c in ("_group", "_t", "_entry"))
            starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(pdf) else []
            fired = np.zeros(len(pdf), dtype=bool)
            for low, high in zip(starts, np.append(starts[1:], len(pdf)).astype(int)):
                if groups[low] != open_group:
                    open_group, state = groups[low], entries[low]
                fired[low:high] = _follow(times[low:high], int(state), cooldown)
                if fired[low:high].any():
                    state = times[low:high][fired[low:high]][-1] + cooldown
            yield pdf[columns].assign(fired=fired)

    return sorted_rows.mapInPandas(replay, schema)


def _entries(bucketed: DataFrame, by: Sequence[str], cooldown: int, rows_per_task: int) -> DataFrame:
    """Per bucket in which the chain fires, the time from which firing is allowed when it arrives there."""
    exit_schema = T.StructType(
        [
            *[bucketed.schema[c] for c in by],
            bucketed.schema["_bucket"],
            T.StructField("_first", T.LongType()),
            T.StructField("_latest", T.LongType()),
            T.StructField("_exit", T.LongType()),
        ]
    )

    def exits(key, pdf: pd.DataFrame) -> pd.DataFrame:
        latest, leave = _exits(np.sort(pdf["_t"].to_numpy()), cooldown, int(key[-1]))
        table = pd.DataFrame({"_latest": latest, "_exit": leave})
        for name, value in zip([*by, "_bucket", "_first"], key):
            table[name] = [value] * len(table)
        return table[exit_schema.fieldNames()]

    # Equal times are one state, so they collapse before a bucket is handed over.
    times = bucketed.select(*by, "_bucket", "_first", "_t").distinct()
    nodes = stage(times.groupBy(*by, "_bucket", "_first").applyInPandas(exits, exit_schema), "exits")
    firsts = nodes.select(*by, F.col("_first").alias("_exit")).distinct()
    asked = nodes.select(*by, "_exit").unionByName(firsts).distinct()
    onward = stage(_at_or_after(nodes, asked, by, rows_per_task), "onward")

    # `_jump` leads 1, 2, 4, ... nodes onward; what the marked nodes reach by it is marked too.
    jumps = stage(order.join_on(nodes.select(*by, "_latest", "_exit"), onward, [*by, "_exit"]).select(*by, "_latest", F.col("_next").alias("_jump")), "jumps")
    marked = stage(order.join_on(firsts, onward, [*by, "_exit"]).select(*by, F.col("_next").alias("_latest")), "marked")
    while True:
        reached = stage(order.join_on(marked, jumps, [*by, "_latest"]).select(*by, F.col("_jump").alias("_latest")), "reached")
        if reached.isEmpty():
            break
        marked = stage(marked.unionByName(reached), "marked")
        further = jumps.select(*by, F.col("_latest").alias("_jump"), F.col("_jump").alias("_far"))
        jumps = stage(order.join_on(jumps, further, [*by, "_jump"]).select(*by, "_latest", F.col("_far").alias("_jump")), "jumps")

    on_chain = order.join_on(nodes, marked, [*by, "_latest"])
    arrivals = on_chain.select(*by, "_exit").unionByName(firsts)
    reached = order.join_on(arrivals, onward, [*by, "_exit"]).select(*by, F.col("_next").alias("_latest"), F.col("_exit").alias("_entry"))
    return order.join_on(nodes.select(*by, "_bucket", "_latest"), reached, [*by, "_latest"]).select(*by, "_bucket", "_entry")


def _at_or_after(nodes: DataFrame, asked: DataFrame, by: Sequence[str], rows_per_task: int) -> DataFrame:
    """For each asked `_exit`, the least `_latest` of its key that is not below it, as `_next`; none gives no row."""
    both = nodes.select(*by, F.col("_latest").alias("_at"), F.col("_latest").alias("_node"), F.lit(False).alias("_asked")).unionByName(
        asked.select(*by, F.col("_exit").alias("_at"), F.lit(None).cast("long").alias("_node"), F.lit(True).alias("_asked"))
    )
    cut = order.add_bucket(both, by, ["_at"], order.measure(both, by), rows_per_task)
    later = Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    after = cut.groupBy(*by, "_bucket").agg(F.min("_node").alias("_least")).select(*by, "_bucket", F.min("_least").over(later).alias("_after"))
    here = Window.partitionBy("_bucket", *by).orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = order.join_on(cut.withColumn("_here", F.min("_node").over(here)).where("_asked"), after, [*by, "_bucket"])
    return found.select(*by, F.col("_at").alias("_exit"), F.coalesce("_here", "_after").alias("_next")).where("_next is not null")
