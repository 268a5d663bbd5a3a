"""Scans over long recordings: windows inside chunks, and one row a chunk to carry from chunk to chunk.

A chunk holds the rows of a key whose order value lies in one multiple of ``rows``. Each function works in
two levels. Inside the chunks Spark sorts and scans as usual, in tasks that do not grow with a recording.
What crosses a border is a summary row per chunk (a sum, a last value, an open end), and only those rows
are scanned by key. Null keys are one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetlab.staging import staged, with_same

#: Rows of a chunk (or units of the order column, where it does not count rows).
CHUNK = 1 << 16

_BEFORE = (Window.unboundedPreceding, -1)
_MERGE = {"min": F.min, "max": F.max, "sum": F.sum}


def in_chunks(df: DataFrame, order: str, rows: float) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(rows)))


def running_sums(df: DataFrame, by: list[str], order: str, values: dict[str, str], rows: float = CHUNK, inclusive: bool = True) -> DataFrame:
    """Add, for each of ``values`` (column to name), its sum up to each row (or before it). Values may have any sign; nulls add nothing."""
    key = [*by, "_chunk"]
    cut = in_chunks(df, order, rows)
    totals = cut.groupBy(*key).agg(*[F.sum(v).alias(f"_t_{n}") for v, n in values.items()])
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(*_BEFORE)
    carry = totals.select(*key, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in values.values()])
    inside = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = cut.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v, n in values.items()})
    out = with_same(out, carry, key).withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in values.values()})
    return out.drop("_chunk", *[f"_c_{n}" for n in values.values()])


def neighbours(df: DataFrame, by: list[str], order: str, value: Column, out: str, rows: float = CHUNK, ahead: bool = False) -> DataFrame:
    """Add ``value`` of the row before (or after, ``ahead``) in the key; null at its end. The order must not tie."""
    key = [*by, "_chunk"]
    cut = in_chunks(df, order, rows).withColumn("_value", F.struct(value.alias("v")))
    step, at_edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    edges = cut.groupBy(*key).agg(at_edge("_value", order).alias("_edge"))
    edges = edges.select(*key, step("_edge").over(Window.partitionBy(*by).orderBy("_chunk")).alias("_handed"))
    near = cut.withColumn("_near", step("_value").over(Window.partitionBy(*key).orderBy(order)))
    near = with_same(near, edges, key).withColumn(out, F.coalesce("_near", "_handed")["v"])
    return near.drop("_chunk", "_value", "_near", "_handed")


def filled(df: DataFrame, by: list[str], order: str, value: Column, out: str, rows: float = CHUNK, ahead: bool = False) -> DataFrame:
    """Add the last ``value`` that is not null up to each row (or the first from it on, ``ahead``)."""
    key = [*by, "_chunk"]
    cut = in_chunks(df, order, rows).withColumn("_value", value)
    pick, at_edge = (F.first, F.min_by) if ahead else (F.last, F.max_by)
    inside, across = ((0, Window.unboundedFollowing), (1, Window.unboundedFollowing)) if ahead else ((Window.unboundedPreceding, 0), _BEFORE)
    edges = cut.filter("_value is not null").groupBy(*key).agg(at_edge("_value", order).alias("_edge"))
    edges = cut.select(*key).distinct().transform(lambda all_: with_same(all_, edges, key, "left"))
    edges = edges.select(*key, pick("_edge", True).over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(*across)).alias("_handed"))
    near = cut.withColumn("_near", pick("_value", True).over(Window.partitionBy(*key).orderBy(order).rowsBetween(*inside)))
    near = with_same(near, edges, key).withColumn(out, F.coalesce("_near", "_handed"))
    return near.drop("_chunk", "_value", "_near", "_handed")


def _stitched(parts: DataFrame, by: list[str], first: str, merge: dict[str, str]) -> DataFrame:
    """Merge the parts that chunk borders cut: an ``_edge`` part that ``_joins`` goes on with the edge part before it.

    Parts inside a chunk are done; at most two a chunk are edges, and only they are scanned by key.
    """
    parts = staged(parts, "chunk-parts")
    upto = Window.partitionBy(*by).orderBy("_chunk", first).rowsBetween(Window.unboundedPreceding, 0)
    edges = parts.filter("_edge").withColumn("_whole", F.sum((~F.col("_joins")).cast("long")).over(upto))
    edges = edges.groupBy(*by, "_whole").agg(*[_MERGE[m](c).alias(c) for c, m in merge.items()])
    return parts.filter("not _edge").select(*by, *merge).unionByName(edges.select(*by, *merge))


def islands(df: DataFrame, by: list[str], order: str, on: Column, rows: float = CHUNK, **aggregates: tuple[str, Column]) -> DataFrame:
    """Maximal runs of neighbouring rows where ``on`` holds: start, end (of ``order``), n and further aggregates.

    An aggregate is min, max or sum of a column. Each chunk gives its runs; those that touch its first or
    last row are stitched to the next chunk's.
    """
    key = [*by, "_chunk"]
    cut = in_chunks(df, order, rows).withColumn("_on", F.coalesce(on, F.lit(False)))
    w = Window.partitionBy(*key).orderBy(order)
    cut = cut.withColumn("_change", (F.col("_on") != F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("int"))
    cut = cut.withColumn("_run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = {k: _MERGE[m](c).alias(k) for k, (m, c) in aggregates.items()}
    parts = cut.filter("_on").groupBy(*key, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"), *own.values())
    borders = cut.groupBy(*key).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.max_by("_on", order).alias("_last_on"))
    before = F.coalesce(F.lag("_last_on").over(Window.partitionBy(*by).orderBy("_chunk")), F.lit(False))
    parts = with_same(parts, borders.select(*key, "_lo", "_hi", before.alias("_open")), key)
    left, right = F.col("start") == F.col("_lo"), F.col("end") == F.col("_hi")
    parts = parts.withColumns({"_edge": left | right, "_joins": left & F.col("_open")})
    return _stitched(parts, by, "start", {"start": "min", "end": "max", "n": "sum", **{k: m for k, (m, _) in aggregates.items()}})


def closed_gaps(runs: DataFrame, by: list[str], gap: float, rows: float = CHUNK) -> DataFrame:
    """Join disjoint runs [start, end) that are less than ``gap`` apart: start, end."""
    key = [*by, "_chunk"]
    cut = in_chunks(runs.select(*by, "start", "end"), "start", rows)
    w = Window.partitionBy(*key).orderBy("start")
    far = F.coalesce(F.col("start") - F.lag("end").over(w) >= F.lit(gap), F.lit(True))
    cut = cut.withColumn("_new", far.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = cut.groupBy(*key, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    borders = cut.groupBy(*key).agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    before = F.lag("_hi").over(Window.partitionBy(*by).orderBy("_chunk"))
    parts = with_same(parts, borders.select(*key, "_lo", "_hi", before.alias("_before")), key)
    left = F.col("start") == F.col("_lo")
    near = F.coalesce(F.col("start") - F.col("_before") < F.lit(gap), F.lit(False))
    parts = parts.withColumns({"_edge": left | (F.col("end") == F.col("_hi")), "_joins": left & near})
    return _stitched(parts, by, "start", {"start": "min", "end": "max"})


def united(df: DataFrame, by: list[str], start: str, end: str, bucket: float) -> DataFrame:
    """The union of overlapping or touching intervals of any length: start, end. Chunks are buckets of ``start``."""
    key = [*by, "_chunk"]
    cut = in_chunks(df.select(*by, start, end), start, bucket)
    reach = cut.groupBy(*key).agg(F.max(end).alias("_reach"))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(*_BEFORE)
    cut = with_same(cut, reach.select(*key, F.max("_reach").over(earlier).alias("_carry")), key)
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.greatest(F.col("_carry"), F.max(end).over(w.rowsBetween(*_BEFORE)))  # of those that are there
    cut = cut.withColumn("_new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int"))
    cut = cut.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = cut.groupBy(*key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end))
    last = F.col("_run") == F.max("_run").over(Window.partitionBy(*key))
    parts = parts.withColumns({"_joins": F.col("_run") == 0, "_edge": last | (F.col("_run") == 0)})
    return _stitched(parts, by, start, {start: "min", end: "max"})
