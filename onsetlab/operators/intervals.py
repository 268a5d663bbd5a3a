"""Joins in time and runs in time.

Bare inequality joins would be nested loops, so range joins meet on time buckets; as-of joins are a
union and one window sort. Runs, unions and pairs are found inside chunks of a recording and stitched
over their borders. Interval sides are small next to samples, and only they are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetlab.operators.chunks import CHUNK, closed_gaps, islands, neighbours, running_sums, united
from onsetlab.staging import staged, with_same


def _order(by: list[str], *order) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def range_join(
    samples: DataFrame, events: DataFrame, by: list[str], t: str, onset: str, lo: float, hi: float,
    bucket: float | None = None, how: str = "inner",
) -> DataFrame:
    """Samples with onset + lo <= t <= onset + hi, once for each event (so overlaps repeat a sample).

    Each event is copied to the two or three buckets (of the window's length, unless given) that it
    touches; the join is an equi-join on ``by`` and bucket with the bounds as residual. ``rel`` is
    t - onset. With ``how="left"`` a sample near no event, or with a null key or time, comes once, with nulls.
    """
    width = bucket or max(hi - lo, 1)
    cell = lambda x: F.floor(x / F.lit(width))
    near = events.withColumn("_cell", F.explode(F.sequence(cell(F.col(onset) + F.lit(lo)), cell(F.col(onset) + F.lit(hi)))))
    rows = samples.withColumn("_cell", cell(F.col(t)))
    clash = [c for c in near.columns if c in samples.columns and c not in by]
    near = near.drop(*[c for c in clash if c not in (onset, "_cell")])
    names = {k: f"_e{i}" for i, k in enumerate([*by, "_cell", *([onset] if onset in samples.columns else [])])}
    near = near.withColumnsRenamed(names)
    start = F.col(names.get(onset, onset))
    inside = (F.col(t) - start).between(F.lit(lo), F.lit(hi))
    on = [F.col(k) == F.col(names[k]) for k in [*by, "_cell"]]
    joined = rows.join(near, [*on, inside], how).withColumn("rel", F.col(t) - start)
    return joined.drop("_cell", *names.values())


def as_of(
    left: DataFrame, right: DataFrame, by: list[str], left_t: str, right_t: str, values: list[str],
    direction: str = "backward", strict: bool = False, prefix: str = "", bucket: float | None = None,
) -> DataFrame:
    """The nearest row of ``right`` at or before (``backward``) or after (``forward``) each row of ``left``.

    ``strict`` leaves out equal times. Adds ``prefix + value`` for each of ``values``, null where there is
    none. Of right rows at one time the last (backward) or first (forward) in the order of the values counts.
    With ``bucket`` (a length of time) a key's rows are sorted bucket by bucket in tasks of their own, and
    what a bucket hands on is one row, so a key with very many rows is no single task.

    Null keys match each other; a null time, left or right, matches nothing, and its left row stays.
    """
    back = direction == "backward"
    tag = F.struct(*[F.col(v) for v in values])
    row = F.struct("*")
    a = left.select(*by, F.col(left_t).alias("_t"), row.alias("_row"), F.lit(None).alias("_hit"), F.lit(1).alias("_left"))
    b = right.select(*by, F.col(right_t).alias("_t"), F.lit(None).alias("_row"), tag.alias("_hit"), F.lit(0).alias("_left"))
    b = b.filter("_t is not null")
    both = a.drop("_hit").unionByName(b.drop("_row"), allowMissingColumns=True)
    # At equal times a right row comes first going backward (or forward, seen from the end), unless strict.
    side = F.col("_left") if back != strict else -F.col("_left")
    keys = by
    if bucket is not None:
        both = both.withColumn("_cell", F.floor(F.col("_t") / F.lit(bucket)))
        keys = [*by, "_cell"]
    w = _order(keys, F.col("_t"), side, F.col("_hit"))
    if back:
        hit = F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        hit = F.first("_hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    if bucket is not None:
        place = F.struct(F.col("_t"), F.col("_hit"))
        ends = both.groupBy(*keys).agg((F.max if back else F.min)(F.when(F.col("_hit").isNotNull(), place)).alias("_end"))
        cells = _order(by, "_cell")
        if back:
            handed = F.last("_end", ignorenulls=True).over(cells.rowsBetween(Window.unboundedPreceding, -1))
        else:
            handed = F.first("_end", ignorenulls=True).over(cells.rowsBetween(1, Window.unboundedFollowing))
        ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], handed["_hit"].alias("_handed"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        both = both.withColumn("_hit", hit).filter("_left = 1").join(ends, same)
        hit = F.coalesce("_hit", "_handed")
    out = both.withColumn("_hit", F.when(F.col("_t").isNotNull(), hit)).filter("_left = 1")
    return out.select("_row.*", *[F.col("_hit")[v].alias(prefix + v) for v in values])


def interpolate_at(points: DataFrame, samples: DataFrame, by: list[str], t: str, value: str, out: str = "value_at", bucket: float | None = None) -> DataFrame:
    """The samples' value at the times ``t`` of ``points``, linear in time; null outside the samples. ``bucket`` as in ``as_of``."""
    s = samples.select(*by, F.col(t).alias("_st"), F.col(value).alias("_sv"))
    before = as_of(points, s, by, t, "_st", ["_st", "_sv"], "backward", prefix="b", bucket=bucket)
    both = as_of(before, s, by, t, "_st", ["_st", "_sv"], "forward", prefix="f", bucket=bucket)
    span = F.col("f_st") - F.col("b_st")
    share = (F.col(t) - F.col("b_st")) / span
    blend = F.when(span == 0, F.col("b_sv")).otherwise(F.col("b_sv") + (F.col("f_sv") - F.col("b_sv")) * share)
    return both.withColumn(out, blend).drop("b_st", "b_sv", "f_st", "f_sv")


def merged_intervals(df: DataFrame, by: list[str], start: str, end: str, bucket: float | None = None) -> DataFrame:
    """The union of overlapping or touching intervals: ``by``, start, end.

    With ``bucket`` (a length of time) a key's intervals are merged bucket by bucket and stitched, so a key
    with very many intervals is no single task.
    """
    if bucket is not None:
        return united(df, by, start, end, bucket)
    w = _order(by, start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", (F.col(start) > F.coalesce(reach, F.col(start) - 1)).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def near_events(samples: DataFrame, events: DataFrame, by: list[str], t: str, onset: str, lo: float, hi: float) -> DataFrame:
    """The samples within [onset + lo, onset + hi] of any event, each once."""
    spans = events.select(*by, (F.col(onset) + F.lit(lo)).alias("_a"), (F.col(onset) + F.lit(hi)).alias("_b"))
    width = max(hi - lo, 1)
    spans = merged_intervals(spans, by, "_a", "_b", bucket=4096 * width)
    cell = lambda x: F.floor(x / F.lit(width))
    spans = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col("_a")), cell(F.col("_b"))))).alias("e")
    rows = samples.withColumn("_cell", cell(F.col(t))).alias("s")
    on = [F.col(f"s.{k}") == F.col(f"e.{k}") for k in [*by, "_cell"]]
    return rows.join(spans, [*on, F.col(f"s.{t}").between(F.col("e._a"), F.col("e._b"))], "left_semi").drop("_cell")


def bouts(
    df: DataFrame, by: list[str], frame: str, value: str, threshold: float, min_gap: int, min_duration: int,
    min_peak: float | None = None, peak: str | None = None, rows: int = CHUNK,
) -> DataFrame:
    """Runs with value >= threshold: gaps under ``min_gap`` closed, then short and weak runs dropped.

    Runs are found in chunks of ``rows`` frames and stitched; a run may be longer than a chunk.

    ``frame`` counts rows. The first and last row of a key are taken as inactive. ``start`` is the first
    active frame and ``end`` the first inactive one after; a run must last ``min_duration`` frames, and
    its greatest ``peak`` (the value, unless named) after the start must reach ``min_peak``.
    """
    extents = df.groupBy(*by).agg(F.min(frame).alias("_first"), F.max(frame).alias("_last"))
    runs = with_same(islands(df, by, frame, F.col(value) >= F.lit(threshold), rows), extents, by)
    runs = runs.withColumns({"start": F.greatest("start", F.col("_first") + 1), "end": F.least("end", F.col("_last") - 1)})
    runs = runs.filter("start <= end").select(*by, "start", (F.col("end") + 1).alias("end"))
    runs = closed_gaps(runs, by, max(min_gap, 1), rows)
    runs = runs.filter(F.col("end") - F.col("start") >= min_duration)
    if min_peak is not None:
        width = max(min_duration, 64)
        cells = runs.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
        tops = df.select(*by, frame, F.col(peak or value).alias("_v")).withColumn("_cell", F.floor(F.col(frame) / width))
        inside = (F.col(frame) > F.col("start")) & (F.col(frame) <= F.col("end"))
        strong = with_same(tops, cells, [*by, "_cell"]).filter(inside).groupBy(*by, "start", "end").agg(F.max("_v").alias("_top"))
        runs = strong.filter(F.col("_top") >= min_peak).drop("_top")
    return running_sums(runs.withColumn("_one", F.lit(1)), by, "start", {"_one": "bout_no"}, rows).drop("_one")


def mark_bouts(df: DataFrame, runs: DataFrame, by: list[str], frame: str, width: int = 256) -> DataFrame:
    """Add bout_no (null outside), bout, bout_beg (first active row) and bout_end (first inactive row after)."""
    cells = runs.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    rows = df.withColumn("_cell", F.floor(F.col(frame) / width)).alias("s")
    cells = cells.alias("b")
    on = [F.col(f"s.{k}") == F.col(f"b.{k}") for k in [*by, "_cell"]]
    hit = rows.join(cells, [*on, F.col(frame).between(F.col("b.start"), F.col("b.end"))], "left")
    # A row that ends one bout and begins the next meets both and belongs to the one that begins: with
    # min_gap >= 1 that cannot happen, as such runs were merged.
    grouped = hit.select(*[F.col(f"s.{c}").alias(c) for c in df.columns], F.struct("b.start", "b.end", "b.bout_no").alias("_b"))
    active = F.col(frame) < F.col("_b.end")
    return grouped.select(
        *df.columns,
        F.when(active, F.col("_b.bout_no")).alias("bout_no"),
        F.coalesce(active, F.lit(False)).alias("bout"),
        F.coalesce(F.col(frame) == F.col("_b.start"), F.lit(False)).alias("bout_beg"),
        F.coalesce(F.col(frame) == F.col("_b.end"), F.lit(False)).alias("bout_end"),
    )


def paired_events(marks: DataFrame, by: list[str], t: str, begins: Column, ends: Column, bucket: float = CHUNK) -> DataFrame:
    """Pair begin and end marks in time; a begin without an end closes at the last row, an end without a begin opens at the first.

    A begin that another begin follows closes there. Marks of one time are taken begins first; a null time is
    no mark. Neighbouring marks are found bucket by bucket (a length of time), so a long key is no single task.
    """
    extents = marks.groupBy(*by).agg(F.min(t).alias("_first"), F.max(t).alias("_last"))
    # One row per time: whether it begins and ends, so that the order does not tie.
    told = marks.withColumn("_kind", F.when(begins, 1).when(ends, 0)).filter(F.col("_kind").isNotNull() & F.col(t).isNotNull())
    kinds = told.groupBy(*by, t).agg(F.count_if(F.col("_kind") == 1).alias("_b"), F.count_if(F.col("_kind") == 0).alias("_e"))
    here = F.struct((F.col("_b") > 0).alias("b"), F.col(t).alias("t"), (F.col("_e") > 0).alias("e"))
    kinds = staged(kinds, "paired-marks")
    near = neighbours(neighbours(kinds, by, t, here, "_next", bucket, ahead=True), by, t, here, "_before", bucket)
    near = with_same(near, extents, by)
    # Begins of one time but the last close at once; the last goes on to an end of the same time, or to the next mark.
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    at = F.col(t)
    closing = F.when(F.col("_e") > 0, at).otherwise(F.coalesce(F.col("_next.t"), F.col("_last")))
    at_once = F.when(F.col("_b") > 1, F.array_repeat(span(at, at), (F.col("_b") - 1).cast("int")))
    lasting = F.when(F.col("_b") > 0, F.array(span(at, closing)))
    lone = F.when((F.col("_b") == 0) & F.col("_before").isNull(), F.array(span(F.col("_first"), at)))
    none = F.filter(F.array(span(at, at)), lambda _: F.lit(False))  # empty, of the right type
    found = F.concat(*[F.coalesce(x, none) for x in (at_once, lasting, lone)])
    return near.select(*by, F.inline(found))


def mean_inside(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Replace values inside a bout (``bout_no``) by the bout's mean; null outside."""
    w = Window.partitionBy(*by, "bout_no")
    return df.withColumn(out, F.when(F.col("bout_no").isNotNull(), F.avg(value).over(w)))
