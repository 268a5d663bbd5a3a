"""Written tables in the cluster's shared folder, and positions in a global order.

Everything that is read more than once, or that iterates, is cut here with a written Parquet
table: executors may be lost at any time and a table in the shared folder outlives them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that ``broadcast_if_small`` will hint at most; beyond it Spark plans a shuffled join.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset a local one of our own, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='onsetlab-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the reader of that table."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a count proves ``df`` has at most ``rows`` rows; otherwise leave the choice to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with the other columns of ``right`` where the keys are equal, null keys among themselves."""
    names = {k: f"_same{i}" for i, k in enumerate(keys)}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()] or [F.lit(True)]  # without keys, one row each
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def before_partition(value: str, name: str) -> Column:
    """Over one row per partition (``_part``): the sum of ``value`` over the partitions before. The window has one row a partition."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0)).alias(name)


def with_position(df: DataFrame, order: list, name: str, label: str) -> DataFrame:
    """Add ``name``: the row's place (from 0) in the global order of ``order``, without a one-task window.

    Rows are range-partitioned, sorted inside each partition and written with the partition's
    number and the place inside it; a table of one row per partition then gives the offsets.
    """
    split = staged(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        label,
    )
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = split.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", before_partition("_n", "_offset"))
    return (
        split.withColumn("_part", part)
        .join(broadcast_if_small(offsets), "_part")
        .withColumn(name, F.col("_offset") + place)
        .drop("_part", "_at", "_offset")
    )


def positions(df: DataFrame, keys: list[str], order: list, name: str, label: str = "positions") -> DataFrame:
    """Add ``name``: the row's place (from 0) in its key, in the order of ``order``. Null keys are one key.

    Rows are range-partitioned by key and order, so a key of very many rows spreads over tasks; a table of
    one row per partition and key gives what comes before, and no window runs over rows.
    """
    split = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    split = staged(split, label).withColumn("_part", F.shiftright("_at", 33))
    heads = split.groupBy(*keys, "_part").agg(F.min("_at").alias("_head"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*keys, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_head")).alias("_shift"))
    out = with_same(split, broadcast_if_small(heads), [*keys, "_part"])
    return out.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


#: Rows up to which ``sums_before`` uses one window per key.
WINDOW_ROWS = 1_000_000


def sums_before(df: DataFrame, keys: list[str], order: list, values: dict[str, str], label: str, limit: int = WINDOW_ROWS) -> DataFrame:
    """Add, for each of ``values`` (column to name), its sum over the earlier rows of the key. Values are not negative.

    A table of few rows takes a window per key. Beyond ``limit`` rows a key may be too large for one
    task: rows are range-partitioned by key and order, summed inside each partition, and shifted by the
    totals of the partitions before and of the keys before. Both ways give the same sums; nulls are one key.
    """
    table = staged(df, label)
    if table.limit(limit + 1).count() <= limit:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return table.withColumns({n: F.coalesce(F.sum(v).over(w), F.lit(0)) for v, n in values.items()})
    split = table.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    split = staged(split.withColumn("_at", F.monotonically_increasing_id()), label).withColumn("_part", F.shiftright("_at", 33))
    totals = split.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values])
    offsets = totals.select("_part", *[before_partition(v, f"_o_{n}") for v, n in values.items()])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = split.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v, n in values.items()})
    out = out.join(broadcast_if_small(offsets), "_part").withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in values.values()})
    base = out.groupBy(*keys).agg(*[F.min(n).alias(f"_b_{n}") for n in values.values()])
    out = with_same(out, base, keys).withColumns({n: F.col(n) - F.col(f"_b_{n}") for n in values.values()})
    return out.select(*table.columns, *values.values())


def quantiles(df: DataFrame, keys: list[str], value: Column | str, shares: list[float], name: str = "quantiles", label: str = "quantiles", limit: int = WINDOW_ROWS) -> DataFrame:
    """Per key the exact quantiles of the values as an array (linear between the two nearest, nulls left out; null without values).

    A distributed selection: values are counted, counts are summed over the values before (beyond ``limit``
    rows over range partitions), and the two order statistics of each share are picked and blended. No task
    or buffer holds the values of a key.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, value.cast("double").alias("_v"))
    counts = rows.groupBy(*keys, "_v").agg(F.count("_v").alias("_c"))  # a null counts 0, so that its key stays
    counts = sums_before(counts, keys, [F.col("_v").asc_nulls_last()], {"_c": "_less"}, label, limit)
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    counts = with_same(counts, sizes, keys)
    at = lambda place: F.max(F.when((F.col("_less") <= place) & (place < F.col("_less") + F.col("_c")), F.col("_v")))
    picks = []
    for k, share in enumerate(shares):
        place = (F.col("_n") - 1) * F.lit(float(share))
        picks += [at(F.floor(place)).alias(f"_lo{k}"), at(F.ceil(place)).alias(f"_hi{k}")]
    out = counts.groupBy(*keys, "_n").agg(*picks)
    blends = []
    for k, share in enumerate(shares):
        place = (F.col("_n") - 1) * F.lit(float(share))
        blends.append(F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (place - F.floor(place)))
    return out.select(*keys, F.when(F.col("_n") > 0, F.array(*blends)).alias(name))


def median(df: DataFrame, keys: list[str], value: Column | str, name: str, label: str = "median") -> DataFrame:
    """Per key the exact median (null without values), by ``quantiles``."""
    return quantiles(df, keys, value, [0.5], "_q", label).select(*keys, F.element_at("_q", 1).alias(name))
