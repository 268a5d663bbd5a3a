"""Expressions that the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from onsetlab.staging import staged

SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column | str) -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def text_key(text: Column | str) -> Column:
    return F.xxhash64(whole(text))


def numbered(df: DataFrame) -> DataFrame:
    """Number the rows that share (doc_id, text_key), so that repeated rows can be told apart in a join."""
    w = Window.partitionBy("doc_id", "text_key").orderBy(F.lit(0))
    return df.withColumn("copy_no", F.row_number().over(w))


def attach(docs: DataFrame, decisions: DataFrame, columns: list[str]) -> DataFrame:
    """Join per-row decisions, keyed by (doc_id, text_key), back to ``docs`` as one struct column ``decided``.

    Repeated rows pair off one to one; null ids match null ids. The columns of ``docs`` come back
    under ``row``, so no name of theirs can clash.
    """
    left = numbered(docs.select(F.struct("*").alias("row"), F.col("doc_id"), text_key("text").alias("text_key")))
    right = numbered(decisions.select("doc_id", "text_key", F.struct(*columns).alias("decided")))
    keys = ("doc_id", "text_key", "copy_no")
    left, right = left.alias("l"), right.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return left.join(right, on).select("l.row", "r.decided")


#: Bits of the table that ``maybe_in`` broadcasts; 64 of them are a row, so it has 524,288 rows at most.
HIT_BITS = 1 << 25


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame, outside: bool = False) -> DataFrame:
    """The rows whose ``key`` (a long) may be in the one column of ``keys``, without a shuffle of ``rows``.

    All keys set bits of one table of fixed size, which is broadcast. No row with a key is lost; some
    without one stay, more of them the fuller the table is, and a join behind it decides. ``outside``
    gives the other rows, which have none of the keys.
    """
    slot = lambda k: F.pmod(F.xxhash64(k, F.lit(91)), F.lit(HIT_BITS))
    name = "__slot"
    bit = F.expr(f"shiftleft(1L, cast({name} & 63 as int))")
    bits = keys.select(slot(F.col(keys.columns[0])).alias(name)).groupBy(F.shiftright(name, 6).alias("__word"))
    bits = F.broadcast(bits.agg(F.bit_or(bit).alias("__bits")))
    marked = rows.withColumn(name, slot(key))
    marked = marked.join(bits, F.shiftright(name, 6) == F.col("__word"), "left" if outside else "inner")
    hit = F.coalesce(F.col("__bits"), F.lit(0)).bitwiseAND(bit) != 0
    return marked.filter(~hit if outside else hit).drop(name, "__word", "__bits")


def kept_rows(docs: DataFrame, mixed: DataFrame, stay: DataFrame) -> DataFrame:
    """``docs`` without those rows of ``mixed`` that are not in ``stay`` (both doc_id and text_key).

    Of rows that repeat in doc_id and text, ``stay`` keeps as many as it names. Only rows that may be in
    ``mixed`` are shuffled.
    """
    row_key = lambda: F.xxhash64("doc_id", "text_key")
    hits = staged(mixed.select(row_key().alias("k")).distinct(), "kept-hits")
    inner = docs.select(F.struct("*").alias("row"), F.col("doc_id"), text_key("text").alias("text_key"))
    sure = maybe_in(inner, row_key(), hits, outside=True).select("row.*")
    maybe = numbered(maybe_in(inner, row_key(), hits)).alias("d")
    keys = ("doc_id", "text_key")
    in_mixed = mixed.distinct().select("doc_id", "text_key", F.lit(True).alias("was")).alias("m")
    on = lambda a, b, k: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in k]
    tagged = maybe.join(in_mixed, on("d", "m", keys), "left").select("d.*", "m.was").alias("d")
    named = numbered(stay).select(*keys, "copy_no", F.lit(True).alias("stays")).alias("s")
    tagged = tagged.join(named, on("d", "s", (*keys, "copy_no")), "left")
    return sure.unionByName(tagged.filter("d.was is null or s.stays").select("d.row.*"))


def give_back() -> None:
    """Free memory of Arrow and of the C library goes back to the system, as workers live on after a task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def per_text(docs: DataFrame, keep: list[Column | str], make: Callable[[], Callable], fields: str, at_once: int = 1024, with_text: bool = False) -> DataFrame:
    """The ``keep`` columns of every row and what Python makes of its text, batch by batch in Arrow.

    ``make`` is called once in each task and gives a function from a list of texts to one sequence per
    field of the DDL ``fields``. The kept columns never pass through Python objects, so null ids next
    to large ones stay exact. ``at_once`` bounds the texts of a call, and with them what Python holds.
    ``with_text`` gives the text back as well, as ``__text``. A ``done`` of the function is called when the
    task ends, and free memory goes back.
    """
    new = StructType.fromDDL(fields)
    rows = docs.select(*keep, F.col("text").alias("__text"))
    kept = len(rows.columns) - (not with_text)
    schema = StructType(rows.schema.fields[:kept] + new.fields)
    types = [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        parts = (b.slice(k, at_once) for b in batches for k in range(0, b.num_rows, at_once))
        for batch in parts:
            made = work(batch.column(batch.num_columns - 1).to_pylist())
            arrays = batch.columns[:kept] + [pa.array(m, type=t) for m, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())
        getattr(work, "done", lambda: None)()
        give_back()

    return rows.mapInArrow(run, schema)


def per_row(docs: DataFrame, run: Callable[..., DataFrame]) -> tuple[DataFrame, list[Column]]:
    """What ``run(docs, keep, with_text)`` makes of every row, and the columns of ``docs`` in its result.

    The text goes to Python once, the other columns as one struct, so that no name of theirs can clash.
    """
    others = [c for c in docs.columns if c != "text"]
    made = run(docs, [F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")], True)
    return made, [F.col("__text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
