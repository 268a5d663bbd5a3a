"""Document fingerprints: an invertible Bloom lookup sketch of paragraph digests.

A text's paragraphs (lines, long ones in runs of ``WORDS`` words) become 40-bit digests; each digest is
added to three of twelve cells, which sum counts, digests and checks. The fingerprint is these cells.
Two fingerprints are subtracted cell by cell, so shared paragraphs cancel, and peeling the cells that
hold one digest recovers the differing ones with their multiplicity. Where peeling gets stuck, it is
tried again larger: the digests are dealt by a fresh hash to as many sketches of 24 cells as their
number asks for, and what fails there to four times as many, until all is recovered. Likeness is the share of
paragraphs in common, (a + b - d) / (a + b + d) for a and b paragraphs of which d differ.

Everything is DataFrame work: the arrays of a row are summed and peeled in place; text moves once by
document and a quarter of it once more, to the document before.

Nulls, ties, odd rows: a null text is empty; two texts without paragraphs have likeness 1; documents of
one doc_id follow in the order of their text's hash, a null doc_id comes last; rows that repeat in
doc_id and text are one document, whose next one is the next that differs (itself, if there is none).
An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetlab.llm.text import text_key, whole
from onsetlab.staging import drop_staged, staged, with_position

WORDS = 48
CELLS, RETRY_CELLS, TABLES = 12, 24, 3
#: Differing paragraphs that a sketch of ``RETRY_CELLS`` should hold at most, and the share of an edited
#: and of an unrelated text's paragraphs that is expected to differ: first guesses that cost time if wrong.
LOAD, EXPECTED = 12, (0.5, 1.0)
KEY_BITS, CHECK_BITS = 40, 30
PARAGRAPH = rf"[^\x20\x09-\x0D]+(?:[\x20\x09]+[^\x20\x09-\x0D]+){{0,{WORDS - 1}}}"


def digests(text: Column) -> Column:
    """The digests of a text's paragraphs, with repeats."""
    mask = F.lit((1 << KEY_BITS) - 1)
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p).bitwiseAND(mask))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1)).bitwiseAND(F.lit((1 << CHECK_BITS) - 1))


def _cells_of(key: Column, level: int, cells: int) -> Column:
    """The key's cells as a bit mask, one in each of the tables (whose sizes are powers of two)."""
    size, r = cells // TABLES, F.xxhash64(key, F.lit(level))
    ones = [
        F.call_function("shiftleft", F.lit(1 << (t * size)), F.shiftright(r, 8 * t).bitwiseAND(F.lit(size - 1)).cast("int"))
        for t in range(TABLES)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), ones)


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), k.cast("long").alias("k"), c.cast("long").alias("c"))


def _has(mask: Column, cell: Column) -> Column:
    return F.call_function("shiftright", mask, cell).bitwiseAND(F.lit(1)) == 1


def sketch(keys: Column, level: int = 0, cells: int = CELLS) -> Column:
    """The cells (count, sum of digests, sum of checks) of an array of digests."""
    marked = F.transform(keys, lambda k: F.struct(k.alias("k"), _check(k).alias("c"), _cells_of(k, level, cells).alias("m")))
    zero = _cell(F.lit(0), F.lit(0), F.lit(0))

    def cell(i: Column) -> Column:
        add = lambda s, x: F.when(_has(x["m"], i), _cell(s["n"] + 1, s["k"] + x["k"], s["c"] + x["c"])).otherwise(s)
        return F.aggregate(marked, zero, add)

    return F.transform(F.array(*map(F.lit, range(cells))), cell)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"] - y["k"], x["c"] - y["c"]))


def peel(subtracted: Column, level: int = 0, cells: int = CELLS) -> Column:
    """How many digests (with multiplicity) the subtracted cells hold; null where peeling gets stuck."""

    def single(c: Column) -> Column:
        k = F.try_divide(c["k"] - F.try_mod(c["k"], c["n"]), c["n"]).cast("long")
        return (c["n"] != 0) & (F.try_mod(c["k"], c["n"]) == 0) & (k >= 0) & (c["c"] == c["n"] * _check(k))

    def found(left: Column) -> Column:
        k = lambda c: F.try_divide(c["k"], c["n"]).cast("long")
        one = lambda c: F.struct(k(c).alias("k"), c["n"].alias("n"), _check(k(c)).alias("c"), _cells_of(k(c), level, cells).alias("m"))
        return F.array_distinct(F.transform(F.filter(left, single), one))

    def without(left: Column, keys: Column) -> Column:
        def take(cell: Column, i: Column) -> Column:
            less = lambda s, x: F.when(
                _has(x["m"], i), _cell(s["n"] - x["n"], s["k"] - x["n"] * x["k"], s["c"] - x["n"] * x["c"])
            ).otherwise(s)
            return F.aggregate(keys, cell, less)

        return F.transform(left, take)

    def state(left: Column, d: Column, keys: Column) -> Column:
        return F.struct(left.alias("cells"), d.cast("long").alias("d"), keys.alias("keys"))

    def turn(s: Column, _: Column) -> Column:
        # The keys found last are taken out, then looked for again; without keys nothing changes.
        left = without(s["cells"], s["keys"])
        d = s["d"] + F.aggregate(s["keys"], F.lit(0).cast("long"), lambda a, x: a + F.abs(x["n"]))
        return F.when(F.size(s["keys"]) == 0, s).otherwise(
            F.element_at(F.transform(F.array(left), lambda c: state(c, d, found(c))), 1)
        )

    start = F.element_at(F.transform(F.array(subtracted), lambda c: state(c, F.lit(0), found(c))), 1)
    ended = F.aggregate(F.array(*map(F.lit, range(cells))), start, turn)
    empty = lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0)
    return F.element_at(
        F.transform(F.array(ended), lambda s: F.when(F.forall(s["cells"], empty), s["d"])), 1
    )


def told(cells: Column) -> Column:
    """A sketch as text."""
    return F.lower(F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["c"]))), "-"))


def _retry(units: DataFrame, level: int) -> DataFrame:
    """Deal the digests of failed units to several sketches each and try these: row_id, pair, x, y, d."""
    differ = (F.size("x") + F.size("y")) * F.element_at(F.array(*map(F.lit, EXPECTED)), F.col("pair") + 1)
    parts = F.lit(4) if level > 1 else F.pow(F.lit(2), F.greatest(F.ceil(F.log2(differ / LOAD)), F.lit(0))).cast("int")
    both = F.concat(
        F.transform("x", lambda k: F.struct(k.alias("k"), F.lit(True).alias("own"))),
        F.transform("y", lambda k: F.struct(k.alias("k"), F.lit(False).alias("own"))),
    )
    dealt = units.withColumn("parts", parts).repartition("row_id").select("row_id", "pair", "unit", "parts", F.explode(both).alias("p"))
    part = F.pmod(F.xxhash64("p.k", F.lit(1000 + level)), F.col("parts"))
    grouped = dealt.withColumn("unit", F.xxhash64("unit", part)).groupBy("row_id", "pair", "unit").agg(
        F.collect_list(F.when(F.col("p.own"), F.col("p.k"))).alias("x"),
        F.collect_list(F.when(~F.col("p.own"), F.col("p.k"))).alias("y"),
    )
    x, y = (sketch(F.col(c), level, RETRY_CELLS) for c in ("x", "y"))
    return grouped.withColumn("d", peel(subtract(x, y), level, RETRY_CELLS))


def _retried(units: DataFrame) -> DataFrame:
    """row_id, pair and d of the failed first attempts, from ever larger ones."""
    solved, level = None, 0
    while not units.isEmpty():
        level += 1
        tried = staged(_retry(units, level), "iblt-retry")
        done = staged(tried.filter("d is not null").groupBy("row_id", "pair").agg(F.sum("d").alias("d")), "iblt-solved")
        solved = done if solved is None else solved.unionByName(done)
        units = staged(tried.filter("d is null").drop("d"), "iblt-failed")
        drop_staged(tried)
    return solved


def _with_next(docs: DataFrame) -> DataFrame:
    """Every row with its text, digests and sketch, and the head, digests and sketch of the next document.

    Both sides of the last join read the same columns of the same rows, so the texts are shuffled once.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"), text_key("text").alias("text_key"), whole("text").alias("text"),
    )
    rows = rows.withColumn("own", digests(F.col("text"))).withColumn("s_own", sketch(F.col("own")))
    keys = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"), text_key("text").alias("text_key"),
        F.char_length(whole("text")).alias("n"),
    ).dropDuplicates(["id_key", "text_key"])
    place = with_position(keys, [F.col("doc_id").asc_nulls_last(), "text_key"], "at", "iblt-order")
    total = place.count()
    before = place.select(
        F.pmod(F.col("at") + 1, F.lit(max(total, 1))).alias("at"),
        F.col("id_key").alias("to_id"), F.col("text_key").alias("to_key"), F.floor(F.col("n") / 4).cast("int").alias("q"),
    )
    wanted = staged(place.select("id_key", "text_key", "at").join(before, "at").drop("at"), "iblt-wanted")
    # A running count, not a row number: a limit on row numbers would be pushed below the shared shuffle.
    so_far = Window.partitionBy("id_key", "text_key").orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, 0)
    first = rows.withColumn("copy", F.count("*").over(so_far)).filter("copy = 1")
    sent = first.join(wanted.hint("shuffle_merge"), ["id_key", "text_key"]).select(
        F.col("to_id").alias("id_key"), F.col("to_key").alias("text_key"),
        F.substring("text", F.lit(1), F.col("q")).alias("head"), F.col("own").alias("next"), F.col("s_own").alias("s_next"),
    )
    out = rows.join(sent.hint("shuffle_merge"), ["id_key", "text_key"])
    return out.withColumn("doc_id", F.expr("try_cast(id_key AS bigint)")).drop("id_key", "text_key")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and their likenesses; see ``query``."""
    n = F.char_length("text")
    rows = _with_next(docs).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.col("head"))
    )
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "own", "s_own", digests(F.col("edited")).alias("edited"), "next", "s_next",
    )
    rows = rows.withColumn("s_edited", sketch(F.col("edited")))
    rows = staged(
        rows.select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id", "n_chars", "edited_sha256", "own", "edited", "next",
            told(F.col("s_own")).alias("fingerprint"), told(F.col("s_edited")).alias("edited_fingerprint"),
            peel(subtract(F.col("s_own"), F.col("s_edited"))).alias("d0"),
            peel(subtract(F.col("s_own"), F.col("s_next"))).alias("d1"),
        ),
        "iblt-rows",
    )
    tries = F.array(
        F.struct(F.lit(0).alias("pair"), F.col("edited").alias("y"), F.col("d0").alias("d")),
        F.struct(F.lit(1).alias("pair"), F.col("next").alias("y"), F.col("d1").alias("d")),
    )
    failed = rows.select("row_id", F.col("own").alias("x"), F.explode(F.filter(tries, lambda t: t["d"].isNull())).alias("t"))
    failed = staged(failed.select("row_id", "t.pair", F.lit(0).cast("long").alias("unit"), "x", "t.y"), "iblt-failed")
    later = _retried(failed)
    if later is not None:
        later = later.groupBy("row_id").agg(
            F.sum(F.when(F.col("pair") == 0, F.col("d"))).alias("e0"), F.sum(F.when(F.col("pair") == 1, F.col("d"))).alias("e1")
        )
        rows = rows.join(later, "row_id", "left").withColumns({"d0": F.coalesce("d0", "e0"), "d1": F.coalesce("d1", "e1")})

    def likeness(other: str, d: str) -> Column:
        both = F.size("own") + F.size(other)
        return F.when(both == 0, F.lit(1.0)).otherwise((both - F.col(d)) / (both + F.col(d)))

    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("edited", "d0").alias("near_edited"), likeness("next", "d1").alias("near_next"),
    )


def query(docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
