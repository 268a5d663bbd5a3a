"""Suffix-array deduplication of repeated 200-byte strings by distributed prefix doubling.

Ranks are names: equal strings have equal names, and the name of 2k bytes is made of the pair of names
k bytes apart. Inside a task the doubling runs from 1 to 128 bytes over whole texts; across documents
Spark sorts and counts positions by (name, name further on) at growing offsets, and a position stays
only while its name is neither unique nor past the threshold:

1. 64 bytes. Of the positions, each 200-byte window needs only one, its least 64-byte name (the
   leftmost, if tied): windows with the same content choose the same one. Positions whose 64-byte name
   is unique in the corpus are dropped, with all windows that chose them.
2. Up to 336 bytes: the stretch of all windows that chose the position. Where a second position has
   the same stretch, all these windows repeat and need no further rank.
3. 200 bytes. What is still open, by the windows' own names, among the distinct stretches that share
   the 64 bytes. Stretches go to one task by these 64 bytes; where more than ``GROUP`` share them, their
   windows are ranked by Spark row by row.

Every repeated window is found, wherever it starts; no pair of positions is formed.

Nulls, ties, odd rows: a null or short text (under 200 bytes) loses nothing; a string that repeats in
one document, or overlaps itself, is repeated; rows that repeat, or have null ids, are documents of
their own, so their texts are repeated. An empty table gives an empty result. Names of 64 bits are only
compared together with those of the level before. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onsetlab.llm.text import text_key, whole
from onsetlab.staging import staged

#: Bytes of a repeated string, and of the names that choose positions.
LENGTH, SEED = 200, 64
SPAN = LENGTH - SEED + 1
#: Stretches of the same 64 bytes that one task ranks.
GROUP = 4096
#: Bytes that are named at once.
AT_ONCE = 1 << 18
ANCHOR = "h long, c long, key long, pos long"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    x = a * _A
    x += b
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the 64 and of the 128 bytes at every position, by doubling."""
    name, half = (data.astype(np.uint64) + np.uint64(1)) * _B, 1
    while half < 64:
        name = _pair(name[:-half], name[half:])
        half *= 2
    return name, _pair(name[:-half], name[half:])


def chosen(name: np.ndarray) -> np.ndarray:
    """For each window of ``SPAN`` names the position of the least, the leftmost if tied."""
    value, place, width = name, np.arange(len(name), dtype=np.int32), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        take = value[step:] < value[:-step]
        value = np.where(take, value[step:], value[:-step])
        place = np.where(take, place[step:], place[:-step])
        width += step
    return place


def stretches(data: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """The chosen positions of texts laid end to end: 64-byte name, stretch's name, text key, start * 512 + length."""
    short, long = names(data)
    place = chosen(short)
    n = len(place)  # windows, those across texts too
    text = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    inside = np.flatnonzero(text[:n] == text[LENGTH - 1 : LENGTH - 1 + n])
    if not len(inside):
        return [np.empty(0, np.int64)] * 4
    at = place[inside]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)])
    lo, hi = inside[first], inside[np.r_[first[1:], len(inside)] - 1]
    at, size = at[first], hi - lo + LENGTH
    shape = ((at - lo) * 512 + size).astype(np.uint64)
    c = _pair(_pair(long[lo], long[lo + np.minimum(104, size - 128)]), _pair(long[lo + size - 128], shape))
    own = text[lo]
    start = lo - np.r_[0, ends][own]
    return [short[at].view(np.int64), c.view(np.int64), keys[own], start * 512 + size]


def _chunks(texts: list[bytes], keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of at least 200 bytes, laid end to end in runs of about ``AT_ONCE`` bytes."""
    held, own, size = [], [], 0
    for text, key in zip(texts, keys, strict=True):
        if len(text) >= LENGTH:
            held.append(text)
            own.append(key)
            size += len(text)
            if size >= AT_ONCE:
                yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(t) for t in held]), np.array(own)
                held, own, size = [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(t) for t in held]), np.array(own)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        for data, ends, keys in _chunks(texts, batch.column(0).to_numpy(zero_copy_only=False)):
            columns = stretches(data, ends, keys)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "c", "key", "pos"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the open stretches of each text."""
    for batch in batches:
        out = {k: [] for k in ("h", "many", "open", "key", "start", "content")}
        for key, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for w in wanted:
                start, size = divmod(w["pos"], 512)
                for k, v in zip(out, (w["h"], w["many"], w["open"], key, start, text[start : start + size]), strict=True):
                    out[k].append(v)
        types = (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


STRETCH = "h long, many boolean, open boolean, key long, start long, content binary"


def _windows(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of the stretches: its row, its place in the row, its name."""
    content = batch.column("content").to_pylist()
    sizes = np.array([len(c) for c in content])
    _, long = names(np.frombuffer(b"".join(content), np.uint8))
    begin = np.cumsum(sizes) - sizes
    n = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = begin[row] + place
    return row, place, _pair(long[at], long[at + LENGTH - 128])


def _spans(key: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring window starts (sorted by row, then place) as byte spans of the text."""
    if not len(key):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["key", "lo", "hi"])
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[first[1:], len(key)] - 1
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[first], start[first], start[last] + LENGTH)], names=["key", "lo", "hi"])


def _rank_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank the windows of stretches that share their 64 bytes (neighbours in the partition)."""

    def rank(table: pa.Table) -> pa.RecordBatch:
        h = table.column("h").to_numpy()
        row, place, name = _windows(table)
        _, same, count = np.unique(_pair(h[row].view(np.uint64), name), return_inverse=True, return_counts=True)
        found = (count[same] > 1) & table.column("open").to_numpy()[row]
        return _spans(table.column("key").to_numpy()[row[found]], (table.column("start").to_numpy()[row] + place)[found])

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if len(held) < GROUP or not len(held):
            continue
        h = held.column("h").to_numpy()
        other = np.flatnonzero(h != h[-1])
        done = int(other[-1]) + 1 if len(other) else 0
        if done:
            yield rank(held.slice(0, done))
            held = held.slice(done)
    if held is not None and len(held):
        yield rank(held)


def _list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the stretches as a row, for groups that no one task should hold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        for at in range(0, len(table), 1024):
            part = table.slice(at, 1024)
            row, place, name = _windows(part)
            of = lambda c: part.column(c).to_numpy()[row]  # noqa: B023, E731
            columns = [of("h"), name.view(np.int64), of("key"), of("start") + place, of("open")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "name", "key", "start", "open"])


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its spans."""
    for batch in batches:
        removed, runs, digests = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text, merged = text or b"", []
            for s in sorted((s["lo"], s["hi"]) for s in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            edges = [0, *(x for s in merged for x in s), len(text)]
            digest = hashlib.sha256()
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                digest.update(memoryview(text)[a:b])
            removed.append(sum(b - a for a, b in merged))
            runs.append(len(merged))
            digests.append(digest.hexdigest())
        sizes = [len(t or b"") for t in batch.column(1).to_pylist()]
        arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated(docs: DataFrame) -> DataFrame:
    """Per document what is left without the bytes of repeated strings: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = docs.select("doc_id", text_key("text").alias("key"), whole("text").cast("binary").alias("content"))
    anchors = staged(texts.select("key", "content").mapInArrow(_anchors, ANCHOR), "substrings-64")
    # Written first: a join whose two sides are plain shuffles can be split where one name is very common.
    again = staged(anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "substrings-again")
    open64 = staged(anchors.join(again, "h"), "substrings-open")

    classes = open64.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("one"))
    classes = staged(classes, "substrings-stretches")
    known = open64.join(classes.filter("n > 1").select("h", "c"), ["h", "c"]).select(
        "key", F.floor(F.col("pos") / 512).alias("lo"), (F.floor(F.col("pos") / 512) + F.col("pos") % 512).alias("hi")
    )
    groups = classes.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1")
    wanted = classes.join(groups, "h").select(
        F.col("one.key").alias("key"),
        F.struct("h", (F.col("m") > GROUP).alias("many"), (F.col("n") == 1).alias("open"), F.col("one.pos").alias("pos")).alias("w"),
    )
    wanted = staged(wanted.groupBy("key").agg(F.collect_list("w").alias("wanted")), "substrings-wanted")

    first = texts.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))).filter("copy = 1")
    cut = first.join(wanted, "key").select("key", "content", "wanted").mapInArrow(_cut, STRETCH)
    cut = staged(cut, "substrings-cut")
    few = cut.filter("not many").repartition("h").sortWithinPartitions("h").mapInArrow(_rank_groups, "key long, lo long, hi long")
    rows = cut.filter("many").mapInArrow(_list_windows, "h long, name long, key long, start long, open boolean")
    twice = rows.groupBy("h", "name").agg(F.count("*").alias("n")).filter("n > 1").select("h", "name")
    many = rows.filter("open").join(twice, ["h", "name"]).select("key", F.col("start").alias("lo"), (F.col("start") + LENGTH).alias("hi"))

    spans = known.unionByName(few).unionByName(many).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return texts.join(staged(spans, "substrings-spans"), "key", "left").select("doc_id", "content", "spans").mapInArrow(_rest, out)


def query(docs: DataFrame) -> DataFrame:
    return repeated(docs)
