"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are cut into pieces; two within the radius share ``pieces - radius`` of them, so rows
that meet under some choice of that many pieces hold every link. Rows of one key, sorted, lie in
neighbouring lanes; their fingerprints are stored as 64 bit planes of 64 lanes a word. Shifting all
planes by d compares every row with the one d places on; carry-save adders count the differing
planes, sixteen planes at a time, and words (blocks of 64 lanes) in which every lane has passed the
radius are abandoned. A key with many rows is cut into chunks, and pairs of chunks go to tasks of
their own. Of the links found only a spanning forest is emitted, so a dense group of n fingerprints
makes n rows and not n squared, and no connection is lost.

Nulls, ties, odd rows: a null or wordless text has fingerprint zero and links like any other; a text
of fewer words than a shingle is one shingle; a bit set in exactly half the shingles is 0; rows that
repeat, or have null ids, are one result row each, and a component with no id at all has a null
component_id. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetlab.llm.components import components
from onsetlab.llm.text import kept_rows, per_text, text_key
from onsetlab.staging import staged

RADIUS = 4
SHINGLE = 4
PIECES = 6
#: Rows of a key that one task compares at most; beyond it pairs of chunks are tasks of their own.
CHUNK = 1024
#: Lanes that are compared at once, and links that are held before they are merged.
LANES = 1 << 15
HELD_LINKS = 1 << 17


def shingle_hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The XXH64 of every shingle of a text, in order; none for a text without words."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII only
    if not tokens:
        return np.empty(0, np.uint64)
    line = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    return np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)


def simhash(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint of one text: bit b is 1 if it is set in over half the shingles' XXH64."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero for none."""
    n = len(hashes)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint's 64 bits as a signed long)."""

    def prints(texts: list) -> list[np.ndarray]:
        return [np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64)]

    return per_text(docs, ["doc_id", text_key("text").alias("text_key")], lambda: prints, "fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """The fingerprints stored vertically: row b holds bit b of every lane, 64 lanes a word, one spare word."""
    lanes = -(-len(fps) // 64) * 64
    padded = np.zeros(lanes, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    return np.concatenate([planes, np.zeros((64, 1), np.uint64)], axis=1)


def _add(planes: list[np.ndarray], counter: list[np.ndarray]) -> None:
    """Carry-save: add bit planes of weight 1 to a vertical counter whose last plane is sticky."""
    column = list(planes)
    for weight in range(len(counter) - 1):
        column.append(counter[weight])
        carries = []
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            x = a ^ b
            column.append(x ^ c)
            carries.append((a & b) | (x & c))
        if len(column) == 2:
            a, b = column
            column, carries = [a ^ b], [*carries, a & b]
        counter[weight] = column[0]
        column = carries
    for carry in column:
        counter[-1] |= carry


def close_lanes(planes: np.ndarray, words: np.ndarray, shift: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the given words of lanes, those with a lane within the radius of the lane ``shift`` on: (word, lane mask)."""
    far, bit = divmod(shift, 64)
    last = planes.shape[1] - 1
    size = (radius + 1).bit_length()
    counter = [np.zeros(len(words), np.uint64) for _ in range(size + 1)]
    over = np.zeros(len(words), np.uint64)
    for group in range(0, 64, 16):
        own = planes[group : group + 16]
        low, high = np.minimum(words + far, last), np.minimum(words + far + 1, last)
        other = own[:, low] >> np.uint64(bit)
        if bit:
            other |= own[:, high] << np.uint64(64 - bit)
        _add(list(own[:, words] ^ other), counter)
        # A lane is over when its count passes the radius: the sticky plane, or the low planes compared with it.
        more, same = counter[-1].copy(), ~counter[-1]
        for weight in range(size - 1, -1, -1):
            if radius >> weight & 1:
                same = same & counter[weight]
            else:
                more |= same & counter[weight]
                same = same & ~counter[weight]
        over = more
        alive = over != np.uint64(0xFFFFFFFFFFFFFFFF)
        if not alive.all():  # abandon the blocks that have passed the radius in every lane
            words, over, counter = words[alive], over[alive], [c[alive] for c in counter]
        if not len(words):
            break
    return words, ~over


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of the linked rows (i, j) in ``root``, where every row points to the least it reaches."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return
        np.minimum.at(root, a, b)
        np.minimum.at(root, b, a)
        while (root != root[root]).any():
            root[:] = root[root]


def close_pairs(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows (i, j) of an equal key whose fingerprints are within the radius, in parts.

    Rows of one key must be neighbours.
    """
    n = len(fps)
    if n < 2:
        return
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[begins, n])
    order = np.argsort(-lengths, kind="stable")  # longest runs first: the lanes still in use are then a prefix
    sizes = lengths[order]
    ends = np.cumsum(sizes)
    lane = np.repeat(begins[order] - (ends - sizes), sizes) + np.arange(n)
    left = np.repeat(ends, sizes) - np.arange(n)  # rows from the lane to its run's end
    planes, held, held_n = bit_planes(fps[lane]), [], 0
    for d in range(1, int(sizes[0])):
        used = int(ends[np.searchsorted(-sizes, -d, side="left") - 1])
        words, mask = close_lanes(planes, np.arange(-(-used // 64)), d, radius)
        if len(words):
            bits = np.unpackbits(mask.view(np.uint8)).reshape(-1, 8)[:, ::-1].reshape(-1)
            at = (words[:, None] * 64 + np.arange(64)).reshape(-1)[bits.astype(bool)]
            at = at[at < used]
            at = at[left[at] > d]
            held.append((lane[at], lane[at + d]))
            held_n += len(at)
        if held_n > HELD_LINKS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, held_n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def connect(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the least row it reaches over close pairs. Rows of one key must be neighbours."""
    root = np.arange(len(fps))
    for i, j in close_pairs(keys, fps, radius):
        _merge(root, i, j)
    return root


def _compare(radius: int):
    """Compare the rows of each task (neighbours in the partition); emit a star for each group that it connects."""

    def stars(task: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        root = connect(task, fp.view(np.uint64), radius)
        own = fp != fp[root]
        return pd.DataFrame({"u": fp[own], "v": fp[root][own]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_tasks(frames):
            yield stars(part["task"].to_numpy(), part["fp"].to_numpy())

    return run


def whole_tasks(frames: Iterator[pd.DataFrame], lanes: int = LANES) -> Iterator[pd.DataFrame]:
    """The rows of a partition again, in parts of about ``lanes`` that end with a task."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= lanes:
            rows = pd.concat(held, ignore_index=True)
            other = np.flatnonzero(rows["task"].to_numpy() != rows["task"].iat[-1])
            done = int(other[-1]) + 1 if len(other) else 0
            if done:
                yield rows.iloc[:done]
            held = [rows.iloc[done:]]
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def choices(radius: int = RADIUS, pieces: int = PIECES) -> list[int]:
    """Masks of which two fingerprints within the radius agree under at least one."""
    cuts = [round(64 * p / pieces) for p in range(pieces + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, pieces - radius)]


def links(fps: DataFrame, radius: int = RADIUS, pieces: int = PIECES, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that connect all that are within the radius."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(choices(radius, pieces))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    return tasks(rows, "fp", chunk).select("task", "fp").mapInPandas(_compare(radius), "u long, v long").distinct()


def tasks(rows: DataFrame, own: str, chunk: int = CHUNK, seed: int | None = None, with_: DataFrame | None = None) -> DataFrame:
    """Deal ``rows`` with a ``key`` into tasks (a column) that compare all pairs of a key's rows.

    The rows of a task are neighbours; a key of more than ``chunk`` rows is cut by the hash of the column
    ``own``, and its pairs of chunks are tasks. With a ``seed`` the chunks are cut by it, and only rows of
    one chunk meet. Keys of one row go. Keys are counted by an aggregate. ``with_`` has further columns by ``own``,
    which only the last exchange carries.
    """
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(staged(counts, "simhash-keys"), "key")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(own, F.lit(seed or 0)), parts).cast("int"))
    if seed is None:
        rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    else:
        rows = rows.withColumn("_other", F.col("_own"))
    task = F.when(parts == 1, F.col("key")).otherwise(
        F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    )
    rows = rows.withColumn("task", task).drop("n", "_own", "_other")
    rows = rows if with_ is None else rows.join(with_, own)
    return rows.repartition("task").sortWithinPartitions("task")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, text_key, fp and component_id, the smallest doc_id it reaches."""
    prints = staged(fingerprints(docs, words), "simhash-prints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    member = components(links(distinct.select("fp"), radius), "simhash-components")
    named = distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    named = staged(named, "simhash-members")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "component").select("fp", "component", "component_id")
    return prints.join(named, "fp")


def one_of_each(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """The documents with all their columns, one of each component: the smallest doc_id, first copy."""
    return first_of_each(docs, near_duplicates(docs, radius, words))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component of ``found`` (doc_id, text_key, component) the document with the smallest doc_id."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    best = staged(found.groupBy("component").agg(first.alias("b"), F.count("*").alias("n")), "simhash-first")
    best = best.select(F.col("b.doc_id").alias("doc_id"), F.col("b.text_key").alias("text_key"), "component", "n")
    mixed = found.join(best.filter("n > 1").select("component"), "component").select("doc_id", "text_key")
    return kept_rows(docs, mixed, best.filter("n > 1").select("doc_id", "text_key"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
