"""SimHash near-dedup at a stated similarity: every pair of at least 0.8 on word shingles is linked.

This is the bit-sliced comparison of ``simhash`` at a wide radius, with candidates that lose no such
pair and a check in full behind it:

* Fingerprints are taken over the set of a text's shingles. Sets of similarity 0.8 differ in about ten
  bits; at ``RADIUS`` fewer than one such pair in a million is missed, and most unrelated pairs go.
* Fingerprints meet under shingles. In one order of all shingles two sets of similarity 0.8 share one
  among the first ``n - ceil(0.8 n) + 1`` of each. Any order is exact; here shingles in buckets that
  many documents hit come last, so that a common line is in few prefixes. The hits are counted over all
  documents, in a table of fixed size.
* Keys that the same nodes share make the same pairs: one of them stays (nodes are told by their number and 128 bits).
* The rows of a key are compared as bit planes, and then by odd sketches: bit b of a set's sketch is the parity
  of its shingles that fall to b, so two sketches differ in no more bits than the sets in shingles. Sets that
  differ in more than a ninth of their sizes' sum are below 0.8, so a pair whose sketches do goes, and no other:
  texts of a large group that are alike, but below 0.8, make no pairs. Long sets have longer sketches.
* What remains is compared by the whole sets (64-bit shingles).

Only components matter. Texts of equal shingles are one node. In a round the rows of a key meet in chunks,
dealt anew each time, and every node tries its few nearest, which joins a large group of near copies with
a few rows for each copy; rounds go on while they join many. Then all pairs of a key that are still in different
components are compared, and no pair leaves its task: a first pass gives the rows that have a pair left, a second
one gets their whole sets and gives only links that join two groups, fewer than its rows.

Nulls, ties, odd rows: null and wordless texts have no shingle and are one node; a text of fewer words
than a shingle is one shingle; rows that repeat, or have null ids, are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetlab.llm.components import components
from onsetlab.llm.simhash import close_pairs, first_of_each, majority, tasks, whole_tasks
from onsetlab.llm.text import give_back, maybe_in, per_text, text_key
from onsetlab.staging import drop_staged, staged

WORDS = 5
#: Differing bits at which pairs are still checked in full, and those of pairs that the rounds try.
RADIUS, NEAR = 28, 12
#: Nearest nodes that a node tries in a round.
NEAREST = 3
#: Buckets in which hits of shingles are counted, and how many of them go last.
BUCKETS, LAST = 20, 1 << 16
#: Bits of a set's odd sketch, the most that a long set has, and pairs of sketches that are compared at once.
SKETCH, SKETCH_MOST, SKETCHES = 1024, 8192, 1 << 14
#: Rows with whole sets that Python holds, but for a task of more.
SETS = 1024
#: Texts that Python holds the shingles of.
AT_ONCE = 512
#: Cross pairs, as a multiple of the rows, that are compared without another round.
PAIRS_A_ROW = 1
#: Another round follows one that links more than a row in so many.
WORTHWHILE = 500
#: Bytes of texts that are hashed at once, more where a text is longer.
PIECE = 1 << 18

_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, np.int8)
_SPACE[list(b" \t\n\r\x0b\x0c")] = 1
_VALUE = np.cumsum(np.full(256, 0xC2B2AE3D27D4EB4F, np.uint64)) ** np.uint64(3)  # odd and even, all different
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)], dtype=np.uint64)
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of every word (run without ASCII white space, A-Z as a-z) a 64-bit hash, a sum of weighted bytes, and its place."""
    part = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[part], prepend=np.int8(1), append=np.int8(1)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers_to(len(part))
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_VALUE[part] * power[: len(part)], out=total[1:])
    return _mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def prefix_length(n: int) -> int:
    """How many first shingles of a set of n hold one of each set of similarity 0.8."""
    return n - -(-4 * n // 5) + 1 if n else 0


def odd_sketch(shingles: np.ndarray, bits: int = SKETCH) -> bytes:
    """Of each of the bits (a power of two) the parity of the shingles that fall to it. Half the bits: the halves' xor."""
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1).tobytes()


def sketch_bits(n: int) -> int:
    """Bits of the sketch of a set of n: twice to four times as many, within bounds."""
    return min(max(SKETCH, 2 << max(n - 1, 0).bit_length()), SKETCH_MOST)


def maybe_similar(sketch: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of rows may have a similarity of 0.8 or more, by their sketches (rows of words) and sizes.

    Two sets differ in at least as many shingles as their sketches in bits, and at 0.8 in at most a ninth of a + b.
    """
    out = np.empty(len(i), bool)
    for at in range(0, len(i), SKETCHES):
        a, b = i[at : at + SKETCHES], j[at : at + SKETCHES]
        differ = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
        out[at : at + SKETCHES] = 9 * differ <= size[a] + size[b]
    return out


def sketches_fit(sketch: list[bytes], size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``maybe_similar`` for sketches of any lengths, each pair at the lesser length of its two."""
    length = np.array([len(x) for x in sketch])
    least, out = np.minimum(length[i], length[j]), np.empty(len(i), bool)
    for bytes_ in np.unique(least):
        at = np.flatnonzero(least == bytes_)
        own = np.unique(np.r_[i[at], j[at]])
        folded = np.empty((len(own), bytes_ // 8), np.uint64)
        for longer in np.unique(length[own]):
            rows = np.flatnonzero(length[own] == longer)
            words = np.frombuffer(b"".join([sketch[k] for k in own[rows]]), np.uint64)
            folded[rows] = np.bitwise_xor.reduce(words.reshape(len(rows), longer // bytes_, -1), axis=1)
        out[at] = maybe_similar(folded, size[own], np.searchsorted(own, i[at]), np.searchsorted(own, j[at]))
    return out


def _similar(both, a, b):
    """Whether sets of sizes a and b with ``both`` in common have a similarity of 0.8 or more."""
    return 9 * both >= 4 * (a + b)


def _shingled(h: np.ndarray, words: int) -> np.ndarray:
    n = len(h) - words + 1
    x = np.full(max(0, n), words, np.uint64)
    for j in range(words if n > 0 else 0):
        x = _mixed((x + h[j : j + n]) * np.uint64(_ODD))
    return x


def shingles(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Of each text the distinct shingles as mixed hashes of their words, ascending."""
    held: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size < PIECE and k < len(texts) - 1:
            continue
        h, place = word_hashes(b"\n".join(held))
        ends = np.searchsorted(place, np.cumsum([len(t) + 1 for t in held])).tolist()
        x, begin = _shingled(h, words), 0
        for end in ends:
            n = end - begin
            yield np.unique(x[begin : end - words + 1] if n >= words else _shingled(h[begin:end], n)) if n else h[:0]
            begin = end
        held, size = [], 0


def frequent(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """At most ``LAST`` buckets of shingles that many documents hit, by rising hits.

    Every task counts all its documents in one array; a bucket that a share of all documents hits is hit
    by that share in some task, so only such buckets leave it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, n = np.zeros(1 << BUCKETS, np.int32), 0
        for batch in batches:
            for s in shingles(batch.column(0).to_pylist(), words):
                hits[s >> np.uint64(64 - BUCKETS)] += 1
            n += batch.num_rows
        often = np.flatnonzero((hits > 1) & (hits.astype(np.int64) * 512 >= n))
        yield pa.RecordBatch.from_arrays([pa.array(often), pa.array(hits[often], pa.int64())], names=["bucket", "n"])

    counts = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "bucket").limit(LAST).collect()  # bounded by LAST
    return np.array([r.bucket for r in reversed(top)], np.int64)


def prefixes(docs: DataFrame, last: np.ndarray, words: int = WORDS) -> DataFrame:
    """doc_id, text_key, node (the hash of the set), fp, size, the odd sketch and the prefix of every document."""
    ranks = docs.sparkSession.sparkContext.broadcast(last)

    def make():
        from xxhash import xxh64_intdigest

        rank_of = np.zeros(1 << BUCKETS, np.int32)
        rank_of[ranks.value] = np.arange(1, len(ranks.value) + 1)

        def work(texts: list) -> list:
            node, fp, size, sketch, prefix = [], [], [], [], []
            for s in shingles(texts, words):
                node.append(xxh64_intdigest(s.tobytes(), 7))
                fp.append(majority(s))
                size.append(len(s))
                sketch.append(odd_sketch(s, sketch_bits(len(s))))
                rank = rank_of[s >> np.uint64(64 - BUCKETS)]
                prefix.append(s[np.argsort(rank, kind="stable")[: prefix_length(len(s))]].view(np.int64))
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            return [signed(node), signed(fp), size, sketch, prefix]

        return work

    fields = "node long, fp long, size int, sketch binary, prefix array<long>"
    return per_text(docs, ["doc_id", text_key("text").alias("text_key")], make, fields, AT_ONCE)


def _sets(docs: DataFrame, members: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The whole sets (node, shingles) of the nodes that are ``wanted``, as a written table."""
    one = members.select("node", "text_key").join(wanted, "node").groupBy("node").agg(F.min("text_key").alias("text_key"))
    one = staged(one, "near-wanted")
    texts = maybe_in(docs.select(text_key("text").alias("text_key"), "text"), F.col("text_key"), one.select("text_key"))
    texts = texts.join(one, "text_key").select("node", "text")  # a text that repeats gives its set again

    def sets(texts: list) -> list:
        return [[s.view(np.int64) for s in shingles(texts, words)]]

    made = staged(per_text(texts, ["node"], lambda: sets, "shingles array<long>", AT_ONCE).dropDuplicates(["node"]), "near-sets")
    drop_staged(one)
    return made


def _verified(docs: DataFrame, members: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Of the pairs (u, v) of nodes those of similarity 0.8 or more, by their whole sets, as a written table."""
    pairs = staged(pairs, "near-pairs")
    sets = _sets(docs, members, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), words)
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    # Written between, so that each join is one of two plain shuffles and can be split at a frequent node.
    half = staged(pairs.join(left, "u"), "near-halves")
    both = F.size(F.array_intersect("a", "b"))
    found = staged(half.join(right, "v").filter(_similar(both, F.size("a"), F.size("b"))).select("u", "v"), "near-edges")
    for table in (pairs, sets, half):
        drop_staged(table)
    return found


def _several(part: pd.DataFrame) -> pd.DataFrame:
    """The rows of those tasks that have more than one component."""
    c, task = part["c"].to_numpy(), part["task"].to_numpy()
    begins = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
    some = np.minimum.reduceat(c, begins) < np.maximum.reduceat(c, begins)
    return part[np.repeat(some, np.diff(np.r_[begins, len(c)]))]


def _nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each row of a task the nearest rows of other components, by bit planes."""
    for part in map(_several, whole_tasks(frames)):
        node, c, fp, task = (part[k].to_numpy() for k in ("node", "c", "fp", "task"))
        for i, j in close_pairs(task, fp.view(np.uint64), NEAR):
            other = c[i] != c[j]
            i, j = np.r_[i[other], j[other]], np.r_[j[other], i[other]]
            far = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int32)
            order = np.lexsort((node[j], far, i))
            i, j, far = i[order], j[order], far[order]
            begins = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else i
            place = np.arange(len(i)) - np.repeat(begins, np.diff(np.r_[begins, len(i)]))
            first = place < NEAREST
            yield pd.DataFrame({"a": node[i[first]], "o": node[j[first]], "far": far[first]})
    give_back()


def _left(part: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i, j) of a task's rows in different components that planes, sizes and sketches leave, in parts."""
    size, sketch = part["size"].to_numpy(np.int64), part["sketch"].tolist()
    c, fp, task = (part[k].to_numpy() for k in ("c", "fp", "task"))
    for i, j in close_pairs(task, fp.view(np.uint64), RADIUS):
        fits = (c[i] != c[j]) & _similar(np.minimum(size[i], size[j]), size[i], size[j])
        i, j = i[fits], j[fits]
        fits = sketches_fit(sketch, size, i, j)
        yield i[fits], j[fits]


def _candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of every task that are left, by their nodes (u, v) and their rows (i, j) of the frame."""
    for part in frames:
        node = part["node"].to_numpy()
        for i, j in _left(part):
            u, v = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            yield pd.DataFrame({"u": u, "v": v, "i": i, "j": j})


def _marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each task that are in a pair which is left, once each."""
    for part in map(_several, whole_tasks(frames)):
        mark = np.zeros(len(part), bool)
        for pairs in _candidates(iter([part])):
            mark[pairs["i"]] = mark[pairs["j"]] = True
        yield part.loc[mark, ["task", "node", "fp", "size", "c"]]
    give_back()


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (u, v) of similarity 0.8 by whole sets, that join two groups of the rows at hand: fewer than these."""
    for part in whole_tasks(frames, SETS):
        sets = [s.view(np.uint64) for s in part["shingles"]]
        part = part.drop(columns="shingles").reset_index(drop=True)
        part["sketch"] = [odd_sketch(s, sketch_bits(len(s))) for s in sets]
        node, size, fp = part["node"].to_numpy(), part["size"].to_numpy(np.int64), part["fp"].to_numpy()
        own = np.unique(part["c"], return_inverse=True)[1].tolist()  # rows of a component are one group from the start
        root, found = list(range(len(own))), []

        def group(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for i, j in _left(part):
            order = np.argsort(np.bitwise_count(fp[i] ^ fp[j]), kind="stable")  # the likely ones first
            for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
                x, y = group(own[a]), group(own[b])
                if x == y:
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if _similar(both, size[a], size[b]):
                    root[x] = y
                    found.append((a, b))
        at = np.array(found, np.int64).reshape(-1, 2)
        yield pd.DataFrame({"u": node[at[:, 0]], "v": node[at[:, 1]]})
    give_back()


def _open_rows(state: DataFrame) -> DataFrame:
    """The rows of those keys that have more than one component."""
    several = state.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    return state.join(staged(several.select("key"), "near-open"), "key")


def _shared(members: DataFrame) -> DataFrame:
    """node, fp, size, key of the keys of several nodes; of keys with the same nodes one stays."""
    nodes = members.select("node", "fp", "size", "prefix").dropDuplicates(["node"])
    rows = nodes.select("node", "fp", "size", F.explode("prefix").alias("key"))
    # By aggregates with partial sums; the join behind them can be split at a frequent key.
    mark = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"s{seed}")
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), mark(1), mark(2)).filter("n > 1")
    keys = staged(keys.groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).select("key"), "near-keys")
    return staged(rows.join(keys, "key"), "near-shared")


def _last_links(docs: DataFrame, members: DataFrame, state: DataFrame, words: int) -> DataFrame:
    """Links (u, v) that join all components of ``state`` which a pair of similarity 0.8 joins."""
    sketches = members.select("node", "sketch").dropDuplicates(["node"])
    compared = tasks(_open_rows(state).select("key", "node", "fp", "size", "c"), "node", with_=sketches)
    marked = staged(compared.mapInPandas(_marked, "task long, node long, fp long, size int, c long"), "near-marked")
    sets = _sets(docs, members, marked.select("node").distinct(), words)
    rows = marked.join(sets, "node").repartition("task").sortWithinPartitions("task")
    found = staged(rows.mapInPandas(_joined, "u long, v long").distinct(), "near-edges")
    for table in (marked, sets):
        drop_staged(table)
    return found


def links(docs: DataFrame, members: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, component) of all nodes that are joined with another."""
    shared = _shared(members)
    n_rows = shared.count()
    edges, found, k = None, 0, 0
    state = shared.withColumn("c", F.col("node"))
    while True:
        # Pairs of a key in different components, counted from the keys' sums.
        parts = state.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key")
        parts = parts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"))
        open_pairs = parts.agg(F.sum((F.col("n") * F.col("n") - F.col("q")).cast("double")) / 2).first()[0] or 0
        if open_pairs <= PAIRS_A_ROW * n_rows or (k and found * WORTHWHILE <= n_rows):
            break
        met = tasks(state.select("key", "node", "fp", "c"), "node", seed=k + 1).mapInPandas(_nearest, "a long, o long, far int")
        met = met.distinct().groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "o"))), 1, NEAREST).alias("o"))
        tried = met.select("a", F.explode("o.o").alias("o")).select(F.least("a", "o").alias("u"), F.greatest("a", "o").alias("v"))
        new = _verified(docs, members, tried.distinct(), words)
        found, k = new.count(), k + 1
        edges = new if edges is None else edges.unionByName(new)
        labels = components(edges, "near-labels").withColumnRenamed("component", "c")
        now = staged(shared.join(labels, "node", "left").withColumn("c", F.coalesce("c", "node")), "near-state")
        if k > 1:
            drop_staged(state)
        state = now
    new = _last_links(docs, members, state, words)
    return components(new if edges is None else edges.unionByName(new), "near-components")


def near_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, text_key and component, which near copies share."""
    members = staged(prefixes(docs, frequent(docs, words), words), "near-prefixes")
    member = staged(links(docs, members, words), "near-member").withColumnRenamed("component", "c")
    named = members.select("doc_id", "text_key", "node").join(member, "node", "left")
    return named.select("doc_id", "text_key", F.coalesce("c", "node").alias("component"))


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents with all their columns, one of each component: the smallest doc_id, first copy."""
    return first_of_each(docs, near_copies(docs, words))
