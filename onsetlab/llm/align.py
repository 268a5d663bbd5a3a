"""Cross-tokenizer alignment: divide and conquer at cuts that two tokenizations share.

Both token sequences of a text cover the same bytes. An interval of tokens is cut at a common end near its
middle, which bisecting the other sequence's ends locates, and both halves are solved in the same way; an
interval without a common end is a leaf, one group of tokens of both sides. All open intervals of a batch of
documents take each step together. Within a group every token of one side is linked with every token of the other.

How many documents hold a pair of ids linked is counted over the whole corpus. Documents are handled in
chunks: a chunk's distinct pairs are its dictionary, its documents refer to it by number, and only
dictionaries are joined with the counts, so what is shuffled is far less than the links. Dictionaries and
documents of a chunk then meet again, one chunk at a time.

Nulls, ties, odd rows: a null or empty text, and one that either tokenizer does not give back byte by byte
(such as one with a literal space mark), has no tokens, zeros and an empty digest; all pairs of an id's
highest count are best; repeated rows count each; an empty table gives no rows. Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from onsetlab.llm.lengths import byte_level, read_vocabulary
from onsetlab.staging import staged

BYTES, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of a chunk, and bytes of text beyond which it is closed.
CHUNK, CHUNK_BYTES = 1024, 2 << 20
#: Pairs of one document or group that are made at a time.
AT_ONCE = 1 << 22
FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LISTS = "chunk long, at array<int>, times array<long>, pair array<long>, holders array<long>"


class Tokens(NamedTuple):
    """Ids of a batch, document after document, the places where documents begin (and the end), and where in the bytes each token ends."""

    ids: np.ndarray
    bounds: np.ndarray
    ends: np.ndarray


# --- tokenizers ---


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def tokenizers(bytes_data: bytes, pieces_data: bytes) -> tuple[list, list[list[bytes]]]:
    """Functions from texts to lists of ids for both sides (a space goes before the text), and the bytes of every id."""
    import sentencepiece

    encode, a = byte_level(json.loads(bytes_data)["model"]["vocab"])
    model = sentencepiece.SentencePieceProcessor(model_proto=pieces_data)
    b = [piece_bytes(model.id_to_piece(k)) for k in range(model.get_piece_size())]
    return [lambda texts: [encode(" " + t) for t in texts], lambda texts: model.encode(texts, num_threads=1)], [a, b]


# --- divide and conquer ---


def shared_cuts(a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which of the ends ``a`` are ends of ``b`` too. Both rise over the whole batch; each document's last end is shared."""
    cut = np.zeros(len(a), dtype=bool)
    last = bounds[1:][np.diff(bounds) > 0] - 1
    cut[last] = True
    low, high = bounds[:-1][np.diff(bounds) > 0], last  # candidates of an interval: from low up to before high
    reach = np.ones(len(low), dtype=np.int64)
    while True:
        open_ = high > low
        low, high, reach = low[open_], high[open_], reach[open_]
        if not len(low):
            return cut
        middle = (low + high) // 2
        left, right = np.maximum(low, middle - reach), np.minimum(high, middle + reach + 1)
        n = right - left
        begin = np.cumsum(n) - n
        at = np.repeat(left - begin, n) + np.arange(n.sum())
        common = b[np.searchsorted(b, a[at])] == a[at]
        away = np.where(common, 2 * np.abs(at - np.repeat(middle, n)) + (at < np.repeat(middle, n)), np.iinfo(np.int64).max)
        nearest = np.minimum.reduceat(away, begin)
        found = nearest < np.iinfo(np.int64).max
        at = middle + np.where(found, np.where(nearest % 2, -(nearest // 2), nearest // 2), 0)
        cut[at[found]] = True
        # A cut interval gives its two halves, one that was not seen whole is looked at further, the others are
        # leaves. They stay in order, so that the next ends are bisected in order too.
        again = ~found & ((left > low) | (right < high))
        k = np.repeat(np.arange(len(low)), np.where(found, 2, again))
        half = np.r_[False, k[1:] == k[:-1]] if len(k) else np.zeros(0, dtype=bool)
        reach = np.where(found[k], 1, reach[k] * 4)
        low, high = np.where(half, at[k] + 1, low[k]), np.where(found[k] & ~half, at[k], high[k])


def groups_of(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The group, counted over the batch, of each token of both sides."""
    cut = shared_cuts(a.ends, b.ends, a.bounds)
    # The ends of b that are cuts are found by their places; between them its tokens are of the next cut's group.
    own = np.zeros(len(b.ends), dtype=np.int64)
    own[np.searchsorted(b.ends, a.ends[cut])] = 1
    return np.cumsum(cut) - cut, np.cumsum(own) - own


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of sorted keys, where each begins and how often it is there."""
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[begin], begin, np.diff(np.r_[begin, len(keys)])


def _starts(groups: np.ndarray) -> np.ndarray:
    """Where each group (of rising numbers from 0 on, none left out) begins, and the end."""
    return np.r_[0, np.cumsum(np.bincount(groups))].astype(np.int64)


def linked_pairs(a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, pairs (a << 16 | b) and times of the distinct links of each document, by document and pair."""
    sides = []
    for ids, group in ((a.ids, group_a), (b.ids, group_b)):
        keys, _, times = _runs(np.sort(group << 16 | ids))
        sides.append((keys >> 16, keys & 0xFFFF, times))
    (in_a, id_a, n_a), (in_b, id_b, n_b) = sides
    starts = _starts(in_b)
    begin, width = starts[in_a], np.diff(starts)[in_a]
    doc = np.repeat(np.arange(len(a.bounds) - 1), np.diff(a.bounds))[_starts(group_a)[in_a]]
    upto = np.cumsum(width)
    parts, k = [], 0
    while k < len(in_a):
        stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + AT_ONCE, side="right")))
        w = width[k:stop]
        at = np.repeat(begin[k:stop] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        key = np.repeat(doc[k:stop] << 32 | id_a[k:stop] << 16, w) | id_b[at]
        parts.append(_summed(key, np.repeat(n_a[k:stop], w) * n_b[at]))
        k = stop
    key, times = _summed(*map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, dtype=np.int64),) * 2
    return key >> 32, key & 0xFFFFFFFF, times


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, begin, _ = _runs(keys[order])
    return keys, np.add.reduceat(times[order], begin) if len(begin) else times


# --- documents, chunk by chunk ---


class Aligner:
    """Encodes and aligns the texts of a chunk."""

    def __init__(self, bytes_data: bytes, pieces_data: bytes) -> None:
        self.encode, self.of = tokenizers(bytes_data, pieces_data)
        self.size = [np.array(list(map(len, of)), dtype=np.int64) for of in self.of]
        # The parts of a digest's input: an id with what stands behind it, inside its side of the group and at its end.
        tails = ("," , "|", ",", ";")
        self.written = [str(k) + tail for side, tail in zip((0, 0, 1, 1), tails, strict=True) for k in range(len(self.of[side]))]
        self.base = np.cumsum([0, len(self.of[0]), len(self.of[0]), len(self.of[1])])

    def tokens(self, texts: list[str | None]) -> tuple[Tokens, Tokens]:
        """Both sides of all texts; texts that are not given back get no tokens."""
        filled = [k for k, t in enumerate(texts) if t]
        sides: list[list] = [[[]] * len(texts) for _ in (0, 1)]
        encoded = [encode([texts[k] for k in filled]) for encode in self.encode]
        for k, ids_a, ids_b in zip(filled, *encoded, strict=True):
            want = (" " + texts[k]).encode()
            if all(b"".join(map(of.__getitem__, ids)) == want for of, ids in zip(self.of, (ids_a, ids_b), strict=True)):
                sides[0][k], sides[1][k] = ids_a, ids_b
        out = []
        for size, lists in zip(self.size, sides, strict=True):
            bounds = np.cumsum([0, *map(len, lists)])
            ids = np.concatenate([np.array(part, dtype=np.int64) for part in lists])
            out.append(Tokens(ids, bounds, np.cumsum(size[ids])))
        return out[0], out[1]

    def digests(self, a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
        """The SHA-256 of each document's groups as text; the empty string without tokens."""
        last = [np.r_[g[1:] != g[:-1], True] if len(g) else np.zeros(0, dtype=bool) for g in (group_a, group_b)]
        order = np.empty(len(a.ids) + len(b.ids), dtype=np.int64)
        # A token of one side stands behind all tokens of the other side in earlier groups (a's own group first).
        order[np.arange(len(a.ids)) + _starts(group_b)[group_a]] = a.ids + self.base[last[0].astype(int)]
        order[np.arange(len(b.ids)) + _starts(group_a)[group_b + 1]] = b.ids + self.base[2 + last[1].astype(int)]
        bounds, out = (a.bounds + b.bounds).tolist(), []
        for begin, end in zip(bounds, bounds[1:], strict=False):
            text = "".join(map(self.written.__getitem__, order[begin:end].tolist()))
            out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if text else "")
        return out

    def chunk(self, texts: list[str | None]) -> list[list]:
        """What ``FIELDS`` and ``LISTS`` (but the chunk) name, for every text; the first one carries the dictionary."""
        a, b = self.tokens(texts)
        group_a, group_b = groups_of(a, b)
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        links = np.bincount(group_a, minlength=n_groups) * np.bincount(group_b, minlength=n_groups)
        upto, until = np.r_[0, np.cumsum(links)], np.r_[group_a, n_groups][a.bounds]
        doc, pair, times = linked_pairs(a, b, group_a, group_b)
        dictionary, at = np.unique(pair, return_inverse=True)
        cuts = np.searchsorted(doc, np.arange(1, len(texts)))
        none = [None] * (len(texts) - 1)
        return [
            np.diff(a.bounds), np.diff(b.bounds), np.diff(until), np.diff(upto[until]), self.digests(a, b, group_a, group_b),
            np.split(at.astype(np.int32), cuts), np.split(times, cuts), [dictionary, *none], [np.bincount(at, minlength=len(dictionary)), *none],
        ]


_aligners: dict[tuple[str, ...], Aligner] = {}


def _aligner(paths: tuple[str, ...], data: list) -> Aligner:
    """The aligner of two vocabularies, made once in a worker."""
    if paths not in _aligners:
        _aligners[paths] = Aligner(*(d.value for d in data))
    return _aligners[paths]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    k = 0
    while k < batch.num_rows:
        stop = max(k + 1, min(k + CHUNK, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + CHUNK_BYTES, side="right"))))
        yield batch.slice(k, stop - k)
        k = stop


def aligned(docs: DataFrame, bytes_path: str = BYTES, pieces_path: str = PIECES) -> DataFrame:
    """doc_id and ``FIELDS`` of each document, its chunk, and its distinct links: numbers in the chunk's dictionary and times.

    The first document of a chunk carries the dictionary: the pairs, and how many documents of the chunk hold each.
    """
    spark = docs.sparkSession
    data = [spark.sparkContext.broadcast(read_vocabulary(p)) for p in (bytes_path, pieces_path)]
    rows = docs.select("doc_id", F.col("text").alias("__text"))
    new = StructType.fromDDL(f"{FIELDS}, {LISTS}")
    schema = StructType(rows.schema.fields[:1] + new.fields)
    types = [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner((bytes_path, pieces_path), data), TaskContext.get().partitionId() << 32
        for part in (s for batch in batches for s in _slices(batch)):
            made = aligner.chunk(part.column(1).to_pylist())
            made.insert(5, [number] * part.num_rows)
            number += 1
            arrays = [part.column(0), *(pa.array(m, type=t) for m, t in zip(made, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best: whether n is the highest of the pair's first id."""
    counts = chunks.select(F.inline(F.arrays_zip("pair", "holders"))).groupBy("pair").agg(F.sum("holders").alias("n"))
    counts = staged(counts.withColumn("a", F.shiftright("pair", 16)), "align-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row per id of the vocabulary at most
    return counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(keep: list[str], schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        n, best = np.zeros(counts.num_rows, dtype=np.int64), np.zeros(counts.num_rows, dtype=np.int64)
        at = counts["at"].to_numpy()
        n[at], best[at] = counts["n"].to_numpy(), counts["best"].to_numpy()
        lists = docs["at"].combine_chunks()
        bounds = np.cumsum(np.r_[0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)])
        at, times = lists.flatten().to_numpy(), docs["times"].combine_chunks().flatten().to_numpy()
        sums = [np.r_[0, np.cumsum(times * of[at])][bounds] for of in (best, n)]
        return pa.table([*(docs[c] for c in keep), *(pa.array(np.diff(s)) for s in sums)], schema=schema)

    return run


def alignment(docs: DataFrame, bytes_path: str = BYTES, pieces_path: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of every document."""
    chunks = staged(aligned(docs, bytes_path, pieces_path), "align-chunks")
    words = chunks.filter("pair is not null").select(F.col("chunk").alias("of"), F.posexplode("pair").alias("at", "pair"))
    words = words.join(pair_counts(chunks.filter("pair is not null")), "pair").select("of", "at", "n", "best")
    keep = ["doc_id", *StructType.fromDDL(FIELDS).fieldNames()]
    left = chunks.select("chunk", *keep, "at", "times")
    schema = StructType(left.select(*keep).schema.fields + StructType.fromDDL("n_best long, count_sum long").fields)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    return left.groupBy("chunk").cogroup(words.groupBy("of")).applyInArrow(_looked_up(keep, arrow), schema)


def query(docs: DataFrame) -> DataFrame:
    return alignment(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
