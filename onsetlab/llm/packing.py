"""Best-fit packing: token pieces into as few sequences as can be, after Martello-Toth dominance reduction.

Documents are encoded whole in the tasks, closed with an end id and cut only where they are longer than a
sequence. Pieces of one length can stand for each other, so the instance is the histogram of lengths, which
has at most as many rows as a sequence has tokens, however large the corpus. On it the driver first fixes,
as often as both sides last, each small set that provably dominates all others with its largest piece (no
optimal packing is lost by that), and deals the remainder by best fit in decreasing order, many equal pieces
at a time. The result names places by rank: the k-th piece in the order of lengths goes there. Spark ranks
the pieces by a range partitioning, so a length that a third of all pieces share is spread over tasks.

Nulls, ties, odd rows: a null or empty text is the end id alone; pieces of equal length are ranked by id,
piece number and checksum, so only rows that agree in all of them can change places; repeated rows are
packed each; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Callable, Iterator
from struct import pack as packed
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from onsetlab.llm.lengths import byte_names, read_vocabulary
from onsetlab.llm.text import per_text
from onsetlab.staging import staged, with_position

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
CAPACITY, END_ID = 4096, 1
#: Words whose ids a worker remembers, the longest such word, and code points of a text handled at once.
REMEMBERED, LONGEST, SLICE = 1 << 18, 64, 1 << 20
#: Words that NFC leaves as they are and whose lower case and classes are those of all Unicode versions, and their parts in lower case.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Places(NamedTuple):
    """``count`` pieces of one length, in order of rank: ``each`` of them go to ``sequence`` and to each one after it, from ``offset`` on."""

    length: int
    count: int
    sequence: int
    each: int
    offset: int


# --- encoding ---


def plain_words(model: dict) -> Callable[[str], list[int]] | None:
    """The ids of a word of ``PLAIN`` letters, digits and signs, by the merges of a BPE with word ends; None if its ids do not rank the merges.

    A word end is written as a byte that UTF-8 does not have, which the first merge of a part joins to its last character.
    """
    import tiktoken

    vocabulary, end = model["vocab"], b"\xff"
    merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if None in merged or merged != sorted(merged) or model["end_of_word_suffix"] != "</w>":
        return None
    byte_of, ranks = byte_names(), {end: len(vocabulary) + 1}
    for entry, k in vocabulary.items():
        closed = entry.endswith("</w>") and entry != "</w>"
        body = entry[:-4] if closed else entry
        if all(c in byte_of for c in body) and end[0] not in (raw := bytes(byte_of[c] for c in body)):
            ranks[raw + end * closed] = k
    encode = tiktoken.Encoding("parts", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    return lambda word: [i for part in PARTS.findall(word.lower()) for i in encode(part.encode() + end)]


def word_encoder(data: bytes) -> Callable[[str], bytes]:
    """From a text to its ids, as little-endian 32-bit numbers, for a vocabulary whose words end at white space.

    Its pattern drops white space and no match crosses it, so the parts between spaces and line feeds are
    encoded apart, and the ids of short ones are remembered. Plain words go to the merges directly; all
    others (other scripts and signs, special tokens) to the library.
    """
    from tokenizers import Tokenizer

    library, plain = Tokenizer.from_buffer(data), plain_words(json.loads(data)["model"])
    memory: dict[str, bytes] = {}

    def encoded(word: str) -> bytes:
        if plain and PLAIN.fullmatch(word) and "<|" not in word:
            ids = plain(word)
        else:
            ids = library.encode(word, add_special_tokens=False).ids
        return packed(f"<{len(ids)}I", *ids)

    def ids(text: str) -> bytes:
        out, at = [], 0
        while at < len(text):  # long texts slice by slice, cut at a space
            end = len(text) if len(text) - at <= SLICE else text.find(" ", at + SLICE)
            end = len(text) if end < 0 else end
            words = text[at:end].replace("\n", " ").split(" ")
            made = {w: encoded(w) for w in {w for w in words if w not in memory}}
            if len(memory) + len(made) > REMEMBERED:
                made.update((w, memory[w]) for w in words if w in memory)
                memory.clear()
            long = any(len(w) > LONGEST for w in made)
            memory.update((w, b) for w, b in made.items() if len(w) <= LONGEST)
            out.append(b"".join(map((lambda w: made.get(w) or memory[w]) if long else memory.__getitem__, words)))
            at = end + 1
        return b"".join(out)

    return ids


_encoders: dict[str, Callable[[str], bytes]] = {}


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def make():
        if vocabulary not in _encoders:  # made once in a worker
            _encoders[vocabulary] = word_encoder(data.value)
        encode = _encoders[vocabulary]

        def run(texts: list[str | None]) -> tuple[list[int], list[list[int]]]:
            sizes, sums = [], []
            for text in texts:
                ids = encode(text or "") + end
                sizes.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[k : k + step]) for k in range(0, len(ids), step)])
            return sizes, sums

        return run

    rows = per_text(docs, ["doc_id"], make, "n long, sums array<long>")
    rows = rows.select("doc_id", "n", F.posexplode("sums").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("long") * capacity
    length = F.least(F.col("n") - start, F.lit(capacity).cast("long"))
    return rows.select("doc_id", "piece", start.alias("start"), length.alias("length"), "ids_crc32")


# --- the packing of a histogram ---


def dominating(largest: int, left: dict[int, int], sizes: list[int], capacity: int) -> tuple[int, ...] | None:
    """A set of at most three pieces with ``largest`` that dominates every other set that holds it; None if none is found.

    ``sizes`` are the lengths still there, ascending. A set dominates another one if the other's pieces can
    be dealt to its own so that each takes no more than its length: swapping the two then never costs a sequence.
    """
    room = capacity - largest
    count = lambda s: left[s] - (s == largest)  # noqa: E731  (others than the piece itself)
    fits = [s for s in sizes[: bisect.bisect_right(sizes, room)] if count(s)]
    if not fits:
        return (largest,)
    most = fits[-1]
    if most == room:
        return (largest, most)
    least: list[int] = []
    for s in fits:
        least += [s] * min(count(s), 3 - len(least))
        if len(least) == 3:
            break
    if len(least) < 2 or least[0] + least[1] > room:  # one more fits, so the largest that does
        return (largest, most)
    if len(least) == 3 and sum(least) <= room:
        return None
    # At most two more fit. The larger of any two is at most ``most``; look at what its partner can be.
    found = np.array(fits)
    low = found[2 * found <= room]
    at = np.searchsorted(found, room - low, side="right") - 1
    single = np.array([count(int(s)) < 2 for s in low], dtype=bool)
    paired = (found[at] > low) | ~single
    if not paired.any():
        return (largest, most)
    low, high = low[paired], found[at][paired]
    if int((low + high).max()) <= most:  # both together take no more than the largest alone
        return (largest, most)
    partner = [s for s in fits[: bisect.bisect_right(fits, room - most)] if count(s) - (s == most) > 0]
    if partner and partner[-1] >= int(low.max()):
        return (largest, most, partner[-1])
    return None


def reduce(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Take dominating sets out of ``left`` (length to count) for good until no more are found: sets and how often each."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(left)
    changed = True
    while changed:
        changed = False
        for size in reversed(list(sizes)):
            while left.get(size) and (chosen := dominating(size, left, sizes, capacity)):
                # The set still dominates while its lengths last: what it is compared with only gets fewer.
                times = min(left[s] // chosen.count(s) for s in chosen)
                fixed.append((chosen, times))
                for s in chosen:
                    left[s] -= times
                for s in {s for s in chosen if not left[s]}:
                    del left[s]
                    sizes.remove(s)
                changed = True
    return fixed


def best_fit(left: dict[int, int], capacity: int, first: int) -> list[Places]:
    """Longest pieces first, each into the fullest sequence that has room; equal pieces and equal sequences are dealt at once."""
    out: list[Places] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left to ranges (first sequence, count) of sequences
    order: list[int] = []  # the rooms, ascending
    following = first

    def put(room: int, run: tuple[int, int]) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append(run)

    for size in sorted(left, reverse=True):
        open_ = left[size]
        while open_:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                room = order[at]
                begin, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, begin, n = capacity, following, -(-open_ // (capacity // size))
                following += n
            each = room // size
            full = min(n, open_ // each)
            if full:
                out.append(Places(size, full * each, begin, each, capacity - room))
                put(room - each * size, (begin, full))
                open_, begin, n = open_ - full * each, begin + full, n - full
            if n and 0 < open_ < each:  # the last ones do not fill a sequence
                out.append(Places(size, open_, begin, open_, capacity - room))
                put(room - open_ * size, (begin, 1))
                open_, begin, n = 0, begin + 1, n - 1
            if n:
                put(room, (begin, n))
    return out


def packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Places]:
    """Places for all pieces of a histogram of lengths (from 1 to ``capacity``): those fixed by dominance, then best fit."""
    left, out, following = dict(counts), [], 0
    for chosen, times in reduce(left, capacity):
        for k, size in enumerate(chosen):
            out.append(Places(size, times, following, 1, sum(chosen[:k])))
        following += times
    return out + best_fit(left, capacity, following)


# --- places for the pieces ---


def _assign(plan: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    starts, sequence, each, offset, length = plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column(batch.num_columns - 1).to_numpy()
            k = np.searchsorted(starts, position, side="right") - 1
            into = position - starts[k]
            made = [sequence[k] + into // each[k], offset[k] + into % each[k] * length[k]]
            names = [*batch.schema.names[:-1], "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, made)], names=names)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of at most ``capacity`` (and doc_id, piece, ids_crc32)."""
    pieces = staged(pieces, "packing-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = sorted(packing(counts, capacity), key=lambda p: p.length)  # stable: earlier places take lower ranks
    length, count, sequence, each, offset = (np.array(c, dtype=np.int64) for c in zip(*plan, strict=True)) if plan else [np.zeros(0, np.int64)] * 5
    ranked = with_position(pieces, ["length", "doc_id", "piece", "ids_crc32"], "position", "packing-order")
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    arrays = [np.cumsum(count) - count, sequence, each, offset, length]  # bounded by lengths and rooms, not by pieces
    return ranked.select(*pieces.columns, "position").mapInArrow(_assign(arrays), schema)


def query(docs: DataFrame) -> DataFrame:
    return pack(token_pieces(docs))
