"""Spelling variant grouping: words one edit apart, found by dense tiles of code-point matrices.

Two words are near if one inserted, deleted or replaced code point turns one into the other: their common
prefix and common suffix together reach the longer length minus one. A single edit leaves the first half or
the rest of the shorter word as it is, so near words of lengths n and n or n+1 meet under the first n // 2
code points or under the last ones. The words of such a key are compared in tiles: padded code-point
matrices, row blocks against row blocks, giving all prefix and suffix lengths of a block at once. A key of
many words is cut into tiles by a hash, and each pair of tiles is a task of its own, so no task grows with
a key. A pair counts where its prefix is the key, and else under its suffix: once.

Words are counted in the tasks first and only partial counts are shuffled; a variant's root is found by
pointer doubling over its forms, whose counts at least double at each step.

Nulls, ties, odd rows: a null text has no words; a null id is written as the empty string where it is
hashed; equal counts go to the smaller word in code-point order; repeated rows count each; an empty table
gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onsetlab.staging import staged

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LEAST_LENGTH, LEAST_COUNT, EVERY = 5, 3, 97
#: Words of a key that one tile holds, and rows that a task compares at a time (whole pairs of tiles).
TILE, ROWS = 512, 1 << 15
#: Code points of a matrix; wider words are compared in smaller blocks.
CELLS = 1 << 22
#: Distinct words, and bytes of them, that a task counts before it hands them on.
HELD_WORDS, HELD_BYTES = 1 << 20, 64 << 20


# --- counting ---


def _count(least: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        size = 0
        out = lambda: pa.RecordBatch.from_pydict(
            {"word": pa.array(list(held), type=pa.binary()).cast(pa.string()), "n": pa.array(list(held.values()), type=pa.int64())}
        )
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                seed = zlib.crc32(f"{number}:".encode())
                for run_, n in Counter(RUN.findall(text)).items():
                    if len(run_) < least:
                        continue
                    word = run_.encode().translate(LOWER)
                    h = zlib.crc32(word, seed)
                    if h % every == 0:
                        if len(run_) == least:
                            continue
                        plain, at = word.decode(), h % len(run_)
                        word = (plain[:at] + plain[at + 1 :]).encode()
                    if word in held:
                        held[word] += n
                    else:
                        held[word] = n
                        size += len(word)
                if len(held) > HELD_WORDS or size > HELD_BYTES:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    return run


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, at_least: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word and n: lower-cased runs of letters, those whose hash ``every`` divides short of one code point."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("number"), "text")
    counted = rows.mapInArrow(_count(least, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least)


# --- near words ---


def matrices(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, padded with zeros: aligned at their begin, and reversed, aligned at their end."""
    width = words.dtype.itemsize // 4
    begin = np.ascontiguousarray(words).view(np.uint32).reshape(len(words), width)
    at = size[:, None] - 1 - np.arange(width)
    return begin, np.where(at >= 0, np.take_along_axis(begin, np.maximum(at, 0), axis=1), 0)


def near_in_tiles(task: np.ndarray, words: np.ndarray, short: np.ndarray, side: np.ndarray, by_prefix: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of equal tasks whose words are one edit apart. Rows of a task must be neighbours.

    ``short`` is the shorter length of a task's pairs, ``side`` tells the two tiles of a task apart, which meet
    ``across`` only where they are two, and ``by_prefix`` whether the task's key is a prefix.
    """
    found_i, found_j = [], []
    size = np.array([len(w) for w in words])
    classes = np.ceil(np.log2(np.maximum(short, 8) + 1)).astype(int)  # so that a long word widens no other matrix
    for c in np.unique(classes):
        rows = np.flatnonzero(classes == c)
        cells = words[rows].astype(f"U{size[rows].max()}")
        step = max(1, CELLS // int(size[rows].max()))  # rows that one matrix may hold
        whole = matrices(cells, size[rows]) if len(rows) <= step else None
        runs = np.flatnonzero(np.r_[True, task[rows][1:] != task[rows][:-1], True])
        ends = np.repeat(runs[1:], np.diff(runs))
        for d in range(1, int(np.diff(runs).max())):
            i = np.flatnonzero(np.arange(len(rows)) + d < ends)
            a, b = rows[i], rows[i + d]
            i = i[(np.minimum(size[a], size[b]) == short[a]) & (~across[a] | (side[a] != side[b]))]
            for x in np.split(i, range(step, len(i), step)):
                a, b = rows[x], rows[x + d]
                left = [m[x] for m in whole] if whole else matrices(cells[x], size[a])
                right = [m[x + d] for m in whole] if whole else matrices(cells[x + d], size[b])
                prefix, suffix = ((p != q).argmax(axis=1) for p, q in zip(left, right, strict=True))
                near = prefix + suffix >= np.maximum(size[a], size[b]) - 1
                near &= (prefix >= short[a] // 2) == by_prefix[a]
                found_i.append(a[near])
                found_j.append(b[near])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each word the near words that a part's tiles show: how many, and the most frequent one."""
    for part in _whole_tasks(frames):
        words, n = part["word"].to_numpy(dtype=object), part["n"].to_numpy()
        i, j = near_in_tiles(
            part["task"].to_numpy(), words, part["short"].to_numpy(), part["tile"].to_numpy(), part["by_prefix"].to_numpy(), part["across"].to_numpy()
        )
        a, b = np.r_[i, j], np.r_[j, i]
        pairs = pd.DataFrame({"word": words[a], "near": words[b], "near_n": n[b]})
        pairs = pairs.sort_values(["word", "near_n", "near"], ascending=[True, False, True])
        first = pairs.drop_duplicates("word")
        yield first.assign(n_near=pairs.groupby("word").size().reindex(first["word"]).to_numpy())


def _whole_tasks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a partition, sorted by task, in parts of about ``ROWS`` that end with a task."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= ROWS:
            rows = pd.concat(held, ignore_index=True)
            other = np.flatnonzero(rows["task"].to_numpy() != rows["task"].iat[-1])
            done = int(other[-1]) + 1 if len(other) else 0
            if done:
                yield rows.iloc[:done]
            held = [rows.iloc[done:]]
    if sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def near_words(words: DataFrame, least: int = LEAST_LENGTH, tile: int = TILE) -> DataFrame:
    """word, n_near, near and near_n (the near word of largest n) of each word that has near words, among words of ``least`` code points or more."""

    def keys(short: Column) -> list[Column]:
        half = F.floor(short / 2).cast("int")
        parts = F.substring("word", F.lit(1), half), F.right(F.col("word"), short - half)
        return [F.struct(F.xxhash64(F.lit(k), short, p).alias("key"), short.alias("short"), F.lit(k == 0).alias("by_prefix")) for k, p in enumerate(parts)]

    size = F.char_length("word")
    rows = words.select("word", "n", F.inline(F.array(*keys(size), *keys(size - 1)))).filter(F.col("short") >= least)
    counts = rows.groupBy("key").agg(F.count("*").alias("m"), F.min(size - F.col("short")).alias("longer"))
    counts = staged(counts.filter("m > 1 and longer = 0").select("key", "m"), "variants-keys")
    rows = rows.join(counts, "key")
    parts = F.ceil(F.col("m") / tile).cast("int")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("word"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    rows = rows.withColumn("task", F.xxhash64("key", low, high)).withColumn("across", F.col("tile") != F.col("other"))
    # In a task of two tiles all rows are ``across``; a tile alone meets itself under its own number.
    rows = rows.select("task", "word", "n", "short", "tile", "by_prefix", "across").repartition("task").sortWithinPartitions("task")
    found = rows.mapInPandas(_compare, "word string, near string, near_n long, n_near long")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return found.select("word", "n_near", F.col("first.near").alias("near"), (-F.col("first.less")).alias("near_n"))


# --- forms and roots ---


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where following ``form`` (null: none) from the word ends. Pointers double their reach each round."""
    state = staged(forms.select("word", F.coalesce("form", "word").alias("root")), "variants-roots")
    while True:
        ahead = state.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = state.join(ahead, F.col("root") == F.col("at")).select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        moved = staged(moved, "variants-roots")
        state = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return state


def variants(docs: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n; the form is the near word of largest n where that is ``times`` the word's n or more."""
    words = staged(word_counts(docs), "variants-words")
    out = words.join(near_words(words), "word", "left")
    has = F.col("near_n") >= times * F.col("n")
    out = out.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n"),
    )
    out = staged(out, "variants-forms")
    return out.join(roots(out), "word").select("word", "form", "root", "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    return variants(docs)
