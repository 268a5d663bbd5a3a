"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer.

Documents are encoded whole; only their lengths leave the tasks, and map-side partial counts make
the shuffle as small as the number of distinct lengths. With the suffix sums of documents and tokens,
each row answers the context limit that equals its length: the tokens left after truncation, the
documents cut, and the share of documents at or below it (so every quantile, too).

Nulls, ties, odd rows: a null or empty text has length 0 and counts as a document; repeated rows
count each; an empty table gives an empty histogram. Only ``text`` is read. Long runs of white space, which
the pattern's engine cannot hold on its stack, are encoded beside the pattern, with the same ids.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetlab.llm.text import per_text
from onsetlab.staging import broadcast_if_small, staged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern's class of it, in runs that are encoded apart.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1024,}")
#: Lengths whose suffix sums one task makes; the blocks' totals are summed apart.
BLOCK = 1024
#: Bytes of a vocabulary file that are sent to the executors at most.
VOCABULARY_BYTES = 64 << 20

_encodings: dict[str, object] = {}


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver alone; the executors get the bytes
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return data


def encoding(path: str, data: bytes):
    """The byte-level BPE of a vocabulary file, made once in a worker."""
    if path not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        _encodings[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def whole_encoder(coder) -> Callable[[str], list[int]]:
    """The ids of a text of any kind and length.

    The pattern takes a run of white space before another character as one part, all but its last character,
    and a run at the text's end as one part; long runs are cut out just so and go to the merges directly.
    """

    def encode(text: str) -> list[int]:
        ids, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += coder.encode_ordinary(text[at : run.start()])
            ids += coder._encode_single_piece(text[run.start() : end])
            at = end
        return ids + coder.encode_ordinary(text[at:]) if at else coder.encode_ordinary(text)

    return encode


def byte_names() -> dict[str, int]:
    """The byte behind each visible character of a byte-level vocabulary: printable bytes are themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def byte_level(vocabulary: dict[str, int]) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """An encoder for a byte-level vocabulary written in visible characters, and the bytes of every id.

    Its ids rank the merges; the strings of special tokens are plain text.
    """
    import tiktoken

    byte_of = byte_names()
    of = [b""] * (max(vocabulary.values()) + 1)
    for entry, k in vocabulary.items():
        of[k] = bytes(map(byte_of.__getitem__, entry))
    ranks = {b: k for k, b in enumerate(of) if b}
    return whole_encoder(tiktoken.Encoding("entries", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})), of


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every document."""
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def make():
        encode = whole_encoder(encoding(vocabulary, data.value))
        return lambda texts: [[len(encode(t)) if t else 0 for t in texts]]

    return per_text(docs, ["doc_id"], make, "n_tokens long")


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row per encoded length: n_docs, and from suffix sums what a context limit of that length leaves.

    Columns: n_tokens, n_docs, docs_at_least, tokens_at_least, truncated_total, docs_cut, share_at_most.
    """
    counts = staged(lengths.groupBy(F.col(length).alias("n_tokens")).agg(F.count("*").alias("n_docs")), "lengths")
    block = F.floor(F.col("n_tokens") / BLOCK)
    rows = counts.withColumn("block", block).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # One row per BLOCK lengths, so this window stays small whatever the number of documents.
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    sums = sums.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(every).alias("d_all"),
        F.sum("t").over(every).alias("t_all"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(broadcast_if_small(sums), "block")
    docs = F.sum("n_docs").over(inside) + F.col("d_after")
    tokens = F.sum("tokens").over(inside) + F.col("t_after")
    cut = F.col("docs_at_least") - F.col("n_docs")
    return (
        out.withColumn("docs_at_least", docs)
        .withColumn("tokens_at_least", tokens)
        .select(
            "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
            (F.col("t_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
            cut.alias("docs_cut"),
            ((F.col("d_all") - cut) / F.col("d_all")).alias("share_at_most"),
        )
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: total tokens, tokens left after truncation, documents cut.

    Each limit is answered by the suffix sums at the least length beyond it; an empty histogram gives zeros.
    """
    beyond = [F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("n_tokens") > x, F.col("n_tokens"))).alias(f"l{x}") for x in limits]
    row = hist.agg(F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("total"), *beyond)
    none = F.lit(0).cast("long")

    def answer(x: int) -> Column:
        cut, gone = (F.coalesce(F.col(f"l{x}")[c], none) for c in ("docs_at_least", "tokens_at_least"))
        left = F.col("total") - gone + cut * F.lit(x)
        return F.struct(F.lit(x).cast("long").alias("context_limit"), F.col("total"), left.alias("truncated_total"), cut.alias("docs_cut"))

    return row.select(F.inline(F.array(*[answer(int(x)) for x in sorted(set(limits))])))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """For each share q the least length that at least q of all documents do not pass."""
    picks = [F.min(F.when(F.col("share_at_most") >= q, F.col("n_tokens"))).alias(f"q{q:g}") for q in shares]
    return hist.agg(*picks)


def query(docs: DataFrame) -> DataFrame:
    return histogram(lengths(docs))
