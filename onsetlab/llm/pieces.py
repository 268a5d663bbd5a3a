"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton reads the text once; at each position its output links name every piece that ends
there, and each relaxes that position. For a unigram model the best sum of scores wins; the query finds
this path for every model. For a model built by merges the path is the merge order's: a piece may follow another only if merging the two
side by side gives these two again, and just one piece at each position can follow the best path to
its start, so the same single pass finds exactly the merge order's ids (no merge can cross the border
of two neighbours that stand on their own). A character in no piece falls back to its UTF-8 bytes.
Decoding undoes encoding for every text.

No piece holds a space mark after another character, so a path passes through the start of each run
of marks (and both sides of a character in no piece): chunks between such places are solved apart and
remembered in the worker, up to a fixed number.

Nulls, ties, odd rows: a null or empty text has no pieces and decodes to the empty text; equal scores
go to the longest piece (unigram) or the leftmost merge; a literal space mark in a text becomes bytes,
so it survives; repeated rows and null ids are ordinary rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetlab.llm.lengths import read_vocabulary
from onsetlab.llm.text import per_row, per_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Chunks whose pieces a worker remembers for good and for a while (as many each), and the longest such chunk.
REMEMBERED, LONGEST = 1 << 17, 64
#: Chunks with scores that it remembers in the same two ways.
REMEMBERED_SCORES = 1 << 18
#: Pairs of pieces that it remembers.
PAIRS = 1 << 18
UNKNOWN_PENALTY = 10.0
_NONE = float("-inf")


class Pieces:
    """A SentencePiece model's pieces as an automaton. ``merges``: built by merges, else by unigram scores."""

    def __init__(self, model: bytes, merges: bool = True) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte, self.text, self.automaton = [0] * 256, {}, ahocorasick.Automaton()
        self.value, self.score, self.merges = [0] * len(sp), {}, merges
        used = set()
        for i in range(len(sp)):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.value[i] = int(piece[1:-1], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} holds a space mark inside")
                self.automaton.add_word(piece, (len(piece), sp.get_score(i), i))
                self.text[i], self.score[piece] = piece.replace(SPACE, " ").encode(), sp.get_score(i)
                used.update(piece)
        self.automaton.make_automaton()
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        cut = "" if "\n" in used else "\n"
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+" + f"|{cut}" * bool(cut)).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.recent: dict[str, tuple[int, ...]] = {}
        self.known_scores: dict[str, tuple] = {}
        self.recent_scores: dict[str, tuple] = {}
        self.mark = [self.byte[b] for b in SPACE.encode()]
        self.pairs: dict[int, bool] = {}
        self.names = [sp.id_to_piece(i) for i in range(len(sp))] + [""]
        self.single = frozenset(c for c in used if c in self.score)

    def _follows(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` from single characters ends in just these two."""
        parts, score = list(left + right), self.score.get
        while len(parts) > 1:
            tried = [score(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(tried)
            if best == _NONE:
                break
            at = tried.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts == ([left, right] if left else [right])

    def merged(self, chunk: str) -> tuple[int, ...]:
        """The pass over a chunk all of whose characters are pieces, for a model built by merges."""
        names, pairs = self.names, self.pairs
        size = len(names)
        n = len(chunk)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        last[0] = size - 1  # nothing before the chunk
        for end, (length, _, piece) in self.automaton.iter(chunk):
            end += 1
            if last[end] < 0:
                before = last[end - length]
                key = before * size + piece
                fits = pairs.get(key)
                if fits is None:
                    fits = self._follows(names[before], names[piece])
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    pairs[key] = fits
                if fits:
                    last[end], back[end] = piece, end - length
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return tuple(reversed(out))

    def scored(self, chunk: str) -> tuple[tuple[int, ...], tuple[int, ...], float]:
        """In one pass the merge order's ids, and the ids and sum of the best-scoring path."""
        if not (self.merges and self.single.issuperset(chunk)):
            best, total = self.relaxed(chunk)
            return (self.viterbi(chunk) if self.merges else best), best, total
        names, pairs, size, n = self.names, self.pairs, len(self.names), len(chunk)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        last[0] = size - 1
        total, piece_to, best_back = [0.0] + [_NONE] * n, [-1] * (n + 1), [0] * (n + 1)
        for end, (length, value, piece) in self.automaton.iter(chunk):
            end += 1
            start = end - length
            through = total[start] + value
            if through > total[end]:  # output links come longest first, so of equal scores the longest piece stays
                total[end], piece_to[end], best_back[end] = through, piece, start
            if last[end] < 0:
                key = last[start] * size + piece
                fits = pairs.get(key)
                if fits is None:
                    fits = self._follows(names[last[start]], names[piece])
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    pairs[key] = fits
                if fits:
                    last[end], back[end] = piece, start
        out, best, score, at = [], [], total[n], n
        while at:
            best.append(piece_to[at])
            at = best_back[at]
        while n:
            out.append(last[n])
            n = back[n]
        return tuple(reversed(out)), tuple(reversed(best)), score

    def relaxed(self, chunk: str) -> tuple[tuple[int, ...], float]:
        """The path of the best sum of scores over a chunk, in one pass: its ids and the sum."""
        n = len(chunk)
        score: list[float] = [0.0] + [_NONE] * n
        back, done = [(0, -1)] * (n + 1), 0

        def bytes_to(stop: int) -> None:
            """A character that no piece reaches better is its bytes, at the score of an unknown one."""
            nonlocal done
            while done < stop:
                done += 1
                if score[done] < score[done - 1] + self.unknown:
                    score[done], back[done] = score[done - 1] + self.unknown, (done - 1, -1)

        for end, (length, value, piece) in self.automaton.iter(chunk):
            bytes_to(end)
            start, stop = end + 1 - length, end + 1
            if score[start] + value > score[stop]:
                score[stop], back[stop] = score[start] + value, (start, piece)
        bytes_to(n)
        out: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            out.extend([piece] if piece >= 0 else [self.byte[b] for b in reversed(chunk[start:at].encode())])
            at = start
        return tuple(reversed(out)), score[n]

    def viterbi(self, chunk: str) -> tuple[int, ...]:
        """The best path over a chunk, in one pass."""
        if not self.merges:
            return self.relaxed(chunk)[0]
        if self.single.issuperset(chunk):
            return self.merged(chunk)
        n = len(chunk)
        back, last, reached = [(0, -1)] * (n + 1), [""] * (n + 1), [True] + [False] * n
        done = 0

        def bytes_to(stop: int) -> None:
            """Positions that no piece has reached are reached by their character's bytes."""
            nonlocal done
            while done < stop:
                done += 1
                if not reached[done] and reached[done - 1]:
                    reached[done], back[done], last[done] = True, (done - 1, -1), chunk[done - 1]

        for end, (length, _, piece) in self.automaton.iter(chunk):
            bytes_to(end)
            start, stop = end + 1 - length, end + 1
            if not reached[stop] and reached[start]:
                text = chunk[start:stop]
                if self._follows(last[start], text):
                    reached[stop], back[stop], last[stop] = True, (start, piece), text
        bytes_to(n)
        out: list[int] = []
        while n:
            start, piece = back[n]
            if piece < 0:
                out.extend(self.byte[b] for b in reversed(chunk[start:n].encode()))
            else:
                out.append(piece)
            n = start
        return tuple(reversed(out))

    def _solved(self, text: str | None, solve, known: dict, recent: dict, most: int) -> Iterator:
        """What ``solve`` makes of the text's chunks, in order; None stands for a literal space mark."""
        for k, part in enumerate(text.split(SPACE) if text else ()):
            if k:
                yield None
            for chunk in self.chunks(("" if k else SPACE) + part.replace(" ", SPACE)):
                got = known.get(chunk) or recent.get(chunk)
                if got is None:
                    got = solve(chunk)
                    if len(chunk) <= LONGEST:
                        if len(recent) >= most:
                            recent.clear()
                        (known if len(known) < most else recent)[chunk] = got
                yield got

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for got in self._solved(text, self.viterbi, self.known, self.recent, REMEMBERED):
            ids += got if got is not None else self.mark
        return ids

    def encode_scored(self, text: str | None) -> tuple[list[int], list[int], float]:
        """``encode``, and the ids and the sum of the best-scoring path; a literal space mark counts as an unknown character."""
        ids: list[int] = []
        best: list[int] = []
        total = 0.0
        for got in self._solved(text, self.scored, self.known_scores, self.recent_scores, REMEMBERED_SCORES):
            a, b, score = got or (self.mark, self.mark, self.unknown)
            ids += a
            best += b
            total += score
        return ids, best, total

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the mark that encoding puts in front goes."""
        text, value = self.text, self.value
        return b"".join([text[i] if i in text else bytes((value[i],)) for i in ids])[1:].decode()

    def forget(self) -> None:
        """Let go what is remembered of chunks."""
        for memory in (self.known, self.recent, self.known_scores, self.recent_scores):
            memory.clear()


_models: dict[str, Pieces] = {}


def model(path: str, data: bytes) -> Pieces:
    """The model of a file, made once in a worker."""
    if path not in _models:
        _models[path] = Pieces(data)
    return _models[path]


def encode(docs: DataFrame, path: str = MODEL, keep: list | None = None, with_text: bool = False) -> DataFrame:
    """The ``keep`` columns (doc_id, if none are named) and ids (array of int) of every document."""
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        pieces = model(path, data.value)

        def work(texts: list) -> list:
            return [[np.array(pieces.encode(t), np.int32) for t in texts]]

        work.done = pieces.forget
        return work

    return per_text(docs, keep or ["doc_id"], make, "ids array<int>", with_text=with_text)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids)."""
    data = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        pieces = model(path, data.value)
        return lambda rows: [[pieces.decode(ids or []) for ids in rows]]

    return per_text(encoded.select("doc_id", F.col("ids").alias("text")), ["doc_id"], make, "text string")


def tokenised(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """The documents with all their columns, and ``ids`` and ``n_tokens`` (which replace columns of that name)."""
    rows, columns = per_row(docs, lambda d, keep, with_text: encode(d, path, keep, with_text))
    own = [column for name, column in zip(docs.columns, columns, strict=True) if name.lower() not in ("ids", "n_tokens")]
    return rows.select(*own, "ids", F.size("ids").cast("long").alias("n_tokens"))


def query(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids, comma-joined), decoded_sha256, round_trip, best_tokens and best_score.

    The ids are those of the model's own kind; the best-scoring path is found in the same pass and decodes
    to the same text.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def make():
        pieces = model(path, data.value)

        def one(text: str | None) -> tuple:
            ids, best, total = pieces.encode_scored(text)
            back = pieces.decode(ids)
            same = back == (text or "") and pieces.decode(best) == back
            return len(ids), sha(",".join(map(str, ids))), sha(back), same, len(best), total

        return lambda texts: list(zip(*map(one, texts), strict=True)) or [[]] * 6

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, best_tokens long, best_score double"
    return per_text(docs, ["doc_id"], make, fields)
