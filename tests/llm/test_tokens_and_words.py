"""Alignment, packing and spelling variants against plain loops on whole texts."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from onsetlab.llm import align, lengths, packing, variants

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", "a ▁ b", "<|endoftext|> hi <s> x </s> <0x41>", " " * 3000 + "x", "\n" * 3000, "é中文\U0001F600 ​\xad\x1c\x85",
    "x" * 5000, "  lead", "tail  ", "\U0001F600" * 500, "　  x", "it's we'll 1234 co-operate", "İSTANBUL ΣΑΣ ﬁ Å é",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def both(spark, docs):
    odd = spark.createDataFrame([(None if k == 3 else 10**9 + k, t) for k, t in enumerate([*TEXTS, TEXTS[-1]])], "doc_id long, text string")
    return docs.select("doc_id", "text").unionByName(odd)


# --- alignment ---


def aligned_by_hand(text, encode_a, bytes_a, encode_b, bytes_b):
    """The groups of a text, from the sets of its ends."""
    if not text:
        return []
    want, sides = (" " + text).encode(), []
    for ids, of in ((encode_a(" " + text), bytes_a), (encode_b(text), bytes_b)):
        parts = [of[i] for i in ids]
        if b"".join(parts) != want:
            return []
        sides.append(list(zip(ids, itertools.accumulate(map(len, parts)), strict=True)))
    groups, left = [], [list(s) for s in sides]
    for end in sorted({e for _, e in sides[0]} & {e for _, e in sides[1]}):
        group = []
        for s in left:
            n = sum(1 for _ in itertools.takewhile(lambda x: x[1] <= end, s))
            group.append([i for i, _ in s[:n]])
            del s[:n]
        groups.append(group)
    return groups


@pytest.mark.parametrize("chunk", [align.CHUNK, 7])
def test_alignment(both, monkeypatch, chunk):
    monkeypatch.setattr(align, "CHUNK", chunk)
    monkeypatch.setattr(align, "AT_ONCE", chunk)
    a = Tokenizer.from_file(align.BYTES)
    a.encode_special_tokens = True
    shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    byte_of = {c: b for b, c in shown.items()} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    bytes_a = {i: bytes(byte_of[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    b = sentencepiece.SentencePieceProcessor(model_file=align.PIECES)
    bytes_b = [align.piece_bytes(b.id_to_piece(k)) for k in range(b.get_piece_size())]
    rows = sorted(map(tuple, both.collect()), key=str)
    groups = [aligned_by_hand(t, lambda x: a.encode(x, add_special_tokens=False).ids, bytes_a, b.encode, bytes_b) for _, t in rows]
    links = [collections.Counter(p for x, y in g for p in itertools.product(x, y)) for g in groups]
    holders = collections.Counter(p for one in links for p in one)
    most = collections.defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    want = []
    for (i, _), g, one in zip(rows, groups, links, strict=True):
        text = ";".join("|".join(",".join(map(str, s)) for s in group) for group in g)
        want.append((
            i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(one.values()),
            sum(n for p, n in one.items() if holders[p] == most[p[0]]), sum(n * holders[p] for p, n in one.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    got = align.query(both).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(1 for w in want if w[1] == 0) == 3  # null, empty, a literal space mark


def test_shared_cuts_are_all_common_ends():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 60, 4000):
        for share in (0.02, 0.5, 0.98):
            a, b, bounds, base = [], [], [0], 0
            for _ in range(4):
                n = int(rng.integers(0, size + 1))
                total = base + n
                for ends in (a, b):
                    ends += [base + k for k in range(1, n) if rng.random() < share] + [total] * (n > 0)
                bounds.append(len(a))
                base = total
            cut = align.shared_cuts(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(bounds))
            assert [x for x, c in zip(a, cut, strict=True) if c] == sorted(set(a) & set(b))


def test_long_runs_are_encoded_as_the_pattern_would():
    coder = lengths.encoding(lengths.VOCABULARY, lengths.read_vocabulary(lengths.VOCABULARY))
    encode = lengths.whole_encoder(coder)
    for run in (" ", "\n", " \n", "\t", "　\x85", " "):
        for n in (1, 1023, 1024, 1025, 6000):
            for text in (run * n, f"a{run * n}", f"{run * n}b", f"'s{run * n}7{run * n}-"):
                assert encode(text) == coder.encode_ordinary(text)
    for unit in (" ", "\n", "x"):  # lengths at which the pattern alone overflows its stack on white space
        assert coder.decode(encode(unit * 3_000_000 + "y")) == unit * 3_000_000 + "y"


# --- packing ---


def pieces_by_hand(rows, capacity):
    library = Tokenizer.from_file(packing.VOCABULARY)
    out = {}
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out.setdefault((i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), 0)
            out[(i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    return out


def test_words_are_encoded_as_the_library_does(docs):
    data = lengths.read_vocabulary(packing.VOCABULARY)
    encode, library, rng = packing.word_encoder(data), Tokenizer.from_file(packing.VOCABULARY), random.Random(8)
    letters = "etaoinshrdlucmfwypvbgkjqxzETAOIéüñßÀÞÿ'.,!0123456789-_&<|>  \n\t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    texts += ["a\x1cb", "İSTANBUL ΣΑΣ ﬁ Å e\u0301 ª² ×÷", "<|endoftext|>x <|startoftext|>y <|x", "x" * 3000 + " y " + "Z" * 3000, "", " ", "ÿ\xff \xffÿ"]
    texts += [r.text or "" for r in docs.collect()]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(both, monkeypatch, capacity):
    monkeypatch.setattr(packing, "SLICE", 50)
    rows = packing.pack(packing.token_pieces(both, capacity=capacity), capacity).collect()
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == pieces_by_hand([tuple(r) for r in both.collect()], capacity)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1]
        assert sum(n for _, n in parts) <= capacity
    tokens = sum(r.length for r in rows)
    assert -(-tokens // capacity) <= len(sequences) <= -(-tokens // capacity) * 1.02 + 1


def fewest(items, capacity):
    """The optimal number of sequences, by search over which items share one with the largest."""
    def solve(left):
        if not left:
            return 0
        if left in seen:
            return seen[left]
        first, rest = left[0], left[1:]
        best = len(left)
        for n in range(len(rest) + 1):
            for chosen in set(itertools.combinations(range(len(rest)), n)):
                if first + sum(rest[k] for k in chosen) <= capacity:
                    best = min(best, 1 + solve(tuple(v for k, v in enumerate(rest) if k not in chosen)))
        seen[left] = best
        return best

    seen = {}
    return solve(tuple(sorted(items, reverse=True)))


def test_what_dominance_fixes_costs_no_sequence():
    for trial in range(250):
        rng = random.Random(trial)
        capacity = rng.choice([10, 20, 31])
        items = [rng.randint(max(1, capacity // rng.choice([3, 6])), capacity) for _ in range(rng.randint(1, 9))]
        left = dict(collections.Counter(items))
        fixed = packing.reduce(left, capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(items, capacity)
        assert sorted(rest + [s for c, n in fixed for s in c * n]) == sorted(items)


def test_best_fit_equals_one_piece_at_a_time():
    for trial in range(200):
        rng = random.Random(trial)
        capacity = rng.choice([10, 50, 100])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 150))), reverse=True)
        rooms = []
        for size in items:
            fits = [k for k, room in enumerate(rooms) if room >= size]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= size
            else:
                rooms.append(capacity - size)
        used = collections.Counter()
        for p in packing.best_fit(dict(collections.Counter(items)), capacity, 0):
            for k in range(p.count):
                used[p.sequence + k // p.each] += p.length
        assert sorted(capacity - u for u in used.values()) == sorted(rooms)


# --- spelling variants ---


def variants_by_hand(rows):
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = collections.defaultdict(set)
    masks = collections.defaultdict(set)
    for w in count:
        for k in range(len(w)):
            masks[(k, w[:k] + w[k + 1 :])].add(w)
            if w[:k] + w[k + 1 :] in count:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 2 * n else None
    out = []
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


def word_table(spark, counts):
    rows = [(k, " ".join([w] * 3)) for k, w in enumerate(w for w, n in counts for _ in range(n))]
    return spark.createDataFrame([*rows, (None, None), (None, "aaaaa " * 4)], "doc_id long, text string")


@pytest.mark.parametrize("tile", [variants.TILE, 4])
def test_variants(spark, both, monkeypatch, tile):
    monkeypatch.setattr(variants.near_words, "__defaults__", (variants.LEAST_LENGTH, tile))
    monkeypatch.setattr(variants, "ROWS", 300)
    rng = random.Random(5)
    made = [("".join(rng.choice("abé") for _ in range(rng.randint(5, 8))), rng.randint(1, 9)) for _ in range(250)]
    wide = [("z" * 700, 4), ("z" * 701, 9), ("z" * 350 + "y" + "z" * 349, 2), ("z" * 699 + "Q", 1)]
    monkeypatch.setattr(variants, "CELLS", 3000)
    for table in (word_table(spark, made + wide), both):
        got = variants.query(table).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert sorted(map(tuple, got)) == variants_by_hand([tuple(r) for r in table.select("doc_id", "text").collect()])


def test_roots_follow_long_chains(spark):
    rows = [(f"w{k:03d}", f"w{k + 1:03d}" if k < 99 else None) for k in range(100)]
    got = variants.roots(spark.createDataFrame(rows, "word string, form string")).collect()
    assert {r.root for r in got} == {"w099"} and len(got) == 100


# --- the pipeline on odd tables, and long texts through every operator ---


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, kind):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, text_key string, component string, ids string, score string"
    same = "one two three four five six seven eight nine ten " * 30
    texts = [None, "", " \t\n", "one", "one", same, same, same.upper(), same[:-10] + " tail", "x" * 5000, "a ▁ b\n\n c \U0001F600"]
    rows = [(None if k == 4 else k, t, "en", None if k % 4 == 0 else f"s{k % 3}", 0, *["clash"] * 5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([] if kind == "empty" else rows + rows[:2], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in (1, 2, 3, 99)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        left[name] = out.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
    got = corpus_pipeline.run(spark, str(tmp_path))
    if kind == "empty":
        assert set(left.values()) == {0} and got.count() == 0
        return
    assert left["toxicity"] == len(rows) + 2  # nothing is told to be toxic
    assert left["exact_dedup"] == 7  # one each of: empty, one, the long text, its capitals, its other tail, x, signs
    assert left["simhash_near_dedup"] < len(rows)
    assert {r.doc_id for r in got.select("doc_id").collect()} <= {r[0] for r in rows}
    assert set(docs.columns) <= set(got.columns)


LONG = [" " * 3_000_000 + "x", "\n" * 2_000_000 + "y", "q" * 1_000_000, "long text with words " * 60_000, None]


@pytest.mark.parametrize("name", ["lengths", "align", "packing", "variants", "mix", "shards", "simhash", "iblt", "exact", "pii", "substrings", "pieces"])
def test_very_long_texts(spark, name):
    from onsetlab.llm import exact, iblt, mixing, pieces, pii, sharding, simhash, substrings

    run = {
        "lengths": lengths.query, "align": align.query, "packing": packing.query, "variants": variants.query, "mix": mixing.query, "shards": sharding.query,
        "simhash": simhash.query, "iblt": iblt.query, "exact": exact.query, "pii": pii.query, "substrings": substrings.query, "pieces": pieces.query,
    }[name]
    most = 150_000 if name == "substrings" else None  # every position of a repetition is one of its windows
    rows = [(k, t and t[:most], "s") for k, t in enumerate(LONG)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    if name == "lengths":
        assert sum(r.n_docs for r in got) == len(rows)
    elif name == "variants":
        assert {r.word for r in got} == {"words"}
    elif name == "packing":
        assert {r.doc_id for r in got} == {k for k, _, _ in rows}
    else:
        assert sorted(r.doc_id for r in got) == [k for k, _, _ in rows]
