import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from onsetlab.llm import align, exact, iblt, lengths, mixing, nearcopies, packing, pieces, pii, queries, sharding, simhash, substrings, toxicity, variants
from onsetlab.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    *[T.StructField(c, T.StringType()) for c in ("row", "size", "shard", "key", "text_key", "digest", "ids", "score", "n")],
])
LONG = "the quick brown fox jumps over the lazy dog again and again without end " * 40
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one"), (None, None), (5, "Mail a.b@c.de or +49 (30) 1234-567 now"),
    (6, LONG), (7, LONG), (8, LONG.upper()), (9, LONG[:-9] + " tail"), (10, "x" * 5000), ((1 << 60) + 1, "a ▁ b\n\n  c \U0001F600"),
    (11, "4111 1111 1111 1111 and 300.1.1.1 and 10.0.0.255"), (12, "\n".join(["same line of a few words"] * 30)),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", 0, *["clash"] * 9) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def labels_of(spark, ids=()):
    return spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")


QUERIES = {
    "mix": mixing.query, "shards": sharding.query, "simhash": simhash.query, "iblt": iblt.query, "exact": exact.query,
    "lengths": lengths.query, "pii": pii.query, "substrings": substrings.query, "pieces": pieces.query,
    "toxicity": lambda d: toxicity.query(d, labels_of(d.sparkSession)),
    "align": align.query, "packing": packing.query, "variants": variants.query,
}


@pytest.mark.parametrize("name", QUERIES)
def test_empty_table(empty, name):
    assert QUERIES[name](empty).count() == 0


@pytest.mark.parametrize("name", QUERIES)
def test_odd_rows_give_a_row_each(odd, name):
    rows = QUERIES[name](odd).collect()
    if name == "variants":
        assert {r.word for r in rows} == {"quick", "brown", "jumps", "again", "without"}
    elif name != "lengths":
        ids = lambda x: sorted(x, key=lambda v: (v is None, v or 0))
        assert ids(r.doc_id for r in rows) == ids(i for i, _ in ODD)
    else:
        assert sum(r.n_docs for r in rows) == len(ODD)


def test_mix(docs, texts):
    rows = mixing.query(docs).collect()
    again = mixing.query(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] for r in rows)
    total = collections.Counter()
    for i, n in size.items():
        total[source[i]] += n
    # Deal 150 % by weight, cap, deal the excess again until nobody is above.
    names = sorted(total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(total.values()), set(names)
    while left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] > 2 * total[s]:
                left += target[s] - 2 * total[s]
                target[s] = 2.0 * total[s]
                open_.discard(s)
    taken = collections.Counter()
    for r in rows:
        assert abs(r.target - target[source[r.doc_id]]) < 1e-6
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 3 * mixing.BLOCK_TOKENS for s in names)


@pytest.mark.parametrize("tokens", [1 << 20, 700])
def test_mix_equals_sql(docs, tokens):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(mixing.oracle(shard_tokens=tokens)).fetchall())
    got = mixing.plan_mix(docs, shard_tokens=tokens).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect())) == want


def test_sainte_lague_equals_dealing_seats_one_by_one(spark):
    votes = {"a": 530, "b": 240, "c": 135, "d": 60, "e": 35, "f": 0}
    for seats in (0, 1, 2, 7, 50, 999):
        df = spark.createDataFrame([(0, p, v, seats) for p, v in votes.items()], "g int, party string, votes long, seats long")
        got = {r.party: r.quota for r in mixing.sainte_lague(df, ["g"], ["party"], "votes", "seats").collect()}
        want = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = max((p for p in votes if votes[p]), key=lambda p: (votes[p] / (2 * want[p] + 1), -ord(p)))
            want[best] += 1
        assert got == want


def test_taken_text_has_the_taken_words(docs):
    taken = {r.doc_id: r.taken for r in mixing.query(docs).collect()}
    words = collections.Counter()
    for r in mixing.taken_text(docs).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_shards(docs, texts):
    rows = sharding.query(docs).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        t = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    group = collections.defaultdict(set)
    for r in rows:
        group[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) - 1 for s in group.values()) <= 1  # groups stay together


def test_label_propagation_joins_neighbours(spark):
    # Sixteen rings of eight documents; each document is in two hubs, so the hubs chain a ring together.
    pairs = [(g * 8 + i, g * 8 + (i + d) % 8) for g in range(16) for i in range(8) for d in (0, 1)]
    members = spark.createDataFrame(pairs, "row_id long, hub long")
    state = {r.row_id: r.shard for r in sharding.propagate(members, 160, 4, rounds=8).collect()}
    cut = lambda s: sum(s[g * 8 + i] != s[g * 8 + (i + 1) % 8] for g in range(16) for i in range(8))
    start = {r.row_id: r.s for r in members.select("row_id", F.pmod(F.xxhash64("row_id", F.lit(11)), F.lit(4)).alias("s")).collect()}
    assert cut(state) < cut(start) * 0.6
    assert max(collections.Counter(state.values()).values()) <= 160 // 4 + 4


def brute_simhash(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_a_hub_larger_than_a_shard_fills_shards_in_turn(spark):
    texts = ["hot"] * 800 + [f"pair {k // 2}" for k in range(400)] + [f"only {k}" for k in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.query(docs).collect()
    count = collections.Counter(r.shard for r in rows)
    assert set(count.values()) == {300}
    where = collections.defaultdict(collections.Counter)
    for r in rows:
        where[texts[r.doc_id]][r.shard] += 1
    most = [n for _, n in where["hot"].most_common()]
    assert sum(most[:3]) >= 760  # three shards are the fewest possible
    pairs = [len(v) for k, v in where.items() if k.startswith("pair")]
    assert sum(n > 1 for n in pairs) <= 10


def test_simhash(docs, texts):
    rows = {r.doc_id: r for r in simhash.query(docs).collect()}
    ids = np.array(sorted(texts))
    prints = np.array([brute_simhash(texts[i]) for i in ids], np.uint64)
    assert [rows[i].fingerprint for i in ids] == [format(int(p), "016x") for p in prints]
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    least = ids.copy()
    while True:
        new = np.array([least[n].min() for n in near])
        if (new == least).all():
            break
        least = new
    assert [rows[i].component_id for i in ids] == least.tolist()


def test_bit_slices_equal_popcounts():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)), base ^ np.uint64(0x1F)])
    keys = rng.integers(0, 3, len(fps))
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    root = simhash.connect(keys, fps, 4)
    want = np.arange(len(fps))
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4) & (keys[:, None] == keys[None, :])
    while True:
        new = np.array([want[n].min() for n in near])
        if (new == want).all():
            break
        want = new
    assert (root == want).all()


def test_links_survive_small_chunks(spark):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(60)})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = components(simhash.links(df, chunk=7)).select("component").distinct().count()
    assert found == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def likeness(a, b):
    find = re.compile(iblt.PARAGRAPH).findall
    a, b = collections.Counter(find(a)), collections.Counter(find(b))
    d, n = sum(((a - b) + (b - a)).values()), sum(a.values()) + sum(b.values())
    return (n - d) / (n + d) if n else 1.0


def test_fingerprints(docs, texts):
    rows = {r.doc_id: r for r in iblt.query(docs).collect()}
    ids = sorted(texts)
    by_text = collections.defaultdict(set)
    for k, i in enumerate(ids):
        text, after, r = texts[i], texts[ids[(k + 1) % len(ids)]], rows[i]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(text, edited), abs=1e-12)
        assert r.near_next == pytest.approx(likeness(text, after), abs=1e-12)
        by_text[text].add(r.fingerprint)
    assert all(len(s) == 1 for s in by_text.values())


def test_exact(docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(exact.ORACLE).fetchall())
    assert sorted(map(tuple, exact.query(docs).collect())) == want
    weak = exact.dedup(docs, lambda c: F.length(c).cast("string"))  # nearly every digest collides
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in weak.collect()}
    assert got == {i: (k, n, s) for i, k, n, s, _ in want}


@pytest.mark.parametrize("files", [1, 2])
def test_exact_state_goes_on_between_micro_batches(spark, docs, files):
    want = sorted(map(tuple, exact.query(docs).collect()))
    spread = docs.repartition(5)
    got = exact.dedup(spread, files_per_batch=files).select("doc_id", "keep_id", "group_size", "kept", "digest")
    assert sorted(map(tuple, got.collect())) == want
    assert max(r[2] for r in want) > 1


def test_exact_orders_extreme_ids(spark):
    ids = [(1 << 63) - 1, -(1 << 63), None, 0]
    df = spark.createDataFrame([(i, "same text") for i in ids], "doc_id long, text string")
    rows = exact.query(df).collect()
    assert {r.keep_id for r in rows} == {-(1 << 63)} and [r.doc_id for r in rows if r.kept] == [-(1 << 63)]


def test_exact_locators_name_the_rows(spark, docs):
    rows = {(r.file, r.place): r for r in exact.dedup(docs).collect()}
    located = exact.located(docs).select("file", "place", "doc_id").collect()
    assert {k: r.doc_id for k, r in rows.items()} == {(r.file, r.place): r.doc_id for r in located}


def test_exact_keeps_one_of_repeated_rows(odd):
    rows = exact.kept_documents(odd).collect()
    assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in ODD})
    assert rows[0].asDict().keys() == {f.name for f in SCHEMA}


def test_lengths(docs, texts):
    encode = lengths.encoding(lengths.VOCABULARY, lengths.read_vocabulary(lengths.VOCABULARY)).encode_ordinary
    n = np.array([len(encode(t)) for t in texts.values()])
    hist = lengths.query(docs)
    for r in hist.collect():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == ((n == r.n_tokens).sum(), (n >= r.n_tokens).sum(), n[n >= r.n_tokens].sum())
        assert (r.truncated_total, r.docs_cut) == (np.minimum(n, r.n_tokens).sum(), (n > r.n_tokens).sum())
        assert r.share_at_most == pytest.approx((n <= r.n_tokens).mean())
    for r in lengths.at_limits(hist, [0, 17, 512, 10**6]).collect():
        assert (r.total, r.truncated_total, r.docs_cut) == (n.sum(), np.minimum(n, r.context_limit).sum(), (n > r.context_limit).sum())
    assert lengths.quantiles(hist, [0.5]).first()["q0.5"] == np.quantile(n, 0.5, method="inverted_cdf")


def brute_pii(t):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd = sum(d[-1::-2]) + sum(2 * x - 9 * (x > 4) for x in d[-2::-2])
        if 12 <= len(d) <= 19 and odd % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)), collections.Counter(k for _, k, _ in spans)


TRICKY = [
    "a@b.c%d@e.f", "x@@y.zz", "@a.b", "a@b", "a@b.c.d-e@f.gh", "..@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4", "1.2.3", "01.002.3.4",
    "4111-1111-1111-1111", "4111 1111  1111 1111", "1" * 40, "+1 (743) 555-3824", "+12", "+1 2345678 ) ", "++49 30 123456789", "+1-+2-345-678-90123",
    "a" * 300 + "@", "é@x.yz", "٣.1.1.1.1", "Dr. Jane Roe called", "John Smith, SSN 123-45-6789, (555) 123-4567", "joe [at] site [dot] com",
]


def test_pii(spark, docs, texts):
    for source, want in ((docs, texts), (spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string"), dict(enumerate(TRICKY)))):
        for r in pii.query(source).collect():
            told, counts = brute_pii(want[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), want[r.doc_id]
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in range(4))
            assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


def test_em_tells_good_labelers_from_bad():
    rng = np.random.default_rng(5)
    truth = rng.random(20000) < 0.3
    right = (0.95, 0.9, 0.85, 0.5, 0.7, 0.6, 0.5)
    vote = [np.where(rng.random(20000) < p, truth, ~truth) * 2 for p in right]
    code = sum(v.astype(int) * 3 ** (pii.LABELERS - 1 - k) for k, v in enumerate(vote))
    posterior = pii.reliabilities(dict(collections.Counter(code.tolist())))
    guess = np.array([posterior[c] > 0.5 for c in code.tolist()])
    assert (guess == truth).mean() > 0.96 > (np.sum(vote, axis=0) > 7)[truth].mean() * 0.96


def planted_secrets():
    """Texts with mail addresses and cards, keys that are assigned, and runs and numbers that are nobody's."""
    rng = np.random.default_rng(11)
    hexa = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    texts, secret, other = [], [], []
    for k in range(400):
        text = f"some words here a.b{k}@mail.site.com and +1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)} then 4111 1111 1111 1111 "
        if k % 4 == 0:
            name = ("token", "api_key", "secret", "password")[k // 4 % 4]
            at = len(text) + len(f'{name} = "')
            text += f'{name} = "{hexa(40)}" '
            secret.append((k, at, at + 40))
        if k % 4 == 1:
            number = str(rng.integers(10**15, 10**16))
            number = number[:-1] + str((int(number[-1]) + (pii.luhn([int(c) for c in number]))) % 10)
            other.append((k, len(text), len(text) + 16))
            text += number + " "
        if k % 4 == 2:
            other.append((k, len(text), len(text) + 19))
            text += "chapter1_aaaaaaaaaa "
        texts.append(text + "and so on.")
    return texts, secret, other


def test_pii_accepts_secrets_and_drops_others(spark):
    texts, secret, other = planted_secrets()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {tuple(s) for s in r.spans} for r in pii.labelled(df).collect()}
    assert all(("secret", a, b) in got[k] for k, a, b in secret)
    assert not any((a, b) in {s[1:] for s in got[k]} for k, a, b in other)
    counts = {r.doc_id: (r.n_secret, r.n_spans) for r in pii.query(df).collect()}
    assert all(counts[k] == (int(k % 4 == 0), len(got[k])) for k in got)


def plain_decisions(texts):
    """EM and the classifier as plain loops over the spans themselves."""
    every = []
    for i, t in enumerate(texts):
        own, failed = pii.base_spans(t)
        every += [(i, s, k < len(own)) for k, s in enumerate([*own, *pii.wider_spans(t, own, failed)])]
    vote = [pii.votes(texts[i], *s) for i, s, _ in every]
    p = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v - 1 for v in row))) for row in vote]
    for _ in range(60):
        prior = {}
        for kind in range(len(pii.KINDS)):
            own = [q for q, (_, s, _) in zip(p, every, strict=True) if s[1] == kind]
            prior[kind] = (1 + sum(own)) / (2 + len(own))
        seen = [[[1.0, 1.0, 2.0], [2.0, 1.0, 1.0]] for _ in range(pii.LABELERS)]
        for q, row in zip(p, vote, strict=True):
            for k, v in enumerate(row):
                seen[k][0][v] += q
                seen[k][1][v] += 1 - q
        new = []
        for (_, s, _), row in zip(every, vote, strict=True):
            yes, no = prior[s[1]], 1 - prior[s[1]]
            for k, v in enumerate(row):
                yes *= seen[k][0][v] / sum(seen[k][0])
                no *= seen[k][1][v] / sum(seen[k][1])
            new.append(yes / (yes + no))
        p = new
    sizes = np.cumsum([0, *pii.CASES])
    x = np.zeros((len(every), sizes[-1] + 1))
    x[:, -1] = 1
    for row, (i, s, _) in zip(x, every, strict=True):
        code = pii.form(texts[i], *s)
        for part in reversed(range(len(pii.CASES))):
            row[sizes[part] + code % pii.CASES[part]] = 1
            code //= pii.CASES[part]
    y, w = np.array(p), np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x.T * (q * (1 - q))) @ x + np.eye(len(w)), x.T @ (y - q) - w)
    keep = 1 / (1 + np.exp(-x @ w)) >= 0.5
    return sorted((i, pii.KINDS[s[1]], s[0], s[2]) for (i, s, base), k in zip(every, keep, strict=True) if base or k)


def test_pii_equals_plain_loops(spark):
    texts, _, _ = planted_secrets()
    texts = texts[:120] + TRICKY
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, *s) for r in pii.labelled(df).collect() for s in r.spans)
    assert got == plain_decisions(texts)


def brute_repeats(texts):
    seen = collections.Counter(t[s : s + 200] for t in texts for s in range(len(t) - 199))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                gone[s : s + 200] = True
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        yield len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize("group", [4096, 2])
def test_substrings(spark, texts, odd, group, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", group)
    some = [t for _, t in sorted(texts.items())] + [t or "" for _, t in ODD] + ["ab" * 180, "q" * 199, LONG[7:420] + "!" + LONG[100:305]]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    rows = sorted(map(tuple, substrings.query(df).collect()))
    assert [r[1:] for r in rows] == list(brute_repeats([t.encode() for t in some]))


def test_pieces(docs, texts, odd):
    import sentencepiece

    data = lengths.read_vocabulary(pieces.MODEL)
    model, sp = pieces.Pieces(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for t in [*list(texts.values()), "  Hello  wörld\n\tx ☃ 𝔘", "    a     b", "日本語 text", "a" * 40]:
        assert model.encode(t) == sp.encode(t)
        assert model.decode(model.encode(t)) == t
    unigram = pieces.Pieces(data, merges=False)
    text = "Viterbi over ☃ pieces\nagain"
    assert unigram.decode(unigram.encode(text)) == text
    assert all(r.round_trip for r in pieces.query(odd).collect())
    encoded = pieces.encode(odd)
    back = [r.text for r in pieces.decode(encoded).collect()]
    assert sorted(back) == sorted(t or "" for _, t in ODD)


def test_unigram_scores_are_the_best():
    model = pieces.Pieces(lengths.read_vocabulary(pieces.MODEL), merges=False)
    for word in ("▁hello", "▁international", "▁abc𝔘d"):
        best = [0.0] + [None] * len(word)
        for end in range(1, len(word) + 1):
            tried = [best[s] + model.score[word[s:end]] for s in range(end) if word[s:end] in model.score]
            best[end] = max([best[end - 1] + model.unknown, *tried])
        got = sum(model.score.get(model.names[i], 0.0) for i in model.viterbi(word) if i in model.text)
        got += model.unknown * sum(c == "𝔘" for c in word)
        assert got == pytest.approx(best[-1])


def test_best_scores_of_whole_texts(texts):
    model = pieces.Pieces(lengths.read_vocabulary(pieces.MODEL))
    longest = max(map(len, model.score))
    for t in [*list(texts.values())[:40], *(t for _, t in ODD), "日本 ☃ text\n\n  x", "a" * 300]:
        ids, best, total = model.encode_scored(t)
        assert ids == model.encode(t) and model.decode(best) == (t or "")
        want = 0.0
        for k, part in enumerate((t or "").split(pieces.SPACE) if t else ()):
            line = ("" if k else pieces.SPACE) + part.replace(" ", pieces.SPACE)
            least = [0.0] + [None] * len(line)
            for end in range(1, len(line) + 1):
                tried = [least[s] + model.score[line[s:end]] for s in range(max(0, end - longest), end) if line[s:end] in model.score]
                least[end] = max([least[end - 1] + model.unknown, *tried])
            want += least[-1] + (model.unknown if k else 0)
        assert total == pytest.approx(want)
        value = sum(model.score[model.names[i]] for i in best if i in model.text)
        assert value >= total - 1e-6  # what is missing are unknown characters


def test_toxicity_learns_from_the_training_folds_only(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(200)]
    rows, marks = [], []
    for i in range(1500):
        toxic = bool(rng.random() < 0.3)
        text = " ".join(rng.choice(words, 60)) + (" you awful troll " + " ".join(rng.choice(words, 5)) if toxic else "")
        rows.append((i, text))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.query(docs, labels).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in range(1500) if got[i].held_out] == held
    assert np.mean([got[i].predicted == marks[i][1] for i in held]) > 0.95
    flipped = spark.createDataFrame([(i, 1 - m if got[i].held_out else m) for i, m in marks], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in toxicity.query(docs, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_toxicity_trains_on_a_bounded_number_of_rows(spark):
    docs = [(k % 7, f"text {k}") for k in range(700)] + [(100 + k, None if k == 3 else f"text {k}") for k in range(50)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = labels_of(spark, [*range(7), *range(7), *range(100, 150)])
    every = {r.doc_id: r for r in toxicity.training_rows(docs, labels).collect()}
    want = [i for i in [*range(7), *range(100, 150)] if zlib.crc32(str(i).encode()) % 5]
    assert sorted(every) == want
    least = {i: min(f"text {k}" for k in range(i, 700, 7)) for i in range(7)} | {100 + k: f"text {k}" for k in range(50)} | {103: None}
    assert all(r.label == i % 2 and r.text == least[i] for i, r in every.items())
    assert toxicity.training_rows(docs, labels, 9).count() == 9


def ftrl_of_every_bucket(rows, labels, bits, epochs, seed):
    """The published update, one coordinate at a time, with no bucket left out."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(b):
        if abs(z[b]) <= toxicity.L1:
            return 0.0
        sign = 1 if z[b] > 0 else -1
        return -(z[b] - sign * toxicity.L1) / ((toxicity.BETA + n[b] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            w = {b: weight(b) for b in rows[i]}
            g = 1 / (1 + np.exp(-min(max(sum(w.values()), -35.0), 35.0))) - labels[i]
            for b, x in w.items():
                z[b] += g - ((n[b] + g * g) ** 0.5 - n[b] ** 0.5) / toxicity.ALPHA * x
                n[b] += g * g
    return {b: weight(b) for b in list(z) if weight(b)}


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    words = [rng.choice(40, rng.integers(1, 9), replace=False) for _ in range(600)]
    rows = [np.append(np.unique(np.r_[w, 40 + i]), 1 << 10) for i, w in enumerate(words)]  # with a bucket of its own
    labels = [int(3 in w or 5 in w) for w in words]
    used, w = toxicity.ftrl(rows, labels, 10, epochs=4, seed=9)
    want = ftrl_of_every_bucket(rows, labels, 10, 4, 9)
    assert len(want) > 3 and sorted(want) == used.tolist()
    assert np.allclose([want[b] for b in used], w)


def test_pipeline(spark, docs):
    out = corpus_pipeline.run(spark, SF)
    step = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    before = step.count()
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF)
        step = spark.createDataFrame(step.collect(), docs.schema)
        assert step.columns == docs.columns
        kept.append(step.count())
    assert before > kept[0] > kept[1] >= kept[2]
    assert out.count() == kept[3]
    model = pieces.Pieces(lengths.read_vocabulary(pieces.MODEL))
    assert all(model.decode(r.ids) == r.text and r.n_tokens == len(r.ids) for r in out.collect())


def test_near_stage_keeps_one_of_each_component(docs):
    found = simhash.near_duplicates(docs).collect()
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert sorted(kept) == sorted({r.component_id for r in found})


def brute_likeness(texts):
    """The least number of each component of the pairs of similarity 0.8 on five words."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def edited_copies():
    """Forty texts of 200 words with seven copies each, of one to nine edited words, and a common line in all."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        words = rng.integers(0, 5000, 200).tolist()
        for copy in range(8):
            w = list(words)
            for at in rng.choice(200, copy + (copy > 4), replace=False):
                w[at] = int(rng.integers(5000, 10000))
            texts.append(" ".join(map(str, w)) + " and a common line that stands below each and every text here")
    return texts


@pytest.mark.parametrize("pairs_a_row", [0, 4])
def test_near_stage_finds_all_of_similarity(spark, odd, monkeypatch, pairs_a_row):
    monkeypatch.setattr(nearcopies, "PAIRS_A_ROW", pairs_a_row)
    texts = [t for _, t in ODD] + edited_copies()
    rows = [(i, t, "en", "s", 0, *["clash"] * 9) for i, t in enumerate(texts)]
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SF)
    want = sorted(set(brute_likeness(texts)))
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert len(want) < 0.7 * len(texts)


def test_odd_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(9)
    sets, sizes = [], (1, 9, 90, 900, 5000)
    for n in sizes:
        base = rng.integers(0, 1 << 63, n, np.uint64)
        for share in (0, 0.05, 0.11, 0.2, 0.5, 1):
            sets.append(np.unique(np.r_[base[round(n * share) :], rng.integers(0, 1 << 63, round(n * share), np.uint64)]))
    i, j = np.triu_indices(len(sets), 1)
    sketch = np.array([np.frombuffer(nearcopies.odd_sketch(s), np.uint64) for s in sets])
    maybe = nearcopies.maybe_similar(sketch, np.array(list(map(len, sets))), i, j)
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    similar = np.array([5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n) for n, a, b in zip(both, i, j, strict=True)])
    assert maybe[similar].all() and similar.sum() > 15
    small = np.array([max(len(sets[a]), len(sets[b])) <= 900 for a, b in zip(i, j, strict=True)])
    assert not maybe[small & (both == 0)].any()


def test_alike_texts_below_the_similarity_make_no_candidates():
    """A group of texts of similarity about 0.7, under one key, made all its pairs."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[:364], rng.integers(0, 1 << 63, 36, np.uint64)]) for _ in range(120)]
    sets.append(sets[0][1:])  # one near copy
    signed = lambda x: np.array(x, np.uint64).view(np.int64)
    rows = pd.DataFrame({"key": 1, "node": np.arange(121), "fp": signed([simhash.majority(s) for s in sets]), "size": list(map(len, sets)), "c": np.arange(121), "task": 1})
    rows["sketch"] = [nearcopies.odd_sketch(s) for s in sets]
    i, _ = next(simhash.close_pairs(np.ones(121), rows["fp"].to_numpy().view(np.uint64), nearcopies.RADIUS))
    assert len(i) > 3000
    found = pd.concat(nearcopies._candidates(iter([rows])))
    assert (0, 120) in set(zip(found["u"], found["v"], strict=True)) and len(found) < 30


def task_rows(sets, c):
    signed = lambda x: np.array(x, np.uint64).view(np.int64)
    rows = pd.DataFrame({"key": 1, "node": np.arange(len(sets)), "fp": signed([simhash.majority(s) for s in sets]), "size": list(map(len, sets)), "c": c, "task": 1})
    rows["sketch"] = [nearcopies.odd_sketch(s, nearcopies.sketch_bits(len(s))) for s in sets]
    rows["shingles"] = [s.view(np.int64) for s in sets]
    return rows


def test_a_group_of_near_copies_makes_no_more_rows_than_it_has():
    """A group of n texts of similarity 0.9 under one key made n * n / 2 candidates, and joins of as many pairs."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[:390], rng.integers(0, 1 << 63, 10, np.uint64)]) for _ in range(120)]
    sets += [rng.integers(0, 1 << 63, 400, np.uint64) for _ in range(5)]  # like none
    rows = task_rows([np.unique(s) for s in sets], [0] * 3 + list(range(3, 125)))
    assert sum(map(len, nearcopies._candidates(iter([rows])))) > 7000
    marked = pd.concat(nearcopies._marked(iter([rows.drop(columns="shingles")])))
    assert set(marked["node"]) == set(range(120)) and len(marked) == 120
    found = pd.concat(nearcopies._joined(iter([marked.merge(rows[["node", "shingles"]], on="node")])))
    assert len(found) == 117  # a tree over 118 components
    root = np.array(rows["c"])
    simhash._merge(root, found["u"].to_numpy(), found["v"].to_numpy())
    assert (root[:120] == 0).all() and (root[120:] == np.arange(120, 125)).all()


def test_sketches_of_long_sets():
    """A sketch of 1,024 bits ruled out no pair of sets of some thousand shingles."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 4000, np.uint64)
    sets = [np.unique(np.r_[base[: 4000 - 4 * k], rng.integers(0, 1 << 63, n, np.uint64)]) for k in (0, 60, 250) for n in (0, 160, 800)]
    sets += [np.unique(base[:n]) for n in (513, 512, 415, 410, 2049, 2048)] + [rng.integers(0, 1 << 63, 0, np.uint64)]
    i, j = np.triu_indices(len(sets), 1)
    size = np.array(list(map(len, sets)))
    sketch = [nearcopies.odd_sketch(s, nearcopies.sketch_bits(len(s))) for s in sets]
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    similar, below = 9 * both >= 4 * (size[i] + size[j]), both < 0.72 * (size[i] + size[j] - both)
    below &= 5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])  # others go by their sizes
    fit = nearcopies.sketches_fit(sketch, size, i, j)
    assert fit[similar].all() and similar.sum() > 10
    assert not fit[below].any() and below.sum() > 5
    short = np.array([np.frombuffer(nearcopies.odd_sketch(s), np.uint64) for s in sets])
    assert nearcopies.maybe_similar(short, size, i, j)[below].any()
    assert len({len(x) for x in sketch}) > 2


def test_keys_of_the_same_nodes_are_one(spark):
    prefix = {1: [10, 11, 12], 2: [10, 11, 12], 3: [12, 13], 4: [14]}
    rows = [(n, 0, 9, p) for n, p in prefix.items()]
    members = spark.createDataFrame(rows + rows[:1], "node long, fp long, size int, prefix array<long>")
    found = nearcopies._shared(members).collect()
    assert sorted((r.key, r.node) for r in found) == [(10, 1), (10, 2), (12, 1), (12, 2), (12, 3)]


def test_near_stage_on_documents(spark, docs, texts):
    ids = sorted(texts)
    want = {ids[k] for k in brute_likeness([texts[i] for i in ids])}
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect()} == want
    assert len(want) < len(ids)


def test_registered_sql_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert {n.split("_")[0] for n in queries.queries()} == {"pipeline", *(f"op{k}" for k in range(1, 11))}
