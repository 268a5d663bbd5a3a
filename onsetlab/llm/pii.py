"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Further candidates come from
wider patterns: runs that may be secrets (keys and tokens), card numbers whose checksum fails, addresses
spelled out, local telephone numbers, national ids, persons. On every span, base ones too, seven labelers
(regex, gazetteer and context) vote for, against or not at all: strict form, gazetteer, words before,
code or assignment before, borders, placeholders, randomness. The votes of all documents are counted by
pattern; from these counts, at most 3**7 a kind, expectation-maximisation (Dawid and Skene 1979) estimates
how reliable each labeler is. Its posteriors train a logistic span classifier on the span's form (kind,
borders, digits, length, the class of the text before and after), of which there are at most 30,720 cases,
counted over all documents as well; it accepts or drops the candidates. So both fits see all data, and
the driver only tables of fixed size.

Nulls, ties, odd rows: a null or empty text has no spans; spans of one start sort in the order of
``KINDS``; base spans of different kinds may overlap, candidates overlap no base span and, from left to
right, no earlier candidate; without any candidate nothing is added; repeated rows and null ids are
ordinary rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetlab.llm.text import per_text
from onsetlab.staging import staged

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "card_like", "spelled_email", "local_phone", "national_id", "person")
LABELERS = 7
#: Cases of a form, part by part: kind, border before and after, digits, length, class before and after.
CASES = (len(KINDS), 4, 4, 4, 4, 4, 3)

# The gazetteers and context words of the labelers, and the names reserved for examples.
TLDS = frozenset("com org net edu gov io co de fr es uk eu info biz us ca it nl ch at be".split())
NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph "
    "jessica thomas sarah charles karen anna peter paul maria jose juan carlos hans klaus pierre marie".split()
)
RESERVED = re.compile(r"(?:^|[@.])(?:example|invalid|test|localhost)(?:\.(?:com|net|org))?$", re.I)
CONTEXT = re.compile(
    r"\b(?:e-?mail|mail|contact|call|phone|tel|mobile|fax|card|visa|account|address|ip|host|ssn|name|mr|mrs|ms|dr)\b[^\n]{0,12}$",
    re.I,
)
SECRET_NAME = re.compile(
    r"(?:token|secret|passw(?:or)?d|passwd|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|\bkey|auth|bearer|credentials?)"
    r"[\"']?\s{0,3}(?:[:=]{1,2}>?|\bis\b|)\s{0,3}[\"'`]?$",
    re.I,
)
ASSIGNED = re.compile(r"[:=]\s{0,3}[\"'`]?$")
CODE = re.compile(r"(?:version|ver|v|rev|[=<>{}\[\]\"'/\\#])\s*$", re.I)

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is taken whole or not at all, so that a run is scanned once.
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_run = "A-Za-z0-9+/_="
_secret = re.compile(rf"(?<![{_run}-])[{_run}][{_run}-]{{15,511}}+(?![{_run}-])")
_wider = (
    ("spelled_email", re.compile(r"\b[A-Za-z0-9_.-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z]{2,24}){1,3}\b", re.I)),
    ("local_phone", re.compile(r"(?<![\w.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    ("national_id", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("person", re.compile(r"\b(?:Mr|Mrs|Ms|Dr)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?\b|\b(?:" + "|".join(sorted(n.capitalize() for n in NAMES)) + r") [A-Z][a-z]{2,30}\b")),
)
_digit, _letter = re.compile("[0-9]"), re.compile("[A-Za-z]")


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    twice = (d * 2 - 9 * (d > 4) for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + sum(twice)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: at each at-sign, as far left as nothing else has taken."""
    found, taken, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _local:
            start -= 1
        host = _domain.match(text, at + 1) if start < at else None
        if host:
            found.append((start, host.end()))
            taken = host.end()
        at = text.find("@", max(at + 1, taken))
    return found


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans, sorted, and of the card numbers that fail their checksum."""
    spans, failed = [(a, 0, b) for a, b in emails(text)], []
    for m in _ip.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) < 256 for p in parts):
            spans.append((m.start(), 1, m.end()))
    for m in _card.finditer(text):
        if m.end() - m.start() > 11:
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19:
                right = luhn(digits)
                (spans if right else failed).append((m.start(), 2 if right else KINDS.index("card_like"), m.end()))
    for m in _phone.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans), failed


def wider_spans(text: str, taken: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates that overlap neither base spans nor earlier candidates, in one sweep."""
    found = [*found]
    for m in _secret.finditer(text):
        if _digit.search(m[0]) and _letter.search(m[0]):
            found.append((m.start(), KINDS.index("secret"), m.end()))
    for kind, pattern in _wider:
        found.extend((m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text))
    out, last, k, reach = [], 0, 0, 0
    for a, kind, b in sorted(found):
        while k < len(taken) and taken[k][0] < b:  # base spans that begin before this one ends
            reach = max(reach, taken[k][2])
            k += 1
        if a >= last and a >= reach:
            out.append((a, kind, b))
            last = b
    return out


def votes(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    """Of each labeler: 2 for, 1 not voting, 0 against."""
    span, name = text[start:end], KINDS[kind]
    digits, before = _digits(span), text[max(0, start - 32) : start]
    words, code, random = CONTEXT.search(before), 0 if CODE.search(before) else 1, 1
    if name in ("email", "spelled_email"):
        form = ".." not in span and not span.startswith((".", "-"))
        known = re.split(r"\W+", span)[-1].lower() in TLDS
    elif name == "ip":
        form, known = not re.search(r"(?:^|\.)0[0-9]", span), digits[0] != 0
    elif name in ("card", "card_like"):
        form, known = name == "card" and len(digits) >= 13, digits[0] in (3, 4, 5, 6)
        random = 2 if len(set(digits)) > 4 else 0
    elif name == "phone":
        form, known = len(digits) >= 10, digits[0] != 0
    elif name == "person":
        form, known = span.count(" ") > 0, span.split()[0].lower() in NAMES
    elif name == "secret":
        words = SECRET_NAME.search(before)
        code = 2 if ASSIGNED.search(before) else 1
        form, known = len(span) >= 20 and "//" not in span, words is not None
        share = len(digits) / len(span)
        random = 2 if len(set(span)) >= 10 and 0.1 < share < 0.9 and not re.search(r"[a-z]{8}|[0-9]{9}", span) else 0
    else:
        form, known = True, digits[0] not in (0, 9)
    near = lambda c: c.isalnum() or c in "_@"
    joined = (start and near(text[start - 1])) or (end < len(text) and near(text[end]))
    filler = len(digits) > 3 and len(set(digits)) < 3 or span.startswith(("127.", "0.0.0.0")) or RESERVED.search(span)
    return (2 if form else 0, 2 if known else 0, 2 if words else 1, code, 0 if joined else 2, 0 if filler else 1, random)


def form(text: str, start: int, kind: int, end: int) -> int:
    """The span's case for the classifier: kind, borders, share of digits, length, what stands before and after."""

    def border(at: int) -> int:
        c = text[at : at + 1] if at >= 0 else ""
        return 0 if not c or c.isspace() else 1 if c.isalnum() else 2 if c in ".,;:!?" else 3

    n = end - start
    before, after = text[max(0, start - 32) : start], text[end : end + 2]
    told = 1 if SECRET_NAME.search(before) else 2 if CONTEXT.search(before) else 3 if CODE.search(before) else 0
    closed = 1 if after[:1] in ("'", '"', "`", ")", "]", "}") and after else 2 if after[:1].isalnum() else 0
    code = kind
    for size, part in zip(CASES[1:], (border(start - 1), border(end), min(3, 4 * len(_digits(text[start:end])) // n), min(3, n // 10), told, closed), strict=True):
        code = code * size + part
    return code


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and more: the document's base spans and candidates, with votes and form as codes."""

    def find(texts: list) -> list[list]:
        base, more = [], []
        for text in texts:
            text = text or ""
            own, failed = base_spans(text)
            for out, some in ((base, own), (more, wider_spans(text, own, failed))):
                rows = []
                for a, kind, b in some:
                    code = 0
                    for v in votes(text, a, kind, b):
                        code = code * 3 + v
                    rows.append({"start": a, "kind": kind, "end": b, "votes": kind * 3**LABELERS + code, "form": form(text, a, kind, b)})
                out.append(rows)
        return [base, more]

    span = "array<struct<start:int,kind:int,end:int,votes:int,form:int>>"
    return per_text(docs, ["doc_id"], lambda: find, f"base {span}, more {span}")


def reliabilities(counts: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """EM over vote patterns (code to count): the posterior of each pattern that its spans are personal data."""
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes], float)
    vote = np.array([[c % 3**LABELERS // 3 ** (LABELERS - 1 - k) % 3 for k in range(LABELERS)] for c in codes])
    kind = codes // 3**LABELERS
    p = np.clip(0.5 + 0.15 * (vote - 1).sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        prior = np.array([(1 + (n * p)[kind == k].sum()) / (2 + n[kind == k].sum()) for k in range(len(KINDS))])
        yes, no = np.log(prior[kind]), np.log(1 - prior[kind])
        for k in range(LABELERS):
            for side, weight in ((0, n * p), (1, n * (1 - p))):
                # The smoothing leans to labelers that are better than chance.
                lean = np.array([1.0, 1.0, 2.0] if side == 0 else [2.0, 1.0, 1.0])
                seen = np.bincount(vote[:, k], weight, 3) + lean
                rate = np.log(seen / seen.sum())[vote[:, k]]
                yes, no = (yes + rate, no) if side == 0 else (yes, no + rate)
        p = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
    return dict(zip(codes.tolist(), p.tolist(), strict=True))


def classifier(cases: dict[int, tuple[float, float]], steps: int = 200, ridge: float = 1.0) -> dict[int, float]:
    """Logistic regression over forms (code to count and summed posterior): each form's probability."""
    if not cases:
        return {}
    codes = np.array(sorted(cases))
    n, y = np.array([cases[c] for c in codes], float).T
    parts, rest = [], codes.copy()
    for size in reversed(CASES):
        parts.append(np.eye(size)[rest % size])
        rest //= size
    x = np.column_stack([np.ones(len(codes)), *parts])
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's method; the ridge keeps it bounded
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - n * p) - ridge * w
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w)), gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(codes.tolist(), (1 / (1 + np.exp(-x @ w))).tolist(), strict=True))


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, base and spans: the base spans, and these with the accepted candidates, sorted by start and kind."""
    found = staged(spans(docs), "pii-spans")
    every = found.select(F.explode(F.concat("base", "more")).alias("s")).select("s.votes", "s.form")
    counts = {r["votes"]: r["n"] for r in every.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 10 * 3**7
    posterior = reliabilities(counts)
    table = docs.sparkSession.createDataFrame(list(posterior.items()), "votes int, p double")
    soft = every.join(F.broadcast(table), "votes").groupBy("form").agg(F.count("*").alias("n"), F.sum("p").alias("p"))
    cases = {r["form"]: (r["n"], r["p"]) for r in soft.collect()}  # at most 30,720 forms
    accepted = [c for c, p in classifier(cases).items() if p >= threshold]
    keep = F.array(*map(F.lit, accepted)).cast("array<int>")
    more = F.filter("more", lambda s: F.array_contains(keep, s["form"])) if accepted else F.slice("more", 1, 0)
    return found.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def _told(spans: str):
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ","
    )


def labelled(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and the spans as an array of (kind, start, end), for redaction or review."""
    kinds = F.array(*map(F.lit, KINDS))
    name = lambda s: F.struct(F.element_at(kinds, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return find(docs, threshold).select("doc_id", F.transform("spans", name).alias("spans"))


def query(docs: DataFrame) -> DataFrame:
    found = find(docs)
    of = lambda k, c="base": F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.sha2(_told("base").cast("binary"), 256).alias("base_sha256"),
        _told("spans").alias("spans"),
        of(KINDS.index("secret"), "spans").alias("n_secret"),
        F.size("spans").cast("long").alias("n_spans"),
    )
