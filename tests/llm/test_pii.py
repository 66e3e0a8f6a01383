"""Base spans against the plain patterns, the votes' estimates against known ones, and what the method adds."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from ledgerline.llm import pii
from tests.conftest import SF
from tests.llm.fixtures import awkward, empty

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip":
                good = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                twice = [x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))]
                good = 16 <= len(d) <= 19 and sum(twice) % 10 == 0
            else:
                good = kind == "email" or 8 <= len(d) <= 15
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(rows, got):
    want = Counter()
    for r in rows:
        spans = plain(r.text)
        of = Counter(s.split(":")[0] for s in spans)
        want[(r.doc_id, of["email"], of["ip"], of["card"], of["phone"], hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
    assert Counter((g.doc_id, g.n_email, g.n_ip, g.n_card, g.n_phone, g.base_sha256) for g in got) == want
    texts = {r.doc_id: r.text for r in rows}
    for g in got:
        spans = [x.split(":") for x in g.spans.split(",") if x]
        spans = [(k, int(a), int(b)) for k, a, b in spans]
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        if list(texts.values()).count(texts[g.doc_id]) == 1:
            assert {f"{k}:{a}:{b}" for k, a, b in spans} >= set(plain(texts[g.doc_id]))


def test_base_spans_of_odd_texts():
    r = random.Random(1)
    pieces = ["a@b.c", "@", "x.y-z@q-1.w", "@@", "..", "1.2.3.4", "256.1.1.1", "0001.2.3.004", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111111", "41111111111111112", " -", "--", "+1", "+1 (017) 555-7713", "+4", ") ", "7 ", "9", "é", "\U0001f600", "+", "%", " ", "\n", "e@f", "@g.h@i.j", "00000000000000000", "5", "+12345678", "+1234567890123456"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 9)))
        assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(text)] == plain(text), text


def test_long_runs_take_little_time():
    for run in ("a", "1", "1.", "1 ", "a@", "+1 ", "@a", "+", "a.", "1-", "ab at ", "12 ", "ff:", "(12) "):
        base = pii.base_spans(run * 100_000)
        pii.candidates((run * 20_000), pii.base_spans(run * 20_000))
        assert isinstance(base, list)


def test_sample_table_and_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs.collect(), pii.pii_report(docs).collect())
    odd = awkward(spark)
    check(odd.collect(), pii.pii_report(odd).collect())
    assert pii.pii_report(empty(spark)).collect() == []


def test_estimated_reliabilities_are_near_the_true_ones():
    r = np.random.default_rng(5)
    truth = r.random(20_000) < 0.3
    right = [0.9, 0.8, 0.7, 0.85]
    votes = ["".join("+" if (t if r.random() < p else not t) else "-" for p in right) for t in truth]
    counts = Counter(votes)
    patterns = sorted(counts)
    share, chance, true = pii.reliabilities(patterns, np.array([counts[p] for p in patterns]), steps=400)
    assert abs(share - 0.3) < 0.04
    assert all(abs(chance[1][i][2] - p) < 0.05 and abs(chance[0][i][0] - p) < 0.05 for i, p in enumerate(right))
    guess = dict(zip(patterns, true, strict=True))
    assert np.mean([(guess[v] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.9


def corpus(seed=1, n=600):
    """Texts with plain data, with data that the base patterns miss (what and where), and with numbers that name nobody."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    n10 = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    rows, hidden, decoys = [], [], []
    for i in range(n):
        out = [word() for _ in range(30)]
        out += [f"mail {word()}@{word()}.com", word(), f"phone +1 ({n10(3)}) 555-{n10(4)}", word(), f"server 10.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 255)}"]
        text = " ".join(out) + " "
        extra = None
        if i % 3 == 0:
            extra = r.choice([f"{word()} [at] {word()} [dot] org", f"{word()}(at){word()}.de"])
            text += f"contact {extra} {word()}"
            hidden.append((i, "email", text.index(extra), text.index(extra) + len(extra)))
        elif i % 3 == 1:
            extra = r.choice([f"chapter {n10(2)}.{n10(2)}", f"order {n10(16)[:15]}x", f"born {r.randint(1, 28):02d}-{r.randint(1, 12):02d}-19{n10(2)}", f"look at {word()}. {word()}"])
            decoys.append((i, len(text), len(text) + len(extra)))
            text += extra
        rows.append((i, text))
    return rows, hidden, decoys


def test_the_method_adds_what_patterns_miss_and_leaves_decoys(spark):
    rows, hidden, decoys = corpus()
    got = {g.doc_id: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in g.spans.split(","))] for g in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum((k, a, b) in got[i] for i, k, a, b in hidden)
    wrong = sum(any(a < y and x < b for _, x, y in got[i]) for i, a, b in decoys)
    assert found >= 0.8 * len(hidden) and wrong <= 0.05 * len(decoys), (found, len(hidden), wrong, len(decoys))
