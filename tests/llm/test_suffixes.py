"""Repeated strings against a count of all windows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pointloom.llm import suffixes

from .conftest import rows


def passages(pairs, passage):
    """(runs, words) of each text that another document has in passages of so many words."""
    words = [(i, t, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in pairs]
    having = defaultdict(set)
    for i, t, w in words:
        for j in range(len(w) - passage + 1):
            having[tuple(w[j : j + passage])].add((i, t))
    out = []
    for _, _, w in words:
        hit = np.zeros(len(w) + 1, int)
        for j in range(len(w) - passage + 1):
            if len(having[tuple(w[j : j + passage])]) > 1:
                hit[j : j + passage] = 1
        out.append((int((np.diff(hit, prepend=0) == 1).sum()), int(hit.sum())))
    return out


def brute(pairs, length, passage=51):
    raw = [(i, (t or "").encode()) for i, t in pairs]
    shared = passages(pairs, passage)
    seen = Counter(b[j : j + length] for _, b in raw for j in range(len(b) - length + 1))
    out = []
    for (i, b), (runs, words) in zip(raw, shared, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest(), len(left), runs, words, runs > 0))
    return sorted(out, key=str)


def mixture(seed, unit, n=60):
    """Texts that share passages of sizes near a window's, with edits, runs of one letter and periodic stretches."""
    rng = random.Random(seed)
    letters = "abcdefgh é"
    passage = ["".join(rng.choice(letters) for _ in range(int(unit * f))) for f in (0.5, 0.98, 1, 1.02, 1.5, 3)] + ["a" * (2 * unit), "xyz" * unit]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randrange(4)):
            p = rng.choice(passage)
            if rng.random() < 0.3:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice("Q€") + p[k + 1 :]
            t += "".join(rng.choice(letters) for _ in range(rng.randrange(unit))) + p
        out.append(t)
    return list(enumerate(out))


@pytest.mark.parametrize(("length", "hot", "sent"), [(400, 512, 10**6), (40, 512, 0), (40, 512, 3000), (40, 3, 10**6)])
def test_dedup(spark, monkeypatch, length, hot, sent):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SENT", sent)
    monkeypatch.setattr(suffixes, "TOGETHER", 50)
    monkeypatch.setattr(suffixes, "HELD", 200 if hot == 3 else 1 << 19)
    monkeypatch.setattr(suffixes, "LONG", 2 if hot == 3 else 16)
    monkeypatch.setattr(suffixes.tk, "PIECE", 1 << 14)
    docs = spark.createDataFrame(mixture(length + hot, length), "doc_id long, text string").repartition(3)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    words = 9 if length == 400 else 5
    got = sorted(rows(suffixes.dedup(docs, length, words)), key=str)
    assert got == brute(plain, length, words) and any(r[-1] for r in got)


def test_odd(spark, odd, no_docs):
    plain = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted(rows(suffixes.dedup(odd, 60)), key=str) == brute(plain, 60)
    assert sorted(rows(suffixes.dedup(odd)), key=str) == brute(plain, 400)
    assert rows(suffixes.dedup(no_docs)) == []
    same = spark.createDataFrame([(None, "ab" * 300), (None, "ab" * 300), (1, "q" * 399), (1, "q" * 399), (1, "z")], "doc_id long, text string")
    assert sorted(rows(suffixes.dedup(same)), key=str) == brute([(r.doc_id, r.text) for r in same.collect()], 400)


def test_tables(spark, real):
    assert sorted(rows(suffixes.dedup(real)), key=str) == brute([(r.doc_id, r.text) for r in real.collect()], 400)


def test_columns(tmp_path):
    rng = random.Random(2)
    for _ in range(30):
        strings, lead, group = [], [], []
        for g in range(3):
            base = bytes(rng.choice(b"ab") for _ in range(60))
            for _ in range(rng.randrange(1, 6)):
                a, b = rng.randrange(20), rng.randrange(40, 61)
                s = bytearray(base[a:b])
                if rng.random() < 0.6:
                    s[rng.randrange(len(s))] = 99
                strings.append(np.frombuffer(bytes(s), np.uint8))
                lead.append(30 - a)
                group.append(g)
        if not strings:
            continue
        doc = [rng.randrange(3) for _ in strings]
        for dtype, of in ((np.uint8, None), (np.uint64, np.array(doc))):
            got = suffixes.repeated([s.astype(dtype) for s in strings], lead, np.array(group), 12, f"file://{tmp_path}", of)
            for i, s in enumerate(strings):
                fits = lambda k, j: (of is None or doc[k] != doc[i]) and k != i and group[k] == group[i] and 0 <= (o := j - lead[i] + lead[k]) and len(strings[i]) - j >= 12 and len(strings[k]) - o >= 12 and (strings[k][o : o + 12] == strings[i][j : j + 12]).all()  # noqa: B023, E731
                assert got[i].tolist() == [j for j in range(len(s)) if any(fits(k, j) for k in range(len(strings)))]
        assert not list(tmp_path.iterdir())
