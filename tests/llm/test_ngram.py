"""The n-gram Jaccard join against all pairs of documents that share a shingle."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pointloom.llm import ngram

from .conftest import rows


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(pairs, percent=80):
    sets = [(i, shingles(t)) for i, t in pairs]
    parent = {i: i for i, _ in pairs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            having[x].append(k)
    for k, (i, s) in enumerate(sets):
        for j in {j for x in s for j in having[x] if j < k}:
            o = sets[j][1]
            same = len(s & o)
            if 100 * same >= percent * (len(s) + len(o) - same):
                a, b = sorted((root(i), root(sets[j][0])))
                parent[b] = a
    return sorted((i, len(s), root(i)) for i, s in sets)


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def near_copies():
    """Chains and clusters of near copies of several degrees, with a line that nearly all texts hold."""
    rng = random.Random(4)
    out = []
    for c in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((3, 6, 30, 80, 200)))]
        for _ in range(rng.choice((2, 5, 50))):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                t = t[: int(len(t) * rng.uniform(0.75, 1))]
            out.append(" ".join(t) + ("\nthe same line at the end of very many texts" if rng.random() < 0.6 else ""))
            if rng.random() < 0.1:
                base = t
    rng.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize("small", [False, True])
def test_components(spark, odd, no_docs, monkeypatch, small):
    if small:  # the ways for large inputs
        monkeypatch.setattr(ngram, "LONG", 3)
        monkeypatch.setattr(ngram, "HELD", 500)
        monkeypatch.setattr(ngram, "CHUNK", 2)
        monkeypatch.setattr(ngram, "SENT", 0)
        monkeypatch.setattr(ngram, "FEW", 0)
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string").repartition(3)
    assert rows(ngram.components_of(docs)) == brute(plain(docs))
    assert rows(ngram.components_of(odd)) == brute(plain(odd))
    if small:
        assert rows(ngram.components_of(docs, 60)) == brute(plain(docs), 60)
    assert rows(ngram.components_of(no_docs)) == []


def triples():
    """Texts whose sets begin alike in the order of codes: two that are similar, and one that is similar to neither or
    only to one.  Kinds: all of one size; the second of the similar ones shorter, so in another group."""
    rng = random.Random(7)
    least = lambda s, k=2: ngram.sets_of([s.encode()])[0][:k].tolist()
    out = []
    for kind in (0, 1):
        made = 0
        while made < 12:
            w = [f"{'uv'[kind]}{rng.randrange(10**6)}" for _ in range(13)]
            b = [*w[:11], "p", "q"]
            c = [*w[:11], "p", "r"] if kind == 0 else b[:12]
            a, b, c = (" ".join(x) for x in (w, b, c))
            if least(a) == least(b) == least(c):
                made += 1
                out += [a, b, c] if made % 2 else [a, c, b]
    return list(enumerate(out, 10))


@pytest.mark.parametrize("parts", [1, 2])
def test_members(spark, monkeypatch, parts):
    """Members of a group that are similar to each other, or to another group, and not to their leader."""
    monkeypatch.setattr(ngram, "order_of", lambda docs: (ngram.Order(np.zeros(1 << 16, np.uint8)), 1000))  # as in a corpus that has no shingle often
    docs = spark.createDataFrame(triples(), "doc_id long, text string")
    docs = docs.coalesce(1) if parts == 1 else docs.repartition(2)
    want = brute(plain(docs))
    assert len({c for _, _, c in want}) == 48
    assert rows(ngram.components_of(docs)) == want


def test_words_of_one_code(spark):
    """Words that polynomials modulo a power of two can't tell apart are different words."""
    word = lambda n, swap: "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))
    texts = [(i, " ".join(f"{word(n, swap)}{k}" if swap else f"{word(n, 0)}{k}" for k in range(9))) for i, (n, swap) in enumerate((n, s) for n in (1024, 4096) for s in (0, 1))]
    texts += [(9, word(1024, 0)), (10, word(1024, 1))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(ngram.components_of(docs)) == brute(plain(docs)) and len({c for _, _, c in brute(plain(docs))}) == 6


def rim():
    """A base, near copies of it that are linked to it, and others beyond them, of which a few are linked to a copy."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    out = [list(base)]
    for _ in range(150):
        t, edits = list(base), rng.choice((1, 1, 2, 3, 4, 5, 6, 8))
        if rng.random() < 0.3:  # side by side, or those of another
            at = rng.randrange(140)
            for j in range(edits):
                t[at + j] = f"e{at}-{j}" if rng.random() < 0.7 else f"x{rng.randrange(10**6)}"
        else:
            for _ in range(edits):
                t[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.1:
            t = t[: rng.randrange(110, 150)]
        out.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize(("parts", "few"), [(1, 1), (9, 1), (9, 10**9)])
def test_rim(spark, monkeypatch, parts, few):
    monkeypatch.setattr(ngram, "FEW", few)
    docs = spark.createDataFrame(rim(), "doc_id long, text string").repartition(parts)
    want = brute(plain(docs))
    assert 5 < len({c for _, _, c in want}) < 140
    assert rows(ngram.components_of(docs)) == want


def test_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "x y z"), (9, "x y z"), (7, "q")], "doc_id long, text string")
    assert rows(ngram.components_of(docs)) == [(None, 1, None), (5, 1, 5), (5, 1, 5), (7, 1, 7), (9, 1, 5)]


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = rows(ngram.components_of(docs))
    assert got == brute(plain(docs)) and len({c for _, _, c in got}) < len(got)
