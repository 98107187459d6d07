"""Operators on words against brute force."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from pointloom.llm import decontaminate, licenses, quality

from .conftest import rows


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def blank(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def quality_base(t):
    w = blank(t)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if blank(x)]
    n = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_quality(spark, real, odd, no_docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    field = quality.train(real, labels)
    assert field is not None
    for docs in (real, odd):
        got = rows(quality.score(docs, field))
        want = sorted((r.doc_id, *quality_base(r.text)) for r in docs.select("doc_id", "text").collect())
        assert [r[:7] for r in got] == want
        assert not any(r[6] and r[7] for r in got)
    assert rows(quality.score(no_docs, field)) == []
    assert quality.train(no_docs, labels) is None and quality.train(real, labels.limit(0)) is None
    assert all(r.kept != r.base_failed for r in quality.score(odd, None).collect())


def thue_morse(n, swap=False):
    """Strings that polynomials modulo a power of two can't tell apart."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_lines_of_one_code(spark):
    texts = [(n, f"{thue_morse(n)}\n{thue_morse(n, True)}\n{'word ' * 60}") for n in (1024, 2048, 4096)]
    got = quality.score(spark.createDataFrame(texts, "doc_id long, text string"), None).collect()
    assert [r.n_dup_lines for r in got] == [0, 0, 0]


def mixed_texts(docs, labels, n=200):
    """Texts of stretches of lines from good and bad documents, and for each line whether it is content.  Lines of bad
    documents count only where they look like junk, as those documents hold plain lines too."""
    import random

    rng = random.Random(5)
    quality_of = {r.doc_id: r.quality for r in labels.collect()}
    junk, clean = [], []
    for r in docs.collect():
        for line in (r.text or "").split("\n"):
            odd = re.search(r"[|]|!!|%%%|&&&", line)
            if blank(line) and quality_of.get(r.doc_id) == (0 if odd else 1):
                (junk if odd else clean).append(line)
    for i in range(n):
        kinds = [rng.random() < 0.5 for _ in range(rng.randrange(2, 5)) for _ in range(rng.randrange(2, 6))]
        for j in range(1, len(kinds)):
            if rng.random() < 0.75:
                kinds[j] = kinds[j - 1]
        yield i, "\n".join(rng.choice(clean if k else junk) for k in kinds), kinds


def test_lines_are_labelled(spark):
    """Content and boilerplate in one text are told apart line by line."""
    import numpy as np

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"])
    field = quality.train(docs, labels.where("doc_id % 2 = 0"))
    known = labels.where("doc_id % 2 = 1")
    texts = list(mixed_texts(docs.join(known, "doc_id", "left_semi").select("doc_id", "text"), known))
    m = quality.Measured([t.encode() for _, t, _ in texts])
    got = quality.viterbi(m.features, m.line_first, field)
    want = np.concatenate([np.array(k) for _, _, k in texts])
    assert len(got) == len(want) and (got == want).mean() > 0.97
    share = [r.content_share for r in quality.score(spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string"), field).collect()]
    assert sum(0 < x < 1 for x in share) > 0.5 * len(share)


def test_quality_held_out(spark):
    """Held-out accuracy of the verdict: the field never sees the documents that it is judged on."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"])
    field = quality.train(docs, labels.where("doc_id % 2 = 0"))
    got = quality.score(docs.join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id"), field).join(labels, "doc_id").toPandas()
    got["verdict"] = got.content_share >= quality.MIN_CONTENT
    assert got[got.quality == 1].verdict.mean() > 0.985 and (~got[got.quality == 0].verdict).mean() > 0.95


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    field = quality.Field(rng.normal(size=quality.N_FEATURES), rng.normal(size=(2, 2)), rng.normal(size=2))
    x = rng.integers(0, 2, (17, quality.N_FEATURES)).astype(np.uint8)
    first = np.array([0, 6, 6, 7, 17])
    got = quality.viterbi(x, first, field)
    for a, b in zip(first[:-1], first[1:]):
        score = x[a:b] @ field.emit
        value = lambda p: (field.start[p[0]] if p else 0) + sum(s for s, y in zip(score, p) if y) + sum(field.pair[u, v] for u, v in zip(p, p[1:]))
        best = max(itertools.product((0, 1), repeat=b - a), key=value)
        assert tuple(got[a:b].astype(int)) == best


def contamination(docs, items):
    windows = {}
    for item, t in items:
        w = alnum(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    sizes = {len(x) for x in windows}
    for i, t in docs:
        w, hit, found = alnum(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[x]
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontaminate(spark, real, odd, no_docs, sf, monkeypatch):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    small = spark.createDataFrame([(1, "The lazy"), (2, None), (3, "..."), (4, "a b c d e"), (4, "W5"), (None, "x"), (12, " ".join(f"w{i}" for i in range(20, 40)))], "item_id long, text string")
    for limit in (decontaminate.BLOCK_WINDOWS, 3):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", limit)
        for docs, items in ((odd, small), (odd, benchmark)) if limit == 3 else ((real, benchmark), (odd, small)):
            if limit == 3 and items is benchmark:
                items = benchmark.limit(3)
            pairs = [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]
            want = sorted(contamination([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], pairs))
            assert rows(decontaminate.judge(docs, items)) == want
    assert sum(r[5] for r in rows(decontaminate.judge(real, benchmark))) > 0
    named = small.select(F.concat(F.lit("item-"), "item_id").alias("item_id"), "text")
    pairs = [(r.item_id, r.text) for r in named.collect() if r.item_id is not None]
    assert rows(decontaminate.judge(odd, named)) == sorted(contamination([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], pairs))
    assert rows(decontaminate.judge(no_docs, small)) == []
    assert all(r[2] == 0 for r in rows(decontaminate.judge(odd, small.limit(0))))


def test_licenses(spark, real, odd, no_docs):
    for docs in (real, odd):
        for r, (i, t) in zip(rows(licenses.scan(docs)), sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), strict=True):
            w = alnum(t)
            at = sorted((j, label) for label, p in licenses.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
            assert r[:6] == (i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
            assert set(filter(None, r[5].split(","))) <= set(r[6].split(",")) and 0 <= r[7] <= 1
    assert rows(licenses.scan(no_docs)) == []
    texts = [(i, f"some words before. {t}. and after") for i, t in enumerate(licenses.TEMPLATES.values())]
    for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        assert list(licenses.TEMPLATES)[r.doc_id] in r.labels.split(",") and r.score == 1


def test_licenses_in_longer_ones(spark):
    """A template that the text holds whole is found where the run goes on in another template."""
    t = licenses.TEMPLATES
    texts = [
        (0, f"{t['apache-2.0']} the project ships"),
        (1, f'{t["apache-2.0"]} (the "License") and more words'),
        (2, f"before {t['apache-2.0-notice']} after"),
        (3, " ".join(["see", t["apache-2.0"], "the end."] * 300)),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [(got[i].labels, got[i].score) for i in (0, 1)] == [("apache-2.0", 1.0)] * 2
    assert got[0].spans == "apache-2.0:0:8"
    assert got[2].labels == "apache-2.0,apache-2.0-notice" and got[2].spans.startswith("apache-2.0:1:9,apache-2.0-notice:1:")
    assert got[3].spans.count("apache-2.0:") == 300


def test_long_texts_take_linear_time():
    import time

    auto = licenses.Automaton(licenses.TEMPLATES)
    sizes = [len(b) for b in auto.bodies]

    def seconds(n):
        words = [w for _ in range(n) for w in [*auto.numbers[1][:20], *auto.numbers[8][5:30]]]
        start = time.process_time()
        assert licenses.chains(auto.matches(words, 0), sizes) is not None
        return time.process_time() - start

    seconds(100)
    assert seconds(4000) < 8 * seconds(1000) + 0.2


def test_matches_of_each_template():
    bodies = {"a": "a b c d e a b c d f", "b": "b c d e", "c": "x a b c d", "d": "c d e a b c d"}
    auto = licenses.Automaton(bodies)
    for text in ("a b c d e x a b c d", "a b c d f", "x a b c d e a b c d e", "b c d e a b c d f a b c d"):
        words, want = text.split(), set()
        for t, body in enumerate(x.split() for x in bodies.values()):
            for i in range(len(words)):
                for j in range(len(body)):
                    n = next((k for k in range(min(len(words) - i, len(body) - j)) if words[i + k] != body[j + k]), min(len(words) - i, len(body) - j))
                    if n >= licenses.MIN_MATCH and (not i or not j or words[i - 1] != body[j - 1]):
                        want.add((t, j, i, n))
        got = auto.matches([auto.vocabulary[x.encode()] for x in words], 0)
        assert sorted(got) == sorted(want)


def test_matching_statistics():
    auto = licenses.Automaton({"a": "a b c b c d", "b": "b c d a b"})
    number = auto.vocabulary
    runs = {tuple(x[i:j]) for x in (["a", "b", "c", "b", "c", "d"], ["b", "c", "d", "a", "b"]) for i in range(6) for j in range(i + 1, 7)}
    text = list("abcbcdabcdabbcxbcda")
    got = auto.statistics([number.get(x.encode(), -1) for x in text])
    assert [n for n, _ in got] == [max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in runs), default=0) for i in range(len(text))]
    for n, state in got:
        assert all(end >= n for _, end in auto.ends[state])
