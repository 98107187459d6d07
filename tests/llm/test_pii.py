"""Personal data against plain regular expressions, and the trees on held-out samples."""

import hashlib
import re

from pointloom.llm import pii

from .conftest import rows

TEXTS = [
    None, "", "a.b+c@x.y.z, @x.y a@b a@@b.c x@y.z@w.v.u é@a.b _%@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1..2.3.4 9" + "1" * 30 + ".2.3.4",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111111 1234567890123456789012345", "+1 (743) 555-3824, +12 3 4 +1-2-3-4-5-6-7-8-9. +1 )) ( 2 + 3",
    "😀 mail é bob at example dot com or call (415) 555-0134 today", "9" * 3000 + "." + "@" * 500 + "+1" * 300, "a" * 2000 + "@b", "phone: 415-555-0134, ssn 078-05-1120, iban DE44 5001 0517 5407 3249 31",
]


def base(t):
    t = t or ""
    found = [[], [], [], []]
    found[0] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found[1] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            found[2].append(m.span())
    found[3] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    text = ",".join(f"{k}:{a}:{b}" for k, x in zip(("email", "ip", "card", "phone"), found) for a, b in x)
    return tuple(map(len, found)), hashlib.sha256(text.encode()).hexdigest(), set(filter(None, text.split(",")))


def test_scan(spark, real, odd, no_docs):
    mine = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for docs in (real, odd, mine, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        for r, (i, t) in zip(rows(pii.scan(docs)), sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), strict=True):
            counts, sha, spans = base(t)
            assert r[:6] == (i, *counts, sha) and r[7] == len(list(filter(None, r[6].split(",")))), t
            got = r[6].split(",") if r[6] else []
            assert spans <= set(got)
            assert got == sorted(got, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
    assert rows(pii.scan(no_docs)) == []
    spans = {r[0]: r[6] for r in rows(pii.scan(mine))}
    assert spans[6] == "email:9:31,phone:40:54" and "ident:" in spans[9] and "account:" in spans[9] and "phone:" in spans[9]


def test_trees_held_out():
    model, right = pii.trained(), []
    for text, span, y in pii.samples(2000, seed=99, held=True):
        right.append((model.chance(pii.features(text, span)) >= model.threshold[span[1]], y))
    accepted = [y for p, y in right if p]
    assert sum(accepted) / len(accepted) > 0.95 and sum(accepted) / sum(y for _, y in right) > 0.7


def test_all_spans_by_brute_force(real):
    """The likeliest candidates first, each kept if it meets nothing that stays."""
    import random

    model, rng = pii.trained(), random.Random(3)
    made = ["".join(rng.choice((s, s, rng.choice(TEXTS) or "")) for _ in range(4)) for s, _, _ in pii.samples(150, seed=5)]
    for t in [*(x for x in TEXTS if x), *made, *(r.text or "" for r in real.collect())]:
        base_found, own = pii.all_spans(t, model)
        taken, want = [(a, b) for a, _, b in base_found], []
        likely = [(model.chance(pii.features(t, c)), c) for c in pii.candidates(t)]
        for p, (a, k, b) in sorted(likely, key=lambda x: (-x[0], x[1])):
            if p >= model.threshold[k] and not any(a < e and s < b for s, e in taken):
                taken.append((a, b))
                want.append((a, k, b))
        assert own == want


def test_thresholds():
    """Calibration decides: no kind with a generator takes all its candidates, and each has a threshold."""
    cuts = pii.trained().threshold
    assert all(0.2 <= c < 1 for c in cuts) and len(set(cuts)) > 2


def test_overlaps():
    """A long span of the base that holds many others keeps a method's span out wherever it lies."""
    text = "1.2.3.4_" * 9 + "415-555-0134@example.org"
    base, own = pii.all_spans(text, pii.trained())
    assert sum(k == 0 for _, k, _ in base) == 1 and own == []
    got = pii.all_spans("call 415-555-0134 or 192[.]168[.]0[.]12, client fe80:0:0:0:ab1:22ff:fe33:4455", pii.trained())
    assert {(k, a) for a, k, _ in got[1]} >= {(3, 5), (1, 21)}


def test_plain_text_is_left_alone(real):
    model = pii.trained()
    extra = [(r.doc_id, x) for r in real.collect() for x in pii.all_spans(r.text, model)[1]]
    assert len(extra) <= 2, extra


def test_redact(spark, odd):
    docs = odd.union(spark.createDataFrame([(99, "write a.b@c.de or +1 (743) 555-3824!", "q", 2.0, "z")], odd.schema))
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[99].text == "write [EMAIL] or [PHONE]!" and got[99].component_id == "z" and got[0].text is None and got[7].text == "the quick brown fox jumps over the lazy dog near the old river bank today"
