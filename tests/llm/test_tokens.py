"""The BPE transducer, its decoder and edit-aware counts against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from pointloom.llm import bpe, tokencount

from .conftest import rows

PATH = bpe.default_vocabulary()
BITS = ["a", "b", "t", "h", "e", " ", "  ", "\n", "é", "\U0001f600", "0", "1", "!", ".", "'s", "'re", "<|endoftext|>", "<|endof", "text|>", "中", "\xa0", "́", "_", "-", "ing", "tion"]


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return bpe.Model(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def some_texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choice(BITS) for _ in range(rng.randrange(70)))


def ids_of(library, t):
    return np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_encode_and_decode(model, library):
    for t in some_texts(1500, 1):
        assert model.encode(t) == ids_of(library, t)
        assert "".join(model.decode(model.encode(t))) == t
    rng = np.random.default_rng(2)
    for _ in range(200):  # ids that are no encoding of any text
        ids = rng.integers(0, len(model.bytes_of), 30)
        assert "".join(model.decode(ids.astype("<u4").tobytes())) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_borders(model):
    rng = random.Random(5)
    for _ in range(4000):
        x, y = (rng.choice((rng.randrange(256), rng.randrange(3000), rng.randrange(50000))) for _ in range(2))
        if not (model.stable(-1, x) and model.stable(-1, y)):
            continue
        whole = model.bytes_of[x] + model.bytes_of[y]
        assert model.parted(x, y) == (model.merged([model.of_byte[b] for b in whole]) == [x, y])


def test_transducer_is_bounded_and_final(model, library):
    rng = random.Random(7)
    for t in ("a" * 5000, "ab" * 3000, "-" * 4001, "the" * 2000, "".join(rng.choice("etaoinshr") for _ in range(6000)), "".join(rng.choice("=-_*") for _ in range(5000))):
        machine, out = bpe.Transducer(model), []
        raw = t.encode()
        while raw:
            n = rng.randrange(1, 50)
            out += machine.feed(raw[:n])
            raw = raw[n:]
            assert len(machine.held) <= model.lookahead + 2 * model.longest + 50
        assert out + machine.end() == library.encode(t).ids


def test_encoder_in_pieces(model, library, monkeypatch):
    """Any pieces give the library's ids, and what is held does not grow with the text."""
    rng = random.Random(9)
    monkeypatch.setattr(bpe, "LONG", 60)
    long = ["a" * 3000, " " * 3000, "\n" * 2000 + "x", "  \n" * 900 + "word", " " + "7" * 2500 + "!", "-=" * 1500, "é" * 1500 + "'re", "'" * 700 + "s", "ab " * 900, "<|endoftext|>" * 80, "x" * 200 + "<|endoftext|>" + " " * 200, "\xa0" * 500 + " y", "a" * 300 + "1" * 300 + " " * 300 + "."]
    for t in [*some_texts(300, 21), *long, *("".join(rng.choice(long)[: rng.randrange(200)] for _ in range(6)) for _ in range(60))]:
        encoder, out, at = bpe.Encoder(model), [], 0
        while at < len(t):
            n = rng.choice((1, 3, 17, 200))
            out += encoder.feed(t[at : at + n])
            at += n
            assert len(encoder.held) <= 60 + 2 * model.margin + 200
        assert b"".join([*out, *encoder.end()]) == ids_of(library, t), t[:80]


def test_other_vocabularies_are_refused():
    import json

    with open(PATH, "rb") as f:
        spec = json.load(f)
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Model(json.dumps(spec).encode())


def test_digests(spark, real, odd, no_docs, library):
    for docs in (real, odd):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = ids_of(library, r.text or "")
            text = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
            want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert rows(bpe.digests(docs, PATH)) == sorted(want)
    assert rows(bpe.digests(no_docs, PATH)) == []
    assert rows(bpe.decode(bpe.encode(odd, PATH), PATH)) == sorted((r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect())


def test_edits(model, library):
    rng = random.Random(11)
    for t in [*some_texts(150, 3), "word " * 900, "", "x" * 2000, " " * 500 + "a" + " " * 500]:
        tree = tokencount.TokenTree(model, t)
        for _ in range(12):
            a = rng.randrange(len(t) + 1)
            b = min(len(t), a + rng.randrange(8))
            new = "".join(rng.choice(BITS) for _ in range(rng.randrange(5)))
            tree.edit(a, b, new)
            t = t[:a] + new + t[b:]
            assert tree.text() == t and tree.n_chars == len(t)
            assert tree.n_tokens == len(library.encode(t, add_special_tokens=False).ids)
    long = "Some words, and more of them. " * 5000
    tree = tokencount.TokenTree(model, long)
    tree.edit(70_000, 70_004, "else")
    assert tree.reencoded < 60


def test_insertions_seldom_rebuild(model, library):
    rng, t = random.Random(4), "Some words, and more of them. " * 9000
    tree = tokencount.TokenTree(model, t)
    for _ in range(200):
        at = rng.randrange(len(t))
        tree.edit(at, at, " put in")
        t = t[:at] + " put in" + t[at:]
    for _ in range(30):  # in one place
        tree.edit(500, 500, " again and again")
        t = t[:500] + " again and again" + t[500:]
    assert tree.rebuilt <= 4 and tree.text() == t
    tree.edit(100, len(t) - 100, "")
    t = t[:100] + t[-100:]
    tree.edit(90, 95, " x y z")
    t = t[:90] + " x y z" + t[95:]
    assert tree.text() == t and tree.n_tokens == len(library.encode(t, add_special_tokens=False).ids)


def test_recount(spark, real, odd, no_docs, library):
    for docs in (real, odd):
        for r, (i, t) in zip(rows(tokencount.recount(docs, PATH)), sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), strict=True):
            n = len(library.encode(t, add_special_tokens=False).ids)
            after = t
            edits = tokencount.sample_edits(t)
            for a, b, new in edits:
                a = min(a, len(after))
                after = after[:a] + new + after[max(a, b) :]
            assert (r[0], *r[2:6]) == (i, n, len(edits), len(after), len(library.encode(after, add_special_tokens=False).ids))
    assert rows(tokencount.recount(no_docs, PATH)) == []
