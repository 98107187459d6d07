"""Every stage of the pipeline against a brute-force version, on what the stage before it kept."""

import pytest

from pointloom.llm import bpe, pii, quality
from pointloom.llm.queries import queries

from .conftest import rows
from .test_ngram import brute
from .test_tokens import ids_of
from .test_words import contamination, quality_base

pipeline = pytest.importorskip("corpus_pipeline")


def check_stages(spark, docs, sf):
    """Runs the stages and holds each against brute force; returns what went into the last."""
    columns = docs.dtypes
    held = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str)
    steps = dict(pipeline.STAGES)
    known = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)

    field = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    share = {(r.doc_id, r.n_words): r.content_share for r in quality.score(docs, field).collect()}
    held = [(i, t) for i, t in held if not (b := quality_base(t))[5] and share[i, b[0]] >= quality.MIN_CONTENT]
    docs = steps["quality_rules"](spark, docs, sf)
    assert docs.dtypes == columns and known(docs) == held

    first = {i: c for i, _, c in brute(held)}
    held = sorted({(i, t) for i, t in held if first[i] == i and t == min(u for j, u in held if j == i)}, key=str)
    docs = steps["near_duplicates"](spark, docs, sf)
    assert docs.dtypes == columns and known(docs) == held

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {x[0] for x in contamination(held, items) if x[5]}
    held = [(i, t) for i, t in held if i not in bad]
    docs = steps["decontamination"](spark, docs, sf)
    assert docs.dtypes == columns and known(docs) == held

    held = sorted(((i, pii.redacted(t, pii.trained())) for i, t in held), key=str)
    docs = steps["personal_data"](spark, docs, sf)
    assert [(n, "bigint" if n == "n_chars" else k) for n, k in columns] == docs.dtypes
    assert known(docs) == held and all(r.n_chars == len(r.text) for r in docs.collect())
    return bad, held, docs, rows(steps["encoding"](spark, docs, sf))


def test_stages(spark, sf):
    from tokenizers import Tokenizer

    assert list(dict(pipeline.STAGES)) == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "encoding"]
    bad, held, docs, got = check_stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert bad
    library = Tokenizer.from_file(bpe.default_vocabulary())
    assert {r[0]: r[1] for r in got} == {i: len(ids_of(library, t)) // 4 for i, t in held}
    assert rows(pipeline.run(spark, sf)) == rows(bpe.digests(docs, bpe.default_vocabulary()))


def test_odd(spark, sf, odd, no_docs):
    """Nulls, empty and long texts, repeated rows and clashing names: the same brute force, and something is left."""
    named = odd.toDF("doc_id", "text", "lang", "n_chars", "source")
    texts = [" ".join(f"{x}{i}" for i in range(n)) for x, n in (("p", 60), ("q", 70), ("p", 61), ("long", 9000))]
    more = spark.createDataFrame([(100 + k, t, "x", 1.0, "y") for k, t in enumerate(texts)] + [(101, texts[1], "x", 1.0, "y"), (101, texts[0] + " other", "x", 1.0, "y"), (None, texts[1], "x", 1.0, "y")], named.schema)
    _, held, _, got = check_stages(spark, named.unionAll(more).where("doc_id is not null"), sf)
    assert len(held) >= 3 and len(got) == len(held)
    with_null = named.unionAll(more)
    for _, stage in pipeline.STAGES[:-1]:
        with_null = stage(spark, with_null, sf)
    assert {r.doc_id for r in with_null.collect()} >= {None, *(i for i, _ in held)}  # a row without id stays
    empty = no_docs.toDF("doc_id", "text", "n_chars")
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert rows(empty) == []


def test_queries():
    assert [int(q[2:].split("_")[0]) for q in queries()] == list(range(1, 11))
