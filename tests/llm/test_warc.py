"""WARC: an exact round trip, the order of histories, and record types against brute force."""

import base64
import hashlib
import random
import zlib

import pytest

from pointloom.llm import warc

from .conftest import rows


def want(pages, least=0):
    first = {}
    for i, html in pages:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(i, first.get(html or "", i))
    for i, html in pages:
        raw = (html or "").encode()
        of = first.get(html or "")
        again = of is not None and of != i
        yield i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", of if again else None


ODD = [(3, "http://www.a.b/x?q=1", "é" * 500), (1, None, None), (2, "::not a url [", ""), (9, "http://a.b/x?q=1", "é" * 500), (None, "http://c", "z"), (8, "http://a.b", "z"), (8, "http://a.b", "z"), (7, "http://a.b/\r\nX: y", "\r\n\r\nWARC/1.1\r\n"), (20, "q", "z")]


@pytest.mark.parametrize("small", [False, True])
def test_archive(spark, sf, tmp_path, monkeypatch, small):
    if small:
        for name, value in (("FAN_IN", 2), ("STRIDE", 3), ("RANGE", 4000)):
            monkeypatch.setattr(warc, name, value)
    odd = spark.createDataFrame([(*r, "w", 1) for r in ODD], "page_id long, url string, html string, size string, first int").repartition(4)
    real = spark.read.parquet(f"{sf}/pages.parquet").repartition(7)
    for k, (pages, least) in enumerate(((odd, 0), (real, 0), (odd, 5), (odd.limit(0), 0))):
        plain = [(r.page_id, r.html) for r in pages.select("page_id", "html").collect()]
        folder = f"file://{tmp_path}/{k}"
        got = warc.archive(pages, folder, least)
        assert sorted(rows(got), key=str) == sorted(want(plain, least), key=str)
        again = warc.merge(warc.write(pages, f"{folder}-2", least), f"{folder}-2").orderBy("range", "place").collect()
        keys = [(r.url_key, r.stamp, r.page_id) for r in again]
        assert keys == sorted(keys) and len(keys) == len(plain)
    for file in tmp_path.glob("1/*.warc.gz"):  # the archives are gzip members one after another
        data, n = file.read_bytes(), 0
        while data:
            d = zlib.decompressobj(31)
            assert d.decompress(data).startswith(b"WARC/1.1\r\n")
            data, n = d.unused_data, n + 1
        assert n


def test_repeated_keys(spark, tmp_path, monkeypatch):
    """More captures of one key than lie between two places, with ranges cut at that key: none is lost."""
    monkeypatch.setattr(warc, "RANGE", 20_000)
    rows_in = [(None, "http://a.b/same", f"text {i}") for i in range(3 * warc.STRIDE)] + [(7, "http://a.b/row", "again")] * (2 * warc.STRIDE + 9) + [(i, f"http://a.b/{i % 40}", f"page {i}") for i in range(900)]
    pages = spark.createDataFrame(rows_in, "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/repeated"
    runs = warc.write(pages, folder)
    histories = warc.merge(runs, folder)
    assert histories.select("range").distinct().count() > 2
    assert histories.count() == len(rows_in)
    got = warc.read(histories, folder)
    assert sorted(rows(got), key=str) == sorted(want([(i, html) for i, _, html in rows_in]), key=str)


def test_loser_tree():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(map(iter, runs))) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("HTTP://www.Example.COM/A/b?c=d") == "com,example)/A/b?c=d"
    assert warc.url_key(None) == "" and warc.url_key("http://x") == "x)/"
