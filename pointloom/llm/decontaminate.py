"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows of benchmark texts.

A window is 13 consecutive words of an item (all its words where it has fewer), regarded as a set of placed
shingles.  For full containment the necessary prefix of a window, its shingles in order of rarity, is one shingle:
the one that the corpus holds least often.  So the join key is that rarest shingle.  Documents are streamed
against it; a hit is bounded by place and length (the window must fit between the ends of the text) and then
verified over the whole window, first by its code and then by its words.

Corpus counts: one pass counts, over all documents, the benchmark's shingles only, with map-side sums.  The
benchmark side is taken in blocks of about ``BLOCK_WINDOWS`` windows, one after another: the driver holds one block,
sends it to the executors and writes what it hits, so a benchmark of any size is a sequence of such blocks over the same
documents.  A benchmark of one block, the usual case, is judged in the pass that finds the hits.

Defined results: a null or empty text has no words; an item without words has no window; ids of items are strings,
whatever their type, and an item without id is left out; items that repeat an id count once, with the windows of all
their texts; repeated documents are each judged on their own; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import kept, narrow, without

WINDOW = 13
SHINGLE = 3
#: Windows of the benchmark that are joined at a time; about 150 bytes each.
BLOCK_WINDOWS = 200_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_FOUND = "doc_id long, th long, size long, runs binary, items array<string>"
_COUNTED = "doc_id long, th long, size long, n_words long"


class Windows:
    """The distinct windows of a block of items, and the shingle that each is found by."""

    def __init__(self, items: list[tuple[str, bytes]]):
        w = tk.Words([t for _, t in items], tk.ALNUM)
        found: dict[tuple[bytes, ...], set[str]] = {}
        for i, (item, _) in enumerate(items):
            words = [w.word(j) for j in range(w.first[i], w.first[i + 1])]
            for j in range(max(1, len(words) - WINDOW + 1) if words else 0):
                found.setdefault(tuple(words[j : j + WINDOW]), set()).add(item)
        self.words = list(found)
        self.items = [sorted(found[x]) for x in self.words]
        self.length = np.array([len(x) for x in self.words], np.int64)
        flat = tk.Words([b" ".join(x) for x in self.words], tk.ALNUM, lower=False)
        first = flat.first[:-1]
        self.code = np.zeros(len(self.words), np.uint64)
        self.widths = sorted({min(SHINGLE, int(n)) for n in self.length})
        shingles = {k: flat.runs(k) for k in self.widths}
        for n in np.unique(self.length):
            same = self.length == n
            self.code[same] = flat.runs(int(n))[first[same]]
        #: For each window, the codes of its shingles from each place on.
        self.shingles = [shingles[min(SHINGLE, int(n))][a : a + n - min(SHINGLE, int(n)) + 1] for a, n in zip(first, self.length, strict=True)]

    def all_shingles(self) -> dict[int, np.ndarray]:
        out: dict[int, list[np.ndarray]] = {}
        for n, x in zip(self.length, self.shingles, strict=True):
            out.setdefault(min(SHINGLE, int(n)), []).append(x)
        return {k: np.unique(np.concatenate(v)) for k, v in out.items()}

    def keyed(self, counts: dict[tuple[int, int], int]) -> None:
        """Sorts the windows by (width, rarest shingle); counts: occurrences in the corpus, absent: none."""
        self.shift = np.zeros(len(self.words), np.int64)
        self.key = np.zeros(len(self.words), np.uint64)
        for i, codes in enumerate(self.shingles):
            width = min(SHINGLE, int(self.length[i]))
            rank = [(counts.get((width, int(c)), 0), int(c)) for c in codes]
            self.shift[i] = j = rank.index(min(rank))
            self.key[i] = codes[j]
        width = np.minimum(self.length, SHINGLE)
        order = np.lexsort((self.key, width))
        self.order = {k: order[width[order] == k] for k in self.widths}
        self.sorted_key = {k: self.key[v] for k, v in self.order.items()}
        del self.shingles


def _counted(wanted: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(v), np.int64) for k, v in wanted.items()}

        def one(_: pa.RecordBatch, texts: list[bytes | None]) -> None:
            w = tk.Words(texts, tk.ALNUM)
            for k, codes in wanted.items():
                run = w.runs(k)[w.run_fits(k)]
                at = np.searchsorted(codes, run)
                at[at == len(codes)] = 0
                total[k] += np.bincount(at[codes[at] == run], minlength=len(codes))

        for _ in tk.by_parts(batches, "text", one):
            pass
        for k, sums in total.items():
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(wanted[k][some].view(np.int64)), pa.array(sums[some])], names=["width", "code", "n"])

    return run


def _hits(block: Windows, w: tk.Words) -> tuple[dict[int, np.ndarray], dict[int, set[str]]]:
    """For each text with a hit, the runs of hit words and the items."""
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for k in block.widths:
        codes, order = block.sorted_key[k], block.order[k]
        run = w.runs(k)
        low = np.searchsorted(codes, run, "left")
        hit = np.flatnonzero((low < len(codes)) & (codes[np.minimum(low, len(codes) - 1)] == run) & w.run_fits(k))
        if not len(hit):
            continue
        low = low[hit]
        many = np.searchsorted(codes, run[hit], "right") - low
        place = np.repeat(hit, many)
        window = order[np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())]
        doc = np.searchsorted(w.first, place, "right") - 1
        start = place - block.shift[window]
        fits = (start >= w.first[doc]) & (start + block.length[window] <= w.first[doc + 1])
        place, window, doc, start = place[fits], window[fits], doc[fits], start[fits]
        for n in np.unique(block.length[window]):
            of = block.length[window] == n
            x, s = window[of], start[of]
            codes_there = np.zeros(len(s), np.uint64)
            for j in range(int(n)):
                codes_there += w.hash[s + j] * tk._PLACE_CODE[j]
            for v, a, d in zip(*(y[tk.mix(codes_there + np.uint64(n)) == block.code[x]].tolist() for y in (x, s, doc[of])), strict=True):
                if block.words[v] == tuple(w.word(a + j) for j in range(int(n))):
                    spans.setdefault(d, []).append((a - int(w.first[d]), int(n)))
                    items.setdefault(d, set()).update(block.items[v])
    return {d: _union(x) for d, x in spans.items()}, items


def _verdicts(ids: pa.Array, n_words: list[int], runs: list[np.ndarray | None], items: list[set[str]]) -> pa.RecordBatch:
    hit = [0 if r is None else int((r[:, 1] - r[:, 0]).sum()) for r in runs]
    sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    bad = [h > 0 and 20 * h >= n for h, n in zip(hit, n_words, strict=True)]
    columns = (pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_()))
    return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _judged_at_once(block: Windows):
    def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        w = tk.Words(texts, tk.ALNUM)
        runs, items = _hits(block, w)
        return _verdicts(rows.column(0), w.counts.tolist(), [runs.get(d) for d in range(len(texts))], [items.get(d, set()) for d in range(len(texts))])

    return lambda batches: tk.by_parts(batches, "text", one)


def _found(block: Windows):
    def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        runs, items = _hits(block, tk.Words(texts, tk.ALNUM))
        at = sorted(runs)
        own = rows.select(["doc_id", "th", "size"]).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*own.columns, pa.array([runs[d].tobytes() for d in at], pa.binary()), pa.array([sorted(items[d]) for d in at], pa.list_(pa.string()))], names=["doc_id", "th", "size", "runs", "items"])

    return lambda batches: tk.by_parts(batches, "text", one)


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.select(["doc_id", "th", "size"]).columns, pa.array(tk.Words(texts, tk.ALNUM).counts.astype(np.int64))], names=["doc_id", "th", "size", "n_words"])

    return tk.by_parts(batches, "text", one)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts from the runs and items of all blocks."""
    for b in batches:
        runs, items = [], []
        for parts, names in zip(b.column("runs").to_pylist(), b.column("items").to_pylist(), strict=True):
            spans = [(int(s), int(e - s)) for p in parts or () for s, e in np.frombuffer(p, np.int64).reshape(-1, 2)]
            runs.append(_union(spans) if spans else None)
            items.append({x for of_block in names or () for x in of_block})
        yield _verdicts(b.column("doc_id"), b.column("n_words").to_pylist(), runs, items)


def _union(spans: list[tuple[int, int]]) -> np.ndarray:
    """Disjoint runs (start, end) of the places that the spans (start, length) cover."""
    out: list[list[int]] = []
    for a, n in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return np.array(out, np.int64)


def _blocks(items: DataFrame) -> Iterator[Windows]:
    """Items (item, text) in blocks; the driver holds the texts of one block at a time."""
    own: list[tuple[str, bytes]] = []
    size = 0
    for row in items.where("item is not null and text is not null").distinct().orderBy("item", "text").toLocalIterator():
        if size >= BLOCK_WINDOWS:
            yield Windows(own)
            own, size = [], 0
        own.append((row.item, row.text.encode()))
        size += len(own[-1][1]) // 4 + 1
    yield Windows(own)


def _ranked(texts: DataFrame, block: Windows) -> Windows:
    wanted = block.all_shingles()
    counts = texts.select("text").mapInArrow(_counted(wanted), "width int, code long, n long").groupBy("width", "code").agg(F.sum("n").alias("n")).collect() if wanted else []  # at most the block's shingles
    block.keyed({(r.width, r.code & (1 << 64) - 1): r.n for r in counts})
    return block


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: words, hit words, items found, and whether at least a twentieth of the words are hit."""
    texts = narrow(docs, id_col, text_col)
    blocks = _blocks(benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")))
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return texts.mapInArrow(_judged_at_once(_ranked(texts, block)), SCHEMA)
    key = ["doc_id", "th", "size"]
    keyed = texts.select("doc_id", "text", F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long").alias("size"))
    found = None
    while block is not None:
        own = kept(keyed.mapInArrow(_found(_ranked(texts, block)), _FOUND).dropDuplicates(key), "hits")  # rows that repeat have the same hits
        found = own if found is None else found.unionByName(own)
        block, following = following, next(blocks, None) if following is not None else None
    by_doc = found.groupBy(*key).agg(F.collect_list("runs").alias("runs"), F.collect_list("items").alias("items")).withColumnsRenamed({c: f"_{c}" for c in key})
    counted = keyed.mapInArrow(_counted_words, _COUNTED)
    same = counted.doc_id.eqNullSafe(F.col("_doc_id")) & (counted.th == F.col("_th")) & (counted["size"] == F.col("_size"))
    return counted.join(by_doc, same, "left").select("doc_id", "n_words", "runs", "items").mapInArrow(_judged, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with all columns, without the contaminated; an id goes if one of its rows is."""
    judged = judge(docs, benchmark, id_col, text_col, item_col, item_text_col)
    return without(docs, kept(judged.where("contaminated").select("doc_id"), "contaminated"), id_col)
