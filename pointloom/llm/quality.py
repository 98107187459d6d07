"""Quality rules: a linear-chain conditional random field labels the lines of a text as content or boilerplate.

The field is trained here, on a bounded sample of labelled documents (``SAMPLE_DOCS`` of either label, chosen by a
hash of the id; of these all lines count).  Labels are of documents, so those of lines come by expectation and
maximisation in turns, with the documents' labels as constraint: each line first takes its document's label; a
classifier of single lines is fitted; a line then takes the label that the classifier gives it, as long as a good
document keeps half of its bytes as content and a bad one has no more than ``MIN_CONTENT`` of them, the surest lines
first; and so on, ``TURNS`` times.  The field is fitted on these labels, which change within a document.  Viterbi
decoding then labels the lines of every text; a document stays if lines of content hold at least ``MIN_CONTENT`` of the
bytes of its lines.  Scoring is one narrow pass over the documents: no shuffle, and each batch of whole texts is handled
on its own.

Defined results: a null text has no words and no lines; a document without lines has content share 0; rows that
repeat are scored each on their own; with no labelled documents of both kinds the field is absent and every line
counts as content; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import narrow, ship

#: Labelled documents of either label that the field is fitted on, at most.
SAMPLE_DOCS = 1500
#: Lines in a training sequence, at most; longer documents give several sequences.
SEQUENCE = 48
#: Turns of fitting a classifier of lines and labelling the lines anew.
TURNS = 4
#: Least share of a good document's bytes that stay content while lines are labelled.
GOOD_CONTENT = 0.5
#: Least share of a kept document's bytes in lines of content.
MIN_CONTENT = 0.3

N_FEATURES = 22
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, content_share double"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class Field:
    """Weights of the field: emit[feature] and the pair and start terms, all in favour of label 1 (content) over 0."""

    emit: np.ndarray
    pair: np.ndarray
    start: np.ndarray


def _cumulated(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


class Measured:
    """The base counts and the lines, with their features, of a batch of texts."""

    def __init__(self, texts: list[bytes | None]):
        w = self.words = tk.Words(texts, tk.BLANK, lower=False)
        buf, docs = w.buf, len(texts)
        self.n_words = w.counts
        lead, symbol = _cumulated(_LEAD[buf]), _cumulated(_SYMBOL[buf])
        self.word_chars = _per_doc(lead[w.end] - lead[w.start], w.first)
        self.n_symbols = symbol[w.at[1:]] - symbol[w.at[:-1]]
        self.n_repeat_words = self._repeated(w, docs)

        stop = np.flatnonzero(buf == 10)
        start = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
        first = np.searchsorted(w.start, start)
        count = np.searchsorted(w.start, stop) - first
        full = count > 0
        start, stop, first, count = start[full], stop[full], first[full], count[full]
        self.line_bytes = stop - start
        self.line_first = np.searchsorted(start, w.at)
        doc = np.repeat(np.arange(docs), np.diff(self.line_first))
        key = tk.mix(tk.codes(buf, start, stop) + tk.mix(doc.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        self.n_dup_lines = _per_doc(again.astype(np.int64), self.line_first)
        self.features = self._features(buf, start, stop, first, count, again, lead, symbol)

    @staticmethod
    def _repeated(w: tk.Words, docs: int) -> np.ndarray:
        """Words in 3-word windows that the text holds at least twice."""
        n = len(w)
        if n < 3:
            return np.zeros(docs, np.int64)
        key = tk.mix(w.runs(3) + tk.mix(w.doc.astype(np.uint64)))
        at = np.flatnonzero(w.run_fits(3))
        order = np.argsort(key[at], kind="stable")
        ranked = key[at][order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        covered = np.zeros(n + 3, bool)
        for j in range(3):
            covered[at[twice] + j] = True
        return _per_doc(covered[:n].astype(np.int64), w.first)

    def _features(self, buf, start, stop, first, count, again, lead, symbol) -> np.ndarray:
        chars = np.maximum(lead[stop] - lead[start], 1)
        share = lambda sums: (sums[stop] - sums[start]) / chars
        symbols, digits, upper = share(symbol), share(_cumulated(_DIGIT[buf])), share(_cumulated(_UPPER[buf]))
        h = self.words.hash
        echo = np.zeros(len(h) + 1, np.int64)
        if len(h):
            echo[2:] = np.cumsum(h[1:] == h[:-1])
        echoed = (echo[first + count] - echo[first + 1]) / count
        length = chars / count
        last = buf[stop - 1] if len(stop) else np.zeros(0, np.uint8)
        columns = [
            np.ones(len(start), bool),
            count <= 2, (count > 2) & (count <= 5), (count > 5) & (count <= 12), (count > 12) & (count <= 30), count > 30,
            symbols == 0, (symbols > 0) & (symbols <= 0.02), (symbols > 0.02) & (symbols <= 0.08), symbols > 0.08,
            digits > 0.2, (digits > 0.05) & (digits <= 0.2),
            upper > 0.3, (upper > 0.1) & (upper <= 0.3),
            np.isin(last, list(b".!?")),
            again,
            echoed == 0, (echoed > 0) & (echoed <= 0.1), (echoed > 0.1) & (echoed <= 0.4), echoed > 0.4,
            length > 14, length < 4,
        ]
        return np.stack(columns, 1).astype(np.uint8) if len(start) else np.zeros((0, N_FEATURES), np.uint8)


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def _line_classifier(x: np.ndarray, y: np.ndarray, rounds: int = 120, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic classifier of lines, with both labels weighing alike."""
    theta, pace = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * len(y)
    for _ in range(rounds):
        grad = x.T @ ((y - 1 / (1 + np.exp(-(x @ theta)))) * weight) - penalty * theta
        pace += grad * grad
        theta += 0.3 * grad / np.sqrt(pace + 1e-9)
    return theta


def line_labels(docs: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    """Labels (true: content) of the lines of labelled documents: (features, bytes, label of the document)."""
    size = np.array([len(x) for x, _, _ in docs])
    first = np.concatenate(([0], np.cumsum(size)))
    x = np.concatenate([x for x, _, _ in docs]).astype(np.float32)
    good = np.repeat([q == 1 for _, _, q in docs], size)
    share = np.concatenate([b / max(1, b.sum()) for _, b, _ in docs])
    doc = np.repeat(np.arange(len(docs)), size)
    y = good.copy()
    for _ in range(TURNS):
        score = x @ _line_classifier(x, y)
        # of each document the lines that go against its label, surest first, as far as its share lasts
        against = np.where(good, -score, score)
        order = np.lexsort((-against, doc))
        turned = np.where(against[order] > 0, share[order], 0.0)
        spent = np.cumsum(turned)
        spent -= np.repeat(np.concatenate(([0.0], spent))[first[:-1]], size)  # within the document
        may = (turned > 0) & (spent <= np.where(good[order], 1 - GOOD_CONTENT, MIN_CONTENT))
        new = good.copy()
        new[order[may]] ^= True
        if (new == y).all() or new.all() or not new.any():
            break
        y = new
    return np.split(y, first[1:-1])


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 120, penalty: float = 1.0) -> Field | None:
    """Greatest conditional likelihood by full-batch gradient steps; docs: features and bytes of lines, label."""
    docs = [d for d in docs if len(d[0])]
    if len({q for _, _, q in docs}) < 2:
        return None
    sequences = [(x[at : at + SEQUENCE], own[at : at + SEQUENCE], q) for (x, _, q), own in zip(docs, line_labels(docs), strict=True) for at in range(0, len(x), SEQUENCE)]
    n, longest = len(sequences), max(len(x) for x, _, _ in sequences)
    x = np.zeros((n, longest, N_FEATURES), np.float32)
    y = np.zeros((n, longest), np.int64)
    size = np.array([len(rows) for rows, _, _ in sequences])
    for i, (rows, own, _) in enumerate(sequences):
        x[i, : len(rows)], y[i, : len(rows)] = rows, own
    real = np.arange(longest) < size[:, None]
    of = np.array([q for _, _, q in sequences])
    weight = np.where(of == 1, 0.5 / max(1, (of == 1).sum()), 0.5 / max(1, (of == 0).sum())) * n
    theta, pace = np.zeros(N_FEATURES + 6), np.zeros(N_FEATURES + 6)
    for _ in range(rounds):
        emit, pair, start = theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[N_FEATURES + 4 :]
        score = np.zeros((n, longest, 2))
        score[:, :, 1] = x @ emit.astype(np.float32)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = score[:, 0] + start
        for t in range(1, longest):
            forward[:, t] = np.logaddexp(forward[:, t - 1, :1] + pair[0], forward[:, t - 1, 1:] + pair[1]) + score[:, t]
        for t in range(longest - 2, -1, -1):
            ahead = score[:, t + 1] + backward[:, t + 1]
            onward = np.stack([np.logaddexp(ahead[:, 0] + pair[k, 0], ahead[:, 1] + pair[k, 1]) for k in (0, 1)], 1)
            backward[:, t] = np.where((t + 1 < size)[:, None], onward, 0)
        total = np.logaddexp(*np.moveaxis(forward[:, 0] + backward[:, 0], 1, 0))
        node = np.exp(forward + backward - total[:, None, None]) * real[:, :, None]
        grad = np.zeros_like(theta)
        off = (y - node[:, :, 1]) * real * weight[:, None]
        grad[:N_FEATURES] = np.einsum("nt,ntf->f", off, x)
        both = real[:, 1:] * weight[:, None]
        for a in (0, 1):
            for b in (0, 1):
                edge = np.exp(np.minimum(0, forward[:, :-1, a] + pair[a, b] + score[:, 1:, b] + backward[:, 1:, b] - total[:, None]))
                grad[N_FEATURES + 2 * a + b] = (((y[:, :-1] == a) & (y[:, 1:] == b)) * both - edge * both).sum()
            grad[N_FEATURES + 4 + a] = (((y[:, 0] == a) - node[:, 0, a]) * weight).sum()
        grad -= penalty * theta
        pace += grad * grad
        theta = theta + 0.3 * grad / np.sqrt(pace + 1e-9)
    return Field(theta[:N_FEATURES].copy(), theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2).copy(), theta[N_FEATURES + 4 :].copy())


def viterbi(features: np.ndarray, first: np.ndarray, field: Field | None) -> np.ndarray:
    """The best labels of the lines of each text; texts are decoded side by side, line by line."""
    n = len(features)
    if field is None or not n:
        return np.ones(n, bool)
    score = features @ field.emit
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    back = np.zeros((n, 2), np.int8)
    live = int((size > 0).sum())
    best = np.empty((live, 2))
    best[:, 0] = field.start[0]
    best[:, 1] = field.start[1] + score[start[:live]]
    ended = np.zeros(len(size), np.int8)
    for t in range(1, int(size[0]) + 1):
        still = int(np.searchsorted(-size, -t, "left"))
        ended[still:live] = best[still:, 1] >= best[still:, 0]
        best, live = best[:still], still
        if not live:
            break
        at = start[:live] + t
        came = best[:, :, None] + field.pair
        pick = came[:, 1] >= came[:, 0]
        back[at] = pick
        best = np.where(pick, came[:, 1], came[:, 0])
        best[:, 1] += score[at]
    label = np.zeros(n, bool)
    state = ended
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))
        at = start[:live] + t
        label[at] = state[:live]
        if t:
            state[:live] = back[at, state[:live]]
    return label


def _scored(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tk.by_parts(batches, "text", one)

    def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        m = Measured(texts)
        content = viterbi(m.features, m.line_first, field)
        total = _per_doc(m.line_bytes, m.line_first)
        share = _per_doc(m.line_bytes * content, m.line_first) / np.maximum(total, 1)
        failed = (m.n_words < 50) | (100 * m.n_repeat_words > 50 * m.n_words)
        long = lambda x: pa.array(x.astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [rows.column(0), *map(long, (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)), pa.array(failed), pa.array(~failed & (share >= MIN_CONTENT)), long(np.diff(m.line_first)), pa.array(share)],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "content_share"],
        )

    return run


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and bytes of all lines of labelled documents."""

    def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        m = Measured(texts)
        spans = list(zip(m.line_first[:-1].tolist(), m.line_first[1:].tolist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array([m.features[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([m.line_bytes[a:b].astype("<i4").tobytes() for a, b in spans], pa.binary()), rows.column(2)], names=["features", "sizes", "label"])

    return tk.by_parts(batches, "text", one)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """The field fitted on SAMPLE_DOCS documents of either label at most; documents with both labels count as bad."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.join(narrow(docs, id_col, text_col).select("doc_id").distinct(), "doc_id", "left_semi")
    pick = lambda q: known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    chosen = pick(0).unionAll(pick(1))
    sample = narrow(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "quality")  # at most 2 * SAMPLE_DOCS rows are broadcast
    rows = sample.mapInArrow(_lines, "features binary, sizes binary, label int").collect()  # 2 * SAMPLE_DOCS at most
    rows.sort()
    return fit([(np.frombuffer(r.features, np.uint8).reshape(-1, N_FEATURES), np.frombuffer(r.sizes, "<i4"), r.label) for r in rows])


def score(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, its content share and the verdict."""
    return narrow(docs, id_col, text_col).mapInArrow(_scored(field), SCHEMA)


def _passing(field: Field | None, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            m = Measured(texts)
            content = viterbi(m.features, m.line_first, field)
            share = _per_doc(m.line_bytes * content, m.line_first) / np.maximum(_per_doc(m.line_bytes, m.line_first), 1)
            failed = (m.n_words < 50) | (100 * m.n_repeat_words > 50 * m.n_words)
            return rows.filter(pa.array(~failed & (share >= MIN_CONTENT)))

        return tk.by_parts(batches, text_col, one)

    return run


def passing(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """The rows of documents that the rules keep, with all their columns."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_passing(field, text_col), docs.schema)
