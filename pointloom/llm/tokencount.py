"""Token counts that follow edits: a segment tree of pre-tokens per document.

The leaves of a document's tree are short runs of pre-tokens, each with its text, and the sizes and token
counts of its pre-tokens; inner nodes hold sums of characters and tokens.  Leaves are filled to ``LEAF`` pre-tokens and
hold up to twice as many, and may run empty, so an edit leaves the number of leaves as it is until one is full; only
then the sums are built anew, from what the leaves have.  An edit walks down by characters, re-encodes
from the last pre-token boundary that lies at least the boundary context before the edit, and stops at the first
boundary behind the edit that the old text had too; all beyond keeps its counts.  Sums on the paths above the
changed leaves are then brought up to date.

Pre-tokens depend on the text from a boundary on alone, look at most a few characters past their end, and strings
of added tokens have a known greatest length; these two give the boundary context.

The tree lives with the task that handles the document, and documents are one narrow pass.

Defined results: a null text is an empty one; edits beyond the end are clipped to it; edits of no effect are
allowed; repeated rows are each counted; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .bpe import Model, model_of, sent
from .common import narrow

LEAF = 48
SCHEMA = "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_chars_edited long, n_tokens_edited long, n_reencoded long"

Edit = tuple[int, int, str]


class Leaf:
    __slots__ = ("counts", "sizes", "text")

    def __init__(self, text: str, sizes: list[int], counts: list[int]):
        self.text, self.sizes, self.counts = text, sizes, counts

    @property
    def ends(self) -> list[int]:
        return list(accumulate(self.sizes))


class TokenTree:
    """The tree of one text.  n_tokens and n_chars are the sums at the root."""

    def __init__(self, model: Model, text: str):
        self.model = model
        self.context = max([8, *(len(s) + 4 for s in model.added)])
        self.reencoded = self.rebuilt = 0
        self.leaves = self._leaves(text, *self._counted(text))
        self._build()

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pretokens(self) -> int:
        return sum(len(x.sizes) for x in self.leaves)

    def text(self) -> str:
        return "".join(x.text for x in self.leaves)

    def _counted(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of each pre-token."""
        model, at, sizes, counts = self.model, 0, [], []
        known, ids = model.known, model.ids
        for special in [*(model.split.finditer(text) if model.split else ()), None]:
            pieces = model.cut(text, at, special.start() if special else len(text))
            sizes += map(len, pieces)
            counts += [len(known.get(p) or ids(p)) >> 2 for p in pieces]
            if special:
                sizes.append(len(special[0]))
                counts.append(1)
                at = special.end()
        return sizes, counts

    @staticmethod
    def _leaves(text: str, sizes: list[int], counts: list[int], into: int | None = None) -> list[Leaf]:
        """Leaves of LEAF pre-tokens, or so many leaves, filled alike."""
        cuts = [len(sizes) * k // into for k in range(into + 1)] if into else [*range(0, len(sizes), LEAF), len(sizes)]
        out, at = [], 0
        for i, j in pairwise(cuts):
            own = sizes[i:j]
            end = at + sum(own)
            out.append(Leaf(text[at:end], own, counts[i:j]))
            at = end
        return out

    def _build(self) -> None:
        self.base = 1
        while self.base < max(1, len(self.leaves)):
            self.base *= 2
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, x in enumerate(self.leaves):
            self.chars[self.base + i], self.tokens[self.base + i] = len(x.text), sum(x.counts)
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at this place, and where the leaf starts; the last leaf at the end."""
        if at >= self.n_chars:
            last = max(0, len(self.leaves) - 1)
            return last, self.n_chars - (len(self.leaves[last].text) if self.leaves else 0)
        i, start = 1, 0
        while i < self.base:
            i *= 2
            if at >= start + self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.base, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts new in the place of the characters from start to end."""
        start = min(max(0, start), self.n_chars)
        end = min(max(start, end), self.n_chars)
        if not self.leaves:
            self.leaves = self._leaves(new, *self._counted(new))
            self.reencoded += self.n_pretokens
            self._build()
            return
        first, first_at = self._find(max(0, start - self.context))
        head = self.leaves[first]
        keep = bisect_right(head.ends, max(0, start - self.context) - first_at)  # pre-tokens before the context
        back = first_at + sum(head.sizes[:keep])
        last, last_at = self._find(max(end, start))
        stop = last_at + len(self.leaves[last].text)
        while True:
            old = "".join(x.text for x in self.leaves[first : last + 1])[back - first_at :]
            text = old[: start - back] + new + old[end - back :]
            whole = last + 1 == len(self.leaves)
            boundaries = self._boundaries(first, last, back - first_at)
            got = self._resynced(text, start - back + len(new), len(new) - (end - start), boundaries, whole)
            if got is not None:
                break
            for _ in range(1 + last - first):
                if last + 1 < len(self.leaves):
                    last += 1
                    stop += len(self.leaves[last].text)
        ends, counts, synced = got
        self.reencoded += len(ends)
        tail_ends, tail_counts = [], []
        if synced is not None:  # what the last leaves hold behind the common boundary
            moved = len(new) - (end - start)
            flat_counts = [c for x in self.leaves[first : last + 1] for c in x.counts][keep:]
            k = bisect_right(boundaries, synced - moved)
            tail_ends = [b + moved for b in boundaries[k:]]
            tail_counts = flat_counts[k:]
        sizes = head.sizes[:keep] + [b - a for a, b in pairwise([0, *ends, *tail_ends])]
        room = last + 1 - first
        fits = len(sizes) <= 2 * LEAF * room
        fresh = self._leaves(head.text[: back - first_at] + text, sizes, [*head.counts[:keep], *counts, *tail_counts], room if fits else None)
        self.leaves[first : last + 1] = fresh
        if not fits:
            self.rebuilt += 1
            self._build()
            return
        touched = set()
        for i, x in enumerate(fresh, self.base + first):
            self.chars[i], self.tokens[i] = len(x.text), sum(x.counts)
            touched.add(i // 2)
        while touched and max(touched) >= 1:
            for i in touched:
                self._sum(i)
            touched = {i // 2 for i in touched if i > 1}

    def _boundaries(self, first: int, last: int, skip: int) -> list[int]:
        """Old boundaries after the first skip characters of these leaves, counted from there."""
        out, at = [], -skip
        for x in self.leaves[first : last + 1]:
            out += [at + e for e in x.ends if at + e > 0]
            at += len(x.text)
        return out

    def _resynced(self, text: str, edited: int, moved: int, boundaries: list[int], whole: bool):
        """Ends and counts of pre-tokens up to a boundary behind the edit that both texts have; None: not in this text."""
        ends, counts = [], []
        model = self.model
        for a, b, added in model.pre_tokens(text):
            if not whole and b > len(text) - self.context:
                return None
            ends.append(b)
            counts.append(1 if added >= 0 else len(model.ids(text[a:b])) // 4)
            if b >= edited:
                i = bisect_left(boundaries, b - moved)
                if i < len(boundaries) and boundaries[i] == b - moved:
                    return ends, counts, b
        return (ends, counts, None) if whole else None


def sample_edits(text: str) -> list[Edit]:
    """Three edits by place alone, each on the text that the one before left: an insertion, a deletion, a change."""
    n = len(text)
    return [(n // 3, n // 3, " edited"), (n // 2, n // 2 + 11, ""), (2 * n // 3, 2 * n // 3 + 5, "Re-written")] if n else []


def _recounted(key: str, source, edits_of: Callable[[str], Iterable[Edit]]):
    def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        model = model_of(key, source)
        out: list[list[int]] = [[] for _ in range(6)]
        for t in texts:
            text = (t or b"").decode()
            tree = TokenTree(model, text)
            before = tree.n_pretokens, tree.n_tokens
            edits = list(edits_of(text))
            for e in edits:
                tree.edit(*e)
            for column, v in zip(out, (*before, len(edits), tree.n_chars, tree.n_tokens, tree.reencoded), strict=True):
                column.append(v)
        return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", "n_pretokens", "n_tokens", "n_edits", "n_chars_edited", "n_tokens_edited", "n_reencoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tk.by_parts(batches, "text", one)

    return run


def recount(docs: DataFrame, path: str, edits_of: Callable[[str], Iterable[Edit]] = sample_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: tokens of the text, and of the text after its edits, with the pre-tokens read again."""
    return narrow(docs, id_col, text_col).mapInArrow(_recounted(*sent(docs, path), edits_of), SCHEMA)
