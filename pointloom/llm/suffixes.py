"""Repeated strings of documents: column-wise construction of suffix order and common prefixes over many contexts.

A document is a string of symbols.  Bytes tell what is removed: strings of ``LENGTH`` bytes that start twice.  Words
tell which passages of ``PASSAGE`` words or more a document shares with another; these are reported beside it, as a
passage can be long in words and yet shorter than LENGTH bytes.  Both go through the same steps.

A string of ``length`` symbols that starts twice selects the same k-gram in both places: the one whose code is least,
the leftmost of equals.  So all windows of ``length`` symbols fall into contexts, each the run of windows that one
selected k-gram serves, and a window repeats only between contexts of the same k-gram, at the same distance to it.

1. One pass cuts every text into contexts, about one in length / 3 symbols, and deals k-gram code, context code and
   place out to buckets of k-grams, packed.  Within a task, equal contexts are one entry, as all windows of a context
   that occurs twice repeat; and a k-gram with more than ``LONG`` different contexts there sends one of them on, since
   it is known already that the others have to be compared.  So a passage of very many documents fills no bucket.
2. Contexts that share their k-gram with a different one are fetched, once each, as two strings: the windows that
   reach half a window or more to the left of the k-gram, and the others.  A repeated window lies in two strings
   that agree on that half, which is the grouping key; most chance neighbours part here.
3. The strings of many groups are a collection, aligned at the k-gram.  A task writes its columns to a sequential file
   and then adds one symbol per string in each round, from the last column to the first, as it reads them.  A round
   takes the order of the suffixes that start one column further right, appends the symbols in that order to the
   collection's Burrows-Wheeler transform, sorts the order stably by them within each group, and carries the array of
   common prefixes along by minima over the ranges between neighbours, which it appends, with the order, to files of
   their own.  As strings are aligned, only suffixes of one column can match, so what a round adds to the transform
   follows what is there and nothing is written again; rounds are bounded by the size of a context and not by the
   longest document, and a task holds a few numbers for each string.  At last order and common prefixes are read in
   sequence: suffixes whose neighbour shares ``length`` symbols start a repeated window.
4. Groups of more than ``HOT`` strings are not gathered in a task: their windows are counted by their 128-bit codes
   with map-side sums instead.

Codes of k-grams and contexts have 62 bits, of two polynomials modulo a prime.

Defined results: a null text is empty; texts shorter than ``length`` keep all bytes; repeats are judged on the
input, overlaps included, in one document or in several; rows that repeat are documents of their own and so repeat
each other; a passage counts as shared where a row with another id or another text has it; a null id is an id like
others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import forget, in_release, kept, mark, narrow, shared_dir

LENGTH = 400
#: Words of a shared passage, at least.
PASSAGE = 51
#: Contexts that a task holds before it packs them, entries of a bucket, about, and bytes of text for a context.
HELD, BUCKET, SPACING = 1 << 19, 1 << 18, 50
#: Different contexts of a k-gram within one task, above which it sends one on.
LONG = 16
#: Strings of a group, at most, that a task orders together.
HOT = 512
#: Strings ordered at once, at least, where there are so many.
TOGETHER = 4096
#: Bytes that are sent to all executors beside the texts, at most; with more, both sides are shuffled.
SENT = 64 << 20
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, n_passages long, n_passage_words long, shares_passage boolean"

_U = np.uint64
_A, _B = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Unit:
    """What the symbols are, how many of them make a window, and whether it has to be in another document."""

    number: int
    size: int
    length: int
    across: bool

    @property
    def gram(self) -> int:
        return max(4, 8 * self.length // 25)

    @property
    def half(self) -> int:
        return (self.length - self.gram) // 2

    def symbols(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if self.size == 1:
            return [np.frombuffer(t or b"", np.uint8) for t in texts]
        w = tk.Words(texts, tk.BLANK, lower=False)
        return [w.hash[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]


def units(length: int = LENGTH, passage: int = PASSAGE) -> tuple[Unit, Unit]:
    return Unit(0, 1, length, False), Unit(1, 8, passage, True)


def least_places(codes: np.ndarray, width: int) -> np.ndarray:
    """The place of the least code, the leftmost of equals, among width codes from each place on."""
    n = len(codes)
    key = (codes & ~_U(0xFFFFF)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    grid = np.full(blocks * width, _U(0xFFFFFFFFFFFFFFFF))
    grid[:n] = key
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & _U(0xFFFFF)).astype(np.int64)


def contexts(buf: np.ndarray, at: np.ndarray, size: np.ndarray, unit: Unit):
    """Contexts of the strings in buf (PIECE symbols at most): place in buf, windows, place of the k-gram, codes."""
    k, length = unit.gram, unit.length
    n = len(buf)
    rolling = tk.Rolling(buf)
    codes = rolling.code(np.arange(n - k + 1), np.arange(k, n + 1))
    place = least_places(codes, length - k + 1)
    step = np.zeros(len(place) + 1, np.int64)
    real = size >= length
    np.add.at(step, at[real], 1)
    np.add.at(step, at[real] + size[real] - length + 1, -1)
    inside = np.cumsum(step[:-1]) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    start = np.flatnonzero(new)
    ended = inside.copy()
    ended[:-1] &= ~inside[1:] | new[1:]
    windows = np.flatnonzero(ended) - start + 1
    off = place[start] - start
    stop = start + windows - 1 + length
    code = tk.mix(rolling.code(start, stop) + windows.astype(np.uint64) * _A + off.astype(np.uint64) * _B)
    return start, windows, off, codes[place[start]] ^ _U(unit.number), code


#: What is known of an entry: its k-gram has several contexts, its context repeats, its document has no id, its unit.
OPEN, MANY, NO_ID, UNIT = 1, 2, 4, 8
_ENTRY = (("gram", np.uint64), ("ctx", np.uint64), ("doc", np.int64), ("th", np.int64), ("at", np.int32), ("windows", np.int32), ("off", np.int32), ("flags", np.uint8))
Entries = dict[str, np.ndarray]


def _packed(rows: Entries) -> bytes:
    raw = b"".join([np.int64(len(rows["gram"])).tobytes(), *(rows[n].astype(t).tobytes() for n, t in _ENTRY)])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(block: bytes) -> Entries:
    raw = pa.decompress(block[8:], int(np.frombuffer(block[:8], np.int64)[0]), "zstd", asbytes=True)
    n, at, out = int(np.frombuffer(raw[:8], np.int64)[0]), 8, {}
    for name, t in _ENTRY:
        out[name] = np.frombuffer(raw, t, n, at)
        at += n * np.dtype(t).itemsize
    return out


def _taken(rows: Entries, at: np.ndarray) -> Entries:
    return {k: v[at] for k, v in rows.items()}


def _joined(parts: list[Entries]) -> Entries:
    return {n: np.concatenate([p[n] for p in parts]) for n, _ in _ENTRY}


def _resolved(rows: Entries, across: np.ndarray, last: bool) -> tuple[Entries, Entries, np.ndarray, Entries]:
    """(contexts that repeat whole, contexts to be compared, whether these stand for themselves alone, entries to go on).

    across: by unit, whether repeats have to be in several documents.  Unless it is the last time, only k-grams with
    very many contexts are settled."""
    doc = tk.mix(rows["doc"].view(np.uint64) ^ tk.mix(rows["th"].view(np.uint64) + (rows["flags"] & NO_ID).astype(np.uint64)))
    order = np.lexsort((doc, rows["ctx"], rows["gram"]))
    rows, doc = _taken(rows, order), doc[order]
    gram, ctx, flags = rows["gram"], rows["ctx"], rows["flags"]
    new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
    new = new_gram | np.concatenate(([True], ctx[1:] != ctx[:-1]))
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(gram)))
    end = start + count - 1
    several = np.where(across[(flags[start] & UNIT) // UNIT], doc[start] != doc[end], count > 1)
    many = several | (np.bitwise_or.reduceat(flags, start) & MANY > 0)
    whole = np.flatnonzero(np.repeat(many, count) & (flags & MANY == 0))  # those with the flag are out already
    of_gram = np.cumsum(new_gram)[start] - 1
    contexts_of = np.bincount(of_gram)
    known = np.zeros(len(contexts_of), bool)
    np.logical_or.at(known, of_gram, np.bitwise_or.reduceat(flags, start) & OPEN > 0)
    settled = (known | (contexts_of > 1)) if last else contexts_of > LONG
    # of a context that repeats one entry stands for all
    stands = np.ones(len(gram), bool)
    stands[np.repeat(many, count)] = False
    stands[start[many]] = True
    compared = np.flatnonzero(stands & np.repeat(settled[of_gram], count) & (flags & OPEN == 0))
    alone = ~np.repeat(many, count)[compared]
    if last:
        return _taken(rows, whole), _taken(rows, compared), alone, _taken(rows, np.zeros(0, np.int64))
    onward = stands & np.repeat(~settled[of_gram], count)
    first_of_gram = np.flatnonzero(new_gram)
    onward[first_of_gram[settled]] = True
    passed = _taken(rows, np.flatnonzero(onward))
    marks = np.repeat(np.where(many, MANY, 0), count) | np.repeat(np.where(settled[of_gram], OPEN, 0), count)
    passed["flags"] = passed["flags"] | marks[onward].astype(np.uint8)
    return _taken(rows, whole), _taken(rows, compared), alone, passed


_MET = "kind int, bucket int, block binary, doc_id long, th long, unit int, low long, high long, gram long, windows int, off int, single boolean"
BLOCK, SPAN, WANTED = range(3)
_TYPES = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())


def _rows(kind: int, size: int, **columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in _MET.split(", ")]
    columns["kind"] = np.full(size, kind, np.int32)
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns.get(n), pa.Array) else pa.nulls(size, t) if x is None else pa.array(x, t) for n, t in zip(names, _TYPES, strict=True)], names=names)


def _found(whole: Entries, compared: Entries, alone: np.ndarray, lengths: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of spans and of contexts that are wanted; their bucket only spreads them."""
    for kind, rows in ((SPAN, whole), (WANTED, compared)):
        n = len(rows["gram"])
        if not n:
            continue
        number = ((rows["flags"] & UNIT) // UNIT).astype(np.int32)
        low = rows["at"].astype(np.int64)
        common = {
            "bucket": (tk.mix(rows["doc"].view(np.uint64)) & _U(buckets - 1)).astype(np.int32), "doc_id": pa.array(rows["doc"], mask=rows["flags"] & NO_ID > 0), "th": rows["th"], "unit": number,
            "low": low, "high": low + rows["windows"] - 1 + lengths[number],
        }
        if kind == WANTED:
            common |= {"gram": rows["gram"].view(np.int64), "windows": rows["windows"], "off": rows["off"], "single": alone}
        yield _rows(kind, n, **common)


def _cut(kinds: tuple[Unit, ...], buckets: int):
    across, lengths = np.array([u.across for u in kinds]), np.array([u.length for u in kinds])

    def entries(unit: Unit, ids: np.ndarray, no_id: np.ndarray, th: np.ndarray, strings: list[np.ndarray]) -> Iterator[Entries]:
        length, most = unit.length, tk.PIECE
        piece = most - length
        held: list[tuple[int, int, np.ndarray]] = []

        def flush() -> Entries:
            size = np.array([len(t) for _, _, t in held], np.int64)
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            start, windows, off, grams, code = contexts(np.concatenate([t for _, _, t in held]), first, size, unit)
            of = np.searchsorted(first, start, "right") - 1
            doc = np.array([i for i, _, _ in held])[of]
            at = start - first[of] + np.array([a for _, a, _ in held], np.int64)[of]
            held.clear()
            return {"gram": grams, "ctx": code, "doc": ids[doc], "th": th[doc], "at": at.astype(np.int32), "windows": windows.astype(np.int32), "off": off.astype(np.int32), "flags": (NO_ID * no_id[doc] + UNIT * unit.number).astype(np.uint8)}

        total = 0
        for i, t in enumerate(strings):
            for a in range(0, len(t) - length + 1, piece):
                part = t[a : a + piece + length - 1]
                if held and total + len(part) > most:
                    yield flush()
                    total = 0
                held.append((i, a, part))
                total += len(part)
        if held:
            yield flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []

        def send() -> Iterator[pa.RecordBatch]:
            whole, compared, alone, passed = _resolved(_joined(held), across, False)
            held.clear()
            yield from _found(whole, compared, alone, lengths, buckets)
            bucket = (passed["gram"] & _U(buckets - 1)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, passed = bucket[order], _taken(passed, order)
            start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            cuts = list(zip(start.tolist(), np.append(start[1:], len(bucket)).tolist(), strict=True))
            for at in range(0, len(cuts), 16):
                yield _rows(BLOCK, len(cuts[at : at + 16]), bucket=bucket[[a for a, _ in cuts[at : at + 16]]].astype(np.int32), block=[_packed({k: v[a:b] for k, v in passed.items()}) for a, b in cuts[at : at + 16]])

        def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            ids, th = rows.column(0), rows.column(2)
            no_id = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for unit in kinds:
                held.extend(entries(unit, ids, no_id, th.to_numpy(zero_copy_only=False), unit.symbols(texts)))
            return rows

        for _ in tk.by_parts(batches, "text", one, tk.PIECE):
            if sum(len(h["gram"]) for h in held) >= HELD:
                yield from send()
        if held:
            yield from send()
        tk.give_back()

    return run


def _met(kinds: tuple[Unit, ...], buckets: int):
    """Settles the k-grams of each bucket; rows that are settled already go through."""
    across, lengths = np.array([u.across for u in kinds]), np.array([u.length for u in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        now, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            whole, compared, alone, _ = _resolved(_joined(list(map(_unpacked, held))), across, True)
            held.clear()
            yield from _found(whole, compared, alone, lengths, buckets)

        for b in batches:
            is_block = pc.equal(b.column("kind"), BLOCK)
            blocks, rest = b.filter(is_block), b.filter(pc.invert(is_block))
            if rest.num_rows:
                yield rest
            for bucket, block in zip(blocks.column("bucket").to_pylist(), blocks.column("block").to_pylist(), strict=True):
                if bucket != now and held:
                    yield from settle()
                now = bucket
                held.append(block)
        if held:
            yield from settle()
        tk.give_back()

    return run


_STRINGS = "key long, unit int, doc_id long, th long, at long, lead int, single boolean, symbols binary"


def _fetched(kinds: tuple[Unit, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, th, text, wanted in zip(*(b.column(c).to_pylist() for c in ("doc_id", "th", "text", "wanted")), strict=True):
                symbols = {u: kinds[u].symbols([text.encode()])[0] for u in {w["unit"] for w in wanted}}
                rows = []
                for w in wanted:
                    unit = kinds[w["unit"]]
                    length, k, half = unit.length, unit.gram, unit.half
                    own = symbols[unit.number][w["at"] : w["at"] + w["windows"] - 1 + length]
                    off = w["off"]
                    tag = w["gram"].to_bytes(8, "little", signed=True)
                    # windows that start half or more before the k-gram, then the others
                    for side, low, high, core in ((b"L", 0, min(off - half, w["windows"] - 1), own[max(0, off - half) : off]), (b"R", max(0, off - half + 1), w["windows"] - 1, own[off + k : off + k + half])):
                        if low <= high:
                            key = int.from_bytes(hashlib.blake2b(tag + side + core.tobytes(), digest_size=8).digest(), "little", signed=True)
                            rows.append((key, unit.number, doc, th, w["at"] + low, off - low, w["single"], own[low : high + length].tobytes()))
                for lo in range(0, len(rows), 2048):
                    kinds_of = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 2048], strict=True), kinds_of, strict=True)], names=[c.split()[0] for c in _STRINGS.split(", ")])
        tk.give_back()

    return run


class Files:
    """Sequential files of one construction, in the folder that executors share; they go when it is done."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.files, path = fs.FileSystem.from_uri(folder)
        self.path = f"{path}/{uuid.uuid4().hex}"
        self.files.create_dir(self.path, recursive=True)

    def write(self, name: str):
        return self.files.open_output_stream(f"{self.path}/{name}", compression=None)

    def read(self, name: str):
        return self.files.open_input_stream(f"{self.path}/{name}", compression=None)

    def __enter__(self) -> Files:
        return self

    def __exit__(self, *_) -> None:
        self.files.delete_dir(self.path)


#: Columns that are put together at a time.
COLUMNS = 64


def _write_columns(strings: list[np.ndarray], first: np.ndarray, end: np.ndarray, width: int, out) -> None:
    """All symbols of a column, then those of the column before it; absent ones are zero."""
    dtype = strings[0].dtype
    for high in range(width, 0, -COLUMNS):
        low = max(0, high - COLUMNS)
        grid = np.zeros((len(strings), high - low), dtype)
        for i in np.flatnonzero((first < high) & (end > low)).tolist():
            a, b = max(first[i], low), min(end[i], high)
            grid[i, a - low : b - low] = strings[i][a - first[i] : b - first[i]]
        out.write(np.ascontiguousarray(grid.T[::-1]).tobytes())


def _add_columns(columns, bwt, order_out, common_out, dtype: np.dtype, first: np.ndarray, end: np.ndarray, group: np.ndarray, width: int) -> None:
    """Rounds: one symbol of every string is read, put into the transform, and order and common prefixes are appended."""
    m = len(first)
    order = np.arange(m)
    common = np.zeros(m + 1, np.int32)  # with the suffix before it in the order; one more for ranges that end last
    base = group.astype(np.int64) * (max(m, 256) + 1)
    for x in range(width - 1, -1, -1):
        column = np.frombuffer(columns.read(m * dtype.itemsize), dtype)
        bwt.write(column[order].tobytes())
        symbol = column.astype(np.int64) if dtype.itemsize == 1 else np.unique(column, return_inverse=True)[1].astype(np.int64)
        symbol = symbol[order]
        absent = (x < first[order]) | (x >= end[order])
        symbol[absent] = max(m, 256)
        key = base[order] + symbol
        if (key[1:] >= key[:-1]).all():
            same = key[1:] == key[:-1]
            least = common[1:m]
            given = absent
        else:
            move = np.argsort(key, kind="stable")
            ranked = key[move]
            same = ranked[1:] == ranked[:-1]
            before, here = move[:-1], move[1:]
            least = common[here]
            far = np.flatnonzero(same & (here != before + 1))
            if len(far):
                span = np.stack([before[far] + 1, here[far] + 1], 1).reshape(-1)
                least[far] = np.minimum.reduceat(common, span)[::2]
            order = order[move]
            given = absent[move]
        common = np.zeros(m + 1, np.int32)
        common[1:m] = np.where(same & ~given[1:], least + 1, 0)
        order_out.write(order.astype(np.int32).tobytes())
        common_out.write(common[:m].tobytes())


def _read_marks(order_in, common_in, m: int, width: int, length: int, doc: np.ndarray | None) -> list[tuple[np.ndarray, int]]:
    """(strings whose suffix at the column starts a repeated window, column); doc: where given, the window has to be in
    several documents, and -1 stands for several."""
    out = []
    for x in range(width - 1, -1, -1):
        order = np.frombuffer(order_in.read(4 * m), np.int32)
        long = np.concatenate((np.frombuffer(common_in.read(4 * m), np.int32) >= length, [False]))
        if not long.any():
            continue
        marked = long[:m] | long[1:]
        if doc is not None:
            start = np.flatnonzero(~long[:m])  # runs of suffixes with the same window
            of = doc[order]
            several = (np.minimum.reduceat(of, start) != np.maximum.reduceat(of, start)) | (np.minimum.reduceat(of, start) < 0)
            marked &= np.repeat(several, np.diff(np.append(start, m)))
        if marked.any():
            out.append((order[marked], x))
    return out


def repeated(strings: list[np.ndarray], lead: list[int], group: np.ndarray, length: int, folder: str, doc: np.ndarray | None = None) -> list[np.ndarray]:
    """For each string, the places from which a window is in another string of its group, at the same distance to the
    k-gram.  Strings are sorted by group."""
    m, size = len(strings), np.array([len(s) for s in strings], np.int64)
    first = max(lead) - np.array(lead, np.int64)
    end = first + size
    width = int(end.max())
    with Files(folder) as files:
        with files.write("columns") as out:
            _write_columns(strings, first, end, width, out)
        with files.read("columns") as columns, files.write("bwt") as bwt, files.write("order") as order, files.write("common") as common:
            _add_columns(columns, bwt, order, common, strings[0].dtype, first, end, group, width)
        with files.read("order") as order, files.read("common") as common:
            marks = _read_marks(order, common, m, width, length, doc)
    if not marks:
        return [np.zeros(0, np.int64)] * m
    of = np.concatenate([i for i, _ in marks])
    at = np.concatenate([np.full(len(i), x) for i, x in marks]) - first[of]
    by = np.lexsort((at, of))
    return np.split(at[by], np.searchsorted(of[by], np.arange(1, m)))


_SPANS = "doc_id long, th long, unit int, low long, high long"


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Runs of places that follow each other: first, last."""
    cut = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist(), strict=True)) if len(places) else []


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=[c.split()[0] for c in _SPANS.split(", ")])


class _Collection:
    """Strings of one unit, group by group, until there are enough to be ordered together."""

    def __init__(self, unit: Unit, folder: str):
        self.unit, self.folder, self.rows, self.groups, self.number = unit, folder, [], [], 0

    def add(self, own: list[tuple]) -> None:
        if len(own) > 1 and any(r[4] for r in own):
            self.rows += own
            self.groups += [self.number] * len(own)
            self.number += 1

    def order(self) -> list[tuple]:
        if not self.rows:
            return []
        dtype = np.uint8 if self.unit.size == 1 else np.uint64
        doc = np.array([hash((r[0], r[1])) & 0x7FFFFFFFFFFFFFFF if r[4] else -1 for r in self.rows], np.int64) if self.unit.across else None
        found = repeated([np.frombuffer(r[5], dtype) for r in self.rows], [r[3] for r in self.rows], np.array(self.groups), self.unit.length, self.folder, doc)
        out = [(i, th, self.unit.number, at + a, at + b + self.unit.length) for (i, th, at, _, single, _), places in zip(self.rows, found, strict=True) if single for a, b in _runs(places)]
        self.rows, self.groups, self.number = [], [], 0
        return out


def _ordered(kinds: tuple[Unit, ...], folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Collection(u, folder) for u in kinds]
        now, unit, own = None, 0, []
        for b in batches:
            for key, number, *row in zip(*(b.column(c).to_pylist() for c in ("key", "unit", "doc_id", "th", "at", "lead", "single", "symbols")), strict=True):
                if key != now:
                    held[unit].add(own)
                    if len(held[unit].rows) >= TOGETHER and (out := held[unit].order()):
                        yield _span_batch(out)
                    now, unit, own = key, number, []
                if not own or own[-1][:3] != tuple(row[:3]):
                    own.append(tuple(row))
        held[unit].add(own)
        for collection in held:
            if out := collection.order():
                yield _span_batch(out)
        tk.give_back()

    return run


_WINDOWS = "d1 long, d2 long, doc_id long, th long, unit int, at long, single boolean"


def _windows(kinds: tuple[Unit, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, doc, th, at, single, own in zip(*(b.column(c).to_pylist() for c in ("unit", "doc_id", "th", "at", "single", "symbols")), strict=True):
                size, length = kinds[number].size, kinds[number].length
                k = len(own) // size - length + 1
                code = b"".join([hashlib.blake2b(own[size * i : size * (i + length)], digest_size=16).digest() for i in range(k)])
                d = np.frombuffer(code, np.int64).reshape(-1, 2)
                fill = lambda v, t: pa.array([v] * k, t)
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), fill(doc, pa.int64()), fill(th, pa.int64()), fill(number, pa.int32()), pa.array(np.arange(at, at + k)), fill(single, pa.bool_())], names=[c.split()[0] for c in _WINDOWS.split(", ")])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with th: 0 where ids tell them apart, else the code of the text, for ids that have several."""
    apart = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return docs.select("doc_id", "text", (F.lit(0).cast("long") if apart else F.xxhash64("text")).alias("th"))


def _beside(docs: DataFrame, rows: DataFrame, items: str, how: str) -> DataFrame:
    """docs with the row of their id and text code, and of the others, where how is left, without.

    The rows are sent to all executors if that is few bytes; else, if at least the ids are, only the documents that have
    a row are shuffled to meet it; else both sides are.  items: the array that makes a row long."""
    count = rows.agg(F.count("*").alias("n"), F.sum(F.size(items)).alias("items")).first()
    rows = rows.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    on = lambda r: docs.doc_id.eqNullSafe(r["_id"]) & (docs.th == r["_th"])
    if count.n * 64 + (count["items"] or 0) * 48 <= SENT:
        rows = F.broadcast(rows)
    elif count.n * 40 <= SENT:
        ids = F.broadcast(rows.select("_id", "_th"))
        near = docs.join(ids, on(ids), "left_semi")
        out = near.join(rows, near.doc_id.eqNullSafe(rows["_id"]) & (near.th == rows["_th"]), "inner").drop("_id", "_th")
        return out if how == "inner" else out.unionByName(docs.join(ids, on(ids), "left_anti"), allowMissingColumns=True)
    return docs.join(rows, on(rows), how).drop("_id", "_th")


def _buckets(size: int) -> int:
    return 1 << max(4, min(30, (2 * size // SPACING // BUCKET).bit_length()))


def _merged_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [[{"unit": u, "low": low, "high": high} for u in (0, 1) for low, high in merged([(x["low"], x["high"]) for x in own if x["unit"] == u])] for own in b.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(out, pa.list_(pa.struct([("unit", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])))], names=["doc_id", "th", "spans"])


def spans(docs: DataFrame, kinds: tuple[Unit, ...]) -> DataFrame:
    """(doc_id, th, spans): ranges of symbols of each unit that repeat, apart from each other.  Documents, which _keyed
    gave, have no row without any."""
    docs = docs.where(F.octet_length("text") >= min(u.length if u.size == 1 else 2 * u.length - 1 for u in kinds))
    spark, since = docs.sparkSession, mark()
    folder = in_release(spark, f"{shared_dir(spark)}/pointloom-columns-{uuid.uuid4().hex}")
    buckets = _buckets(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    cut = docs.select("doc_id", "text", "th").mapInArrow(_cut(kinds, buckets), _MET)
    met = kept(cut.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met(kinds, buckets), _MET).drop("bucket", "block"), "met")
    length = F.element_at(F.array(*(F.lit(u.length) for u in kinds)), F.col("unit") + 1)
    whole = met.where(F.col("kind") == SPAN).select("doc_id", "th", "unit", "low", "high")
    one = F.struct("gram", "unit", F.col("low").alias("at"), "windows", "off", "single")
    wanted = kept(met.where(F.col("kind") == WANTED).groupBy("doc_id", "th").agg(F.collect_list(one).alias("wanted")), "wanted")  # a row for each document
    # rows of documents that repeat fetch the same strings, which are taken once below
    texts = _beside(docs, wanted, "wanted", "inner").select("doc_id", "th", "text", "wanted")
    strings = kept(texts.mapInArrow(_fetched(kinds), _STRINGS), "strings")
    hot = kept(strings.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("key"), "hot")
    cold = strings.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "doc_id", "th", "at")
    found = whole.unionByName(cold.mapInArrow(_ordered(kinds, folder), _SPANS))
    if not hot.isEmpty():
        code = F.xxhash64("doc_id", "th")
        across = [u.number for u in kinds if u.across]
        windows = kept(strings.join(hot, "key", "left_semi").dropDuplicates(["key", "doc_id", "th", "at"]).mapInArrow(_windows(kinds), _WINDOWS), "windows")
        counted = windows.groupBy("d1", "d2", "unit").agg(F.count("*").alias("n"), F.min(code).alias("from"), F.max(code).alias("to"), F.bool_and("single").alias("single"))
        repeats = F.when(F.col("unit").isin(across), F.col("from") != F.col("to")).otherwise(F.col("n") > 1) | ~F.col("single")
        found = found.unionByName(windows.where("single").join(counted.where(repeats).select("d1", "d2"), ["d1", "d2"], "left_semi").select("doc_id", "th", "unit", F.col("at").alias("low"), (F.col("at") + length).alias("high")))
    lists = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("unit", "low", "high")).alias("spans"))  # a row for each document
    out = kept(lists.mapInArrow(_merged_spans, "doc_id long, th long, spans array<struct<unit: int, low: long, high: long>>"), "spans")
    forget(spark, since, out)
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(8)]
        for t, spans_of in zip(texts, rows.column(2).to_pylist(), strict=True):
            left, count, removed, at = hashlib.sha256(), 0, 0, 0
            raw = t or b""
            for a, b in merged([(x["low"], x["high"]) for x in spans_of or () if x["unit"] == 0]):
                left.update(raw[at:a])
                count, removed, at = count + 1, removed + b - a, b
            left.update(raw[at:])
            passages = merged([(x["low"], x["high"]) for x in spans_of or () if x["unit"] == 1])
            for column, v in zip(out, (len(raw), removed, count, left.hexdigest(), len(raw) - removed, len(passages), sum(b - a for a, b in passages), bool(passages)), strict=True):
                column.append(v)
        kinds = (*(pa.int64(),) * 3, pa.string(), *(pa.int64(),) * 3, pa.bool_())
        return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return tk.by_parts(batches, "text", one)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the ranges; ranges that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: bytes, bytes and maximal runs removed, the digest of what is left and its bytes; the runs
    of words that it shares with another document, and whether there is any."""
    texts = _keyed(narrow(docs, id_col, text_col))
    by_doc = spans(texts, units(length, passage))
    return _beside(texts, by_doc, "spans", "left").select("doc_id", "text", "spans").mapInArrow(_removed, SCHEMA)
