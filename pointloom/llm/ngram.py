"""N-gram Jaccard join: a grouped prefix join, whose result is the connected components of similar documents.

A document's set holds the codes of its distinct 5-word shingles.  All sets are ordered alike: shingles that the
corpus holds often come last, the others by their code.  Two sets with a Jaccard similarity of t or more share a
shingle among their first n - ceil(t * n) + 1, their prefixes.

1. One pass counts shingles in a table of counters of bounded size; only how far a counter lies above the mean
   matters to the order, so chance collisions cost time at most.
2. One pass makes each document's set.  Documents of equal prefix and size collapse into a group within the task,
   and the group's prefix goes, packed, to the task of its shingle.  There the groups that share a shingle form a
   list; pairs with sizes too far apart are filtered out.  In lists that are long within one task already only
   their first group is passed on, so a shingle of very many documents fills no task.  A group of several different
   sets is a list of its own, and every list that it is in is written whole.
3. Group pairs are expanded to members, filtered by what their prefixes allow, and verified with whole sets, so
   that a group of m near copies takes about m verifications, not m * m.  First each document is verified against
   one pivot of each list.  Then lists whose documents are all in one component are done, as no further link can
   change the result.  In the others, shingles that a document of these lists has alone bound what it can share.
   Where very many pairs across components are left in a list, every document of it is measured against the one that
   has the fewest shingles alone: two documents share at most the lesser of what both share with it, and the lesser of
   what both share with others beyond it, which takes out the rim of a large group.  All pairs that these bounds
   leave, of sizes close enough, are verified.

Exact copies are one class throughout: equal sets have equal 128-bit digests, and links between classes are links
between all their documents.

Defined results: null, empty and blank texts have an empty set, no link, and their own id as component; texts of one
to four words are one shingle; ids that repeat with different texts are linked through the id; rows that repeat give
repeated rows; a null id has a null component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import forget, kept, mark, narrow, without
from .graph import components

N = 5
#: Similarity of a link: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Counters of shingles, as powers of two: at least, at most (one byte each to every executor).
COUNTERS = (16, 24)
SLICE = 1 << 15
#: A list longer than this within one task is taken apart there.
LONG = 32
#: Prefix entries in a bucket, about; there are as many buckets as that needs.
BUCKET = 1 << 18
#: Entries that a task holds before it packs them.
HELD = 1 << 20
#: Documents verified against a pivot in one group.
CHUNK = 64
#: Pairs across components, for each entry of a list, that are taken without measuring the list against a pivot.
FEW = 1
#: Lists before a document's entry that its pairs are looked for in.
SEEN = 16
#: Requests for sets that are sent to all executors, at most (40 bytes each); with more, both sides are shuffled.
SENT = 400_000

_U = np.uint64


def sets_of(texts: list[bytes | None], n: int = N) -> list[np.ndarray]:
    """The sorted distinct codes of each text's shingles."""
    w = tk.Words(texts, tk.BLANK)
    codes = w.runs(n)
    out = []
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b - a >= n:
            out.append(np.unique(codes[a : b - n + 1]))
        elif b > a:
            whole = tk.mix(np.array([(w.hash[a:b] * tk._PLACE_CODE[: b - a]).sum() + _U(b - a)], np.uint64))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


class Order:
    """Rank of codes: the level of their counter, then the code."""

    def __init__(self, levels: np.ndarray):
        self.levels = levels  # uint8, one for each counter

    def first(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, int, int]:
        """The first k codes, and the level and code of the last of them; codes are sorted."""
        level = self.levels[(codes & _U(len(self.levels) - 1)).astype(np.int64)]
        at = np.argsort(level, kind="stable")[:k]
        return codes[at], int(level[at[-1]]), int(codes[at[-1]])


def _counts(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int32)

        def one(_: pa.RecordBatch, texts: list[bytes | None]) -> None:
            np.add.at(total, (np.concatenate(sets_of(texts)) & _U(counters - 1)).astype(np.int64), 1)

        for _ in tk.by_parts(batches, "text", one):
            pass
        for at in range(0, counters, SLICE):
            yield _slice(at, total[at : at + SLICE])

    return run


_SLICES = "at int, n long, counts binary"


def _slice(at: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "n": pa.array([int(counts.sum())], pa.int64()), "counts": pa.array([pa.compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)], pa.binary())})


def _unsliced(counts: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(counts, 8 * SLICE, "zstd", asbytes=True), np.uint8).reshape(8, SLICE).T).view("<i8").reshape(-1)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, total = None, np.zeros(0, np.int64)
    for b in batches:
        for at, counts in zip(b.column("at").to_pylist(), b.column("counts").to_pylist(), strict=True):
            if at != now:
                if now is not None:
                    yield _slice(now, total)
                now, total = at, np.zeros(SLICE, np.int64)
            total += _unsliced(counts)
    if now is not None:
        yield _slice(now, total)


def order_of(docs: DataFrame) -> tuple[Order, int]:
    """The order, and the number of shingles of all sets.

    The counters, at most 2 ** COUNTERS[1], follow the number of words as far as bytes tell it; they are added slice
    by slice on the executors, and the driver gets a byte for each.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = 1 << min(COUNTERS[1], max(COUNTERS[0], (size // 64).bit_length()))
    slices = docs.select("text").mapInArrow(_counts(counters), _SLICES)
    summed = kept(slices.repartition("at").sortWithinPartitions("at").mapInArrow(_summed, _SLICES), "counts")
    shingles = summed.agg(F.sum("n")).first()[0] or 0
    mean = max(1.0, shingles / counters)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above = [np.log2(np.maximum(_unsliced(c) / mean, 1)) for c in b.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("at"), pa.array([np.where(x >= 0.7, np.minimum(2 * x, 255), 0).astype(np.uint8).tobytes() for x in above], pa.binary())], names=["at", "levels"])

    out = np.zeros(counters, np.uint8)
    for r in summed.mapInArrow(levels, "at int, levels binary").collect():
        out[r.at : r.at + SLICE] = np.frombuffer(r.levels, np.uint8)
    return Order(out), int(shingles)


ROWS = "kind int, a long, b long, n int, d1 long, d2 long, bucket int, block binary"
DOC, EDGE, LIST, BLOCK, MEMBER = range(5)
#: What is known of an entry: its list was taken apart in a task; its group has members beside the leader.
OPEN, LED = 1, 2
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
_NAMES = ("kind", "a", "b", "n", "d1", "d2", "bucket", "block")


def _rows(kind: int, size: int, **columns) -> pa.RecordBatch:
    made = {k: pa.array(v, t) for k, t in zip(_NAMES, _TYPES, strict=True) if (v := columns.get(k)) is not None}
    made["kind"] = pa.array(np.full(size, kind, np.int32))
    return pa.RecordBatch.from_arrays([made.get(k, pa.nulls(size, t)) for k, t in zip(_NAMES, _TYPES, strict=True)], names=list(_NAMES))


def _packed(shingle: np.ndarray, doc: np.ndarray, n: np.ndarray, flags: np.ndarray) -> bytes:
    """Columns of a bucket's entries, in the order of documents, with documents as differences."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    raw = b"".join([np.int64(len(doc)).tobytes(), shingle[order].tobytes(), np.diff(doc, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), n[order].astype(np.int32).tobytes(), flags[order].astype(np.uint8).tobytes()])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(block[8:], int(np.frombuffer(block[:8], np.int64)[0]), "zstd", asbytes=True)
    k = int(np.frombuffer(raw[:8], np.int64)[0])
    part = lambda at, size: raw[8 + at * k : 8 + (at + size) * k]
    doc = np.cumsum(np.ascontiguousarray(np.frombuffer(part(4, 8), np.uint8).reshape(8, k).T).view(np.int64).reshape(-1))
    return np.frombuffer(part(0, 4), np.uint32), doc, np.frombuffer(part(12, 4), np.int32), np.frombuffer(part(16, 1), np.uint8)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of runs of equal keys."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(key)))


def _stars(key: np.ndarray, doc: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Edges of each list to its pivots.  Rows are sorted by key; a pivot serves sizes up to the greatest that fits."""
    rank = tk.mix(doc.view(np.uint64))
    size = np.floor(np.log(np.maximum(n, 1)) / -np.log(percent / 100)).astype(np.int64)  # sizes in one class fit
    order = np.lexsort((rank, size, key))
    k, s, d = key[order], size[order], doc[order]
    new_list = np.concatenate(([True], k[1:] != k[:-1]))
    new = new_list | np.concatenate(([True], s[1:] != s[:-1]))
    pivot = d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
    edges = [np.stack([d[~new], pivot[~new]], 1)]
    start = np.flatnonzero(new)
    near = ~new_list[start[1:]] & (s[start[1:]] == s[start[:-1]] + 1) if len(start) > 1 else np.zeros(0, bool)
    if near.any():  # pivots of neighbouring classes
        edges.append(np.stack([d[start[1:][near]], d[start[:-1][near]]], 1))
    out = np.concatenate(edges)
    return np.unique(out[out[:, 0] != out[:, 1]], axis=0)


class _Sender:
    """Groups documents of equal prefix and size, and deals the groups' prefixes out to buckets."""

    def __init__(self, order: Order, buckets: int, percent: int):
        self.order, self.buckets, self.percent = order, buckets, percent
        self.groups: dict[tuple, tuple[int, int, int, int]] = {}
        self.held, self.led, self.size = [], set(), 0

    def take(self, ids: list[int | None], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        import hashlib

        rows, members = [], []
        for i, codes in zip(ids, sets, strict=True):
            n = len(codes)
            d1, d2 = np.frombuffer(hashlib.blake2b(codes.tobytes(), digest_size=16).digest(), np.int64).tolist() if n else (None, None)
            rows.append((i, n, d1, d2))
            if not n or i is None:
                continue
            prefix, _, _ = self.order.first(codes, prefix_size(n, self.percent))
            key = n, hashlib.blake2b(prefix.tobytes(), digest_size=16).digest()
            leader = self.groups.get(key)
            if leader is None:
                self.groups[key] = (i, d1, d2, len(self.held))
                self.held.append((i, n, tk.mix(prefix)))
                self.size += len(prefix)
            elif leader[1:3] != (d1, d2):
                members.append((leader[0], i))
                self.led.add(leader[3])
        yield _rows(DOC, len(rows), **dict(zip(("a", "n", "d1", "d2"), zip(*rows), strict=True)))
        if members:
            yield _rows(MEMBER, len(members), **dict(zip("ab", zip(*members), strict=True)))
        if self.size >= HELD:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        size = np.array([len(p) for _, _, p in self.held])
        doc = np.repeat(np.array([i for i, _, _ in self.held], np.int64), size)
        n = np.repeat(np.array([k for _, k, _ in self.held], np.int32), size)
        code = np.concatenate([p for _, _, p in self.held])
        led = np.zeros(len(self.held), bool)
        led[list(self.led)] = True
        if led.any():  # members can be similar to each other and not to the leader
            leader, sizes = (np.array(x, t)[led] for x, t in zip(list(zip(*self.held, strict=True))[:2], (np.int64, np.int32), strict=True))
            yield _rows(LIST, len(leader), a=_content_id(tk.mix(leader.view(np.uint64)), 1), b=leader, n=sizes)
        led = np.repeat(led, size)
        self.groups, self.held, self.led, self.size = {}, [], set(), 0
        bucket = (code & _U(self.buckets - 1)).astype(np.int64)
        shingle = (code >> _U(32)).astype(np.uint32)
        order = np.lexsort((shingle, bucket))
        doc, n, led, bucket, shingle = doc[order], n[order], led[order], bucket[order], shingle[order]
        start, count = _runs((bucket << 32) | shingle.astype(np.int64))
        long = np.repeat(count > LONG, count)
        stays = ~long
        if long.any():
            key = _list_id(bucket[long], shingle[long])
            yield from _listed(key, doc[long], n[long], self.percent)
            stays[start[count > LONG]] = True
        doc, n, bucket, shingle, flags = (x[stays] for x in (doc, n, bucket, shingle, OPEN * long + LED * led))
        start, count = _runs(bucket)
        blocks = [_packed(shingle[a : a + k], doc[a : a + k], n[a : a + k], flags[a : a + k]) for a, k in zip(start.tolist(), count.tolist(), strict=True)]
        for at in range(0, len(blocks), 16):
            yield _rows(BLOCK, len(blocks[at : at + 16]), bucket=bucket[start[at : at + 16]].astype(np.int32), block=blocks[at : at + 16])


def _list_id(bucket, shingle) -> np.ndarray:
    return ((shingle.astype(np.uint64) << _U(31)) | bucket.astype(np.uint64)).view(np.int64)


def _content_id(content: np.ndarray, count) -> np.ndarray:
    return (tk.mix(content + np.asarray(count).astype(np.uint64)) | _U(1 << 63)).view(np.int64)


def _listed(key: np.ndarray, doc: np.ndarray, n: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole lists, and the edges to their pivots."""
    edges = _stars(key, doc, n, percent)
    yield _rows(EDGE, len(edges), a=edges[:, 0], b=edges[:, 1])
    yield _rows(LIST, len(key), a=key, b=doc, n=n)


def _sent(levels, buckets: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, out = _Sender(Order(levels.value), buckets, percent), []

        def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> None:
            out.extend(sender.take(rows.column(0).to_pylist(), sets_of(texts)))
            return rows

        for _ in tk.by_parts(batches, "text", one):
            yield from out
            out.clear()
        yield from sender.send()
        tk.give_back()

    return run


def _joined(percent: int):
    """Lists of a bucket: edges to pivots; lists of three or more, and those of groups with members, also whole, once
    for each set of documents."""

    def of_bucket(bucket: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        shingle, doc, n, flags = (np.concatenate(x) for x in zip(*map(_unpacked, blocks), strict=True))
        order = np.lexsort((doc, shingle))
        shingle, doc, n, flags = shingle[order], doc[order], n[order], flags[order]
        start, count = _runs(shingle)
        shared = np.repeat(count > 1, count)
        if not shared.any():
            return
        number = np.repeat(np.arange(len(start)), count)[shared]
        shingle, doc, n, flags = shingle[shared], doc[shared], n[shared], flags[shared]
        edges = _stars(number, doc, n, percent)
        yield _rows(EDGE, len(edges), a=edges[:, 0], b=edges[:, 1])
        start, count = _runs(number)
        content = np.add.reduceat(tk.mix(doc.view(np.uint64)), start)
        known = np.bitwise_or.reduceat(flags, start)
        is_open = known & OPEN > 0
        key = np.where(is_open, _list_id(np.full(len(start), bucket), shingle[start]), _content_id(content, count))
        _, first = np.unique(key, return_index=True)
        once = np.zeros(len(start), bool)
        once[first] = True
        once &= (known > 0) | (count > 2)
        rows = np.repeat(once, count)
        if rows.any():
            yield _rows(LIST, int(rows.sum()), a=np.repeat(key, count)[rows], b=doc[rows], n=n[rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for b in batches:
            for bucket, block in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
                if bucket != now and blocks:
                    yield from of_bucket(now, blocks)
                    blocks = []
                now = bucket
                blocks.append(block)
        if blocks:
            yield from of_bucket(now, blocks)
        tk.give_back()

    return run


def _all_codes(buckets: int):
    """All shingles of documents, dealt out to buckets; a shingle that a task has seen twice goes once, as shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            doc = np.repeat(np.array([i for i, _ in held], np.int64), [len(c) for _, c in held])
            code = tk.mix(np.concatenate([c for _, c in held]))
            held.clear()
            bucket, shingle = (code & _U(buckets - 1)).astype(np.int64), (code >> _U(32)).astype(np.uint32)
            order = np.lexsort((shingle, bucket))
            doc, bucket, shingle = doc[order], bucket[order], shingle[order]
            start, count = _runs((bucket << 32) | shingle.astype(np.int64))
            doc, bucket, shingle, shared = doc[start], bucket[start], shingle[start], count > 1
            start, count = _runs(bucket)
            blocks = [_packed(shingle[a : a + k], doc[a : a + k], np.zeros(k, np.int32), shared[a : a + k]) for a, k in zip(start.tolist(), count.tolist(), strict=True)]
            for at in range(0, len(blocks), 16):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[start[at : at + 16]].astype(np.int32)), pa.array(blocks[at : at + 16], pa.binary())], names=["bucket", "block"])

        def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            held.extend((i, c) for i, c in zip(rows.column(0).to_pylist(), sets_of(texts), strict=True) if len(c))
            return rows

        for _ in tk.by_parts(batches, "text", one):
            if sum(len(c) for _, c in held) >= HELD // 2:
                yield from send()
        if held:
            yield from send()
        tk.give_back()

    return run


def _lonely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, own): shingles of a bucket that one document has alone, counted by document."""

    def of_bucket(blocks: list[bytes]) -> pa.RecordBatch:
        shingle, doc, _, shared = (np.concatenate(x) for x in zip(*map(_unpacked, blocks), strict=True))
        order = np.argsort(shingle, kind="stable")
        start, count = _runs(shingle[order])
        alone = order[start[(count == 1) & (shared[order[start]] == 0)]]
        of, own = np.unique(doc[alone], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(of), pa.array(own.astype(np.int64))], names=["doc", "own"])

    now, blocks = None, []
    for b in batches:
        for bucket, block in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
            if bucket != now and blocks:
                yield of_bucket(blocks)
                blocks = []
            now = bucket
            blocks.append(block)
    if blocks:
        yield of_bucket(blocks)
    tk.give_back()


def _beside(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = kept(ids.toDF("id"), "ids")
    if ids.count() <= SENT:
        ids = F.broadcast(ids)
    return docs.join(ids, docs.doc_id == F.col("id"), "left_semi")


def shareable(docs: DataFrame, placed: DataFrame, unsure: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Lists with e, the shingles that a document has in common with any other of any list, without the documents that
    these are too few of for every other of the list.  unsure: ids with several texts, which stay."""
    codes = _beside(docs, placed.select("doc").distinct()).select("doc_id", "text").mapInArrow(_all_codes(buckets), "bucket int, block binary")
    own = codes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_lonely, "doc long, own long").groupBy("doc").agg(F.sum("own").alias("own"))
    own = own.join(unsure.select(F.col("a").alias("doc")), "doc", "left_anti")
    known = placed.join(own, "doc", "left").select("list", "doc", "n", "part", (F.col("n") - F.coalesce("own", F.lit(0))).cast("int").alias("e"))
    least = placed.groupBy("list").agg(F.min("n").alias("least"))
    return known.join(least, "list").where(F.col("e") * 100 >= percent * (F.col("n") + F.col("least") - F.col("e"))).drop("least")


def _parts(levels, percent: int):
    """Whole sets, or where levels are given, prefixes: half codes, then the level and code of the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = None if levels is None else Order(levels.value)

        def part(codes: np.ndarray) -> bytes:
            if order is None or not len(codes):
                return codes.tobytes()
            prefix, level, last = order.first(codes, prefix_size(len(codes), percent))
            return np.sort((prefix >> _U(32)).astype(np.uint32)).tobytes() + bytes([level]) + last.to_bytes(8, "big")

        def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            keep = [rows.column(rows.schema.get_field_index(c)) for c in ("doc_id", "pivot", "salt", "role")]
            sets = sets_of(texts)
            return pa.RecordBatch.from_arrays([*keep, pa.array([len(s) for s in sets], pa.int32()), pa.array(list(map(part, sets)), pa.binary())], names=["doc_id", "pivot", "salt", "role", "n", "codes"])

        return tk.by_parts(batches, "text", one)

    return run


def shared(own: bytes, other: bytes) -> int:
    """How many shingles two whole sets share."""
    return len(np.intersect1d(np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64), assume_unique=True))


def similar(own: bytes, other: bytes, n: int, m: int, percent: int) -> bool:
    """Whether two whole sets are similar."""
    common = shared(own, other)
    return 100 * common >= percent * (n + m - common)


def may_be_similar(own: bytes, other: bytes, n: int, m: int, percent: int) -> bool:
    """Whether two prefixes allow for it: what both sets share up to the prefix that ends first is in both prefixes,
    and beyond it that set has only so many left.  Half codes can only make more look shared."""
    a, b = np.frombuffer(own[:-9], np.uint32), np.frombuffer(other[:-9], np.uint32)
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    rest = n - len(a) if own[-9:] <= other[-9:] else m - len(b)
    most = min(shared + rest, n, m)
    return 100 * most >= percent * (n + m - most)


def _compared(test, percent: int):
    """Rows (a, b) of the pairs that pass the test, or without a test, of all pairs with s, what they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for batch in batches:
            found = []
            for doc, pivot, salt, role, n, codes in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "pivot", "salt", "role", "n", "codes")), strict=True):
                if role == 0:
                    if at != (pivot, salt):
                        at, mine = (pivot, salt), []
                    mine.append((n, codes))
                    continue
                for m, other in mine if at == (pivot, salt) else ():
                    if test is None:
                        found.append((doc, pivot, shared(codes, other)))
                    elif min(n, m) and 100 * min(n, m) >= percent * max(n, m) and test(codes, other, n, m, percent):
                        found.append((doc, pivot))
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b", "s"][: len(found[0])])

    return run


def _checked(docs: DataFrame, pairs: DataFrame, levels, test, percent: int) -> DataFrame:
    """The pairs that pass the test, or all with what they share.  Partners of a pivot are dealt out in groups of about CHUNK."""
    pairs = kept(pairs.select("a", "b").where("a <> b").distinct(), "pairs")
    busy = pairs.groupBy("b").agg(F.count("*").alias("k")).where(F.col("k") > CHUNK)
    salted = pairs.join(busy, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.ceil(F.col("k") / CHUNK)), F.lit(0)).cast("int").alias("salt"))
    wanted = salted.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "salt", F.lit(1).alias("role"))
    wanted = wanted.unionAll(salted.select(F.col("b").alias("id"), F.col("b").alias("pivot"), "salt", F.lit(0).alias("role")).distinct())
    wanted = kept(wanted, "wanted")
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
    parts = docs.join(wanted, docs.doc_id == F.col("id")).select("doc_id", "text", "pivot", "salt", "role").mapInArrow(_parts(levels, percent), "doc_id long, pivot long, salt int, role int, n int, codes binary")
    dealt = parts.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role")
    return kept(dealt.mapInArrow(_compared(test, percent), "a long, b long" + ", s long" * (test is None)), "links")


def verify(docs: DataFrame, pairs: DataFrame, levels, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of documents that are similar: filtered by their prefixes, then judged on whole sets."""
    return _checked(docs, _checked(docs, pairs, levels, may_be_similar, percent), None, similar, percent)


def _buckets(shingles: int, percent: int) -> int:
    need = shingles * (100 - percent) // 100 // BUCKET + 1
    return 1 << max(6, min(30, (need - 1).bit_length()))


def _close(na, nb, sa, sb, oa, ob, percent: int):
    """Whether sets of sizes na and nb can be similar, where they have at most the lesser of sa and sb in common within
    the pivot of their list, and the lesser of oa and ob beyond it."""
    most = F.least(sa, sb) + F.least(oa, ob)
    return (F.col(na) * 100 >= F.col(nb) * percent) & (F.col(nb) * 100 >= F.col(na) * percent) & (most * 100 >= percent * (F.col(na) + F.col(nb) - most))


def _mixed(placed: DataFrame) -> DataFrame:
    """The lists that hold documents of more than one component."""
    several = placed.groupBy("list").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("list")
    return kept(placed.join(several, "list", "left_semi"), "placed")


def components_of(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least id that links lead to)."""
    since = mark()
    docs = narrow(docs, id_col, text_col)
    order, shingles = order_of(docs)
    buckets = _buckets(shingles, percent)
    levels = docs.sparkSession.sparkContext.broadcast(order.levels)  # 2 ** COUNTERS[1] bytes at most
    sent = kept(docs.mapInArrow(_sent(levels, buckets, percent), ROWS), "sent")
    own = sent.where(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), "n", "d1", "d2")
    joined = kept(sent.where(F.col("kind") == BLOCK).select("bucket", "block").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_joined(percent), ROWS), "joined")
    classes = own.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    reps = own.join(classes, ["n", "d1", "d2"])
    reps = kept(reps.select("doc_id", "rep", "n").distinct(), "reps")

    def found(kind: int) -> DataFrame:
        return sent.where(F.col("kind") == kind).unionAll(joined.where(F.col("kind") == kind))

    def of_rep(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            one = reps.select(F.col("doc_id").alias("_id"), F.col("rep").alias("_rep"))
            df = df.join(one, df[c] == one["_id"]).withColumn(c, F.col("_rep")).drop("_id", "_rep")
        return df

    members = of_rep(found(MEMBER).select("a", "b").distinct(), "a", "b").where("a <> b").distinct()  # a leads b
    members = kept(members.select(F.col("a").alias("leader"), F.col("b").alias("member")), "members")
    edges = kept(of_rep(found(EDGE).select("a", "b").distinct(), "a", "b").distinct(), "edges")
    more = edges.join(members, edges.a == members.leader).select(F.col("member").alias("a"), "b")
    same_id = reps.where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))  # an id with several texts
    many = reps.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("a"))
    links = verify(docs, edges.unionAll(more).unionAll(members.select(F.col("member").alias("a"), F.col("leader").alias("b"))), levels, percent)
    links = links.unionAll(same_id.join(many, "a", "left_semi").select("a", "b"))
    parts = components(links)

    # Lists whose documents are in several components.
    lists = of_rep(found(LIST).select(F.col("a").alias("list"), F.col("b").alias("doc"), "n").distinct(), "doc").distinct()
    wider = lists.join(members, lists.doc == members.leader).select("list", F.col("member").alias("doc"), "n")
    lists = lists.unionAll(wider)
    placed = _mixed(lists.join(parts, lists.doc == parts.v, "left").select("list", "doc", "n", F.coalesce("c", "doc").alias("part")).distinct())
    placed = _mixed(shareable(docs, placed, many, buckets, percent))
    placed = placed.join(many.select(F.col("a").alias("doc"), F.lit(True).alias("unsure")), "doc", "left")
    spans = placed.groupBy("list", "part").agg(F.count("*").cast("double").alias("k"))
    busy = kept(spans.groupBy("list").agg((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))).alias("pairs"), F.sum("k").alias("k")).where(F.col("pairs") > FEW * F.col("k")).select("list"), "busy")
    # In each list with very many pairs, what every document shares with the one that has the least of its own.
    rank = F.struct((F.col("n") - F.col("e")).alias("own"), F.xxhash64("doc").alias("h"), F.col("doc").alias("p"), F.col("part").alias("to"), F.col("n").alias("np"))
    pivots = placed.where("unsure is null").join(busy, "list", "left_semi").groupBy("list").agg(F.min(rank).alias("x")).select("list", "x.p", "x.to", "x.np")
    tried = kept(placed.join(pivots, "list").where("doc <> p and unsure is null").select("list", "doc", "p", "part", "to", "n", "np"), "tried")
    met = kept(_checked(docs, tried.select(F.col("doc").alias("a"), F.col("p").alias("b")), None, None, percent).groupBy("a", "b").agg(F.max("s").alias("s")), "met")
    known = tried.join(met, (tried.doc == met.a) & (tried.p == met.b))
    step = kept(known.where((F.col("part") != F.col("to")) & (F.col("s") * 100 >= percent * (F.col("n") + F.col("np") - F.col("s")))).select("a", "b", "part", "to").distinct(), "step")
    later = [step.select("a", "b")]
    onto = components(step.select(F.col("part").alias("a"), F.col("to").alias("b")))
    inside = known.select("list", "doc", "s").unionAll(pivots.select("list", F.col("p").alias("doc"), F.col("np").cast("long")))
    placed = placed.join(onto, placed.part == onto.v, "left").join(inside, ["list", "doc"], "left")
    inside, beyond = F.when(F.col("unsure"), F.col("n")).otherwise(F.coalesce("s", "e")), F.when(F.col("unsure"), F.col("n")).otherwise(F.coalesce(F.col("e") - F.col("s"), F.lit(0)))
    placed = _mixed(placed.select("list", "doc", "n", F.coalesce("c", "part").alias("part"), inside.cast("int").alias("s"), beyond.cast("int").alias("o")))

    # All pairs that are left across components, as far as sizes allow.
    # A pair meets in many lists; where both have seen each other in one of the last few, it isn't taken again.
    before = Window.partitionBy("doc").orderBy("list").rowsBetween(-SEEN, -1)
    placed = kept(placed.withColumn("seen", F.collect_list("list").over(before)), "placed")
    spans = placed.groupBy("list", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("s").alias("s"), F.max("o").alias("o"), F.count("*").alias("k"), F.first("seen").alias("seen"))
    spans = spans.withColumn("seen", F.when(F.col("k") == 1, F.col("seen")).otherwise(F.array().cast("array<long>")))  # of components of one document
    names = ("list", "one", "least", "most", "s", "o", "k", "seen")
    left, right = spans.toDF(*names), spans.toDF(*(f"{c}2" for c in names)).withColumnRenamed("one2", "two")
    common = F.least("s", "s2") + F.least("o", "o2")
    fits = (F.col("most") * 100 >= F.col("least2") * percent) & (F.col("most2") * 100 >= F.col("least") * percent) & (common * 100 >= percent * (F.col("least") + F.col("least2") - common))
    across = left.join(right, (left.list == right.list2) & (left.one < right.two) & fits & ~F.arrays_overlap("seen", "seen2"))
    fewer = F.col("k") <= F.col("k2")  # the smaller side is expanded first, the larger against it
    across = across.select("list", F.when(fewer, F.col("one")).otherwise(F.col("two")).alias("part"), F.when(fewer, F.col("two")).otherwise(F.col("one")).alias("part2"))
    one, two = placed.toDF("list", "a", "na", "part", "sa", "oa", "seena"), placed.toDF("list", "b", "nb", "part2", "sb", "ob", "seenb")
    pairs = across.join(one, ["list", "part"]).join(two, ["list", "part2"]).where(_close("na", "nb", "sa", "sb", "oa", "ob", percent) & ~F.arrays_overlap("seena", "seenb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = kept(pairs, "across")
    if not pairs.isEmpty():
        later.append(verify(docs, pairs, levels, percent))
    for found_later in later:
        links = links.unionAll(found_later)
    parts = components(links)
    levels.unpersist()
    forget(docs.sparkSession, since, sent, parts)  # the result reads these two
    labelled = own.join(classes, ["n", "d1", "d2"], "left").select("doc_id", "n", "rep")
    return labelled.join(parts, labelled.rep == parts.v, "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "rep", "doc_id")).alias("component_id"))


def distinct(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all columns, without those linked to one of a lesser id; an id with several rows keeps the
    row of the least text, and rows without id stay."""
    since = mark()
    parts = kept(components_of(docs, percent, id_col, text_col), "components")
    forget(docs.sparkSession, since, parts)
    gone = parts.where("doc_id <> component_id").select("doc_id")
    several = parts.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    several = kept(several, "several")
    out = without(docs, gone.unionAll(several), id_col)
    if several.isEmpty():
        return out
    own = docs.join(several.toDF("_several"), docs[f"`{id_col}`"] == F.col("_several"), "left_semi")
    rank = F.row_number().over(Window.partitionBy(f"`{id_col}`").orderBy(f"`{text_col}`"))
    ranked = own.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), rank.alias("rank")).where("rank = 1")
    return out.unionAll(ranked.select("row.*"))
