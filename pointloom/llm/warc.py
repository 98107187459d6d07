"""WARC archives with an index that is merged externally.

Writing.  Payloads meet by digest: the least page id of equal payloads is the response and the others are revisits
of it.  Each task writes one archive of gzip members, and beside it a run: its captures sorted by URL key, time and
page id.  Files have names of their own, so an attempt that is lost or runs twice leaves at most a file that nothing
names; the names that count are those in the table that the write stage returns.

Merging.  Runs are merged by loser trees of at most ``FAN_IN`` inputs, round after round, until ``FAN_IN`` are left;
the last round is cut into ranges of the whole key, URL key, time and page id together, so captures of one URL or
host are spread as well as any others.  The concatenated ranges are the capture histories in global order.

Reading.  The histories name archive and offset of every capture; each archive is read where they point, and the
length and digest of every response are computed anew from what was read.

Files are reached through pyarrow's file systems, by the URI of the shared folder.

Defined results: a null payload is an empty one; a null URL has an empty key; rows that repeat an id and payload are
each a record, of the same type; a page without id is a record without id, and a response unless an equal payload
has an id; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, shared_dir, ship

FAN_IN = 64
#: Lines of a run between two entries of its list of places, at first; the list is thinned when it gets long.
STRIDE = 512
#: Places of a run, at most twice as many.
PLACES = 512
#: Bytes of captures in a range of the last round, about.
RANGE = 8 << 20
#: Seconds since the epoch of page 0; page n was captured n seconds later.
EPOCH = 1_700_000_000
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

Key = tuple[str, str, int]


def url_key(url: str | None) -> str:
    """The host's labels from the top down, then the path: com,example)/a?b."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url or ""
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){rest}" if host else rest if url else ""


def stamp(page_id: int | None) -> str:
    import datetime

    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=EPOCH + (page_id or 0) % 10**9)).strftime("%Y%m%d%H%M%S")


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member; a revisit has the response's headers alone."""
    t = stamp(page_id)
    when = f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:]}Z"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    out = zlib.compressobj(1, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of the response, and the payload in the record."""
    raw = zlib.decompress(member, 31)
    fields = lambda lines: dict(x.split(": ", 1) for x in lines.decode().split("\r\n")[1:] if ": " in x)
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {warc.get('WARC-Record-ID')} has another length than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


class LoserTree:
    """Merges sorted inputs: each inner node keeps the loser of its match, so one path is replayed for each item."""

    def __init__(self, inputs: Iterable[Iterator]):
        self.inputs = list(inputs)
        self.size = 1
        while self.size < max(1, len(self.inputs)):
            self.size *= 2
        self.head = [next(i, None) for i in self.inputs] + [None] * (self.size - len(self.inputs))
        self.loser = [0] * self.size
        winner = list(range(self.size))
        while len(winner) > 1:
            half = len(winner) // 2
            for i in range(half):
                a, b = winner[2 * i], winner[2 * i + 1]
                won = a if self._before(a, b) else b
                self.loser[half + i], winner[i] = (b if won == a else a), won
            winner = winner[:half]
        self.best = winner[0]

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def __iter__(self) -> Iterator:
        while (item := self.head[self.best]) is not None:
            yield item
            at = self.best
            self.head[at] = next(self.inputs[at], None)
            node = (self.size + at) // 2
            while node:
                if self._before(self.loser[node], at):
                    at, self.loser[node] = self.loser[node], at
                node //= 2
            self.best = at


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _line(key: Key, place: tuple[str, int, int]) -> bytes:
    return json.dumps([*key, *place], separators=(",", ":")).encode() + b"\n"


def _write_run(folder: str, captures: Iterable[tuple[Key, tuple[str, int, int]]]) -> tuple[str, int, list]:
    """Writes sorted captures; returns the name, the bytes and the places (first key, offset) every so many lines, of
    which a run of any length has fewer than 2 * PLACES."""
    files, path = _files(folder)
    name = f"run-{uuid.uuid4().hex}.cdxj"
    size, places, stride = 0, [], STRIDE
    with files.open_output_stream(f"{path}/{name}", compression=None) as out:
        held = []
        for i, (key, place) in enumerate(captures):
            line = _line(key, place)
            if i % STRIDE == 0:
                out.write(b"".join(held))
                held.clear()
            if i % stride == 0:
                places.append([list(key), size])
                if len(places) == 2 * PLACES:
                    places, stride = places[::2], 2 * stride
            held.append(line)
            size += len(line)
        out.write(b"".join(held))
    return name, size, places


def _read_run(folder: str, name: str, size: int, places: list, low: Key | None = None, high: Key | None = None) -> Iterator[tuple[Key, tuple[str, int, int]]]:
    """Captures of a run from key low on and below high; reads start at the last place before low, as lines of key low
    itself can lie before a place of that key."""
    files, path = _files(folder)
    at = 0
    for key, offset in places:
        if low is not None and tuple(key) < low:
            at = offset
    with files.open_input_file(f"{path}/{name}") as f:
        f.seek(at)
        rest = b""
        while at < size or rest:
            piece = f.read(1 << 16) if at < size else b""
            at += len(piece)
            lines = (rest + piece).split(b"\n")
            rest = lines.pop() if piece else b""
            for line in lines:
                if not line:
                    continue
                key, stamped, page, *place = json.loads(line)
                whole = key, stamped, page
                if high is not None and whole >= high:
                    return
                if low is None or whole >= low:
                    yield whole, tuple(place)
            if not piece:
                return


_WRITTEN = "run string, size long, places string, records long"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        name, offset, captures, out = f"pages-{uuid.uuid4().hex}.warc.gz", 0, [], None
        for b in batches:
            for page, url, packed, size, sha, first, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "packed", "size", "sha", "first", "revisit")), strict=True):
                out = out or files.open_output_stream(f"{path}/{name}", compression=None)
                payload = None if revisit or not size else pa.decompress(packed, size, "zstd", asbytes=True)
                member = record(page, url, payload, size, base64.b32encode(bytes.fromhex(sha)).decode(), first, revisit)
                out.write(member)
                captures.append(((url_key(url), stamp(page), -1 if page is None else page), (name, offset, len(member))))
                offset += len(member)
        if out is None:
            return
        out.close()
        captures.sort()
        run_name, size, places = _write_run(folder, captures)
        yield pa.RecordBatch.from_pydict({"run": [run_name], "size": [size], "places": [json.dumps(places)], "records": [len(captures)]})

    return run


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        html = [(x or "").encode() for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array([pa.compress(x, "zstd", asbytes=True) for x in html], pa.binary()), pa.array([len(x) for x in html], pa.int64()), pa.array([hashlib.sha1(x).hexdigest() for x in html], pa.string())],
            names=["page_id", "url", "packed", "size", "sha"],
        )


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes the archives and runs to the folder; one row per run."""
    ship(pages.sparkSession)
    _make(folder)
    one = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    firsts = one.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("of"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    firsts = firsts.where(f"bytes >= {int(least_bytes)} and page_id is not null").groupBy("of").agg(F.min("page_id").alias("first"))
    packed = one.mapInArrow(_packer, "page_id long, url string, packed binary, size long, sha string")
    joined = packed.join(firsts, packed.sha == firsts.of, "left").drop("of")
    return kept(joined.withColumn("revisit", F.coalesce(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.lit(False)) & F.col("first").isNotNull()).mapInArrow(_writer(folder), _WRITTEN), "runs")


def _make(folder: str) -> None:
    files, path = _files(folder)
    files.create_dir(path, recursive=True)


def _merger(folder: str):
    """Merges the runs of each row into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for runs in b.column("runs").to_pylist():
                merged = LoserTree(_read_run(folder, r["run"], r["size"], json.loads(r["places"])) for r in runs)
                name, size, places = _write_run(folder, merged)
                yield pa.RecordBatch.from_pydict({"run": [name], "size": [size], "places": [json.dumps(places)], "records": [sum(r["records"] for r in runs)]})

    return run


def _ranger(folder: str, runs: list[tuple[str, int, list]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, low, high in zip(*(b.column(c).to_pylist() for c in ("at", "low", "high")), strict=True):
                low, high = (None if x is None else tuple(json.loads(x)) for x in (low, high))
                rows: list[tuple] = []
                for i, (key, place) in enumerate(LoserTree(_read_run(folder, *r, low, high) for r in runs)):
                    rows.append((at, i, *key, *place))
                    if len(rows) == 4096:
                        yield _history(rows)
                        rows = []
                if rows:
                    yield _history(rows)

    return run


_HISTORY = "range int, place long, url_key string, stamp string, page_id long, archive string, offset long, length long"


def _history(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _HISTORY.split(", ")])


def merge(runs: DataFrame, folder: str) -> DataFrame:
    """Capture histories in global order: by range, then by place in the range."""
    spark = runs.sparkSession
    while (count := runs.count()) > FAN_IN:
        groups = -(-count // FAN_IN)
        numbered = runs.withColumn("k", F.row_number().over(_order_window()) % groups)
        grouped = numbered.groupBy("k").agg(F.collect_list(F.struct("run", "size", "places", "records")).alias("runs"))  # FAN_IN at most
        runs = kept(grouped.select("runs").repartition(groups).mapInArrow(_merger(folder), _WRITTEN), "runs")
    last = [(r.run, r.size, json.loads(r.places)) for r in runs.collect()]  # FAN_IN at most, each with its places
    total = sum(size for _, size, _ in last)
    keys = sorted(tuple(k) for _, _, places in last for k, _ in places)
    cuts = max(1, min(len(keys), total // RANGE + 1))
    bounds = sorted({keys[len(keys) * i // cuts] for i in range(1, cuts)}) if keys else []
    edges = [None, *(json.dumps(k) for k in bounds), None]
    ranges = [(i, edges[i], edges[i + 1]) for i in range(len(edges) - 1)]
    return spark.createDataFrame(ranges, "at int, low string, high string").repartition(len(ranges), "at").mapInArrow(_ranger(folder, last), _HISTORY)


def _order_window():
    from pyspark.sql import Window

    return Window.orderBy("run")  # over one row for each archive


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        now, f = None, None
        for b in batches:
            rows = []
            for name, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if name != now:
                    if f is not None:
                        f.close()
                    now, f = name, files.open_input_file(f"{path}/{name}")
                warc, http, payload = parsed(f.read_at(length, offset))
                number = lambda s: int(s[10:-1]) if s[10:-1] else None
                digest, revisit = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"] == "revisit"
                size = int(http["Content-Length"])
                if not revisit:
                    seen = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if (seen, len(payload)) != (digest, size):
                        raise ValueError(f"{name} at {offset}: the payload is not the one that was written")
                rows.append((number(warc["WARC-Record-ID"]), size, digest, "revisit" if revisit else "response", number(warc["WARC-Refers-To"]) if revisit else None))
            if rows:
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if f is not None:
            f.close()

    return run


def read(histories: DataFrame, folder: str) -> DataFrame:
    """The records that the histories name, read from their archives: an archive is read by one task.  The number of
    partitions is given, as places are few bytes and would else be put together into one."""
    parts = int(histories.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = histories.select("archive", "offset", "length").repartition(parts, "archive").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_reader(folder), SCHEMA)


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes all pages, merges the index and reads every record back through it."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(merge(write(pages, folder, least_bytes), folder), folder)
