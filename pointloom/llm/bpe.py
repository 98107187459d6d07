"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Encoding.  Let last(i) be the last token of the encoding of the first i bytes.  Dropping the last token of an
encoding leaves the encoding of the bytes before it, so last(i) is the one token t that ends at i and that forms a
stable pair with last(i - |t|), i.e. the merges applied to both together give the same two tokens.  Candidates come
from an Aho-Corasick automaton over the vocabulary, so the transducer reads each byte once.

Lookahead.  Whether a merge (x, y) happens can depend on bytes to the right of y only through a merge of lower rank
that competes for y, or through the merges that make y.  ``sufficient_lookahead`` follows these chains through the
merge list, in the order of ranks, and gives a bound K in bytes: a token is final once K more bytes were read.
``Transducer.feed`` emits tokens then, and keeps no more than K bytes, the longest token and the bytes just fed.

Pre-tokens are cut by the byte-level pattern that the vocabulary asks for, and strings of added tokens are ids of their
own; a vocabulary that asks for anything else is refused.  ``Encoder`` takes a text in pieces: it holds what no more
text can change, i.e. a few characters, and feeds a pre-token that grows long to a transducer while it is still growing.
Tokens of short pre-tokens are remembered in a table of bounded size.

Decoding.  Tokens map to bytes, which go through an incremental UTF-8 state machine, ``Decoder``; malformed bytes become
U+FFFD.  Digests are taken as ids come out, so that neither the ids of a text nor what they decode to are held.

Defined results: null texts are empty and give no tokens; repeated rows are each encoded; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .common import narrow

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries of the tables of known pre-tokens and of known pairs; a full table is emptied.
REMEMBERED = 200_000
#: Longest pre-token, in characters, that is remembered.
SHORT = 40
#: Bytes fed at a time from a long pre-token.
FED = 4096
#: Characters that an encoder is given at a time, and of a pre-token that is fed while it grows.
PIECE, LONG = 1 << 15, 1 << 12

#: Fixed value: the pattern of byte-level pre-tokens, and what the kinds of long ones go on with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII alone, for which there is a faster engine.
ASCII = r"""'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\r0-9A-Za-z]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""
KINDS = (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")


def default_vocabulary() -> str:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The letters that vocabulary files write for bytes: printable ones stand for themselves, others follow at 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """A vocabulary, its merges and what the transducer needs of them."""

    def __init__(self, source: bytes):
        import ahocorasick
        import regex

        spec = json.loads(source)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for b, i in [*vocab.items(), *((s.encode(), i) for s, i in self.added.items())]:
            self.bytes_of[i] = b
        self.of_byte = [vocab[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            x, y = (to_bytes(s) for s in (m if isinstance(m, list) else m.split(" ")))
            self.merges[vocab[x], vocab[y]] = (rank, vocab[x + y])
        #: How a token is made: rank, left and right part.
        self.made = {token: (rank, x, y) for (x, y), (rank, token) in self.merges.items()}
        self.longest = max(map(len, vocab))
        self.lookahead = self.sufficient_lookahead()
        wanted = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or wanted.get("type") != "ByteLevel" or wanted.get("add_prefix_space") or not wanted.get("use_regex", True) or spec["model"].get("ignore_merges"):
            raise ValueError("the vocabulary is not one of plain byte-level pairs")
        self.pattern = regex.compile(PATTERN)
        self.ascii = re.compile(ASCII)
        self.kinds = [regex.compile(k) for k in KINDS]
        #: Characters at the end of a text so far that more text can change the reading of.
        self.margin = max([8, *map(len, self.added)])
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.automaton = ahocorasick.Automaton()
        for b, i in vocab.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.known_pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def sufficient_lookahead(self) -> int:
        """Bytes after a token that decide whether it is final, at most; see the module's text."""
        competing = [0] * len(self.bytes_of)  # reach of merges that take the token as their left part
        making = [0] * len(self.bytes_of)
        most = 0
        for (x, y), (_, made) in sorted(self.merges.items(), key=lambda m: m[1][0]):
            reach = max(competing[y], making[y])
            making[made] = max(making[made], reach)
            competing[x] = max(competing[x], len(self.bytes_of[y]) + reach)
            most = max(most, reach, competing[x])
        return most + self.longest

    def merged(self, parts: list[int]) -> list[int]:
        """The merges themselves, lowest rank first, leftmost first; only used on the bytes of single tokens."""
        merges = self.merges
        while len(parts) > 1:
            best = min(((merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [merges[parts[i], parts[i + 1]][1]]
        return parts

    def parted(self, x: int, y: int) -> bool:
        """Whether no merge crosses the border of two tokens that stand next to each other.

        Seen backwards in time: of the tokens at the border the one made last is undone, and each pair that stood there
        must not have a merge of a rank before both were used up.  Of equal ranks the leftmost merge comes first.
        """
        merges, made = self.merges, self.made
        x_used = y_used = len(merges)
        while True:
            cross = merges.get((x, y))
            if cross is not None and cross[0] < x_used and cross[0] <= y_used:
                return False
            a, b = made.get(x), made.get(y)
            if a is not None and (b is None or a[0] > b[0]):
                x_used, x = a[0], a[2]
            elif b is not None:
                y_used, y = b[0], b[1]
            else:
                return True

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together; left -1: none."""
        pair = left, right
        got = self.known_pairs.get(pair)
        if got is None:
            got = self.parted(left, right) if left >= 0 else self.merged([self.of_byte[b] for b in self.bytes_of[right]]) == [right]
            if len(self.known_pairs) >= REMEMBERED:
                self.known_pairs.clear()
            self.known_pairs[pair] = got
        return got

    def cut(self, text: str, at: int, stop: int) -> list[str]:
        """Pre-tokens of a stretch without added tokens."""
        return (self.ascii if text.isascii() else self.pattern).findall(text, at, stop)

    def pre_tokens(self, text: str, at: int = 0) -> Iterator[tuple[int, int, int]]:
        """(start, end, id of an added token or -1) from at on, where a pre-token starts."""
        while at < len(text):
            special = self.split.search(text, at) if self.split else None
            stop = special.start() if special else len(text)
            for m in self.pattern.finditer(text, at, stop):
                yield m.start(), m.end(), -1
            if not special:
                return
            yield special.start(), special.end(), self.added[special[0]]
            at = special.end()

    def ids(self, piece: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit integers."""
        got = self.known.get(piece)
        if got is None:
            raw = piece.encode()
            if len(raw) <= self.lookahead:
                out = self.whole(raw.decode("latin-1"))
            else:
                t = Transducer(self)
                out = [x for at in range(0, len(raw), FED) for x in t.feed(raw[at : at + FED])]
                out += t.end()
            got = struct.pack(f"<{len(out)}I", *out)
            if len(piece) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = got
        return got

    def whole(self, held: str) -> list[int]:
        """The transducer's steps on a pre-token that ends within the lookahead, so that nothing is final before."""
        n = len(held)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        known = self.known_pairs.get
        for end, (token, k) in self.automaton.iter(held):
            end += 1
            if not size[end]:
                left = last[end - k]
                fits = known((left, token))
                if fits or fits is None and self.stable(left, token):
                    last[end], size[end] = token, k
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def blocks(self, text: str) -> Iterator[bytes]:
        """Ids of a text, as little-endian 32-bit integers, as they become final."""
        encoder = Encoder(self)
        if len(text) <= PIECE:
            encoder.held = text
        else:
            for at in range(0, len(text), PIECE):
                yield from encoder.feed(text[at : at + PIECE])
        yield from encoder.end()

    def encode(self, text: str) -> bytes:
        return b"".join(self.blocks(text))

    def decode(self, ids: bytes) -> Iterator[str]:
        """The text of ids, block by block."""
        machine = Decoder(self)
        for at in range(0, len(ids), 1 << 16):
            yield machine.feed(ids[at : at + (1 << 16)])
        yield machine.end()


class Decoder:
    """Text from ids that arrive in blocks; a character that is not whole yet waits."""

    def __init__(self, model: Model):
        self.of, self.machine = model.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        of = self.of
        return self.machine.decode(b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]))

    def end(self) -> str:
        return self.machine.decode(b"", final=True)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of a text that arrives in pieces.  It holds the last characters, whose reading can still change, and of a
    pre-token that is LONG what its transducer holds."""

    def __init__(self, model: Model):
        self.model, self.held = model, ""
        self.run: Transducer | None = None  # of a pre-token that is being fed, which is of this kind
        self.kind = 0

    def feed(self, text: str) -> Iterator[bytes]:
        self.held += text
        yield from self._drained(False)

    def end(self) -> Iterator[bytes]:
        yield from self._drained(True)

    def _drained(self, last: bool) -> Iterator[bytes]:
        model = self.model
        while True:
            special = model.split.search(self.held) if model.split else None
            if special and (last or special.start() + model.margin <= len(self.held)):
                yield from self._read(special.start(), True)
                self.held = self.held[len(special[0]) :]
                yield _packed([model.added[special[0]]])
                continue
            yield from self._read(len(self.held) if last else max(0, len(self.held) - model.margin), last)
            return

    def _read(self, stop: int, whole: bool) -> Iterator[bytes]:
        """Reads the first characters that are held; whole: a pre-token ends where they end."""
        model = self.model
        if self.run is not None:
            m = model.kinds[self.kind].match(self.held, 0, stop)
            end = m.end() if m else 0
            open_ended = end == stop and not whole
            if end and (open_ended or self.kind == 3 and end < stop):
                end -= 1  # it can belong to what follows, as the last of several blanks does
            yield from self._fed(self.held[:end])
            self.held, stop = self.held[end:], stop - end
            if open_ended:
                return
            yield _packed(self.run.end())
            self.run = None
        pieces = model.cut(self.held, 0, stop)
        end = stop
        if not whole:
            while pieces and end > stop - model.margin:
                end -= len(pieces.pop())
        known, ids = model.known, model.ids
        if pieces:
            yield b"".join([known.get(p) or ids(p) for p in pieces])
            self.held = self.held[end:]
        elif not whole and stop > LONG and model.pattern.match(self.held, 0, stop).end() == stop:
            self.run = Transducer(model)
            body = self.held[1] if self.held[0] == " " and not self.held[1].isspace() else self.held[0]
            self.kind = next(i for i, k in enumerate(model.kinds) if k.match(body))
            yield from self._fed(self.held[: stop - 1])
            self.held = self.held[stop - 1 :]

    def _fed(self, text: str) -> Iterator[bytes]:
        raw = text.encode()
        for at in range(0, len(raw), FED):
            yield _packed(self.run.feed(raw[at : at + FED]))


class Transducer:
    """Encodes one pre-token that arrives in pieces; feed returns the ids that are final."""

    def __init__(self, model: Model):
        self.model = model
        self.held = ""  # bytes that are not emitted or that a token may still reach back to
        self.last: list[int] = [-1]  # the token that ends before each held byte, and after the last
        self.size: list[int] = [0]
        self.emitted = 0  # held bytes whose tokens are out

    def feed(self, piece: bytes) -> list[int]:
        model, stable = self.model, self.model.stable
        seen = len(self.last) - 1
        reach = max(0, seen - model.longest + 1)
        self.held += piece.decode("latin-1")
        last, size = self.last, self.size
        last += [-1] * len(piece)
        size += [0] * len(piece)
        pairs = model.known_pairs
        for end, (token, n) in model.automaton.iter(self.held, reach):
            if end >= seen and not size[end + 1] and end + 1 >= n:
                left = last[end + 1 - n]
                fits = pairs.get((left, token))
                if fits or fits is None and stable(left, token):
                    last[end + 1], size[end + 1] = token, n
        if len(self.held) <= model.lookahead:
            return []
        out = self._back(len(self.held), len(self.held) - model.lookahead)
        drop = min(self.emitted, len(self.held) - model.longest)
        if drop > 0:
            self.held, self.last, self.size = self.held[drop:], last[drop:], size[drop:]
            self.emitted -= drop
        return out

    def _back(self, at: int, final: int) -> list[int]:
        """The tokens on the way back from a place that end at final or before it."""
        out = []
        while at > self.emitted:
            if at <= final:
                out.append((at, self.last[at]))
            at -= self.size[at]
        if out:
            self.emitted = out[0][0]
        return [t for _, t in reversed(out)]

    def end(self) -> list[int]:
        return self._back(len(self.held), len(self.held))


_models: dict[str, Model] = {}


def model_of(key: str, source) -> Model:
    """The model of a worker; source: a broadcast of the vocabulary file's bytes."""
    if key not in _models:
        _models.clear()
        _models[key] = Model(source.value)
    return _models[key]


def sent(df: DataFrame, path: str):
    """The vocabulary for the executors: a file of fixed size that only the driver has to reach."""
    with open(path, "rb") as f:
        source = f.read()
    return hashlib.sha256(source).hexdigest(), df.sparkSession.sparkContext.broadcast(source)


def _digests(key: str, source):
    def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        model = model_of(key, source)
        n, ids_sha, text_sha = [], [], []
        for t in texts:
            count, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(model)
            for ids in model.blocks((t or b"").decode()):
                count += len(ids) // 4
                of_ids.update(ids)
                of_text.update(decoder.feed(ids).encode())
            of_text.update(decoder.end().encode())
            n.append(count)
            ids_sha.append(of_ids.hexdigest())
            text_sha.append(of_text.hexdigest())
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return lambda batches: tk.by_parts(batches, "text", one)


def _encoded(key: str, source):
    def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        model = model_of(key, source)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array([model.encode((t or b"").decode()) for t in texts], pa.binary())], names=["doc_id", "ids"])

    return lambda batches: tk.by_parts(batches, "text", one)


def _decoded(key: str, source):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(key, source)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["".join(model.decode(x or b"")) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, a binary of little-endian unsigned 32-bit integers."""
    return narrow(docs, id_col, text_col).mapInArrow(_encoded(*sent(docs, path)), "doc_id long, ids binary")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text, from what encode gave."""
    return ids.select("doc_id", "ids").mapInArrow(_decoded(*sent(ids, path)), "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: tokens, and digests of the ids and of the text that they decode to."""
    return narrow(docs, id_col, text_col).mapInArrow(_digests(*sent(docs, path)), SCHEMA)
