"""Personal data: fixed formats, and further spans that boosted trees accept from candidates of high recall.

Generators propose overlapping spans: numbers in the ways of telephones and cards, addresses written out
("name at host dot org"), network addresses in other forms, identity and account numbers.  Features of a candidate's format and of the words around
it go through gradient-boosted trees with logistic loss; their margins are calibrated on held-out samples, and for
each kind the least threshold with precision of at least ``PRECISION`` there selects spans.  Spans of a fixed format
always stay; of overlapping candidates the likeliest is taken.

The trees are trained on the driver from ``SAMPLES`` made-up sentences, positive and negative alike, with a fixed
seed; calibration and thresholds come from ``HELD`` more, which use words and forms that the training set has not.  The scan is one narrow pass over whole texts; places are in code points.

Defined results: a null text is an empty one without spans; ties in start are ordered by kind; repeated rows are each
scanned; other columns are ignored by scan and kept by redact.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .common import narrow, ship

KINDS = ("email", "ip", "card", "phone", "ident", "account")
SAMPLES, HELD = 6000, 3000
PRECISION = 0.98
ROUNDS, DEPTH, RATE = 60, 3, 0.3
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

Span = tuple[int, int, int]  # start, kind number, end

# Formats of the base.  The first character is tested twice so that a search skips to it, and a run of digits is
# entered at its start alone; both leave the matches as they are and the time linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed formats, sorted by kind and start."""
    out: list[Span] = []
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = at = m.end()
        else:
            at += 1
            done = at
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# Generators, of high recall; every one is entered where its first character is seen and is linear in the text.
_GENERATORS = (
    (0, re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._+-]{0,40}\x20?[(\[{]?\x20?(?:at|AT|@)\x20?[)\]}]?\x20?[A-Za-z0-9-]{1,40}(?:\x20?[(\[{]?\x20?(?:dot|DOT|\.)\x20?[)\]}]?\x20?[A-Za-z]{2,10}){1,3}"), re.compile(r"(?i)\b(?:at|dot)\b|[)\]}]|@")),
    (1, re.compile(r"(?<![0-9A-Za-z:.])[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){3,7}(?![0-9A-Za-z:])"), re.compile(":[0-9a-fA-F]{0,4}:")),
    (1, re.compile(r"[0-9](?<![0-9]{2})[0-9]{0,2}(?: ?[(\[{]?(?:dot|\.)[)\]}]? ?[0-9]{1,3}){3}(?![0-9.])"), re.compile(r"dot|[\])}]")),
    (2, re.compile(r"[0-9](?<![0-9]{2})[0-9]{3}(?:[ ./_-]{1,2}[0-9]{4}){2,3}[0-9]{0,3}(?![0-9])"), None),
    (3, re.compile(r"(?:(?<![0-9(])\(|(?<![0-9(])(?=[0-9]))[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}[ ./-][0-9]{3,5}(?![0-9])"), None),
    (3, re.compile(r"[0-9](?<![0-9]{2})[0-9]{8,10}(?![0-9])"), None),
    (4, re.compile(r"[0-9](?<![0-9]{2})[0-9]{2}[ -][0-9]{2}[ -][0-9]{4}(?![0-9])"), None),
    (5, re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), None),
)

_CUES = (
    ("email", "mail", "e-mail", "contact", "write", "address", "reply"),
    ("card", "visa", "mastercard", "credit", "pay", "amex", "debit", "charge"),
    ("phone", "tel", "call", "telephone", "mobile", "cell", "fax", "ring", "dial", "whatsapp"),
    ("ssn", "social", "security", "passport", "identity", "id", "insurance"),
    ("iban", "account", "bank", "transfer", "acct", "swift"),
    ("ip", "host", "server", "ping", "address", "client", "login", "peer"),
    ("version", "order", "invoice", "isbn", "part", "serial", "page", "ticket", "no", "item", "ref", "lot", "figure", "section", "total", "eur", "usd", "code"),
)
_WORD = re.compile(r"[A-Za-z-]+")
N_FEATURES = 15 + 2 * len(_CUES)


def candidates(text: str) -> list[Span]:
    out = []
    for kind, pattern, needs in _GENERATORS:
        if needs is not None and not needs.search(text):
            continue
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    start, kind, end = span
    s = text[start:end]
    digits = _digits(s)
    before, after = text[max(0, start - 40) : start], text[end : end + 25]
    near = [w.lower() for w in _WORD.findall(before)[-4:]]
    behind = [w.lower() for w in _WORD.findall(after)[:2]]
    seps = [c for c in s if c in " ./_-()"]
    groups = re.split(r"[^A-Za-z0-9]+", s.strip("()"))
    tail = before.rstrip()[-1:]
    own = [
        kind, len(s), len(digits), sum(c.isalpha() for c in s), len(seps), len(set(seps)), len(groups), max(map(len, groups)),
        luhn(digits) if digits else 0, len(set(digits)) / max(1, len(digits)), tail in tuple("$€£#"), tail in (":", "="), after[:1] in tuple("%$€"),
        before[-1:].isalnum() or before[-1:] in ("-", ".", "/"), after[:1].isalnum() or after[:2][-1:].isdigit() and after[:1] in "-./,",
    ]
    for cue in _CUES:
        own += [sum(w in cue for w in near), sum(w in cue for w in behind)]
    return [float(x) for x in own]


@dataclass
class Tree:
    """A binary tree in heap order; feature -1 marks a leaf."""

    feature: list[int]
    cut: list[float]
    value: list[float]

    def __call__(self, x: list[float]) -> float:
        i = 0
        while self.feature[i] >= 0:
            i = 2 * i + 1 + (x[self.feature[i]] > self.cut[i])
        return self.value[i]


@dataclass
class Boosted:
    start: float
    trees: list[Tree]
    scale: float = 1.0
    shift: float = 0.0
    threshold: tuple[float, ...] = (0.5,) * len(KINDS)

    def margin(self, x: list[float]) -> float:
        return self.start + RATE * sum(t(x) for t in self.trees)

    def chance(self, x: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.scale * self.margin(x) + self.shift))))


def _grown(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> Tree:
    size = 2 ** (DEPTH + 1) - 1
    tree = Tree([-1] * size, [0.0] * size, [0.0] * size)
    rows = {0: np.arange(len(x))}
    for i in range(size):
        if i not in rows:
            continue
        at = rows.pop(i)
        g, h = gradient[at].sum(), hessian[at].sum()
        tree.value[i] = float(g / (h + 1))
        best = (1e-3, -1, 0.0)
        if 2 * i + 2 < size and len(at) >= 20:
            for f in range(x.shape[1]):
                order = np.argsort(x[at, f], kind="stable")
                v = x[at, f][order]
                gl, hl = np.cumsum(gradient[at][order])[:-1], np.cumsum(hessian[at][order])[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[v[1:] == v[:-1]] = -1
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
        if best[1] >= 0:
            tree.feature[i], tree.cut[i] = best[1], best[2]
            right = x[at, best[1]] > best[2]
            rows[2 * i + 1], rows[2 * i + 2] = at[~right], at[right]
    return tree


def fit(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> Boosted:
    """Boosting on the samples a with labels b; calibration and thresholds on x with labels y."""
    rate = b.mean()
    model = Boosted(math.log(rate / (1 - rate)), [])
    margin = np.full(len(b), model.start)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        tree = _grown(a, b - p, p * (1 - p))
        model.trees.append(tree)
        margin += RATE * np.array([tree(r) for r in a.tolist()])
    score = np.array([model.margin(r) for r in x.tolist()])
    for _ in range(200):  # logistic calibration of the margins
        p = 1 / (1 + np.exp(-(model.scale * score + model.shift)))
        off = y - p
        model.scale += 0.05 * float((off * score).mean())
        model.shift += 0.2 * float(off.mean())
    chance = np.array([model.chance(r) for r in x.tolist()])
    cuts = []
    for kind in range(len(KINDS)):
        of = x[:, 0] == kind
        got, want = chance[of], y[of]
        fits = [t for t in np.linspace(0.2, 0.99, 80) if (got >= t).any() and want[got >= t].mean() >= PRECISION]
        cuts.append(float(fits[0]) if fits else 1.1)
    model.threshold = tuple(cuts)
    return model


def samples(n: int, seed: int = 7, held: bool = False) -> list[tuple[str, Span, int]]:
    """Made-up sentences with one candidate that is personal data (1) or not (0).  Samples that are held out draw on the
    other half of the cues and fillers, and on forms of their own; either class has sentences that look like the other."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    bits = ("mo", "lan", "ri", "pe", "sto", "var", "ul", "ke", "dra", "ny") if held else ("an", "er", "the", "on", "re", "ti", "is", "ou", "le", "en")
    word = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(1, 4)))
    filler = lambda k: " ".join(word() for _ in range(k))
    cue_of = lambda i: rng.choice(_CUES[i][held::2])
    own_cue = {0: 0, 1: 6, 2: 1, 3: 2, 4: 3, 5: 4}

    def card() -> str:
        body = (rng.choice(("4", "5", "37")) + num(13))[:15]
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def phone() -> str:
        if held:
            return rng.choice((f"{num(3)}.{num(3)}.{num(4)}", f"({num(3)}) {num(3)} {num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"{num(3)}/{num(3)}-{num(4)}", f"0{num(10)}"[:11]))
        return rng.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(9)}", f"{num(3)} {num(3)} {num(4)}"))

    def network() -> str:
        parts = [str(rng.randrange(256)) for _ in range(4)]
        six = ":".join(hexa(rng.randrange(1, 5)) for _ in range(8))
        return rng.choice((six, rng.choice(("[.]", " dot ", "(.)")).join(parts), six.replace(":0", "::", 1) if ":0:" in six else six))

    def good() -> tuple[int, str, str]:
        kind = rng.choice((0, 1, 2, 3, 3, 4, 5))
        cue = cue_of(own_cue[kind])
        if kind == 0:
            ways = ((" [at] ", " dot "), ("(AT)", "(DOT)"), (" at ", " [dot] ")) if held else ((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" AT ", " DOT "), ("(at)", "."))
            at, dot = rng.choice(ways)
            return kind, word() + rng.choice((".", "_", "")) + word() + at + word() + dot + rng.choice(("com", "org", "net", "de")), cue
        if kind == 1:
            return kind, network(), cue
        if kind == 2:
            c, sep = card(), rng.choice((".", "/", " - ", "_", "  "))[:2]
            return kind, sep.join(c[i : i + 4] for i in range(0, 16, 4)), cue
        if kind == 3:
            return kind, phone(), cue
        if kind == 4:
            return kind, f"{num(3)}-{num(2)}-{num(4)}", cue
        return kind, rng.choice(("DE", "FR", "GB", "ES")) + num(2) + "".join(rng.choice((" ", "")) + num(4) for _ in range(4)) + num(2), cue

    def bad() -> tuple[int, str, str]:
        kind = rng.choice((0, 1, 2, 3, 3, 4, 5))
        cue = rng.choice((cue_of(5), cue_of(5), cue_of(5), word(), word()))
        if rng.random() < 0.15:  # the form of the data, in a place that says otherwise
            if kind == 3:
                return kind, phone(), cue_of(5)
            if kind == 1:
                return kind, rng.choice(("[.]", "(.)")).join(str(rng.randrange(10, 999)) for _ in range(4)), cue_of(5)
        if kind == 0:
            return kind, rng.choice((f"{word()} at {word()}. {word()}", f"{word()} at the. {word()}", f"{word()} at {word()} dot {word()}", f"{word()} (at) {word()}. {word()}")), rng.choice((word(), "look", "was", "arrive"))
        if kind == 1:
            return kind, rng.choice((f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", f"{num(1)}:{num(1)}:{num(2)}:{num(1)}:{num(2)}", " dot ".join(num(1) for _ in range(4)))), rng.choice((cue, "at", "ratio", "time"))
        if kind == 2:
            sep = rng.choice((".", "/", " ", "-"))
            return kind, sep.join((f"{rng.randrange(1900, 2030)}", num(4), num(4), num(4))[: rng.choice((3, 4))]), cue
        if kind == 3:
            return kind, rng.choice((f"{num(3)}.{num(3)}.{num(3)}", f"{rng.randrange(1900, 2030)}-{num(3)}-{num(3)}", f"{num(9)}", f"{num(10)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}/{num(3)}/{num(4)}")), cue
        if kind == 4:
            return kind, rng.choice((f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)} {num(2)} {num(4)}")), cue
        return kind, rng.choice(("AB", "XK", "NO")) + num(2) + "".join(rng.choice((" ", "")) + rng.choice((num(4), "ABCD", "PART")) for _ in range(rng.randrange(2, 5))), cue

    out = []
    for _ in range(n):
        y = rng.random() < 0.5
        kind, s, cue = good() if y else bad()
        if y and kind in (0, 1, 2, 3, 5) and rng.random() < 0.25 and not s.replace(" ", "").isdigit():
            cue = word()
        before = f"{filler(rng.randrange(4))} {cue}{rng.choice((' ', ': ', ' is ', ' number ', ' # ' if not y else ' '))}"
        text = before + s + rng.choice((" ", ". ", ", ", "\n")) + filler(rng.randrange(3))
        out.append((text, (len(before), kind, len(before) + len(s)), int(y)))
    return out


@lru_cache(1)
def trained() -> Boosted:
    sets = [(np.array([features(t, s) for t, s, _ in made]), np.array([y for _, _, y in made], float)) for made in (samples(SAMPLES), samples(HELD, 8, held=True))]
    return fit(*sets[0], *sets[1])


def all_spans(text: str, model: Boosted) -> tuple[list[Span], list[Span]]:
    """Spans of the base, and those of the method that meet none of them."""
    base = base_spans(text)
    more: list[tuple[float, Span]] = []
    for span in candidates(text):
        x = features(text, span)
        if (p := model.chance(x)) >= model.threshold[span[1]]:
            more.append((p, span))
    if not more:
        return base, []
    taken: list[tuple[int, int]] = []  # what is covered, as runs apart from each other
    for a, b in sorted((a, b) for a, _, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(taken[-1][1], b)
        else:
            taken.append((a, b))
    own = []
    for _, (a, k, b) in sorted(more, key=lambda x: (-x[0], x[1])):
        i = bisect.bisect_left(taken, (b, 0))
        if not i or taken[i - 1][1] <= a:
            own.append((a, k, b))
            taken.insert(i, (a, b))
    return base, own


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[1], s[0])))


def _scanned(model: Boosted):
    def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        counts: list[list[int]] = [[], [], [], []]
        sha, spans, n_spans = [], [], []
        for t in texts:
            base, own = all_spans((t or b"").decode(), model)
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in base))
            sha.append(hashlib.sha256(_written(base).encode()).hexdigest())
            spans.append(_written(base + own))
            n_spans.append(len(base) + len(own))
        return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(n_spans, pa.int64())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tk.by_parts(batches, "text", one)

    return run


def redacted(text: str, model: Boosted) -> str:
    """The text with each span, or run of spans that meet, replaced by its first kind in brackets."""
    base, own = all_spans(text, model)
    out, at = [], 0
    for a, k, b in sorted(base + own):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redactor(model: Boosted, text_col: str):
    def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        i = rows.schema.get_field_index(text_col)
        new = pa.array([None if t is None else redacted(t.decode(), model) for t in texts], rows.schema.field(i).type)
        return rows.set_column(i, rows.schema.field(i), new)

    return lambda batches: tk.by_parts(batches, text_col, one)


def scan(docs: DataFrame, model: Boosted | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base, and all spans."""
    return narrow(docs, id_col, text_col).mapInArrow(_scanned(model or trained()), SCHEMA)


def redact(docs: DataFrame, model: Boosted | None = None, text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, with personal data in the text replaced."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_redactor(model or trained(), text_col), docs.schema)
