"""Secret scans in DataFrame functions alone: fixed formats, and random strings told by character Markov models.

Two first-order models of characters, one of random strings and one of ordinary identifiers, are trained from
labelled samples with aggregations; the log-likelihood ratio of each pair of characters goes into one table of
128 * 128 numbers, which is fixed in size and part of the scan's expressions.  Runs of at least ``MIN_RUN``
characters are reported as kind markov, unless they meet a span of a fixed format, where the mean ratio a pair is at
least ``THRESHOLD``: of the whole run, or of any ``MIN_RUN`` characters in a row, so that ordinary text joined to a
secret doesn't hide it.  The scan is one narrow pass without Python, and work beyond one search per format is done only for
texts that hold a candidate.

Samples: random strings are digests of the numbers below ``RANDOM_SAMPLES``, in hexadecimal and base 64;
identifiers are the words of at most ``SAMPLE_DOCS`` documents labelled good, and those words joined as
identifiers are.  Without such documents only the built-in words count.

Defined results: a null text is an empty one, without spans; ties in start are ordered by kind; repeated rows are
each scanned; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow

RANDOM_SAMPLES = 4000
SAMPLE_DOCS = 500
MIN_RUN = 20
THRESHOLD = 0.6

#: Formats of the base.  In assign, letters of the name are in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RUN = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
KINDS = ("assign", "access", "hex", "markov")

#: Ordinary parts of identifiers, for corpora without labels.
WORDS = "get set value name index count user account file path read write open close list item result response request handler service manager config option default parse format string number date time update delete create insert select order table column data type class object method function return error message event listener thread lock queue cache buffer stream input output filter sort merge"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(text: Column, pattern: str, matches: Column) -> Column:
    """Where each match starts: sums, over two levels, of the lengths of what lies between matches and of matches."""
    step = 256

    def from_gaps(gaps: Column) -> Column:
        total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
        totals = F.transform(F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / step).cast("int")), lambda c: total(F.slice(gaps, c * step + 1, F.lit(step))))
        return _let(totals, lambda t: F.transform(gaps, lambda _, i: total(F.slice(t, F.lit(1), F.floor(i / step).cast("int"))) + total(F.slice(gaps, F.floor(i / step).cast("int") * step + 1, i % step + 1))))

    between = F.transform(F.split(text, pattern, -1), F.length)
    before = F.concat(F.array(F.lit(0)), F.transform(matches, F.length))
    gaps = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), F.slice(before, F.lit(1), F.size(matches)), lambda a, b: a + b)
    return _let(gaps, from_gaps)


def _found(text: Column, pattern: str, kind: str, keep, group: int = 0, maybe: Column | None = None) -> Column:
    """Array of (start, kind number, end) of the matches whose group passes keep."""
    number = F.lit(KINDS.index(kind))

    def spans(matches: Column) -> Column:
        grouped = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        placed = F.arrays_zip(_starts(text, pattern, matches).alias("s"), matches.alias("m"), grouped.alias("g"))
        good = F.filter(placed, lambda x: keep(x["g"]))
        return F.transform(good, lambda x: F.struct(x["s"].alias("start"), number.alias("kind"), (x["s"] + F.length(x["m"])).alias("stop")))

    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    there = F.regexp_like(text, F.lit(pattern)) if maybe is None else maybe
    return F.when(there, _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(none)


def _pairs(samples: DataFrame, weight: str = "n") -> DataFrame:
    """Counts of pairs of characters of the samples, as code * 128 + code of the next."""
    codes = samples.select(weight, F.transform(F.split("s", ""), F.ascii).alias("c"))
    return codes.select(weight, F.explode(F.expr("transform(sequence(1, size(c) - 1), i -> c[i - 1] * 128 + c[i])")).alias("pair")).groupBy("pair").agg(F.sum(weight).alias("n"))


def random_samples(spark: SparkSession, low: int = 0, high: int = RANDOM_SAMPLES) -> DataFrame:
    digest = spark.range(low, high).select(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256).alias("h"))
    return digest.select(F.explode(F.array("h", F.translate(F.base64(F.unhex("h")), "=", ""))).alias("s"), F.lit(1).cast("long").alias("n"))


def identifier_samples(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Words of labelled documents and built-in ones, alone and joined in the ways of identifiers."""
    spark = docs.sparkSession
    built_in = spark.range(1).select(F.explode(F.split(F.lit(WORDS), " ")).alias("w"), F.lit(20).cast("long").alias("n"))
    words = built_in
    if labels is not None:
        good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
        chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)  # at most SAMPLE_DOCS rows are broadcast
        texts = docs.join(F.broadcast(chosen), "doc_id").select("text")
        seen = texts.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        words = words.unionAll(seen)
    low = F.lower("w")
    shapes = F.array(F.concat(low, low), F.concat(low, F.lit("_"), low), F.concat(low, F.initcap("w")), F.concat(F.initcap("w"), F.initcap("w")), F.concat(low, F.lit("-"), low), F.concat(F.upper("w"), F.lit("_"), F.upper("w")), F.concat(low, F.lit("/"), low), F.concat(low, F.lit("2")))
    return words.select(F.explode(shapes).alias("s"), "n")


def train(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """The table of log-likelihood ratios: at code * 128 + next code, random against identifier, given the first code."""
    import math

    docs = narrow(docs, id_col, text_col)
    tables = []
    for samples in (random_samples(docs.sparkSession), identifier_samples(docs, labels)):
        counts = {r.pair: float(r.n) for r in _pairs(samples).where("pair between 0 and 16383").collect()}  # at most 128 * 128 rows
        scale = 1e5 / max(1.0, sum(counts.values()))
        first: dict[int, float] = {}
        for p, n in counts.items():
            first[p // 128] = first.get(p // 128, 0) + n * scale
        tables.append((counts, scale, first))
    ratio = [0.0] * (128 * 128)
    for p in range(128 * 128):
        own = [math.log((counts.get(p, 0) * scale + 1) / (first.get(p // 128, 0) + 66)) for counts, scale, first in tables]
        ratio[p] = round(own[0] - own[1], 6)
    return ratio


def _ratios(run: Column, table: Column) -> Column:
    """Log-likelihood ratios of the pairs of a run of ASCII characters."""
    return _let(F.transform(F.split(run, ""), F.ascii), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.element_at(table, F.element_at(c, i) * 128 + F.element_at(c, i + 1) + 1)))


def _mean(ratios: Column) -> Column:
    return F.aggregate(ratios, F.lit(0.0), lambda a, b: a + b) / F.size(ratios)


def llr(run: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of the pairs of a run of ASCII characters."""
    return _let(_ratios(run, table), _mean)


def holds_random(run: Column, table: Column) -> Column:
    """Whether the whole run, of MIN_RUN characters or more, or MIN_RUN characters in a row of it look random."""
    stretches = lambda r: F.sequence(F.lit(1), F.size(r) - (MIN_RUN - 2))
    return _let(_ratios(run, table), lambda r: (_mean(r) >= THRESHOLD) | F.exists(stretches(r), lambda i: _mean(F.slice(r, i, F.lit(MIN_RUN - 1))) >= THRESHOLD))


def scan(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base, and all spans."""
    docs = narrow(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    long = lambda n: lambda g: F.length(g) >= n
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded to a constant
    found = docs.select(
        "doc_id",
        _found(text, ASSIGN, "assign", long(12), 1).alias("assign"),
        _found(text, ACCESS, "access", long(18), maybe=text.contains("AKIA")).alias("access"),
        _found(text, HEX, "hex", long(16), maybe=F.regexp_like(text, F.lit("[0-9a-f]{16}"))).alias("hex"),
        _found(text, RUN, "markov", lambda g: holds_random(g, table)).alias("run"),
    )
    order = "array_sort(concat(assign, access, hex))"
    # a run that meets a base span is not reported again
    spans = found.withColumn("base", F.expr(order)).withColumn("more", F.expr("filter(run, r -> not exists(base, b -> b.start < r.stop and r.start < b.stop))"))
    names = ", ".join(f"'{k}'" for k in KINDS)
    written = lambda x: F.expr(f"concat_ws(',', transform({x}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), s.start, s.stop)))")
    return spans.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(written("base"), 256).alias("base_sha256"), written("array_sort(concat(base, more))").alias("spans")
    )
