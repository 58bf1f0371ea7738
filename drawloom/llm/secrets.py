"""Secret scans: fixed patterns and a randomness test battery. Native columns only.

Base kinds (leftmost, not overlapping within a kind; code points, end exclusive):
``assign`` keyword, separator and a value of 8 characters or more; ``access`` AKIA ids of 16 or more; ``hex`` runs of 32
or more. On top of them, kind ``random``: runs of 20 or more of ``[A-Za-z0-9+/_=-]`` whose inferred encoding (hex,
base32, lower or upper letters with digits, base64) passes three tests of uniform randomness:

* chi-squared of the alphabet in equal bins,
* Wald-Wolfowitz runs above and below the middle of the alphabet,
* lag-one serial correlation of the alphabet positions.

The p-values are combined by Fisher's rule. Calling a token ordinary is a discovery against randomness, and its false
discoveries (secrets passed over) are held at ``FDR`` by Benjamini and Hochberg, in each class of length and encoding
on its own: short tokens have little power and must not borrow it from long ones. The p-values of the whole table
enter as counts on a fixed grid, so the procedure needs one small aggregate. Words, capitalised words and paths or
identifiers made of them have no encoding and are not tested.

Copies of a text are scanned once. Null texts count as empty; empty texts and tables have no spans; repeated rows each
get their row; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.llm.common import shuffle_width, small_side, stored
from drawloom.llm.winnowing import let

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
_PATTERN = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, RUN), strict=True))
_ORDINARY = r"^[/_+=-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[/_+=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[/_+=-]*$"

FDR = 0.05
#: p-values are counted by tenths of their decimal logarithm, down to 1e-30.
GRID, LOWEST = 10, 300
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabet, size and number of equal bins by encoding; the first that fits is taken.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef", 8),
    ("HEX", r"^[0-9A-F]+$", _DIGITS + "ABCDEF", 8),
    ("base32", r"^[A-Z2-7]+=*$", _UPPER + "234567", 8),
    ("base36", r"^[0-9a-z]+$", _DIGITS + _LOWER, 9),
    ("BASE36", r"^[0-9A-Z]+$", _DIGITS + _UPPER, 9),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", _UPPER + _LOWER + _DIGITS + "+/", 8),
)


def pieces(text: Column, kind: str) -> Column:
    """Matches in order with the code points before each since the last one."""
    pattern = F.lit(_PATTERN[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(1)) if kind == "assign" else found
    gaps = F.split(text, _PATTERN[kind])

    def one(m: Column, i: Column, g: Column, v: Column) -> Column:
        kept = F.char_length(F.get(v, i)) >= 8 if kind == "assign" else ~F.rlike(m, F.lit(_ORDINARY)) if kind == "random" else F.lit(True)
        token = F.when(kept, m) if kind == "random" else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.char_length(F.get(g, i)).alias("gap"), F.char_length(m).alias("length"), kept.alias("kept"), token.alias("token"))

    all_of = let(gaps, lambda g: let(values, lambda v: F.transform(found, lambda m, i: one(m, i, g, v))))
    return F.when(F.rlike(text, pattern), all_of)


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, by the five-term polynomial of Abramowitz and Stegun 26.2.17 (fixed values)."""
    t = F.lit(1.0) / (1.0 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * series


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * normal_tail(F.least(F.abs(z), F.lit(37.0))))


def upper_tail(z: Column) -> Column:
    return F.when(z >= 0, normal_tail(F.least(z, F.lit(37.0)))).otherwise(1 - normal_tail(F.least(-z, F.lit(37.0))))


def battery(values: Column, size: Column, bins: Column) -> Column:
    """Fisher's combination of the three p-values of a sequence of alphabet positions."""

    def tests(v: Column) -> Column:
        n = F.size(v).cast("double")
        per_bin = F.transform(F.sequence(F.lit(0), bins - 1), lambda b: F.size(F.filter(v, lambda x: F.floor(x * bins / size) == b)))
        expected, df = n / bins, (bins - 1).cast("double")
        chi = F.aggregate(per_bin, F.lit(0.0), lambda a, c: a + (c - expected) * (c - expected) / expected)
        chi_z = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        high = F.transform(v, lambda x: x * 2 >= size)
        pairs = F.slice(F.arrays_zip(high.alias("x"), F.slice(high, F.lit(2), F.size(high)).alias("y")), F.lit(1), F.size(high) - 1)
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        centred = F.transform(v, lambda x: x - mean)

        def rest(h: Column, c: Column) -> Column:
            above = F.size(F.filter(h, lambda x: x)).cast("double")
            below = n - above
            turns = F.size(F.filter(F.zip_with(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1), lambda x, y: x != y), lambda d: d)) + 1
            middle = 2 * above * below / n + 1
            spread = (middle - 1) * (middle - 2) / (n - 1)
            runs_p = F.when(spread > 0, two_sided((turns - middle) / F.sqrt(spread))).otherwise(F.lit(1e-30))
            power = F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
            lag = F.aggregate(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
            serial_p = F.when(power > 0, two_sided((lag / power + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-30))
            half = -(F.ln(F.greatest(upper_tail(chi_z), F.lit(1e-300))) + F.ln(F.greatest(runs_p, F.lit(1e-300))) + F.ln(F.greatest(serial_p, F.lit(1e-300))))
            return F.exp(-half) * (1 + half + half * half / 2)

        return let(high, lambda h: let(centred, lambda c: rest(h, c)))

    return let(values, tests)


def tested(tokens: DataFrame) -> DataFrame:
    """Adds encoding, p (combined) and length class to distinct tokens; those without an encoding go."""
    body = F.rtrim(F.col("token"), F.lit("="))
    encoding = reduce(lambda e, x: e.when(F.rlike("token", F.lit(x[1])), F.lit(x[0])), ENCODINGS[1:], F.when(F.rlike("token", F.lit(ENCODINGS[0][1])), F.lit(ENCODINGS[0][0])))

    def by_encoding(value):
        return reduce(lambda e, x: e.when(F.col("encoding") == x[0], F.lit(value(x))), ENCODINGS[1:], F.when(F.col("encoding") == ENCODINGS[0][0], F.lit(value(ENCODINGS[0]))))

    rows = tokens.withColumn("encoding", encoding).filter("encoding is not null")
    rows = rows.withColumn("body", F.translate(body, "-_", "+/")).withColumn("alphabet", by_encoding(lambda x: x[2])).withColumn("bins", by_encoding(lambda x: x[3]))
    rows = rows.filter(F.char_length("body") >= 16)
    values = F.transform(F.filter(F.split("body", ""), lambda c: c != ""), lambda c: F.instr(F.col("alphabet"), c) - 1)
    p = battery(values, F.char_length("alphabet"), F.col("bins"))
    length = F.floor(F.log2(F.char_length("body")) * 2)
    return rows.select("token", "encoding", F.least(F.greatest(p, F.lit(1e-30)), F.lit(1.0)).alias("p"), length.alias("length_class"))


def ordinary_below(rows: DataFrame) -> DataFrame:
    """Largest p that is called ordinary in each class, by Benjamini and Hochberg on the grid; one row per class."""
    cell = F.floor(-F.log10("p") * GRID).cast("int")
    counts = rows.groupBy("encoding", "length_class", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))  # at most LOWEST + 1 cells a class
    whole = Window.partitionBy("encoding", "length_class")
    below = whole.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    edge = F.pow(F.lit(10.0), -F.col("cell") / GRID)
    steps = counts.withColumn("found", F.sum("c").over(below)).withColumn("n", F.sum("c").over(whole)).withColumn("edge", edge)
    return steps.filter(F.col("n") * F.col("edge") <= FDR * F.col("found")).groupBy("encoding", "length_class").agg(F.min("cell").alias("cell"))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and ``spans``, an array of (start, rank of the kind, end, kind) in order."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.array(*(pieces(text, k) for k in KINDS)).alias("found"))
    found = stored(rows.select("doc_id", "k1", "k2", F.when(F.exists("found", lambda f: f.isNotNull()), F.flatten(F.filter("found", lambda f: f.isNotNull()))).alias("found")))
    hits = stored(found.filter("found is not null").groupBy("k1", "k2").agg(F.first("found").alias("found")))
    each = hits.select("k1", "k2", F.explode("found").alias("f")).select("k1", "k2", "f.*")
    so_far = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("k1", "k2", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    placed = stored(each.withColumn("end", so_far).filter("kept").withColumn("start", F.col("end") - F.col("length")).select("k1", "k2", "kind", "start", "end", "token"))
    distinct = placed.filter("kind = 'random'").select("token").distinct()
    # Small rows, costly tests: adaptive execution would put them in one task, and drops a second shuffle by the token itself.
    dealt = distinct.repartition(shuffle_width(docs.sparkSession), F.xxhash64("token"))
    tokens = stored(tested(dealt))
    limit = ordinary_below(tokens)  # a few classes
    cell = F.floor(-F.log10("p") * GRID).cast("int")
    random = stored(tokens.withColumn("own", cell).join(F.broadcast(limit), ["encoding", "length_class"], "left").filter("cell is null or own < cell").select("token"))
    base = placed.filter("kind != 'random'").drop("token")
    spans = base.unionByName(placed.filter("kind = 'random'").join(small_side(random, 100_000), "token", "left_semi").drop("token"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("rank")
    listed = stored(spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", rank, "end", "kind"))).alias("spans")))
    none = F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>")
    return found.select("doc_id", "k1", "k2").join(listed, ["k1", "k2"], "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return scan(docs).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
