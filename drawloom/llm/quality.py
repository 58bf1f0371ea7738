"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its failure is a bit and its measurement a column. Policies are bit masks
with a version, applied to the stored ledger with native columns, and ablations come from bitwise counts over it.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and fail ``few_words``. Repeated rows each get
their own ledger row; an empty table gives an empty ledger; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.llm.common import map_batches, stored, texts

#: Bit positions, in order. A new rule goes to the end, so that stored ledgers stay readable.
RULES = ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words", "shouting")
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Policies by version: a document is kept if none of the bits is set.
POLICIES = {"v1_base": BASE, "v2_default": BASE | BIT["symbols"], "v3_strict": sum(BIT.values())}

LEDGER = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, failed_bits long"
)
_WINDOW = 5
_SPACES = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))


def repeated_words(words: list[bytes], window: int = _WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more. Exact: windows are numbered, not hashed."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    codes = ids[:n]
    size = len(number)
    for k in range(1, window):
        if int(codes.max(initial=0) + 1) * size >= 2**62:
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes * size + ids[k : k + n]
    order = np.sort(codes)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(codes, twice)
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    lines = again = 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
            lines += 1
        elif line.split(None, 1):
            seen.add(line)
            lines += 1
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    n, chars, repeat = len(words), len(text) - spaces, repeated_words(words)
    bits = (
        BIT["few_words"] * (n < 10)
        | BIT["repeated_windows"] * (100 * repeat > 20 * n)
        | BIT["symbols"] * (symbols > 2 * n)
        | BIT["repeated_lines"] * (2 * again > lines)
        | BIT["long_words"] * (chars > 30 * n)
        | BIT["shouting"] * (2 * upper > chars)
    )
    return n, chars, symbols, again, repeat, lines, upper, bits


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: measurements and failure bits (``LEDGER``)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*map(measure, texts(batch, "text")), strict=True)
        names = [c.split()[0] for c in LEDGER.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names)

    return map_batches(docs.select("doc_id", "text"), one, LEDGER)


def kept_rows(docs: DataFrame, version: str = "v2_default") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns and without a join."""
    mask = POLICIES[version]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([measure(t)[-1] & mask == 0 for t in texts(batch, "text")], pa.bool_()))

    return map_batches(docs, one, docs.schema)


def apply_policy(rows: DataFrame, version: str = "v2_default") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` by the bits of a policy."""
    bits = F.col("failed_bits")
    return rows.withColumn("base_failed", bits.bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", bits.bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(rows: DataFrame, version: str = "v2_default") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects (kept if the rule were dropped)."""
    active = F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version]))
    counts = [f(name) for name in RULES if BIT[name] & POLICIES[version] for f in (
        lambda r: F.count_if(active.bitwiseAND(F.lit(BIT[r])) != 0).alias(f"{r}_failed"),
        lambda r: F.count_if(active == BIT[r]).alias(f"{r}_alone"),
    )]
    one = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.bit_or(active).alias("any_bits"), *counts)
    pairs = [F.struct(F.lit(r).alias("rule"), F.col(f"{r}_failed").alias("n_failed"), F.col(f"{r}_alone").alias("n_alone")) for r in RULES if BIT[r] & POLICIES[version]]
    return one.select("n_docs", F.explode(F.array(*pairs)).alias("r")).select(F.lit(version).alias("version"), "r.rule", "n_docs", "r.n_failed", "r.n_alone")


def report(docs: DataFrame, version: str = "v2_default") -> DataFrame:
    """The ledger, written once and read by everything that follows, with the verdict of every policy.

    Adds ``base_failed``, ``kept`` by ``version``, ``kept_<version>`` for each policy, and the ablation of ``version``:
    ``sole_rule`` is the only rule of it that rejects the document (null if none or several do), ``sole_rule_docs`` the
    number of documents of the whole table that this rule alone rejects, so that dropping it would bring them back.
    """
    rows = stored(ledger(docs))
    active = F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version]))
    rule = F.element_at(F.create_map(*[F.lit(x) for name in RULES for x in (BIT[name], name)]), active.cast("int"))
    judged = apply_policy(rows, version).select("*", *[F.col("failed_bits").bitwiseAND(F.lit(m)).eqNullSafe(0).alias(f"kept_{v}") for v, m in POLICIES.items()], rule.alias("sole_rule"))
    counts = ablation(rows, version).select(F.col("rule").alias("sole_rule"), F.col("n_alone").alias("sole_rule_docs"))
    return judged.join(F.broadcast(counts), "sole_rule", "left")  # one row for each rule of the policy
