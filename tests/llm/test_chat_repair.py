"""Repairs against all edits of short conversations, and whole tables against the SQL twin."""

import hashlib
import itertools
import random
import re

import duckdb
import pyarrow as pa

from drawloom.llm import chat_repair as cr
from drawloom.llm.catalog import QUERIES

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def brute(codes):
    """Least (cost, audit) over every edit of each row and up to two insertions at each place."""
    rows = [codes[k : k + 2] for k in range(0, len(codes), 2)]
    gaps = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    edits = [[("D", "", 4)] + ([] if f in "bd" else [("K", c, 3 * (f == "t"))] + [("R", x, 3 + 3 * (f == "t")) for x in "ua"]) for c, f in rows]
    best = None
    for chosen in itertools.product(*edits):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            roles = "".join(between[0]) + "".join(e[1] + "".join(g) for e, g in zip(chosen, between[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "I" * len(between[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(chosen, between[1:], strict=True))
                best = min(best or (10**9, ""), (sum(e[2] for e in chosen) + 3 * sum(map(len, between)), audit))
    return best


def codes_of(rng, n):
    return "".join(rng.choice("suax") + rng.choice("bdt---") for _ in range(n))


def test_lightest_equals_all_edits():
    rng = random.Random(1)
    for n, times in ((0, 1), (1, 24), (2, 150), (3, 60)):
        for _ in range(times):
            codes = codes_of(rng, n)
            ((cost, audit),) = cr.lightest(codes).values()
            assert (cost, audit) == brute(codes), codes


def test_parts_join_to_the_same_repair():
    rng = random.Random(2)
    for _ in range(400):
        codes, parts, at = codes_of(rng, rng.randint(1, 14)), [], 0
        while at < len(codes):
            step = 2 * rng.randint(1, 4)
            ways = [{"start": q, "end": e, "cost": b[0], "audit": b[1]} for q in range(4) for e, b in cr.lightest(codes[at : at + step], q, None).items()]
            parts.append({"part": len(parts), "ways": ways})
            at += step
        cost, audit, pieces = cr.joined(parts)
        assert {(cost, audit)} == set(cr.lightest(codes).values()) and "".join(p[2] for p in pieces) == audit


def conversations(rng):
    texts = ["Yes.", "No!", "cut", "", " \n", "Why?\n", "a.\x0b", "x. ", "é", None, "Yes.", "tail. \n\n", "\x1c"]
    out = []
    for c in [*range(160), None, 500]:
        for t in range(rng.randint(0, 9)):
            out.append((c, rng.choice([t, t, t, t + 1, None, 2 * t]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.6 else f"text {c} {t}."))
    return out + [(600, t, ["user", "assistant"][t % 2], f"t{t}.") for t in range(40)] + [(601, 3, "user", "same.")] * 9 + [(602, None, None, None)] * 3


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 7) for r in rows], "conv_id long, turn long, role string, text string, key string, part int").repartition(3)


def twin(rows):
    db = duckdb.connect()
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    db.register("conversations", pa.table({n: pa.array(c, k) for n, c, k in zip(["conv_id", "turn", "role", "text"], columns, kinds, strict=True)}))
    cur = db.execute(cr.REPAIR_SQL)
    at = [[d[0] for d in cur.description].index(c) for c in COLUMNS]
    return sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_equals_twin_whole_and_in_parts(spark):
    rows = conversations(random.Random(3))
    truth = twin(rows)
    assert rows_of(cr.report(frame(spark, rows), damage=True)) == truth
    assert rows_of(cr.report(frame(spark, rows), damage=True, part=3)) == truth
    assert len(truth) == len({r[0] for r in rows}) and len({r[7] for r in truth}) > 60


def test_repaired_texts_have_the_digest(spark):
    rows = frame(spark, conversations(random.Random(4)))
    found, texts = cr.repair(rows, part=4)
    pieces = {}
    for r in sorted(texts.collect(), key=lambda r: (r.key, r.part)):
        pieces.setdefault(r.key, []).extend([r.repaired] if r.repaired else [])
    for r in found.collect():
        text = "\n".join(pieces[r.key])
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256


def test_one_long_conversation_and_empty_tables(spark):
    rows = [(1, t, ["user", "assistant", "user"][t % 3], f"text {t}" + "." * (t % 5 > 0)) for t in range(3000)] + [(2, 1, "user", "same.")] * 2000
    got = {r.conv_id: r for r in cr.report(frame(spark, rows)).collect()}
    codes = "".join(("u" if t % 3 != 1 else "a") + ("-" if t % 5 else "t") for t in range(3000))
    assert {(got[1].cost, got[1].audit)} == set(cr.lightest(codes).values())
    assert (got[2].duplicate, got[2].audit, got[2].cost) == (1999, "K" + "D" * 1999 + "I", 7999)  # one user row stays and needs an answer
    assert cr.report(frame(spark, rows).limit(0), damage=True).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.001")) == twin(rows)
