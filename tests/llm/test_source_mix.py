"""The mix against its SQL twin, a plain water filling, and what the schedule promises."""

import random
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from drawloom.llm import source_mix as sm
from drawloom.llm.catalog import QUERIES

COLUMNS = ["doc_id", "size", "source_size", "target", "taken", "n_slots", "first_slot"]


def rows_of(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in COLUMNS)) for r in df.collect()), key=repr)


def twin(docs):
    db = duckdb.connect()
    columns = list(zip(*docs, strict=True)) if docs else [[], [], []]
    db.register("documents", pa.table({"doc_id": pa.array(columns[0], pa.int64()), "text": pa.array(columns[1], pa.string()), "source": pa.array(columns[2], pa.string())}))
    cur = db.execute(sm.MIX_SQL)
    at = [[d[0] for d in cur.description].index(c) for c in COLUMNS]
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in cur.fetchall()), key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(d, t, s, 1, "z") for d, t, s in docs], "doc_id long, text string, source string, size int, _row string").repartition(3)


def filled(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, list(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not above:
            return target | {s: weight[s] * level for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in above]
    return target


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    out = []
    for k in range(400):
        source = "hot" if k % 3 == 0 else rng.choice(["a", "ä", "z", "", None, "b", "c", "tiny"])
        out.append((k, " ".join("w" for _ in range(rng.randint(0, 90))), "tiny2" if k == 7 else source))
    return out + [(9000, "x " * 20_000, "z"), (9001, None, "nothing"), (9002, "", None), (9003, "\x0b\t", "b"), (None, "q r s", "a"), (9004, "one two", "hot"), (9004, "one two", "hot")]


def test_equals_twin(spark, docs):
    assert rows_of(sm.mix(frame(spark, docs))) == twin(docs)


def test_targets_and_promises(spark, docs):
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
    truth, taken, rows = filled(sizes), Counter(), sm.mix(frame(spark, docs)).collect()
    source = {d: s for d, _, s in docs}
    for r in rows:
        assert r.target == pytest.approx(truth[source[r.doc_id]]) and r.taken <= 2 * r.size and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert all(0 <= truth[s] - taken[s] < 1 + 1e-6 for s in sizes)
    assert sum(truth.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert rows_of(sm.mix(frame(spark, docs).repartition(5))) == rows_of(sm.mix(frame(spark, docs)))


def test_sequence_keeps_the_weights_all_along(spark, docs):
    """Each slot is one source's block; every prefix of the schedule holds sources by their weight, but for a few blocks."""
    parts = sm.mix_sequence(frame(spark, docs), block=64).collect()
    by_slot = defaultdict(set)
    words = Counter()
    for p in parts:
        by_slot[p.slot].add(p.source)
        words[p.slot] += p.words
    order = sorted(by_slot)
    total = Counter(next(iter(by_slot[k])) for k in order)
    assert all(len(s) == 1 for s in by_slot.values()) and max(words.values()) == 64
    seen = Counter()
    for n, k in enumerate(order, 1):
        seen[next(iter(by_slot[k]))] += 1
        assert all(abs(seen[s] - n * total[s] / len(order)) < 8 for s in total)


def test_many_sources_and_empty_tables(spark):
    many = [(k, "a b c", f"s{k:05d}") for k in range(3000)]
    assert rows_of(sm.mix(frame(spark, many))) == twin(many)
    assert sm.mix(frame(spark, many).limit(0)).count() == 0
    none = [(1, None, "a"), (2, "", None)]
    assert [(r.size, r.target, r.taken, r.first_slot) for r in sm.mix(frame(spark, none)).collect()] == [(0, 0.0, 0, None)] * 2


def test_query(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert rows_of(QUERIES["op12_source_mix"](spark, "/root/testdata/sf0.001")) == twin(docs)
