"""Components of the n-gram join against all pairs."""

import random

import numpy as np
import pyarrow as pa

from drawloom.llm import ngram_join as nj
from drawloom.llm.catalog import QUERIES


def brute(docs, size=5):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i in ids:
        for g in sets[i]:
            where.setdefault(g, []).append(i)
    seen = set()
    for i in ids:
        for g in sets[i]:
            for j in where[g]:
                if j > i and (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        a, b = sorted((root(i), root(j)))
                        parent[b] = a
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 90))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for k in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words = words[: rng.randint(0, len(words))] + passage[: rng.randint(0, 60)]
        sep = rng.choice([" ", "\n", "\t ", "\v"])
        text = sep.join(words)
        docs.append((k, text.upper() if rng.random() < 0.2 else text))
    return docs


def run(spark, docs, parts=3):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, n string, k int").repartition(parts)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.jaccard_components(df).collect())


def test_components_equal_all_pairs(spark):
    docs = corpus(1, 500)
    assert run(spark, docs) == brute(docs)


def test_edges_of_the_threshold_and_chains(spark):
    chain = [(k, " ".join(f"c{j}" for j in range(k, k + 40))) for k in range(0, 60, 2)]
    apart = [(100 + k, " ".join(f"d{j}" for j in range(k, k + 40))) for k in range(0, 60, 8)]
    assert run(spark, chain + apart) == brute(chain + apart)


def test_edge_rows(spark):
    docs = [(5, None), (4, ""), (3, " \n\t"), (2, "a"), (7, "A"), (8, "a b c d"), (9, "a b c d e"), (10, "É x"), (11, "é x"), (1, "z " * 30_000), (12, "z " * 20_000)]
    assert run(spark, docs) == brute(docs)
    df = spark.createDataFrame([(1, "p q r s t u"), (1, "p q r s t u"), (None, "p q r s t u"), (3, "p q r s t u")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in nj.jaccard_components(df).collect()), key=repr)
    assert got == [(1, 1), (1, 1), (3, 1), (None, None)]
    assert nj.jaccard_components(df.limit(0)).count() == 0


def test_prefix_tree_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(60):
        base = np.unique(rng.integers(-500, 500, rng.integers(1, 200)))
        sets = [(k, np.unique(np.concatenate([rng.choice(base, max(1, len(base) - rng.integers(0, 8)), False), rng.integers(-500, 500, rng.integers(0, 12))]))) for k in range(30)]
        query = np.unique(rng.choice(base, max(1, len(base) - 2), False))
        truth = [k for k, s in sets if 100 * (o := len(np.intersect1d(s, query))) >= 75 * (len(s) + len(query) - o)]
        assert sorted(nj.PrefixTree(sets).links(query, stretch=7)) == truth


def test_groups_are_tied_with_few_walks(monkeypatch):
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(-9999, 9999, 300))

    def copies(source, n, lost):
        return [np.unique(np.append(np.delete(source, rng.choice(len(source), lost, False)), rng.integers(10**6, 10**9, 3))) for _ in range(n)]

    # A large component, three sets that link to it or to each other, and two that reach no other.
    sets = copies(base, 60, 5) + copies(base, 3, 15) + copies(np.append(base[:150], np.arange(20_000, 20_150)), 2, 4)
    labels = [0] * 60 + [60, 61, 62, 63, 64]
    walks, found, links = [], [], nj.PrefixTree.links

    def counted(tree, *args):
        walks.append(1)
        for k in links(tree, *args):
            found.append(k)
            yield k

    monkeypatch.setattr(nj.PrefixTree, "links", counted)
    got = nj.tied([(k, label, s) for k, (label, s) in enumerate(zip(labels, sets, strict=True))])
    parent = list(range(65))
    for a, b in got:
        a, b = labels[a], labels[b]
        parent = [parent[a] if p == parent[b] else p for p in parent]
    truth = list(range(65))
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(s, sets[j]))
            if labels[i] != labels[j] and 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                truth = [truth[labels[i]] if p == truth[labels[j]] else p for p in truth]
    distinct = sorted(set(labels))
    same = [[x[i] == x[j] for i in distinct for j in distinct] for x in (parent, truth)]
    assert same[0] == same[1] and len(got) == len(distinct) - len({truth[i] for i in distinct})
    assert len(walks) <= 5 and len(found) == len(got)  # not 65 walks that find all pairs


def test_sets_of_a_batch_are_those_of_its_texts():
    rng = random.Random(3)
    words = ["a", "A", "b", "\0", "a\0", "é", "É", "\x1c", "12345678", "123456789", "1234567890123456", "12345678901234567", "x" * 64, "x" * 65, "X" * 200, ""]
    texts = [None, "", " ", "\n\t", "a"] + ["".join(rng.choice(words) + rng.choice([" ", "\n", "\v", "  ", "\t", "\f", "\r"]) for _ in range(rng.randint(0, 14))).strip(rng.choice([" ", "\n "])) for _ in range(800)] + [None, ""]
    whole = pa.array(texts)
    for batch in (whole, whole.slice(7, 300), whole.cast(pa.large_string()), pa.array([None, ""], pa.string()), whole.slice(0, 0)):
        values, places = nj.shingle_sets(batch)
        of = {}
        for t, a, b in zip(batch.to_pylist(), places[:-1], places[1:], strict=True):
            w = (t or "").encode().lower().split()
            truth = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
            own = values[a:b].tolist()
            assert own == sorted(set(own)) and len(own) == len(truth)
            assert own == nj.shingle_sets(pa.array([t], pa.string()))[0].tolist()
            of.setdefault(frozenset(truth), set()).add(tuple(own))
        assert all(len(x) == 1 for x in of.values()) and len({next(iter(x)) for x in of.values()}) == len(of)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op8_ngram_jaccard_join"](spark, "/root/testdata/sf0.01").collect()))
    assert got == brute(docs)
