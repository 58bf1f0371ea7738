"""Boosting, forests and networks against plain versions, and the walk over blocks."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawloom.operators import ensembles as en
from drawloom.operators import learn

RNG = np.random.default_rng(11)


def table(n=600):
    x = np.column_stack([RNG.integers(0, 9, n), RNG.integers(0, 2, n), RNG.integers(0, 40, n) / 7]).astype(float)
    y = (RNG.random(n) < en.sigmoid(0.6 * x[:, 0] - 2 + x[:, 1] - 0.3 * x[:, 2])).astype(float)
    return x, y


def plain_boosting(x, y, targets, leaves, rate, trees):
    """Every cut between two values is tried on the rows themselves; the best leaf splits first."""
    margin, out = np.full(len(x), np.log(y.mean() / (1 - y.mean()))), np.full(len(targets), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = en.sigmoid(margin)
        g, h = p - y, p * (1 - p)

        def best(rows, g=g, h=h):
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
            found = (0.0, None, None)
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(len(a), len(b)) >= 47 and (gain := score(a) + score(b) - score(rows)) > found[0] + 1e-12:
                        found = (gain, f, cut)
            return found

        parts = [(np.arange(len(x)), np.arange(len(targets)))]
        while len(parts) < leaves:
            cuts = [best(r) for r, _ in parts]
            k = max(range(len(parts)), key=lambda i: cuts[i][0])
            if cuts[k][0] <= 0:
                break
            (rows, wanted), (_, f, cut) = parts.pop(k), cuts[k]
            a, b = x[rows, f] <= cut, targets[wanted, f] <= cut
            parts += [(rows[a], wanted[b]), (rows[~a], wanted[~b])]
        for rows, wanted in parts:
            value = -rate * g[rows].sum() / (h[rows].sum() + 1)
            margin[rows] += value
            out[wanted] += value
    return en.sigmoid(out)


@pytest.mark.parametrize(("leaves", "rate"), [(3, 0.1), (7, 0.03), (15, 0.1)])
def test_boosting_equals_plain_search(leaves, rate):
    x, y = table()
    targets, _ = table(80)
    got, _ = en.boosting(x, y, targets, {"max_leaf_nodes": leaves, "learning_rate": rate, "trees": 6}, None)
    assert got == pytest.approx(plain_boosting(x, y, targets, leaves, rate, 6), abs=1e-9)


def test_many_values_share_bins():
    x = RNG.normal(size=(3000, 1))
    edges = en.bin_edges(x, 16)
    counts = np.bincount(en.binned(x, edges)[:, 0])
    assert len(edges[0]) == 15 and counts.max() < 1.2 * counts.min()


def test_forest_keeps_depth_and_leaf_size():
    x, y = table(900)
    codes = en.binned(x, en.bin_edges(x))
    nodes = en.grow(codes, en.Histograms(codes), np.arange(900), -y, np.ones(900), 2**4, 4, 50, 0.0, lambda: np.array([0, 2]))
    values = en.tree_values(nodes, codes)
    sizes = {v: (values == v).sum() for v in np.unique(values)}
    assert all(n[0] in (-1, 0, 2) for n in nodes) and 2 <= len(sizes) <= 16 and min(sizes.values()) >= 50
    assert all(values[values == v].mean() == pytest.approx(y[values == v].mean()) for v in sizes)
    p, _ = en.forest(x, y, x, {"max_depth": 4, "min_samples_leaf": 50}, np.random.default_rng(1))
    assert p[y == 1].mean() > p[y == 0].mean() + 0.1


def test_network_gradient_and_decay():
    x, y = table(200)
    z, hidden = (x - x.mean(0)) / x.std(0), 5
    w = RNG.normal(size=(z.shape[1] + 2) * hidden + 1)
    loss, gradient = en.network_loss(w, z, y, hidden, 0.3)
    for k in RNG.choice(len(w), 12, replace=False):
        step = np.zeros(len(w))
        step[k] = 1e-6
        assert (en.network_loss(w + step, z, y, hidden, 0.3)[0] - en.network_loss(w - step, z, y, hidden, 0.3)[0]) / 2e-6 == pytest.approx(gradient[k], abs=1e-6)
    fits = {a: en.network(x, y, x, {"hidden": 8, "alpha": a, "steps": 400}, np.random.default_rng(3))[0] for a in (0.001, 5.0, 1e6)}
    assert np.std(fits[0.001]) > np.std(fits[5.0]) > np.std(fits[1e6]) and np.std(fits[1e6]) < 1e-3
    assert fits[1e6].mean() == pytest.approx(y.mean(), abs=1e-3)


def features_frame(spark, flip_after=None, constant=None):
    rng = np.random.default_rng(2)
    rows = []
    for game, begin in (("A", 60), ("B", 70)):
        for k in range(100):
            day = date(2020, 1, 1) + timedelta(days=7 * k)
            for number in range(1, 8):
                hit, x = int(rng.random() < 0.4), float(rng.integers(0, 6))
                hit = 1 - hit if flip_after is not None and k >= flip_after else hit
                hit = 1 if constant == game else hit
                rows.append((game, "r", day, k, number, hit, day - timedelta(days=7), begin, x + hit * (number % 2), float(number)))
    return spark.createDataFrame(rows, "game string, rule_code string, draw_date date, draw_idx int, number int, hit int, max_input_date date, begin int, x double, z double")


def test_walk_uses_earlier_draws_only(spark):
    grid = [("boosting", {"max_leaf_nodes": 3.0, "learning_rate": 0.1, "trees": 5.0}), ("forest", {"max_depth": 4.0, "min_samples_leaf": 50.0, "trees": 5.0}), ("mlp", {"hidden": 8.0, "alpha": 0.1, "steps": 20.0})]

    def walk(**change):
        rows = features_frame(spark, **change)
        got = en.walk_forward(rows, grid, "begin", block=10, warmup=5, columns=["x", "z"], shares=3)
        return {(r.game, r.family, r.draw_idx, r.number): r for r in got.collect()}

    base, changed = walk(), walk(flip_after=80)
    assert len(base) == 3 * 7 * (40 + 30)
    assert all(base[k].probability == changed[k].probability for k in base if k[2] < 80 and base[k].block_start + 10 <= 80)
    assert any(base[k].probability != changed[k].probability for k in base if base[k].block_start >= 90)
    assert {(k[0], r.block_start) for k, r in base.items()} == {("A", b) for b in (60, 70, 80, 90)} | {("B", b) for b in (70, 80, 90)}
    assert not [r for r in base.values() if r.max_input_date >= r.draw_date or r.block_start > r.draw_idx]
    walked = en.walk_forward(features_frame(spark), grid[:1], "begin", block=10, warmup=5, columns=["x"])
    assert learn.leaked_targets(walked).isEmpty() and learn.leaked_targets(walked.withColumn("block_start", F.col("block_start") + 5)).count() == 7 * 35
    refused = walk(constant="A")
    assert {r.refused for k, r in refused.items() if k[0] == "A"} == {"one_class"} and {r.probability for k, r in refused.items() if k[0] == "A"} == {None}
    assert {r.refused for k, r in refused.items() if k[0] == "B"} == {None}


def test_settings_of_each_series(spark):
    rows = features_frame(spark)
    chosen = spark.createDataFrame([("A", "r", "mlp", "mlp-a", {"hidden": 4.0, "alpha": 0.1, "steps": 5.0}), ("B", "r", "forest", "forest-b", {"max_depth": 2.0, "min_samples_leaf": 20.0, "trees": 3.0})], "game string, rule_code string, family string, setting string, params map<string,double>")
    got = en.walk_forward(rows, chosen, "begin", block=20, warmup=5, columns=["x"])
    assert {(r.game, r.setting) for r in got.select("game", "setting").distinct().collect()} == {("A", "mlp-a"), ("B", "forest-b")}
    assert got.filter(F.col("probability").isNull()).isEmpty()
