"""Boosted trees, forests and networks, fitted walk-forward for every series, setting and block in one pass.

A series has one draw a day at most, so the rows that one model may see are bounded by the calendar; what grows with the
data is the number of series. So Spark groups the rows by (series, setting, share of the blocks), and each group fits its
blocks one after another: rows travel once for each setting, not once for each block, and there is no driver loop.

Trees work on histograms: features are cut to at most ``BINS`` bins at quantiles of the training rows, gradient sums per
bin give the best split, and of two children only the smaller one is summed. Boosting grows the leaf with the greatest
gain first; a forest grows all nodes to a depth, on resampled rows and a few features drawn for each node. The network has
one hidden layer of rectifiers, standardised inputs and weight decay, and takes quasi-Newton steps on all rows.

Random choices come from a hash of setting, series and block, so reruns agree. A model that may not be fitted (no rows,
one class, values that are not finite) gives null probabilities and says why in ``refused``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.operators.features import FEATURE_COLUMNS, SERIES

BINS = 255
# What the families of the study share beyond their grids.
TREES, LEAST_IN_LEAF, PENALTY, LEAST_HESSIAN, NETWORK_STEPS = 100, 47, 1.0, 1e-3, 60


# --- trees -------------------------------------------------------------------------------


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Inner edges of each column's bins: between its values if they are few, else at its quantiles."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        if len(values) <= bins:
            edges.append((values[1:] + values[:-1]) / 2)
        else:
            edges.append(np.unique(np.percentile(column, np.linspace(0, 100, bins + 1)[1:-1], method="midpoint")))
    return edges


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1).astype(np.int32)


class Histograms:
    """Sums of gradients, curvatures and rows per (feature, bin)."""

    def __init__(self, codes: np.ndarray):
        self.width = int(codes.max(initial=0)) + 1
        self.features = codes.shape[1]
        self.flat = codes + self.width * np.arange(self.features, dtype=np.int32)

    def of(self, rows: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
        at, size = self.flat[rows].ravel(), self.width * self.features
        sums = [np.bincount(at, np.repeat(v[rows], self.features), size) for v in (gradient, curvature)]
        return np.stack([*sums, np.bincount(at, minlength=size)]).reshape(3, self.features, self.width)


def best_split(sums: np.ndarray, least: int, penalty: float, features: np.ndarray | None = None) -> tuple[float, int, int]:
    """(gain, feature, last bin on the left) of a node's histograms; a gain of 0 means no split."""
    left = np.cumsum(sums, 2)[:, :, :-1]
    total = sums.sum(2)[:, :, None]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / (left[1] + penalty) + right[0] ** 2 / (right[1] + penalty) - total[0] ** 2 / (total[1] + penalty)
    allowed = (left[2] >= least) & (right[2] >= least) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
    if features is not None:
        allowed[np.setdiff1d(np.arange(len(allowed)), features)] = False
    gain = np.where(allowed, gain, 0.0)
    if not gain.size:
        return 0.0, 0, 0
    at = int(np.argmax(gain))
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def grow(codes: np.ndarray, histograms: Histograms, rows: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, leaves: int, depth: int, least: int, penalty: float, draw=None) -> list[tuple]:
    """A tree as nodes (feature, bin, left, right, value). The leaf with the greatest gain splits first.

    ``draw`` gives the features that a node may use; without it all.
    """
    nodes: list[tuple] = []

    def leaf(rows: np.ndarray, sums: np.ndarray, level: int) -> tuple:
        gain, feature, cut = best_split(sums, least, penalty, draw() if draw else None) if level < depth else (0.0, 0, 0)
        whole = sums[:, 0].sum(1)
        nodes.append((-1, 0, 0, 0, -whole[0] / (whole[1] + penalty)))
        return (gain, len(nodes) - 1, feature, cut, rows, sums, level)

    open_ = [leaf(rows, histograms.of(rows, gradient, curvature), 0)]
    made = 1
    while made < leaves:
        best = max(range(len(open_)), key=lambda i: (open_[i][0], -open_[i][1]), default=None)
        if best is None or open_[best][0] <= 0:
            break
        _, node, feature, cut, inside, sums, level = open_.pop(best)
        goes = codes[inside, feature] <= cut
        parts = inside[goes], inside[~goes]
        small = int(len(parts[1]) < len(parts[0]))
        small_sums = histograms.of(parts[small], gradient, curvature)
        both = (sums - small_sums, small_sums) if small else (small_sums, sums - small_sums)
        children = [leaf(p, s, level + 1) for p, s in zip(parts, both, strict=True)]
        nodes[node] = (feature, cut, children[0][1], children[1][1], nodes[node][4])
        open_ += children
        made += 1
    return nodes


def tree_values(nodes: list[tuple], codes: np.ndarray) -> np.ndarray:
    feature, cut, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
    at = np.zeros(len(codes), np.int64)
    while (inner := feature[at] >= 0).any():
        rows = np.flatnonzero(inner)
        here = at[rows]
        goes = codes[rows, feature[here]] <= cut[here]
        at[rows] = np.where(goes, left[here], right[here])
    return value[at]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def boosting(x: np.ndarray, y: np.ndarray, targets: np.ndarray, params: dict, rng: np.random.Generator) -> tuple[np.ndarray, bool]:
    """Probabilities of ``targets`` by gradient boosting on the logistic loss."""
    edges = bin_edges(x)
    codes, wanted = binned(x, edges), binned(targets, edges)
    histograms, every, rate = Histograms(codes), np.arange(len(x)), params["learning_rate"]
    start = np.log(y.mean() / (1 - y.mean()))
    margin, out = np.full(len(x), start), np.full(len(targets), start)
    for _ in range(int(params.get("trees", TREES))):
        p = sigmoid(margin)
        tree = grow(codes, histograms, every, p - y, p * (1 - p), int(params["max_leaf_nodes"]), len(x), LEAST_IN_LEAF, PENALTY)
        margin += rate * tree_values(tree, codes)
        out += rate * tree_values(tree, wanted)
    return sigmoid(out), True


def forest(x: np.ndarray, y: np.ndarray, targets: np.ndarray, params: dict, rng: np.random.Generator) -> tuple[np.ndarray, bool]:
    """Mean class shares of trees on resampled rows. With unit curvature the gain is the loss of variance."""
    edges = bin_edges(x)
    codes, wanted = binned(x, edges), binned(targets, edges)
    histograms, few = Histograms(codes), max(1, int(np.sqrt(x.shape[1])))
    depth, trees = int(params["max_depth"]), int(params.get("trees", TREES))
    total = np.zeros(len(targets))
    for _ in range(trees):
        rows = np.sort(rng.integers(0, len(x), len(x)))
        nodes = grow(codes, histograms, rows, -y, np.ones(len(x)), 2**depth, depth, int(params["min_samples_leaf"]), 0.0, lambda: rng.choice(x.shape[1], few, replace=False))
        total += tree_values(nodes, wanted)
    return np.clip(total / trees, 0.0, 1.0), True


# --- network -----------------------------------------------------------------------------


def network_loss(w: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int, alpha: float) -> tuple[float, np.ndarray]:
    """Mean log loss plus ``alpha / 2`` times the squared weights a row, and its gradient. Biases are not decayed."""
    n, k = x.shape
    w1, b1 = w[: k * hidden].reshape(k, hidden), w[k * hidden : (k + 1) * hidden]
    w2, b2 = w[(k + 1) * hidden : -1], w[-1]
    inner = np.maximum(x @ w1 + b1, 0)
    margin = inner @ w2 + b2
    loss = np.mean(np.logaddexp(0, margin) - y * margin) + alpha / (2 * n) * ((w1**2).sum() + (w2**2).sum())
    off = (sigmoid(margin) - y) / n
    back = np.outer(off, w2) * (inner > 0)
    return float(loss), np.concatenate([(x.T @ back + alpha / n * w1).ravel(), back.sum(0), inner.T @ off + alpha / n * w2, [off.sum()]])


def quasi_newton(function, w: np.ndarray, steps: int, memory: int = 10, tolerance: float = 1e-5) -> tuple[np.ndarray, bool]:
    """Limited-memory quasi-Newton descent with step halving."""
    loss, gradient = function(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(gradient).max() <= tolerance:
            return w, True
        direction, kept = gradient.copy(), []
        for s, g in reversed(pairs):
            a = s @ direction / (s @ g)
            kept.append(a)
            direction -= a * g
        if pairs:
            s, g = pairs[-1]
            direction *= (s @ g) / (g @ g)
        for (s, g), a in zip(pairs, reversed(kept), strict=True):
            direction += (a - g @ direction / (s @ g)) * s
        slope = gradient @ direction
        if slope <= 0:
            direction, slope, pairs = gradient, gradient @ gradient, []
        step = 1.0 if pairs else min(1.0, 1.0 / np.abs(gradient).sum())
        while True:
            moved = w - step * direction
            new_loss, new_gradient = function(moved)
            if new_loss <= loss - 1e-4 * step * slope:
                break
            step /= 2
            if step < 1e-12:
                return w, bool(np.abs(gradient).max() <= tolerance)
        s, g = moved - w, new_gradient - gradient
        if s @ g > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, g)]
        w, loss, gradient = moved, new_loss, new_gradient
    return w, bool(np.abs(gradient).max() <= tolerance)


def network(x: np.ndarray, y: np.ndarray, targets: np.ndarray, params: dict, rng: np.random.Generator) -> tuple[np.ndarray, bool]:
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z, wanted, hidden, k = (x - mean) / scale, (targets - mean) / scale, int(params["hidden"]), x.shape[1]
    bounds = np.sqrt(6 / (k + hidden)), np.sqrt(6 / (hidden + 1))
    start = np.concatenate([rng.uniform(-bounds[0], bounds[0], (k + 1) * hidden), rng.uniform(-bounds[1], bounds[1], hidden + 1)])
    w, converged = quasi_newton(lambda w: network_loss(w, z, y, hidden, params["alpha"]), start, int(params.get("steps", NETWORK_STEPS)))
    inner = np.maximum(wanted @ w[: k * hidden].reshape(k, hidden) + w[k * hidden : (k + 1) * hidden], 0)
    return sigmoid(inner @ w[(k + 1) * hidden : -1] + w[-1]), converged


FITS = {"boosting": boosting, "forest": forest, "mlp": network}


# --- all series, settings and blocks -----------------------------------------------------


def seed_of(*parts: object) -> np.random.Generator:
    return np.random.default_rng(int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16], 16))


def setting_id(family: str, params: dict[str, float]) -> str:
    return family + "-" + "-".join(f"{k}{params[k]:g}" for k in sorted(params))


def walk_forward(features: DataFrame, settings: list[tuple[str, dict]] | DataFrame, start: str, end: str | None = None, block: int = 25, warmup: int = 150, window: int | None = None, columns=FEATURE_COLUMNS, shares: int = 4) -> DataFrame:
    """Probabilities of every target from the series' ``start`` (to before its ``end``), by models of earlier draws only.

    ``settings`` is a list of (family, params), or a table (series columns, family, setting, params) with those of each
    series. ``start`` and ``end`` name columns of ``features`` with draw positions. The blocks of a series and setting
    are dealt to ``shares`` groups. Returns the target rows with family, setting, block_start, probability, converged
    and refused.
    """
    base = [*SERIES, "draw_date", "draw_idx", "number", "hit", "max_input_date"]
    bounds = [F.col(start).cast("int").alias("_start"), (F.col(end) if end else F.lit(None)).cast("int").alias("_end")]
    rows = features.select(*base, *bounds, *(F.col(c).cast("double").alias(c) for c in columns))
    if isinstance(settings, DataFrame):
        rows = rows.join(settings.select(*SERIES, "family", "setting", "params"), SERIES)
    else:
        grid = [F.struct(F.lit(f).alias("family"), F.lit(setting_id(f, p)).alias("setting"), F.create_map(*(F.lit(x) for k, v in p.items() for x in (k, float(v)))).alias("params")) for f, p in settings]
        rows = rows.withColumn("_s", F.explode(F.array(*grid))).select("*", "_s.*").drop("_s")
    dealt = rows.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    names = list(columns)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["draw_idx", "number"], ignore_index=True)
        head = frame.iloc[0]
        family, setting, share = head["family"], head["setting"], int(head["_share"])
        params = dict(head["params"])
        idx = frame["draw_idx"].to_numpy()
        x, y = frame[names].to_numpy(dtype=np.float64), frame["hit"].to_numpy(dtype=np.float64)
        last = idx[-1] + 1 if pd.isna(head["_end"]) else min(int(head["_end"]), idx[-1] + 1)
        parts = []
        for number, first in enumerate(range(int(head["_start"]), last, block)):
            if number % shares != share:
                continue
            low = warmup if window is None else max(warmup, first - window)
            train = (idx >= low) & (idx < first)
            wanted = (idx >= first) & (idx < min(first + block, last))
            part = frame.loc[wanted, base].copy()
            refused = "no_rows" if not train.any() else "not_finite" if not np.isfinite(x[train | wanted]).all() else "one_class" if y[train].min() == y[train].max() else None
            p, converged = (np.nan, None) if refused else FITS[family](x[train], y[train], x[wanted], params, seed_of(setting, *(head[c] for c in SERIES), first))
            part["family"], part["setting"], part["block_start"] = family, setting, first
            part["probability"], part["converged"], part["refused"] = p, converged, refused
            parts.append(part)
        return pd.concat(parts) if parts else pd.DataFrame(columns=out_names)

    kinds = dict(features.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in base) + ", family string, setting string, block_start int, probability double, converged boolean, refused string"
    out_names = [x.split()[0] for x in schema.split(", ")]
    fitted = dealt.groupBy(*SERIES, "family", "setting", "_share").applyInPandas(fit, schema)
    return fitted.withColumn("probability", F.when(F.isnan("probability"), F.lit(None)).otherwise(F.col("probability")))

