"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters with a hashed word vector, the mean vector of its character trigrams, and the log-odds of the word and of
its trigrams in the training rows. The network reads windows of ``WINDOW`` words that overlap by half; the score of a
text is the greatest of its windows. Words depend on their characters only, so their projections to the gates are kept
in a table per worker (up to ``MEMO`` words); the recurrent part runs over blocks of windows.

Training uses at most ``TRAIN_DOCS`` labelled rows of each label (least hashes of doc_id) whose crc32 of the doc_id is
not 2 modulo 4, and of these texts up to ``TRAIN_CHARS``; near copies count once in the log-odds. Scoring covers
all rows and whole texts and sees the text only.

Null and empty texts and texts without words score 0. Repeated rows score alike; without labels of both kinds all score
0; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.llm import nets
from drawloom.llm.common import texts

WINDOW, STRIDE = 32, 16
TRAIN_DOCS, TRAIN_CHARS = 1000, 100_000
THRESHOLD = 0.3
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 6, 6, 8
WORD_BUCKETS, CHAR_BUCKETS = 1 << 13, 1 << 14
MEMO, CHUNK_CHARS, BLOCK = 250_000, 1 << 20, 2048
EPOCHS = 5
_EDGES = ".,;:!?\"'()[]{}<>#*$%&|-_/\\"


def clean(token: str) -> str:
    return token.strip(_EDGES) or token


class Vocabulary:
    """Input features of words: buckets and the log-odds learnt from the training rows."""

    def __init__(self, positive: list[str], negative: list[str]) -> None:
        words, chars = {}, np.zeros((2, CHAR_BUCKETS))
        sizes = []
        for label, side in enumerate((negative, positive)):
            seen = {}
            for text in side:
                own = {clean(w) for w in text.lower().split()}
                if own:
                    seen.setdefault(min(map(_crc, own)), own)  # near copies mostly share the least hash
            for own in seen.values():
                for w in own:
                    words.setdefault(w, [0, 0])[label] += 1
                buckets, _ = self.trigrams(list(own))
                np.add.at(chars[label], np.unique(buckets), 1)
            sizes.append(max(1, len(seen)))
        n, p = sizes
        self.words = {w: _odds(b, p, a, n) for w, (a, b) in words.items() if a + b >= 3}
        self.chars = np.array([_odds(b, p, a, n) for a, b in chars.T], np.float32)

    @staticmethod
    def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all trigrams of ``^word$`` (bytes), and where each word's begin."""
        raw = "".join(f"\x02{w}\x03" for w in words).encode()
        sizes = np.array([len(w.encode()) for w in words])
        a = np.frombuffer(raw, np.uint8).astype(np.uint32)
        mixed = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))
        buckets = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(18)
        ends = np.cumsum(sizes + 2)
        keep = np.ones(len(a), bool)
        keep[ends - 1] = keep[ends - 2] = False
        return buckets[keep[: len(buckets)]].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def features(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets, trigram buckets, their starts, and two numbers a word."""
        words = [clean(t) for t in tokens]
        buckets, starts = self.trigrams(words)
        counts = np.diff(np.append(starts, len(buckets)))
        chars = np.add.reduceat(self.chars[buckets], starts) / np.maximum(counts, 1)
        known = np.array([self.words.get(w, 0.0) for w in words], np.float32)
        return np.array([_crc(w) % WORD_BUCKETS for w in words]), buckets, starts, np.stack([known, chars], 1).astype(np.float32)


def _crc(word: str) -> int:
    return zlib.crc32(word.encode())


def _odds(pos: float, n_pos: int, neg: float, n_neg: int) -> float:
    return float(np.clip(np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2)), -4, 4))


def starting_weights(seed: int = 7) -> nets.Weights:
    rng = np.random.default_rng(seed)
    wide = WORD_DIM + CHAR_DIM + 2
    w = {"word": (rng.standard_normal((WORD_BUCKETS, WORD_DIM)) * 0.1).astype(np.float32), "char": (rng.standard_normal((CHAR_BUCKETS, CHAR_DIM)) * 0.1).astype(np.float32)}
    for side in "fb":
        w[f"{side}_w"], w[f"{side}_b"], w[f"{side}_u"] = nets.glorot(rng, wide, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32), nets.glorot(rng, HIDDEN, 3 * HIDDEN)
    w |= {"att_w": nets.glorot(rng, 2 * HIDDEN, ATTENTION), "att_b": np.zeros(ATTENTION, np.float32), "att_v": nets.glorot(rng, ATTENTION, 1)[:, 0]}
    return w | {"out_w": nets.glorot(rng, 2 * HIDDEN, 1)[:, 0], "out_b": np.full(1, -1.0, np.float32)}


def inputs(w: nets.Weights, features: tuple) -> np.ndarray:
    words, buckets, starts, numbers = features
    counts = np.diff(np.append(starts, len(buckets)))
    chars = np.add.reduceat(w["char"][buckets], starts) / np.maximum(counts, 1)[:, None]
    return np.concatenate([w["word"][words], chars, numbers], 1).astype(np.float32)


def score_windows(w: nets.Weights, forward: np.ndarray, backward: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities of windows of table rows (batch, time); -1 is padding. The tables hold projected words."""
    mask = (rows.T >= 0).astype(np.float32)[..., None]
    at = np.maximum(rows.T, 0)
    states = np.concatenate([nets.gru(forward[at], w["f_u"], mask, False), nets.gru(backward[at], w["b_u"], mask, True)], 2)
    pooled, _ = nets.attention(states, mask, w)
    return nets.sigmoid(pooled @ w["out_w"] + w["out_b"])


def gradients(w: nets.Weights, batch: tuple) -> nets.Weights:
    """Of the mean cross-entropy over windows (features of distinct words, rows, labels)."""
    features, rows, labels = batch
    x = inputs(w, features)
    mask = (rows.T >= 0).astype(np.float32)[..., None]
    at = np.maximum(rows.T, 0)
    seq, traces, states = x[at], ([], []), []
    for side, trace in zip("fb", traces, strict=True):
        states.append(nets.gru(seq @ w[f"{side}_w"] + w[f"{side}_b"], w[f"{side}_u"], mask, side == "b", trace))
    pooled, kept = nets.attention(np.concatenate(states, 2), mask, w)
    off = (nets.sigmoid(pooled @ w["out_w"] + w["out_b"]) - labels).astype(np.float32) / len(labels)
    g: nets.Weights = {"out_w": pooled.T @ off, "out_b": off.sum(keepdims=True)}
    dstates = nets.attention_back(off[:, None] * w["out_w"], kept, w, g)
    dx = np.zeros_like(seq)
    for side, trace, part in zip("fb", traces, (dstates[..., :HIDDEN], dstates[..., HIDDEN:]), strict=True):
        dproj, g[f"{side}_u"] = nets.gru_back(part, w[f"{side}_u"], mask, trace)
        dproj *= mask
        g[f"{side}_w"], g[f"{side}_b"] = np.tensordot(seq, dproj, ((0, 1), (0, 1))), dproj.sum((0, 1))
        dx += dproj @ w[f"{side}_w"].T
    per_word = np.zeros_like(x)
    np.add.at(per_word, at.ravel(), (dx * mask).reshape(-1, x.shape[1]))
    words, buckets, starts, _ = features
    g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
    np.add.at(g["word"], words, per_word[:, :WORD_DIM])
    counts = np.diff(np.append(starts, len(buckets)))
    np.add.at(g["char"], buckets, np.repeat(per_word[:, WORD_DIM : WORD_DIM + CHAR_DIM] / np.maximum(counts, 1)[:, None], counts, 0))
    return g


def cut(n: int) -> np.ndarray:
    """Starts of the overlapping windows over ``n`` words."""
    return np.arange(0, max(1, n - STRIDE), STRIDE)


def window_rows(ids: np.ndarray) -> np.ndarray:
    starts = cut(len(ids))
    padded = np.concatenate([ids, np.full(max(0, starts[-1] + WINDOW - len(ids)), -1, np.int32)])
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts]


class Model:
    def __init__(self, vocabulary: Vocabulary, weights: nets.Weights) -> None:
        self.vocabulary, self.weights = vocabulary, weights

    @classmethod
    def train(cls, positive: list[str], negative: list[str], seed: int = 7) -> Model | None:
        positive, negative = ([t for t in side if t.split()] for side in (positive, negative))
        if not positive or not negative:
            return None
        vocabulary, rng = Vocabulary(positive, negative), np.random.default_rng(seed)
        model = cls(vocabulary, starting_weights(seed))

        def fit(windows: list[list[str]], labels: list[int], epochs: int) -> None:
            order = np.arange(len(windows))

            def batches(epoch: int) -> Iterator[tuple]:
                np.random.default_rng([seed, epoch]).shuffle(order)
                for k in range(0, len(order), 128):
                    part = order[k : k + 128]
                    number: dict[str, int] = {}
                    rows = np.full((len(part), WINDOW), -1)
                    for r, p in enumerate(part):
                        rows[r, : len(windows[p])] = [number.setdefault(t, len(number)) for t in windows[p]]
                    yield vocabulary.features(list(number)), rows, np.array([labels[p] for p in part], np.float32)

            model.weights = nets.adam(model.weights, batches, gradients, epochs)

        def by_odds(tokens: list[str]) -> np.ndarray:
            odds = np.array([vocabulary.words.get(clean(t), 0.0) for t in tokens])
            return np.array([np.sort(odds[k : k + WINDOW])[-3:].sum() for k in cut(len(tokens))])

        def choose(rank) -> tuple[list[list[str]], list[int]]:
            """The first window of each toxic text by ``rank``; the first two and one at random of the others."""
            windows, labels = [], []
            for label, side in ((1, positive), (0, negative)):
                for text in side:
                    tokens = text.lower().split()
                    starts, best = cut(len(tokens)), np.argsort(-rank(tokens), kind="stable")
                    picks = best[:1] if label else {*best[:2].tolist(), int(rng.integers(len(starts)))}
                    windows += [tokens[starts[k] : starts[k] + WINDOW] for k in picks]
                    labels += [label] * len(picks)
            return windows, labels

        fit(*choose(by_odds), EPOCHS)
        scorer = Scorer(model, rows=20_000)
        fit(*choose(scorer.windows), EPOCHS)  # again on the windows that the first fit finds most toxic
        return model


class Scorer:
    """A model with its table of projected words."""

    def __init__(self, model: Model, rows: int = 2 * MEMO) -> None:
        self.model, self.memo = model, {}
        self.forward = np.empty((rows, 3 * HIDDEN), np.float32)
        self.backward = np.empty((rows, 3 * HIDDEN), np.float32)

    def windows(self, tokens: list[str]) -> np.ndarray:
        """Scores of the windows of one text, without the table of words."""
        distinct = list(dict.fromkeys(tokens))
        self.project(distinct, 0)
        number = {t: k for k, t in enumerate(distinct)}
        return score_windows(self.model.weights, self.forward, self.backward, window_rows(np.array([number[t] for t in tokens], np.int32)))

    def project(self, tokens: list[str], at: int) -> None:
        w = self.model.weights
        x = inputs(w, self.model.vocabulary.features(tokens))
        if (most := at + len(tokens)) > len(self.forward):
            self.forward, self.backward = (np.resize(t, (most, 3 * HIDDEN)) for t in (self.forward, self.backward))
        self.forward[at:most], self.backward[at:most] = x @ w["f_w"] + w["f_b"], x @ w["b_w"] + w["b_b"]

    def __call__(self, whole: list[str]) -> list[float]:
        split = [t.lower().split() for t in whole]
        memo = self.memo
        new = list({t for tokens in split for t in tokens if t not in memo})
        known = len(memo)
        local = {t: known + k for k, t in enumerate(new)}
        for k in range(0, len(new), 50_000):
            self.project(new[k : k + 50_000], known + k)
        for t in new[: max(0, MEMO - known)]:
            memo[t] = local[t]
        windows, owner = [], []
        for doc, tokens in enumerate(split):
            if tokens:
                ids = np.array([memo[t] if t in memo else local[t] for t in tokens], np.int32)
                windows.append(window_rows(ids))
                owner.append(np.full(len(windows[-1]), doc))
        score = np.zeros(len(whole), np.float64)
        if windows:
            rows, docs = np.concatenate(windows), np.concatenate(owner)
            for k in range(0, len(rows), BLOCK):
                np.maximum.at(score, docs[k : k + BLOCK], score_windows(self.model.weights, self.forward, self.backward, rows[k : k + BLOCK]))
        return score.tolist()


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train_on(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on the bounded sample; the driver sees its texts only."""
    usable = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).distinct()
    order = F.xxhash64("doc_id")
    sample = [usable.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(TRAIN_DOCS) for k in (0, 1)]
    chosen = F.broadcast(sample[0].unionByName(sample[1]))  # at most 2 * TRAIN_DOCS ids
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").filter(F.char_length("text") <= TRAIN_CHARS)
    once = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # repeated rows count once
    found = sorted((r.doc_id, r.toxic, r.text) for r in once.collect())
    return Model.train(*([t for _, toxic, t in found if toxic == k] for k in (1, 0)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row."""
    scorers: list[Scorer] = []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is not None and not scorers:
            scorers.append(Scorer(model))
        for batch in batches:
            whole, scores, held, size = texts(batch, "text"), [], [], 0
            if model is None:
                scores = [0.0] * len(whole)
            else:
                for k, text in enumerate(whole):
                    held.append(text)
                    size += len(text)
                    if size >= CHUNK_CHARS or k == len(whole) - 1:
                        scores += scorers[0](held)
                        held, size = [], 0
            if whole:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs, train_on(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
