"""Small recurrent networks in numpy: a GRU and an LSTM layer in both directions, attention pooling, Adam.

Sequences are arrays of (time, batch, features) with a mask of (time, batch, 1); padded steps hold the state at zero.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Weights = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def glorot(rng: np.random.Generator, rows: int, columns: int) -> np.ndarray:
    return (rng.standard_normal((rows, columns)) * np.sqrt(2 / (rows + columns))).astype(np.float32)


def gru(projected: np.ndarray, u: np.ndarray, mask: np.ndarray, backwards: bool, trace: list | None = None) -> np.ndarray:
    """States of a GRU whose input is already projected to its three gates (update, reset, candidate)."""
    steps, batch, size = len(projected), projected.shape[1], u.shape[0]
    h, out = np.zeros((batch, size), projected.dtype), np.empty((steps, batch, size), projected.dtype)
    for t in range(steps - 1, -1, -1) if backwards else range(steps):
        x, hu = projected[t], h @ u
        gates = sigmoid(x[:, : 2 * size] + hu[:, : 2 * size])
        z, r = gates[:, :size], gates[:, size:]
        n = np.tanh(x[:, 2 * size :] + r * hu[:, 2 * size :])
        new = (n + z * (h - n)) * mask[t]
        if trace is not None:
            trace.append((t, h, z, r, n, hu))
        h = out[t] = new
    return out


def gru_back(grad: np.ndarray, u: np.ndarray, mask: np.ndarray, trace: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected input and of ``u``."""
    steps, batch, size = grad.shape
    into, du, dh = np.zeros((steps, batch, 3 * size), grad.dtype), np.zeros_like(u), np.zeros((batch, size), grad.dtype)
    for t, h, z, r, n, hu in reversed(trace):
        d = (dh + grad[t]) * mask[t]
        dn, dz, dh = d * (1 - z) * (1 - n * n), d * (h - n) * z * (1 - z), d * z
        dr = dn * hu[:, 2 * size :] * r * (1 - r)
        into[t] = np.concatenate([dz, dr, dn], 1)
        dhu = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ dhu
        dh = dh + dhu @ u.T
    return into, du


def lstm(projected: np.ndarray, u: np.ndarray, mask: np.ndarray, backwards: bool, trace: list | None = None) -> np.ndarray:
    """States of an LSTM whose input is already projected to its four gates (input, forget, output, candidate)."""
    steps, batch, size = len(projected), projected.shape[1], u.shape[0]
    h, c = np.zeros((2, batch, size), projected.dtype)
    out = np.empty((steps, batch, size), projected.dtype)
    for t in range(steps - 1, -1, -1) if backwards else range(steps):
        a = projected[t] + h @ u
        gates, g = sigmoid(a[:, : 3 * size]), np.tanh(a[:, 3 * size :])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        kept = (f * c + i * g) * mask[t]
        squashed = np.tanh(kept)
        new = o * squashed * mask[t]
        if trace is not None:
            trace.append((t, h, c, i, f, o, g, squashed))
        h = out[t] = new
        c = kept
    return out


def lstm_back(grad: np.ndarray, u: np.ndarray, mask: np.ndarray, trace: list) -> tuple[np.ndarray, np.ndarray]:
    steps, batch, size = grad.shape
    into, du = np.zeros((steps, batch, 4 * size), grad.dtype), np.zeros_like(u)
    dh, dc = np.zeros((2, batch, size), grad.dtype)
    for t, h, c, i, f, o, g, squashed in reversed(trace):
        d = (dh + grad[t]) * mask[t]
        dk = (dc + d * o * (1 - squashed * squashed)) * mask[t]
        a = np.concatenate([dk * g * i * (1 - i), dk * c * f * (1 - f), d * squashed * o * (1 - o), dk * i * (1 - g * g)], 1)
        into[t] = a
        du += h.T @ a
        dh, dc = a @ u.T, dk * f
    return into, du


def attention(states: np.ndarray, mask: np.ndarray, w: Weights) -> tuple[np.ndarray, tuple]:
    """Weighted mean of the states over time; the weights come from a small tanh layer."""
    hidden = np.tanh(states @ w["att_w"] + w["att_b"])
    score = (hidden @ w["att_v"])[..., None] + (mask - 1) * 1e4
    score = np.exp(score - score.max(0)) * mask
    alpha = score / np.maximum(score.sum(0), 1e-9)
    return (alpha * states).sum(0), (states, hidden, alpha)


def attention_back(grad: np.ndarray, kept: tuple, w: Weights, into: Weights) -> np.ndarray:
    states, hidden, alpha = kept
    dalpha = (grad * states).sum(-1, keepdims=True)
    dscore = alpha * (dalpha - (alpha * dalpha).sum(0))
    dhidden = dscore * w["att_v"] * (1 - hidden * hidden)
    into["att_v"] = (dscore * hidden).sum((0, 1))
    into["att_w"] = np.tensordot(states, dhidden, ((0, 1), (0, 1)))
    into["att_b"] = dhidden.sum((0, 1))
    return alpha * grad + dhidden @ w["att_w"].T


def adam(weights: Weights, batches: Callable[[int], list], gradients: Callable[[Weights, tuple], Weights], epochs: int, rate: float = 0.01) -> Weights:
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    step = 0
    for epoch in range(epochs):
        for batch in batches(epoch):
            step += 1
            for k, g in gradients(weights, batch).items():
                g = np.clip(g, -1, 1)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                weights[k] = (weights[k] - move).astype(np.float32)
    return weights
