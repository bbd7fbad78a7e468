"""A small character convolutional network over candidates and what stands around them.

A window is the bytes left of a candidate, the candidate, and the bytes right of it.  Each
byte is its class (digit, hex letter, ...), its part of the window and a learned vector; a
convolution over ``TAPS`` bytes is pooled over the candidate (maximum and mean) and over its
surroundings (maximum), and a hidden layer gives log-odds.  All in numpy.
"""

from __future__ import annotations

import numpy as np

TAPS, FILTERS, LEARNED, HIDDEN = 5, 24, 8, 16
#: Positions convolved at once.
CHUNK = 1 << 15
#: Windows of a training step.
BATCH = 128
LEFT, INSIDE, RIGHT = 0, 1, 2


def _classes() -> np.ndarray:
    kind = np.full(256, 6)
    kind[0x21:0x80] = 5
    kind[0x61:0x7B], kind[0x41:0x5B], kind[0x30:0x3A] = 2, 3, 0
    kind[0x61:0x67] = 1
    kind[0x80:] = 4
    kind[[0x22, 0x27, 0x3A, 0x3D]] = 7
    return np.eye(8, dtype=np.float32)[kind]


CLASS = _classes()
WIDE = 8 + 3 + LEARNED
SHAPES = {
    "embed": (256, LEARNED), "conv": (TAPS, WIDE, FILTERS), "conv_bias": (FILTERS,),
    "hidden": (3 * FILTERS, HIDDEN), "hidden_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (1,),
}


def fresh(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = {"embed": 0.1, "conv": 1 / np.sqrt(TAPS * 4), "hidden": 1 / np.sqrt(3 * FILTERS), "out": 0.3}
    return {k: rng.normal(0, scale.get(k, 0.0), s).astype(np.float32) if k in scale else np.zeros(s, np.float32) for k, s in SHAPES.items()}


def _inputs(p: dict, data: np.ndarray, part: np.ndarray) -> np.ndarray:
    """One row a byte; bytes of no part are zero."""
    x = np.concatenate([CLASS[data], np.eye(3, dtype=np.float32)[np.minimum(part, 2)], p["embed"][data]], axis=-1)
    x[part > 2] = 0
    return x


def _top(p: dict, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(pooled @ p["hidden"] + p["hidden_bias"], 0)
    return hidden, hidden @ p["out"] + p["out_bias"][0]


def log_odds(p: dict, windows: list[bytes], left: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Of windows of any length: they are laid end to end, with ``TAPS`` empty bytes
    between, and convolved in chunks."""
    if not windows:
        return np.zeros(0, np.float32)
    size = np.array([len(w) for w in windows], np.int64)
    at = np.cumsum(size + TAPS) - size
    data = np.frombuffer(b"".join(bytes(TAPS) + w for w in windows) + bytes(TAPS), np.uint8)
    owner = np.full(len(data), -1, np.int64)
    part = np.full(len(data), 3, np.int64)
    where = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
    own = np.repeat(np.arange(len(size)), size)
    owner[where] = own
    place = where - at[own]
    part[where] = np.where(place < left[own], LEFT, np.where(place < left[own] + inside[own], INSIDE, RIGHT))
    half = TAPS // 2
    most = np.zeros((2, len(size), FILTERS), np.float32)
    total = np.zeros((len(size), FILTERS), np.float32)
    for first in range(half, len(data) - half, CHUNK):
        last = min(first + CHUNK, len(data) - half)
        x = _inputs(p, data[first - half : last + half], part[first - half : last + half])
        act = sum(x[j : j + last - first] @ p["conv"][j] for j in range(TAPS)) + p["conv_bias"]
        act = np.maximum(act, 0)
        for i, group in enumerate((part[first:last] == INSIDE, (part[first:last] == LEFT) | (part[first:last] == RIGHT))):
            rows, mine = act[group], owner[first:last][group]
            if len(rows):
                begin = np.concatenate([[0], np.flatnonzero(mine[1:] != mine[:-1]) + 1])
                np.maximum.at(most[i], mine[begin], np.maximum.reduceat(rows, begin, axis=0))
                if i == 0:
                    np.add.at(total, mine[begin], np.add.reduceat(rows, begin, axis=0))
    pooled = np.concatenate([most[0], total / np.maximum(inside, 1)[:, None], most[1]], axis=1)
    return _top(p, pooled)[1]


def gradient(p: dict, data: np.ndarray, part: np.ndarray, told: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Weighted log-loss and its gradient for windows as rows of equal width, with half
    a kernel of empty bytes at either end."""
    rows, width = data.shape
    half = TAPS // 2
    x = _inputs(p, data, part)
    n = width - 2 * half
    act = np.maximum(sum(x[:, j : j + n] @ p["conv"][j] for j in range(TAPS)) + p["conv_bias"], 0)
    middle = part[:, half : half + n]
    inside, around = middle == INSIDE, (middle == LEFT) | (middle == RIGHT)
    size = np.maximum(inside.sum(1), 1)[:, None]
    masked = [np.where(m[:, :, None], act, 0) for m in (inside, around)]
    best = [m.argmax(1) for m in masked]
    top = [np.take_along_axis(m, b[:, None], 1)[:, 0] for m, b in zip(masked, best)]
    pooled = np.concatenate([top[0], masked[0].sum(1) / size, top[1]], axis=1)
    hidden, odds = _top(p, pooled)
    loss = float((weight * (np.logaddexp(0, odds) - told * odds)).sum())
    error = (weight * (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - told)).astype(np.float32)
    g = {"out": hidden.T @ error, "out_bias": np.array([error.sum()], np.float32)}
    d_hidden = error[:, None] * p["out"] * (hidden > 0)
    g["hidden"], g["hidden_bias"] = pooled.T @ d_hidden, d_hidden.sum(0)
    d_pooled = d_hidden @ p["hidden"].T
    d_act = np.where(inside[:, :, None], (d_pooled[:, FILTERS : 2 * FILTERS] / size)[:, None], 0).astype(np.float32)
    r, f = np.arange(rows)[:, None], np.arange(FILTERS)[None]
    np.add.at(d_act, (r, best[0], f), d_pooled[:, :FILTERS] * (top[0] > 0))
    np.add.at(d_act, (r, best[1], f), d_pooled[:, 2 * FILTERS :] * (top[1] > 0))
    d_act *= act > 0
    flat = d_act.reshape(-1, FILTERS)
    g["conv"] = np.stack([x[:, j : j + n].reshape(-1, WIDE).T @ flat for j in range(TAPS)])
    g["conv_bias"] = flat.sum(0)
    d_x = np.zeros((rows, width, LEARNED), np.float32)
    for j in range(TAPS):
        d_x[:, j : j + n] += d_act @ p["conv"][j][-LEARNED:].T
    d_x[part > 2] = 0
    g["embed"] = np.stack([np.bincount(data.ravel(), weights=d_x[:, :, k].ravel(), minlength=256) for k in range(LEARNED)], axis=1).astype(np.float32)
    return loss, g


def rows_of(windows: list[bytes], left: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as rows of equal width."""
    half = TAPS // 2
    width = max(len(w) for w in windows) + 2 * half
    data, part = np.zeros((len(windows), width), np.uint8), np.full((len(windows), width), 3)
    for i, (w, a, b) in enumerate(zip(windows, left.tolist(), inside.tolist())):
        data[i, half : half + len(w)] = np.frombuffer(w, np.uint8)
        part[i, half : half + len(w)] = np.repeat([LEFT, INSIDE, RIGHT], [a, b, len(w) - a - b])
    return data, part


def constant(odds: float) -> dict[str, np.ndarray]:
    """A network that gives every window the same log-odds."""
    p = fresh()
    p["out"][:] = 0
    p["out_bias"][:] = odds
    return p


def train(p: dict, windows: list[bytes], left: np.ndarray, inside: np.ndarray, told: np.ndarray, weight: np.ndarray, epochs: int, batch: int = BATCH, rate: float = 0.004) -> dict:
    """``p`` after Adam on the weighted log-loss."""
    p = {k: v.copy() for k, v in p.items()}
    rng = np.random.default_rng(5)
    by_length = np.argsort([len(w) for w in windows], kind="stable")
    lots = [by_length[i : i + batch] for i in range(0, len(by_length), batch)]
    held = {k: (np.zeros(s, np.float32), np.zeros(s, np.float32)) for k, s in SHAPES.items()}
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(lots)):
            lot = lots[i]
            data, part = rows_of([windows[j] for j in lot], left[lot], inside[lot])
            _, g = gradient(p, data, part, told[lot], weight[lot] / len(lot))
            step += 1
            for k, d in g.items():
                d = d + 1e-4 * p[k]
                m, v = held[k]
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p
