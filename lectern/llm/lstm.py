"""A bidirectional LSTM over sequences of hashed feature bags, in numpy: inference, and training by Adam."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init(buckets: int, width: int, hidden: int, out: int, seed: int) -> Params:
    r = np.random.default_rng(seed)
    p = {"E": r.normal(0, 0.3, (buckets, width))}
    for d in "fb":
        p["W" + d] = r.normal(0, (width + hidden) ** -0.5, (width + hidden, 4 * hidden))
        p["c" + d] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]  # in, forget, cell, out
    p["V"] = r.normal(0, (2 * hidden + width) ** -0.5, (2 * hidden + width, out))
    p["v"] = np.zeros(out)
    return {k: x.astype(np.float32) for k, x in p.items()}


def bags(p: Params, features: list[np.ndarray]) -> np.ndarray:
    """Sum of the embeddings of each bag over the fourth root of its size: one sign among many words keeps its weight."""
    n = np.array([len(f) for f in features])
    flat = np.concatenate(features)
    sums = np.add.reduceat(p["E"][flat], np.r_[0, np.cumsum(n)[:-1]], axis=0)
    return sums / (n**0.25).astype(sums.dtype)[:, None]


def _run(x: np.ndarray, mask: np.ndarray, W: np.ndarray, c: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """x (time, rows, width); padding keeps the state."""
    T, B, _ = x.shape
    H = W.shape[1] // 4
    h = s = np.zeros((B, H), np.float32)
    out, trace = np.zeros((T, B, H), np.float32), []
    for t in range(T):
        z = np.concatenate([x[t], h], 1)
        a = z @ W + c
        i, f, o = _sigmoid(a[:, :H]), _sigmoid(a[:, H : 2 * H]), _sigmoid(a[:, 3 * H :])
        g = np.tanh(a[:, 2 * H : 3 * H])
        s2 = f * s + i * g
        m = mask[t][:, None]
        tanh = np.tanh(s2)
        if keep:
            trace.append((z, i, f, g, o, s, tanh, m))
        s = np.where(m, s2, s)
        h = np.where(m, o * tanh, h)
        out[t] = h
    return out, trace


def _back(d_out: np.ndarray, trace: list, W: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    T, B, H = d_out.shape
    dW, dc, dx = np.zeros_like(W), np.zeros(4 * H, np.float32), np.zeros((T, B, width), np.float32)
    dh = ds = np.zeros((B, H), np.float32)
    for t in range(T - 1, -1, -1):
        z, i, f, g, o, s, tanh, m = trace[t]
        dh = dh + d_out[t]
        d = np.where(m, ds + dh * o * (1 - tanh * tanh), 0)
        da = np.concatenate([d * g * i * (1 - i), d * s * f * (1 - f), d * i * (1 - g * g), np.where(m, dh, 0) * tanh * o * (1 - o)], 1)
        dz = da @ W.T
        dW += z.T @ da
        dc += da.sum(0)
        dx[t] = dz[:, :width]
        dh = np.where(m, dz[:, width:], dh)
        ds = np.where(m, d * f, ds)
    return dx, dW, dc


def forward(p: Params, docs: list[list[np.ndarray]], keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Logits (blocks, out) of all blocks of the documents, in order."""
    lengths = np.array([len(d) for d in docs])
    x = bags(p, [f for d in docs for f in d])
    T, B = lengths.max(), len(docs)
    row = np.repeat(np.arange(B), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grid = np.zeros((T, B, x.shape[1]), np.float32)
    grid[at, row] = x
    mask = np.arange(T)[:, None] < lengths
    hf, tf = _run(grid, mask, p["Wf"], p["cf"], keep)
    hb, tb = _run(grid[::-1], mask[::-1], p["Wb"], p["cb"], keep)
    z = np.concatenate([hf[at, row], hb[::-1][at, row], x], 1)
    return z @ p["V"] + p["v"], (z, at, row, grid.shape, tf, tb)


def gradients(p: Params, docs: list[list[np.ndarray]], loss) -> tuple[float, Params]:
    """loss: logits -> (loss, gradient of the logits)."""
    logits, (z, at, row, shape, tf, tb) = forward(p, docs, True)
    value, d = loss(logits)
    H, width = p["Wf"].shape[1] // 4, shape[2]
    g = {"V": z.T @ d, "v": d.sum(0)}
    dz = d @ p["V"].T
    df, db = np.zeros((*shape[:2], H), np.float32), np.zeros((*shape[:2], H), np.float32)
    df[at, row], db[at, row] = dz[:, :H], dz[:, H : 2 * H]
    dxf, g["Wf"], g["cf"] = _back(df, tf, p["Wf"], width)
    dxb, g["Wb"], g["cb"] = _back(db[::-1], tb, p["Wb"], width)
    dx = (dxf + dxb[::-1])[at, row] + dz[:, 2 * H :]
    features = [f for doc in docs for f in doc]
    n = np.array([len(f) for f in features])
    g["E"] = np.zeros_like(p["E"])
    flat = np.concatenate(features)
    order = np.argsort(flat, kind="stable")
    at = flat[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    g["E"][at[starts]] = np.add.reduceat(np.repeat(dx / (n**0.25).astype(dx.dtype)[:, None], n, axis=0)[order], starts, axis=0)
    return value, g


def train(p: Params, docs: list[list[np.ndarray]], targets: list[np.ndarray], loss, epochs: int, rows: int, rate: float, seed: int) -> Params:
    """loss: (logits, targets) -> (loss, gradient). Documents of like length go together; the rate falls linearly to a thirtieth."""
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(x) for k, x in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
    batches = [order[i : i + rows] for i in range(0, len(order), rows)]
    step = 0
    for epoch in range(epochs):
        for b in r.permutation(len(batches)):
            own = batches[b]
            y = np.concatenate([targets[i] for i in own])
            _, g = gradients(p, [docs[i] for i in own], lambda logits: loss(logits, y))
            norm = np.sqrt(sum((x * x).sum() for x in g.values()))
            step += 1
            for k in p:
                x = g[k] * min(1, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                p[k] = p[k] - rate * (1 - 0.97 * epoch / max(1, epochs - 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return p
