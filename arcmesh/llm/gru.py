"""A gated recurrent language model in numpy: forward, truncated backpropagation, class-factored softmax.

The vocabulary is cut into classes of WIDTH; a token's probability is its class's times its own within
the class. Documents run in parallel lanes; the state is carried from window to window and reset at the
start of a document, so a document's log-likelihood is that of the whole text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

WIDTH = 32
Params = dict[str, np.ndarray]


def new(counts: np.ndarray, hidden: int, seed: int = 11) -> Params:
    """A model that starts as the unigram of `counts` (padded to whole classes)."""
    rng = np.random.default_rng(seed)
    m = len(counts)
    c = m // WIDTH
    logs = np.log(counts + 0.1)
    by_class = np.log(np.exp(logs).reshape(c, WIDTH).sum(axis=1))
    draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    return {"x": draw(m, 3 * hidden), "u": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "wc": draw(hidden, c) * 0, "bc": by_class.astype(np.float32), "ww": draw(m, hidden) * 0, "bw": logs.astype(np.float32)}


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in sorted(p)])


def unflat(v: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def lanes(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, longest first."""
    heap = [(0, i) for i in range(min(width, max(1, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, i = heap[0]
        out[i].append(d)
        heapq.heapreplace(heap, (n + int(lengths[d]), i))
    return sorted(out, key=lambda own: -int(lengths[own].sum()))


def grid(tokens: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their documents by step and lane; a document of -1 is padding."""
    dealt = lanes(np.diff(off), width)
    steps = max(int(sum(off[d + 1] - off[d] for d in own)) for own in dealt)
    tok = np.zeros((steps, len(dealt)), np.int32)
    doc = np.full((steps, len(dealt)), -1, np.int32)
    for i, own in enumerate(dealt):
        at = 0
        for d in own:
            n = int(off[d + 1] - off[d])
            tok[at : at + n, i] = tokens[off[d] : off[d + 1]]
            doc[at : at + n, i] = d
            at += n
    return tok, doc


#: Between rows of windows: rows a power of two apart would share the same few places of the processor's cache.
APART = 48


def _room(space: dict, name: str, rows: int, *shape: int, kind: type = np.float32) -> np.ndarray:
    """An array kept in space for the next window: new pages cost more than what is computed in them."""
    size = int(np.prod(shape))
    if name not in space or len(space[name]) < rows * (size + APART):
        space[name] = np.empty(rows * (size + APART), kind)
    return space[name][: rows * (size + APART)].reshape(rows, size + APART)[:, :size].reshape(rows, *shape)


def _run(p: Params, given: np.ndarray, reset: np.ndarray, h: np.ndarray, space: dict, keep: bool = True) -> tuple[np.ndarray, ...]:
    """Of each step of a window (steps, lanes): the state before (0 where a document starts), gates,
    candidates and the state after, as (features, steps, lanes), so that every operation runs along lanes.
    h: the state to start from (features, lanes). Without keep only the states after are filled."""
    n = p["u"].shape[0]
    u_gates, u_new = -np.ascontiguousarray(p["u"][:, : 2 * n].T), np.ascontiguousarray(p["u"][:, 2 * n :].T)
    table = np.ascontiguousarray((p["x"] + p["b"]).T)
    table[: 2 * n] *= -1  # for the exponentials in the sigmoids
    kind = table.dtype
    x = _room(space, "x", 3 * n, *given.shape, kind=kind)
    to = given.reshape(-1).astype(np.intp)
    for row, out in zip(table, x.reshape(3 * n, -1), strict=True):
        np.take(row, to, out=out, mode="clip")
    before, gates, cand, after = (_room(space, name, k * (keep or name == "after"), *given.shape, kind=kind) for name, k in (("before", n), ("gates", 2 * n), ("cand", n), ("after", n)))
    starts = [np.flatnonzero(r) for r in reset]
    g, c, rh = np.empty((2 * n, given.shape[1]), kind), np.empty((n, given.shape[1]), kind), np.empty((n, given.shape[1]), kind)
    for t in range(len(given)):
        if len(starts[t]):
            h = h.copy()
            h[:, starts[t]] = 0
        if keep:
            before[:, t] = h
            g, c = gates[:, t], cand[:, t]
        np.matmul(u_gates, h, out=g)
        g += x[: 2 * n, t]
        with np.errstate(over="ignore"):  # 1 / inf is the 0 that is meant
            np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        np.matmul(u_new, np.multiply(g[n:], h, out=rh), out=c)
        c += x[2 * n :, t]
        np.tanh(c, out=c)
        d = np.subtract(c, h, out=rh)
        d *= g[:n]
        h = np.add(h, d, out=after[:, t])
    return before, gates, cand, after


#: Rows of a softmax handled at a time, so that they stay in the processor's cache.
ROWS = 1024


def _classes(p: Params, kind: type) -> tuple[np.ndarray, np.ndarray, bool]:
    """Weights and bias, below one another, of the classes and of the words of each; whether sums of their
    exponentials could overflow or vanish (states lie within 1)."""
    top = np.vstack([p["wc"], p["bc"]]).astype(kind, copy=False)
    own = np.concatenate([p["ww"], p["bw"][:, None]], axis=1, dtype=kind).reshape(-1, WIDTH, len(top)).transpose(0, 2, 1)
    return top, np.ascontiguousarray(own), max(float(np.abs(top).sum(axis=0).max()), float(np.abs(own).sum(axis=1).max())) > 60


def _exps(s: np.ndarray, w: np.ndarray, at: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a softmax over s @ w: the exponentials, their sum in each row, the places (in all of them) of one
    column of each row, and what stood there."""
    x = s @ w
    if large:
        x -= x.max(axis=1, keepdims=True)
    place = np.arange(0, x.size, x.shape[1]) + at
    own = x.reshape(-1).take(place)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype), place, own


def _with_one(states: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The columns `at` of states as rows, and a 1 for the bias."""
    rows = np.ones((states.shape[1], len(states) + 1), states.dtype)
    rows[:, :-1] = states.T
    return rows.take(at, axis=0)


def _by_class(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Order of the tokens by class, the class of each in it, and (class, from, to)."""
    c = (y // WIDTH).astype(np.uint16)  # sorted by radix
    order = np.argsort(c, kind="stable")
    c = c[order].astype(np.intp)
    cut = np.flatnonzero(np.diff(c)) + 1
    return order, c, [(int(c[a]), int(a), int(b)) for a, b in zip([0, *cut], [*cut, len(c)], strict=True)] if len(c) else []


def log_probs(p: Params, states: np.ndarray, y: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Natural log probability of y after each of the columns `real` of states (features, all)."""
    order, c, groups = _by_class(y)
    s, w = _with_one(states, real[order]), y[order] % WIDTH
    top, words, large = _classes(p, s.dtype)
    own, total = np.empty((2, len(y)), s.dtype), np.empty((2, len(y)), s.dtype)
    for a in range(0, len(y), ROWS):
        at = slice(a, a + ROWS)
        _, total[0, at], _, own[0, at] = _exps(s[at], top, c[at], large)
    for k, first, end in groups:
        for a in range(first, end, ROWS):
            at = slice(a, min(end, a + ROWS))
            _, total[1, at], _, own[1, at] = _exps(s[at], words[k], w[at], large)
    out = np.empty(len(y))
    out[order] = (own - np.log(total)).sum(axis=0, dtype=np.float64)
    return out


def windows(tok: np.ndarray, doc: np.ndarray, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """given (the token before; 0 starts a document), wanted, reset and document, by window; only of the
    lanes that have not ended."""
    prev_tok = np.vstack([np.zeros((1, tok.shape[1]), tok.dtype), tok[:-1]])
    prev_doc = np.vstack([np.full((1, tok.shape[1]), -2, doc.dtype), doc[:-1]])
    for t in range(0, len(tok), steps):
        at = np.s_[t : t + steps, : int((doc[t] >= 0).sum())]
        reset = doc[at] != prev_doc[at]
        yield np.where(reset, 0, prev_tok[at]), tok[at], reset, doc[at]


def score(p: Params, tokens: np.ndarray, off: np.ndarray, width: int = 256, steps: int = 64) -> np.ndarray:
    """Natural log-likelihood of each document tokens[off[i] : off[i + 1]]."""
    out = np.zeros(len(off) - 1)
    if len(out) and off[-1]:
        tok, doc = grid(tokens, off, width)
        h, space = np.zeros((p["u"].shape[0], tok.shape[1]), np.float32), {}
        for given, wanted, reset, own in windows(tok, doc, steps):
            states = _run(p, given, reset, h[:, : given.shape[1]], space, keep=False)[-1]
            h, own = states[:, -1].copy(), own.reshape(-1)
            real = np.flatnonzero(own >= 0)
            out += np.bincount(own[real], log_probs(p, states.reshape(len(h), -1), wanted.reshape(-1)[real], real), len(out))
    return out


def gradients(p: Params, given: np.ndarray, wanted: np.ndarray, reset: np.ndarray, real: np.ndarray, h: np.ndarray, space: dict | None = None) -> tuple[Params, np.ndarray, float]:
    """Gradients of the mean loss of a window, the state it ends in, and the loss. space: see _room."""
    n, kind = p["u"].shape[0], p["u"].dtype
    space = {} if space is None else space
    room = lambda name, k: _room(space, name, k, *given.shape, kind=kind)
    before, gates, cand, states = _run(p, given, reset, h, space)
    at = np.flatnonzero(real)
    y = wanted.reshape(-1)[at]
    order, c, groups = _by_class(y)
    at = at[order]
    s, w, count = _with_one(states.reshape(n, -1), at), y[order] % WIDTH, max(1, len(y))
    top, words, large = _classes(p, kind)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    ds, by_top, by_words, loss = np.empty((len(s) + 1, n + 1), kind), np.zeros_like(top), np.zeros((len(words), WIDTH, n + 1), kind), 0.0

    def back(rows: slice, weights: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The gradients of the loss times each row's sum, the rows over that sum, and that sum inverted."""
        nonlocal loss
        d, total, place, own = _exps(s[rows], weights, column[rows], large)
        loss += float(np.log(total).sum()) - float(own.sum())
        flat = d.reshape(-1)
        flat[place] -= total
        inverse = (1 / total)[:, None]
        return d, s[rows] * inverse, inverse

    for a in range(0, len(s), ROWS):
        rows = slice(a, min(len(s), a + ROWS))
        d, own, inverse = back(rows, top, c)
        by_top += own.T @ d
        np.matmul(d, top.T, out=ds[rows])
        ds[rows] *= inverse
    for k, first, end in groups:
        for a in range(first, end, ROWS):
            rows = slice(a, min(end, a + ROWS))
            d, own, inverse = back(rows, words[k], w)
            by_words[k] += d.T @ own
            more = d @ words[k].T
            more *= inverse
            ds[rows] += more
    by_words = by_words.reshape(-1, n + 1)
    g["wc"], g["bc"], g["ww"], g["bw"] = (x / kind.type(count) for x in (by_top[:-1], by_top[-1], by_words[:, :-1], by_words[:, -1]))
    ds /= count
    ds[-1] = 0
    place = np.full(given.size, len(y))
    place[at] = np.arange(len(y))
    dstates = room("dstates", n)
    dstates.reshape(n, -1)[:] = ds.take(place, axis=0)[:, :-1].T
    u_gates, u_new = np.ascontiguousarray(p["u"][:, : 2 * n]), np.ascontiguousarray(p["u"][:, 2 * n :])
    starts = [np.flatnonzero(r) for r in reset]
    dh, dx, rh = np.zeros((n, given.shape[1]), kind), room("dx", 3 * n), room("rh", n)
    drh, keep, by = (np.empty_like(dh) for _ in range(3))
    for t in range(len(given) - 1, -1, -1):
        z, r, new, old, dgates, da = gates[:n, t], gates[n:, t], cand[:, t], before[:, t], dx[: 2 * n, t], dx[2 * n :, t]
        np.multiply(r, old, out=rh[:, t])
        dh += dstates[:, t]
        np.multiply(new, new, out=by)
        np.subtract(1, by, out=by)
        by *= z
        np.multiply(dh, by, out=da)
        np.matmul(u_new, da, out=drh)
        np.subtract(1, z, out=keep)
        dh_kept = np.multiply(dh, keep, out=keep)
        np.subtract(new, old, out=by)
        by *= z
        np.multiply(dh_kept, by, out=dgates[:n])
        drh *= r
        np.subtract(1, r, out=by)
        by *= old
        np.multiply(drh, by, out=dgates[n:])
        np.matmul(u_gates, dgates, out=dh)
        dh += dh_kept
        dh += drh
        if len(starts[t]):
            dh[:, starts[t]] = 0
    flat = dx.reshape(3 * n, -1)
    g["u"][:, : 2 * n] = before.reshape(n, -1) @ flat[: 2 * n].T
    g["u"][:, 2 * n :] = rh.reshape(n, -1) @ flat[2 * n :].T
    g["b"] = flat.sum(axis=1)
    to = given.reshape(-1).astype(np.intp)
    for i, row in enumerate(flat):
        g["x"][:, i] = np.bincount(to, row, len(p["x"]))
    return g, states[:, -1].copy(), loss / count


def segments(off: np.ndarray, most: int) -> np.ndarray:
    """Offsets with the documents longer than `most` cut into sequences of that length."""
    return np.unique(np.concatenate([off, *(np.arange(a, b, most) for a, b in zip(off, off[1:], strict=False) if b - a > most)]))


def train(p: Params, tokens: np.ndarray, off: np.ndarray, width: int = 512, steps: int = 32, rate: float = 0.03, past: dict | None = None, longest: int = 1024) -> Params:
    """One pass of Adam over the documents, a step for each window. Documents longer than `longest` tokens
    are trained on as several, so that the lanes end together. past: the moments and the number of steps,
    to go on from with more documents; empty at first."""
    p = {k: v.copy() for k, v in p.items()}
    if len(off) < 2 or not off[-1]:
        return p
    past = {} if past is None else past
    if not past:
        past |= {"m": {k: np.zeros_like(v) for k, v in p.items()}, "v": {k: np.zeros_like(x) for k, x in p.items()}, "i": 0}
    m, v = past["m"], past["v"]
    tok, doc = grid(tokens, segments(off, longest), width)
    h, space = np.zeros((p["u"].shape[0], tok.shape[1]), np.float32), {}
    for given, wanted, reset, own in windows(tok, doc, steps):
        g, h, _ = gradients(p, given, wanted, reset, own >= 0, h[:, : given.shape[1]], space)
        past["i"] += 1
        i = past["i"]
        step = rate * np.sqrt(1 - 0.999**i) / (1 - 0.9**i)
        for k in p:
            m[k] *= np.float32(0.9)
            m[k] += np.float32(0.1) * g[k]
            v[k] *= np.float32(0.999)
            g[k] *= g[k]
            g[k] *= np.float32(0.001)
            v[k] += g[k]
            d = np.sqrt(v[k], out=g[k])
            d += np.float32(1e-8)
            np.divide(m[k], d, out=d)
            d *= np.float32(step)
            p[k] -= d
    return p
