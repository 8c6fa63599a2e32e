"""A bidirectional gated recurrent network with attention pooling, forward and backward passes in numpy.

Inputs are windows of code points; each position adds the vector of its character to that of its word (a run of letters,
or the pair with the next character where a script has no spaces). Both directions feed an attention pool and one output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 24
CHARS, WORD_BITS = 4096, 13
WORDS = 2**WORD_BITS
DIM, HIDDEN, ATTENTION = 16, 16, 16


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character and word buckets of windows (n, width) of code points, 0 where a window has ended."""
    c = codes.astype(np.uint32)
    words = c * np.uint32(1_000_003)
    words[:, :-1] += c[:, 1:] * np.uint32(8_191)
    words += np.uint32(17)
    words &= np.uint32(0x7FFFFFFF)
    words = _bucket(words ^ (words >> np.uint32(13)), WORDS - 1)
    latin = (c >= 97) & (c <= 122)
    rows = np.flatnonzero(latin.any(1))
    if len(rows):
        c_l, latin = c[rows].astype(np.int64), latin[rows]
        h = np.zeros(len(rows), np.int64)
        word = np.zeros_like(c_l)
        for t in range(c.shape[1]):
            h = np.where(latin[:, t], (h * 131 + c_l[:, t]) & 0x7FFFFFFF, 0)
            word[:, t] = h
        for t in range(c.shape[1] - 2, -1, -1):
            word[:, t] = np.where(latin[:, t] & latin[:, t + 1], word[:, t + 1], word[:, t])
        word = word * 7 + 3
        words[rows] = np.where(latin, 1 + (word ^ (word >> 13)) % (WORDS - 1), words[rows])
    chars = _bucket(c ^ (c >> np.uint32(12)), CHARS - 1)
    real = c > 0
    words *= real
    chars *= real
    return chars.astype(np.int32), words.astype(np.int32)


def _bucket(x: np.ndarray, count: int) -> np.ndarray:
    """1 + x % count; numpy divides by a constant faster than it takes remainders."""
    return x - x // np.uint32(count) * np.uint32(count) + np.uint32(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"Ec": normal(CHARS, DIM, scale=0.2), "Ew": normal(WORDS, DIM, scale=0.2)}
    for d in "fb":
        p |= {f"W{d}": normal(DIM, 3 * HIDDEN, scale=DIM**-0.5), f"U{d}": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"Wa": normal(2 * HIDDEN, ATTENTION, scale=0.3), "va": normal(ATTENTION, scale=0.3), "wo": normal(2 * HIDDEN, scale=0.3), "bo": np.zeros(1, np.float32)}


def _run(g: np.ndarray, u: np.ndarray, backward: bool) -> tuple[np.ndarray, list]:
    """States (n, width, HIDDEN) from gate inputs (n, width, 3 * HIDDEN), and what the backward pass needs."""
    n, width, _ = g.shape
    h, out, kept = np.zeros((n, HIDDEN), np.float32), np.empty((n, width, HIDDEN), np.float32), []
    k = HIDDEN
    for t in range(width - 1, -1, -1) if backward else range(width):
        hu = h @ u
        zr = _sigmoid(g[:, t, : 2 * k] + hu[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        new = np.tanh(g[:, t, 2 * k :] + r * hu[:, 2 * k :])
        kept.append((t, h, z, r, new, hu[:, 2 * k :]))
        h = new + z * (h - new)
        out[:, t] = h
    return out, kept


def _back(dout: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, width, k = dout.shape
    dg, du, dh = np.empty((n, width, 3 * k), np.float32), np.zeros_like(u), np.zeros((n, k), np.float32)
    for t, h, z, r, new, hn in reversed(kept):
        dh = dh + dout[:, t]
        dnew = dh * (1 - z) * (1 - new * new)
        dz = dh * (h - new) * z * (1 - z)
        dr = dnew * hn * r * (1 - r)
        dg[:, t] = np.concatenate([dz, dr, dnew], 1)
        dhu = np.concatenate([dz, dr, dnew * r], 1)
        du += h.T @ dhu
        dh = dh * z + dhu @ u.T
    return dg, du


def step(p: dict, chars: np.ndarray, words: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Weighted logistic loss of a batch and its gradient; those of the two tables as (rows, values)."""
    mask = chars > 0
    x = p["Ec"][chars] + p["Ew"][words]
    states, kept = {}, {}
    for d in "fb":
        states[d], kept[d] = _run(x @ p[f"W{d}"] + p[f"b{d}"], p[f"U{d}"], d == "b")
    s = np.concatenate([states["f"], states["b"]], 2)
    a = np.tanh(s @ p["Wa"])
    e = np.where(mask, a @ p["va"], -1e9)
    e = np.exp(e - e.max(1, keepdims=True))
    e /= e.sum(1, keepdims=True)
    pooled = (e[:, :, None] * s).sum(1)
    prob = _sigmoid(pooled @ p["wo"] + p["bo"])
    loss = float(-(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum() / weight.sum())
    dlogit = (weight * (prob - y) / weight.sum()).astype(np.float32)
    grad = {"wo": pooled.T @ dlogit, "bo": np.array([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * p["wo"]
    ds = e[:, :, None] * dpooled[:, None, :]
    de = (s * dpooled[:, None, :]).sum(2)
    de = e * (de - (e * de).sum(1, keepdims=True))
    da = de[:, :, None] * p["va"] * (1 - a * a)
    grad["va"] = de.reshape(-1) @ a.reshape(-1, ATTENTION)
    grad["Wa"] = s.reshape(-1, 2 * HIDDEN).T @ da.reshape(-1, ATTENTION)
    ds = ds + da @ p["Wa"].T
    dx = np.zeros_like(x)
    for d, part in (("f", ds[:, :, :HIDDEN]), ("b", ds[:, :, HIDDEN:])):
        dg, grad[f"U{d}"] = _back(part, kept[d], p[f"U{d}"])
        grad[f"W{d}"] = x.reshape(-1, DIM).T @ dg.reshape(-1, 3 * HIDDEN)
        grad[f"b{d}"] = dg.sum((0, 1))
        dx += dg @ p[f"W{d}"].T
    flat = dx.reshape(-1, DIM)
    for name, ids in (("Ec", chars), ("Ew", words)):
        order = np.argsort(ids, axis=None, kind="stable")
        rows, first = np.unique(ids.reshape(-1)[order], return_index=True)
        grad[name] = (rows, np.add.reduceat(flat[order], first, axis=0))
    return loss, grad


class Adam:
    def __init__(self, p: dict, rate: float = 0.004, decay: float = 1e-4):
        self.p, self.rate, self.decay, self.t = p, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def apply(self, grad: dict) -> None:
        self.t += 1
        fix = (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in grad.items():
            at, g = (g if isinstance(g, tuple) else (slice(None), g))
            g = np.clip(g, -1, 1)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            self.p[k][at] -= self.rate * (fix * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-8) + self.decay * self.p[k][at])


class Scorer:
    """The trained network for scoring. A forward state depends on the inputs up to its place only and a backward state on
    those from its place on, so windows are sorted by their inputs and every state that several windows begin (or end) with
    is worked out once, with its share of the attention and of the output. Windows that end early are filled as in training.

    Input products are tables. All gates are taken from one logistic function, tanh(x) being 2 / (1 + exp(-2 x)) - 1; the
    factors -1 and -2 are put into the tables once."""

    #: Windows worked on together, and states in a block that stays in the processor's cache.
    MOST, BLOCK = 131_072, 2048

    def __init__(self, p: dict):
        self.p, k = p, HIDDEN
        factor = np.r_[np.full(2 * k, -1), np.full(k, -2)].astype(np.float32)
        self.gates, self.kept = {}, {}
        for d, at in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            c, w, u = (p["Ec"] @ p[f"W{d}"] + p[f"b{d}"]) * factor, (p["Ew"] @ p[f"W{d}"]) * factor, p[f"U{d}"] * factor
            apart = [x.reshape(-1, 3, k).swapaxes(0, 1) for x in (c, w, u)]  # by gate
            self.gates[d] = [np.ascontiguousarray(x, np.float32) for x in (*apart, p["Wa"][at] * -2, p["wo"][at])]

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Probability of each window (n, WIDTH) of code points, 0 after its end."""
        n, out = len(codes), np.empty(len(codes), np.float32)
        if not n:
            return out
        inputs = np.empty((WIDTH, n), np.int32)
        for low in range(0, n, self.BLOCK):
            chars, words = features(codes[low : low + self.BLOCK])
            inputs[:, low : low + self.BLOCK] = ((chars << WORD_BITS) | words).T
        order = _shared_order(inputs, range(WIDTH))
        for low in range(0, n, self.MOST):
            mine = order[low : low + self.MOST]
            out[mine] = self._scores(inputs.take(mine, 1))
        return out

    def _scores(self, inputs: np.ndarray) -> np.ndarray:
        """Of windows, as inputs (WIDTH, n), in an order that brings equal beginnings together."""
        n, p = inputs.shape[1], self.p
        turned = _shared_order(inputs, range(WIDTH - 1, -1, -1))
        back = np.empty(n, np.intp)
        back[turned] = np.arange(n)
        ends = {t: (group[back], a, o) for t, group, a, o in self._states("b", inputs.take(turned, 1))}
        e, value = self._room("e", 2 * WIDTH * n).reshape(2, WIDTH, n)
        va = p["va"] * np.float32(2)  # twice, less what tanh adds to all alike, which doesn't matter here
        room = np.empty((2, self.BLOCK, ATTENTION), np.float32)
        with np.errstate(over="ignore"):
            for t, group, a, o in self._states("f", inputs):
                other, b, o_b = ends.pop(t)
                for low in range(0, n, self.BLOCK):
                    part = slice(low, min(low + self.BLOCK, n))
                    both, more = room[:, : part.stop - low]
                    a.take(group[part], 0, out=both, mode="clip")
                    both += b.take(other[part], 0, out=more, mode="clip")
                    _logistic(both)
                    np.matmul(both, va, out=e[t, part])
                np.add(o.take(group), o_b.take(other), out=value[t])
        e[inputs == 0] = -np.inf
        e[0, inputs[0] == 0] = 0  # a window of nothing but fill
        e -= e.max(0)
        np.exp(e, out=e)
        value *= e
        return _sigmoid(value.sum(0) / e.sum(0) + p["bo"])

    def _states(self, d: str, inputs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each place in reading order: the place, each window's state, and of every state what it adds to the
        attention's inputs and to the output."""
        c, w, u, wa, wo = self.gates[d]
        n, k = inputs.shape[1], HIDDEN
        room, states = self._room("block", 10 * self.BLOCK * k), self._room("states", 2 * n * k)
        # The backward attention inputs of all places are used later, the forward ones at once.
        attention, used = self._room(d, (WIDTH if d == "b" else 1) * n * ATTENTION), 0
        starts = np.zeros(n, bool)
        starts[0] = True
        before, group = np.zeros((1, k), np.float32), np.zeros(n, np.intp)
        for t in range(WIDTH) if d == "f" else range(WIDTH - 1, -1, -1):
            starts[1:] |= inputs[t, 1:] != inputs[t, :-1]
            first = np.flatnonzero(starts)
            parent, read, size = group[first], inputs[t, first].astype(np.intp), len(first)
            char, word = read >> WORD_BITS, read & (2**WORD_BITS - 1)
            h = states[t % 2 * n * k :][: size * k].reshape(size, k)
            a = attention[used : used + size * ATTENTION].reshape(size, ATTENTION)
            used += size * ATTENTION if d == "b" else 0
            with np.errstate(over="ignore"):
                for low in range(0, size, self.BLOCK):
                    part = slice(low, min(low + self.BLOCK, size))
                    m = part.stop - low
                    gates, given, more = room[: 9 * m * k].reshape(3, 3, m, k)
                    old = before.take(parent[part], 0, out=room[9 * m * k : 10 * m * k].reshape(m, k), mode="clip")
                    np.matmul(old, u, out=gates)
                    c.take(char[part], 1, out=given, mode="clip")
                    given += w.take(word[part], 1, out=more, mode="clip")
                    zr, new = gates[:2], gates[2]
                    zr += given[:2]
                    _logistic(zr)
                    new *= zr[1]
                    new += given[2]
                    np.exp(new, out=new)
                    new += 1
                    np.divide(2, new, out=new)
                    new -= 1
                    old -= new
                    old *= zr[0]
                    np.add(old, new, out=h[part])
                    np.matmul(h[part], wa, out=a[part])
            before, group = h, np.cumsum(starts) - 1
            yield t, group, a, h @ wo

    def _room(self, name: str, size: int) -> np.ndarray:
        """Memory for so many numbers, the same at each call: new memory takes the system longer than what is worked out there."""
        if name not in self.kept or len(self.kept[name]) < size:
            self.kept[name] = np.empty(size, np.float32)
        return self.kept[name][:size]


def _shared_order(inputs: np.ndarray, places: range) -> np.ndarray:
    """An order of windows, as inputs (WIDTH, n), that brings those together which are equal in the first of the places, for
    any number of them. It goes by hashes, so a few may stand apart."""
    n, factors = inputs.shape[1], np.random.default_rng(5).integers(1, 2**32, WIDTH, np.uint32) | np.uint32(1)

    def piece(low: int, high: int, bits: int) -> np.ndarray:
        total = np.zeros(n, np.uint32)
        for i in range(low, high):
            total += inputs[places[i]].view(np.uint32) * factors[i]
        total ^= total >> np.uint32(15)
        return ((total * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.uint64)

    def key(rank: np.ndarray, bounds: tuple[int, ...], bits: int) -> np.ndarray:
        for low, high in zip(bounds, bounds[1:]):
            rank = (rank << np.uint64(bits)) | piece(low, high, bits)
        return rank

    first = key(np.zeros(n, np.uint64), (0, 1, 2, 4, 6, 9), 12)
    _, rank = np.unique(first, return_inverse=True)
    return np.argsort(key(rank.astype(np.uint64), (9, 12, 15, 19), 12))


def _logistic(x: np.ndarray) -> None:
    """1 / (1 + exp(x)) in place."""
    np.exp(x, out=x)
    x += 1
    np.divide(1, x, out=x)
