"""A small gated recurrent language model with a class-factored output layer, in numpy."""

from __future__ import annotations

import numpy as np

WINDOW = 32
HIDDEN = 16


def word_classes(mass: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word, words in order of falling mass: equal shares of the square root of the mass."""
    share = np.cumsum(np.sqrt(mass))
    raw = np.minimum((share - np.sqrt(mass)) / share[-1] * classes, classes - 1).astype(int)
    return np.unique(raw, return_inverse=True)[1]


class Gru:
    """Words are numbered by class, so a class is a range of words. ``bounds``: first word of each class, and the end."""

    def __init__(self, mass: np.ndarray, bounds: np.ndarray, hidden: int = HIDDEN, seed: int = 7):
        v, c, h = len(mass), len(bounds) - 1, hidden
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bounds, self.hidden = bounds, h
        self.cls = np.repeat(np.arange(c, dtype=np.int16), np.diff(bounds))
        heavy = np.add.reduceat(mass, bounds[:-1])
        self.p = {
            "emb": rng.normal(0, 0.3, (v, h)), "wx": rng.normal(0, h**-0.5, (h, 3 * h)), "wh": rng.normal(0, h**-0.5, (h, 3 * h)), "b": np.zeros(3 * h),
            "wc": np.zeros((h, c)), "bc": np.log(heavy), "wo": np.zeros((v, h)), "bo": np.log(mass / heavy[self.cls]),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}  # untrained, it is the unigram model
        self.m = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.s = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.steps = 0

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k, x in self.p.items():
            self.p[k] = np.asarray(flat[at : at + x.size], np.float32).reshape(x.shape).copy()
            at += x.size
        return self

    def projected(self) -> np.ndarray:
        """What each word as input adds to the three gates."""
        return self.p["emb"] @ self.p["wx"] + self.p["b"]

    def forward(self, gates: np.ndarray, state: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States before each word of a window and the state behind it. ``gates``: step by row by 3 x hidden; row i of
        the result's step t has seen the inputs up to t."""
        h, wh, out = self.hidden, self.p["wh"], np.empty((*gates.shape[:2], self.hidden), np.float32)
        for t in range(len(gates)):
            u = state @ wh
            zr = 1 / (1 + np.exp(-(gates[t, :, : 2 * h] + u[:, : 2 * h])))
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(gates[t, :, 2 * h :] + r * u[:, 2 * h :])
            new = n + z * (state - n)
            if keep is not None:
                keep.append((state, z, r, n, u[:, 2 * h :]))
            state = out[t] = new
        return out, state

    def log_prob(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability: its class, then the word in its class."""
        def picked(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
            own = logits[np.arange(len(at)), at]
            np.exp(logits, out=logits)
            return own - np.log(logits @ np.ones(logits.shape[1], logits.dtype))

        cls = self.cls[words]
        out = picked(states @ self.p["wc"] + self.p["bc"], cls)
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(len(self.bounds)))
        for c in np.flatnonzero(np.diff(ends)):
            begin, end = self.bounds[c], self.bounds[c + 1]
            if end - begin == 1:
                continue
            rows = order[ends[c] : ends[c + 1]]
            out[rows] += picked(states[rows] @ self.p["wo"][begin:end].T + self.p["bo"][begin:end], words[rows] - begin)
        return out

    def learn(self, inputs: np.ndarray, words: np.ndarray, real: np.ndarray, state: np.ndarray, rate: float) -> np.ndarray:
        """One step on a window (step by row), back through the window only; ``real`` marks words, not padding. Gives
        the state behind the window, as before the step."""
        p, h, keep = self.p, self.hidden, []
        x = p["emb"][inputs]
        states, last = self.forward(x @ p["wx"] + p["b"], state, keep)
        t, i = np.nonzero(real)
        if not len(t):
            return last
        s, w = states[t, i], words[t, i]
        order = np.argsort(self.cls[w], kind="stable")
        t, i, s, w = t[order], i[order], s[order], w[order]  # words of a class lie together
        cls, rows = self.cls[w], np.arange(len(w))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        e = _softmax(s @ p["wc"] + p["bc"])
        e[rows, cls] -= 1
        g["wc"], g["bc"] = s.T @ e, e.sum(axis=0)
        ds = e @ p["wc"].T
        ends = np.searchsorted(cls, np.arange(len(self.bounds)))
        for c in np.flatnonzero(np.diff(ends)):
            begin, end = self.bounds[c], self.bounds[c + 1]
            if end - begin == 1:  # certain within its class
                continue
            own, wo = slice(ends[c], ends[c + 1]), p["wo"][begin:end]
            e = s[own] @ wo.T
            e += p["bo"][begin:end]
            e = _softmax(e)
            e[rows[: len(e)], w[own] - begin] -= 1
            np.matmul(e.T, s[own], out=g["wo"][begin:end])
            np.sum(e, axis=0, out=g["bo"][begin:end])
            ds[own] += e @ wo
        dout = np.zeros_like(states)
        dout[t, i] = ds
        carried = np.zeros_like(state)
        dgates = np.empty((len(inputs), inputs.shape[1], 3 * h), np.float32)
        before, z, r, n, un = (np.stack(x) for x in zip(*keep, strict=True))
        by_n, by_z, by_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), un * r * (1 - r)
        du, wht = np.empty_like(dgates), np.ascontiguousarray(p["wh"].T)
        for k in range(len(inputs) - 1, -1, -1):
            d = dout[k] + carried
            dn = d * by_n[k]
            dgates[k, :, 2 * h :] = dn
            np.multiply(d, by_z[k], out=du[k, :, :h])
            np.multiply(dn, by_r[k], out=du[k, :, h : 2 * h])
            np.multiply(dn, r[k], out=du[k, :, 2 * h :])
            carried = d * z[k] + du[k] @ wht
        dgates[:, :, : 2 * h] = du[:, :, : 2 * h]
        g["wh"] = before.reshape(-1, h).T @ du.reshape(-1, 3 * h)
        flat_x, flat_g = x.reshape(-1, h), dgates.reshape(-1, 3 * h)
        g["wx"], g["b"] = flat_x.T @ flat_g, flat_g.sum(axis=0)
        dx = flat_g @ p["wx"].T
        cells = (inputs.reshape(-1, 1) * h + np.arange(h)).ravel()
        g["emb"] = np.bincount(cells, dx.ravel(), minlength=p["emb"].size).astype(np.float32).reshape(p["emb"].shape)
        self._step(g, len(t), rate)
        return last

    def _step(self, g: dict, n: int, rate: float) -> None:
        """Adam on the mean gradient."""
        self.steps += 1
        scale = rate / (1 - 0.9**self.steps)
        root = (1 - 0.99**self.steps) ** -0.5
        for k, x in self.p.items():
            d, m, s = g[k], self.m[k], self.s[k]
            d *= np.float32(1 / n)
            m *= 0.9
            s *= 0.99
            m += np.float32(0.1) * d
            d *= d
            d *= np.float32(0.01)
            s += d
            np.sqrt(s, out=d)
            d *= np.float32(root)
            d += 1e-6
            np.divide(m, d, out=d)
            d *= np.float32(scale)
            x -= d


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place. States lie within 1, so logits beyond 80 don't occur in a sound model; the cut keeps sums finite."""
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x *= (1 / (x @ np.ones(x.shape[1], x.dtype)))[:, None]
    return x
