"""A gated recurrent language model in numpy: truncated backpropagation, class-factored output softmax."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np

#: Units of the state and the embedding, streams side by side and steps of one window in training.
UNITS, STREAMS, STEPS, RATE = 24, 384, 24, 0.01
#: Texts that are scored side by side.
WIDE = 1024


def _exp(a: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Turns a into its exponentials, after taking each row's greatest value off where one might overflow; returns (their sums, what was taken off)."""
    top = 0.0
    if a.size and max(a.max(), -a.min()) > 60:
        top = a.max(1)
        a -= top[:, None]
    np.exp(a, out=a)
    return a @ np.ones(a.shape[1], a.dtype), top


def _logistic(a: np.ndarray, k: int) -> None:
    """Turns a into 1 / (1 + exp(k a)); numpy's tanh takes half as long again. An infinite exponential gives 0, as it should."""
    a *= k
    with np.errstate(over="ignore"):
        np.exp(a, out=a)
    a += 1
    np.reciprocal(a, out=a)


class Gru:
    """Over symbols 0..S-1; 0 ends a text and begins the next. A symbol's probability is its class's times its own in the class.

    Symbols are numbered anew by class (`at`), so that the weights of a class lie side by side.
    """

    def __init__(self, counts: np.ndarray, classes: int = 32, seed: int = 3):
        r = np.random.default_rng(seed)
        s, h = len(counts), UNITS
        # classes of about equal mass of the square roots of the counts
        order = np.argsort(-counts, kind="stable")
        mass = np.cumsum(np.sqrt(counts[order] + 1.0))
        of = np.minimum((mass / mass[-1] * classes).astype(np.int64), classes - 1)  # ascending
        self.at = np.empty(s, np.int64)
        self.at[order] = np.arange(s)
        self.of = of
        self.begin = np.searchsorted(of, np.arange(classes + 1))
        f = np.float32
        share = ((counts + 0.5) / (counts + 0.5).sum())[order]
        mass_of = np.array([share[a:b].sum() if b > a else 1e-9 for a, b in zip(self.begin, self.begin[1:])])
        self.p = {
            "e": (r.standard_normal((s, h)) * 0.3).astype(f), "wx": (r.standard_normal((h, 3 * h)) / h**0.5).astype(f), "bx": np.zeros(3 * h, f),
            "u": (r.standard_normal((h, 3 * h)) / h**0.5).astype(f), "wc": (r.standard_normal((h, classes)) * 0.1).astype(f), "bc": np.log(mass_of).astype(f),
            "ww": (r.standard_normal((s, h)) * 0.1).astype(f), "bw": np.log(share).astype(f),
        }

    def step(self, xw: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Streams by units, as all states here. Fastest if a unit's values of all streams lie side by side in memory, as in what it returns."""
        n = UNITS
        hu = (self.p["u"].T @ h.T).T
        gates = hu[:, : 2 * n]
        gates += xw[:, : 2 * n]
        _logistic(gates, -1)
        z, r, hn = gates[:, :n], gates[:, n:], hu[:, 2 * n :]
        new = r * hn
        new += xw[:, 2 * n :]
        _logistic(new, -2)  # tanh(a) = 2 / (1 + exp(-2 a)) - 1
        new *= 2
        new -= 1
        out = h - new
        out *= z
        out += new
        return out, (z, r, new, h, hn)

    def log_probabilities(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logs of the probabilities of y after states h; with grads, what the states get back of the mean's gradient."""
        p, w = self.p, self.at[y]
        # by symbol, so that those of a class and their states lie side by side
        order = np.argsort(w.astype(np.int16) if len(self.at) < 1 << 15 else w, kind="stable")
        w, h = w[order], h[order]
        of, every = self.of[w], np.arange(len(w))
        a = h @ p["wc"]
        a += p["bc"]
        out = a[every, of]
        total, top = _exp(a)
        out -= np.log(total) + top
        dh = None
        scale = np.float32(1 / max(len(y), 1))
        if grads is not None:
            a *= (scale / total)[:, None]
            a[every, of] -= scale
            grads["wc"] += h.T @ a
            grads["bc"] += np.ones(len(a), a.dtype) @ a
            dh = a @ p["wc"].T
        ends = np.searchsorted(of, np.arange(len(self.begin)))
        nth = w - self.begin[of]
        for c in np.flatnonzero((np.diff(ends) > 0) & (np.diff(self.begin) > 1)).tolist():
            i, m = slice(ends[c], ends[c + 1]), slice(self.begin[c], self.begin[c + 1])
            b = h[i] @ p["ww"][m].T
            b += p["bw"][m]
            mine = (every[: len(b)], nth[i])
            out[i] += b[mine]
            total, top = _exp(b)
            out[i] -= np.log(total) + top
            if grads is not None:
                b *= (scale / total)[:, None]
                b[mine] -= scale
                grads["ww"][m] += b.T @ h[i]
                grads["bw"][m] += np.ones(len(b), b.dtype) @ b
                dh[i] += b @ p["ww"][m]
        back = np.empty_like(order)
        back[order] = every
        return out[back], None if dh is None else dh[back]

    def learn(self, batches: Iterable[list[np.ndarray]], rate: float = RATE) -> int:
        """One pass over all texts of all batches; texts: symbols of each, without the end. Returns how many symbols it went over, ends included.

        Streams of whole texts; the state goes on from window to window and starts anew with each text. What is left when a
        batch is dealt to its streams goes to the next batch, and at the end is a stream of its own: no symbol is left out.
        """
        m, v, n, seen = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0, 0
        rest = np.zeros(0, np.int64)
        for texts in chain(batches, [[]]):
            line = np.concatenate([rest, *(np.concatenate((t, [0])) for t in texts)])
            if not len(line):
                continue
            streams = max(1, min(STREAMS, len(line) // (4 * STEPS)))
            length = len(line) // streams
            rest, seen = line[length * streams :], seen + length * streams
            y = line[: length * streams].reshape(streams, length)
            x = np.concatenate((np.zeros((streams, 1), np.int64), y[:, :-1]), 1)
            h = np.zeros((streams, UNITS), np.float32)
            for a in range(0, length, STEPS):
                h, grads = self._window(x[:, a : a + STEPS].T, y[:, a : a + STEPS].T, h)
                n += 1
                norm = float(np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())))
                for k, g in grads.items():
                    if norm > 1:
                        g *= np.float32(1 / norm)
                    m[k] += np.float32(0.1) * (g - m[k])
                    v[k] += np.float32(0.005) * (g * g - v[k])
                    self.p[k] -= np.float32(rate / (1 - 0.9**n)) * m[k] / (np.sqrt(v[k] * np.float32(1 / (1 - 0.995**n))) + np.float32(1e-7))
        return seen

    def _window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict]:
        # by step, unit and stream; what is named with .T is by stream and unit
        p, (steps, streams), units = self.p, x.shape, UNITS
        flat = self.at[x.reshape(-1)]
        table = p["e"] @ p["wx"] + p["bx"]
        xw = np.empty((steps, 3 * units, streams), h.dtype)
        kept, states = [], np.empty((steps, units, streams), h.dtype)
        alive = (x != 0).astype(h.dtype)[:, None]
        before = np.empty((steps, units, streams), h.dtype)
        for t, places in enumerate(flat.reshape(steps, streams)):
            xw[t] = table[places].T
            np.multiply(h.T, alive[t], out=before[t])
            h, k = self.step(xw[t].T, before[t].T)
            kept.append(tuple(a.T for a in k))
            states[t] = h.T
        g = {k: np.zeros_like(a) for k, a in p.items()}
        _, dh_out = self.log_probabilities(states.transpose(0, 2, 1).reshape(-1, units), y.reshape(-1), g)
        dh_out = np.ascontiguousarray(dh_out.reshape(steps, streams, units).transpose(0, 2, 1))
        dx, du = np.empty_like(xw), np.empty_like(xw)
        back = np.zeros((units, streams), h.dtype)
        for t in range(steps - 1, -1, -1):
            z, r, new, prev, hn = kept[t]
            d = dh_out[t]
            d += back
            dz, dr, dnew = (dx[t, i * units : (i + 1) * units] for i in range(3))
            dun = du[t, 2 * units :]
            keep = d * z
            np.subtract(d, keep, out=dnew)  # d (1 - z)
            one = prev - new
            one *= keep
            np.multiply(one, 1 - z, out=dz)
            np.multiply(new, new, out=one)
            np.subtract(1, one, out=one)
            dnew *= one
            np.multiply(dnew, r, out=dun)
            np.multiply(dun, hn, out=one)
            np.multiply(one, 1 - r, out=dr)
            du[t, : 2 * units] = dx[t, : 2 * units]
            back = p["u"] @ du[t]
            back += keep
            back *= alive[t]
        g["u"] += (before @ du.transpose(0, 2, 1)).sum(0)
        # of each symbol the sum over its places
        summed = np.stack([np.bincount(flat, dx[:, i].reshape(-1), len(self.at)) for i in range(3 * units)], 1).astype(h.dtype)
        g["wx"] += p["e"].T @ summed
        g["bx"] += summed.sum(0)
        g["e"] += summed @ p["wx"].T
        return h, g

    def score(self, texts: list[np.ndarray], most: int = 48_000) -> np.ndarray:
        """The natural log of each whole text's probability, its end included. Texts of about a length run side by side, WIDE at most, as
        wider arrays leave the cache; states are carried from window to window."""
        out = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        table = (self.p["e"] @ self.p["wx"] + self.p["bx"])[self.at]
        for a in range(0, len(order), WIDE):
            some = order[a : a + WIDE]
            out[some] = self._score([texts[i] for i in some], table, most)
        return out

    def _score(self, texts: list[np.ndarray], table: np.ndarray, most: int) -> np.ndarray:
        """score() of texts in descending length."""
        lengths = np.array([len(t) + 1 for t in texts])
        flat = np.zeros(lengths.sum() + 1, texts[0].dtype)  # an end before each text
        begin = np.cumsum(lengths) - lengths
        for t, a in zip(texts, begin.tolist()):
            flat[a + 1 : a + 1 + len(t)] = t
        h = np.zeros((UNITS, len(texts)), np.float32)
        at, total = 0, np.zeros(len(texts))
        while at < lengths[0]:
            live = int(np.searchsorted(-lengths, -at, side="left"))
            steps = int(min(max(8, most // max(live, 1)), 512, lengths[0] - at))
            when = np.arange(at, at + steps)[:, None]
            inside = when < lengths[:live]
            here = (begin[:live] + when)[inside]
            x, states = flat[here], np.empty((len(here), UNITS), np.float32)
            a, owners = 0, inside.sum(1).tolist()
            for n in owners:
                now, _ = self.step(np.ascontiguousarray(table[x[a : a + n]].T).T, h[:, :n].T)
                h[:, :n] = now.T
                states[a : a + n] = now
                a += n
            got, _ = self.log_probabilities(states, flat[here + 1])
            a = 0
            for n in owners:
                total[:n] += got[a : a + n]
                a += n
            at += steps
        return total
