"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters with a code of their own (0 pads); the rest share the last one.
CHARS = 128


def encode(text: str, width: int) -> np.ndarray:
    """Codes of the first ``width`` characters, padded with 0."""
    out = np.zeros(width, np.int64)
    c = np.frombuffer(text[:width].encode("utf-32-le", "surrogatepass"), "<u4")
    out[: len(c)] = np.where((c > 0) & (c < CHARS), c, CHARS)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def log_product(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logarithm of exp(x) @ weights, row by row."""
    m = x.max(1, keepdims=True)
    return np.log(np.exp(x - m) @ weights) + m


@dataclass
class Tagger:
    """Parameters by name; texts are (batch, time) codes, tags are (batch, time) numbers."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, tags: int, embed: int = 16, hidden: int = 16, seed: int = 1) -> Tagger:
        r = np.random.default_rng(seed)
        p = {"embed": r.normal(0, 0.3, (CHARS + 1, embed)), "out": r.normal(0, 0.2, (2 * hidden, tags)), "bias": np.zeros(tags), "move": r.normal(0, 0.1, (tags, tags))}
        for side in ("f", "b"):
            p[f"{side}x"] = r.normal(0, embed**-0.5, (embed, 4 * hidden))
            p[f"{side}h"] = r.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            p[f"{side}c"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])  # gates: in, forget, out, new
        return cls(p)

    def _sides(self, name: str) -> np.ndarray:
        """A parameter of both directions."""
        return np.stack([self.p[f"f{name}"], self.p[f"b{name}"]])

    def _lstm(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Outputs of both directions at once, by time (the second one's runs from the end): (time, 2, batch, hidden)."""
        both = np.stack([x, x[:, ::-1]]).transpose(2, 0, 1, 3)
        wh = self._sides("h")
        n = wh.shape[1]
        pre = both @ self._sides("x") + self._sides("c")[:, None]
        t, _, b, _ = pre.shape
        h, c = np.zeros((2, b, n), x.dtype), np.zeros((2, b, n), x.dtype)
        out, kept = np.zeros((t, 2, b, n), x.dtype), []
        for k in range(t):
            a = pre[k] + h @ wh
            g = sigmoid(a[..., : 3 * n])
            new = np.tanh(a[..., 3 * n :])
            before = (h, c)
            c = g[..., n : 2 * n] * c + g[..., :n] * new
            tc = np.tanh(c)
            h = g[..., 2 * n :] * tc
            out[k] = h
            kept.append((*before, g, new, tc))
        return out, kept

    def _lstm_back(self, x: np.ndarray, dout: np.ndarray, kept: list, grad: dict) -> np.ndarray:
        """Gradients of both directions' parameters, and of ``x``; ``dout`` is by time like the outputs."""
        both = np.stack([x, x[:, ::-1]]).transpose(2, 0, 1, 3)
        wh = self._sides("h")
        n = wh.shape[1]
        t, _, b, _ = dout.shape
        da = np.zeros((t, 2, b, 4 * n), x.dtype)
        dh, dc, gh = np.zeros((2, b, n), x.dtype), np.zeros((2, b, n), x.dtype), np.zeros_like(wh)
        for k in range(t - 1, -1, -1):
            h0, c0, g, new, tc = kept[k]
            i, f, o = g[..., :n], g[..., n : 2 * n], g[..., 2 * n :]
            dh = dh + dout[k]
            dc = dc + dh * o * (1 - tc * tc)
            d = da[k]
            d[..., :n], d[..., n : 2 * n], d[..., 2 * n : 3 * n], d[..., 3 * n :] = dc * new * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)
            gh += h0.transpose(0, 2, 1) @ d
            dh, dc = d @ wh.transpose(0, 2, 1), dc * f
        dx = (da @ self._sides("x").transpose(0, 2, 1)).transpose(1, 2, 0, 3)
        for s, side in enumerate("fb"):
            flat = da[:, s].reshape(-1, 4 * n)
            grad[f"{side}h"], grad[f"{side}x"], grad[f"{side}c"] = gh[s], both[:, s].reshape(len(flat), -1).T @ flat, flat.sum(0)
        return dx[0] + dx[1][:, ::-1]

    def emissions(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.p["embed"][codes]
        out, kept = self._lstm(x)
        h = np.concatenate([out[:, 0].transpose(1, 0, 2), out[::-1, 1].transpose(1, 0, 2)], axis=2)
        return h @ self.p["out"] + self.p["bias"], (x, h, kept)

    def _alpha(self, e: np.ndarray) -> np.ndarray:
        out, move = np.empty_like(e), np.exp(self.p["move"])
        out[:, 0] = e[:, 0]
        for k in range(1, e.shape[1]):
            out[:, k] = e[:, k] + log_product(out[:, k - 1], move)
        return out

    def _beta(self, e: np.ndarray) -> np.ndarray:
        out, move = np.zeros_like(e), np.exp(self.p["move"].T)
        for k in range(e.shape[1] - 2, -1, -1):
            out[:, k] = log_product(e[:, k + 1] + out[:, k + 1], move)
        return out

    def marginals(self, e: np.ndarray) -> np.ndarray:
        """Probability of each tag at each place."""
        a, b = self._alpha(e), self._beta(e)
        return np.exp(a + b - logsumexp(a[:, -1], 1)[:, None, None])

    def loss_and_gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences."""
        e, (x, h, kept) = self.emissions(codes)
        n, t, kinds = e.shape
        move = self.p["move"]
        a, b = self._alpha(e), self._beta(e)
        z = logsumexp(a[:, -1], 1)
        rows, places = np.arange(n)[:, None], np.arange(t)[None, :]
        gold = e[rows, places, tags].sum() + move[tags[:, :-1], tags[:, 1:]].sum()
        de = np.exp(a + b - z[:, None, None])
        de[rows, places, tags] -= 1
        # chances of two tags in a row, summed over all places: a product of two lists of vectors
        here, there = a[:, :-1], e[:, 1:] + b[:, 1:]
        most = here.max(2, keepdims=True), there.max(2, keepdims=True)
        scale = np.exp(most[0] + most[1] - z[:, None, None])
        pair = np.exp(move) * ((np.exp(here - most[0]) * scale).reshape(-1, kinds).T @ np.exp(there - most[1]).reshape(-1, kinds))
        np.subtract.at(pair, (tags[:, :-1], tags[:, 1:]), 1)
        de /= n
        grad = {"move": pair / n, "out": h.reshape(-1, h.shape[2]).T @ de.reshape(-1, kinds), "bias": de.sum((0, 1))}
        dh = de @ self.p["out"].T
        half = h.shape[2] // 2
        dx = self._lstm_back(x, np.stack([dh[:, :, :half], dh[:, ::-1, half:]]).transpose(2, 0, 1, 3), kept, grad)
        grad["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grad["embed"], codes, dx)
        return float(z.sum() - gold) / n, grad

    def fit(self, codes: np.ndarray, tags: np.ndarray, rounds: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 2) -> list[float]:
        """Adam on shuffled batches, in single precision; the mean loss of each round."""
        r = np.random.default_rng(seed)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        u = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        for _ in range(rounds):
            total = []
            order = r.permutation(len(codes))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                loss, grad = self.loss_and_gradient(codes[pick], tags[pick])
                norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
                step += 1
                for k, g in grad.items():
                    g = g * np.float32(min(1.0, 5.0 / (norm + 1e-9)))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    u[k] = 0.999 * u[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(u[k] / (1 - 0.999**step)) + 1e-8)
                total.append(loss)
            losses.append(float(np.mean(total)))
        return losses

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag sequences and the marginal probability of each of their tags."""
        e, _ = self.emissions(codes)
        n, t, _ = e.shape
        best, back = e[:, 0], np.zeros(e.shape, np.int64)
        for k in range(1, t):
            s = best[:, :, None] + self.p["move"]
            back[:, k] = s.argmax(1)
            best = s.max(1) + e[:, k]
        tags = np.zeros((n, t), np.int64)
        tags[:, -1] = best.argmax(1)
        for k in range(t - 1, 0, -1):
            tags[:, k - 1] = back[np.arange(n), k, tags[:, k]]
        return tags, self.marginals(e)[np.arange(n)[:, None], np.arange(t)[None, :], tags]
