"""A bidirectional LSTM over symbols with a conditional random field on top, trained and run in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Symbols (batch, length) to tag probabilities. The gates stand in the order input, forget, output, content."""

    def __init__(self, symbols: int, tags: int, hidden: int = 24, size: int = 16, seed: int = 1):
        r = np.random.default_rng(seed)
        self.hidden, self.tags = hidden, tags
        draw = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"e": r.normal(size=(symbols, size)).astype(np.float32) * 0.3, "o": draw(2 * hidden, tags), "ob": np.zeros(tags, np.float32),
                  "t": np.zeros((tags, tags), np.float32), "s": np.zeros(tags, np.float32)}
        for d in "fb":
            self.p |= {d + "x": draw(size, 4 * hidden), d + "h": draw(hidden, 4 * hidden), d + "b": np.zeros(4 * hidden, np.float32)}
            self.p[d + "b"][hidden:2 * hidden] = 1

    def _run(self, d: str, x: np.ndarray, kept: list | None = None) -> np.ndarray:
        """Hidden states of one direction, in the order of ``x``; ``kept`` gets what the backward pass needs."""
        n, length = x.shape
        k = self.hidden
        gates_of = self.p["e"] @ self.p[d + "x"] + self.p[d + "b"]  # one row a symbol
        h, c = np.zeros((n, k), gates_of.dtype), np.zeros((n, k), gates_of.dtype)
        out = np.empty((n, length, k), gates_of.dtype)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            g = gates_of[x[:, t]] + h @ self.p[d + "h"]
            gate, content = _sigmoid(g[:, :3 * k]), np.tanh(g[:, 3 * k:])
            before, was = h, c
            c = gate[:, k:2 * k] * c + gate[:, :k] * content
            squashed = np.tanh(c)
            h = gate[:, 2 * k:] * squashed
            out[:, t] = h
            if kept is not None:
                kept.append((t, gate, content, before, was, squashed))
        return out

    def unary(self, x: np.ndarray, kept: dict[str, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the tags at each place, and the hidden states."""
        h = np.concatenate([self._run(d, x, None if kept is None else kept[d]) for d in "fb"], 2)
        return h @ self.p["o"] + self.p["ob"], h

    def _chains(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward and backward weights, local weights and the log of the sum over all tag sequences."""
        n, length, tags = u.shape
        step, top = np.exp(self.p["t"] - self.p["t"].max()), u.max(2, keepdims=True)
        local = np.exp(u - top)
        a, b = np.empty_like(local), np.ones_like(local)
        first = np.exp(self.p["s"] - self.p["s"].max())
        log = self.p["s"].max() + top.sum((1, 2)) + (length - 1) * self.p["t"].max()
        for t in range(length):
            now = (first if t == 0 else a[:, t - 1] @ step) * local[:, t]
            total = now.sum(1, keepdims=True)
            a[:, t] = now / total
            log = log + np.log(total[:, 0])
        for t in range(length - 2, -1, -1):
            now = (b[:, t + 1] * local[:, t + 1]) @ step.T
            b[:, t] = now / now.sum(1, keepdims=True)
        return a, b, local, log

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The probability of each tag at each place, over all tag sequences of the window."""
        a, b, _, _ = self._chains(self.unary(x)[0])
        both = a * b
        return both / both.sum(2, keepdims=True)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log probability of the tag sequences ``y``, and its gradients."""
        n, length = x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        u, h = self.unary(x, kept)
        a, b, local, log = self._chains(u)
        rows, at = np.arange(n)[:, None], np.arange(length)[None, :]
        truth = u[rows, at, y].sum(1) + self.p["t"][y[:, :-1], y[:, 1:]].sum(1) + self.p["s"][y[:, 0]]
        both = a * b
        both /= both.sum(2, keepdims=True)
        du = both.copy()
        du[rows, at, y] -= 1
        step = np.exp(self.p["t"] - self.p["t"].max())
        pair = a[:, :-1, :, None] * step * (local * b)[:, 1:, None, :]
        pair = (pair / pair.sum((2, 3), keepdims=True)).sum((0, 1))
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        start = both[:, 0].sum(0)
        np.subtract.at(start, y[:, 0], 1)
        du /= n
        g = {"t": pair / n, "s": start / n, "ob": du.sum((0, 1)), "o": np.einsum("ntk,ntj->kj", h, du), "e": np.zeros_like(self.p["e"])}
        dh = du @ self.p["o"].T
        for i, d in enumerate("fb"):
            self._back(d, x, dh[:, :, i * self.hidden:(i + 1) * self.hidden], kept[d], g)
        return float((log - truth).mean()), g

    def _back(self, d: str, x: np.ndarray, dh: np.ndarray, kept: list, g: dict[str, np.ndarray]) -> None:
        k = self.hidden
        into = np.zeros((len(self.p["e"]), 4 * k), dh.dtype)  # gradient of the gates, by symbol
        wh = np.zeros_like(self.p[d + "h"])
        later, dc = np.zeros_like(dh[:, 0]), np.zeros_like(dh[:, 0])
        for t, gate, content, before, was, squashed in reversed(kept):
            down = dh[:, t] + later
            dc = dc + down * gate[:, 2 * k:] * (1 - squashed * squashed)
            dg = np.hstack([dc * content, dc * was, down * squashed]) * gate * (1 - gate)
            dg = np.hstack([dg, dc * gate[:, :k] * (1 - content * content)])
            np.add.at(into, x[:, t], dg)
            wh += before.T @ dg
            later, dc = dg @ self.p[d + "h"].T, dc * gate[:, k:2 * k]
        g[d + "h"], g[d + "b"] = wh, into.sum(0)
        g[d + "x"] = self.p["e"].T @ into
        g["e"] += into @ self.p[d + "x"].T

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 64, rate: float = 0.02, seed: int = 2) -> None:
        """Adam steps over shuffled batches, the rate falling to nothing."""
        r = np.random.default_rng(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        order = np.empty(0, int)
        for i in range(1, steps + 1):
            if len(order) < min(batch, len(x)):
                order = r.permutation(len(x))
            some, order = order[:batch], order[batch:]
            _, g = self.loss(x[some], y[some])
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 5.0 / max(size, 1e-9))
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.01 * (v * v - square[k])
                self.p[k] -= (rate * (1 - i / (steps + 1)) * (mean[k] / (1 - 0.9 ** i)) / (np.sqrt(square[k] / (1 - 0.99 ** i)) + 1e-8)).astype(self.p[k].dtype)


def best_path(score: np.ndarray, allowed: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The tag sequence of the largest summed score (length, tags) that takes allowed steps only."""
    total = score[0] + np.where(start, 0, -np.inf)
    step = np.where(allowed, 0, -np.inf)
    back = np.zeros(score.shape, np.int8)
    for t in range(1, len(score)):
        ways = total[:, None] + step
        back[t] = ways.argmax(0)
        total = ways.max(0) + score[t]
    path = np.empty(len(score), np.int64)
    path[-1] = total.argmax()
    for t in range(len(score) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path
