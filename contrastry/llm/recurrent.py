"""A bidirectional gated recurrent network with attention pooling, forward and backward, in numpy.

Sequences of one call all have the same length, so that no step is masked; callers group theirs
by length. Arrays are time first: (step, sequence, feature).
"""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def gate(x: np.ndarray) -> None:
    """The logistic function in place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


class Encoder:
    """Both directions over a sequence and the attention-weighted mean of their states."""

    DIRECTIONS = ("fore", "back")

    def __init__(self, name: str, inputs: int, hidden: int):
        self.name, self.inputs, self.hidden = name, inputs, hidden

    def fresh(self, rng: np.random.Generator) -> Weights:
        made: Weights = {}
        for way in self.DIRECTIONS:
            made[f"{self.name}_{way}_in"] = rng.normal(0, 1 / np.sqrt(self.inputs), (self.inputs, 3 * self.hidden))
            made[f"{self.name}_{way}_own"] = rng.normal(0, 1 / np.sqrt(self.hidden), (self.hidden, 3 * self.hidden))
            made[f"{self.name}_{way}_bias"] = np.zeros(3 * self.hidden)
        made[f"{self.name}_attention"] = rng.normal(0, 0.1, 2 * self.hidden)
        return {k: v.astype(np.float32) for k, v in made.items()}

    def projected(self, w: Weights, x: np.ndarray) -> list[np.ndarray]:
        """What an input adds to the gates of either direction; the same for every occurrence of a token."""
        return [x @ w[f"{self.name}_{way}_in"] + w[f"{self.name}_{way}_bias"] for way in self.DIRECTIONS]

    def forward(self, w: Weights, gates: list[np.ndarray], index: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Pooled states (sequence, 2 * hidden) of the sequences ``index`` (step, sequence) of rows of ``gates``."""
        steps, count = index.shape
        h = self.hidden
        states = np.empty((steps, count, 2 * h), np.float32)
        for d, way in enumerate(self.DIRECTIONS):
            own, given = w[f"{self.name}_{way}_own"], gates[d]
            state = np.zeros((count, h), np.float32)
            for step in (range(steps) if d == 0 else range(steps - 1, -1, -1)):
                x, held = given[index[step]], state @ own
                zr, inner = held[:, :2 * h], held[:, 2 * h:]
                zr += x[:, :2 * h]
                gate(zr)
                z, r = zr[:, :h], zr[:, h:]
                new = r * inner
                new += x[:, 2 * h:]
                np.tanh(new, out=new)
                if keep is not None:
                    keep.append((d, step, state, z, r, new, inner))
                state = state - new
                state *= z
                state += new
                states[step, :, d * h:(d + 1) * h] = state
        score = states @ w[f"{self.name}_attention"]
        score = np.exp(score - score.max(0))
        score /= score.sum(0)
        pooled = np.einsum("tb,tbh->bh", score, states)
        if keep is not None:
            keep.append((states, score, pooled))
        return pooled

    def backward(self, w: Weights, gates: list[np.ndarray], index: np.ndarray, keep: list, d_pooled: np.ndarray, grad: Weights) -> list[np.ndarray]:
        """Adds to ``grad`` and returns the gradients of ``gates``."""
        states, score, pooled = keep.pop()
        h = self.hidden
        d_score = score * (np.einsum("bh,tbh->tb", d_pooled, states) - (d_pooled * pooled).sum(1))
        grad[f"{self.name}_attention"] += np.einsum("tb,tbh->h", d_score, states)
        d_states = score[:, :, None] * d_pooled + d_score[:, :, None] * w[f"{self.name}_attention"]
        outers = [np.empty((*index.shape, 3 * h), np.float32) for _ in gates]
        carried = np.zeros((index.shape[1], h), np.float32)
        steps = len(index)
        seen = 0
        for d, step, before, z, r, new, inner in reversed(keep):
            if seen % steps == 0:
                carried = np.zeros_like(carried)
            seen += 1
            way = self.DIRECTIONS[d]
            d_state = carried + d_states[step, :, d * h:(d + 1) * h]
            d_new = d_state * (1 - z) * (1 - new * new)
            d_z = d_state * (before - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            outer = np.concatenate([d_z, d_r, d_new], 1)
            held = np.concatenate([d_z, d_r, d_new * r], 1)
            grad[f"{self.name}_{way}_own"] += before.T @ held
            carried = d_state * z + held @ w[f"{self.name}_{way}_own"].T
            outers[d][step] = outer
        return [summed_rows(index.ravel(), outer.reshape(-1, 3 * h), len(g)) for g, outer in zip(gates, outers)]

    def unprojected(self, w: Weights, x: np.ndarray, d_gates: list[np.ndarray], grad: Weights) -> np.ndarray:
        """Adds the gradients of the projection to ``grad`` and returns those of its input."""
        d_x = np.zeros_like(x)
        for way, g in zip(self.DIRECTIONS, d_gates):
            grad[f"{self.name}_{way}_in"] += x.T @ g
            grad[f"{self.name}_{way}_bias"] += g.sum(0)
            d_x += g @ w[f"{self.name}_{way}_in"].T
        return d_x


def summed_rows(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of each index from 0 to ``size`` - 1."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.diff(index, prepend=-1))
    out[index[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Adam:
    def __init__(self, w: Weights, rate: float):
        self.rate, self.step = rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in w.items()}
        self.square = {k: np.zeros_like(v) for k, v in w.items()}

    def update(self, w: Weights, grad: Weights) -> None:
        self.step += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        shrink = min(1.0, 5.0 / (size + 1e-9))
        for k, g in grad.items():
            g = g * shrink
            self.mean[k] = 0.9 * self.mean[k] + 0.1 * g
            self.square[k] = 0.99 * self.square[k] + 0.01 * g * g
            w[k] -= (self.rate * (self.mean[k] / (1 - 0.9**self.step)) / (np.sqrt(self.square[k] / (1 - 0.99**self.step)) + 1e-6)).astype(np.float32)
