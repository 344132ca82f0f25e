"""A bidirectional gated recurrent network over bytes, in NumPy, trained by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that one step of the network reads.
STRIDE = 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x *= 2
    x = _sigmoid(x)
    x *= 2
    x -= 1
    return x


class ByteNetwork:
    """Gives every step (two bytes) log-probabilities of the classes.

    One direction: update and reset gates and a candidate state from the step's bytes and
    the last state (the reset gate scales the recurrent part of the candidate).
    """

    def __init__(self, classes: int, hidden: int = 24, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h = hidden
        self.hidden, self.classes = h, classes
        self.weights: dict[str, np.ndarray] = {}
        for d in "fb":
            for s in range(STRIDE):
                self.weights[f"{d}e{s}"] = rng.normal(0, 0.5, (256, 3 * h)).astype(np.float32)
            u = np.concatenate([np.linalg.qr(rng.normal(size=(h, h)))[0] for _ in range(3)], 1)
            self.weights[f"{d}u"] = u.astype(np.float32)
            bias = np.zeros(3 * h, np.float32)
            bias[:h] = 1.0  # keep the state at first
            self.weights[f"{d}b"] = bias
            self.weights[f"{d}c"] = np.zeros(h, np.float32)
        self.weights["v"] = rng.normal(0, 0.2, (2 * h, classes)).astype(np.float32)
        self.weights["o"] = np.zeros(classes, np.float32)

    def _run(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction, time first; ``x`` has a row of bytes per sequence."""
        w, h = self.weights, self.hidden
        n, steps = x.shape[0], x.shape[1] // STRIDE
        u, b, c0 = w[d + "u"], w[d + "b"], w[d + "c"]
        tables = [w[f"{d}e{s}"] for s in range(STRIDE)]
        cols = np.ascontiguousarray(x.T)
        out = np.empty((steps, n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = tables[0][cols[t * STRIDE]]
            for s in range(1, STRIDE):
                a += tables[s][cols[t * STRIDE + s]]
            a += b
            g = state @ u
            gates = a[:, : 2 * h]
            gates = _sigmoid(gates + g[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            m = g[:, 2 * h :] + c0
            c = _tanh(a[:, 2 * h :] + r * m)
            new = c + z * (state - c)
            if keep is not None:
                keep.append((t, state, z, r, m, c))
            state = new
            out[t] = state
        return out

    def _states(self, d: str, x: np.ndarray) -> np.ndarray:
        """The states of ``_run``, as numbers for use only: each gate in its own contiguous block, nothing kept or copied on the way."""
        w, h = self.weights, self.hidden
        n, steps = x.shape[0], x.shape[1] // STRIDE
        u, c0 = np.ascontiguousarray(w[d + "u"].reshape(h, 3, h).transpose(1, 0, 2)), w[d + "c"]
        tables = [np.ascontiguousarray(w[f"{d}e{s}"].reshape(256, 3, h).transpose(1, 0, 2)) for s in range(STRIDE)]
        tables[0] = tables[0] + w[d + "b"].reshape(3, 1, h)
        cols = np.ascontiguousarray(x.T)
        out = np.empty((steps, n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        a, more, g = (np.empty((3, n, h), np.float32) for _ in range(3))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(tables[0], cols[t * STRIDE], axis=1, out=a, mode="clip")
            for s in range(1, STRIDE):
                a += np.take(tables[s], cols[t * STRIDE + s], axis=1, out=more, mode="clip")
            np.matmul(state, u, out=g)
            gates, m = a[:2], g[2]
            gates += g[:2]
            # exp may overflow to infinity: the gate is then 0
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            m += c0
            m *= gates[1]
            m += a[2]
            np.tanh(m, out=m)
            now = out[t]
            np.subtract(state, m, out=now)
            now *= gates[0]
            now += m
            state = now
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(steps, sequences, classes) for bytes ``x`` (sequences, bytes)."""
        h, v = self.hidden, self.weights["v"]
        with np.errstate(over="ignore"):
            z = self._states("f", x).reshape(-1, h) @ v[:h]
            z += self._states("b", x).reshape(-1, h) @ v[h:]
        z += self.weights["o"]
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        return z.reshape(x.shape[1] // STRIDE, x.shape[0], -1)

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """(gradients, loss) of the mean negative log-probability of class ``y`` (sequences, steps) at unmasked steps."""
        w, h = self.weights, self.hidden
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(d, x, kept[d]) for d in "fb"], 2)
        z = both @ w["v"] + w["o"]
        z -= z.max(2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(2, keepdims=True)
        total = max(1.0, float(mask.sum()))
        rows = np.arange(x.shape[0])
        at = np.arange(p.shape[0])[:, None], rows[None, :], y.T
        loss = -float((np.log(p[at] + 1e-9) * mask).sum()) / total
        p[at] -= 1
        p *= (mask / total)[:, :, None]
        flat = p.reshape(-1, self.classes)
        grads = {"v": both.reshape(-1, 2 * h).T @ flat, "o": flat.sum(0)}
        dboth = (flat @ w["v"].T).reshape(both.shape)
        cols = np.ascontiguousarray(x.T)
        for d in "fb":
            u = w[d + "u"]
            du, db, dc0 = np.zeros_like(u), np.zeros_like(w[d + "b"]), np.zeros_like(w[d + "c"])
            tables = [np.zeros_like(w[f"{d}e{s}"]) for s in range(STRIDE)]
            dh = np.zeros((x.shape[0], h), np.float32)
            part = dboth[:, :, :h] if d == "f" else dboth[:, :, h:]
            for t, before, gz, gr, m, c in reversed(kept[d]):
                dh = dh + part[t]
                dc = dh * (1 - gz) * (1 - c * c)
                dz = dh * (before - c) * gz * (1 - gz)
                dr = dc * m * gr * (1 - gr)
                dm = dc * gr
                da = np.concatenate([dz, dr, dc], 1)
                dg = np.concatenate([dz, dr, dm], 1)
                du += before.T @ dg
                db += da.sum(0)
                dc0 += dm.sum(0)
                for s in range(STRIDE):
                    # sums per byte value
                    hot = np.zeros((256, x.shape[0]), np.float32)
                    hot[cols[t * STRIDE + s], rows] = 1
                    tables[s] += hot @ da
                dh = dh * gz + dg @ u.T
            grads |= {d + "u": du, d + "b": db, d + "c": dc0} | {f"{d}e{s}": tables[s] for s in range(STRIDE)}
        return grads, loss

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, epochs: int, rate: float = 0.02, batch: int = 256, seed: int = 6) -> list[float]:
        """Adam over shuffled batches; ``y`` and ``mask`` are (sequences, steps). Gives the loss of each epoch."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses, t = [], 0
        every = max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            losses.append(0.0)
            for idx in _batches(rng.permutation(len(x)), batch):
                grads, loss = self.gradients(x[idx], y[idx], np.ascontiguousarray(mask[idx].T))
                losses[-1] += loss * len(idx) / len(x)
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                scale = min(1.0, 1.0 / (size + 1e-9))
                t += 1
                step = rate * 0.5 * (1 + np.cos(np.pi * t / every))
                for k, g in grads.items():
                    g = g * scale
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.weights[k] = (self.weights[k] - step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return losses


def _batches(order: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for at in range(0, len(order), size):
        yield order[at : at + size]
