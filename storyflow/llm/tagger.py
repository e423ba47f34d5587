"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Sequences are int arrays (n, length) of character numbers. Both directions run together, one step a character. Tags are
``O`` and, for each kind, a begin and an inside tag; transitions into an inside tag from another kind are impossible.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

EMBED, HIDDEN = 12, 24
RATE, BETAS = 0.012, (0.9, 0.98)


def allowed(n_kinds: int) -> np.ndarray:
    """(tags + 1, tags) booleans: which tag may follow which; the last row is the start."""
    n = 1 + 2 * n_kinds
    good = np.ones((n + 1, n), bool)
    for k in range(n_kinds):
        inside = 2 + 2 * k
        good[:, inside] = False
        good[[inside - 1, inside], inside] = True
    return good


@dataclass
class Tagger:
    n_kinds: int
    n_chars: int
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int, embed: int = EMBED, hidden: int = HIDDEN, dtype: type = np.float32) -> Tagger:
        rng, n = np.random.default_rng(seed), 1 + 2 * self.n_kinds
        shapes = {"embed": (self.n_chars, embed), "into": (2, embed, 4 * hidden), "again": (2, hidden, 4 * hidden), "out": (2 * hidden, n)}
        self.params = {k: (rng.normal(size=s) / np.sqrt(s[-2] if k != "embed" else embed)).astype(dtype) for k, s in shapes.items()}
        self.params |= {"gate": np.zeros((2, 1, 4 * hidden), dtype), "bias": np.zeros(n, dtype), "follow": np.zeros((n + 1, n), dtype)}
        self.params["gate"][:, :, hidden : 2 * hidden] = 1  # begins by remembering
        return self

    def _states(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """What both directions compute, step by step; index 1 reads the sequence from its end."""
        p = self.params
        hidden, (n, length) = p["again"].shape[1], ids.shape
        table = p["embed"] @ p["into"] + p["gate"]
        both = np.stack([ids.T, ids.T[::-1]], 1)  # (length, 2, n)
        h = c = np.zeros((2, n, hidden), table.dtype)
        kept = {k: np.empty((length, 2, n, size), table.dtype) for k, size in (("gates", 4 * hidden), ("cell", hidden), ("tanh", hidden), ("h", hidden))}
        for t in range(length):
            z = np.stack([table[0][both[t, 0]], table[1][both[t, 1]]]) + h @ p["again"]
            gates = kept["gates"][t]
            np.negative(z[..., : 3 * hidden], out=gates[..., : 3 * hidden])
            np.exp(np.minimum(gates[..., : 3 * hidden], 60), out=gates[..., : 3 * hidden])
            gates[..., : 3 * hidden] += 1
            np.reciprocal(gates[..., : 3 * hidden], out=gates[..., : 3 * hidden])
            np.tanh(z[..., 3 * hidden :], out=gates[..., 3 * hidden :])
            i, f, o, g = (gates[..., k * hidden : (k + 1) * hidden] for k in range(4))
            c = kept["cell"][t] = f * c + i * g
            kept["tanh"][t] = np.tanh(c)
            h = kept["h"][t] = o * kept["tanh"][t]
        return kept | {"both": both}

    def emissions(self, ids: np.ndarray, states: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """(length, n, tags) scores of each tag before transitions."""
        h = (states or self._states(ids))["h"]
        joined = np.concatenate([h[:, 0], h[::-1, 1]], -1)
        return joined @ self.params["out"] + self.params["bias"]

    def _transitions(self) -> np.ndarray:
        return np.where(allowed(self.n_kinds), np.exp(self.params["follow"]), 0)

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tag probabilities, log partition of each sequence, forward, weight, backward) by scaled forward-backward sums."""
        follow = self._transitions()
        top = e.max(-1, keepdims=True)
        weight = np.exp(e - top)
        forward, backward, scale = np.empty_like(weight), np.empty_like(weight), np.empty(e.shape[:2], e.dtype)
        for t in range(len(e)):
            a = weight[t] * (follow[-1] if t == 0 else forward[t - 1] @ follow[:-1])
            scale[t] = a.sum(-1)
            forward[t] = a / scale[t][:, None]
        backward[-1] = 1
        for t in range(len(e) - 2, -1, -1):
            backward[t] = (weight[t + 1] * backward[t + 1]) @ follow[:-1].T / scale[t + 1][:, None]
        weight /= scale[..., None]
        return forward * backward, (np.log(scale) + top[..., 0]).sum(0), forward, weight, backward

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean negative log likelihood of the tags, its gradients)."""
        p, (n, length) = self.params, ids.shape
        states = self._states(ids)
        e = self.emissions(ids, states)
        prob, log_all, forward, weight, backward = self.marginals(e)
        gold, rows, steps = tags.T, np.arange(n)[None], np.arange(length)[:, None]
        score = e[steps, rows, gold].sum(0) + p["follow"][-1, gold[0]] + p["follow"][gold[:-1], gold[1:]].sum(0)
        d_e = prob.copy()
        d_e[steps, rows, gold] -= 1
        d_e /= n
        pairs = np.einsum("tna,tnb->ab", forward[:-1], weight[1:] * backward[1:]) * self._transitions()[:-1]
        np.subtract.at(pairs, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        first = prob[0].sum(0) - np.bincount(gold[0], minlength=e.shape[-1])
        grads = {"follow": np.where(allowed(self.n_kinds), np.concatenate([pairs, first[None]]) / n, 0), "bias": d_e.sum((0, 1))}
        h = states["h"]
        joined = np.concatenate([h[:, 0], h[::-1, 1]], -1)
        grads["out"] = np.einsum("tnh,tnk->hk", joined, d_e)
        d_joined, hidden = d_e @ p["out"].T, h.shape[-1]
        d_out = np.stack([d_joined[..., :hidden], d_joined[::-1, :, hidden:]], 1)
        d_z = np.empty_like(states["gates"])
        d_h = d_c = np.zeros_like(h[0])
        grads["again"] = np.zeros_like(p["again"])
        for t in range(length - 1, -1, -1):
            i, f, o, g = (states["gates"][t][..., k * hidden : (k + 1) * hidden] for k in range(4))
            d_h = d_h + d_out[t]
            d_c = d_c + d_h * o * (1 - states["tanh"][t] ** 2)
            before = states["cell"][t - 1] if t else np.zeros_like(d_c)
            for k, d in enumerate((d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * states["tanh"][t] * o * (1 - o), d_c * i * (1 - g**2))):
                d_z[t][..., k * hidden : (k + 1) * hidden] = d
            if t:
                grads["again"] += h[t - 1].transpose(0, 2, 1) @ d_z[t]
            d_c = d_c * f
            d_h = d_z[t] @ p["again"].transpose(0, 2, 1)
        grads["gate"] = d_z.sum((0, 2))[:, None]
        table = np.zeros((2, self.n_chars, 4 * hidden), d_z.dtype)
        for way in range(2):
            order = np.argsort(states["both"][:, way].ravel(), kind="stable")
            chars = states["both"][:, way].ravel()[order]
            edges = np.flatnonzero(np.diff(chars, prepend=-1))
            table[way, chars[edges]] = np.add.reduceat(d_z[:, way].reshape(-1, 4 * hidden)[order], edges)
        grads["into"] = p["embed"].T @ table
        grads["embed"] = (table @ p["into"].transpose(0, 2, 1)).sum(0)
        return float((log_all - score).mean()), grads

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int, seed: int) -> list[float]:
        """Adam over shuffled batches with a falling rate; returns the loss of each step."""
        rng, losses = np.random.default_rng(seed), []
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.params.items()}
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < min(batch, len(ids)):
                order = rng.permutation(len(ids))
            some, order = order[:batch], order[batch:]
            loss, grads = self.loss(ids[some], tags[some])
            losses.append(loss)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5 / max(norm, 1e-9))
                m, v = moments[k]
                m += (1 - BETAS[0]) * (g - m)
                v += (1 - BETAS[1]) * (g * g - v)
                rate = RATE * (1 - 0.9 * step / steps)
                self.params[k] -= (rate * (m / (1 - BETAS[0] ** step)) / (np.sqrt(v / (1 - BETAS[1] ** step)) + 1e-8)).astype(self.params[k].dtype)
        return losses


def best_path(log_p: np.ndarray, n_kinds: int) -> np.ndarray:
    """The likeliest allowed tags of one sequence of (length, tags) log probabilities."""
    barred = np.where(allowed(n_kinds), 0, -np.inf)
    score, came = log_p[0] + barred[-1], np.zeros(log_p.shape, np.int8)
    for t in range(1, len(log_p)):
        each = score[:, None] + barred[:-1]
        came[t] = each.argmax(0)
        score = each[came[t], np.arange(len(score))] + log_p[t]
    tags = np.empty(len(log_p), np.int64)
    tags[-1] = score.argmax()
    for t in range(len(log_p) - 1, 0, -1):
        tags[t - 1] = came[t, tags[t]]
    return tags
