"""Fitting the embedding table to teacher vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from recallgrid.functions.text import bucket_pair, embed_tokens

# Least pairs, least hold-out, share held out, margin of acceptance.
LEAST_PAIRS, LEAST_HELD, HELD_SHARE, MARGIN = 24, 5, 0.2, 0.01


@dataclass
class Fit:
    pairs: int
    trained: bool = False
    before: float = 0.0
    after: float = 0.0
    table: np.ndarray | None = None

    @property
    def accepted(self) -> bool:
        return self.table is not None


class _Adam:
    def __init__(self, weights: np.ndarray, rate: float):
        self.weights, self.rate, self.steps = weights, rate, 0
        self.mean, self.square = np.zeros_like(weights), np.zeros_like(weights)

    def step(self, gradient: np.ndarray) -> None:
        self.steps += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.001 * (gradient * gradient - self.square)
        mean, square = self.mean / (1 - 0.9**self.steps), self.square / (1 - 0.999**self.steps)
        self.weights -= self.rate * mean / (np.sqrt(square) + 1e-8)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def agreement(local: np.ndarray, teacher: np.ndarray) -> float:
    """Correlation of the pairwise cosines of two sets of vectors; 0 for less than 2 or constant ones."""
    if len(local) < 2:
        return 0.0
    upper = np.triu_indices(len(local), k=1)
    a, b = ((_unit(x) @ _unit(x).T)[upper] for x in (local, teacher))
    return 0.0 if a.std() < 1e-9 or b.std() < 1e-9 else float(np.corrcoef(a, b)[0, 1])


def fit_table(texts: list[str], teachers: np.ndarray, table: np.ndarray, epochs: int = 4, rate: float = 1e-3, batch: int = 64, seed: int = 7) -> Fit:
    """A table whose text vectors, through a linear bridge, come nearer to the teachers'.

    A fifth of the pairs (at least 5) is held out; the new table is accepted only if its agreement with the
    teachers there beats the old one's by more than the margin. The given table isn't changed.
    """
    out = Fit(len(texts))
    if len(texts) < LEAST_PAIRS:
        return out
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = max(LEAST_HELD, int(len(texts) * HELD_SHARE))
    ids = [np.array([bucket_pair(t, len(table)) for t in embed_tokens(x)], dtype=np.int64).ravel() for x in texts]
    goal = _unit(np.asarray(teachers, dtype=np.float64)).astype(np.float32)
    judged = [i for i in order[:held] if len(ids[i])]
    train = np.array([i for i in order[held:] if len(ids[i])], dtype=np.int64)
    vectors = lambda w, rows: np.stack([w[ids[i]].mean(axis=0) for i in rows]) if len(rows) else np.zeros((0, w.shape[1]))
    words = _Adam(table.copy(), rate)
    bridge = _Adam((rng.standard_normal((goal.shape[1], table.shape[1])) / np.sqrt(table.shape[1])).astype(np.float32), rate)
    for _ in range(epochs):
        rng.shuffle(train)
        for start in range(0, len(train), batch):
            rows = train[start : start + batch]
            e = vectors(words.weights, rows)
            miss = e @ bridge.weights.T - goal[rows]
            back = miss @ bridge.weights / len(rows)
            sizes = np.array([len(ids[i]) for i in rows])
            gradient = np.zeros_like(words.weights)
            np.add.at(gradient, np.concatenate([ids[i] for i in rows]), np.repeat(back / sizes[:, None], sizes, axis=0))
            bridge.step((miss.T @ e / len(rows)).astype(np.float32))
            words.step(gradient)
    out.trained = True
    out.before, out.after = (agreement(vectors(w, judged), goal[judged]) for w in (table, words.weights))
    if out.after > out.before + MARGIN:
        out.table = words.weights
    return out
