"""Linear-chain conditional random field with two labels, trained and decoded for many sequences at once."""

from __future__ import annotations

from array import array

import numpy as np


class Chain:
    """weights: feature -> label difference (label 1 against label 0); transitions by neighbour labels; start, end."""

    def __init__(self, weights: dict[str, float], trans: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.weights, self.trans, self.start, self.end = weights, trans, start, end

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def viterbi(self, scores: list[float]) -> list[int]:
        """The most probable labels of one sequence, given each item's score for label 1 (label 0 scores 0)."""
        if not scores:
            return []
        t00, t01, t10, t11 = (float(x) for x in self.trans.reshape(-1))
        a, b = float(self.start[0]), float(self.start[1]) + scores[0]
        back = []
        for s in scores[1:]:
            from0 = a + t00 >= b + t10
            from1 = a + t01 >= b + t11
            a, b = (a + t00 if from0 else b + t10), (a + t01 if from1 else b + t11) + s
            back.append((0 if from0 else 1, 0 if from1 else 1))
        y = 0 if a + float(self.end[0]) >= b + float(self.end[1]) else 1
        out = [y]
        for step in reversed(back):
            y = step[y]
            out.append(y)
        return out[::-1]

    @staticmethod
    def fit(sequences: list[list[list[str]]], labels: list[list[int]], rounds: int = 80, rate: float = 0.12, decay: float = 2e-4, least: int = 2) -> Chain:
        """Maximum likelihood with weight decay by Adam over the whole sample; forward-backward runs on all sequences at once."""
        count: dict[str, int] = {}
        for seq in sequences:
            for item in seq:
                for f in item:
                    count[f] = count.get(f, 0) + 1
        vocabulary = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= least))}
        lengths = np.array([len(s) for s in sequences])
        keep = lengths > 0
        sequences = [s for s, k in zip(sequences, keep, strict=True) if k]
        labels = [y for y, k in zip(labels, keep, strict=True) if k]
        lengths = lengths[keep]
        n, longest = len(sequences), int(lengths.max()) if len(lengths) else 0
        if n == 0:
            return Chain({}, np.zeros((2, 2)), np.zeros(2), np.zeros(2))
        cell, column = array("q"), array("q")
        y = np.zeros((n, longest), dtype=np.int64)
        for i, (seq, lab) in enumerate(zip(sequences, labels, strict=True)):
            y[i, : len(lab)] = lab
            for t, item in enumerate(seq):
                found = {vocabulary[f] for f in item if f in vocabulary}
                cell.extend([i * longest + t] * len(found))
                column.extend(found)
        cell_at, column_at = np.frombuffer(cell, dtype=np.int64), np.frombuffer(column, dtype=np.int64)
        mask = np.arange(longest)[None, :] < lengths[:, None]
        last = lengths - 1
        w = np.zeros(len(vocabulary) + 8)
        m, v = np.zeros_like(w), np.zeros_like(w)
        size = len(vocabulary)
        at = np.arange(n)
        items = float(mask.sum())
        for step in range(1, rounds + 1):
            emit = np.bincount(cell_at, weights=w[column_at], minlength=n * longest).reshape(n, longest)
            trans, start, end = w[size : size + 4].reshape(2, 2), w[size + 4 : size + 6], w[size + 6 : size + 8]
            forward = np.zeros((n, longest, 2))
            backward = np.zeros((n, longest, 2))
            e = np.stack([np.zeros_like(emit), emit], axis=2)
            forward[:, 0] = start + e[:, 0]
            for t in range(1, longest):
                z = forward[:, t - 1, :, None] + trans[None]
                forward[:, t] = np.logaddexp(z[:, 0], z[:, 1]) + e[:, t]
            backward[at, last] = end
            for t in range(longest - 2, -1, -1):
                z = trans[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :]
                b = np.logaddexp(z[:, :, 0], z[:, :, 1])
                backward[:, t] = np.where((t < last)[:, None], b, np.where((t == last)[:, None], end, 0.0))
            total = forward[at, last] + end
            log_z = np.logaddexp(total[:, 0], total[:, 1])
            node = np.exp(forward + backward - log_z[:, None, None]) * mask[:, :, None]
            gradient = np.zeros_like(w)
            gradient[:size] = np.bincount(column_at, weights=(node[:, :, 1] - y * mask).reshape(-1)[cell_at], minlength=size)
            pair_mask = mask[:, 1:]
            edge = forward[:, :-1, :, None] + trans[None, None] + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - log_z[:, None, None, None]
            expected = (np.exp(np.where(pair_mask[:, :, None, None], edge, -np.inf))).sum(axis=(0, 1))
            observed = np.zeros((2, 2))
            np.add.at(observed, (y[:, :-1][pair_mask], y[:, 1:][pair_mask]), 1)
            gradient[size : size + 4] = (expected - observed).reshape(-1)
            first = np.bincount(y[:, 0], minlength=2)
            final = np.bincount(y[at, last], minlength=2)
            gradient[size + 4 : size + 6] = node[:, 0].sum(axis=0) - first
            gradient[size + 6 : size + 8] = node[at, last].sum(axis=0) - final
            gradient = gradient / items + decay * w / 10
            m = 0.9 * m + 0.1 * gradient
            v = 0.999 * v + 0.001 * gradient**2
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights = {f: float(w[i]) for f, i in vocabulary.items() if abs(w[i]) > 1e-3}
        return Chain(weights, w[size : size + 4].reshape(2, 2).copy(), w[size + 4 : size + 6].copy(), w[size + 6 : size + 8].copy())
