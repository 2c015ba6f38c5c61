"""A linear-chain conditional random field over string features, trained by maximum likelihood."""

from __future__ import annotations

import numpy as np

Sequence = list[list[str]]  # features of each token


class LinearChain:
    """Weights of features by label, of label pairs and of the first label; labels are 0 .. labels - 1."""

    def __init__(self, labels: int) -> None:
        self.labels = labels
        self.index: dict[str, int] = {}
        self.weights = np.zeros((1, labels))
        self.moves = np.zeros((labels, labels))
        self.first = np.zeros(labels)

    def _ids(self, seqs: list[Sequence]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat feature ids, the token of each, and the lengths; unknown features are left out."""
        index = self.index
        ids: list[int] = []
        counts: list[int] = []
        for seq in seqs:
            for feats in seq:
                known = [i for i in map(index.get, feats) if i is not None]
                ids += known
                counts.append(len(known))
        token = np.repeat(np.arange(len(counts)), counts)
        return np.array(ids, dtype=np.int64), token, np.array([len(s) for s in seqs])

    def _scores(self, ids: np.ndarray, token: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Padded label scores (sequences, longest, labels)."""
        total = int(lengths.sum())
        flat = np.zeros((total, self.labels))
        for y in range(self.labels):
            flat[:, y] = np.bincount(token, weights=self.weights[ids, y], minlength=total)
        out = np.zeros((len(lengths), int(lengths.max()), self.labels))
        out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
        return out

    def decode(self, seqs: list[Sequence]) -> list[np.ndarray]:
        """The most likely labels of each sequence (Viterbi)."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(seqs)
        order = sorted((i for i in range(len(seqs)) if seqs[i]), key=lambda i: len(seqs[i]))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            ids, token, lengths = self._ids([seqs[i] for i in part])
            scores = self._scores(ids, token, lengths)
            best = scores[:, 0] + self.first
            back = np.zeros(scores.shape, dtype=np.int64)
            for t in range(1, scores.shape[1]):
                options = best[:, :, None] + self.moves[None]
                back[:, t] = options.argmax(axis=1)
                after = options.max(axis=1) + scores[:, t]
                best = np.where((t < lengths)[:, None], after, best)
            last = best.argmax(axis=1)
            for row, i in enumerate(part):
                y = np.zeros(lengths[row], dtype=np.int64)
                y[-1] = last[row]
                for t in range(lengths[row] - 1, 0, -1):
                    y[t - 1] = back[row, t, y[t]]
                out[i] = y
        return out

    def fit(self, seqs: list[Sequence], labels: list[list[int]], rounds: int = 8, rate: float = 0.15, l2: float = 1e-5, batch: int = 128, seed: int = 5, least: int = 2) -> LinearChain:
        """Adagrad on the likelihood; features that occur less than ``least`` times are left out."""
        counts: dict[str, int] = {}
        for seq in seqs:
            for feats in seq:
                for f in feats:
                    counts[f] = counts.get(f, 0) + 1
        self.index = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= least))}
        self.weights = np.zeros((len(self.index), self.labels))
        params = [self.weights, self.moves, self.first]
        squares = [np.full(p.shape, 1e-8) for p in params]
        rng = np.random.default_rng(seed)
        order = np.array(sorted((i for i in range(len(seqs)) if seqs[i]), key=lambda i: len(seqs[i])))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        ready = [(self._ids([seqs[i] for i in g]), np.concatenate([labels[i] for i in g]).astype(np.int64)) for g in groups]
        for _ in range(rounds):
            for g in rng.permutation(len(groups)):
                (ids, token, lengths), truth = ready[g]
                grads = self._gradients(ids, token, lengths, truth)
                for p, s, d in zip(params, squares, grads, strict=True):
                    d = d / len(lengths) + l2 * p
                    s += d * d
                    p -= rate * d / np.sqrt(s)
        return self

    def _gradients(self, ids: np.ndarray, token: np.ndarray, lengths: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
        scores = self._scores(ids, token, lengths)
        n, longest, k = scores.shape
        live = np.arange(longest)[None, :] < lengths[:, None]
        fore = np.zeros_like(scores)
        fore[:, 0] = scores[:, 0] + self.first
        for t in range(1, longest):
            step = np.logaddexp.reduce(fore[:, t - 1, :, None] + self.moves[None], axis=1) + scores[:, t]
            fore[:, t] = np.where(live[:, t, None], step, fore[:, t - 1])
        whole = np.logaddexp.reduce(fore[:, -1], axis=1)
        back = np.zeros_like(scores)
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(self.moves[None] + (scores[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(live[:, t + 1, None], step, 0.0)
        given = np.exp(fore + back - whole[:, None, None])
        flat = given[live]
        wrong = flat.copy()
        wrong[np.arange(len(truth)), truth] -= 1
        gw = np.zeros_like(self.weights)
        for y in range(k):
            gw[:, y] = np.bincount(ids, weights=wrong[token, y], minlength=len(gw))
        moved = np.zeros((k, k))
        for t in range(1, longest):
            on = live[:, t]
            pair = fore[on, t - 1, :, None] + self.moves[None] + (scores[on, t] + back[on, t])[:, None, :] - whole[on, None, None]
            moved += np.exp(pair).sum(axis=0)
        padded = np.full((n, longest), -1)
        padded[live] = truth
        np.subtract.at(moved, (padded[:, :-1][live[:, 1:]], padded[:, 1:][live[:, 1:]]), 1)
        begun = given[:, 0].sum(axis=0) - np.bincount(padded[:, 0], minlength=k)
        return [gw, moved, begun]
