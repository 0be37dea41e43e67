"""A linear-chain conditional random field over hashed features, in numpy.

Two labels: outside (0) and secret (1). A token's features index one weight per label; a
2 x 2 matrix weighs neighbouring labels. Training maximises the regularised likelihood by
Adagrad over batches of sequences of similar length, with forward-backward run on a whole
batch at once; decoding is Viterbi.
"""

from __future__ import annotations

import zlib

import numpy as np

BUCKETS = 1 << 15


class Remembered:
    """A function of one text that keeps its last results, those of long texts excepted. They are
    not shipped to workers."""

    MOST, LONG = 1 << 15, 256

    def __init__(self, of):
        self.of, self.seen = of, {}

    def __call__(self, value):
        try:
            return self.seen[value]
        except KeyError:
            if len(value) > self.LONG:
                return self.of(value)
            if len(self.seen) >= self.MOST:
                self.seen.clear()
            self.seen[value] = got = self.of(value)
            return got

    def __reduce__(self):
        return Remembered, (self.of,)


@Remembered
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def feature_ids(names: list[str]) -> np.ndarray:
    return np.array([_bucket(n) for n in names], np.int64)


class LinearChainCRF:
    def __init__(self) -> None:
        self.w = np.zeros((BUCKETS, 2))
        self.trans = np.zeros((2, 2))
        self.start = np.zeros(2)
        self.says: dict[str, float] = {}
        self.parts: dict[tuple, float] = {}

    def emissions(self, seq: list[np.ndarray]) -> np.ndarray:
        """(tokens, 2) scores."""
        if not seq:
            return np.zeros((0, 2))
        size = np.array([len(f) for f in seq])
        flat = self.w[np.concatenate(seq)]
        return np.add.reduceat(flat, np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)

    def viterbi(self, seq: list[np.ndarray]) -> list[int]:
        e = self.emissions(seq)
        if not len(e):
            return []
        t = self.trans
        a, b = e[0, 0] + self.start[0], e[0, 1] + self.start[1]
        back = []
        for x, y in e[1:]:
            p0, q0 = a + t[0, 0], b + t[1, 0]
            p1, q1 = a + t[0, 1], b + t[1, 1]
            back.append((int(q0 > p0), int(q1 > p1)))
            a, b = max(p0, q0) + x, max(p1, q1) + y
        path = [int(b > a)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def _says(self, name: str) -> float:
        """How far a feature speaks for label 1 against label 0."""
        got = self.says.get(name)
        if got is None:
            w = self.w[_bucket(name)]
            got = float(w[1] - w[0])
            if len(name) <= Remembered.LONG:
                if len(self.says) >= Remembered.MOST:
                    self.says.clear()
                self.says[name] = got
        return got

    def decode(self, seq: list[tuple[tuple, list[str]]], names_of) -> list[int]:
        """The path of `viterbi` for tokens given as (part, names): `names_of(part)` are the names
        of a part that recurs, whose sum is kept."""
        parts, says, t = self.parts, self._says, self.trans.tolist()
        a, b = self.start.tolist()
        back = []
        for i, (part, names) in enumerate(seq):
            d = parts.get(part)
            if d is None:
                spelt = names_of(part)
                d = sum(map(says, spelt))
                if max(map(len, spelt)) <= Remembered.LONG:
                    if len(parts) >= Remembered.MOST:
                        parts.clear()
                    parts[part] = d
            for n in names:
                d += says(n)
            if i:
                p0, q0, p1, q1 = a + t[0][0], b + t[1][0], a + t[0][1], b + t[1][1]
                back.append((q0 > p0, q1 > p1))
                a, b = max(p0, q0), max(p1, q1) + d
            else:
                b += d
        path = [int(b > a)] if seq else []
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]

    def fit(self, seqs: list[list[np.ndarray]], labels: list[list[int]], epochs: int = 10, rate: float = 0.3, ridge: float = 1e-6, batch: int = 64) -> "LinearChainCRF":
        rng = np.random.default_rng(5)
        order = sorted((i for i in range(len(seqs)) if seqs[i]), key=lambda i: len(seqs[i]))
        batches = [order[s : s + batch] for s in range(0, len(order), batch)]
        gw, gt, gs = np.full((BUCKETS, 2), 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                ids = batches[k]
                n, longest = len(ids), max(len(seqs[i]) for i in ids)
                e = np.zeros((n, longest, 2))
                y = np.zeros((n, longest), np.int64)
                mask = np.zeros((n, longest), bool)
                for r, i in enumerate(ids):
                    m = len(seqs[i])
                    e[r, :m] = self.emissions(seqs[i])
                    y[r, :m] = labels[i]
                    mask[r, :m] = True
                p, pair = self._marginals(e, mask)
                want = np.eye(2)[y]
                d = np.where(mask[:, :, None], p - want, 0.0)
                both = mask[:, 1:]
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
                g_t = (pair - seen) / n + ridge * self.trans
                g_s = d[:, 0].sum(0) / n
                rows = [seqs[i][t] for i in ids for t in range(len(seqs[i]))]
                flat = np.concatenate(rows)
                owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
                dv = d[mask] / n
                g = np.stack([np.bincount(flat, dv[owner, c], BUCKETS) for c in (0, 1)], 1)
                hit = np.unique(flat)
                gi = g[hit] + ridge * self.w[hit]
                gw[hit] += gi * gi
                self.w[hit] -= rate * gi / np.sqrt(gw[hit])
                gt += g_t * g_t
                self.trans -= rate * g_t / np.sqrt(gt)
                gs += g_s * g_s
                self.start -= rate * g_s / np.sqrt(gs)
        return self

    def _marginals(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each label at each place, and expected counts of label pairs."""
        n, length, _ = e.shape
        fwd = np.zeros_like(e)
        fwd[:, 0] = e[:, 0] + self.start
        for t in range(1, length):
            step = np.logaddexp(fwd[:, t - 1, 0, None] + self.trans[0], fwd[:, t - 1, 1, None] + self.trans[1]) + e[:, t]
            fwd[:, t] = np.where(mask[:, t, None], step, fwd[:, t - 1])
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        bwd = np.zeros_like(e)
        for t in range(length - 2, -1, -1):
            nxt = e[:, t + 1] + bwd[:, t + 1]
            step = np.logaddexp(self.trans[:, 0] + nxt[:, 0, None], self.trans[:, 1] + nxt[:, 1, None])
            bwd[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        p = np.exp(np.clip(fwd + bwd - total[:, None, None], -60, 0))
        pair = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                z = fwd[:, :-1, a] + self.trans[a, b] + e[:, 1:, b] + bwd[:, 1:, b] - total[:, None]
                pair[a, b] = np.exp(np.clip(z, -60, 0))[mask[:, 1:]].sum()
        return p, pair
