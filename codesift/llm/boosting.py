"""Gradient-boosted trees for two classes on binned features, trained on a bounded sample."""

from __future__ import annotations

import numpy as np

from . import shipped

shipped(__name__)

BINS = 32


class Boosted:
    """Trees of one depth as arrays; a value goes right when it exceeds the cut."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (leaf.size - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 100, depth: int = 5, rate: float = 0.2, least: float = 3.0,
        rows: float = 0.5, columns: float = 0.4, seed: int = 1) -> Boosted:
    """Newton steps on the logistic loss; splits by the gain over all bins of some features, on some rows for each tree."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    mean = np.average(y, weights=weight).clip(0.01, 0.99)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(n, base)
    all_f, all_c, all_l = [], [], []
    inner, used = (1 << depth) - 1, max(1, int(width * columns))
    offset = np.arange(used) * BINS
    for _ in range(trees):
        own, some = np.sort(rng.permutation(width)[:used]), np.flatnonzero(rng.random(n) < rows)
        p = 1 / (1 + np.exp(-score[some]))
        g, h = weight[some] * (p - y[some]), weight[some] * np.maximum(p * (1 - p), 1e-6)
        part, values = binned[np.ix_(some, own)], x[some]
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(some), np.int64)
        each_g, each_h = np.repeat(g, used), np.repeat(h, used)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            at = (((node - first) * (used * BINS))[:, None] + offset + part).ravel()
            gs = np.bincount(at, each_g, many * used * BINS).reshape(many, used, BINS)
            hs = np.bincount(at, each_h, many * used * BINS).reshape(many, used, BINS)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gt**2 / (ht + 1)
            gain[(hl < least) | (hr < least)] = -1
            flat = gain.reshape(many, -1)
            best = flat.argmax(1)
            for k in range(many):
                j, b = divmod(int(best[k]), BINS)
                if flat[k, best[k]] > 1e-9 and b < len(cuts[own[j]]):
                    feature[first + k], cut[first + k] = own[j], cuts[own[j]][b]
            node = 2 * node + 1 + (values[np.arange(len(some)), feature[node]] > cut[node])
        slot = node - inner
        leaf = -rate * np.bincount(slot, g, 1 << depth) / (np.bincount(slot, h, 1 << depth) + 1)
        tree = Boosted(0.0, feature[None], cut[None], leaf[None])
        score += tree.logit(x)
        all_f.append(feature)
        all_c.append(cut)
        all_l.append(leaf)
    return Boosted(base, np.array(all_f), np.array(all_c), np.array(all_l))
