"""A small convolutional text classifier in numpy: hashed word embeddings, filters of
several widths, max pooling, one dense layer."""

from __future__ import annotations

import numpy as np

from .words import _KIND, span_hashes, split

#: for the classifier a word is a run of ASCII letters, digits and longer characters
GAP = (_KIND == 0) | (_KIND == 4)
GAP[0x80:] = False


#: bytes of the word beginnings that have embeddings of their own beside the whole word
PREFIXES = (4, 5)


def word_ids(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the lower-cased words of each row and of their beginnings (one row of
    three for each word; 0 is padding), and where rows start."""
    starts, stops, lo = split(data, at, GAP)
    got = span_hashes(data, starts, [stops, *[np.minimum(stops, starts + n) for n in PREFIXES]], fold=True)
    ids = [(h + np.uint64(i)) % np.uint64(buckets - 1) + np.uint64(1) for i, h in enumerate(got)]
    return np.stack(ids, 1).astype(np.int32), lo


class Cnn:
    """p = sigmoid(dense(max over positions of relu(sum_j emb[word i+j] @ filter[j] + bias)))."""

    def __init__(self, buckets: int = 1 << 16, dim: int = 8, filters: int = 6, widths: tuple[int, ...] = (1, 2, 3), seed: int = 5):
        rng = np.random.default_rng(seed)
        self.buckets, self.widths, self.filters = buckets, widths, filters
        self.emb = (rng.standard_normal((buckets, dim)) * 0.05).astype(np.float32)
        self.emb[0] = 0
        self.w = [(rng.standard_normal((k, dim, filters)) * 0.3).astype(np.float32) for k in widths]
        self.b = [np.zeros(filters, np.float32) for _ in widths]
        self.dense = (rng.standard_normal(filters * len(widths)) * 0.3).astype(np.float32)
        self.bias = np.float32(0)
        self.tables = None

    def start_from_counts(self, docs: list[np.ndarray], y: np.ndarray, prior: float = 8.0) -> None:
        """Let the first dimension begin as the shrunken log-odds of a word's documents,
        read by the first filter of width one: pooling then finds telling words at once."""
        seen, hit = np.zeros(self.buckets), np.zeros(self.buckets)
        for ids, label in zip(docs, y.tolist(), strict=True):
            words = np.unique(ids)
            seen[words] += 1
            hit[words] += label
        base = min(max(y.mean(), 1e-3), 1 - 1e-3)
        rate = (hit + prior * base) / (seen + prior)
        self.emb[:, 0] = np.clip(np.log(rate / (1 - rate)) - np.log(base / (1 - base)), -3, 6) * (seen > 0)
        self.emb[0] = 0
        for w in self.w:
            w[:, 0, 0] = 0
        self.w[0][0, :, 0] = 0
        self.w[0][0, 0, 0] = 1
        self.dense[0] = 1
        self.bias = np.float32(np.log(base / (1 - base)) - 1)

    def _tables(self):
        if self.tables is None:
            self.tables = [[self.emb @ w[j] for j in range(len(w))] for w in self.w]
        return self.tables

    def pooled(self, ids: np.ndarray, lo: np.ndarray, tables=None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled features of each row and the positions they come from.  A row shorter
        than a filter counts as followed by padding; one without words pools to 0."""
        n, feats, where = len(lo) - 1, [], []
        some = np.flatnonzero(np.diff(lo) > 0)
        end = np.repeat(lo[1:], np.diff(lo))
        words = None if tables else self.emb[ids].sum(1)
        for w, b, width in zip(self.w, self.b, self.widths, strict=True):
            out = np.zeros((n, self.filters), np.float32)
            pos = np.full((n, self.filters), -1, np.int64)
            if len(some):
                act = np.zeros((len(ids), self.filters), np.float32) + b
                for j in range(width):
                    inside = np.arange(len(ids)) + j < end
                    at = np.minimum(np.arange(len(ids)) + j, len(ids) - 1)
                    if tables:
                        t = tables[self.widths.index(width)][j]
                        word = np.where(inside[:, None], ids[at], 0) if j else ids
                        for c in range(word.shape[1]):
                            act += t[word[:, c]]
                    else:
                        act += (words[at] * inside[:, None] if j else words) @ w[j]
                top = np.maximum.reduceat(act, lo[some])
                out[some] = top
                if not tables:
                    hit = act == np.repeat(out, np.diff(lo), axis=0)
                    for f in range(self.filters):
                        at = np.flatnonzero(hit[:, f])
                        rows = np.searchsorted(lo, at, side="right") - 1
                        pos[rows[::-1], f] = at[::-1]
            feats.append(np.maximum(out, 0))
            where.append(np.where(out > 0, pos, -1))
        return np.concatenate(feats, 1), where

    def score(self, ids: np.ndarray, lo: np.ndarray) -> np.ndarray:
        x, _ = self.pooled(ids, lo, self._tables())
        return 1 / (1 + np.exp(-(x @ self.dense + self.bias).astype(float)))

    def score_rows(self, docs: list[np.ndarray], batch: int = 64) -> np.ndarray:
        out = [np.zeros(0)]
        for k in range(0, len(docs), batch):
            some = docs[k:k + batch]
            out.append(self.score(np.concatenate(some), np.concatenate([[0], np.cumsum([len(d) for d in some])])))
        return np.concatenate(out)

    def train(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """Adagrad on the log loss, in an order fixed by ``seed``."""
        rng = np.random.default_rng(seed)
        params = [self.emb, *self.w, *self.b, self.dense]
        memory = [np.full_like(p, 1e-2) for p in params]
        bias_memory = 1e-2

        def step(i, grad, at=slice(None)):
            memory[i][at] += grad * grad
            params[i][at] -= rate * grad / np.sqrt(memory[i][at])

        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for k in range(0, len(order), batch):
                some = order[k:k + batch]
                lo = np.concatenate([[0], np.cumsum([len(docs[i]) for i in some])])
                ids = np.concatenate([docs[i] for i in some])
                x, where = self.pooled(ids, lo)
                p = 1 / (1 + np.exp(-(x @ self.dense + self.bias)))
                g = ((p - y[some]) / len(some)).astype(np.float32)
                gx = g[:, None] * self.dense * (x > 0)
                gd = x.T @ g
                touched, grads = [], []
                for f, (w, width) in enumerate(zip(self.w, self.widths, strict=True)):
                    gf = gx[:, f * self.filters:(f + 1) * self.filters]
                    row, col = np.nonzero((where[f] >= 0) & (gf != 0))
                    gv, at = gf[row, col], where[f][row, col]
                    gw = np.zeros_like(w)
                    for j in range(width):
                        inside = at + j < lo[row + 1]
                        word = ids[np.minimum(at + j, len(ids) - 1)] if len(ids) else ids
                        r = np.flatnonzero(inside)
                        np.add.at(gw[j].T, col[r], gv[r, None] * self.emb[word[r]].sum(1))
                        for c in range(word.shape[1]):
                            touched.append(word[r, c])
                            grads.append(gv[r, None] * w[j].T[col[r]])
                    gb = gf.sum(0)
                    step(1 + f, gw)
                    step(1 + len(self.w) + f, gb)
                words = np.concatenate(touched) if touched else np.zeros(0, np.int64)
                if len(words):
                    u, inv = np.unique(words, return_inverse=True)
                    ge = np.zeros((len(u), self.emb.shape[1]), np.float32)
                    np.add.at(ge, inv, np.concatenate(grads))
                    step(0, ge, u)
                step(len(params) - 1, gd)
                gb = float(g.sum())
                bias_memory += gb * gb
                self.bias -= np.float32(rate * gb / np.sqrt(bias_memory))
        self.emb[0] = 0
        self.tables = None


#: the cutoffs to choose from
GRID = np.arange(1, 20) / 20


def threshold_of(counts: np.ndarray, least: int = 50) -> float:
    """The cutoff of GRID with the fewest errors, false rejections counted twice, the
    nearest to 0.5 of equals; 0.5 with fewer than ``least`` rows of either label.
    ``counts``: rows by label (0, 1) and number of cutoffs that the score reaches."""
    if counts.sum(1).min() < least:
        return 0.5
    wrong = [2 * counts[0, i + 1:].sum() + counts[1, :i + 1].sum() for i in range(len(GRID))]
    return float(min(zip(wrong, abs(GRID - 0.5), GRID, strict=True))[2])


def best_threshold(score: np.ndarray, y: np.ndarray, least: int = 50) -> float:
    """``threshold_of`` the scores and labels."""
    bins = np.searchsorted(GRID, score, side="right")
    return threshold_of(np.stack([np.bincount(bins[y == k], minlength=len(GRID) + 1) for k in (0, 1)]), least)
