"""A linear-chain conditional random field over word features, in numpy.

Scores are exact for sequences of any length: a sequence is cut into blocks, the product of
each block's transfer matrices is computed for all blocks at once, one short scan passes the
messages from block to block, and a second pass over all blocks gives every token's marginals.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Sequence

import numpy as np

BLOCK = 128
BIAS = "\x00"


def _blocks(lens: np.ndarray, size: int):
    """Block starts and lengths, longest first; per sequence the blocks in order; whether a block opens its sequence."""
    per = np.maximum(1, -(-lens // size)) * (lens > 0)
    seq = np.repeat(np.arange(len(lens)), per)
    first = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64)
    nth = np.arange(len(seq)) - first[seq]
    offset = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
    start = offset[seq] + nth * size
    length = np.minimum(size, lens[seq] - nth * size)
    order = np.argsort(-length, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return start[order], length[order], (nth == 0)[order], per, first, place


def _norm(x: np.ndarray) -> np.ndarray:
    """x divided by its sums over all axes but the last."""
    return x / np.maximum(x.sum(axis=tuple(range(x.ndim - 1))), 1e-300)


def marginals(emit: np.ndarray, lens: Sequence[int], trans: np.ndarray, start: np.ndarray, *, pairs: bool = False):
    """Posterior label probabilities [tokens, labels] by forward-backward.

    emit: log scores of the concatenated sequences; lens: their lengths, zero allowed.
    With pairs also the expected number of each transition [labels, labels].
    Inside, labels are the leading axes and tokens or blocks the last, so numpy runs along memory."""
    lens = np.asarray(lens, np.int64)
    n, k = emit.shape
    joint = np.zeros((k, k))
    if n == 0:
        return (np.zeros((n, k)), joint) if pairs else np.zeros((n, k))
    p = np.ascontiguousarray(np.exp(emit - emit.max(axis=1, keepdims=True)).T)
    a = np.exp(trans - trans.max())
    s = np.exp(start - start.max())
    s = (s / s.sum())[:, None]
    at, length, opens, per, first, place = _blocks(lens, BLOCK)
    nb = len(at)
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]))]  # blocks longer than t
    many = per > 1
    come, back = np.full((k, nb), 1.0 / k), np.ones((k, nb))
    if many.any():
        # products of transfer matrices m[from, to, block], of the blocks of cut sequences
        cut = np.sort(place[np.concatenate([np.arange(f, f + c) for f, c in zip(first[many], per[many], strict=True)])])
        slot = np.full(nb, -1)
        slot[cut] = np.arange(len(cut))
        m = np.repeat(np.eye(k)[:, :, None], len(cut), axis=2)
        for t, c in enumerate(active):
            c = int(np.searchsorted(cut, c))
            step = np.matmul(a.T, m[:, :, :c])
            if t == 0:
                step[:, :, opens[cut[:c]]] = s
            step *= p[:, at[cut[:c]] + t]
            m[:, :, :c] = _norm(step) if t % 8 == 7 else step
        m = _norm(m)
        # messages between blocks
        seqs = np.argsort(-per, kind="stable")
        depth = per[seqs]
        deep = int(depth[0])
        some = [seqs[: int(np.searchsorted(-depth, -j, side="left"))] for j in range(deep)]
        for j in range(1, deep):
            here, before = place[first[some[j]] + j], place[first[some[j]] + j - 1]
            come[:, here] = _norm(np.einsum("in,ijn->jn", come[:, before], m[:, :, slot[before]]))
        for j in range(deep - 1, 0, -1):
            here, before = place[first[some[j]] + j], place[first[some[j]] + j - 1]
            back[:, before] = _norm(np.einsum("ijn,jn->in", m[:, :, slot[here]], back[:, here]))
    # tokens
    out = np.empty((k, n))
    alpha = come.copy()
    for t, c in enumerate(active):
        step = a.T @ alpha[:, :c]
        if t == 0:
            step[:, opens[:c]] = s
        alpha[:, :c] = step = _norm(step * p[:, at[:c] + t])
        out[:, at[:c] + t] = step
    beta = back
    for t in range(len(active) - 1, -1, -1):
        c = active[t]
        here = at[:c] + t
        right = p[:, here] * beta[:, :c]
        now = out[:, here]
        if pairs:
            left = out[:, here - 1] if t else come[:, :c]
            x = _norm(left[:, None] * a[:, :, None] * right[None])
            joint += x.sum(axis=2) if t else x[:, :, ~opens[:c]].sum(axis=2)
        out[:, here] = now * beta[:, :c]
        beta[:, :c] = _norm(a @ right)
    out = np.ascontiguousarray(_norm(out).T)
    return (out, joint) if pairs else out


class Vocabulary(dict):
    """Word to number; a new word gets the next number and waits in new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i


class Crf:
    """Weights of features and transitions; features(word) lists a word's features."""

    def __init__(self, labels: list[str], features: dict[str, int], weights: np.ndarray, trans: np.ndarray, start: np.ndarray, of: Callable[[str], Iterable[str]]):
        self.labels, self.features, self.weights, self.trans, self.start, self.of = labels, features, weights, trans, start, of

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)))
        get, w = self.features.get, self.weights
        for i, word in enumerate(words):
            ids = [j for f in self.of(word) if (j := get(f)) is not None]
            if ids:
                out[i] = w[ids].sum(axis=0)
        return out


class Scorer:
    """Applies a Crf to batches of texts; remembers the emissions of up to `most` words, then starts anew."""

    def __init__(self, crf: Crf, most: int = 400_000):
        self.crf, self.most = crf, most
        self.reset()

    def reset(self) -> None:
        self.words = Vocabulary()
        self.table = np.zeros((1024, len(self.crf.labels)))

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        """Marginals of the concatenated words of all texts."""
        if len(self.words) > self.most:
            self.reset()
        get = self.words.__getitem__
        lens = [len(t) for t in texts]
        ids = np.fromiter((i for t in texts for i in map(get, t)), np.int64, sum(lens))
        if new := self.words.new:
            end = len(self.words)
            if end > len(self.table):
                self.table = np.vstack([self.table, np.zeros((max(end, len(self.table)), self.table.shape[1]))])
            self.table[end - len(new) : end] = self.crf.emissions(new)
            self.words.new = []
        return marginals(self.table[ids], lens, self.crf.trans, self.crf.start)


def numbered(words: list[str], vocab: Vocabulary) -> np.ndarray:
    """The numbers of words, four bytes each: training texts are held in this form."""
    found = np.fromiter(map(vocab.__getitem__, words), np.int32, len(words))
    vocab.new.clear()
    return found


def in_parts(texts: list[np.ndarray], most: int) -> list[list[int]]:
    """The places of texts that have words, dealt in order into parts of about `most` words."""
    parts: list[list[int]] = [[]]
    size = 0
    for i, t in enumerate(texts):
        if len(t):
            if size and size + len(t) > most:
                parts.append([])
                size = 0
            parts[-1].append(i)
            size += len(t)
    return parts


def fit(vocab: Vocabulary, texts: list[np.ndarray], tags: list[np.ndarray], labels: list[str], of: Callable[[str], Iterable[str]], *, rounds: int = 30, rate: float = 0.3, l2: float = 1e-3, least: int = 2, most: int = 100_000) -> Crf:
    """Maximum likelihood by Adam on all sequences at once.

    texts: numbers of words of vocab; tags: the label number of every word. Features seen in fewer than `least` words of the
    texts are left out. Gradients are summed over parts of about `most` words, so memory does not grow with the texts but
    by their numbers. No texts, or no words: a model with zero weights."""
    k, nt = len(labels), len(vocab)
    times = np.zeros(nt, np.int64)
    for t in texts:
        np.add.at(times, t, 1)
    names: dict[str, int] = {}
    rows, cols = array("i"), array("i")
    for word, i in vocab.items():
        if times[i]:
            for f in of(word):
                rows.append(i)
                cols.append(names.setdefault(f, len(names)))
    rows, cols = np.frombuffer(rows, np.int32) if rows else np.zeros(0, np.int32), np.frombuffer(cols, np.int32) if cols else np.zeros(0, np.int32)
    keep = np.bincount(cols, weights=times[rows], minlength=len(names)) >= least
    number = np.cumsum(keep) - 1
    features = {f: int(number[j]) for f, j in names.items() if keep[j]}
    use = keep[cols]
    rows, cols = rows[use], number[cols[use]]
    nf, n = len(features), int(times.sum())
    crf = Crf(labels, features, np.zeros((nf, k)), np.zeros((k, k)), np.zeros(k), of)
    if n == 0:
        return crf
    parts = in_parts(texts, most)
    params = [crf.weights, crf.trans, crf.start]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for r in range(1, rounds + 1):
        e = np.stack([np.bincount(rows, weights=crf.weights[cols, c], minlength=nt) for c in range(k)], axis=1)
        by_type, pairs, starts = np.zeros((nt, k)), np.zeros((k, k)), np.zeros(k)
        for part in parts:
            ids, y = np.concatenate([texts[i] for i in part]), np.concatenate([tags[i] for i in part])
            lens = np.array([len(texts[i]) for i in part], np.int64)
            heads = np.concatenate([[0], np.cumsum(lens)[:-1]])
            inner = np.ones(len(ids), bool)
            inner[heads] = False
            pos = np.flatnonzero(inner)
            rest, joint = marginals(e[ids], lens, crf.trans, crf.start, pairs=True)
            rest *= -1
            rest[np.arange(len(ids)), y] += 1
            np.add.at(pairs, (y[pos - 1], y[pos]), 1)
            pairs -= joint
            starts += rest[heads].sum(axis=0)
            by_type += np.stack([np.bincount(ids, weights=rest[:, c], minlength=nt) for c in range(k)], axis=1)
        grads = [np.stack([np.bincount(cols, weights=by_type[rows, c], minlength=nf) for c in range(k)], axis=1) / n, pairs / n, starts / n]
        for x, g, m1, m2 in zip(params, grads, first, second, strict=True):
            g = g - l2 * x / n
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            x += rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-9)
    return crf
