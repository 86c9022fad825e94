"""The lattice of all pieces of a fixed vocabulary within many words at once, for the operators that sum over it or seek its best path."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """vocabulary: distinct pieces; number 0 stands for any single letter that isn't a piece itself."""

    def __init__(self, vocabulary: list[str]):
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(vocabulary[1:], 1):
            by_length.setdefault(len(p), []).append((int(self._hash(np.array([list(map(ord, p))], np.uint64))[0]), i))
        self.tables = {}
        for k, pairs in sorted(by_length.items()):
            pairs.sort()
            self.tables[k] = (np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int32))
            assert len({h for h, _ in pairs}) == len(pairs)
        self.longest = max(self.tables)

    @staticmethod
    def _hash(letters: np.ndarray) -> np.ndarray:
        h = np.zeros(len(letters), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(letters.shape[1]):
                h = (h ^ letters[:, j]) * _BASE
                h ^= h >> np.uint64(29)
        return h

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """start, end (places: each word has one before each letter and one after the last), piece; then each word's first place, and each
        edge's end within its word. Edges are in the order of that, then of their words, then of their lengths. No word is empty."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words)), lengths)
        left = np.repeat(first + lengths, lengths) - np.arange(len(codes))  # letters from here to the word's end
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        starts, ks, found = [], [], []
        single = np.zeros(len(codes), bool)
        for k in range(1, self.longest + 1):
            keep = left[at] >= k
            at, h = at[keep], h[keep]
            if not len(at):
                break
            with np.errstate(over="ignore"):
                h = (h ^ codes[at + (k - 1)]) * _BASE
                h ^= h >> np.uint64(29)
            if k in self.tables:
                known, ids = self.tables[k]
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[i] == h
                starts.append(at[hit])
                ks.append(np.full(int(hit.sum()), k))
                found.append(ids[i[hit]])
                if k == 1:
                    single[at[hit]] = True
        other = np.flatnonzero(~single)
        starts.append(other)
        ks.append(np.ones(len(other), np.int64))
        found.append(np.zeros(len(other), np.int32))
        start, k, piece = np.concatenate(starts), np.concatenate(ks), np.concatenate(found)
        w = word[start]
        within = start + k - first[w]
        order = np.lexsort((w, within))
        start, k, piece, w, within = (x[order] for x in (start, k, piece, w, within))
        return start + w, start + w + k, piece, first + np.arange(len(words)), within

    def forward(self, words: list[str], p: np.ndarray) -> tuple[np.ndarray, ...]:
        """p: probabilities by (piece, language). Returns alpha by (place, language) and the edges."""
        start, end, piece, first, within = self.edges(words)
        places = int(first[-1]) + len(words[-1]) + 1
        alpha = np.zeros((places, p.shape[1]))
        alpha[first] = 1
        cuts = np.searchsorted(within, np.arange(1, int(within[-1]) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                add = alpha[start[a:b]] * p[piece[a:b]]
                e = end[a:b]
                head = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
                alpha[e[head]] = np.add.reduceat(add, head, axis=0)
        return alpha, start, end, piece, first, within

    def scores(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probabilities by (word, language)."""
        alpha, _, _, _, first, _ = self.forward(words, p)
        last = np.r_[first[1:], len(alpha)] - 1
        return np.log(np.maximum(alpha[last], 1e-300))

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece under one language; p by piece, counts by word."""
        alpha, start, end, piece, first, within = self.forward(words, p[:, None])
        alpha = alpha[:, 0]
        last = np.r_[first[1:], len(alpha)] - 1
        beta = np.zeros(len(alpha))
        beta[last] = 1
        cuts = np.searchsorted(within, np.arange(1, int(within[-1]) + 2))
        for a, b in reversed(list(zip(cuts[:-1], cuts[1:], strict=True))):
            if a < b:
                np.add.at(beta, start[a:b], beta[end[a:b]] * p[piece[a:b]])
        word = np.searchsorted(first, start, side="right") - 1
        whole = alpha[last]
        share = np.divide(counts, whole, out=np.zeros(len(words)), where=whole > 0)
        return np.bincount(piece, alpha[start] * p[piece] * beta[end] * share[word], minlength=len(p))

    def best(self, words: list[str], score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of each word's best segmentation: all of them in order, and where each word's begin, and the end. Scores add up; of
        equal ones that with the longer last piece wins."""
        start, end, piece, first, within = self.edges(words)
        places = int(first[-1]) + len(words[-1]) + 1
        reached, back = np.full(places, -np.inf), np.zeros(places, np.int64)
        reached[first] = 0
        cuts = np.searchsorted(within, np.arange(1, int(within[-1]) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                total, e = reached[start[a:b]] + score[piece[a:b]], end[a:b]
                head = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
                most = np.maximum.reduceat(total, head)
                reached[e[head]] = most
                chosen = np.flatnonzero(total == np.repeat(most, np.diff(np.r_[head, b - a])))
                back[e[chosen]] = a + chosen  # the last of equal ones, which is the longest piece, remains
        at, word = np.r_[first[1:], places] - 1, np.arange(len(words))
        steps = []
        while len(at):
            edge = back[at]
            steps.append((word, piece[edge]))
            at = start[edge]
            more = at > first[word]
            at, word = at[more], word[more]
        steps.reverse()
        word, found = np.concatenate([w for w, _ in steps]), np.concatenate([p for _, p in steps])
        order = np.argsort(word, kind="stable")
        return found[order], np.searchsorted(word[order], np.arange(len(words) + 1))
