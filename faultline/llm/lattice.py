"""Expected numbers of pieces over all segmentations of very many words: forward and backward sums over a trie of a chunk of sorted words.

Words of a chunk share the nodes of their prefixes. A node's pieces are found from its end on, in a trie of the reversed
pieces; sums go depth by depth, all nodes of a depth at once.
"""

from __future__ import annotations

import math

import numpy as np

#: Words of a chunk, and letters of a word up to which sums stay in the range of doubles; longer ones are summed by logarithms.
CHUNK, LETTERS = 8_000, 48
#: What a letter's weight is raised by (its logarithm), so that sums over whole words stay near one.
LIFT = 2.5


class Reversed:
    """A trie of the reversed pieces in arrays: sorted keys (node x alphabet + letter) lead to nodes, a node may be a piece."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.place = pieces, {p: i for i, p in enumerate(pieces)}
        letters = sorted(set().union(*pieces)) if pieces else []
        self.alphabet, self.longest = len(letters) + 1, max(map(len, pieces), default=0)
        self.code = np.full(0x110000, -1, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(len(letters))
        of = {c: i for i, c in enumerate(letters)}
        child: dict[int, int] = {}
        piece = [-1]
        for i, p in enumerate(pieces):
            node = 0
            for c in reversed(p):
                key = node * self.alphabet + of[c]
                if (down := child.get(key)) is None:
                    down = child[key] = len(piece)
                    piece.append(-1)
                node = down
            piece[node] = i
        self.keys = np.array(sorted(child), np.int64)
        self.down = np.array([child[k] for k in self.keys.tolist()], np.int32)
        self.piece = np.array(piece, np.int32)
        self.lengths = np.array([len(p) for p in pieces], np.int32)

    def weights(self, logs: np.ndarray) -> np.ndarray:
        return np.exp(logs + LIFT * self.lengths)

    def add(self, words: list[str], numbers: np.ndarray, logs: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> None:
        """Adds to counts how often each piece is expected in the words, which are distinct and sorted, so many times each. Words that no pieces cover add nothing."""
        for start in range(0, len(words), CHUNK):
            some, n = words[start : start + CHUNK], numbers[start : start + CHUNK]
            short = [i for i, w in enumerate(some) if len(w) <= LETTERS]
            if short:
                self._chunk([some[i] for i in short], n[short], weights, counts)
            for i in set(range(len(some))) - set(short) if len(short) < len(some) else ():
                self._long(some[i], float(n[i]), logs, counts)

    def _chunk(self, words: list[str], n: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        if not width:
            return
        letters = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
        columns = np.arange(width)
        # A word's new nodes are those beyond what it shares with the word before.
        equal = np.zeros(letters.shape, bool)
        equal[1:] = letters[1:] == letters[:-1]
        shared = np.where(equal.all(1), width, np.argmin(equal, 1))
        new = (columns >= shared[:, None]) & (columns < sizes[:, None])
        nodes = np.zeros((len(words), width + 1), np.int64)  # node 0, the empty prefix, comes first
        nodes[:, 1:] = np.maximum.accumulate(np.where(new, np.cumsum(new.ravel()).reshape(new.shape), 0), axis=0)
        word, end = np.nonzero(new)
        codes = self.code[letters]
        state, to, depth = np.zeros(len(word), np.int64), nodes[word, end + 1], end + 1
        edges = []
        for length in range(1, self.longest + 1):
            keep = depth >= length
            word, state, to, depth = word[keep], state[keep], to[keep], depth[keep]
            code = codes[word, depth - length]
            key = np.where(code >= 0, state * self.alphabet + code, -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            keep = self.keys[at] == key
            word, to, depth, state = word[keep], to[keep], depth[keep], self.down[at[keep]].astype(np.int64)
            found = self.piece[state]
            ends = found >= 0
            edges.append((depth[ends], to[ends], nodes[word[ends], depth[ends] - length], found[ends]))
            if not len(word):
                break
        depth, to, above, piece = (np.concatenate(x) for x in zip(*edges))
        order = np.argsort(depth.astype(np.uint8), kind="stable")
        depth, to, above, piece = depth[order], to[order], above[order], piece[order]
        own, bounds = weights[piece], np.searchsorted(depth, np.arange(1, width + 2))
        forward = np.zeros(int(nodes.max()) + 1)
        forward[0] = 1.0
        for a, b in zip(bounds[:-1], bounds[1:]):
            np.add.at(forward, to[a:b], forward[above[a:b]] * own[a:b])
        last = nodes[np.arange(len(words)), sizes]
        whole, backward = forward[last], np.zeros(len(forward))
        covered = whole > 0
        backward[last[covered]] = n[covered] / whole[covered]
        for a, b in zip(bounds[-2::-1], bounds[:0:-1]):
            np.add.at(backward, above[a:b], backward[to[a:b]] * own[a:b])
        counts += np.bincount(piece, forward[above] * own * backward[to], minlength=len(counts))

    def _long(self, word: str, n: float, logs: np.ndarray, counts: np.ndarray) -> None:
        """One word of any length, by logarithms."""
        size, place, none = len(word), self.place, -math.inf
        forward, backward = [0.0] + [none] * size, [none] * size + [0.0]

        def total(terms: list[float]) -> float:
            most = max(terms, default=none)
            return most if most == none else most + math.log(sum(math.exp(x - most) for x in terms))

        into = lambda end: [(s, i) for s in range(max(0, end - self.longest), end) if forward[s] > none and (i := place.get(word[s:end])) is not None]
        for end in range(1, size + 1):
            forward[end] = total([forward[s] + logs[i] for s, i in into(end)])
        if forward[size] == none:
            return
        for start in range(size - 1, -1, -1):
            backward[start] = total([logs[i] + backward[e] for e in range(start + 1, min(size, start + self.longest) + 1) if backward[e] > none and (i := place.get(word[start:e])) is not None])
        for end in range(1, size + 1):
            for s, i in into(end):
                if backward[end] > none:
                    counts[i] += n * math.exp(forward[s] + logs[i] + backward[end] - forward[size])
