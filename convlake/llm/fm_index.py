"""A compressed FM-index of many short sequences of words, which lives within one task.

The sequences stand one after the other, each with an end of its own. Their suffixes are sorted by prefix
doubling; the word before each suffix, in that order, is the transform, kept as a wavelet tree laid out
level by level: one bit a word and level in 64-bit blocks, and a count for each block. A step of backward
search puts a word before what has matched and costs two ranks a level; all queries take their steps
together. Matching statistics are followed up to ``width`` words: when that many match, the last one is let
go, which leads to the interval of all suffixes that agree in ``width - 1`` words.
"""

from __future__ import annotations

from itertools import chain

#: No sequence has the window.
NONE = (1 << 63) - 1


class Wavelet:
    """Rank of every symbol in a sequence of small integers."""

    def __init__(self, symbols, many: int):
        import numpy as np

        self.bits = max(1, int(many - 1).bit_length())
        n = len(symbols)
        self.blocks, self.counts, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.zeros((n // 64 + 1) * 8, "uint8")
            packed[: -(-n // 8)] = np.packbits(bit.astype("uint8"), bitorder="little")
            blocks = packed.view("<u8")
            self.blocks.append(blocks)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(blocks[:-1]), dtype="int64")]).astype("int32"))
            one = bit.astype(bool)
            self.zeros.append(n - int(one.sum()))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        self.first = self._down(np.arange(many), np.zeros(many, "int64"))

    def _down(self, symbols, at):
        import numpy as np

        for k in range(self.bits):
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype("uint64")) - np.uint64(1)
            ones = self.counts[k][block] + np.bitwise_count(self.blocks[k][block] & below)
            at = np.where((symbols >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols, at):
        """How often each of ``symbols`` comes before ``at``."""
        return self._down(symbols, at) - self.first[symbols]


class FMIndex:
    """``sequences`` (words between single spaces) with a label each; windows are ``width`` words."""

    def __init__(self, sequences: list[bytes], labels, width: int):
        import numpy as np

        self.width = width
        words = [s.split(b" ") for s in sequences]
        self.known = {w: k + 1 for k, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        sizes = np.fromiter(map(len, words), "int64", len(words))
        ends = np.cumsum(sizes + 1) - 1
        n = int(sizes.sum()) + len(words)
        text = np.zeros(n, "int64")
        inner = np.ones(n, bool)
        inner[ends] = False
        text[inner] = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), "int64", n - len(words))
        # an end is below every word, and each end differs from the others
        order = np.where(inner, len(words) + text, 0)
        order[ends] = np.arange(len(words))
        order, steps, half = order.astype("int64"), 1, 1
        while 2 * half <= width - 1:
            half *= 2
        block = order if half == 1 else None
        while True:
            following = np.zeros(n, "int64")
            if steps < n:
                following[: n - steps] = order[steps:] + 1
            key = order * (n + len(self.known) + 2) + following
            sa = np.argsort(key)
            new = np.concatenate([[0], np.cumsum(np.diff(key[sa]) != 0)])
            order = np.empty(n, "int64")
            order[sa] = new
            steps *= 2
            if steps == half:
                block = order
            if new[-1] == n - 1:
                break
        block = order if block is None else block
        self.wavelet = Wavelet(text[sa - 1], len(self.known) + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.known) + 1))])

        def starts(length: int):
            # blocks of ``half`` words, overlapping, cover a prefix of ``length``
            far = np.minimum(sa + length - half, n - 1)
            differ = (np.diff(block[sa]) != 0) | (np.diff(block[far]) != 0)
            return np.flatnonzero(np.concatenate([[True], differ]))

        self.shorter, whole = starts(width - 1), starts(width)
        owner = np.repeat(np.arange(len(words)), sizes + 1)
        self.n, self.whole = n, whole
        self.least = np.minimum.reduceat(np.asarray(labels, "int64")[owner[sa]], whole)

    def windows(self, sequences: list[bytes]):
        """For every window of every sequence the least label of those that have it, or NONE: (values, ends by sequence)."""
        import numpy as np

        words = [s.split(b" ") for s in sequences]
        sizes = np.fromiter(map(len, words), "int64", len(words))
        first = np.concatenate([[0], np.cumsum(sizes)])
        asked = np.fromiter((self.known.get(w, 0) for w in chain.from_iterable(words)), "int64", int(first[-1]))
        many = np.maximum(sizes - self.width + 1, 0)
        out_first = np.concatenate([[0], np.cumsum(many)])
        out = np.full(int(out_first[-1]), NONE)
        live = np.flatnonzero(many > 0)
        at, low, high, depth = sizes[live] - 1, np.zeros(len(live), "int64"), np.full(len(live), self.n), np.zeros(len(live), "int64")
        while len(live):
            full = depth == self.width
            if full.any():
                k = np.searchsorted(self.shorter, low[full], "right")
                low[full], high[full] = self.shorter[k - 1], np.append(self.shorter, self.n)[k]
                depth[full] -= 1
            symbol = asked[first[live] + at]
            both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.concatenate([self.before[symbol], self.before[symbol]])
            new_low, new_high = both[: len(live)], both[len(live) :]
            ok = (symbol > 0) & (new_low < new_high)
            # what doesn't go on begins again one word before where it ended
            low, high = np.where(ok, new_low, 0), np.where(ok, new_high, self.n)
            at = np.where(ok, at - 1, at + np.maximum(depth, 1) - 1 - (depth == 0))
            depth = np.where(ok, depth + 1, 0)
            done = depth == self.width
            if done.any():
                out[out_first[live[done]] + at[done] + 1] = self.least[np.searchsorted(self.whole, low[done], "right") - 1]
            rest = (at >= 0) & (at + depth + 1 >= self.width)
            if not rest.all():
                live, at, low, high, depth = live[rest], at[rest], low[rest], high[rest], depth[rest]
        return out, out_first
