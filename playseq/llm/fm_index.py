"""An FM-index over the integer sequence of one shard: counting and locating phrases."""

from __future__ import annotations

import numpy as np

from playseq.llm.suffixes import rank_doubling

_PHRASES = 1 << 17


class Wavelet:
    """Ranks of symbols: one bit vector for each bit of the alphabet, zeros moved before ones."""

    def __init__(self, symbols: np.ndarray):
        bits = max(1, int(symbols.max()).bit_length())
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            zeros = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(~ones, out=zeros[1:])
            self.levels.append((bit, zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each place."""
        begin = np.zeros(len(symbol), np.int64)
        found = [p.copy() for p in places]
        for bit, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            total = zeros[-1]
            for at in (begin, *found):
                low = zeros[at]
                at[:] = np.where(one, total + at - low, low)
        return [at - begin for at in found]


class FMIndex:
    """`sequence` holds symbols from 1 on; every `step`-th suffix position is kept for locating."""

    def __init__(self, sequence: np.ndarray, step: int = 16):
        text = np.append(sequence.astype(np.int64), 0)
        suffixes = rank_doubling(text)
        self.last = text[suffixes - 1]
        self.wavelet = Wavelet(self.last)
        counts = np.bincount(text)
        self.before = np.cumsum(counts) - counts
        self.size = len(text)
        self.sampled = suffixes % step == 0
        self.sample_rank = np.cumsum(self.sampled) - self.sampled
        self.samples = suffixes[self.sampled]

    def count(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows, padded on the right): first and last place in suffix order."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        for start in range(0, len(phrases), _PHRASES):
            alive = np.arange(start, min(start + _PHRASES, len(phrases)))
            for back in range(int(lengths[alive].max())):
                alive = alive[(lengths[alive] > back) & (high[alive] > low[alive])]
                if not len(alive):
                    break
                symbol = phrases[alive, lengths[alive] - 1 - back]
                known = symbol < len(self.before)
                high[alive[~known]] = low[alive[~known]]
                alive, symbol = alive[known], symbol[known]
                a, b = self.wavelet.rank(symbol, low[alive], high[alive])
                low[alive], high[alive] = self.before[symbol] + a, self.before[symbol] + b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row of the suffix array, walking to the next sampled one."""
        out = np.empty(len(rows), np.int64)
        todo, row, walked = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            here = self.sampled[row]
            out[todo[here]] = self.samples[self.sample_rank[row[here]]] + walked
            todo, row = todo[~here], row[~here]
            symbol = self.last[row]
            (ahead,) = self.wavelet.rank(symbol, row)
            row = self.before[symbol] + ahead
            walked += 1
        return out
