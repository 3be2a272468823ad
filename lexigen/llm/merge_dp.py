"""Byte-pair encoding by dynamic programming over prefixes.

Merging the best-ranked pair again and again gives one token sequence per string,
and that sequence is the only one in which every two neighbours are *compatible*:
merging the characters of both alone gives the two back. So the last token of every
prefix follows from the last tokens of shorter prefixes, in time linear in the string:
``last[i]`` is the token ``t`` that ends at ``i`` and is compatible with ``last[i - len(t)]``.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Sequence


def merged(symbols: Sequence[str], rank: Callable[[str, str], int | None]) -> list[str]:
    """Tokens of a short symbol sequence by repeated merging: lowest rank first, leftmost first."""
    out = list(symbols)
    while len(out) > 1:
        best, at = None, -1
        for i in range(len(out) - 1):
            r = rank(out[i], out[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        out[at : at + 2] = [out[at] + out[at + 1]]
    return out


class PrefixDP:
    """Last token and token count at every prefix.

    ``vocab``: tokens; ``rank(a, b)``: merge rank or None; ``symbols(token)``: the
    characters merging starts from; ``end``: a mark glued to a closed word's last character.
    """

    def __init__(self, vocab, rank, symbols=list, end: str = "", limit: int = 1_000_000):
        self.vocab, self.rank, self.symbols, self.end, self.limit = vocab, rank, symbols, end, limit
        self.longest = max(len(t) - (len(end) if end and t.endswith(end) else 0) for t in vocab)
        self._whole: dict[str, bool] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._latest: tuple = (None, None)

    def whole(self, token: str) -> bool:
        """Whether merging the token's own characters gives the token."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = merged(self.symbols(token), self.rank) == [token]
        return known

    def fits(self, a: str, b: str) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= self.limit:
                self._pairs.clear()
            known = self._pairs[a, b] = merged([*self.symbols(a), *self.symbols(b)], self.rank) == [a, b]
        return known

    def step(self, word: str, i: int, last: list, mark: str = "") -> int:
        """Length of the token that ends prefix ``i`` of ``word``; ``last`` holds the
        last tokens of the shorter open prefixes. 0: no token fits."""
        vocab, pairs = self.vocab, self._pairs
        for k in range(min(i, self.longest), 0, -1):
            t = word[i - k : i] + mark
            if t in vocab:
                if i == k:
                    if self.whole(t):
                        return k
                elif last[i - k] is not None:
                    ok = pairs.get((last[i - k], t))
                    if ok or ok is None and self.whole(t) and self.fits(last[i - k], t):
                        return k
        return 0

    def open_prefixes(self, word: str) -> tuple[list[str | None], list[int]]:
        """(last token, count) for every prefix 0..len(word), without the end mark."""
        last: list[str | None] = [None] * (len(word) + 1)
        count = [0] * (len(word) + 1)
        vocab, pairs, whole, fits, longest = self.vocab, self._pairs, self.whole, self.fits, self.longest
        for i in range(1, len(word) + 1):  # as step() does, without a call for each prefix
            for at in range(max(0, i - longest), i):
                t = word[at:i]
                if t in vocab:
                    if not at:
                        ok = whole(t)
                    elif (before := last[at]) is None:
                        continue
                    elif (ok := pairs.get((before, t))) is None:
                        ok = whole(t) and fits(before, t)
                    if ok:
                        last[i] = t
                        count[i] = count[at] + 1
                        break
        return last, count

    def latest_prefixes(self, word: str) -> tuple[list[str | None], list[int]]:
        """:meth:`open_prefixes`, kept for the word asked last."""
        if self._latest[0] != word:
            self._latest = (word, self.open_prefixes(word))
        return self._latest[1]

    def closed_count(self, word: str) -> int:
        """Tokens of the word with its end mark."""
        last, count = self.latest_prefixes(word) if len(word) > 64 else self.open_prefixes(word[:-1])
        return count[len(word) - self.step(word, len(word), last, self.end)] + 1

    def longest_closed(self, opened: tuple[list[str | None], list[int]], word: str, budget: int) -> int:
        """Length of the longest prefix that makes at most ``budget`` tokens as a closed word, from the open prefixes. A closed prefix
        has one token more than an open one at most ``longest`` letters shorter, so only those that could
        do are looked at."""
        last, count = opened
        least = list(itertools.accumulate(reversed(count), min))[::-1]  # of this prefix and all longer ones
        i = bisect.bisect_left(least, budget)  # no open prefix from here on has fewer
        for n in range(min(len(word), i - 1 + self.longest), 0, -1):
            if count[n - self.step(word, n, last, self.end)] + 1 <= budget:
                return n
        return 0

    def closed_counts(self, word: str) -> list[int]:
        """Tokens of every prefix 0..len(word), each taken as a closed word."""
        last, count = self.open_prefixes(word)
        return [0, *(count[i - self.step(word, i, last, self.end)] + 1 for i in range(1, len(word) + 1))]
