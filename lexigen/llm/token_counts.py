"""Operator 1, token counts: exact counts at every prefix of a text.

For each text a table of running token counts is built, one entry per chunk between
white space, with the prefix dynamic programme of :mod:`merge_dp` inside chunks. Any
prefix's count and any budget's cut are then read off the table. Where a cut falls inside a chunk, the chunk gets a table of its
own (:class:`ChunkTable`): running counts at its words, and the programme's counts at every prefix of the one word at the cut, so
a chunk without white space costs time in proportion to its length. Only a prefix that ends within a character (between a letter
and its combining marks) is counted from its word's beginning.

Chunks are independent for this tokenizer: normalisation, special strings, the word
pattern and merges never reach across white space. Words seen before are remembered in a
bounded table per worker.

Null text counts as empty (0 tokens); empty tables give empty results; columns of the
input other than those asked for are not returned; repeated rows are counted each.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexigen.llm.common import held, texts_of, with_columns
from lexigen.session import spread

#: Unicode white space, as the tokenizer's patterns see it.
_CHUNK = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: The tokenizer's word pattern, on lower-case printable ASCII.
_ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+")
_PRINTABLE = re.compile("[!-~]*")
_CHARACTER = regex.compile(r"\X|.", regex.DOTALL)


def chunks(text: str) -> list[str]:
    """Runs between white space."""
    return _CHUNK.findall(text) if _SEPARATORS.search(text) else text.split()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCounter:
    """Token counts for a word-end BPE vocabulary file (tokenizers .json)."""

    def __init__(self, path: str, limit: int = 800_000):
        from tokenizers import Tokenizer

        from lexigen.llm.merge_dp import PrefixDP

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ranks = {p: i for i, p in enumerate(pairs)}
        self.dp = PrefixDP(frozenset(model["vocab"]), lambda a, b: ranks.get((a, b)), self._symbols, self.end)
        self.rules = Tokenizer.from_file(path)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.limit = limit
        self._words: dict[str, int] = {}
        self._chunks: dict[str, int] = {}

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def pieces(self, chunk: str) -> list[str]:
        """Words of a chunk in the vocabulary's alphabet; a special string as ''."""
        if _PRINTABLE.fullmatch(chunk) and not (self.special and "<|" in chunk):
            return _ASCII_PIECES.findall(chunk.lower())
        out = []
        for n, part in enumerate(self.special.split(chunk) if self.special else [chunk]):
            if n % 2:
                out.append("")
            elif part:
                norm = self.rules.normalizer.normalize_str(part)
                out += [w for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(norm)]
        return out

    def words(self, text: str) -> list[tuple[str, int, int]]:
        """Words of a normal form in the vocabulary's alphabet (a letter a byte), and where they start and end in it."""
        if _PRINTABLE.fullmatch(text):
            return [(m[0], *m.span()) for m in _ASCII_PIECES.finditer(text)]
        return [(w, a, b) for w, (a, b) in self.rules.pre_tokenizer.pre_tokenize_str(text)]

    def of_words(self, text: str) -> int:
        return sum(self.of_word(w) for w, _, _ in self.words(text))

    def of_word(self, word: str) -> int:
        n = self._words.get(word)
        if n is None:
            n = self.dp.closed_count(word) if word else 1
            if len(self._words) >= self.limit:
                self._words.clear()
            if len(word) <= 64:
                self._words[word] = n
        return n

    def of_chunk(self, chunk: str) -> int:
        n = self._chunks.get(chunk)
        if n is None:
            n = sum(map(self.of_word, self.pieces(chunk)))
            if len(self._chunks) >= self.limit // 2:
                self._chunks.clear()
            if len(chunk) <= 64:
                self._chunks[chunk] = n
        return n

    def table(self, text: str) -> "PrefixTable":
        parts = chunks(text)
        known = self._chunks.get
        counts = [known(p) for p in parts]
        if None in counts:
            counts = [self.of_chunk(p) if n is None else n for p, n in zip(parts, counts, strict=True)]
        return PrefixTable(self, text, parts, np.cumsum(np.array(counts, dtype=np.int64)))


class ChunkTable:
    """Token counts at the prefixes of a chunk without special strings."""

    def __init__(self, counter: WordCounter, chunk: str):
        self.counter, self.chunk = counter, chunk
        norm = counter.rules.normalizer.normalize_str
        #: Characters with their combining marks, and where each ends in the chunk and in its normal form.
        self.marks = [m.end() for m in _CHARACTER.finditer(chunk)]
        parts = [chunk.lower()] if chunk.isascii() else [norm(chunk[a:b]) for a, b in zip([0, *self.marks], self.marks, strict=False)]
        self.text = "".join(parts)
        #: False where characters act on one another beyond their marks; prefixes are then counted one by one.
        self.local = chunk.isascii() or self.text == norm(chunk)
        ends = range(1, len(chunk) + 1) if chunk.isascii() else itertools.accumulate(map(len, parts))
        self.ends = list(ends)
        words = counter.words(self.text) if self.local else []
        self.words, self.word_starts, self.word_ends = ([w[k] for w in words] for k in range(3))
        self.running = list(itertools.accumulate(map(counter.of_word, self.words), initial=0))
        self._word: tuple = (-1, None, [])

    def _of(self, text: str) -> int:
        return sum(map(self.counter.of_word, self.counter.pieces(text)))

    def _at(self, q: int) -> int:
        """Tokens of the first ``q`` characters of the normal form."""
        j = bisect.bisect_left(self.word_starts, q) - 1
        if j < 0:
            return 0
        if q >= self.word_ends[j]:
            return self.running[j + 1]
        begun = self.text[self.word_starts[j] : q]
        if begun.startswith("'"):  # a contraction: its beginning is read as other words
            return self.running[j] + self.counter.of_words(begun)
        (last, count), letters = self._opened(j)
        n = letters[q - self.word_starts[j]]
        return self.running[j] + count[n - self.counter.dp.step(self.words[j], n, last, self.counter.end)] + 1

    def _opened(self, j: int) -> tuple[tuple[list, list[int]], list[int]]:
        """The open prefixes of word ``j``, and its letters (bytes) before each of its places."""
        if self._word[0] != j:
            own = self.text[self.word_starts[j] : self.word_ends[j]]
            sizes = itertools.repeat(1, len(own)) if own.isascii() else (len(c.encode("utf-8", "surrogatepass")) for c in own)
            self._word = (j, self.counter.dp.latest_prefixes(self.words[j]), list(itertools.accumulate(sizes, initial=0)))
        return self._word[1:]

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters."""
        if not self.local:
            return self._of(self.chunk[:chars])
        at = bisect.bisect_right(self.marks, chars) - 1
        whole, done = (self.marks[at], self.ends[at]) if at >= 0 else (0, 0)
        if whole == chars:
            return self._at(done)
        # part of a character: its word up to there, and what it makes by itself
        j = max(0, bisect.bisect_left(self.word_starts, done) - 1)
        start = self.word_starts[j] if self.word_starts and self.word_starts[j] < done else done
        tail = self.text[start:done] + self.counter.rules.normalizer.normalize_str(self.chunk[whole:chars])
        return self._at(start) + self.counter.of_words(tail)

    def cut(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        inside = len(self.chunk)
        if self.local and self.words and self.running[-1] > budget:
            # the word in which the budget runs out; every prefix beyond it has more
            j = bisect.bisect_left(self.running, budget, hi=len(self.words) - 1)
            j -= self.running[j] > budget
            end = self.word_ends[j]
            if not self.text.startswith("'", self.word_starts[j]):
                opened, letters = self._opened(j)
                n = self.counter.dp.longest_closed(opened, self.words[j], budget - self.running[j])
                end = self.word_starts[j] + bisect.bisect_right(letters, n) - 1
            at = bisect.bisect_right(self.ends, end)  # the character after it may have a beginning that still fits
            inside = self.marks[min(at, len(self.marks) - 1)]
        while inside and self.count(inside) > budget:
            inside -= 1
        return inside


class PrefixTable:
    """Running token counts of one text; answers prefix and budget questions."""

    def __init__(self, counter: WordCounter, text: str, parts: list[str], running: np.ndarray):
        self.counter, self.text, self.parts, self.running = counter, text, parts, running
        self._starts: list[int] | None = None

    @property
    def total(self) -> int:
        return int(self.running[-1]) if len(self.running) else 0

    @property
    def starts(self) -> list[int]:
        """Offsets of the chunks."""
        if self._starts is None:
            self._starts, at = [], 0
            for p in self.parts:
                at = self.text.index(p, at)
                self._starts.append(at)
                at += len(p)
        return self._starts

    def _segments(self, m: int) -> list[tuple[str, str]]:
        """Chunk ``m`` as plain runs, each with the special string behind it ('' behind the last)."""
        special = self.counter.special
        found = special.split(self.parts[m]) if special else [self.parts[m]]
        return list(zip(found[::2], [*found[1::2], ""], strict=True))

    def _inside(self, m: int, chars: int) -> int:
        """Tokens of the first ``chars`` characters of chunk ``m``."""
        done = 0
        for plain, mark in self._segments(m):
            if chars < len(plain) + max(1, len(mark)):
                return done + ChunkTable(self.counter, plain + mark[:-1]).count(chars)
            done += sum(map(self.counter.of_word, self.counter.pieces(plain))) + 1
            chars -= len(plain) + len(mark)
        return done

    def _cut_inside(self, m: int, budget: int) -> int:
        """Characters of the longest prefix of chunk ``m`` of at most ``budget`` tokens."""
        at = 0
        for plain, mark in self._segments(m):
            own = sum(map(self.counter.of_word, self.counter.pieces(plain))) if mark else 0
            if not mark or own + 1 > budget:
                return at + ChunkTable(self.counter, plain + mark[:-1]).cut(budget)
            budget, at = budget - own - 1, at + len(plain) + len(mark)
        return at

    def count(self, chars: int) -> int:
        """Tokens of the text's first ``chars`` code points, exactly."""
        m = bisect.bisect_right(self.starts, chars - 1) - 1 if chars > 0 else -1
        if m < 0:
            return 0
        before = int(self.running[m - 1]) if m else 0
        inside = chars - self.starts[m]
        return int(self.running[m]) if inside >= len(self.parts[m]) else before + self._inside(m, inside)

    def every_prefix(self) -> list[int]:
        """Counts at all prefixes 0..len(text)."""
        return [self.count(p) for p in range(len(self.text) + 1)]

    def cut(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        m = int(np.searchsorted(self.running, budget, side="right"))
        if m == len(self.parts):
            return len(self.text)
        left = budget - (int(self.running[m - 1]) if m else 0)
        if left <= 0:
            return self.starts[m]
        return self.starts[m] + self._cut_inside(m, left)


def counter_for(path: str | None) -> WordCounter:
    """The vocabulary of this worker, loaded once."""
    path = path or default_vocabulary()
    return held(("counter", path), lambda: WordCounter(path))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, ...] = (2048,), vocabulary: str | None = None, keep_table: bool = False) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens`` and, for each budget b, ``cut_b``: the
    code points of the longest prefix of at most b tokens. ``keep_table`` adds the stored
    table itself: ``chunk_ends`` (code points) and ``chunk_tokens`` (running counts)."""
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_bytes long, n_tokens long" + "".join(f", cut_{b} long" for b in budgets)
    schema += ", chunk_ends array<int>, chunk_tokens array<int>" if keep_table else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(vocabulary)
        for batch in batches:
            tables = [counter.table(t) for t in texts_of(batch, text_col)]
            new = {
                "n_bytes": pa.array([len(t.text.encode("utf-8", "surrogatepass")) for t in tables], pa.int64()),
                "n_tokens": pa.array([t.total for t in tables], pa.int64()),
            }
            new |= {f"cut_{b}": pa.array([t.cut(b) for t in tables], pa.int64()) for b in budgets}
            if keep_table:
                new["chunk_ends"] = pa.array([[s + len(p) for s, p in zip(t.starts, t.parts, strict=True)] for t in tables], pa.list_(pa.int32()))
                new["chunk_tokens"] = pa.array([t.running.astype(np.int32) for t in tables], pa.list_(pa.int32()))
            yield with_columns(batch, [id_col], **new)

    return spread(df.select(id_col, text_col)).mapInArrow(run, schema)
