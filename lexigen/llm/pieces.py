"""Operator 5, subword pieces: encoding and decoding with a sentencepiece BPE vocabulary by
a streaming Viterbi pass.

The lattice's edges are the vocabulary's pieces; the path that survives at a boundary is the
one whose neighbouring pieces are compatible (:mod:`merge_dp`), which is what the library's
merging gives. The pass keeps only a window of boundaries no wider than the longest piece
plus what is not yet decided: when the paths back from all boundaries that a later piece
could start at meet in one boundary, the ids up to it are committed and forgotten.

White space always is such a meeting point (no piece runs on past it), and so are a
character that no piece holds (written as byte pieces) and a place between two characters that
stand side by side in no piece; segments between them are remembered in a bounded table per worker.
Segments of up to four times the longest piece are solved whole by the same programme; longer ones, and
those with a character outside the vocabulary, run through the pass, which commits once that many are undecided.

Null text is empty and has no ids; empty tables give empty results; repeated rows are
encoded each.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexigen.llm.common import held, texts_of, with_columns
from lexigen.session import spread

#: What the vocabulary writes for a space.
SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCoder:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, limit: int = 900_000):
        import sentencepiece

        from lexigen.llm.merge_dp import PrefixDP

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {i: int(self.text[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.silent = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.ids = {self.text[i]: i for i in range(n) if i not in self.silent and i not in self.byte}
        score = {t: sp.get_score(i) for t, i in self.ids.items()}
        self.dp = PrefixDP(frozenset(self.ids), lambda a, b: None if (s := score.get(a + b)) is None else -s)
        self.alphabet = {t for t in self.ids if len(t) == 1}
        self.bounded = not any(SPACE in t.lstrip(SPACE) for t in self.ids)
        #: characters that stand side by side in some piece; between others every path meets
        self.joined = {a + b for t in self.ids for a, b in zip(t, t[1:])}
        self.limit = limit
        self._segments: dict[str, bytes] = {}
        self._shown = [t.replace(SPACE, " ") for t in self.text]

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters (spaces already written as the mark)."""
        dp, longest = self.dp, self.dp.longest
        window, last, back = "", [None], [0]  # boundaries 0..len(window); 0 is committed
        for c in symbols:
            if c not in self.alphabet:  # no piece holds it: every path ends here
                yield from self._path(last, len(window))
                yield from (self.byte_id[b] for b in c.encode("utf-8", "surrogatepass"))
                window, last, back = "", [None], [0]
                continue
            window += c
            i = len(window)
            k = dp.step(window, i, last)
            last.append(window[i - k : i] if k else None)
            back.append(i - k)
            if i >= 4 * longest:
                meet = self._meeting(back, last, range(max(1, i - longest + 1), i + 1))
                if meet > longest:
                    done = list(self._path(last, meet))
                    yield from done[:-1]
                    # the last piece before the boundary stays, as the neighbour of what follows
                    cut = meet - len(last[meet])
                    window, last, back = window[cut:], [None, *last[cut + 1 :]], [0, *(b - cut for b in back[cut + 1 :])]
        yield from self._path(last, len(window))

    def _path(self, last: list, end: int) -> Iterator[int]:
        out = []
        while end:
            out.append(self.ids[last[end]])
            end -= len(last[end])
        return reversed(out)

    @staticmethod
    def _meeting(back: list[int], last: list, live: Iterable[int]) -> int:
        """The last boundary that the paths back from all live boundaries share."""
        at = {b for b in live if last[b] is not None}
        while len(at) > 1:
            top = max(at)
            at.remove(top)
            at.add(back[top])
        return at.pop()

    def _window(self, text: str) -> bytes:
        """Ids of a run of characters between two boundaries where all paths meet."""
        if len(text) > 4 * self.dp.longest or not self.alphabet.issuperset(text):
            return np.fromiter(self.stream(text), dtype="<u4").tobytes()
        last, _ = self.dp.open_prefixes(text)
        return array("I", self._path(last, len(text))).tobytes()

    def _keep(self, text: str, ids: bytes) -> bytes:
        if len(self._segments) >= self.limit:
            self._segments.clear()
        if len(text) <= 64:
            self._segments[text] = ids
        return ids

    def segment(self, text: str) -> bytes:
        """Ids of a segment as little-endian 32-bit bytes."""
        ids = self._segments.get(text)
        if ids is not None:
            return ids
        joined = self.joined
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joined]
        if not cuts:
            return self._keep(text, self._window(text))
        known, out = self._segments.get, []
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            part = text[a:b]
            out.append(known(part) or self._keep(part, self._window(part)))
        return self._keep(text, b"".join(out))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.zeros(0, dtype="<u4")
        known, out = self._segments.get, []
        if not self.bounded or "\n" in self.alphabet:
            return np.frombuffer(self.segment(SPACE + text.replace(" ", SPACE)), dtype="<u4")
        newline = self.segment("\n")
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(newline)
            parts = line.split(" ")
            # a run of spaces is one segment with the word after it
            held = SPACE if not n else ""
            segments = [held + parts[0]] if held or parts[0] else []
            if "" in parts[1:] or SPACE in line or (len(segments) and segments[0] == SPACE):
                segments = _runs((SPACE if not n else "") + line.replace(" ", SPACE))
            else:
                segments += [SPACE + p for p in parts[1:]]
            out += [known(s) or self.segment(s) for s in segments]
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each, control ids nothing."""
        out, raw, shown = [], bytearray(), self._shown
        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw = bytearray()
            if i not in self.silent:
                out.append(shown[i])
        if raw:
            out.append(_utf8(bytes(raw)))
        text = "".join(out)
        return text[1:] if text[:1] == " " else text


def _utf8(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _runs(line: str) -> list[str]:
    """Segments of a line: spaces with the word that follows them."""
    out, at = [], 0
    for i in range(1, len(line)):
        if line[i] == SPACE != line[i - 1]:
            out.append(line[at:i])
            at = i
    return [*out, line[at:]] if line else out


def coder_for(path: str | None) -> PieceCoder:
    path = path or default_model()
    return held(("pieces", path), lambda: PieceCoder(path))


def encode_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per row: id and ``ids`` (array<int>)."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [coder.encode(t).astype(np.int32) for t in texts_of(part, text_col)]
                yield with_columns(part, [id_col], ids=pa.array(ids, pa.list_(pa.int32())))

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def decode_pieces(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """Per row: id and ``text``; null ids give an empty text."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(model)
        for batch in batches:
            yield with_columns(batch, [id_col], text=pa.array([coder.decode(x or []) for x in batch.column(ids_col).to_pylist()], pa.string()))

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, text string")


def piece_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per row: id, ``n_ids``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit) and
    ``round_trip``: whether decoding the ids gives the text back. Encoding and decoding run
    in one pass, so ids are not stored."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(model)
        for batch in batches:
            texts = texts_of(batch, text_col)
            n, crc, same = [], [], []
            for t in texts:
                ids = coder.encode(t)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
                same.append(coder.decode(ids.tolist()) == t)
            yield with_columns(batch, [id_col], n_ids=pa.array(n, pa.int64()), ids_crc32=pa.array(crc, pa.int64()), round_trip=pa.array(same, pa.bool_()))

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n_ids long, ids_crc32 long, round_trip boolean")
