"""Operator 6, URL filters from a sorted digest array.

A rule is a host with a path prefix and a verdict. The rules' 64-bit xxhash digests are
sorted into one array, beside their full strings; both are files that Spark hands to every
executor and workers map into memory. A URL is probed under every suffix of its host and
every rule length of its path, all URLs of a batch in one binary search, and a digest that
is found counts only if the stored string is equal. The longest rule that fits wins (on a
tie, the one with the longer host).

Null URLs and URLs without ``://`` have an empty host and path and get the default
verdict. Empty tables give empty results; an empty list of rules gives every row the default.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from lexigen.llm.common import lower_ascii, with_columns
from lexigen.session import spread

_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host = _HOST.match(url, at + 3).group()
    return lower_ascii(host), _PATH.match(url, at + 3 + len(host)).group()


def suffixes(host: str, labels: list[int]) -> list[str]:
    """The host and the domains it is in, as far as they have one of these numbers of labels (ascending)."""
    out, at, n = [], len(host), 0
    while at >= 0 and labels and n < labels[-1]:
        at, n = host.rfind(".", 0, at), n + 1
        if n in labels:
            out.append(host[at + 1 :])
    return out


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class DigestArray:
    """Strings with a verdict, found by binary search over their sorted digests.

    On file: ``<name>.keys.npy`` (digests, sorted), ``<name>.ends.npy`` (ends of the strings),
    ``<name>.verdicts.npy`` and ``<name>.text`` (the strings, in that order)."""

    PARTS = ("keys.npy", "ends.npy", "verdicts.npy", "text")

    def __init__(self, prefix: str):
        self.keys = np.load(f"{prefix}.keys.npy", mmap_mode="r")
        self.ends = np.load(f"{prefix}.ends.npy", mmap_mode="r")
        self.verdicts = np.load(f"{prefix}.verdicts.npy", mmap_mode="r")
        size = os.path.getsize(f"{prefix}.text")
        self.text = np.memmap(f"{prefix}.text", np.uint8, "r") if size else np.zeros(0, np.uint8)

    @staticmethod
    def write(entries: Iterable[tuple[str, int]], prefix: str, hash_of=digest) -> None:
        """Write the files; of equal strings the last verdict counts."""
        rows = sorted((hash_of(s), s, v) for s, v in dict(entries).items())
        raw = [s.encode("utf-8", "surrogatepass") for _, s, _ in rows]
        np.save(f"{prefix}.keys.npy", np.array([h for h, _, _ in rows], np.uint64))
        np.save(f"{prefix}.ends.npy", np.cumsum([len(x) for x in raw], dtype=np.int64))
        np.save(f"{prefix}.verdicts.npy", np.array([v for _, _, v in rows], np.int8))
        with open(f"{prefix}.text", "wb") as f:
            f.write(b"".join(raw))

    def string(self, i: int) -> str:
        start = int(self.ends[i - 1]) if i else 0
        return self.text[start : int(self.ends[i])].tobytes().decode("utf-8", "surrogatepass")

    def find(self, strings: list[str], hash_of=digest) -> np.ndarray:
        """Index of each string, -1 where it is not stored."""
        wanted = np.fromiter(map(hash_of, strings), np.uint64, len(strings))
        left = np.searchsorted(self.keys, wanted, side="left")
        right = np.searchsorted(self.keys, wanted, side="right")
        out = np.full(len(strings), -1, np.int64)
        for i in np.flatnonzero(right > left):  # confirm: equal digests may belong to other strings
            for at in range(left[i], right[i]):
                if self.string(at) == strings[i]:
                    out[i] = at
                    break
        return out


def ship_rules(spark: SparkSession, rules: list[tuple[str, str]], name: str = "") -> tuple[str, list[int], list[int]]:
    """Write the digest array of (``host/path``, ``allow`` or ``block``) rules and hand its files
    to all executors; returns its name, the rules' path lengths and their hosts' numbers of labels."""
    for rule, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"no verdict: {verdict!r} of {rule!r}")
    name = name or "rules-" + hashlib.md5(repr(sorted(rules)).encode()).hexdigest()[:16]
    if not os.path.exists(SparkFiles.get(f"{name}.keys.npy")):
        prefix = os.path.join(tempfile.mkdtemp(prefix="url-rules-"), name)
        DigestArray.write(((r, int(v == "block")) for r, v in rules), prefix)
        for part in DigestArray.PARTS:
            spark.sparkContext.addFile(f"{prefix}.{part}")
    hosts = [r.split("/", 1)[0] for r, _ in rules]
    return name, sorted({len(r) - len(h) for (r, _), h in zip(rules, hosts, strict=True)}), sorted({h.count(".") + 1 for h in hosts})


def judge(urls: list[str | None], array: DigestArray, lengths: list[int], labels: list[int], default: str = "allow") -> list[tuple[str, str, str | None, str]]:
    """(host, path, rule, verdict) of each URL."""
    parts = [host_and_path(u) for u in urls]
    probes, owner, host_len = [], [], []
    for row, (host, path) in enumerate(parts):
        heads = [path[:n] for n in lengths if n <= len(path)]
        for s in suffixes(host, labels):
            for head in heads:
                probes.append(s + head)
                owner.append(row)
                host_len.append(len(s))
    best: dict[int, tuple[int, int, int, int]] = {}
    if probes:
        found = array.find(probes)
        for i in np.flatnonzero(found >= 0):
            rank = (len(probes[i]), host_len[i], int(i), int(found[i]))
            if owner[i] not in best or rank > best[owner[i]]:
                best[owner[i]] = rank
    out = []
    for row, (host, path) in enumerate(parts):
        if row in best:
            _, _, i, at = best[row]
            out.append((host, path, probes[i], "block" if array.verdicts[at] else "allow"))
        else:
            out.append((host, path, None, default))
    return out


_ARRAYS: dict[str, DigestArray] = {}


def filter_urls(df: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: id, ``host``, ``path``, ``rule`` (null: none fits) and ``verdict``."""
    name, lengths, labels = ship_rules(df.sparkSession, rules)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = SparkFiles.get(name)
        if where not in _ARRAYS:
            _ARRAYS[where] = DigestArray(where)
        for batch in batches:
            rows = judge(batch.column(url_col).to_pylist(), _ARRAYS[where], lengths, labels, default)
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield with_columns(batch, [id_col], **{k: pa.array(v, pa.string()) for k, v in zip(("host", "path", "rule", "verdict"), columns, strict=True)})

    return spread(df.select(id_col, url_col)).mapInArrow(run, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")
