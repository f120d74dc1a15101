"""Byte-level text kernels shared by the operators of this package.

Texts are laid end to end in one ``uint8`` buffer and every step (word
boundaries, word fingerprints, n-gram fingerprints) is one numpy pass over that
buffer, so the Python cost of a document does not depend on its word count.

Words are runs of bytes other than 0x20 and 0x09-0x0D.  No byte of a multi-byte
UTF-8 sequence falls in that set, so byte runs equal character runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled in one numpy pass; a longer text forms a pass of its own.
PASS_BYTES = 1 << 19

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
ASCII_LOWER = IDENTITY.copy()
ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit affects every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    have = _powers.get("p")
    if have is None or len(have) <= n:
        size = max(n + 1, PASS_BYTES + 4096)
        for name, base in (("p", _BASE), ("q", _BASE_INV)):
            x = np.full(size, base, _U)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            _powers[name] = x
    return _powers["p"][: n + 1], _powers["q"][: n + 1]


class Spans:
    """Position-free polynomial fingerprints of codes[start:end], for any number of pairs."""

    def __init__(self, codes: np.ndarray):
        self.power, inverse = _power(len(codes))
        self.total = np.empty(len(codes) + 1, _U)
        self.total[0] = 0
        np.cumsum(codes * inverse[:-1], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.power[starts])


def _spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(codes)(starts, ends)


class Words:
    """Words of a list of UTF-8 texts.

    ``starts``/``ends`` are byte positions in ``buf``, ``first[i]:first[i + 1]``
    are the words of text i, and ``hashes`` their 64-bit fingerprints.
    """

    def __init__(self, texts: list[bytes], fold: np.ndarray = IDENTITY):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths + 1, out=self.begin[1:])
        self.buf = raw if fold is IDENTITY else fold[raw]
        self.inside = ~WHITESPACE[self.buf]
        edge = np.flatnonzero(np.diff(self.inside, prepend=False))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.begin)
        self.counts = np.diff(self.first)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = _spans(_BYTE_CODES[self.buf], self.starts, self.ends)
        return self._hashes

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprints of byte spans of the buffer."""
        return _spans(_BYTE_CODES[self.buf], starts, ends)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Word positions that start a k-word window inside one text, and the windows' fingerprints."""
        return window_hashes(self.hashes, self.first, k)


def window_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and fingerprints of the k-long windows that stay inside first[i]:first[i + 1]."""
    last = np.repeat(first[1:], np.diff(first)) - k
    at = np.flatnonzero(np.arange(len(hashes)) <= last)
    return at, _spans(hashes, at, at + k) if len(at) else np.zeros(0, _U)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return np.ascontiguousarray(x).view(np.int64)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; null stays None."""
    if pa.types.is_null(column.type):
        return [None] * len(column)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def passes(texts: list[bytes | None], limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of rows of about ``limit`` bytes, whole texts only."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n + 1
    if at < len(texts):
        yield at, len(texts)


def text_passes(column: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Runs of rows of about ``limit`` bytes, as (first, end, texts); only one run's texts are held at a time."""
    if pa.types.is_null(column.type):
        sizes = np.zeros(len(column), np.int64)
    else:
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and size + n > limit:
            yield at, i, byte_texts(column.slice(at, i - at))
            at, size = i, 0
        size += n + 1
    if at < len(column):
        yield at, len(column), byte_texts(column.slice(at))


def annotate(df, text_col: str, fn, fields: list[tuple[str, str]], into: str):
    """Adds struct column ``into`` computed by ``fn(list[bytes | None]) -> list of arrays``.

    Runs as one Arrow map without a shuffle and keeps every other column.  A
    column that already has the name ``into`` is replaced.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from joinwright.llm.worker import tidy

    df = df.drop(into)
    sizes = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields))
    out = T.StructType([*df.schema.fields, T.StructField(into, sizes)])
    columns, arrow = df.columns, to_arrow_schema(out)
    where = columns.index(text_col)
    inner = arrow.field(into).type

    def run(batches):
        for batch in batches:
            for a, b, texts in text_passes(batch.column(where)):
                arrays = [pa.array(x, f.type) for x, f in zip(fn(texts), inner, strict=True)]
                struct = pa.StructArray.from_arrays(arrays, fields=list(inner))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, struct], names=[*columns, into])

    return df.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(tidy(run), out)
