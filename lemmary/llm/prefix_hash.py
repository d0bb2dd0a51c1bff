"""Document fingerprints from prefix polynomial hashes.

H[i] = sum of text[j] * B^j for j < i, modulo the prime 2^31 - 1. Two entries
give the hash of any span, so spans are compared in constant time and the
longest common extension of two places is found by binary search.

A fingerprint holds the length, the hash of the whole text under two bases,
prefix hashes at fixed places (so the common beginning of two texts is found by
binary search over them) and the smallest span hash of each of 64 classes over
all spans of ``SPAN`` code points (so shared content is found wherever it is).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.llm.common import long_id, shuffle_width, slice_bounds, slice_of, text_of

P = np.uint64((1 << 31) - 1)
BASES = (911_382_323, 972_663_749)
SPAN = 12
CLASSES = 64
_S31 = np.uint64(31)


def _fold(x: np.ndarray) -> np.ndarray:
    """Modulo 2^31 - 1, for values under 2^63."""
    x = (x & P) + (x >> _S31)
    x = (x & P) + (x >> _S31)
    return np.where(x >= P, x - P, x)


class _Powers:
    """Powers of a base and of its inverse; grown by doubling."""

    def __init__(self, base: int) -> None:
        p = int(P)
        self.steps = (base, pow(base, p - 2, p))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) < n:
            for k in (0, 1):
                t = self.tables[k]
                self.tables[k] = np.concatenate([t, _fold(t * np.uint64(pow(self.steps[k], len(t), int(P))))])
        return [t[:n] for t in self.tables]


_POWERS = [_Powers(b) for b in BASES]


class PrefixHash:
    """Prefix hashes of one text under one base."""

    def __init__(self, text: str, base: int = 0) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        power, self.inverse = _POWERS[base].upto(self.n + 1)
        self.h = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_fold(codes * power[: self.n]), out=self.h[1:])
        self.h = _fold(self.h)

    def span(self, i: int, j: int) -> int:
        """Hash of text[i:j], the same wherever the span stands."""
        d = (int(self.h[j]) - int(self.h[i])) % int(P)
        return d * int(self.inverse[i]) % int(P)

    def spans(self, width: int) -> np.ndarray:
        """Hashes of all spans of a width, by where they begin; of the whole text if it is shorter."""
        w = min(width, self.n)
        d = self.h[w:] + P - self.h[: self.n + 1 - w]
        return _fold(_fold(d) * self.inverse[: self.n + 1 - w])


def span_equal(a: PrefixHash, i: int, b: PrefixHash, j: int, n: int) -> bool:
    return a.span(i, i + n) == b.span(j, j + n)


def longest_common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """How many code points a[i:] and b[j:] share from their beginning."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if span_equal(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def _grid(n: int) -> list[int]:
    """Places up to n: four to each doubling."""
    out, k = [], 0
    while (p := int(2 ** (k / 4))) <= n:
        if not out or p > out[-1]:
            out.append(p)
        k += 1
    return out


_GRID = np.array(_grid(1 << 40), np.int64)


def fingerprint(text: str) -> str:
    """length, whole hash, class minima (4 hex digits each), prefix hashes (6 each), joined by '-'. Empty text: '0---'."""
    if not text:
        return "0---"
    first, second = PrefixHash(text), PrefixHash(text, 1)
    x = first.spans(SPAN) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.full(CLASSES, (1 << 64) - 1, np.uint64)
    np.minimum.at(low, (x >> np.uint64(58)).astype(np.int64), x & np.uint64((1 << 58) - 1))
    # The upper bits of a minimum are near zero, so its lower bits are kept; an empty class is '....'.
    sketch = "".join("...." if v >= 1 << 58 else f"{v & 0xFFFF:04x}" for v in low.tolist())
    places = _GRID[: np.searchsorted(_GRID, first.n, "right")]
    grid = "".join(f"{v & 0xFFFFFF:06x}" for v in first.h[places].tolist())
    return f"{first.n:x}-{int(first.h[-1]):08x}{int(second.h[-1]):08x}-{sketch}-{grid}"


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints: the share of equal class minima, or of the common beginning if that is more."""
    if a == b:
        return 1.0
    (n, _, s, g), (m, _, t, h) = a.split("-"), b.split("-")
    if not s or not t:
        return 0.0
    x, y = np.frombuffer(s.encode(), "S4"), np.frombuffer(t.encode(), "S4")
    used = (x != b"....") | (y != b"....")
    same = float(((x == y) & used).sum() / max(1, used.sum()))
    low, high = 0, min(len(g), len(h)) // 6  # equal up to a place implies equal at all before it
    while low < high:
        mid = (low + high + 1) // 2
        if g[6 * mid - 6 : 6 * mid] == h[6 * mid - 6 : 6 * mid]:
            low = mid
        else:
            high = mid - 1
    begin = int(_GRID[low - 1]) / max(int(n, 16), int(m, 16), 1) if low else 0.0
    return min(1.0, max(same, begin))


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint): a narrow map; null and empty texts have the fingerprint '0---'."""
    read = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_chars", "fingerprint"])

    return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def with_next(docs: DataFrame, id_column: str, text_column: str, slices: int | None = None) -> DataFrame:
    """(slice, extra, doc_id, t): each slice in descending id order, followed by the first row after it.

    Texts are shuffled once. Rows are dealt out by cut points of the id, and the
    first row of each slice is also sent to the slice before it, so no task sees
    more than its slice and the order is closed to a ring. Null ids come last;
    rows of one id are ordered by their text.
    """
    read = docs.select(long_id(docs, id_column).alias("doc_id"), text_of(text_column).alias("t"))
    bounds = slice_bounds(read, "doc_id", slices or 8 * shuffle_width(docs.sparkSession))
    own = slice_of("doc_id", bounds).cast("int")
    heads = {r.slice: r.head for r in read.select(own.alias("slice"), "doc_id").groupBy("slice").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)  # bounded by the number of slices
    before = {n: order[i - 1] for i, n in enumerate(order)}
    head = F.array(*[F.lit(heads.get(i)).cast("long") for i in range(len(bounds) + 1)])
    target = F.array(*[F.lit(before.get(i, i)) for i in range(len(bounds) + 1)])
    place = lambda n, extra: F.struct(n.alias("slice"), F.lit(extra).alias("extra"))
    s = F.col("s")
    sent = F.when(
        F.get(head, s).eqNullSafe(F.col("doc_id")), F.array(place(s, 0), place(F.get(target, s), 1))
    ).otherwise(F.array(place(s, 0)))
    dealt = read.withColumn("s", own).select(F.explode(sent).alias("p"), "doc_id", "t").select("p.slice", "p.extra", "doc_id", "t")
    return dealt.repartition("slice").sortWithinPartitions("slice", "extra", F.col("doc_id").desc_nulls_last(), "t")


def edited_text(text: str, after: str) -> str:
    """The last third of the code points replaced by as many first ones of the next text, or all of it."""
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


def edit_likeness(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", slices: int | None = None) -> DataFrame:
    """One row for each input row: its fingerprint, that of its edited text, and likeness to that and to the next document.

    The next document is the one with the next lower id, the first after the
    last; a single row is next to itself. Null texts are empty; null ids come
    last and rows of one id are ordered by text. Ids that are not integers are
    refused. An empty table gives an empty result; other columns are ignored.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # slice, extra, id, text, fingerprint
        for batch in batches:
            out = []
            for n, extra, doc_id, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] == n and held[1]:
                    continue  # a repeated row of the head's id
                fp = fingerprint(t)
                if held is not None and held[0] == n:
                    edited = edited_text(held[3], t)
                    efp = fingerprint(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[2], len(held[3]), sha, held[4], efp, likeness(held[4], efp), likeness(held[4], fp)))
                held = (n, extra, doc_id, t, fp)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), types, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_column, text_column, slices).mapInArrow(run, schema)
