"""Byte-level BPE by a contiguous rank array, and decoding.

A short word keeps its parts and the ranks of adjacent pairs in two flat lists.
The lowest rank is found by scanning, its boundary deleted and the two
neighbouring ranks refreshed, until no pair has a rank. Scanning is quadratic,
so words over ``LONG_WORD`` bytes take a heap over a linked list, which gives
the same merges.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.llm.chunks import SPLIT_KEPT, ChunkEncoder, byte_names, check_split, rounds
from lemmary.llm.common import text_of

LONG_WORD = 256
SHIFT = 20
#: Words that a Python worker keeps; its decoder runs beside it in another worker.
WORDS = 250_000
NONE = 1 << 60


class RankArrayBPE:
    """Encoder and decoder of a vocabulary file with a vocabulary and ordered merges."""

    def __init__(self, path: str) -> None:
        spec = check_split(path, "kept")
        vocab = spec["model"]["vocab"]
        names = byte_names()
        value = {c: b for b, c in enumerate(names)}
        self.byte_ids = [vocab[c] for c in names]
        #: Rank of a pair of ids, as one integer, and the id that each rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] << SHIFT | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.table = [b""] * size
        for token, i in vocab.items():
            self.table[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            self.table[i] = token.encode()
        self.split = regex.compile(SPLIT_KEPT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.kept = True

    def merge_short(self, word: bytes) -> list[int]:
        ids, rank_of, made = self.byte_ids, self.ranks.get, self.made
        parts = [ids[b] for b in word]
        ranks = [rank_of(a << SHIFT | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            new = parts[i] = made[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << SHIFT | new, NONE)
            if i < len(ranks):
                ranks[i] = rank_of(new << SHIFT | parts[i + 1], NONE)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        rank_of = self.ranks.get
        parts: list[int | None] = [self.byte_ids[b] for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of(parts[i] << SHIFT | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue  # an older entry
            parts[i], parts[j] = self.made[rank], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n and (r := rank_of(parts[left] << SHIFT | parts[right], NONE)) != NONE:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p is not None]

    def letters(self, word: str) -> bytes:
        return self.word(" " + word)

    def word(self, word: str) -> bytes:
        """Ids of one word of the split, as 32-bit integers."""
        raw = word.encode()
        return array("i", self.merge_short(raw) if len(raw) <= LONG_WORD else self.merge_long(raw)).tobytes()

    def pieces(self, text: str) -> list[str] | None:
        """Words of the split; None if the text holds a special token."""
        return None if any(s in text for s in self.special) else self.split.findall(text)

    def encode(self, text: str) -> bytes:
        found = self.pieces(text)
        if found is not None:
            return b"".join(map(self.word, found))
        return b"".join(
            array("i", [self.special[part]]).tobytes() if i % 2 else b"".join(map(self.word, self.split.findall(part)))
            for i, part in enumerate(self.cut.split(text))
        )

    def ids(self, text: str) -> list[int]:
        return array("i", self.encode(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """Bytes of all ids, specials included, as UTF-8; invalid bytes become U+FFFD."""
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, tuple[RankArrayBPE, ChunkEncoder]] = {}


def _load(path: str) -> tuple[RankArrayBPE, ChunkEncoder]:
    if path not in _LOADED:
        bpe = RankArrayBPE(path)
        _LOADED[path] = bpe, ChunkEncoder(bpe, WORDS)
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): one row for each input row, ids of the whole text.

    A null or empty text has no ids. Repeated rows and null ids give a row each;
    an empty table gives an empty result; other columns are ignored. Narrow: no
    shuffle, bounded memory, a lost task is simply run again.
    """
    read = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("t"))
    id_type = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = _load(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in rounds(texts):
                flat, ends = encoder.encode(texts[part])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                own = batch.column(0).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([own, ids], ["doc_id", "ids"])

    return read.mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The input rows with a column ``decoded``; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _load(vocabulary)
        piece = np.array(bpe.table, dtype=object)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            values = lists.values.to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy()
            texts = [b"".join(piece[values[a:b]]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    from pyspark.sql.types import StringType, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add("decoded", StringType()))
