"""Token ids in sorted-string-table shards.

A shard holds documents by ascending identifier:

    data blocks    entries (shared key bytes, own key bytes, value bytes as varints; key suffix; value), then crc32
    sparse index   for each block: its last key, offset, length
    Bloom filter   bits over the keys
    footer         fixed size: places of index and filter, counts, id width, magic

A key is one byte (0 for a null identifier, else 1), the identifier as eight
big-endian bytes with the sign flipped, and a counter for repeated identifiers.
A lookup asks the filter, binary-searches the index and scans one block.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.llm.chunks import library_encoder, rounds, vocabulary_size
from lemmary.llm.common import fresh_path, long_id, shuffle_width, slice_bounds, text_of

MAGIC = b"LEMSST01"
FOOTER = struct.Struct("<QQQQQQQBB8s")  # index at, filter at, filter bits, documents, tokens, blocks, end, id width, hashes
BLOCK_BYTES = 64 << 10
BITS_PER_KEY, HASHES = 10, 7
#: Bytes of text for each shard, about.
SHARD_BYTES = 64 << 20


def _filesystem(path: str):
    """Any store that Arrow can open; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    if doc_id is None:
        return b"\0" + struct.pack(">QI", 0, repeat)
    return b"\1" + struct.pack(">QI", (doc_id + (1 << 63)) & ((1 << 64) - 1), repeat)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a = zlib.crc32(key)
    b = zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class ShardWriter:
    """Writes one shard; keys must ascend. The file appears under its name only when it is whole."""

    def __init__(self, path: str, width: int, attempt: int = 0) -> None:
        self.fs, self.path = _filesystem(path)
        self.temp = f"{self.path}.{attempt}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.width, self.at, self.block, self.last = width, 0, bytearray(), b""
        self.index: list[tuple[bytes, int, int]] = []
        self.crcs: list[bytes] = []
        self.docs = self.tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            top = min(len(key), len(self.last))
            while shared < top and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.crcs.append(key)
        self.docs += 1
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.out.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> int:
        self._flush()
        index_at = self.at
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", a, n) for k, a, n in self.index)
        bits = max(64, BITS_PER_KEY * len(self.crcs))
        bloom = bytearray((bits + 7) // 8)
        for key in self.crcs:
            for p in _bloom_places(key[:9], bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = index_at + len(index)
        end = bloom_at + len(bloom)
        self.out.write(index + bytes(bloom) + FOOTER.pack(index_at, bloom_at, bits, self.docs, self.tokens, len(self.index), end, self.width, HASHES, MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)
        return end + FOOTER.size


class Shard:
    """Reads one shard: its footer and index at once, blocks on demand."""

    def __init__(self, path: str) -> None:
        fs, at = _filesystem(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        (index_at, bloom_at, self.bits, self.docs, self.tokens, blocks, end, self.width, _, magic) = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC or end + FOOTER.size != size:
            raise ValueError(f"{path} is not a whole shard")
        self.file.seek(index_at)
        index = self.file.read(bloom_at - index_at)
        self.bloom = self.file.read(end - bloom_at)
        self.lasts: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        p = 0
        for _ in range(blocks):
            n, p = _read_varint(index, p)
            self.lasts.append(index[p : p + n])
            self.places.append(struct.unpack_from("<QQ", index, p + n))
            p += n + 16

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, n = self.places[i]
        self.file.seek(at)
        data = self.file.read(n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        key, p = b"", 0
        while p < n - 4:
            shared, p = _read_varint(data, p)
            own, p = _read_varint(data, p)
            size, p = _read_varint(data, p)
            key = key[:shared] + data[p : p + own]
            yield key, data[p + own : p + own + size]
            p += own + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.places)):
            yield from self._block(i)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4")

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every row with this identifier; an empty list if there is none."""
        prefix = key_of(doc_id)[:9]
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(prefix, self.bits)):
            return []
        out = []
        for i in range(bisect.bisect_left(self.lasts, prefix), len(self.lasts)):
            for key, value in self._block(i):
                if key[:9] == prefix:
                    out.append(self.ids(value))
                elif key[:9] > prefix:
                    return out
        return out


def write_shards(
    docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 0,
    id_width: int | None = None, shards: int | None = None, folder: str | None = None, shard_bytes: int = SHARD_BYTES,
) -> list[dict]:
    """Encode every whole text, append ``end_id`` and write shards in ascending identifier order.

    Returns a row for each shard, in order: path, documents, tokens, start (ids
    before it); the list is bounded by the number of shards, which follows from
    the bytes of the texts. A null text is empty; null identifiers come first,
    repeated ones in the order of their ids; identifiers that are not integers
    are refused; an empty table writes no shard. Ids take two bytes if the
    vocabulary allows, else four. Ids are shuffled once, as bytes.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "sst")
    most = max(vocabulary_size(vocabulary) - 1, end_id)
    id_width = id_width or (2 if most < 1 << 16 else 4)
    if most >= 1 << 8 * id_width:
        raise ValueError(f"ids up to {most} do not fit in {id_width} bytes")
    dtype = "<u2" if id_width == 2 else "<u4"
    read = docs.select(long_id(docs, id_column).alias("doc_id"), text_of(text_column).alias("t"))
    if shards is None:
        size = read.agg(F.sum(F.octet_length("t")).alias("b")).first().b or 0
        shards = max(2 * shuffle_width(spark), -(-size // shard_bytes))
    bounds = np.array(slice_bounds(read, "doc_id", shards), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary, "kept")
        last = np.array([end_id], dtype).tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = batch.column(0)
            shard = np.searchsorted(bounds, ids.fill_null(0).to_numpy(), "right")
            shard[ids.is_null().to_numpy(zero_copy_only=False)] = 0
            for part in rounds(texts):
                flat, ends = encoder.encode(texts[part])
                flat = flat.astype(dtype)
                values = [flat[a:b].tobytes() + last for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[part]), ids.slice(part.start, part.stop - part.start), pa.array(values, pa.binary())], ["shard", "doc_id", "ids"])
        encoder.rest_a_while()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        out, writer, now, last, repeat = [], None, None, None, 0
        path = lambda n: f"{folder}/shard-{n:08d}.sst"

        def close() -> None:
            if writer is not None:
                writer.close()
                out.append((now, path(now), writer.docs, writer.tokens))

        for batch in batches:
            for n, doc_id, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n != now:
                    close()
                    writer, now, last, repeat = ShardWriter(path(n), id_width, attempt), n, None, 0
                repeat = repeat + 1 if (doc_id,) == last else 0
                last = (doc_id,)
                writer.add(key_of(doc_id, repeat), value)
        close()
        yield pa.RecordBatch.from_pandas(
            pd.DataFrame(out, columns=["shard", "path", "docs", "tokens"]).astype({"shard": "int64", "path": "object", "docs": "int64", "tokens": "int64"}),
            schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]),
        )

    ordered = (
        read.mapInArrow(encode, "shard long, doc_id long, ids binary")
        .repartition("shard")
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    )
    rows = ordered.mapInArrow(write, "shard long, path string, docs long, tokens long").collect()
    start, out = 0, []
    for r in sorted(rows, key=lambda r: r.shard):
        out.append({"path": r.path, "docs": r.docs, "tokens": r.tokens, "start": start})
        start += r.tokens
    return out


def read_shards(spark, shards: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids): documents as the files hold them; start counts ids of all before."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not shards:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(path)
                rows, size = [], 0
                for key, value in shard:
                    ids = shard.ids(value).astype("<u4")
                    rows.append((id_of(key), start, len(ids), ids.tobytes()))
                    start += len(ids)
                    size += ids.nbytes
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    tasks = max(min(len(shards), shuffle_width(spark)), len(shards) // 8)  # a few shards in a task
    return table.repartition(tasks).mapInArrow(read, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "start", "n_tokens", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
