"""Hierarchical packing of token sequences into several context sizes.

Each document is routed to the smallest tier that holds what is left of it after
whole windows of the longest tier are cut off. Tiers are packed from the longest
to the shortest; the gap of a window is filled with the largest pieces of
shorter tiers that fit, then closed by cutting one piece. Windows of a tier are
dealt out to step groups of equal tokens so that their attention costs balance.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.llm.chunks import lean, library_encoder, rounds
from lemmary.llm.common import text_of

TIERS = (4096, 2048, 1024, 512)
#: Tokens that are packed together; bounds a task's memory whatever its input.
GROUP_TOKENS = 1 << 20
STEP_TOKENS = 8 * 4096

Piece = tuple[int, int, int]  # document, start, length


class _Pool:
    """Pieces of one tier by length; takes the largest that fits or the largest of all."""

    def __init__(self) -> None:
        self.keys: list[tuple[int, int, int]] = []  # length, document, start

    def add(self, p: Piece) -> None:
        bisect.insort(self.keys, (p[2], p[0], p[1]))

    def take(self, most: int) -> Piece | None:
        i = bisect.bisect_left(self.keys, (most + 1, -1, -1))
        if not i:
            return None
        n, d, s = self.keys.pop(i - 1)
        return d, s, n

    def take_largest(self) -> Piece | None:
        if not self.keys:
            return None
        n, d, s = self.keys.pop()
        return d, s, n


def pack(pieces: list[Piece], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """(windows, rest): windows are lists of pieces that fill a tier's size exactly.

    With ``last``, what fills no window is cut into windows of powers of two and
    rest is empty; otherwise it is returned for the next group.
    """
    top = tiers[0]
    pools = [_Pool() for _ in tiers]

    def route(p: Piece) -> None:
        if p[2]:
            tier = max(i for i, t in enumerate(tiers) if p[2] <= t)
            pools[tier].add(p)

    windows: list[list[Piece]] = []
    for d, s, n in pieces:
        whole = n // top
        windows += [[(d, s + i * top, top)] for i in range(whole)]
        route((d, s + whole * top, n - whole * top))
    rest: list[Piece] = []
    for i, size in enumerate(tiers):
        while (first := pools[i].take_largest()) is not None:
            window, gap = [first], size - first[2]
            while gap:
                p = next((p for pool in pools[i:] if (p := pool.take(gap)) is not None), None)
                if p is None:
                    break
                window.append(p)
                gap -= p[2]
            if gap:  # close it with the front of a larger piece: the shortest tier that has one
                p = next((p for pool in reversed(pools[i:]) if (p := pool.take_largest()) is not None), None)
                if p is not None:
                    window.append((p[0], p[1], gap))
                    route((p[0], p[1] + gap, p[2] - gap))
                    gap = 0
            if gap:
                rest += window
            else:
                windows.append(window)
    if not last:
        return windows, rest
    left = sum(p[2] for p in rest)
    queue = list(reversed(rest))
    while left:
        gap = min(top, 1 << (left.bit_length() - 1))
        left -= gap
        window = []
        while gap:
            d, s, n = queue.pop()
            m = min(n, gap)
            window.append((d, s, m))
            gap -= m
            if n > m:
                queue.append((d, s + m, n - m))
        windows.append(window)
    return windows, []


def step_groups(windows: list[list[Piece]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Number of the step of each window: steps of one window size hold equal tokens and near-equal attention cost."""
    out, first = [0] * len(windows), 0
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(windows):
        by_size.setdefault(sum(p[2] for p in w), []).append(i)
    for size in sorted(by_size, reverse=True):
        own = sorted(by_size[size], key=lambda i: (-sum(p[2] * p[2] for p in windows[i]), i))
        steps = max(1, -(-len(own) * size // step_tokens))
        for k, i in enumerate(own):  # back and forth, so no step gets all the costly ones
            lap, at = divmod(k, steps)
            out[i] = first + (at if lap % 2 == 0 else steps - 1 - at)
        first += steps
    return out


FIELDS = [
    ("doc_id", None), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int64()), ("step_group", pa.int64()), ("ids", pa.list_(pa.int32())),
]


def pack_documents(
    docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2,
    tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS, with_ids: bool = True,
) -> DataFrame:
    """One row for each piece: its place in its document, in its sequence, its window size, step group and ids.

    Every id of every document, its end id included, lies in exactly one piece.
    A null text is empty and packs its end id alone. Repeated rows and null ids
    are packed like others; an empty table gives an empty result; other columns
    are ignored. Each task packs its own rows, a bounded group at a time: no
    shuffle, and a lost task gives the same pieces again. Sequences and step
    groups are numbered within a task, with the task's number above bit 32.
    """
    read = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("t"))
    id_field = read.schema["doc_id"]
    names = [n for n, _ in FIELDS if with_ids or n != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = library_encoder(vocabulary, "dropped")
        base = TaskContext.get().partitionId() << 32
        docs_now: dict[int, tuple] = {}  # number -> id, ids
        queue: list[Piece] = []
        state = {"next": 0, "tokens": 0, "sequence": 0, "step": 0}
        id_type = None

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal queue
            windows, queue = pack(queue, tiers, last)
            rows, steps = [], step_groups(windows)
            for window, step in zip(windows, steps, strict=True):
                at, size = 0, sum(p[2] for p in window)
                for d, s, n in window:
                    own, ids = docs_now[d]
                    cut = ids[s : s + n]
                    rows.append((own, s, n, zlib.crc32(cut.astype("<u4").tobytes()), len(ids), base | state["sequence"], at, size, base | state["step"] + step, cut))
                    at += n
                state["sequence"] += 1
            state["step"] += max((step + 1 for step in steps), default=0)
            kept = {p[0] for p in queue}
            for d in [d for d in docs_now if d not in kept]:
                del docs_now[d]
            state["tokens"] = sum(p[2] for p in queue)
            for a in range(0, len(rows), 20_000):
                columns = list(zip(*rows[a : a + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, id_type if n == "doc_id" else t) for c, (n, t) in zip(columns, FIELDS, strict=True) if n in names], names
                )

        for batch in batches:
            id_type = batch.schema.field(0).type
            own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in rounds(texts):
                flat, ends = encoder.encode(texts[part])
                for k, i in enumerate(range(part.start, part.stop)):
                    ids = np.append(flat[ends[k] : ends[k + 1]], np.int32(end_id))
                    d = state["next"]
                    state["next"] += 1
                    docs_now[d] = own[i], ids
                    queue.append((d, 0, len(ids)))
                    state["tokens"] += len(ids)
                if state["tokens"] >= group_tokens:
                    yield from flush(False)
        if queue:
            yield from flush(True)
        docs_now.clear()
        encoder.rest_a_while()

    sql = {pa.int64(): "long", pa.list_(pa.int32()): "array<int>"}
    schema = ", ".join(f"{n} {id_field.dataType.simpleString() if t is None else sql[t]}" for n, t in FIELDS if n in names)
    return read.mapInArrow(lean(run, encodes=True), schema)
