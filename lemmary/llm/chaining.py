"""Repeated passages by collinear chaining of shared word k-mers.

Every k-mer of a text is a seed. A passage of L words with a share of i equal to
those of another text has at least L (1 - K (1 - i)) - K + 1 of its k-mers in
common with it, as a changed word spoils K of them: 7 of 50 words at 0.8. All
pairs of texts that hold a seed are linked if few hold it. Of a seed that many
hold, those holders are linked, all of them, in whose text a passage could have
so many k-mers in common by such seeds alone (``dense``): any other passage has
one of its other k-mers in common too. A pair is chained only where its links
and the text's other such places reach that number. Unchanged runs of min_words
words whose seeds do not settle the matter, as the text repeats them, are keys
as well, to the first text that holds the run. Links of a pair of texts are chained: the best increasing sequence under gap costs, found
with a Fenwick tree of prefix maxima. Chains are aligned on the words
themselves, between their anchors and beyond both ends, which finds passages
with changed words too. Identical texts form a class first and only its first
member is searched.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from operator import lt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmary.llm.common import text_of, written

K, WINDOW = 4, 1
#: Anchors that make a chain: one, as a passage may have one k-mer only in common that few texts hold.
LEAST = 1
#: A seed with more holders links those only whose places are dense.
FEW = 64
#: Words whose seeds are made at once.
WORDS = 50_000
#: Words between the anchors of an unchanged run.
STEP = 6
#: Score of a covered word, cost of a word in a gap (both sides count).
WORD_SCORE, GAP_COST = 1.0, 0.05
MIN_WORDS, MIN_IDENTITY = 50, 0.8
_C = np.uint64(0xD6E8FEB86659FD93)
#: Words read beyond a chain's ends, and the grid that its span is widened to.
MARGIN, GRID = 48, 32
#: A chain may be parted at gaps of so many words.
SPLIT_GAP = 6
_B = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of text whose words are hashed at once.
BLOCK = 1 << 20
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


#: A number for each byte; A-Z have those of a-z.
_BYTE = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _B)
_BYTE[65:91] = _BYTE[97:123]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base)])


_POWERS = _powers(_B, BLOCK), _powers(_INVERSE, BLOCK)


def _block_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text) of texts that follow each other in ``data``.

    A word's hash is its part of a running polynomial sum, divided by the power of its start.
    """
    n = len(data)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = ends[(ends > 0) & (ends < n)]  # words end where texts do
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _POWERS if n <= BLOCK else (_powers(_B, n), _powers(_INVERSE, n))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    at = np.searchsorted(begin, ends)
    return _mixed((total[end] - total[begin]) * inverse[begin]), np.diff(np.r_[0, at])


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words of each text); text i is the bytes from ends[i - 1] to ends[i]. A-Z count as a-z.

    More than BLOCK bytes are one text, which is hashed in parts that end at white space.
    """
    if len(data) <= BLOCK:
        return _block_hashes(data, ends)
    gaps = np.flatnonzero(_SPACE[data])
    cuts = [0]
    while len(data) - cuts[-1] > BLOCK:
        i = int(np.searchsorted(gaps, cuts[-1] + BLOCK))
        if i and gaps[i - 1] > cuts[-1]:
            cuts.append(int(gaps[i - 1]))
        elif i < len(gaps):
            cuts.append(int(gaps[i]))
        else:
            break
    cuts.append(len(data))
    hashes = np.concatenate([_block_hashes(data[a:b], np.array([b - a]))[0] for a, b in zip(cuts, cuts[1:], strict=False)])
    return hashes, np.array([len(hashes)])


def text_blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, ends) of texts in a row without nulls: blocks of at most BLOCK bytes, or one longer text."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        yield whole[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        i = j


def minimizers(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(seed, position) of one text's ``numbered_minimizers``."""
    return numbered_minimizers(words, np.array([len(words)]), k, window)[:2]


def numbered_minimizers(
    words: np.ndarray, sizes: np.ndarray, k: int = K, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, position, count so far, repeated at all) of texts of ``sizes`` words in a row, and the number of seeds of each.

    Seeds are the smallest k-mer hash of each run of ``window`` k-mers, once. Any shared run of window + k - 1 words
    shares a seed. A seed that a text repeats is renamed by its count so far, so the n-th place in one text meets the
    n-th in another: repeated words and lines chain too.
    """
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(len(sizes), np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * _B + words[j : j + n]
    h ^= h >> np.uint64(32)
    h *= _C
    h ^= h >> np.uint64(32)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = np.cumsum(sizes) - sizes
    kmers = np.maximum(sizes - k + 1, 0)
    runs = np.where(kmers > 0, np.maximum(kmers - window + 1, 1), 0)
    at = np.repeat(start - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    end = np.repeat(start + kmers - 1, runs)  # a text's last k-mer: a shorter window is looked at as far as there
    seeds, place = h[at], at
    for j in range(1, window):
        there = np.minimum(at + j, end)
        less = h[there] < seeds
        seeds, place = np.where(less, h[there], seeds), np.where(less, there, place)
    once = np.r_[True, place[1:] != place[:-1]] if len(place) else np.zeros(0, bool)
    seeds, place = seeds[once], place[once]
    owner = text[place]
    # Equal seeds stay in the order of their texts.
    order = np.argsort(seeds, kind="stable")
    ordered, of = seeds[order], owner[order]
    begin = np.flatnonzero(np.r_[True, (ordered[1:] != ordered[:-1]) | (of[1:] != of[:-1])]) if len(seeds) else np.zeros(0, np.int64)
    times = np.diff(np.r_[begin, len(seeds)])
    count, again = np.zeros(len(seeds), np.uint64), np.zeros(len(seeds), bool)
    count[order] = np.arange(len(seeds)) - np.repeat(begin, times)
    again[order] = np.repeat(times > 1, times)
    seeds = seeds + count * np.uint64(0xC2B2AE3D27D4EB4F)
    return seeds, place - start[owner], count, again, np.bincount(owner, minlength=len(sizes))


def run_hashes(words: np.ndarray, run: int) -> np.ndarray:
    """A hash of each run of ``run`` words, built from runs of powers of two."""
    n = len(words) - run + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, power, at, size = np.zeros(n, np.uint64), words.astype(np.uint64), 0, 1
    while True:
        if run & size:
            out = ((out ^ (out >> np.uint64(29))) * _B + power[at : at + n]) * _C
            at += size
        if at == run:
            return out ^ (out >> np.uint64(32))
        power = ((power[:-size] ^ (power[:-size] >> np.uint64(31))) * _C + power[size:]) * _B
        size *= 2


def run_starts(n_words: int, lone: np.ndarray, settled: np.ndarray, run: int, k: int = K, window: int = WINDOW) -> np.ndarray:
    """Starts of the runs that need a key: none of the seeds that the run determines is ``lone``, fewer than LEAST are ``settled``.

    A seed at least window - 1 k-mers from both ends of a run is chosen by
    windows inside it, so every holder of the run has it too. A lone seed is in
    no other text; settled ones link all pairs of their holders, and LEAST of
    them are enough for a chain.
    """
    n = n_words - run + 1
    if n < 1:
        return np.zeros(0, np.int64)
    start = np.arange(n)
    lo, hi = start + window - 1, start + run - k - window + 2

    def inside(places: np.ndarray) -> np.ndarray:
        before = np.r_[0, np.cumsum(np.bincount(places, minlength=n_words))]
        return before[np.maximum(hi, lo)] - before[lo]

    return start[(inside(lone) == 0) & (inside(settled) < LEAST)]


class Fenwick:
    """Prefix maxima of (value, item) over ranks."""

    def __init__(self, n: int) -> None:
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, entry: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if entry > self.best[i]:
                self.best[i] = entry
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """Largest entry at ranks below i."""
        out = (-1e18, -1)
        while i:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def _ascending(x: list[int], y: list[int], k: int) -> tuple[list[float], list[int]]:
    """(score, predecessor) of anchors that all ascend: the one before is the best, as stops on the way only add words."""
    score, before = [k * WORD_SCORE] * len(x), [-1] * len(x)
    for i in range(1, len(x)):
        dx, dy = x[i] - x[i - 1], y[i] - y[i - 1]
        value = score[i - 1] + min(k, dx, dy) * WORD_SCORE - GAP_COST * (dx + dy)
        if value > score[i]:
            score[i], before[i] = value, i - 1
    return score, before


def _best_before(x: list[int], y: list[int], k: int) -> tuple[list[float], list[int]]:
    """(score, predecessor) of any anchors.

    One whose words end before an anchor on both sides is the prefix maximum of
    a Fenwick tree, as linear costs split into a part of each end. One that
    overlaps it starts fewer than k words before it in x or y: those columns and
    rows are looked at one by one.
    """
    order = sorted(set(y))
    tree = Fenwick(len(order))
    rows: dict[int, tuple[float, int]] = {}  # y -> best (score + costs, anchor) of anchors at least k words back in x
    recent: list[tuple[int, list[int], list[tuple[float, int]], dict[int, tuple[float, int]]]] = []  # columns fewer than k back
    score, before = [0.0] * len(x), [-1] * len(x)
    own: list[tuple[int, tuple[float, int]]] = []  # the present column, by descending y
    for i in range(len(x)):
        if i and x[i] != x[i - 1]:
            own.reverse()
            tops, top = [], (-1e18, -1)
            for _, entry in own:
                top = max(top, entry)
                tops.append(top)
            recent.append((x[i - 1], [at for at, _ in own], tops, dict(own)))
            own = []
            while recent and recent[0][0] <= x[i] - k:
                for at, entry in recent.pop(0)[3].items():
                    tree.put(bisect.bisect_left(order, at), entry)
                    rows[at] = max(rows.get(at, entry), entry)
        at, cost = y[i], GAP_COST * (x[i] + y[i])
        value, p = tree.top(bisect.bisect_right(order, at - k))
        best = (value - cost + k * WORD_SCORE, p)
        for d in range(1, k):
            if at - d in rows:
                value, p = rows[at - d]
                best = max(best, (value - cost + d * WORD_SCORE, p))
        for column, ys, tops, entries in recent:
            d = x[i] - column
            n = bisect.bisect_right(ys, at - d)
            if n:
                value, p = tops[n - 1]
                best = max(best, (value - cost + d * WORD_SCORE, p))
            for e in range(1, d):
                if at - e in entries:
                    value, p = entries[at - e]
                    best = max(best, (value - cost + e * WORD_SCORE, p))
        score[i] = k * WORD_SCORE
        if best[0] > score[i]:
            score[i], before[i] = best
        own.append((at, (score[i] + cost, i)))
    return score, before


def chains(x: list[int], y: list[int], k: int = K, least: int = LEAST) -> list[list[int]]:
    """Chains of anchors (x[i], y[i]) that ascend in both; x ascends, ties by descending y. Best first, anchors used once.

    Score of a chain: the words that its anchors cover (a word in two anchors
    counts once) less GAP_COST for each word that it advances on either side.
    """
    if all(map(lt, x, x[1:])) and all(map(lt, y, y[1:])):
        score, before = _ascending(x, y, k)
    else:
        score, before = _best_before(x, y, k)
    used, out = [False] * len(x), []
    for i in sorted(range(len(x)), key=lambda i: (-score[i], i)):
        chain, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = before[j]
        if len(chain) >= least:
            out.append(chain[::-1])
    return out


def _extend(a: np.ndarray, b: np.ndarray, drop: float = 8.0) -> tuple[int, int]:
    """(words, equal words): how far two sequences go on together; a wrong word costs 2, and ``drop`` below the best ends it."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1.0, -2.0))
    top = np.maximum.accumulate(np.maximum(total, 0.0))
    stop = np.flatnonzero(top - total > drop)
    end = int(stop[0]) if len(stop) else n
    if not end or total[:end].max() <= 0:
        return 0, 0
    best = int(total[:end].argmax()) + 1
    return best, int(same[:best].sum())


def align(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int], k: int = K) -> tuple[int, int, int, int, int]:
    """(start, end, other start, other end, equal words) of the passage around anchors x in a and y in b."""
    left, same = _extend(a[: x[0]][::-1], b[: y[0]][::-1])
    ax, by, equal = x[0], y[0], same
    for i, j in zip(x, y, strict=True):
        if i < ax or j < by:  # overlaps the anchor before on the same or another diagonal
            step = min(i + k - ax, j + k - by)
            if step <= 0:
                continue
            s, t = i + k - step, j + k - step
        else:
            s, t = i, j
        ga, gb = s - ax, t - by
        if ga == gb:
            equal += int((a[ax:s] == b[by:t]).sum())
        elif ga and gb:  # equal beginning and end of an uneven gap
            front, in_front = _extend(a[ax:s], b[by:t])
            back, in_back = _extend(a[ax + front : s][::-1], b[by + front : t][::-1])
            equal += in_front + in_back
        equal += i + k - s
        ax, by = i + k, j + k
    right, more = _extend(a[ax:], b[by:])
    return x[0] - left, ax + right, y[0] - left, by + right, equal + more


def passages_of(
    a: np.ndarray, b: np.ndarray, x: list[int], y: list[int], min_words: int, min_identity: float, k: int = K
) -> Iterator[tuple[int, int, int, int, int]]:
    """Alignments along a chain that are long and alike enough. A stretch that is not alike enough is parted at its widest gap."""
    todo = [(0, len(x))]
    while todo:
        i, j = todo.pop()
        s, e, t, u, equal = align(a, b, x[i:j], y[i:j], k)
        size = max(e - s, u - t)
        if size < min_words:
            continue
        if equal >= min_identity * size:
            yield s, e, t, u, equal
            continue
        gap, at = max(((max(x[n + 1] - x[n], y[n + 1] - y[n]) - k, n + 1) for n in range(i, j - 1)), default=(0, 0))
        if gap >= SPLIT_GAP:
            todo += [(i, at), (at, j)]


def _seeds(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    read = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_column).alias("doc_id"), text_of(text_column).alias("t"))
    read = read.withColumn("sha", F.sha2(F.col("t").cast("binary"), 256))
    id_type = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, short = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
            for data, stops in text_blocks(batch.column(2)):
                w, sizes = word_hashes(data, stops)
                n.append(sizes)
                short.append(w.astype(np.uint32))
            sizes = np.concatenate(n)
            words = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(short).view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes.astype(np.int32)), words], ["rid", "doc_id", "sha", "n_words", "words"]
            )

    return written(read.mapInArrow(run, f"rid long, doc_id {id_type}, sha string, n_words int, words array<int>"), "chain-words-of")


def _places(texts: DataFrame) -> DataFrame:
    """(rid, seed, x, twice): every seed of the texts' words; ``twice`` where the text repeats it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(1)
            at, every = c.offsets.to_numpy().astype(np.int64), c.values.to_numpy(zero_copy_only=False)
            i = 0
            while i < batch.num_rows:  # blocks of texts, or one longer text
                j = max(i + 1, int(np.searchsorted(at, at[i] + WORDS, side="right")) - 1)
                words = every[at[i] : at[j]].view(np.uint32).astype(np.uint64)
                seeds, places, _, again, held = numbered_minimizers(words, np.diff(at[i : j + 1]))
                rid = np.repeat(batch.column(0).to_numpy()[i:j], held)
                columns = [pa.array(rid), pa.array(seeds.view(np.int64)), pa.array(places.astype(np.int32)), pa.array(again)]
                for k in range(0, len(rid), WORDS):
                    yield pa.RecordBatch.from_arrays([x[k : k + WORDS] for x in columns], ["rid", "seed", "x", "twice"])
                i = j

    return texts.select("rid", "words").mapInArrow(run, "rid long, seed long, x int, twice boolean")


def shared_at_least(min_words: int, min_identity: float, k: int = K) -> tuple[float, int]:
    """(a, b): a passage of n words, ``min_words`` or more, at ``min_identity`` has at least a n + b k-mers in common with the other text."""
    return max(1 - k * (1 - min_identity), 0.0), 1 - k


def dense(places: np.ndarray, min_words: int, min_identity: float, k: int = K) -> np.ndarray:
    """Whether a passage around each of the ascending places could have all the k-mers that it must share at these places.

    n places from f to g are in at least g - f + k words, so n >= a (g - f + k) + b
    is asked, and as many as ``min_words`` words share; the farthest g for each f
    comes from suffix maxima.
    """
    a, b = shared_at_least(min_words, min_identity, k)
    n, least = len(places), max(1, math.ceil(a * min_words + b - 1e-9))
    out = np.zeros(n + 1, np.int64)
    if n >= least:
        g = np.arange(n) - a * places
        tops = np.maximum.accumulate(g[::-1])[::-1]
        far = np.searchsorted(-tops, -(g + a * k + b - 1 - 1e-6), side="right") - 1  # the last place with g as large as that
        first = np.flatnonzero(far - np.arange(n) + 1 >= least)
        np.add.at(out, first, 1)
        np.add.at(out, far[first] + 1, -1)
    return np.cumsum(out)[:n] > 0


def _anchors(columns: list[np.ndarray], k: int = K, step: int = STEP) -> list[np.ndarray]:
    """(rid, other, x, y), sorted and once each, from matches of seeds (run 0) and of runs of words.

    Runs that go on from word to word are one stretch, which gives anchors ``step`` words apart and one at its end.
    """
    *seeds, run = columns
    is_run = run > 0
    if is_run.any():
        rid, other, x, y, size = (c[is_run] for c in columns)
        order = np.lexsort((x, y - x, other, rid))
        rid, other, x, y, size = (c[order] for c in (rid, other, x, y, size))
        joined = (rid[1:] == rid[:-1]) & (other[1:] == other[:-1]) & (x[1:] == x[:-1] + 1) & (y[1:] == y[:-1] + 1)
        first, last = np.r_[True, ~joined], np.r_[~joined, True]
        long = x[last] - x[first] + size[last] - k  # from the first to the last anchor
        n = long // step + 1
        along = step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        parts = zip((rid, other, x, y), (0, 0, along, along), (0, 0, long, long), strict=True)
        seeds = [np.concatenate([c[~is_run], np.repeat(e[first], n) + a, e[first] + z]) for c, (e, a, z) in zip(seeds, parts, strict=True)]
        rid, other, x, y = seeds
        order = np.lexsort((-y.astype(np.int64), x, other, rid))
        seeds = [c[order] for c in seeds]
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in seeds], axis=0)]
        seeds = [c[new] for c in seeds]
    return seeds


def _chained(matches: DataFrame, common: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """Chains of each pair: (rid, other, xs, ys), word positions of the anchors.

    ``common`` has places (rid, x) that links may lack. A pair whose links are
    too few for a passage even with all of those is left out.
    """
    none = [F.lit(-1).cast("long").alias("other"), "x", F.lit(0).alias("y"), F.lit(0).alias("run")]
    matches = matches.unionByName(common.select("rid", *none))
    a, b = shared_at_least(min_words, min_identity)
    least = a * min_words + b - 1e-9
    dealt = matches.repartition("rid").sortWithinPartitions("rid", "other", "x", F.col("y").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def solve(columns: list[np.ndarray]) -> pa.RecordBatch:
            lacked = columns[1] < 0
            lack_of, lack = columns[0][lacked], columns[2][lacked]  # by rid and x
            rid, other, x, y = _anchors([c[~lacked] for c in columns])
            cut = np.flatnonzero(np.r_[True, (rid[1:] != rid[:-1]) | (other[1:] != other[:-1])]) if len(rid) else np.zeros(0, np.int64)
            size = np.diff(np.r_[cut, len(rid)])
            out = []
            for a, n in zip(cut[size >= LEAST].tolist(), size[size >= LEAST].tolist(), strict=True):
                more = lack[np.searchsorted(lack_of, rid[a]) : np.searchsorted(lack_of, rid[a], side="right")]
                if n + len(more) < least:
                    continue
                own = np.unique(x[a : a + n])
                all_ = np.union1d(own, more)
                near = dense(all_, min_words, min_identity)
                if not near[np.searchsorted(all_, own)].any():
                    continue
                near = near[np.searchsorted(all_, x[a : a + n])].tolist()
                xs, ys = x[a : a + n].tolist(), y[a : a + n].tolist()
                for c in chains(xs, ys):
                    if any(near[i] for i in c):
                        out.append((int(rid[a]), int(other[a]), [xs[i] for i in c], [ys[i] for i in c]))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(columns, kinds, strict=True)], ["rid", "other", "xs", "ys"])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                if held[0][0][0] != held[-1][0][-1]:
                    rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                    end = int(np.searchsorted(rows[0], rows[0][-1]))
                    yield solve([c[:end] for c in rows])
                    held = [[c[end:] for c in rows]]
        if held:
            yield solve([np.concatenate(c) for c in zip(*held, strict=True)])

    return dealt.mapInArrow(run, "rid long, other long, xs array<int>, ys array<int>")


def _slices(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, lo, hi, words): 32-bit hashes of the words lo to hi of each wanted text; spans are few because they lie on a grid."""
    by_row = wanted.distinct().groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    cut = table.select("rid", "words").join(by_row, "rid").select("rid", F.explode("spans").alias("s"), "words")
    return cut.select("rid", "s.lo", "s.hi", F.slice("words", F.col("s.lo") + 1, F.col("s.hi") - F.col("s.lo")).alias("words"))


def _run_matches(table: DataFrame, held: DataFrame, run: int) -> DataFrame:
    """(rid, other, x, y, run): each run of ``run`` words that a text shares with the first text that holds it, unless its seeds settle it.

    A place whose seed the text repeats never rules a run out: its name counts repeats.
    """
    known = held.groupBy("rid").agg(F.collect_list(F.col("x") * 2 + F.col("settled").cast("int")).alias("known"))
    read = table.filter(F.col("n_words") >= run).select("rid", "words").join(known, "rid").select("rid", "words", "known")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (w, we), (z, ze) = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in batch.columns[1:])
            rid = batch.column(0).to_numpy()
            for i in range(batch.num_rows):
                words = w[we[i] : we[i + 1]].view(np.uint32)
                known = z[ze[i] : ze[i + 1]]
                _, places, count, _, _ = numbered_minimizers(words.astype(np.uint64), np.array([len(words)]))
                alone = np.zeros(len(words), bool)
                alone[places[count == 0]] = True
                alone[known >> 1] = False
                x = run_starts(len(words), np.flatnonzero(alone), known[known & 1 > 0] >> 1, run)
                if len(x):
                    h = run_hashes(words, run)[x].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), rid[i])), pa.array(h), pa.array(x.astype(np.int32))], ["rid", "run", "x"])

    runs = written(read.mapInArrow(look, "rid long, run long, x int"), "chain-runs")
    low = F.min(F.struct(F.col("rid").alias("r"), F.col("x").alias("x"))).alias("low")
    first = runs.groupBy("run").agg(low, F.max("rid").alias("b")).filter("low.r < b")
    # Read from a table, both sides of the join are plain exchanges: a frequent run's partition can be split.
    first = written(first.select("run", F.col("low.r").alias("other"), F.col("low.x").alias("y")), "chain-first")
    return runs.join(first, "run").filter("rid <> other").select("rid", "other", "x", "y", F.lit(run).alias("run"))


def _linked(unique: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(held, matches, common): seeds that several texts hold, (rid, x, settled); their links, (rid, other, x, y, run = 0); places (rid, x) that links may lack.

    A seed that FEW texts or fewer hold links all pairs of them, any other all
    pairs of its dense holders.
    """
    seeds = _places(unique)
    common = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice")).filter("n > 1")
    common = written(common.select("seed", F.least("n", F.lit(FEW + 1)).cast("int").alias("n"), "twice"), "chain-common")
    held = written(seeds.select("rid", "seed", "x").join(common, "seed"), "chain-held")
    few = held.filter(F.col("n") <= FEW).groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("rid", "x"))).alias("all"))
    few = few.select("all", F.posexplode("all").alias("i", "me")).filter("i > 0").select("me", F.explode(F.slice("all", 1, F.col("i"))).alias("o"))
    few = few.select(F.col("me.rid").alias("rid"), F.col("o.rid").alias("other"), F.col("me.x").alias("x"), F.col("o.x").alias("y"))
    often = held.filter((F.col("n") > FEW) | F.col("twice")).select("rid", "x", F.when(F.col("n") > FEW, F.col("seed")).alias("seed"))
    repeated = seeds.filter("twice").select("rid", "x", F.lit(None).cast("long").alias("seed"))
    often = written(often.unionByName(repeated).groupBy("rid", "x").agg(F.max("seed").alias("seed")), "chain-often")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.sort(places.values.to_numpy())
                x = x[dense(x, min_words, min_identity)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), rid)), pa.array(x.astype(np.int32))], ["rid", "x"])

    near = often.groupBy("rid").agg(F.collect_list("x").alias("places")).mapInArrow(run, "rid long, x int")
    many = written(often.filter("seed IS NOT NULL").join(near, ["rid", "x"]).select("seed", "rid", "x"), "chain-dense")
    others = many.select("seed", F.col("rid").alias("other"), F.col("x").alias("y"))
    many = many.join(others, "seed").filter("rid > other").select("rid", "other", "x", "y")
    matches = few.unionByName(many).withColumn("run", F.lit(0))
    return held.select("rid", "x", F.expr(f"n <= {FEW} AND NOT twice").alias("settled")), matches, often.select("rid", "x")


def repeated_passages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY
) -> DataFrame:
    """Rows (doc_id, kind, other_id, start, end, other_start, other_end, words, identity); positions count words, ends are exclusive.

    kind 'passage': words start to end of the first row of doc_id's class align
    with the other text at ``min_identity`` or more over ``min_words`` or more.
    kind 'copy': the text is identical to that of the first row of its class,
    other_id; such rows take part in passages through it. Null and empty texts
    hold no words and give no rows. Null ids stay null; repeated rows of one id
    are copies of each other; an empty table gives an empty result; other columns
    are ignored.
    """
    table = _seeds(docs, id_column, text_column)
    classes = table.filter("n_words > 0").groupBy("sha").agg(F.min(F.struct("rid", "doc_id")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    classes = written(classes.select("sha", F.col("f.rid").alias("first"), F.col("f.doc_id").alias("first_id")), "chain-classes")
    copies = table.select("rid", "doc_id", "sha", "n_words").join(classes, "sha").filter("rid <> first")
    copies = written(copies.select("rid", "doc_id", "first", "first_id", "n_words"), "chain-copies")
    unique = table.join(copies.select("rid"), "rid", "left_anti")
    held, matches, common = _linked(unique, min_words, min_identity)
    matches = matches.unionByName(written(_run_matches(unique, held, min_words), "chain-run-links"))
    found = written(_chained(matches, common, min_words, min_identity), "chains")
    lo = lambda c: F.greatest(F.lit(0), F.expr(f"CAST(({c}[0] - {MARGIN}) DIV {GRID} * {GRID} AS INT)"))
    hi = lambda c: F.expr(f"CAST((element_at({c}, -1) + {K + MARGIN + GRID}) DIV {GRID} * {GRID} AS INT)")
    found = found.select("rid", "other", "xs", "ys", lo("xs").alias("xl"), hi("xs").alias("xh"), lo("ys").alias("yl"), hi("ys").alias("yh"))
    wanted = found.select("rid", F.col("xl").alias("lo"), F.col("xh").alias("hi")).unionByName(
        found.select(F.col("other").alias("rid"), F.col("yl").alias("lo"), F.col("yh").alias("hi"))
    )
    slices = written(_slices(table, wanted), "chain-words")
    own = slices.select("rid", F.col("lo").alias("xl"), F.col("hi").alias("xh"), F.col("words").alias("a"))
    others = slices.select(F.col("rid").alias("other"), F.col("lo").alias("yl"), F.col("hi").alias("yh"), F.col("words").alias("b"))
    ready = found.join(own, ["rid", "xl", "xh"]).join(others, ["other", "yl", "yh"]).select("rid", "other", "xs", "ys", "xl", "yl", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "other", "start", "end", "other_start", "other_end", "equal"]
        for batch in batches:
            lists = {n: batch.column(batch.schema.get_field_index(n)) for n in ("xs", "ys", "a", "b")}
            flat = {n: (c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for n, c in lists.items()}
            plain = [batch.column(i).to_pylist() for i in (0, 1, 4, 5)]
            out = []
            for i, (rid, other, xl, yl) in enumerate(zip(*plain, strict=True)):
                xs, ys, a, b = (v[e[i] : e[i + 1]] for v, e in (flat[n] for n in ("xs", "ys", "a", "b")))
                for s, e, t, u, equal in passages_of(a, b, (xs - xl).tolist(), (ys - yl).tolist(), min_words, min_identity):
                    out.append((rid, other, s + xl, e + xl, t + yl, u + yl, equal))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    passages = ready.mapInArrow(run, "rid long, other long, start long, end long, other_start long, other_end long, equal long")
    # Several chains of a pair may end in one alignment or in a part of it.
    spot = F.struct("start", "end", "other_start", "other_end", "equal")
    inside = lambda p, q: (p["start"] >= q["start"]) & (p["end"] <= q["end"]) & (p["other_start"] >= q["other_start"]) & (p["other_end"] <= q["other_end"]) & (p != q)
    by_pair = passages.groupBy("rid", "other").agg(F.collect_set(spot).alias("all"))
    whole = F.filter("all", lambda p: ~F.exists("all", lambda q: inside(p, q)))
    passages = by_pair.select("rid", "other", F.explode(whole).alias("s")).select("rid", "other", "s.*")
    ids = table.select("rid", "doc_id")
    named = passages.join(ids, "rid").join(ids.select(F.col("rid").alias("other"), F.col("doc_id").alias("other_id")), "other")
    longest = F.greatest(F.col("end") - F.col("start"), F.col("other_end") - F.col("other_start"))
    named = named.select(
        "doc_id", F.lit("passage").alias("kind"), "other_id", "start", "end", "other_start", "other_end",
        longest.alias("words"), (F.col("equal") / longest).alias("identity"),
    )
    n = F.col("n_words").cast("long")
    zero = F.lit(0).cast("long")
    return named.unionByName(
        copies.select(
            "doc_id", F.lit("copy").alias("kind"), F.col("first_id").alias("other_id"), zero.alias("start"), n.alias("end"),
            zero.alias("other_start"), n.alias("other_end"), n.alias("words"), F.lit(1.0).alias("identity"),
        )
    )
