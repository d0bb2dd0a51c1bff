"""SimHash near-duplicates through pivot distance tables.

Every fingerprint gets a table of Hamming distances to fixed reference
fingerprints (pivots). By the triangle inequality two fingerprints within
``bits`` of each other differ by at most ``bits`` in every coordinate, so a pair
whose largest coordinate difference is more is discarded unseen; survivors are
verified by their Hamming distance.

Fingerprints meet in buckets by parts of their bits: with at most ``bits``
differing, some choice of parts is equal in both, so no link is lost. Work is on
distinct fingerprints: copies are one row before anything is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.llm.chunks import lean
from lemmary.llm.common import components, fresh_name, numbered, text_of, written

PIVOTS = 24
SEED = 42
#: A bucket of more distinct fingerprints is linked through flipped bits instead, without loss.
BUCKET_LIMIT = 8_192
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def pivots(n: int = PIVOTS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words; of the whole sequence if it is shorter; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    a, b = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    return np.fromiter((h(joined[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a))


def fold_bits(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(((counts * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64 bits of each hash; the hash itself for 0."""
    if not k:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & ((1 << 64) - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, keep: list[str], text_column: str = "text", width: int = 3, words: int = 1) -> DataFrame:
    """The columns ``keep`` and ``fp``: ``words`` fingerprints of 64 bits of the whole text, as an array of longs."""
    read = docs.select(*[F.col(c) for c in keep], text_of(text_column).alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(len(keep)).to_pylist():
                h = shingle_hashes(t, width)
                out.append([_signed(fold_bits(mixed(h, k))) for k in range(words)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.list_(pa.int64()))], [*keep, "fp"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[: len(keep)])
    return read.mapInArrow(lean(run), f"{kept}, fp array<long>")


def _bucket_keys(bits: int, parts: int) -> list[int]:
    """Masks: of the parts of a 64-bit fingerprint, each choice of parts - bits."""
    edges = [64 * i // parts for i in range(parts + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(part, parts - bits)]


def _table(fp: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """(rows, pivots): the distance of each fingerprint of (rows, words) to each pivot."""
    table = np.bitwise_count(fp[:, :1] ^ pivot[None, :]).astype(np.int16)
    for k in range(1, fp.shape[1]):
        table += np.bitwise_count(fp[:, k : k + 1] ^ np.roll(pivot, k)[None, :]).astype(np.int16)
    return table


def _within(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs (i, j) are within the limit: the tables discard most, their survivors are compared."""
    at = np.arange(len(i))
    for p in range(table.shape[1]):
        if len(at):
            at = at[np.abs(table[i[at], p] - table[j[at], p]) <= limit]
    return at[np.bitwise_count(fp[i[at]] ^ fp[j[at]]).sum(axis=1, dtype=np.int64) <= limit]


def _walk(key: np.ndarray, fp: np.ndarray, limit: int, pivot: np.ndarray, own: np.ndarray, ids: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal keys meet, neighbours by the first pivot first. Returns a spanning forest of the links and the rows that have any.

    With ``ids`` the links of a key's row of the smallest id are tried first, so
    that keys of the same rows give the same links, and rows that are connected
    are not compared; ``own`` numbers the rows' groups. Without it no groups are
    joined: only which rows have a link to another group is found.
    """
    table = _table(fp, pivot)
    order = np.lexsort((table[:, 0], key))
    key, fp, table, label = key[order], fp[order], table[order], own[order]
    n, join = len(key), ids is not None
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, n]))
    marked = np.zeros(n, bool)
    a_out: list[np.ndarray] = []
    b_out: list[np.ndarray] = []

    def merge(a: np.ndarray, b: np.ndarray) -> None:
        while True:
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if not len(a):
                return
            # One merge for each root in a pass: the first pair that lowers it.
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            roots, first = np.unique(high, return_index=True)
            a_out.append(order[a[first]])
            b_out.append(order[b[first]])
            label[roots] = low[first]
            while not np.array_equal(up := label[label], label):
                label[:] = up

    if join and n:
        label = np.arange(n)
        by_id = np.lexsort((ids[order], key))
        center = by_id[begin][group]
        other = np.flatnonzero(center != np.arange(n))
        near = _within(fp, table, other, center[other], limit)
        merge(center[other[near]], other[near])
    i, shift, look = np.arange(n), 1, True
    while len(i):
        if look:  # a key whose rows are all connected, or all marked, needs no further look
            done = np.minimum.reduceat(label, begin) == np.maximum.reduceat(label, begin)
            if not join:
                done |= np.minimum.reduceat(marked, begin)
            i = i[~done[group[i]]]
        i = i[i + shift < n]
        j = i + shift
        alive = (key[j] == key[i]) & (table[j, 0] - table[i, 0] <= limit)  # sorted by the first pivot: no later row fits either
        i, j = i[alive], j[alive]
        open_ = np.flatnonzero((label[i] != label[j]) & ~(marked[i] & marked[j]))
        near = open_[_within(fp, table, i[open_], j[open_], limit)]
        look = len(near) > 0
        if look and join:
            merge(i[near], j[near])
        elif look:
            marked[i[near]] = marked[j[near]] = True
        shift += 1
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(a_out), cat(b_out), order[marked]


def by_key(rows: DataFrame, solve, schema: str) -> DataFrame:
    """``solve`` of the rows of whole keys (column 0, a long), a bounded number of keys at a time, in tasks dealt by the key."""
    dealt = rows.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column(0)[batch.num_rows - 1].as_py()
            held.append(batch)
            if held[0].column(0)[0].as_py() == last:
                continue  # one key so far
            cut = int(np.searchsorted(batch.column(0).to_numpy(), last))  # the last key may go on
            if cut or len(held) > 1:
                yield solve(pa.concat_batches([*held[:-1], batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield solve(pa.concat_batches(held))

    return dealt.mapInArrow(lean(run), schema)


def _plain(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False)


def _prints(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)


def bucket_links(keyed: DataFrame, limit: int) -> DataFrame:
    """(a, b): links within ``limit`` bits among rows (key long, id long, fp array<long>) of one key.

    Only links that join two groups are given out, so a dense bucket yields one
    row less than it has members.
    """
    pivot = pivots()

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _plain(batch, 1)
        a, b, _ = _walk(_plain(batch, 0), _prints(batch), limit, pivot, np.arange(len(ids)), ids)
        return pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], ["a", "b"])

    return by_key(keyed, solve, "a long, b long")


def bucket_rows(grouped: DataFrame, limit: int) -> DataFrame:
    """The rows (key, id, own) of (key, id, fp, own) that are within ``limit`` bits of a row of their key in another group ``own``."""
    pivot = pivots()

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, own = _plain(batch, 0), _plain(batch, 3)
        _, _, at = _walk(key, _prints(batch), limit, pivot, np.unique(own, return_inverse=True)[1], None)
        return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(_plain(batch, 1)[at]), pa.array(own[at])], ["key", "id", "own"])

    return by_key(grouped, solve, "key long, id long, own long")


def _alike(own: np.ndarray, flat: np.ndarray, ends: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links that join groups ``own`` among sets flat[ends[i]:ends[i + 1]] of Jaccard similarity or more: for each row, its overlaps with all others are counted at once."""
    n, size = len(own), np.diff(ends)
    place = np.unique(flat, return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    holder = np.repeat(np.arange(n), size)[order]
    begin = np.searchsorted(place[order], np.arange(place.max() + 2))
    label = np.unique(own, return_inverse=True)[1]
    groups, a, b = int(label.max()) + 1, [], []
    for i in range(n):
        if groups < 2:
            break
        mine = place[ends[i] : ends[i + 1]]
        many = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(holder[at], minlength=n)
        near = np.flatnonzero((label != label[i]) & (both >= similarity * (size + size[i] - both) - 1e-9))
        found, first = np.unique(label[near], return_index=True)
        a += [i] * len(found)
        b += near[first].tolist()
        label[np.isin(label, found)] = label[i]
        groups -= len(found)
    return a, b


def bucket_verified(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join the groups of rows (key, id, own, s array<int>) of one key, by the similarity of their sets."""

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, ids, own = (_plain(batch, i) for i in range(3))
        sets = batch.column(3)
        flat, ends = sets.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sets.value_lengths().to_numpy())]
        cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        a_out, b_out = [], []
        for x, y in zip(cuts, cuts[1:], strict=False):
            a, b = _alike(own[x:y], flat[ends[x] : ends[y]], ends[x : y + 1] - ends[x], similarity)
            a_out.append(ids[x:y][a])
            b_out.append(ids[x:y][b])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (a_out, b_out)], ["a", "b"])

    return by_key(rows, solve, "a long, b long")


def parted(keyed: DataFrame, most: int = BUCKET_LIMIT) -> DataFrame:
    """The rows (key, id, .., n) under keys of at most ``most`` rows, n being a key's rows.

    The rows of a larger key are dealt to blocks of half that size and meet in a
    key for each two blocks: every pair still meets, in a task of bounded size.
    """
    blocks = F.when(F.col("n") <= most, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / most)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("blocks"))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), (F.col("blocks") - 1).cast("long")), lambda j: F.xxhash64("key", F.least("own", j), F.greatest("own", j)))
    dealt = keyed.withColumn("blocks", blocks).withColumn("own", own).withColumn("meet", F.when(F.col("blocks") == 1, F.array("key")).otherwise(meet))
    return dealt.select(F.explode("meet").alias("key"), *[c for c in keyed.columns if c not in ("key", "n")])


def links(distinct: DataFrame, bits: int = 2, parts: int = 4, most: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b): enough links among distinct 64-bit fingerprints (column fp long) to connect all that lie within ``bits``.

    Rows with a bucket of over ``most`` members also meet by flipped bits: two
    fingerprints within 2 bits share a value one flip from each, and all that
    share one are within 2 bits of each other, so a link to the smallest is
    enough. That path is exact for ``bits`` = 2 and linear in the bucket.
    """
    masks = _bucket_keys(bits, parts)
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)]))
    keyed = written(
        distinct.select("fp", key.alias("k")).select(F.xxhash64("k.m", "k.v").alias("key"), F.col("fp").alias("id")), "simhash-keys"
    )
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = written(counts.filter(F.col("n") > most).select("key"), "simhash-hot")
    some = hot.limit(1).count() > 0
    if some and bits != 2:
        raise ValueError("buckets beyond the limit are exact for two bits only")
    few = keyed.join(hot, "key", "left_anti") if some else keyed  # no task holds a hot key's rows
    found = bucket_links(few.select("key", "id", F.array("id").alias("fp")), bits)
    if not some:
        return found
    dense = keyed.join(hot, "key", "left_semi").select("id").distinct()
    flips = F.expr("explode(concat(array(id), transform(sequence(0, 63), i -> id ^ shiftleft(1L, i))))")
    near = dense.select("id", flips.alias("v"))
    low = near.groupBy("v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.unionByName(near.join(low, "v").filter("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct())


def simhash_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, bits: int = 2, most: int = BUCKET_LIMIT
) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each input row.

    Words are split at ASCII white space with A-Z lowered; texts without words
    (null, empty) have fingerprint zero and link like any other. component_id is
    the smallest id reachable over links; null ids are skipped, and a component
    of null ids alone has a null component_id. Repeated rows give a row each; an
    empty table gives an empty result; other columns are ignored.
    """
    read = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    table = written(fingerprints(read, ["doc_id"], "text", width).select("doc_id", F.get("fp", F.lit(0)).alias("fp")), "simhash")
    distinct = written(table.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    label = components(links(distinct, bits, most=most))
    named = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("label", "fp").alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    by_fp = named.join(smallest, "label").select("fp", "component_id")
    return table.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Bands of minimum hashes and hashes in a band: sets at 0.8 share a band with probability 1 - (1 - 0.8^4)^16 = 0.9998.
BANDS, DEPTH = 16, 4
#: Words of a fingerprint, and the most of its 256 bits that may differ: five deviations above the mean at 0.8 for the
#: smallest sets (4 of 5 shingles, where a bit differs with probability 3/16).
PRINT_WORDS, PRINT_LIMIT = 4, 80
_FACTORS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: DEPTH minima of the hashes under random odd factors. The same plan for any number of rows."""
    with np.errstate(over="ignore"):
        low = np.array([(hashes * f).min() for f in _FACTORS]).reshape(BANDS, DEPTH)
    return np.array([xxhash.xxh64_intdigest(low[k].tobytes(), k) for k in range(BANDS)], np.uint64)


def sketches(read: DataFrame, width: int) -> DataFrame:
    """(rid, doc_id, same, fp, keys) of rows (rid, doc_id, text): digest, fingerprint and band keys of the shingle set; null without words."""
    id_type = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, fp, keys = [], [], []
            for t in batch.column(2).to_pylist():
                h = np.unique(shingle_hashes(t, width))
                some = len(h) > 0
                same.append(xxhash.xxh3_128_digest(h.tobytes()) if some else None)
                fp.append([_signed(fold_bits(mixed(h, k))) for k in range(PRINT_WORDS)] if some else None)
                keys.append(band_keys(h).view(np.int64) if some else None)
            longs = pa.list_(pa.int64())
            arrays = [pa.array(same, pa.binary()), pa.array(fp, longs), pa.array(keys, longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["rid", "doc_id", "same", "fp", "keys"])

    return read.mapInArrow(lean(run), f"rid long, doc_id {id_type}, same binary, fp array<long>, keys array<long>")


def sets_of(read: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, s): the set of shingles, as 32 bits of each hash, of the rows (rid, text) whose number is among ``ids``."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width).astype(np.uint32)).view(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], ["id", "s"])

    wanted = ids.select(F.col("id").alias("rid")).distinct()
    return written(read.join(wanted, "rid", "left_semi").select("rid", "text").mapInArrow(lean(shingle), "id long, s array<int>"), "simhash-sets")


def verified(pairs: DataFrame, read: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows (rid, text) whose sets of shingles have a Jaccard similarity of ``similarity`` or more."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pairs")
    sets = sets_of(read, pairs.select(F.explode(F.array("a", "b")).alias("id")), width)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xe), (y, ye) = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in batch.columns[2:])
            keep = []
            for i in range(batch.num_rows):
                p, q = x[xe[i] : xe[i + 1]], y[ye[i] : ye[i + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = sets.select(F.col("id").alias("a"), F.col("s").alias("x")), sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    return written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(judge), "a long, b long"), "simhash-links")


def near_duplicate_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, similarity: float = 0.8, rid: str | None = None
) -> DataFrame:
    """(rid, doc_id, group): rows whose shingles are similar share a group, the smallest row number in it.

    Texts meet if a band of minimum hashes is equal and are candidates if they
    pass the pivot tables and the limit on differing bits of their fingerprints;
    both are fixed, whatever the number of rows. A link needs an exact Jaccard
    similarity of ``similarity`` between the sets of shingles: first for a
    spanning forest of each band's candidates, then for every candidate pair
    whose groups are still apart. Equal sets are one row before that. Texts
    without words form no link. ``rid`` names a column of a stored table that
    numbers its rows; without it the rows are numbered and stored here.
    """
    if rid is None:
        docs, rid = numbered(docs)
    read = docs.select(F.col(f"`{rid}`").alias("rid"), F.col(f"`{id_column}`").alias("doc_id"), text_of(text_column).alias("text"))
    table = written(sketches(read, width), "simhash")
    first = F.min(F.struct("rid", "fp", "keys")).alias("f")
    distinct = written(table.filter("same IS NOT NULL").groupBy("same").agg(first).select("same", F.col("f.rid").alias("low"), "f.fp", "f.keys"), "simhash-distinct")
    bands = distinct.select(F.explode("keys").alias("key"), F.col("low").alias("id"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bands = written(bands.join(shared, "key"), "simhash-bands")  # keys of one row alone go before fingerprints travel
    keyed = written(parted(bands.join(distinct.select(F.col("low").alias("id"), "fp"), "id")).select("key", "id", "fp"), "simhash-keyed")
    links = verified(bucket_links(keyed, PRINT_LIMIT), read, width, similarity)
    label = written(components(links).select(F.col("node").alias("id"), "label"), "simhash-groups")
    grouped = keyed.join(label, "id", "left").select("key", "id", "fp", F.coalesce("label", "id").alias("own"))
    apart = written(bucket_rows(grouped, PRINT_LIMIT), "simhash-apart")
    more = bucket_verified(apart.join(sets_of(read, apart, width), "id").select("key", "id", "own", "s"), similarity)
    label = components(links.unionByName(more))
    named = distinct.join(label.withColumnRenamed("node", "low"), "low", "left").select("same", F.coalesce("label", "low").alias("group"))
    return table.join(named, "same", "left").select("rid", "doc_id", F.coalesce("group", "rid").alias("group"))


def keep_one_of_near(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The input rows with one row of each near-duplicate group, the first read; all columns stay."""
    rows, rid = numbered(docs)
    gone = fresh_name(rows, "gone")
    dropped = near_duplicate_groups(rows, id_column, text_column, rid=rid, **how).filter("rid <> group").select(F.col("rid").alias(gone))
    return rows.join(dropped, F.col(rid) == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
