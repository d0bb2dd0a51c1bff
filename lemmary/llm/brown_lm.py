"""A class-based bigram language model over all words of a corpus.

Exchange clustering assigns words to classes so that class bigrams predict best.
The text's probability multiplies class transitions with emissions of words from
their classes; both are smoothed, and a word's count comes from the whole
training part, however rare it is.

    P(w | v) = (count(w) + 1) * (L * P(class w | class v) / (N_class + V_class + U_class) + (1 - L) / (N + V + U))

U_class is 1 if words that training did not see belong to the class, else 0, and
U is the sum: the probabilities of all known words and of one unknown word for
each such class add up to one.

The most frequent words and common endings are clustered first, word by word on
the driver, over their bigram counts. Every other word of the head (the most
frequent ``HEAD_WORDS``) then moves, in parallel, to the class that fits its own
neighbours' classes best. Words beyond the head, and unseen ones, belong to the
class of their ending. The factor count(w) + 1 stands apart: counts of the head
travel in a bounded table, those of all others by a join.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.llm.common import text_of, written

END = b""
#: Entries that a task holds before it gives them out.
TASK_WORDS = 300_000
HEAD_WORDS = 200_000
#: A longer word stands under a key of its digest and its ending.
WORD_BYTES = 64
FIRST_WORDS, TYPE_ENDINGS, ENDING = 1000, 400, 3
CLASSES = 64


def long_key(word: bytes) -> bytes:
    return b"\0" + hashlib.sha256(word).digest() + word[-ENDING:]


def words_of(text: str) -> list[bytes]:
    """A-Z lowered, split at ASCII white space; words of over WORD_BYTES bytes by their key."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if words and max(map(len, words)) > WORD_BYTES:
        return [w if len(w) <= WORD_BYTES else long_key(w) for w in words]
    return words


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n long): every word of the column ``t`` with its count, the end of a text as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def give() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for t in batch.column(0).to_pylist():
                found.update(words_of(t))
                found[END] += 1
                if len(found) > TASK_WORDS:
                    yield give()
        if found:
            yield give()

    return texts.select("t").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class TypeIndex(dict):
    """Number of any word: 0 for the end, then words of their own, endings, and one for all else."""

    def __init__(self, words: list[bytes], endings: list[bytes]) -> None:
        super().__init__()
        self.own = {END: 0} | {w: i + 1 for i, w in enumerate(words)}
        self.endings = {e: len(self.own) + i for i, e in enumerate(endings)}
        self.other = len(self.own) + len(endings)
        self.size = self.other + 1

    def __missing__(self, word: bytes) -> int:
        if len(self) > TASK_WORDS:
            self.clear()
        t = self.own.get(word)
        if t is None:
            t = self.endings.get(word[-ENDING:], self.other)
        self[word] = t
        return t

    def sequence(self, words: list[bytes]) -> np.ndarray:
        """Numbers of a text between two ends."""
        out = np.zeros(len(words) + 2, np.int64)
        out[1:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return out


def count_codes(texts: DataFrame, words: list[bytes], endings: list[bytes], codes, dense: int = 0) -> DataFrame:
    """(code long, n long): how often ``codes`` gives each code over all texts, from the numbers of a text's words.

    A task adds up in an array of ``dense`` cells, or sorts and gives out a bounded number of codes at a time.
    """
    shared = texts.sparkSession.sparkContext.broadcast((words, endings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TypeIndex(*shared.value)
        sums = np.zeros(dense, np.int64)
        held, size = [], 0

        def give(found: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(found), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[a : a + 200_000]), pa.array(n[a : a + 200_000])], ["code", "n"])

        def settle() -> Iterator[pa.RecordBatch]:
            if held and dense:
                sums[:] += np.bincount(np.concatenate(held), minlength=dense)
            elif held:
                yield from give(*np.unique(np.concatenate(held), return_counts=True))
            held.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(codes(index.sequence(words_of(t))))
                size += len(held[-1])
                if size > 4_000_000:
                    yield from settle()
                    size = 0
        yield from settle()
        yield from give(np.flatnonzero(sums), sums[sums > 0])

    return texts.select("t").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def count_pairs(texts: DataFrame, words: list[bytes], endings: list[bytes], label: np.ndarray | None = None) -> np.ndarray:
    """Counts of adjacent numbers, or of their labels, over all texts. A task gives out at most size^2 sums, and so does the result."""
    size = TypeIndex(words, endings).size if label is None else int(label.max()) + 1

    def codes(s: np.ndarray) -> np.ndarray:
        s = s if label is None else label[s]
        return s[:-1] * size + s[1:]

    table = count_codes(texts, words, endings, codes, size * size).toArrow()
    out = np.zeros(size * size, np.float64)
    out[table.column("code").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, max_rounds: int = 20) -> np.ndarray:
    """Class of each type: types move, most frequent first, to the class that raises the class bigram likelihood most, until none moves.

    The end (type 0) keeps class 0 to itself.
    """
    n = len(pairs)
    classes = max(2, min(classes, n))
    order = 1 + np.argsort(-(pairs.sum(0) + pairs.sum(1))[1:], kind="stable")
    label = np.zeros(n, np.int64)
    label[order] = 1 + np.arange(n - 1) % (classes - 1)
    one = np.zeros((n, classes))
    one[np.arange(n), label] = 1
    right, left = pairs @ one, pairs.T @ one  # counts with the class after and before each type
    m = one.T @ right
    for _ in range(max_rounds):
        moved = 0
        for t in order:
            a = label[t]
            self_n = pairs[t, t]
            r, l = right[t].copy(), left[t].copy()  # noqa: E741
            r[a] -= self_n
            l[a] -= self_n
            m[a] -= r
            m[:, a] -= l
            m[a, a] -= self_n
            row, col = m.sum(1) + l, m.sum(0) + r  # wherever the type goes, its neighbours have it beside them
            gain_r = _xlogx(m + r[None, :]) - _xlogx(m)
            gain_l = _xlogx(m + l[:, None]) - _xlogx(m)
            d = np.diag(m)
            gain = gain_r.sum(1) - np.diag(gain_r) + gain_l.sum(0) - np.diag(gain_l) + _xlogx(d + r + l + self_n) - _xlogx(d)
            rt, lt = r.sum() + self_n, l.sum() + self_n
            gain -= _xlogx(row + rt) - _xlogx(row) + _xlogx(col + lt) - _xlogx(col)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-6 * abs(gain[a]):
                b = a
            m[b] += r
            m[:, b] += l
            m[b, b] += self_n
            if b != a:
                moved += 1
                label[t] = b
                right[:, a] -= pairs[:, t]
                right[:, b] += pairs[:, t]
                left[:, a] -= pairs[t]
                left[:, b] += pairs[t]
        if not moved:
            break
    return label


def best_class(m: np.ndarray, own: int, before: np.ndarray, after: np.ndarray) -> int:
    """The class that a word of class ``own`` fits best, given counts of the classes before and after it and class bigrams ``m``.

    The gain of the class bigram likelihood as in ``exchange``, with all other words in their places.
    """
    m = m.copy()
    m[own] = np.maximum(m[own] - after, 0)
    m[:, own] = np.maximum(m[:, own] - before, 0)
    row, col, r, l = m.sum(1), m.sum(0), np.flatnonzero(after), np.flatnonzero(before)  # noqa: E741
    gain = (_xlogx(m[:, r] + after[r]) - _xlogx(m[:, r])).sum(1) + (_xlogx(m[l] + before[l, None]) - _xlogx(m[l])).sum(0)
    d = np.diag(m)  # both sides meet in a class's bigram with itself
    gain += _xlogx(d + after + before) - _xlogx(d + after) - _xlogx(d + before) + _xlogx(d)
    row, col = row + before, col + after  # wherever the word goes, its neighbours have it beside them
    gain -= _xlogx(row + after.sum()) - _xlogx(row) + _xlogx(col + before.sum()) - _xlogx(col)
    gain[0] = -np.inf  # the end keeps its class to itself
    best = int(np.argmax(gain))
    return best if gain[best] > gain[own] + 1e-9 * abs(gain[own]) else own


def move_words(texts: DataFrame, words: list[bytes], endings: list[bytes], label: np.ndarray, m: np.ndarray, first: int) -> np.ndarray:
    """Labels after each word from number ``first`` on has moved to its best class, all at once.

    Counts of (word, class before) and (word, class after) are added up over all
    texts and sorted by word; each word is settled from its own few rows.
    """
    size, most = len(m), len(words)

    def codes(s: np.ndarray) -> np.ndarray:
        c = label[s]
        here = np.flatnonzero((s >= first) & (s <= most))
        return np.concatenate([s[here] * (2 * size) + c[here - 1], s[here] * (2 * size) + size + c[here + 1]])

    counts = count_codes(texts, words, endings, codes).select(F.expr(f"code DIV {2 * size}").alias("word"), F.expr(f"CAST(code % {2 * size} AS INT)").alias("side"), "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def settle(word: np.ndarray, side: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            out = []
            for a, b in zip(cut, np.r_[cut[1:], len(word)], strict=True):
                sides = np.bincount(side[a:b], n[a:b], 2 * size)
                out.append(best_class(m, int(label[word[a]]), sides[:size], sides[size:]))
            return pa.RecordBatch.from_arrays([pa.array(word[cut]), pa.array(out, pa.int64())], ["word", "label"])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                end = int(np.searchsorted(rows[0], rows[0][-1]))  # the last word may go on
                if end:
                    yield settle(*(c[:end] for c in rows))
                held = [[c[end:] for c in rows]]
        if held:
            yield settle(*held[0])

    moved = counts.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word long, label long").toArrow()  # at most HEAD_WORDS rows
    out = label.copy()
    out[moved.column("word").to_numpy()] = moved.column("label").to_numpy()
    return out


@dataclass
class BrownModel:
    """What scoring needs; every part is bounded by the parameters, the counts of rarer words stay in ``vocabulary``."""

    words: list[bytes]
    endings: list[bytes]
    classes: np.ndarray  # of the end, the words, the endings and all else
    log_factor: np.ndarray  # log10 of the bracket above, [class before, class]
    log_count: np.ndarray  # log10(count + 1) of the end and the words
    tokens: int
    types: int
    vocabulary: DataFrame


def frequent(vocabulary: DataFrame, most: int) -> DataFrame:
    """The words above a count that at most ``most`` words reach.

    The count is read off a histogram of some thousand bins, so no task sorts or
    gathers the words of others, as a top-k of this size would.
    """
    level = F.floor(F.log2("n") * 64).cast("int")
    bins = vocabulary.groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()
    cut, total = None, 0
    for r in sorted(bins, key=lambda r: -r.b):
        total += r.k
        if total > most:
            break
        cut = r.b
    return vocabulary.filter(level >= cut) if cut is not None else vocabulary.limit(0)


def train(
    texts: DataFrame, classes: int = CLASSES, weight: float = 0.98, pull: float = 20.0, head_words: int = HEAD_WORDS, first_words: int = FIRST_WORDS
) -> BrownModel:
    """Learn from the column ``t`` of all rows. An empty table gives a model without words.

    ``head_words`` bounds the words that get a class of their own, and with it
    the table that travels; ``first_words`` of them are clustered on the driver.
    """
    spark = texts.sparkSession
    vocabulary = written(count_words(texts), "lm-words")
    total = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.octet_length("word") == 0, F.col("n"))).alias("e")).first()
    n, v = int(total.n or 0), int(total.v)
    seen = vocabulary.filter(F.octet_length("word") > 0)
    top = frequent(seen, head_words).toArrow()
    head = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True))
    words = sorted(head, key=lambda w: (-head[w], w))
    few = words[:first_words]
    ending = F.when(F.octet_length("word") <= ENDING, F.col("word")).otherwise(F.substring("word", -ENDING, ENDING))
    rest = seen
    if few:
        own = spark.createDataFrame([(bytearray(w),) for w in few], "word binary")
        rest = rest.join(F.broadcast(own), "word", "left_anti")  # bounded by first_words
    by_ending = rest.groupBy(ending.alias("e")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    some = by_ending.orderBy(F.col("n").desc(), "e").limit(TYPE_ENDINGS).collect()
    endings = [bytes(r.e) for r in some]
    pairs = count_pairs(texts, few, endings)
    own = exchange(pairs, classes)
    one = np.zeros((len(own), int(own.max()) + 1))
    one[np.arange(len(own)), own] = 1
    moves = one.T @ pairs @ one
    place = {e: 1 + len(few) + i for i, e in enumerate(endings)}
    more = [place.get(w[-ENDING:], len(own) - 1) for w in words[len(few) :]]
    label = np.concatenate([own[: 1 + len(few)], own[np.array(more, np.int64)], own[1 + len(few) :]])
    if more:
        label = move_words(texts, words, endings, label, moves, 1 + len(few))
        moves = count_pairs(texts, words, endings, label)
        moves = np.pad(moves, [(0, one.shape[1] - len(moves))] * 2)  # a class may have been left
    size = one.shape[1]
    # Words beyond the head, by ending: all words of an ending less those that the head has.
    tail = np.array([*[r.v for r in some], v - 1 - len(few) - sum(r.v for r in some) if v else 0], np.float64)
    np.subtract.at(tail, np.array(more, np.int64) - 1 - len(few), 1)
    class_n = moves.sum(0)
    class_v = np.bincount(label[: 1 + len(words)], minlength=size) + np.bincount(label[1 + len(words) :], tail, minlength=size)
    unseen = np.bincount(label[1 + len(words) :], minlength=size) > 0
    prior = (class_n + 1) / (class_n.sum() + size)
    step = (moves + pull * prior[None, :]) / (moves.sum(1, keepdims=True) + pull)
    inside = weight * step / np.maximum(class_n + class_v + unseen, 1)[None, :] + (1 - weight) / (n + v + unseen.sum())
    counts = np.array([int(total.e or 0), *[head[w] for w in words]], np.float64)
    return BrownModel(words, endings, label, np.log10(inside), np.log10(counts + 1), n, v, vocabulary)


def score(docs: DataFrame, model: BrownModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each input row; log10 probabilities of whole texts.

    Null and empty texts are a single end. Repeated rows, null ids and ids of any
    type give a row each; an empty table gives an empty result; other columns are
    ignored. With an empty training part every token has base probability 1.
    """
    read = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_column}`").alias("doc_id"), text_of(text_column).alias("t"))
    id_type = read.schema["doc_id"].dataType.simpleString()
    n, v, last = model.tokens, model.types, len(model.words)
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.endings, model.classes, model.log_factor, model.log_count))
    floor = float(np.log10(n + v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, endings, classes, factor, log_count = shared.value
        index = TypeIndex(words, endings)
        end_known = int(log_count[0] > 0)
        names = ["rid", "doc_id", "n_tokens", "head_known", "head_log", "moves", "tail"]
        for batch in batches:
            out = []
            for t in batch.column(2).to_pylist():
                own = words_of(t)
                s = index.sequence(own)
                rare = np.flatnonzero(s > last)
                c = classes[s]
                found = s[1:] if not len(rare) else s[1:][s[1:] <= last]
                out.append((len(own) + 1, len(found) - 1 + end_known, float(log_count[found].sum()), float(factor[c[:-1], c[1:]].sum()), [own[i - 1] for i in rare.tolist()]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, y) for c, y in zip(columns, types, strict=True)]], names)

    table = written(
        read.mapInArrow(run, f"rid long, doc_id {id_type}, n_tokens long, head_known long, head_log double, moves double, tail array<binary>"),
        "lm-scores",
    )
    rare = model.vocabulary.select("word", F.log10(F.col("n") + 1).alias("x"))
    tail = (
        table.select("rid", F.explode("tail").alias("word")).join(rare, "word")
        .groupBy("rid").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("k"))
    )
    logs = F.col("head_log") + F.coalesce("x", F.lit(0.0))
    return table.drop("tail").join(tail, "rid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * floor).alias("base_score"),
        ((logs + F.col("moves")) if n else (logs - F.col("n_tokens") * floor)).alias("score"),
    )
