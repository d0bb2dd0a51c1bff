"""A convolutional text classifier in numpy.

A word and its prefixes are hashed into two embedding tables whose rows are
added; filters of several widths slide over the words, the largest response of each filter over
the whole text is kept, and a logistic layer scores it. Training takes all
labelled rows, in blocks on the executors whose weights are averaged; scoring is
a narrow map over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from lemmary.llm.chunks import lean, rounds
from lemmary.llm.common import fold_of, text_of, written

WORD = re.compile(r"\w+")
TABLE_BITS = 15
KNOWN_BITS = 22
WIDTHS = (1, 2, 3)
CACHE = 200_000
#: Rows whose texts are Python strings at a time while they are scored.
SLICE = 1_000
#: Labelled rows that are trained on in one go, and tasks that train at once: each sends its weights to the driver.
BLOCK, TASKS = 8192, 16
#: Passes over all rows; with more than one block, weights are averaged after every LOCAL of them.
EPOCHS, LOCAL = 12, 3
#: Weights are added up as whole numbers of this, so the sum does not depend on the order of blocks.
UNIT = 2.0**-40


#: Lengths of the prefixes that a word's embedding also sums, so inflected forms share what their stem learned.
PREFIXES = (3, 4, 5, 6)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its prefixes; 0 where the word is not longer than the prefix."""
    if not word:
        return [0] * (1 + len(PREFIXES))
    return [word_hash(word), *[word_hash("^" + word[:n]) if len(word) > n else 0 for n in PREFIXES]]


def features_of(words: list[str]) -> np.ndarray:
    return np.array([word_features(w) for w in words], np.uint64).reshape(len(words), 1 + len(PREFIXES))


@dataclass
class ToxicityModel:
    """Weights; ``known`` marks hashed words that training saw often enough, others embed to zero."""

    tables: np.ndarray  # (2, 2^TABLE_BITS, dim)
    known: np.ndarray  # packed bits
    filters: list[np.ndarray]  # for each width k: (k, dim, filters)
    bias: np.ndarray  # (widths, filters)
    out: np.ndarray  # (widths * filters,)
    out_bias: float
    thresholds: dict = field(default_factory=dict)
    threshold: float = 0.5

    def embed(self, hashes: np.ndarray) -> np.ndarray:
        """Embeddings of words given as rows of feature hashes."""
        mask = np.uint64((1 << TABLE_BITS) - 1)
        out = np.zeros((len(hashes), self.tables.shape[2]), np.float32)
        for own in hashes.T:
            some = np.flatnonzero(self.is_known(own))
            a, b = own[some] & mask, (own[some] >> np.uint64(TABLE_BITS)) & mask
            out[some] += self.tables[0][a] + self.tables[1][b]
        return out

    def is_known(self, hashes: np.ndarray) -> np.ndarray:
        k = (hashes >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)
        return (self.known[k >> 3] >> (k & 7).astype(np.uint8)) & 1

    def taps(self, embedded: np.ndarray) -> list[list[np.ndarray]]:
        """For each width and offset the response of each word to the filters."""
        return [[(embedded @ w[j]).astype(np.float32) for j in range(len(w))] for w in self.filters]


def _responses(taps: list[list[np.ndarray]], ids: np.ndarray, starts: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(documents, widths * filters): the largest response in each document; ids end each document with padding (id 0)."""
    padding = np.flatnonzero(ids == 0)
    out = []
    for k, own in enumerate(taps):
        r = own[0][ids].copy()
        for j in range(1, len(own)):
            r[:-j] += own[j][ids[j:]]
        r[padding] = 0  # a window that begins there would reach into the next document
        out.append(np.maximum.reduceat(r, starts, axis=0) + bias[k])
    return np.concatenate(out, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


PAD = max(WIDTHS) - 1


def gradient(model: ToxicityModel, flat: np.ndarray, starts: np.ndarray, y: np.ndarray, hashes: np.ndarray) -> tuple[float, list[np.ndarray], float]:
    """(logistic loss, its derivatives by tables, filters, bias and output, by the output's bias) over documents of word numbers laid end to end.

    ``hashes`` are the features of each word number; each document ends with padding (number 0).
    """
    mask, filters = np.uint64((1 << TABLE_BITS) - 1), model.bias.shape[1]
    words, ids = np.unique(flat, return_inverse=True)
    e, own = model.embed(hashes[words]), hashes[words]
    ends = np.r_[starts[1:], len(flat)]
    grads = [np.zeros_like(p) for p in (model.tables, *model.filters, model.bias, model.out)]
    grad_e = np.zeros_like(e)
    hidden, best = [], []
    for k, own_taps in enumerate(model.taps(e)):
        r = own_taps[0][ids].copy()
        for j in range(1, len(own_taps)):
            r[:-j] += own_taps[j][ids[j:]]
        r[flat == 0] = 0
        arg = np.stack([a + r[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
        best.append(arg)
        hidden.append(np.take_along_axis(r, arg, 0) + model.bias[k])
    z = np.concatenate(hidden, axis=1)
    h = np.maximum(z, 0)
    p = _sigmoid(h @ model.out + model.out_bias)
    loss = -float(np.mean(np.where(y > 0, np.log(p + 1e-30), np.log(1 - p + 1e-30))))
    d = ((p - y) / len(y)).astype(model.out.dtype)
    grads[-1] += h.T @ d
    dz = (d[:, None] * model.out[None, :]) * (z > 0)
    for k, width in enumerate(WIDTHS):
        dk = dz[:, k * filters : (k + 1) * filters]
        grads[1 + len(WIDTHS)][k] += dk.sum(axis=0)
        dk = dk * (flat[best[k]] != 0)
        for j in range(width):
            w = ids[np.minimum(best[k] + j, len(flat) - 1)]  # (documents, filters)
            grads[1 + k][j] += np.einsum("nfd,nf->df", e[w], dk)
            np.add.at(grad_e, w, dk[:, :, None] * model.filters[k][j].T[None, :, :])
    for feature in own.T:
        some = np.flatnonzero(model.is_known(feature))
        for t, shift in ((0, 0), (1, TABLE_BITS)):
            np.add.at(grads[0][t], (feature[some] >> np.uint64(shift)) & mask, grad_e[some])
    return loss, grads, float(d.sum())


def new_model(share: float, dim: int = 8, filters: int = 8, seed: int = 13) -> ToxicityModel:
    """Random weights, no known words; without both labels the score is ``share``, that of label 1."""
    rng = np.random.default_rng(seed)
    n_out = len(WIDTHS) * filters
    tables = rng.normal(0, 0.1, (2, 1 << TABLE_BITS, dim)).astype(np.float32)
    weights = [rng.normal(0, 0.5, (k, dim, filters)).astype(np.float32) for k in WIDTHS]
    bias = np.zeros((len(WIDTHS), filters), np.float32)
    out = rng.normal(0, 0.3, n_out).astype(np.float32)
    model = ToxicityModel(tables, np.zeros(1 << (KNOWN_BITS - 3), np.uint8), weights, bias, out, 0.0)
    if share in (0.0, 1.0):
        model.out[:] = 0
        model.out_bias = -40.0 if share == 0 else 40.0
    else:
        model.out_bias = float(np.log(share / (1 - share)))
    return model


def numbered_words(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """(word numbers of each text, features of each number); 0 is padding."""
    index: dict[str, int] = {"": 0}
    docs = [np.array([index.setdefault(w, len(index)) for w in WORD.findall(t.lower())], np.int64) for t in texts]
    return docs, features_of(list(index))


def documents_of_features(docs: list[np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, number of documents that hold it)."""
    unique, place = np.unique(hashes, return_inverse=True)
    place = place.reshape(hashes.shape)
    seen = np.zeros(len(unique), np.int64)
    for d in docs:
        seen[np.unique(place[np.unique(d)])] += 1
    return unique[unique != 0], seen[unique != 0]


def mark_known(model: ToxicityModel, places: np.ndarray) -> None:
    """Mark the upper KNOWN_BITS bits of features as seen often enough."""
    np.bitwise_or.at(model.known, places >> 3, (1 << (places & 7)).astype(np.uint8))
    model.known[0] &= 0xFE  # padding and absent prefixes are never known


def train(
    model: ToxicityModel, docs: list[np.ndarray], hashes: np.ndarray, y: np.ndarray, epochs: int, seed: int, batch: int = 64, rate: float = 0.02, decay: float = 1e-4
) -> None:
    """Passes of Adam on the logistic loss from the model's weights on; gradients reach the words at each filter's largest response."""
    rng = np.random.default_rng(seed)
    params = [model.tables, *model.filters, model.bias, model.out]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step, pad = 0, np.zeros(PAD, np.int64)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            flat = np.concatenate([np.r_[docs[i], pad] for i in own])
            starts = np.cumsum([0, *[len(docs[i]) + PAD for i in own[:-1]]])
            loss, grads, d_bias = gradient(model, flat, starts, y[own], hashes)
            model.out_bias -= rate * d_bias
            step += 1
            for p_, g, m, v in zip(params, grads, first, second, strict=True):
                if p_ is not model.tables:
                    g += decay * p_
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)


def train_model(texts: list[str], labels: list[int], dim: int = 8, filters: int = 8, epochs: int = EPOCHS, min_docs: int = 3, seed: int = 13) -> ToxicityModel:
    """Fit to texts at hand. Without both labels the score is the share of label 1 (0 without rows)."""
    share = sum(labels) / len(labels) if labels else 0.0
    model = new_model(share, dim, filters, seed)
    if share not in (0.0, 1.0):
        docs, hashes = numbered_words(texts)
        found, seen = documents_of_features(docs, hashes)
        mark_known(model, (found[seen >= min_docs] >> np.uint64(64 - KNOWN_BITS)).astype(np.int64))
        train(model, docs, hashes, np.array(labels, np.float32), epochs, seed)
    return model


def _blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """One row for each block of labelled rows (id, t, y): word numbers, sizes, features and labels as bytes."""

    def run(table: pa.Table) -> pa.Table:
        at = sorted((word_hash(str(i)), str(i), t, y) for i, t, y in zip(*[table.column(c).to_pylist() for c in ("id", "t", "y")], strict=True))
        docs, hashes = numbered_words([r[2] for r in at])
        parts = [np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs], np.int32), hashes, np.array([r[3] for r in at], np.float32)]
        return pa.table({"block": table.column("block")[:1], **{n: pa.array([p.tobytes()], pa.binary()) for n, p in zip(("words", "sizes", "hashes", "y"), parts, strict=True)}})

    dealt = rows.select("id", "t", "y", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(blocks)).alias("block"))
    return written(dealt.groupBy("block").applyInArrow(run, "block long, words binary, sizes binary, hashes binary, y binary"), "toxic-blocks")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            block, words, sizes, hashes, y = (c[i].as_py() for c in batch.columns)
            docs = np.split(np.frombuffer(words, np.int32).astype(np.int64), np.cumsum(np.frombuffer(sizes, np.int32))[:-1])
            yield block, docs, np.frombuffer(hashes, np.uint64).reshape(-1, 1 + len(PREFIXES)), np.frombuffer(y, np.float32)


def train_blocks(rows: DataFrame, n: int, share: float, min_docs: int = 3, seed: int = 13) -> ToxicityModel:
    """Fit to all ``n`` rows (id, t, y), of which a share has label 1.

    Each block trains from the common weights; after LOCAL passes the mean of
    the blocks' changes is added to them, for a table's row the mean over the
    blocks that changed it. One block is trained in one go. What reaches the
    driver is bounded by the weights, TASKS of them, and the bits of known words.
    """
    model = new_model(share, seed=seed)
    if share in (0.0, 1.0):
        return model
    n_blocks = -(-n // BLOCK)
    blocks = _blocks(rows, n_blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs, hashes, _ in _opened(batches):
            found, seen = documents_of_features(docs, hashes)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(seen)], ["h", "n"])

    often = blocks.mapInArrow(lean(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)
    places = often.select(F.shiftrightunsigned("h", 64 - KNOWN_BITS).cast("int").alias("at")).distinct().toArrow()
    mark_known(model, places.column("at").to_numpy().astype(np.int64))
    epochs = EPOCHS if n_blocks == 1 else LOCAL
    for turn in range(EPOCHS // epochs):
        sums = blocks.coalesce(TASKS).mapInArrow(lean(lambda batches, m=model, e=epochs, r=turn: _changes(m, batches, e, seed + 1000 * r)), "changes binary, touched binary, n long").toArrow()
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in sums.column("changes"))
        touched = sum(np.frombuffer(x.as_py(), np.int64) for x in sums.column("touched"))
        done = sum(sums.column("n").to_pylist())
        params = [model.tables, *model.filters, model.bias, model.out]
        parts = np.split(total[:-1] * UNIT, np.cumsum([p.size for p in params])[:-1])
        for p, part in zip(params, parts, strict=True):
            by = np.maximum(touched, 1).reshape(2, -1, 1) if p is model.tables else done
            p += (part.reshape(p.shape) / by).astype(np.float32)
        model.out_bias += float(total[-1] * UNIT / done)
    return model


def _changes(model: ToxicityModel, batches: Iterator[pa.RecordBatch], epochs: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Sum of the changes of all weights by the blocks of a task, blocks that changed each row of the tables, number of blocks."""
    total, touched, n = 0, np.zeros((2, 1 << TABLE_BITS), np.int64), 0
    flat = lambda m: np.concatenate([*[p.ravel().astype(np.float64) for p in (m.tables, *m.filters, m.bias, m.out)], [m.out_bias]])
    for block, docs, hashes, y in _opened(batches):
        own = ToxicityModel(model.tables.copy(), model.known, [f.copy() for f in model.filters], model.bias.copy(), model.out.copy(), model.out_bias)
        train(own, docs, hashes, y, epochs, seed + block)
        total = total + np.rint((flat(own) - flat(model)) / UNIT).astype(np.int64)
        touched += (own.tables != model.tables).any(axis=2)
        n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([touched.ravel().tobytes()], pa.binary()), pa.array([n])], ["changes", "touched", "n"])


class Scorer:
    """Scores batches of texts; responses of words are kept in a bounded cache."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.table = [[t for t in own] for own in self.model.taps(np.zeros((1, self.model.tables.shape[2]), np.float32))]

    def score(self, texts: list[str]) -> np.ndarray:
        words = [WORD.findall(t.lower()) for t in texts]
        new = list(dict.fromkeys(w for own in words for w in set(own) if w not in self.index))
        if len(self.index) + len(new) > CACHE:
            self.clear()
            new = list(dict.fromkeys(w for own in words for w in set(own)))
        if new:
            for w in new:
                self.index[w] = len(self.index)
            more = self.model.taps(self.model.embed(features_of(new)))
            self.table = [[np.concatenate([a, b]) for a, b in zip(x, y, strict=True)] for x, y in zip(self.table, more, strict=True)]
        get = self.index.__getitem__
        flat = np.zeros(sum(map(len, words)) + PAD * len(words), np.int64)
        at, starts = 0, []
        for own in words:
            starts.append(at)
            flat[at : at + len(own)] = np.fromiter(map(get, own), np.int64, len(own))
            at += len(own) + PAD
        z = _responses(self.table, flat, np.array(starts), self.model.bias)
        return _sigmoid(np.maximum(z, 0).astype(np.float64) @ self.model.out + self.model.out_bias)


def calibrate(model: ToxicityModel, scores: np.ndarray, labels: np.ndarray, langs: list, least: int = 20) -> None:
    """Thresholds by language: the cut with the best F1 on calibration rows, the widest gap on ties; 0.5 for few positives."""
    def cut(s: np.ndarray, y: np.ndarray) -> float:
        if y.sum() < least or y.sum() == len(y):
            return 0.5
        order = np.argsort(-s, kind="stable")
        s, y = s[order], y[order]
        hit = np.cumsum(y)
        f1 = 2 * hit / (np.arange(len(y)) + 1 + y.sum())
        last = np.r_[s[1:] < s[:-1], True]  # a cut falls between different scores only
        f1 = np.where(last, f1, -1)
        top = np.flatnonzero(f1 >= f1.max() - 1e-12)
        below = np.r_[s[1:], 0.0]
        i = top[np.argmax(s[top] - below[top])]
        return float((s[i] + below[i]) / 2)

    model.threshold = cut(scores, labels)
    groups = np.array([x if x is not None else "" for x in langs])
    for lang in sorted(set(groups.tolist())):
        own = groups == lang
        model.thresholds[lang] = cut(scores[own], labels[own]) if labels[own].sum() >= least else model.threshold


def fit(
    docs: DataFrame, labels: DataFrame, folds: int = 5, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
) -> ToxicityModel:
    """Train on all labelled rows outside fold 0, whole texts of any length.

    A quarter of them by a hash of the id calibrates the thresholds instead, all
    of its scores. Rows with a null label or id are skipped; of repeated labels
    of one id the largest counts, of repeated rows of one id the smallest text.
    Ids are of any type; the result does not depend on partitions. Without
    documents, or without labels for them, every score is 0. Scores, labels and
    languages of the calibration rows are gathered on the driver, a few bytes each.
    """
    marks = (
        labels.filter("toxic IS NOT NULL").select(F.col(f"`{id_column}`").alias("id"), (F.col("toxic").cast("int") > 0).cast("int").alias("y")).filter("id IS NOT NULL")
        .groupBy("id").agg(F.max("y").alias("y"))
        .filter(fold_of("id", folds) != 0)
    )
    lang = F.col(f"`{lang_column}`").cast("string") if lang_column in docs.columns else F.lit(None).cast("string")
    rows = (
        docs.select(F.col(f"`{id_column}`").alias("id"), text_of(text_column).alias("t"), lang.alias("lang")).join(marks, "id")
        .groupBy("id").agg(F.min(F.struct("t", "lang", "y")).alias("r")).select("id", "r.*", (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)) == 0).alias("held"))
    )
    rows = written(rows, "toxic-rows")
    sizes = {r.held: (r.n, r.y) for r in rows.groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()}
    if not sizes:
        return train_model([], [])
    fitted = min(sizes)  # all of a few rows may be in the quarter
    n, y = sizes[fitted]
    model = train_blocks(rows.filter(F.col("held") == fitted), n, y / n)
    if True in sizes and not fitted:
        scored = score_documents(rows.filter("held").select("t", "lang", "y"), model, "t", "lang", "score", "flag").select("score", "y", "lang").toArrow()
        calibrate(model, scored.column("score").to_numpy(), scored.column("y").to_numpy(), scored.column("lang").to_pylist())
    return model


def score_documents(
    docs: DataFrame, model: ToxicityModel, text_column: str = "text", lang_column: str = "lang", score: str = "toxicity", flag: str = "toxic_by_lang"
) -> DataFrame:
    """The input's columns with ``score`` (0 to 1, from the text alone) and ``flag`` (score against the language's threshold).

    Null and empty texts have the score of a text without words. Rows keep their
    number and ids of any type; an empty table gives an empty result. A column of
    the input named like ``score`` or ``flag`` is replaced. A narrow map.
    """
    keep = [c for c in docs.columns if c.lower() not in (score.lower(), flag.lower())]
    lang = F.coalesce(F.col(f"`{lang_column}`").cast("string"), F.lit("")) if lang_column in keep else F.lit("")
    own = [F.col(f"`{c}`") for c in keep]
    inside = text_column in keep and docs.schema[text_column].dataType == StringType()  # then the text travels once, in its row
    place = keep.index(text_column) if inside else -1
    text = F.lit(None).cast("string") if inside else text_of(text_column)
    read = docs.select(F.struct(*own).alias("row") if own else F.struct(F.lit(0)).alias("row"), text.alias("text"), lang.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            column, scores = batch.column(0).field(place) if inside else batch.column(1), []
            for at in range(0, batch.num_rows, SLICE):
                texts = [t or "" for t in column.slice(at, SLICE).to_pylist()]
                scores += [scorer.score(texts[part]) for part in rounds(texts, 1_000_000)]
            s = np.concatenate(scores) if scores else np.zeros(0)
            cut = [model.thresholds.get(x, model.threshold) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array(s >= np.array(cut, float), pa.bool_())], names=["row", "score", "flag"]
            )

    scored = read.mapInArrow(lean(run), StructType([read.schema["row"]]).add("score", DoubleType()).add("flag", BooleanType()))
    return scored.select(*[F.col("row")[c].alias(c) for c in keep], F.col("score").alias(score), F.col("flag").alias(flag))
