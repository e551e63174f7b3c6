"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (of UTF-8 bytes, with word ends
marked) and of itself, each hashed to a row of an embedding table; a word's
vector is the mean over its bag, a text's the mean over its words, and a linear
softmax on it tells the two labels apart. Embeddings and softmax are trained
jointly in numpy, full batch, with Adam. A misspelling never seen in training
shares most of its n-grams, and so its place, with the word it hides.

As everything after the embeddings is linear, scoring needs one number per
embedding row; the executors get that vector.

Learning takes rows of ``labels`` that ``held_out`` leaves in, chosen by a hash
of doc_id: at most about ``COUNT_DOCS`` of each label, whole texts, equal texts
once. In how many of them each embedding row occurs is counted on the
executors; rows in fewer than ``MIN_DOCS``, or whose share differs between the
labels by less than ``MIN_ERRORS`` standard errors, stay zero, as a few thousand
texts would teach them noise, and so do all but the ``MOST_ROWS`` that differ most. At most about ``FIT_DOCS`` toxic texts and twice
as many others are trained on. A text's mean is a weighted sum of embedding
rows, so executors reduce texts to those weights and the driver, which trains,
gets no text, however long.

Defined cases: a null, empty or blank text scores the share of toxic labels
(0 without any labels, as does every text then). A document labelled more than
once is toxic if any label says so; null labels are ignored. Repeated rows
count each. A null doc_id is never held out. An empty table gives an empty
result. Extra columns are passed on if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise, named, pick, ragged, slices, text_bytes, tune_arrow, unit_hash, whole

GRAMS, BUCKETS, WIDTH = (3, 4, 5), 1 << 16, 8
COUNT_DOCS, FIT_DOCS = 8000, 1500
MIN_DOCS, MIN_ERRORS, MOST_ROWS = 10, 4.0, 512
EPOCHS, RATE, DECAY, SEED, GAIN = 150, 0.1, 1e-4, 5, 100.0
#: Characters cut from the ends of a word.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def split_words(part: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of a slice without punctuation at their ends, and the ends of its rows."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(part))
    words = pc.utf8_trim(lists.flatten(), PUNCTUATION)
    filled = np.asarray(pc.greater(pc.binary_length(words), 0))
    offsets = np.asarray(lists.offsets, np.int64)
    upto = np.concatenate([[0], np.cumsum(filled)])
    return words.filter(pa.array(filled)), upto[offsets - offsets[0]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def subwords(words: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(rows, ends): the embedding rows of each word's bag."""
    raw, ends = text_bytes(words.cast(pa.large_string()))
    lengths = np.diff(ends) + 2
    upto = np.concatenate([[0], np.cumsum(lengths)])
    text = np.empty(int(upto[-1]), np.uint64)
    text[upto[:-1]], text[upto[1:] - 1] = 2, 3
    text[ragged(upto[:-1] + 1, lengths - 2)] = raw
    word_of = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(text)) - upto[:-1][word_of]
    own = np.add.reduceat(_mix(text + (place.astype(np.uint64) << np.uint64(8))), upto[:-1]) if len(words) else np.empty(0, np.uint64)
    rows, owners = [_mix(own + np.uint64(1 << 40))], [np.arange(len(words))]
    for n in GRAMS:
        if len(text) < n:
            continue
        starts = np.flatnonzero(place[: len(text) - n + 1] + n <= lengths[word_of[: len(text) - n + 1]])
        key = np.full(len(starts), n, np.uint64)
        for k in range(n):
            key = key * np.uint64(0x100000001B3) + text[starts + k]
        rows.append(_mix(key))
        owners.append(word_of[starts])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    found = (np.concatenate(rows)[order] % np.uint64(buckets)).astype(np.int64)
    return found, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def _mean(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean of each stretch of rows; zero where it is empty."""
    counts = np.diff(ends)
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    filled = np.flatnonzero(counts)
    if len(filled):
        out[filled] = np.add.reduceat(values, ends[:-1][filled], axis=0)
        out[filled] /= counts[filled].reshape(-1, *[1] * (values.ndim - 1))
    return out


def occurrences(texts: pa.Array) -> np.ndarray:
    """In how many of the texts each embedding row occurs."""
    words, ends = split_words(texts)
    coded = words.dictionary_encode()
    grams, gram_ends = subwords(coded.dictionary)
    codes = np.asarray(coded.indices, np.int64)
    out = np.zeros(BUCKETS, np.int64)
    for i in range(len(ends) - 1):
        own = np.unique(codes[ends[i] : ends[i + 1]])
        out[grams[ragged(gram_ends[own], gram_ends[own + 1] - gram_ends[own])]] += 1  # an index that repeats is added once
    return out


def telling_rows(counts: np.ndarray, sizes: np.ndarray, least: int = MIN_DOCS, errors: float = MIN_ERRORS, most: int = MOST_ROWS) -> np.ndarray:
    """The ``most`` embedding rows whose share of texts differs most between the labels, in standard errors, ``errors`` at least.

    ``counts`` has a row of occurrences per label, ``sizes`` the texts of each.
    """
    share = counts.sum(axis=0) / sizes.sum()
    gap = np.abs(counts[1] / sizes[1] - counts[0] / sizes[0])
    error = np.sqrt(share * (1 - share) * (1 / sizes[0] + 1 / sizes[1]))
    telling = np.where((counts.sum(axis=0) >= least) & (error > 0), gap / np.where(error > 0, error, 1), 0)
    live = np.zeros(len(telling), bool)
    live[np.argsort(-telling, kind="stable")[:most]] = True
    return live & (telling >= errors)


def bags(texts: pa.Array, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, weights, ends): how much each live embedding row weighs in each text's mean of its words' means.

    Rows that aren't live are zero: they count in a mean and are left out here.
    """
    words, ends = split_words(texts)
    coded = words.dictionary_encode()
    grams, gram_ends = subwords(coded.dictionary)
    kept = live[grams]
    own = grams[kept]
    upto = np.concatenate([[0], np.cumsum(kept)])[gram_ends]
    share = 1 / np.maximum(np.diff(gram_ends), 1)
    codes = np.asarray(coded.indices, np.int64)
    rows, weights, counts = [], [], []
    for i in range(len(ends) - 1):
        code, n = np.unique(codes[ends[i] : ends[i + 1]], return_counts=True)
        sizes = upto[code + 1] - upto[code]
        found = own[ragged(upto[code], sizes)]
        row, place = np.unique(found, return_inverse=True)
        rows.append(row)
        weights.append(np.bincount(place, np.repeat(n * share[code], sizes), len(row)) / max(1, ends[i + 1] - ends[i]))
        counts.append(len(row))
    joined = [np.concatenate(x) if x else np.empty(0) for x in (rows, weights)]
    return joined[0].astype(np.int32), joined[1].astype(np.float32), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _sums(values: np.ndarray, starts: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Sums of stretches of columns that begin at ``starts``, placed at ``at`` of ``n``."""
    out = np.zeros((len(values), n), np.float32)
    if values.shape[1]:
        out[:, at] = np.add.reduceat(values, starts, axis=1)
    return out


def train(rows: np.ndarray, weights: np.ndarray, ends: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, decay: float = DECAY, seed: int = SEED, gain: float = GAIN) -> tuple[np.ndarray, float]:
    """(one number per embedding row, bias) of the model trained on ``bags``; a text's log odds are the weighted sum plus the bias.

    Means are taken ``gain`` times, a fixed factor on the softmax's weights, so
    that steps of one size serve a word among hundreds and the bias alike.
    """
    weights = weights * np.float32(gain)
    used, local = np.unique(rows, return_inverse=True)
    texts = np.repeat(np.arange(len(labels)), np.diff(ends))
    filled = np.flatnonzero(np.diff(ends))
    order = np.argsort(local, kind="stable")
    begins = np.searchsorted(local[order], np.arange(len(used)))
    rng = np.random.default_rng(seed)
    table = (rng.standard_normal((WIDTH, BUCKETS)) * 0.1).astype(np.float32)[:, used]
    out = (rng.standard_normal((WIDTH, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    onehot = np.eye(2, dtype=np.float32)[labels]
    params = [table, out, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, epochs + 1):
        vectors = _sums(table[:, local] * weights, ends[:-1][filled], len(labels), filled).T
        logits = vectors @ out + bias
        logits -= logits.max(axis=1, keepdims=True)
        share = np.exp(logits)
        share /= share.sum(axis=1, keepdims=True)
        error = (share - onehot) / len(labels)
        back = (error @ out.T).T
        grads = [_sums((back[:, texts] * weights)[:, order], begins, len(used), np.arange(len(used))) + decay * table, vectors.T @ error, error.sum(axis=0)]
        rate = RATE * (1 - (step - 1) / epochs)
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
    number = np.zeros(BUCKETS, np.float32)
    number[used] = gain * ((out[:, 1] - out[:, 0]) @ table)
    return number, float(bias[1] - bias[0])


class Model:
    """What scoring needs: a number per embedding row, the bias, the share of toxic labels."""

    def __init__(self, row: np.ndarray, bias: float, prior: float):
        self.row, self.bias, self.prior = row, bias, prior

    def score(self, part: pa.Array) -> np.ndarray:
        if not len(self.row):
            return np.zeros(len(part))
        words, ends = split_words(part)
        coded = words.dictionary_encode()
        grams, gram_ends = subwords(coded.dictionary)
        per_word = _mean(self.row[grams].astype(np.float64), gram_ends)
        odds = _mean(per_word[np.asarray(coded.indices, np.int64)], ends) + self.bias
        return np.where(np.diff(ends) > 0, 1 / (1 + np.exp(-np.clip(odds, -500, 500))), self.prior)


def fit(docs: DataFrame, labels: DataFrame, count_docs: int = COUNT_DOCS, fit_docs: int = FIT_DOCS) -> Model:
    """Choose embedding rows from counts made on the executors, and train on the driver, on bounded samples.

    The driver gets no text, only the sampled texts' weights of the chosen rows.
    """
    spark = docs.sparkSession
    tune_arrow(spark)
    known = pick(labels, ["doc_id", "toxic"]).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    untrained = Model(np.empty(0, np.float32), 0.0, prior)
    if len(sizes) < 2:
        return untrained
    share = F.when(F.col("toxic") == 1, min(1.0, count_docs / sizes[1])).otherwise(min(1.0, count_docs / sizes[0]))
    draw = unit_hash("doc_id", seed=13)
    chosen = known.where(draw < share).withColumn("rank", draw / share)  # about 2 * count_docs rows at any size
    # copies of a text would count its words again and again
    sample = whole(docs).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id"), F.min("rank").alias("rank"))
    sample = materialise(sample, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            toxic = np.asarray(batch.column(1))
            for label in (0, 1):
                for _, part in slices(batch.column(0).filter(pa.array(toxic == label)), 1 << 21):
                    total[label] += occurrences(part)
                    seen[label] += len(part)
        found = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([*found, BUCKETS], pa.int64()), pa.array([*total[0, found], seen[0]], pa.int64()), pa.array([*total[1, found], seen[1]], pa.int64())], names=["row", "clean", "toxic"])

    counted = sample.select("text", "toxic").mapInArrow(count, "row long, clean long, toxic long").groupBy("row").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    counts = np.zeros((2, BUCKETS + 1), np.int64)
    for label, name in enumerate(("clean", "toxic")):
        counts[label, counted.column("row").to_numpy()] = counted.column(name).to_numpy()
    if not counts[:, BUCKETS].all():
        return untrained
    live = telling_rows(counts[:, :BUCKETS], counts[:, BUCKETS])
    part = F.when(F.col("toxic") == 1, fit_docs / min(count_docs, sizes[1])).otherwise(2 * fit_docs / min(count_docs, sizes[0]))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(0), 1 << 21):
                rows, weights, ends = bags(texts, live)
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in (rows, weights)]
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(texts)) for c in batch.columns[1:]], *lists], names=["doc_id", "toxic", "rows", "weights"])

    # ties of doc_id are broken by what is trained on, so reruns agree
    held = sample.where(F.col("rank") < part).select("text", "doc_id", "toxic").mapInArrow(weigh, "doc_id long, toxic int, rows array<int>, weights array<float>").orderBy("doc_id", "toxic", "rows", "weights").toArrow()
    toxic = held.column("toxic").to_numpy()
    if len(set(toxic.tolist())) < 2:
        return untrained
    rows, weights = held.column("rows").combine_chunks(), held.column("weights").combine_chunks()
    ends = np.asarray(rows.offsets, np.int64)
    row, bias = train(rows.flatten().to_numpy(), weights.flatten().to_numpy(), ends - ends[0], toxic)
    return Model(row.astype(np.float32), bias, prior)


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` with score and predicted of every whole text."""
    spark = docs.sparkSession
    tune_arrow(spark)
    shared = spark.sparkContext.broadcast(model)  # one float per embedding row
    rows = pick(docs, ["text"], keep)
    places = [f"kept_{k}" for k in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(0), 1 << 21):
                found = shared.value.score(part)
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(part)) for c in batch.columns[1:]], pa.array(found)], names=[*places, "score"])

    out = rows.mapInArrow(run, ", ".join([*[f"{p} {rows.schema[p].dataType.simpleString()}" for p in places], "score double"]))
    return out.select(*named(keep), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
