"""Language identification by prediction by partial matching.

Each language has a context tree over bytes, of depth ``ORDER``: how often each
byte followed each context of up to that many bytes in the training texts. A
byte seen after its longest context costs its share there; an unseen one pays
the context's escape probability (distinct followers over followers plus
distinct followers) and is tried one byte shorter, down to a uniform byte. The
statistics are frozen after training, so a text's code length in a language is
a sum of fixed costs, and the shortest code wins. The score is the posterior
of the winner under equal priors. All 256 bytes are told apart, but A-Z are
folded to a-z.

A tree is kept as its runs (a context and the byte after it, one to ``ORDER`` + 1
bytes) with their counts, the most frequent of each language, ``NODES`` of all
together and no more than ``CELLS`` over the number of languages; counts that
are cut are as if never seen. So what the driver gathers, what the workers get
and what they hold is bounded for any number of languages and any alphabet.

Training takes rows whose language isn't null and that ``held_out`` leaves in,
at most about ``FIT_DOCS`` of each language, chosen by a hash of doc_id.

Defined cases: a null text, or one without a letter, is ``und`` with score 0,
and so is every text if nothing could be learned. Equal code lengths go to the
first language in code point order. Repeated rows count each. A null doc_id is
never held out. An empty table gives an empty result. Extra columns are passed
on if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out, materialise, named, pick, slices, text_bytes, tune_arrow, unit_hash

ORDER = 3
#: Texts of each language that the trees are fitted to, on average.
FIT_DOCS = 4000
#: Runs that the trees keep in all, and cells (runs by languages) of a worker's cost table.
NODES, CELLS = 1 << 20, 1 << 24
STEP_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_LETTER = regex.compile(r"\p{L}")
_UNIFORM = 8.0


def windows(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code, ends): each byte of the rows with the ``ORDER`` before it, as one number; a text starts after line ends."""
    raw, ends = text_bytes(part)
    at = np.arange(len(raw)) + ORDER * (np.repeat(np.arange(len(part)), np.diff(ends)) + 1)
    padded = np.full(len(raw) + ORDER * len(part), 10, np.uint32)
    padded[at] = _FOLD[raw]
    code = padded[at - ORDER]
    for k in range(ORDER - 1, -1, -1):
        code = code << np.uint32(8) | padded[at - k]
    return code, ends


def run_keys(code: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes of each window, as keys that tell lengths apart."""
    return (code.astype(np.int64) & ((1 << 8 * length) - 1)) | length << 32


class Trees:
    """The context trees of all languages as one table: a row per run, a column per language."""

    def __init__(self, keys: np.ndarray, language: np.ndarray, counts: np.ndarray, languages: int):
        """One entry per run and language: the run's key, the language's number and the count."""
        self.runs, row = np.unique(keys, return_inverse=True)
        self.languages = languages
        n = np.zeros((len(self.runs), languages), np.float32, order="F")  # counts of a bounded sample, exact in 24 bits
        n[row, language] = counts
        length = self.runs >> 32
        context = ((self.runs & 0xFFFFFFFF) >> 8) | (length - 1) << 32
        self.contexts, of = np.unique(context, return_inverse=True)
        self.escape = np.zeros((len(self.contexts), languages), np.float32, order="F")
        self.cost = np.zeros((len(self.runs), languages), np.float32, order="F")
        for k in range(languages):  # a column at a time, as a table can have many
            own = n[:, k].astype(np.float64)
            total, kinds = np.bincount(of, own, len(self.contexts)), np.bincount(of, own > 0, len(self.contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                # a context that a language has not seen costs it nothing to leave
                self.escape[:, k] = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                self.cost[:, k] = np.where(own > 0, -np.log2(own / (total + kinds)[of]), 0.0)
        for k in range(1, ORDER + 2):
            for rows in np.array_split(np.flatnonzero(length == k), max(1, len(self.runs) * languages >> 20)):
                shorter = self.bits((self.runs[rows] & 0xFFFFFFFF).astype(np.uint32), k - 1)
                self.cost[rows] += np.where(n[rows] > 0, np.float32(0), self.escape[of[rows]] + shorter)
        self._file(n.sum(axis=1))

    def _file(self, weight: np.ndarray) -> None:
        """A direct table from the bits of a full window to its row; of runs that meet there the most frequent stays."""
        full = np.flatnonzero(self.runs >> 32 == ORDER + 1)
        self.shift = np.uint32(32 - min(22, max(10, int(np.ceil(np.log2(8 * len(full) + 1))))))
        self.slot_code = np.zeros(1 << 32 - int(self.shift), np.uint32)
        self.slot_row = np.full(len(self.slot_code), -1, np.int32)
        full = full[np.argsort(weight[full], kind="stable")]
        code = (self.runs[full] & 0xFFFFFFFF).astype(np.uint32)
        slot = self._slot(code)
        self.slot_code[slot], self.slot_row[slot] = code, full  # the last one written stays, here the most frequent

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code * np.uint32(2654435769)) >> self.shift

    def find(self, sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where there is none."""
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == keys, at, -1)

    def bits(self, code: np.ndarray, length: int) -> np.ndarray:
        """Costs of each window's last byte in a tree of depth ``length`` - 1, a column per language."""
        if not length:
            return np.full((len(code), self.languages), _UNIFORM, np.float32)
        keys = run_keys(code, length)
        row = self.find(self.runs, keys)
        out = self.cost[row]
        new = np.flatnonzero(row < 0)
        if len(new):
            at = self.find(self.contexts, ((keys[new] & 0xFFFFFFFF) >> 8) | (length - 1) << 32)
            leave = np.where((at >= 0)[:, None], self.escape[at], np.float32(0))
            out[new] = leave + self.bits(code[new], length - 1)
        return out

    def code_lengths(self, part: pa.Array) -> np.ndarray:
        """Bits of every whole text, a row per text and a column per language."""
        code, ends = windows(part)
        out = np.zeros((len(part), self.languages))
        filled = np.flatnonzero(np.diff(ends))
        if not len(filled):
            return out
        slot = self._slot(code)
        row = self.slot_row[slot]
        other = np.flatnonzero((self.slot_code[slot] != code) | (row < 0))
        rest = self.bits(code[other], ORDER + 1)
        row[other] = 0
        for k in range(self.languages):
            cost = self.cost[:, k][row]
            cost[other] = rest[:, k]
            out[filled, k] = np.add.reduceat(cost, ends[:-1][filled], dtype=np.float64)
        return out


class Model:
    """Frozen counts of every language; bounded, and sent to the executors as it is."""

    def __init__(self, languages: list[str], keys: np.ndarray, language: np.ndarray, counts: np.ndarray):
        self.languages, self.entries = languages, (keys, language, counts)
        self._trees: Trees | None = None

    def __getstate__(self):
        return self.__dict__ | {"_trees": None}

    def bits(self, part: pa.Array) -> np.ndarray:
        if self._trees is None:
            self._trees = Trees(*self.entries, len(self.languages))
        return self._trees.code_lengths(part)

    def predict(self, part: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.languages or not len(part):
            return ["und"] * len(part), np.zeros(len(part))
        lettered = np.fromiter((bool(_LETTER.search(t)) for t in part.to_pylist()), bool, len(part))
        bits = self.bits(part)
        best = bits.argmin(axis=1)
        with np.errstate(under="ignore"):
            score = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered, strict=True)], np.where(lettered, score, 0.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (lang, text) rows, counted a slice at a time."""
    for batch in batches:
        langs = np.asarray(batch.column(0).to_pylist(), object)
        for at, part in slices(batch.column(1), STEP_BYTES):
            code, ends = windows(part)
            row_lang = langs[at : at + len(part)]
            for name in set(row_lang.tolist()):
                mine = code[np.repeat(row_lang == name, np.diff(ends))]
                for length in range(1, ORDER + 2):
                    keys, n = np.unique(run_keys(mine, length), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], names=["lang", "run", "n"])


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, nodes: int = NODES, cells: int = CELLS) -> Model:
    """Count runs on the executors; only the most frequent, ``nodes`` at most, are collected."""
    tune_arrow(docs.sparkSession)
    usable = pick(docs, ["doc_id", "text", "lang"]).withColumn("doc_id", F.col("doc_id").cast("long")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # a row per language; a label column with millions of values is counted, but not collected
    sizes = materialise(usable.groupBy("lang").agg(F.count("*").alias("texts")), "languages")
    languages = sizes.count()
    if not languages:
        return Model([], *[np.empty(0, np.int64)] * 3)
    share = F.least(F.lit(1.0), F.lit(float(fit_docs)) / F.col("texts"))
    sample = usable.join(sizes, "lang").where(unit_hash("doc_id", seed=11) < share).select("lang", "text")
    most = max(1, min(nodes, cells // languages) // languages)
    counted = sample.mapInArrow(_count, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    first = W.partitionBy("lang").orderBy(F.desc("n"), "run")
    kept = counted.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most).select("lang", "run", "n")
    if languages > nodes:  # then each has one run, and the first ``nodes`` languages are learned
        kept = kept.orderBy("lang").limit(nodes)
    kept = kept.toArrow()
    if not len(kept):
        return Model([], *[np.empty(0, np.int64)] * 3)
    learned = sorted(set(kept.column("lang").to_pylist()), key=lambda x: x.encode())
    number = {x: k for k, x in enumerate(learned)}
    return Model(learned, kept.column("run").to_numpy(), np.array([number[x] for x in kept.column("lang").to_pylist()], np.int64), kept.column("n").to_numpy())


def identify(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` with lang_pred and score of every whole text."""
    spark = docs.sparkSession
    tune_arrow(spark)
    shared = spark.sparkContext.broadcast(model)  # at most NODES entries
    rows = pick(docs, ["text"], keep)
    places = [f"kept_{k}" for k in range(len(keep))]
    fields = [f"{p} {rows.schema[p].dataType.simpleString()}" for p in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, part in slices(batch.column(0), STEP_BYTES):
                lang, score = model.predict(part)
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(part)) for c in batch.columns[1:]], pa.array(lang, pa.string()), pa.array(score)], names=[*places, "lang_pred", "score"])

    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"])).select(*named(keep), "lang_pred", "score")
