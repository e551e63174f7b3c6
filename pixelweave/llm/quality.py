"""Quality rules with risk-controlled thresholds.

``text_statistics`` counts words, symbols, repeated lines and repeated word
windows of whole texts. Two base rules always hold. Beyond them, each rule of
``RULES`` rejects what lies past a cutoff. The cutoffs of a stratum are chosen
from its labelled good documents, in two halves that share none:

1. A quarter of them, drawn by a hash of doc_id, lays out a path of settings
   from mild to sharp, each with a cutoff for every rule: first so many grid
   steps beyond the sharpest cutoff that rejects none of this quarter
   (``MARGINS``), then the sharpest that reject no more than growing shares of
   ``risk`` (``SHARES``).
2. The rest test the path in this order: a setting holds if the exact binomial
   (Clopper-Pearson) upper bound on the good documents that any of its rules
   rejects is at most ``risk``. The last setting before the first that fails is
   used; if the first fails, only the base rules reject.

As the order is fixed before the second half is looked at and testing stops at
the first failure, each test has the stratum's whole confidence; that is
``delta`` over the number of strata (Bonferroni), so with probability 1 -
``delta`` no stratum loses more than ``risk`` of its good documents to the
rules. The same holds at every size: a stratum whose second half has fewer than
about ln(strata / delta) / risk good documents (438) can't certify anything.

Defined cases: a null, empty or blank text has no words and fails the base
rules. Labels that are null are ignored, a document labelled more than once
counts as good only if all its labels say so, and without labels only the base
rules apply. Repeated rows count each. A null doc_id joins no label. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, pick, slices, text_bytes, tune_arrow

WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
RISK, DELTA = 0.01, 0.05

#: Rule: the value it looks at, and its candidate cutoffs from sharp to mild; past a cutoff means above it.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [round(0.02 * 1.2**k, 4) for k in range(24)]),
    "dup_lines": ("n_dup_lines / n_words", [round(0.002 * 1.25**k, 5) for k in range(24)]),
    "repeats": ("n_repeat_words / n_words", [round(0.01 * 1.15**k, 4) for k in range(24)]),
    "long_words": ("word_chars / n_words", [round(5.0 + 0.5 * k, 1) for k in range(24)]),
    "short_words": ("-word_chars / n_words", [round(-4.5 + 0.15 * k, 2) for k in range(24)]),
}

#: The path of settings: steps of a rule's grid beyond its sharpest cutoff that rejects none, then shares of the rule's part of the risk.
MARGINS, SHARES = (8, 4, 2, 1, 0), (0.125, 0.25, 0.5, 1.0)
#: A good document in so many lays out the path, the others test it.
PATH_PART = 4

#: Strata: bands of the number of words.
BANDS = (100, 300, 1000)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; distinct ones stay distinct."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _per_row(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each row's stretch."""
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[ends[1:]] - upto[ends[:-1]]


def _repeat_words(words: pa.Array, ends: np.ndarray, window: int) -> np.ndarray:
    """Words of each row that lie in a window of words found twice or more in the row."""
    codes = np.asarray(words.dictionary_encode().indices, np.int64)
    n = len(codes)
    out = np.zeros(len(ends) - 1, np.int64)
    if n < window:
        return out
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    marks = _mix(codes)
    with np.errstate(over="ignore"):
        key = _mix(row[: n - window + 1] + (1 << 40))
        for k in range(window):
            key = key * np.uint64(0xD1342543DE82EF95) + marks[k : n - window + 1 + k]
    starts = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    if not len(starts):
        return out
    key = _mix(key[starts])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[twice], 1)
    np.add.at(edge, starts[twice] + window, -1)
    return _per_row(np.cumsum(edge[:-1]) > 0, ends)


def _statistics(part: pa.Array, window: int) -> list[np.ndarray]:
    raw, ends = text_bytes(part)
    space = _SPACE[raw]
    before = np.concatenate([[True], space[:-1]]) if len(raw) else np.empty(0, bool)
    before[ends[:-1][ends[:-1] < len(raw)]] = True
    n_words = _per_row(~space & before, ends)
    chars = _per_row(~space & ((raw & 0xC0) != 0x80), ends)
    symbols = _per_row(_SYMBOL[raw], ends)
    words = pc.ascii_split_whitespace(part).flatten()
    words = words.filter(pc.greater(pc.binary_length(words), 0))
    repeats = _repeat_words(words, np.concatenate([[0], np.cumsum(n_words)]), window)
    dups = np.zeros(len(part), np.int64)
    for i, text in enumerate(part.to_pylist()):
        lines = text.split("\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            filled = [x for x in lines if x.strip(" \t\n\r\x0b\x0c")]
            dups[i] = len(filled) - len(set(filled))
    return [n_words, chars, symbols, dups, repeats]


def text_statistics(docs: DataFrame, window: int = WINDOW, keep: Sequence[str] = ()) -> DataFrame:
    """Counts of every whole text, one row a document, with doc_id or else the columns ``keep``."""
    tune_arrow(docs.sparkSession)
    rows = pick(docs, ["text"], keep or ["doc_id"])
    places = [f"kept_{k}" for k in range(len(keep or ["doc_id"]))]
    if not keep:
        rows = rows.withColumn("kept_0", F.col("kept_0").cast("long"))
    schema = [*[f"{p} {rows.schema[p].dataType.simpleString()}" for p in places], *[f"{n} long" for n in COUNTS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(part)) for c in batch.columns[1:]], *[pa.array(x, pa.int64()) for x in _statistics(part, window)]], names=[*places, *COUNTS])

    counted = rows.mapInArrow(run, ", ".join(schema))
    return counted.select(*[F.col(p).alias(c) for p, c in zip(places, keep or ["doc_id"], strict=True)], *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def stratum() -> Column:
    """The band of a document's number of words, from 0."""
    return sum((F.when(F.col("n_words") >= b, 1).otherwise(0) for b in BANDS), F.lit(0))


def tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), exact: summed from k away from the mean until the rest is below rounding."""
    if k >= n:
        return 1.0
    above = k >= n * p  # then the terms fall from k + 1 upwards, and the sum is of the other side
    i = k + 1 if above else k
    term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    total, odds = 0.0, p / (1 - p)
    while 0 <= i <= n and term > total * 1e-17:
        total += term
        term *= (n - i) / (i + 1) * odds if above else i / (n - i + 1) / odds
        i += 1 if above else -1
    return max(0.0, 1 - total) if above else min(total, 1.0)


def certified(n: int, k: int, risk: float, delta: float) -> bool:
    """Whether the Clopper-Pearson upper bound at confidence 1 - delta is at most ``risk``."""
    return n > 0 and k < n and tail(n, k, risk) <= delta


def _path(places: list[int], n: int, risk: float) -> list[int | None]:
    """A rule's cutoff in each setting of the path; ``places`` counts documents by how many cutoffs they passed.

    None is no cutoff. Cutoff i rejects those that passed more than i.
    """
    size = len(places) - 1
    rejected = [sum(places[i + 1 :]) for i in range(size)]
    none = next((i for i in range(size) if not rejected[i]), size)
    within = [next((i for i in range(size) if rejected[i] <= share * risk / len(RULES) * n), size) for share in SHARES]
    return [i if i < size else None for i in [*[none + m for m in MARGINS], *within]]


def choose_cutoffs(statistics: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[tuple[int, str], float]:
    """(stratum, rule) to its cutoff in the sharpest setting that is certified.

    Only histograms per stratum and rule reach the driver: of cutoffs passed in
    the first half, of the first setting that rejects in the second.
    """
    good = pick(labels, ["doc_id", "quality"]).withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = statistics.where(~base_failed()).join(good, "doc_id", "left_semi").withColumn("stratum", stratum())
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit("path|"), F.col("doc_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % PATH_PART
    passed = {name: sum((F.when(F.expr(value) > c, 1).otherwise(0) for c in cutoffs), F.lit(0)) for name, (value, cutoffs) in RULES.items()}
    halves = materialise(held.select("stratum", (drawn == 0).alias("first"), *[c.alias(name) for name, c in passed.items()]), "good")
    counted = halves.where("first").select("stratum", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("passed")) for name in RULES])).alias("r")).groupBy("stratum", "r.rule", "r.passed").count().collect()
    strata = range(len(BANDS) + 1)
    path: dict[tuple[int, str], list[int | None]] = {}
    for s in strata:
        for rule, (_, cutoffs) in RULES.items():
            places = [0] * (len(cutoffs) + 1)
            for row in counted:
                if (row["stratum"], row["rule"]) == (s, rule):
                    places[row["passed"]] = row["count"]
            path[s, rule] = _path(places, sum(places), risk)
    steps = len(MARGINS) + len(SHARES)
    # cutoffs of a rule only fall along the path, so a document is rejected from its first such setting on
    def milder(s: int, rule: str) -> Column:
        """How many settings of the path spare the document."""
        return sum((F.when(F.col(rule) <= (len(RULES[rule][1]) if i is None else i), 1).otherwise(0) for i in path[s, rule]), F.lit(0))

    first = F.coalesce(*[F.when(F.col("stratum") == s, F.least(*[milder(s, rule) for rule in RULES])) for s in strata])
    tested = halves.where("NOT first").select("stratum", first.alias("step")).groupBy("stratum", "step").count().collect()
    chosen = {}
    for s in strata:
        at = [0] * (steps + 1)
        for row in tested:
            if row["stratum"] == s:
                at[row["step"]] = row["count"]
        last = None
        for k in range(steps):
            if not certified(sum(at), sum(at[: k + 1]), risk, delta / len(strata)):
                break
            last = k
        if last is not None:
            chosen |= {(s, rule): cutoffs[path[s, rule][last]] for rule, (_, cutoffs) in RULES.items() if path[s, rule][last] is not None}
    return chosen


def judge(statistics: DataFrame, cutoffs: dict[tuple[int, str], float]) -> DataFrame:
    """Adds base_failed and kept; a null verdict is impossible as n_words is at least 20 past the base rules."""
    rejected = F.lit(False)
    for (s, rule), cutoff in cutoffs.items():
        rejected = rejected | ((stratum() == s) & (F.expr(RULES[rule][0].replace("/ n_words", "/ greatest(n_words, 1)")) > cutoff))
    return statistics.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    statistics = materialise(text_statistics(docs), "statistics")
    return judge(statistics, choose_cutoffs(statistics, labels, risk, delta))


def oracle(window: int = WINDOW, risk: float = RISK, delta: float = DELTA) -> str:
    """``quality_rules`` of the tables documents and labels as DuckDB SQL."""
    space = r"\x20\x09-\x0D"
    symbols = "[^#*$%&|<>]"
    band = " + ".join(f"(n_words >= {b})::INT" for b in BANDS)
    values = " UNION ALL ".join(f"SELECT r, stratum, '{rule}' AS rule, {value.replace('/ n_words', '/ greatest(n_words, 1)')} AS value FROM judged" for rule, (value, _) in RULES.items())
    cutoffs = ", ".join(f"('{rule}', {i}, {c}::DOUBLE)" for rule, (_, own) in RULES.items() for i, c in enumerate(own))
    p = f"({risk!r}::DOUBLE)"
    size = max(len(own) for _, own in RULES.values())
    margins = ", ".join(f"({k}, {m})" for k, m in enumerate(MARGINS))
    shares = ", ".join(f"({len(MARGINS) + k}, {share * risk / len(RULES)!r}::DOUBLE)" for k, share in enumerate(SHARES))
    return f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^{space}]+') AS ws FROM t),
        win AS (SELECT r, i, array_to_string(ws[i:i + {window - 1}], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM w)),
        rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
        cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range({window}) x(k) GROUP BY r),
        line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
        dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM line WHERE regexp_matches(line, '[^{space}]') GROUP BY r),
        stats AS (SELECT w.r, w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '{symbols}', '', 'g')) AS n_symbols,
            coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN dup ON dup.r = w.r LEFT JOIN cov ON cov.r = w.r),
        judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, {band} AS stratum FROM stats),
        good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
        vals AS ({values}),
        held AS (SELECT v.*, CAST('0x' || substr(md5('path|' || j.doc_id), 1, 8) AS BIGINT) % {PATH_PART} = 0 AS first FROM vals v JOIN judged j ON j.r = v.r WHERE NOT j.base_failed AND j.doc_id IN (SELECT doc_id FROM good)),
        cutoff(rule, i, c) AS (VALUES {cutoffs}),
        bands AS (SELECT unnest(range({len(BANDS) + 1}))::INT AS stratum),
        trial AS (SELECT b.stratum, x.rule, x.i, count(h.r) AS n, count(CASE WHEN h.value > x.c THEN 1 END) AS k FROM bands b CROSS JOIN cutoff x LEFT JOIN held h ON h.first AND h.stratum = b.stratum AND h.rule = x.rule GROUP BY ALL),
        path AS (SELECT stratum, rule, t.step, min(CASE WHEN k = 0 THEN i END) + t.m AS i FROM trial, (VALUES {margins}) t(step, m) GROUP BY stratum, rule, t.step, t.m
            UNION ALL SELECT stratum, rule, t.step, min(CASE WHEN k <= t.a * n THEN i END) FROM trial, (VALUES {shares}) t(step, a) GROUP BY stratum, rule, t.step, t.a),
        setting AS (SELECT p.stratum, p.rule, p.step, x.c FROM path p JOIN cutoff x ON x.rule = p.rule AND x.i = p.i WHERE p.i < {size}),
        losses AS (SELECT h.r, h.stratum, s.step, max((h.value > s.c)::INT) AS lost FROM held h JOIN setting s ON s.stratum = h.stratum AND s.rule = h.rule WHERE NOT h.first GROUP BY ALL),
        steps AS (SELECT b.stratum, t.step, (SELECT count(DISTINCT r) FROM held h WHERE NOT h.first AND h.stratum = b.stratum) AS n, (SELECT coalesce(sum(lost), 0) FROM losses l WHERE l.stratum = b.stratum AND l.step = t.step) AS k FROM bands b, range({len(MARGINS) + len(SHARES)}) t(step)),
        tails AS (SELECT stratum, step, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln{p} + (n - j) * ln(1 - {p}))) AS tail FROM (SELECT *, unnest(range(0, CAST(k AS BIGINT) + 1)) AS j FROM steps WHERE k < n) GROUP BY ALL),
        failed AS (SELECT s.stratum, min(s.step) AS step FROM steps s LEFT JOIN tails t USING (stratum, step) WHERE t.tail IS NULL OR t.tail > {delta / (len(BANDS) + 1)!r}::DOUBLE GROUP BY s.stratum),
        chosen AS (SELECT s.stratum, s.rule, s.c FROM setting s LEFT JOIN failed f USING (stratum) WHERE s.step = coalesce(f.step, {len(MARGINS) + len(SHARES)}) - 1),
        rejected AS (SELECT DISTINCT v.r FROM vals v JOIN chosen h ON h.stratum = v.stratum AND h.rule = v.rule WHERE v.value > h.c)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM rejected) AS kept FROM judged"""
