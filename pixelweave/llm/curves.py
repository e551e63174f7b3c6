"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is projected to a few dimensions by ``orderings`` random rotations,
shifted, and cut to a grid; its place on the grid's Hilbert curve is its key in
that ordering. Spark range-partitions each ordering by key, which gives every
vector a rank in it. A query looks through the vectors within ``window`` ranks
of its own, a block at a time; what the windows of all orderings find is merged
and ranked by exact distances in double precision.

The window is fitted, not given: for at most ``PROBES`` queries, drawn by a hash
of their id, the true neighbours are found in one pass over the table, and the
window is the distance in ranks within which ``target`` of them lie in at least
one ordering. So recall holds on any data, and work follows the data: vectors in
clusters need windows of some hundred rows at any size, vectors alike in all
directions need windows that grow with the table, as no ordering keeps their
neighbours together. ``measure`` reports both. The README has figures.

Equal vectors are one point of the index, with the ids that can be among its
nearest, so any number of copies costs one row. Blocks bound what a task holds;
only ids and ranks are sorted, and a block's vectors are joined to it.

Defined cases: vectors that are null, zero, hold a null or non-finite component
or have another length than most, and rows with a null id, take no part. Rows
that repeat id and vector count once; an id with several vectors may be found
under each, and the nearest counts. Equal distances go to the smaller id, also
at the last rank. Fewer candidates than ``k`` give fewer rows. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import materialise, pick, tune_arrow

K = 10
ORDERINGS, GRID_DIMS, GRID_BITS, SEED = 16, 6, 10, 3
#: Queries whose true neighbours fit the window, and the share of those it must reach.
PROBES, TARGET = 64, 0.97
#: Rows of a block at least and at most; between them a window is four blocks.
LEAST_BLOCK, MOST_BLOCK = 64, 16_384
#: Rows that a sorted part of an ordering holds on average.
PART_ROWS = 1_000_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of grid cells (rows of ``dims`` numbers below 2^bits), dims * bits <= 63.

    The published transform to and from transposed Hilbert integers (Skilling,
    2004), over whole columns at a time.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i, axis in enumerate(axes):
            high = (axis >> bit & 1).astype(bool)
            swap = np.where(high, 0, (axes[0] ^ axis) & low)
            flip = np.where(high, low, 0)
            if i:
                axes[i] = axis ^ swap
                axes[0] = axes[0] ^ swap ^ flip
            else:
                axes[0] = axis ^ flip
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] >> bit & 1, (1 << bit) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ turn) >> bit & 1)
    return key


class Curves:
    """The seeded projections, shifts and scales of every ordering."""

    def __init__(self, dim: int, mean: np.ndarray, scale: float, orderings: int = ORDERINGS, dims: int = GRID_DIMS, bits: int = GRID_BITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        dims = min(dims, dim)
        self.bits, self.mean, self.scale = min(bits, 63 // dims), mean, scale or 1.0
        axes: list[np.ndarray] = []
        while len(axes) < orderings:  # as long as a rotation has unused axes, orderings don't share any
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            axes += [turn[:, i : i + dims] for i in range(0, dim - dims + 1, dims)]
        self.axes = axes[:orderings]
        self.shifts = [rng.random(dims) for _ in range(orderings)]

    def keys(self, vectors: np.ndarray, t: int) -> np.ndarray:
        """Keys in ordering ``t``; the grid spans six scales, and one more for the shift."""
        place = ((vectors - self.mean) @ self.axes[t] / self.scale + 3) / 6  # mostly in 0 to 1
        place = (np.clip(place, 0, 1) + self.shifts[t]) / 2
        return hilbert_keys(np.minimum((place * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1), self.bits)


def usable(vectors: DataFrame, id_name: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) rows that take part, and their length; single precision stays single, as no value changes."""
    rows = pick(vectors, [id_name, vector]).toDF("id", "v")
    kind = rows.schema["v"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>" if single else "array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 0
    return rows.where(F.size("v") == dim), dim


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


def _points(rows: DataFrame, k: int) -> DataFrame:
    """A row for each distinct vector: point, its k + 1 smallest ids (no other copy can be among the nearest), whether it is asked for."""
    few = rows.withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
    few = few.groupBy("v").agg(F.min("id").alias("point"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.groupBy("v").agg(F.max("query").alias("asked"))
    return materialise(few.join(asked, "v"), "points")


def _moments(points: DataFrame, dim: int) -> tuple[np.ndarray, float]:
    """The mean vector, and the root mean square of a component around it."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dim), 0.0
        for batch in batches:
            matrix = _matrix(batch.column(0), dim)
            n, total, square = n + len(matrix), total + matrix.sum(axis=0), square + float((matrix * matrix).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 2)), pa.array(np.array([*total, square, n], float))], names=["i", "x"])

    found = points.select("v").mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toArrow().column("x").to_numpy()
    mean, n = found[:dim] / found[-1], found[-1]
    return mean, float(np.sqrt(max(0.0, found[dim] / (n * dim) - (mean * mean).mean())))


def _ranked(points: DataFrame, dim: int, n: int, curves: Curves, orderings: int) -> DataFrame:
    """(t, point, rank): every point's place in every ordering."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                matrix = _matrix(batch.column(1), dim)
                for t in range(orderings):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), t, np.int32)), pa.array(curves.keys(matrix, t)), batch.column(0)], names=["t", "key", "point"])

    keyed = materialise(points.select("point", "v").mapInArrow(project, "t int, key long, point long"), "keys")
    order = ["t", "key", "point"]
    dealt = keyed.repartitionByRange(max(1, -(-n * orderings // PART_ROWS)), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # partition number above, place in the sorted partition below
    laid = materialise(dealt.select("t", "point", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place")), "ordered")
    # where each ordering begins in each part: a row for every million vectors
    parts = laid.groupBy("t", "part").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    before = W.partitionBy("t").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = materialise(parts.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")), "parts")
    return laid.join(parts.select("t", "part", "base"), ["t", "part"]).select("t", "point", (F.col("base") + F.col("place")).alias("rank"))


def _true_neighbours(points: DataFrame, dim: int, k: int, probes: int) -> DataFrame:
    """(asker, point) of the k nearest points of at most ``probes`` asked ones, by one pass over all."""
    chosen = points.where("asked").select("point", "v").orderBy(F.xxhash64("point", F.lit(5)), "point").limit(probes).toArrow()
    ids, asks = chosen.column("point").to_numpy(), _matrix(chosen.column("v"), dim)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield from _best(ids, asks, np.asarray(batch.column(0)), _matrix(batch.column(1), dim), k)

    found = points.select("point", "v").mapInArrow(search, FOUND)
    nearest_first = W.partitionBy("asker").orderBy("score", "point")
    return found.withColumn("nth", F.row_number().over(nearest_first)).where(F.col("nth") <= k).select("asker", "point")


def fit_window(ranked: DataFrame, true: DataFrame, target: float) -> int:
    """The fewest ranks within which ``target`` of the true pairs lie in some ordering."""
    pairs = true.select("asker", "point").toArrow()  # k for each probe
    asker, point = (pairs.column(c).to_numpy() for c in ("asker", "point"))
    if not len(pairs):
        return 1
    wanted = ranked.sparkSession.createDataFrame([(int(i),) for i in np.unique(np.concatenate([asker, point]))], "point long")
    held = ranked.join(F.broadcast(wanted), "point").toArrow()  # at most (k + 1) * PROBES points
    t, ids, rank = (held.column(c).to_numpy() for c in ("t", "point", "rank"))
    known, at = np.unique(ids, return_inverse=True)
    places = np.zeros((int(t.max()) + 1, len(known)), np.int64)
    places[t, at] = rank
    apart = np.abs(places[:, np.searchsorted(known, asker)] - places[:, np.searchsorted(known, point)]).min(axis=0)
    return max(1, int(np.sort(apart)[min(len(apart), int(np.ceil(target * len(apart)))) - 1]))


FOUND = "asker long, point long, score double"


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_name: str = "vec_id", vector: str = "embedding", orderings: int = ORDERINGS, dims: int = GRID_DIMS, bits: int = GRID_BITS, target: float = TARGET, probes: int = PROBES, least_block: int = LEAST_BLOCK, most_block: int = MOST_BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest found; ``is_query`` is a condition on the column ``id``."""
    spark = vectors.sparkSession
    tune_arrow(spark)
    rows, dim = usable(vectors, id_name, vector)
    rows = rows.withColumn("query", is_query).distinct()
    points = _points(rows, k)
    n = points.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    curves = Curves(dim, *_moments(points, dim), orderings, dims, bits, seed)
    ranked = _ranked(points, dim, n, curves, orderings)
    window = fit_window(ranked, _true_neighbours(points, dim, k, probes), target)
    block = min(max(least_block, -(-window // 4)), most_block)
    reach = max(1, -(-window // block))
    filed = ranked.select("t", "point", F.floor(F.col("rank") / block).alias("b"))
    met = _meet(filed, points, reach)
    found = met.mapInArrow(_search(dim, k), FOUND).groupBy("asker", "point").agg(F.min("score").alias("score"))
    found = found.withColumn("nth", F.row_number().over(W.partitionBy("asker").orderBy("score", "point"))).where(F.col("nth") <= k).drop("nth")
    own = points.where("asked").select(F.col("point").alias("asker"), "point", F.lit(0.0).alias("score"))
    hits = found.unionByName(own).join(points.select("point", "ids"), "point").select("asker", F.explode("ids").alias("vec_id"), "score")
    askers = rows.where("query").select("id", "v").join(points.select("point", "v"), "v").select(F.col("id").alias("query_id"), F.col("point").alias("asker"))
    final = askers.join(hits, "asker").where("query_id != vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranks = final.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranks.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meet(filed: DataFrame, points: DataFrame, reach: int) -> DataFrame:
    """Every block with its points and the queries of blocks up to ``reach`` away, together in one partition."""
    members = filed.withColumn("is_query", F.lit(False))
    lookups = filed.join(points.where("asked").select("point"), "point", "left_semi").withColumn("b", F.explode(F.sequence(F.col("b") - reach, F.col("b") + reach))).withColumn("is_query", F.lit(True))
    both = members.unionByName(lookups.select("t", "point", "b", "is_query")).join(points.select("point", "v"), "point")
    return both.select("t", "b", "is_query", "point", "v").repartition("t", "b").sortWithinPartitions("t", "b")


def measure(vectors: DataFrame, is_query: Column, k: int = K, id_name: str = "vec_id", vector: str = "embedding", probes: int = PROBES, target: float = TARGET) -> dict[str, float]:
    """points, window (ranks), block (rows), and looked_at: distances of a query as a share of all points."""
    rows, dim = usable(vectors, id_name, vector)
    points = _points(rows.withColumn("query", is_query).distinct(), k)
    n = points.count()
    ranked = _ranked(points, dim, n, Curves(dim, *_moments(points, dim)), ORDERINGS)
    window = fit_window(ranked, _true_neighbours(points, dim, k, probes), target)
    block = min(max(LEAST_BLOCK, -(-window // 4)), MOST_BLOCK)
    return {"points": n, "window": window, "block": block, "looked_at": ORDERINGS * min(n, block * (2 * max(1, -(-window // block)) + 1)) / n}


def _search(dim: int, k: int):
    """The nearest of each block to each of its queries; rows come sorted by block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            ask = np.asarray(table.column(2)).astype(bool)
            ids, matrix = np.asarray(table.column(3)), _matrix(table.column(4), dim)
            if ask.any() and not ask.all():
                yield from _best(ids[ask], matrix[ask], ids[~ask], matrix[~ask], k)

        for batch in batches:
            t, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(b) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if i == j:
                    continue
                if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (t[i], b[i]):
                    yield from flush()
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield from flush()

    return search


def _best(ask_ids: np.ndarray, asks: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest other points of each asker: a quick pass by dot products, then exact distances."""
    squares = np.einsum("ij,ij->i", matrix, matrix)
    for s in range(0, len(asks), 256):
        part, own = asks[s : s + 256], ask_ids[s : s + 256]
        rough = squares[None, :] - 2 * (part @ matrix.T)
        rough[own[:, None] == ids[None, :]] = np.inf
        out_a, out_p, out_s = [], [], []
        for i in range(len(part)):
            row = rough[i]
            if len(row) > 4 * k:
                limit = np.partition(row, 2 * k)[2 * k]  # ties and rounding stay in
                near = np.flatnonzero(row <= limit + 1e-9 * (1 + abs(limit)))
            else:
                near = np.arange(len(row))
            near = near[ids[near] != own[i]]
            exact = np.sqrt(np.cumsum((matrix[near] - part[i]) ** 2, axis=1)[:, -1])  # summed in order, as SQL does
            order = np.lexsort((ids[near], exact))[:k]
            out_a += [int(own[i])] * len(order)
            out_p += ids[near][order].tolist()
            out_s += exact[order].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_p, pa.int64()), pa.array(out_s, pa.float64())], names=["asker", "point", "score"])


def oracle(condition: str = "id % 100 = 0", k: int = K, id_name: str = "vec_id", vector: str = "embedding", table: str = "embeddings") -> str:
    """All pairs of queries and rows as DuckDB SQL: what ``nearest`` finds at full recall, as on tables of some hundred rows."""
    return f"""
    WITH v AS (SELECT DISTINCT {id_name} AS id, CAST({vector} AS DOUBLE[]) AS v FROM {table} WHERE {id_name} IS NOT NULL AND {vector} IS NOT NULL),
        sound AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        common AS (SELECT len(v) AS d FROM sound GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        rows AS (SELECT id, v FROM sound WHERE len(v) = (SELECT d FROM common)),
        pairs AS (SELECT q.id AS query_id, c.id AS vec_id, min(sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))))) AS score FROM (SELECT * FROM rows WHERE {condition}) q JOIN rows c ON q.id <> c.id GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS nth FROM pairs)
    SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, score FROM ranked WHERE nth <= {k}"""
