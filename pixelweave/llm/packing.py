"""Bound-certified best-fit packing of token documents into sequences.

``pieces`` cuts documents into pieces of at most ``capacity`` tokens. ``pack``
gives every piece a sequence and an offset:

1. A full piece is a sequence of its own. The others are dealt at random into
   groups of bounded size and each group is packed by best-fit decreasing.
2. Dual-feasible functions give each group a lower bound on its number of
   sequences. A group whose count equals its bound is certified optimal.
3. The sequences that aren't full, of groups with a gap, are dealt to new
   groups, at most half as many, are packed again there, and the better of the
   two packings stays. This repeats until an exchange closes less than
   ``LEAST_GAIN`` of the gaps, or no two groups have one.

``certificate`` holds the result against the bound of the whole table.

Nulls and oddities: a null or empty text is one document of no ids but the end
id. Repeated rows are packed once each. A null doc_id is packed like any other.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tune_arrow, whole
from .tokens import WordTokenizer

CAPACITY = 2048
#: Pieces that a packing group holds on average.
GROUP_PIECES = 60_000
#: Exchanges go on while each closes at least this share of the gaps it met.
LEAST_GAIN = 0.02

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "part long, local long, offset long, length long, doc_id long, piece int, start long, ids_crc32 long, used long, bound long, bins long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of every document: ids by the tokenizer, then ``end_id``."""
    tune_arrow(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.at(tokenizer_path)
        for batch in batches:
            doc_ids = batch.column(0)
            for at, ids, ends in tokenizer.encode_column(batch.column(1)):
                row, piece, start, length, crc = [], [], [], [], []
                for i in range(len(ends) - 1):
                    own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        row.append(at + i), piece.append(k), start.append(s), length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(row, pa.int64())).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return whole(docs).mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """The best of three families of dual-feasible functions, at every useful parameter.

    Each maps lengths so that any set that fits keeps a sum of at most one
    sequence; the sum over all pieces, rounded up, is then a lower bound.
    ``counts`` says how often each length occurs, if they come counted.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True) if counts is None else (np.asarray(lengths, np.int64), np.asarray(counts, np.int64))
    best = -(-int((sizes * counts).sum()) // capacity)
    half = sizes[sizes * 2 <= capacity]
    for e in np.unique(half):  # over capacity - e count whole, under e nothing, the rest by length
        value = np.where(sizes > capacity - e, capacity, np.where(sizes < e, 0, sizes))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(1, 33):  # rounding: x -> floor((k + 1) x) / k unless (k + 1) x is whole
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * counts).sum()) // (capacity * k)))
    for e in np.unique(half):  # over half: what e-sized pieces can't share
        if e:
            per = capacity // e
            value = np.where(sizes * 2 > capacity, 2 * (per - (capacity - sizes) // e), np.where(sizes * 2 == capacity, per, 2 * (sizes // e)))
            best = max(best, -(-int((value * counts).sum()) // (2 * per)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of every piece and the number of bins.

    Open bins are filed by the room they have left; a bit set finds the
    tightest room in which a piece fits.
    """
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        where[i], offset[i] = b, capacity - room
        left = room - size
        if left:
            if not rooms[left]:
                open_rooms |= 1 << left
            rooms[left].append(b)
    return where, offset, bins


def _order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")


def _pack_group(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _order(pdf)
        lengths = pdf["length"].to_numpy(np.int64)
        where, offset, bins = best_fit_decreasing(lengths, capacity)
        used = np.bincount(where, weights=lengths, minlength=bins).astype(np.int64)
        return pdf.assign(local=where, offset=offset, used=used[where], bound=lower_bound(lengths, capacity), bins=bins)[[c.split()[0] for c in PACKED.split(", ")]]

    return pack


def _repack_group(capacity: int):
    """Packs what several groups brought; without a gain each keeps its sequences."""

    def repack(pdf: pd.DataFrame) -> pd.DataFrame:
        before = len(pdf[["part", "local"]].drop_duplicates())
        pdf = _order(pdf)
        lengths = pdf["length"].to_numpy(np.int64)
        where, offset, bins = best_fit_decreasing(lengths, capacity)
        if bins < before:
            used = np.bincount(where, weights=lengths, minlength=bins).astype(np.int64)
            pdf = pdf.assign(local=where, offset=offset, used=used[where])
        else:
            old = pdf.groupby(["part", "local"], sort=False).ngroup().to_numpy()
            pdf, bins = pdf.assign(local=old), before
        return pdf.assign(part=pdf["meet"], bound=lower_bound(lengths, capacity), bins=bins)[[c.split()[0] for c in PACKED.split(", ")]]

    return repack


def pack(rows: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, least_gain: float = LEAST_GAIN) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` rows.

    A group takes about ``group_pieces`` rows in every round, so a task's memory
    doesn't grow with the table.
    """
    rows = materialise(rows, "pieces")
    full, loose = rows.where(F.col("length") >= capacity), rows.where(F.col("length") < capacity)
    groups = max(1, round(loose.count() / group_pieces))
    dealt = loose.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    done = [full.withColumn("key", F.struct(F.lit(-1).alias("round"), F.xxhash64("doc_id", "piece").alias("part"), F.monotonically_increasing_id().alias("local"))).withColumn("offset", F.lit(0).cast("long"))]
    packed = materialise(dealt.groupBy("part").applyInPandas(_pack_group(capacity), PACKED), "packed")

    def keyed(df: DataFrame, k: int) -> DataFrame:
        return df.withColumn("key", F.struct(F.lit(k).alias("round"), F.col("part"), F.col("local")))

    k = 0
    while True:
        gaps = packed.select("part", "bins", "bound").where("bins > bound").distinct()
        many, gap = gaps.agg(F.count("*"), F.sum(F.col("bins") - F.col("bound"))).first()
        if many < 2:
            break
        joined = packed.join(gaps.select("part", F.lit(True).alias("open")), "part", "left").withColumn("open", F.coalesce("open", F.lit(False)) & (F.col("used") < capacity))
        moving = joined.where("open")
        before, loads = moving.agg(F.countDistinct("part", "local"), F.count("*")).first()
        # whole sequences move, dealt by a hash, so each new group mixes what several old ones brought
        meets = min(max(1, many // 2), -(-loads // group_pieces))
        met = materialise(moving.withColumn("meet", F.pmod(F.xxhash64("part", "local", F.lit(k)), F.lit(meets))).groupBy("meet").applyInPandas(_repack_group(capacity), PACKED), "repacked")
        after = met.select("part", "bins").distinct().agg(F.sum("bins")).first()[0]
        done.append(keyed(joined.where("NOT open"), k))
        packed, k = met, k + 1
        if before - after < max(1, least_gain * gap):
            break
    done.append(keyed(packed, k))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = None
    for df in done:
        part = df.select(*names, _sequence_number(F.col("key")).alias("sequence_id"), "offset")
        out = part if out is None else out.unionByName(part)
    return out


def _sequence_number(key):
    """A number no two sequences share: round in the low bits, then group and place.

    A whole piece uses Spark's row number (partition and place), a packed one
    its group (below 2^27) and place within it (below 2^28).
    """
    whole_piece = key["local"] * 64
    packed_one = (key["part"] * F.lit(1 << 28) + key["local"]) * 64 + key["round"] + 1
    return F.when(key["round"] == -1, whole_piece).otherwise(packed_one)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What ``pack`` gave against what no packing can beat, in one row.

    sequences (used), length_bound (all tokens by the capacity), bound (the
    best dual-feasible function over the whole table's lengths) and certified
    (whether sequences meets bound, so that fewer are impossible). The bound
    is taken from the histogram of lengths, one row for each at most.
    """
    lengths = packed.groupBy("length").count()

    def bounds(table: pa.Table) -> pa.Table:
        sizes, counts = (table.column(c).to_numpy() for c in ("length", "count"))
        found = lower_bound(sizes, capacity, counts)
        return pa.table({"length_bound": pa.array([-(-int((sizes * counts).sum()) // capacity)], pa.int64()), "bound": pa.array([found], pa.int64())})

    found = lengths.groupBy().applyInArrow(bounds, "length_bound long, bound long")
    used = packed.agg(F.countDistinct("sequence_id").alias("sequences"))
    both = used.unionByName(found, allowMissingColumns=True).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("sequences", "length_bound", "bound")])
    return both.withColumn("certified", F.col("sequences") == F.col("bound"))
