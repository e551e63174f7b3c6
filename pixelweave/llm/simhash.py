"""SimHash near-duplicates by multi-index hashing.

A fingerprint bit is set if more than half of a text's shingle hashes have it.
Texts link at ``radius`` or fewer differing bits; components follow links.

Candidate search: the 64 bits are cut into ``segments``. With radius r and m
segments, r = m q + a, two fingerprints within r bits differ in at most q bits
in one of the first a + 1 segments or in at most q - 1 bits in another. Each
distinct fingerprint is filed under its segments, and looked up under every
segment value inside those small Hamming balls; a table match is verified on
all 64 bits. Tables are dealt by (segment, value). Values that more than
``CROWDED`` fingerprints share are counted first, and the tables these
fingerprints are filed or looked up in are dealt in parts instead: by value and
each of r + 1 cuts of the other bits, in one of which any link is equal. So a
value that a third of all fingerprints share is spread over many tasks. Within a
task a long table is cut again by the same rule, and what is left is searched
breadth-first: what a frontier reaches leaves the pool, so a dense group costs a
few sweeps instead of all pairs. Each task returns a spanning forest of the
links it finds, and the components are taken from the forests together.

Exact copies share a fingerprint and are one node, so any number of them costs
one row. Defined cases: a null or empty text or one without words has
fingerprint zero and links like any other; fewer words than a shingle: the
whole sequence is the shingle; repeated rows and ties share a component; a null
doc_id takes part but never names a component (null if no member has an id); an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from .common import materialise, narrow_rows, slices, tune_arrow, whole

SEED = 42
RADIUS, SEGMENTS, SHINGLE = 4, 3, 4
#: Rows of a table up to which tables are compared together, and beyond which a table is cut again.
SMALL_TABLE, TABLE_ROWS = 64, 4096
#: Fingerprints of one segment value beyond which its tables are dealt in parts.
CROWDED = 1 << 16
#: Marks the key of a part, below the segment's number.
PART = 1 << 59
#: Cells of one distance block, and rows that a task gathers before it works.
BLOCK, STEP_ROWS = 1 << 22, 1 << 18


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """The fingerprint of lower-cased words."""
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(text, SEED)
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(text)]
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts[:n], ends[shingle - 1 :], strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long, of every whole text."""
    tune_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty(len(batch), np.uint64)
            for at, part in slices(batch.column(1)):
                for i, text in enumerate(part.cast(pa.large_binary()).to_pylist()):
                    found[at + i] = fingerprint(text.lower().split(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return whole(docs).mapInArrow(run, "doc_id long, fp long")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    cut = [64 * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def ball_radii(radius: int, segments: int) -> list[int]:
    """The radius that must be searched in each segment; -1: none."""
    q, a = divmod(radius, segments)
    return [q if k <= a else q - 1 for k in range(segments)]


def ball(width: int, radius: int) -> list[int]:
    """All masks of up to ``radius`` of ``width`` bits."""
    return [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _sweep(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of all links among ``fps``, breadth-first.

    What a frontier reaches leaves the pool at once, so pairs inside a dense
    group are never compared.
    """
    links, pool = [], np.arange(len(fps))
    while len(pool):
        frontier, pool = pool[:1], pool[1:]
        while len(frontier) and len(pool):
            step = max(1, BLOCK // len(pool))
            own, frontier_next = frontier[:step], [frontier[step:]]
            near = _distance(fps[own], fps[pool]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                parent = own[near[:, hit].argmax(axis=0)]
                child = pool[hit]
                links += zip(parent.tolist(), child.tolist(), strict=True)
                frontier_next.append(child)
                pool = pool[~hit]
            frontier = np.concatenate(frontier_next)
    return links


def _within(fps: np.ndarray, radius: int, used: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct ``fps``.

    Small sets are swept. Larger ones are first filed by five segments of the
    bits outside ``used`` (a mask of bits already shared), equality in one of
    which any link needs at radius 4, and each file is searched in turn; the
    forest joins what they find. A file that a cut doesn't make smaller is swept.
    """
    if len(fps) <= TABLE_ROWS:
        return _sweep(fps, radius)
    free = [b for b in range(64) if not used >> b & 1]
    parts = radius + 1
    if len(free) < 2 * parts:
        return _sweep(fps, radius)
    forest, links = Forest(len(fps)), []
    for k in range(parts):
        mask = sum(1 << b for b in free[k::parts])
        key = fps & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        bounds = np.flatnonzero(np.diff(key[order])) + 1
        for own in np.split(order, bounds):
            if len(own) < 2:
                continue
            roots = {forest.root(int(i)) for i in own}
            if len(roots) == 1:
                continue
            found = _within(fps[own], radius, used | mask) if len(own) < 0.9 * len(fps) else _sweep(fps[own], radius)
            for i, j in found:
                a, b = int(own[i]), int(own[j])
                if forest.join(a, b):
                    links.append((a, b))
    return links


def _match_tables(radius: int, segments: int):
    """Links among the rows of each table; rows come sorted by table."""
    bounds_of = segment_bounds(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if not len(batch):
                continue
            rest.append(batch)
            held += len(batch)
            if held < STEP_ROWS:
                continue
            rows = pa.Table.from_batches(rest).combine_chunks()
            key = np.asarray(rows.column(0))
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield from emit(rows.slice(0, cut))
            rest = rows.slice(cut).combine_chunks().to_batches()
            held = min(len(rows) - cut, STEP_ROWS // 2)  # a table longer than a step is gathered a step at a time
        if rest:
            yield from emit(pa.Table.from_batches(rest))

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, fps = np.asarray(rows.column(0)), np.asarray(rows.column(1)).view(np.uint64)
        exact = np.asarray(rows.column(2))
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        sizes = np.diff(bounds)
        links: list[np.ndarray] = []
        # tables of a few rows, all at once: compare each row with the next, the next but one, ...
        left = np.repeat(np.where(sizes <= SMALL_TABLE, sizes, 0), sizes) - (np.arange(len(key)) - np.repeat(bounds[:-1], sizes)) - 1
        at = np.flatnonzero(left > 0)
        for d in range(1, SMALL_TABLE):
            at = at[left[at] >= d]
            if not len(at):
                break
            near = (exact[at] | exact[at + d]) & (np.bitwise_count(fps[at] ^ fps[at + d]) <= radius)
            links.append(np.stack([fps[at[near]], fps[at[near] + d]]))
        for t in np.flatnonzero(sizes > SMALL_TABLE):
            own = fps[bounds[t] : bounds[t + 1]]
            if exact[bounds[t] : bounds[t + 1]].any():  # only then is anything filed here
                first, width = bounds_of[int(key[bounds[t]]) >> 60]
                found = np.array(_within(own, radius, ((1 << width) - 1) << first), np.int64).reshape(-1, 2)
                links.append(np.stack([own[found[:, 0]], own[found[:, 1]]]))
        pairs = np.concatenate(links, axis=1) if links else np.empty((2, 0), np.uint64)
        if pairs.shape[1]:
            nodes, places = np.unique(pairs, return_inverse=True)
            places, forest = places.reshape(2, -1), Forest(len(nodes))
            kept = np.array([forest.join(i, j) for i, j in zip(*places.tolist(), strict=True)])
            src, dst = pairs[:, kept].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return run


def _probe(key: Column, segment: int):
    """The table that a mask leads to: the segment above the value."""
    return lambda mask: F.struct(key.bitwiseXOR(mask).bitwiseOR(F.lit(segment << 60)).alias("key"), (mask == 0).alias("exact"))


def _cuts(radius: int, first: int, width: int) -> list[int]:
    """Masks of ``radius`` + 1 disjoint parts of the bits outside a segment, as signed longs."""
    free = [b for b in range(64) if not first <= b < first + width]
    masks = [sum(1 << b for b in free[k :: radius + 1]) for k in range(radius + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _in_parts(rows: DataFrame, radius: int, segments: int) -> DataFrame:
    """Rows of tables, filed under the table and the bits of each cut instead; parts that share a hash are compared in vain."""
    parts = None
    for k, (first, width) in enumerate(segment_bounds(segments)):
        keys = [F.xxhash64("key", F.lit(i), F.col("fp").bitwiseAND(F.lit(m))).bitwiseAND(F.lit(PART - 1)).bitwiseOR(F.lit(k << 60 | PART)) for i, m in enumerate(_cuts(radius, first, width))]
        here = F.shiftright("key", 60) == k
        parts = F.when(here, F.array(*keys)) if parts is None else parts.when(here, F.array(*keys))
    return rows.select(F.explode(parts).alias("key"), "fp", "exact")


def links(nodes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """Links (src, dst) that span the components of ``nodes`` (fp), which are distinct."""
    bounds, radii = segment_bounds(segments), ball_radii(radius, segments)
    files, probes, around = [], [], None
    for k, ((first, width), r) in enumerate(zip(bounds, radii, strict=True)):
        if r >= 0:
            value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
            masks = F.array(*[F.lit(m).cast("long") for m in ball(width, r)])
            files.append(value.bitwiseOR(F.lit(k << 60)))
            probes.append(F.transform(masks, _probe(value, k)))
            met, here = F.transform(masks, lambda m: F.col("key").bitwiseXOR(m)), F.shiftright("key", 60) == k
            around = F.when(here, met) if around is None else around.when(here, met)
    # one row for each value and map task is shuffled; a table outside these holds at most ``crowded`` rows for each mask
    counts = nodes.select(F.explode(F.array(*files)).alias("key")).groupBy("key").count()
    hot = materialise(counts.where(F.col("count") > crowded).select(F.explode(around).alias("key")).distinct(), "crowded")
    spread = nodes.select("fp", F.explode(F.concat(*probes)).alias("p")).select("p.key", "fp", "p.exact")
    tables = spread.join(hot, "key", "left_anti").unionByName(_in_parts(spread.join(hot, "key", "left_semi"), radius, segments))
    dealt = tables.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_match_tables(radius, segments), "src long, dst long")


def label(nodes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """``nodes``, whose fp are distinct, with the root of each one's component."""
    nodes = materialise(nodes, "nodes")
    with narrow_rows(nodes.sparkSession):
        found = materialise(links(nodes.select("fp"), radius, segments, crowded), "links")
    members = connected_components(found, "src", "dst", workspace=materialise)
    return nodes.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    labelled = label(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), radius, segments)
    smallest = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_print = labelled.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
