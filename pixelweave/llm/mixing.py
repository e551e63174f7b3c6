"""Mixing sources to target weights by Sainte-Lague apportionment, in SQL functions only.

Targets: sources in code point order (null last) have ``weights`` in turn and
share ``volume`` times all words; no target passes ``limit`` times its source,
and what that frees is shared again by weight (a water level, found in closed
form from running sums over the sources).

Seats: the table seats blocks of equal words once: each source's target
competes with the quotients target / 1, target / 3, target / 5, ... and the
highest get a block. Only seats that rounding can decide are ranked; the seats
that a source is sure of are counted, so a few rows per source are ranked
however many blocks.

Selection: a source's documents lie in the order of a seeded hash as a line of
words, cut into blocks. Whole passes over the line come first, and the blocks
left are taken in a row from a seeded block on, around the end.

Shards are ranges of the hash and only split the work: a shard sums its stretch
of each line, and the stretches before it give the place where its own begins.
So the result is the same for any number of shards, and nothing is rounded in a
shard.

Defined cases: a null or empty text has size 0 and takes nothing. Null doc_ids
are dealt by their text. Repeated rows are placed each; rows of equal doc_id lie
by size and a hash of their text, and equal rows are interchangeable, so a rerun
gives the same rows. Rows that share a doc_id, or a null one and a text, lie in
one shard, which is sorted on disk if it is large; rows of size 0 take up no
place in a line, so they are spread over all shards, whatever their id. An empty table gives an empty
result. Extra columns stay if named in ``keep``, and are ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise, named, pick

WEIGHTS, VOLUME, LIMIT = (5, 2, 1), 1.5, 2
BLOCK_WORDS, SHARD_DOCS, SEED = 16, 1000, 7


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _draw(*parts: Column) -> Column:
    """A seeded number below 2^32 from the md5 of text parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def _shard(shards: int, seed: int) -> tuple[Column, Column]:
    """(deal, shard): the hash by which a row lies in its line, and the range of it that the row is worked on in."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.col("nameless"), F.lit(""))
    deal = F.md5(F.concat_ws("|", F.lit(str(seed)), name).cast("binary"))
    by_deal = F.shiftright(F.conv(F.substring(deal, 1, 8), 16, 10).cast("long") * shards, 32)
    return deal, F.when(F.col("size") > 0, by_deal).otherwise(F.monotonically_increasing_id() % shards)


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, volume: float = VOLUME, limit: float = LIMIT) -> DataFrame:
    """source, place, source_size, n_docs, weight and target of each source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())  # one row a source, in one task
    ranked = sources.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.lit(float(weights[-1]))
    for k, w in enumerate(weights):
        weight = F.when(F.col("place") % len(weights) == k, F.lit(float(w))).otherwise(weight)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(limit)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    filling = W.orderBy("ratio", "place")
    level = (
        ranked.withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.lit(float(volume)) * F.col("all_words") - F.col("full")) / F.col("open"))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("water", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("water") * F.col("weight"))
    return level.select("source", "place", "source_size", "n_docs", "weight", target.alias("target"))


def shard_quotas(lines: DataFrame, block: int = BLOCK_WORDS, limit: float = LIMIT) -> DataFrame:
    """Words taken of each source in groups seated alone: ``lines`` has shard (the group), place, line (words) and share (target)."""
    shard = W.partitionBy("shard")
    totals = (
        lines.withColumn("all_share", F.sum("share").over(shard.orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))  # in one order, so sums round alike
        .withColumn("n_sources", F.count("*").over(shard))
        .withColumn("seats", F.greatest(F.lit(1.0), F.round(F.col("all_share") / block)))
        .withColumn("part", F.when(F.col("all_share") > 0, F.col("share") / F.col("all_share")).otherwise(F.lit(0.0)))
        .withColumn("sure", F.greatest(F.lit(0.0), F.ceil(F.col("part") * (F.col("seats") - F.col("n_sources") / 2) - 0.5)).cast("long"))
        .withColumn("most", F.greatest(F.col("sure"), F.ceil(F.col("part") * (F.col("seats") + F.col("n_sources") / 2) + 0.5).cast("long")))
        .withColumn("contested", F.col("seats").cast("long") - F.sum("sure").over(shard))
    )
    rivals = totals.where("share > 0").withColumn("seat", F.explode(F.sequence(F.col("sure"), F.col("most"))))
    by_quotient = W.partitionBy("shard").orderBy((F.col("share") / (2 * F.col("seat") + 1)).desc(), "place")
    won = rivals.withColumn("rank", F.row_number().over(by_quotient)).where("rank <= contested").groupBy("shard", "place").agg(F.count("*").alias("won"))
    words = F.least((F.col("sure") + F.coalesce("won", F.lit(0))) * block, (F.col("line") * limit).cast("long"))
    return totals.join(won, ["shard", "place"], "left").select("shard", "place", "line", words.alias("quota"))


def mix(docs: DataFrame, keep: Sequence[str] = (), weights: Sequence[float] = WEIGHTS, volume: float = VOLUME, limit: int = LIMIT, block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """doc_id, ``keep``, size, source_size, target and taken of every document."""
    places = [f"kept_{k}" for k in range(len(keep))]
    text = F.col("text").cast("binary")
    counted = pick(docs, ["doc_id", "source", "text"], keep).select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size"), F.when(F.col("doc_id").isNull(), F.md5(text)).alias("nameless"), F.xxhash64(text).alias("mark"), *places)
    sized = materialise(counted.drop(*places), "sizes")
    targets = materialise(source_targets(sized, weights, volume, limit), "targets")
    shards = max(1, -(-(targets.agg(F.sum("n_docs")).first()[0] or 0) // shard_docs))
    deal, shard = _shard(shards, seed)
    share = F.when(F.col("source_size") > 0, F.col("target") * F.col("source_size") / F.col("source_size")).otherwise(F.lit(0.0))  # rounds as the SQL does
    seated = materialise(shard_quotas(targets.select(F.lit(0).alias("shard"), "place", F.col("source_size").alias("line"), share.alias("share")), block, limit), "quotas")
    drawn = F.when(F.col("line") > 0, _draw(F.lit(str(seed)), F.lit("0"), F.col("place").cast("string")) % F.ceil(F.col("line") / block) * block).otherwise(F.lit(0))
    quotas = targets.join(seated.select("place", "line", "quota", drawn.alias("first")), "place")
    # a row per source, written so that its true size decides whether it is broadcast
    quotas = materialise(quotas.select(F.col("source").alias("of"), "place", "source_size", "target", "line", "quota", "first"), "shares")

    def place(rows: DataFrame) -> DataFrame:
        return rows.withColumn("deal", deal).withColumn("shard", shard).join(quotas, F.col("source").eqNullSafe(F.col("of")))

    before = W.partitionBy("place").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row per shard
    stretches = place(sized.where("size > 0")).groupBy("shard", "place").agg(F.sum("size").alias("stretch"))
    starts = materialise(stretches.select(F.col("shard").alias("s_shard"), F.col("place").alias("s_place"), F.coalesce(F.sum("stretch").over(before), F.lit(0)).alias("start")), "starts")
    order = W.partitionBy("shard", "place").orderBy("deal", "doc_id", "size", "mark").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = place(counted if keep else sized).withColumn("upto", F.sum("size").over(order))
    met = laid.join(starts, (F.col("shard") == F.col("s_shard")) & (F.col("place") == F.col("s_place")), "left")  # rows of size 0 may have no start
    met = met.withColumn("end", F.coalesce("start", F.lit(0)) + F.col("upto")).withColumn("begin", F.col("end") - F.col("size"))
    passes = F.when(F.col("line") > 0, F.floor(F.col("quota") / F.col("line"))).otherwise(F.lit(0)).cast("long")
    met = met.withColumn("passes", passes).withColumn("last", F.col("first") + F.col("quota") - F.col("passes") * F.col("line"))

    def shared(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("end"), b) - F.greatest(F.col("begin"), a))

    taken = F.col("passes") * F.col("size") + shared(F.col("first"), F.least("last", "line")) + shared(F.lit(0), F.col("last") - F.col("line"))
    return met.select("doc_id", *named(keep), "size", "source_size", "target", taken.cast("long").alias("taken"))


def oracle(weights: Sequence[float] = WEIGHTS, volume: float = VOLUME, limit: int = LIMIT, block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> str:
    """``mix`` of the table documents as DuckDB SQL.

    Each shard is seated alone here, so it equals ``mix`` where ``shard_docs`` makes one shard of the table.
    """
    turns = " ".join(f"WHEN {k} THEN {float(w)}" for k, w in enumerate(weights))
    drawn = "CAST('0x' || substr({0}, 1, 8) AS BIGINT)"
    share = "greatest(0, least(l.{1}, {3}) - greatest(l.{0}, {2}))"
    return f"""
    WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}')) AS size, md5('{seed}|' || coalesce(doc_id::VARCHAR, md5(text), '')) AS deal FROM documents),
        sources AS (SELECT source, sum(size)::DOUBLE AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
        named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sources),
        capped AS (SELECT *, (CASE place % {len(weights)} {turns} END)::DOUBLE AS weight, {limit} * source_size AS cap FROM named),
        ordered AS (SELECT *, cap / weight AS ratio FROM capped),
        levels AS (SELECT *, ({volume}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ordered),
        targets AS (SELECT source, place, source_size, CASE WHEN ratio <= level THEN cap ELSE max(CASE WHEN ratio > level THEN level END) OVER () * weight END AS target FROM levels),
        placed AS (SELECT d.doc_id, d.size, d.deal, t.place, t.source_size, t.target, {drawn.format("d.deal")} % greatest(1, (SELECT CAST(ceil(count(*) / {shard_docs}::DOUBLE) AS BIGINT) FROM documents)) AS shard FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
        lines AS (SELECT shard, place, sum(size) AS line, CASE WHEN any_value(source_size) > 0 THEN any_value(target) * sum(size) / any_value(source_size) ELSE 0 END AS share FROM placed GROUP BY shard, place),
        totals AS (SELECT *, sum(share) OVER (PARTITION BY shard ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS all_share, count(*) OVER (PARTITION BY shard) AS n_sources FROM lines),
        seated AS (SELECT *, greatest(1, round(all_share / {block})) AS seats, CASE WHEN all_share > 0 THEN share / all_share ELSE 0 END AS part FROM totals),
        sure AS (SELECT *, greatest(0, ceil(part * (seats - n_sources / 2) - 0.5::DOUBLE))::BIGINT AS sure FROM seated),
        wide AS (SELECT *, greatest(sure, ceil(part * (seats + n_sources / 2) + 0.5::DOUBLE)::BIGINT) AS most, seats::BIGINT - sum(sure) OVER (PARTITION BY shard) AS contested FROM sure),
        rivals AS (SELECT shard, place, share, contested, unnest(range(sure, most + 1)) AS seat FROM wide WHERE share > 0),
        ranks AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY share / (2 * seat + 1) DESC, place) AS nth FROM rivals),
        won AS (SELECT shard, place, count(*) AS won FROM ranks WHERE nth <= contested GROUP BY shard, place),
        quotas AS (SELECT w.shard, w.place, w.line, least((w.sure + coalesce(won.won, 0)) * {block}, w.line * {limit}) AS quota FROM wide w LEFT JOIN won USING (shard, place)),
        starts AS (SELECT *, CASE WHEN line > 0 THEN {drawn.format(f"md5('{seed}|' || shard || '|' || place)")} % CAST(ceil(line / {block}::DOUBLE) AS BIGINT) * {block} ELSE 0 END AS first, CASE WHEN line > 0 THEN quota // line ELSE 0 END AS passes FROM quotas),
        laid AS (SELECT *, sum(size) OVER (PARTITION BY shard, place ORDER BY deal, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until FROM placed),
        l AS (SELECT a.*, a.until - a.size AS since, s.line, s.quota, s.first, s.passes, s.first + s.quota - s.passes * s.line AS last FROM laid a JOIN starts s ON a.shard = s.shard AND a.place = s.place)
    SELECT doc_id, size, source_size::BIGINT AS source_size, target, CAST(passes * size + {share.format("since", "until", "first", "least(last, line)")} + {share.format("since", "until", "0", "last - line")} AS BIGINT) AS taken FROM l"""
