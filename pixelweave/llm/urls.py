"""URL filters: listed rules, and a path-template tree per host, in SQL functions only.

A rule is (host, path, verdict): it fits its host and all subdomains if the
url's path starts with the rule's; the longest fitting rule decides.

Urls that no rule fits are judged by their template. Segments of a path that
look like numbers or long hexadecimal ids become shapes. Then, from the root of
each host down, every node's branches are compared with the pool of all its
branches, in two ways:

- what follows: the chi-square statistic of the branch's next segments against
  the pool's shares is within ``z`` standard deviations of its mean (one less
  than the pool's kinds of next segment);
- labels: of the branch's urls that a rule decides, the blocked lie within ``z``
  standard errors of the pool's share, smoothed by a url of either kind.

Branches that pass both can't be told apart and become one wildcard; the others
keep their names. So a segment that varies freely is generalised at any number
of branches, and one that leads elsewhere, or is labelled otherwise, stands
alone. Each template's labelled purity, the share of blocked among labelled urls
smoothed by ``weight`` urls of even odds, rejects it from ``purity`` on. Urls
without a label thus share the verdict of labelled ones that their template
can't be told from, and a template without labels is allowed. The tree goes
as deep as any path does, a step for every level of segments.

The tree is built from counts per host and shape of path, so a host with a
third of all urls is counted before it is shuffled, and no group of urls is
gathered into one task.

Defined cases: a null url, or one without ``://``, has empty host and path and
no rule; it is judged like any other url of the empty host. Repeated rows count
each. A null page_id is kept. A long url has as many levels as segments. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, pick

#: (host, path, verdict)
Rule = tuple[str, str, str]

RULES: list[Rule] = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
Z, PURITY, WEIGHT = 3.0, 0.8, 4.0
#: What follows a path's last segment.
END = "{end}"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG_HEX, DIGITS = "^[0-9a-fA-F-]{16,}$", "[0-9]+"


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path): empty strings where there is none."""
    scheme = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(scheme > 0, F.substring(url, scheme + 3, F.length(url))).otherwise(F.lit(""))
    raw_host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw_host) + 1, F.length(url)), "^[^?#]*", 0)
    return F.translate(raw_host, UPPER, LOWER), F.coalesce(path, F.lit(""))


def first_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    return F.when(segment.rlike(LONG_HEX), F.lit("{x}")).otherwise(F.regexp_replace(segment, DIGITS, "{n}"))


def judge(pages: DataFrame, rules: Sequence[Rule] = tuple(RULES), z: float = Z, purity: float = PURITY, weight: float = WEIGHT) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every url."""
    host, path = parse(F.col("url"))
    rows = pick(pages, ["page_id", "url"]).select("page_id", host.alias("host"), path.alias("path"))
    rule, listed = first_rule(rules, F.col("host"), F.col("path"))
    segments = F.transform(F.filter(F.split("path", "/", -1), lambda x: x != ""), shape)
    rows = rows.withColumn("rule", rule).withColumn("listed", listed).withColumn("shapes", F.concat_ws("/", segments))
    counts = rows.groupBy("host", "shapes").agg(F.count("*").cast("double").alias("n"), F.count(F.when(F.col("listed") == "allow", 1)).cast("double").alias("a"), F.count(F.when(F.col("listed") == "block", 1)).cast("double").alias("b"))
    tree = materialise(counts.withColumn("node", F.lit("")), "url-tree")
    depth = tree.agg(F.max(_size())).first()[0] or 0
    for level in range(depth):
        tree = materialise(_descend(tree, level, z), "url-tree")
    templates = tree.groupBy("host", "node").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    smoothed = (F.col("tb") + F.lit(weight / 2)) / (F.col("ta") + F.col("tb") + F.lit(weight))
    verdicts = templates.select("host", "node", F.when(smoothed >= purity, "block").otherwise("allow").alias("learned"))
    by_shape = tree.join(verdicts, ["host", "node"]).select("host", "shapes", F.col("node").alias("template"), "learned")
    return rows.join(by_shape, ["host", "shapes"]).select("page_id", "host", "path", "rule", F.coalesce("listed", "learned").alias("verdict"), "template")


def _size() -> Column:
    """How many segments a path has."""
    return F.when(F.col("shapes") == "", 0).otherwise(F.size(F.split("shapes", "/", -1)))


def _descend(tree: DataFrame, level: int, z: float) -> DataFrame:
    """Moves every path one segment down, to a named branch or the node's wildcard."""
    parts = F.split("shapes", "/", -1)
    segment = lambda k: F.when(_size() > k, F.element_at(parts, k + 1))
    at = tree.withColumn("segment", segment(level)).withColumn("next", F.coalesce(segment(level + 1), F.lit(END)))
    kinds = at.where("segment IS NOT NULL").groupBy("host", "node", "segment", "next").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b")])
    branches = kinds.groupBy("host", "node", "segment").agg(F.sum("n").alias("bn"), F.sum("a").alias("ba"), F.sum("b").alias("bb"))
    follows = kinds.groupBy("host", "node", "next").agg(F.sum("n").alias("pc"))
    pools = branches.groupBy("host", "node").agg(F.count("*").alias("branches"), F.sum("bn").alias("pn"), F.sum("ba").alias("pa"), F.sum("bb").alias("pb"))
    wide = follows.groupBy("host", "node").agg((F.count("*") - 1).cast("double").alias("free"))
    # sum of (seen - expected)^2 / expected over all kinds is the sum of seen^2 / expected over those seen, less the total
    squares = kinds.join(follows, ["host", "node", "next"]).groupBy("host", "node", "segment").agg(F.sum(F.col("n") * F.col("n") / F.col("pc")).alias("squares"))
    share = (F.col("pb") + 1) / (F.col("pa") + F.col("pb") + 2)
    labelled = F.col("ba") + F.col("bb")
    same_labels = F.abs(F.col("bb") - labelled * share) <= z * F.sqrt(labelled * share * (1 - share)) + labelled * F.lit(1.0) / (F.col("pa") + F.col("pb") + 2) + 1e-9
    chi = F.col("squares") * F.col("pn") / F.col("bn") - F.col("bn")
    same_follow = chi <= F.col("free") + z * F.sqrt(2 * F.col("free")) + 1e-9 * F.col("bn")
    named = branches.join(squares, ["host", "node", "segment"]).join(pools, ["host", "node"]).join(wide, ["host", "node"])
    steps = named.select("host", "node", "segment", F.concat("node", F.lit("/"), F.when((F.col("branches") > 1) & same_labels & same_follow, "*").otherwise(F.col("segment"))).alias("down"))
    moved = at.join(steps, ["host", "node", "segment"], "left")
    return moved.select("host", "shapes", "n", "a", "b", F.coalesce("down", "node").alias("node"))


def oracle(rules: Sequence[Rule] = tuple(RULES), depth: int = 8, z: float = Z, purity: float = PURITY, weight: float = WEIGHT) -> str:
    """The same as DuckDB SQL, for tables whose paths have at most ``depth`` segments; one that is deeper fails."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p, _ in ordered]
    pick_first = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values, strict=True)) + " END" if fits else "NULL"
    segment = lambda k: f"CASE WHEN shapes <> '' AND len(string_split(shapes, '/')) > {k} THEN string_split(shapes, '/')[{k + 1}] END"
    share = "((pb + 1) / (pa + pb + 2))"
    levels = "".join(
        f"""
        at{k} AS (SELECT *, {segment(k)} AS segment, coalesce({segment(k + 1)}, '{END}') AS next FROM tree{k}),
        kind{k} AS (SELECT host, node, segment, next, sum(n) n, sum(a) a, sum(b) b FROM at{k} WHERE segment IS NOT NULL GROUP BY ALL),
        kid{k} AS (SELECT host, node, segment, sum(n) bn, sum(a) ba, sum(b) bb FROM kind{k} GROUP BY ALL),
        follow{k} AS (SELECT host, node, next, sum(n) pc FROM kind{k} GROUP BY ALL),
        pool{k} AS (SELECT host, node, count(*) branches, sum(bn) pn, sum(ba) pa, sum(bb) pb FROM kid{k} GROUP BY ALL),
        wide{k} AS (SELECT host, node, (count(*) - 1)::DOUBLE AS free FROM follow{k} GROUP BY ALL),
        chi{k} AS (SELECT host, node, segment, sum(n * n / pc) AS squares FROM kind{k} JOIN follow{k} USING (host, node, next) GROUP BY ALL),
        step{k} AS (SELECT host, node, segment, node || '/' || CASE WHEN branches > 1
              AND abs(bb - (ba + bb) * {share}) <= {z}::DOUBLE * sqrt((ba + bb) * {share} * (1 - {share})) + (ba + bb) / (pa + pb + 2) + 1e-9
              AND squares * pn / bn - bn <= free + {z}::DOUBLE * sqrt(2 * free) + 1e-9 * bn THEN '*' ELSE segment END AS down
            FROM kid{k} JOIN chi{k} USING (host, node, segment) JOIN pool{k} USING (host, node) JOIN wide{k} USING (host, node)),
        tree{k + 1} AS (SELECT a.host, a.shapes, a.n, a.a, a.b, coalesce(s.down, a.node) AS node FROM at{k} a LEFT JOIN step{k} s ON a.host = s.host AND a.node = s.node AND a.segment = s.segment),"""
        for k in range(depth)
    )
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM cut),
        parsed AS (SELECT page_id, translate(raw_host, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM raw),
        judged AS (SELECT *, {pick_first([h + p for h, p, _ in ordered])} AS rule, {pick_first([v for _, _, v in ordered])} AS listed,
            array_to_string(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '{LONG_HEX}') THEN '{{x}}' ELSE regexp_replace(x, '{DIGITS}', '{{n}}', 'g') END), '/') AS shapes FROM parsed),
        tree0 AS (SELECT host, CASE WHEN len(string_split(shapes, '/')) > {depth} THEN error('a path is deeper than the oracle') ELSE shapes END AS shapes, count(*)::DOUBLE n, count(CASE WHEN listed = 'allow' THEN 1 END)::DOUBLE a, count(CASE WHEN listed = 'block' THEN 1 END)::DOUBLE b, '' AS node FROM judged GROUP BY host, shapes),{levels}
        template AS (SELECT host, node, sum(a) ta, sum(b) tb FROM tree{depth} GROUP BY ALL),
        learned AS (SELECT host, node, CASE WHEN (tb + {weight / 2}::DOUBLE) / (ta + tb + {weight}::DOUBLE) >= {purity}::DOUBLE THEN 'block' ELSE 'allow' END AS learned FROM template)
    SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.listed, l.learned) AS verdict, t.node AS template
    FROM judged j JOIN tree{depth} t ON j.host = t.host AND j.shapes = t.shapes JOIN learned l ON t.host = l.host AND t.node = l.node"""
