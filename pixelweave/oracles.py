"""SQL of the raster queries, as DuckDB runs it over the same tables."""

from __future__ import annotations

from .sources import rasters

W, H = rasters.FRAME_WIDTH, rasters.FRAME_HEIGHT
AREA = W * H
KINDS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rasters.EVENT_CODES.items())

EV = f"""ev AS (SELECT event_id // {AREA} AS image_id, CAST(event_id % {W} AS INTEGER) AS x, CAST((event_id % {AREA}) // {W} AS INTEGER) AS y,
    CAST(floor(least(value, 255::DOUBLE)) AS INTEGER) AS c0, CAST(user_id % 256 AS INTEGER) AS c1, CAST(CASE event_type {KINDS} ELSE 0 END AS INTEGER) AS c2,
    CAST((event_id % {AREA}) // {W} AS BIGINT) * {W} + event_id % {W} AS g FROM events)"""


def grey(step: int, name: str = "px") -> str:
    return f"{name} AS (SELECT image_id, x, y, g, c0 // {step} AS c0, c0 // {step} AS c1, c0 // {step} AS c2 FROM ev)"


def edges(name: str, source: str, colours: tuple[str, ...] = ("c0", "c1", "c2")) -> str:
    d = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in colours)
    return f"{name} AS (SELECT p.image_id, p.g AS a, q.g AS b, {d} AS d FROM {source} p JOIN {source} q ON p.image_id = q.image_id AND ((q.x = p.x - 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y - 1)))"


def roots(name: str, nodes: str, pairs: str) -> str:
    """``name`` (image_id, g, root): the smallest node that each of ``nodes`` (image_id, g) reaches over ``pairs`` (image_id, a, b)."""
    return f"""{name}_s AS (SELECT image_id, a, b FROM ({pairs}) UNION SELECT image_id, b, a FROM ({pairs})),
    {name}_r(image_id, g, r) AS (SELECT image_id, g, g FROM {nodes} UNION SELECT s.image_id, s.b, t.r FROM {name}_r t JOIN {name}_s s ON s.image_id = t.image_id AND s.a = t.g WHERE t.r < s.b),
    {name} AS (SELECT image_id, g, min(r) AS root FROM {name}_r GROUP BY image_id, g)"""


def labels(name: str, nodes: str, pairs: str) -> str:
    return f"""{roots(f"{name}_root", nodes, pairs)},
    {name} AS (SELECT image_id, g, dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS label FROM {name}_root)"""


def parents(name: str, source: str, radius: int, limit: str, device: bool = False) -> str:
    d = " + ".join(f"(q.c{k} - p.c{k}) * (q.c{k} - p.c{k})" for k in range(3))
    up, left, order = ("AND q.y > 0", "AND q.x > 0", "d, p") if device else ("", "", "d, r, side")
    return f"""{name}_c AS (SELECT p.image_id, p.g, q.g AS p, CAST({d} AS DOUBLE) AS d, CASE WHEN q.x = p.x THEN q.y - p.y ELSE q.x - p.x END AS r, CASE WHEN q.x = p.x THEN 0 ELSE 1 END AS side
        FROM {source} p JOIN {source} q ON p.image_id = q.image_id AND ((q.x = p.x AND q.y BETWEEN p.y - {radius} AND p.y - 1 {up}) OR (q.y = p.y AND q.x BETWEEN p.x - {radius} AND p.x - 1 {left}))),
    {name}_b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, g ORDER BY {order}) AS nth FROM {name}_c) WHERE nth = 1),
    {name} AS (SELECT s.image_id, s.g, CASE WHEN b.d < {limit}::DOUBLE THEN b.p ELSE s.g END AS p FROM {source} s LEFT JOIN {name}_b b ON s.image_id = b.image_id AND s.g = b.g)"""


def shifted(steps: int, radius: int, limit: float) -> str:
    """s0 to s<steps>: the states of the mean shift over ``ev``."""
    out = ["s0 AS (SELECT image_id, x, y, g, c0 * 100::DOUBLE / 255::DOUBLE AS l, c1 - 128::DOUBLE AS u, c2 - 128::DOUBLE AS v, CAST(x AS BIGINT) AS ix, CAST(y AS BIGINT) AS iy, 5::DOUBLE AS shift, 0 AS steps FROM ev)"]
    for k in range(steps):
        dl, du, dv = f"(q.c0 * 100::DOUBLE / 255::DOUBLE - s.l)", f"(q.c1 - 128::DOUBLE - s.u)", f"(q.c2 - 128::DOUBLE - s.v)"
        out.append(f"""a{k} AS (SELECT s.image_id, s.g, count(*)::DOUBLE AS n, sum(q.c0)::DOUBLE AS t0, sum(q.c1)::DOUBLE AS t1, sum(q.c2)::DOUBLE AS t2, sum(q.x)::DOUBLE AS tx, sum(q.y)::DOUBLE AS ty
            FROM s{k} s JOIN ev q ON q.image_id = s.image_id AND q.x BETWEEN s.x - {radius} AND s.x + {radius} AND q.y BETWEEN s.y - {radius} AND s.y + {radius}
            WHERE s.shift > 3 AND {dl} * {dl} + {du} * {du} + {dv} * {dv} <= {limit}::DOUBLE GROUP BY s.image_id, s.g)""")
        out.append(f"m{k} AS (SELECT image_id, g, t0 * 100::DOUBLE / 255::DOUBLE / n AS l, t1 / n - 128::DOUBLE AS u, t2 / n - 128::DOUBLE AS v, CAST(floor(tx / n) AS BIGINT) + 1 AS ix, CAST(floor(ty / n) AS BIGINT) + 1 AS iy FROM a{k})")
        shift = "CAST((m.ix - s.ix) * (m.ix - s.ix) + (m.iy - s.iy) * (m.iy - s.iy) AS DOUBLE) + (m.l - s.l) * (m.l - s.l) + (m.u - s.u) * (m.u - s.u) + (m.v - s.v) * (m.v - s.v)"
        out.append(f"s{k + 1} AS (SELECT s.image_id, s.x, s.y, s.g, coalesce(m.l, s.l) AS l, coalesce(m.u, s.u) AS u, coalesce(m.v, s.v) AS v, coalesce(m.ix, s.ix) AS ix, coalesce(m.iy, s.iy) AS iy, CASE WHEN m.g IS NULL THEN s.shift ELSE {shift} END AS shift, s.steps + CASE WHEN m.g IS NULL THEN 0 ELSE 1 END AS steps FROM s{k} s LEFT JOIN m{k} m ON s.image_id = m.image_id AND s.g = m.g)")
    return ",\n    ".join(out)


def smooth(radius: int, limit: float) -> str:
    return f"{shifted(5, radius, limit)},\n    sm AS (SELECT image_id, x, y, g, l * 255::DOUBLE / 100::DOUBLE AS c0, u + 128::DOUBLE AS c1, v + 128::DOUBLE AS c2, steps FROM s5)"


COLOURS = "((label * 19088743) & 4294967295 & 16711680) >> 4 AS red, ((label * 19088743) & 4294967295 & 65280) >> 2 AS green, (label * 19088743) & 255 AS blue"
GRADE = "CASE WHEN {0} IS NULL OR isnan({0}) THEN 4 WHEN {0} >= 0.1::DOUBLE THEN 0 WHEN {0} >= 0.05::DOUBLE THEN 1 WHEN {0} >= 0.01::DOUBLE THEN 2 WHEN {0} >= 0.005::DOUBLE THEN 3 ELSE 4 END"


def shares(graded: str) -> str:
    return f"SELECT CAST(n.range AS INTEGER) AS grade, count(t.grade) AS cnt, round(count(t.grade) / (SELECT count(*) FROM {graded})::DOUBLE, 6) AS share FROM range(5) n LEFT JOIN {graded} t ON t.grade = n.range GROUP BY n.range"


def merges(rounds: int, distance: float) -> str:
    """t0 to t<rounds>: labels of the merging rounds over ``px``."""
    out = [edges("touch", "px"), "t0 AS (SELECT image_id, g, g AS label FROM px)"]
    for k in range(rounds):
        d = " + ".join(f"(u.m{c} - v.m{c}) * (u.m{c} - v.m{c})" for c in range(3))
        out += [
            f"rt{k} AS (SELECT t.image_id, t.label, " + ", ".join(f"sum(p.c{c})::DOUBLE / count(*) AS m{c}" for c in range(3)) + f" FROM t{k} t JOIN px p USING (image_id, g) GROUP BY t.image_id, t.label)",
            f"ad{k} AS (SELECT DISTINCT e.image_id, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b FROM touch e JOIN t{k} p ON p.image_id = e.image_id AND p.g = e.a JOIN t{k} q ON q.image_id = e.image_id AND q.g = e.b WHERE p.label <> q.label)",
            f"cl{k} AS (SELECT x.image_id, x.a, x.b FROM ad{k} x JOIN rt{k} u ON u.image_id = x.image_id AND u.label = x.a JOIN rt{k} v ON v.image_id = x.image_id AND v.label = x.b WHERE {d} < {distance * distance}::DOUBLE)",
            f"nd{k} AS (SELECT image_id, label AS g FROM rt{k})",
            roots(f"mr{k}", f"nd{k}", f"SELECT * FROM cl{k}"),
            f"t{k + 1} AS (SELECT t.image_id, t.g, dense_rank() OVER (PARTITION BY t.image_id ORDER BY m.root) - 1 AS label FROM t{k} t JOIN mr{k} m ON m.image_id = t.image_id AND m.g = t.label)",
        ]
    return ",\n    ".join(out)


def oracle_sql() -> dict[str, str]:
    from .queries import BALL, CONNECT, FLOOD_RADIUS, FLOOD_RANGE, GREY_STEP, WINDOW

    def q(body: str, *tables: str) -> str:
        return "WITH RECURSIVE " + ",\n    ".join((EV, *tables)) + "\n" + body

    g64, g32 = grey(GREY_STEP), grey(32, "p32")
    e64, e32 = edges("e", "px"), edges("e32", "p32")
    exact = (g64, e64, labels("lab", "px", "SELECT * FROM e WHERE d = 0"))
    ranged = (g32, e32, labels("lab32", "p32", "SELECT * FROM e32 WHERE d < 4"))
    par = parents("par", "px", FLOOD_RADIUS, FLOOD_RANGE)
    flooded = (g64, par, roots("fl", "px", "SELECT image_id, g AS a, p AS b FROM par WHERE g <> p"))
    moves = shifted(5, WINDOW, BALL)
    smoothed = (smooth(WINDOW, BALL), edges("es", "sm"))
    segmented = (*smoothed, labels("lab", "sm", f"SELECT * FROM es WHERE d < {CONNECT}"))
    seeds = (parents("par", "sm", 4, CONNECT / 6), roots("fl", "sm", "SELECT image_id, g AS a, p AS b FROM par WHERE g <> p"))
    seeded = (*smoothed, *seeds, labels("lab", "sm", f"SELECT image_id, a, b FROM es WHERE d < {CONNECT} UNION SELECT image_id, g, root FROM fl WHERE g <> root"))
    corners = ", ".join(str(c) for c in rasters.square_corners(rasters.SCENE_SQUARES, rasters.SCENE_WIDTH, rasters.SCENE_HEIGHT, rasters.SCENE_SIDE))
    near = f"JOIN ev q ON q.image_id = p.image_id AND q.x BETWEEN p.x - {WINDOW} AND p.x + {WINDOW} AND q.y BETWEEN p.y - {WINDOW} AND p.y + {WINDOW}"
    pairs = "pairs AS (SELECT image_id, r.label AS ref, t.label AS test FROM lab r JOIN lab32 t USING (image_id, g)), con AS (SELECT image_id, ref, test, count(*) AS cnt FROM pairs GROUP BY ALL)"
    adj = "adj AS (SELECT DISTINCT e.image_id, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b FROM e JOIN lab p ON p.image_id = e.image_id AND p.g = e.a JOIN lab q ON q.image_id = e.image_id AND q.g = e.b WHERE p.label <> q.label)"
    shade = "least(greatest(floor((value::DOUBLE + 0.5::DOUBLE) * 256), 0), 255)"
    return {
        "raster_scan": q("SELECT image_id, x, y, c0, c1, c2, g, x AS x_back, y AS y_back FROM ev"),
        "embedding_scan": f"""WITH cell AS (SELECT vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings),
            px AS (SELECT vec_id // 3 AS y, x, {", ".join(f"max(CASE WHEN vec_id % 3 = {k} THEN {shade} END) AS c{k}" for k in range(3))} FROM cell GROUP BY 1, 2)
            SELECT 0::BIGINT AS image_id, x::INTEGER AS x, y::INTEGER AS y, c0::INTEGER AS c0, c1::INTEGER AS c1, c2::INTEGER AS c2 FROM px WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL""",
        "square_scene": f"""WITH sq(i, l, t, s) AS (VALUES {corners}),
            cell AS (SELECT (range % {rasters.SCENE_WIDTH})::INTEGER AS x, (range // {rasters.SCENE_WIDTH})::INTEGER AS y FROM range({rasters.SCENE_WIDTH * rasters.SCENE_HEIGHT}))
            SELECT x, y, coalesce(arg_max((i + 1) * 10, i), 0)::INTEGER AS value FROM cell LEFT JOIN sq ON x >= l AND x < l + s AND y >= t AND y < t + s GROUP BY x, y""",
        "channel_check": q("SELECT image_id, count(*) AS pixels, min(CASE WHEN c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL THEN 1 ELSE 0 END)::INTEGER AS three_channels FROM ev GROUP BY image_id"),
        "luv_code": q("SELECT image_id, x, y, round(c0 * 100::DOUBLE / 255::DOUBLE, 6) AS l, round(c1 - 128::DOUBLE, 6) AS u, round(c2 - 128::DOUBLE, 6) AS v FROM ev"),
        "luv_roundtrip": q("SELECT image_id, x, y, round(c0 * 100::DOUBLE / 255::DOUBLE * 255::DOUBLE / 100::DOUBLE, 6) AS f0, c1::DOUBLE AS f1, c2::DOUBLE AS f2 FROM ev"),
        "window_gather": q(f"SELECT p.image_id, p.x, p.y, count(*)::INTEGER AS n, sum(q.c0 * (q.x + 1) + q.c1 * (q.y + 1))::BIGINT AS moment FROM ev p {near} GROUP BY p.image_id, p.x, p.y"),
        "window_gather_stats": q(f"SELECT p.image_id, p.x, p.y, count(*) AS n, sum(q.c0)::BIGINT AS sum_c0, sum(q.c1)::BIGINT AS sum_c1, sum(q.c2)::BIGINT AS sum_c2 FROM ev p {near} GROUP BY p.image_id, p.x, p.y"),
        "mean_shift_step": q("SELECT image_id, x, y, round(l, 6) AS l, round(u, 6) AS u, round(v, 6) AS v, ix AS to_x, iy AS to_y, round(shift, 6) AS shift FROM s1", shifted(1, WINDOW, BALL)),
        "mean_shift_filter": q("SELECT image_id, x, y, round(l * 255::DOUBLE / 100::DOUBLE, 6) AS f0, round(u + 128::DOUBLE, 6) AS f1, round(v + 128::DOUBLE, 6) AS f2, steps AS iters FROM s5", moves),
        "mean_shift_wide": q("SELECT image_id, x, y, round(l * 255::DOUBLE / 100::DOUBLE, 6) AS f0, round(u + 128::DOUBLE, 6) AS f1, round(v + 128::DOUBLE, 6) AS f2, steps AS iters FROM s5", shifted(5, 13, 100.0)),
        "mean_shift_iterations": q("SELECT steps AS iters, count(*) AS pixels FROM s5 GROUP BY steps", moves),
        "flood_parent": q("SELECT image_id, g, p FROM par", g64, par),
        "flood_device": q("SELECT image_id, g, p FROM par", g64, parents("par", "px", FLOOD_RADIUS, FLOOD_RANGE, device=True)),
        "flood_tiled": q("SELECT image_id, g, root * 10 AS label FROM fl", *flooded),
        "flood_labels": q("SELECT image_id, g, root * 10 AS label FROM fl", *flooded),
        "flood_scaled": q("SELECT image_id, g, root AS label FROM fl", grey(16), parents("par", "px", FLOOD_RADIUS, 4.0), roots("fl", "px", "SELECT image_id, g AS a, p AS b FROM par WHERE g <> p")),
        "flood_jump": q("SELECT a.image_id, a.g, b.p AS label FROM par a JOIN par b ON a.image_id = b.image_id AND a.p = b.g", g64, par),
        "cc_edges": q("SELECT image_id, a, b, d FROM e", edges("e", "ev")),
        "colour_matches": q("SELECT image_id, sum(CASE WHEN d = 0 THEN 1 ELSE 0 END)::BIGINT AS matches, count(*) AS edges FROM e GROUP BY image_id", g64, e64),
        "cc_exact": q("SELECT image_id, g, label FROM lab", *exact),
        "cc_range": q("SELECT image_id, g, label FROM lab32", *ranged),
        "cc_seeded": q("SELECT image_id, g, label FROM lab", *flooded, e64, labels("lab", "px", "SELECT image_id, a, b FROM e WHERE d < 1 UNION SELECT image_id, g, root FROM fl WHERE g <> root")),
        "cc_seeded_tiled": q("SELECT image_id, g, label FROM lab", *flooded, e64, labels("lab", "px", "SELECT image_id, a, b FROM e WHERE d < 1 UNION SELECT image_id, g, root FROM fl WHERE g <> root")),
        "cc_tiled": q("SELECT image_id, g, label FROM lab", *exact),
        "region_count": q("SELECT image_id, count(DISTINCT label) AS regions FROM lab GROUP BY image_id", *exact),
        "region_sizes": q("SELECT image_id, label, count(*) AS n FROM lab GROUP BY image_id, label", *exact),
        "region_table": q("SELECT l.image_id, l.label, count(*) AS n, " + ", ".join(f"round(sum(v.c{k})::DOUBLE / count(*), 6) AS m{k}" for k in range(3)) + " FROM lab l JOIN ev v USING (image_id, g) GROUP BY l.image_id, l.label", *exact),
        "region_adjacency": q("SELECT image_id, a, b FROM adj", *exact, adj),
        "region_neighbours": q("SELECT image_id, a AS label, count(*)::INTEGER AS degree, array_to_string(list_sort(list_append(list(b), a)), ',') AS with_itself FROM (SELECT image_id, a, b FROM adj UNION ALL SELECT image_id, b, a FROM adj) GROUP BY image_id, a", *exact, adj),
        "region_merge_round": q("SELECT image_id, g, label FROM t1", grey(1), merges(1, 6.5)),
        "region_merge": q("SELECT image_id, g, label FROM t5", grey(1), merges(5, 6.5)),
        "dense_relabel": q("SELECT image_id, g, dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS label FROM fl", *flooded),
        "color_labels": q(f"SELECT image_id, g, label, {COLOURS} FROM lab", *exact),
        "float_diff_grades": q(shares("gr"), moves, f"va AS (SELECT round(s.l * 255::DOUBLE / 100::DOUBLE, 6) AS test, e.c0::DOUBLE AS ref FROM s5 s JOIN ev e USING (image_id, g)), di AS (SELECT CASE WHEN ref = 0 THEN CASE WHEN test <> 0 THEN 'infinity'::DOUBLE ELSE 'nan'::DOUBLE END ELSE abs(test - ref) / ref END AS d FROM va), gr AS (SELECT {GRADE.format('d')} AS grade FROM di)"),
        "size_check": q("SELECT (SELECT count(*) FROM lab32) AS n_test, (SELECT count(*) FROM lab) AS n_ref, (SELECT count(*) FROM lab32) = (SELECT count(*) FROM lab) AS same", *exact, *ranged),
        "label_contingency": q("SELECT image_id, ref, test, cnt FROM con", *exact, *ranged, pairs),
        "label_overlap_grades": q(shares("gr"), *exact, *ranged, pairs, f"ov AS (SELECT 1.0::DOUBLE - max(cnt)::DOUBLE / sum(cnt)::DOUBLE AS d FROM con GROUP BY image_id, ref), gr AS (SELECT {GRADE.format('d')} AS grade FROM ov)"),
        "segment_pipeline": q(f"SELECT image_id, g, label, {COLOURS} FROM lab", *segmented),
        "segment_seeded": q(f"SELECT image_id, g, label, {COLOURS} FROM lab", *seeded),
        "segment_report": q("SELECT image_id, count(*) AS pixels, count(DISTINCT label) AS regions FROM lab GROUP BY image_id", *segmented),
        "segment_metrics": q("SELECT count(DISTINCT image_id) AS images, count(*) AS pixels, count(DISTINCT (image_id, label)) AS regions FROM lab", *segmented),
        "image_roundtrip": q("SELECT image_id, x, y, c0, c1, c2 FROM ev"),
        "image_components": q("SELECT image_id, g, label FROM lab", *exact),
        "frame_stream": q("SELECT image_id, count(*) AS pixels, count(DISTINCT label) AS regions FROM lab GROUP BY image_id", *seeded),
        "bin_roundtrip": q("SELECT image_id, g AS pos, c1 AS value FROM ev"),
        "filtered_bins": q(f"SELECT image_id, g + k * {AREA} AS pos, round((CASE k WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END)::FLOAT::DOUBLE, 2) AS value FROM sm, (VALUES (0), (1), (2)) t(k)", smooth(WINDOW, BALL)),
    }
