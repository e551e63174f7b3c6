"""Operators against brute force on small rasters of awkward shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import compare, components, flood, meanshift, regions, tiles
from pixelweave.operators.components import smallest_reachable
from pixelweave.oracles import merges
from pixelweave.plans.workspace import materialise
from pixelweave.sources import bins

PIXEL = "image_id long, x int, y int, c0 int, c1 int, c2 int"


def snake(h, w):
    image = np.zeros((h, w), int)
    image[1::2, :] = 200
    image[1::4, -1] = 0
    image[3::4, 0] = 0
    return image


RASTERS = {
    "one": np.array([[7]]),
    "row": np.array([[1, 1, 2, 2, 2, 9, 1]]),
    "column": np.array([[1], [1], [5], [5]]),
    "uniform": np.full((5, 6), 3),
    "checkerboard": np.indices((5, 7)).sum(axis=0) % 2 * 50,
    "snake": snake(9, 7),
    "diagonal": np.array([[9, 0], [0, 9]]),
    "random": np.random.default_rng(1).integers(0, 3, (11, 13)) * 2,
}


def table(spark, images):
    rows = [(i, x, y, int(a[y, x]), int(a[y, x]), int(a[y, x])) for i, a in images for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, PIXEL)


def brute_components(image, near):
    h, w = image.shape
    label = -np.ones((h, w), int)
    n = 0
    for y in range(h):
        for x in range(w):
            if label[y, x] < 0:
                stack = [(y, x)]
                label[y, x] = n
                while stack:
                    a, b = stack.pop()
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < h and 0 <= d < w and label[c, d] < 0 and near(image[a, b], image[c, d]):
                            label[c, d] = n
                            stack.append((c, d))
                n += 1
    return label.reshape(-1).tolist()


def labels_of(df):
    return [r["label"] for r in df.orderBy("g").collect()]


@pytest.mark.parametrize("name", RASTERS)
def test_components(spark, name):
    image = RASTERS[name]
    h, w = image.shape
    pixels = table(spark, [(0, image)])
    assert labels_of(components.label_equal(pixels, w, h)) == brute_components(image, lambda a, b: a == b)
    assert labels_of(components.label_range(pixels, w, h, 12.0)) == brute_components(image, lambda a, b: 3 * (a - b) ** 2 < 12)


@pytest.mark.parametrize("name", ["snake", "random", "uniform"])
def test_tiles_agree(spark, name):
    image = RASTERS[name]
    h, w = image.shape
    pixels = table(spark, [(0, image), (5, image)])
    found = components.label_equal(pixels, w, h, tile=3)
    for i in (0, 5):
        assert labels_of(found.where(F.col("image_id") == i)) == brute_components(image, lambda a, b: a == b)


def brute_mean_shift(image, radius, limit):
    h, w = image.shape
    out = []
    for i in range(h):
        for j in range(w):
            l, u = image[i, j] * 100 / 255, image[i, j] - 128.0
            v, ic, jc, shift, steps = u, i, j, 5.0, 0
            while shift > 3 and steps < 5:
                near = [(a, b, image[a, b]) for a in range(max(0, i - radius), min(h, i + radius + 1)) for b in range(max(0, j - radius), min(w, j + radius + 1)) if (image[a, b] * 100 / 255 - l) ** 2 + (image[a, b] - 128.0 - u) ** 2 + (image[a, b] - 128.0 - v) ** 2 <= limit]
                n, s = len(near), sum(int(p[2]) for p in near)
                l2, u2 = s * 100 / 255 / n, s / n - 128.0
                i2, j2 = math.floor(sum(p[0] for p in near) / n) + 1, math.floor(sum(p[1] for p in near) / n) + 1
                shift = (i2 - ic) ** 2 + (j2 - jc) ** 2 + (l2 - l) ** 2 + 2 * (u2 - u) ** 2
                l, u, v, ic, jc, steps = l2, u2, u2, i2, j2, steps + 1
            out.append((l * 255 / 100, u + 128.0, steps))
    return out


@pytest.mark.parametrize("engine", ["windows", "tiles"])
@pytest.mark.parametrize("name", ["one", "row", "snake", "random"])
def test_mean_shift(spark, name, engine):
    image = RASTERS[name]
    got = meanshift.mean_shift(table(spark, [(0, image)]), 2, 30.0, engine=engine, tile=4).orderBy("y", "x").collect()
    for row, (f0, f1, steps) in zip(got, brute_mean_shift(image, 2, 30.0), strict=True):
        assert row["iters"] == steps and abs(row["f0"] - f0) < 1e-9 and abs(row["f1"] - f1) < 1e-9


def test_engines_agree_exactly(spark):
    rng = np.random.default_rng(6)
    pixels = table(spark, [(i, rng.integers(0, 256, (23, 17)) // 32 * 32) for i in range(2)])
    key = lambda engine: sorted(tuple(r) for r in meanshift.mean_shift(pixels, 3, 1500.0, engine=engine, tile=8).collect())
    assert key("windows") == key("tiles")
    gaps = pixels.where("NOT (x = 5 AND y = 7) AND NOT (x > 8 AND y > 3 AND y < 20)")
    for tile in (6, 16):
        got = meanshift.mean_shift(gaps, 3, 1500.0, tile=tile).collect()
        assert len(got) == gaps.count()
        if tile == 6:
            first = sorted(map(tuple, got))
    assert sorted(map(tuple, got)) == first


def test_clamped():
    assert [meanshift.clamped(k) for k in (-1, 0, 1, 7, 16, 17)] == [16, 16, 1, 7, 16, 16]


def test_mean_shift_limit_is_inclusive(spark):
    image = np.array([[0, 51]])  # distance 20^2 + 51^2 + 51^2
    at = meanshift.mean_shift(table(spark, [(0, image)]), 1, 20.0**2 + 2 * 51**2).orderBy("x").first()
    assert at["f1"] == 25.5


def brute_flood(image, radius, limit):
    h, w = image.shape
    out = [g * 10 for g in range(h * w)]
    for y in range(h):
        for x in range(w):
            best = (999999.0, None)
            for r in range(-radius, 0):
                for a, b in ((y + r, x), (y, x + r)):
                    if a >= 0 and b >= 0 and 3 * (image[a, b] - image[y, x]) ** 2 < best[0]:
                        best = (3 * (image[a, b] - image[y, x]) ** 2, a * w + b)
            if best[0] < limit:
                out[y * w + x] = out[best[1]]
    return out


@pytest.mark.parametrize("name", RASTERS)
def test_flood(spark, name):
    image = RASTERS[name]
    h, w = image.shape
    assert labels_of(flood.flood(table(spark, [(0, image)]), w, h, 4, 12.0)) == brute_flood(image, 4, 12.0)


def test_flood_root_is_fixed(spark):
    image = RASTERS["row"]
    h, w = image.shape
    far = flood.parents(table(spark, [(0, image)]), w, 4, 5.0, h)
    for _ in range(3):  # eight hops, and a row of seven pixels
        far = flood.jump(far)
    assert {(r["g"], r["p"]) for r in far.collect()} == {(r["g"], r["label"]) for r in flood.flood(table(spark, [(0, image)]), w, h, 4, 5.0, step=1).collect()}


def test_merge_keeps_images_apart(spark):
    image = np.array([[0, 3, 90], [0, 3, 90]])
    got = regions.merge_regions(table(spark, [(0, image), (1, image)]), 3, 2)
    for i in (0, 1):
        assert labels_of(got.where(F.col("image_id") == i)) == [0, 0, 1, 0, 0, 1]


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_merge_equals_sql(spark, sql, rounds):
    """With gaps, copies, nulls, and pixels without a place, by groups and by joins."""
    rng = np.random.default_rng(rounds)
    rows = [(i, x, y, *(int(v) for v in rng.integers(0, 14, 3))) for i in (0, HASHED, -HASHED) for y in range(6) for x in range(7)]
    rows = [r if rng.random() > 0.1 else (*r[:3], None, None, None) for r in rows if rng.random() > 0.1]
    rows += [(*rows[k][:3], 1, None, 9) for k in (0, 0, 5, 40)]
    pixels = spark.createDataFrame(rows, PIXEL)
    px = pixels.toPandas()  # noqa: F841
    want = sql.execute(f"WITH RECURSIVE px AS (SELECT CAST(image_id AS BIGINT) AS image_id, x, y, y * 7 + x AS g, c0::INTEGER AS c0, c1::INTEGER AS c1, c2::INTEGER AS c2 FROM (SELECT image_id, x, y, {', '.join(f'CASE WHEN NOT isnan(c{k}::DOUBLE) THEN c{k} END AS c{k}' for k in range(3))} FROM px)), {merges(rounds, 6.5)} SELECT image_id, g, label FROM t{rounds}").fetchall()
    lost = spark.createDataFrame([(None, 1, 1, 0, 0, 0), (3, None, 1, 0, 0, 0)], PIXEL)
    for tile in (components.TILE, 4):
        got = regions.merge_regions(pixels.unionByName(lost), 7, 6, rounds=rounds, tile=tile).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize("tile", [3, components.TILE])
def test_pixels_are_not_broadcast(spark, monkeypatch, tile):
    """Few bytes of Parquet hold the labels of millions of pixels, more than a driver does."""
    plans = []

    def spy(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, name)

    for module in (regions, components, tiles):
        monkeypatch.setattr(module, "materialise", spy)
    image = RASTERS["random"]
    pixels = materialise(table(spark, [(0, image), (1, image)]), "pixels")
    for found in (regions.merge_regions(pixels, 13, 11, tile=tile), regions.merge_round(pixels, materialise(regions.one_per_pixel(pixels, 13), "labels"), 13, 11, tile=tile), components.label_equal(pixels, 13, 11, tile=tile)):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def test_difference_grades(spark):
    nan = float("nan")
    values = spark.createDataFrame([(1.1, 1.0), (1.06, 1.0), (1.02, 1.0), (1.006, 1.0), (1.0, 1.0), (0.0, 0.0), (1.0, 0.0), (5.0, -1.0), (nan, 1.0)], "test double, ref double")
    got = {r["grade"]: r["cnt"] for r in compare.difference_grades(values).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: 1, 4: 4}


def test_empty_tables(spark):
    none = table(spark, [(0, np.array([[1]]))]).limit(0)
    assert components.label_equal(none, 4, 4).count() == 0
    assert flood.flood(none, 4, 4, 2, 1.0).count() == 0
    assert meanshift.mean_shift(none, 2, 9.0).count() == 0


def test_bin_codec(spark, tmp_path):
    for kind, values in (("int", [1, -2, 2**31 - 1]), ("float", [0.5, -1.25])):
        assert bins.decode(bins.encode(np.array(values), kind), kind).tolist() == values
    with pytest.raises(ValueError):
        bins.decode(bins.encode(np.array([1, 2]), "int")[:-1], "int")


def test_smallest_reachable():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (40, 30), (200, 260)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        want = np.arange(n)
        while True:
            low = want.copy()
            for i, j in zip(a, b, strict=True):
                low[i] = low[j] = min(low[i], low[j])
            if (low == want).all():
                break
            want = low
        assert (smallest_reachable(n, a, b) == want).all()


def test_image_files(spark, tmp_path):
    from pixelweave.sources import images

    colour = np.arange(2 * 5 * 3).reshape(2, 5, 3) * 8
    (tmp_path / "a.png").write_bytes(images.encode_png(colour))
    (tmp_path / "-7.png").write_bytes(images.encode_png(colour[:1]))
    (tmp_path / "no.png").write_bytes(b"not an image")
    got = images.read_images(spark, str(tmp_path)).collect()
    want = [(x, y, *colour[y, x].tolist()) for y in range(2) for x in range(5)]
    assert sorted(tuple(r[1:]) for r in got if r["image_id"] != -7) == sorted(want)
    assert sorted(tuple(r[1:]) for r in got if r["image_id"] == -7) == sorted(want[:5])


HASHED = 6_917_529_027_641_081_856  # such ids come from file addresses


@pytest.mark.parametrize("name", ["snake", "random", "uniform", "checkerboard"])
def test_tiles_agree_for_any_id(spark, name):
    image = RASTERS[name]
    h, w = image.shape
    pixels = table(spark, [(HASHED, image), (-HASHED, image), (3, image)])
    found = components.label_equal(pixels, w, h, tile=3)
    flooded = flood.flood(pixels, w, h, 4, 12.0, tile=3)
    merged = regions.merge_round(pixels, regions.one_per_pixel(pixels, w), w, h, tile=3)
    whole = regions.merge_round(pixels, regions.one_per_pixel(pixels, w), w, h)
    for i in (HASHED, -HASHED, 3):
        own = lambda df: labels_of(df.where(F.col("image_id") == i))  # noqa: B023, E731
        assert own(found) == brute_components(image, lambda a, b: a == b)
        assert own(flooded) == brute_flood(image, 4, 12.0)
        assert own(merged) == own(whole)


def test_images_above_one_tile(spark):
    """1,100 by 3: two tiles at the default size, and components that cross their border."""
    image = np.zeros((3, 1100), int)
    image[1, :1050] = 200
    pixels = table(spark, [(HASHED, image)])
    assert labels_of(components.label_range(pixels, 1100, 3, 12.0)) == brute_components(image, lambda a, b: 3 * (a - b) ** 2 < 12)
    assert labels_of(flood.flood(pixels, 1100, 3, 4, 12.0)) == brute_flood(image, 4, 12.0)


def test_tiles_of_one_key_are_taken_apart():
    import pyarrow as pa

    from pixelweave.operators.tiles import each_tile

    left = pa.table({"image_id": [1, 1, 2, 1], "tile_x": [0, 0, 0, 5], "tile_y": [0, 0, 0, 0], "x": [1, 2, 3, 4]})
    right = pa.table({"image_id": [2, 9], "tile_x": [0, 0], "tile_y": [0, 0], "g": [7, 8]})
    got = {key: [t.column(3).to_pylist() for t in own] for key, own in each_tile(left, right)}
    assert got == {(1, 0, 0): [[1, 2], []], (1, 5, 0): [[4], []], (2, 0, 0): [[3], [7]]}
    assert [key for key, _ in each_tile(left.slice(0, 2))] == [(1, 0, 0)] and not list(each_tile(left.slice(0, 0)))


def test_gaps_stay_gaps(spark):
    image = RASTERS["uniform"]
    h, w = image.shape
    holed = table(spark, [(0, image)]).where("x != 2")
    for tile in (1024, 3):
        got = holed.join(components.label_equal(holed, w, h, tile=tile).withColumn("x", (F.col("g") % w).cast("int")).withColumn("y", F.floor(F.col("g") / w).cast("int")), ["image_id", "x", "y"]).collect()
        assert len(got) == h * (w - 1) and {(r["label"], r["x"] > 2) for r in got} == {(0, False), (1, True)}


def test_radii_outside_the_range_run_as_the_largest(spark):
    image = np.random.default_rng(2).integers(0, 3, (5, 40)) * 9
    pixels = table(spark, [(0, image)])
    run = lambda r: sorted(map(tuple, meanshift.mean_shift(pixels, r, 300.0).collect()))
    assert run(20) == run(16) == run(0) != run(3)


def test_frames_wait_until_they_are_complete(spark, tmp_path):
    """Rows of four frames dealt over nine files, two a batch; the last frame never completes."""
    from pixelweave.streaming.frames import frame_regions

    image = RASTERS["random"]
    h, w = image.shape
    pixels = table(spark, [(i, image) for i in range(4)]).where(f"NOT (image_id = 3 AND y = {h - 1})")
    got = {r["image_id"]: (r["pixels"], r["regions"]) for r in frame_regions(spark, pixels, lambda rows: rows, w, h, 1, 4.0, 6.0, files=9).collect()}
    assert got[0] == got[1] == got[2] and got[0][0] == h * w and got[3][0] == (h - 1) * w


def test_device_rules(spark):
    image = RASTERS["uniform"]
    h, w = image.shape
    got = {r["g"]: r["p"] for r in flood.parents(table(spark, [(0, image)]), w, 2, 1.0, h, device=True).collect()}
    for y in range(h):
        for x in range(w):
            near = [a * w + x for a in range(max(1, y - 2), y)] + [y * w + b for b in range(max(1, x - 2), x)]
            assert got[y * w + x] == min(near, default=y * w + x)
