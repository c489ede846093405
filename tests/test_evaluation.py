from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumapair.functions import images, paths, pixels, prompts, schedules
from lumapair.operators import frechet, pairing, quality, reports
from lumapair.sources import sinks, trees


def test_psnr_of_equal_images_is_100(spark):
    df = spark.createDataFrame([([0.1, 0.5], [0.1, 0.5]), ([0.0, 0.0], [0.5, 0.5])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(pixels.psnr(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 100.0
    assert got[1] == pytest.approx(-10 * math.log10(0.25))


def test_ssim_and_sobel():
    x = np.random.default_rng(1).random((1, 8, 8))
    assert images.ssim(x, x) == pytest.approx(1.0)
    flat = np.zeros((1, 5, 5))
    flat[:, :, 3:] = 1
    got = images.sobel(flat)[0]
    want = np.zeros((5, 5))
    p = np.pad(flat[0], 1)
    kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    for i in range(5):
        for j in range(5):
            w = p[i : i + 3, j : j + 3]
            want[i, j] = math.sqrt((w * kx).sum() ** 2 + (w * kx.T).sum() ** 2 + 1e-12)
    assert np.allclose(got, want)


def test_resize_keeps_constants_and_size():
    y = images.short_side_crop(np.full((3, 10, 20), 0.25), 5)
    assert y.shape == (3, 5, 5) and np.allclose(y, 0.25)


def test_frechet_of_a_set_with_itself_is_0_and_partitions_do_not_matter(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(60, 4)), rng.normal(1, 2, size=(50, 4))
    rows = [("k", "p", v.tolist()) for v in a] + [("k", "g", v.tolist()) for v in b] + [("one", "p", [0.0] * 4), ("one", "g", [0.0] * 4)]
    df = spark.createDataFrame(rows, "key string, side string, f array<double>")
    want = frechet.distance(frechet.moments(a), frechet.moments(b))
    for n in (1, 7):
        got = {r["key"]: r["distance"] for r in frechet.frechet(df.repartition(n), "key", "side", "f", ("p", "g")).collect()}
        assert got["k"] == pytest.approx(want) and math.isnan(got["one"])
    assert frechet.distance(frechet.moments(a), frechet.moments(a)) == pytest.approx(0, abs=1e-9)


def test_pairing_ignores_order_and_takes_the_lowest_path(spark):
    gt = spark.createDataFrame([("a", "g/a.png"), ("a", "g/a.jpg"), ("b", "g/b.png")], "stem string, path string")
    lq = spark.createDataFrame([("a", "l/a.png"), ("c", "l/c.png")], "stem string, path string")
    assert [tuple(r) for r in pairing.pair(gt, lq, ["stem"]).collect()] == [("a", "g/a.jpg", "l/a.png")]
    assert {tuple(r) for r in pairing.unmatched(gt, lq, ["stem"]).collect()} == {("b", "missing"), ("c", "unexpected")}
    assert pairing.head_per_group(gt, "stem", [F.col("path")], 0).count() == 3


def test_paths_and_prompts(spark):
    df = spark.createDataFrame([("x/a.b.PNG",), ("x/readme",), ("checkpoint-12",)], "p string")
    got = [tuple(r) for r in df.select(paths.stem(F.col("p")), paths.is_image(F.col("p")), paths.checkpoint_step(F.col("p"))).collect()]
    assert got == [("a.b", True, None), ("readme", False, None), ("checkpoint-12", False, 12)]
    import hashlib

    p = prompts.hash_share(F.col("p"))
    for r in df.select("p", p.alias("h")).collect():
        assert r["h"] == int(hashlib.md5(r["p"].encode()).hexdigest()[:8], 16) % 10**6 / 10**6
    assert prompts.parse_prompts(["rain: a:b ", "x"]) == {"rain": "a:b"}


def test_ties_go_to_the_first_seed_and_nan_is_skipped(spark):
    df = spark.createDataFrame([(1, 7, 0, 2.0), (1, 5, 1, 2.0), (1, 3, 2, float("nan"))], "image int, seed int, seed_pos int, score double")
    r = reports.image_stability(df, ["image"], "score").first()
    assert (r["best_seed"], r["worst_seed"], r["score_range"]) == (7, 7, 0.0)
    assert math.isnan(df.where("seed = 3").agg(reports.nan_mean(F.col("score"))).first()[0])


def test_guards_and_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", float("-inf")), ("a", None)], "k string, v double")
    r = quality.nonfinite_guard(df, ["k"], "v").first()
    assert (r["n"], r["n_null"], r["n_nan"], r["n_inf"], r["finite_min"], r["finite_max"]) == (4, 1, 1, 1, 1.0, 1.0)
    steps = spark.createDataFrame([(500,), (1000,), (1500,)], "step long")
    assert {x["step"] for x in quality.retention(steps, 3).where("kept").collect()} == {1000, 1500}
    with pytest.raises(ValueError):
        schedules.flow_start(0, 3)


def test_trees_by_listing(spark, tmp_path):
    for f in ("rain/a/gt/1.png", "rain/a/lq/1.jpg", "rain/a/gt/2.png", "rain/a/GT/3.png", "rain/a/LQ/3.png", "rain/b/test/GT/4.PNG", "rain/b/test/LQ/4.png",
              "snow/test/GT/5.png", "snow/test/LQ/5.png", "snow/other/gt/6.png", "snow/other/lq/6.png", "snow/test/LQ/notes.txt"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    files = trees.image_files(spark, str(tmp_path))
    got = {(r["sub_name"], r["stem"]) for r in trees.eval_pairs(files, str(tmp_path), ["rain", "snow"], ["test"]).collect()}
    assert got == {("rain_a", "1"), ("rain_b", "4"), ("snow_test", "5")}
    got = [(r["weather"], r["split"], r["stem"]) for r in trees.training_pairs(files, str(tmp_path), ["snow"], ["test"]).collect()]
    assert got == [("snow", "test", "5")]


def test_pick_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert trees.pick_columns(df, caption="c").first().asDict() == {"image": 1, "caption": 3, "conditioning": 3}
    with pytest.raises(ValueError):
        trees.pick_columns(df, image="x")


def test_report_files(spark, tmp_path):
    per = spark.createDataFrame([("r_a", "x", 30.0, 0.5, float("nan"), 1.0)], "sub_name string, stem string, psnr double, ssim double, lpips double, infer_time double")
    sinks.write_image_lines(sinks.image_lines(per), str(tmp_path / "lines"))
    assert "x, 30.0000, 0.5000, nan, 1.00" in [r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()]
    report = spark.createDataFrame([("rain", 3, 30.0, float("nan")), (None, 3, 30.0, 0.1)], "weather string, n long, psnr double, lpips double")
    got = [r["value"] for r in sinks.table_lines(report, ["weather"], ["psnr", "lpips"]).collect()]
    assert got == ["rain             3    30.0000        N/A", "ALL              3    30.0000     0.1000"]
    sinks.write_csv(per, str(tmp_path / "csv"))
    sinks.write_json(per, str(tmp_path / "json"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == per.columns and spark.read.json(str(tmp_path / "json")).count() == 1
