"""Places in orders and groups, prepared images, typed rows, cached maps, step logs, fetches, draws, options."""

from __future__ import annotations

import os
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumapair.functions import images, schedules
from lumapair.operators import pairing, places, validation
from lumapair.sources import config, tables


def rows(n: int) -> list[tuple]:
    """A large group, a null group, ties, and repeated rows."""
    return [("big" if i % 3 else None if i % 2 else "small", i * 7 % 50, f"v{i % 40}") for i in range(n)] + [("big", 3, "same")] * 60


@pytest.mark.parametrize("range_rows", [200_000, 9])
def test_places_in_groups(spark, range_rows):
    df = spark.createDataFrame(rows(200), "`g.x` string, o int, v string")
    found = [places.placed(df.repartition(n), [F.col("o").desc()], "p", [F.col("`g.x`")], range_rows) for n in (1, 9)]
    a, b = (sorted(map(tuple, f.collect()), key=repr) for f in found)
    assert a == b and found[0].columns == ["g.x", "o", "v", "p"] and len(a) == 260
    for g in ("big", "small", None):
        own = sorted((r[3], r[1]) for r in a if r[0] == g)
        assert [p for p, _ in own] == list(range(len(own))) and [o for _, o in own] == sorted((o for _, o in own), reverse=True)


def test_places_of_all_rows_and_of_none(spark):
    df = spark.range(500).repartition(7)
    got = places.placed(df, [F.col("id").desc()], "p", range_rows=20)
    assert sorted((r["p"], r["id"]) for r in got.collect()) == [(i, 499 - i) for i in range(500)]
    assert places.placed(df.where("id < 0"), [F.col("id")], "p").count() == 0
    # Ranges of one group, and of rows that are all equal, are many.
    for df in (df.withColumn("g", F.lit(1)), df.select(F.lit(1).alias("id"), F.lit(1).alias("g"))):
        seen = []
        plain, places.materialize = places.materialize, lambda t, name: seen.append(t) or plain(t, name)
        try:
            assert sorted(r["p"] for r in places.placed(df, [F.col("id")], "p", [F.col("g")], 20).collect()) == list(range(500))
        finally:
            places.materialize = plain
        assert max(r["count"] for r in seen[0].groupBy("r").count().collect()) < 100


def test_lists_are_cut_at_the_shorter_one(spark):
    a, b = spark.range(30).withColumnRenamed("id", "a"), spark.range(100, 107).withColumnRenamed("id", "b")
    got = places.zipped(a.repartition(5), b.repartition(3), [F.col("a").desc()], [F.col("b")]).collect()
    assert sorted((r["place"], r["a"], r["b"]) for r in got) == [(i, 29 - i, 100 + i) for i in range(7)]
    assert places.zipped(a, b.where("b < 0"), [F.col("a")], [F.col("b")]).count() == 0


def test_batches(spark):
    df = spark.range(53)
    got = [sorted(map(tuple, places.batches(df.repartition(n), "id", 8, 3, 2).collect())) for n in (1, 6)]
    assert got[0] == got[1] and len(got[0]) == 106
    orders = [[r[0] for r in sorted(got[0], key=lambda r: r[2]) if r[1] == e] for e in (0, 1)]
    assert orders[0] != orders[1] and all(sorted(o) == list(range(53)) for o in orders)
    kept = places.batches(df, "id", 8, 3, 2, drop_last=True)
    assert kept.count() == 96
    stacked = places.collated(kept, ["id"]).collect()
    assert len(stacked) == 12 and {r["n"] for r in stacked} == {8}
    assert [r["id"] for r in stacked if (r["epoch"], r["batch"]) == (1, 2)] == [orders[1][16:24]]
    assert places.batches(df.where("id > 99"), "id", 8, 3).count() == 0
    with pytest.raises(ValueError):
        places.batches(df, "id", 0, 3)


def plain_resize(x: np.ndarray, m: int, kernel) -> np.ndarray:
    """One axis, result by result, with all values weighed."""
    n, out = len(x), []
    scale = max(n / m, 1)
    for i in range(m):
        centre = (i + 0.5) * n / m
        w = [float(kernel(np.array(abs((k + 0.5 - centre) / scale)))) for k in range(n)]
        out.append(sum(a * b for a, b in zip(w, x)) / sum(w))
    return np.array(out)


@pytest.mark.parametrize("n, m", [(8, 5), (5, 8), (7, 7), (1, 4), (30, 3), (3, 30)])
def test_sparse_weights_equal_all_weights(n, m):
    x = np.random.default_rng(n).random(n)
    for kernel in (images._linear, images._cubic):
        assert np.allclose(images.resized(x[None, None], 1, m, kernel)[0, 0], plain_resize(x, m, kernel))
        assert images.taps(n, m, kernel)[0].shape[1] <= 4 * max(n / m, 1) + 2


def test_prepared_images_of_mixed_sizes(spark):
    rng = np.random.default_rng(9)
    shapes = [(8, 8), (4, 16), (8, 8), (5, 3), (64, 48)]
    own = [rng.random((3, *s)) for s in shapes]
    data = [(i, x.ravel().tolist(), *x.shape[1:]) for i, x in enumerate(own)]
    data += [(10, None, 8, 8), (11, [0.5] * 5, 8, 8), (12, [None] * 192, 8, 8), (13, [0.5] * 192, None, 8), (14, [], 0, 0), (15, [0.5] * 192, -8, 8)]
    df = spark.createDataFrame(data, "i int, values array<double>, height int, width int").coalesce(1)
    for how in (images.short_side_crop, images.square):
        got = {r["i"]: r["prepared"] for r in images.with_prepared(df, 6, how).collect()}
        assert [i for i, v in sorted(got.items()) if v is None] == [10, 11, 12, 13, 14, 15]
        assert all(np.allclose(got[i], how(x, 6).ravel()) for i, x in enumerate(own))
    assert images.short_side_crop(own[1], 6).shape == (3, 6, 6)
    # A gradient keeps its direction and range.
    ramp = images.square(np.tile(np.linspace(0, 1, 16), (1, 16, 1)), 4)
    assert (np.diff(ramp, axis=2) > 0.2).all() and np.allclose(np.diff(ramp, axis=1), 0)


def test_step_validation(spark):
    rng = np.random.default_rng(2)
    data = [(i, ["rain", "snow", "fog"][i % 3], (p := rng.random(3 * 9 * 12)).tolist(), p.tolist() if i % 2 else (1 - p).tolist(), 9, 12) for i in range(18)] + [(99, "snow", None, None, 9, 12)]
    df = spark.createDataFrame(data, "image_id long, weather string, pred array<double>, target array<double>, height int, width int")
    scores, log = validation.step_validation(df, 7, ["rain", "snow"], None, 6)
    assert {r["image_id"] for r in scores.collect()} == {i for i in range(18) if i % 3 < 2}
    same = [r for r in scores.collect() if r["image_id"] % 2]
    assert all(r["psnr"] == 100 and r["ssim"] == pytest.approx(1) for r in same)
    got = {r["key"]: r["value"] for r in log.collect()}
    assert set(got) == {f"val/{w}/{m}" for w in ("rain", "snow") for m in ("psnr", "ssim")} | {"val/avg_psnr", "val/avg_ssim"}
    assert got["val/avg_psnr"] == pytest.approx((got["val/rain/psnr"] + got["val/snow/psnr"]) / 2)
    assert validation.step_validation(df, 7, ["rain"], 2, 6)[0].count() == 2


def test_typed_rows_and_rejects(spark):
    df = spark.createDataFrame([("1", "a.png", None), ("x", "b.png", "t"), (None, "c.gif", "t"), ("4", None, "t"), ("5", "e.png", "t")], "id string, image string, `te.xt` string")
    found = tables.checked(df, "id long NOT NULL, image string NOT NULL, `te.xt` string, more int", {"png": F.col("image").endswith(".png")})
    assert tables.accepted(found).count() == 0  # `more` is missing
    found = tables.checked(df, "id long NOT NULL, image string NOT NULL, `te.xt` string", {"png": F.col("image").endswith(".png")})
    good, bad = tables.accepted(found), tables.rejected(found).collect()
    assert [tuple(r) for r in good.orderBy("id").collect()] == [(1, "a.png", None), (5, "e.png", "t")] and dict(good.dtypes)["id"] == "bigint"
    assert sorted(tuple(r["faults"]) for r in bad) == [("id is no bigint",), ("id is null", "png"), ("image is null", "png")]
    assert any('"te.xt":"t"' in r["row"] and '"id":null' in r["row"] for r in bad)


def test_cached_map(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "cache")
    spark.range(5).write.parquet(source)
    built = []

    def build(inputs):
        built.append(1)
        return inputs[0].withColumn("twice", F.col("id") * 2)

    run = lambda version="1", options=None: tables.cached_map(spark, folder, [source], build, version, options).agg(F.sum("twice")).first()[0]
    assert [run(), run(), len(built)] == [20, 20, 1]
    run(options={"k": 1}), run(options={"k": 1}), run("2")
    assert len(built) == 3
    spark.range(6).write.mode("overwrite").parquet(source)
    assert run() == 30 and len(built) == 4
    # What a lost builder left behind does not count.
    path = f"{folder}/{tables.fingerprint(spark, [source], '1', {})}"
    os.remove(f"{path}/_SUCCESS")
    os.rename(path, f"{path}-left")
    assert run() == 30 and len(built) == 5


def test_step_log_takes_a_step_once(spark, tmp_path):
    log = str(tmp_path / "log")
    assert tables.read_steps(spark, log).count() == 0
    one = lambda *r: spark.createDataFrame(r, "run string, step long, key string, value double")
    tables.append_steps(one(("a", 1, "x", 1.0), ("a", 1, "y", 2.0), ("a", 2, "x", 3.0)), log)
    tables.append_steps(one(("a", 1, "x", 9.0), ("b", 1, "x", 5.0)), log)
    tables.append_steps(one(("a", 1, "x", 9.0), ("b", 1, "x", 5.0)), log)
    assert sorted(map(tuple, tables.read_steps(spark, log).collect())) == [("a", 1, "x", 9.0), ("a", 2, "x", 3.0), ("b", 1, "x", 5.0)]


def test_step_log_has_few_files_for_many_steps(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.range(3000).select(F.lit("a").alias("run"), F.when(F.col("id") > 0, F.col("id")).alias("step"), F.lit("x").alias("key"), F.lit(1).alias("value"))
    tables.append_steps(rows, log)
    for value in (2, 3):
        tables.append_steps(rows.where("step IS NULL OR step % 2 = 0").withColumn("value", F.lit(value)), log)
    files = [f for _, _, found in os.walk(log) for f in found if f.endswith(".parquet")]
    assert 3 <= len(files) < 100
    got = tables.read_steps(spark, log).collect()
    assert {r["step"]: r["value"] for r in got} == {(i or None): (1.0 if i % 2 else 3.0) for i in range(3000)} and len(got) == 3000


def test_fetch_reads_few_files(spark, tmp_path):
    path = str(tmp_path / "placed")
    tables.write_by_place(spark.range(1000).repartition(5).withColumn("text", F.lit("t")), [F.col("id").desc()], path, 100)
    got = tables.fetch(spark, path, [5, 777, 778, 5, 4000], 100)
    assert sorted((r["place"], r["id"]) for r in got.collect()) == [(5, 994), (777, 222), (778, 221)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(place, [" in plan and "IN (0,7,40)]" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    files = {r[0] for r in got.select(F.input_file_name()).collect()}
    assert len(files) == 2 and {f.split("folder=")[1][0] for f in files} == {"0", "7"}
    assert tables.fetch(spark, path, [], 100).count() == 0


def test_draws(spark):
    p = [1e-9, 1e-4, 0.02, 0.02425, 0.3, 0.5, 0.8, 0.98, 0.9999]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(schedules.inverse_normal(F.col("p")).alias("z")).collect()
    assert [r["z"] for r in got] == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-8, abs=1e-8)
    u = schedules.uniform_draw(F.col("id"), 1)
    d = spark.range(20_000).select(u.alias("u"), *[schedules.timestep_density(u, s).alias(s) for s in ("logit_normal", "mode", "cosine", "sigma_sqrt")]).toPandas()
    assert ((d > 0) & (d < 1)).all().all() and abs(d["u"].mean() - 0.5) < 0.01 and abs(np.log(d["logit_normal"] / (1 - d["logit_normal"])).std() - 1) < 0.02
    assert (d["sigma_sqrt"] == d["u"]).all() and abs((d["cosine"] < 0.5).mean() - 0.5) < 0.02
    with pytest.raises(ValueError):
        schedules.timestep_density(F.lit(0.5), "other")


def test_columns_of_schedules(spark):
    one = spark.createDataFrame([(0.3,)], "s double")
    assert one.select(schedules.flow_start_of(F.col("s"), 3.0)).first()[0] == pytest.approx(schedules.flow_start(0.3, 3.0))
    with pytest.raises(Exception, match="strength must be"):
        one.select(schedules.flow_start_of(F.col("s") + 1, 3.0)).collect()
    with pytest.raises(Exception, match="sizes differ: 1 and 2"):
        one.select(schedules.toward(F.array("s"), F.array("s", "s"), F.lit(0.5))).collect()


def test_rules_of_options():
    fine = {"pretrained_model_name_or_path": "m", "dataset_root": "d"}
    assert config.start_faults(fine) == []
    assert len(config.start_faults({})) == 2 and len(config.start_faults(fine | {"dataset_name": "n"})) == 1
    for bad in (
        {"ra_fusion_interval": 0}, {"ra_fusion_hidden_dim": -1}, {"ra_fusion_num_res_blocks": 0}, {"ra_fusion_kernel_size": 4}, {"ra_fusion_kernel_size": -1}, {"ra_fusion_scale": float("inf")},
        {"ra_fusion_scale": -0.1}, {"use_ra_fusion": True, "train_controlnet": False}, {"train_transformer_lora": 1}, {"report_to": "wandb", "hub_token": "t"},
    ):
        assert len(config.faults(bad)) == 1, bad
    assert config.faults({"use_ra_fusion": True, "train_controlnet": False, "controlnet_model_name_or_path": "c"}) == []


def test_candidate_lists(spark, tmp_path):
    assert [r["seed"] for r in config.candidate_list(spark).orderBy("at").collect()] == [1, 2, 3, 4, 5, 6]
    text = '[{"seed": 9, "controlnet_conditioning_scale": 1, "num_inference_steps": 3}]'
    (tmp_path / "c.json").write_text(text)
    assert tuple(config.candidate_list(spark, text).first()) == tuple(config.candidate_list(spark, path=str(tmp_path / "c.json")).first()) == (0, 9, 1.0, 3)
    with pytest.raises(Exception, match="lacks num_inference_steps"):
        config.candidate_list(spark, '[{"seed": 9, "controlnet_conditioning_scale": 1}]').collect()
    with pytest.raises(ValueError):
        config.candidate_list(spark, "{}")
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("- {seed: 9, controlnet_conditioning_scale: 1, num_inference_steps: 3}\n")
    assert config.candidate_list(spark, path=str(tmp_path / "c.yaml")).first()["seed"] == 9


def test_position_of_a_group_that_spans_ranges(spark, monkeypatch):
    monkeypatch.setattr(places, "RANGE_ROWS", 10)
    got = pairing.numbered_in_group(spark.range(100).withColumn("g", F.lit("one")), "g", [F.col("id")]).collect()
    assert all(r["image_index"] == r["id"] for r in got)
