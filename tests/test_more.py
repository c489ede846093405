from __future__ import annotations

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumapair import session
from lumapair.functions import images, schedules
from lumapair.operators import frechet, pairing, reports
from lumapair.sources import config, sinks, trees


def _png(path, pixels: np.ndarray) -> None:
    """A PNG of (height, width, 3) bytes."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, _ = pixels.shape
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_images_are_decoded_as_red_green_blue(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 256, (3, 5, 3), dtype=np.uint8)
    _png(tmp_path / "a.png", x)
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = images.decoded(spark, str(tmp_path)).collect()
    assert [(r["height"], r["width"]) for r in rows] == [(3, 5)]
    assert np.allclose(np.array(rows[0]["values"]).reshape(3, 3, 5), x.transpose(2, 0, 1) / 255)


def test_image_folder_with_metadata(spark, tmp_path):
    (tmp_path / "train").mkdir()
    for n in ("a.png", "b.png"):
        (tmp_path / "train" / n).write_bytes(b"x")
    assert trees.image_folder(spark, str(tmp_path)).columns == ["path"]
    (tmp_path / "train" / "metadata.jsonl").write_text('{"file_name": "a.png", "text": "one"}\n')
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in trees.image_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.png": "one", "b.png": None}


def test_square_and_scores_with_nulls(spark):
    assert np.allclose(images.square(np.full((3, 4, 9), 0.5), 6), 0.5) and images.square(np.zeros((1, 8, 5)), 8).shape == (1, 8, 8)
    one = [0.1] * 64
    df = spark.createDataFrame([(1, one, one), (2, None, one), (3, one[:5], one), (4, [None, *one[1:]], one), (5, one, [0.2] * 64)], "i int, pred array<double>, target array<double>")
    got = {r["i"]: r["s"] for r in images.with_pair_score(df, "s", images.ssim).collect()}
    assert got[1] == pytest.approx(1) and [got[i] for i in (2, 3, 4)] == [None] * 3
    assert got[5] == pytest.approx(float(images.ssim(np.full((1, 8, 8), 0.1), np.full((1, 8, 8), 0.2))))


def test_sources_and_checkpoints(spark, tmp_path):
    pairs = spark.createDataFrame([("r/rain/train/GT/1.png",), ("r/rain/train/LQ/1.png",)], "path string")
    assert {tuple(r) for r in trees.missing_folders(pairs, "r", ["rain", "snow"], ["train"]).collect()} == {("snow", "train")}
    with pytest.raises(ValueError):
        trees.missing_folders(pairs, "r", ["haze"], ["train"])
    assert trees.eval_roots({"dataset_root": "d/", "dataset_rain": "x"}, ["rain", "snow"]) == {"rain": "x", "snow": "d/snow"}
    assert trees.eval_roots({}, ["rain"]) == {}

    def folder(*files: str) -> str:
        return trees.checkpoint_folder(spark.createDataFrame([(f,) for f in files], "path string"), "m").first()["folder"]

    assert folder("m/config.json", "m/controlnet/config.json") == "m"
    assert folder("m/controlnet/config.json", "m/checkpoint-9/controlnet/config.json") == "m/controlnet"
    assert folder("m/checkpoint-9/controlnet/config.json", "m/checkpoint-10/controlnet/config.json", "m/checkpoint-x/controlnet/config.json") == "m/checkpoint-10/controlnet"
    assert folder("m/other.bin") == "m"
    names = spark.createDataFrame([("checkpoint-9",), ("checkpoint-10",)], "name string")
    assert tuple(trees.resume_folder(names).first()) == ("checkpoint-10", 10)
    assert tuple(trees.resume_folder(names, "a/checkpoint-3/").first()) == ("checkpoint-3", 3)
    assert tuple(trees.resume_folder(names.where("false")).first()) == (None, None)


def test_settings(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("lr: 5e-5\nsteps: '7'\nsplits: true\nempty:\nnew: 1\n")
    (tmp_path / "c.json").write_text('{"lr": 1.0}')
    found = config.read_map(spark, str(tmp_path / "c.yaml"))
    got = config.settled({"lr": 1e-3, "steps": 1, "splits": ["a"], "empty": "kept", "seed": 3}, found, {"seed": 9})
    assert got == {"lr": 5e-5, "steps": 7, "splits": ["a"], "empty": "kept", "seed": 9, "new": 1}
    assert config.read_map(spark, str(tmp_path / "c.json")) == {"lr": 1.0} and config.coerced(1, "x") == "x" and config.coerced(True, "x") == "x"
    assert config.one_source("r", None, None) == "dataset_root"
    for bad in ((None, None, None), ("a", "b", None)):
        with pytest.raises(ValueError):
            config.one_source(*bad)
    assert config.faults({"resolution": 512}) == []
    assert len(config.faults({"resolution": 9, "proportion_empty_prompts": 2, "strength": 0, "rss_weight": -1, "rss_threshold": 1, "validation_image": ["a", "b"], "validation_prompt": ["c", "d", "e"]})) == 6
    lacking = spark.createDataFrame([('[{"seed": 1, "num_inference_steps": 3}]',)], "value string")
    with pytest.raises(Exception, match="candidate 0 lacks controlnet_conditioning_scale"):
        config.candidates(lacking).collect()


def test_lookups_are_exact(spark):
    df = spark.createDataFrame([(1, 10), (2, 30)], "i int, timestep int")
    schedule = spark.createDataFrame([(10, 0.5), (20, 0.2)], "timestep int, sigma double")
    assert schedules.with_sigma(df.where("i = 1"), schedule).first()["sigma"] == 0.5
    with pytest.raises(Exception, match="not one noise level for timestep 30"):
        schedules.with_sigma(df, schedule).collect()
    known = spark.createDataFrame([(10, "a"), (30, "b"), (30, "c")], "timestep int, v string")
    assert pairing.with_lookup(df.where("i = 1"), known, "timestep").first()["v"] == "a"
    with pytest.raises(Exception, match="not one row for 30"):
        pairing.with_lookup(df, known, "timestep").collect()


def test_matched_lists_and_shuffles(spark):
    def frame(n: int, name: str):
        return spark.createDataFrame([(i, f"{name}{i}") for i in range(n)], f"at int, {name} string")

    assert {(r["a"], r["b"]) for r in pairing.matched(frame(2, "a"), frame(2, "b")).collect()} == {("a0", "b0"), ("a1", "b1")}
    assert {(r["a"], r["b"]) for r in pairing.matched(frame(1, "a"), frame(2, "b")).collect()} == {("a0", "b0"), ("a0", "b1")}
    with pytest.raises(ValueError):
        pairing.matched(frame(2, "a"), frame(3, "b"))
    order = [r["a"] for r in pairing.shuffled(frame(20, "a"), "a", 5).collect()]
    assert sorted(order) != order and order == [r["a"] for r in pairing.shuffled(frame(20, "a").repartition(3), "a", 5).collect()]


def test_moments_merge_upward(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3))
    rows = [(f"g{i % 2}", f"s{i % 3}", i % 5 % 2, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, s string, side int, f array<double>")
    got = {(r["level"], r["g"], r["s"]): r["distance"] for r in frechet.frechet_levels(df.repartition(5), "g", "s", "side", "f", ("0", "1")).collect()}

    def want(keep) -> float:
        return frechet.distance(*(frechet.moments(x[[i for i, r in enumerate(rows) if r[2] == side and keep(r)]]) for side in (0, 1)))

    assert len(got) == 6 + 2 + 1
    assert got["all", None, None] == pytest.approx(want(lambda r: True)) and got["group", "g1", None] == pytest.approx(want(lambda r: r[0] == "g1"))
    assert got["sub", "g0", "s2"] == pytest.approx(want(lambda r: r[0] == "g0" and r[1] == "s2"))
    with pytest.raises(Exception, match="different lengths"):
        frechet.frechet(spark.createDataFrame([("k", 0, [1.0]), ("k", 1, [1.0, 2.0])], "g string, side int, f array<double>").coalesce(1), "g", "side", "f", ("0", "1")).collect()


def _per_image(spark):
    nan = float("nan")
    rows = [("rain", "rain_a", "x", 30.0, 0.5, nan, 1.0), ("rain", "rain_a", "y", 20.0, 0.7, 0.2, 2.0), ("snow", "snow_b", "z", 10.0, 0.1, nan, 3.0)]
    return spark.createDataFrame(rows, "weather string, sub_name string, stem string, psnr double, ssim double, lpips double, infer_time double")


def test_report_file(spark):
    report = reports.metrics_report(_per_image(spark))
    lines = sinks.report_lines(report.withColumn("fid", F.lit(float("nan"))), {"Model": "m"}, ["rain", "snow"], "Report")
    assert lines[1] == "Report" and lines[3] == "Model:            m"
    assert f"{'rain_a':<28} {'rain':<8} {2:>5} {25.0:>10.4f} {0.6:>10.4f} {0.2:>10.4f} {'  N/A  ':>10} {1.5:>12.2f}" in lines
    assert f"{'snow':<12} {1:>5} {10.0:>10.4f} {0.1:>10.4f} {'  N/A  ':>10} {'  N/A  ':>10} {3.0:>12.2f}" in lines
    assert lines[-2] == f"{'ALL':<12} {3:>5} {20.0:>10.4f} {1.3 / 3:>10.4f} {0.2:>10.4f} {'  N/A  ':>10} {'-':>12}"
    step = sinks.step_lines(report.where("level = 'group'").select("weather", "psnr", "ssim"), {"Step": 5})
    assert step == ["Step: 5", "", "Per-weather metrics:", "  rain      PSNR=25.000 dB  SSIM=0.6000", "  snow      PSNR=10.000 dB  SSIM=0.1000", "", "Average:        PSNR=17.500 dB  SSIM=0.3500"]
    assert sinks.step_lines(report.where("false"), {"Step": 5})[-1] == "Per-weather metrics:"


def test_image_lines_start_with_comments(spark, tmp_path):
    sinks.write_image_lines(sinks.image_lines(_per_image(spark)), str(tmp_path / "l"))
    files = sorted((tmp_path / "l" / "sub_name=rain_a").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines() == ["# Per-image metrics for subdataset=rain_a", "# name, PSNR, SSIM, LPIPS, infer_time(s)", "x, 30.0000, 0.5000, nan, 1.00", "y, 20.0000, 0.7000, 0.2000, 2.00"]


def test_seed_tables_and_their_json(spark):
    nan = float("nan")
    rows = [("s", "rain", i, seed, pos, 2.0, 10.0 * i + pos, 0.5, nan if pos else 0.25, float(pos)) for i in (0, 1) for pos, seed in enumerate((7, 5, 3))]
    runs = spark.createDataFrame(rows, "subdataset string, weather string, image_index int, seed int, seed_pos int, elapsed_sec double, psnr double, ssim double, lpips double, diversity double")
    lq = spark.createDataFrame([("s", 0, 1.0, 0.1, nan), ("s", 1, 3.0, 0.3, 0.5)], "subdataset string, image_index int, lq_psnr double, lq_ssim double, lq_lpips double")
    files = spark.createDataFrame([("s", 0, "l0", "g0"), ("s", 1, "l1", "g1")], "subdataset string, image_index int, lq_path string, gt_path string")
    seeds, table = reports.seed_table(runs, lq), reports.image_table(runs, files)
    per = {r["seed"]: r for r in seeds.collect()}
    assert len(seeds.columns) == 11 and per[7]["mean_diversity_lpips_vs_seed0"] == 0 and per[3]["mean_diversity_lpips_vs_seed0"] == 2
    assert per[7]["mean_lpips"] == 0.25 and math.isnan(per[5]["mean_lpips"]) and (per[5]["lq_mean_psnr"], per[5]["lq_mean_lpips"]) == (2.0, 0.5)
    image = table.where("image_index = 1").first()
    assert len(table.columns) == 17 and (image["best_psnr_seed"], image["worst_psnr_seed"], image["psnr_range"], image["lpips_range"]) == (3, 7, 2.0, 0.0)
    summary = reports.summary_table(seeds, table, 7)
    s = summary.first()
    assert len(summary.columns) == 17 and (s["n_samples"], s["diversity_lpips_mean"], s["diversity_lpips_max"], s["images_with_psnr_range_ge_0_5_pct"]) == (2, 1.5, 2.0, 100.0)
    assert math.isnan(s["lpips_mean"])
    got = json.loads(sinks.seed_json(seeds, summary).first()["value"])
    assert [r["seed"] for r in got["per_seed"]] == [3, 5, 7] and got["summary"]["s"]["n_samples"] == 2
    stats = spark.createDataFrame([(1.0, 2)], "psnr_mean double, best_at int")
    assert json.loads(sinks.sweep_json(seeds, stats, {"a": "b"}).first()["value"])["stats"] == {"psnr_mean": 1.0, "best_at": 2}


def test_written_tables_go(spark, tmp_path):
    t = session.materialize(spark.range(3), "t")
    path = session._path_of[t]
    assert t.count() == 3 and path in session._tables
    session.discard(t)
    assert path not in session._tables
    session.materialize(spark.range(3), "t")
    session.drop_tables(spark)
    assert not session._tables


def test_the_library_stands_without_its_training_data_side(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'eval_report' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_listing_pairs_like_its_two_sides(spark):
    rows = [("a", "gt", "g/a.png"), ("a", "gt", "g/a.jpg"), ("a", "lq", "l/a.png"), ("b", "gt", "g/b.png"), ("c", "lq", "l/c.png"), ("d", "other", "o/d.png"), ("e", None, "e.png")]
    files = spark.createDataFrame(rows, "stem string, side string, path string")
    side = F.col("side")
    got = [tuple(r) for r in pairing.pair_sides(files, side == "gt", side == "lq", ["stem"]).collect()]
    assert got == [tuple(r) for r in pairing.pair(files.where(side == "gt"), files.where(side == "lq"), ["stem"]).collect()] == [("a", "g/a.jpg", "l/a.png")]
    assert pairing.pair_sides(files.limit(0), side == "gt", side == "lq", ["stem"]).count() == 0
