"""Registered queries of the evaluation side, each with the SQL that must give the same rows.

The test tables hold no images: an embedding stands for an 8 x 8 patch with values
(x + 1) / 2, its target is the next patch of the same label among 200 ids. Label is the
weather, vec_id % 3 the sub-dataset. Runs over seeds come from lineitem (see FIXTURES.md).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumapair.functions import images, paths, pixels, prompts, schedules
from lumapair.operators import frechet, pairing, places, quality, reports, validation
from lumapair.session import folder, ship, table
from lumapair.sources import config, sinks, tables, trees

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _r(c, digits: int = 6):
    return F.round(c, digits)


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, weather, sub, pred, target"""
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("weather"), (F.col("vec_id") % 3).alias("sub"), pixels.unit_range(F.col("embedding")).alias("pred"))
    following = F.lead("pred").over(Window.partitionBy("weather", F.floor(F.col("vec_id") / 200)).orderBy("vec_id"))
    return own.withColumn("target", following).where("target IS NOT NULL")


_PATCHES = """p AS (SELECT vec_id, label AS weather, vec_id % 3 AS sub, list_transform(embedding, lambda x: least(greatest((x::DOUBLE + 1) / 2, 0.0::DOUBLE), 1.0::DOUBLE)) AS pred FROM embeddings),
    q AS (SELECT *, lead(pred) OVER (PARTITION BY weather, vec_id // 200 ORDER BY vec_id) AS target FROM p),
    e AS (SELECT vec_id, weather, sub, list_transform(range(1, len(pred) + 1), lambda i: pred[i] - target[i]) AS d FROM q WHERE target IS NOT NULL),
    m AS (SELECT vec_id, weather, sub, d, list_avg(list_transform(d, lambda v: v * v)) AS mse FROM e),
    s AS (SELECT vec_id, weather, sub, d, mse, CASE WHEN mse <= 1e-12 THEN 100.0 ELSE -10 * log10(mse) END::DOUBLE AS psnr FROM m)"""


@query("SELECT d.doc_id, concat(d.source, '/', d.doc_id, '.png') AS gt_path, concat('lq/', d.doc_id, '.png') AS lq_path FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def pair_inner(spark, sf_dir):
    gt = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".png")).alias("path"))
    lq = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("lq/"), "doc_id", F.lit(".png")).alias("path"))
    return pairing.pair(gt.where(paths.is_image(F.col("path"))), lq.where(paths.is_image(F.col("path"))), ["doc_id"])


@query("SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION SELECT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def pair_unmatched(spark, sf_dir):
    return pairing.unmatched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 20")
def head_limit_per_group(spark, sf_dir):
    return pairing.head_per_group(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", [F.col("doc_id")], 20)


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('20240805:', doc_id)), doc_id) AS n FROM documents) WHERE n <= 20")
def hash_sample_per_group(spark, sf_dir):
    return pairing.sample_per_group(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 20, 20240805)


def _prompted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(F.lit("rain"), F.lit("snow"), F.lit("haze")), (F.col("doc_id") % 3 + 1).cast("int")).alias("weather"), F.concat_ws("/", "source", "doc_id").alias("path"))
    return docs.withColumn("prompt", prompts.prompt(F.col("path"), F.col("weather"), 0.2))


_PROMPTED = """w AS (SELECT doc_id, ['rain', 'snow', 'haze'][doc_id % 3 + 1] AS weather, concat(source, '/', doc_id) AS path FROM documents),
    x AS (SELECT doc_id, weather, CASE WHEN (concat('0x', left(md5(path), 8))::BIGINT % 1000000) / 1000000.0::DOUBLE < 0.2 THEN CASE weather WHEN 'rain' THEN 'rainy scene, rain streaks on the image, wet surfaces, overcast sky' WHEN 'snow' THEN 'snowy scene, snowflakes covering the image, cold atmosphere, white noise' ELSE 'hazy scene, foggy atmosphere, low visibility, grayish tone' END ELSE '' END AS prompt FROM w)"""


@query(f"WITH {_PROMPTED} SELECT doc_id, weather, prompt FROM x")
def prompt_assign(spark, sf_dir):
    return _prompted(spark, sf_dir).select("doc_id", "weather", "prompt")


@query(f'WITH {_PROMPTED}, y AS (SELECT prompt, min(doc_id) AS "first", count(*) AS n FROM x GROUP BY prompt) SELECT prompt, "first", n, round(n / sum(n) OVER (), 6) AS share, row_number() OVER (ORDER BY "first") - 1 AS prompt_id FROM y')
def prompt_dictionary(spark, sf_dir):
    return pairing.prompt_dictionary(_prompted(spark, sf_dir), "prompt", "doc_id").withColumn("share", _r("share"))


@query(f"WITH {_PATCHES} SELECT vec_id, round(psnr, 6) AS psnr, round(list_avg(list_transform(d, lambda v: abs(v))), 6) AS l1, round(list_avg(list_transform(d, lambda v: sqrt(v * v + 1e-6))), 6) AS charbonnier FROM s")
def psnr_per_sample(spark, sf_dir):
    a, b = F.col("pred"), F.col("target")
    return patches(spark, sf_dir).select("vec_id", _r(pixels.psnr(a, b)).alias("psnr"), _r(pixels.l1(a, b)).alias("l1"), _r(pixels.charbonnier(a, b)).alias("charbonnier"))


@query(f"WITH {_PATCHES} SELECT weather, round(-10 * log10(avg(mse)), 6) AS psnr_pooled FROM s GROUP BY weather")
def psnr_pooled(spark, sf_dir):
    per = patches(spark, sf_dir).withColumn("mse", pixels.mse(F.col("pred"), F.col("target")))
    return per.groupBy("weather").agg(_r(pixels.psnr_of(F.avg("mse"))).alias("psnr_pooled"))


_PIXELS = """px AS (SELECT vec_id, unnest(range(0, 64)) AS m, unnest(pred) AS a, unnest(target) AS b FROM q WHERE target IS NOT NULL),
    nb AS (SELECT k, m, k // 8 - m // 8 AS dy, k % 8 - m % 8 AS dx FROM (SELECT unnest(range(0, 64)) AS k), (SELECT unnest(range(0, 64)) AS m))"""
_SSIM = """g AS (SELECT k, m, exp(-(dy * dy + dx * dx) / 4.5::DOUBLE) / (SELECT pow(sum(exp(-(d * d) / 4.5::DOUBLE)), 2) FROM (SELECT unnest(range(-5, 6)) AS d)) AS w FROM nb WHERE abs(dy) <= 5 AND abs(dx) <= 5),
    f AS (SELECT vec_id, k, sum(w * a) AS ma, sum(w * b) AS mb, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab FROM px JOIN g ON px.m = g.m GROUP BY vec_id, k),
    ss AS (SELECT vec_id, avg(((2 * ma * mb + 1e-4) * (2 * (ab - ma * mb) + 9e-4)) / ((ma * ma + mb * mb + 1e-4) * (aa - ma * ma + bb - mb * mb + 9e-4))) AS ssim FROM f GROUP BY vec_id)"""


@query(f"WITH {_PATCHES}, {_PIXELS}, {_SSIM} SELECT vec_id, round(ssim, 6) AS ssim FROM ss")
def ssim_per_sample(spark, sf_dir):
    ship(spark)
    scored = images.with_pair_score(patches(spark, sf_dir).select("vec_id", "pred", "target"), "ssim", images.ssim)
    return scored.select("vec_id", _r("ssim").alias("ssim"))


@query(
    f"""WITH {_PATCHES}, {_PIXELS}, e1 AS (SELECT vec_id, k, sum(a * -dx * (2 - abs(dy))) AS ax, sum(a * -dy * (2 - abs(dx))) AS ay, sum(b * -dx * (2 - abs(dy))) AS bx, sum(b * -dy * (2 - abs(dx))) AS by_
        FROM px JOIN nb ON px.m = nb.m WHERE abs(dy) <= 1 AND abs(dx) <= 1 GROUP BY vec_id, k)
    SELECT vec_id, round(avg(abs(sqrt(ax * ax + ay * ay + 1e-12) - sqrt(bx * bx + by_ * by_ + 1e-12))), 6) AS edge_l1 FROM e1 GROUP BY vec_id"""
)
def sobel_edge_l1(spark, sf_dir):
    ship(spark)
    scored = images.with_pair_score(patches(spark, sf_dir).select("vec_id", "pred", "target"), "edge_l1", images.edge_l1)
    return scored.select("vec_id", _r("edge_l1").alias("edge_l1"))


def per_image(spark, sf_dir):
    """vec_id, weather, sub_name, psnr, ssim, lpips (NaN for each tenth), infer_time"""
    a, b = F.col("pred"), F.col("target")
    scored = images.with_pair_score(patches(spark, sf_dir), "ssim", images.ssim)
    lpips = F.when(F.col("vec_id") % 10 == 0, float("nan")).otherwise(pixels.l1(a, b))
    name = F.concat(F.lit("w"), F.col("weather").cast("string"), F.lit("_"), F.col("sub").cast("string"))
    return scored.select("vec_id", "weather", name.alias("sub_name"), pixels.psnr(a, b).alias("psnr"), "ssim", lpips.alias("lpips"), (F.col("vec_id") % 7 / 10.0).alias("infer_time"))


_IMAGES = f"""{_PATCHES}, {_PIXELS}, {_SSIM}, im AS (SELECT s.vec_id, weather, concat('w', weather, '_', sub) AS sub_name, psnr, ssim, CASE WHEN s.vec_id % 10 <> 0 THEN list_avg(list_transform(d, lambda v: abs(v))) END AS lpips, s.vec_id % 7 / 10.0::DOUBLE AS infer_time FROM s JOIN ss ON s.vec_id = ss.vec_id)"""


@query(
    f"""WITH {_IMAGES} SELECT weather, sub_name, count(*) AS n, round(avg(psnr), 6) AS psnr, round(avg(ssim), 6) AS ssim, round(avg(lpips), 6) AS lpips, CASE WHEN grouping(weather) = 0 THEN round(avg(infer_time), 6) END AS avg_time,
    CASE grouping(weather) + grouping(sub_name) WHEN 0 THEN 'sub' WHEN 1 THEN 'group' ELSE 'all' END AS level FROM im GROUP BY GROUPING SETS ((weather, sub_name), (weather), ())"""
)
def metrics_report(spark, sf_dir):
    ship(spark)
    return reports.metrics_report(per_image(spark, sf_dir)).withColumns({c: _r(c) for c in ("psnr", "ssim", "lpips", "avg_time")})


@query(
    f"""WITH {_IMAGES}, w AS (SELECT weather, avg(psnr) AS psnr, avg(ssim) AS ssim FROM im GROUP BY weather)
    SELECT 500::BIGINT AS step, concat('val/', weather, '/psnr') AS key, round(psnr, 6) AS value FROM w UNION ALL SELECT 500, concat('val/', weather, '/ssim'), round(ssim, 6) FROM w
    UNION ALL SELECT 500, 'val/avg_psnr', round(avg(psnr), 6) FROM w UNION ALL SELECT 500, 'val/avg_ssim', round(avg(ssim), 6) FROM w"""
)
def step_scalars(spark, sf_dir):
    ship(spark)
    report = reports.metrics_report(per_image(spark, sf_dir)).where("level = 'group'")
    return reports.step_scalars(report.select(F.col("weather").cast("string").alias("weather"), "psnr", "ssim"), 500).withColumn("value", _r("value"))


@query("SELECT coalesce(round(avg(value), 6), 0) AS value, 0.0::DOUBLE AS none FROM events")
def pair_means(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    none = reports.pair_means(e.where("event_id < 0").select(F.col("value").alias("none")), ["none"])
    return reports.pair_means(e, ["value"]).select(_r("value").alias("value")).crossJoin(none)


@query(
    f"""WITH {_PATCHES} SELECT weather, sub, count(*) AS n, round(avg(psnr), 6) AS mean_psnr,
    CASE grouping(weather) + grouping(sub) WHEN 0 THEN 'sub' WHEN 1 THEN 'group' ELSE 'all' END AS level FROM s GROUP BY GROUPING SETS ((weather, sub), (weather), ())"""
)
def eval_report(spark, sf_dir):
    per = patches(spark, sf_dir).withColumn("psnr", pixels.psnr(F.col("pred"), F.col("target")))
    return reports.rollup_report(per.select("weather", "sub", "psnr"), "weather", "sub", {"mean_psnr": _r(F.avg("psnr"))})


@query(f"WITH {_PATCHES}, g AS (SELECT avg(psnr) AS m FROM s GROUP BY weather) SELECT (SELECT round(avg(m), 6) FROM g) AS macro, round(avg(psnr), 6) AS micro FROM s")
def macro_vs_micro(spark, sf_dir):
    per = patches(spark, sf_dir).withColumn("psnr", pixels.psnr(F.col("pred"), F.col("target")))
    return reports.macro_and_micro(per, "weather", "psnr").select(_r("macro").alias("macro"), _r("micro").alias("micro"))


@query("SELECT l_returnflag, round(avg(l_extendedprice) FILTER (l_discount <> 0), 4) AS mean_score FROM lineitem GROUP BY l_returnflag")
def nan_skipping_mean(spark, sf_dir):
    score = F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(_r(reports.nan_mean(score), 4).alias("mean_score"))


_RUNS = "r AS (SELECT l_orderkey AS image, l_orderkey % 4 AS grp, l_linenumber AS seed, l_linenumber - 1 AS seed_pos, avg(l_extendedprice) / 999.1::DOUBLE AS score FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def runs(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("seed")).agg((F.avg("l_extendedprice") / 999.1).alias("score"))
    return per.withColumn("grp", F.col("image") % 4).withColumn("seed_pos", F.col("seed") - 1)


@query(f"WITH {_RUNS} SELECT grp, seed, count(*) AS n, round(avg(score), 6) AS mean_score FROM r GROUP BY grp, seed")
def seed_runs(spark, sf_dir):
    return reports.seed_means(runs(spark, sf_dir), "grp", "score").withColumn("mean_score", _r("mean_score"))


_STABLE = """i AS (SELECT grp, image, count(*) AS n_seeds, avg(score) AS score_mean, stddev_pop(score) AS score_std, max(score) - min(score) AS score_range,
    arg_min(seed, (-score, seed_pos)) AS best_seed, arg_min(seed, (score, seed_pos)) AS worst_seed, max(score) AS best_score, min(score) AS worst_score, max(score) - avg(score) AS oracle_gain FROM r GROUP BY grp, image)"""


def _stable(spark, sf_dir):
    return reports.image_stability(runs(spark, sf_dir), ["grp", "image"], "score")


@query(f"WITH {_RUNS}, {_STABLE} SELECT grp, image, n_seeds, round(score_mean, 7) AS score_mean, round(score_std, 7) AS score_std, round(score_range, 7) AS score_range, round(oracle_gain, 7) AS oracle_gain FROM i")
def seed_stability(spark, sf_dir):
    cols = [_r(c, 7).alias(c) for c in ("score_mean", "score_std", "score_range", "oracle_gain")]
    return _stable(spark, sf_dir).select("grp", "image", "n_seeds", *cols)


@query(f"WITH {_RUNS}, {_STABLE} SELECT grp, image, best_seed, worst_seed, round(best_score, 7) AS best_score, round(worst_score, 7) AS worst_score FROM i")
def best_worst_seed(spark, sf_dir):
    return _stable(spark, sf_dir).select("grp", "image", "best_seed", "worst_seed", _r("best_score", 7).alias("best_score"), _r("worst_score", 7).alias("worst_score"))


@query(
    f"""WITH {_RUNS}, {_STABLE}, g AS (SELECT grp, seed, avg(score) AS m FROM r GROUP BY grp, seed),
    a AS (SELECT grp, avg(m) AS score_mean, stddev_pop(m) AS score_std, count(*) AS n_seeds FROM g GROUP BY grp),
    b AS (SELECT grp, count(*) AS n_images, avg(score_range) AS range_mean, avg(oracle_gain) AS gain_mean, avg(CASE WHEN score_range >= 20 THEN 1.0 ELSE 0.0 END) * 100 AS wide_pct FROM i GROUP BY grp)
    SELECT a.grp, round(score_mean, 7) AS score_mean, round(score_std, 7) AS score_std, n_seeds, n_images, round(range_mean, 7) AS range_mean, round(gain_mean, 7) AS gain_mean, round(wide_pct, 7) AS wide_pct FROM a JOIN b ON a.grp = b.grp"""
)
def seed_summary(spark, sf_dir):
    out = reports.seed_summary(runs(spark, sf_dir), _stable(spark, sf_dir), "grp", "score", 20.0)
    return out.withColumns({c: _r(c, 7) for c in ("score_mean", "score_std", "range_mean", "gain_mean", "wide_pct")})


@query(f"WITH {_RUNS} SELECT o.image, round(avg(abs(o.score - f.score)), 7) AS difference_mean, round(max(abs(o.score - f.score)), 7) AS difference_max FROM r o JOIN r f ON o.image = f.image AND f.seed_pos = 0 AND o.seed_pos > 0 GROUP BY o.image")
def seed_diversity(spark, sf_dir):
    out = reports.against_first(runs(spark, sf_dir), ["image"], "score")
    return out.withColumns({c: _r(c, 7) for c in ("difference_mean", "difference_max")})


@query(f"WITH {_RUNS}, c AS (SELECT seed_pos AS pos, avg(score) AS score FROM r GROUP BY seed_pos) SELECT count(*) AS n, round(avg(score), 7) AS score_mean, round(stddev_pop(score), 7) AS score_std, round(min(score), 7) AS score_min, round(max(score), 7) AS score_max, arg_min(pos, (-score, pos)) AS best_at, arg_min(pos, (score, pos)) AS worst_at FROM c")
def sweep_stats(spark, sf_dir):
    per = runs(spark, sf_dir).groupBy(F.col("seed_pos").alias("pos")).agg(F.avg("score").alias("score"))
    return reports.sweep_stats(per, "score", "pos").withColumns({c: _r(c, 7) for c in ("score_mean", "score_std", "score_min", "score_max")})


_SEEDS = """l AS (SELECT *, l_orderkey % 4 AS z FROM lineitem), rr AS (SELECT concat('s', z) AS subdataset, ['rain', 'snow', 'haze'][z % 3 + 1] AS weather, l_orderkey AS image_index, l_linenumber AS seed, l_linenumber - 1 AS seed_pos,
        l_linenumber * 1.5::DOUBLE AS elapsed_sec, avg(l_extendedprice) / 99991 AS psnr, avg(l_discount) / 0.99991 AS ssim, CASE WHEN min(l_quantity) >= 3 THEN avg(l_tax) / 0.99991 END AS lpips, avg(l_quantity) / 50 AS diversity
        FROM l GROUP BY z, l_orderkey, l_linenumber),
    lq AS (SELECT concat('s', z) AS subdataset, l_orderkey AS image_index, avg(l_extendedprice) / 199982 AS lq_psnr, avg(l_discount) / 2 AS lq_ssim, avg(l_tax) * 2 AS lq_lpips FROM l GROUP BY z, l_orderkey),
    lm AS (SELECT subdataset, avg(lq_psnr) AS lq_mean_psnr, avg(lq_ssim) AS lq_mean_ssim, avg(lq_lpips) AS lq_mean_lpips FROM lq GROUP BY subdataset),
    st AS (SELECT subdataset, weather, seed, max(elapsed_sec) AS elapsed_sec, avg(psnr) AS mean_psnr, avg(ssim) AS mean_ssim, avg(lpips) AS mean_lpips, CASE WHEN min(seed_pos) = 0 THEN 0.0 ELSE avg(diversity) END AS mean_diversity_lpips_vs_seed0
        FROM rr GROUP BY subdataset, weather, seed),
    it AS (SELECT subdataset, weather, image_index, avg(psnr) AS psnr_mean, stddev_pop(psnr) AS psnr_std, max(psnr) - min(psnr) AS psnr_range, stddev_pop(ssim) AS ssim_std, max(ssim) - min(ssim) AS ssim_range,
        stddev_pop(lpips) AS lpips_std, max(lpips) - min(lpips) AS lpips_range, arg_min(seed, (-psnr, seed_pos)) AS best_psnr_seed, arg_min(seed, (psnr, seed_pos)) AS worst_psnr_seed, max(psnr) AS best_psnr, min(psnr) AS worst_psnr,
        max(psnr) - avg(psnr) AS oracle_psnr_gain FROM rr GROUP BY subdataset, weather, image_index)"""


def seed_scores(spark, sf_dir):
    """Runs over images and seeds, the scores of the degraded inputs, and paths; all from lineitem."""
    z = F.col("l_orderkey") % 4
    own = table(spark, sf_dir, "lineitem").select("*", F.concat(F.lit("s"), z.cast("string")).alias("subdataset"), F.element_at(F.array(F.lit("rain"), F.lit("snow"), F.lit("haze")), (z % 3 + 1).cast("int")).alias("weather"), F.col("l_orderkey").alias("image_index"))
    lpips = F.when(F.min("l_quantity") >= 3, F.avg("l_tax") / 0.99991).otherwise(float("nan"))
    per = own.groupBy("subdataset", "weather", "image_index", F.col("l_linenumber").alias("seed")).agg((F.avg("l_extendedprice") / 99991).alias("psnr"), (F.avg("l_discount") / 0.99991).alias("ssim"), lpips.alias("lpips"), (F.avg("l_quantity") / 50).alias("diversity"))
    lq = own.groupBy("subdataset", "image_index").agg((F.avg("l_extendedprice") / 199982).alias("lq_psnr"), (F.avg("l_discount") / 2).alias("lq_ssim"), (F.avg("l_tax") * 2).alias("lq_lpips"))
    files = lq.select("subdataset", "image_index", F.concat(F.lit("lq/"), "image_index").alias("lq_path"), F.concat(F.lit("gt/"), "image_index").alias("gt_path"))
    return per.withColumn("seed_pos", F.col("seed") - 1).withColumn("elapsed_sec", F.col("seed") * 1.5), lq, files


_SEED_COLUMNS = ["elapsed_sec", "mean_psnr", "mean_ssim", "mean_lpips", "mean_diversity_lpips_vs_seed0", "lq_mean_psnr", "lq_mean_ssim", "lq_mean_lpips"]
_IMAGE_COLUMNS = ["psnr_mean", "psnr_std", "psnr_range", "ssim_std", "ssim_range", "lpips_std", "lpips_range", "best_psnr", "worst_psnr", "oracle_psnr_gain"]
_SUMMARY_COLUMNS = ["psnr_mean", "psnr_std", "ssim_mean", "ssim_std", "lpips_mean", "lpips_std", "diversity_lpips_mean", "diversity_lpips_max", "lq_mean_psnr", "lq_mean_ssim", "lq_mean_lpips", "per_image_psnr_range_mean", "per_image_oracle_psnr_gain_mean", "images_with_psnr_range_ge_0_5_pct"]


def _rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in names)


@query(f"WITH {_SEEDS} SELECT st.subdataset, weather, seed, {_rounded(_SEED_COLUMNS)} FROM st JOIN lm ON st.subdataset = lm.subdataset")
def seed_table(spark, sf_dir):
    per, lq, _ = seed_scores(spark, sf_dir)
    return reports.seed_table(per, lq).withColumns({c: _r(c) for c in _SEED_COLUMNS})


@query(f"WITH {_SEEDS} SELECT subdataset, weather, image_index, concat('lq/', image_index) AS lq_path, concat('gt/', image_index) AS gt_path, {_rounded(_IMAGE_COLUMNS).replace('round(lpips_std, 6)', 'coalesce(round(lpips_std, 6), -1)').replace('round(lpips_range, 6)', 'coalesce(round(lpips_range, 6), -1)')}, best_psnr_seed, worst_psnr_seed FROM it")
def image_table(spark, sf_dir):
    """Images without a score in lpips have NaN there, shown as -1."""
    per, _, files = seed_scores(spark, sf_dir)
    out = reports.image_table(per, files).withColumns({c: _r(c) for c in _IMAGE_COLUMNS})
    return out.withColumns({c: F.nanvl(c, F.lit(-1.0)) for c in ("lpips_std", "lpips_range")})


@query(
    f"""WITH {_SEEDS}, sm AS (SELECT st.subdataset, weather, avg(mean_psnr) AS psnr_mean, stddev_pop(mean_psnr) AS psnr_std, avg(mean_ssim) AS ssim_mean, stddev_pop(mean_ssim) AS ssim_std, avg(mean_lpips) AS lpips_mean, stddev_pop(mean_lpips) AS lpips_std,
        avg(mean_diversity_lpips_vs_seed0) FILTER (seed <> 1) AS diversity_lpips_mean, max(mean_diversity_lpips_vs_seed0) FILTER (seed <> 1) AS diversity_lpips_max, any_value(lq_mean_psnr) AS lq_mean_psnr, any_value(lq_mean_ssim) AS lq_mean_ssim,
        any_value(lq_mean_lpips) AS lq_mean_lpips FROM st JOIN lm ON st.subdataset = lm.subdataset GROUP BY st.subdataset, weather),
    ov AS (SELECT subdataset, count(*) AS n_samples, avg(psnr_range) AS per_image_psnr_range_mean, avg(oracle_psnr_gain) AS per_image_oracle_psnr_gain_mean, avg(CASE WHEN psnr_range >= 0.5 THEN 1.0 ELSE 0.0 END) * 100 AS images_with_psnr_range_ge_0_5_pct FROM it GROUP BY subdataset)
    SELECT sm.subdataset, weather, n_samples, {_rounded(_SUMMARY_COLUMNS)} FROM sm JOIN ov ON sm.subdataset = ov.subdataset"""
)
def summary_table(spark, sf_dir):
    per, lq, _ = seed_scores(spark, sf_dir)
    return reports.summary_table(reports.seed_table(per, lq), reports.image_spread(per), 1).withColumns({c: _r(c) for c in _SUMMARY_COLUMNS})


@query("""WITH x AS (SELECT vec_id % 2 AS side, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT side, i, count(x) AS n, avg(x) AS m, var_samp(x) AS v FROM x GROUP BY side, i)
    SELECT side, max(n) AS n, round(sum(m * m), 6) AS mean_norm2, round(sum(v), 6) AS cov_trace FROM c GROUP BY side""")
def frechet_terms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).alias("side"), F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    return frechet.trace_terms(e, "side", "f").withColumns({c: _r(c) for c in ("mean_norm2", "cov_trace")})


@query()
def frechet_distance(spark, sf_dir):
    ship(spark)
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 2).alias("side"), "embedding")
    return frechet.frechet(e, "label", "side", "embedding", ("0", "1")).withColumn("distance", _r("distance"))


@query(
    """WITH e AS (SELECT label::VARCHAR AS label, (vec_id % 3)::VARCHAR AS sub, vec_id % 2 AS side, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
    m AS (SELECT label, sub, side, grouping(label) + grouping(sub) AS g, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c FROM e GROUP BY GROUPING SETS ((label, sub, side), (label, side), (side)))
    SELECT CASE a.g WHEN 0 THEN 'sub' WHEN 1 THEN 'group' ELSE 'all' END AS level, a.label, a.sub, round(pow(a.mx - b.mx, 2) + pow(a.my - b.my, 2) + a.vx + a.vy + b.vx + b.vy
        - 2 * sqrt(a.vx * b.vx + 2 * a.c * b.c + a.vy * b.vy + 2 * sqrt(greatest((a.vx * a.vy - a.c * a.c) * (b.vx * b.vy - b.c * b.c), 0))), 6) AS distance
    FROM m a JOIN m b ON a.side = 0 AND b.side = 1 AND a.g = b.g AND a.label IS NOT DISTINCT FROM b.label AND a.sub IS NOT DISTINCT FROM b.sub"""
)
def frechet_levels(spark, sf_dir):
    """Two components, for which the distance has a closed form."""
    ship(spark)
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 3).alias("sub"), (F.col("vec_id") % 2).alias("side"), F.slice("embedding", 1, 2).alias("f"))
    return frechet.frechet_levels(e, "label", "sub", "side", "f", ("0", "1")).withColumn("distance", _r("distance"))


@query(
    """WITH x AS (SELECT label, vec_id % 2 AS side, vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    c AS (SELECT a.label, a.side, a.i, b.i AS k, count(*) AS n, covar_samp(a.x, b.x) AS c FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i AND a.i // 16 * 16 <= b.i GROUP BY a.label, a.side, a.i, b.i),
    d AS (SELECT label, side, i, k, n, c FROM c UNION ALL SELECT label, side, k, i, n, c FROM c WHERE i <> k AND i // 16 = k // 16)
    SELECT label::VARCHAR AS key, side::VARCHAR AS side, (i // 16)::INT AS block, max(n) AS n, round(sum(c) FILTER (i = k), 6) AS trace, round(sum(c), 6) AS total, round(sum(c * c), 6) AS squares FROM d GROUP BY label, side, i // 16"""
)
def frechet_blocks(spark, sf_dir):
    """Blocks of 16 rows of each covariance."""
    ship(spark)
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 2).alias("side"), "embedding")
    bytes_ = 16 * 64 * 8
    return frechet.block_terms(frechet.moment_blocks(e, "label", "side", "embedding", bytes_), bytes_).withColumns({c: _r(c) for c in ("trace", "total", "squares")})


@query("SELECT label, round(sqrt(avg(x * x)), 6) AS rms, round(max(abs(x)), 6) AS abs_max FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label")
def tensor_diagnostics(spark, sf_dir):
    return quality.tensor_diagnostics(table(spark, sf_dir, "embeddings"), ["label"], "embedding").withColumns({c: _r(c) for c in ("rms", "abs_max")})


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value IS NULL) AS n_null, count(*) FILTER (isnan(value)) AS n_nan, count(*) FILTER (isinf(value)) AS n_inf, min(value) FILTER (isfinite(value)) AS finite_min, max(value) FILTER (isfinite(value)) AS finite_max FROM events GROUP BY event_type")
def nonfinite_guard(spark, sf_dir):
    return quality.nonfinite_guard(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("SELECT event_id AS step, event_id > 100 AND (event_id - 100) % 500 = 0 AS save, event_id > 100 AND (event_id - 100) % 2000 = 0 AS validate, event_id // 300 AS epoch, (event_id % 300) * 4 AS skip FROM events")
def step_triggers(spark, sf_dir):
    steps = quality.step_triggers(table(spark, sf_dir, "events").select(F.col("event_id").alias("step")), {"save": 500, "validate": 2000}, start=100)
    return quality.resume_point(steps, 300, 4)


@query("SELECT step, row_number() OVER (ORDER BY step DESC) <= 2 AS kept FROM (SELECT event_id AS step FROM events WHERE event_id % 500 = 0)")
def checkpoint_retention(spark, sf_dir):
    names = table(spark, sf_dir, "events").where("event_id % 500 = 0").select(F.concat(F.lit("checkpoint-"), "event_id").alias("name"))
    return quality.retention(names.select(paths.checkpoint_step(F.col("name")).alias("step")), 3)


@query(
    """WITH e AS (SELECT event_id, event_id % 30 + 1 AS steps, (event_id % 10 + 1) / 10.0::DOUBLE AS s FROM events), l AS (SELECT event_id, steps, s / (3 - s * 2) AS start, unnest(range(0, steps)) AS i FROM e)
    SELECT event_id, i::INT AS i, round(CASE WHEN steps = 1 THEN start ELSE start + (0.001 - start) * i / (steps - 1) END, 6) AS level FROM l"""
)
def flow_schedule(spark, sf_dir):
    """The noise levels of each event's schedule: as many as its id says, from its strength."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 30 + 1).alias("steps"), ((F.col("event_id") % 10 + 1) / 10.0).alias("strength"))
    levels = schedules.flow_schedule(schedules.flow_start_of(F.col("strength"), 3.0), F.col("steps"))
    return e.select("event_id", F.posexplode(levels).alias("i", "level")).withColumn("level", _r("level"))


@query(
    """WITH e AS (SELECT event_id, event_id % 30 + 2 AS n, event_id % 29 % (event_id % 30 + 2) AS step FROM events)
    SELECT event_id, step, round(0.5 * greatest((least(greatest(((n - least(step + 1, n - 1)) / n::DOUBLE - 1 / n::DOUBLE) / ((n - 1) / n::DOUBLE), 0.0), 1.0) - 0.2) / 0.8, 0.0), 6) AS weight FROM e"""
)
def rss_schedule(spark, sf_dir):
    """The correction weight after a step of each event's schedule."""
    n = F.col("event_id") % 30 + 2
    e = table(spark, sf_dir, "events").select("event_id", n.alias("n"), (F.col("event_id") % 29 % n).alias("step"))
    sigmas = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: (F.col("n") - i) / F.col("n").cast("double"))
    return e.select("event_id", "step", _r(schedules.rss_weight(sigmas, F.col("step").cast("int"), 0.5, 0.2)).alias("weight"))


_TREE = """f AS (SELECT doc_id, ['rain', 'snow', 'haze'][doc_id % 3 + 1] AS weather, doc_id // 3 % 4 AS s FROM documents),
    l AS (SELECT doc_id, weather, concat('set', s) AS sub, ['gt', 'test/GT', 'GT', 'gt'][s + 1] AS gt, ['lq', 'test/LQ', 'LQ', 'lq'][s + 1] AS lq FROM f WHERE doc_id % 7 <> 0)"""


@query(f"""WITH {_TREE} SELECT weather, concat(weather, '_', sub) AS sub_name, doc_id::VARCHAR AS stem, concat('tree/', weather, '/', sub, '/', gt, '/', doc_id, '.png') AS gt_path, concat('tree/', weather, '/', sub, '/', lq, '/', doc_id, '.JPG') AS lq_path FROM l""")
def eval_tree_pairs(spark, sf_dir):
    """Three layouts of sub-folders; set3 has its upper-case layout too, which does not count as the lower-case one has pairs."""
    ids = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(F.lit("rain"), F.lit("snow"), F.lit("haze")), (F.col("doc_id") % 3 + 1).cast("int")).alias("weather"), (F.floor(F.col("doc_id") / 3) % 4).cast("int").alias("s"))
    folder = F.concat(F.lit("tree/"), "weather", F.lit("/set"), F.col("s").cast("string"), F.lit("/"))

    def side(dirs, end):
        return F.concat(folder, F.element_at(F.array(*[F.lit(d) for d in dirs]), F.col("s") + 1), F.lit("/"), F.col("doc_id").cast("string"), F.lit(end))

    last = F.col("s") == 3
    degraded = F.when(F.col("doc_id") % 7 != 0, side(["lq", "test/LQ", "LQ", "lq"], ".JPG"))
    upper = [F.when(last, side([d] * 4, ".png")) for d in ("GT", "LQ")]
    files = ids.select(F.explode(F.array(side(["gt", "test/GT", "GT", "gt"], ".png"), degraded, *upper)).alias("path")).where("path IS NOT NULL")
    return trees.eval_pairs(files.where(paths.is_image(F.col("path"))), "tree", ["rain", "snow", "haze"], ["test"])


@query(f"WITH {_PATCHES} SELECT concat('sub', sub) AS sub_name, concat(vec_id, ', ', printf('%.4f', round(psnr, 4)), ', ', printf('%.4f', round(mse, 4)), ', 0.00') AS value FROM s")
def image_lines(spark, sf_dir):
    per = patches(spark, sf_dir).select(F.concat(F.lit("sub"), F.col("sub").cast("string")).alias("sub_name"), F.col("vec_id").cast("string").alias("stem"), F.lit(0.0).alias("infer_time"),
        _r(pixels.psnr(F.col("pred"), F.col("target")), 4).alias("psnr"), _r(pixels.mse(F.col("pred"), F.col("target")), 4).alias("mse"))
    return sinks.image_lines(per, metrics=("psnr", "mse"))


@query("SELECT event_type, count(*) FILTER (abs(value) / 1e4 < 1e-6) AS tiny, count(*) FILTER (abs(value) / 1e4 >= 1e-6 AND abs(value) / 1e4 < 1e-2) AS small, count(*) FILTER (abs(value) / 1e4 >= 1e-2) AS large FROM events GROUP BY event_type")
def magnitude_buckets(spark, sf_dir):
    return quality.magnitude_buckets(table(spark, sf_dir, "events").select("event_type", (F.col("value") / 1e4).alias("value")), ["event_type"], "value")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE event_id % 13 = 0) WHERE n <= 20")
def first_offenders(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 13 == 0, float("nan")).otherwise(F.col("value")))
    return quality.first_offenders(e, "event_type", "event_id", "value")


@query("SELECT event_type, event_id, event_id // 8 AS batch, round(avg(value) OVER (PARTITION BY event_type, event_id // 8), 6) AS batch_mean FROM events")
def batch_times(spark, sf_dir):
    out = quality.batch_times(table(spark, sf_dir, "events"), "event_type", "event_id", "value", 8)
    return out.select("event_type", "event_id", "batch", _r("batch_mean").alias("batch_mean"))


@query("SELECT event_id, round((event_id % 5) / greatest(event_id % 3, 1e-8), 6) AS ratio FROM events")
def rms_ratio(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", _r(quality.ratio((i % 5).cast("double"), (i % 3).cast("double"))).alias("ratio"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS n FROM documents) WHERE n <= 50")
def head_limit(spark, sf_dir):
    return pairing.head(table(spark, sf_dir, "documents").select("doc_id", "source"), [F.col("source"), F.col("doc_id")], 50).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('7:', doc_id)), doc_id) AS n FROM documents) WHERE n <= 50")
def hash_sample(spark, sf_dir):
    return pairing.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 7)


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat(concat('0x', left(md5(lang), 8))::BIGINT % 2147483648, ':', doc_id)), doc_id) AS n FROM documents WHERE lang IS NOT NULL) WHERE n <= 10")
def seeded_sample_per_group(spark, sf_dir):
    return pairing.seeded_sample_per_group(table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang", "doc_id"), "lang", "doc_id", 10)


_SAVED = """i AS (SELECT doc_id, ['rain', 'snow', 'haze'][doc_id % 3 + 1] AS weather, concat(['rain', 'snow', 'haze'][doc_id % 3 + 1], '_set', doc_id // 3 % 4) AS sub_name FROM documents),
    j AS (SELECT *, row_number() OVER (PARTITION BY sub_name ORDER BY doc_id) - 1 AS image_index FROM i)"""


def _indexed(spark, sf_dir):
    weather = F.element_at(F.array(F.lit("rain"), F.lit("snow"), F.lit("haze")), (F.col("doc_id") % 3 + 1).cast("int"))
    own = table(spark, sf_dir, "documents").select("doc_id", weather.alias("weather"), F.concat(weather, F.lit("_set"), (F.floor(F.col("doc_id") / 3) % 4).cast("string")).alias("sub_name"))
    return pairing.numbered_in_group(own, "sub_name", [F.col("doc_id")])


@query(f"WITH {_SAVED} SELECT doc_id, sub_name, image_index FROM j")
def position_in_group(spark, sf_dir):
    return _indexed(spark, sf_dir).select("doc_id", "sub_name", "image_index")


@query(
    """WITH a AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS place FROM events), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS place FROM documents)
    SELECT place, event_id, doc_id FROM a JOIN b USING (place)"""
)
def positional_pairs(spark, sf_dir):
    """Predictions and ground truth that only their order relates; the longer list is cut."""
    left = table(spark, sf_dir, "events").select("event_id", "ts")
    right = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    found = places.zipped(left, right, [F.col("ts").desc(), F.col("event_id")], [F.col("n_chars"), F.col("doc_id")])
    return found.select("place", "event_id", "doc_id")


_BATCHES = """o AS (SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY md5(concat('11:', epoch, ':', doc_id)), doc_id) - 1 AS place FROM documents, (SELECT unnest(range(0, 3))::INT AS epoch)),
    b AS (SELECT epoch, place // 16 AS batch, place, doc_id FROM o WHERE place < (SELECT count(*) // 16 * 16 FROM documents))"""


def _batched(spark, sf_dir):
    return places.batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 16, 11, 3, True)


@query(f"WITH {_BATCHES} SELECT epoch, batch, place, doc_id FROM b")
def epoch_batches(spark, sf_dir):
    return _batched(spark, sf_dir).select("epoch", "batch", "place", "doc_id")


@query(f"WITH {_BATCHES} SELECT epoch, batch, count(*)::INT AS n, string_agg(doc_id, ',' ORDER BY place) AS doc_ids FROM b GROUP BY epoch, batch")
def collated_batches(spark, sf_dir):
    stacked = places.collated(_batched(spark, sf_dir), ["doc_id"])
    return stacked.select("epoch", "batch", "n", F.array_join("doc_id", ",").alias("doc_ids"))


@query(
    f"""WITH {_SAVED}, k AS (SELECT *, count(*) OVER (PARTITION BY sub_name) AS n FROM j),
    c AS (SELECT *, CASE WHEN sub_name = 'rain_set1' THEN 3 WHEN weather = 'rain' THEN 5 WHEN weather = 'snow' THEN 0 WHEN sub_name = 'haze_set2' THEN 2000000 ELSE n END AS k FROM k)
    SELECT sub_name, concat(lpad(image_index::VARCHAR, 3, '0'), '_', doc_id, '_pred.png') AS pred FROM c WHERE image_index < k"""
)
def saved_images(spark, sf_dir):
    own = _indexed(spark, sf_dir)
    counts = pairing.save_counts(own.groupBy("weather", "sub_name").agg(F.count("*").alias("n")), {"rain_set1_num": 3, "rain_num": 5, "snow_num": 0, "haze_set2_num": 2000000, "haze_num": -1})
    return pairing.saved_images(own, counts, stem="doc_id").select("sub_name", "pred")


@query("SELECT event_id, round((1000 - event_id % 1000) / 1000.0::DOUBLE, 6) AS sigma FROM events")
def sigma_lookup(spark, sf_dir):
    schedule = spark.range(1000).select(F.col("id").alias("timestep"), ((1000 - F.col("id")) / 1000.0).alias("sigma"))
    return schedules.with_sigma(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1000).alias("timestep")), schedule).select("event_id", _r("sigma").alias("sigma"))


@query(f"WITH {_PROMPTED}, y AS (SELECT prompt, row_number() OVER (ORDER BY min(doc_id)) - 1 AS prompt_id FROM x GROUP BY prompt) SELECT x.doc_id, y.prompt_id FROM x JOIN y ON x.prompt = y.prompt")
def prompt_lookup(spark, sf_dir):
    own = _prompted(spark, sf_dir)
    known = pairing.prompt_dictionary(own, "prompt", "doc_id").select("prompt", "prompt_id")
    return pairing.with_lookup(own.select("doc_id", "prompt"), known, "prompt").select("doc_id", "prompt_id")


@query(
    """WITH p AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS at FROM benchmark), d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS at FROM documents)
    SELECT 'one prompt' AS kind, d.at, doc_id, length(text)::INT AS n FROM d, p WHERE p.at = 0 UNION ALL SELECT 'one image', p.at, doc_id, length(text)::INT FROM p, d WHERE d.at = 0
    UNION ALL SELECT 'both', p.at, doc_id, length(text)::INT FROM p JOIN d ON p.at = d.at"""
)
def validation_pairs(spark, sf_dir):
    """One prompt for all images, one image for all prompts, and as many of both."""
    prompt = places.placed(table(spark, sf_dir, "benchmark").select("item_id", "text"), [F.col("item_id")], "at").select("at", "text")
    image = places.placed(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], "at")
    as_many = image.join(prompt.select("at"), "at", "left_semi")
    kinds = {"one prompt": (image, prompt.where("at = 0")), "one image": (image.where("at = 0"), prompt), "both": (as_many, prompt)}
    found = [pairing.matched(i, p).select(F.lit(kind).alias("kind"), "at", "doc_id", F.length("text").alias("n")) for kind, (i, p) in kinds.items()]
    return found[0].union(found[1]).union(found[2])


def _weights(kernel: str) -> str:
    """SQL of the table r: weight of value k of n in result i of m."""
    return f"""z AS (SELECT n, m, greatest(n / m::DOUBLE, 1) AS scale, unnest(range(0, m)) AS i FROM (VALUES (8, 5), (4, 5), (16, 20), (16, 5), (8, 6)) AS v(n, m)),
    y AS (SELECT n, m, i, k, abs((k + 0.5 - (i + 0.5) * n / m) / scale) AS t FROM (SELECT *, unnest(range(0, n)) AS k FROM z)),
    x AS (SELECT n, m, i, k, {kernel} AS w FROM y), r AS (SELECT n, m, i, k, w / sum(w) OVER (PARTITION BY n, m, i) AS w FROM x)"""


_LINEAR = "greatest(0.0::DOUBLE, 1 - t)"
_CUBIC = "CASE WHEN t < 1 THEN 1.5::DOUBLE * t * t * t - 2.5::DOUBLE * t * t + 1 WHEN t < 2 THEN -0.5::DOUBLE * (t * t * t - 5 * t * t + 8 * t - 4) ELSE 0 END"
#: Patches of two shapes, 8 x 8 and 4 x 16, by their values; rows of both are resampled together.
_SHAPED = """h AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 4 END AS high, CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 16 END AS wide, pred FROM p),
    v AS (SELECT vec_id, high, wide, unnest(range(0, 64)) // wide AS row_, unnest(range(0, 64)) % wide AS col, unnest(pred) AS value FROM h)"""


def _shaped(spark, sf_dir):
    ship(spark)
    own = table(spark, sf_dir, "embeddings").select("vec_id", pixels.unit_range(F.col("embedding")).alias("values"))
    even = F.col("vec_id") % 2 == 0
    return own.withColumns({"height": F.when(even, 8).otherwise(4), "width": F.when(even, 8).otherwise(16)})


def _pixels_of(df: DataFrame, size: int) -> DataFrame:
    each = df.select("vec_id", F.posexplode("prepared").alias("at", "value"))
    return each.select("vec_id", F.floor(F.col("at") / size).alias("i"), (F.col("at") % size).cast("long").alias("j"), _r("value").alias("value"))


@query(
    f"""WITH {_PATCHES}, {_SHAPED}, {_weights(_LINEAR)}, s2 AS (SELECT vec_id, row_, col, value, high, wide, CASE WHEN high = 8 THEN 5 ELSE 20 END AS across FROM v)
    SELECT vec_id, a.i, CASE WHEN across = 20 THEN b.i - 8 ELSE b.i END AS j, round(sum(a.w * b.w * value), 6) AS value FROM s2 JOIN r a ON a.n = high AND a.m = 5 AND a.k = row_ JOIN r b ON b.n = wide AND b.m = across AND b.k = col
    WHERE across = 5 OR b.i BETWEEN 8 AND 12 GROUP BY vec_id, a.i, b.i, across"""
)
def short_side_patches(spark, sf_dir):
    """Short side to 5, bilinear, then the middle square."""
    return _pixels_of(images.with_prepared(_shaped(spark, sf_dir), 5, images.short_side_crop, channels=1), 5)


@query(
    f"""WITH {_PATCHES}, {_SHAPED}, {_weights(_CUBIC)}
    SELECT vec_id, a.i, b.i AS j, round(least(greatest(sum(a.w * b.w * value), 0.0), 1.0), 6) AS value FROM v JOIN r a ON a.n = high AND a.m = 5 AND a.k = row_ JOIN r b ON b.n = wide AND b.m = 5 AND b.k = col GROUP BY vec_id, a.i, b.i"""
)
def square_patches(spark, sf_dir):
    """To 5 x 5, bicubic, whatever the shape."""
    return _pixels_of(images.with_prepared(_shaped(spark, sf_dir), 5, images.square, channels=1), 5)


@query(
    f"""WITH {_PATCHES}, {_weights(_LINEAR)}, o AS (SELECT vec_id, weather, pred, target FROM q WHERE target IS NOT NULL AND weather < 6
        QUALIFY row_number() OVER (PARTITION BY weather ORDER BY md5(concat(concat('0x', left(md5(weather::VARCHAR), 8))::BIGINT % 2147483648, ':', vec_id)), vec_id) <= 7),
    u AS (SELECT vec_id, weather, unnest(range(0, 64)) AS l, unnest(pred) AS a, unnest(target) AS b FROM o),
    px AS (SELECT vec_id, weather, ra.i * 6 + rb.i AS m, sum(ra.w * rb.w * a) AS a, sum(ra.w * rb.w * b) AS b FROM u JOIN r ra ON ra.n = 8 AND ra.m = 6 AND ra.k = l // 8 JOIN r rb ON rb.n = 8 AND rb.m = 6 AND rb.k = l % 8 GROUP BY vec_id, weather, ra.i, rb.i),
    nb AS (SELECT k, m, k // 6 - m // 6 AS dy, k % 6 - m % 6 AS dx FROM (SELECT unnest(range(0, 36)) AS k), (SELECT unnest(range(0, 36)) AS m)), {_SSIM},
    im AS (SELECT px.vec_id, weather, -10 * log10(avg((a - b) * (a - b))) AS psnr, any_value(ssim) AS ssim FROM px JOIN ss ON px.vec_id = ss.vec_id GROUP BY px.vec_id, weather),
    w AS (SELECT weather, avg(psnr) AS psnr, avg(ssim) AS ssim FROM im GROUP BY weather)
    SELECT 1500::BIGINT AS step, concat('val/', weather, '/psnr') AS key, round(psnr, 6) AS value FROM w UNION ALL SELECT 1500, concat('val/', weather, '/ssim'), round(ssim, 6) FROM w
    UNION ALL SELECT 1500, 'val/avg_psnr', round(avg(psnr), 6) FROM w UNION ALL SELECT 1500, 'val/avg_ssim', round(avg(ssim), 6) FROM w"""
)
def step_validation(spark, sf_dir):
    """Seven patches of each of six weathers, brought to 6 x 6 and scored, as rows of a step log."""
    ship(spark)
    own = patches(spark, sf_dir).select(F.col("vec_id").alias("image_id"), "weather", "pred", "target", F.lit(8).alias("height"), F.lit(8).alias("width"))
    _, log = validation.step_validation(own, 1500, list(range(6)), 7, 6, channels=1)
    return log.withColumn("value", _r("value"))


@query("SELECT 'run1' AS run, event_id // 500 AS step, event_type AS key, round(avg(CASE WHEN event_id // 500 % 2 = 0 THEN value + 1 ELSE value END), 6) AS value FROM events GROUP BY event_id // 500, event_type")
def step_log(spark, sf_dir):
    """Means per 500 events, appended to a log; then every other step is appended once more with other values."""
    e = table(spark, sf_dir, "events").select(F.lit("run1").alias("run"), F.floor(F.col("event_id") / 500).alias("step"), F.col("event_type").alias("key"), "value")
    log = folder(spark, "step-log")
    means = lambda rows, v: rows.groupBy("run", "step", "key").agg(F.avg(v).alias("value"))
    tables.append_steps(means(e, F.col("value")), log)
    tables.append_steps(means(e.where("step % 2 = 0"), F.col("value") + 1), log)
    return tables.read_steps(spark, log).withColumn("value", _r("value"))


_TYPED = """f AS (SELECT d.doc_id, concat(source, '/', d.doc_id, CASE WHEN d.doc_id % 9 = 0 THEN '.gif' ELSE '.png' END) AS image, CASE WHEN l.doc_id IS NOT NULL THEN concat('lq/', d.doc_id, '.png') END AS conditioning_image, text,
        CASE WHEN d.doc_id % 11 = 0 THEN 'many' ELSE (quality + d.doc_id)::VARCHAR END AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    k AS (SELECT *, list_filter([CASE WHEN image IS NULL THEN 'image is null' END, CASE WHEN conditioning_image IS NULL THEN 'conditioning_image is null' END, CASE WHEN text IS NULL THEN 'text is null' END,
        CASE WHEN quality IS NOT NULL AND try_cast(quality AS BIGINT) IS NULL THEN 'quality is no bigint' END, CASE WHEN NOT coalesce(ends_with(image, '.png'), false) THEN 'image' END], lambda x: x IS NOT NULL) AS faults FROM f)"""


def _checked(spark, sf_dir):
    """Rows of a training table as text, some of them faulty."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.when(i % 9 == 0, ".gif").otherwise(".png")).alias("image"), "text")
    known = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("lq/"), "doc_id", F.lit(".png")).alias("conditioning_image"), "quality")
    rows = d.join(known, "doc_id", "left").withColumn("quality", F.when(i % 11 == 0, "many").otherwise((F.col("quality") + i).cast("string")))
    schema = "doc_id long, image string NOT NULL, conditioning_image string NOT NULL, text string NOT NULL, quality long"
    return tables.checked(rows, schema, {"image": paths.is_image(F.col("image"))})


@query(f"WITH {_TYPED} SELECT doc_id, image, conditioning_image, length(text)::INT AS n, quality::BIGINT AS quality FROM k WHERE len(faults) = 0")
def typed_rows(spark, sf_dir):
    return tables.accepted(_checked(spark, sf_dir)).select("doc_id", "image", "conditioning_image", F.length("text").alias("n"), "quality")


@query(f"WITH {_TYPED} SELECT doc_id, array_to_string(faults, ', ') AS faults FROM k WHERE len(faults) > 0")
def typed_rejects(spark, sf_dir):
    return tables.rejected(_checked(spark, sf_dir)).select(F.get_json_object("row", "$.doc_id").cast("long").alias("doc_id"), F.array_join("faults", ", ").alias("faults"))


@query(f'WITH {_PROMPTED}, y AS (SELECT prompt, min(doc_id) AS "first", count(*) AS n FROM x GROUP BY prompt) SELECT prompt, "first", n FROM y')
def cached_prompts(spark, sf_dir):
    """The prompts of a table through a cached map: built once, then read."""
    at, source = folder(spark, "cache"), f"{sf_dir}/documents.parquet"
    build = lambda _: pairing.prompt_dictionary(_prompted(spark, sf_dir), "prompt", "doc_id").select("prompt", "first", "n")
    tables.cached_map(spark, at, [source], build, "prompts-1", {"share": 0.2})

    def never(_):
        raise AssertionError("the table stands under its fingerprint")

    return tables.cached_map(spark, at, [source], never, "prompts-1", {"share": 0.2})


@query("SELECT place, doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS place FROM documents) WHERE place IN (0, 7, 50, 100, 499, 500, 999)")
def fetched_rows(spark, sf_dir):
    """Seven rows by their places in a table that is written in an order."""
    at = folder(spark, "placed")
    tables.write_by_place(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), [F.col("source"), F.col("doc_id")], at, 100)
    return tables.fetch(spark, at, [500, 0, 7, 50, 100, 499, 999, 7], 100).select("place", "doc_id", "source")


def _poly(factors: list[float], x: str) -> str:
    out = f"({factors[0]!r})::DOUBLE"
    for f in factors[1:]:
        out = f"({out} * {x} + ({f!r})::DOUBLE)"
    return out


def _tail(q: str) -> str:
    return f"{_poly(schedules.TAIL_TOP, q)} / {_poly(schedules.TAIL_BOTTOM, q)}"


@query(
    f"""WITH u AS (SELECT event_id, (concat('0x', left(md5(concat('5:', event_id)), 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM events),
    q AS (SELECT *, sqrt(-2 * ln(u)) AS lo, sqrt(-2 * ln(1 - u)) AS hi, (u - 0.5) AS r FROM u),
    z AS (SELECT *, CASE WHEN u < 0.02425 THEN {_tail("lo")} WHEN u > 1 - 0.02425 THEN -({_tail("hi")}) ELSE {_poly(schedules.MIDDLE_TOP, "(r * r)")} * r / {_poly(schedules.MIDDLE_BOTTOM, "(r * r)")} END AS z FROM q)
    SELECT event_id, round(z, 6) AS normal, trunc(1 / (1 + exp(-(z * 1.2 + 0.3))) * 1000)::INT AS logit_normal, trunc((1 - u - 1.29 * (cos(pi() / 2 * u) * cos(pi() / 2 * u) - 1 + u)) * 1000)::INT AS mode,
        trunc((1 - 1 / (tan(pi() / 2 * u) + 1)) * 1000)::INT AS cosine, trunc(u * 1000)::INT AS even FROM z"""
)
def timestep_draws(spark, sf_dir):
    """Timesteps of each event by the densities of the weighting schemes."""
    u = schedules.uniform_draw(F.col("event_id"), 5)
    drawn = lambda *a: schedules.timestep_index(schedules.timestep_density(F.col("u"), *a))
    e = table(spark, sf_dir, "events").select("event_id", u.alias("u"))
    return e.select(
        "event_id", _r(schedules.inverse_normal(F.col("u"))).alias("normal"), drawn("logit_normal", 0.3, 1.2).alias("logit_normal"), drawn("mode").alias("mode"), drawn("cosine").alias("cosine"), drawn("cosmap").alias("even"),
    )


@query(
    f"""WITH {_PATCHES}, t AS (SELECT vec_id, vec_id % 11 / 10.0::DOUBLE AS sigma, pred, target FROM q WHERE target IS NOT NULL)
    SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (1 - sigma) * pred[i] + sigma * target[i])), 6) AS blended, round(list_sum(list_transform(range(1, 65), lambda i: target[i] - pred[i])), 6) AS velocity,
        round(list_sum(pred), 6) AS clean, round(list_sum(list_transform(pred, lambda v: v * 2 - 1)), 6) AS signed, list_sum(list_transform(pred, lambda v: round_even(v * 255, 0)::INT))::BIGINT AS quantised,
        round(1 - sigma, 6) AS image_weight, (sigma / 1.1 * 1000)::DOUBLE::INT AS timestep, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN sigma > 0 THEN pred[i] + sigma * (target[i] - pred[i]) ELSE pred[i] END)), 6) AS corrected FROM t""".replace("(sigma / 1.1 * 1000)::DOUBLE::INT", "trunc(sigma / 1.1 * 1000)::INT")
)
def flow_terms(spark, sf_dir):
    """Blend, velocity and what they stand for, per patch; sums over its values."""
    own = patches(spark, sf_dir).withColumn("sigma", F.col("vec_id") % 11 / 10.0)
    x, n, sigma = F.col("pred"), F.col("target"), F.col("sigma")
    z, v = pixels.blend(x, n, sigma), pixels.velocity(x, n)
    total = lambda a: _r(F.aggregate(a, F.lit(0.0), lambda acc, y: acc + y))
    return own.select(
        "vec_id", total(z).alias("blended"), total(v).alias("velocity"), total(pixels.clean(z, v, sigma)).alias("clean"), total(pixels.signed_range(x)).alias("signed"),
        F.aggregate(pixels.quantised(x), F.lit(0).cast("long"), lambda acc, y: acc + y).alias("quantised"), _r(schedules.image_loss_weight(sigma)).alias("image_weight"),
        schedules.timestep_index(sigma / 1.1).alias("timestep"), total(schedules.toward(x, n, sigma)).alias("corrected"),
    )


@query("SELECT event_id, round(value + 0.5 * CASE WHEN event_id % 10 = 0 THEN value * 2 ELSE 0 END + 0.1 * (value + 1), 6) AS loss FROM events")
def total_loss(spark, sf_dir):
    v = F.col("value")
    terms = [(0.5, F.when(F.col("event_id") % 10 == 0, v * 2)), (0.1, v + 1)]
    return table(spark, sf_dir, "events").select("event_id", _r(schedules.total_loss(v, terms)).alias("loss"))


@query(
    """WITH e AS (SELECT event_id, event_id % 23 + 2 AS layers, event_id % 31 % (event_id % 23 + 2) AS block FROM events)
    SELECT event_id, block, (block < layers - 1 AND (block + 1) % 4 = 0) AS ends_stage, floor(block / (layers / (layers // 2)::DOUBLE))::INT AS residual FROM e"""
)
def stages(spark, sf_dir):
    """Whether a block ends a stage, and which control output it takes, in networks whose depth follows from the event."""
    layers = F.col("event_id") % 23 + 2
    e = table(spark, sf_dir, "events").select("event_id", layers.alias("layers"), (F.col("event_id") % 31 % layers).alias("block"))
    ends = F.array_contains(schedules.stage_indices(F.col("layers"), 4), F.col("block"))
    return e.select("event_id", "block", ends.alias("ends_stage"), schedules.residual_index(F.col("block"), F.col("layers"), F.floor(F.col("layers") / 2)).alias("residual"))


@query("SELECT doc_id, CASE WHEN (concat('0x', left(md5(doc_id::VARCHAR), 8))::BIGINT % 1000000) / 1000000.0::DOUBLE < 0.3 THEN '' ELSE ['one', 'two', 'three'][concat('0x', substr(md5(doc_id::VARCHAR), 9, 7))::BIGINT % 3 + 1] END AS caption FROM documents")
def caption_choice(spark, sf_dir):
    three = F.array(F.lit("one"), F.lit("two"), F.lit("three"))
    return table(spark, sf_dir, "documents").select("doc_id", prompts.caption(three, F.col("doc_id").cast("string"), 0.3, True).alias("caption"))


@query("SELECT concat('checkpoint-', max(event_id)) AS folder, max(event_id) AS step FROM events WHERE event_id % 500 = 0")
def resume_folder(spark, sf_dir):
    names = table(spark, sf_dir, "events").where("event_id % 500 = 0").select(F.concat(F.lit("checkpoint-"), "event_id").alias("name"))
    return trees.resume_folder(names.union(spark.range(1).select(F.lit("checkpoint-old"))))


@query("SELECT concat('runs/checkpoint-', max(event_id), '/controlnet') AS folder FROM events WHERE event_id % 500 = 0")
def checkpoint_folder(spark, sf_dir):
    files = table(spark, sf_dir, "events").where("event_id % 500 = 0").select(F.concat(F.lit("runs/checkpoint-"), "event_id", F.lit("/controlnet/config.json")).alias("path"))
    return trees.checkpoint_folder(files.union(spark.range(1).select(F.lit("runs/checkpoint-x/controlnet/config.json"))), "runs")


@query("SELECT event_id, i::INT AS at, (event_id + i)::INT AS seed, i + 0.5::DOUBLE AS controlnet_conditioning_scale, 30 AS num_inference_steps FROM events, (SELECT unnest(range(0, 2)) AS i) WHERE event_id % 100 = 0")
def candidates(spark, sf_dir):
    one = lambda i: F.concat(F.lit('{"seed":'), (F.col("event_id") + i).cast("string"), F.lit(f',"controlnet_conditioning_scale":{i}.5,"num_inference_steps":30}}'))
    e = table(spark, sf_dir, "events").where("event_id % 100 = 0").select("event_id", F.concat(F.lit("["), one(0), F.lit(","), one(1), F.lit("]")).alias("value"))
    found = config.candidates(e)
    # Seeds follow from the event, which leads back to it.
    return found.select((F.col("seed") - F.col("at")).cast("long").alias("event_id"), "at", "seed", "controlnet_conditioning_scale", "num_inference_steps")


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def time_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", paths.stamp(F.col("ts")).alias("stamp"))
