"""Report files: text lines per image, fixed-width tables, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(x: Column, digits: int = 4, missing: str = "nan") -> Column:
    """A number with fixed decimals; `missing` for NaN and null."""
    return F.when(x.isNull() | F.isnan(x), missing).otherwise(F.format_string(f"%.{digits}f", x))


def image_lines(per_image: DataFrame, sub: str = "sub_name", name: str = "stem", metrics: tuple[str, ...] = ("psnr", "ssim", "lpips"), seconds: str = "infer_time") -> DataFrame:
    """sub and value: one line per image, its metrics with four decimals and its seconds with two."""
    fields = [F.col(name), *[number(F.col(m).cast("double")) for m in metrics], number(F.col(seconds).cast("double"), 2)]
    return per_image.select(sub, F.concat_ws(", ", *fields).alias("value"))


def with_headings(lines: DataFrame, sub: str = "sub_name") -> DataFrame:
    """lines and, for each sub-dataset, the two comment lines that come first; `place` orders them."""
    heads = F.array(F.concat(F.lit("# Per-image metrics for subdataset="), F.col(sub)), F.lit("# name, PSNR, SSIM, LPIPS, infer_time(s)"))
    first = lines.select(sub).distinct().select(sub, F.posexplode(heads).alias("place", "value"))
    return first.unionByName(lines.select(sub, F.lit(2).alias("place"), "value"))


def write_image_lines(lines: DataFrame, path: str, sub: str = "sub_name") -> None:
    """A folder of text files per sub-dataset, the comment lines first, then the images by name. Files are cut by ranges, so a large sub-dataset is written by many tasks."""
    with_headings(lines, sub).repartitionByRange(sub, "place", "value").sortWithinPartitions(sub, "place", "value").select(sub, "value").write.partitionBy(sub).text(path)


def _cell(v: float | None, width: int = 10, digits: int = 4) -> str:
    return f"{v:>{width}.{digits}f}" if v is not None and v == v else f"{'N/A':^7}".rjust(width)


def report_lines(report: DataFrame, settings: dict[str, object], weathers: list[str], title: str) -> list[str]:
    """The report file of a metrics report (with fid, if it has that column): settings, sub-datasets, weathers, and all. The report has a row per sub-dataset, which the driver formats."""
    rows = [r.asDict() for r in report.orderBy("weather", "sub_name").collect()]
    rule, bar = "-" * 90, "=" * 90
    names = f"{'N':>5} {'PSNR (dB)':>10} {'SSIM':>10} {'LPIPS':>10} {'FID':>10} {'AvgTime(s)':>12}"

    def cells(r: dict) -> str:
        return " ".join([f"{r['n']:>5}", *(_cell(r.get(m)) for m in ("psnr", "ssim", "lpips", "fid")), "-".rjust(12) if r["avg_time"] is None else _cell(r["avg_time"], 12, 2)])

    out = [bar, title, bar, *(f"{k + ':':<17} {v}" for k, v in settings.items()), "", rule, "Per-Subdataset Metrics:", rule, f"{'Subdataset':<28} {'Weather':<8} {names}", rule]
    out += [f"{r['sub_name']:<28} {w:<8} {cells(r)}" for w in weathers for r in rows if r["level"] == "sub" and r["weather"] == w]
    out += ["", rule, "Per-Weather Aggregated Metrics:", rule, f"{'Weather':<12} {names}", rule]
    out += [f"{w:<12} {cells(r)}" for w in weathers for r in rows if r["level"] == "group" and r["weather"] == w]
    return [*out, rule, *(f"{'ALL':<12} {cells(r)}" for r in rows if r["level"] == "all"), bar]


def step_lines(report: DataFrame, settings: dict[str, object]) -> list[str]:
    """The file of a step validation (weather, psnr, ssim): settings, a line per weather, and the mean over weathers."""
    rows = report.orderBy("weather").collect()
    out = [*(f"{k}: {v}" for k, v in settings.items()), "", "Per-weather metrics:", *(f"  {r['weather']:8s}  PSNR={r['psnr']:.3f} dB  SSIM={r['ssim']:.4f}" for r in rows)]
    if rows:
        psnr, ssim = (sum(r[m] for r in rows) / len(rows) for m in ("psnr", "ssim"))
        out += ["", f"Average:        PSNR={psnr:.3f} dB  SSIM={ssim:.4f}"]
    return out


def seed_json(seeds: DataFrame, summary: DataFrame, sub: str = "subdataset") -> DataFrame:
    """value: one JSON text {per_seed, summary} of a seed table and a summary table, a row per seed and sub-dataset each."""
    options = {"ignoreNullFields": "false"}
    per = seeds.agg(F.array_sort(F.collect_list(F.struct(sub, "seed", *[c for c in seeds.columns if c not in (sub, "seed")]))).alias("per_seed"))
    own = summary.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(sub), F.struct(*[c for c in summary.columns if c != sub]))))).alias("summary"))
    return per.crossJoin(own).select(F.to_json(F.struct("per_seed", "summary"), options).alias("value"))


def sweep_json(results: DataFrame, stats: DataFrame, settings: dict[str, str]) -> DataFrame:
    """value: one JSON text {args, results, stats} of a sweep; results has a row per candidate."""
    rows = results.agg(F.array_sort(F.collect_list(F.struct(*results.columns))).alias("results"))
    args = F.create_map(*[F.lit(str(x)) for kv in settings.items() for x in kv]) if settings else F.create_map().cast("map<string,string>")
    return rows.crossJoin(stats.select(F.struct(*stats.columns).alias("stats"))).select(F.to_json(F.struct(args.alias("args"), "results", "stats")).alias("value"))


def table_lines(report: DataFrame, names: list[str], metrics: list[str], name_width: int = 12) -> DataFrame:
    """value: a fixed-width line per row of a rolled-up report; NaN and null metrics read N/A, null names ALL."""
    label = F.concat_ws(" ", *[F.rpad(F.coalesce(F.col(n).cast("string"), F.lit("ALL")), name_width, " ") for n in names])
    cells = [F.lpad(number(F.col(m).cast("double"), missing="N/A"), 10, " ") for m in metrics]
    return report.select(*names, F.concat_ws(" ", label, F.lpad(F.col("n").cast("string"), 5, " "), *cells).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; null fields are kept, so that all lines have the same keys."""
    df.write.option("ignoreNullFields", "false").json(path)
