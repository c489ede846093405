"""Listings of image trees, and the pairs in them.

A tree is listed once, paths only (Spark does not read a file's content if that column
is not selected); what a folder means is taken from the path. Folders without an image
are not seen by a listing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumapair.functions import paths
from lumapair.operators import pairing


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """path of every image below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path").where(paths.is_image(F.col("path")))


def below(path: Column, root: str) -> Column:
    """What follows `root/` in a path; null if the path does not hold it."""
    at = F.instr(path, f"{root.rstrip('/')}/")
    return F.when(at > 0, F.substr(path, at + len(root.rstrip("/")) + 1))


def training_pairs(files: DataFrame, root: str, weathers: list[str], splits: list[str]) -> DataFrame:
    """weather, split, stem, gt_path, lq_path of `root/<weather>/<split>/{GT,LQ}/<file>`, for the named weathers and splits."""
    part = F.split(below(F.col("path"), root), "/")
    parts = files.select("path", part.alias("p")).where(F.size("p") == 4)
    named = parts.select("path", F.col("p")[0].alias("weather"), F.col("p")[1].alias("split"), F.col("p")[2].alias("side"), paths.stem(F.col("path")).alias("stem"))
    wanted = named.where(F.col("weather").isin(weathers) & F.col("split").isin(splits))
    return pairing.pair_sides(wanted, F.col("side") == "GT", F.col("side") == "LQ", ["weather", "split", "stem"])


def eval_pairs(files: DataFrame, root: str, weathers: list[str], splits: list[str]) -> DataFrame:
    """weather, sub_name, stem, gt_path, lq_path of `root/<weather>/<sub>/...`, each sub-folder by its own layout.

    Sub-folders named like a split are taken alone, if a weather has such. In a sub-folder
    the first layout that gives pairs counts: `gt` and `lq`, then `GT` and `LQ` in a folder
    of a split (in the order of splits), then `GT` and `LQ`.
    """
    part = F.split(below(F.col("path"), root), "/")
    parts = files.select("path", part.alias("p"), paths.stem(F.col("path")).alias("stem")).where(F.col("p")[0].isin(weathers))
    n, side, split = F.size("p"), F.element_at("p", -2), F.element_at("p", -3)
    split_at = F.array_position(F.array(*[F.lit(s) for s in splits]), split)
    upper = side.isin("GT", "LQ")
    rank = F.when((n == 4) & side.isin("gt", "lq"), 0).when((n == 5) & upper & (split_at > 0), split_at).when((n == 4) & upper, len(splits) + 1)
    seen = parts.where(n >= 3).select("path", "stem", F.col("p")[0].alias("weather"), F.col("p")[1].alias("sub"), F.lower(side).alias("side"), rank.cast("int").alias("rank"))
    split_named = F.col("sub").isin(splits)
    per = seen.groupBy("weather").agg(F.max(split_named).alias("only_splits"))
    chosen = seen.join(per, "weather").where(~F.col("only_splits") | split_named).where("rank IS NOT NULL")
    pairs = pairing.pair_sides(chosen, F.col("side") == "gt", F.col("side") == "lq", ["weather", "sub", "rank", "stem"])
    first = pairs.groupBy("weather", "sub").agg(F.min("rank").alias("rank"))
    return pairs.join(first, ["weather", "sub", "rank"]).select("weather", paths.sub_name(F.col("weather"), F.col("sub")).alias("sub_name"), "stem", "gt_path", "lq_path")


def pick_columns(df: DataFrame, image: str | None = None, caption: str | None = None, conditioning: str | None = None) -> DataFrame:
    """image, caption, conditioning of df, by name, or by place (first, second, third) where no name is given."""
    given, names = [image, caption, conditioning], df.columns
    picked = []
    for at, name in enumerate(given):
        if name is None and at >= len(names) or name is not None and name not in names:
            raise ValueError(f"column {name or at} is not among {', '.join(names)}")
        picked.append(F.col(f"`{name or names[at]}`"))
    return df.select(*[c.alias(a) for c, a in zip(picked, ("image", "caption", "conditioning"))])


def missing_folders(files: DataFrame, root: str, weathers: list[str], splits: list[str]) -> DataFrame:
    """(weather, split) of the training folders without a pair; all of them missing is an error."""
    spark = files.sparkSession
    wanted = spark.createDataFrame([(w, s) for w in weathers for s in splits], "weather string, split string")
    found = training_pairs(files, root, weathers, splits).select("weather", "split").distinct()
    if found.isEmpty():
        raise ValueError(f"no pair below {root} in {', '.join(weathers)} and {', '.join(splits)}")
    return wanted.join(found, ["weather", "split"], "left_anti")


def eval_roots(config: dict, weathers: list[str]) -> dict[str, str]:
    """Folder of each weather: `dataset_<weather>`, else a folder of its name below `dataset_root`; weathers with neither are left out."""
    root = config.get("dataset_root")
    found = {w: config.get(f"dataset_{w}") or (f"{root.rstrip('/')}/{w}" if root else None) for w in weathers}
    return {w: r for w, r in found.items() if r}


def image_folder(spark: SparkSession, root: str) -> DataFrame:
    """path and the fields of metadata.jsonl (one JSON object per line, with file_name relative to its folder) of the images below root; images without an entry have nulls."""
    files = image_files(spark, root)
    look = {"recursiveFileLookup": "true", "pathGlobFilter": "metadata.jsonl"}
    if spark.read.format("binaryFile").options(**look).load(root).select("path").isEmpty():
        return files
    notes = spark.read.options(**look).json(root)
    folder = F.regexp_replace(F.col("_metadata.file_path"), r"[^/]*$", "")
    named = notes.withColumn("_path", F.concat(folder, "file_name")).drop("file_name")
    plain = lambda p: F.regexp_replace(p, r"^file:/+", "/")
    return files.join(named, plain(F.col("path")) == plain(F.col("_path")), "left").drop("_path")


def checkpoint_folder(files: DataFrame, root: str) -> DataFrame:
    """One row, folder: root if it holds config.json, else its `controlnet`, else that of the checkpoint with the largest number, else root."""
    part = F.split(below(F.col("path"), root), "/")
    p = files.select(part.alias("p")).where(F.element_at("p", -1) == "config.json")
    step = paths.checkpoint_step(F.col("p")[0])
    rank = F.when(F.size("p") == 1, F.lit(1 << 62)).when((F.size("p") == 2) & (F.col("p")[0] == "controlnet"), F.lit((1 << 62) - 1))
    rank = F.coalesce(rank, F.when((F.size("p") == 3) & (F.col("p")[1] == "controlnet"), step))
    base = root.rstrip("/")
    folder = F.concat_ws("/", F.lit(base), F.concat_ws("/", F.slice("p", 1, F.size("p") - 1)))
    best = p.where(rank.isNotNull()).agg(F.max_by(folder, rank).alias("folder"))
    return best.select(F.coalesce(F.regexp_replace("folder", "/+$", ""), F.lit(base)).alias("folder"))


def resume_folder(names: DataFrame, wanted: str = "latest", name: str = "name") -> DataFrame:
    """One row, (folder, step): the checkpoint to resume from; nulls if there is none. `latest` is the one with the largest number."""
    own = F.regexp_extract(F.lit(wanted.rstrip("/")), r"([^/]*)$", 1)
    step = paths.checkpoint_step(F.col(name))
    if wanted != "latest":
        return names.sparkSession.range(1).select(own.alias("folder"), paths.checkpoint_step(own).alias("step"))
    return names.agg(F.max_by(name, step).alias("folder"), F.max(step).alias("step"))
