"""Tables on the shared store: declared types with rejects, cached maps, a log of steps, rows by place."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumapair.operators.places import placed
from lumapair.session import exists, files_below, rename

#: Rows of a file of a placed table.
FILE_ROWS = 1_000_000


def checked(df: DataFrame, schema: str | StructType, rules: dict[str, Column] | None = None) -> DataFrame:
    """df with `typed` (the declared fields, cast) and `faults` (why a row does not meet the declaration; empty if it does).

    A field that the table lacks, a value that cannot be cast, and a null where `NOT NULL`
    is declared are faults; so is a rule (a column, by name) that is false or null.
    """
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    cast = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType) for f in fields}
    faults = []
    for f in fields:
        if f.name not in df.columns:
            faults.append(F.lit(f"{f.name} is missing"))
            continue
        faults.append(F.when(F.col(f"`{f.name}`").isNotNull() & cast[f.name].isNull(), f"{f.name} is no {f.dataType.simpleString()}"))
        if not f.nullable:
            faults.append(F.when(F.col(f"`{f.name}`").isNull(), f"{f.name} is null"))
    faults += [F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in (rules or {}).items()]
    return df.select("*", F.struct(*[c.alias(n) for n, c in cast.items()]).alias("typed"), F.array_compact(F.array(*faults)).alias("faults"))


def accepted(rows: DataFrame) -> DataFrame:
    """Of `checked` rows, those without a fault, with the declared columns alone."""
    return rows.where(F.size("faults") == 0).select("typed.*")


def rejected(rows: DataFrame) -> DataFrame:
    """Of `checked` rows, those with faults: the row as it came, as JSON, and the faults."""
    own = [c for c in rows.columns if c not in ("typed", "faults")]
    return rows.where(F.size("faults") > 0).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]), {"ignoreNullFields": "false"}).alias("row"), "faults")


def fingerprint(spark: SparkSession, inputs: list[str], version: str, options: dict) -> str:
    """What decides a cached map: the input files (path, size, time), the function's version and its options."""
    found = [files_below(spark, p) for p in inputs]
    return hashlib.sha256(json.dumps([found, version, options], sort_keys=True, default=str).encode()).hexdigest()


def cached_map(spark: SparkSession, folder: str, inputs: list[str], build: Callable[[list[DataFrame]], DataFrame], version: str, options: dict | None = None) -> DataFrame:
    """The table that `build` makes of the Parquet inputs, read if it stands under its fingerprint, else built.

    It is written aside and takes its name when it is whole, so that a lost driver leaves
    nothing behind that counts, and of two builders at once the first one's table stays.
    """
    path = f"{folder.rstrip('/')}/{fingerprint(spark, inputs, version, options or {})}"
    if not exists(spark, f"{path}/_SUCCESS"):
        aside = f"{path}-{uuid.uuid4().hex}"
        build([spark.read.parquet(p) for p in inputs]).write.parquet(aside)
        rename(spark, aside, path)
    return spark.read.parquet(path)


def append_steps(rows: DataFrame, path: str) -> None:
    """Add rows (run, step, key, value) to a log, as one batch. What the log has of a run's step is replaced, so that a repeated step counts once.

    A batch is a folder of few files, however many steps it has; it is written aside and takes its name when it is whole.
    """
    spark, log = rows.sparkSession, path.rstrip("/")
    own = rows.select("run", F.col("step").cast("long"), "key", F.col("value").cast("double").alias("value"))
    batches = {m[1] for f, _, _ in (files_below(spark, log) if exists(spark, log) else []) if (m := re.search(r"/batch=(\d+)-[^/]*/[^/]*$", f))}
    name = f"{max(map(int, batches), default=0) + 1:010d}-{uuid.uuid4().hex}"
    own.write.parquet(f"{log}/_{name}")
    rename(spark, f"{log}/_{name}", f"{log}/batch={name}")


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """run, step, key, value of a log, of each run's step the last batch that has it; none, if nothing has been written yet."""
    schema = "run string, step long, key string, value double, batch string"
    found = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    last = found.groupBy(F.col("run").alias("r"), F.col("step").alias("s")).agg(F.max("batch").alias("b"))
    same = F.col("run").eqNullSafe(F.col("r")) & F.col("step").eqNullSafe(F.col("s")) & (F.col("batch") == F.col("b"))
    return found.join(last, same).select("run", "step", "key", "value")


def write_by_place(df: DataFrame, order: list[Column], path: str, file_rows: int = FILE_ROWS) -> None:
    """A table in an order, with `place` from 0, in folders of file_rows places each."""
    at = placed(df, order, "place").withColumn("folder", F.floor(F.col("place") / file_rows))
    at.repartitionByRange("place").sortWithinPartitions("place").write.option("maxRecordsPerFile", file_rows).partitionBy("folder").parquet(path)


def fetch(spark: SparkSession, path: str, places: list[int], file_rows: int = FILE_ROWS) -> DataFrame:
    """Rows of `write_by_place` by their places, each once: folders are chosen by name, and within them files' statistics pass over what holds none."""
    wanted = sorted(set(places))
    return spark.read.parquet(path).where(F.col("folder").isin(sorted({p // file_rows for p in wanted})) & F.col("place").isin(wanted)).drop("folder")
