"""Fréchet distances against plain NumPy, in all forms that a set of vectors can travel in."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumapair.operators import frechet


def plain(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) < 2 or len(b) < 2:
        return float("nan")
    sa, sb = np.atleast_2d(np.cov(a.T)), np.atleast_2d(np.cov(b.T))
    both = np.sqrt(np.maximum(np.linalg.eigvals(sa @ sb).real, 0)).sum()
    return float(np.square(a.mean(axis=0) - b.mean(axis=0)).sum() + np.trace(sa) + np.trace(sb) - 2 * both)


def sets() -> dict[tuple[str | None, str], np.ndarray]:
    """Few vectors against few, few against many, many against many, and sides that are missing or hold one vector."""
    rng = np.random.default_rng(4)
    sizes = {"few": (2, 4), "mixed": (3, 90), "mixed back": (200, 4), "many": (150, 333), "one": (1, 60), None: (5, 70)}
    found = {(k, s): rng.normal(rng.normal(), 1 + rng.random(8), (n, 8)) for k, both in sizes.items() for s, n in zip("pg", both)}
    return found | {("no g", "p"): rng.normal(size=(9, 8)), ("copies", "p"): np.ones((40, 8)), ("copies", "g"): np.zeros((3, 8))}


@pytest.mark.parametrize("partitions, block_bytes, fan", [(1, 1 << 20, 16), (9, 3 * 8 * 8, 2), (23, 1, 3)])
def test_every_form_gives_the_same_distance(spark, partitions, block_bytes, fan):
    own = sets()
    rows = [(k, s, v.tolist()) for (k, s), x in own.items() for v in x] + [("few", "p", None), ("nothing", "p", None)]
    df = spark.createDataFrame(rows, "k string, s string, f array<double>").repartition(partitions)
    got = {r["key"]: r["distance"] for r in frechet.frechet(df, "k", "s", "f", ("p", "g"), block_bytes, fan).collect()}
    none = np.zeros((0, 8))
    want = {k: plain(own.get((k, "p"), none), own.get((k, "g"), none)) for k in {k for k, _ in own}}
    assert got == pytest.approx(want, abs=1e-6, nan_ok=True)


def test_blocks_hold_the_upper_triangle(spark):
    x = np.random.default_rng(6).normal(size=(50, 7))
    df = spark.createDataFrame([("k", "p", v.tolist()) for v in x], "k string, s string, f array<double>").repartition(6)
    got = frechet.moment_blocks(df, "k", "s", "f", 3 * 7 * 8, 2).orderBy("block").collect()
    want = 49 * np.cov(x.T)
    assert [r["block"] for r in got] == [0, 1, 2] and {r["n"] for r in got} == {50}
    for r, lo in zip(got, (0, 3, 6)):
        assert np.allclose(np.frombuffer(r["m2"]).reshape(-1, 7 - lo), want[lo : lo + 3, lo:])
        assert np.allclose(np.frombuffer(r["mean"]), x.mean(axis=0))


def test_no_vectors(spark):
    none = spark.createDataFrame([], "k string, s string, f array<double>")
    assert frechet.frechet(none, "k", "s", "f", ("p", "g")).count() == 0
    assert frechet.frechet_levels(none.withColumn("t", F.lit("x")), "k", "t", "s", "f", ("p", "g")).count() == 0


def test_width_2048_with_more_sets_in_a_task_than_memory_would_hold(spark):
    """70 small keys and a large one in one task: 142 matrices would take 4.8 GB, and their messages more than Arrow's 32-bit offsets hold."""
    value = lambda i: F.sin(F.col("id") * 7919.0 + i * F.col("id") * 0.37 + i).cast("float")
    one = spark.range(420).select("id", (F.col("id") % 70).cast("string").alias("k"), (F.col("id") / 70 % 2).cast("int").alias("s"))
    large = spark.range(1000, 3200).select("id", F.lit("large").alias("k"), (F.col("id") % 2).cast("int").alias("s"))
    df = one.union(large).withColumn("f", F.transform(F.sequence(F.lit(1), F.lit(2048)), value)).coalesce(1)
    got = {r["key"]: r["distance"] for r in frechet.frechet(df, "k", "s", "f", ("0", "1")).collect()}
    rows = df.where("k IN ('3', 'large')").collect()
    x = {(k, s): np.array([r["f"] for r in rows if r["k"] == k and r["s"] == s], float) for k in ("3", "large") for s in (0, 1)}
    assert len(got) == 71 and len(x["large", 0]) == 1100
    assert got["3"] == pytest.approx(plain(x["3", 0], x["3", 1]), rel=1e-6)
    assert got["large"] == pytest.approx(frechet.distance(*(frechet.moments(x["large", s]) for s in (0, 1))), rel=1e-6)


def test_memory_of_a_task(monkeypatch):
    """Many sets one after the other, one of them large: a task holds one matrix and what is added to it."""
    monkeypatch.setattr(frechet.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    rng = np.random.default_rng(8)

    def batches():
        for k in range(70):
            for _ in range(2 if k == 5 else 1):
                x = rng.normal(size=(1100 if k == 5 else 3, 2048))
                yield pa.RecordBatch.from_arrays([pa.array([str(k)] * len(x)), pa.array(["p"] * len(x)), pa.FixedSizeListArray.from_arrays(x.ravel(), 2048).cast(pa.list_(pa.float64()))], ["key", "side", "f"])

    tracemalloc.start()
    seen = [(b["n"][0].as_py(), b["block"][0].as_py()) for b in frechet._met(True, 2048, frechet.BLOCK_BYTES)(batches())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen.count((3, -1)) == 69 and (2200, 31) in seen and peak < 250e6
