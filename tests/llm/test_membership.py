"""Bit filters, parities of shingle sets, and what the near stage moves."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumapair.llm import simhash
from lumapair.llm.membership import bit_filter, may_be_in


def _hashes(rng: np.random.Generator, n: int) -> np.ndarray:
    return np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))


@pytest.mark.parametrize("values", [[], [0], [-1, None, 2**63 - 1, -(2**63)], list(range(0, 60_000, 3))])
def test_a_filter_denies_no_value(spark, values):
    packed = bit_filter(spark.createDataFrame([(v,) for v in values], "v long").repartition(3))
    own = spark.createDataFrame([(v,) for v in values], "v long").where(may_be_in(packed, F.col("v")))
    assert own.count() == sum(v is not None for v in values)
    others = spark.range(10**6, 10**6 + 20_000).where(may_be_in(packed, F.col("id"))).count()
    assert others < 4000


def test_parity_bounds_what_sets_share():
    rng = np.random.default_rng(40)
    for m, n, common in [(0, 0, 0), (1, 1, 1), (1, 1, 0), (60, 70, 50), (64, 65, 60), (300, 290, 270), (300, 300, 0), (30, 5000, 20), (5000, 4500, 4400), (5000, 4200, 100)]:
        both, a, b = _hashes(rng, common), _hashes(rng, m - common), _hashes(rng, n - common)
        a, b = np.concatenate([both, a]), np.concatenate([both, b])
        most = simhash.most_shared(len(a), len(b), simhash.parity(a), simhash.parity(b))
        assert most == simhash.most_shared(len(b), len(a), simhash.parity(b), simhash.parity(a)) >= common
        if common == 0 and m > 1:
            assert most < 0.8 / 1.8 * (m + n)


def _shuffled(spark) -> int:
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_the_near_stage_moves_no_text_that_stays(spark):
    rng = np.random.default_rng(41)
    texts = [" ".join(rng.bytes(16).hex() for _ in range(300)) for _ in range(300)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(1000 + i, f"{t} more", "en") for i, t in enumerate(texts[:5])]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = _shuffled(spark)
        got = corpus_pipeline.near_deduplicated(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
        moved = _shuffled(spark) - at
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["doc_id"] for r in got} == set(range(300))
    assert 0 < moved < 0.5 * sum(map(len, texts))
