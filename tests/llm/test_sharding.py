"""The law of the shards, the matrix, and uniformity."""

from collections import Counter

import numpy as np

from fluvia.llm import sharding


def test_matrix_sums_and_mean():
    counts = [5, 0, 17, 100, 3]
    draws = np.array([sharding.communication_matrix(counts, 4, s) for s in range(400)])
    assert (draws.sum(axis=2) == counts).all()
    sizes = draws.sum(axis=1)
    assert sizes.max() - sizes.min() <= 1
    assert abs(draws[:, 3].mean() - 25) < 0.5


def test_hypergeometric_beyond_the_generator():
    rng = np.random.default_rng(1)
    draws = np.array([sharding._hypergeometric(rng, 10**9, 3 * 10**9, 4000) for _ in range(600)])
    assert abs(draws.mean() - 1000) < 6 and abs(draws.std() - 27.4) < 4


def test_shards_are_even_gapless_and_repeatable(spark):
    rows = [(i, i % 3, "s") for i in range(1003)] + [(7, 1, "s")] * 5 + [(None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, shard long, slot string").withColumnRenamed("shard", "v").withColumnRenamed("slot", "w")
    a = sharding.shuffle_to_shards(df, 16, ["doc_id", "v"]).collect()
    b = sharding.shuffle_to_shards(df.repartition(7), 16, ["doc_id", "v"]).collect()
    sizes = Counter(r.shard for r in a)
    assert len(a) == len(rows) and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in a if r.shard == s) == list(range(sizes[s]))
    key = lambda r: (str(r.doc_id), r.shard, r.slot)
    assert Counter(map(key, a)) == Counter(map(key, b))


def test_few_rows_and_clashing_names(spark):
    few = sharding.shuffle_to_shards(spark.createDataFrame([(1, 9)], "doc_id long, slot long"), 4, ["doc_id"]).collect()
    assert len(few) == 1 and few[0].slot == 0
    assert sharding.shuffle_to_shards(spark.createDataFrame([], "doc_id long"), 4, ["doc_id"]).count() == 0
