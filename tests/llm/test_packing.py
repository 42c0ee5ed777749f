import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm.packing import bucket_boundaries, pack, padding, plan, token_counts, vocabulary_path


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(40):
        lengths = np.sort(rng.choice(np.arange(1, 40), 8, replace=False))
        counts = rng.integers(1, 9, 8)
        for k in (1, 2, 3, 5, 9):
            choices = itertools.combinations(lengths, min(k, 8) - 1)
            best = min(padding(lengths, counts, np.array(sorted({*c, lengths[-1]}))) for c in choices)
            assert padding(lengths, counts, bucket_boundaries(lengths, counts, k)) == best


@pytest.mark.parametrize("mix", [True, False])
def test_plan_places_each_item_once(mix):
    rng = np.random.default_rng(1)
    bounds, counts = np.array([3, 10, 40, 55, 100]), rng.integers(0, 500, 5)
    rows = plan(bounds, counts, 100, mix)
    load: dict[int, int] = {}
    for bucket, size in enumerate(bounds):
        spans = sorted((a, b) for k, a, b, _, _ in rows if k == bucket)
        assert [x for a, b in spans for x in (a, b)] == sorted(x for a, b in spans for x in (a, b))
        assert sum(b - a for a, b in spans) == counts[bucket]
        for k, a, b, each, first in rows:
            if k == bucket:
                for i in range(b - a):
                    load[first + i // each] = load.get(first + i // each, 0) + size
    assert max(load.values()) <= 100


def test_rows(spark):
    items = spark.range(3000).select(F.col("id").alias("key"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 130).alias("tokens"))
    specs = spark.createDataFrame([("a", 50), ("b", 20), ("none", 0), (None, None), ("a", 50)], "spec_name string, capacity int")
    rows = pack(items, specs, "key").cache()
    for name, capacity in (("a", 50), ("b", 20)):
        some = rows.where(F.col("spec_name") == name)
        assert some.groupBy("container_id").agg(F.sum("tokens").alias("n")).where(F.col("n") > capacity).count() == 0
        placed = some.groupBy("key").agg(F.sum("tokens").alias("n"), F.count("*").alias("pieces"))
        both = placed.join(items.where("tokens > 0"), "key", "full")
        assert both.where("n is null or tokens is null or n <> tokens").count() == 0
        assert both.where((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).count() == 0
        used = some.agg((F.sum("tokens") / F.countDistinct("container_id") / capacity).alias("u")).first().u
        assert used > 0.9
    assert {r.spec_name for r in rows.select("spec_name").distinct().collect()} == {"a", "b"}
    assert pack(items.where("false"), specs, "key").count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "x" * 100_000)], "id long, text string")
    got = {r.id: r.tokens for r in token_counts(df, "id", "text", vocabulary_path()).collect()}
    assert got[2] == got[3] == 0 < got[1] <= 4 and got[4] > 1 and got[5] > 1000


def test_named_method_and_topping_up_on_real_lengths(spark, data):
    """Batches of one bucket alone, as the method says, against containers topped up from others."""
    from pyspark.sql import functions as F

    from folioforge.llm import queries

    def used(rows):
        one = rows.groupBy("spec_name", "capacity", "container_id").agg(F.sum("tokens").alias("n"), F.countDistinct("bucket_tokens").alias("buckets"))
        return {r.spec_name: r for r in one.groupBy("spec_name").agg(
            (F.sum("n") / F.count("*") / F.first("capacity")).alias("share"), F.max("buckets").alias("buckets"), F.max(F.col("n") > F.col("capacity")).alias("over")).collect()}

    inside, mixed = used(queries.p6_inside(spark, data)), used(queries.p6_containers(spark, data))
    for name in inside:
        assert inside[name].buckets == 1 and not inside[name].over and not mixed[name].over
        assert mixed[name].share > inside[name].share
