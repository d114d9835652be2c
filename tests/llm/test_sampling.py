"""Bounded samples and thresholds."""

from pyspark.sql import functions as F

from corpusloom.llm.sampling import at_least, hash_sample


def test_hash_sample_is_the_lowest_hashes(spark):
    df = spark.range(5000)
    lowest = sorted(r.id for r in df.orderBy(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(1 << 31)), F.xxhash64("id", F.lit(0))).limit(100).collect())
    assert sorted(r.id for r in hash_sample(df, "id", 100, 5000).collect()) == lowest
    assert hash_sample(df, "id", 10_000, 5000).count() == 5000 and hash_sample(df.limit(0), "id", 5, 0).count() == 0


def test_at_least_takes_whole_steps(spark):
    df = spark.createDataFrame([(c, i) for c, n in ((1, 50), (2, 20), (7, 5), (1 << 40, 2)) for i in range(n)], "count long, i long")
    assert {most: at_least(df, "count", most).count() for most in (1, 2, 6, 7, 26, 27, 76, 77, 1000)} == {1: 0, 2: 2, 6: 2, 7: 7, 26: 7, 27: 27, 76: 27, 77: 77, 1000: 77}
    assert at_least(df.limit(0), "count", 5).count() == 0
