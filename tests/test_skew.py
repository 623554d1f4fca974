import random

from pyspark.sql import functions as F

from tidewright.plans import skew as S
from tidewright.plans.skew import salted_lookup


def test_salted_lookup_with_hot_and_null_keys(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None) for i in range(6000)]
    left = spark.createDataFrame(rows, "id int, k string")
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(40)]], "k string, v int")
    plain = {(r.id, r.v) for r in left.join(right, "k", "left").collect()}
    for hot in (None, spark.createDataFrame([("hot",), ("k1",)], "k string")):
        got = salted_lookup(left, right, "k", F.col("id"), hot=hot).collect()
        assert len(got) == 6000 and {(r.id, r.v) for r in got} == plain
        inner = salted_lookup(left, right, "k", F.col("id"), "inner", hot=hot).collect()
        assert {(r.id, r.v) for r in inner} == {p for p in plain if p[1] is not None}


def test_grid_join_of_keys_that_are_hot_on_both_sides(spark):
    rng = random.Random(2)
    keys = ["hot"] * 300 + ["warm"] * 40 + [f"k{i}" for i in range(60)] + [None] * 5
    a = spark.createDataFrame([(i, rng.choice(keys), i % 3) for i in range(1500)], "a int, k string, j int")
    b = spark.createDataFrame([(i, rng.choice(keys), i % 3) for i in range(900)], "b int, k string, j int")
    for on in (["k"], ["k", "j"]):
        plain = sorted((r.a, r.b) for r in a.join(b, on).select("a", "b").collect())
        counted = lambda df, on=on: df.groupBy(S.slot_of(on).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        hot = S.grid(counted(a), counted(b), least=20, share=5)
        assert 0 < hot.count() <= 10 and hot.agg(F.max("n_left")).first()[0] > 1 < hot.agg(F.max("n_right")).first()[0]
        for known in (None, hot):
            got = S.grid_join(a, b, on, hot=known)
            assert sorted((r.a, r.b) for r in got.select("a", "b").collect()) == plain and "__a" not in got.columns
    hashed = lambda df: df.withColumn("k", F.xxhash64("k", "j"))
    folded = S.grid_join(hashed(a).drop("j"), hashed(b).drop("j"), ["k"], hot=S.grid(*(hashed(d).groupBy(S.slot_of(["k"]).alias("slot")).agg(F.count(F.lit(1)).alias("n")) for d in (a, b)), least=20, share=5), folded=True)
    assert sorted((r.a, r.b) for r in folded.select("a", "b").collect()) == sorted((r.a, r.b) for r in hashed(a).join(hashed(b), "k").select("a", "b").collect())
