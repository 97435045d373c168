from collections import Counter

from pyspark.sql.functions import spark_partition_id

from recallgrid.operators.skew import dominant_keys, heavy_codes, hot_split_join, tree_aggregate


def brute(rows):
    out = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        own = [r for r in rows if r[0] == k]
        best = {}
        for _, r, v in own:
            if r is not None and v is not None and v == v and v > 0:
                best[r] = max(best.get(r, 0), v)
        top = sorted(((-v, r) for r, v in best.items()))[:3]
        out[k] = (len(own), len(best), sum(best.values()), [(-v, r) for v, r in top])
    return out


def test_tree_matches_brute_force(spark):
    rows = [(i % 7 if i % 3 else 1, i % 50, float(i % 9)) for i in range(900)]
    rows += [(1, 3, 2.0)] * 200 + [(None, 1, 1.0), (2, None, 5.0), (2, 8, None), (2, 9, float("nan")), (2, 10, -1.0), (9, None, None)]
    df = spark.createDataFrame(rows, "k long, r long, v double").withColumnsRenamed({}).selectExpr("*", "1 as n", "2 as c", "'x' as top")
    for chunk_rows in (3, 10, 10**6):
        got = {x["k"]: (x["n_rows"], x["n_records"], x["value_sum"], [tuple(t) for t in x["top"]]) for x in tree_aggregate(df, "k", "r", "v", chunk_rows=chunk_rows, fan_in=3).collect()}
        assert got == brute(rows)


def test_dominant_and_empty(spark):
    df = spark.createDataFrame([(1, i, 1.0) for i in range(90)] + [(k, 0, 1.0) for k in range(2, 12)] + [(None, 1, 1.0)] * 20, "k long, r long, v double")
    assert [tuple(r) for r in dominant_keys(df.repartition(40), "k", 0.03, fan_in=3).collect()] == [(1, 90)]
    assert tree_aggregate(df.limit(0), "k", "r", "v").count() == 0 and dominant_keys(df.limit(0), "k", 0.03).count() == 0


def test_hot_split_join(spark):
    big = spark.createDataFrame([(1, i) for i in range(500)] + [(i, -i) for i in range(2, 300)] + [(None, 0)] * 9, "k long, x long")
    look = spark.createDataFrame([(i, f"v{i}") for i in range(1, 250)], "k long, v string")
    n, heavy = heavy_codes(big, "k", 0.1)
    assert n == 798 and list(heavy.values()) == [500]
    assert Counter(map(tuple, hot_split_join(big, look, "k", share=0.1).collect())) == Counter(map(tuple, big.join(look, "k").collect()))
    assert Counter(map(tuple, hot_split_join(big, look, "k", "left", share=0.1).collect())) == Counter(map(tuple, big.join(look, "k", "left").collect()))
    assert hot_split_join(big.limit(0), look, "k").count() == 0


def test_a_hot_key_that_the_lookup_lacks_never_shares_a_task(spark):
    big = spark.range(40_000).selectExpr("if(id % 2 = 0, -1, id) as k", "id as x").repartition(8)
    look = spark.range(30_000).selectExpr("id as k", "'v' as v")
    joined = hot_split_join(big, look, "k", "left")
    per_task = joined.filter("k = -1").groupBy(spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in per_task) == 20_000 and max(r["count"] for r in per_task) < 5_000
    assert hot_split_join(big, look, "k").filter("k = -1").count() == 0
