import math

from pyspark.sql import functions as F

from decoylens.operators import rollups as R


def test_a_group_of_a_histogram_is_many_tasks(spark):
    """All values of a group met its range in one task; here two groups have all rows."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = F.col("id")
        df = spark.range(4000).select(F.when(n % 50 == 0, "b").otherwise("a").alias("g"), F.when(n % 7 > 0, n % 1000).alias("v"))
        found = R.histogram(df, "v", ["g"], 5, log=True)
        # The join's own tasks: the rows of each before the last grouping.
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(g#" in plan and "_part#" in plan[plan.index("SortMergeJoin") :].split("\n")[0]
        rows = [(r["g"], math.log1p(r["v"])) for r in df.collect() if r["v"] is not None]
        ranges = {g: (min(own), max(own)) for g in "ab" if (own := [x for h, x in rows if h == g])}
        expected = {}
        for g, x in rows:
            lo, hi = ranges[g]
            key = (g, min(math.floor((x - lo) / ((hi - lo) / 5)) + 1, 5))
            expected[key] = expected.get(key, 0) + 1
        assert {(r["g"], r["bin"]): r["n"] for r in found.collect()} == expected
        none = R.histogram(df, "v", [], 5)
        assert sum(r["n"] for r in none.collect()) == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
