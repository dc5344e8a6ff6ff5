"""Ingest queries on rows as larger tables have them."""

from decoylens.plans.sources import numeric_coercion, written_by


def test_totals_beyond_64_bits(spark, tmp_path):
    keys = "explode(array_repeat(struct(4L as l_orderkey, 2000000000L as l_partkey), 4)) as r"
    spark.range(1).selectExpr(keys).select("r.*").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in numeric_coercion(spark, str(tmp_path)).collect()] == [(0, 4 * 2_000_000_000 * 3_000_000_000, 4)]


def test_folders_of_sensors_and_days_in_one_pass(spark, tmp_path):
    rows = [(f"{s}-{y}-{i}", f"sensor-{s}", y) for s in range(2) for y in (1995, 1996) for i in range(3)]
    lines = spark.createDataFrame(rows, "value string, sensor string, year int").repartition(1)
    written_by(lines, f"{tmp_path}/logs", ["sensor", "year"], "conn.{0}.log")
    found = {str(f.relative_to(tmp_path)): sorted(f.read_text().split()) for f in tmp_path.rglob("conn.*.log")}
    assert found == {f"logs/sensor-{s}/{y}/conn.0.log": [f"{s}-{y}-{i}" for i in range(3)] for s in range(2) for y in (1995, 1996)}
