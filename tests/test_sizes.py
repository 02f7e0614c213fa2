"""Plans go by what files hold, not by how well they are packed."""

from pyspark.sql import functions as F

from precinct.blocks.shared import materialize
from precinct.plans.fixtures import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_tables_are_not_broadcast(spark, tmp_path):
    """Half a million rows that take few bytes in a file would be sent to the driver and to every task."""
    rows = spark.range(500_000).select("id", F.concat(F.lit("theft|"), (F.col("id") % 3).cast("string")).alias("grp"), (F.col("id") % 1000 / 7).alias("x"), (F.col("id") % 1000 / 9).alias("y"))
    rows.write.parquet(f"{tmp_path}/rows.parquet")
    for df in (materialize(rows, "rows"), table(spark, str(tmp_path), "rows")):
        assert "Broadcast" not in plan(df.join(df.select(F.col("id").alias("other"), "x", "y"), ["x", "y"]))
    few = materialize(rows.limit(100), "few")
    assert "BroadcastHashJoin" in plan(rows.join(few.select("id"), "id"))
