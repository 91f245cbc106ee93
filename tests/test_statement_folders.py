"""Statement folders: many small ones are listed by few tasks."""
from pyspark.sql import functions as F

from ledgerlens.sources import statements as SS


def test_folders_are_listed_by_tasks_that_follow_the_cores(spark, tmp_path):
    path = str(tmp_path / "statements")
    raw = spark.range(240).select((F.col("id") % 80).alias("account_id"), F.col("id").alias("seq"), F.lit("x").alias("narration"))
    SS.write_statements(raw, path)
    name, sc = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    before = spark.conf.get(name, None)
    sc.setJobGroup("folders", "listing")
    try:
        d = SS.read_statements(spark, path, require_rows=False)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("folders") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 2 * sc.defaultParallelism, tasks
    assert spark.conf.get(name, None) == before
    assert d.count() == 240 and d.select("account_id").distinct().count() == 80
