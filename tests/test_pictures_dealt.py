"""Pictures of a table in one split are analysed by many tasks."""

from moderata.plans import registry


def test_pixel_statistics_run_in_many_tasks(spark):
    rows = registry.QUERIES["image_pixel_stats"](spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
