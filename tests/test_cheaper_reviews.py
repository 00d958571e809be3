"""What `moderate_reviews` leaves out or does in another order changes no result."""

import numpy as np
from pyspark.sql import functions as F

from moderata.operators import verdicts as V
from moderata.operators import vision as I
from moderata.plans import registry


def test_annotations_of_one_split_are_judged_in_many_tasks(spark):
    rows = registry.QUERIES["vision_decide"](spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_verdict_that_is_not_asked_for_is_null(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, True)], "review_id long, wanted boolean")
    said = spark.createDataFrame([(1, '{"decision":"APPROVED","flags":[]}', None), (2, None, '{"decision":"REJECTED"}')], "review_id long, primary_raw string, secondary_raw string")
    found = {r.review_id: r.verdict for r in V.with_verdicts(rows, said, "review_id", asked=F.col("wanted")).collect()}
    plain = {r.review_id: r.verdict for r in V.with_verdicts(rows, said, "review_id").collect()}
    assert found == {1: plain[1], 2: None, 3: plain[3]} and plain[2].decision == "REJECTED"


def test_sharpness_is_the_variance_of_the_laplacian():
    r = np.random.default_rng(3)
    for shape in ((64, 64), (1, 1), (1, 7), (33, 90), (600, 700)):
        gray = r.integers(0, 256, shape).astype(float)
        resized = np.concatenate(list(I._resized(gray, 512))).astype(float)
        p = np.pad(resized, 1, mode="reflect")
        edges = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
        assert np.isclose(I._sharpness(gray), edges.var(), rtol=1e-12)
