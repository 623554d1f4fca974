"""The summary aggregates the ratings once: cells and failed rows read the same kept labels."""

import re

from tidewright.plans import catalogue


def test_labels_are_made_once(spark):
    df = catalogue.queries()["a23_hypothesis_summary"](spark, "/root/testdata/sf0.001")
    leaves = df._jdf.queryExecution().withCachedData().collectLeaves()
    read = [leaves.apply(i).output().toString() for i in range(leaves.size())]
    assert read and not [x for x in read if re.search(r"\bphysician#", x)]
    spark.catalog.clearCache()
