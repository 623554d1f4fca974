"""Cells joined before their classes are unpivoted equal those joined after, and the flags equal those of the summary."""

import pytest

from tidewright.operators import cells as C
from tidewright.operators import endpoints as E
from tidewright.plans import catalogue, views

FOLDER = "/root/testdata/sf0.001"


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


def test_wide_cells_equal_paired_cells(spark):
    wide = views.cells(spark, FOLDER)
    long = C.paired_cells(views.pivoted(spark, FOLDER), views.reference(spark, FOLDER))
    assert set(wide.columns) == set(long.columns)
    got = rows(wide, long.columns)
    assert got and got == rows(long, long.columns)



def test_classes_are_made_after_the_join(spark):
    plan = views.cells(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join Inner")
    assert plan.count("Generate inline") == 1


@pytest.mark.parametrize("where", ["true", "llm_context_free is not null and llm_correct_context is not null and llm_shuffled_context is not null", "delta_physician = 0"])
def test_flags_equal_those_of_the_summary(spark, where):
    cells = views.cells(spark, FOLDER).where(where)
    whole = E.endpoint_summary(cells, spark.createDataFrame([], "model string"), 50)
    assert rows(E.behaviour_flags(cells, 50), ["model", "flag"]) == rows(whole, ["model", "flag"])
    spark.catalog.clearCache()


def test_flags_make_no_other_endpoint(spark):
    df = catalogue.queries()["a24_flags_complete_cells"](spark, FOLDER)
    leaves = df._jdf.queryExecution().withCachedData().collectLeaves()
    kept = [leaves.apply(i).output().toString() for i in range(leaves.size())]
    assert kept and not [x for x in kept if "item_text" in x or "category" in x]
    spark.catalog.clearCache()
