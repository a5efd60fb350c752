"""The plans hold at scale: no pair explosions, no unbounded single task, pruned reads."""

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
EAGER = {
    "knn_cosine", "model_lr", "model_rf", "model_gbt", "model_mlp", "classify_all", "scan_blocks_json",
    "job_answer", "job_answer_nearest", "scan_folder", "manifest_explode", "scan_csv", "answer_json", "incremental_classify",
}
# Running sums over at most one row a first character, and counts of at most classes x classes rows.
BOUNDED = {"category_codes", "features_training"}


def plan_of(spark, name):
    return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - EAGER))
def test_plan(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in BOUNDED:
        windows_alone = [
            a for a, b in zip(plan.split("\n"), plan.split("\n")[2:]) if "Window [" in a and "SinglePartition" in b
        ]
        assert not windows_alone


def test_outline_shuffles_once(spark):
    """One hash shuffle by document carries labels, style test, first headings and numbering."""
    from sheafline.operators.outline import outline
    from sheafline.plans import fixtures as fx

    plan = outline(fx.labelled(spark, SMALL), largest=1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_reads_only_what_it_needs(spark):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_of(spark, "outline")
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan_of(spark, "unprocessed_docs")


def test_ranks_are_limited_before_the_shuffle(spark):
    for name in ("top_sections", "top_sections_per_doc"):
        assert "WindowGroupLimit" in plan_of(spark, name)


def test_stages_are_counted_in_one_pass(spark):
    """The blocks are read once for all stages, and the labels once."""
    assert plan_of(spark, "stage_counts").count("FileScan parquet") == 2


def test_pages_are_only_mapped(spark):
    plan = plan_of(spark, "blocks_from_pages")
    assert "hashpartitioning" not in plan and plan.count("FileScan parquet") == 1
