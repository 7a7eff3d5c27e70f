"""What costs much is worked out once, over many tasks, and written; what reads it does not work it out again."""

from pyspark.sql import functions as F

from plumbline.operators import extract
from plumbline.plans import registry

SF = "/root/testdata/sf0.001"


def test_answers_are_judged_once(spark):
    """Splitting rows by their faults parses no answer and checks no constraint again."""
    prompts = spark.createDataFrame([(1, "Content blocks:\n[b0000] TEXT: Product name: A\n[b0001] TEXT: Weight: 3 g"), (2, None)], "doc_id long, prompt string")
    found = extract.extract_records(prompts, extract.KeyValueClient)
    assert not any(x in found._jdf.queryExecution().toString().lower() for x in ("parse_json", "parsejson", "schema_of_variant", "schemaofvariant"))
    assert {(r.doc_id, r.product_name, r.attempts, r.error) for r in found.collect()} == {(1, "A", 1, None), (2, "", 1, None)}


def test_prompts_are_many_tasks(spark):
    tasks = []
    ask = extract.ask

    def noted(prompts, *more):
        tasks.append(prompts.groupBy(F.spark_partition_id()).count().count())
        return ask(prompts, *more)

    extract.ask = noted
    try:
        registry.queries()["q_extract_records"](spark, SF)
    finally:
        extract.ask = ask
    assert tasks[0] >= spark.sparkContext.defaultParallelism


def test_merged_records_score_once(spark):
    """The parts of a merge read written records, and none goes back to the table to score it again."""
    frame = registry.queries()["q_merged_records"](spark, SF)
    assert frame.inputFiles() and not [f for f in frame.inputFiles() if "part.parquet" in f]


def test_resolved_records_merge_once(spark):
    """Decisions are taken from merged records that are written, so that they are not merged once more for them."""
    frame = registry.queries()["q_resolved_records"](spark, SF)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert not [f for f in frame.inputFiles() if "part.parquet" in f] and "collect_list(struct(record_ord" not in plan
