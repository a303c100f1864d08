"""What a plan takes for small isn't broadcast where it is counted to be large, and lines are split once for a document."""

import corpus_pipeline
from blockloom.llm import line_dedup
from blockloom.llm.common import bounded_broadcast


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_more_rows_than_allowed_are_not_broadcast(spark):
    few, many = spark.range(10), spark.range(1000)
    assert "BroadcastHashJoin" in plan(many.join(bounded_broadcast(few, 10), "id"))
    large = many.join(bounded_broadcast(few, 9), "id")
    assert large.count() == 10 and "Broadcast" not in plan(large)


def test_lines_of_a_document_are_split_once(spark):
    """A split inside the function of a line takes time with the square of the lines."""
    text = "\n".join([f"line {k % 1990}" for k in range(2000)] + ["", "end"])
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "another text", "en", "s", 12)], "doc_id long, text string, lang string, source string, n_chars long")
    found = line_dedup.clean(docs)
    assert {(r.doc_id, r.text, r.n_chars) for r in found.collect()} == {(1, t := "\n".join([f"line {k}" for k in range(1990)] + ["", "end"]), len(t)), (2, "another text", 12)}
    assert "lambdafunction(split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" not in plan(found)  # of the lines that go
    assert corpus_pipeline.lines_stage(spark, docs, "").count() == 2
