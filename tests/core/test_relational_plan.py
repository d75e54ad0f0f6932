"""The relational plan sends no table of tokens through the driver and tokenises once for each of its tables."""

from spanloom.functions import predicates as P
from spanloom.operators.engine import Parser
from spanloom.plans.grammar import pred, rule

TWO = rule([pred(P.is_title()), pred(P.is_lower())])


def test_no_broadcast_of_tokens(spark, tmp_path):
    """Spark takes exploded tokens for as many rows as texts; at 1 GB the broadcast of one of them ended the driver."""
    texts = ["A big Dog ran", "no match", "", None, "Two big\nBad wolves", "the END"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = Parser(TWO, engine="relational").findall(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2
    assert plan.count("+- ArrowEvalPython") + plan.count(":- ArrowEvalPython") == 3  # titles, lower words, texts with a match
    order = lambda df: sorted(map(str, df.collect()))
    assert order(found) == order(Parser(TWO, engine="vector").findall(docs)) and found.count() == 4


def test_repeats_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(1, "a b C d e f"), (2, "G")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = Parser(rule([pred(P.is_title()), pred(P.is_lower()).repeatable()]), engine="relational").findall(docs)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.values for r in found.collect()] == [["C", "d", "e", "f"]]
