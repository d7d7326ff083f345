"""What a search over all documents moves, and that it changes no result."""

import pytest
from test_operators import tfidf

from lodestone.operators import search
from lodestone.plans import search_queries, text_queries

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("common", [1, 3, 1 << 16])
def test_frequencies_of_common_and_other_terms_come_to_the_same(spark, monkeypatch, common):
    monkeypatch.setattr(search, "COMMON", common, raising=True)
    texts = ["waiting period of thirty days", "period of grace", "nothing here", "waiting waiting lists", "", "rare words alone"]
    asked = ["How long is the waiting period?", "rare lists", "zzz unknown", ""]
    q = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    # A record that comes in two rows is one text.
    rows = [*enumerate(texts[:4]), (4, texts[4]), (5, "rare words"), (5, "alone")]
    r = spark.createDataFrame(rows, "record_id int, text string")
    got = {(x.question_id, x.record_id): x.lexical for x in search.lexical_search(q, r.where("record_id < 5"), 10, scope=()).collect()}
    want = {(i, j): s for i, a in enumerate(asked) for j, s in enumerate(tfidf(a, texts[:5])) if s > 0}
    assert got == pytest.approx(want)
    both = {x.record_id for x in search.lexical_search(q, r, 10, scope=()).where("question_id = 1").collect()}
    assert both == {3, 5}


def test_hits_are_summed_where_the_records_are(spark, monkeypatch):
    plans, real = {}, search.written
    monkeypatch.setattr(search, "written", lambda df, name: plans.setdefault(name, plan_of(df)) and real(df, name))
    search_queries.tfidf_search(spark, SF)
    # Only the best of a task go to their question; no pair of question and record does before.
    assert "SortMergeJoin [question_id" not in plans["found"] and plans["found"].count("hashpartitioning(question_id") == 1
    assert "Exchange hashpartitioning(record_id" not in plans["found"]


def test_texts_of_all_documents_do_not_move_to_their_hits(spark):
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")  # less than the documents, more than the hits
    try:
        for query in (search_queries.overlaps, search_queries.evidence_status):
            assert "SortMergeJoin [doc_id" not in plan_of(query(spark, SF)) and "SortMergeJoin [record_id" not in plan_of(query(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_terms_of_a_text_are_counted_and_ranked_where_it_is(spark):
    plan = plan_of(text_queries.key_terms(spark, SF))
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # the plan's lower part comes last
