"""Parameter sweeps on retrieval results, with DuckDB SQL.

Cases are all benchmark passages. Each is searched by TF-IDF (what its own plan
does) and by the fusion of two rankings (what another route does); the outcomes
are whether a document that holds the passage is among the first four, and the
reciprocal rank of the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import metrics, search, sweeps
from ..sources.tables import written
from .search_queries import QUERY_PLANS_SQL, RRF_SQL, lexical_hits, query_plans, questions_of, rrf_fusion
from .text_queries import documents

#: The grids of the sweeps.
PLANNER = (0.55, 0.6, 0.66, 0.7, 0.74, 0.78, 0.82, 0.86, 0.9)
ROUTER = (0.5, 0.55, 0.6, 0.62, 0.7, 0.78, 0.84, 0.9)
GAPS = (0.0, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.4, 1.0)
FALLBACKS = (0.0, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0)


def judged(spark, sf_dir, hits: DataFrame) -> DataFrame:
    """hits (question_id, doc_id, rank) with whole: does the document hold the whole passage?"""
    rows = hits.join(documents(spark, sf_dir), "doc_id").join(questions_of(spark, sf_dir), "question_id")
    whole = (F.col("question") != "") & F.contains("text", F.col("question"))
    return rows.select("question_id", "doc_id", "rank", whole.alias("whole"))


def outcomes(rows: DataFrame, suffix: str = "", first: int = 4) -> DataFrame:
    """question_id, hit, mrr of judged rows."""
    best = F.min(F.when(F.col("whole") & (F.col("rank") <= first), F.col("rank")))
    per = rows.groupBy("question_id").agg(best.alias("best"))
    return per.select("question_id", F.col("best").isNotNull().cast("double").alias(f"hit{suffix}"), F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias(f"mrr{suffix}"))


def first_hits(spark, sf_dir) -> DataFrame:
    """The first twelve of every passage by TF-IDF, searched once: those of any smaller number are among them."""
    return written(lexical_hits(spark, sf_dir, 12), "hits")


def cases(spark, sf_dir, hits: DataFrame) -> DataFrame:
    """question_id, hit, mrr and hit_after, mrr_after of every passage; hits are first_hits()."""
    own = hits.where("rank <= 4").select("question_id", F.col("record_id").alias("doc_id"), "rank")
    other = written(rrf_fusion(spark, sf_dir, hits).where("rank <= 4").select("question_id", "doc_id", "rank"), "fused")
    every = questions_of(spark, sf_dir).select("question_id")
    rows = every.join(outcomes(judged(spark, sf_dir, own)), "question_id", "left").join(outcomes(judged(spark, sf_dir, other), "_after"), "question_id", "left")
    return rows.fillna(0.0)


def report(rows: DataFrame, *axes: str) -> DataFrame:
    return rows.select(*axes, "cases", "stepped", F.round("hit", 9).alias("hit"), F.round("mrr", 9).alias("mrr"))


def planner_threshold_sweep(spark, sf_dir):
    """At every pair of thresholds: how many passages leave their plan for the other route, and what is found then.

    A plan is left if its confidence is below the planner's threshold and the
    rules' own route is no surer than the router's.
    """
    plans = query_plans(spark, sf_dir).where("question_id LIKE 'b%'").select(F.substring("question_id", 2, 1 << 30).alias("key"), "confidence", "route_confidence")
    rows = cases(spark, sf_dir, first_hits(spark, sf_dir)).withColumn("key", F.col("question_id").cast("string")).join(plans, "key")
    axes = [sweeps.Axis("planner", PLANNER, "confidence"), sweeps.Axis("router", ROUTER, "route_confidence", reached=True)]
    return report(sweeps.step_sweep(written(rows, "cases"), axes, ["hit", "mrr"]), "planner", "router")


WHOLE = "contains(d.text, coalesce(b.text, '')) AND coalesce(b.text, '') <> ''"
CASES = rf"""{RRF_SQL[RRF_SQL.index('WITH') + 4 : RRF_SQL.rindex('SELECT question_id, doc_id, round(fused')]},
own AS (SELECT question_id, min(rank) AS best FROM top t JOIN benchmark b ON b.item_id = question_id JOIN d ON d.doc_id = t.doc_id WHERE rank <= 4 AND {WHOLE} GROUP BY question_id),
other AS (SELECT question_id, min(rank) AS best FROM r t JOIN benchmark b ON b.item_id = question_id JOIN d ON d.doc_id = t.doc_id WHERE rank <= 4 AND {WHOLE} GROUP BY question_id),
cases AS (SELECT item_id AS question_id, (own.best IS NOT NULL)::INT AS hit, coalesce(1.0::DOUBLE / own.best, 0) AS mrr, (other.best IS NOT NULL)::INT AS hit_after, coalesce(1.0::DOUBLE / other.best, 0) AS mrr_after
  FROM benchmark LEFT JOIN own ON own.question_id = item_id LEFT JOIN other ON other.question_id = item_id)"""


def values(numbers, name: str) -> str:
    return f"(SELECT unnest([{', '.join(map(str, numbers))}])::DOUBLE AS {name})"


def averages(test: str) -> str:
    of = lambda m: f"round(avg(CASE WHEN {test} THEN {m}_after ELSE {m} END), 9)::DOUBLE AS {m}"
    return f"count(*) AS cases, count(*) FILTER ({test}) AS stepped, {of('hit')}, {of('mrr')}"


PLANNER_SWEEP_SQL = f"""
WITH {CASES}, plans AS ({QUERY_PLANS_SQL})
SELECT planner, router, {averages('confidence < planner AND route_confidence <= router')}
FROM cases JOIN plans ON plans.question_id = 'b' || cases.question_id, {values(PLANNER, 'planner')}, {values(ROUTER, 'router')} GROUP BY planner, router
"""


def selector_gap_sweep(spark, sf_dir):
    """At every gap: for how many passages the first two scores are that close, and what is found if those take the other ranking instead."""
    hits = first_hits(spark, sf_dir)
    of = lambda k: F.max(F.when(F.col("rank") == k, F.col("lexical")))
    gaps = hits.groupBy("question_id").agg(F.round(of(1) - of(2), 6).alias("gap"))
    rows = cases(spark, sf_dir, hits).join(gaps, "question_id", "left")
    return report(sweeps.step_sweep(written(rows, "cases"), [sweeps.Axis("threshold", GAPS, "gap", reached=True)], ["hit", "mrr"]), "threshold")


GAP_SWEEP_SQL = f"""
WITH {CASES}, gaps AS (SELECT question_id, round(max(lexical) FILTER (rank = 1) - max(lexical) FILTER (rank = 2), 6) AS gap FROM top GROUP BY question_id)
SELECT threshold, {averages('coalesce(gap <= threshold, false)')} FROM cases LEFT JOIN gaps USING (question_id), {values(GAPS, 'threshold')} GROUP BY threshold
"""


def fallback_sweep(spark, sf_dir):
    """For every number of fallback documents: what is found if so many of the other ranking's follow the four of the plan, without those that it has already."""
    hits = first_hits(spark, sf_dir)
    own = hits.where("rank <= 4").select("question_id", F.col("record_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))
    other = written(rrf_fusion(spark, sf_dir, hits).select("question_id", "doc_id", "rank"), "fused").join(own.select("question_id", "doc_id"), ["question_id", "doc_id"], "left_anti")
    ranked = search.top(other.withColumnRenamed("rank", "old"), "question_id", 12, "old")
    first = judged(spark, sf_dir, ranked).where("whole").groupBy("question_id").agg(F.min("rank").alias("place"))
    rows = questions_of(spark, sf_dir).select("question_id").join(outcomes(judged(spark, sf_dir, own)), "question_id", "left").fillna(0.0).join(first, "question_id", "left")
    after = {"hit_after": F.lit(1.0), "mrr_after": F.when(F.col("hit") > 0, F.col("mrr")).otherwise(1.0 / (4 + F.col("place")))}
    return report(sweeps.step_sweep(written(rows.withColumns(after), "cases"), [sweeps.Axis("fallbacks", FALLBACKS, "place", reached=True)], ["hit", "mrr"]), "fallbacks")


FALLBACK_SWEEP_SQL = f"""
WITH {CASES}, further AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place FROM r WHERE rank <= 12 AND (question_id, doc_id) NOT IN (SELECT question_id, doc_id FROM top WHERE rank <= 4)),
places AS (SELECT question_id, min(place) AS place FROM further f JOIN benchmark b ON b.item_id = question_id JOIN d ON d.doc_id = f.doc_id WHERE {WHOLE} GROUP BY question_id),
fell AS (SELECT question_id, hit, mrr, 1 AS hit_after, CASE WHEN hit > 0 THEN mrr ELSE 1.0::DOUBLE / (4 + place) END AS mrr_after, place FROM (SELECT question_id, hit, mrr FROM cases) LEFT JOIN places USING (question_id))
SELECT fallbacks, {averages('coalesce(place <= fallbacks, false)')} FROM fell, {values(FALLBACKS, 'fallbacks')} GROUP BY fallbacks
"""

def run_report(spark, sf_dir):
    """What the stages of one retrieval run let through: questions, plans by route and those that a model would be asked about, hits, and fused candidates."""
    run = metrics.Run()
    questions = run.stage("questions", questions_of(spark, sf_dir), empty=F.count_if(F.col("question") == ""))
    unsure = (F.col("confidence") < 0.7) & (F.col("route_confidence") <= 0.62)
    routes = {r: F.count_if(F.col("preferred_route") == r) for r in ("chunk_first", "synopsis_first", "hybrid_both")}
    run.stage("plans", query_plans(spark, sf_dir).where("question_id LIKE 'b%'"), model_calls=F.count_if(unsure), deterministic=F.count_if(~unsure), **routes)
    fused = run.stage("fused", rrf_fusion(spark, sf_dir), by_both=F.count_if((F.col("lexical") > 0) & (F.col("dense") > 0)))
    judged_ = run.stage("judged", judged(spark, sf_dir, fused), whole=F.count_if("whole"), first=F.count_if(F.col("whole") & (F.col("rank") == 1)))
    run.stage("answered", questions.join(judged_.where("whole"), "question_id", "left_semi"))
    return run.report(spark).select("stage", "metric", "value")


RUN_REPORT_SQL = f"""
WITH {CASES}, plans AS (SELECT *, confidence < 0.7 AND route_confidence <= 0.62 AS unsure FROM ({QUERY_PLANS_SQL}) WHERE question_id LIKE 'b%'),
fused AS (SELECT * FROM r WHERE rank <= 12), judged AS (SELECT question_id, rank, {WHOLE} AS whole FROM fused t JOIN benchmark b ON b.item_id = question_id JOIN d ON d.doc_id = t.doc_id),
m(stage, metric, value) AS (
  SELECT 'questions', unnest(['rows', 'empty']), unnest([count(*), count(*) FILTER (coalesce(text, '') = '')]) FROM benchmark
  UNION ALL SELECT 'plans', unnest(['rows', 'model_calls', 'deterministic', 'chunk_first', 'synopsis_first', 'hybrid_both']), unnest([count(*), count(*) FILTER (unsure), count(*) FILTER (NOT unsure),
    count(*) FILTER (preferred_route = 'chunk_first'), count(*) FILTER (preferred_route = 'synopsis_first'), count(*) FILTER (preferred_route = 'hybrid_both')]) FROM plans
  UNION ALL SELECT 'fused', unnest(['rows', 'by_both']), unnest([count(*), count(*) FILTER (round(lexical, 6) > 0 AND dense > 0)]) FROM fused
  UNION ALL SELECT 'judged', unnest(['rows', 'whole', 'first']), unnest([count(*), count(*) FILTER (whole), count(*) FILTER (whole AND rank = 1)]) FROM judged
  UNION ALL SELECT 'answered', 'rows', count(DISTINCT question_id) FILTER (whole) FROM judged)
FROM m
"""

QUERIES = {"run_report": run_report, "planner_threshold_sweep": planner_threshold_sweep, "selector_gap_sweep": selector_gap_sweep, "fallback_sweep": fallback_sweep}

ORACLE_SQL = {"run_report": RUN_REPORT_SQL, "planner_threshold_sweep": PLANNER_SWEEP_SQL, "selector_gap_sweep": GAP_SWEEP_SQL, "fallback_sweep": FALLBACK_SWEEP_SQL}
