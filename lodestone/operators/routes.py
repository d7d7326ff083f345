"""Planned retrieval: every question takes its route through sections and chunks, all questions at once.

Questions are rows (question_id, document_id, question). A question's records
are the chunks of its document that its filters leave; the lexical weights are
fitted on those, so a record's row carries the question that it belongs to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import constants as C
from ..functions import questions as Q
from ..functions.text import keyword_overlap
from ..sources.tables import written
from . import search, topology

# How many sections a route looks into, and how much of the rest it adds.
SECTION_WINDOW, FALLBACK_TOP_K, REGION_TOP_K = 4, 3, 10
OVERVIEW_KINDS = ("overview", "abstract", "introduction", "background")
FINDINGS_KINDS = ("results", "discussion", "evidence")
LATE_KINDS = ("discussion", "conclusion", "conclusions", "future work", "future directions", "limitations")
LOW_KINDS = ("references", "appendix")
NONE = "CAST(array() AS array<string>)"


def plan(questions: DataFrame, synopses: DataFrame) -> DataFrame:
    """Adds what is asked, the filters, the constraint, the route, the target kinds and regions, and the confidence."""
    rows = questions.withColumn("p", Q.profile("question"))
    rows = rows.withColumn("page_labels", Q.page_labels("question")).withColumn("clause_terms", Q.clause_terms("question")).withColumn("explicit", Q.section_filter("question"))
    rows = rows.withColumn("mode", Q.constraint_mode("question", F.col("p")))
    rows = rows.withColumn("route", Q.preferred_route(F.col("mode"), F.col("p"))).withColumn("kinds", Q.target_regions(F.col("p"))).withColumn("focus", Q.summary_focus("question"))
    rows = written(rows, "profiles")
    regions = topology.candidate_regions(rows.select("question_id", "document_id", "question", "kinds", "explicit"), synopses, REGION_TOP_K)
    targets = regions.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "section_id"))), lambda x: x["section_id"]).alias("targets"))
    rows = rows.join(targets, "question_id", "left").withColumn("targets", F.coalesce("targets", F.expr(NONE)))
    fallback = F.col("mode").isin("soft_local", "soft_multi_region")
    confidence = Q.plan_confidence("question", F.col("mode"), F.col("p"), F.size("targets") > 0)
    summary = (F.col("p.query_type") == "summary_lookup") & (F.col("p.evidence_spread") == "global")
    return written(rows.withColumn("fallback", fallback).withColumn("confidence", confidence).withColumn("global_summary", summary), "plans")


def chunk_candidates(plans: DataFrame, chunks: DataFrame, sections: str, k: int = C.FUSED_TOP_K, dense: DataFrame | None = None) -> DataFrame:
    """Scored candidates of each plan. sections: the column with the section ids to look into (empty: all).

    Pages, clauses and sections filter in turn; a filter that would leave nothing is skipped unless the constraint is hard.
    """
    rows = plans.select("question_id", "document_id", "question", "page_labels", "clause_terms", "mode", "kinds", F.col(sections).alias("_sections")).join(search.completed(chunks).withColumnRenamed("chunk_id", "record_id"), "document_id")
    tests = [
        (F.size("page_labels") > 0, F.array_contains("page_labels", F.col("page_label"))),
        (F.size("clause_terms") > 0, F.arrays_overlap("clause_terms", F.coalesce("clause_ids", F.expr(NONE)))),
        (F.size("_sections") > 0, F.coalesce(F.array_contains("_sections", F.col("section_id")), F.lit(False))),
    ]
    kept = written(search.relaxing_filter(rows, tests, F.col("mode") == "hard_region").select("question_id", "record_id", "text"), "allowed")
    asked = plans.select("question_id", "question")
    lexical = search.lexical_search(asked, kept, k, scope=("question_id",))
    ranked = lexical.select("question_id", "record_id", F.lit("lexical").alias("system"), "rank", F.col("lexical").alias("score"))
    if dense is not None:
        allowed = search.only_allowed(dense, kept.select("question_id", "record_id"))
        order = W.partitionBy("question_id").orderBy(F.desc("score"), "record_id")
        ranked = ranked.unionByName(allowed.select("question_id", "record_id", F.lit("dense").alias("system"), F.row_number().over(order).alias("rank"), "score"))
    fused = written(search.fuse(ranked, k), "fused")
    fused = written(search.promote_continuations(fused, search.completed(chunks)), "promoted")
    scope = plans.select("question_id", F.col(sections).alias("section_ids"), F.col("kinds").alias("region_kinds"), "clause_terms")
    return written(search.score_chunks(asked, fused, chunks.drop("document_id"), scope), "candidates")


def ranked_synopses(plans: DataFrame, synopses: DataFrame) -> DataFrame:
    """The synopses of each plan's document, by lexical rank, kinds and targets."""
    text = F.concat_ws("\n", "title", F.array_join("section_path", " > "), "region_kind", F.array_join("key_terms", ", "), "synopsis")
    records = plans.select("question_id", "document_id").join(synopses.select("document_id", F.col("section_id").alias("record_id"), text.alias("text")), "document_id").select("question_id", "record_id", "text")
    lexical = search.lexical_search(plans.select("question_id", "question"), records, 8, scope=("question_id",))
    scores = lexical.select("question_id", F.col("record_id").alias("section_id"), F.lit(0.0).alias("dense"), "lexical")
    targets = plans.select("question_id", F.explode("targets").alias("section_id"))
    return written(topology.rank_synopses(plans.select("question_id", "document_id", "question", "kinds"), synopses, scores, targets), "synopses")


def anchors(plans: DataFrame, ranked: DataFrame, synopses: DataFrame) -> DataFrame:
    """question_id, chosen: for summaries of a whole document the first overview, findings and late sections as the focus wants them, then targets."""
    kinds = synopses.select("document_id", "section_id", F.lower(F.coalesce("section_kind", F.lit(""))).alias("_kind"))
    rows = ranked.join(kinds, ["document_id", "section_id"]).where(~F.col("_kind").isin(*LOW_KINDS))
    first = lambda k: F.min_by(F.when(F.col("_kind").isin(*k), F.col("section_id")), F.when(F.col("_kind").isin(*k), F.col("rank")))
    found = rows.groupBy("question_id").agg(
        first(OVERVIEW_KINDS).alias("_o"), first(FINDINGS_KINDS).alias("_f"), first(LATE_KINDS).alias("_l"),
        F.transform(F.filter(F.array_sort(F.collect_list(F.struct("rank", "section_id"))), lambda x: x["rank"] <= SECTION_WINDOW - 1), lambda x: x["section_id"]).alias("_top"),
    )
    rows = plans.where("global_summary").join(found, "question_id", "left")
    focused = (
        F.when(F.col("focus") == "findings", F.array("_o", "_f", "_l"))
        .when(F.col("focus") == "late", F.array("_o", "_l", "_f"))
        .when(F.col("focus") == "balanced", F.array("_o", "_f", "_l"))
        .otherwise(F.array("_o", "_f"))
    )
    picked = F.filter(focused, lambda x: x.isNotNull())
    chosen = F.concat(F.when(F.size(picked) > 0, picked).otherwise(F.coalesce("_top", F.expr(NONE))), "targets")
    return rows.select("question_id", F.slice(F.array_distinct(chosen), 1, SECTION_WINDOW).alias("chosen"))


def scoped_sections(plans: DataFrame, ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """question_id, chosen: a plan's targets, or its best synopses, and the sections next to the first of them."""
    best = ranked.where(F.col("rank") <= SECTION_WINDOW).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "section_id"))), lambda x: x["section_id"]).alias("_best"))
    rows = plans.where("NOT global_summary").join(best, "question_id", "left")
    rows = rows.withColumn("_own", F.when(F.size("targets") > 0, F.col("targets")).otherwise(F.coalesce("_best", F.expr(NONE))))
    seeds = F.slice("_own", 1, 2)
    seeds = rows.where("mode != 'hard_region'").select("question_id", "document_id", F.posexplode(F.when(F.col("mode") == "soft_local", F.slice("_own", 1, 1)).otherwise(seeds)).alias("seed", "source"), "mode")
    near = []
    for local, types in ((True, ("previous_next", "parent_child", "semantic_neighbor")), (False, ("previous_next", "same_region_family", "semantic_neighbor"))):
        own = seeds.where((F.col("mode") == "soft_local") if local else (F.col("mode") != "soft_local"))
        near.append(topology.expand_scope(own, edges, types).select("question_id", F.struct("seed", F.negative("weight").alias("w"), "target").alias("n")))
    more = near[0].unionByName(near[1]).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list("n")), lambda x: x["target"]).alias("_near"))
    return rows.join(more, "question_id", "left").select("question_id", F.array_distinct(F.concat("_own", F.coalesce("_near", F.expr(NONE)))).alias("chosen"))


def section_seeds(plans: DataFrame, chunks: DataFrame, limit: int = 3) -> DataFrame:
    """For summaries of a whole document one chunk of each of the first chosen sections: the first of an overview, else the one that overlaps most."""
    rows = plans.where("global_summary").select("question_id", "document_id", "question", "focus", F.posexplode(F.slice("chosen", 1, limit)).alias("_at", "section_id"))
    rows = rows.join(search.completed(chunks).drop("document_id").withColumnRenamed("chunk_id", "record_id"), "section_id")
    overlap = keyword_overlap("question", F.coalesce("section_heading", F.lit(""))) + keyword_overlap("question", F.left("text", F.lit(600)))
    early = (F.col("focus") == "overview") & F.col("section_kind").isin(*OVERVIEW_KINDS)
    late = F.col("focus").isin("findings", "late") & F.col("section_kind").isin(*FINDINGS_KINDS, *LATE_KINDS)
    value = F.when(early, -F.col("chunk_index").cast("double")).otherwise(overlap + F.when(late & (F.col("chunk_index") > 0), 0.05).otherwise(0.0))
    order = W.partitionBy("question_id", "section_id").orderBy(F.desc("_v"), "chunk_index")
    best = rows.withColumn("_v", value).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    fused = best.select("question_id", "record_id", F.lit(0.22).alias("fused"), F.lit(0.0).alias("dense"), F.lit(0.0).alias("lexical"))
    scope = plans.select("question_id", F.col("chosen").alias("section_ids"), F.col("kinds").alias("region_kinds"))
    return search.score_chunks(plans.select("question_id", "question"), fused, chunks.drop("document_id"), scope)


def route_all(questions: DataFrame, chunks: DataFrame, synopses: DataFrame, edges: DataFrame, dense: DataFrame | None = None, plans: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plans (with the route used), final candidates and grades of all questions.

    Direct search looks into the targets, or everywhere for the hybrid route;
    the synopsis routes look into chosen sections, add the best chunks from
    outside where the plan allows, and, for summaries, a chunk of each anchor.
    The section route, which only a model names, looks into the best sections and
    nowhere else. plans: those of plan() as planning.merged_plans() changes them.
    """
    plans = plan(questions, synopses) if plans is None else written(plans, "merged")
    guided = plans.where("route != 'chunk_first'")
    ranked = ranked_synopses(guided, synopses)
    chosen = anchors(guided, ranked, synopses).unionByName(scoped_sections(guided, ranked, edges))
    plans = plans.join(chosen, "question_id", "left").withColumn("chosen", F.coalesce("chosen", F.expr(NONE))).withColumn("everywhere", F.expr(NONE))
    plans = written(plans, "routes")
    keep = ["question_id", "record_id", "text", "section_id", "section_heading", "section_kind", "heading_only", "continuation_id", "chunk_role", "score", "dense", "lexical", "query_type"]
    direct = chunk_candidates(plans.where("route = 'chunk_first'"), chunks, "targets", dense=dense).select(*keep)
    hybrid = chunk_candidates(plans.where("route = 'hybrid_both'"), chunks, "everywhere", dense=dense).select(*keep)
    local = chunk_candidates(plans.where("route != 'chunk_first'"), chunks, "chosen", dense=dense).select(*keep)
    outside = chunk_candidates(plans.where("route NOT IN ('chunk_first', 'section_first') AND fallback"), chunks, "everywhere", k=max(FALLBACK_TOP_K + 2, 3), dense=dense)
    outside = outside.join(plans.select("question_id", F.explode("chosen").alias("section_id")), ["question_id", "section_id"], "left_anti").select(*keep)
    outside = search.top(outside, "question_id", FALLBACK_TOP_K, F.desc("score"), "record_id").select(*keep)
    seeds = section_seeds(plans, chunks).select(*keep)
    pool = direct.unionByName(hybrid).unionByName(local).unionByName(outside).unionByName(seeds)
    pool = in_hard_scope(written(pool, "pool"), plans)
    final = written(search.finalize(search.best_by_id(pool)), "final")
    used = F.when((F.col("route") == "synopsis_first") & F.col("global_summary"), "global_summary_first").otherwise(F.col("route"))
    return plans.withColumn("route_used", used), final, search.grade(questions, final)


def hard_scopes(plans: DataFrame) -> DataFrame:
    """question_id, scope of the plans whose scope is hard and named: the sections allowed, else the targets."""
    named = F.when(F.coalesce(F.size("allowed"), F.lit(0)) > 0, F.col("allowed")).otherwise(F.col("targets")) if "allowed" in plans.columns else F.col("targets")
    return plans.where("strictness = 'hard'").select("question_id", named.alias("scope")).where("size(scope) > 0")


def in_hard_scope(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """Where a plan's scope is hard and named (column strictness), candidates from other sections go, after the merge."""
    if "strictness" not in plans.columns:
        return candidates
    hard = hard_scopes(plans)
    allowed = hard.select("question_id", F.explode("scope").alias("section_id")).distinct()
    free = candidates.join(hard.select("question_id"), "question_id", "left_anti")
    return free.unionByName(candidates.join(allowed, ["question_id", "section_id"], "left_semi").select(*free.columns))


def scope_notes(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """question_id, removed, note of the questions with a hard scope: how many candidates in_hard_scope() takes out."""
    kept = in_hard_scope(candidates, plans).groupBy("question_id").agg(F.count(F.lit(1)).alias("kept"))
    had = candidates.groupBy("question_id").agg(F.count(F.lit(1)).alias("had"))
    removed = F.coalesce("had", F.lit(0)) - F.coalesce("kept", F.lit(0))
    hard = hard_scopes(plans).select("question_id").join(had, "question_id", "left").join(kept, "question_id", "left")
    rows = hard.select("question_id", removed.alias("removed"))
    return rows.withColumn("note", F.when(F.col("removed") > 0, F.concat(F.lit("Hard scope removed "), F.col("removed").cast("string"), F.lit(" candidates from outside."))))
