"""Plans that a model has a say in: its answers are tables, which are checked and merged for all questions at once.

plans: what routes.plan() gives. synopses: what topology.build_synopses() gives;
columns that are missing count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import constants as C
from ..functions.questions import answer_focus, route
from ..functions.text import col

NONE = "CAST(array() AS array<string>)"
SYNOPSIS_COLUMNS = {
    "front_matter_kind": "string", "low_value": "boolean", "chapter_number": "string", "chapter_title": "string", "section_role": "string", "section_path": "array<string>",
    "scope_labels": "array<string>", "aliases": "array<string>", "region_kind": "string", "title": "string", "ordinal": "int",
}
#: What a model may answer on the scope of a question; attempt counts its answers.
SCOPE_ANSWERS = """question_id string, attempt int, scope_ids array<string>, strictness string, confidence double, scope_query string, answer_focus array<string>,
intent_type string, query_type string, evidence_spread string, preferred_route string, fallback string, reason string"""
#: What it may answer on the plan itself.
PLAN_ANSWERS = """question_id string, intent_type string, query_type string, evidence_spread string, preferred_route string, constraint_mode string, region_kinds array<string>,
content_types array<string>, fallback string, confidence double"""


def completed(synopses: DataFrame) -> DataFrame:
    return synopses.select("*", *[F.lit(None).cast(t).alias(c) for c, t in SYNOPSIS_COLUMNS.items() if c not in synopses.columns])


def cleaned(values, valid: tuple[str, ...]) -> Column:
    """Of a model's list what is valid, in lower case, each once, in order."""
    own = F.transform(F.coalesce(col(values), F.expr(NONE)), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(own, lambda x: x.isin(*valid)))


def said(value, valid: tuple[str, ...], otherwise) -> Column:
    own = F.lower(F.trim(F.coalesce(col(value), F.lit(""))))
    return F.when(own.isin(*valid), own).otherwise(col(otherwise))


def flag(value, otherwise: Column) -> Column:
    own = F.lower(F.trim(col(value)))
    return F.when(own.isin("1", "true", "yes", "on"), True).when(own.isin("0", "false", "no", "off"), False).otherwise(otherwise)


def strictness_of(value) -> Column:
    own = F.replace(F.lower(F.trim(F.coalesce(col(value), F.lit("")))), F.lit("-"), F.lit("_"))
    return F.when(own.isin("hard", "hard_local", "hard_region", "strict", "strict_local"), "hard").when(own.isin("soft", "soft_local", "soft_multi_region", "local"), "soft").otherwise("none")


def has_filters() -> Column:
    return (F.size("page_labels") + F.size("clause_terms") + F.size("explicit")) > 0


def names_a_part(question) -> Column:
    """Does the question bind itself to a chapter, section, appendix, page or clause?"""
    low = F.lower(col(question))
    return low.rlike(r"\b(?:chapter|section|appendix|page|clause)\s+[a-z0-9ivxlcdm]") | low.rlike(r"\b(?:in|from|within|inside)\s+the\s+[a-z0-9][a-z0-9 ._-]{2,80}?\s+(?:chapter|section|appendix)\b")


def long_tokens(text) -> Column:
    """Distinct words of more than two letters or digits."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2))


def scope_tokens(text) -> Column:
    """Distinct words of more than two characters; punctuation stays."""
    return F.array_distinct(F.filter(F.split(F.replace(F.lower(col(text)), F.lit("_"), F.lit(" ")), r"\s+"), lambda t: F.length(t) > 2))


def is_low_value() -> Column:
    return F.coalesce("low_value", F.lit(False)) | F.lower(F.coalesce("front_matter_kind", F.lit(""))).isin(*C.LOW_VALUE_FRONT_MATTER)


def likely_scopes(questions: DataFrame, synopses: DataFrame, top: int = 20) -> DataFrame:
    """question_id, section_id, overlap, rank: the sections whose names share most of a question's words. Only pairs that share a word are formed."""
    rows = completed(synopses).where(~is_low_value())
    names = F.concat_ws(" ", "title", "chapter_title", "section_role", F.array_join(F.slice("section_path", F.greatest(F.size("section_path") - 3, F.lit(1)), F.lit(4)), " "), F.array_join(F.slice("scope_labels", 1, 8), " "), F.array_join(F.slice("aliases", 1, 8), " "))
    terms = rows.select("document_id", "section_id", "ordinal", F.explode(long_tokens(names)).alias("term"))
    asked = questions.select("question_id", "document_id", long_tokens("question").alias("_q")).select("question_id", "document_id", F.size("_q").alias("_n"), F.explode("_q").alias("term"))
    pairs = asked.join(terms, ["document_id", "term"]).groupBy("question_id", "_n", "section_id", "ordinal").agg(F.count(F.lit(1)).alias("_c"))
    order = W.partitionBy("question_id").orderBy(F.desc("overlap"), "ordinal", "section_id")
    return pairs.withColumn("overlap", F.col("_c") / F.col("_n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("question_id", "section_id", "overlap", "rank")


def chapter_key() -> list[Column]:
    return [F.coalesce("chapter_number", F.lit("")).alias("number"), F.lower(F.coalesce("chapter_title", F.lit(""))).alias("chapter")]


def coherent(scopes: DataFrame) -> DataFrame:
    """question_id, scope_ids of hard scopes: one chapter's sections.

    scopes: question_id, pos, section_id, number, chapter, words. The chapter that
    shares most with what is asked wins, then the larger, then the first; if
    none shares anything, there must be only one. Without chapters the first section is left.
    """
    hits = F.size(F.array_intersect(scope_tokens("chapter"), "words")) + ((F.col("number") != "") & F.array_contains("words", F.col("number"))).cast("int")
    groups = scopes.where("number != '' OR chapter != ''").groupBy("question_id", "number", "chapter").agg(
        F.max(hits).alias("score"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "section_id"))), lambda x: x["section_id"]).alias("ids")
    )
    w = W.partitionBy("question_id")
    best = groups.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), F.desc("n"), "first"))).withColumn("_m", F.count(F.lit(1)).over(w)).where("_r = 1")
    best = best.select("question_id", F.when((F.col("score") > 0) | (F.col("_m") == 1), F.col("ids")).otherwise(F.expr(NONE)).alias("_ids"))
    first = scopes.groupBy("question_id").agg(F.min_by("section_id", "pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    out = first.join(best, "question_id", "left")
    return out.select("question_id", F.when(F.col("_n") == 1, F.array("_first")).otherwise(F.coalesce("_ids", F.array("_first"))).alias("scope_ids"))


def focus_score() -> Column:
    """How much a section looks like the summary or the end of its chapter."""
    points = lambda test, n: F.when(test, n).otherwise(0)
    title, role = F.lower("title"), F.lower(F.coalesce("section_role", F.lit("")))
    text = F.lower(F.concat_ws(" ", "section_id", "title", "region_kind", F.array_join("section_path", " "), F.coalesce("section_role", F.lit(""))))
    return (
        points(F.contains(text, F.lit("summary")), 4) + points(F.contains(text, F.lit("chapter")), 3) + points(F.col("region_kind").isin("overview", "discussion"), 2)
        + points(role.isin("overview", "conclusion"), 2) + points(title.isin("introduction", "overview", "summary", "conclusion", "conclusions"), 2) + points(F.contains("section_id", F.lit("|")), 1)
    )


def focused(scopes: DataFrame, synopses: DataFrame, top: int = 3) -> DataFrame:
    """question_id, focused: where a summary of one chapter is asked for, its sections that look most like one.

    scopes: question_id, document_id, section_id, number, chapter of the questions that ask for summaries or conclusions.
    """
    named = scopes.where("number != '' OR chapter != ''").select("question_id", "document_id", "number", "chapter").distinct()
    single = named.withColumn("_m", F.count(F.lit(1)).over(W.partitionBy("question_id"))).where("_m = 1").drop("_m")
    rows = completed(synopses).where(~is_low_value()).withColumn("_score", focus_score()).where("_score > 0").select("document_id", "section_id", "ordinal", "_score", *chapter_key())
    rows = rows.withColumnRenamed("number", "_number").withColumnRenamed("chapter", "_chapter")
    same = F.when(F.col("number") != "", F.col("number") == F.col("_number")).otherwise(F.col("chapter") == F.col("_chapter"))
    found = single.join(rows, "document_id").where(same)
    order = W.partitionBy("question_id").orderBy(F.desc("_score"), "ordinal")
    first = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    return first.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "section_id"))), lambda x: x["section_id"]).alias("focused"))


def scoped_plans(plans: DataFrame, answers: DataFrame, synopses: DataFrame, least: float = 0.55) -> DataFrame:
    """Plans whose scope a model has resolved, where its answer can be enforced; of several attempts the first that can.

    An answer must be sure enough, name known sections of some value, and, for a
    hard scope, the question must bind itself to a part and the sections to one chapter.
    """
    known = completed(synopses).select("document_id", "section_id", is_low_value().alias("_low"), *chapter_key())
    rows = plans.join(answers.select("question_id", F.struct(*[c for c in answers.columns if c != "question_id"]).alias("m")), "question_id").withColumn("try", F.concat_ws("#", "question_id", "m.attempt"))
    rows = rows.withColumn("strictness", strictness_of("m.strictness")).where((F.coalesce("m.confidence", F.lit(0.0)) >= least) & (F.col("strictness") != "none"))
    each = rows.select("try", "document_id", F.size("page_labels").alias("_pages"), F.posexplode(F.array_distinct(F.transform(F.coalesce("m.scope_ids", F.expr(NONE)), lambda x: F.trim(x)))).alias("pos", "section_id"))
    each = each.join(known, ["document_id", "section_id"]).where((F.col("_pages") > 0) | ~F.col("_low"))
    bound = rows.join(each.select("try").distinct(), "try", "left_semi").withColumn("strictness", F.when(has_filters(), "hard").otherwise(F.col("strictness")))
    bound = bound.where((F.col("strictness") != "hard") | has_filters() | names_a_part("question")).withColumn("words", scope_tokens(F.concat_ws(" ", "question", F.coalesce("m.scope_query", F.lit("")))))
    of_try = each.join(bound.select("try", "strictness", "words"), "try")
    hard = coherent(of_try.where("strictness = 'hard'").withColumn("question_id", F.col("try"))).where(F.size("scope_ids") > 0)
    soft = of_try.where("strictness = 'soft'").groupBy(F.col("try").alias("question_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "section_id"))), lambda x: x["section_id"]).alias("scope_ids"))
    kept = bound.join(hard.unionByName(soft).withColumnRenamed("question_id", "try"), "try")
    focus = F.array_distinct(F.concat(cleaned("m.answer_focus", C.FOCUS_TERMS), answer_focus("question")))
    kept = kept.withColumn("answer_focus", focus)
    asks = kept.where(F.arrays_overlap("answer_focus", F.array(F.lit("summary"), F.lit("conclusions")))).select("try", "document_id", F.explode("scope_ids").alias("section_id"))
    about = focused(asks.join(known, ["document_id", "section_id"]).withColumnRenamed("try", "question_id"), synopses).withColumnRenamed("question_id", "try")
    kept = kept.join(about, "try", "left").withColumn("scope_ids", F.coalesce("focused", "scope_ids"))
    first = kept.withColumn("_r", F.row_number().over(W.partitionBy("question_id").orderBy("m.attempt"))).where("_r = 1")
    hard_scope = F.col("strictness") == "hard"
    profile = F.col("p").withField("intent_type", said("m.intent_type", C.INTENT_TYPES, "p.intent_type")).withField("query_type", said("m.query_type", C.QUERY_TYPES, "p.query_type")).withField("evidence_spread", said("m.evidence_spread", C.EVIDENCE_SPREADS, "p.evidence_spread"))
    new = {
        "p": profile,
        "mode": F.when(hard_scope, "hard_region").when(F.size("scope_ids") <= 2, "soft_local").otherwise("soft_multi_region"),
        "route": F.when(hard_scope, "chunk_first").otherwise(said("m.preferred_route", C.ROUTES, "route")),
        "targets": F.col("scope_ids"),
        "kinds": F.when(hard_scope, F.expr(NONE)).otherwise(F.col("kinds")),
        "fallback": ~hard_scope & flag("m.fallback", F.lit(False)),
        "confidence": F.greatest("confidence", F.coalesce("m.confidence", F.lit(0.0))),
    }
    return first.select(
        *[new.get(c, F.col(c)).alias(c) for c in plans.columns], "strictness", F.col("scope_ids").alias("allowed"), F.coalesce(F.trim("m.scope_query"), F.lit("")).alias("scope_query"), "answer_focus", F.lit("llm_orchestrator").alias("planner_source"), F.coalesce(F.trim("m.reason"), F.lit("")).alias("reason")
    )


def told_plans(plans: DataFrame, answers: DataFrame) -> DataFrame:
    """Plans as a model's structured answers change them. Filters of the question always win; a plan that comes out as it was stays deterministic."""
    rows = plans.join(answers.select("question_id", F.struct(*[c for c in answers.columns if c != "question_id"]).alias("m")), "question_id")
    wanted = said("m.constraint_mode", tuple(m for m in C.CONSTRAINT_MODES if m != "hard_region"), "mode")
    rows = rows.withColumn("_mode", F.when(has_filters(), "hard_region").otherwise(wanted))
    hard, kinds = F.col("_mode") == "hard_region", cleaned("m.region_kinds", C.REGION_KINDS)
    rows = rows.withColumn("_p", F.col("p").withField("intent_type", said("m.intent_type", C.INTENT_TYPES, "p.intent_type")).withField("query_type", said("m.query_type", C.QUERY_TYPES, "p.query_type")).withField("evidence_spread", said("m.evidence_spread", C.EVIDENCE_SPREADS, "p.evidence_spread")))
    rows = rows.withColumn("_route", F.when(hard, "chunk_first").otherwise(said("m.preferred_route", C.ROUTES, "route")))
    rows = rows.withColumn("_kinds", F.when(hard, F.expr(NONE)).when(F.size(kinds) > 0, kinds).otherwise(F.col("kinds")))
    rows = rows.withColumn("_fallback", F.col("_mode").isin("soft_local", "soft_multi_region") & flag("m.fallback", F.col("fallback")))
    as_it_was = (F.to_json("_p") == F.to_json("p")) & (F.col("_route") == F.col("route")) & (F.col("_mode") == F.col("mode")) & (F.col("_kinds") == F.col("kinds")) & (F.col("_fallback") == F.col("fallback"))
    sure = F.greatest("confidence", F.coalesce("m.confidence", F.lit(0.82)))
    new = {"p": "_p", "mode": "_mode", "route": "_route", "kinds": "_kinds", "fallback": "_fallback"}
    return rows.where(~as_it_was).select(*[F.col(new.get(c, c)).alias(c) if c != "confidence" else sure.alias(c) for c in plans.columns], F.lit("llm_structured").alias("planner_source"))


def routed_plans(plans: DataFrame, answers: DataFrame, threshold: float = 0.7, router: float = 0.62) -> DataFrame:
    """Unsure plans whose rules are unsure of the route, too, take the route that a model names. answers: question_id, route."""
    rule = route("question", F.col("p"))
    asked = plans.where((F.col("confidence") < threshold) & (rule["confidence"] <= router))
    named = answers.select("question_id", F.lower(F.trim("route")).alias("_route")).where(F.col("_route").isin(*C.ROUTES))
    rows = asked.join(named, "question_id")
    new = {"route": F.col("_route"), "confidence": F.greatest("confidence", F.lit(0.72))}
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in plans.columns], F.lit("llm_fallback").alias("planner_source"))


def merged_plans(plans: DataFrame, synopses: DataFrame, scopes: DataFrame | None = None, told: DataFrame | None = None, routes: DataFrame | None = None) -> DataFrame:
    """One plan for each question: a resolved scope, else a structured answer, else the deterministic plan with a model's route where it is unsure.

    scopes: SCOPE_ANSWERS; told: PLAN_ANSWERS; routes: question_id, route. Tables that are left out answer nothing.
    """
    own = plans.withColumn("planner_source", F.lit("deterministic"))
    if routes is not None:
        found = routed_plans(plans, routes)
        own = found.unionByName(own.join(found.select("question_id"), "question_id", "left_anti"))
    if told is not None:
        base = own.drop("planner_source")
        found = told_plans(base, told)
        own = found.unionByName(own.join(found.select("question_id"), "question_id", "left_anti"))
    more = {"strictness": F.lit("none"), "allowed": F.expr(NONE), "scope_query": F.lit(""), "answer_focus": answer_focus("question"), "reason": F.lit("")}
    own = own.select("*", *[c.alias(n) for n, c in more.items()])
    if scopes is not None:
        found = scoped_plans(plans, scopes, synopses)
        own = found.unionByName(own.join(found.select("question_id"), "question_id", "left_anti"))
    return own
