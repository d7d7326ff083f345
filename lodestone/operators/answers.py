"""Answers from evidence: selection, extractive text, cache and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import constants as C
from ..functions.text import cache_key, contains_any, preview, squash
from ..sources.tables import written

# Sections that sum up a document, and what stands for an answer where there is none.
SUPPORT_KINDS = ("overview", "abstract", "introduction", "background", "results", "discussion", "conclusion", "conclusions", "future work", "future directions")
UNSUPPORTED = "Unsupported by the retrieved evidence."


def normalized(score: str, by: str = "question_id") -> Column:
    """Scores of a question between 0 and 1; all 1 if they are equal."""
    w = W.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low <= 1e-9, 1.0).otherwise((F.col(score) - low) / (high - low))


def selection_triggers(final: DataFrame, plans: DataFrame, grades: DataFrame, gap: float = 0.08, on: tuple[str, ...] = ("spread",)) -> DataFrame:
    """question_id, gap, the triggers and whether one that is on fires: is a second look at the order of a question's evidence worth its price?

    plans: question_id, spread. Only questions with two candidates, and with a
    grade other than unsupported, are looked at. A gap of 1 or more takes every
    question as ambiguous.
    """
    first = lambda k: F.max(F.when(F.col("final_rank") == k, F.col("score")))
    gaps = final.where("final_rank <= 2").groupBy("question_id").agg(F.abs(first(1) - first(2)).alias("gap"))
    graded = grades.select("question_id", "evidence_status").where("evidence_status != 'unsupported'")
    rows = plans.select("question_id", "spread").join(graded, "question_id", "left").join(gaps, "question_id", "left")
    looked_at = F.col("gap").isNotNull() & F.col("evidence_status").isNotNull()
    tests = {"weak": F.col("evidence_status") == "weak", "spread": F.col("spread").isin("global", "sectional"), "gap": (F.col("gap") <= gap) | F.lit(gap >= 1.0)}
    tests = {k: looked_at & F.coalesce(t, F.lit(False)) for k, t in tests.items()}
    wanted = F.lit(False)
    for name in on:
        wanted = wanted | tests[name]
    return rows.select("question_id", F.when(looked_at, F.col("gap")).alias("gap"), *[t.alias(f"{k}_trigger") for k, t in tests.items()], wanted.alias("triggered"))


def reorder(final: DataFrame, given: DataFrame) -> DataFrame:
    """given: question_id, record_id, given. A quarter old rank, three quarters a model's scores; the selection stays the same."""
    rows = final.join(given, ["question_id", "record_id"], "left").withColumn("_old", normalized("score")).withColumn("given", F.coalesce("given", F.lit(0.0)))
    rows = rows.withColumn("selector_score", 0.25 * F.col("_old") + 0.75 * F.col("given")).drop("_old", "given")
    order = W.partitionBy("question_id").orderBy(F.desc("selector_score"), "final_rank")
    return rows.withColumn("final_rank", F.row_number().over(order))


#: What a candidate may have for the selector; missing columns count as null.
CONTEXT_COLUMNS = {
    "section_id": "string", "section_heading": "string", "section_kind": "string", "content_type": "string", "section_role": "string", "chapter_title": "string",
    "chapter_number": "string", "scope_labels": "array<string>", "section_path": "array<string>", "page_label": "string",
}


def with_context(rows: DataFrame) -> DataFrame:
    return rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in CONTEXT_COLUMNS.items() if c not in rows.columns])


def context_adjustment() -> Column:
    """What a candidate's names add to its score for what the answer should dwell on. Rows: strictness, allowed, answer_focus and CONTEXT_COLUMNS."""
    about = F.lower(F.concat_ws(" ", "section_id", "section_heading", "section_kind", "content_type", "section_role", "chapter_title", F.array_join("scope_labels", " "), F.array_join("section_path", " ")))
    focus = lambda *names: F.arrays_overlap("answer_focus", F.array(*[F.lit(n) for n in names]))
    add = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0.0)
    hard = F.col("strictness") == "hard"
    return (
        add(hard & F.array_contains("allowed", F.col("section_id")), 0.06)
        + add(hard & focus("summary", "conclusions") & contains_any(about, ("summary", "overview", "introduction", "conclusion")), 0.14)
        + add(hard & focus("implementation", "methodology") & F.exists("answer_focus", lambda x: F.contains(about, x)), 0.05)
        + add(focus("findings", "results") & contains_any(about, ("finding", "findings", "result", "results", "discussion", "evidence")), 0.08)
        + add(focus("limitations", "challenges") & contains_any(about, ("challenge", "challenges", "limitation", "limitations", "constraint")), 0.10)
    )


def select_evidence(final: DataFrame, plans: DataFrame, given: DataFrame, chosen: DataFrame, top: int = 4, most: int = 2, prune: bool = False) -> DataFrame:
    """The final candidates with the chosen ones first (or, with prune, only these).

    plans: question_id, spread, strictness, allowed, answer_focus. given: question_id,
    record_id, given (a model's score). chosen: question_id, pos, record_id (what it
    picked). Only questions of `given` or `chosen` change. The first `top` are scored
    anew; the model's picks come first, for summaries of a whole document after the
    best section that sums up; the best of the rest fill up, there with other pages first.
    """
    asked = given.select("question_id").unionByName(chosen.select("question_id")).distinct().withColumn("_asked", F.lit(True))
    rows = with_context(final).join(asked, "question_id", "left").join(plans.select("question_id", "spread", "strictness", "allowed", "answer_focus"), "question_id", "left")
    pool = rows.where((F.col("final_rank") <= top) & F.col("_asked")).join(given, ["question_id", "record_id"], "left").withColumn("_old", normalized("score"))
    whole, kind = F.coalesce(F.col("spread") == "global", F.lit(False)), F.lower(F.coalesce("section_kind", F.lit("")))
    summary = F.when(whole & kind.isin(*SUPPORT_KINDS), 0.12).when(whole & kind.isin("references", "appendix"), -0.28).otherwise(0.0)
    pool = pool.withColumn("_value", 0.25 * F.col("_old") + 0.75 * F.coalesce("given", F.lit(0.0)) + summary + context_adjustment())
    pool = pool.withColumn("_place", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("_value"), "final_rank")))
    item = F.struct("_place", "record_id", F.coalesce("page_label", F.lit("")).alias("page"), kind.isin(*SUPPORT_KINDS).alias("support"))
    ranked = pool.groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("ranked"), F.bool_or(whole).alias("whole"))
    picks = chosen.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "record_id"))), lambda x: x["record_id"]).alias("picks"))
    q = ranked.join(picks, "question_id", "left")
    known = F.transform("ranked", lambda x: x["record_id"])
    q = q.withColumn("picks", F.slice(F.array_distinct(F.filter(F.coalesce("picks", F.array_except(known, known)), lambda x: F.array_contains(known, x))), 1, most))
    best = F.get(F.filter("ranked", lambda x: x["support"]), F.lit(0))["record_id"]
    q = q.withColumn("first", F.when(F.col("whole") & best.isNotNull() & ~F.array_contains("picks", best), F.concat(F.array(best), "picks")).otherwise(F.col("picks")))
    q = q.withColumn("limit", F.when(F.col("whole"), most + 1).otherwise(most))
    pages = F.array_distinct(F.transform(F.filter("ranked", lambda x: F.array_contains("first", x["record_id"])), lambda x: x["page"]))

    def fill(done, x):
        full = F.size(done["ids"]) >= F.col("limit")
        again = F.col("whole") & F.array_contains(done["pages"], x["page"]) & (F.size(done["pages"]) < F.col("limit"))
        more = F.struct(F.concat(done["ids"], F.array(x["record_id"])).alias("ids"), F.array_union(done["pages"], F.array(x["page"])).alias("pages"))
        return F.when(full | again | F.array_contains(done["ids"], x["record_id"]), done).otherwise(more)

    q = q.select("question_id", F.aggregate("ranked", F.struct(F.col("first").alias("ids"), pages.alias("pages")), fill)["ids"].alias("ids"))
    out = final.join(q, "question_id", "left").withColumn("_at", F.coalesce(F.array_position("ids", F.col("record_id")), F.lit(0)))
    if prune:
        out = out.where(F.col("ids").isNull() | (F.col("_at") > 0))
    order = W.partitionBy("question_id").orderBy(F.col("_at") == 0, "_at", "final_rank")
    return out.withColumn("final_rank", F.row_number().over(order)).drop("ids", "_at")


def citation(source="file_name", label="page_label") -> Column:
    return F.concat_ws(" - ", F.coalesce(source, F.lit("Document")), F.coalesce(label, F.lit("Document")))


def extractive_answers(questions: DataFrame, final: DataFrame, grades: DataFrame, size: int = 220) -> DataFrame:
    """The beginnings of the two best pieces of evidence; unsupported questions get none and abstain."""
    best = final.where("final_rank <= 2").groupBy("question_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", F.left(squash("text"), F.lit(size)).alias("t")))), lambda x: x["t"]), " ").alias("answer"),
        F.array_sort(F.collect_list("record_id")).alias("evidence"),
    )
    supported = F.col("evidence_status") != "unsupported"
    rows = questions.join(grades, "question_id").join(best, "question_id", "left")
    return rows.select("question_id", "question", F.when(supported, F.col("answer")).alias("answer"), F.when(supported, F.col("evidence")).alias("evidence"), supported.alias("supported"), "evidence_status")


def is_inferential(answer) -> Column:
    """Does an answer hedge, so that its support counts as weak?"""
    return contains_any(F.lower(answer), C.INFERENTIAL_MARKERS)


def citations(final: DataFrame) -> DataFrame:
    """question_id, citations (labels) and details ([i] label), each detail once, in the order of the evidence."""
    label = F.coalesce(F.nullif(F.col("citation"), F.lit("")), "page_label", F.lit("Document")) if "citation" in final.columns else F.coalesce("page_label", F.lit("Document"))
    rows = with_context(final).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", label.alias("label")))), lambda x: x["label"]).alias("citations"))
    return rows.withColumn("details", F.array_distinct(F.transform("citations", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x))))


def is_true(reply: str, path: str) -> Column:
    """Whether a value of a JSON text counts as true: anything but false, zero, null and what is empty. Null where there is no JSON or no value."""
    value = F.try_variant_get(F.try_parse_json(reply), path, "variant")
    text, kind = F.try_variant_get(value, "$", "string"), F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None)
        .when(kind == "VOID", False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.rlike("^(ARRAY|OBJECT)"), ~text.isin("[]", "{}"))
        .otherwise(F.coalesce(text.try_cast("double") != 0.0, F.lit(True)))
    )


def model_answers(told: DataFrame, replies: DataFrame, cited: DataFrame) -> DataFrame:
    """What a model replied takes the place of extracted answers where the evidence isn't unsupported.

    replies: question_id, reply (JSON with supported, answer, reason). A reply that is
    no JSON supports nothing; one that hedges is downgraded; a supported one ends in its references.
    """
    body = F.from_json("reply", "supported string, answer string, reason string").withField("supported", is_true("reply", "$.supported"))
    rows = told.join(replies.select("question_id", "reply", body.alias("_m")), "question_id", "left").join(cited.select("question_id", "details"), "question_id", "left")
    valid = F.col("_m.supported").isNotNull() | F.col("_m.answer").isNotNull() | F.col("_m.reason").isNotNull()
    text = F.coalesce(F.nullif(F.trim("_m.answer"), F.lit("")), F.lit(UNSUPPORTED))
    hedged = F.coalesce(F.col("_m.supported"), F.lit(False)) & is_inferential(text)
    good = F.coalesce(F.col("_m.supported"), F.lit(False)) & ~hedged
    reason = F.when(~valid, "The reply was no valid structured output.").otherwise(F.nullif(F.trim("_m.reason"), F.lit("")))
    note = F.when(hedged, F.concat_ws(" ", reason, F.lit("The answer infers, so it counts as unsupported."))).otherwise(F.coalesce(reason, F.when(F.col("evidence_status") == "weak", "The evidence is weak.")))
    full = F.when(good & (F.size("details") > 0), F.concat(text, F.lit("\n\nReferences:\n"), F.array_join(F.transform("details", lambda d: F.concat(F.lit("- "), d)), "\n"))).otherwise(text)
    use = F.col("reply").isNotNull() & (F.col("evidence_status") != "unsupported")
    new = {"answer": F.when(use, full).otherwise(F.col("answer")), "supported": F.when(use, good).otherwise(F.col("supported"))}
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in told.columns], F.when(use, note).alias("note"))


def cached(questions: DataFrame, cache: DataFrame, *versions) -> tuple[DataFrame, DataFrame]:
    """Questions that the cache answers, and the others. Keys are of the fingerprint, the question and the versions."""
    keyed = questions.withColumn("cache_key", cache_key("fingerprint", "question", *[F.lit(v) for v in versions]))
    return keyed.join(cache, "cache_key"), keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def without_fingerprints(cache: DataFrame, gone: DataFrame) -> DataFrame:
    """A cache (cache_key, fingerprint, ...) without the answers on documents whose index is gone (fingerprint)."""
    return cache.join(gone.select("fingerprint").distinct(), "fingerprint", "left_anti")


def nearest_cached(distances: DataFrame, within: float = 0.2) -> DataFrame:
    """distances: question_id, cached_id, distance. The nearest cached question, if it is near enough."""
    nearest = distances.groupBy("question_id").agg(F.min(F.struct("distance", "cached_id")).alias("m"))
    return nearest.select("question_id", F.col("m.cached_id").alias("cached_id"), F.col("m.distance").alias("distance"), (F.col("m.distance") <= within).alias("hit"))


def traced() -> Column:
    """What a trace shows of a candidate, never its whole text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.struct(
        F.col("final_rank").alias("rank"), F.col("record_id").alias("chunk_id"), F.coalesce("page_label", F.lit("Document")).alias("page_label"), text("section_id").alias("section_id"), text("section_heading").alias("section_heading"),
        text("chapter_number").alias("chapter_number"), text("chapter_title").alias("chapter_title"), text("section_role").alias("section_role"), F.col("dense").alias("dense_score"), F.col("lexical").alias("lexical_score"),
        F.col("score").alias("fused_score"), F.col("rerank_score"), preview("text").alias("preview"),
    )


def run_traces(answers: DataFrame, final: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """A trace of each question: its candidates' names, scores and previews, never whole texts; it expires."""
    rows = with_context(final)
    rows = rows if "rerank_score" in rows.columns else rows.withColumn("rerank_score", F.lit(None).cast("double"))
    shown = rows.groupBy("question_id").agg(F.to_json(F.array_sort(F.collect_list(traced()))).alias("candidates"))
    rows = answers.join(shown, "question_id", "left")
    key = F.left(F.sha2(F.concat_ws("|", F.col("question_id").cast("string"), now.cast("string")), 256), F.lit(16))
    return rows.select(key.alias("trace_id"), "question_id", "question", "supported", "evidence_status", "candidates", now.alias("created_at"), (now + F.make_interval(hours=F.lit(hours))).alias("expires_at"))


def answer_all(questions: DataFrame, search_once, recover, now: Column, cache: DataFrame | None = None, versions: tuple[str, ...] = (), select=None, replies: DataFrame | None = None) -> dict[str, DataFrame]:
    """Answers of all questions, from the cache where it has them: answers, traces and cache (the new entries).

    questions: question_id, document_id, fingerprint, question. search_once(questions)
    gives final candidates and grades; recover(questions, final, grades) those of the
    unsupported ones that deserve one more search; select(final) looks again at the
    order. replies are a model's (see model_answers); without, answers are extracted.
    """
    hits, open_ = (None, questions.withColumn("cache_key", cache_key("fingerprint", "question", *[F.lit(v) for v in versions]))) if cache is None else cached(questions, cache, *versions)
    open_ = written(open_, "open")
    look = select or (lambda rows: rows)
    final, grades = search_once(open_)
    final, grades = written(look(final), "first"), written(grades, "first-grades")
    told = extractive_answers(open_, final, grades)
    told = written(told if replies is None else model_answers(told, replies, citations(final)), "told")
    # Whoever got no answer gets one wider search, and with it another answer if it found anything.
    silent = told.where("NOT supported").select("question_id")
    again, regraded = recover(open_.join(silent, "question_id", "left_semi"), final, grades)
    again, regraded = written(look(again), "again"), written(regraded, "again-grades")
    found = again.select("question_id").distinct()
    retold = extractive_answers(open_.join(found, "question_id", "left_semi"), again, regraded)
    retold = retold if replies is None else model_answers(retold, replies, citations(again))
    rest = lambda rows: rows.join(found, "question_id", "left_anti")
    told = written(rest(told).unionByName(retold).join(open_.select("question_id", "cache_key"), "question_id"), "answers")
    shown = rest(final).unionByName(again, allowMissingColumns=True)
    fresh = told.withColumn("cache_hit", F.lit(False))
    old = fresh.limit(0) if hits is None else hits.withColumn("cache_hit", F.lit(True))
    return {"answers": fresh.unionByName(old.select(*[c for c in fresh.columns if c in old.columns]), allowMissingColumns=True), "traces": run_traces(told, shown, now), "cache": told.drop("question_id", "question")}
