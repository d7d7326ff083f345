"""Retrieval for all questions at once: dense and lexical ranking, fusion, scoring, grading, recovery.

Stages that others read more than once are written as tables in the shared
folder, so that plans stay small.

Questions are rows: question_id, document_id, question. A question searches the
chunks of its document; with document_id left out of both tables it searches
all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import constants as C
from ..functions.questions import fact_signal, has_term, may_recover, profile
from ..sources.tables import bucketed, written
from ..functions.text import clamp, content_overlap, contains_any, keyword_overlap, search_tokens, significant_terms
from .vector_index import VectorIndex, build_index, search_index

#: Terms whose frequencies go to every task, whatever the number of terms; those of the others are joined.
COMMON = 1 << 16


def top(rows: DataFrame, by: str, k: int, *order) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def dense_search(queries: DataFrame, vectors: DataFrame | VectorIndex, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """queries: question_id, query_vector; vectors: vec_id, embedding (and `by`), or an index of them. The k nearest in squared distance."""
    index = vectors if isinstance(vectors, VectorIndex) else build_index(vectors, by=by)
    return search_index(index, queries, k)


def term_counts(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    terms = rows.select(*keys, F.explode(search_tokens(text)).alias("term")).where(~F.col("term").isin(*C.STOP_WORDS))
    return terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def lexical_search(questions: DataFrame, records: DataFrame, k: int, scope: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """records: record_id, text and the scope. TF-IDF cosine of each question with the records of its scope.

    Weights are fitted for each question on its records and the question itself:
    idf = ln((1 + n) / (1 + df)) + 1, where n and df count the question, too.
    Scores that agree to 12 digits count as equal, and the smaller record wins.
    Only terms of questions move: a record's norm needs all its terms, but with
    plain document frequencies, which are the scope's and not the question's;
    the question adds one to n, and to df of its own terms.
    """
    keys = [*scope, "record_id"]
    asking = list(dict.fromkeys(["question_id", *scope]))
    scope = list(scope)
    # A text moves once, to its record's task, where its terms are counted; they stay dealt by
    # record, so that norms and hits are summed where they are.
    buckets = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = records.select(*keys, "text").repartition(buckets, *keys)
    counts = bucketed(term_counts(texts, keys, "text"), "terms", *keys)
    n = records.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")) if scope else records.agg(F.count(F.lit(1)).alias("n"))
    n = written(n, "sizes")
    sized = lambda rows: rows.join(n, scope) if scope else rows.crossJoin(F.broadcast(n))
    # Squares of idf as a question sees a term that it has itself (1) or doesn't have (0), once for each term.
    square = lambda own: F.pow(F.log((2.0 + F.col("n")) / (1.0 + F.col("df") + own)) + 1.0, F.lit(2))
    frequencies = counts.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    frequencies = written(sized(frequencies).select(*scope, "term", "df", square(0).alias("idf2")), "frequencies")
    # The questions' terms with what their scope says of them, and each question's own norm.
    asked = term_counts(questions, asking, "question").withColumnRenamed("tf", "qtf")
    asked = sized(asked.join(frequencies.drop("idf2"), [*scope, "term"], "left").withColumn("df", F.coalesce("df", F.lit(0))))
    asked = asked.select(*asking, "term", "qtf", square(1).alias("idf2"), (square(1) - square(0)).alias("more"))
    asked = written(asked.withColumn("q2", F.sum(F.col("qtf") * F.col("qtf") * F.col("idf2")).over(W.partitionBy("question_id"))), "asked")
    tf2 = F.col("tf") * F.col("tf")
    hits = counts.join(asked, [*scope, "term"])
    dots = hits.groupBy(*asking, "record_id").agg(F.sum(F.col("tf") * F.col("qtf") * F.col("idf2")).alias("dot"), F.sum(tf2 * F.col("more")).alias("extra"), F.first("q2").alias("q2"))
    # Most of the text is common terms, whose weights go to the records; only the rest of the terms go to theirs.
    common = F.broadcast(frequencies.orderBy(F.desc("df"), *scope, "term").limit(COMMON).drop("df"))
    length = lambda rows, name: rows.groupBy(*keys).agg(F.sum(tf2 * F.col("idf2")).alias(name))
    near = length(counts.join(common, [*scope, "term"]), "near")
    far = length(counts.join(common, [*scope, "term"], "left_anti").join(frequencies, [*scope, "term"]), "far")
    scored = dots.join(near.hint("shuffle_hash"), keys, "left").join(far.hint("shuffle_hash"), keys, "left").where("near IS NOT NULL OR far IS NOT NULL")
    norm2 = F.coalesce("near", F.lit(0.0)) + F.coalesce("far", F.lit(0.0))
    scored = scored.withColumn("lexical", F.col("dot") / F.sqrt((norm2 + F.col("extra")) * F.col("q2"))).where("lexical > 0")
    found = top(scored.select("question_id", "record_id", "lexical"), "question_id", k, F.desc(F.round("lexical", 12)), "record_id")
    # Few rows: what joins them to texts sees that, and doesn't move the texts.
    return written(found.select("question_id", "record_id", "lexical", "rank"), "found")


def relaxing_filter(rows: DataFrame, tests: list[tuple[Column, Column]], strict: Column, by: str = "question_id") -> DataFrame:
    """Each (wanted, test) in turn keeps the rows that pass, unless none would be left and the question isn't strict."""
    for wanted, test in tests:
        found = F.max((wanted & test).cast("int")).over(W.partitionBy(by))
        rows = rows.withColumn("_keep", ~wanted | test | ((found == 0) & ~strict)).where("_keep").drop("_keep")
    return rows


def fuse(ranked: DataFrame, k: int = C.FUSED_TOP_K) -> DataFrame:
    """ranked: question_id, record_id, system, rank, score. Reciprocal ranks summed; the systems' scores as columns."""
    of = lambda name: F.coalesce(F.max(F.when(F.col("system") == name, F.col("score"))), F.lit(0.0)).alias(name)
    fused = ranked.groupBy("question_id", "record_id").agg(F.sum(1.0 / (C.RRF_K + F.col("rank"))).alias("fused"), of("dense"), of("lexical"))
    return top(fused, "question_id", k, F.desc(F.round("fused", 12)), "record_id")


def only_allowed(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Hits outside the scope go after the search: a scope can end with fewer than k."""
    return hits.join(allowed, ["question_id", "record_id"], "left_semi")


def promote_continuations(fused: DataFrame, chunks: DataFrame, first: int = 6) -> DataFrame:
    """A heading among the first brings in the chunk that continues it, a little below itself, unless it is there already."""
    stubs = fused.where(F.col("rank") <= first).join(chunks.where("heading_only").select(F.col("chunk_id").alias("record_id"), "continuation_id"), "record_id")
    stubs = stubs.where("continuation_id IS NOT NULL")
    score = F.greatest(F.col("fused") * 0.96, F.col("fused") - 0.005) + 0.03
    more = stubs.select("question_id", F.col("continuation_id").alias("record_id"), score.alias("fused")).groupBy("question_id", "record_id").agg(F.max("fused").alias("fused"))
    fits = chunks.where(~F.col("chunk_role").isin("navigation_like", "reference_like")).select(F.col("chunk_id").alias("record_id"))
    more = more.join(fused.select("question_id", "record_id"), ["question_id", "record_id"], "left_anti").join(fits, "record_id", "left_semi")
    return fused.select("question_id", "record_id", "fused", "dense", "lexical").unionByName(more.withColumn("dense", F.lit(0.0)).withColumn("lexical", F.lit(0.0)))


def pick(test: Column, yes: float, no: float = 0.0) -> Column:
    return F.when(test, yes).otherwise(no)


def evidence_adjustment(p: Column, recovery: Column) -> Column:
    """What a chunk's role, artifact, front matter and a model's opinion add to its score."""
    kind, role, artifact = p["query_type"], F.coalesce("chunk_role", F.lit("")), F.coalesce("artifact_type", F.lit(""))
    numeric = kind == "numeric_lookup"
    body = F.coalesce(F.nullif(F.col("body_score"), F.lit(0.0)), F.lit(0.5))
    aimed = F.array_contains(p["content_types"], artifact)
    shown = (
        F.when(artifact == "table", pick(aimed | kind.isin("numeric_lookup", "comparison_lookup"), 0.18, -0.16))
        .when(artifact.isin("front_matter", "footnote"), F.when(recovery, 0.20).otherwise(pick(aimed, 0.16, -0.14)))
        .when(artifact == "bibliography", pick(aimed, 0.14, -0.28))
        .otherwise(0.0)
    )
    form = (
        F.when(role == "navigation_like", -0.18)
        .when(role == "reference_like", -0.14)
        .when(role == "table_fragment", pick(numeric, -0.02, -0.08))
        .when(F.coalesce("heading_only", F.lit(False)), -0.10)
        .otherwise(0.0)
    )
    sure = F.coalesce("semantic_confidence", F.lit(0.0))
    opinion = F.coalesce(F.nullif(F.col("semantic_body_score"), F.lit(0.0)), body)
    by_role = (
        F.when(F.col("semantic_role") == "body_evidence", F.lit(0.06))
        .when(F.col("semantic_role") == "summary_evidence", pick(kind == "summary_lookup", 0.08, 0.04))
        .when(F.col("semantic_role") == "heading_stub", F.lit(-0.08))
        .when(F.col("semantic_role") == "navigation_noise", F.lit(-0.12))
        .when(F.col("semantic_role") == "reference_noise", F.lit(-0.1))
        .when(F.col("semantic_role") == "table_fragment", pick(numeric, -0.02, -0.05))
        .otherwise(F.lit(0.0))
    )
    matter, weight = F.coalesce("front_matter_kind", F.lit("")), F.coalesce("front_matter_score", F.lit(0.0))
    listed = F.greatest(weight, F.lit(0.65))
    front = (
        F.when(matter.isin("contents", "list_of_figures", "list_of_tables"), F.when(recovery, -0.08 * listed).otherwise(-0.18 * listed))
        .when(matter.isin(*C.LOW_VALUE_FRONT_MATTER), F.when(recovery, 0.12 * listed).otherwise(-0.18 * listed))
        .when(matter == "title_page", F.when(recovery, 0.08).otherwise(-0.05) * F.greatest(weight, F.lit(0.5)))
        .otherwise(0.0)
    )
    return 0.06 * clamp(body) + shown + form - pick(F.coalesce("low_value_prior", F.lit(0.0)) >= 0.7, 0.06) + F.when(sure > 0, sure * (0.08 * (clamp(opinion) - 0.5) + by_role)).otherwise(0.0) + front


def summary_adjustment(question, p: Column) -> Column:
    terms, kind = significant_terms(question), F.lower(F.coalesce("section_kind", F.lit("")))
    head = F.lower(F.left("text", F.lit(400)))
    value = (
        -pick(kind.isin("references", "appendix"), 0.20)
        + pick(has_term(terms, C.EARLY_SUMMARY_TERMS) & kind.isin("overview", "abstract", "introduction", "background"), 0.16)
        + pick(has_term(terms, C.FINDINGS_SUMMARY_TERMS) & kind.isin("results", "discussion"), 0.14)
        + pick(has_term(terms, C.LATE_SUMMARY_TERMS) & kind.isin("discussion", "conclusion", "conclusions", "future work", "future directions", "limitations"), 0.14)
        - pick(contains_any(head, ("author contributions", "supplementary information")), 0.15)
        - pick(F.coalesce("heading_only", F.lit(False)), 0.06)
        - pick(F.col("chunk_role") == "navigation_like", 0.08)
    )
    return F.when(p["query_type"] == "summary_lookup", value).otherwise(0.0)


#: What a chunk may have; missing columns count as null.
CHUNK_COLUMNS = {
    "section_heading": "string", "section_path": "array<string>", "section_id": "string", "section_kind": "string", "content_type": "string", "clause_ids": "array<string>",
    "chunk_role": "string", "body_score": "double", "low_value_prior": "double", "heading_only": "boolean", "front_matter_kind": "string", "front_matter_score": "double",
    "artifact_type": "string", "semantic_role": "string", "semantic_confidence": "double", "semantic_body_score": "double", "continuation_id": "string", "region_kind": "string",
}


def completed(chunks: DataFrame) -> DataFrame:
    return chunks.select("*", *[F.lit(None).cast(t).alias(c) for c, t in CHUNK_COLUMNS.items() if c not in chunks.columns])


def score_chunks(questions: DataFrame, fused: DataFrame, chunks: DataFrame, scope: DataFrame | None = None, recovery: bool = False) -> DataFrame:
    """Candidates with their final score.

    fused: question_id, record_id, fused, dense, lexical. scope (optional):
    question_id, section_ids, region_kinds, clause_terms.
    """
    # Below the join, so that a question is analysed once and not for each candidate.
    analysed = questions.select("question_id", "question", profile("question").alias("_p"))
    # Candidates meet the chunks first: they are few, so that no text moves.
    rows = fused.join(completed(chunks).withColumnRenamed("chunk_id", "record_id"), "record_id").join(analysed, "question_id")
    if scope is not None:
        rows = rows.join(scope, "question_id", "left")
    none = F.expr("CAST(array() AS array<string>)")
    given = lambda c: F.coalesce(c, none) if scope is not None and c in scope.columns else none
    p, text = F.col("_p"), lambda c: F.coalesce(c, F.lit(""))
    score = (
        F.col("fused")
        + 0.15 * keyword_overlap("question", "text")
        + 0.15 * keyword_overlap("question", text("section_heading"))
        + 0.08 * keyword_overlap("question", F.array_join(F.coalesce("section_path", none), " "))
        + pick(F.coalesce(F.array_contains(p["content_types"], F.col("content_type")), F.lit(False)), 0.14)
        + pick(F.arrays_overlap(F.coalesce("clause_ids", none), given("clause_terms")), 0.18)
        + pick(F.coalesce(F.array_contains(given("section_ids"), F.col("section_id")), F.lit(False)), 0.14)
        + pick(F.coalesce(F.array_contains(given("region_kinds"), F.col("region_kind")), F.lit(False)), 0.08)
        + evidence_adjustment(p, F.lit(recovery))
        + summary_adjustment("question", p)
    )
    rows = rows.withColumn("score", score)
    if recovery:
        rows = rows.withColumn("score", F.col("score") + fact_signal("question", "text", F.col("_p.query_type")))
    return rows.withColumn("query_type", F.col("_p.query_type")).drop("_p")


def finalize(candidates: DataFrame, k: int = C.FINAL_TOP_K) -> DataFrame:
    """The k candidates to show: a heading gives its place to the chunk that continues it if that is a candidate, and comes last if not."""
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "record_id")
    ranked = candidates.withColumn("_rank", F.row_number().over(order))
    there = ranked.where(~F.coalesce("heading_only", F.lit(False))).select("question_id", F.col("record_id").alias("continuation_id"), F.lit(True).alias("_there"))
    ranked = ranked.join(there, ["question_id", "continuation_id"], "left").withColumn("_stub", F.coalesce("heading_only", F.lit(False)))
    # A body chunk takes the best place that it or a heading before it has.
    gives = ranked.where(F.col("_stub") & F.coalesce("_there", F.lit(False))).groupBy("question_id", F.col("continuation_id").alias("record_id")).agg(F.min("_rank").alias("_given"))
    kept = ranked.where(~(F.col("_stub") & F.coalesce("_there", F.lit(False)))).join(gives, ["question_id", "record_id"], "left")
    place = F.least("_rank", F.coalesce("_given", "_rank"))
    kept = kept.withColumn("final_rank", F.row_number().over(W.partitionBy("question_id").orderBy(F.col("_stub"), place)))
    return kept.where(F.col("final_rank") <= k).drop("_rank", "_there", "_stub", "_given")


def grade(questions: DataFrame, final: DataFrame) -> DataFrame:
    """question_id, evidence_status, best_score, max_lexical, overlap: of every question, also those without candidates."""
    rows = final.groupBy("question_id").agg(
        F.min_by("score", "final_rank").alias("best_score"),
        F.max("lexical").alias("max_lexical"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("final_rank", "text", "section_heading"))), lambda x: x["final_rank"] <= 3), lambda x: F.concat_ws(" ", x["text"], x["section_heading"])), " ").alias("_text"),
        F.bool_or(F.lower(F.coalesce("section_kind", F.lit(""))).isin(*C.SUMMARY_SUPPORT_KINDS) & (F.col("final_rank") <= 4)).alias("_support"),
    )
    rows = questions.select("question_id", "question", profile("question").alias("_p")).join(rows, "question_id", "left")
    best, lexical = F.coalesce("best_score", F.lit(0.0)), F.coalesce("max_lexical", F.lit(0.0))
    overlap = F.when(F.col("_text").isNull(), 0.0).otherwise(content_overlap("question", F.coalesce("_text", F.lit(""))))
    status = (
        F.when(F.col("best_score").isNull() | ((best < C.UNSUPPORTED_SCORE) & (lexical < C.UNSUPPORTED_LEXICAL)), "unsupported")
        .when((best < C.WEAK_SCORE) & (overlap <= C.UNSUPPORTED_OVERLAP), F.when((F.col("_p.query_type") == "summary_lookup") & F.coalesce("_support", F.lit(False)), "weak").otherwise("unsupported"))
        .when((best < C.WEAK_SCORE) | (lexical < C.LEXICAL_HIT), "weak")
        .otherwise("strong")
    )
    return rows.select("question_id", status.alias("evidence_status"), best.alias("best_score"), lexical.alias("max_lexical"), overlap.alias("overlap"))


def best_by_id(candidates: DataFrame) -> DataFrame:
    """Of candidates that several routes bring in, the one with the highest score."""
    order = W.partitionBy("question_id", "record_id").orderBy(F.desc("score"))
    return candidates.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def retrieve(questions: DataFrame, chunks: DataFrame, dense: DataFrame | None = None, k: int = C.FUSED_TOP_K) -> tuple[DataFrame, DataFrame]:
    """The final candidates of each question, and its grade. dense: question_id, record_id, rank, score."""
    lexical = lexical_search(questions, chunks.select("document_id", F.col("chunk_id").alias("record_id"), "text"), k)
    ranked = lexical.select("question_id", "record_id", F.lit("lexical").alias("system"), "rank", F.col("lexical").alias("score"))
    if dense is not None:
        ranked = ranked.unionByName(dense.select("question_id", "record_id", F.lit("dense").alias("system"), "rank", "score"))
    fused = written(promote_continuations(written(fuse(ranked, k), "fused"), completed(chunks)), "promoted")
    final = written(finalize(written(score_chunks(questions, fused, chunks.drop("document_id")), "scored")), "final")
    return final, grade(questions, final)


def neighbours(seeds: DataFrame, chunks: DataFrame, forward: int = 8, most_seeds: int = 6, most: int = 10) -> DataFrame:
    """Chunks that follow the first seeds in their document; the first seed wins, and each question gets `most` at most.

    seeds: question_id, record_id, rank, score. Chunks are numbered in the order
    of chunk_index, which may have gaps. The range join is an equi-join on
    document and number, one row for each of the next places.
    """
    order = W.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    at = chunks.select(F.col("chunk_id").alias("record_id"), "document_id", F.row_number().over(order).alias("place"))
    ahead = seeds.where(F.col("rank") <= most_seeds).join(at, "record_id").withColumn("place", F.explode(F.sequence(F.col("place") + 1, F.col("place") + forward)))
    found = ahead.select("question_id", "rank", "document_id", "place", F.greatest(F.col("score") * 0.90, F.col("score") - 0.02).alias("base")).join(at, ["document_id", "place"])
    first = found.withColumn("_r", F.row_number().over(W.partitionBy("question_id", "record_id").orderBy("rank", "place"))).where("_r = 1")
    return top(first.drop("_r").withColumnRenamed("rank", "seed_rank"), "question_id", most, "seed_rank", "place").select("question_id", "record_id", "base", "rank")


def recover(questions: DataFrame, chunks: DataFrame, final: DataFrame, grades: DataFrame, k: int = C.FINAL_TOP_K) -> tuple[DataFrame, DataFrame]:
    """One wider search for unsupported questions whose kind allows it: artifacts and front matter, and what follows the best finds."""
    open_ = written(questions.join(grades.where("evidence_status = 'unsupported'"), "question_id", "left_semi").where(may_recover(profile("question"))), "open")
    full = completed(chunks)
    text = F.lower(F.concat_ws("\n", F.left("text", F.lit(1200)), "section_heading", "section_kind", "front_matter_kind", "artifact_type", F.array_join("section_path", " ")))
    texts = full.select("document_id", F.col("chunk_id").alias("record_id"), text.alias("text"), "artifact_type", "front_matter_kind")
    lexical = lexical_search(open_, texts.select("document_id", "record_id", "text"), max(3 * C.FUSED_TOP_K, k + 20))
    special = F.col("artifact_type").isin("front_matter", "footnote") | ~F.coalesce("front_matter_kind", F.lit("body")).isin("", "body") | contains_any("text", C.RECOVERY_ARTIFACT_TERMS)
    named = open_.join(texts.where(special), "document_id").where(keyword_overlap("question", "text") > 0).select("question_id", "record_id", F.lit(0.0).alias("lexical"))
    pool = lexical.select("question_id", "record_id", "lexical").unionByName(named).groupBy("question_id", "record_id").agg(F.max("lexical").alias("lexical"))
    pool = written(pool.withColumn("fused", F.greatest(F.lit(0.10), "lexical")).withColumn("dense", F.lit(0.0)), "pool")
    bare = chunks.drop("document_id")
    found = written(top(score_chunks(open_, pool, bare, recovery=True), "question_id", max(k + 12, 16), F.desc("score"), "record_id"), "found")
    seeds = final.select("question_id", "record_id", "score", F.col("final_rank").alias("rank")).join(open_, "question_id", "left_semi").unionByName(found.select("question_id", "record_id", "score", (F.col("rank") + k).alias("rank")))
    near = neighbours(seeds, chunks).select("question_id", "record_id", F.lit(0.0).alias("lexical"), F.col("base").alias("fused"), F.lit(0.0).alias("dense"))
    more = written(score_chunks(open_, written(near, "near"), bare, recovery=True), "more")
    shared_columns = [c for c in final.columns if c in more.columns and c in found.columns and c != "rank"]
    old = final.join(open_, "question_id", "left_semi").select(*shared_columns)
    again = written(finalize(best_by_id(old.unionByName(found.select(*shared_columns)).unionByName(more.select(*shared_columns))), k), "recovered")
    return again, grade(open_, again)
