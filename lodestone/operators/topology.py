"""Sections to synopses and edges, and the regions a question should look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import constants as C
from ..functions import rules as R
from ..functions.text import col, contains_any, distinct_by_case, first_distinct, key_tokens, keyword_overlap, let, page_number, question_terms, sentences, shared
from .similar_sets import most_similar


def key_terms(rows: DataFrame, key: list[str], text: Column, top: int = 8) -> DataFrame:
    """key columns, key_terms: the most frequent terms, earlier ones first among equals."""
    # A text moves once, to its key's task, where its terms are counted and ranked; they don't move.
    texts = rows.select(*key, text.alias("_text")).repartition(*key)
    placed = texts.select(*key, F.posexplode(key_tokens("_text")).alias("pos", "term"))
    counted = placed.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("n"), "pos"))).where(F.col("rank") <= top)
    return ranked.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("key_terms"))


def representative_sentences(summary, text, title, kind) -> Column:
    own = lambda t: F.concat(F.slice(t, 1, 4), F.slice(t, F.greatest(F.size(t) - 1, F.lit(1)), 2))
    pool = F.concat(sentences(summary), let(sentences(text), own))
    unique = distinct_by_case(F.filter(pool, lambda s: F.length(s) >= 24))

    def chosen(u):
        return (
            F.when(F.size(u) == 0, F.array(col(title)))
            .when(col(kind) == "overview", F.slice(u, 1, 3))
            .when(col(kind).isin("discussion", "evidence") & (F.size(u) >= 3), F.array(F.get(u, F.lit(0)), F.element_at(u, -1)))
            .otherwise(F.slice(u, 1, 2))
        )

    return let(unique, chosen)


#: What synopses keep of their sections, if these have it.
KEPT = ("aliases", "scope_labels", "section_role", "chapter_number", "chapter_title", "content_type")


def build_synopses(sections: DataFrame) -> DataFrame:
    """sections as build_sections and profile_sections make them. One synopsis each."""
    key = ["document_id", "section_id"]
    join = lambda c: F.array_join(c, " ")
    about = F.concat_ws(" ", "title", join("section_path"), "summary", join("aliases"), join("scope_labels"), "section_role", "chapter_title")
    terms = key_terms(sections, key, about)
    heading = F.concat_ws(" ", "title", join("section_path"), "section_kind", "content_type", "section_role", "chapter_title")
    rows = sections.join(terms, key, "left").withColumn("key_terms", F.coalesce("key_terms", F.expr("CAST(array() AS array<string>)")))
    rows = rows.withColumn("region_kind", R.region_kind(heading, "text"))
    path = F.array_join("section_path", " > ")
    synopsis = F.concat_ws(
        "\n",
        "title",
        F.when((path != "") & (path != F.col("title")), path),
        F.nullif(F.array_join(F.slice("aliases", 1, 4), " | "), F.lit("")),
        F.when(F.size("key_terms") > 0, F.concat(F.lit("Key terms: "), F.array_join(F.slice("key_terms", 1, 6), ", "))),
        F.array_join(representative_sentences("summary", "text", "title", "region_kind"), " "),
    )
    low = F.col("low_value") | R.is_low_value_text(F.concat_ws(" ", "title", "summary", F.left("text", F.lit(400))))
    return rows.select(*key, "ordinal", "title", F.trim(synopsis).alias("synopsis"), "region_kind", "page_labels", "key_terms", "section_path", "section_kind", "front_matter_kind", "front_matter_score", low.alias("low_value"), *[c for c in KEPT if c in rows.columns])


def build_edges(synopses: DataFrame, least: float = 0.2, top: int = 2) -> DataFrame:
    """document_id, source, target, edge_type, weight: the next section, the parent, the next two of a region kind, the most similar."""
    doc = W.partitionBy("document_id").orderBy("ordinal")
    edge = lambda rows, kind, weight: rows.select("document_id", "source", "target", F.lit(kind).alias("edge_type"), weight.alias("weight"))
    after = synopses.select("document_id", F.col("section_id").alias("source"), F.lead("section_id").over(doc).alias("target")).where("target IS NOT NULL")
    depth = F.size("section_path")
    children = synopses.where(depth > 1).select("document_id", F.col("section_id").alias("target"), F.slice("section_path", F.lit(1), F.greatest(depth - 1, F.lit(0))).alias("p"))
    parents = synopses.select("document_id", "section_id", "ordinal", F.col("section_path").alias("p"))
    up = children.join(parents, ["document_id", "p"]).where("section_id != target").groupBy("document_id", "target").agg(F.min_by("section_id", "ordinal").alias("source"))
    family = W.partitionBy("document_id", "region_kind").orderBy("ordinal")
    kin = synopses.select("document_id", F.col("section_id").alias("source"), F.lead("section_id", 1).over(family).alias("_a"), F.lead("section_id", 2).over(family).alias("_b"))
    kin = kin.select("document_id", "source", F.explode(F.array("_a", "_b")).alias("target")).where("target IS NOT NULL")
    return (
        edge(after, "previous_next", F.lit(1.0))
        .unionByName(edge(up, "parent_child", F.lit(1.0)))
        .unionByName(edge(kin, "same_region_family", F.lit(0.75)))
        .unionByName(edge(most_similar(synopses, ["document_id"], "section_id", "key_terms", least, top), "semantic_neighbor", F.col("similarity")))
    )


def expand_scope(seeds: DataFrame, edges: DataFrame, edge_types: tuple[str, ...] = (), top: int = 2) -> DataFrame:
    """Neighbours of seed sections over one edge, the heaviest first. seeds: document_id, source and what else should stay."""
    own = edges.where(F.col("edge_type").isin(*edge_types)) if edge_types else edges
    order = W.partitionBy("document_id", "source").orderBy(F.desc("weight"), "target")
    ranked = own.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")
    return seeds.join(ranked, ["document_id", "source"])


def region_score(question, synopses_title, synopsis, kind, kinds, first_page, last_page, low_value, matter_kind, matter_score, path, explicit) -> Column:
    """How well a region fits a question before any search."""
    q = F.array_distinct(key_tokens(question))
    title, text = F.lower(col(synopses_title)), F.lower(col(synopsis))
    early = F.arrays_overlap(q, F.array(*[F.lit(x) for x in C.EARLY_REGION_TERMS]))
    late = F.arrays_overlap(q, F.array(*[F.lit(x) for x in C.LATE_REGION_TERMS]))
    kind, at = col(kind), F.when(col(last_page) > 0, col(first_page) / col(last_page))
    low_terms = F.transform(F.filter(col(explicit), lambda t: F.trim(t) != ""), F.lower)
    named = F.exists(low_terms, lambda t: F.contains(title, t) | F.contains(text, t) | F.exists(col(path), lambda p: F.contains(F.lower(p), t)))
    return (
        shared(q, key_tokens(F.concat_ws(" ", col(synopses_title), col(synopsis)))) / F.greatest(F.size(q), F.lit(1))
        + points(F.array_contains(col(kinds), kind), 0.35)
        + F.coalesce(points(early & kind.isin("overview", "general"), 0.18) * (1 - at), F.lit(0.0))
        + F.coalesce(points(late & kind.isin("discussion", "overview"), 0.18) * at, F.lit(0.0))
        - points(early & (kind == "appendix"), 0.65)
        - points(early & (kind == "evidence"), 0.12)
        + points(early & F.trim(title).isin("overview", "abstract", "document overview", "introduction"), 0.22)
        - points(col(low_value), 0.45)
        - points(~col(matter_kind).isin("", "body"), 0.25) * col(matter_score)
        + points(named, 1.2)
    )


def candidate_regions(questions: DataFrame, synopses: DataFrame, top: int = 10) -> DataFrame:
    """questions: question_id, document_id, question, kinds, explicit. Returns question_id, section_id, score, rank."""
    first = page_number(F.get("page_labels", F.lit(0)))
    rows = synopses.withColumn("_p", first).withColumn("_last", F.max("_p").over(W.partitionBy("document_id")))
    score = region_score("question", "title", "synopsis", "region_kind", "kinds", "_p", "_last", "low_value", "front_matter_kind", "front_matter_score", "section_path", "explicit")
    scored = questions.join(rows, "document_id").withColumn("score", score).where("score > 0")
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "ordinal")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("question_id", "document_id", "section_id", "score", "rank")


def rank_synopses(questions: DataFrame, synopses: DataFrame, scores: DataFrame, targets: DataFrame, top: int = 5) -> DataFrame:
    """scores: question_id, section_id, dense, lexical; targets: question_id, section_id. Whatever either names is ranked."""
    named = scores.select("question_id", "section_id", "dense", "lexical", F.lit(False).alias("_t")).unionByName(targets.select("question_id", "section_id", F.lit(0.0).alias("dense"), F.lit(0.0).alias("lexical"), F.lit(True).alias("_t")))
    named = named.groupBy("question_id", "section_id").agg(F.max("dense").alias("dense"), F.max("lexical").alias("lexical"), F.bool_or("_t").alias("_t"))
    rows = named.join(questions, "question_id").join(synopses, ["document_id", "section_id"])
    overlap = keyword_overlap("question", F.concat_ws(" ", "title", "synopsis", F.array_join("key_terms", " "), F.array_join("section_path", " ")))
    score = F.col("dense") + F.col("lexical") + 0.22 * overlap + points(F.array_contains("kinds", F.col("region_kind")), 0.22) + points(F.col("_t"), 0.35) + role_boost("question") - points(F.col("low_value"), 0.35) - points(F.col("region_kind") == "appendix", 0.25)
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "ordinal")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("question_id", "document_id", "section_id", "score", "rank")


def points(test, n: float) -> Column:
    return F.when(test, n).otherwise(0.0)


def role_boost(question) -> Column:
    """What a synopsis' title and region are worth for a question that asks about a whole document, its end or its findings."""
    terms, title = F.array_distinct(question_terms(question)), F.trim(F.lower("title"))
    asks = lambda words: F.arrays_overlap(terms, F.array(*[F.lit(w) for w in words]))
    whole, late, found = asks(C.ROLE_OVERVIEW_TERMS), asks(C.ROLE_LATE_TERMS), asks(C.ROLE_RESULT_TERMS)
    kind = F.col("region_kind")
    return (
        points(whole & title.isin(*C.OVERVIEW_TITLES), 0.34)
        + points(whole & (kind == "overview"), 0.18)
        + points(whole & F.col("section_kind").isin("abstract", "introduction", "overview"), 0.12)
        - points(whole & ~found & (kind == "evidence"), 0.18)
        + points(late & title.isin(*C.LATE_TITLES), 0.24)
        + points(late & (kind == "discussion"), 0.14)
        + points(found & title.isin(*C.RESULT_TITLES), 0.28)
        + points(found & kind.isin("evidence", "discussion"), 0.12)
    )


def policy_signal() -> Column:
    """Do a section's names speak of what a policy covers, leaves out or asks for?"""
    names = F.lower(F.concat_ws(" ", "title", F.array_join("section_path", " "), "section_kind", "content_type", "region_kind"))
    return contains_any(names, C.POLICY_SECTION_TERMS)


def synopsis_quality() -> Column:
    """Between 0 and 1: long enough, with terms, more than its title and summary, of a long section.

    Rows: synopsis, key_terms, title, summary, text, document_style, and what policy_signal() reads.
    """
    own, title, summary = F.trim("synopsis"), F.lower(F.trim("title")), F.lower(F.trim("summary"))
    value = (
        points(F.length(own) >= 160, 0.4)
        + points(F.size("key_terms") >= 4, 0.2)
        + points((title != "") & (F.lower(own) != title), 0.15)
        + points((summary != "") & ~F.contains(F.lower(own), summary), 0.1)
        + points(F.length(F.trim("text")) >= 600, 0.15)
        + points((F.col("document_style") == "policy_document") & policy_signal() & contains_any(F.lower(own), C.POLICY_SECTION_TERMS), 0.1)
    )
    return F.round(F.least(value, F.lit(1.0)), 6)


def synopsis_priority() -> Column:
    """How much a synopsis needs a rewrite. Rows also have low_value and structure_repaired."""
    policy = F.col("document_style") == "policy_document"
    wanted = F.when(policy, F.col("region_kind").isin(*C.POLICY_REGION_KINDS) | policy_signal()).otherwise(F.col("region_kind").isin(*C.TARGET_REGION_KINDS))
    value = 1.0 - synopsis_quality() + points(F.col("structure_repaired"), 0.25) + points(F.length("text") >= 1200, 0.15) + points(policy & policy_signal(), 0.15)
    return F.round(F.when(F.col("low_value") | ~wanted, 0.0).otherwise(value), 6)


def review_synopses(rows: DataFrame, top: int = 6, least: float = 0.2) -> DataFrame:
    """Per document the synopses that a model should rewrite: of the first by priority those that need it."""
    order = W.partitionBy("document_id").orderBy(F.desc("priority"), "ordinal")
    ranked = rows.withColumn("priority", synopsis_priority()).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= top) & (F.col("priority") > least))


def documents_to_review(rows: DataFrame, mode: str = "targeted", threshold: float = 0.62) -> DataFrame:
    """document_id of the documents whose synopses are worth a look at all. rows: as for synopsis_priority(),
    with structure_confidence and repair_reasons."""
    every = rows.select("document_id").distinct()
    if mode in ("off", "disabled"):
        return every.limit(0)
    if mode in ("all", "always"):
        return every
    noisy = F.arrays_overlap("repair_reasons", F.array(*[F.lit(r) for r in C.NOISY_STRUCTURE_REASONS]))
    thin = policy_signal() & (F.length("text") >= 600) & (synopsis_quality() < 0.72)
    facts = rows.groupBy("document_id").agg(
        F.first("document_style").alias("style"), F.min(F.coalesce(F.nullif("structure_confidence", F.lit(0.0)), F.lit(1.0))).alias("sure"),
        F.bool_or("structure_repaired").alias("repaired"), F.bool_or(F.coalesce(noisy, F.lit(False))).alias("noisy"), F.bool_or(thin).alias("thin"),
    )
    unsure = F.col("sure") <= threshold
    return facts.where(F.col("repaired") | (unsure & F.col("noisy")) | ((F.col("style") == "research_paper") & F.col("noisy")) | ((F.col("style") == "policy_document") & (unsure | F.col("thin")))).select("document_id")


def rewritten(synopses: DataFrame, given: DataFrame) -> DataFrame:
    """Synopses and terms that a model wrote take the place of the old ones. given: document_id, section_id, synopsis, key_terms."""
    terms = F.slice(F.filter(F.transform("key_terms", lambda t: F.trim(t)), lambda t: t != ""), 1, 8)
    good = given.where("trim(coalesce(section_id, '')) != '' AND trim(coalesce(synopsis, '')) != '' AND key_terms IS NOT NULL")
    good = good.select("document_id", F.trim("section_id").alias("section_id"), F.left(F.trim("synopsis"), F.lit(1200)).alias("_s"), terms.alias("_k"))
    out = synopses.join(good, ["document_id", "section_id"], "left").withColumn("written", F.col("_s").isNotNull())
    return out.withColumn("synopsis", F.coalesce("_s", "synopsis")).withColumn("key_terms", F.coalesce("_k", "key_terms")).drop("_s", "_k")


def scope_labels(*items) -> Column:
    return first_distinct(F.array(*[col(i) for i in items]), 24)


def joined_text(*parts) -> Column:
    """The parts that aren't blank, with an empty line between."""
    return F.trim(F.concat_ws("\n\n", *[F.nullif(col(p), F.lit("")) for p in parts]))


def section_search_text() -> Column:
    """What a section is searched by: its names, its summary, and both ends of its text."""
    tail = F.when(F.length("text") > 700, F.trim(F.right("text", F.lit(350))))
    return joined_text("title", F.array_join("section_path", " > "), F.array_join("aliases", " | "), F.array_join("scope_labels", " | "), "section_role", "chapter_title", "summary", F.trim(F.left("text", F.lit(700))), F.coalesce(tail, F.lit("")))


def synopsis_search_text() -> Column:
    """What a synopsis is searched by."""
    return joined_text("title", F.array_join("section_path", " > "), "region_kind", F.array_join(F.slice("key_terms", 1, 8), ", "), "synopsis", F.array_join("page_labels", " | "))
