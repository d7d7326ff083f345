"""Question sets and benchmark suites as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import constants as C
from ..functions.questions import starters
from ..functions.rules import best_title
from ..functions.text import clean_lines, col, contains_any, strip

# Section kinds that questions are made of first, and questions that fill up a set.
EARLY_KINDS = ("overview", "abstract", "introduction", "background")
BODY_KINDS = ("methodology", "methods", "results", "discussion", "conclusion", "future work", "future directions")
FILLERS = (
    "Which sections should I read first to understand this document quickly?",
    "What are the most important claims or takeaways in this document?",
    "What challenges, constraints, or limitations are discussed in this document?",
)


def is_noise_title(title) -> Column:
    """A title that no question is made of: lists, references, years, numbers, single words."""
    own = F.lower(strip(title))
    single = (F.size(F.split(own, r"\s+")) == 1) & ~own.isin(*C.SINGLE_WORD_TITLES)
    return (own == "") | contains_any(own, C.NOISE_TITLE_TERMS) | col(title).rlike(r"\[\d+\]|\b(?:19|20)\d{2}\b") | (F.regexp_count(col(title), F.lit(r"\p{Nd}")) >= 4) | single


def ranked_titles(sections: DataFrame, top: int = 6) -> DataFrame:
    """document_id, title, kind, rank: the sections to ask about, by kind, place and length; of equal titles the first.

    sections: document_id, ordinal (from 1), title, section_kind, page_labels.
    """
    kind = F.lower(F.trim(F.coalesce("section_kind", F.lit(""))))
    score = F.when(kind.isin(*EARLY_KINDS), 5).when(kind.isin(*BODY_KINDS), 4).otherwise(0) + F.when(F.col("ordinal") <= 6, 2).otherwise(0) + F.when(F.size("page_labels") > 1, 1).otherwise(0)
    rows = sections.select("document_id", "ordinal", strip("title").alias("title"), kind.alias("kind"), score.alias("score")).where(~is_noise_title("title")).withColumn("low", F.lower("title")).where("low != 'document overview'")
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy("document_id", "low").orderBy(F.desc("score"), "ordinal"))).where("_r = 1")
    order = W.partitionBy("document_id").orderBy(F.desc("score"), "low")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("document_id", "title", "kind", "score", "rank")


def section_question(title, kind) -> Column:
    title, kind = col(title), F.lower(col(kind))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(kind.isin(*EARLY_KINDS), say("What does the document say in the ", title, " section?"))
        .when(kind.isin("methodology", "methods"), say("How does the document describe the approach or methods in ", title, "?"))
        .when(kind == "results", say("What findings or outcomes are reported in ", title, "?"))
        .when(kind.isin("discussion", "conclusion", "conclusions"), say("What conclusions or implications are discussed in ", title, "?"))
        .when(kind.isin("future work", "future directions", "limitations"), say("What limitations or future directions are discussed in ", title, "?"))
        .otherwise(say("What does the document say about ", title, "?"))
    )


def question_sets(documents: DataFrame, sections: DataFrame, most: int = 8) -> DataFrame:
    """document_id, number, question: first questions by style, then of sections, of the first two together, and fillers; each once, whatever its case.

    documents: document_id, document_style.
    """
    ranked = ranked_titles(sections).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "kind"))).alias("s"))
    rows = documents.join(ranked, "document_id", "left").withColumn("s", F.coalesce("s", F.expr("CAST(array() AS array<struct<rank:int,title:string,kind:string>>)")))
    of_sections = F.transform("s", lambda x: section_question(x["title"], x["kind"]))
    both = F.when(F.size("s") >= 2, F.array(F.concat(F.lit("How do the sections "), F.get("s", F.lit(0))["title"], F.lit(" and "), F.get("s", F.lit(1))["title"], F.lit(" connect in the document?")))).otherwise(F.expr("CAST(array() AS array<string>)"))
    every = F.filter(F.transform(F.concat(starters("document_style"), of_sections, both, F.array(*[F.lit(f) for f in FILLERS])), lambda q: F.trim(q)), lambda q: q != "")
    seen = F.filter(every, lambda q, i: F.array_position(F.transform(every, lambda x: F.lower(x)), F.lower(q)) == i + 1)
    return rows.select("document_id", F.posexplode(F.slice(seen, 1, most)).alias("number", "question"))


def intent_of(question_type, reasoning, question) -> Column:
    """What kind of work a benchmark's question asks for."""
    kind, why, q = (F.lower(F.coalesce(col(c), F.lit(""))) for c in (question_type, reasoning, question))
    return (
        F.when(F.contains(why, F.lit("calculation")) | F.contains(kind, F.lit("generated")) | contains_any(q, ("how much", "amount", "percentage", "ratio")), "numeric_procedure")
        .when(F.contains(why, F.lit("comparison")) | contains_any(q, ("compare", "difference")), "comparison_synthesis")
        .otherwise("lookup")
    )


def safe_name(name) -> Column:
    """A file's name of letters, digits, hyphens, underscores and dots."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.regexp_replace(col(name), r"[^\p{L}\p{N}_.-]", "-"), "-{2,}", "-"), F.lit("-")), F.lit("")), F.lit("document"))


def manifest_documents(questions: DataFrame, documents: DataFrame, folder: str) -> DataFrame:
    """The documents that questions are about, each once. documents: doc_name, doc_type, doc_link."""
    one = documents.groupBy("doc_name").agg(F.max(F.struct("doc_type", "doc_link")).alias("d"))
    rows = one.join(questions.select("doc_name"), "doc_name", "left_semi")
    return rows.select(F.col("doc_name").alias("document_id"), F.concat(F.lit(folder.rstrip("/") + "/"), safe_name("doc_name"), F.lit(".pdf")).alias("path"), F.lower(F.coalesce("d.doc_type", F.lit("financial_filing"))).alias("document_type"), F.coalesce("d.doc_link", F.lit("")).alias("source"), F.lit(False).alias("used_for_tuning"))


def manifest_questions(questions: DataFrame) -> DataFrame:
    """questions: question_id, doc_name, question, answer, justification, question_type, question_reasoning, pages (from 0; null where none is known)."""
    label = lambda p: F.when(p.isNotNull(), F.concat(F.lit("Page "), (p + 1).cast("string"))).otherwise("")
    regions = F.transform(F.coalesce("pages", F.expr("CAST(array() AS array<int>)")), lambda p: F.struct(F.lit("Annotated evidence").alias("section"), label(p).alias("page_label")))
    return questions.select(
        F.col("question_id").cast("string").alias("question_id"), F.col("doc_name").alias("document_id"), "question", intent_of("question_type", "question_reasoning", "question").alias("intent_type"), F.lit(True).alias("answerable"),
        regions.alias("expected_regions"), F.coalesce("answer", F.lit("")).alias("gold_answer"), F.coalesce("justification", F.lit("")).alias("gold_answer_notes"),
    )


def suite_rows(documents: DataFrame, questions: DataFrame, systems: DataFrame, most: int | None = None) -> DataFrame:
    """Every question with its document, for every system; systems is a stated, small set. most: questions, by id."""
    if most:
        questions = questions.orderBy("question_id").limit(most)
    rows = questions.join(documents.select("document_id", "path", "document_type"), "document_id")
    return rows.join(F.broadcast(systems.select("system").distinct()))


def page_brief(heading, path, label, text) -> Column:
    """What a model sees of a page to assign it: its label, a heading, and its first lines."""
    useful = F.slice(F.filter(F.slice(clean_lines(text), 1, 12), lambda x: F.length(x) <= 180), 1, 3)
    given = F.coalesce(F.nullif(col(heading), F.lit("")), F.when(F.size(col(path)) > 0, F.element_at(col(path), -1)), col(label), F.lit("Document"))
    return F.struct(F.coalesce(col(label), F.lit("Document")).alias("page_label"), best_title(given, text, label).alias("heading_candidate"), F.left(F.array_join(useful, " | "), F.lit(600)).alias("excerpt"))


def long_enough(rows: DataFrame, text: str = "text", more_than: int = 30) -> DataFrame:
    return rows.where(F.length(text) > more_than)

