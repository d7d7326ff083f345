"""Evaluation suites: manifests with their defaults, and what is wrong with a suite.

A suite is three tables: suite (suite_id, frozen, top_k, max_chars), documents
(document_id, path, document_type, source, license_notes, used_for_tuning) and
questions (question_id, document_id, question, intent_type, answerable,
gold_answer, gold_answer_notes, expected_regions, unsupported_reason). All
rules look at whole tables by joins and groups; any number of suites' questions
can be checked at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The intents that a question may have, and what a flag's text means.
INTENTS = ("lookup", "local_scope", "broad_summary", "comparison_synthesis", "numeric_procedure", "unsupported")
TRUE = ("1", "true", "yes", "on")
TOP_K, MAX_CHARS = 5, 600

#: Flags may be true values, texts or numbers, so they are read as text.
MANIFEST = """suite_id string, description string, frozen string, context_budget struct<top_k:int,max_chars_per_context:int>,
documents array<struct<document_id:string,path:string,document_type:string,type:string,source:string,license_notes:string,used_for_tuning:string>>,
questions array<struct<question_id:string,document_id:string,question:string,intent_type:string,answerable:string,gold_answer:string,gold_answer_notes:string,
expected_regions:array<struct<section:string,page_label:string>>,unsupported_reason:string>>"""


def flag(text, default: bool) -> Column:
    return F.when(text.isNull(), F.lit(default)).otherwise(F.lower(F.trim(text)).isin(*TRUE))


def or_empty(c) -> Column:
    return F.coalesce(c, F.lit(""))


def read_suite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """suite, documents and questions of a manifest, with its defaults. A byte order mark is passed over; a suite without a name has its file's."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    text = spark.read.text(path, wholetext=True).select(name.alias("name"), F.from_json(F.regexp_replace("value", "^\\x{FEFF}", ""), MANIFEST).alias("m"))
    budget = lambda field, default: F.coalesce(F.col(f"m.context_budget.{field}"), F.lit(default))
    suite = text.select(F.coalesce("m.suite_id", "name").alias("suite_id"), or_empty(F.col("m.description")).alias("description"), flag(F.col("m.frozen"), False).alias("frozen"), budget("top_k", TOP_K).alias("top_k"), budget("max_chars_per_context", MAX_CHARS).alias("max_chars"))
    d = text.select(F.explode("m.documents").alias("d")).select("d.*")
    documents = d.select(
        "document_id", "path", F.coalesce("document_type", "type", F.lit("unknown")).alias("document_type"), or_empty(F.col("source")).alias("source"),
        or_empty(F.col("license_notes")).alias("license_notes"), flag(F.col("used_for_tuning"), False).alias("used_for_tuning"),
    )
    q = text.select(F.explode("m.questions").alias("q")).select("q.*")
    regions = F.coalesce("expected_regions", F.expr("CAST(array() AS array<struct<section:string,page_label:string>>)"))
    questions = q.select(
        "question_id", "document_id", "question", F.trim(or_empty(F.col("intent_type"))).alias("intent_type"), flag(F.col("answerable"), True).alias("answerable"), or_empty(F.col("gold_answer")).alias("gold_answer"),
        or_empty(F.col("gold_answer_notes")).alias("gold_answer_notes"), regions.alias("expected_regions"), or_empty(F.col("unsupported_reason")).alias("unsupported_reason"),
    )
    return suite, documents, questions


def problems(suite: DataFrame, documents: DataFrame, questions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """rule, subject, detail: one row for each broken rule and what breaks it. files: path of what exists; left out, paths are not checked."""

    def found(rows: DataFrame, rule: str, subject: str | None = None, detail: str | None = None) -> DataFrame:
        of = lambda c: F.lit("") if c is None else or_empty(F.col(c).cast("string"))
        return rows.select(F.lit(rule).alias("rule"), of(subject).alias("subject"), of(detail).alias("detail"))

    empty = lambda rows: rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    twice = lambda rows, key: rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    unsupported = F.col("intent_type") == "unsupported"
    without_gold = (or_empty(F.col("gold_answer")) == "") & (or_empty(F.col("gold_answer_notes")) == "") & (F.coalesce(F.size("expected_regions"), F.lit(0)) <= 0)
    rows = [
        found(empty(documents), "no documents"),
        found(empty(questions), "no questions"),
        found(suite.where("top_k <= 0"), "top_k not positive", "suite_id", "top_k"),
        found(suite.where("max_chars <= 0"), "max_chars not positive", "suite_id", "max_chars"),
        found(twice(documents, "document_id"), "duplicate document", "document_id", "n"),
        found(documents.where("used_for_tuning"), "used for tuning", "document_id"),
        found(twice(questions, "question_id"), "duplicate question", "question_id", "n"),
        found(questions.join(documents.select("document_id"), "document_id", "left_anti"), "unknown document", "question_id", "document_id"),
        found(questions.where(~F.coalesce(F.col("intent_type").isin(*INTENTS), F.lit(False))), "unknown intent", "question_id", "intent_type"),
        found(questions.where(unsupported & F.col("answerable")), "unsupported but answerable", "question_id"),
        found(questions.where(~F.col("answerable") & (or_empty(F.col("unsupported_reason")) == "")), "no reason", "question_id"),
        found(questions.where(F.col("answerable") & without_gold), "nothing to judge by", "question_id"),
    ]
    if files is not None:
        rows.append(found(documents.join(files.select("path"), "path", "left_anti"), "no file", "document_id", "path"))
    return reduce(DataFrame.unionByName, rows)
