"""Queries on plans, reviews, suites and their metrics, with DuckDB SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..operators import answers, chunking, evaluate, search, suites, topology, validation
from ..operators import planning as P
from .search_queries import questions_of
from .text_queries import DOCS, LINE_END, STRIP, any_of, documents, table


def pick(column: str, values) -> Column:
    """One of the values, by a number's remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


def sql_pick(column: str, values) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[({column} % {len(values)} + 1)::INT]"


def likely_scopes(spark, sf_dir):
    """For each passage the twenty documents whose first words share most of its words."""
    sections = documents(spark, sf_dir).select(F.lit("all").alias("document_id"), F.col("doc_id").cast("string").alias("section_id"), F.col("doc_id").alias("ordinal"), F.left("text", F.lit(120)).alias("title"), (F.col("doc_id") % 11 == 0).alias("low_value"))
    asked = questions_of(spark, sf_dir).withColumn("document_id", F.lit("all"))
    found = P.likely_scopes(asked, sections)
    return found.select("question_id", "section_id", F.round("overlap", 9).alias("overlap"), F.col("rank").cast("long").alias("rank"))


def long_words(column: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda x: length(x) > 2))"


LIKELY_SQL = f"""
WITH {DOCS}, s AS (SELECT doc_id, unnest({long_words("left(text, 120)")}) AS term FROM d WHERE doc_id % 11 <> 0),
q AS (SELECT item_id AS question_id, {long_words("coalesce(text, '')")} AS w FROM benchmark), a AS (SELECT question_id, len(w) AS n, unnest(w) AS term FROM q),
c AS (SELECT question_id, doc_id, count(*) / any_value(n) AS overlap FROM a JOIN s USING (term) GROUP BY question_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, doc_id) AS rank FROM c)
SELECT question_id, doc_id::VARCHAR AS section_id, round(overlap, 9) AS overlap, rank FROM r WHERE rank <= 20
"""

STYLES, REGIONS, KINDS = ("policy_document", "research_paper", "generic_longform"), ("overview", "rules", "evidence", "appendix", "procedure"), ("claims", "general", "results", "coverage terms")


def synopsis_reviews(spark, sf_dir):
    """Documents as sections: the synopses of each source that a model should rewrite first."""
    empty = F.expr("CAST(array() AS array<string>)")
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("document_id")), "doc_id").select(
        "document_id", F.col("doc_id").alias("section_id"), F.col("doc_id").alias("ordinal"), F.left("text", F.lit(30)).alias("title"), F.substr("text", F.lit(10), F.lit(40)).alias("summary"), F.expr("left(text, doc_id % 400)").alias("synopsis"), "text",
        F.slice(F.regexp_extract_all(F.lower(F.left("text", F.lit(40))), F.lit("[a-z]+"), F.lit(0)), 1, 6).alias("key_terms"), pick("doc_id", STYLES).alias("document_style"), pick("doc_id", REGIONS).alias("region_kind"),
        pick("doc_id", KINDS).alias("section_kind"), F.lit("general").alias("content_type"), empty.alias("section_path"), (F.col("doc_id") % 13 == 0).alias("low_value"), (F.col("doc_id") % 7 == 0).alias("structure_repaired"),
    )
    found = topology.review_synopses(rows)
    return found.select("document_id", "section_id", F.col("rank").cast("long").alias("rank"), "priority", topology.synopsis_quality().alias("quality"))


SYNOPSIS_SQL = rf"""
WITH {DOCS}, r AS (SELECT d.doc_id, coalesce(source, '') AS document_id, d.text, left(d.text, 30) AS title, substring(d.text, 10, 40) AS summary, left(d.text, (d.doc_id % 400)::INT) AS synopsis,
  least(len(regexp_extract_all(lower(left(d.text, 40)), '[a-z]+')), 6) AS terms, {sql_pick('d.doc_id', STYLES)} AS style, {sql_pick('d.doc_id', REGIONS)} AS kind, {sql_pick('d.doc_id', KINDS)} AS section_kind FROM d JOIN documents e ON e.doc_id = d.doc_id),
s AS (SELECT *, lower(concat_ws(' ', title, '', section_kind, 'general', kind)) AS names, lower(trim(synopsis, ' ')) AS own, lower(trim(title, ' ')) AS lt, lower(trim(summary, ' ')) AS ls FROM r),
t AS (SELECT *, {any_of('names', C.POLICY_SECTION_TERMS)} AS signal, style = 'policy_document' AS policy FROM s),
q AS (SELECT *, round(least(0.4::DOUBLE * (length(own) >= 160)::INT + 0.2::DOUBLE * (terms >= 4)::INT + 0.15::DOUBLE * (lt <> '' AND own <> lt)::INT + 0.1::DOUBLE * (ls <> '' AND NOT contains(own, ls))::INT
  + 0.15::DOUBLE * (length(trim(text, ' ')) >= 600)::INT + 0.1::DOUBLE * (policy AND signal AND {any_of('own', C.POLICY_SECTION_TERMS)})::INT, 1.0), 6) AS quality FROM t),
p AS (SELECT *, round(CASE WHEN doc_id % 13 = 0 OR NOT (CASE WHEN policy THEN kind IN ('overview', 'definitions', 'rules', 'procedure') OR signal ELSE kind IN ('overview', 'procedure', 'evidence', 'discussion') END) THEN 0
  ELSE 1.0::DOUBLE - quality + 0.25::DOUBLE * (doc_id % 7 = 0)::INT + 0.15::DOUBLE * (length(text) >= 1200)::INT + 0.15::DOUBLE * (policy AND signal)::INT END, 6) AS priority FROM q)
SELECT document_id, doc_id AS section_id, rank, priority, quality FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY priority DESC, doc_id) AS rank FROM p) WHERE rank <= 6 AND priority > 0.2
"""

ROLES, MATTERS = ("body", "heading_stub", "table_fragment", "body", "reference_like", "navigation_like"), ("", "body", "preface", "body")


def chunk_reviews(spark, sf_dir):
    """Beginnings of documents as chunks: those of each source whose role is most in doubt, with what stands around them."""
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("document_id")), "doc_id").select(
        "document_id", F.col("doc_id").alias("chunk_index"), F.expr("left(text, 100 + doc_id % 300)").alias("text"), pick("doc_id", ROLES).alias("chunk_role"), pick("doc_id", MATTERS).alias("front_matter_kind"), ((F.col("doc_id") % 21) / 20.0).alias("body_score"),
    )
    found = chunking.review_candidates(rows)
    return found.select("document_id", "chunk_index", F.col("rank").cast("long").alias("rank"), "priority", F.md5("previous_text").alias("before"), F.md5("next_text").alias("after"))


CHUNK_SQL = rf"""
WITH {DOCS}, r AS (SELECT coalesce(source, '') AS document_id, d.doc_id, left(d.text, (100 + d.doc_id % 300)::INT) AS text, {sql_pick('d.doc_id', ROLES)} AS role, {sql_pick('d.doc_id', MATTERS)} AS matter,
  coalesce(nullif((d.doc_id % 21) / 20.0::DOUBLE, 0), 0.5) AS body FROM d JOIN documents e ON e.doc_id = d.doc_id),
s AS (SELECT *, {STRIP.format('text')} AS own, coalesce(replace(left(lag(text) OVER w, 180), chr(10), ' '), '') AS a, coalesce(replace(left(lead(text) OVER w, 180), chr(10), ' '), '') AS b FROM r WINDOW w AS (PARTITION BY document_id ORDER BY doc_id)),
p AS (SELECT *, round(1.2::DOUBLE * (role IN ('heading_stub', 'navigation_like', 'reference_like', 'table_fragment'))::INT + 1.0::DOUBLE * (matter NOT IN ('', 'body'))::INT + 0.5::DOUBLE * (body BETWEEN 0.15 AND 0.85)::INT
  + 0.3::DOUBLE * (length(own) <= 220)::INT + 0.2::DOUBLE * (len(string_split_regex(own, '{LINE_END}')) >= 3 AND body <= 0.65)::INT, 6) AS priority FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY priority DESC, doc_id) AS rank FROM p WHERE priority > 0)
SELECT document_id, doc_id AS chunk_index, rank, priority, md5(a) AS before, md5(b) AS after FROM k WHERE rank <= 12
"""

SPREADS, ROUTES_USED, MODES = ("atomic", "sectional", "distributed", "global"), ("chunk_first", "synopsis_first", "hybrid_both"), ("none", "soft_multi_region")


def plan_outcomes(spark, sf_dir):
    """Orders as questions, their items as results: hits, regions, and whether the plan suited what was found."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("Page "), (F.col("l_partkey") % 5 + 1).cast("string")).alias("page_label"),
        F.when(F.col("l_suppkey") % 3 == 0, "").otherwise("s").alias("section_id"), F.when(F.col("l_returnflag") == "A", "overview").when(F.col("l_returnflag") == "N", "evidence").otherwise("").alias("region_kind"),
    )
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "question_id")
    labels = orders.select("question_id", F.array(F.concat(F.lit("Page "), (F.col("o_custkey") % 5 + 1).cast("string"))).alias("expected_pages"))
    kinds = F.when(F.col("question_id") % 2 == 0, F.array(F.lit("overview"))).otherwise(F.expr("CAST(array() AS array<string>)"))
    plans = orders.select("question_id", pick("question_id", SPREADS).alias("spread"), pick("o_custkey", ROUTES_USED).alias("route_used"), pick("o_custkey", MODES).alias("mode"), kinds.alias("kinds"), (F.col("question_id") % 3 == 0).alias("fallback_used"))
    out = evaluate.retrieval_summary(evaluate.retrieval_outcomes(items, labels, plans))
    return out.select("questions", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


OUTCOMES_SQL = f"""
WITH r AS (SELECT o_orderkey AS q, l_linenumber AS rank, 'Page ' || (l_partkey % 5 + 1) AS page, l_suppkey % 3 <> 0 AS sec, CASE l_returnflag WHEN 'A' THEN 'overview' WHEN 'N' THEN 'evidence' ELSE '' END AS kind,
  'Page ' || (o_custkey % 5 + 1) AS want, {sql_pick('o_orderkey', SPREADS)} AS spread, {sql_pick('o_custkey', ROUTES_USED)} AS route, {sql_pick('o_custkey', MODES)} AS mode, o_orderkey % 2 = 0 AS named, o_orderkey % 3 = 0 AS fb
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
o AS (SELECT q, any_value(spread) AS spread, any_value(route) AS route, any_value(mode) AS mode, any_value(fb) AS fb, min(rank) FILTER (page = want) AS first, coalesce(bool_or(page = want AND sec), false) AS s,
  coalesce(bool_or(page = want AND CASE WHEN named THEN kind = 'overview' ELSE kind <> '' END), false) AS g, count(DISTINCT page) AS pages FROM r GROUP BY q),
p AS (SELECT *, first IS NOT NULL AS hit, first IS NOT NULL AND CASE spread WHEN 'atomic' THEN route = 'chunk_first' WHEN 'sectional' THEN route IN ('synopsis_first', 'section_first') AND pages <= 3
  WHEN 'distributed' THEN mode = 'soft_multi_region' AND route IN ('synopsis_first', 'hybrid_both') WHEN 'global' THEN route IN ('synopsis_first', 'hybrid_both') ELSE true END AS plan FROM o)
SELECT count(*) AS questions, round(avg(hit::INT), 9) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mean_reciprocal_rank, round(avg(s::INT), 9) AS section_hit_rate, round(avg(g::INT), 9) AS region_hit_rate, round(avg(plan::INT), 9) AS plan_hit_rate,
  round(coalesce(avg(hit::INT) FILTER (fb), 0), 9) AS fallback_recovery_rate, round(coalesce(avg(hit::INT) FILTER (spread = 'distributed'), 0), 9) AS multi_region_recall FROM p
"""


def trigger_rates(spark, sf_dir):
    """How often each trigger fires, by priority, and how the statuses are spread."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 4 == 0).alias("weak_trigger"), (F.col("o_custkey") % 3 == 0).alias("spread_trigger"), (F.col("o_custkey") % 5 == 0).alias("gap_trigger"),
    ).withColumn("triggered", F.col("weak_trigger") | F.col("gap_trigger"))
    counts = evaluate.category_counts(rows, "status", ("priority",))
    out = evaluate.trigger_summary(rows, ("priority",)).join(counts, "priority")
    shown = F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return out.select("priority", "triggered", F.round("trigger_rate", 9).alias("trigger_rate"), "weak_triggered", "spread_triggered", "gap_triggered", shown.alias("statuses"))


TRIGGERS_SQL = """
WITH r AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, o_orderkey % 4 = 0 AS w, o_custkey % 3 = 0 AS s, o_custkey % 5 = 0 AS g FROM orders),
c AS (SELECT priority, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM (SELECT priority, status, count(*) AS n FROM r GROUP BY ALL) GROUP BY priority)
SELECT priority, count(*) FILTER (w OR g) AS triggered, round(avg((w OR g)::INT), 9) AS trigger_rate, count(*) FILTER (w) AS weak_triggered, count(*) FILTER (s) AS spread_triggered, count(*) FILTER (g) AS gap_triggered, any_value(statuses) AS statuses
FROM r JOIN c USING (priority) GROUP BY priority
"""


def scope_rates(spark, sf_dir):
    """Orders as scoped questions: how well results kept to their scope."""
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 2 == 0).alias("page_hit"), (F.col("o_orderkey") % 3 == 0).alias("scope_hit"), (F.col("o_custkey") % 2 == 0).alias("compliant"), ((F.col("o_custkey") % 5) / 4.0).alias("precision"),
        F.when(F.col("o_orderstatus") == "O", "hard_region").otherwise("none").alias("mode"), (F.col("o_orderstatus") == "F").alias("fallback_used"),
    )
    out = evaluate.scope_summary(rows)
    return out.select("questions", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


SCOPES_SQL = """
SELECT count(*) AS questions, round(avg((o_orderkey % 2 = 0)::INT), 9) AS page_hit_rate, round(avg((o_orderkey % 3 = 0)::INT), 9) AS scope_hit_rate, round(avg((o_custkey % 2 = 0)::INT), 9) AS compliance_rate,
  round(avg((o_custkey % 5) / 4.0::DOUBLE), 9) AS precision_mean, round(avg((o_orderstatus = 'O')::INT), 9) AS hard_scope_rate, round(avg((o_orderstatus = 'F')::INT), 9) AS fallback_rate FROM orders
"""


def vendor_margins(spark, sf_dir):
    """Return flags as systems: how far A leads in each metric; R has no taxes."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("system"), F.col("l_discount").cast("double").alias("discount"), F.when(F.col("l_returnflag") != "R", F.col("l_tax").cast("double")).alias("tax"))
    out = evaluate.margins(rows, "system", "A", ["discount", "tax"])
    return out.select("system", F.round("discount", 9).alias("discount"), F.round("tax", 9).alias("tax"))


MARGINS_SQL = """
WITH m AS (SELECT l_returnflag AS system, avg(l_discount::DOUBLE) AS d, avg(CASE WHEN l_returnflag <> 'R' THEN l_tax::DOUBLE END) AS t FROM lineitem GROUP BY 1)
SELECT m.system, round(a.d - m.d, 9) AS discount, round(a.t - m.t, 9) AS tax FROM m, m a WHERE a.system = 'A' AND m.system <> 'A'
"""

SECTION_KINDS = ("overview", "methods", "general", "results", "Discussion", "appendix", "limitations")


def titled_sections(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("document_id", F.col("doc_id").alias("ordinal"), F.split_part(F.left("text", F.lit(30)), F.lit("."), F.lit(1)).alias("title"), pick("doc_id", SECTION_KINDS).alias("section_kind"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Page 1"), F.lit("Page 2"))).otherwise(F.array(F.lit("Page 1"))).alias("page_labels"))


def ranked_titles(spark, sf_dir):
    """Beginnings of documents as titles: the six of each source to ask about first."""
    found = suites.ranked_titles(titled_sections(spark, sf_dir))
    return found.select("document_id", "title", "kind", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


TITLES_SQL = rf"""
WITH {DOCS}, r AS (SELECT coalesce(source, '') AS document_id, d.doc_id, {STRIP.format("split_part(left(d.text, 30), '.', 1)")} AS title, lower({sql_pick('d.doc_id', SECTION_KINDS)}) AS kind FROM d JOIN documents e ON e.doc_id = d.doc_id),
s AS (SELECT *, lower(title) AS low, CASE WHEN kind IN ('overview', 'abstract', 'introduction', 'background') THEN 5 WHEN kind IN ('methodology', 'methods', 'results', 'discussion', 'conclusion', 'future work', 'future directions') THEN 4 ELSE 0 END
  + (doc_id <= 6)::INT * 2 + (doc_id % 2 = 0)::INT AS score FROM r),
t AS (SELECT * FROM s WHERE low <> '' AND low <> 'document overview' AND NOT {any_of('low', C.NOISE_TITLE_TERMS)} AND NOT regexp_matches(title, '\[\d+\]|\b(?:19|20)\d{{2}}\b') AND len(regexp_extract_all(title, '\p{{Nd}}')) < 4
  AND NOT (len(string_split_regex(low, '\s+')) = 1 AND low NOT IN ({', '.join(f"'{x}'" for x in C.SINGLE_WORD_TITLES)}))),
u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY document_id, low ORDER BY score DESC, doc_id) = 1),
v AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, low) AS rank FROM u)
SELECT document_id, title, kind, score::BIGINT AS score, rank FROM v WHERE rank <= 6
"""


def question_sets(spark, sf_dir):
    """Eight questions for each source, by its style and its sections."""
    sections = titled_sections(spark, sf_dir)
    styles = sections.groupBy("document_id").agg(F.min("ordinal").alias("o")).select("document_id", pick("o", ("policy_document", "research_paper", "other")).alias("document_style"))
    return suites.question_sets(styles, sections).withColumn("number", F.col("number").cast("long"))


def suite_problems(spark, sf_dir):
    """Whole documents as questions of a suite whose documents are their sources: how many break each rule.

    A text is a question's name, so copies are duplicates; the language is its
    intent; labels say whether it can be answered and whether its source was tuned on.
    """
    labels = table(spark, sf_dir, "labels")
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    intent = F.when(F.col("lang") == "en", "lookup").when(F.col("lang") == "de", "unsupported").otherwise(F.coalesce("lang", F.lit("")))
    text = F.coalesce("text", F.lit(""))
    none = F.expr("CAST(array() AS array<string>)")
    questions = rows.select(
        F.sha2(text, 256).alias("question_id"), "lang", F.coalesce("source", F.lit("")).alias("document_id"), intent.alias("intent_type"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("answerable"),
        F.regexp_extract(text, "^[^.]*\\.", 0).alias("gold_answer"), F.lit("").alias("gold_answer_notes"), none.alias("expected_regions"), F.when(F.col("toxic") == 1, "toxic").alias("unsupported_reason"),
    )
    per = rows.groupBy(F.coalesce("source", F.lit("")).alias("document_id")).agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.bool_or(F.coalesce(F.col("lang") == "es", F.lit(False))).alias("spanish"))
    documents = per.select("document_id", F.concat("document_id", F.lit(".pdf")).alias("path"), (F.col("toxic") == 1).alias("used_for_tuning"), "spanish")
    suite = spark.range(1).select(F.lit("all").alias("suite_id"), F.lit(5).alias("top_k"), F.lit(0).alias("max_chars"))
    found = validation.problems(suite, documents.where("spanish"), questions, documents.where("used_for_tuning").select("path"))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject").alias("subjects"))


SUITE_PROBLEMS_SQL = r"""
WITH r AS (SELECT d.*, quality, toxic, coalesce(text, '') AS t FROM documents d LEFT JOIN labels USING (doc_id)),
q AS (SELECT sha256(t) AS id, coalesce(source, '') AS doc, CASE WHEN lang = 'en' THEN 'lookup' WHEN lang = 'de' THEN 'unsupported' ELSE coalesce(lang, '') END AS intent,
  coalesce(quality = 1, false) AS answerable, regexp_extract(t, '^[^.]*\.') AS gold, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS reason FROM r),
p AS (SELECT coalesce(source, '') AS id, max(coalesce(toxic, 0)) = 1 AS tuned, bool_or(coalesce(lang = 'es', false)) AS spanish FROM r GROUP BY 1), d AS (FROM p WHERE spanish),
x AS (
  SELECT 'max_chars not positive' AS rule, 'all' AS subject
  UNION ALL SELECT 'no documents', '' WHERE (SELECT count(*) FROM d) = 0 UNION ALL SELECT 'no questions', '' WHERE (SELECT count(*) FROM q) = 0
  UNION ALL SELECT 'used for tuning', id FROM d WHERE tuned UNION ALL SELECT 'no file', id FROM d WHERE NOT tuned
  UNION ALL SELECT 'duplicate question', id FROM q GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'unknown document', id FROM q WHERE doc NOT IN (SELECT id FROM d)
  UNION ALL SELECT 'unknown intent', id FROM q WHERE intent NOT IN ('lookup', 'local_scope', 'broad_summary', 'comparison_synthesis', 'numeric_procedure', 'unsupported')
  UNION ALL SELECT 'unsupported but answerable', id FROM q WHERE intent = 'unsupported' AND answerable
  UNION ALL SELECT 'no reason', id FROM q WHERE NOT answerable AND reason = ''
  UNION ALL SELECT 'nothing to judge by', id FROM q WHERE answerable AND gold = ''
)
SELECT rule, count(*) AS n, count(DISTINCT subject) AS subjects FROM x GROUP BY rule
"""


def suite_manifest(spark, sf_dir):
    """Passages as a benchmark's questions and nations as its documents: every question with its document, for two systems."""
    length = F.length(F.coalesce("text", F.lit("")))
    questions = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.concat(F.lit("doc/ "), (length % 30).cast("string")).alias("doc_name"), F.coalesce("text", F.lit("")).alias("question"), F.lit("a").alias("answer"), F.lit(None).cast("string").alias("justification"),
        F.when(length % 3 == 0, "metrics-generated").when(length % 3 == 1, "domain-relevant").alias("question_type"), F.lit(None).cast("string").alias("question_reasoning"), F.array(F.lit(0), F.lit(None).cast("int")).alias("pages"),
    )
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("doc/ "), F.col("n_nationkey").cast("string")).alias("doc_name"), F.upper("n_name").alias("doc_type"), F.lit("l").alias("doc_link"))
    docs = suites.manifest_documents(questions, nations.unionByName(nations), "pdf/")
    systems = spark.createDataFrame([("own",), ("other",)], "system string")
    rows = suites.suite_rows(docs, suites.manifest_questions(questions), systems)
    pages = F.array_join(F.transform("expected_regions", lambda x: x["page_label"]), "|")
    return rows.select("system", "question_id", "document_id", "path", "document_type", "intent_type", pages.alias("pages"))


MANIFEST_SQL = f"""
WITH q AS (SELECT item_id::VARCHAR AS question_id, lower(coalesce(text, '')) AS t, length(coalesce(text, '')) AS n FROM benchmark),
d AS (SELECT n_nationkey AS k, lower(n_name) AS document_type FROM nation), s AS (SELECT unnest(['own', 'other']) AS system)
SELECT system, question_id, 'doc/ ' || k AS document_id, 'pdf/doc-' || k || '.pdf' AS path, document_type,
  CASE WHEN n % 3 = 0 OR {any_of('t', ('how much', 'amount', 'percentage', 'ratio'))} THEN 'numeric_procedure' WHEN {any_of('t', ('compare', 'difference'))} THEN 'comparison_synthesis' ELSE 'lookup' END AS intent_type, 'Page 1|' AS pages
FROM q JOIN d ON k = n % 30, s
"""


def answered_questions(spark, sf_dir):
    """Every passage asked of all documents: cache, search, grade, answer, one wider search for the unsupported, trace."""
    chunks = documents(spark, sf_dir).select(F.lit("all").alias("document_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("int").alias("chunk_index"), "text", F.lit("Page 1").alias("page_label"))
    asked = questions_of(spark, sf_dir).withColumn("document_id", F.lit("all")).withColumn("fingerprint", F.lit("all"))
    out = answers.answer_all(asked, lambda q: search.retrieve(q, chunks), lambda q, final, grades: search.recover(q, chunks, final, grades), F.lit(datetime.datetime(2026, 1, 1)).cast("timestamp"))
    traces = out["traces"].select("question_id", F.size(F.from_json("candidates", "array<struct<rank:int>>")).alias("shown"))
    return out["answers"].join(traces, "question_id").select("question_id", "supported", "evidence_status", "cache_hit", "cache_key", F.md5(F.coalesce("answer", F.lit(""))).alias("answer_md5"), F.col("shown").cast("long").alias("shown"))


QUERIES = {
    "likely_scopes": likely_scopes, "synopsis_reviews": synopsis_reviews, "chunk_reviews": chunk_reviews, "plan_outcomes": plan_outcomes, "trigger_rates": trigger_rates, "scope_rates": scope_rates,
    "vendor_margins": vendor_margins, "ranked_titles": ranked_titles, "question_sets": question_sets, "suite_problems": suite_problems, "suite_manifest": suite_manifest, "answered_questions": answered_questions,
}

ORACLE_SQL = {
    "likely_scopes": LIKELY_SQL, "synopsis_reviews": SYNOPSIS_SQL, "chunk_reviews": CHUNK_SQL, "plan_outcomes": OUTCOMES_SQL, "trigger_rates": TRIGGERS_SQL, "scope_rates": SCOPES_SQL,
    "vendor_margins": MARGINS_SQL, "ranked_titles": TITLES_SQL, "suite_problems": SUITE_PROBLEMS_SQL, "suite_manifest": MANIFEST_SQL,
}
