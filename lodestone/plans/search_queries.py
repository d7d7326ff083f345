"""Queries on retrieval: questions against documents and vectors, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import constants as C
from ..functions import questions as Q
from ..functions import text as T
from ..operators import answers, search, semantic_cache
from ..sources.tables import written
from .text_queries import DOCS, SQUASH, any_of, documents, quoted, table


def questions_of(spark, sf_dir) -> DataFrame:
    """Benchmark passages as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("question"))


def asked(spark, sf_dir) -> DataFrame:
    """Everything that is asked: benchmark passages and users' turns, numbered by where they come from."""
    bench = questions_of(spark, sf_dir).select(F.concat(F.lit("b"), "question_id").alias("question_id"), "question")
    users = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("question_id"), F.coalesce("text", F.lit("")).alias("question"))
    return bench.unionByName(users)


ASKED = "q AS (SELECT 'b' || item_id AS question_id, coalesce(text, '') AS question FROM benchmark UNION ALL SELECT 'c-' || conv_id || '-' || turn, coalesce(text, '') FROM conversations WHERE role = 'user')"


def lexical_hits(spark, sf_dir, k: int = 4) -> DataFrame:
    records = documents(spark, sf_dir).select(F.col("doc_id").alias("record_id"), "text")
    return search.lexical_search(questions_of(spark, sf_dir), records, k, scope=())


def tfidf_search(spark, sf_dir):
    hits = lexical_hits(spark, sf_dir)
    return hits.select("question_id", F.col("record_id").alias("doc_id"), F.round("lexical", 6).alias("lexical"), F.col("rank").cast("long").alias("rank"))


#: The four best documents of each passage by TF-IDF cosine; ties go to the smaller number.
TFIDF_CTES = rf"""{DOCS}, stop AS (SELECT unnest([{quoted(C.STOP_WORDS)}]) AS term),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM d) WHERE term NOT IN (FROM stop) GROUP BY ALL),
qt AS (SELECT item_id AS question_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM benchmark) WHERE term NOT IN (FROM stop) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM d),
w AS (SELECT t.doc_id, t.term, tf, df, n FROM t JOIN f USING (term), n),
norms AS (SELECT doc_id, sum((tf * (ln((2.0::DOUBLE + n) / (1 + df)) + 1)) ^ 2) AS norm2 FROM w GROUP BY doc_id),
h AS (SELECT question_id, doc_id, sum(qtf * tf * (ln((2.0::DOUBLE + n) / (2 + df)) + 1) ^ 2) AS dot,
  sum((tf * (ln((2.0::DOUBLE + n) / (2 + df)) + 1)) ^ 2 - (tf * (ln((2.0::DOUBLE + n) / (1 + df)) + 1)) ^ 2) AS extra FROM qt JOIN w USING (term) GROUP BY ALL),
q2 AS (SELECT question_id, sum((qtf * (ln((2.0::DOUBLE + n) / (2 + coalesce(df, 0))) + 1)) ^ 2) AS q2 FROM qt LEFT JOIN f USING (term), n GROUP BY question_id),
hits AS (SELECT question_id, doc_id, dot / sqrt((norm2 + extra) * q2) AS lexical FROM h JOIN norms USING (doc_id) JOIN q2 USING (question_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(lexical, 12) DESC, doc_id) AS rank FROM hits)"""


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def vector_queries(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))


def knn_l2(spark, sf_dir):
    """Of every twentieth vector the five nearest of all."""
    hits = search.dense_search(vector_queries(spark, sf_dir).drop("query_label"), vectors(spark, sf_dir), 5)
    return hits.select("question_id", "vec_id", F.round("distance", 8).alias("distance"), F.round("dense", 8).alias("dense"), F.col("rank").cast("long").alias("rank"))


DISTANCE = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
KNN = f"k AS (SELECT a.vec_id AS question_id, a.label AS query_label, b.vec_id, b.label, {DISTANCE} AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"


def knn_by_label(spark, sf_dir):
    """The three nearest of the same label."""
    queries = vector_queries(spark, sf_dir).withColumnRenamed("query_label", "label")
    hits = search.dense_search(queries, vectors(spark, sf_dir), 3, by=("label",))
    return hits.select("question_id", "vec_id", F.round("distance", 8).alias("distance"), F.col("rank").cast("long").alias("rank"))


def semantic_cache_hits(spark, sf_dir):
    """All vectors as questions, one after the other: which are answered by an earlier one within a squared distance of 1.2, and by which."""
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("question_id"), F.col("vec_id").alias("position"), F.col("embedding").alias("vector"))
    found = semantic_cache.elect(rows, 1.2)
    return found.select("question_id", "hit", F.col("entry_id").cast("long").alias("entry_id"), F.round("distance", 8).alias("distance"))


SEMANTIC_CACHE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
p AS (SELECT b.vec_id AS later, a.vec_id AS earlier, {DISTANCE} AS distance FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND distance <= 1.2),
n AS (SELECT v.vec_id, v.i, coalesce(list(earlier) FILTER (earlier IS NOT NULL), []) AS near FROM v LEFT JOIN p ON later = v.vec_id GROUP BY ALL),
s AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS entries
  UNION ALL SELECT n.i, CASE WHEN list_has_any(near, entries) THEN entries ELSE list_append(entries, n.vec_id) END FROM s JOIN n ON n.i = s.i + 1),
e AS (SELECT unnest(entries) AS id FROM (SELECT entries FROM s ORDER BY i DESC LIMIT 1)),
b AS (SELECT later, earlier, distance FROM p JOIN e ON e.id = earlier WHERE later NOT IN (SELECT id FROM e) QUALIFY row_number() OVER (PARTITION BY later ORDER BY distance, earlier) = 1)
SELECT vec_id AS question_id, later IS NOT NULL AS hit, coalesce(earlier, vec_id) AS entry_id, round(distance, 8) AS distance FROM v LEFT JOIN b ON later = vec_id
"""


def dense_scope(spark, sf_dir):
    """What is left of ten nearest when the scope (the query's label) applies after the search, and what a scope before it finds."""
    queries = vector_queries(spark, sf_dir)
    every = vectors(spark, sf_dir)
    hits = search.dense_search(queries.drop("query_label"), every, 10)
    # Of the allowed pairs only those of hits are formed.
    wanted = hits.select("question_id", F.col("vec_id").alias("record_id")).join(queries.select("question_id", F.col("query_label").alias("label")), "question_id")
    allowed = wanted.join(every.select(F.col("vec_id").alias("record_id"), "label"), ["record_id", "label"], "left_semi").select("question_id", "record_id")
    after = search.only_allowed(hits.withColumnRenamed("vec_id", "record_id"), allowed).groupBy("question_id").agg(F.count(F.lit(1)).alias("after"))
    before = search.dense_search(queries.withColumnRenamed("query_label", "label"), every, 10, by=("label",)).groupBy("question_id").agg(F.count(F.lit(1)).alias("before"))
    return queries.select("question_id").join(after, "question_id", "left").join(before, "question_id", "left").select("question_id", F.coalesce("after", F.lit(0)).alias("after"), F.coalesce("before", F.lit(0)).alias("before"))


DENSE_SCOPE_SQL = f"""
WITH {KNN}, a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY distance, vec_id) <= 10),
b AS (SELECT * FROM k WHERE label = query_label QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY distance, vec_id) <= 10)
SELECT e.vec_id AS question_id, (SELECT count(*) FROM a WHERE a.question_id = e.vec_id AND a.label = a.query_label) AS after, (SELECT count(*) FROM b WHERE b.question_id = e.vec_id) AS before
FROM embeddings e WHERE e.vec_id % 20 = 0
"""


def rrf_fusion(spark, sf_dir, lexical=None):
    """Documents of a passage by TF-IDF and by shared terms, fused by reciprocal ranks. lexical: the first twelve, if they are there already."""
    lexical = lexical_hits(spark, sf_dir, 12) if lexical is None else lexical
    questions = questions_of(spark, sf_dir).select("question_id", F.explode(T.question_terms("question")).alias("term"))
    terms = documents(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(T.tokens("text"))).alias("term"))
    shared = terms.join(questions, "term").groupBy("question_id", F.col("doc_id").alias("record_id")).agg(F.count(F.lit(1)).alias("n"))
    dense = search.top(shared, "question_id", 12, F.desc("n"), "record_id")
    ranked = lexical.select("question_id", "record_id", F.lit("lexical").alias("system"), "rank", F.col("lexical").alias("score"))
    ranked = ranked.unionByName(dense.select("question_id", "record_id", F.lit("dense").alias("system"), "rank", F.col("n").cast("double").alias("score")))
    fused = search.fuse(ranked, 12)
    return fused.select("question_id", F.col("record_id").alias("doc_id"), F.round("fused", 9).alias("fused"), F.round("lexical", 6).alias("lexical"), "dense", F.col("rank").cast("long").alias("rank"))


RRF_SQL = rf"""
WITH {TFIDF_CTES}, a AS (SELECT question_id, doc_id, rank, lexical FROM top WHERE rank <= 12),
qw AS (SELECT DISTINCT item_id AS question_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM benchmark) WHERE length(term) > 3),
dw AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM d)),
b AS (SELECT question_id, doc_id, count(*) AS n FROM qw JOIN dw USING (term) GROUP BY ALL),
c AS (SELECT question_id, doc_id, n, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, doc_id) AS rank FROM b QUALIFY rank <= 12),
u AS (SELECT question_id, doc_id, rank, lexical, 0::DOUBLE AS dense FROM a UNION ALL SELECT question_id, doc_id, rank, 0, n::DOUBLE FROM c),
s AS (SELECT question_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS fused, max(lexical) AS lexical, max(dense) AS dense FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(fused, 12) DESC, doc_id) AS rank FROM s)
SELECT question_id, doc_id, round(fused, 9) AS fused, round(lexical, 6) AS lexical, dense, rank FROM r WHERE rank <= 12
"""


def relaxing_filter(spark, sf_dir):
    """Documents of each source in the passage's wanted language and length: a filter that would leave nothing is skipped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("question_id"), "lang", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    tests = [(F.lit(True), F.col("lang") == "es"), (F.lit(True), F.col("n_chars") > 60_000)]
    kept = search.relaxing_filter(docs, tests, F.lit(False))
    return kept.groupBy(F.col("question_id").alias("source")).agg(F.count(F.lit(1)).alias("kept"), F.sum("doc_id").alias("ids"))


RELAXING_SQL = """
WITH a AS (SELECT doc_id, coalesce(source, '') AS source, lang, coalesce(n_chars, 0) AS n FROM documents),
b AS (SELECT * FROM a QUALIFY coalesce(lang = 'es', false) OR NOT coalesce(bool_or(lang = 'es') OVER (PARTITION BY source), false)),
c AS (SELECT * FROM b QUALIFY n > 60000 OR NOT bool_or(n > 60000) OVER (PARTITION BY source))
SELECT source, count(*) AS kept, sum(doc_id)::BIGINT AS ids FROM c GROUP BY source
"""


def score_shapes(spark, sf_dir):
    """The nearest vectors' similarities, normalised for each query, and the gap between the first two."""
    hits = search.dense_search(vector_queries(spark, sf_dir).drop("query_label"), vectors(spark, sf_dir), 5)
    order = W.partitionBy("question_id").orderBy("rank")
    rows = hits.withColumn("norm", answers.normalized("dense")).withColumn("gap", F.col("dense") - F.lead("dense").over(order))
    return rows.select("question_id", "vec_id", F.round("norm", 7).alias("norm"), F.round(F.when(F.col("rank") == 1, F.col("gap")), 8).alias("gap"))


SCORE_SHAPES_SQL = f"""
WITH {KNN}, t AS (SELECT question_id, vec_id, 1 / (1 + greatest(distance, 0)) AS s, row_number() OVER (PARTITION BY question_id ORDER BY distance, vec_id) AS rank FROM k),
m AS (SELECT *, min(s) OVER w AS lo, max(s) OVER w AS hi, s - lead(s) OVER (PARTITION BY question_id ORDER BY rank) AS gap FROM t WHERE rank <= 5 WINDOW w AS (PARTITION BY question_id))
SELECT question_id, vec_id, round(CASE WHEN hi - lo <= 1e-9 THEN 1.0 ELSE (s - lo) / (hi - lo) END, 7)::DOUBLE AS norm, round(CASE WHEN rank = 1 THEN gap END, 8)::DOUBLE AS gap FROM m
"""


def query_profiles(spark, sf_dir):
    """What every question asks for."""
    rows = asked(spark, sf_dir).withColumn("p", Q.profile("question"))
    return rows.select("question_id", "p.query_type", "p.intent_type", "p.evidence_spread", F.array_join("p.content_types", ",").alias("content_types"), F.col("p.explicit").alias("explicit"))


def cue(phrases) -> str:
    return any_of("l", phrases)


PROFILE_CTES = rf"""{ASKED}, l AS (SELECT question_id, question, lower(question) AS l FROM q), a AS (SELECT *,
  {cue(C.SUMMARY_CUES)} AS summary, {cue(C.DETAIL_CUES)} OR regexp_matches(l, '\bwhat\b.*\b(features?|variables?|inputs?|signals?|factors?)\b.*\bused\b') AS detail,
  {cue(C.DEFINITION_CUES)} AS defines, {cue(C.PROCESS_CUES)} AS proc, {cue(C.NUMERIC_CUES)} AS numeric, {cue(C.TABLE_CUES)} AS tab, {cue(C.FRONT_MATTER_CUES)} AS fm,
  {cue(C.FOOTNOTE_CUES)} AS fn, {cue(C.BIBLIOGRAPHY_CUES)} AS bib, {cue(C.COMPARISON_CUES)} AS cmp,
  {cue(C.DISTRIBUTED_CUES)} OR regexp_matches(l, '\bwhat\b.*\b[a-z0-9_-]{{3,}}s\b.*\bapply\b') AS dist, {cue(C.GLOBAL_SUMMARY_CUES)} AS whole_doc,
  regexp_matches(l, '\bpages?\s+\d+\b') AS page, regexp_matches(question, '(?i)(?:clause|section)\s+(\d+(?:\.\d+)+)') AS clause,
  regexp_matches(question, '"([^"]+)"') OR regexp_matches(question, '(?i)(?:section|chapter)\s+([A-Za-z][A-Za-z0-9 ._-]*)') AS sec, {cue(C.EXPLICIT_SECTION_CUES)} AS seccue,
  contains(l, '{C.CONCLUDE_CUE}') AS concl FROM l
), b AS (SELECT *, NOT summary AND defines AS adef, NOT summary AND (proc OR detail) AS aproc,
  CASE WHEN cmp THEN 'comparison' WHEN summary THEN 'summary' WHEN NOT summary AND (proc OR detail) THEN 'procedure' WHEN numeric THEN 'numeric' WHEN dist THEN 'cross_cutting' ELSE 'lookup' END AS intent_type FROM a
), p AS (SELECT *, page OR clause OR sec AS explicit,
  CASE WHEN intent_type = 'summary' THEN 'summary_lookup' WHEN adef THEN 'definition_lookup' WHEN intent_type = 'procedure' THEN 'process_lookup' WHEN intent_type = 'numeric' THEN 'numeric_lookup'
    WHEN intent_type = 'comparison' THEN 'comparison_lookup' WHEN intent_type = 'cross_cutting' THEN 'cross_cutting_lookup' ELSE 'general_lookup' END AS query_type,
  CASE WHEN page OR clause THEN 'atomic' WHEN intent_type = 'summary' AND ((summary AND whole_doc) OR concl) THEN 'global' WHEN intent_type IN ('comparison', 'cross_cutting') OR dist THEN 'distributed'
    WHEN intent_type IN ('summary', 'numeric', 'procedure') OR sec OR seccue THEN 'sectional' ELSE 'atomic' END AS evidence_spread,
  concat_ws(',', CASE WHEN tab OR numeric THEN 'table' END, CASE WHEN fm THEN 'front_matter' END, CASE WHEN fn THEN 'footnote' END, CASE WHEN bib THEN 'bibliography' END,
    CASE WHEN adef THEN 'definition,general' WHEN aproc THEN 'methodology,general,results' WHEN numeric THEN 'results,general' WHEN intent_type = 'summary' THEN 'general,results'
      WHEN intent_type IN ('comparison', 'cross_cutting') THEN 'general,definition,results' ELSE 'general,definition' END) AS content_types FROM b)"""


def query_plans(spark, sf_dir):
    """Constraint, route and confidence of every question, without a model and before any region is known."""
    rows = asked(spark, sf_dir).withColumn("p", Q.profile("question"))
    mode = Q.constraint_mode("question", F.col("p"))
    rows = rows.withColumn("mode", mode)
    route = Q.route("question", F.col("p"))
    return rows.select(
        "question_id",
        F.col("mode").alias("constraint_mode"),
        Q.preferred_route(F.col("mode"), F.col("p")).alias("preferred_route"),
        F.array_join(Q.target_regions(F.col("p")), ",").alias("target_regions"),
        F.round(Q.plan_confidence("question", F.col("mode"), F.col("p"), F.lit(False)), 6).alias("confidence"),
        route["route"].alias("route"),
        F.round(route["confidence"], 6).alias("route_confidence"),
        Q.summary_focus("question").alias("focus"),
    )


def term_set(column: str, minimum: int, out: str = "") -> str:
    terms = f"list_distinct(list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda x: length(x) > {minimum}{out}))"
    return terms


def folded(terms: str) -> str:
    return f"list_distinct(list_concat({terms}, list_concat(list_transform(list_filter({terms}, lambda x: length(x) > 4 AND suffix(x, 's')), lambda x: x[:-2]), list_transform(list_filter({terms}, lambda x: length(x) > 5 AND suffix(x, 'ies')), lambda x: x[:-4] || 'y'))))"


def overlaps(spark, sf_dir):
    """Overlap of each passage with its four best documents: plain, with plurals folded, and signals of a fact."""
    hits = lexical_hits(spark, sf_dir).select("question_id", F.col("record_id").alias("doc_id"))
    rows = hits.join(documents(spark, sf_dir), "doc_id").join(questions_of(spark, sf_dir), "question_id")
    return rows.select("question_id", "doc_id", F.round(T.keyword_overlap("question", "text"), 9).alias("keyword_overlap"), F.round(T.content_overlap("question", "text"), 9).alias("content_overlap"))


OVERLAPS_SQL = rf"""
WITH {TFIDF_CTES}, x AS (SELECT question_id, t.doc_id, coalesce(b.text, '') AS question, d.text FROM top t JOIN benchmark b ON b.item_id = question_id JOIN d ON d.doc_id = t.doc_id WHERE rank <= 4),
y AS (SELECT question_id, doc_id, {term_set('question', 3)} AS q, {term_set('text', 0)} AS t, {term_set('question', 3, f" AND x NOT IN ({quoted(C.GENERIC_QUERY_TERMS)})")} AS g FROM x),
z AS (SELECT question_id, doc_id, q, t, {folded('g')} AS s, {folded('t')} AS u FROM y)
SELECT question_id, doc_id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END, 9)::DOUBLE AS keyword_overlap,
  round(CASE WHEN len(s) > 0 THEN len(list_intersect(s, u)) / len(s) ELSE 0 END, 9)::DOUBLE AS content_overlap FROM z
"""


ASKING = "what|which|how|why|when|where|tell|summarize|explain|describe"
INSIDE = rf"(?i)\bin the\s+([A-Za-z][A-Za-z0-9 ._-]*?)\s+(?:{ASKING}|is|are|was|were|does|do|did)\b"
MARKS_SQL = Q.MARKS.replace("'", "''")


def shares(column: str, words) -> str:
    return f"len(list_intersect({column}, [{quoted(words)}])) > 0"


QUERY_PLANS_SQL = rf"""
WITH {PROFILE_CTES},
e AS (SELECT *, list_concat(regexp_extract_all(question, '"([^"]+)"', 1), list_concat(regexp_extract_all(question, '(?i)(?:section|chapter)\s+([A-Za-z][A-Za-z0-9 ._-]*)', 1), regexp_extract_all(question, '{INSIDE}', 1))) AS raw,
  {term_set('question', 3, f" AND x NOT IN ({quoted(C.GENERIC_QUERY_TERMS)})")} AS g FROM p),
t AS (SELECT *, list_filter(list_transform(raw, lambda x: trim(string_split_regex(trim({SQUASH.format('x')}, '{MARKS_SQL}'), '(?i)\b(?:{ASKING})\b')[1], '{MARKS_SQL}')), lambda x: x <> '') AS named, {folded('g')} AS s FROM e),
m AS (SELECT *, CASE WHEN page OR clause OR len(named) > 0 THEN 'hard_region' WHEN evidence_spread = 'sectional' THEN 'soft_local' WHEN evidence_spread IN ('distributed', 'global') THEN 'soft_multi_region' ELSE 'none' END AS mode FROM t)
SELECT question_id, mode AS constraint_mode, CASE WHEN mode = 'hard_region' OR evidence_spread = 'atomic' THEN 'chunk_first' WHEN intent_type = 'procedure' AND detail THEN 'hybrid_both' ELSE 'synopsis_first' END AS preferred_route,
  CASE WHEN explicit THEN '' WHEN adef THEN 'definitions,general' WHEN intent_type = 'procedure' THEN 'procedure,evidence,general' WHEN intent_type = 'numeric' THEN 'evidence,discussion,general' WHEN intent_type = 'comparison' THEN 'evidence,discussion,overview'
    WHEN intent_type = 'summary' THEN 'overview,discussion,evidence' WHEN intent_type = 'cross_cutting' THEN 'rules,discussion,evidence,general' ELSE 'general,rules,definitions' END AS target_regions,
  round(greatest(CASE WHEN mode = 'hard_region' THEN 0.92 WHEN evidence_spread = 'atomic' THEN 0.86 WHEN evidence_spread = 'global' THEN 0.78 WHEN evidence_spread = 'sectional' THEN 0.74 ELSE 0.66 END::DOUBLE
    - 0.08::DOUBLE * (mode IN ('soft_local', 'soft_multi_region'))::INT - 0.08::DOUBLE * (len(named) > 0)::INT, 0), 6) AS confidence,
  CASE WHEN explicit AND {cue(Q.CHUNK_HINTS)} OR evidence_spread = 'atomic' THEN 'chunk_first' WHEN evidence_spread IN ('global', 'sectional') THEN 'synopsis_first' ELSE 'hybrid_both' END AS route,
  CASE WHEN explicit AND {cue(Q.CHUNK_HINTS)} THEN 0.9 WHEN evidence_spread IN ('atomic', 'global') THEN 0.84 WHEN evidence_spread = 'sectional' THEN CASE WHEN {cue(Q.SYNOPSIS_HINTS)} THEN 0.78 ELSE 0.7 END WHEN evidence_spread = 'distributed' THEN 0.62 ELSE 0.55 END::DOUBLE AS route_confidence,
  CASE WHEN {shares('s', C.FINDINGS_SUMMARY_TERMS)} THEN 'findings' WHEN {shares('s', C.LATE_SUMMARY_TERMS)} THEN 'late' WHEN {shares('s', C.EARLY_SUMMARY_TERMS)} THEN 'overview' ELSE 'balanced' END AS focus FROM m
"""


def finalized(questions, ranked, docs) -> DataFrame:
    """The final candidates; they are scored once, and few, so what reads them again reads no documents."""
    scored = written(search.score_chunks(questions, written(search.fuse(ranked), "fused"), docs), "scored")
    return written(search.finalize(scored), "final")


def evidence_status(spark, sf_dir):
    """The grade of every passage's evidence: search over all documents, scored, finalised."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    questions = questions_of(spark, sf_dir)
    hits = lexical_hits(spark, sf_dir, C.FUSED_TOP_K)
    ranked = hits.select("question_id", F.col("record_id").cast("string").alias("record_id"), F.lit("lexical").alias("system"), "rank", F.col("lexical").alias("score"))
    final = finalized(questions, ranked, docs)
    graded = search.grade(questions, final)
    return graded.select("question_id", "evidence_status", F.round("best_score", 6).alias("best_score"), F.round("max_lexical", 6).alias("max_lexical"), F.round("overlap", 6).alias("overlap"))


def extractive_answers(spark, sf_dir):
    """Answers to all passages: the beginnings of the two best documents, or an abstention; and what a cache would know them by."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    questions = questions_of(spark, sf_dir)
    hits = lexical_hits(spark, sf_dir, C.FUSED_TOP_K)
    ranked = hits.select("question_id", F.col("record_id").cast("string").alias("record_id"), F.lit("lexical").alias("system"), "rank", F.col("lexical").alias("score"))
    final = finalized(questions, ranked, docs)
    told = answers.extractive_answers(questions, final, search.grade(questions, final))
    return told.select("question_id", "answer", F.array_join("evidence", ",").alias("evidence"), "supported", "evidence_status", T.cache_key("question").alias("cache_key"))


QUERIES = {
    "tfidf_search": tfidf_search, "knn_l2": knn_l2, "knn_by_label": knn_by_label, "semantic_cache_hits": semantic_cache_hits, "dense_scope": dense_scope, "rrf_fusion": rrf_fusion, "relaxing_filter": relaxing_filter,
    "score_shapes": score_shapes, "query_profiles": query_profiles, "query_plans": query_plans, "overlaps": overlaps, "evidence_status": evidence_status,
    "extractive_answers": extractive_answers,
}

ORACLE_SQL = {
    "tfidf_search": f"WITH {TFIDF_CTES} SELECT question_id, doc_id, round(lexical, 6) AS lexical, rank FROM top WHERE rank <= 4",
    "knn_l2": f"WITH {KNN}, t AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, vec_id) AS rank FROM k) SELECT question_id, vec_id, round(distance, 8) AS distance, round(1 / (1 + distance), 8) AS dense, rank FROM t WHERE rank <= 5",
    "knn_by_label": f"WITH {KNN}, t AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, vec_id) AS rank FROM k WHERE label = query_label) SELECT question_id, vec_id, round(distance, 8) AS distance, rank FROM t WHERE rank <= 3",
    "semantic_cache_hits": SEMANTIC_CACHE_SQL,
    "dense_scope": DENSE_SCOPE_SQL,
    "rrf_fusion": RRF_SQL,
    "relaxing_filter": RELAXING_SQL,
    "score_shapes": SCORE_SHAPES_SQL,
    "query_profiles": f"WITH {PROFILE_CTES} SELECT question_id, query_type, intent_type, evidence_spread, content_types, explicit FROM p",
    "overlaps": OVERLAPS_SQL,
    "query_plans": QUERY_PLANS_SQL,
}
