"""Queries on documents' text and structure, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import constants as C
from ..functions import rules as R
from ..functions import text as T
from ..operators import chunking, scan, search, similar_sets, structure, topology
from ..sources.tables import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_of(column: str, phrases) -> str:
    """SQL: does the column hold one of the phrases?"""
    return "(" + " OR ".join(f"contains({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


#: SQL pieces that several queries share.
DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LINES = (
    DOCS
    + f", r AS (SELECT doc_id, string_split_regex(text, '{LINE_END}') AS a FROM d)"
    + f", l AS (SELECT doc_id, i - 1 AS raw_no, {STRIP.format('a[i]')} AS line FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM r))"
    + ", n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY raw_no) - 1 AS line_no, line FROM l WHERE line <> '')"
)
SQUASH = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def doc_fingerprint(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.fingerprint("text").alias("fingerprint"), T.document_id("text").alias("document_id"), F.length("text").cast("long").alias("chars"))


def doc_lines(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.lines("text").alias("a"))
    longest = F.aggregate("a", F.lit(0), lambda m, x: F.greatest(m, F.length(x)))
    return rows.select("doc_id", F.size("a").cast("long").alias("n_lines"), longest.cast("long").alias("longest"), F.sha2(F.array_join("a", "\n"), 256).alias("lines_sha256"))


def line_flags(spark, sf_dir):
    """How many lines of each document are what kind."""
    tests = {
        "n_artifact": R.is_page_artifact, "n_reference": R.is_reference_line, "n_sentence_like": R.is_sentence_like, "n_noise": R.is_noise_line,
        "n_tabular": R.is_tabular_line, "n_caption": R.is_table_caption, "n_block_start": R.starts_block,
    }
    # A document's lines are rows of one task, so that the counts are summed before they move.
    rows = documents(spark, sf_dir).select("doc_id", F.explode_outer(T.lines("text")).alias("line"))
    return rows.groupBy("doc_id").agg(*[F.count_if(test("line")).alias(name) for name, test in tests.items()])


LINE_FLAGS_SQL = rf"""
WITH {LINES}, w AS (
  SELECT *, lower(line) AS low, list_filter(string_split({SQUASH.format('line')}, ' '), lambda x: x <> '') AS w,
    len(regexp_extract_all(line, '[0-9]')) AS dg, len(regexp_extract_all(line, '\p{{Nd}}')) AS nd, len(regexp_extract_all(line, '\p{{L}}')) AS nl FROM n
), f AS (
  SELECT doc_id,
    regexp_matches(low, '^(?:[ivxlcdm]+|\d+|.*page\s+\d+)$') OR contains(low, 'author manuscript') AS artifact,
    contains(low, '[pubmed:') OR regexp_matches(line, '^\d{{1,3}}\.\s+[A-Z]') OR (contains(low, 'et al.') AND nd > 0) AS reference,
    len(w) >= 6 AND len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Ll}}'))) >= greatest(2, len(w) // 3) AS sentence_like,
    CASE WHEN contains(line, '@') OR starts_with(low, 'doi') OR starts_with(low, 'http') OR {any_of('low', ('author manuscript', 'available in pmc', '[pubmed:', 'copyright'))}
      OR regexp_matches(low, '^page\s+\d+$') THEN true WHEN len(w) > 24 THEN false ELSE nd > nl AND nd >= 6 END AS noise,
    regexp_matches(line, '\s{{2,}}|\t|[|]') AND (dg / greatest(length(line), 1) >= 0.12 OR len(w) >= 4) AS tabular,
    regexp_matches(line, '^(?i)(?:table|exhibit)\s+[A-Za-z0-9.\-:]+') AND low NOT IN ('table of contents', 'list of tables') AS caption,
    regexp_matches(line, '^(\d+(?:\.\d+)+)\b') OR (upper(line) = line AND low <> line) AS starts
  FROM w
)
SELECT d.doc_id, count(*) FILTER (artifact) AS n_artifact, count(*) FILTER (reference) AS n_reference, count(*) FILTER (sentence_like) AS n_sentence_like,
  count(*) FILTER (noise) AS n_noise, count(*) FILTER (tabular) AS n_tabular, count(*) FILTER (caption) AS n_caption, count(*) FILTER (starts) AS n_block_start
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""


def page_heading_guess(spark, sf_dir):
    """The fourth line of a document that has more than three, else the first."""
    a = T.lines("text")
    return documents(spark, sf_dir).select("doc_id", F.coalesce(F.get(a, F.lit(3)), F.get(a, F.lit(0)), F.lit("")).alias("heading"))


def overlap_chunks(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(T.windows("text", 1200, 180)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("chunk_md5"))


OVERLAP_CHUNKS_SQL = rf"""
WITH {DOCS}, s AS (
  SELECT doc_id, text, unnest(range(0, (1 + greatest(0, ceil((length(text) - 1200) / 1020.0)))::BIGINT)) AS i FROM d WHERE length(text) > 0
), c AS (SELECT doc_id, i, {STRIP.format("substring(text, (i * 1020 + 1)::INT, 1200)")} AS chunk FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, length(chunk) AS chars, md5(chunk) AS chunk_md5 FROM c WHERE chunk <> ''
"""


def as_pages(docs: DataFrame, lines_per_page: int = 12) -> DataFrame:
    """Documents cut into pages of some lines, as a reader of files would give them."""
    rows = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(T.lines("text")).alias("line_no", "line"))
    rows = rows.withColumn("page_no", F.floor(F.col("line_no") / lines_per_page).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    pages = rows.groupBy("document_id", "page_no").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))
    return pages.withColumn("page_label", F.concat(F.lit("Page "), F.col("page_no") + 1)).withColumn("section_heading", F.lit(""))


def semantic_blocks(spark, sf_dir):
    pages = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit(0).alias("page_no"), "text")
    rows = chunking.semantic_blocks(pages)
    return rows.select(F.col("document_id").alias("doc_id"), F.col("block").cast("long").alias("block"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("block_md5"))


SEMANTIC_BLOCKS_SQL = rf"""
WITH {LINES}, b AS (
  SELECT doc_id, line_no, line, sum(CASE WHEN line_no > 0 AND (regexp_matches(line, '^(\d+(?:\.\d+)+)\b') OR (upper(line) = line AND lower(line) <> line)) THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS block FROM n
), g AS (SELECT doc_id, block, string_agg(line, chr(10) ORDER BY line_no) AS t FROM b GROUP BY ALL)
SELECT doc_id, block, length(t) AS chars, md5(t) AS block_md5 FROM g
"""


def line_continuations(spark, sf_dir):
    """The next line of each line, and for short lines the first later line that isn't short: lines as chunks of one block, and as blocks of their own."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.posexplode(T.lines("text")).alias("chunk_index", "line"))
    short = F.length("line") <= 60
    lines = rows.select("document_id", F.lit(0).alias("page_no"), F.lit(None).cast("string").alias("artifact_type"), F.col("chunk_index").alias("at"), F.col("chunk_index").cast("string").alias("chunk_id"), "chunk_index", F.when(short, "heading_stub").otherwise("body").alias("chunk_role"), short.alias("short"))
    one = chunking.with_continuations(lines.withColumn("kind_no", F.lit(0)).withColumn("heading_only", F.lit(False)))
    each = chunking.with_continuations(lines.withColumn("kind_no", F.col("chunk_index")).withColumn("heading_only", F.col("short")))
    key = ["document_id", "chunk_index"]
    both = one.select(*key, F.col("continuation_id").cast("long").alias("next_line")).join(each.select(*key, F.col("continuation_id").cast("long").alias("next_body")), key)
    return both.select(F.col("document_id").alias("doc_id"), F.col("chunk_index").cast("long").alias("line_no"), "next_line", "next_body")


LINE_CONTINUATIONS_SQL = f"""
WITH {LINES}
SELECT doc_id, line_no, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line,
  CASE WHEN length(line) <= 60 THEN min(CASE WHEN length(line) > 60 THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS next_body
FROM n
"""


def sentences_top3(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join(F.slice("s", 1, 3), " | ").alias("first_three"))


SENTENCES_SQL = rf"""
WITH {DOCS}, s AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({SQUASH.format('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM d
)
SELECT doc_id, len(s) AS n_sentences, array_to_string(s[1:3], ' | ') AS first_three FROM s
"""


def key_terms(spark, sf_dir):
    terms = topology.key_terms(documents(spark, sf_dir), ["doc_id"], F.col("text"))
    return terms.select("doc_id", F.array_join("key_terms", ",").alias("key_terms"))


KEY_TERMS_SQL = f"""
WITH {DOCS}, t AS (
  SELECT doc_id, a[i] AS term, i FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (
    SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({quoted(C.KEY_TERM_STOPWORDS)})) AS a FROM d))
), c AS (SELECT doc_id, term, count(*) AS n, min(i) AS p FROM t GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS r FROM c)
SELECT doc_id, string_agg(term, ',' ORDER BY r) AS key_terms FROM k WHERE r <= 8 GROUP BY doc_id
"""


def doc_classes(spark, sf_dir):
    """Style, content type and front matter of each document, from its text."""
    empty = F.lit("")
    matter = R.front_matter(empty, "text", F.lit("Document"))
    return documents(spark, sf_dir).select(
        "doc_id",
        R.document_style(F.left("text", F.lit(800))).alias("style"),
        R.content_type(empty, "text", F.lit("general")).alias("content_type"),
        matter["kind"].alias("front_matter_kind"),
        matter["score"].alias("front_matter_score"),
        R.is_low_value_text("text").alias("low_value"),
    )


def style_sql(column: str) -> str:
    points = {name: " + ".join(f"CASE WHEN {any_of(column, phrases)} THEN {p} ELSE 0 END" for p, phrases in cues) for name, cues in C.STYLE_CUES}
    best = f"greatest({', '.join(points.values())})"
    return f"CASE WHEN {best} < 2 THEN 'generic_longform' " + " ".join(f"WHEN {p} = {best} THEN '{name}'" for name, p in points.items()) + " END"


DOC_CLASSES_SQL = rf"""
WITH {DOCS}, x AS (SELECT doc_id, text, lower(text) AS low, lower(left(text, 800)) AS head, lower(' ' || left(text, 1200)) AS joined, ' ' || left(lower(text), 1600) AS matter FROM d)
SELECT doc_id, {style_sql('head')} AS style,
  CASE {' '.join(f"WHEN {any_of('joined', phrases)} THEN '{name}'" for name, phrases in C.CONTENT_CUES)} ELSE 'general' END AS content_type,
  CASE {' '.join(f"WHEN {any_of('matter', phrases)} THEN '{kind}'" for kind, _, phrases in C.FRONT_MATTER)} ELSE 'body' END AS front_matter_kind,
  CASE {' '.join(f"WHEN {any_of('matter', phrases)} THEN {score}" for _, score, phrases in C.FRONT_MATTER)} ELSE 0 END::DOUBLE AS front_matter_score,
  {any_of('low', C.LOW_VALUE_PHRASES)} OR regexp_matches(low, '\bextended data (fig|figure|table)') OR regexp_matches(text, '\.{{10,}}') OR (contains(low, '.pdf') AND regexp_matches(low, '\p{{Nd}}')) AS low_value
FROM x
"""


def region_kinds(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", R.region_kind(F.left("text", F.lit(400)), "text").alias("region_kind"))


def region_sql() -> str:
    scores = {}
    for kind, keywords in C.REGION_KEYWORDS:
        s = " + ".join(f"contains(low, '{k}')::INT" for k in keywords)
        if kind == "evidence":
            s += " + CASE WHEN numeric > 0.05 THEN 1.5 ELSE 0 END + CASE WHEN tabular > 0.003 THEN 1.0 ELSE 0 END"
        if kind == "appendix":
            s += " + CASE WHEN contains(low, 'reference') THEN 1.5 ELSE 0 END"
        scores[kind] = f"({s})::DOUBLE"
    names = list(scores)
    listed = ", ".join(f"{s} AS s{i}" for i, s in enumerate(scores.values()))
    best = f"greatest({', '.join(f's{i}' for i in range(len(names)))})"
    cases = " ".join(f"WHEN s{i} = {best} THEN '{n}'" for i, n in enumerate(names))
    return rf"""
WITH {DOCS}, x AS (
  SELECT doc_id, lower(left(text, 400)) AS low, len(regexp_extract_all(left(text, 1500), '[0-9]')) / greatest(length(left(text, 1500)), 1) AS numeric,
    (len(regexp_extract_all(left(text, 1200), '[|]|\t')) + len(regexp_extract_all(lower(left(text, 1200)), 'table '))) / greatest(length(left(text, 1200)), 1) AS tabular FROM d
), s AS (SELECT doc_id, {listed} FROM x)
SELECT doc_id, CASE WHEN {best} <= 0 THEN 'general' {cases} END AS region_kind FROM s
"""


def front_section(spark, sf_dir):
    """A document's excerpt and its summary as an introduction."""
    rows = documents(spark, sf_dir)
    return rows.select("doc_id", F.md5(R.excerpt("text")).alias("excerpt_md5"), F.md5(R.section_summary(F.lit("Results"), "text")).alias("summary_md5"))


def sections_of(spark, sf_dir) -> DataFrame:
    """Turns of conversations in the place of sections: (conv_id, turn, kind, text)."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("kind"), F.coalesce("text", F.lit("")).alias("text"))


def section_adjacency(spark, sf_dir):
    """Edges between a turn and the next, and the next two of its role."""
    rows = sections_of(spark, sf_dir)
    none = F.expr("CAST(array() AS array<string>)")
    synopses = rows.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("section_id"), F.col("turn").alias("ordinal"), none.alias("section_path"), F.col("kind").alias("region_kind"), none.alias("key_terms"))
    return topology.build_edges(synopses).select(F.col("document_id").alias("conv_id"), "source", "target", "edge_type", "weight")


SECTION_ADJACENCY_SQL = """
WITH c AS (SELECT conv_id, turn, role, lead(turn) OVER d AS a, lead(turn, 1) OVER k AS b, lead(turn, 2) OVER k AS e FROM conversations
  WINDOW d AS (PARTITION BY conv_id ORDER BY turn), k AS (PARTITION BY conv_id, role ORDER BY turn))
SELECT conv_id, turn AS source, a AS target, 'previous_next' AS edge_type, 1.0::DOUBLE AS weight FROM c WHERE a IS NOT NULL
UNION ALL SELECT conv_id, turn, b, 'same_region_family', 0.75 FROM c WHERE b IS NOT NULL
UNION ALL SELECT conv_id, turn, e, 'same_region_family', 0.75 FROM c WHERE e IS NOT NULL
"""


def similar_turns(spark, sf_dir):
    """Of the turns of a conversation the two most alike to each, by key terms."""
    rows = sections_of(spark, sf_dir)
    terms = topology.key_terms(rows, ["conv_id", "turn"], F.col("text"))
    pairs = similar_sets.most_similar(terms, ["conv_id"], "turn", "key_terms", 0.2, 2)
    return pairs.select("conv_id", "source", "target", F.round("similarity", 9).alias("similarity"))


SIMILAR_TURNS_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, a[i] AS term, i FROM (SELECT conv_id, turn, a, unnest(range(1, len(a) + 1)) AS i FROM (
    SELECT conv_id, turn, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({quoted(C.KEY_TERM_STOPWORDS)})) AS a FROM conversations))
), c AS (SELECT conv_id, turn, term, count(*) AS n, min(i) AS p FROM t GROUP BY ALL),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, p) <= 8),
z AS (SELECT conv_id, turn, term, count(*) OVER (PARTITION BY conv_id, turn) AS m FROM k),
j AS (SELECT a.conv_id, a.turn AS source, b.turn AS target, count(*) / (any_value(a.m) + any_value(b.m) - count(*)) AS s
  FROM z a JOIN z b ON a.conv_id = b.conv_id AND a.term = b.term AND a.turn <> b.turn GROUP BY 1, 2, 3)
SELECT conv_id, source, target, round(s, 9) AS similarity FROM j WHERE s >= 0.2 QUALIFY row_number() OVER (PARTITION BY conv_id, source ORDER BY s DESC, target) <= 2
"""


def neighbour_turns(spark, sf_dir):
    """For each user turn the turns up to three places on."""
    name = F.concat_ws("-", "conv_id", "turn")
    chunks = sections_of(spark, sf_dir).select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), name.alias("chunk_id"), "kind")
    seeds = chunks.where("kind = 'user'").select(F.col("chunk_id").alias("question_id"), F.col("chunk_id").alias("record_id"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    found = search.neighbours(seeds, chunks, forward=3, most=3)
    turn = lambda c: F.substring_index(c, "-", -1).cast("long")
    return found.select(F.regexp_extract("question_id", "^(.*)-[0-9]+$", 1).cast("long").alias("conv_id"), turn("question_id").alias("seed"), turn("record_id").alias("neighbour"), F.col("rank").cast("long").alias("distance"))


NEIGHBOUR_TURNS_SQL = """
WITH a AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations)
SELECT s.conv_id, s.turn AS seed, n.turn AS neighbour, n.pos - s.pos AS distance
FROM a s JOIN a n ON n.conv_id = s.conv_id AND n.pos BETWEEN s.pos + 1 AND s.pos + 3 WHERE s.role = 'user'
"""


def role_runs(spark, sf_dir):
    """Runs of equal event types of a user: pages assigned one title are a section."""
    rows = table(spark, sf_dir, "events")
    assigned = rows.select(F.col("user_id").alias("document_id"), F.struct("ts", "event_id").alias("page_no"), F.col("event_id").cast("string").alias("page_label"), F.col("event_type").alias("title"), F.lit("").alias("section_kind"), F.lit("").alias("text"))
    runs = structure.repaired_sections(assigned)
    return runs.select(F.col("document_id").alias("user_id"), F.col("title").alias("event_type"), F.size("page_labels").cast("long").alias("events"), F.array_min(F.transform("page_labels", lambda x: x.cast("long"))).alias("first_id"))


ROLE_RUNS_SQL = """
WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER o = event_type THEN 0 ELSE 1 END AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT user_id, event_type, count(*) AS events, min(event_id) AS first_id FROM r GROUP BY user_id, run, event_type
"""


#: Of each event type, how much of a user's path it leaves; other types leave all and are not on it.
CUTS = {"signup": 0, "view": 1, "click": 2, "purchase": 3}


def event_paths(spark, sf_dir):
    """For each event the path of its user after it, the error before it, and its number: carries as from page to page."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    cut = F.element_at(F.create_map(*[F.lit(x) for p in CUTS.items() for x in p]), F.col("event_type"))
    failed = F.when(F.col("event_type") == "error", F.col("event_id"))
    events = scan.ranged(rows, ["user_id"], ["ts", "event_id"]).sums({"number": F.lit(1)}).last({"error_before": failed})
    paths = events.stacks("path", F.when(cut.isNotNull(), F.array(F.struct(cut.alias("cut"), F.col("event_type").alias("value")))))
    return paths.rows.select("user_id", "event_id", "number", "error_before", F.array_join("path", ">").alias("path"))


EVENT_PATHS_SQL = f"""
WITH e AS (SELECT *, CASE event_type {" ".join(f"WHEN '{t}' THEN {c}" for t, c in CUTS.items())} END AS cut FROM events),
k AS (SELECT *, count(cut) OVER o AS k FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, k + least(0, coalesce(min(cut + 1 - k) OVER o, 0)) AS depth FROM k WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number,
  last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS error_before,
  [{", ".join(f"last_value(CASE WHEN cut IS NOT NULL AND depth = {i} THEN event_type END IGNORE NULLS) OVER o" for i in range(1, max(CUTS.values()) + 2))}] AS a
  FROM d WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, number, error_before, coalesce(array_to_string(a[1:depth], '>'), '') AS path FROM p
"""


def enriched_pages(spark, sf_dir) -> DataFrame:
    pages = as_pages(documents(spark, sf_dir)).withColumn("document_id", F.col("document_id").cast("string"))
    return structure.enrich_pages(written(pages, "pages"))


def page_structure(spark, sf_dir):
    """Headings, kinds and clauses of all pages, carried through each document."""
    return enriched_pages(spark, sf_dir).select("document_id", "page_no", "page_label", "section_heading", F.array_join("section_path", " > ").alias("section_path"), F.array_join("clause_ids", ",").alias("clause_ids"), "section_kind", "content_type")


def section_topology(spark, sf_dir):
    """Edges between the sections of all documents."""
    sections = written(structure.build_sections(written(enriched_pages(spark, sf_dir), "enriched")), "sections")
    synopses = written(topology.build_synopses(written(structure.profile_sections(sections), "profiles")), "synopses")
    return topology.build_edges(synopses).groupBy("document_id", "edge_type").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))


def chunk_table(spark, sf_dir):
    """All chunks and artifacts of all documents."""
    pages = written(as_pages(documents(spark, sf_dir)).withColumn("section_kind", F.lit("general")), "pages")
    chunks = chunking.chunk_pages(pages)
    return chunks.select("document_id", "chunk_id", "chunk_index", "page_label", "artifact_type", "chunk_role", F.round("body_score", 6).alias("body_score"), F.round("low_value_prior", 6).alias("low_value_prior"), "continuation_id", F.length("text").alias("chars"))


QUERIES = {
    "doc_fingerprint": doc_fingerprint, "doc_lines": doc_lines, "line_flags": line_flags, "page_heading_guess": page_heading_guess, "overlap_chunks": overlap_chunks,
    "semantic_blocks": semantic_blocks, "line_continuations": line_continuations, "sentences_top3": sentences_top3, "key_terms": key_terms, "doc_classes": doc_classes,
    "region_kinds": region_kinds, "front_section": front_section, "section_adjacency": section_adjacency, "similar_turns": similar_turns, "neighbour_turns": neighbour_turns,
    "role_runs": role_runs, "event_paths": event_paths, "page_structure": page_structure, "section_topology": section_topology, "chunk_table": chunk_table,
}

ORACLE_SQL = {
    "doc_fingerprint": f"WITH {DOCS} SELECT doc_id, sha256(text) AS fingerprint, left(sha256(text), 16) AS document_id, length(text) AS chars FROM d",
    "doc_lines": f"WITH {LINES} SELECT d.doc_id, count(n.line) AS n_lines, coalesce(max(length(n.line)), 0) AS longest, sha256(coalesce(string_agg(n.line, chr(10) ORDER BY n.line_no), '')) AS lines_sha256 FROM d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id",
    "line_flags": LINE_FLAGS_SQL,
    "page_heading_guess": f"WITH {LINES} SELECT d.doc_id, coalesce(max(CASE WHEN line_no = 3 THEN line END), max(CASE WHEN line_no = 0 THEN line END), '') AS heading FROM d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id",
    "overlap_chunks": OVERLAP_CHUNKS_SQL,
    "semantic_blocks": SEMANTIC_BLOCKS_SQL,
    "line_continuations": LINE_CONTINUATIONS_SQL,
    "sentences_top3": SENTENCES_SQL,
    "key_terms": KEY_TERMS_SQL,
    "doc_classes": DOC_CLASSES_SQL,
    "region_kinds": region_sql(),
    "section_adjacency": SECTION_ADJACENCY_SQL,
    "similar_turns": SIMILAR_TURNS_SQL,
    "neighbour_turns": NEIGHBOUR_TURNS_SQL,
    "role_runs": ROLE_RUNS_SQL,
    "event_paths": EVENT_PATHS_SQL,
}
