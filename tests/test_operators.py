"""Stages on small tables."""

import datetime
import io
import math
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import constants as C
from lodestone.operators import answers, chunking, evaluate, retention, routes, search, structure, topology
from lodestone.sources import files
from lodestone.sources.tables import written
from lodestone.streaming import retention as streaming

PAGES = [
    ("d", 0, "Page 1", "Abstract\nWe study the aims of care. It works well for many.", ""),
    ("d", 1, "Page 2", "1 Study Design\n3.1 Waiting Period\nThe waiting period is thirty days for all new members.", ""),
    ("d", 2, "Page 3", "the text goes on with plain words and nothing else to see here.", ""),
    ("d", 3, "Page 4", "References\n12. Smith J. A paper.", ""),
    ("e", 0, "Page 1", "STUDY DESIGN\nTable 1: Rates\nyear  1999  2000\nrate  12  13\nsum  25  26\n\nThe rates rise in both years shown. They are small.\n1 A note that is long enough to be a footnote line.", ""),
]
PAGE_SCHEMA = "document_id string, page_no int, page_label string, text string, section_heading string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, PAGE_SCHEMA)


@pytest.fixture(scope="module")
def enriched(pages):
    return written(structure.enrich_pages(pages), "enriched")


def test_enrich_pages(enriched):
    rows = {(r.document_id, r.page_no): r for r in enriched.collect()}
    assert rows["d", 0].section_heading == "Abstract" and rows["d", 0].section_kind == "abstract"
    assert rows["d", 1].section_path == ["Abstract", "Study Design"] or rows["d", 1].section_heading
    assert rows["d", 2].section_heading == rows["d", 1].section_heading  # carried on
    assert rows["d", 3].section_path == ["References"] and rows["d", 3].content_type == "references"


def test_sections_to_edges(enriched):
    sections = written(structure.build_sections(enriched), "sections")
    found = {(r.document_id, r.section_id): r for r in sections.collect()}
    assert found["d", "References"].front_matter_kind == "references"
    assert sum(r.document_id == "d" for r in found.values()) == 3
    synopses = written(topology.build_synopses(written(structure.profile_sections(sections), "profiles")), "synopses")
    assert synopses.where("synopsis = ''").count() == 0
    edges = topology.build_edges(synopses).collect()
    assert Counter(e.edge_type for e in edges)["previous_next"] == 2
    assert all(e.source != e.target for e in edges)
    questions = enriched.sparkSession.createDataFrame([(1, "d", "What does the abstract say?", ["overview"], [])], "question_id int, document_id string, question string, kinds array<string>, explicit array<string>")
    assert topology.candidate_regions(questions, synopses).first()["section_id"] == "Abstract"
    styles = structure.document_styles(enriched)
    assert {r.document_id: r.document_style for r in styles.collect()}["d"] == "policy_document"
    assert structure.overview_sections(enriched, sections, styles).collect()


def test_assess_structure(spark, enriched):
    documents = spark.createDataFrame([("d", 30, "research_paper"), ("e", 1, "generic_longform"), ("none", 9, "x")], "document_id string, page_count int, document_style string")
    got = {r.document_id: r for r in structure.assess_structure(structure.build_sections(enriched), documents).collect()}
    assert "long_document_too_few_sections" in got["d"].reason_codes
    assert got["d"].confidence == pytest.approx(0.92 - 0.28 - (0.18 if "weak_canonical_headings" in got["d"].reason_codes else 0))
    assert got["e"].reason_codes == ["healthy_structure"] and not got["e"].should_repair
    assert got["none"].confidence == 0 and got["none"].reason_codes == ["no_sections"]


def test_repaired_sections(spark):
    rows = [("d", 0, "p0", "A", "x", "1"), ("d", 1, "p1", "A", "x", "2"), ("d", 2, "p2", "B", "x", "3"), ("d", 3, "p3", "A", "x", "4")]
    got = structure.repaired_sections(spark.createDataFrame(rows, "document_id string, page_no int, page_label string, title string, section_kind string, text string")).orderBy("ordinal").collect()
    assert [(r.title, r.text, r.page_labels) for r in got] == [("A", "1\n\n2", ["p0", "p1"]), ("B", "3", ["p2"]), ("A", "4", ["p3"])]


def test_chunks(enriched):
    chunks = written(chunking.chunk_pages(enriched, 80, 20), "chunks")
    rows = sorted(chunks.collect(), key=lambda r: (r.document_id, r.chunk_index))
    assert [r.chunk_index for r in rows if r.document_id == "e"] == list(range(sum(r.document_id == "e" for r in rows)))
    table = next(r for r in rows if r.artifact_type == "table")
    assert table.text.startswith("Table 1") and table.visibility == "targeted_or_numeric" and table.chunk_id == "e-artifact-0000"
    assert any(r.artifact_type == "footnote" for r in rows) and any(r.artifact_type == "bibliography" for r in rows)
    by = {r.chunk_id: r for r in rows}
    assert all(by[r.continuation_id].chunk_index > r.chunk_index for r in rows if r.continuation_id)
    assert chunking.artifact_counts(chunks).where("document_id = 'e'").first()["counts"]["table"] == 1
    joined = structure.join_section_metadata(chunks.select("document_id", "page_label", "chunk_id", "content_type"), structure.build_sections(enriched))
    assert joined.count() == chunks.count() and joined.where("section_id IS NULL").count() == 0


def tfidf(question, texts):
    token = lambda t: [w for w in re.findall(r"[^\W]{2,}", t.lower()) if w not in C.STOP_WORDS]
    docs = [Counter(token(t)) for t in [*texts, question]]
    df = Counter(w for d in docs for w in d)
    idf = lambda w: math.log((1 + len(docs)) / (1 + df[w])) + 1
    vec = [{w: n * idf(w) for w, n in d.items()} for d in docs]
    norm = [math.sqrt(sum(v * v for v in x.values())) for x in vec]
    q = vec[-1]
    return [sum(q.get(w, 0) * v for w, v in x.items()) / (n * norm[-1]) if n and norm[-1] else 0.0 for x, n in zip(vec[:-1], norm)]


def test_lexical_search(spark):
    texts = ["waiting period of thirty days", "period of grace", "nothing here", "waiting waiting lists", ""]
    questions = [(1, "d", "How long is the waiting period?"), (2, "d", "zzz unknown"), (3, "e", "period")]
    q = spark.createDataFrame(questions, "question_id int, document_id string, question string")
    r = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)] + [("e", 9, "other period")], "document_id string, record_id int, text string")
    got = {(x.question_id, x.record_id): x.lexical for x in search.lexical_search(q, r, 10).collect()}
    want = {(1, i): s for i, s in enumerate(tfidf(questions[0][2], texts)) if s > 0} | {(3, 9): tfidf("period", ["other period"])[0]}
    assert got == pytest.approx(want)


def test_fuse_promote_finalize(spark):
    ranked = spark.createDataFrame([(1, "a", "dense", 1, 0.9), (1, "b", "dense", 2, 0.8), (1, "b", "lexical", 1, 0.5)], "question_id int, record_id string, system string, rank int, score double")
    fused = search.fuse(ranked)
    assert {r.record_id: r.fused for r in fused.collect()} == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61})
    chunks = spark.createDataFrame([("a", "d", "HEAD", True, "heading_stub", "c"), ("b", "d", "Body text. More.", False, "body", None), ("c", "d", "After the head.", False, "body", None)], "chunk_id string, document_id string, text string, heading_only boolean, chunk_role string, continuation_id string")
    more = {r.record_id: r.fused for r in search.promote_continuations(fused, search.completed(chunks)).collect()}
    assert more["c"] == pytest.approx(max(0.96 / 61, 1 / 61 - 0.005) + 0.03)
    questions = spark.createDataFrame([(1, "What is the head?"), (2, "nothing at all")], "question_id int, question string")
    final = search.finalize(search.score_chunks(questions, search.promote_continuations(fused, search.completed(chunks)), chunks.drop("document_id")))
    assert "a" not in [r.record_id for r in final.collect()]  # its continuation stands for it
    grades = {r.question_id: r.evidence_status for r in search.grade(questions, final).collect()}
    assert grades[2] == "unsupported" and grades[1] != "unsupported"
    told = {r.question_id: r for r in answers.extractive_answers(questions, final, search.grade(questions, final)).collect()}
    assert told[1].answer and told[2].answer is None and not told[2].supported


def test_retrieve_and_recover(spark, enriched):
    chunks = written(chunking.chunk_pages(enriched, 200, 40), "chunks")
    questions = spark.createDataFrame([(1, "d", "How long is the waiting period for members?"), (2, "d", "Who funded zebras?")], "question_id int, document_id string, question string")
    final, grades = search.retrieve(questions, chunks)
    best = final.where("question_id = 1 AND final_rank = 1").first()
    assert "waiting period" in best["text"]
    status = {r.question_id: r.evidence_status for r in grades.collect()}
    assert status[1] in ("strong", "weak") and status[2] == "unsupported"
    again, regraded = search.recover(questions, chunks, final, grades)
    assert {r.question_id for r in regraded.collect()} <= {2} and again.where("question_id = 1").count() == 0
    near = search.neighbours(spark.createDataFrame([(1, "d-chunk-0000", 1, 1.0)], "question_id int, record_id string, rank int, score double"), chunks)
    assert near.count() <= 8


def test_neighbours_go_by_order_where_numbers_have_gaps(spark):
    chunks = spark.createDataFrame([("d", f"c{i}", i * i) for i in range(12)] + [("e", "x", 5)], "document_id string, chunk_id string, chunk_index int")
    seeds = spark.createDataFrame([(1, "c2", 1, 1.0), (1, "c4", 2, 0.01), (2, "c10", 1, 0.5), (3, "c0", 7, 1.0)], "question_id int, record_id string, rank int, score double")
    got = [(r.question_id, r.record_id, round(r.base, 6)) for r in search.neighbours(seeds, chunks, forward=3).orderBy("question_id", "rank").collect()]
    # The first seed wins; a seed beyond the sixth rank has none; nothing crosses documents.
    assert got == [(1, "c3", 0.98), (1, "c4", 0.98), (1, "c5", 0.98), (1, "c6", 0.009), (1, "c7", 0.009), (2, "c11", 0.48)]


def test_relaxing_filter(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "question_id int, x string")
    test = [(F.lit(True), F.col("x") == "a")]
    assert {(r.question_id, r.x) for r in search.relaxing_filter(rows, test, F.lit(False)).collect()} == {(1, "a"), (2, "b")}
    assert {(r.question_id, r.x) for r in search.relaxing_filter(rows, test, F.lit(True)).collect()} == {(1, "a")}


def test_answers(spark):
    final = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.5, 2), (2, "c", 0.3, 1)], "question_id int, record_id string, score double, final_rank int")
    given = spark.createDataFrame([(1, "b", 1.0)], "question_id int, record_id string, given double")
    order = {r.record_id: r.final_rank for r in answers.reorder(final, given).collect()}
    assert order == {"b": 1, "a": 2, "c": 1}
    near = spark.createDataFrame([(1, "x", 0.3), (1, "y", 0.2), (2, "x", 0.5)], "question_id int, cached_id string, distance double")
    assert {r.question_id: (r.cached_id, r.hit) for r in answers.nearest_cached(near).collect()} == {1: ("y", True), 2: ("x", False)}
    questions = spark.createDataFrame([("f", "What  Is it?"), ("f", "other")], "fingerprint string, question string")
    nothing = spark.createDataFrame([], "cache_key string, answer string")
    keys = [r.cache_key for r in answers.cached(questions, nothing, "v1")[1].collect()]
    cache = spark.createDataFrame([(keys[0], "told")], "cache_key string, answer string")
    again = spark.createDataFrame([("f", " what is IT? "), ("f", "other")], "fingerprint string, question string")
    hits, misses = answers.cached(again, cache, "v1")
    assert hits.first()["answer"] == "told" and misses.count() == 1
    assert answers.cached(again, cache, "v2")[0].count() == 0


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def test_sessions_and_expiry(spark):
    events = spark.createDataFrame([(1, at(0)), (1, at(23)), (1, at(47)), (2, at(5)), (3, None)], "user_id int, ts timestamp")
    got = {(r.user_id, r.session_no): r.touches for r in retention.sessions(events, "user_id", "ts").collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (2, 1): 1}  # 24 hours to the instant is a new session
    now = F.lit(at(10))
    documents = spark.createDataFrame([("a", "u", at(1), at(10), "p1"), ("b", "u", at(2), at(11), "p2"), ("c", "v", at(1), None, "p3")], "document_id string, owner string, last_activity_at timestamp, expires_at timestamp, path string")
    keep, gone = retention.active_workspaces(documents, now)
    assert {r.document_id for r in keep.collect()} == {"b", "c"} and {r.document_id for r in gone.collect()} == {"a"}
    indexes = spark.createDataFrame([("a", "fa"), ("b", "fb"), ("x", "fx")], "document_id string, fingerprint string")
    uploads = spark.createDataFrame([("p1",), ("p2",), ("p9",)], "path string")
    caches = spark.createDataFrame([("fa",), ("fb",)], "fingerprint string")
    traces = spark.createDataFrame([("b", at(9)), ("b", at(12)), ("a", None)], "document_id string, expires_at timestamp")
    swept = retention.sweep(documents, indexes, uploads, caches, traces, now)
    assert {r.category: r.deleted for r in retention.sweep_summary(swept).collect()} == {"documents": 1, "indexes": 2, "uploads": 2, "caches": 1, "traces": 2}
    old = spark.createDataFrame([(None, None, at(0), None, '{"owner": "u", "last_activity_at": "bad"}')], "owner string, last_activity_at timestamp, created_at timestamp, expires_at timestamp, metadata string")
    row = retention.backfill(old).first()
    assert row.owner == "u" and row.last_activity_at == at(0) and row.expires_at == at(24)


def test_session_stream(spark, tmp_path):
    rows = [(1, at(0)), (1, at(24)), (1, at(30)), (2, at(1)), (9, at(200))]
    spark.createDataFrame(rows, "user_id int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.events_stream(spark, str(tmp_path / "in"), "user_id int, ts timestamp")
    query = streaming.write_batches(streaming.session_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = {(r.user_id, r.first_at): (r.expires_at, r.touches) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1, at(0)] == (at(24), 1) and got[1, at(24)] == (at(54), 2) and got[2, at(1)] == (at(25), 1)


def test_trace_sweeper(spark, tmp_path):
    traces = spark.createDataFrame([(1, at(1)), (2, at(50)), (3, None)], "trace_id int, expires_at timestamp")
    records = files.store(spark, str(tmp_path), "traces")
    records.save(traces)
    spark.createDataFrame([(at(1),)], "now timestamp").write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("now timestamp").parquet(str(tmp_path / "ticks"))
    streaming.trace_sweeper(ticks, str(tmp_path), str(tmp_path / "check")).awaitTermination(120)
    assert {r.trace_id for r in records.rows().collect()} == {2, 3} and records.versions() == [0, 1]


def docx(paragraphs):
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.docx").write_bytes(docx(["First", " ", "Second"]))
    (tmp_path / "in/a.docx").write_bytes(docx([" "]))
    (tmp_path / "in/c.txt").write_text("x")
    rows = files.read_pages(spark, str(tmp_path / "in"), glob="*.docx").collect()
    assert [(r.file_name, r.page_label, r.text, r.page_count) for r in rows] == [("b.docx", "Document", "First\nSecond", 1)]
    assert [r.file_name for r in files.list_files(spark, str(tmp_path / "in")).collect()] == ["a.docx", "b.docx"]
    with pytest.raises(Exception, match="unsupported file type"):
        files.read_pages(spark, str(tmp_path / "in"), glob="*.txt").collect()
    assert files.backend_of("nonsense") == "pypdf"
    table = spark.createDataFrame([("f1", 1), ("f2", 2)], "fingerprint string, x int")
    files.write_artifacts({"chunks": table, "edges": table}, str(tmp_path / "store"), "v1")
    assert files.read_artifacts(spark, str(tmp_path / "store"), ("chunks", "edges"), "v1", "f1")["chunks"].first()["x"] == 1
    assert files.read_artifacts(spark, str(tmp_path / "store"), ("chunks", "missing"), "v1", "f1") is None
    assert files.read_artifacts(spark, str(tmp_path / "store"), ("chunks",), "v2", "f1") is None
    (tmp_path / "m.json").write_bytes(b'\xef\xbb\xbf{"suite_id": "s", "questions": [{"question_id": "q", "answerable": true}]}')
    assert files.read_manifest(spark, str(tmp_path / "m.json")).first()["questions"][0]["answerable"] is True
    flat = files.flatten_metadata(spark.createDataFrame([(["a", "b"], {"k": 1})], "x array<string>, y map<string,int>")).first()
    assert (flat.x, flat.y) == ("a | b", '{"k":1}')
    assert {(r.fingerprint, r.x) for r in files.upsert(table, spark.createDataFrame([("f1", 9)], "fingerprint string, x int"), ["fingerprint"]).collect()} == {("f1", 9), ("f2", 2)}


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1, "Page 2", "Alpha beta"), (1, 2, "Page 3", "gamma")], "question_id int, rank int, page_label string, text string")
    labels = spark.createDataFrame([(1, ["Page 3"], ["ALPHA", "delta"]), (2, ["Page 1"], [])], "question_id int, expected_pages array<string>, expected_fragments array<string>")
    got = {r.question_id: (r.hit, r.reciprocal_rank, r.fragment_recall) for r in evaluate.question_metrics(results, labels).collect()}
    assert got == {1: (1, 0.5, 0.5), 2: (0, 0.0, 0.0)}
    values = spark.createDataFrame([(float(i),) for i in range(1, 12)], "v double")
    row = evaluate.latency_summary(values, "v").first()
    assert (row.p95, row.p95_floor, row["mean"]) == (11.0, 10.0, 6.0)
    scope = spark.createDataFrame([(1, True), (1, False), (2, True), (3, None)], "question_id int, in_scope boolean")
    assert {r.question_id: (r.precision, r.compliant) for r in evaluate.scope_compliance(scope).collect()} == {1: (0.5, False), 2: (1.0, True), 3: (0.0, False)}
    before, after = spark.createDataFrame([(1, 0.1), (2, 0.5)], "q int, m double"), spark.createDataFrame([(1, 0.2), (2, 0.5)], "q int, m double")
    assert tuple(evaluate.changes(before, after, ["q"], "m").first())[:3] == (1, 0, 1)


def test_routes(spark, enriched):
    sections = written(structure.build_sections(enriched), "sections")
    synopses = written(topology.build_synopses(written(structure.profile_sections(sections), "profiles")), "synopses")
    edges = written(topology.build_edges(synopses), "edges")
    chunks = chunking.chunk_pages(enriched, 200, 40).drop("section_kind", "content_type", "section_path")
    chunks = written(structure.join_section_metadata(chunks, sections), "chunks")
    asked = [(1, "d", "How long is the waiting period on page 2?"), (2, "d", "What is this paper about?"), (3, "d", "How many years do rates rise?"), (4, "e", "Compare the rates of both years")]
    questions = spark.createDataFrame(asked, "question_id int, document_id string, question string")
    plans, final, grades = routes.route_all(questions, chunks, synopses, edges)
    used = {r.question_id: r.route_used for r in plans.collect()}
    assert used == {1: "chunk_first", 2: "global_summary_first", 3: "synopsis_first", 4: "synopsis_first"}
    rows = final.collect()
    assert grades.count() == 4 and len({(r.question_id, r.record_id) for r in rows}) == len(rows)
    assert next(r for r in rows if r.question_id == 1 and r.final_rank == 1).text.find("waiting period") >= 0
    assert {r.record_id[0] for r in rows if r.question_id == 4} == {"e"}
    from lodestone.functions import questions as Q

    row = questions.select(Q.answer_focus("question").alias("f"), Q.starters(F.lit("thesis_document")).alias("s")).first()
    assert row.f == [] and row.s[0].endswith("this thesis?")
    assert sections.join(synopses.select("section_id", topology.synopsis_search_text().alias("t")), "section_id").where("t = ''").count() == 0
