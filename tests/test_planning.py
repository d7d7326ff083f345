"""Plans that models have a say in, evidence selection, answers, suites and stores on small tables."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers, evaluate, planning, retention, routes, suites, topology
from lodestone.sources import files

SYNOPSES = "document_id string, section_id string, ordinal int, title string, synopsis string, region_kind string, page_labels array<string>, key_terms array<string>, section_path array<string>, section_kind string, front_matter_kind string, front_matter_score double, low_value boolean, chapter_number string, chapter_title string, section_role string"


def synopsis(n, title, kind, chapter=("", ""), low=False, matter="", role="", terms=()):
    return ("d", f"s{n}", n, title, f"{title} text", kind, [f"Page {n}"], list(terms), [title], "general", matter, 0.0, low, *chapter, role)


@pytest.fixture(scope="module")
def synopses(spark):
    two, three = ("2", "Claims Handling"), ("3", "Renewal")
    rows = [
        synopsis(1, "Contents", "general", matter="contents"), synopsis(2, "Overview", "overview", two, role="overview"), synopsis(3, "Filing Claims", "procedure", two), synopsis(4, "Chapter Summary", "discussion", two),
        synopsis(5, "Renewal Terms", "rules", three), synopsis(6, "Grace", "rules", three), synopsis(7, "Loose Notes", "general"), synopsis(8, "Old Index", "general", low=True),
    ]
    return spark.createDataFrame(rows, SYNOPSES)


QUESTIONS = ["How are claims filed?", "What does the Claims Handling chapter conclude, in summary?", "Give an overview of the whole document.", "What is on page 5?", "Compare renewal and grace across sections."]


@pytest.fixture(scope="module")
def plans(spark, synopses):
    return routes.plan(spark.createDataFrame([(str(i), "d", q) for i, q in enumerate(QUESTIONS)], "question_id string, document_id string, question string"), synopses)


def scope(i, attempt, ids, strictness, confidence=0.9, focus=(), query="", fallback=None):
    return (str(i), attempt, ids, strictness, confidence, query, list(focus), None, None, None, "synopsis_first", fallback, "because")


def test_scopes_that_can_be_enforced(spark, synopses, plans):
    told = [
        scope(0, 1, ["s3", "s9", "s1", "s3", "s8"], "soft", fallback="yes"),  # unknown, repeated and worthless ones go
        scope(1, 1, ["s3", "s5", "s2"], "hard"),  # one chapter: the one that the question names; its summary sections
        scope(2, 1, ["s2"], "strict"),  # hard, but the question binds itself to nothing
        scope(2, 2, ["s2", "s3", "s4"], "soft"),  # the second attempt holds
        scope(3, 1, ["s1"], "soft", 0.5),  # not sure enough
        scope(4, 1, [], "soft"),
    ]
    found = {r.question_id: r for r in planning.scoped_plans(plans, spark.createDataFrame(told, planning.SCOPE_ANSWERS), synopses).collect()}
    assert set(found) == {"0", "1", "2"}
    assert found["0"].allowed == ["s3"] and found["0"].mode == "soft_local" and found["0"].strictness == "soft" and found["0"].fallback
    assert found["1"].strictness == "hard" and found["1"].mode == "hard_region" and found["1"].route == "chunk_first" and not found["1"].fallback and found["1"].kinds == []
    assert found["1"].answer_focus == ["summary"] and found["1"].allowed == ["s4", "s2"]  # scores 4 + 3 + 2, then 2 + 2 + 2
    assert found["2"].mode == "soft_multi_region" or found["2"].allowed == ["s4", "s2"]
    merged = {r.question_id: r for r in planning.merged_plans(plans, synopses, spark.createDataFrame(told, planning.SCOPE_ANSWERS)).collect()}
    assert {k: r.planner_source for k, r in merged.items()} == {"0": "llm_orchestrator", "1": "llm_orchestrator", "2": "llm_orchestrator", "3": "deterministic", "4": "deterministic"}
    assert merged["3"].strictness == "none" and merged["3"].allowed == []


def test_coherent_scopes(spark):
    rows = [("a", 0, "x", "2", "claims", ["claims"]), ("a", 1, "y", "3", "renewal", ["claims"]), ("b", 0, "x", "2", "claims", ["other"]), ("b", 1, "y", "3", "renewal", ["other"]), ("c", 0, "x", "", "", ["other"]), ("c", 1, "y", "", "", ["other"]), ("d", 0, "x", "2", "claims", ["zzz"]), ("d", 1, "y", "2", "claims", ["zzz"]), ("e", 4, "x", "2", "", [])]
    got = {r.question_id: r.scope_ids for r in planning.coherent(spark.createDataFrame(rows, "question_id string, pos int, section_id string, number string, chapter string, words array<string>")).collect()}
    assert got == {"a": ["x"], "b": [], "c": ["x"], "d": ["x", "y"], "e": ["x"]}


def test_told_and_routed_plans(spark, synopses, plans):
    before = {r.question_id: r for r in plans.collect()}
    told = [("0", " Numeric ", "zzz", None, "HYBRID_BOTH", "soft_local", ["evidence", "zzz", "Evidence"], None, "no", 0.4), ("3", None, None, None, "synopsis_first", "none", ["rules"], None, None, None), ("2", None, None, None, None, None, None, None, None, None)]
    got = {r.question_id: r for r in planning.told_plans(plans, spark.createDataFrame(told, planning.PLAN_ANSWERS)).collect()}
    assert got["0"].p.intent_type == "numeric" and got["0"].p.query_type == before["0"].p.query_type and got["0"].route == "hybrid_both" and got["0"].kinds == ["evidence"] and got["0"].mode == "soft_local" and not got["0"].fallback
    assert got["0"].confidence == max(before["0"].confidence, 0.4)
    assert "2" not in got and ("3" not in got or got["3"].mode == "hard_region" and got["3"].route == "chunk_first")
    unsure = plans.withColumn("confidence", F.lit(0.5))
    routed = {r.question_id: r for r in planning.routed_plans(unsure, spark.createDataFrame([(str(i), "section_first" if i != 2 else "nowhere") for i in range(5)], "question_id string, route string")).collect()}
    assert all(r.route == "section_first" and r.confidence == 0.72 and r.p.evidence_spread == "distributed" for r in routed.values()) and "4" in routed
    assert planning.routed_plans(plans.withColumn("confidence", F.lit(0.9)), spark.createDataFrame([("4", "section_first")], "question_id string, route string")).count() == 0


FINAL = "question_id int, record_id string, final_rank int, score double, dense double, lexical double, text string, section_kind string, page_label string, section_id string"


def test_select_evidence(spark):
    rows = [(q, f"c{k}", k + 1, 1 - k / 10, 0.1, 0.2, f"text {k}\nmore", kind, page, f"s{k}") for q in (1, 2, 3) for k, (kind, page) in enumerate([("references", "p1"), ("body", "p1"), ("results", "p2"), ("body", "p2"), ("body", "p3")])]
    final = spark.createDataFrame(rows, FINAL)
    plans = spark.createDataFrame([(1, "global", "none", [], []), (2, "atomic", "hard", ["s3"], ["summary"]), (3, "global", "none", [], [])], "question_id int, spread string, strictness string, allowed array<string>, answer_focus array<string>")
    given = spark.createDataFrame([(1, "c0", 0.9), (1, "c1", 0.4), (2, "c3", 0.9)], "question_id int, record_id string, given double")
    chosen = spark.createDataFrame([(1, 0, "c1"), (1, 1, "zzz"), (1, 2, "c1"), (2, 0, "c1")], "question_id int, pos int, record_id string")
    got = {}
    for r in answers.select_evidence(final, plans, given, chosen).orderBy("question_id", "final_rank").collect():
        got.setdefault(r.question_id, []).append(r.record_id)
    # Summary: the pick after the best section that sums up, then the best of the rest (c0 is .25 + .675 - .28).
    assert got[1][:2] == ["c2", "c1"] and sorted(got[1]) == sorted(got[3]) and got[3] == ["c0", "c1", "c2", "c3", "c4"]
    assert got[2][:2] == ["c1", "c3"]
    pruned = answers.select_evidence(final, plans, given, chosen, prune=True).where("question_id = 2")
    assert [r.record_id for r in pruned.orderBy("final_rank").collect()] == ["c1", "c3"]
    cited = {r.question_id: r.details for r in answers.citations(final).collect()}
    assert cited[1][:2] == ["[1] p1", "[2] p1"]


def test_model_answers(spark):
    told = spark.createDataFrame([(k, "q", "own", ["c"], True, s) for k, s in enumerate(["strong", "strong", "weak", "strong", "unsupported", "strong"])], "question_id int, question string, answer string, evidence array<string>, supported boolean, evidence_status string")
    replies = [(0, json.dumps({"supported": True, "answer": "Yes."})), (1, json.dumps({"supported": True, "answer": "It likely is.", "reason": "r"})), (2, json.dumps({"supported": False, "answer": "", "reason": ""})), (3, "no json"), (4, json.dumps({"supported": True, "answer": "x"}))]
    cited = spark.createDataFrame([(k, ["[1] p"]) for k in range(6)], "question_id int, details array<string>")
    got = {r.question_id: r for r in answers.model_answers(told, spark.createDataFrame(replies, "question_id int, reply string"), cited).collect()}
    assert got[0].answer == "Yes.\n\nReferences:\n- [1] p" and got[0].supported
    assert not got[1].supported and got[1].note.startswith("r The answer infers") and not got[2].supported and got[2].answer == answers.UNSUPPORTED and got[2].note == "The evidence is weak."
    assert not got[3].supported and got[3].answer == answers.UNSUPPORTED and got[4].answer == "own" == got[5].answer


def test_answer_all_recovers_once_and_caches(spark):
    asked = spark.createDataFrame([(1, "d", "f", "first"), (2, "d", "f", "second"), (3, "d", "f", "third")], "question_id int, document_id string, fingerprint string, question string")
    status = {1: "strong", 2: "unsupported", 3: "unsupported"}
    columns = "question_id int, record_id string, final_rank int, score double, dense double, lexical double, text string, page_label string"

    def once(q):
        ids = [r.question_id for r in q.collect()]
        return spark.createDataFrame([(i, f"c{i}", 1, 0.5, 0.1, 0.1, f"text {i}", "p") for i in ids], columns), spark.createDataFrame([(i, status[i]) for i in ids], "question_id int, evidence_status string")

    def again(q, final, grades):
        assert sorted(r.question_id for r in q.collect()) == [2, 3]
        return spark.createDataFrame([(2, "r2", 1, 0.6, 0.1, 0.1, "found", "p")], columns), spark.createDataFrame([(2, "weak")], "question_id int, evidence_status string")

    now = F.lit(datetime.datetime(2026, 1, 1)).cast("timestamp")
    out = answers.answer_all(asked, once, again, now)
    got = {r.question_id: r for r in out["answers"].collect()}
    assert (got[1].answer, got[2].answer, got[3].answer) == ("text 1", "found", None) and [got[k].supported for k in (1, 2, 3)] == [True, True, False] and not got[1].cache_hit
    traces = {r.question_id: json.loads(r.candidates) for r in out["traces"].collect()}
    assert traces[2][0]["chunk_id"] == "r2" and len(traces[1][0]) == 12 and "rerank_score" not in traces[1][0]  # nulls are left out
    status.clear()
    cached = answers.answer_all(asked, lambda q: (spark.createDataFrame([], columns), spark.createDataFrame([], "question_id int, evidence_status string")), lambda q, f, g: (spark.createDataFrame([], columns), spark.createDataFrame([], "question_id int, evidence_status string")), now, cache=out["cache"])
    assert {r.question_id: (r.answer, r.cache_hit) for r in cached["answers"].collect()} == {1: ("text 1", True), 2: ("found", True), 3: (None, True)}


def test_review_of_synopses(spark):
    base = ("d", "s", 1, "Claims", "short", ["a"], ["p"], "general", "general", "rules", "sum", "x" * 700, False, False, "policy_document", 1.0, ["noisy_titles"])
    schema = "document_id string, section_id string, ordinal int, title string, synopsis string, key_terms array<string>, section_path array<string>, section_kind string, content_type string, region_kind string, summary string, text string, low_value boolean, structure_repaired boolean, document_style string, structure_confidence double, repair_reasons array<string>"
    rows = spark.createDataFrame([base, ("e", *base[1:14], "generic_longform", *base[15:]), ("f", *base[1:13], True, "generic_longform", 0.5, []), ("g", *base[1:14], "research_paper", 0.9, ["weak_canonical_headings"])], schema)
    assert {r.document_id: r.q for r in rows.select("document_id", topology.synopsis_quality().alias("q")).collect()} == {k: 0.4 for k in "defg"}
    assert {r.document_id for r in topology.documents_to_review(rows).collect()} == {"d", "f", "g"}
    assert topology.documents_to_review(rows, "all").count() == 4 and topology.documents_to_review(rows, "off").count() == 0
    assert {r.document_id: r.priority for r in topology.review_synopses(rows).collect()} == {"d": 0.75}
    new = topology.rewritten(rows, spark.createDataFrame([("d", " s ", "better", [" a ", ""]), ("e", "s", "  ", [])], "document_id string, section_id string, synopsis string, key_terms array<string>"))
    assert {r.document_id: (r.synopsis, r.key_terms, r.written) for r in new.collect()}["d"] == ("better", ["a"], True) and new.where("written").count() == 1


def test_question_sets(spark):
    titles = ["Overview", "Claims Process", "claims process", "Table of Contents", "Budget 2021", "Results", "1234 Things", "Future Work", "Waiting Period [3]", "Word"]
    kinds = ["overview", "methods", "results", "general", "general", "results", "general", "future work", "general", "general"]
    sections = spark.createDataFrame([("d", k + 1, t, kinds[k], ["p"] * (1 + k % 2)) for k, t in enumerate(titles)], "document_id string, ordinal int, title string, section_kind string, page_labels array<string>")
    assert [r.title for r in suites.ranked_titles(sections).orderBy("rank").collect()] == ["Claims Process", "Results", "Future Work"]
    asked = [r.question for r in suites.question_sets(spark.createDataFrame([("d", "policy_document"), ("e", "none")], "document_id string, document_style string"), sections).where("document_id = 'd'").orderBy("number").collect()]
    assert len(asked) == 8 and asked[3] == "How does the document describe the approach or methods in Claims Process?" and asked[6] == "How do the sections Claims Process and Results connect in the document?"
    brief = spark.createDataFrame([("", ["A", "B"], "Page 2", "line one\n" + "x" * 200 + "\nline two\n\nthree\nfour")], "h string, p array<string>, l string, t string").select(suites.page_brief("h", "p", "l", "t").alias("b")).first().b
    assert brief.excerpt == "line one | line two | three" and brief.page_label == "Page 2"
    assert suites.long_enough(spark.createDataFrame([("x" * 30,), ("x" * 31,)], "text string")).count() == 1


def test_stores_and_reports(spark, tmp_path):
    records = files.store(spark, str(tmp_path), "documents")
    assert records.rows() is None and records.get("a") is None
    for rows in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)], [("d", 5)]):
        records.save(spark.createDataFrame(rows, "document_id string, n int"))
    assert {(r.document_id, r.n) for r in records.rows().collect()} == {("a", 1), ("b", 3), ("c", 4), ("d", 5)} and records.versions() == [1, 2]
    records.delete(spark.createDataFrame([("a",)], "document_id string"))
    assert records.get("a").count() == 0 and records.get("b").first().n == 3
    with pytest.raises(ValueError):
        files.store(spark, str(tmp_path), "nothing")
    assert files.latest_report(spark, str(tmp_path), "r") is None
    for n in (1, 2):
        files.save_report(spark.createDataFrame([(n,)], "n int"), str(tmp_path), "r", f"2026010{n}")
    assert files.latest_report(spark, str(tmp_path), "r").first().n == 2
    vectors = spark.createDataFrame([("chunks", "f", "c1", [0.5], ["x", "y"], {"k": 1})], "collection string, fingerprint string, record_id string, embedding array<double>, path array<string>, more map<string,int>")
    files.write_vectors(vectors, str(tmp_path / "v"))
    files.write_vectors(vectors, str(tmp_path / "v"))
    row = spark.read.parquet(str(tmp_path / "v")).collect()
    assert len(row) == 1 and row[0].embedding == [0.5] and row[0].path == "x | y" and json.loads(row[0].more) == {"k": 1}
    files.write_artifacts({"pages": spark.createDataFrame([("f", 1), ("g", 2)], "fingerprint string, n int")}, str(tmp_path / "a"), "v1")
    assert files.delete_artifacts(spark, str(tmp_path / "a"), ("pages",), "v1", "f") == 1 and files.read_artifacts(spark, str(tmp_path / "a"), ("pages",), "v1", "f") is None
    shown = files.safe_documents(spark.createDataFrame([("d", "n", "pdf", "/p", "f", 1, 2, '{"document_style": "s", "_secret": "x"}')], "document_id string, file_name string, file_type string, source_path string, fingerprint string, char_count int, page_count int, metadata string")).first()
    assert shown.metadata.asDict() == {"document_style": "s", "section_heading": None, "section_kind": None, "content_type": None}
    errors = spark.createDataFrame([("Error 429",), ("bad key",), ("Connection reset",)], "m string")
    assert [r.t for r in errors.select(files.is_transient("m").alias("t")).collect()] == [True, False, True]


def test_triggers_look_at_scope_and_gap(spark):
    final = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.45), (2, 1, 0.9), (3, 1, 0.5), (3, 2, 0.5), (4, 1, 0.9), (4, 2, 0.1), (5, 1, 0.9), (5, 2, 0.1)], "question_id int, final_rank int, score double")
    plans = spark.createDataFrame([(1, "global"), (2, "global"), (3, "global"), (4, "atomic"), (5, "sectional"), (6, "global")], "question_id int, spread string")
    grades = spark.createDataFrame([(1, "weak"), (2, "weak"), (3, "unsupported"), (4, "strong"), (5, "strong")], "question_id int, evidence_status string")
    got = {r.question_id: r for r in answers.selection_triggers(final, plans, grades).collect()}
    assert got[1].triggered and got[1].gap_trigger and got[1].weak_trigger and not got[2].triggered and not got[2].weak_trigger
    # Unsupported and ungraded questions are left out, and the spread is the plan's.
    assert not any([got[3].triggered, got[3].spread_trigger, got[3].gap_trigger]) and got[3].gap is None and not got[6].triggered
    assert not got[4].triggered and got[5].triggered and not got[5].gap_trigger
    assert {r.question_id for r in answers.selection_triggers(final, plans, grades, gap=1.0, on=("gap",)).where("triggered").collect()} == {1, 4, 5}
    assert evaluate.trigger_summary(answers.selection_triggers(final, plans, grades)).first().triggered == 2


@pytest.mark.parametrize(
    ("reply", "want"),
    [("true", True), ("false", False), ('"true"', True), ('"false"', True), ('""', False), ("0", False), ("1", True), ("0.5", True), ("null", False), ("[]", False), ("[0]", True), ("{}", False)],
)
def test_what_counts_as_support(spark, reply, want):
    rows = spark.createDataFrame([('{"supported": %s, "answer": "x"}' % reply,)], "reply string")
    assert rows.select(answers.is_true("reply", "$.supported").alias("v")).first().v is want


def test_no_support_without_json(spark):
    rows = spark.createDataFrame([("no json",), ('{"answer": "x"}',), (None,)], "reply string")
    assert [r.v for r in rows.select(answers.is_true("reply", "$.supported").alias("v")).collect()] == [None] * 3


def test_changed_questions_and_access(spark):
    one, two = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.2)], "q string, m double"), spark.createDataFrame([("a", 0.5), ("b", 0.75), ("c", 0.2)], "q string, m double")
    assert [(r.q, r.delta) for r in evaluate.changed_questions(one, two, ["q"], "m").collect()] == [("a", -0.5), ("b", 0.25)]
    day = datetime.datetime(2026, 1, 2)
    documents = spark.createDataFrame([("x", "u", datetime.datetime(2026, 1, 3)), ("y", "u", datetime.datetime(2026, 1, 1)), ("z", "v", None)], "document_id string, owner string, expires_at timestamp")
    asked = spark.createDataFrame([("x", "u"), ("y", "u"), ("z", "u"), ("none", "u"), ("z", "v"), ("y", "v")], "document_id string, user string")
    now = F.lit(day).cast("timestamp")
    assert {(r.document_id, r.user): r.status for r in retention.access(asked, documents, now).collect()} == {("x", "u"): 200, ("y", "u"): 410, ("z", "u"): 404, ("none", "u"): 404, ("z", "v"): 200, ("y", "v"): 404}
    assert {r.document_id for r in retention.with_visible_parent(asked.select("document_id").distinct(), documents, F.lit("u"), now).collect()} == {"x"}


def test_hard_scope_says_what_it_removed(spark):
    plans = spark.createDataFrame([(1, "hard", ["a"]), (2, "hard", []), (3, "soft", ["a"]), (4, "hard", ["z"]), (5, "hard", ["a"])], "question_id int, strictness string, targets array<string>")
    found = spark.createDataFrame([(1, "a", "r1"), (1, "b", "r2"), (1, None, "r3"), (2, "b", "r2"), (3, "b", "r2"), (4, "a", "r1"), (5, "a", "r1")], "question_id int, section_id string, record_id string")
    assert {(r.question_id, r.record_id) for r in routes.in_hard_scope(found, plans).collect()} == {(1, "r1"), (2, "r2"), (3, "r2"), (5, "r1")}
    named = plans.where("question_id IN (1, 5)").withColumn("allowed", F.when(F.col("question_id") == 1, F.array(F.lit("b"))).otherwise(F.expr("CAST(array() AS array<string>)")))
    assert {(r.question_id, r.record_id) for r in routes.in_hard_scope(found.where("question_id IN (1, 5)"), named).collect()} == {(1, "r2"), (5, "r1")}
    notes = {r.question_id: (r.removed, r.note) for r in routes.scope_notes(found, plans).collect()}
    assert notes == {1: (2, "Hard scope removed 2 candidates from outside."), 4: (1, "Hard scope removed 1 candidates from outside."), 5: (0, None)}


def test_answers_of_gone_documents_and_an_owners_listing(spark):
    cache = spark.createDataFrame([("k1", "f1"), ("k2", "f2"), ("k3", "f1")], "cache_key string, fingerprint string")
    assert [r.cache_key for r in answers.without_fingerprints(cache, spark.createDataFrame([("f1",), ("f9",)], "fingerprint string")).collect()] == ["k2"]
    at = datetime.datetime
    rows = [("x", "u", at(2026, 1, 5), at(2026, 1, 1)), ("y", "u", at(2026, 1, 5), at(2026, 1, 2)), ("z", "u", at(2026, 1, 2), at(2026, 1, 1)), ("v", "w", None, None), ("n", "u", None, None)]
    documents = spark.createDataFrame(rows, "document_id string, owner string, expires_at timestamp, last_activity_at timestamp")
    now = F.lit(at(2026, 1, 2)).cast("timestamp")
    assert [r.document_id for r in retention.listing(documents, F.lit("u"), now).collect()] == ["y", "x", "n"]


def test_objective_of_planned_retrieval(spark):
    rows = spark.createDataFrame([(1.0, 0.5, 1.0, 0.0, 1.0), (0.0, 0.0, 0.0, 1.0, 0.0)], "hit double, mrr double, section double, region double, plan double")
    got = [r.o for r in rows.select(evaluate.objective_b("hit", "mrr", "section", "region", "plan").alias("o")).collect()]
    assert got == pytest.approx([0.3 + 0.1 + 0.2 + 0.1, 0.2])
