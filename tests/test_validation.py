"""Manifests' defaults, and each rule for suites."""

import json

import pytest

from lodestone.operators.validation import problems, read_suite


def write(tmp_path, body, bom=False):
    path = tmp_path / "my.suite.json"
    path.write_text(json.dumps(body), encoding="utf-8-sig" if bom else "utf-8")
    return str(path)


GOOD_DOCUMENT = {"document_id": "d", "path": "d.pdf"}
GOOD_QUESTION = {"question_id": "q", "document_id": "d", "question": "?", "intent_type": " lookup ", "gold_answer": "yes"}


def test_defaults(spark, tmp_path):
    suite, documents, questions = read_suite(spark, write(tmp_path, {"documents": [GOOD_DOCUMENT, {"document_id": "e", "path": "e", "type": "policy", "used_for_tuning": " Yes "}], "questions": [GOOD_QUESTION, {"question_id": 5, "document_id": "d", "question": "x", "answerable": False}]}, bom=True))
    s = suite.first()
    assert (s.suite_id, s.description, s.frozen, s.top_k, s.max_chars) == ("my.suite", "", False, 5, 600)
    assert [(r.document_type, r.used_for_tuning, r.source) for r in documents.collect()] == [("unknown", False, ""), ("policy", True, "")]
    assert [(r.question_id, r.intent_type, r.answerable, r.expected_regions, r.gold_answer) for r in questions.collect()] == [("q", "lookup", True, [], "yes"), ("5", "", False, [], "")]


def test_a_given_suite(spark, tmp_path):
    body = {"suite_id": "s", "frozen": "on", "context_budget": {"top_k": 3}, "documents": [GOOD_DOCUMENT], "questions": [GOOD_QUESTION]}
    suite, documents, questions = read_suite(spark, write(tmp_path, body))
    s = suite.first()
    assert (s.suite_id, s.frozen, s.top_k, s.max_chars) == ("s", True, 3, 600)
    files = spark.createDataFrame([("d.pdf",)], "path string")
    assert problems(suite, documents, questions, files).collect() == []


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ({"documents": [], "questions": [GOOD_QUESTION]}, {("no documents", ""), ("unknown document", "q")}),
        ({"documents": [GOOD_DOCUMENT]}, {("no questions", "")}),
        ({"context_budget": {"top_k": 0, "max_chars_per_context": -1}, "documents": [GOOD_DOCUMENT], "questions": [GOOD_QUESTION]}, {("top_k not positive", "s"), ("max_chars not positive", "s")}),
        ({"documents": [GOOD_DOCUMENT, GOOD_DOCUMENT], "questions": [GOOD_QUESTION]}, {("duplicate document", "d")}),
        ({"documents": [GOOD_DOCUMENT | {"used_for_tuning": 1}], "questions": [GOOD_QUESTION]}, {("used for tuning", "d")}),
        ({"documents": [GOOD_DOCUMENT | {"path": "gone.pdf"}], "questions": [GOOD_QUESTION]}, {("no file", "d")}),
        ({"documents": [GOOD_DOCUMENT], "questions": [GOOD_QUESTION, GOOD_QUESTION]}, {("duplicate question", "q")}),
        ({"documents": [GOOD_DOCUMENT], "questions": [GOOD_QUESTION | {"document_id": "z"}]}, {("unknown document", "q")}),
        ({"documents": [GOOD_DOCUMENT], "questions": [GOOD_QUESTION | {"intent_type": "other"}]}, {("unknown intent", "q")}),
        ({"documents": [GOOD_DOCUMENT], "questions": [GOOD_QUESTION | {"intent_type": "unsupported"}]}, {("unsupported but answerable", "q")}),
        ({"documents": [GOOD_DOCUMENT], "questions": [GOOD_QUESTION | {"answerable": "no"}]}, {("no reason", "q")}),
        ({"documents": [GOOD_DOCUMENT], "questions": [GOOD_QUESTION | {"gold_answer": ""}]}, {("nothing to judge by", "q")}),
        ({"documents": [GOOD_DOCUMENT], "questions": [GOOD_QUESTION | {"gold_answer": "", "expected_regions": [{"page_label": "Page 1"}]}]}, set()),
    ],
)
def test_each_rule(spark, tmp_path, body, want):
    files = spark.createDataFrame([("d.pdf",)], "path string")
    got = problems(*read_suite(spark, write(tmp_path, {"suite_id": "s"} | body)), files)
    assert {(r.rule, r.subject) for r in got.collect()} == want
