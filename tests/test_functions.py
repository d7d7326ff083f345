"""Column functions on small hand-written lines, headings and questions."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import questions as Q
from lodestone.functions import rules as R
from lodestone.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def get(column):
        return one.select(column.alias("x")).first()["x"]

    return get


def lit(x):
    return F.lit(x)


def cut(text, size, overlap):
    """The windows, by a loop."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (10, 0), (5, 5), (4, 9), (1, 0)])
def test_windows(value, size, overlap):
    for n in (0, 1, 4, 5, 9, 10, 11, 23, 40):
        text = ("abc def  ghi\tjkl mno " * 3)[:n]
        assert value(T.windows(lit(text), size, overlap)) == cut(text, size, overlap)


def test_lines_and_sentences(value):
    assert value(T.lines(lit(" a \r\n\n b\x0bc d "))) == ["a", "b", "c", "d"]
    assert value(T.sentences(lit("One.  Two!\nThree? Four"))) == ["One.", "Two!", "Three?", "Four"]
    assert value(T.title_case(lit("don't A-b mixed"))) == "Don'T A-B Mixed"
    assert value(T.first_distinct(F.array(lit("A b"), lit(" a  B."), lit(""), lit("c")))) == ["A b", "c"]
    assert [value(T.roman_number(lit(x))) for x in ("IV", "xii", "XL", "M", "")] == [4, 12, 40, None, None]
    assert value(T.page_number(lit("Page 12"))) == 12 and value(T.page_number(lit("Document"))) is None
    assert value(T.parse_time(lit("2024-01-01T00:00:00Z"))) is not None and value(T.parse_time(lit("soon"))) is None
    assert value(T.without_references(lit("Answer.\n\nReferences:\n[1] x"))) == "Answer."


def test_overlap(value):
    assert value(T.keyword_overlap(lit("What are claims limits?"), lit("the claims have limits"))) == pytest.approx(2 / 3)
    assert value(T.keyword_overlap(lit("a of"), lit("x"))) == 0.0
    assert set(value(T.significant_terms(lit("What policies cover studies?")))) == {"policies", "policie", "policy", "cover", "studies", "studie", "study"}
    assert value(T.content_overlap(lit("policies"), lit("one policy"))) == pytest.approx(1 / 3)


def test_line_kinds(value):
    assert [value(R.is_page_artifact(lit(x))) for x in ("xiv", "12", "Page 3", "NIH Author Manuscript", "Foo page 3", "Results")] == [True] * 5 + [False]
    assert value(R.is_author_line(lit("Jane Doe1, John Roe2"))) and value(R.is_author_line(lit("a@b.c"))) and not value(R.is_author_line(lit("Study Design")))
    assert value(R.is_reference_line(lit("12. Smith J"))) and value(R.is_reference_line(lit("Smith et al. 2020"))) and not value(R.is_reference_line(lit("Smith")))
    assert value(R.is_sentence_like(lit("this is a line with many words"))) and not value(R.is_sentence_like(lit("A Short Title")))
    assert value(R.is_tabular_line(lit("Rate  12  13"))) and not value(R.is_tabular_line(lit("Rate 12 13")))
    assert value(R.is_table_caption(lit("Table 2: Rates"))) and not value(R.is_table_caption(lit("Table of contents")))
    assert value(R.is_noise_line(lit("doi 10.1"))) and not value(R.is_noise_line(lit("Plain words")))


def test_headings(value):
    assert value(R.page_heading(lit("1. INTRODUCTION ....... 3"))) in ("", "Introduction")
    assert value(R.page_heading(lit("2 Future Work"))) == "Future Work"
    assert value(R.page_heading(lit("appendix b tables"))) == "Appendix B Tables"
    for x, is_one in (("Methodology", True), ("3.2 Waiting Periods", True), ("1 Study Design and Data", True), ("the cat sat on the mat today", False), ("12", False), ("EXCLUSIONS AND LIMITS", True)):
        assert value(R.is_heading(lit(x))) is is_one, x
    kinds = {"Appendix A": "appendix", "4 Results": "results", "Main conclusions": "conclusion", "Our Methods": "methodology", "Scope": "general"}
    assert {k: value(R.section_kind(lit(k))) for k in kinds} == kinds
    assert value(R.content_type(lit("Exclusions"), lit("not covered"), lit("general"))) == "exclusion"
    assert value(R.document_style(lit("policy sum insured waiting period"))) == "policy_document"
    assert value(R.document_style(lit("plain"))) == "generic_longform"
    assert value(R.canonical_section_heading(lit("noise\n3.1 waiting period: thirty days"))) == "Waiting Period"
    assert value(R.best_title(lit(""), lit("12\nStudy Design\nmore text here."), lit("Page 1"))) == "Study Design"


def test_chunk_roles(value):
    roles = {
        "": "navigation_like",
        "Contents\nIntro .... 3": "navigation_like",
        "Smith et al. report": "reference_like",
        "12 13 14\n15 16 17": "table_fragment",
        "STUDY DESIGN": "heading_stub",
        "This is a body sentence. It says something.": "body",
    }
    assert {k: value(R.chunk_role(lit(k)))["role"] for k in roles} == roles
    matter = value(R.front_matter(lit("Contents"), lit(""), lit("Page 2")))
    assert (matter["kind"], matter["score"], matter["low_value"]) == ("contents", 0.98, True)
    assert value(R.front_matter(lit("x"), lit("a project report submitted"), lit("Page 1")))["kind"] == "title_page"
    assert value(R.region_kind(lit("Results and findings"), lit("text"))) == "evidence"
    assert value(R.section_role(lit("Methods"), lit(""), lit("body")))["role"] == "method"


@pytest.mark.parametrize(
    ("question", "kind", "intent", "spread"),
    [
        ("What is the waiting period?", "definition_lookup", "lookup", "atomic"),
        ("Compare plan A versus plan B", "comparison_lookup", "comparison", "distributed"),
        ("What is this paper about?", "summary_lookup", "summary", "global"),
        ("How many patients were enrolled?", "numeric_lookup", "numeric", "sectional"),
        ("How do I file a claim?", "process_lookup", "procedure", "sectional"),
        ("Who signed it on page 4?", "general_lookup", "lookup", "atomic"),
        ("Tell me about rules across plans", "cross_cutting_lookup", "cross_cutting", "distributed"),
    ],
)
def test_profiles(value, question, kind, intent, spread):
    p = value(Q.profile(lit(question)))
    assert (p["query_type"], p["intent_type"], p["evidence_spread"]) == (kind, intent, spread)


def test_filters_and_plans(value):
    assert value(Q.page_labels(lit("See pages 3 and page 12"))) == ["Page 3", "Page 12"]
    assert value(Q.clause_terms(lit("under clause 4.2.1"))) == ["4.2.1"]
    assert value(Q.section_filter(lit('In the "Waiting Periods" section what applies?'))) == ["Waiting Periods"]
    assert value(Q.section_filter(lit("in the results chapter what is shown"))) == ["results chapter"]
    p = Q.profile(lit("What is on page 2?"))
    mode = Q.constraint_mode(lit("What is on page 2?"), p)
    assert value(mode) == "hard_region" and value(Q.preferred_route(mode, p)) == "chunk_first"
    assert value(Q.plan_confidence(lit("What is on page 2?"), mode, p, F.lit(False))) == pytest.approx(0.92)
    assert value(Q.definition_target(lit("Define the grace period?"))) == "grace period"
    assert value(Q.summary_focus(lit("What are the key findings?"))) == "findings"
    low = value(Q.fact_signal(lit("When was it signed?"), lit("nothing"), lit("general_lookup")))
    high = value(Q.fact_signal(lit("When was it signed?"), lit("It was signed on March 3, 2021."), lit("general_lookup")))
    assert high - low >= 0.3
