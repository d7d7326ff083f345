"""What page structure and chunking leave undone, and that it changes no result."""

from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as T
from lodestone.operators import chunking, structure

WHITE = [chr(c) for c in range(0x3100) if chr(c).isspace() and not 0x1C <= c <= 0x1F]


def test_white_space_as_the_patterns_see_it(spark):
    texts = ["", " ", "a b", "a  b", "a \tb", "\t a\n", "a​b᠎", "\x1ca\x1f", *[f"{w}a{w}b {w}c{w} {w}" for w in WHITE]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.trim(F.regexp_replace("t", r"(?U)\s+", " ")), F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    for r in rows.select("t", T.squash("t").alias("a"), old[0].alias("b"), T.strip("t").alias("c"), old[1].alias("d")).collect():
        assert (r["a"], r["c"]) == (r["b"], r["d"]), repr(r["t"])


def test_long_lines_are_no_headings_by_the_full_test_either(spark):
    words = "Alpha beta Gamma delta Epsilon zeta Eta theta Iota kappa Lambda mu Nu xi Omicron pi".split()
    texts = [" ".join(words[:n]) + end for n in (9, 12, 14, 15, 16) for end in ("", ".", " ..... 12", " - 3 : 4", " x")]
    texts += ["1.2 " + " ".join(words), "12 " + " ".join(words), "- : " + " ".join(words), "APPENDIX " + " ".join(words), " ".join(words).upper(), "1 Abstract", ": Future  Work", "results ..... 7", "- " * 20 + "A", "A " + "1 " * 20]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    full = T.let(R.heading_text("t"), lambda text: T.let(T.words(text), lambda w: R.heading_test(F.col("t"), text, w)))
    for r in rows.select("t", R.is_heading("t").alias("a"), full.alias("b"), F.col("t").rlike(R.LONG_LINE).alias("long")).collect():
        assert r["a"] == r["b"], r["t"]


def test_prose_gets_no_title_and_late_lines_no_text(spark):
    prose = "these words of a line are only prose and go on for more than a dozen and then some"
    pages = spark.createDataFrame([("d", 0, "\n".join(["Results", *[prose] * 12, "Late Heading"]))], "document_id string, page_no int, text string")
    facts = structure.line_facts(pages).first()["facts"]
    assert [f["kind"] for f in facts] == ["known", *["text"] * 12, "heading"]
    assert facts[0]["title"] == "Results" and facts[0]["section"] == "results" and facts[0]["line"] == "Results"
    assert all(f["title"] is None and f["section"] is None and f["line"] is None for f in facts[1:13])
    assert facts[13]["title"] == "Late Heading" and facts[13]["line"] is None and facts[13]["prose"] is None


def test_only_pages_that_can_have_tables_are_spread(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(chunking, "written", lambda df, name: kept.append((name, df.select("page_no").collect())) or df, raising=False)
    table = "Table 1 Rates\na | 1 | 2 | 3\nb | 4 | 5 | 6\nc | 7 | 8 | 9"
    runs = "x\na | 1 | 2 | 3\nb | 4 | 5 | 6\nc | 7 | 8 | 9"
    texts = ["plain prose\nand more of it", table, runs, "a | 1 | 2 | 3\nb | 4 | 5 | 6"]
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "document_id string, page_no int, text string")
    found = {r["page_no"]: r["text"] for r in chunking.table_blocks(pages).collect()}
    assert found == {1: table, 2: runs.removeprefix("x\n")}
    assert [(n, sorted(r["page_no"] for r in rows)) for n, rows in kept] == [("tabular", [1, 2])]
