"""What the index build moves: a text once, and what is found out about it without it."""

from pyspark.sql import functions as F

from lodestone.operators import chunking, scan, structure
from lodestone.sources import tables
from lodestone.streaming import indexing

TEXTS = ["1 Scope\nThe plan covers all members of the fund.", "Abstract\nShort.", "ARTICLE ONE\n" + "All new members wait for thirty days. " * 60]


def test_texts_move_once_and_nothing_is_left_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    wrote, dealt, write, deal = [], [], tables.written, tables.bucketed
    for module in (indexing, chunking, structure, scan):
        monkeypatch.setattr(module, "written", lambda df, name: wrote.append((name, df.columns)) or write(df, name), raising=False)
        monkeypatch.setattr(module, "bucketed", lambda df, name, *keys: dealt.append((name, keys)) or deal(df, name, *keys), raising=False)
    store = indexing.IndexStore(f"{tmp_path}/store")
    store.add(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate([*TEXTS, TEXTS[0]])], "file_name string, text string"), 0)
    assert not [name for name, columns in wrote if "text" in columns]
    assert dealt == [("pages", ("document_id", "page_no")), ("found", ("document_id", "page_no"))]
    assert {p.name for p in (tmp_path / "shared").glob("*") if not p.name.startswith(".")} == set()
    assert sorted((r.file_name, r.chars) for r in store.table(spark, "catalogue").collect()) == [(f"f{i}", len(t)) for i, t in enumerate(TEXTS)]


def test_chunks_number_through_the_pages_of_a_document(spark):
    """No chunk is dealt again to count those before it: pages hand on their numbers."""
    table = "Table 1 Rates\na | 1 | 2 | 3\nb | 4 | 5 | 6\nc | 7 | 8 | 9"
    texts = {("a", 1): "one\n" * 700, ("a", 2): table, ("a", 3): "last words", ("b", 1): table, ("b", 2): "x " * 2000}
    rows = [(d, p, f"Page {p}", t, "", "general") for (d, p), t in texts.items()]
    pages = spark.createDataFrame(rows, "document_id string, page_no int, page_label string, text string, section_heading string, section_kind string")
    chunks = chunking.chunk_pages(pages)
    found = chunks.orderBy("document_id", "page_no", F.col("artifact_type").isNull(), "kind_no", "at").collect()
    for name in "ab":
        own = [r.chunk_index for r in found if r.document_id == name]
        assert own == list(range(len(own))) and len(own) > 3
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
