"""Pages to chunks and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules as R
from ..functions.text import lines, raw_lines, strip, windows
from ..sources.tables import bucketed, written
from .scan import ranged

# How artifacts may be shown, and what they are worth as evidence.
VISIBILITY = {"table": "targeted_or_numeric", "footnote": "targeted_only", "front_matter": "targeted_only", "bibliography": "explicit_only"}
BODY_SCORE = {"table": 0.72, "footnote": 0.56, "front_matter": 0.48, "bibliography": 0.12}


def semantic_blocks(pages: DataFrame) -> DataFrame:
    """document_id, page_no, block, text: a block starts at a clause number or a line in capitals."""
    rows = pages.select("document_id", "page_no", F.posexplode(lines("text")).alias("line_no", "line"))
    order = W.partitionBy("document_id", "page_no").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    starts = F.when(R.starts_block("line") & (F.col("line_no") > 0), 1).otherwise(0)
    rows = rows.withColumn("block", F.sum(starts).over(order))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy("document_id", "page_no", "block").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))


def table_blocks(pages: DataFrame) -> DataFrame:
    """document_id, page_no, at, text: captioned tables, then runs of three or more tabular lines.

    A caption's table reaches to the first line after three of its lines that
    closes one (a blank line, or a heading that isn't tabular). Captions inside
    a table open none: a fold over a page's captions, of which there are few,
    gives the spans; lines fall into spans, and what is left into runs. Pages
    without a caption and without three tabular lines have no tables, so their
    lines are not spread; headings close only tables that a caption opens.
    """
    page = ["document_id", "page_no"]
    split = pages.select(F.col("document_id").cast("string").alias("document_id"), F.col("page_no").cast("int").alias("page_no"), raw_lines("text").alias("_lines"))
    split = split.withColumn("_opens", F.exists("_lines", R.is_table_caption)).withColumn("_tabular", F.size(F.filter("_lines", R.is_tabular_line)))
    rows = written(split.where(F.col("_opens") | (F.col("_tabular") >= 3)), "tabular").select(*page, "_opens", F.posexplode("_lines").alias("i", "line"))
    filled = F.col("line") != ""
    before = W.partitionBy(*page).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    facts = rows.select(*page, "i", "line", R.is_table_caption("line").alias("caption"), R.is_tabular_line("line").alias("tabular"), F.when(F.col("_opens"), R.is_heading_line("line")).otherwise(False).alias("heading"))
    facts = facts.withColumn("above", F.coalesce(F.count_if(filled).over(before), F.lit(0)))
    spot = F.struct("i", "above")
    closes = ~filled | (F.col("heading") & ~F.col("tabular"))
    marks = facts.groupBy(*page).agg(F.array_sort(F.collect_list(F.when(F.col("caption"), spot))).alias("opens"), F.array_sort(F.collect_list(F.when(closes, spot))).alias("ends"), (F.max("i") + 1).alias("size"))

    def reach(done, c):
        end = F.get(F.filter("ends", lambda e: (e["i"] > c["i"]) & (e["above"] >= c["above"] + 3)), F.lit(0))["i"]
        span = F.struct(c["i"].alias("start"), F.coalesce(end, F.col("size")).alias("end"))
        return F.when((F.size(done) > 0) & (c["i"] < F.element_at(done, -1)["end"]), done).otherwise(F.concat(done, F.array(span)))

    spans = marks.where(F.size("opens") > 0).select(*page, F.aggregate("opens", F.expr("CAST(array() AS array<struct<start:int,end:int>>)"), reach).alias("spans"))
    placed = facts.join(spans, page, "left").withColumn("block", F.when(filled, F.get(F.filter("spans", lambda s: (s["start"] <= F.col("i")) & (F.col("i") < s["end"])), F.lit(0))["start"]))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text")
    tables = placed.where("block IS NOT NULL").groupBy(*page, "block").agg(text, F.count(F.lit(1)).alias("n")).where("n >= 2").select(*page, F.lit(0).alias("kind"), F.col("block").alias("start"), "text")
    # Neighbouring lines have the same difference between their place and their number.
    free = placed.where("block IS NULL AND tabular").withColumn("run", F.col("i") - F.row_number().over(W.partitionBy(*page).orderBy("i")))
    runs = free.groupBy(*page, "run").agg(text, F.count(F.lit(1)).alias("n"), F.min("i").alias("start")).where("n >= 3").select(*page, F.lit(1).alias("kind"), "start", "text")
    # Of equal texts of a page the first stays.
    first = tables.unionByName(runs).groupBy(*page, "text").agg(F.min(F.struct("kind", "start")).alias("place"))
    return first.select(*page, (F.row_number().over(W.partitionBy(*page).orderBy("place")) - 1).alias("at"), "text")


def footnotes(text) -> Column:
    """The footnote lines among the last of a page, as one text."""
    own = lines(text)
    tail = F.slice(own, F.greatest(F.size(own) - 13, F.lit(1)), 14)
    return strip(F.array_join(F.filter(tail, R.is_footnote_line), "\n"))


def artifacts(pages: DataFrame) -> DataFrame:
    """document_id, page_no, kind_no, at, artifact_type, text of each page's artifacts, in the order they are numbered."""
    kind = F.lower(F.coalesce("section_kind", F.lit("")))
    matter = R.front_matter(F.coalesce(F.nullif("section_heading", F.lit("")), F.col("page_label")), "text", "page_label")
    own = pages.select(
        F.col("document_id").cast("string").alias("document_id"),
        F.col("page_no").cast("int").alias("page_no"),
        F.array(
            F.struct(F.lit(1).alias("kind_no"), F.lit("footnote").alias("artifact_type"), footnotes("text").alias("text")),
            F.struct(F.lit(2).alias("kind_no"), F.lit("front_matter").alias("artifact_type"), F.when((matter["score"] >= 0.5) & (matter["kind"] != ""), strip("text")).otherwise("").alias("text")),
            F.struct(F.lit(3).alias("kind_no"), F.lit("bibliography").alias("artifact_type"), F.when(kind.isin("references", "bibliography") | F.lower(F.trim(F.coalesce("section_heading", F.lit("")))).isin("references", "bibliography"), strip("text")).otherwise("").alias("text")),
        ).alias("a"),
    )
    rest = own.select("document_id", "page_no", F.explode("a").alias("a")).select("document_id", "page_no", "a.*").where("text != ''").withColumn("at", F.lit(0))
    tables = table_blocks(pages).withColumn("kind_no", F.lit(0)).withColumn("artifact_type", F.lit("table"))
    return tables.unionByName(rest)


def chunk_pages(pages: DataFrame, size: int = 1200, overlap: int = 180) -> DataFrame:
    """All chunks of all documents: each page's artifacts, then the windows of its blocks.

    pages: document_id, page_no, page_label, text, section_heading, section_kind
    and whatever else chunks should carry. chunk_index counts through a document.
    """
    keys = ["document_id", "page_no"]
    pages = pages.withColumn("document_id", F.col("document_id").cast("string")).withColumn("page_no", F.col("page_no").cast("int"))
    blocks = semantic_blocks(pages).select(*keys, F.col("block").cast("int").alias("kind_no"), F.posexplode(windows("text", size, overlap)).alias("at", "text")).withColumn("artifact_type", F.lit(None).cast("string"))
    # Dealt by page for good: blocks and tables lie so already, and nothing that follows moves a chunk.
    found = bucketed(artifacts(pages).unionByName(blocks), "found", *keys)
    starts = ranged(found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), ["document_id"], ["page_no"]).sums({"_before": F.col("_n")}, own=False).rows.select(*keys, "_before")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("artifact_type").isNull(), "kind_no", "at"))
    found = found.join(starts, keys).withColumn("chunk_index", (F.col("_before") + place - 1).cast("int")).drop("_before")
    found = found.withColumn("artifact_index", F.when(F.col("artifact_type").isNotNull(), F.row_number().over(W.partitionBy(*keys, "artifact_type").orderBy("at"))))
    matter = R.front_matter(F.coalesce(F.nullif("section_heading", F.lit("")), F.col("page_label")), F.col("_page"), "page_label")
    heads = pages.withColumn("_page", F.left("text", F.lit(1600))).withColumn("_m", matter).drop("text", "_page")
    chunks = heads.join(found, keys)
    role = R.chunk_role("text")
    number = F.lpad(F.col("chunk_index").cast("string"), 4, "0")
    is_artifact = F.col("artifact_type").isNotNull()
    by_type = lambda table, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.col("artifact_type")), F.lit(other))
    chunks = (
        chunks.withColumn("_r", role)
        .withColumn("chunk_id", F.concat("document_id", F.when(is_artifact, F.lit("-artifact-")).otherwise(F.lit("-chunk-")), F.when(F.length(F.col("chunk_index").cast("string")) > 4, F.col("chunk_index").cast("string")).otherwise(number)))
        .withColumn("chunk_role", F.when(is_artifact, F.concat("artifact_type", F.lit("_artifact"))).otherwise(F.col("_r.role")))
        .withColumn("body_score", F.when(is_artifact, by_type(BODY_SCORE, 0.4)).otherwise(F.col("_r.score")))
        .withColumn("heading_only", ~is_artifact & (F.col("_r.role") == "heading_stub"))
        .withColumn("front_matter_kind", F.col("_m.kind"))
        .withColumn("front_matter_score", F.col("_m.score"))
        .withColumn("low_value_prior", F.when(is_artifact, F.when(F.col("artifact_type") == "bibliography", 0.88).otherwise(0.35)).otherwise(R.low_value_prior(F.col("_r.score"), F.col("_m.score"), F.col("_m.low_value"))))
        .withColumn("visibility", F.when(is_artifact, by_type(VISIBILITY, "targeted_only")))
        .withColumn("artifact_id", F.when(is_artifact, F.concat_ws("-", "document_id", "artifact_type", F.replace(F.lower("page_label"), F.lit(" "), F.lit("-")), F.col("artifact_index").cast("string"))))
    )
    return with_continuations(chunks).drop("_r", "_m")


def with_continuations(chunks: DataFrame) -> DataFrame:
    """Adds continuation_id: the next chunk of a block; for a heading without one, the first later body chunk of the page."""
    body = F.when(F.col("artifact_type").isNull(), F.col("chunk_id"))
    block = W.partitionBy("document_id", "page_no", F.col("artifact_type").isNull(), "kind_no").orderBy("at")
    page = W.partitionBy("document_id", "page_no", F.col("artifact_type").isNull()).orderBy("chunk_index").rowsBetween(1, W.unboundedFollowing)
    fits = F.when(~F.col("chunk_role").isin("navigation_like", "reference_like", "heading_stub"), F.col("chunk_id"))
    later = F.when(F.col("heading_only"), F.first(fits, ignorenulls=True).over(page))
    return chunks.withColumn("continuation_id", F.when(F.col("artifact_type").isNull(), F.coalesce(F.lead(body).over(block), later)))


def artifact_counts(chunks: DataFrame) -> DataFrame:
    """document_id, page_no, counts: number of artifacts of each type on a page."""
    counted = chunks.where("artifact_type IS NOT NULL").groupBy("document_id", "page_no", "artifact_type").count()
    return counted.groupBy("document_id", "page_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("artifact_type", "count")))).alias("counts"))


def review_priority() -> Column:
    """How much a chunk's role is in doubt: what it looks like, its front matter, its evidence, how short and broken it is."""
    points = lambda test, n: F.when(test, n).otherwise(0.0)
    body = F.coalesce(F.nullif(F.col("body_score"), F.lit(0.0)), F.lit(0.5))
    role, matter = F.lower(F.coalesce("chunk_role", F.lit(""))), F.lower(F.coalesce("front_matter_kind", F.lit("")))
    own = strip("text")
    return (
        points(role.isin("heading_stub", "navigation_like", "reference_like", "table_fragment"), 1.2)
        + points(~matter.isin("", "body"), 1.0)
        + points((body >= 0.15) & (body <= 0.85), 0.5)
        + points(F.length(own) <= 220, 0.3)
        + points((F.size(raw_lines(own)) >= 3) & (body <= 0.65), 0.2)
    )


def review_candidates(chunks: DataFrame, top: int = 12) -> DataFrame:
    """Per document the chunks whose role a model should review first, with the text around them. Chunks without doubt stay out."""
    near = W.partitionBy("document_id").orderBy("chunk_index")
    flat = lambda c: F.replace(F.left(c, F.lit(180)), F.lit("\n"), F.lit(" "))
    rows = chunks.withColumn("previous_text", F.coalesce(flat(F.lag("text").over(near)), F.lit(""))).withColumn("next_text", F.coalesce(flat(F.lead("text").over(near)), F.lit("")))
    order = W.partitionBy("document_id").orderBy(F.desc("priority"), "chunk_index")
    return rows.withColumn("priority", F.round(review_priority(), 6)).where("priority > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def annotate(rows: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Left join of a model's answers; answers replace, rows without one stay."""
    names = [c for c in annotations.columns if c != key]
    out = rows.join(annotations.select(key, *[F.col(c).alias("_" + c) for c in names]), key, "left")
    for c in names:
        out = out.withColumn(c, F.coalesce("_" + c, c) if c in rows.columns else F.col("_" + c)).drop("_" + c)
    return out
