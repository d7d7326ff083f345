"""The index build as a stream: files arrive, and what is new is fingerprinted, structured and chunked.

Each micro-batch is one set-oriented run of the same stages as a batch build. A
text whose fingerprint the catalogue has, under the same settings, is not built
again, whatever it is called; copies inside a batch are built once. All tables
are written under the batch's number, the catalogue last: a batch that is played
again overwrites its own folders and looks only at what other batches have, so
it changes nothing. Readers see the batches of the catalogue, so a batch that
broke off is not seen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import fingerprint
from ..operators import chunking, structure
from ..sources.tables import bucketed, scratch, written


@dataclass(frozen=True)
class Settings:
    """An index is used again only if all of these are as they were."""

    schema_version: str = "1"
    embedding_model: str = ""
    chunk_size: int = 1200
    chunk_overlap: int = 180


def one_page(texts: DataFrame) -> DataFrame:
    """texts (document_id, text) as pages: the whole text, as for a file without pages."""
    return texts.select("document_id", F.lit(0).alias("page_no"), F.lit("Document").alias("page_label"), "text", F.lit("").alias("section_heading"))


@dataclass(frozen=True)
class IndexStore:
    """Tables pages, chunks, arrivals and catalogue under path, in a folder for each batch."""

    path: str
    settings: Settings = Settings()
    cut: Callable[[DataFrame], DataFrame] = one_page

    def table(self, spark: SparkSession, name: str) -> DataFrame | None:
        """All rows of the batches that the catalogue has; None before there is any."""
        done = self.folders(spark, "catalogue")
        paths = [f"{self.path}/{name}/batch={n}" for n in sorted(done & self.folders(spark, name))]
        return spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths) if paths else None

    def folders(self, spark: SparkSession, name: str) -> set[int]:
        """The numbers of the batches whose folder of a table was written to its end."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return set()
        ended = [f.getPath() for f in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return {int(p.getName().removeprefix("batch=")) for p in ended if p.getName().startswith("batch=")}

    def built(self, spark: SparkSession, other_than: int) -> DataFrame | None:
        """fingerprint of what other batches have built under these settings; None if there is no other batch."""
        rows = self.table(spark, "catalogue")
        if rows is None:
            return None
        s = self.settings
        same = (F.col("schema_version") == s.schema_version) & (F.col("embedding_model") == s.embedding_model) & (F.col("chunk_size") == s.chunk_size) & (F.col("chunk_overlap") == s.chunk_overlap)
        return rows.where(same & (F.col("batch") != other_than)).select("fingerprint").distinct()

    def add(self, batch: DataFrame, number: int) -> None:
        """batch: file_name, text.

        Texts move once, to their pages: these are dealt by page for good, and what
        else is found out about them is joined without them.
        """
        with scratch(batch.sparkSession):
            self.build(batch, number)

    def build(self, batch: DataFrame, number: int) -> None:
        spark, s = batch.sparkSession, self.settings
        text, done = F.coalesce("text", F.lit("")), self.built(spark, number)
        rows = batch.select("file_name", text.alias("text")).withColumn("fingerprint", fingerprint("text"))
        arrived = written(rows.select("file_name", "fingerprint", F.length("text").cast("long").alias("chars")), "arrived")
        only_new = lambda t: t if done is None else t.join(done, "fingerprint", "left_anti")
        named = lambda t: t.withColumn("document_id", F.left("fingerprint", F.lit(16)))
        new = written(named(only_new(arrived).groupBy("fingerprint").agg(F.min("file_name").alias("file_name"), F.max("chars").alias("chars"))), "new")
        texts = named(only_new(rows)).select("document_id", "text")
        # Copies have the same pages, of which one stays.
        cut = bucketed(self.cut(texts).dropDuplicates(["document_id", "page_no"]), "pages", "document_id", "page_no")
        pages = structure.enrich_pages(cut)
        self.write(pages, "pages", number)
        self.write(chunking.chunk_pages(pages, s.chunk_size, s.chunk_overlap), "chunks", number)
        self.write(arrived.select("file_name", "fingerprint"), "arrivals", number)
        count = lambda t, name: t.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
        stored = {name: spark.read.parquet(f"{self.path}/{name}/batch={number}") for name in ("pages", "chunks")}
        found = new.select("fingerprint", "document_id", "file_name", "chars")
        for more in (count(stored["pages"], "pages"), count(stored["chunks"].where("artifact_type IS NULL"), "chunks"), structure.document_styles(stored["pages"])):
            found = found.join(more, "document_id", "left")
        found = found.fillna(0, ["pages", "chunks"])
        keys = [F.lit(v).alias(k) for k, v in (("schema_version", s.schema_version), ("embedding_model", s.embedding_model), ("chunk_size", s.chunk_size), ("chunk_overlap", s.chunk_overlap))]
        self.write(found.select("fingerprint", "document_id", "file_name", "chars", "pages", "chunks", "document_style", *keys), "catalogue", number)

    def write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")


def index_stream(arrivals: DataFrame, store: IndexStore, checkpoint: str):
    """Builds what arrives (file_name, text: a stream) into the store; runs through what is there and ends."""
    return arrivals.writeStream.foreachBatch(lambda batch, number: store.add(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
