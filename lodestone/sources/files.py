"""Binary documents in, tables out.

Files are read by Spark's binaryFile source, so any file system that Spark
reads will do. Parsers run in mapInArrow, one file at a time.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.constants import TRANSIENT_ERRORS
from ..functions.text import contains_any

PAGES = "document_id string, fingerprint string, file_name string, file_type string, page_no int, page_label string, text string, page_count int"
SUFFIXES = (".pdf", ".docx")
BACKENDS = ("pypdf", "docling")


def backend_of(name: str | None, default: str = "pypdf") -> str:
    """The PDF backend; an unknown name falls back to the default."""
    name = (name or "").strip().lower()
    return name if name in BACKENDS else default


def docx_pages(content: bytes) -> tuple[list[tuple[str, str]], int]:
    """One page of the paragraphs that aren't blank."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    paragraphs = ["".join(t.text or "" for t in p.iter(word + "t")).strip() for p in body.iter(word + "p")]
    text = "\n".join(p for p in paragraphs if p)
    return ([("Document", text)] if text else []), int(bool(text))


def pdf_pages(content: bytes, backend: str) -> tuple[list[tuple[str, str]], int]:
    """The pages with text; labels count the others, too. Backends are optional packages."""
    if backend == "docling":
        from docling.datamodel.base_models import DocumentStream
        from docling.document_converter import DocumentConverter

        document = DocumentConverter().convert(DocumentStream(name="file.pdf", stream=io.BytesIO(content))).document
        n = len(document.pages)
        pages = [(f"Page {i}", document.export_to_markdown(page_no=i).strip()) for i in range(1, n + 1)]
        pages = [p for p in pages if p[1]] or [("Document", document.export_to_markdown().strip())]
        return pages, n
    from pypdf import PdfReader

    found = [(page.extract_text() or "").strip() for page in PdfReader(io.BytesIO(content)).pages]
    return [(f"Page {i}", t) for i, t in enumerate(found, 1) if t], len(found)


def parser(backend: str):
    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                name = re.sub(r"^.*/", "", path)
                suffix = name[name.rfind(".") :].lower()
                if suffix not in SUFFIXES:
                    raise ValueError(f"unsupported file type: {suffix}")
                pages, n = docx_pages(content) if suffix == ".docx" else pdf_pages(content, backend)
                digest = hashlib.sha256(content).hexdigest()
                out += [(digest[:16], digest, name, suffix[1:], i, label, text, n) for i, (label, text) in enumerate(pages)]
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.string()] * 4 + [pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PAGES.split(", ")])

    return run


def read_pages(spark: SparkSession, path: str, backend: str | None = None, glob: str = "*") -> DataFrame:
    """A row for each page of the PDF and DOCX files under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(parser(backend_of(backend)), PAGES)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The supported files under path, by name: name, bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.where(F.lower("path").rlike(r"\.(pdf|docx)$")).select(name.alias("file_name"), "length").orderBy("file_name")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


MANIFEST = """suite_id string, description string, frozen boolean, context_budget struct<top_k:int,max_chars_per_context:int>,
documents array<struct<document_id:string,path:string,document_type:string,source:string,license_notes:string,used_for_tuning:boolean>>,
questions array<struct<question_id:string,document_id:string,question:string,intent_type:string,answerable:boolean,
expected_regions:array<struct<section:string,page_label:string>>,gold_answer:string,gold_answer_notes:string,unsupported_reason:string>>"""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation suite: one row. A byte order mark is passed over."""
    text = spark.read.text(path, wholetext=True).select(F.from_json(F.regexp_replace("value", "^\\x{FEFF}", ""), MANIFEST).alias("m"))
    return text.select("m.*")


def write_artifacts(tables: dict[str, DataFrame], path: str, schema_version: str) -> None:
    """One table for each entity, partitioned by schema version and fingerprint; an index written again replaces its partitions."""
    for name, table in tables.items():
        rows = table.withColumn("schema_version", F.lit(schema_version))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("schema_version", "fingerprint").parquet(f"{path}/{name}")


def read_artifacts(spark: SparkSession, path: str, names: tuple[str, ...], schema_version: str, fingerprint: str) -> dict[str, DataFrame] | None:
    """The tables of an index, or nothing if any of them has no rows of it."""
    found = {}
    for name in names:
        try:
            rows = spark.read.parquet(f"{path}/{name}").where((F.col("schema_version") == schema_version) & (F.col("fingerprint") == fingerprint))
        except Exception as e:  # a table that was never written
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None
        if rows.isEmpty():
            return None
        found[name] = rows
    return found


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and the old ones whose key is not among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def flatten_metadata(df: DataFrame, separator: str = " | ", kept: tuple[str, ...] = ()) -> DataFrame:
    """Scalars stay, arrays of strings are joined, anything else becomes JSON text."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        if f.name in kept:
            out.append(F.col(f.name))
        elif kind == "array<string>":
            out.append(F.array_join(f.name, separator).alias(f.name))
        elif kind.startswith(("array", "map", "struct", "variant")):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def delete_artifacts(spark: SparkSession, path: str, names: tuple[str, ...], schema_version: str, fingerprint: str) -> int:
    """Drop an index' partitions from every table; how many there were."""
    jvm, gone = spark._jvm, 0
    for name in names:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/schema_version={schema_version}/fingerprint={fingerprint}")
        gone += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    return gone


class Records:
    """A table of records under a path, in numbered versions: a change writes the next one whole, and only a finished one counts."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, system = self.files(self.path)
        if not system.exists(at):
            return []
        names = [f.getPath().getName() for f in system.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit() and system.exists(self.files(f"{self.path}/{n}/_SUCCESS")[0]))

    def rows(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/{found[-1]}") if found else None

    def put(self, rows: DataFrame, keep: int = 2) -> None:
        """Write the next version, and drop all but the last `keep`."""
        found = self.versions()
        rows.write.mode("overwrite").parquet(f"{self.path}/{found[-1] + 1 if found else 0}")
        for n in [*found][: max(0, len(found) + 1 - keep)]:
            at, system = self.files(f"{self.path}/{n}")
            system.delete(at, True)

    def save(self, new: DataFrame) -> None:
        old = self.rows()
        self.put(new if old is None else upsert(old, new, [self.key]))

    def get(self, value) -> DataFrame | None:
        rows = self.rows()
        return None if rows is None else rows.where(F.col(self.key) == F.lit(value))

    def delete(self, gone: DataFrame) -> None:
        """Drop the records whose key is among those of gone."""
        old = self.rows()
        if old is not None:
            self.put(old.join(gone.select(self.key), self.key, "left_anti"))


def store(spark: SparkSession, path: str, kind: str) -> Records:
    """The records of a kind: documents by document_id, indexes by fingerprint, answers by cache_key, traces by trace_id."""
    keys = {"documents": "document_id", "indexes": "fingerprint", "answers": "cache_key", "traces": "trace_id"}
    if kind not in keys:
        raise ValueError(f"unknown kind of records: {kind}")
    return Records(spark, f"{path.rstrip('/')}/{kind}", keys[kind])


def write_vectors(rows: DataFrame, path: str) -> None:
    """Vectors of an index: collection (chunks, sections, synopses), fingerprint, record_id, embedding and flat metadata.

    Partitioned by collection and fingerprint; writing an index again replaces its partitions.
    """
    flatten_metadata(rows, kept=("embedding",)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection", "fingerprint").parquet(path)


def save_report(rows: DataFrame, path: str, prefix: str, stamp: str) -> str:
    """A report as one JSON file in a folder named by prefix and time; its path."""
    at = f"{path.rstrip('/')}/{prefix}_{stamp}.json"
    rows.coalesce(1).write.mode("overwrite").json(at)
    return at


def latest_report(spark: SparkSession, path: str, prefix: str) -> DataFrame | None:
    """The newest report of that prefix by the time its file was written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{prefix}_*.json")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    best = max(found, key=lambda f: (f.getModificationTime(), f.getPath().getName()), default=None)
    return None if best is None else spark.read.json(best.getPath().toString())


def safe_documents(documents: DataFrame, metadata: str = "metadata") -> DataFrame:
    """What users see of documents: of the JSON metadata four fields only."""
    safe = F.struct(*[F.get_json_object(metadata, f"$.{k}").alias(k) for k in ("document_style", "section_heading", "section_kind", "content_type")])
    return documents.select("document_id", "file_name", "file_type", "source_path", "fingerprint", "char_count", "page_count", safe.alias("metadata"))


def is_transient(message) -> Column:
    """Does an error's message speak of something that another attempt may cure?"""
    return contains_any(F.lower(message), TRANSIENT_ERRORS)
