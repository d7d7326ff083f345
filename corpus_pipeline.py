"""The corpus pipeline: documents in, token ids out.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns
a frame. run() writes each stage's rows as Parquet to the shared folder and
reads them again as the next one's docs. All but the last return the columns
of documents.

Rows with a null identifier are kept like others. Rows that repeat an
identifier with another text are documents of their own: rows are told apart
by identifier and text, and of rows that repeat both, one stays after each of
the two dedup stages. Further columns, whatever their names, are carried along
up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lodestone.llm import bpe, toxicity
from lodestone.llm.common import NULL_ID, materialize
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.mixing import mix_sources
from lodestone.llm.ngram_join import ngram_join
from lodestone.llm.queries import rank_file


def chosen(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of docs whose identifier and text are in stay (doc_id, text_sha256); of rows that are equal in both, one.

    That one has the smallest hash of all other columns, so a retried task chooses
    it again. Texts move once: the choice of one row needs no other partitioning
    than the join.
    """
    ident = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NULL_ID))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.struct("*").alias("row")).select("row", F.xxhash64(F.lit(0), *others).alias("tie"), ident("row.doc_id").alias("id"), F.sha2(text.cast("binary"), 256).alias("digest"))
    rows = rows.join(stay.select(ident("doc_id").alias("id"), F.col("text_sha256").alias("digest")), ["id", "digest"], "left_semi")
    same = W.partitionBy("id", "digest").orderBy("tie")
    return rows.withColumn("number", F.row_number().over(same)).where("number = 1").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return chosen(docs, exact_dedup(docs, keep="max").where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles join (similarity of 0.8 or more) the smallest doc_id stays, as one row."""
    return chosen(docs, ngram_join(docs, width=5, percent=80).where("kept"))


def first_words(text, n):
    """The text up to the end of its n-th word."""
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), n.cast("string"), F.lit("}+"))
    return F.regexp_substr(text, pattern)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated for each whole epoch, and cut where its source's budget ends."""
    rows = mix_sources(docs.select("doc_id", "source", "text", F.struct("*").alias("row")), keep=("row",)).where("taken > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int"))))
    rest = F.col("taken") - F.col("epoch") * F.col("size")
    rows = rows.withColumn("cut", F.when(rest < F.col("size"), first_words(F.col("row.text"), rest)).otherwise(F.col("row.text")))
    new = {"text": F.col("cut"), "n_chars": F.length("cut").cast(dict(docs.dtypes)["n_chars"])}
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to, as a digest."""
    rows = bpe.encode(docs.select("doc_id", "source", "text"), rank_file(), decoded=True)
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix),
    ("byte-level BPE", tokenize),
]

#: Learnt scores and merges are not SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
