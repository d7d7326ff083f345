"""The index build as a stream: each text once, and nothing twice when batches are played again."""

from collections import Counter

from pyspark.sql import functions as F

from lodestone.streaming.indexing import IndexStore, Settings, index_stream

SCHEMA = "file_name string, text string"
BODY = "The waiting period is thirty days for all new members of the plan. " * 30


def contents(spark, store):
    names = ("catalogue", "pages", "chunks", "arrivals")
    return {n: Counter(tuple(str(v) for v in r) for r in store.table(spark, n).collect()) for n in names}


def test_files_arrive_in_batches(spark, tmp_path):
    batches = [[("a", BODY), ("b", "Abstract\nShort."), ("a2", BODY)], [("c", BODY), ("d", None), ("e", "")], [("f", "1 Scope\nNew text here."), ("b2", "Abstract\nShort.")]]
    source = tmp_path / "in"
    store = IndexStore(str(tmp_path / "store"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / f"b{k}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(source))
        index_stream(stream, store, str(tmp_path / "check")).awaitTermination()
    found = {r.file_name: r for r in store.table(spark, "catalogue").collect()}
    assert set(found) == {"a", "b", "d", "f"} and found["a"].chunks == 2 and found["a"].chars == len(BODY) and found["d"].chunks == 0
    assert all(r.document_id == r.fingerprint[:16] for r in found.values())
    assert store.table(spark, "arrivals").count() == 8
    chunks = Counter(r.document_id for r in store.table(spark, "chunks").where("artifact_type IS NULL").collect())
    assert chunks == Counter({r.document_id: r.chunks for r in found.values() if r.chunks})
    before = contents(spark, store)
    # A batch that is played again changes nothing, the first as well as the last.
    for number in (2, 0, 1, 2):
        store.add(spark.createDataFrame(batches[number], SCHEMA), number)
        assert contents(spark, store) == before


def test_a_batch_that_broke_off_is_not_seen(spark, tmp_path):
    store = IndexStore(str(tmp_path / "store"))
    assert store.table(spark, "catalogue") is None
    rows = spark.createDataFrame([("a", BODY)], SCHEMA)
    store.write(rows, "pages", 0)
    assert store.table(spark, "pages") is None
    store.add(rows, 0)
    assert store.table(spark, "pages").count() == 1 and store.table(spark, "catalogue").count() == 1


def test_other_settings_build_anew(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", BODY)], SCHEMA)
    IndexStore(path).add(rows, 0)
    other = IndexStore(path, Settings(chunk_size=300, chunk_overlap=50))
    other.add(rows, 1)
    other.add(rows, 2)
    assert sorted((r.batch, r.chunk_size) for r in other.table(spark, "catalogue").collect()) == [(0, 1200), (1, 300)]
    assert other.table(spark, "chunks").where(F.col("batch") == 1).count() > 5
