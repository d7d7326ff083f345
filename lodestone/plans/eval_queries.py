"""Queries on evaluation, retention and plain relational shapes, with DuckDB SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as T
from ..operators import evaluate, retention, search
from ..sources.tables import new_folder
from ..streaming import expiry, indexing
from .search_queries import TFIDF_CTES, lexical_hits, questions_of
from .text_queries import DOCS, SEMANTIC_BLOCKS_SQL, documents, table


def labelled(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


def passage_hits(spark, sf_dir):
    """For each passage: is a document that holds it among the four best, at which rank, and how much of it do they hold?"""
    hits = lexical_hits(spark, sf_dir).select("question_id", F.col("record_id").alias("doc_id"), "rank")
    rows = hits.join(documents(spark, sf_dir), "doc_id").join(questions_of(spark, sf_dir), "question_id")
    rows = rows.withColumn("whole", F.contains("text", F.col("question")) & (F.col("question") != ""))
    fragments = F.filter(F.transform(F.split("question", r"[.!?]", -1), lambda x: F.trim(x)), lambda x: x != "")
    found = F.size(F.filter(fragments, lambda x: F.contains(F.lower("text"), F.lower(x))))
    per = rows.groupBy("question_id").agg(
        F.max(F.col("whole").cast("int")).alias("hit"), F.coalesce(1.0 / F.min(F.when(F.col("whole"), F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"), F.max(found / F.greatest(F.size(fragments), F.lit(1))).alias("fragment_recall")
    )
    return per.select("question_id", F.col("hit").cast("long").alias("hit"), F.round("reciprocal_rank", 9).alias("reciprocal_rank"), F.round("fragment_recall", 9).alias("fragment_recall"), F.round(evaluate.objective_a("hit", "fragment_recall", "reciprocal_rank"), 9).alias("objective"))


PASSAGE_SQL = f"""
WITH {TFIDF_CTES}, x AS (SELECT question_id, rank, coalesce(b.text, '') AS question, d.text FROM top t JOIN benchmark b ON b.item_id = question_id JOIN d ON d.doc_id = t.doc_id WHERE rank <= 4),
y AS (SELECT question_id, rank, contains(text, question) AND question <> '' AS whole, text, list_filter(list_transform(string_split_regex(question, '[.!?]'), lambda z: trim(z)), lambda z: z <> '') AS f FROM x),
z AS (SELECT question_id, rank, whole, len(list_filter(f, lambda g: contains(lower(text), lower(g)))) / greatest(len(f), 1) AS r FROM y),
a AS (SELECT question_id, max(whole::INT)::BIGINT AS hit, coalesce(1.0::DOUBLE / min(CASE WHEN whole THEN rank END), 0) AS reciprocal_rank, max(r) AS fragment_recall FROM z GROUP BY question_id)
SELECT question_id, hit, round(reciprocal_rank, 9) AS reciprocal_rank, round(fragment_recall, 9) AS fragment_recall, round(0.45::DOUBLE * hit + 0.35::DOUBLE * fragment_recall + 0.20::DOUBLE * reciprocal_rank, 9) AS objective FROM a
"""


def dataset_averages(spark, sf_dir):
    """Quality and toxicity: every source counting the same, and by its size."""
    rows = labelled(spark, sf_dir).withColumn("quality", F.col("quality").cast("double")).withColumn("toxic", F.col("toxic").cast("double")).withColumn("source", F.coalesce("source", F.lit("")))
    one = evaluate.macro_average(rows, "source", ["quality", "toxic"]).select(F.lit("macro").alias("kind"), "quality", "toxic")
    two = evaluate.weighted_average(rows, "source", ["quality", "toxic"]).select(F.lit("weighted").alias("kind"), "quality", "toxic")
    return one.unionByName(two).select("kind", F.round("quality", 9).alias("quality"), F.round("toxic", 9).alias("toxic"))


AVERAGES_SQL = """
WITH l AS (SELECT coalesce(source, '') AS source, quality::DOUBLE AS q, toxic::DOUBLE AS t FROM documents JOIN labels USING (doc_id)),
s AS (SELECT source, count(*) AS n, avg(q) AS q, avg(t) AS t FROM l GROUP BY source)
SELECT 'macro' AS kind, round(avg(q), 9) AS quality, round(avg(t), 9) AS toxic FROM s
UNION ALL SELECT 'weighted', round(sum(q * n) / greatest(sum(n), 1), 9), round(sum(t * n) / greatest(sum(n), 1), 9) FROM s
"""


def suite_summary(spark, sf_dir):
    """Rates by language and by language and source, as a suite has them by system and intent."""
    rows = labelled(spark, sf_dir).select(F.col("lang").alias("system"), F.col("source").alias("intent_type"), (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 0).alias("supported"), F.col("n_chars").cast("double").alias("quality"))
    out = evaluate.suite_summary(rows)
    return out.select("system", "intent_type", "questions", *[F.round(c, 6).alias(c) for c in out.columns[3:]])


SUITE_SQL = """
WITH l AS (SELECT lang AS system, source AS intent_type, quality = 1 AS answerable, toxic = 0 AS supported, n_chars::DOUBLE AS q FROM documents JOIN labels USING (doc_id))
SELECT system, intent_type, count(*) AS questions, round(avg(supported::INT), 6)::DOUBLE AS supported_rate, round(avg(supported::INT) FILTER (answerable), 6)::DOUBLE AS answerable_supported_rate,
  round(avg((NOT supported)::INT) FILTER (NOT answerable), 6)::DOUBLE AS abstention_rate, round(avg(supported::INT) FILTER (NOT answerable), 6)::DOUBLE AS false_support_rate, round(avg(q) FILTER (supported), 6)::DOUBLE AS quality_attempted
FROM l GROUP BY GROUPING SETS ((system), (system, intent_type))
"""


def latency_summary(spark, sf_dir):
    """Both rules for the 95th percentile of the events' values, by type."""
    out = evaluate.latency_summary(table(spark, sf_dir, "events"), "value", ("event_type",))
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "p95", "p95_floor")])


LATENCY_SQL = """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(max(CASE WHEN i = ceil(n * 95 / 100.0) THEN value END), 6) AS p95,
  round(max(CASE WHEN i = greatest(floor(n * 95 / 100.0), 1) THEN value END), 6) AS p95_floor FROM r GROUP BY event_type
"""


def abstention(spark, sf_dir):
    """Documents by label and by whether their length would support an answer."""
    rows = labelled(spark, sf_dir).withColumn("status", F.when(F.col("n_chars") > 3000, "strong").when(F.col("n_chars") > 300, "weak").otherwise("unsupported"))
    out = evaluate.status_rates(rows, "status", ("quality", "toxic"))
    return out.select("quality", "toxic", "n", *[F.round(c, 9).alias(c) for c in ("strong", "weak", "unsupported")])


ABSTENTION_SQL = """
WITH l AS (SELECT quality, toxic, CASE WHEN n_chars > 3000 THEN 'strong' WHEN n_chars > 300 THEN 'weak' ELSE 'unsupported' END AS s FROM documents JOIN labels USING (doc_id))
SELECT quality, toxic, count(*) AS n, round(avg((s = 'strong')::INT), 9)::DOUBLE AS strong, round(avg((s = 'weak')::INT), 9)::DOUBLE AS weak, round(avg((s = 'unsupported')::INT), 9)::DOUBLE AS unsupported FROM l GROUP BY ALL
"""


def threshold_sweep(spark, sf_dir):
    """Which length and weight tell good documents from bad best: all combinations over all labelled documents, ranked."""
    grid = evaluate.parameter_grid(spark, least=[100, 500, 2000], weight=[0.25, 0.75])
    cases = labelled(spark, sf_dir).select("doc_id", "n_chars", "quality", "toxic")
    good = (F.col("n_chars") >= F.col("least")).cast("int")
    outcome = F.col("weight") * (good == F.col("quality")).cast("double") + (1 - F.col("weight")) * (good != F.col("toxic")).cast("double")
    rows = evaluate.sweep(cases, grid, outcome, [F.desc(F.round("outcome", 9)), F.col("least"), F.col("weight")])
    return rows.select("least", "weight", F.round("outcome", 9).alias("outcome"), "cases", F.col("rank").cast("long").alias("rank"))


SWEEP_SQL = """
WITH l AS (SELECT n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)), g AS (SELECT a::BIGINT AS least, b::DOUBLE AS weight FROM unnest([100, 500, 2000]) t(a), unnest([0.25, 0.75]) u(b)),
o AS (SELECT least, weight, round(avg(weight * ((n_chars >= least)::INT = quality)::INT + (1 - weight) * ((n_chars >= least)::INT <> toxic)::INT), 9) AS outcome, count(*) AS cases FROM l, g GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY outcome DESC, least, weight) AS rank FROM o
"""


def sessions_24h(spark, sf_dir):
    """Sessions of users with 24 hours of rest between them."""
    rows = retention.sessions(table(spark, sf_dir, "events"), "user_id", "ts")
    stamp = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return rows.select("user_id", F.col("session_no").cast("long").alias("session_no"), stamp("first_at"), stamp("last_at"), stamp("expires_at"), "touches")


SESSIONS_SQL = """
WITH a AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER o IS NULL OR ts >= lag(ts) OVER o + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS s FROM events WHERE ts IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM a)
SELECT user_id, session_no, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at, epoch_us(max(ts) + INTERVAL 24 HOUR) AS expires_at, count(*) AS touches FROM b GROUP BY ALL
"""


def workspace_expiry(spark, sf_dir):
    """The users' workspaces that a stream of all events closes, up to an hour before the last event."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    at = new_folder(spark, "expiry")
    expiry.run_to_end(expiry.expiring_workspaces(stream, "user_id", "event_id", "ts"), f"{at}/closed", f"{at}/state")
    rows = spark.read.schema("user_id long, first_at timestamp, last_at timestamp, expires_at timestamp, touches long").parquet(f"{at}/closed")
    return rows.select("user_id", *[F.unix_micros(c).alias(c) for c in ("first_at", "last_at", "expires_at")], "touches")


EXPIRY_SQL = """
WITH a AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER o IS NULL OR ts >= lag(ts) OVER o + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS s FROM events WHERE ts IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM a)
SELECT user_id, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at, epoch_us(max(ts) + INTERVAL 24 HOUR) AS expires_at, count(*) AS touches FROM b GROUP BY user_id, session_no
HAVING max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
"""


def index_build(spark, sf_dir):
    """All documents as arriving files: what the stream builds, each text once, and how many files brought it."""
    docs = table(spark, sf_dir, "documents")
    at = new_folder(spark, "index")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parquet*").select(F.col("doc_id").cast("string").alias("file_name"), "text")
    store = indexing.IndexStore(f"{at}/store")
    indexing.index_stream(stream, store, f"{at}/check").awaitTermination()
    brought = store.table(spark, "arrivals").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("files"))
    return store.table(spark, "catalogue").join(brought, "fingerprint").select("fingerprint", "document_id", "files", "chars", "pages", "chunks")


INDEX_BUILD_SQL = f"""
WITH b AS ({SEMANTIC_BLOCKS_SQL}), c AS (SELECT doc_id, sum(1 + greatest(0, ceil((chars - 1200) / 1020.0)))::BIGINT AS chunks FROM b WHERE chars > 0 GROUP BY doc_id)
SELECT sha256(coalesce(text, '')) AS fingerprint, left(sha256(coalesce(text, '')), 16) AS document_id, count(*) AS files, max(length(coalesce(text, ''))) AS chars, 1::BIGINT AS pages, coalesce(max(chunks), 0)::BIGINT AS chunks
FROM documents LEFT JOIN c USING (doc_id) GROUP BY 1, 2
"""


def workspaces(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as workspaces of customers, and the instant to look at them from."""
    orders = table(spark, sf_dir, "orders")
    now = F.lit(datetime.datetime(1998, 6, 1)).cast("timestamp_ntz")
    rows = orders.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("last_activity_at"), (F.col("o_orderdate") + F.expr("INTERVAL 180 DAYS")).alias("expires_at"))
    return rows, now


def active_workspaces(spark, sf_dir):
    """Per customer the last order, if it isn't expired, and how many others go."""
    rows, now = workspaces(spark, sf_dir)
    keep, gone = retention.active_workspaces(rows, now)
    counts = gone.groupBy("owner").agg(F.count(F.lit(1)).alias("deleted"))
    return keep.select("owner", F.col("document_id").alias("kept")).join(counts, "owner", "full_outer").select("owner", "kept", F.coalesce("deleted", F.lit(0)).alias("deleted"))


ACTIVE_SQL = """
WITH r AS (SELECT o_custkey AS owner, o_orderkey AS k, o_orderdate + INTERVAL 180 DAY <= TIMESTAMP '1998-06-01' AS gone, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS i FROM orders)
SELECT owner, max(CASE WHEN i = 1 AND NOT gone THEN k END) AS kept, count(*) - count(CASE WHEN i = 1 AND NOT gone THEN k END) AS deleted FROM r GROUP BY owner
"""


def sweep_counts(spark, sf_dir):
    """What a sweep deletes: expired orders, their lines, and customers without orders as orphans."""
    rows, now = workspaces(spark, sf_dir)
    gone = rows.where(retention.expired("expires_at", now))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"))
    children = retention.cascade(gone, {"lines": lines})
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"))
    return retention.sweep_summary({"documents": gone, "lines": children["lines"], "orphans": owners.join(rows.select("owner"), "owner", "left_anti")})


SWEEP_COUNTS_SQL = """
WITH g AS (SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 180 DAY <= TIMESTAMP '1998-06-01')
SELECT 'documents' AS category, count(*) AS deleted FROM g UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey IN (FROM g)
UNION ALL SELECT 'orphans', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
"""


def workspace_sweep(spark, sf_dir):
    """What a sweep deletes of five kinds: orders as documents, their lines as indexes and traces, customers as uploads, parts as cached answers."""
    rows, now = workspaces(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem")
    documents = rows.select("document_id", F.col("owner").cast("string").alias("path"), "expires_at")
    indexes = lines.select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").cast("string").alias("fingerprint"))
    traces = lines.select(F.col("l_orderkey").alias("document_id"), (F.col("l_shipdate") + F.expr("INTERVAL 120 DAYS")).alias("expires_at"))
    uploads = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"))
    caches = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("fingerprint"))
    return retention.sweep_summary(retention.sweep(documents, indexes, uploads, caches, traces, now))


WORKSPACE_SWEEP_SQL = """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, coalesce(o_orderdate + INTERVAL 180 DAY <= TIMESTAMP '1998-06-01', false) AS gone FROM orders), live AS (SELECT k, c FROM o WHERE NOT gone),
li AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey IN (SELECT k FROM live))
SELECT 'documents' AS category, count(*) AS deleted FROM o WHERE gone
UNION ALL SELECT 'indexes', count(*) FROM lineitem WHERE l_partkey NOT IN (FROM li)
UNION ALL SELECT 'uploads', count(*) FROM customer WHERE c_custkey NOT IN (SELECT c FROM live)
UNION ALL SELECT 'caches', count(*) FROM part WHERE p_partkey NOT IN (FROM li)
UNION ALL SELECT 'traces', count(*) FROM lineitem WHERE coalesce(l_shipdate + INTERVAL 120 DAY <= TIMESTAMP '1998-06-01', false) OR l_orderkey NOT IN (SELECT k FROM live)
"""


def props_json(spark, sf_dir):
    """Values inside the events' JSON, guarded."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


def type_deltas(spark, sf_dir):
    """Each event type's mean value and count less those of the first type, by user."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))
    out = evaluate.deltas(rows, "event_type", "click", ["mean", "n"], ["user_id"])
    return out.select("user_id", "event_type", F.round("delta_mean", 6).alias("delta_mean"), "delta_n")


DELTAS_SQL = """
WITH r AS (SELECT user_id, event_type, avg(value) AS m, count(*)::DOUBLE AS n FROM events GROUP BY ALL)
SELECT a.user_id, a.event_type, round(a.m - b.m, 6) AS delta_mean, a.n - b.n AS delta_n FROM r a JOIN r b ON a.user_id = b.user_id AND b.event_type = 'click' WHERE a.event_type <> 'click'
"""


def duplicate_texts(spark, sf_dir):
    """Texts that occur more than once, by digest."""
    return evaluate.duplicate_ids(documents(spark, sf_dir).select(T.fingerprint("text").alias("fingerprint")), "fingerprint").select("fingerprint", F.col("count").alias("n"))


def pricing_summary(spark, sf_dir):
    """Sums of line items by flag and status."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit(datetime.datetime(1998, 9, 2)))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    money = lambda c: F.round(F.sum(c), 2)
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_base_price"), money(net).alias("sum_disc_price"), money(net * (1 + F.col("l_tax"))).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"),
    )


PRICING_SQL = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
"""


def region_revenue(spark, sf_dir):
    """Revenue by region and nation of customers, of items from suppliers of the same nation."""
    t = lambda n: table(spark, sf_dir, n)
    rows = (
        t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"))
        .join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("items"))


REGION_SQL = """
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS items FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
"""


def customer_top_orders(spark, sf_dir):
    """Each customer's three dearest orders."""
    ranked = search.top(table(spark, sf_dir, "orders"), "o_custkey", 3, F.desc("o_totalprice"), "o_orderkey")
    return ranked.select("o_custkey", "o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))


QUERIES = {
    "passage_hits": passage_hits, "dataset_averages": dataset_averages, "suite_summary": suite_summary, "latency_summary": latency_summary, "abstention": abstention,
    "threshold_sweep": threshold_sweep, "sessions_24h": sessions_24h, "workspace_expiry": workspace_expiry, "index_build": index_build, "active_workspaces": active_workspaces, "sweep_counts": sweep_counts, "workspace_sweep": workspace_sweep, "props_json": props_json,
    "type_deltas": type_deltas, "duplicate_texts": duplicate_texts, "pricing_summary": pricing_summary, "region_revenue": region_revenue, "customer_top_orders": customer_top_orders,
}

ORACLE_SQL = {
    "passage_hits": PASSAGE_SQL,
    "dataset_averages": AVERAGES_SQL, "suite_summary": SUITE_SQL, "latency_summary": LATENCY_SQL, "abstention": ABSTENTION_SQL, "threshold_sweep": SWEEP_SQL, "sessions_24h": SESSIONS_SQL,
    "workspace_expiry": EXPIRY_SQL, "index_build": INDEX_BUILD_SQL, "active_workspaces": ACTIVE_SQL, "sweep_counts": SWEEP_COUNTS_SQL, "workspace_sweep": WORKSPACE_SWEEP_SQL, "type_deltas": DELTAS_SQL, "pricing_summary": PRICING_SQL, "region_revenue": REGION_SQL,
    "props_json": "SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1",
    "duplicate_texts": f"WITH {DOCS} SELECT sha256(text) AS fingerprint, count(*) AS n FROM d GROUP BY 1 HAVING count(*) > 1",
    "customer_top_orders": "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3",
}
