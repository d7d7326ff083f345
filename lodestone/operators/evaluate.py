"""Metrics of retrieval and answers, and sweeps over parameters."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .order_statistics import same, values_at


def question_metrics(results: DataFrame, labels: DataFrame) -> DataFrame:
    """results: question_id, rank, page_label, text; labels: question_id, expected_pages, expected_fragments.
    One row for each label: hit, reciprocal_rank, fragment_recall."""
    rows = labels.join(results, "question_id", "left")
    hit = F.array_contains("expected_pages", F.col("page_label"))
    out = rows.groupBy("question_id", "expected_fragments").agg(F.min(F.when(hit, F.col("rank"))).alias("_first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("_t"))
    low = F.lower(F.coalesce("_t", F.lit("")))
    found = F.size(F.filter("expected_fragments", lambda x: F.contains(low, F.lower(x))))
    return out.select(
        "question_id",
        F.col("_first").isNotNull().cast("int").alias("hit"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
        (found / F.greatest(F.size("expected_fragments"), F.lit(1))).alias("fragment_recall"),
    )


def objective_a(hit, recall, mrr) -> Column:
    return 0.45 * F.col(hit) + 0.35 * F.col(recall) + 0.20 * F.col(mrr)


def objective_b(hit, mrr, section, region, plan) -> Column:
    return 0.30 * F.col(hit) + 0.20 * F.col(mrr) + 0.20 * F.col(section) + 0.20 * F.col(region) + 0.10 * F.col(plan)


def macro_average(rows: DataFrame, dataset: str, metrics: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Every dataset counts the same."""
    return rows.groupBy(*by, dataset).agg(*[F.avg(m).alias(m) for m in metrics]).groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def weighted_average(rows: DataFrame, dataset: str, metrics: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Every dataset counts by its rows."""
    per = rows.groupBy(*by, dataset).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(m).alias(m) for m in metrics])
    return per.groupBy(*by).agg(*[(F.sum(F.col(m) * F.col("_n")) / F.greatest(F.sum("_n"), F.lit(1))).alias(m) for m in metrics])


def suite_summary(rows: DataFrame, spark_view: str = "_suite") -> DataFrame:
    """By system, and by system and intent: rates over the questions they are about. rows: system, intent_type, answerable, supported, quality."""
    return rows.groupingSets([["system"], ["system", "intent_type"]], "system", "intent_type").agg(
        F.count(F.lit(1)).alias("questions"),
        F.avg(F.col("supported").cast("double")).alias("supported_rate"),
        F.avg(F.when(F.col("answerable"), F.col("supported").cast("double"))).alias("answerable_supported_rate"),
        F.avg(F.when(~F.col("answerable"), (~F.col("supported")).cast("double"))).alias("abstention_rate"),
        F.avg(F.when(~F.col("answerable"), F.col("supported").cast("double"))).alias("false_support_rate"),
        F.avg(F.when(F.col("supported"), F.col("quality"))).alias("quality_attempted"),
    )


def latency_summary(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, population deviation, and both rules for the 95th percentile: nearest rank, and the item before 95 % of them."""
    ranks = {"p95": lambda n: F.ceil(n * 95 / 100), "p95_floor": lambda n: F.greatest(F.floor(n * 95 / 100), F.lit(1))}
    at = values_at(rows, value, ranks, by)
    known = rows.where(F.col(value).isNotNull())
    spread = known.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    both = spread.join(at, same(spread, at, by)) if by else spread.join(at)  # without groups, one row each
    return both.select(*[spread[c] for c in by], "mean", "deviation", "p95", "p95_floor")


def deltas(rows: DataFrame, system: str, baseline: str, metrics: list[str], keys: list[str]) -> DataFrame:
    """Each system's metrics less the baseline's."""
    base = rows.where(F.col(system) == baseline).select(*keys, *[F.col(m).alias("_" + m) for m in metrics])
    return rows.where(F.col(system) != baseline).join(base, keys).select(*keys, system, *[(F.col(m) - F.col("_" + m)).alias(f"delta_{m}") for m in metrics])


def changes(before: DataFrame, after: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """How many questions are better, worse and the same."""
    delta = F.col("_a") - F.col("_b")
    rows = before.select(*keys, F.col(metric).alias("_b")).join(after.select(*keys, F.col(metric).alias("_a")), keys)
    return rows.agg(F.count_if(delta > 0).alias("improved"), F.count_if(delta < 0).alias("worsened"), F.count_if(delta == 0).alias("unchanged"), F.avg(delta).alias("mean_delta"))


def changed_questions(before: DataFrame, after: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """The questions whose metric differs, by how much, the worst first; equal changes by key."""
    rows = before.select(*keys, F.col(metric).alias("before")).join(after.select(*keys, F.col(metric).alias("after")), keys).withColumn("delta", F.col("after") - F.col("before"))
    return rows.where("delta != 0").orderBy("delta", *keys)


def parameter_grid(spark: SparkSession, **values) -> DataFrame:
    """All combinations of the values, numbered."""
    names = list(values)
    rows = [(i, *combination) for i, combination in enumerate(product(*values.values()))]
    return spark.createDataFrame(rows, ["combination", *names])


def sweep(cases: DataFrame, grid: DataFrame, outcome: Column, order: list[Column]) -> DataFrame:
    """The average outcome of every combination over all cases, ranked. The grid is a stated, small set."""
    scored = cases.crossJoin(F.broadcast(grid)).withColumn("_o", outcome)
    per = scored.groupBy(*grid.columns).agg(F.avg("_o").alias("outcome"), F.count(F.lit(1)).alias("cases"))
    return per.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1")


def limited_contexts(rows: DataFrame, top: int | None, most: int | None, by: str = "question_id") -> DataFrame:
    """The first contexts of each question, cut to a length; nothing is cut where a limit is not given."""
    out = rows.where(F.col("rank") <= top) if top else rows
    return out.withColumn("text", F.left("text", F.lit(most))) if most else out


def scope_compliance(rows: DataFrame) -> DataFrame:
    """rows: question_id, in_scope (null without results). Share of results in scope, and whether there are any and all are."""
    return rows.groupBy("question_id").agg(F.coalesce(F.avg(F.col("in_scope").cast("double")), F.lit(0.0)).alias("precision"), F.coalesce(F.bool_and("in_scope"), F.lit(False)).alias("compliant"))


def status_rates(rows: DataFrame, status: str, by: tuple[str, ...] = ()) -> DataFrame:
    of = lambda s: F.avg((F.col(status) == s).cast("double")).alias(s)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), of("strong"), of("weak"), of("unsupported"))


def plan_matches(hit, spread, mode, route, pages) -> Column:
    """Did a plan's route suit what the question asked for, given that it found the page? pages: how many different ones it returned."""
    fits = (
        F.when(F.col(spread) == "atomic", F.col(route) == "chunk_first")
        .when(F.col(spread) == "sectional", F.col(route).isin("synopsis_first", "section_first") & (F.col(pages) <= 3))
        .when(F.col(spread) == "distributed", (F.col(mode) == "soft_multi_region") & F.col(route).isin("synopsis_first", "hybrid_both"))
        .when(F.col(spread) == "global", F.col(route).isin("synopsis_first", "hybrid_both"))
        .otherwise(True)
    )
    return F.col(hit).cast("boolean") & fits


def retrieval_outcomes(results: DataFrame, labels: DataFrame, plans: DataFrame) -> DataFrame:
    """One row for each label: hit, reciprocal_rank, section_hit, region_hit, plan_hit, and the share of expected pages found.

    results: question_id, rank, page_label, section_id, region_kind; labels: question_id,
    expected_pages; plans: question_id, spread, mode, route_used, kinds, fallback_used.
    """
    rows = labels.join(results, "question_id", "left").join(plans, "question_id", "left")
    on_page = F.coalesce(F.array_contains("expected_pages", F.coalesce("page_label", F.lit("Document"))) & F.col("rank").isNotNull(), F.lit(False))
    kind = F.coalesce("region_kind", F.lit(""))
    region = F.when(F.size("kinds") > 0, F.array_contains("kinds", kind)).otherwise(kind != "")
    out = rows.groupBy("question_id", "spread", "mode", "route_used", "fallback_used", "expected_pages").agg(
        F.min(F.when(on_page, F.col("rank"))).alias("_first"),
        F.bool_or(on_page & (F.coalesce("section_id", F.lit("")) != "")).alias("section_hit"),
        F.bool_or(on_page & F.coalesce(region, F.lit(False))).alias("region_hit"),
        F.collect_set("page_label").alias("_pages"),
    )
    out = out.withColumn("hit", F.col("_first").isNotNull()).withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("_first"), F.lit(0.0))).withColumn("pages", F.size("_pages"))
    share = F.size(F.array_intersect("_pages", "expected_pages")) / F.greatest(F.size("expected_pages"), F.lit(1))
    return out.withColumn("plan_hit", plan_matches("hit", "spread", "mode", "route_used", "pages")).withColumn("pages_found", share).drop("_first", "_pages", "expected_pages")


def retrieval_summary(outcomes: DataFrame) -> DataFrame:
    """Rates over all questions, and over those that used the fallback or were distributed."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c + "_rate")
    return outcomes.agg(
        F.count(F.lit(1)).alias("questions"), rate("hit"), F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mean_reciprocal_rank"), rate("section_hit"), rate("region_hit"), rate("plan_hit"),
        F.coalesce(F.avg(F.when(F.col("fallback_used"), F.col("hit").cast("double"))), F.lit(0.0)).alias("fallback_recovery_rate"),
        F.coalesce(F.avg(F.when(F.col("spread") == "distributed", F.col("pages_found"))), F.lit(0.0)).alias("multi_region_recall"),
    )


def category_counts(rows: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """counts: how often each value of a column occurs, as a map."""
    per = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).count()
    return per.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "count")))).alias("counts"))


def scope_summary(rows: DataFrame) -> DataFrame:
    """rows: page_hit, scope_hit, compliant, precision, mode, fallback_used. Rates over all of them."""
    rate = lambda c, name: F.coalesce(F.avg(c.cast("double")), F.lit(0.0)).alias(name)
    return rows.agg(
        F.count(F.lit(1)).alias("questions"), rate(F.col("page_hit"), "page_hit_rate"), rate(F.col("scope_hit"), "scope_hit_rate"), rate(F.col("compliant"), "compliance_rate"), rate(F.col("precision"), "precision_mean"),
        rate(F.col("mode") == "hard_region", "hard_scope_rate"), rate(F.col("fallback_used"), "fallback_rate"),
    )


def trigger_summary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """rows: triggered, weak_trigger, spread_trigger, gap_trigger. How often each fires, and how often any does."""
    count = lambda c: F.count_if(F.col(c)).alias(c.removesuffix("_trigger") + ("_triggered" if c != "triggered" else ""))
    return rows.groupBy(*by).agg(count("triggered"), F.coalesce(F.avg(F.col("triggered").cast("double")), F.lit(0.0)).alias("trigger_rate"), *[count(c) for c in ("weak_trigger", "spread_trigger", "gap_trigger")])


def margins(reports: DataFrame, system: str, local: str, metrics: list[str]) -> DataFrame:
    """Each other system with the local one's lead in each metric: the difference of the means over all reports, null where one has none."""
    means = reports.groupBy(system).agg(*[F.avg(m).alias(m) for m in metrics])
    own = means.where(F.col(system) == local).select(*[F.col(m).alias("_" + m) for m in metrics])
    # One row meets a row for each system.
    return means.where(F.col(system) != local).join(own).select(system, *[(F.col("_" + m) - F.col(m)).alias(m) for m in metrics])
