"""Reports, summaries and metrics over facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import DISTRICTS


def exact_sum(c: str) -> Column:
    """A sum of values of two decimals that doesn't depend on their order."""
    return F.sum(F.col(c).cast("decimal(28,2)")).cast("double")


def exact_avg(c: str, digits: int = 6) -> Column:
    return F.round(exact_sum(c) / F.count(c), digits)


def first_last(c: str, key: list[str], last: bool) -> Column:
    order = F.struct(*key)
    return F.max_by(c, order) if last else F.min_by(c, order)


def value_counts(facts: DataFrame, columns: list[str]) -> DataFrame:
    """``dimension, item, n`` of several columns in one pass of grouping sets."""
    sets = [[c] for c in columns]
    grouped = facts.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    width = len(columns)
    dimension, item = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        mine = F.col("g") == (1 << width) - 1 - (1 << (width - 1 - i))
        dimension, item = F.when(mine, F.lit(c)).otherwise(dimension), F.when(mine, F.col(c).cast("string")).otherwise(item)
    return grouped.select(dimension.alias("dimension"), item.alias("item"), "n")


def distinct_dimensions(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count(F.lit(1)).alias("total"), *[F.countDistinct(c).alias(f"{c}s") for c in ("district", "indicator", "year")])


def cross_district(facts: DataFrame) -> DataFrame:
    """For each indicator and year of three districts or more: the mean of district means, best, worst and the gap.

    Ties go to the district seen first for the best and last for the worst.
    """
    each = facts.groupBy("indicator", "year", "district").agg((exact_sum("value") / F.count("value")).alias("mean"), F.min("ord").alias("seen"))
    best, worst = F.max_by("district", F.struct("mean", -F.col("seen"))), F.min_by("district", F.struct("mean", -F.col("seen")))
    out = each.groupBy("indicator", "year").agg(
        F.count(F.lit(1)).alias("n_districts"), F.round(F.avg("mean"), 4).alias("state_average"), best.alias("highest_district"), worst.alias("lowest_district"), F.round(F.max("mean") - F.min("mean"), 4).alias("performance_gap")
    )
    return out.where("n_districts >= 3")


def district_year(facts: DataFrame) -> DataFrame:
    """Bridge of districts and years with two facts or more; null confidences count as one half."""
    out = facts.groupBy("district", "year").agg(
        F.count(F.lit(1)).alias("fact_count"), exact_sum("value").alias("total"), exact_avg("value").alias("average"), F.max("value").alias("highest"), F.min("value").alias("lowest"),
        F.round(F.max("value") - F.min("value"), 6).alias("span"), F.countDistinct("indicator").alias("indicators"),
        F.round(F.sum(F.coalesce("confidence_score", F.lit(0.5)).cast("decimal(10,4)")).cast("double") / F.count(F.lit(1)), 6).alias("confidence"),
    )
    return out.where("fact_count >= 2")


def indicator_temporal(facts: DataFrame) -> DataFrame:
    """Bridge of an indicator in a district over the years: slope between first and last, trend, extremes."""
    key = ["year", "ord"]
    out = facts.groupBy("indicator", "district").agg(
        F.count(F.lit(1)).alias("data_points"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        first_last("value", key, False).alias("earliest"), first_last("value", key, True).alias("latest"), exact_avg("value").alias("average"),
    )
    slope = F.when(F.col("last_year") > F.col("first_year"), F.round((F.col("latest") - F.col("earliest")) / (F.col("last_year") - F.col("first_year")), 6)).otherwise(0.0)
    trend = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable")
    return out.where("data_points >= 2").withColumn("slope", slope).withColumn("trend", trend).withColumn("year_span", F.col("last_year") - F.col("first_year") + 1)


def document_type(name: Column) -> Column:
    """First match of a document's name."""
    low = F.lower(name)
    out = F.when(F.coalesce(name, F.lit("")) == "", "unknown").when(low.contains("go_") | low.contains("government_order"), "government_order")
    for part, kind in (("cse_", "cse_document"), ("scert_", "scert_document"), ("act", "act"), ("rule", "rule")):
        out = out.when(low.contains(part), kind)
    return out.otherwise("general_document")


def policy_hierarchy(facts: DataFrame) -> DataFrame:
    """Bridge of document types of three facts or more with their indicators of two or more."""
    typed = facts.withColumn("doc_type", document_type(F.col("source_document")))
    out = typed.groupBy("doc_type", "indicator").agg(F.count(F.lit(1)).alias("fact_count"), *[F.countDistinct(c).alias(n) for c, n in (("source_document", "documents"), ("district", "districts"), ("year", "years"))])
    out = out.withColumn("of_type", F.sum("fact_count").over(Window.partitionBy("doc_type"))).where("of_type >= 3 and fact_count >= 2").drop("of_type")
    return out.withColumn("scope", F.when(F.col("districts") > 1, "multi_district").otherwise("single_district"))


def district_summary(checked: DataFrame) -> DataFrame:
    """All known districts, with zeros where there are no facts; ``checked`` has the validator's columns."""
    dims = checked.sparkSession.createDataFrame([(d,) for d in DISTRICTS], "district string")
    sums = checked.groupBy("district").agg(
        F.count(F.lit(1)).alias("total_facts"), F.count_if("is_valid").alias("valid_facts"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.sum("n_warnings").alias("warnings"), F.sum("n_errors").alias("errors"), F.sum("n_anomalies").alias("anomalies"),
    )
    zero = {c: 0 for c in ("total_facts", "valid_facts", "warnings", "errors", "anomalies")}
    return F.broadcast(dims).join(sums, "district", "left").fillna(zero | {"avg_confidence": 0.0})


def indicator_summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("indicator").agg(
        F.count(F.lit(1)).alias("total_facts"), F.min("value").alias("lowest"), F.max("value").alias("highest"), exact_avg("value", 4).alias("average"), F.round(F.stddev_pop("value"), 4).alias("deviation"), F.sum("n_anomalies").alias("anomalies")
    )


def year_summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("year").agg(
        F.count(F.lit(1)).alias("total_facts"), F.count_if("is_valid").alias("valid_facts"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.countDistinct(F.coalesce("district", F.lit("\0"))).alias("districts"), F.countDistinct("indicator").alias("indicators")
    )


def quality_metrics(checked: DataFrame) -> DataFrame:
    """Validity, completeness, rates, coverage of 13 districts and 22 indicators, years, mean confidence."""
    n = F.count(F.lit(1))
    share = lambda c: F.round(F.count_if(c) / n, 6)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return checked.agg(
        share(F.col("is_valid")).alias("validity"), share(text("district")).alias("district_completeness"), share(text("indicator")).alias("indicator_completeness"),
        share(F.col("value").isNotNull()).alias("value_completeness"), share(F.col("year").isNotNull()).alias("year_completeness"),
        share(F.col("n_warnings") > 0).alias("warning_rate"), share(F.col("n_anomalies") > 0).alias("anomaly_rate"),
        F.round(F.countDistinct(F.when(F.col("district").isin(DISTRICTS), F.col("district"))) / 13, 6).alias("district_coverage"), F.round(F.countDistinct(F.when(F.col("known_indicator"), F.col("indicator"))) / 22, 6).alias("indicator_coverage"),
        F.countDistinct("year").alias("years"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
    )


def trend_yearly(facts: DataFrame, first: int, last: int) -> DataFrame:
    """Each year's figures (years and values of 0 left out) and the direction from the first to the last mean."""
    used = facts.where((F.col("year") != 0) & (F.col("value") != 0) & F.col("year").between(first, last))
    years = used.groupBy("year").agg(F.count(F.lit(1)).alias("n"), exact_sum("value").alias("total"), (exact_sum("value") / F.count("value")).alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    ends = years.agg(F.min_by("mean", "year").alias("a"), F.max_by("mean", "year").alias("b"))
    change = F.try_divide(F.col("b") - F.col("a"), F.col("a")) * 100
    direction = F.when(change > 5, "increasing").when(change < -5, "decreasing").otherwise("stable")
    return years.crossJoin(F.broadcast(ends)).select("year", "n", "total", F.round("mean", 6).alias("mean"), "lowest", "highest", direction.alias("direction"))


def year_gaps(facts: DataFrame) -> DataFrame:
    """Consecutive distinct years more than one apart."""
    years = facts.select("year").where("year is not null").distinct().withColumn("one", F.lit(1))
    return years.withColumn("before", F.lag("year").over(Window.partitionBy("one").orderBy("year"))).where("year - before > 1").select("before", "year")


def sparse_indicators(facts: DataFrame, share: float = 0.3) -> DataFrame:
    """Indicators with fewer facts than a share of the mean over indicators."""
    counts = facts.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    return counts.crossJoin(F.broadcast(mean)).where(F.col("n") < share * F.col("mean")).select("indicator", "n")


def grouped(facts: DataFrame, keys: list[str]) -> DataFrame:
    """``key, n, members``: the facts alike in some columns (null: Unknown), in their order."""
    named = [F.coalesce(F.col(k).cast("string"), F.lit("Unknown")) for k in keys]
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "fact_id"))), lambda x: x["fact_id"]), ",")
    return facts.groupBy(F.concat_ws("_", *named).alias("key")).agg(F.count(F.lit(1)).alias("n"), members.alias("members"))


def extraction_metrics(items: DataFrame, least: float = 0.95) -> DataFrame:
    """``method, n, mean, documents, items, confidence, status`` of extracted items (doc_id, method, confidence).

    The last four are of all items; nulls don't count for a mean. Items pass from a mean confidence of ``least`` on. An
    empty table has no methods and so gives no rows.
    """
    every = items.agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("items"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    each = items.groupBy(F.coalesce("method", F.lit("unknown")).alias("method")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"))
    return each.crossJoin(F.broadcast(every)).withColumn("status", F.when(F.col("confidence") >= least, "passed").otherwise("warning"))


def consistency(counts: DataFrame, reference: str, least: float = 0.98) -> DataFrame:
    """``store, n, share, consistent``: each store's rows against those of one (store, n); no rows there give a share of 0."""
    of = counts.where(F.col("store") == reference).select(F.col("n").alias("__all"))
    share = F.coalesce(F.try_divide(F.col("n"), F.col("__all")), F.lit(0.0))
    return counts.where(F.col("store") != reference).crossJoin(F.broadcast(of)).select("store", "n", share.alias("share"), (share >= least).alias("consistent"))


def overall_status(stages: DataFrame, run: str) -> DataFrame:
    """``run, status``: passed if all stages passed, failed if any failed, else warning."""
    status = F.when(F.every(F.col("status") == "passed"), "passed").when(F.some(F.col("status") == "failed"), "failed").otherwise("warning")
    return stages.groupBy(run).agg(status.alias("overall"))


def store_summary(rows: DataFrame, store: str, key: str, k: int = 3) -> DataFrame:
    """``store, n, sample``: how many rows a store has, and its first keys."""
    counted = rows.agg(F.count(F.lit(1)).alias("n"))
    first = rows.select(F.col(key).cast("string").alias("key")).orderBy("key").limit(k).agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("sample"))
    return counted.crossJoin(first).select(F.lit(store).alias("store"), "n", "sample")


def graph_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes, edges, status``: a graph without nodes or edges has failed."""
    both = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
    return both.withColumn("status", F.when((F.col("nodes") > 0) & (F.col("edges") > 0), "passed").otherwise("failed"))
