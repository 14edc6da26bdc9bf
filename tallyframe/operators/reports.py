"""Reports over runs, communities, question banks and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .windows import first_match


def community_summaries(members: DataFrame) -> DataFrame:
    """``community`` with its districts, indicators, years, size and theme: the commonest indicator, first seen on ties."""
    counts = members.groupBy("community", "indicator").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("seen"))
    theme = first_match(counts, ["community"], [F.desc("n"), "seen"]).select("community", F.col("indicator").alias("theme"))
    sums = members.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("district").alias("districts"), F.countDistinct("indicator").alias("indicators"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return sums.join(theme, "community")


def community_relevance(districts: Column, indicators: Column, year_overlap: Column, asked: Column) -> Column:
    """0.3 for each asked name among the districts, 0.4 for each among the indicators, 0.3 for years in common, at most 1.

    Names are compared in lower case, each once; nulls count as none.
    """
    low = lambda names: F.array_distinct(F.transform(names, F.lower))
    common = lambda have: F.coalesce(F.size(F.array_intersect(low(have), low(asked))), F.lit(0))
    return F.least(F.lit(1.0), 0.3 * common(districts) + 0.4 * common(indicators) + F.when(year_overlap, 0.3).otherwise(0.0))


def recommendations(quality: Column, coverage: Column, enhanced: Column, supersessions: Column, last_year: Column, anomaly_rate: Column, as_of_year: int) -> Column:
    """The advice whose threshold is passed, in order."""
    rules = [
        (quality < 0.7, "improve data quality"),
        (coverage < 0.8, "extend district coverage"),
        (enhanced < 0.5, "improve table parsing"),
        (supersessions > 0, "review superseded orders"),
        (last_year < as_of_year - 1, "add recent data"),
        (anomaly_rate > 0.1, "check anomalies"),
    ]
    return F.array_compact(F.array(*[F.when(c, text) for c, text in rules]))


def application_lists(items: DataFrame) -> DataFrame:
    """``doc_id, district, indicator, value, confidence``: rows of a list, and its distinct school codes if any.

    Items of under ten characters or without a district are left out.
    """
    used = items.where((F.length("text") >= 10) & F.col("district").isNotNull())
    code = F.nullif(F.regexp_extract("text", "([0-9]{8,})", 1), F.lit(""))
    sums = used.groupBy("doc_id", "district").agg(F.count(F.lit(1)).alias("applications"), F.countDistinct(code).alias("schools"))
    each = F.explode(F.array(F.struct(F.lit("Applications").alias("indicator"), F.col("applications").alias("value"), F.lit(0.8).alias("confidence")), F.struct(F.lit("Schools").alias("indicator"), F.col("schools").alias("value"), F.lit(0.7).alias("confidence"))))
    return sums.select("doc_id", "district", each.alias("f")).select("doc_id", "district", "f.*").where("value > 0")


def pass_rates(results: DataFrame) -> DataFrame:
    """Pass rates overall, by category and by difficulty, from one grouping-sets pass."""
    out = results.groupingSets([[], ["category"], ["difficulty"]], "category", "difficulty").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "category").otherwise("difficulty")
    return out.select(dimension.alias("dimension"), F.coalesce("category", "difficulty", F.lit("all")).alias("item"), "n", "passed", F.round(F.col("passed") / F.col("n"), 6).alias("rate"))


def evaluated(answers: DataFrame) -> DataFrame:
    """An answer passes with enough citations, the expected sources, confidence 0.6 and no warnings."""
    sources = F.size(F.array_except("expected_sources", "sources")) == 0
    return answers.withColumn("passed", (F.col("citations") >= F.col("citations_min")) & sources & (F.col("confidence") >= 0.6) & (F.col("warnings") == 0))


def final_verified(results: DataFrame, accuracy: float = 0.95) -> DataFrame:
    """Results of confidence ``accuracy`` or more; a consistency under 0.3 marks them as conflicting."""
    status = F.when(F.col("consistency") < 0.3, "conflicting").otherwise(F.col("status"))
    return results.where(F.col("confidence") >= accuracy).withColumn("status", status)


def citation_text(title: Column, section: Column, clause: Column, date: Column, page: Column) -> Column:
    part = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c.cast("string")))
    return F.concat_ws(", ", title, part("Section ", section), part("Clause ", clause), F.when(date.isNotNull(), F.concat(F.lit("("), date, F.lit(")"))), part("Page ", page))


def legal_chain(documents: DataFrame) -> DataFrame:
    """The last document of each type, acts before rules before orders."""
    rank = F.when(F.col("doc_type") == "act", 1).when(F.col("doc_type") == "rule", 2).when(F.col("doc_type") == "government_order", 3).otherwise(4)
    return first_match(documents, ["doc_type"], [F.desc("ord")]).withColumn("rank", rank)


def legal_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``child, parent``: the first parent whose title holds the child's reference as a run of words.

    Instead of comparing all titles, every run of words of a title becomes a key to join on, as many words long as some
    reference is: the lengths that occur (a small table) are joined first. A reference's first title is found once,
    however many children have it and parents hold it; texts that are repeated are split once.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    wanted = stored(children.where("reference is not null").select("reference").distinct().select("reference", words("reference").alias("r")).select("reference", F.size("r").alias("n"), F.array_join("r", " ").alias("k")), "references").where("n > 0")
    lengths = wanted.groupBy().agg(F.collect_set("n").alias("lengths"))
    titles = first_match(parents.where("title is not null").select("parent", "title"), ["title"], ["parent"])
    titled = titles.select("parent", words("title").alias("w")).crossJoin(F.broadcast(lengths))
    sized = titled.select("parent", "w", F.explode("lengths").alias("n")).where("n <= size(w)")
    runs = sized.select("parent", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("start"))
    keys = runs.select("parent", F.array_join(F.slice("w", F.col("start"), F.col("n")), " ").alias("k"))
    first = first_match(keys.join(wanted, "k", "left_semi"), ["k"], ["parent"])
    found = stored(wanted.join(first, "k").select("reference", "parent"), "parents")
    return first_match(children.join(found, "reference"), ["child"], ["parent"]).select("child", "parent")


def common_results(results: DataFrame, n_queries: int) -> DataFrame:
    """Results that every query found."""
    return results.groupBy("fact_id").agg(F.countDistinct("query").alias("n")).where(F.col("n") == n_queries).select("fact_id")


def checksum(columns: list[str]) -> Column:
    """MD5 of a row as JSON with its columns in name order."""
    return F.md5(F.to_json(F.struct(*sorted(columns))).cast("binary"))


def combined_text(items: DataFrame) -> DataFrame:
    """Texts of over ten characters of each document, in order, with a blank line between."""
    kept = items.where(F.length("text") > 10)
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
