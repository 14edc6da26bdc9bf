"""The fact validator: eight rules as columns, each cross-fact rule as one equi-join.

A fact starts at confidence 1 and loses 0.3 for an unknown district, 0.2 for an unknown indicator, 0.2 for a value out
of range or 0.3 for a missing one, 0.1 for a bad year, 0.05 for a unit, 0.1 for an outlier, and 0.05 for each
inconsistency and each jump. Confidence is counted in hundredths, so it doesn't depend on the order of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import DISTRICTS, FIRST_YEAR, GROWTH_LIMIT, IQR_FACTOR, Z_LIMIT
from ..sources.tables import stored
from .filters import ranges

#: Ranks of a span in which a run of equal values is looked up.
SPAN = 4096


#: Indicators that sums and ratios compare, and their columns.
WANTED = {"Boys Enrollment": "boys", "Girls Enrollment": "girls", "Primary Enrollment": "primary", "Upper Primary Enrollment": "upper", "Total Enrollment": "total", "Number of Teachers": "teachers"}


def first_values(facts: DataFrame) -> DataFrame:
    """``district, indicator, year, value`` of the first fact, in order, of each such group; combined before the shuffle, unsorted."""
    order = F.coalesce("ord", F.lit(-(1 << 63)))
    return facts.groupBy("district", "indicator", "year").agg(F.min_by("value", order).alias("value"))


def lookup(facts: DataFrame, indicator: str, name: str) -> DataFrame:
    """The first fact, in order, of an indicator for each district and year."""
    return first_values(facts.where(F.col("indicator") == indicator)).select("district", "year", F.col("value").alias(name))


def matches(first: DataFrame) -> DataFrame:
    """``district, year`` and a column for each indicator that is compared, from the groups' first values."""
    return first.groupBy("district", "year").agg(*[F.max(F.when(F.col("indicator") == k, F.col("value"))).alias(v) for k, v in WANTED.items()])


def with_matches(facts: DataFrame) -> DataFrame:
    """Totals beside their parts, ratios beside their terms: one aggregation by district and year, one join."""
    return facts.join(matches(first_values(facts.where(F.col("indicator").isin(list(WANTED))))), ["district", "year"], "left")


def inconsistencies(m: DataFrame) -> Column:
    """How many of the three sums and ratios fail."""
    v = F.col("value")
    parts = (F.col("indicator") == "Total Enrollment") & (F.abs(v - (F.col("boys") + F.col("girls"))) > 0.05 * v)
    levels = (F.col("indicator") == "Total Enrollment") & (F.col("primary") + F.col("upper") > v * 1.1)
    ratio = (F.col("indicator") == "Pupil Teacher Ratio") & (F.col("teachers") > 0) & (F.abs(v - F.try_divide("total", "teachers")) > 0.1 * v)
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in (parts, levels, ratio)), F.lit(0))


def year_before(first: DataFrame) -> DataFrame:
    """``district, indicator, year, previous``: the groups' first values, moved to the next year."""
    return first.select("district", "indicator", (F.col("year") + 1).alias("year"), F.col("value").alias("previous"))


def previous_year(facts: DataFrame) -> DataFrame:
    """``fact_id, previous``: the value of the same district and indicator exactly one year before, if any."""
    return facts.join(year_before(first_values(facts)), ["district", "indicator", "year"]).select("fact_id", "value", "previous")


def district_statistics(facts: DataFrame) -> DataFrame:
    """``indicator, year, district, peers, mean, deviation, q1, q3`` over other districts' values of an indicator and year.

    What a district leaves out are its own values: sums are the group's less its own. Equal values of a district are one
    run; runs are sorted once in each group of indicator and year, and the others' k-th value stands at rank k moved up
    by the own runs before it, in the run that covers this rank, found through spans of ``SPAN`` ranks. Only groups with
    three other values at least are returned; a group of n values makes n rows at most, not n squared.
    """
    group, mine = ["indicator", "year"], ["indicator", "year", "district"]
    have = facts.select(*mine, "value").dropna(subset=mine)
    runs = have.where("value is not null").groupBy(*mine, "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = stored(runs.withColumn("end", upto).withColumn("start", F.col("end") - F.col("n") + 1), "runs")
    moments = have.groupBy(*mine).agg(F.count("value").alias("n"), F.sum(F.col("value").cast("decimal(28,2)")).alias("s"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    centre = moments.groupBy(*group).agg((F.sum(F.col("m") * F.col("n")) / F.sum(F.when(F.col("n") > 0, F.col("n")))).alias("centre"))
    x = F.col("m") - F.col("centre")
    own = moments.join(centre, group).withColumns({"s1": F.col("n") * x, "s2": F.col("n") * (F.col("v") + x * x)})
    sums = own.groupBy(*group).agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "s", "s1", "s2")])
    less = lambda c: F.col(f"all_{c}") - F.coalesce(c, F.lit(0))
    lists = ranked.groupBy(*mine).agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("runs"))
    others = own.join(sums, group).withColumn("peers", less("n")).where("peers >= 3").join(lists, mine, "left")
    at = {f"{q}_{side}": how(p * (F.col("peers") - 1)) + 1 for q, p in (("q1", 0.25), ("q3", 0.75)) for side, how in (("low", F.floor), ("high", F.ceil))}
    at |= {"least": F.lit(1).cast("long"), "most": F.col("peers")}
    moved = lambda k: F.aggregate("runs", k, lambda t, r: F.when(r["start"] <= t, t + r["n"]).otherwise(t))
    rank = lambda k: F.coalesce(moved(k), k)
    others = stored(others.withColumns({f"rank_{name}": rank(k) for name, k in at.items()}).drop("runs"), "others")
    wanted = others.select(*mine, F.explode(F.create_map(*[c for name in at for c in (F.lit(name), F.col(f"rank_{name}"))])).alias("which", "rank")).withColumn("span", F.floor(F.col("rank") / SPAN))
    spans = ranked.select(*group, "start", "end", "value", F.explode_outer(F.sequence(F.floor(F.col("start") / SPAN), F.floor(F.col("end") / SPAN))).alias("span"))
    met = wanted.join(spans, [*group, "span"]).where("rank between start and end")
    found = met.groupBy(*mine).agg(*[F.max(F.when(F.col("which") == name, F.col("value"))).alias(name) for name in at])

    def quantile(q: str, p: float) -> Column:
        place = p * (F.col("peers") - 1)
        low, high = F.col(f"{q}_low"), F.col(f"{q}_high")
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(q)

    mean = ((F.col("all_s") - F.coalesce("s", F.lit(0))).cast("double") / F.col("peers")).alias("mean")
    spread = F.greatest(F.lit(0.0), less("s2") / F.col("peers") - F.pow(less("s1") / F.col("peers"), 2))
    deviation = F.when(F.col("least") == F.col("most"), 0.0).otherwise(F.sqrt(spread)).alias("deviation")
    return others.join(found, mine).select(*mine, "peers", mean, deviation, quantile("q1", 0.25), quantile("q3", 0.75))


def peer_statistics(facts: DataFrame) -> DataFrame:
    """``fact_id, value`` beside the statistics of other districts' facts of the same indicator and year (three at least)."""
    keys = ["indicator", "year", "district"]
    return facts.select(*keys, "fact_id", "value").join(district_statistics(facts), keys).select("fact_id", "value", "peers", "mean", "deviation", "q1", "q3")


def outlier(value: Column, mean: Column, deviation: Column, q1: Column, q3: Column) -> Column:
    """By z-score where the peers deviate, else or also by the interquartile range."""
    z = F.coalesce((deviation > 0) & (F.abs(value - mean) / deviation > Z_LIMIT), F.lit(False))
    width = q3 - q1
    iqr = F.coalesce((width > 0) & ((value < q1 - IQR_FACTOR * width) | (value > q3 + IQR_FACTOR * width)), F.lit(False))
    return z | iqr


def validated(facts: DataFrame, as_of_year: int) -> DataFrame:
    """``facts`` with known_indicator, is_valid, confidence, n_errors, n_warnings and n_anomalies, and the rule arrays.

    What facts are compared with is one row for each district, indicator and year, written first: facts meet it in one
    join, which needs no shuffle of them where that table is small.
    """
    keys = ["district", "indicator", "year"]
    known = facts.join(F.broadcast(ranges(facts)), "indicator", "left")
    first = stored(first_values(facts).dropna(subset=keys), "first")
    beside = first.select(*keys).join(district_statistics(facts).drop("peers"), keys, "left").join(year_before(first), keys, "left").join(matches(first), ["district", "year"], "left")
    m = known.join(stored(beside, "beside"), keys, "left").withColumn("out", outlier(*map(F.col, ("value", "mean", "deviation", "q1", "q3"))))
    jump = (F.col("previous") > 0) & (F.abs(F.col("value") - F.col("previous")) / F.col("previous") > GROWTH_LIMIT)
    m = m.withColumn("jump", jump)
    no = lambda c: F.coalesce(c, F.lit(False))
    district, indicator = no(F.col("district").isin(DISTRICTS)), F.col("low").isNotNull()
    range_, missing = no(~F.col("value").between(F.col("low"), F.col("high"))), F.col("value").isNull()
    year = no(F.col("year").between(FIRST_YEAR, as_of_year + 1))
    unit = indicator & ~no(F.col("unit") == F.col("expected_unit"))
    out, jump, inconsistent = district & indicator & no(F.col("out")), no(F.col("jump")), inconsistencies(m)
    lost = 30 * (~district).cast("int") + 20 * (~indicator).cast("int") + 20 * range_.cast("int") + 30 * missing.cast("int") + 10 * (~year).cast("int") + 5 * unit.cast("int") + 10 * out.cast("int") + 5 * inconsistent + 5 * jump.cast("int")
    wrong = ((~district, "DIST_001"), (~indicator, "IND_001"), (range_ | missing, "VAL_001"), (~year, "YEAR_001"))
    doubtful = ((unit, "UNIT_001"), (out, "STAT_001"), (inconsistent > 0, "CONS_001"), (jump, "TEMP_001"))
    errors, warnings = (F.array_compact(F.array(*[F.when(c, r) for c, r in rules])) for rules in (wrong, doubtful))
    n_errors = sum((c.cast("int") for c, _ in wrong), F.lit(0))
    n_warnings = unit.cast("int") + out.cast("int") + jump.cast("int") + inconsistent
    # counts come from the rules, not from the arrays, which are made only where they are asked for
    counts = {"n_errors": n_errors, "n_warnings": n_warnings, "n_anomalies": out.cast("int"), "is_valid": n_errors == 0}
    counted = m.withColumns({"errors": errors, "warnings": warnings, "known_indicator": indicator, "confidence": F.greatest(F.lit(0), 100 - lost) / F.lit(100.0)} | counts)
    return counted.select(*facts.columns, "known_indicator", "errors", "warnings", "n_errors", "n_warnings", "n_anomalies", "is_valid", "confidence")
