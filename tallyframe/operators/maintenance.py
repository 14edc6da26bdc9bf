"""Delta maintenance: a run takes in the files that changed and rebuilds only the bridges that they touch.

The tracker holds every file's key, hash, status and the run that set them. A file that failed keeps its hash, so it is
tried again only when it has changed; what it had given before stays as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import changed
from ..sources.tables import stored

PROCESSED, FAILED = "processed", "failed"
TRACKER = "key string, hash string, status string, run int"
#: Types of bridges and the attributes of their groups.
GROUPS = {"DY": ["district", "year"], "IT": ["indicator", "district"]}


@dataclass(frozen=True)
class State:
    """What a run leaves: the tracker, the facts (each with its file), and the bridges."""

    tracker: DataFrame
    facts: DataFrame
    bridges: DataFrame


def groups_of(facts: DataFrame) -> DataFrame:
    """``bridge_type, bridge_id, fact_id`` of facts; groups with a null attribute make no bridge."""
    each = F.array(*[F.struct(F.lit(t).alias("bridge_type"), F.when(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull(), F.concat_ws("_", F.lit(t), *keys)).alias("bridge_id")) for t, keys in GROUPS.items()])
    return facts.select("fact_id", F.explode(each).alias("b")).select("b.*", "fact_id").where("bridge_id is not null")


def bridges_of(members: DataFrame) -> DataFrame:
    """``bridge_type, bridge_id, fact_ids`` (sorted)."""
    return members.groupBy("bridge_type", "bridge_id").agg(F.array_sort(F.collect_list("fact_id")).alias("fact_ids"))


def first_state(facts: DataFrame) -> State:
    """The state before any run; ``facts`` gives the columns."""
    spark, none = facts.sparkSession, facts.where("false")
    return State(spark.createDataFrame([], TRACKER), none, bridges_of(groups_of(none)))


def updated(state: State, files: DataFrame, extracted: DataFrame, failed: DataFrame, run: int) -> State:
    """The state after a run.

    ``files`` (key, hash) are all files there are, ``extracted`` the facts, with their ``key``, of files that were
    read, ``failed`` the keys of those that couldn't be. Only new and changed files are taken; files that are gone
    lose their facts and their tracker's row. A bridge is rebuilt if a fact of it came, went or may have changed, from the
    facts of its group; the others are passed on. Reading a file again or a run without changes alters nothing.
    """
    fresh = stored(changed(files.select("key", "hash"), state.tracker), "fresh")
    bad = failed.select("key").distinct()
    taken = fresh.join(bad, "key", "left_anti")
    gone = state.tracker.join(files.select("key"), "key", "left_anti").select("key")
    away = stored(taken.select("key").union(gone).distinct(), "away")
    new = extracted.join(taken.select("key"), "key", "left_semi").select(state.facts.columns)
    old = state.facts.join(away, "key", "left_semi")
    kept = state.facts.join(away, "key", "left_anti")
    facts = stored(kept.unionByName(new), "facts")
    touched = stored(groups_of(old.unionByName(new)).select("bridge_type", "bridge_id").distinct(), "touched")
    rebuilt = bridges_of(groups_of(facts).join(touched, ["bridge_type", "bridge_id"], "left_semi"))
    bridges = stored(state.bridges.join(touched, ["bridge_type", "bridge_id"], "left_anti").unionByName(rebuilt), "bridges")
    status = fresh.join(bad.withColumn("bad", F.lit(True)), "key", "left").select("key", "hash", F.when(F.col("bad"), FAILED).otherwise(PROCESSED).alias("status"), F.lit(run).alias("run"))
    passed = state.tracker.join(files.select("key"), "key", "left_semi").join(fresh.select("key"), "key", "left_anti")
    return State(stored(passed.unionByName(status), "tracker"), facts, bridges)
