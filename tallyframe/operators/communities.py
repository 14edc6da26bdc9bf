"""Communities of a graph by modularity: vertices move by their gain, communities are contracted, until nothing gains.

In a round, the weights between each vertex and the communities around it are summed, and the vertex moves to the one
where it adds most to modularity, if that is more than by staying. All moves of a round are made at once, so only half
of the vertices, chosen by hash and anew every two rounds, move in it; a round that doesn't raise modularity is undone,
and two such in a row end a level. A level's communities become vertices, whose weights and degrees are sums, and
levels go on until one raises nothing. A round is joins and sums over the edges, whatever the number of communities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Exact whole numbers for products of degrees.
WHOLE = "decimal(38,0)"


def modularity_communities(edges: DataFrame, weight: str | None = None, directed: bool = True) -> DataFrame:
    """``id, community`` of every id of ``edges`` (source, target): a community bears its smallest id.

    Without ``weight``, each distinct edge counts once; else that column's whole numbers are summed over an edge's
    rows. ``directed`` compares edges with the products of out- and in-degrees, else of degrees. Edges with a null end
    are left out; loops count in degrees alone. A vertex without edges to others stays alone; no edges give no rows.
    """
    some = edges.where("source is not null and target is not null")
    each = some.select("source", "target").distinct().withColumn("w", F.lit(1).cast("long")) if weight is None else some.groupBy("source", "target").agg(F.sum(F.col(weight).cast("long")).alias("w"))
    if not directed:
        each = each.union(each.select("target", "source", "w")).groupBy("source", "target").agg(F.sum("w").alias("w"))
    each = stored(each, "edges")
    total = int(each.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0])
    zero = F.lit(0).cast("long")
    ends = each.select(F.col("source").alias("v"), F.col("w").alias("out"), zero.alias("in")).union(each.select("target", zero, "w"))
    vertices = stored(ends.groupBy("v").agg(F.sum("out").alias("out"), F.sum("in").alias("in")), "vertices")
    near = stored(joined_up(each.select(F.col("source").alias("v"), F.col("target").alias("x"), "w").union(each.select("target", "source", "w"))), "neighbours")
    members = vertices.select(F.col("v").alias("id"), F.col("v").alias("c"))
    turn = 0
    while True:
        at = vertices.select("v", F.col("v").alias("c"))
        first = best = modularity(near, vertices, at, total)
        idle = 0
        while idle < 2:
            after = stored(moved(near, vertices, at, total, turn), "members")
            value, turn = modularity(near, vertices, after, total), turn + 1
            if value > best:
                at, best, idle = after, value, 0
            else:
                idle += 1
        if best <= first:
            break
        members = stored(relabelled(members, at, "c"), "members")
        vertices = stored(relabelled(vertices, at, "v").groupBy("v").agg(F.sum("out").alias("out"), F.sum("in").alias("in")), "vertices")
        near = stored(joined_up(relabelled(relabelled(near, at, "v"), at, "x")), "neighbours")
    return members.join(members.groupBy("c").agg(F.min("id").alias("community")), "c").select("id", "community")


def joined_up(near: DataFrame) -> DataFrame:
    """The weight between each two different vertices, from both sides."""
    return near.where("v <> x").groupBy("v", "x").agg(F.sum("w").alias("w"))


def relabelled(rows: DataFrame, at: DataFrame, column: str) -> DataFrame:
    """``column`` by its vertex's community (``v, c``)."""
    to = at.select(F.col("v").alias(column), F.col("c").alias("__to"))
    return rows.join(to, column).withColumn(column, F.col("__to")).drop("__to")


def times(a: Column | int, b: Column) -> Column:
    whole = lambda x: (F.lit(x) if isinstance(x, int) else x).cast(WHOLE)
    return (whole(a) * whole(b)).cast(WHOLE)


def degrees(vertices: DataFrame, at: DataFrame) -> DataFrame:
    return vertices.join(at, "v").groupBy("c").agg(F.sum("out").alias("all_out"), F.sum("in").alias("all_in"))


def modularity(near: DataFrame, vertices: DataFrame, at: DataFrame, total: int) -> int:
    """Modularity less 1, times the square of the total weight: what it lacks is the weight between communities."""
    left, right = at.select("v", F.col("c").alias("mine")), at.select(F.col("v").alias("x"), F.col("c").alias("other"))
    between = near.join(left, "v").join(right, "x").where("mine <> other").agg(F.sum("w").cast(WHOLE).alias("s"))
    expected = degrees(vertices, at).agg(F.sum(times(F.col("all_out"), F.col("all_in"))).cast(WHOLE).alias("s"))
    found = {r.what: int(r.s or 0) for r in between.select(F.lit("between").alias("what"), "s").union(expected.select(F.lit("expected"), "s")).collect()}
    return -(found["between"] // 2 * total + found["expected"])


def moved(near: DataFrame, vertices: DataFrame, at: DataFrame, total: int, turn: int) -> DataFrame:
    """``v, c`` after the moves of one round."""
    lively = lambda v: F.pmod(F.xxhash64(v, F.lit(turn // 2)) + turn, F.lit(2)) == 0
    own = vertices.where(lively("v")).join(at, "v").withColumnRenamed("c", "mine")
    around = near.where(lively("v")).join(at.withColumnRenamed("v", "x"), "x").select("v", "c", "w")
    sums = around.union(own.select("v", "mine", F.lit(0).cast("long"))).groupBy("v", "c").agg(F.sum("w").alias("w"))
    options = sums.join(own, "v").join(degrees(vertices, at), "c").withColumn("stays", F.col("c") == F.col("mine"))
    # what a vertex meets in its own community is the others
    less = lambda whole, mine: F.col(whole) - F.when(F.col("stays"), F.col(mine)).otherwise(0)
    gain = (times(total, F.col("w")) - times(F.col("out"), less("all_in", "in")) - times(F.col("in"), less("all_out", "out"))).cast(WHOLE)
    best = options.select("v", F.struct(gain.alias("gain"), "stays", "c").alias("to")).groupBy("v").agg(F.max("to").alias("to"))
    return at.join(best, "v", "left").select("v", F.coalesce("to.c", "c").alias("c"))
