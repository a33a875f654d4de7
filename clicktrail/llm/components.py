"""Connected components of a table of links, by contraction; nothing is gathered in one place."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.spark import materialize

#: Times that pointers are followed to where their ends point: 2 ** JUMPS steps in a round.
JUMPS = 2


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id of ``links (a, b)``; the component is its smallest id.

    A round points every node to the first of itself and its neighbours in a shuffled order, the hash of the id,
    follows the pointers a few steps, and goes on with the links between what they end in.  In a shuffled order pointers
    are short even on long chains, so links shrink by a constant factor each round.  Minima are combined before the
    shuffle and the other sides of joins have unique keys, so a node with any share of the links is no bottleneck.
    What a round makes is written.
    """
    edges = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    named = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        first = F.least(F.min(place("other")), place("node"))["id"]
        points = both.groupBy("node").agg(first.alias("to"))
        for _ in range(JUMPS):
            points = materialize(points, "points")
            on = points.select(F.col("node").alias("to"), F.col("to").alias("next"))
            points = points.join(on, "to").select("node", F.col("next").alias("to"))
        points = materialize(points, "points")
        if named is None:
            named = points.select(F.col("node").alias("id"), F.col("to").alias("component"))
        else:
            on = points.select(F.col("node").alias("component"), "to")
            named = materialize(named.join(on, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "components")
        at, of = points.select(F.col("node").alias("a"), F.col("to").alias("ta")), points.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        between = edges.join(at, "a").join(of, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        # an end that points on itself stays linked to where it points
        on = points.select(F.col("node").alias("a"), F.col("to").alias("b"))
        onward = on.join(points.select(F.col("to").alias("a")).distinct(), "a").select("a", "b")
        edges = materialize(between.union(onward).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if named is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    smallest = named.groupBy("component").agg(F.min("id").alias("smallest"))
    return named.join(smallest, "component").select("id", F.col("smallest").alias("component"))
