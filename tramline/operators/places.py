"""Places around stations: which elements belong to one, how surely parking does, and edges of a rail graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What speaks for and against parking being a station's, and classes by the least score.
PARKING_WEIGHTS = (("role", 4), ("station", 4), ("rail_operator", 3), ("nearby", 1), ("unrelated", -4), ("restricted", -2))
PARKING_CLASSES = ((7, "Official", 0.95), (4, "Likely", 0.8), (0, "Nearby", 0.55))
PARKING_REST = ("Unrelated", 0.2)


def parking(**signs: Column) -> Column:
    """Score, class and confidence of parking from booleans named as in PARKING_WEIGHTS; null counts as false."""
    score = sum((F.when(signs[k], n).otherwise(0) for k, n in PARKING_WEIGHTS if k in signs), F.lit(0))
    name, sure = F.lit(PARKING_REST[0]), F.lit(PARKING_REST[1])
    for least, k, v in reversed(PARKING_CLASSES):
        name, sure = F.when(score >= least, k).otherwise(name), F.when(score >= least, v).otherwise(sure)
    return F.struct(score.alias("score"), name.alias("kind"), sure.alias("confidence"))


def of_area(elements: DataFrame, memberships: DataFrame, areas: DataFrame) -> DataFrame:
    """Elements but those that are members of other areas only; members of no area stay."""
    other = memberships.join(areas, "area", "left_anti").select("element").distinct()
    own = memberships.join(areas, "area", "left_semi").select("element").distinct()
    return elements.join(other.join(own, "element", "left_anti"), "element", "left_anti")


def rail_edges(way_nodes: DataFrame) -> DataFrame:
    """(way, seq, node, cost) to undirected edges between neighbours on a way; of parallel ones the cheapest."""
    w = Window.partitionBy("way").orderBy("seq")
    step = way_nodes.withColumn("to", F.lead("node").over(w)).where("to is not null and to <> node")
    return step.groupBy(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).agg(F.min("cost").alias("cost"))
