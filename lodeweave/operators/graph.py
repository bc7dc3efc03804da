"""Graph construction and statistics over triples (kg, head, rel, tail) and (kg, entity, attr, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import INVERSE, NAME_ATTRIBUTES, predicate_name


def inverse_edges(rel: DataFrame) -> DataFrame:
    """Every edge and its inverse, from one scan."""
    both = F.array(F.struct("head", "rel", "tail", F.lit(False).alias("is_inv")), F.struct(F.col("tail").alias("head"), F.concat("rel", F.lit(INVERSE)).alias("rel"), F.col("head").alias("tail"), F.lit(True).alias("is_inv")))
    return rel.select("kg", F.explode(both).alias("e")).select("kg", "e.*")


def undirected(rel: DataFrame) -> DataFrame:
    both = F.array(F.struct("head", "tail"), F.struct(F.col("tail").alias("head"), F.col("head").alias("tail")))
    return rel.select("kg", F.explode(both).alias("e")).select("kg", F.col("e.head").alias("a"), F.col("e.tail").alias("b")).distinct()


def entities(rel: DataFrame, attr: DataFrame) -> DataFrame:
    ends = rel.select("kg", F.explode(F.array("head", "tail")).alias("entity"))
    return ends.unionByName(attr.select("kg", "entity")).distinct()


def stats(rel: DataFrame, attr: DataFrame) -> DataFrame:
    """Entities, relations (with inverses) and attributes of each graph, in one pass over the triples."""

    def named(**kinds: str):
        return F.explode(F.array(*[F.struct(F.lit(k.rstrip("_")).alias("kind"), F.col(c).alias("x")) for k, c in kinds.items()])).alias("y")

    every = rel.select("kg", named(e="head", e_="tail", r="rel")).unionByName(attr.select("kg", named(e="entity", a="attr"))).select("kg", "y.*").distinct()
    count = lambda kind: F.sum((F.col("kind") == kind).cast("bigint"))
    return every.groupBy("kg").agg(count("e").alias("entities"), (2 * count("r")).alias("relations"), count("a").alias("attributes"))


def adjacency(rel: DataFrame) -> DataFrame:
    """(kg, head, rel, n_tails, tails): the tails of each head and relation, in order, repeated ones too."""
    return rel.groupBy("kg", "head", "rel").agg(F.count("*").alias("n_tails"), F.array_join(F.array_sort(F.collect_list("tail")), " ").alias("tails"))


def relation_heads(rel: DataFrame) -> DataFrame:
    """(kg, rel, heads, tails, pairs): how many different heads and tails a relation joins, and how many pairs."""
    return rel.groupBy("kg", "rel").agg(F.count_distinct("head").alias("heads"), F.count_distinct("tail").alias("tails"), F.count("*").alias("pairs"))


def entity_attributes(attr: DataFrame) -> DataFrame:
    """(kg, entity, attr, values): the different values of each attribute of an entity, in order."""
    return attr.groupBy("kg", "entity", "attr").agg(F.array_sort(F.collect_set("value")).alias("values"))


def relation_functionality(rel: DataFrame) -> DataFrame:
    named = rel.select("kg", predicate_name(F.col("rel")).alias("rel_name"), "head", "tail").distinct()
    return named.groupBy("kg", "rel_name").agg(F.countDistinct("head").alias("heads"), F.count("*").alias("pairs")).select("kg", "rel_name", F.round(F.col("heads") / F.col("pairs"), 8).alias("functionality"))


def attribute_functionality(rel: DataFrame, attr: DataFrame) -> DataFrame:
    docs = entities(rel, attr).groupBy("kg").agg(F.count("*").alias("docs"))
    named = attr.select("kg", predicate_name(F.col("attr")).alias("attr_name"), "attr", "entity", "value").distinct()
    per = named.groupBy("kg", "attr_name", "entity", "attr").agg(F.count("*").alias("n"))
    per = per.groupBy("kg", "attr_name").agg(F.count("*").alias("cnt"), F.sum("n").alias("total"))
    return per.join(docs, "kg").select("kg", "attr_name", F.round(F.col("cnt") / F.col("total") * (F.col("cnt") / F.col("docs")), 8).alias("functionality"))


def relation_ids(rel: DataFrame, offset: int = 0) -> DataFrame:
    """Dense ids by first appearance (the smallest head and tail)."""
    first = rel.groupBy("kg", "rel").agg(F.min(F.struct("head", "tail")).alias("f"))
    return first.select("kg", "rel", (F.row_number().over(Window.partitionBy("kg").orderBy("f", "rel")) - 1 + offset).cast("bigint").alias("rel_id"))


def names(attr: DataFrame) -> DataFrame:
    """Lower-cased values of name attributes."""
    return attr.where(predicate_name(F.col("attr")).isin(*NAME_ATTRIBUTES)).select("kg", "entity", F.lower("value").alias("name"))


def alias(attr: DataFrame) -> DataFrame:
    return names(attr).groupBy("kg", "entity").agg(F.min("name").alias("alias"))
