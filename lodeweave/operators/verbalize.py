"""Entities as text.  Flags are Python booleans, so parts that are off never enter the plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import entity_name, predicate_name
from . import graph

#: What stands for an entity that shows neither name nor url (fixed value).
ANONYMOUS = "An Entity"


def ordered_join(pairs, sep: str) -> Column:
    """Strings of an array of structs (order..., line), in order, joined."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["line"]), sep)


@dataclass(frozen=True)
class Flags:
    """What a verbalised entity shows."""

    use_name: bool = True
    use_url: bool = True
    use_translated_url: bool = False
    use_relationship: bool = True
    use_attributes: bool = True
    use_inverse: bool = False
    neighbors_use_attr: bool = False
    head_use_attr: bool = False


def header(ents: DataFrame, attr: DataFrame, use_name: bool = False, use_url: bool = True, translated: DataFrame | None = None) -> DataFrame:
    """(kg, entity, header): [name ][url name or translated name ]; the last blank stays, nothing shown is ''.

    ``translated`` (kg, entity, translated) replaces url names; an entity that it lacks is an error.
    """
    out = ents.select("kg", "entity")
    parts = [F.lit("")]
    if use_name:
        out = out.join(graph.alias(attr), ["kg", "entity"], "left")
        parts.append(F.coalesce(F.concat("alias", F.lit(" ")), F.lit("")))
    if use_url and translated is not None:
        out = out.join(translated.select("kg", "entity", "translated"), ["kg", "entity"], "left")
        known = F.when(F.col("translated").isNull(), F.raise_error(F.concat(F.lit("no translated name of "), "entity"))).otherwise(F.col("translated"))
        parts.append(F.concat(known, F.lit(" ")))
    elif use_url:
        parts.append(F.concat(entity_name(F.col("entity")), F.lit(" ")))
    return out.select("kg", "entity", F.concat(*parts).alias("header"))


def serialized(ents: DataFrame, attr: DataFrame, use_name: bool, use_url: bool, translated: DataFrame | None, with_attributes: bool) -> DataFrame:
    """(kg, entity, text): an entity inside a line: its header or ANONYMOUS, and all its attributes in brackets if asked for."""
    out = header(ents, attr, use_name, use_url, translated)
    text = F.when(F.col("header") == "", F.lit(ANONYMOUS)).otherwise(F.col("header"))
    if with_attributes:
        one = F.concat(F.lit(" "), predicate_name(F.col("attr")), F.lit(":"), F.col("value"), F.lit(";"))
        suffix = attr.groupBy("kg", "entity").agg(ordered_join(F.collect_list(F.struct("attr", "value", one.alias("line"))), "").alias("suffix"))
        out = out.join(suffix, ["kg", "entity"], "left")
        text = F.concat(text, F.lit(" ["), F.coalesce("suffix", F.lit("")), F.lit("]"))
    return out.select("kg", "entity", text.alias("text"))


def relation_lines(rel: DataFrame, attr: DataFrame | None = None, use_name: bool = False, use_url: bool = True, use_inverse: bool = False, neighbors_use_attr: bool = False, head_use_attr: bool = False, translated: DataFrame | None = None) -> DataFrame:
    """(kg, entity, relations): one line an edge; an inverse edge is printed in its first direction.

    Names that are parts of urls need no join; anything else is joined on both ends.
    """
    e = graph.inverse_edges(rel) if use_inverse else rel.select("kg", "head", "rel", "tail").withColumn("is_inv", F.lit(False))
    if use_name or translated is not None or neighbors_use_attr or head_use_attr:
        ends = e.select("kg", F.explode(F.array("head", "tail")).alias("entity")).distinct()

        def side(name: str, with_attributes: bool) -> DataFrame:
            text = serialized(ends, attr, use_name, use_url, translated, with_attributes)
            return text.select("kg", F.col("entity").alias(name), F.col("text").alias(f"{name}_text"))

        e = e.join(side("head", head_use_attr), ["kg", "head"]).join(side("tail", neighbors_use_attr), ["kg", "tail"])
        h, t = F.col("head_text"), F.col("tail_text")
    elif use_url:
        h, t = (F.concat(entity_name(F.col(c)), F.lit(" ")) for c in ("head", "tail"))
    else:
        h = t = F.lit(ANONYMOUS)
    name = predicate_name(F.col("rel"))
    line = F.when(F.col("is_inv"), F.concat_ws(" ", t, name, h)).otherwise(F.concat_ws(" ", h, name, t))
    lines = e.select("kg", F.col("head").alias("entity"), F.struct("rel", "tail", line.alias("line")).alias("x"))
    return lines.groupBy("kg", "entity").agg(ordered_join(F.collect_list("x"), "\n").alias("relations"))


def attribute_lines(attr: DataFrame) -> DataFrame:
    line = F.concat(predicate_name(F.col("attr")), F.lit(" "), F.col("value"))
    return attr.groupBy("kg", "entity").agg(ordered_join(F.collect_list(F.struct("attr", "value", line.alias("line"))), "\n").alias("attributes"))


def full(rel: DataFrame, attr: DataFrame, flags: Flags = Flags(), translated: DataFrame | None = None) -> DataFrame:
    """(kg, entity, sequence): the header, then a line for each edge and each attribute, as the flags say."""
    if flags.use_translated_url and translated is None:
        raise ValueError("use_translated_url needs the translated names")
    names = translated if flags.use_translated_url else None
    out = header(graph.entities(rel, attr), attr, flags.use_name, flags.use_url, names)
    text = F.col("header")
    if flags.use_relationship:
        lines = relation_lines(rel, attr, flags.use_name, flags.use_url, flags.use_inverse, flags.neighbors_use_attr, flags.head_use_attr, names if flags.use_url else None)
        out = out.join(lines, ["kg", "entity"], "left")
        text = F.concat(text, F.coalesce(F.concat(F.lit("\n"), F.col("relations")), F.lit("")))
    if flags.use_attributes:
        out = out.join(attribute_lines(attr), ["kg", "entity"], "left")
        text = F.concat(text, F.coalesce(F.concat(F.lit("\n"), F.col("attributes")), F.lit("")))
    return out.select("kg", "entity", text.alias("sequence"))


def choices(candidates: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """(a) first\\n(b) second ... per key."""
    line = F.concat(F.lit("("), F.char(F.lit(96) + F.col(order)), F.lit(") "), F.col(label))
    return candidates.groupBy(key).agg(ordered_join(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))), "\n").alias("choices"))


def truncate_pair(query, doc, limit: int):
    """Both texts cut in proportion to their words, if they have over ``limit`` together."""
    q, d = F.split(query, " "), F.split(doc, " ")
    n, m = F.size(q), F.size(d)
    keep = F.floor(n / (n + m) * limit).cast("int")
    over = n + m > limit
    return F.when(over, F.array_join(F.slice(q, F.lit(1), F.greatest(keep, F.lit(0))), " ")).otherwise(query), F.when(over, F.array_join(F.slice(d, F.lit(1), limit - keep), " ")).otherwise(doc)


def with_instruction(query: Column, instruction: str | None) -> Column:
    """The query behind its instruction, if there is one."""
    return F.concat(F.lit(instruction), query) if instruction else query
