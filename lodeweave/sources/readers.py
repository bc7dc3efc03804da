"""Readers for knowledge-graph files; every one has an explicit schema, and bad rows are dropped by a join or a filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import clean_literal, entity_name, hash_order

STATEMENT = r'^\s*<([^>]*)>\s+<([^>]*)>\s+"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?\s*\.\s*$'


def id_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="id bigint, url string", quote="")


def id_map_faults(ids: DataFrame) -> DataFrame:
    """Ids or urls that occur twice; empty for a one-to-one map."""
    by_id = ids.groupBy(F.col("id").cast("string").alias("key")).count().where("count > 1").withColumn("side", F.lit("id"))
    return by_id.unionByName(ids.groupBy(F.col("url").alias("key")).count().where("count > 1").withColumn("side", F.lit("url")))


def url_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="head string, rel string, tail string", quote="").dropna()


def decode(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Id triples (head, rel, tail) to urls; unknown ids drop the row."""
    e1, e2 = entities.select(F.col("id").alias("head"), F.col("url").alias("head_url")), entities.select(F.col("id").alias("tail"), F.col("url").alias("tail_url"))
    r = relations.select(F.col("id").alias("rel"), F.col("url").alias("rel_url"))
    return triples.join(e1, "head").join(r, "rel").join(e2, "tail").select("head_url", "rel_url", "tail_url")


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Literal statements as a set (entity, attr, value); lines that don't parse are left out."""
    c = F.col(column)
    ok = lines.where(c.rlike(STATEMENT))
    return ok.select(*[F.regexp_extract(c, STATEMENT, i).alias(n) for i, n in enumerate(("entity", "attr", "value"), 1)]).distinct()


def attribute_lines(spark: SparkSession, path: str, rdf: bool = True) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", schema="entity string, attr string, value string", quote="").dropna()
    return rows.withColumn("value", clean_literal(F.col("value"))).distinct() if rdf else rows


def links_by_url(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(url1, url2) to (id1, id2)."""
    a, b = left.select(F.col("url").alias("url1"), F.col("id").alias("id1")), right.select(F.col("url").alias("url2"), F.col("id").alias("id2"))
    return links.join(a, "url1").join(b, "url2").select("id1", "id2")


def strip_side(link, side: int):
    """`1@@name` to `name`, checking the side."""
    return F.when(F.assert_true(F.startswith(link, F.lit(f"{side}@@")), "wrong side").isNull(), F.split_part(link, F.lit("@@"), F.lit(2)))


def links_by_id(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="id1 bigint, id2 bigint", quote="").dropna()


def link_faults(links: DataFrame) -> DataFrame:
    """(key, n, side) of entities that are linked more than once; empty for one-to-one links."""
    a, b = links.columns[:2]
    sides = [links.groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1").withColumn("side", F.lit(c)) for c in (a, b)]
    return sides[0].unionByName(sides[1])


def one_to_one(links: DataFrame) -> DataFrame:
    """The links, or an error if an entity is linked twice."""
    bad = link_faults(links).first()
    if bad is not None:
        raise ValueError(f"{bad['key']} is linked {bad['n']} times on side {bad['side']}")
    return links


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of the lines of a file in order, ord from 0: the places of lines inside a file survive a single-file scan."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")))
    return lines.select(F.col("pos").cast("bigint").alias("ord"), F.col("col").alias("value"))


def translated_names(ids: DataFrame, lines: DataFrame, other: DataFrame) -> DataFrame:
    """(kg, entity, translated): line ord of the translation belongs to id ord of the first graph; the other graph keeps its url names."""
    first = ids.join(lines, "ord", "left").select(F.lit(1).alias("kg"), F.col("url").alias("entity"), F.coalesce("value", entity_name(F.col("url"))).alias("translated"))
    return first.unionByName(other.select(F.lit(2).alias("kg"), F.col("url").alias("entity"), entity_name(F.col("url")).alias("translated")))


SFT = "query string, pos array<string>, neg array<string>"


def sft_scan(spark: SparkSession, path: str, most: int | None = None, seed: str = "7") -> DataFrame:
    """Training records of a JSON-lines file or of every file of a folder, at most ``most`` of each file by hash order."""
    rows = spark.read.schema(SFT).json(path)
    if most is None:
        return rows
    w = Window.partitionBy("_file").orderBy(hash_order(seed, F.col("query")), "query")
    named = rows.withColumn("_file", F.input_file_name())
    return named.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k", "_file")


def corpus_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string").json(path)


@dataclass(frozen=True)
class Dataset:
    """How the files of a dataset kind are read: the form of its attribute triples, whether triples hold ids, and of its links."""

    attributes: str
    by_id: bool
    links: str


#: Dataset kinds.
DATASETS = {"DBP15K": Dataset("n3", True, "id"), "DW15KV2": Dataset("rdf-tsv", False, "url"), "MEDBBK9K": Dataset("tsv", False, "prefixed")}


def dataset(kind: str) -> Dataset:
    if kind.upper() not in DATASETS:
        raise ValueError(f"unknown dataset {kind}")
    return DATASETS[kind.upper()]


def load_attributes(spark: SparkSession, kind: str, path: str) -> DataFrame:
    form = dataset(kind).attributes
    return parse_ntriples(spark.read.text(path)) if form == "n3" else attribute_lines(spark, path, form == "rdf-tsv")


def load_relations(spark: SparkSession, kind: str, triples: str, entities: str | None = None, relations: str | None = None) -> DataFrame:
    """(head, rel, tail) as urls; kinds whose triples hold ids need both id maps."""
    if not dataset(kind).by_id:
        return url_triples(spark, triples)
    rows = spark.read.csv(triples, sep="\t", schema="head bigint, rel bigint, tail bigint", quote="").dropna()
    return decode(rows, id_map(spark, entities), id_map(spark, relations)).toDF("head", "rel", "tail")


def load_links(spark: SparkSession, kind: str, path: str) -> DataFrame:
    form = dataset(kind).links
    if form == "id":
        return one_to_one(links_by_id(spark, path))
    rows = spark.read.csv(path, sep="\t", schema="url1 string, url2 string", quote="").dropna()
    if form == "prefixed":
        rows = rows.select(strip_side(F.col("url1"), 1).alias("url1"), strip_side(F.col("url2"), 2).alias("url2"))
    return one_to_one(rows)
