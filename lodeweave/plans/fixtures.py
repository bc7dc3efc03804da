"""A two-view knowledge graph over the star-schema tables, and a vector graph over the embeddings; in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RELATIONS = {"bought": ("boughtPart", "purchasedItem"), "supplied": ("suppliedBy", "soldByVendor"), "home": ("homeNation", "nationOf"), "based": ("basedIn", "vendorNation"), "region": ("inRegion", "regionOf")}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _url(kind: str, key: Column) -> Column:
    return F.concat(F.lit("http://kg"), F.col("kg").cast("string"), F.lit(f".example.org/resource/{kind}_"), key.cast("string"))


def _rel(name: str | Column) -> Column:
    one, two = RELATIONS[name]
    return F.concat(F.lit("http://kg"), F.col("kg").cast("string"), F.lit(".example.org/ontology/"), F.when(F.col("kg") == 1, one).otherwise(two))


def _views(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select((F.col("o_orderkey") % 2 + 1).cast("int").alias("kg"), F.col("o_custkey").alias("c"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))


def relations(spark: SparkSession, sf: str) -> DataFrame:
    """(kg, head, rel, tail): one scan of the order lines, whose edges of all kinds are made distinct on their keys."""
    cust, supp = table(spark, sf, "customer"), table(spark, sf, "supplier")
    li = _views(spark, sf).join(cust.select(F.col("c_custkey").alias("c"), F.col("c_nationkey").cast("long").alias("cn")), "c").join(supp.select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").cast("long").alias("sn")), "s")

    def edge(kind: str, a: str, b: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))

    edges = li.select("kg", F.explode(F.array(edge("bought", "c", "p"), edge("supplied", "p", "s"), edge("home", "c", "cn"), edge("based", "s", "sn"))).alias("e")).select("kg", "e.*").distinct()
    nation = table(spark, sf, "nation").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("kg"), F.lit("region").alias("kind"), F.col("n_nationkey").cast("long").alias("a"), F.col("n_regionkey").cast("long").alias("b"))
    ends = {"bought": ("Customer", "Part"), "supplied": ("Part", "Supplier"), "home": ("Customer", "Nation"), "based": ("Supplier", "Nation"), "region": ("Nation", "Region")}

    def of(pick) -> Column:
        out = F.lit(None).cast("string")
        for kind in ends:
            out = F.when(F.col("kind") == kind, pick(kind)).otherwise(out)
        return out

    return edges.unionByName(nation).select("kg", of(lambda k: _url(ends[k][0], F.col("a"))).alias("head"), of(_rel).alias("rel"), of(lambda k: _url(ends[k][1], F.col("b"))).alias("tail"))


def attributes(spark: SparkSession, sf: str) -> DataFrame:
    """(kg, entity, attr, value): one scan of the order lines for the keys of all kinds that occur."""
    both = F.explode(F.array(F.lit(1), F.lit(2))).alias("kg")
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key")) for kind, c in (("Customer", "c"), ("Supplier", "s"), ("Part", "p"))])
    keys = _views(spark, sf).select("kg", F.explode(kinds).alias("x")).select("kg", "x.*").distinct()

    def pairs(values: dict[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(a).alias("attr"), v.alias("value")) for a, v in values.items()]).alias("pairs")

    facts = table(spark, sf, "customer").select(F.lit("Customer").alias("kind"), F.col("c_custkey").alias("key"), pairs({"name": F.col("c_name"), "mktSegment": F.col("c_mktsegment"), "acctBal": money("c_acctbal")}))
    facts = facts.unionByName(table(spark, sf, "supplier").select(F.lit("Supplier").alias("kind"), F.col("s_suppkey").alias("key"), pairs({"name": F.col("s_name"), "acctBal": money("s_acctbal")})))
    facts = facts.unionByName(table(spark, sf, "part").select(F.lit("Part").alias("kind"), F.col("p_partkey").alias("key"), pairs({"title": F.col("p_name"), "brandName": F.col("p_brand"), "partType": F.col("p_type"), "size": F.col("p_size").cast("string")})))
    out = keys.join(facts, ["kind", "key"]).select("kg", "kind", "key", "pairs")
    out = out.unionByName(table(spark, sf, "nation").select(both, F.lit("Nation").alias("kind"), F.col("n_nationkey").cast("long").alias("key"), pairs({"label": F.col("n_name")})))
    out = out.unionByName(table(spark, sf, "region").select(both, F.lit("Region").alias("kind"), F.col("r_regionkey").cast("long").alias("key"), pairs({"label": F.col("r_name")})))
    root = F.concat(F.lit("http://kg"), F.col("kg").cast("string"), F.lit(".example.org/"))
    return out.select("kg", F.concat(root, F.lit("resource/"), F.col("kind"), F.lit("_"), F.col("key").cast("string")).alias("entity"), F.explode("pairs").alias("x"), root.alias("root")).select("kg", "entity", F.concat("root", F.lit("ontology/"), "x.attr").alias("attr"), "x.value")


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, documents, gold): the halves of the embeddings, k and n + k belong together."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    n = e.count() // 2
    q, d = e.where(F.col("id") < n), e.where((F.col("id") >= n) & (F.col("id") < 2 * n))
    return q, d, q.select(F.col("id").alias("q"), (F.col("id") + n).alias("gold"))


KG_SQL = """
li AS MATERIALIZED (SELECT (o_orderkey % 2 + 1)::INT AS kg, o_custkey AS c, l_partkey AS p, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
views AS (SELECT unnest([1, 2]) AS kg),
raw AS (
  SELECT DISTINCT kg, 'Customer_' || c AS h, CASE kg WHEN 1 THEN 'boughtPart' ELSE 'purchasedItem' END AS r, 'Part_' || p AS t FROM li
  UNION ALL SELECT DISTINCT kg, 'Part_' || p, CASE kg WHEN 1 THEN 'suppliedBy' ELSE 'soldByVendor' END, 'Supplier_' || s FROM li
  UNION ALL SELECT DISTINCT kg, 'Customer_' || c, CASE kg WHEN 1 THEN 'homeNation' ELSE 'nationOf' END, 'Nation_' || c_nationkey FROM li JOIN customer ON c = c_custkey
  UNION ALL SELECT DISTINCT kg, 'Supplier_' || s, CASE kg WHEN 1 THEN 'basedIn' ELSE 'vendorNation' END, 'Nation_' || s_nationkey FROM li JOIN supplier ON s = s_suppkey
  UNION ALL SELECT kg, 'Nation_' || n_nationkey, CASE kg WHEN 1 THEN 'inRegion' ELSE 'regionOf' END, 'Region_' || n_regionkey FROM nation, views),
rel AS MATERIALIZED (SELECT kg, 'http://kg' || kg || '.example.org/resource/' || h AS head, 'http://kg' || kg || '.example.org/ontology/' || r AS rel, 'http://kg' || kg || '.example.org/resource/' || t AS tail FROM raw),
rawattr AS (
  SELECT kg, 'Customer_' || c AS e, unnest([{'a': 'name', 'v': c_name}, {'a': 'mktSegment', 'v': c_mktsegment}, {'a': 'acctBal', 'v': c_acctbal::DECIMAL(18,2)::VARCHAR}]) AS x FROM (SELECT DISTINCT kg, c FROM li) JOIN customer ON c = c_custkey
  UNION ALL SELECT kg, 'Supplier_' || s, unnest([{'a': 'name', 'v': s_name}, {'a': 'acctBal', 'v': s_acctbal::DECIMAL(18,2)::VARCHAR}]) FROM (SELECT DISTINCT kg, s FROM li) JOIN supplier ON s = s_suppkey
  UNION ALL SELECT kg, 'Part_' || p, unnest([{'a': 'title', 'v': p_name}, {'a': 'brandName', 'v': p_brand}, {'a': 'partType', 'v': p_type}, {'a': 'size', 'v': p_size::VARCHAR}]) FROM (SELECT DISTINCT kg, p FROM li) JOIN part ON p = p_partkey
  UNION ALL SELECT kg, 'Nation_' || n_nationkey, {'a': 'label', 'v': n_name} FROM nation, views
  UNION ALL SELECT kg, 'Region_' || r_regionkey, {'a': 'label', 'v': r_name} FROM region, views),
attr AS MATERIALIZED (SELECT kg, 'http://kg' || kg || '.example.org/resource/' || e AS entity, 'http://kg' || kg || '.example.org/ontology/' || x.a AS attr, x.v AS value FROM rawattr)
"""

VEC_SQL = """
n AS (SELECT count(*) // 2 AS n FROM embeddings),
qs AS (SELECT vec_id AS q, embedding::DOUBLE[] AS v, label FROM embeddings, n WHERE vec_id < n),
ds AS (SELECT vec_id AS c, embedding::DOUBLE[] AS w, label AS dlabel FROM embeddings, n WHERE vec_id >= n AND vec_id < 2 * n),
sim AS MATERIALIZED (SELECT q, c, round({score}, 6) AS score, label, dlabel FROM qs, ds),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rk FROM sim),
gold AS (SELECT q, q + n AS gold FROM qs, n)
"""
SCORES = {"inner": "list_inner_product(v, w)", "cosine": "list_cosine_similarity(v, w)", "euclidean": "1 - list_distance(v, w)", "l2": "-power(list_distance(v, w), 2)", "manhattan": "1 - list_sum(list_transform(list_zip(v, w), lambda z: abs(z[1] - z[2])))"}


def kg_sql(body: str) -> str:
    return f"WITH {KG_SQL.rstrip()}{body if body.startswith(",") else " " + body}"


def vec_sql(body: str, metric: str = "cosine") -> str:
    sep = "" if body.startswith(",") else " "
    return f"WITH {VEC_SQL.format(score=SCORES[metric]).rstrip()}{sep}{body}"


def entity_name_sql(c: str) -> str:
    return f"replace(split_part({c}, '/', -1), '_', ' ')"


def predicate_name_sql(c: str) -> str:
    return f"lower(replace(regexp_replace(regexp_replace(split_part({c}, '/', -1), '_\\(inv\\)$', ''), '([a-z])([A-Z])', '\\1_\\2', 'g'), '_', ' '))"
