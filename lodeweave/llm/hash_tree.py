"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child draws
-ln(u) / weight with u from a hash of the row's id and the child's name, and the
smallest draw wins, so children get rows in proportion to their weights.  A
changed weight therefore moves rows only into or out of the subtree that holds
it.  A shard that is added later is a *growth*: at the top it draws beside the
regions with its own weight, and a row that it wins goes straight down to it, so
growth takes rows only into the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class Tree:
    """weights: region -> rack -> shard number -> weight; growth: (region, rack, shard, weight) in order of arrival."""

    weights: dict[str, dict[str, dict[int, float]]]
    growth: tuple[tuple[str, str, int, float], ...] = field(default=())

    def grow(self, region: str, rack: str, shard: int, weight: float = 1.0) -> Tree:
        return Tree(self.weights, (*self.growth, (region, rack, shard, weight)))


def even_tree(n_shards: int, regions: int = 3, racks: int = 4) -> Tree:
    """n_shards of equal weight over regions x racks."""
    weights: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(n_shards):
        region, rack = f"region{s % regions}", f"rack{s // regions % racks}"
        weights.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return Tree(weights)


def _draw(key: Column, node: str, weight: float) -> Column:
    # 52 bits of a hash, never 0 or 1
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{node}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(float(weight))


def _winner(key: Column, nodes: list[tuple[str, float]]) -> Column:
    """Index of the node with the smallest draw; nodes without weight never win."""
    live = [(i, n, w) for i, (n, w) in enumerate(nodes) if w > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    return F.array_min(F.array(*[F.struct(_draw(key, n, w).alias("d"), F.lit(i).alias("i")) for i, n, w in live]))["i"]


def place(df: DataFrame, key: Column, tree: Tree, prefix: str = "") -> DataFrame:
    """df with {prefix}region, {prefix}rack, {prefix}shard of each row.

    Ids draw as text; a null id draws as an empty text, so all null ids share a shard.
    Weights under or at 0 get no rows; a tree without positive weight is an error.
    """
    total = {r: sum(w for k in racks.values() for w in k.values() if w > 0) for r, racks in tree.weights.items()}
    top = [*total.items(), *[(f"growth/{k}/{s}", w) for k, (_, _, s, w) in enumerate(tree.growth)]]
    if not any(w > 0 for _, w in top):
        raise ValueError("the tree has no weight")
    key = F.coalesce(key.cast("string"), F.lit(""))
    df = df.withColumn("_top", _winner(key, top))
    rack, shard = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (r, racks) in enumerate(tree.weights.items()):
        if total[r] <= 0:
            continue
        names = list(racks)
        win = _winner(key, [(f"{r}/{k}", sum(w for w in racks[k].values() if w > 0)) for k in names])
        rack = F.when(F.col("_top") == i, F.element_at(F.array(*map(F.lit, names)), win + 1)).otherwise(rack)
    for k, (_, rk, _, _) in enumerate(tree.growth, len(total)):
        rack = F.when(F.col("_top") == k, F.lit(rk)).otherwise(rack)
    region = F.element_at(F.array(*map(F.lit, [*total, *[g[0] for g in tree.growth]])), F.col("_top") + 1)
    df = df.withColumn("_region", region).withColumn("_rack", rack)
    for i, (r, racks) in enumerate(tree.weights.items()):
        for k, leaves in racks.items():
            if sum(w for w in leaves.values() if w > 0) <= 0:
                continue
            win = _winner(key, [(f"{r}/{k}/{s}", w) for s, w in leaves.items()])
            pick = F.element_at(F.array(*map(F.lit, leaves)), win + 1)
            shard = F.when((F.col("_top") == i) & (F.col("_rack") == k), pick).otherwise(shard)
    for k, (_, _, s, _) in enumerate(tree.growth, len(total)):
        shard = F.when(F.col("_top") == k, F.lit(s)).otherwise(shard)
    df = df.withColumn("_shard", shard)
    return df.withColumns({f"{prefix}region": F.col("_region"), f"{prefix}rack": F.col("_rack"), f"{prefix}shard": F.col("_shard")}).drop("_top", "_region", "_rack", "_shard")


def assign(df: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 20_000) -> DataFrame:
    """One row per input row: id_col, size, text_crc32, region, rack, shard, slot, grown_shard.

    slot is gapless from 0 in each shard.  Rows are numbered inside (shard, block) and the
    blocks' counts are summed up before, so no task holds a whole shard; a block has about
    ``block_rows`` rows.  Equal rows take neighbouring slots.  A null text has size 8 and
    a null crc.  grown_shard is null without ``grown``.
    """
    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_h"))
    rows = place(rows, F.col("_id"), tree)
    if grown is None:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    else:
        rows = place(rows, F.col("_id"), grown, "_g").withColumn("grown_shard", F.col("_gshard")).drop("_gregion", "_grack", "_gshard")
    rows = materialize(rows)
    n_blocks = max(1, -(-rows.count() // (block_rows * max(1, sum(len(s) for r in tree.weights.values() for s in r.values())))))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_id", "_h"), F.lit(n_blocks)).cast("int"))
    # shards x blocks rows; a running sum over a shard's blocks
    counts = rows.groupBy("shard", "_block").agg(F.count("*").alias("_n"))

    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")).select("shard", "_block", "_before")
    inside = Window.partitionBy("shard", "_block").orderBy("_id", "_h")
    out = rows.withColumn("_in", F.row_number().over(inside) - 1).join(before, ["shard", "_block"])
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "region", "rack", "shard", (F.col("_before") + F.col("_in")).alias("slot"), "grown_shard")


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder a shard, in Parquet."""
    assigned.write.mode("overwrite").partitionBy("shard").parquet(path)
