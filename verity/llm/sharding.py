"""Sharding by a hierarchical weighted hash tree (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verity.llm.common import cut


@dataclass(frozen=True)
class Leaf:
    """A shard with its place in the tree. A draw depends on the names only, never on positions in a list."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, racks: int = 3) -> list[Leaf]:
    """Shards 0.. filled into racks of ``per_rack`` and regions of ``racks`` racks, all of weight 1."""
    return [Leaf(k // (per_rack * racks), k // per_rack, k) for k in range(shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """Exponential draw of a node of the tree with rate ``weight``: -ln(u) / weight, u uniform in (0, 1) from 53 bits of the hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def _least(draws: dict[int, Column]) -> Column:
    """The key with the least draw; equal draws go to the smaller key."""
    parts = [F.struct(draw.alias("draw"), F.lit(k).alias("k")) for k, draw in sorted(draws.items())]
    return F.array_min(F.array(*parts))["k"]


def _case(on: Column, branches: dict[int, Column]) -> Column:
    out = None
    for k, value in sorted(branches.items()):
        out = F.when(on == k, value) if out is None else out.when(on == k, value)
    return out


def place(df: DataFrame, key: str, tree: list[Leaf], out: str) -> DataFrame:
    """Add the shard ``out``: descend region, rack and shard, each by the least of its nodes' weighted hash draws.

    A node draws with the weight of all shards below it, under its own name, and only the children of the chosen node draw, so a row costs
    depth times fan-out hashes. If a weight changes, only the draws of that shard, its rack and its region do: rows move
    into the region (out of it, if it gets lighter); those that stay in the region move between the rack and its siblings only, and those that
    stay in the rack between the shard and its siblings. Nothing moves between other subtrees. A new shard in a region of its own
    takes rows only into itself.

    Null keys all have the same draws, so they share a shard. Equal keys share a shard.
    """
    if not tree:
        raise ValueError("the tree has no shards")
    if len({leaf.shard for leaf in tree}) < len(tree) or any(not leaf.weight > 0 for leaf in tree):
        raise ValueError("shards must be distinct and weights positive")
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for leaf in tree:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[leaf.shard] = leaf.weight
    total = lambda x: sum(map(total, x.values())) if isinstance(x, dict) else x

    def choose(nodes: dict[int, dict | float], path: str) -> Column:
        return _least({k: _draw(F.col(key), f"{path}{k}", total(x)) for k, x in nodes.items()})

    df = df.withColumn("_region", choose(regions, ""))
    df = df.withColumn("_rack", _case(F.col("_region"), {r: choose(racks, f"{r}/") for r, racks in regions.items()}))
    inner = {r: _case(F.col("_rack"), {k: choose(shards, f"{r}/{k}/") for k, shards in racks.items()}) for r, racks in regions.items()}
    return df.withColumn(out, _case(F.col("_region"), inner)).drop("_region", "_rack")


def number_within(df: DataFrame, group: str, out: str) -> DataFrame:
    """Number the rows of each ``group`` 0, 1, .. without gaps, with no group in one task.

    The rows are first written with an id that holds the partition and the place in it, so a lost executor can't
    change them. Rows are ranked within (partition, group), and only the counts of those are summed up in order.
    """
    df = cut(df.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = df.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    rank = F.row_number().over(Window.partitionBy("_part", group).orderBy("_at"))
    numbered = df.withColumn("_rank", rank.cast("long")).join(starts, ["_part", group])
    return numbered.withColumn(out, F.col("_from") + F.col("_rank") - 1).drop("_at", "_part", "_rank", "_from")


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24) -> DataFrame:
    """Shard, slot and later shard of every row, by key: id and shard count decide.

    Returns id_col, size (UTF-8 bytes plus 8; null text: 8), text_crc32 (null text: 0, as for the empty text), law,
    shard, slot (from 0 without gaps within the shard) and grown_shard (with one shard more, which takes rows only
    into itself, as a multiple of 12 shards fills its regions and one more opens another). Repeated rows keep a slot each; rows with a null id share a shard; an empty table gives none;
    other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias(id_col), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = place(rows, id_col, even_tree(shards), "shard")
    rows = place(rows, id_col, even_tree(shards + 1), "grown_shard")
    rows = number_within(rows, "shard", "slot")
    return rows.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
