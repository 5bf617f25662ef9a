"""Sharding by a weighted hash tree: regions, then racks, then shards.

At each level a row draws -ln(u)/weight for every child, u hashed from the child's path and the row's key,
and descends to the smallest draw. A child's draw depends on nothing but its own path, weight and the key, so
a change of weight in one subtree moves rows only into or out of that subtree. The planned shards form a full
tree; each shard added later is a region of its own, so it takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rank_rows

DRAW_DIGITS = 12


@dataclass(frozen=True)
class HashTree:
    """Shards 0..shards-1 in regions of racks of shards; weights: of single shards, 1 where unnamed."""

    shards: int
    racks_per_region: int = 2
    shards_per_rack: int = 5
    planned: int = 40
    weights: dict[int, float] = field(default_factory=dict)

    def regions(self) -> list[list[list[int]]]:
        """Per region its racks, per rack its shards."""
        per_region = self.racks_per_region * self.shards_per_rack
        base = range(min(self.shards, self.planned))
        regions = []
        for r in range(0, len(base), per_region):
            own = list(base[r : r + per_region])
            regions.append([own[k : k + self.shards_per_rack] for k in range(0, len(own), self.shards_per_rack)])
        return regions + [[[s]] for s in range(self.planned, self.shards)]

    def weight(self, node: object) -> float:
        return self.weights.get(node, 1.0) if isinstance(node, int) else sum(self.weight(x) for x in node)


def _draw(path: Column, key: Column, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(path, F.lit(":"), key).cast("binary")), 1, DRAW_DIGITS)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))
    return -F.log(u) / F.lit(weight)


def _descend(prefix: Column, key: Column, weights: list[float]) -> Column:
    """The child with the smallest draw, the first on ties."""
    if len(weights) == 1:
        return F.lit(0)
    draws = [F.struct(_draw(F.concat(prefix, F.lit(f"/{i}")), key, w).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*draws))["i"]


def place(key: Column, tree: HashTree) -> Column:
    """The shard of a key (text), by one descent of the tree."""
    if tree.shards < 1:
        raise ValueError("a tree has one shard at least")
    regions = tree.regions()
    shapes: dict[tuple, list[int]] = {}
    for i, region in enumerate(regions):
        shapes.setdefault(tuple(tuple(tree.weight(s) for s in rack) for rack in region), []).append(i)

    def inside(region: Column, shape: tuple) -> Column:
        """Number of the shard within the region, for all regions of one shape."""
        name = F.concat(F.lit("r"), region.cast("string"))
        sizes = [len(rack) for rack in shape]

        def at(rack: int) -> Column:
            return F.lit(sum(sizes[:rack])) + _descend(F.concat(name, F.lit(f"/{rack}")), key, list(shape[rack]))

        def of(rack: Column) -> Column:
            if len({tuple(r) for r in shape}) == 1 and len(shape) > 1:
                return rack * sizes[0] + _descend(F.concat(name, F.lit("/"), rack.cast("string")), key, list(shape[0]))
            out = at(0)
            for k in range(1, len(shape)):
                out = F.when(rack == k, at(k)).otherwise(out)
            return out

        picked = _descend(name, key, [sum(r) for r in shape])
        return F.element_at(F.transform(F.array(picked), of), 1)

    def shard(region: Column) -> Column:
        first = F.array(*[F.lit(r[0][0]) for r in regions])
        out = None
        for shape, own in shapes.items():
            value = F.get(first, region) + inside(region, shape)
            out = value if out is None else F.when(region.isin(own), value).otherwise(out)
        return out

    region = _descend(F.lit("root"), key, [tree.weight(r) for r in regions])
    return F.element_at(F.transform(F.array(region), shard), 1).cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, spread: int = 64, **tree: object) -> DataFrame:
    """Every row with its shard, its slot there (gapless from 0), and its shard were there one more.

    Law `key`: doc_id (null: the empty key) and the number of shards decide. size: UTF-8 bytes of the text (null:
    none) plus 16. Equal rows share a shard and take slots side by side. Only doc_id and text are read; an empty
    table gives no rows. No text is shuffled: slots are numbered on (doc_id, size, text_crc32).
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("__key"))
    now, more = HashTree(shards, **tree), HashTree(shards + 1, **tree)
    rows = rows.select("doc_id", "size", "text_crc32", place(F.col("__key"), now).alias("shard"), place(F.col("__key"), more).alias("grown_shard"))
    by = F.conv(F.substring(F.md5(F.concat(F.lit("slot:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 4), 16, 10).cast("long") % spread
    ranked = rank_rows(rows, ["shard"], "slot", spread, by)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
