"""Placement of keys on shards by a weighted hash tree of regions, racks and shards, in DataFrame expressions only.

At each level every child draws -ln(u) / weight, u being a hash of the key and the child's label, and the lowest draw
wins; that gives each child its share of the weights. A tree grows by generations: what one call adds is a generation
with labels, and so draws, of its own, and weights summed from its own shards up. Older draws stay as they are, so a key
moves only where a new generation's draw is the lowest, and from there down only among what that generation added. A
new shard thus takes keys only into itself, whichever rack it stands in. Taking a shard away changes only the draws of
the nodes above it.

Defined results: a null key hashes as the empty text; a null text has no bytes and checksum 0; equal keys share a
shard, and slots order rows by key, checksum and size, whole repeats among each other in any order; an empty table gives
no rows; further columns, however they are called, are ignored. The law is ``key``: texts have no say in the shard.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import positions

_HEX = 13  # 52 bits, which a double holds exactly


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0
    generation: int = 0

    def labels(self) -> tuple[str, str, str]:
        region = f"{self.generation}/{self.region}"
        return region, f"{region}/{self.rack}", f"{region}/{self.rack}/{self.shard}"


@dataclass(frozen=True)
class Tree:
    shards: tuple[Shard, ...]

    @classmethod
    def uniform(cls, regions: int, racks: int, shards: int) -> Tree:
        """Shards of weight 1, numbered from 0."""
        places = ((r, k) for r in range(regions) for k in range(racks) for _ in range(shards))
        return cls(tuple(Shard(f"r{r}", f"k{k}", i) for i, (r, k) in enumerate(places)))

    def grown(self, added: Iterable[Shard]) -> Tree:
        """The tree with new shards, or more weight for shards it has, as one more generation."""
        newest = 1 + max((s.generation for s in self.shards), default=-1)
        return Tree((*self.shards, *(Shard(s.region, s.rack, s.shard, s.weight, newest) for s in added)))

    def without(self, shard: int) -> Tree:
        return Tree(tuple(s for s in self.shards if s.shard != shard))

    def children(self) -> dict[str, dict[str, float]]:
        """For each node, its children and the sums of their shards' weights."""
        nodes: dict[str, dict[str, float]] = {"": {}}
        for s in self.shards:
            if s.weight <= 0:
                raise ValueError(f"shard {s.shard} needs a weight above 0")
            at = ""
            for label in s.labels():
                below = nodes.setdefault(at, {})
                below[label] = below.get(label, 0.0) + s.weight
                at = label
        return nodes


def draw(key: Column, label: Column, weight: Column) -> Column:
    """An exponential draw of rate ``weight``, the same wherever it is made."""
    hashed = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), label)), 1, _HEX), 16, 10).cast("double")
    return -F.log((hashed + 0.5) / float(16**_HEX)) / weight


def place(key: Column, tree: Tree) -> Column:
    """(region, rack, shard) of a key: three levels down, at each the child of the lowest draw."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    nodes = tree.children()

    def options(at: str) -> Column:
        return F.array(*(F.struct(F.lit(label).alias("label"), F.lit(weight).alias("weight")) for label, weight in nodes[at].items()))

    def lowest(children: Column) -> Column:
        draws = F.transform(children, lambda c: F.struct(draw(text, c["label"], c["weight"]).alias("draw"), c["label"].alias("label")))
        return F.array_min(draws)["label"]

    def below(labels: Iterable[str]) -> Column:
        return F.create_map(*(x for label in labels for x in (F.lit(label), options(label))))

    regions = list(nodes[""])
    racks = [label for r in regions for label in nodes[r]]
    region = lowest(options(""))
    rack = lowest(F.element_at(below(regions), region))
    parts = F.split(lowest(F.element_at(below(racks), rack)), "/")
    return F.struct(parts[1].alias("region"), parts[2].alias("rack"), parts[3].cast("int").alias("shard"))


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, region, rack, shard, slot, grown_shard): where each row goes and its place there.

    ``size`` is the text's UTF-8 bytes and 8 more for the key. Slots of a shard run from 0 without gaps; they come from one
    sort by ranges of the whole table, as a shard may be too large for a task. Texts are not shuffled.
    """
    bytes_of = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        key, (F.octet_length(bytes_of) + 8).cast("long").alias("size"), F.crc32(bytes_of).alias("text_crc32"), F.lit("key").alias("law"),
        place(F.col(key), tree).alias("place"), (place(F.col(key), grown)["shard"] if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    flat = rows.select(key, "size", "text_crc32", "law", "place.region", "place.rack", "place.shard", "grown_shard")
    return positions(flat, [key, "text_crc32", "size"], within=["shard"], name="slot")


def moved(assigned: DataFrame) -> DataFrame:
    """Rows and bytes that growth moves: (shard, grown_shard, n_rows, bytes), the rows that stay included."""
    return assigned.groupBy("shard", "grown_shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"))


def write(docs: DataFrame, tree: Tree, path: str, key: str = "doc_id") -> None:
    """Store all columns of ``docs`` under region, rack and shard; a shard is split into files by size."""
    spot = docs.withColumn("__place", place(F.col(key), tree))
    named = spot.withColumns({f"shard_{n}": F.col("__place")[n] for n in ("region", "rack")} | {"shard_number": F.col("__place")["shard"]}).drop("__place")
    parts = ["shard_region", "shard_rack", "shard_number"]
    named.hint("rebalance", *parts).write.mode("overwrite").partitionBy(*parts).parquet(path)
