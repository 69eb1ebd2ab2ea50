"""A Merkle manifest of a dataset: packed digest-to-children records, proofs by descent from the root, verification.

Every row is a leaf. The leaves of a tree (a source) stand in order; every three neighbours, at the end fewer, hash
to one node of the next level until one node is left, the tree's subroot. The subroots, in the order of their trees,
hash to the root in the same way. The store is found by digests alone: it maps a digest to the digests of its children.

Records are packed into pages: a page holds the records of up to ``LEVELS`` levels below one digest, so a proof among n
leaves takes about log(n) / log(243) joins, and no group exceeds 243 rows whatever share of the rows a tree holds.

Defined results: nulls in any field hash as ``-``, empty texts as ``0:``; null ids come first in their tree, null trees
first among trees; rows that are equal as a whole are leaves of their own; an empty table has no root and no proofs;
columns beyond those named are carried along or ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import positions
from millrace.session import durable, forget

FAN = 3
#: Levels of a page, which has 243 digests at its lowest.
LEVELS = 5
WIDTH = FAN**LEVELS


def field(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields."""
    return F.sha2(F.concat(*map(field, fields)), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path of proofs."""

    def above(at: Column, step: Column) -> Column:
        left, right = F.slice(step["others"], 1, step["digit"]), F.slice(step["others"], step["digit"] + 1, FAN)
        return F.sha2(F.concat(F.array_join(left, ""), at, F.array_join(right, "")), 256)

    return F.aggregate(path, start, above)


def path_digest(path: Column) -> Column:
    """SHA-256 of all siblings on a path, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda step: step["others"])), ""), 256)


@dataclass
class Manifest:
    """The stored leaves (with __tree and __rank), the trees' order, the pages of both levels from below, and the root."""

    leaves: DataFrame
    trees: DataFrame
    pages: list[DataFrame]
    forest: list[DataFrame]
    root: str | None

    def forget(self) -> None:
        """Delete the store."""
        for stored in (self.leaves, self.trees, *self.pages, *self.forest):
            forget(stored)


def _pack(levels: int, digests: list[str]) -> tuple[str, list[dict]]:
    """The digest above a run of neighbours, and the records that lead from it down to them."""
    records = {}
    for _ in range(levels):
        above = []
        for i in range(0, len(digests), FAN):
            run = digests[i : i + FAN]
            above.append(hashlib.sha256("".join(run).encode()).hexdigest())
            records[above[-1]] = run
        digests = above
    return digests[0], [{"digest": d, "children": c} for d, c in records.items()]


_PAGE = "tree string, page long, height int, digest string, levels int, records array<struct<digest: string, children: array<string>>>"
_RECORDS = pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))]))
_PAGE_ARROW = pa.schema([("tree", pa.string()), ("page", pa.int64()), ("height", pa.int32()), ("digest", pa.string()), ("levels", pa.int32()), ("records", _RECORDS)])


def _paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            levels = min(LEVELS, r["height"])
            top, records = _pack(levels, [n["digest"] for n in r["nodes"]])
            rows.append({"tree": r["tree"], "page": r["page"], "height": r["height"] - levels, "digest": top, "levels": levels, "records": records})
        yield pa.RecordBatch.from_pylist(rows, schema=_PAGE_ARROW)


def _grow(nodes: DataFrame, heights: DataFrame | int) -> tuple[list[DataFrame], DataFrame]:
    """Pages, from below, and roots of the trees of ``nodes`` (tree, rank, digest).

    ``heights`` (tree, height), or one number for all, tells how many levels a tree has above these nodes. A tree that ends lower than others hands
    its root up through pages of no levels, so that a root and its leaves are as many pages apart in all trees.
    """
    pages = []
    run = F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("nodes")
    by = ("tree", F.floor(F.col("rank") / WIDTH).cast("long").alias("page"))
    # Heights are joined to runs, not to nodes: grouping by page must not inherit a partitioning by tree.
    runs = nodes.groupBy(*by).agg(run)
    runs = runs.withColumn("height", F.lit(heights)) if isinstance(heights, int) else runs.join(heights, "tree")
    while True:
        pages.append(durable(runs.select("tree", "page", "height", "nodes").mapInArrow(_paged, _PAGE), "pages"))
        nodes = pages[-1].select("tree", F.col("page").alias("rank"), "digest", "height")
        if not nodes.agg(F.max("rank")).first()[0]:
            return pages, nodes
        runs = nodes.groupBy(*by).agg(F.max("height").alias("height"), run)


def _height(count: Column) -> Column:
    """Levels above ``count`` neighbours until one node is left, in whole numbers."""
    return F.size(F.filter(F.array(*(F.lit(FAN**i) for i in range(40))), lambda p: p < count))


def build(rows: DataFrame, tree: Column, order: Sequence[str]) -> Manifest:
    """Store the manifest of ``rows``, which have a column ``leaf``: a tree for each value of ``tree``.

    Leaves of a tree ascend by ``order``, nulls first, then by leaf; trees ascend by the bytes of their names. Ranks come
    from one sort by ranges, so a tree may hold any share of the rows.
    """
    named = durable(rows.withColumn("__tree", F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit(""))), "leaves")
    leaves = durable(positions(named, [*order, "leaf"], within=["__tree"], name="__rank"), "ranked")
    forget(named)
    heights = leaves.groupBy(F.col("__tree").alias("tree")).agg(F.count("*").alias("n")).select("tree", _height(F.col("n")).alias("height"))
    nodes = leaves.select(F.col("__tree").alias("tree"), F.col("__rank").alias("rank"), F.col("leaf").alias("digest"))
    pages, subroots = _grow(nodes, heights)
    trees = durable(positions(subroots.select("tree", "digest"), ["tree"], name="rank"), "trees")
    count = trees.count()
    forest, top = _grow(trees.select(F.lit("").alias("tree"), "rank", "digest"), sum(FAN**i < count for i in range(40)))
    root = top.first()
    return Manifest(leaves, trees, pages, forest, root["digest"] if root else None)


class _Page:
    """The records of a page as a mapping that is descended by digits."""

    def __init__(self, digest: str, levels: int, records: list[dict]):
        self.top, self.levels = digest, levels
        self.children = {r["digest"]: r["children"] for r in records}

    def descend(self, place: int) -> tuple[str, list[dict]]:
        """The digest reached by the base-3 digits of ``place``, and per level, from above, the children not selected."""
        at, path = self.top, []
        for level in range(self.levels - 1, -1, -1):
            digit = place // FAN**level % FAN
            run = self.children[at]
            path.append({"digit": digit, "others": run[:digit] + run[digit + 1 :]})
            at = run[digit]
        return at, path

    def width(self) -> int:
        """How many digests the page has at its lowest."""
        lowest = [self.top]
        for _ in range(self.levels):
            lowest = [c for d in lowest for c in self.children[d]]
        return len(lowest)


_PATH = "array<struct<digit: int, others: array<string>>>"
_REQUEST = f"tree string, subroot string, rank long, digest string, path {_PATH}"
_PATH_ARROW = pa.list_(pa.struct([("digit", pa.int32()), ("others", pa.list_(pa.string()))]))


def _with_page(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Each request joined with the page its digest names; equal subtrees share one."""
    return requests.join(pages.select("digest", "levels", "records").dropDuplicates(["digest"]), "digest")


def _step(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests (tree, subroot, rank, digest, path) for all that lies one page below those given."""
    schema = pa.schema([("tree", pa.string()), ("subroot", pa.string()), ("rank", pa.int64()), ("digest", pa.string()), ("path", _PATH_ARROW)])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():  # a page at a time: at most 243 rows with their paths
                page, rows = _Page(r["digest"], r["levels"], r["records"]), []
                for place in range(page.width()):
                    at, path = page.descend(place)
                    rows.append({"tree": r["tree"], "subroot": r["subroot"], "rank": r["rank"] * WIDTH + place, "digest": at, "path": r["path"] + path})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    joined = _with_page(requests, pages).select("tree", "subroot", "rank", "digest", "levels", "records", "path")
    return durable(joined.mapInArrow(below, _REQUEST), "requests")


def prove(manifest: Manifest, keep: Sequence[str]) -> DataFrame:
    """The leaves' columns ``keep`` with leaf, subroot, root and path: for each level from the leaf up (digit, others).

    Requests descend page by page. Those for one page travel together, so a page is asked for once and not once per leaf
    below it; the path down to a page is carried with the page's requests, and only the last step makes a row of each leaf.
    """
    spark = manifest.leaves.sparkSession
    at = spark.createDataFrame([("", None, 0, manifest.root, [])] if manifest.root else [], _REQUEST)
    for pages in reversed(manifest.forest):
        at = _step(at, pages)
    names = manifest.trees.select(F.col("tree").alias("name"), F.col("rank").alias("number"))
    at = at.join(names, at["rank"] == names["number"]).select(
        F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.lit(0).cast("long").alias("rank"), "digest", "path"
    )
    for pages in reversed(manifest.pages[1:]):
        at = _step(at, pages)

    leaves = manifest.leaves
    carried = leaves.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col("__rank").alias("rank"), F.col("__tree").alias("tree"))
    asked = carried.groupBy("tree", F.floor(F.col("rank") / WIDTH).cast("long").alias("page")).agg(
        F.collect_list(F.struct((F.col("rank") % WIDTH).cast("int").alias("place"), *(f"c{i}" for i in range(len(keep))))).alias("places")
    )
    last = _with_page(at, manifest.pages[0]).join(asked.withColumnRenamed("page", "rank"), ["tree", "rank"])

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                r = {n: columns[n][i].as_py() for n in ("digest", "levels", "records", "path", "subroot")}
                places = columns["places"][i].values.flatten()
                page, found = _Page(r["digest"], r["levels"], r["records"]), []
                for place in places[0].to_pylist():
                    reached, path = page.descend(place)
                    found.append((reached, (r["path"] + path)[::-1]))
                digests = pa.array([f[0] for f in found], pa.string())
                paths = pa.array([f[1] for f in found], _PATH_ARROW)
                rest = [pa.repeat(pa.scalar(x, pa.string()), len(found)) for x in (r["subroot"], root)]
                yield pa.RecordBatch.from_arrays([*places[1:], digests, *rest, paths], names=[*keep, "leaf", "subroot", "root", "path"])

    root = manifest.root
    kept = ", ".join(f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in keep)
    return last.select("digest", "levels", "records", "path", "subroot", "places").mapInArrow(proofs, f"{kept}, leaf string, subroot string, root string, path {_PATH}")
