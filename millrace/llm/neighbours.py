"""Near-duplicate embeddings by a robust-pruned flat graph.

Vectors with equal components are one node. Centres fitted on a bounded sample cut the nodes into shards of
bounded size; a node is a member of the few shards whose centres are nearest, so shards overlap. Each shard
builds a flat graph: a node's candidates (its nearest members and some far ones) are pruned robustly, a
candidate falling away if a chosen one is nearer to it than the node is by a factor. The adjacency lists of
all shards are united per node. A node searches in the shard of its nearest centre: greedily from medoids and
from its own place in the graph, with a beam; nodes found within the radius are expanded until no more come.
Every link is computed in double precision. ``audit`` measures recall against brute force.

A shard that is too large (a third of all vectors may lie in one place) is cut into blocks by a hash: each
block has a graph of its own, and each block's nodes search all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.session import durable

COSINE = 0.95
SHARD, OVERLAP = 1500, 4
DEGREE, POOL, FAR, SLACK, BEAM, MEDOIDS = 24, 48, 16, 1.2, 32, 8
FIT_ROWS = 20_000


def nodes(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(node, unit, size, copies, head) of each distinct vector that can link; head is its smallest id.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing and are left out.
    ``node`` hashes the components; the dimension is part of it, and vectors of other lengths never meet.
    """
    x = F.transform(F.col(column), lambda v: v.cast("double") + F.lit(0.0))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    usable = vectors.select(F.col(id_column).alias("id"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0) & ~bad).withColumn("norm", norm).where("norm > 0 and norm < double('Infinity')")
    unit = usable.select("id", F.transform("x", lambda v: v / F.col("norm")).alias("unit"))
    return unit.groupBy(F.sha2(F.array_join("unit", ",").cast("binary"), 256).alias("digest")).agg(F.min("id").alias("head"), F.count("*").alias("copies"), F.first("unit").alias("unit")).select(F.substring("digest", 1, 24).alias("node"), "head", "copies", "unit")


def _centres(found: DataFrame, total: int, shard: int, fit_rows: int) -> dict[int, np.ndarray]:
    """Centres for each dimension from a sample of about ``fit_rows`` nodes: spherical k-means on the driver."""
    sample = found.where(F.conv(F.substring("node", 1, 8), 16, 10).cast("long") < F.lit(int(min(1.0, fit_rows / max(total, 1)) * 2**32)))
    rows = sample.select("node", "unit").toPandas().sort_values("node")
    out = {}
    for dim, part in rows.groupby(rows["unit"].map(len)):
        x = np.stack(part["unit"].to_numpy())
        k = max(1, math.ceil(total * len(x) / max(len(rows), 1) * OVERLAP / shard))
        k = min(k, max(1, len(x) // 4))
        centre = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(8):
            own = (x @ centre.T).argmax(axis=1)
            sums = np.zeros_like(centre)
            np.add.at(sums, own, x)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centre = np.where(length > 0, sums / np.maximum(length, 1e-12), centre)
        out[int(dim)] = centre
    return out


def assigned(found: DataFrame, total: int, shard: int = SHARD, overlap: int = OVERLAP, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``found`` with shards (nearest first), one row per node."""
    centres = _centres(found, total, shard, fit_rows)
    first = {d: sum(len(c) for e, c in centres.items() if e < d) for d in centres}

    @F.pandas_udf("array<int>")
    def nearest(units: pd.Series) -> pd.Series:
        out: list[list[int]] = []
        for u in units:
            c = centres.get(len(u))
            # A dimension that the sample missed shares one shard.
            out.append([-len(u)] if c is None else (first[len(u)] + np.argsort(-(c @ u), kind="stable")[:overlap]).tolist())
        return pd.Series(out)

    return found.withColumn("shards", nearest("unit"))


def robust_prune(x: np.ndarray, pools: np.ndarray, degree: int = DEGREE, slack: float = SLACK) -> list[np.ndarray]:
    """Of each row's candidates (indices; itself ignored), those that are not nearer to a chosen one."""
    kept = []
    for lo in range(0, len(pools), 128):
        pool = pools[lo : lo + 128]
        own = np.arange(lo, lo + len(pool))
        v = x[pool]
        far = np.maximum(2 - 2 * np.einsum("id,ijd->ij", x[own], v), 0)
        between = np.maximum(2 - 2 * v @ v.transpose(0, 2, 1), 0)
        alive = pool != own[:, None]
        chosen = np.full((len(pool), degree), -1)
        rows = np.arange(len(pool))
        for d in range(degree):
            best = np.where(alive, far, np.inf).argmin(axis=1)
            some = alive[rows, best]
            if not some.any():
                break
            chosen[some, d] = pool[rows[some], best[some]]
            alive &= ~((slack * between[rows, best] <= far) & some[:, None])
            alive[rows, best] = False
        kept += [c[c >= 0] for c in chosen]
    return kept


def build(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists over the rows of x: robustly pruned candidates, with their reverse edges."""
    n = len(x)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    k = min(POOL, n - 1)
    near = np.empty((n, k), np.int64)
    for lo in range(0, n, 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        near[lo : lo + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    step = np.arange(1, min(FAR, n - 1) + 1) * max(1, n // (FAR + 1))
    out = robust_prune(x, np.concatenate((near, (np.arange(n)[:, None] + step) % n), axis=1))
    pairs = np.concatenate([np.stack((np.full(len(a), i), a), axis=1) for i, a in enumerate(out)])
    pairs = np.unique(np.concatenate((pairs, pairs[:, ::-1])), axis=0)
    return np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, n)))


def medoids(x: np.ndarray, k: int = MEDOIDS) -> np.ndarray:
    """The row nearest to the mean, then rows far from those taken."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return np.array(chosen)


def range_search(x: np.ndarray, adjacency: list[np.ndarray], query: np.ndarray, own: int, starts: np.ndarray, cosine: float = COSINE, beam: int = BEAM) -> np.ndarray:
    """Rows with a cosine of ``cosine`` or more to the query that the search meets.

    The best nodes seen are expanded, ``beam`` at most, and beyond them every node within the range: the
    search ends when all those have been expanded. ``own`` is the query's row in x, or -1.
    """
    seen = np.zeros(len(x), bool)
    first = starts if own < 0 else np.append(starts, own)
    first = np.unique(first)
    seen[first] = True
    found, score = first, x[first] @ query
    expanded = np.zeros(len(first), bool)
    while True:
        limit = np.partition(score, -beam)[-beam] if len(score) > beam else -np.inf
        todo = ~expanded & (score >= min(limit, cosine))
        if not todo.any():
            break
        at = found[todo]
        expanded |= todo
        new = np.unique(np.concatenate([adjacency[i] for i in at]))
        new = new[~seen[new]]
        seen[new] = True
        found, score, expanded = np.concatenate((found, new)), np.concatenate((score, x[new] @ query)), np.concatenate((expanded, np.zeros(len(new), bool)))
    return found[score >= cosine]


def _matrix(units: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(u, np.float64) for u in units])


def _graph(members: DataFrame) -> DataFrame:
    """Adjacency (node, near) of each (shard, block) of members."""

    def grown(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        ids = rows["node"].to_numpy()
        return pd.DataFrame({"node": ids, "near": [ids[a] for a in build(_matrix(rows["unit"]))]})

    return members.groupBy("shard", "block").applyInPandas(grown, "node string, near array<string>")


def linked(members: DataFrame, cosine: float) -> DataFrame:
    """Rows (node, other, n): the number of vectors linked within a block, and links that span what was found.

    ``members`` has shard, block (of the graph), seekers (whether the row searches), node, unit, copies, near. A
    row with an ``other`` is a link for the components; one without is a count.
    """

    def searched(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["role", "node"], ignore_index=True)
        graph = rows[rows["role"] == 0].reset_index(drop=True)
        seek = rows[rows["role"] == 1].reset_index(drop=True)
        if not len(graph) or not len(seek):
            return pd.DataFrame({"node": [], "other": [], "n": []})
        x, q = _matrix(graph["unit"]), _matrix(seek["unit"])
        ids = graph["node"].to_numpy()
        place = {v: i for i, v in enumerate(ids)}
        adjacency = [np.array([place[o] for o in near if o in place], np.int64) for near in graph["near"]]
        copies, starts = graph["copies"].to_numpy(), medoids(x)
        node, other, n = [], [], []
        joined: dict[str, str] = {}

        def root(v: str) -> str:
            while joined.get(v, v) != v:
                joined[v] = joined.get(joined[v], joined[v])
                v = joined[v]
            return v

        for i, name in enumerate(seek["node"]):
            got = range_search(x, adjacency, q[i], place.get(name, -1), starts, cosine)
            got = got[ids[got] != name]
            node.append(name), other.append(None), n.append(int(copies[got].sum()))
            for o in ids[got]:
                a, b = root(name), root(o)
                if a != b:  # links that close a circle add nothing to a component
                    joined[max(a, b)] = min(a, b)
                    node.append(name), other.append(o), n.append(0)
        return pd.DataFrame({"node": node, "other": other, "n": n})

    return members.groupBy("shard", "seekers", "block").applyInPandas(searched, "node string, other string, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, shard: int = SHARD, overlap: int = OVERLAP, fit_rows: int = FIT_ROWS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``id_column``, n_links, component_id and kept of each row of ``vectors``.

    n_links counts the other rows linked directly, copies included; component_id is the smallest id that links
    reach; kept marks that row. Rows without links (see ``nodes``) are components of their own; so are rows of
    null id among themselves, but where their vector links. Repeated rows count as copies of each other. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    found = durable(nodes(vectors, id_column, column), "vectors")
    total = found.count()
    if not total:
        links, counts = spark.createDataFrame([], "node string, other string"), spark.createDataFrame([], "node string, n long")
    else:
        placed = durable(assigned(found, total, shard, overlap, fit_rows), "placed")
        home = placed.select("node", "unit", "copies", F.col("shards")[0].alias("shard"))
        member = placed.select("node", "unit", "copies", F.explode("shards").alias("shard"))
        blocks = durable(member.groupBy("shard").agg(F.ceil(F.count("*") / (2.0 * shard)).cast("int").alias("blocks")), "blocks")
        block = F.pmod(F.xxhash64("node", "shard"), F.col("blocks")).cast("int")
        split = member.join(blocks, "shard").withColumn("block", block)
        union = _graph(split).select("node", F.explode("near").alias("o")).groupBy("node").agg(F.collect_set("o").alias("near"))
        union = durable(union, "graph")
        graph = split.join(union, "node", "left").withColumn("near", F.coalesce("near", F.array().cast("array<string>")))
        seekers = home.join(blocks, "shard").withColumn("seekers", F.pmod(F.xxhash64("node", F.lit("seek")), F.col("blocks")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        columns = ["shard", "seekers", "block", "role", "node", "unit", "copies", "near"]
        sides = graph.withColumn("seekers", every).withColumn("role", F.lit(0)).select(*columns)
        sides = sides.unionByName(seekers.withColumn("block", every).withColumn("role", F.lit(1)).withColumn("near", F.array().cast("array<string>")).select(*columns))
        result = durable(linked(sides, cosine), "links")
        links = result.where("other is not null").select("node", "other")
        counts = result.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    label = components(links, "node", "other")
    heads = found.join(label, "node", "left").select("node", "head", "copies", F.coalesce("root", "node").alias("root"))
    lowest = heads.groupBy("root").agg(F.min("head").alias("component_id"))
    out = heads.join(lowest, "root").join(counts, "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    ids = rows_of(vectors, id_column, column)
    joined = ids.join(out, "node", "left")
    component = F.coalesce("component_id", F.col("id"))
    return joined.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def rows_of(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, node) of every row; node is null where the vector links with nothing."""
    x = F.transform(F.col(column), lambda v: v.cast("double") + F.lit(0.0))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    bad = F.col("x").isNull() | (F.size("x") == 0) | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    unit = F.transform("x", lambda v: v / F.col("norm"))
    node = F.substring(F.sha2(F.array_join(unit, ",").cast("binary"), 256), 1, 24)
    usable = ~F.coalesce(bad, F.lit(True)) & (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    return vectors.select(F.col(id_column).alias("id"), x.alias("x")).withColumn("norm", norm).select("id", F.when(usable, node).alias("node"))


def audit(vectors: DataFrame, result: DataFrame, queries: int = 256, cosine: float = COSINE, id_column: str = "vec_id", column: str = "embedding") -> float:
    """Recall of the links of about ``queries`` rows against brute force: links found / links there are.

    Each block of vectors is held against all queries, so the work grows with the rows, not with their square.
    """
    found = nodes(vectors, id_column, column).select("node", "unit", "copies")
    total = max(found.count(), 1)
    rows = found.where(F.conv(F.substring("node", 9, 8), 16, 10).cast("long") < F.lit(int(min(1.0, queries / total) * 2**32))).toPandas()
    if not len(rows):
        return 1.0
    names = rows["node"].tolist()
    by_size = {d: (p.index.to_numpy(), _matrix(p["unit"])) for d, p in rows.groupby(rows["unit"].map(len))}

    def count(batches):
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for d, part in batch.groupby(batch["unit"].map(len)):
                if d in by_size:
                    at, q = by_size[d]
                    total[at] += ((q @ _matrix(part["unit"]).T) >= cosine) @ part["copies"].to_numpy()
        yield pd.DataFrame({"node": names, "n": total})

    truth = found.mapInPandas(count, "node string, n long").groupBy("node").agg((F.sum("n") - 1).alias("there"))
    got = rows_of(vectors, id_column, column).join(result.select(F.col(id_column).alias("id"), "n_links"), "id").groupBy("node").agg(F.max("n_links").alias("got"))
    sums = truth.join(got, "node").agg(F.sum(F.least("got", "there")), F.sum("there")).first()
    return 1.0 if not sums[1] else sums[0] / sums[1]
