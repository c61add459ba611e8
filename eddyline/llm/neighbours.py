"""Embedding near-duplicates by NN-descent.

1. Equal vectors fold into one node with a weight, so a group of exact copies is one row whatever its size.
2. A first neighbour graph comes from ``TABLES`` orders of the nodes, each by the signs of random projections:
   every node is compared with the block of nodes that it lands in (blocks of ``BLOCK`` rows, cut from a
   range-partitioned sort, so no bucket is ever gathered) and keeps the ``K`` nearest above ``FLOOR``.
3. Rounds of NN-descent: each node's neighbours, to and from it, are compared with one another, and lists keep
   the best. Rounds go on while they find links.
4. A list whose ``K`` entries all are links is saturated, that is, its node sits in a dense group. There lists
   can't tell the links: the whole component is compared with itself, tile by tile (``TILE`` nodes or so each).
   A part needs no comparing: angles obey the triangle inequality, so nodes of a component within half the
   threshold's angle of its centre all link with each other. Such a core is counted, not paired.
5. Lists full of their own group can hide links to another. So, where there are dense groups, further searches keep for
   each node its nearest of *other* components: from new orders, then by neighbours of neighbours. What links is
   found merges components, and the search is made again from fresh orders until one finds none.
6. Recall is audited: ``AUDIT`` nodes of all, and as many of those with links, are compared with every node.
   A node's recall counts once, whatever its copies, and the least mean of a class of nodes by number of links
   decides. Below ``RECALL`` lists grow and the search goes on from new orders, ``TRIES`` times at most; after
   that all nodes are compared with one another, tile by tile.

Components come from star contraction over list links and bridges. Comparisons that decide are in double
precision. Defined results: vectors that are null, empty, zero or hold a null or non-finite component link
with nothing and are components of their own; vectors of different lengths don't link; rows that repeat an id
are rows of their own with that id; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eddyline.llm.common import saved, spread_join, table
from eddyline.llm.components import components

THRESHOLD = 0.95
FLOOR = 0.7
K = 10
TABLES = 8
BLOCK = 512
TILE = 1024
AUDIT = 256
LEAST_CLASS = 16
RECALL = 0.95
TRIES = 3
_EDGE = "u long, v long, cos double"


def unit_rows(vectors: DataFrame) -> DataFrame:
    """vec_id and unit: the vector scaled to length 1 as little-endian doubles, or null where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch["embedding"]:
                x = np.array([np.nan if e is None else e for e in v.as_py()], np.float64) if v.is_valid else np.zeros(0)
                most = np.abs(x).max() if len(x) else 0.0
                if np.isfinite(most) and most > 0:
                    x = x / most
                    out.append((x / np.sqrt(x @ x)).astype("<f8").tobytes())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(out, pa.binary())], ["vec_id", "unit"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, unit binary")


def _matrix(units, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(units), "<f8").reshape(len(units), -1).astype(kind)


def _best(cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest entries of each row that reach the floor, the diagonal left out."""
    np.fill_diagonal(cos, -2)
    if cos.shape[1] > k:
        column = np.argpartition(-cos, k, axis=1)[:, :k]
    else:
        column = np.tile(np.arange(cos.shape[1]), (len(cos), 1))
    row = np.repeat(np.arange(len(cos)), column.shape[1])
    column = column.ravel()
    ok = cos[row, column] >= FLOOR
    return row[ok], column[ok]


def _edges(node: np.ndarray, cos: np.ndarray, k: int) -> pa.RecordBatch:
    row, column = _best(cos, k)
    return pa.RecordBatch.from_arrays([pa.array(node[row]), pa.array(node[column]), pa.array(cos[row, column].astype(float))], ["u", "v", "cos"])


def orders_needed(bits: int) -> int:
    """Orders in which all but 0.5 % of pairs at the threshold share the signs that tell blocks apart once: all
    but the last log2(BLOCK / 64) of them."""
    same = (1 - math.acos(THRESHOLD) / math.pi) ** max(0, bits - math.log2(BLOCK / 64))
    return max(TABLES, math.ceil(math.log(0.005) / math.log1p(-same))) if same < 1 else TABLES


def _apart(cos: np.ndarray, root: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """``cos`` without pairs of one component and without those of which neither is in a dense one."""
    cos[(root[:, None] == root) | ~(dense[:, None] | dense)] = -2
    return cos


def first_graph(nodes: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """Edges from comparing each node with its block in ``TABLES`` orders, or more where the signs are many; of nodes that
    have them (root, dense), only edges between components."""
    own = [c for c in ("root", "dense") if c in nodes.columns]
    bits = max(4, min(30, math.ceil(math.log2(max(2, n / 64)))))
    tables = orders_needed(bits)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["unit"].to_pylist())
            for t in range(tables):
                p = x @ np.random.default_rng([seed, t, x.shape[1]]).standard_normal((x.shape[1], bits + 1))
                sign = (p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t)), pa.array(sign), pa.array(p[:, bits]), *(batch[c] for c in ("node", "unit", *own))], ["t", "sign", "p", "node", "unit", *own])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part["unit"].to_pylist(), np.float32)
                cos = x @ x.T
                yield _edges(np.asarray(part["node"]), _apart(cos, np.asarray(part["root"]), np.asarray(part["dense"])) if own else cos, k)

    kinds = {"root": "root long", "dense": "dense boolean"}
    orders = nodes.select("node", "unit", *own).mapInArrow(signed, ", ".join(["t long, sign long, p double, node long, unit binary", *(kinds[c] for c in own)]))
    parts = max(1, min(100_000, math.ceil(n * tables / 20_000)))
    return orders.repartitionByRange(parts, "t", "sign", "p").sortWithinPartitions("t", "sign", "p").mapInArrow(compared, _EDGE)


def shortlist(edges: DataFrame, k: int) -> DataFrame:
    """The k best entries of each list, each once."""
    best = Window.partitionBy("u").orderBy(F.desc("cos"), "v")
    return edges.groupBy("u", "v").agg(F.max("cos").alias("cos")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def descend(nodes: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """A round: the neighbours of each node, compared with one another, and the lists after that."""
    back = lists.select(F.col("v").alias("c"), F.col("u").alias("m"), "cos")
    near = lists.select(F.col("u").alias("c"), F.col("v").alias("m"), "cos").unionByName(back).groupBy("c", "m").agg(F.max("cos").alias("cos"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("cos"), "m"))).where(F.col("r") <= 3 * k)
    met = near.select("c", "m").join(nodes.select(F.col("node").alias("m"), "unit"), "m")

    def local(part: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(part["unit"].tolist(), np.float32)
        return _edges(part["m"].to_numpy(), x @ x.T, k).to_pandas()

    return shortlist(lists.unionByName(met.groupBy("c").applyInPandas(local, _EDGE)), k)


def _around(lists: DataFrame, most: int) -> DataFrame:
    """(c, m): the ``most`` nearest of those that a node c lists or that list it."""
    back = lists.select(F.col("v").alias("c"), F.col("u").alias("m"), "cos")
    near = lists.select(F.col("u").alias("c"), F.col("v").alias("m"), "cos").unionByName(back).groupBy("c", "m").agg(F.max("cos").alias("cos"))
    return near.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("cos"), "m"))).where(F.col("r") <= most).select("c", "m")


def descend_apart(named: DataFrame, lists: DataFrame, cross: DataFrame, k: int) -> DataFrame:
    """A round for lists of other components' nodes: a node's neighbours of its own component meet those of others."""
    near = _around(lists, 3 * k).unionByName(_around(cross, 3 * k)).unionByName(cross.select(F.col("u").alias("c"), F.col("u").alias("m"))).distinct()
    met = near.join(cross.select(F.col("u").alias("c")).unionByName(cross.select(F.col("v").alias("c"))).distinct(), "c", "left_semi").join(named.withColumnRenamed("node", "m"), "m")

    def local(part: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(part["unit"].tolist(), np.float32)
        return _edges(part["m"].to_numpy(), _apart(x @ x.T, part["root"].to_numpy(), part["dense"].to_numpy(bool)), k).to_pandas()

    return shortlist(cross.unionByName(met.select("c", "m", "unit", "root", "dense").groupBy("c").applyInPandas(local, _EDGE)), k)


def bridged(nodes: DataFrame, n: int, lists: DataFrame, links: DataFrame, k: int, seed: int) -> DataFrame:
    """``links`` and, for nodes of dense components, links to other components: searched from fresh orders until none is found."""
    while True:
        roots = saved(components(links, "nn-cc"), "nn-roots")
        dense = _crowded(links, k).join(roots, "node").select("root").distinct().withColumn("dense", F.lit(True))
        if dense.isEmpty():
            return links
        named = nodes.select("node", "unit").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = saved(named.join(dense, "root", "left").select("node", "unit", "root", F.coalesce("dense", F.lit(False)).alias("dense")), "nn-named")
        cross = saved(shortlist(first_graph(named, n, k, seed), k), "nn-cross")
        before = (0, 0.0)
        while True:
            now = cross.agg(F.coalesce(F.sum((F.col("cos") >= THRESHOLD).cast("long")), F.lit(0)), F.coalesce(F.sum("cos"), F.lit(0.0))).first()
            if now[0] <= before[0] and now[1] <= before[1] * 1.001:
                break
            before = now
            cross = saved(descend_apart(named, lists, cross, k), "nn-cross")
        new = saved(exact_links(nodes, cross), "nn-bridges")
        if new.isEmpty():
            return links
        links, seed = saved(links.unionByName(new), "nn-links"), seed + 1


def exact_links(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """(u, v), u > v: entries that reach the threshold in double precision."""
    pairs = lists.where(F.col("cos") >= THRESHOLD - 1e-4).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    full = pairs.join(nodes.select(F.col("node").alias("u"), F.col("unit").alias("x")), "u").join(nodes.select(F.col("node").alias("v"), F.col("unit").alias("y")), "v")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cos = np.einsum("ij,ij->i", _matrix(batch["x"].to_pylist()), _matrix(batch["y"].to_pylist()))
                yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], ["u", "v"]).filter(pa.array(cos >= THRESHOLD))

    return full.select("u", "v", "x", "y").mapInArrow(check, "u long, v long")


def _centres(members: DataFrame) -> DataFrame:
    """root, centre: the direction of the sum of a component's vectors, summed by batches first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                root, at = np.unique(np.asarray(batch["root"]), return_inverse=True)
                x = _matrix(batch["unit"].to_pylist())
                total = np.zeros((len(root), x.shape[1]))
                np.add.at(total, at, x)
                yield pa.RecordBatch.from_arrays([pa.array(root), pa.array([t.astype("<f8").tobytes() for t in total], pa.binary())], ["root", "part"])

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sort(_matrix(part["part"].tolist()), axis=0).sum(0)  # in an order that reruns share
        size = np.sqrt(total @ total)
        return pd.DataFrame({"root": part["root"].iloc[:1], "centre": [(total / size if size > 0 else total).astype("<f8").tobytes()]})

    return members.select("root", "unit").mapInArrow(partial, "root long, part binary").groupBy("root").applyInPandas(whole, "root long, centre binary")


def _crowded(links: DataFrame, k: int) -> DataFrame:
    """node of those with ``k`` links or more."""
    ends = links.select("u").unionByName(links.select(F.col("v").alias("u")))
    return ends.groupBy("u").count().where(F.col("count") >= k).select(F.col("u").alias("node"))


def dense_members(nodes: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """node, weight, unit, root, core (whether it is sure to link with all others of the root's core) of the
    components that hold a node with ``k`` listed links or more."""
    crowded = _crowded(links, k)
    half = math.acos(THRESHOLD) / 2 - 1e-9

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cos = np.einsum("ij,ij->i", _matrix(batch["unit"].to_pylist()), _matrix(batch["centre"].to_pylist()))
                near = np.arccos(np.clip(cos, -1, 1)) <= half
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("node", "weight", "unit", "root")), pa.array(near)], ["node", "weight", "unit", "root", "core"])

    roots = components(links, "nn-dense")
    dense = roots.join(crowded, "node").select("root").distinct()
    members = saved(roots.join(dense, "root").join(nodes.select("node", "weight", "unit"), "node"), "nn-members")
    return saved(members.join(_centres(members), "root").select("node", "weight", "unit", "root", "centre").mapInArrow(inside, "node long, weight long, unit binary, root long, core boolean"), "nn-cores")


def _stars(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column label) labels of the components of a bipartite link matrix; equal where linked by a path."""
    a, b = np.arange(len(link)), np.full(link.shape[1], len(link))
    while True:
        low = np.where(link, a[:, None], len(link)).min(0, initial=len(link))
        up = np.minimum(a, np.where(link, low, len(link)).min(1, initial=len(link)))
        if (up == a).all() and (low == b).all():
            return a, b
        a, b = up, low


def tiled(members: DataFrame) -> DataFrame:
    """node, n: rows with which each member links among the members of its root, itself included."""
    return tiled_pairs(members, False).groupBy("node").agg(F.sum("n").alias("n"))


def tiled_pairs(members: DataFrame, connect: bool) -> DataFrame:
    """node, n, v: parts of the number of rows that a member links with among its root's, itself included, v null;
    if ``connect``, links to v too, n null. Every two tiles of a root are compared, but for two of its core, whose
    nodes all link."""
    parts = members.groupBy("root").agg(F.sum(F.col("core").cast("long")).alias("inner"), F.count(F.lit(1)).alias("size"), F.sum(F.when(F.col("core"), F.col("weight")).otherwise(0)).alias("core_weight"))
    parts = saved(parts.select("root", "core_weight", F.ceil(F.col("inner") / TILE).alias("a"), F.ceil((F.col("size") - F.col("inner")) / TILE).alias("b")), "nn-tiles")
    code = F.xxhash64("node", F.lit("tile"))
    dealt = members.join(parts, "root").withColumn("tile", F.when(F.col("core"), F.pmod(code, "a")).otherwise(F.col("a") + F.pmod(code, F.greatest("b", F.lit(1)))))
    proven = dealt.where("core").select("node", F.col("core_weight").alias("n"))
    first = F.when(F.col("core"), F.col("a")).otherwise(F.lit(0).cast("long"))
    met = dealt.where(first < F.col("a") + F.col("b")).withColumn("other", F.explode(F.sequence(first, F.col("a") + F.col("b") - 1)))

    def compared(part: pd.DataFrame) -> pd.DataFrame:
        x, w, low = _matrix(part["unit"].tolist()), part["weight"].to_numpy(), (part["tile"] < part["other"]).to_numpy()
        same = (part["tile"] == part["other"]).to_numpy()
        n = np.zeros(len(x), np.int64)
        if same.all():
            link = x @ x.T >= THRESHOLD
            n += link @ w
        else:
            link = x[low] @ x[~low].T >= THRESHOLD
            n[low], n[~low] = link @ w[~low], link.T @ w[low]
        node = part["node"].to_numpy()
        out = pd.DataFrame({"node": node, "n": pd.array(n, "Int64"), "v": pd.array([None] * len(n), "Int64")})
        if connect and link.any():
            left, right = (node, node) if same.all() else (node[low], node[~low])
            a, b = _stars(link)
            ends, roots = np.concatenate([left, right[b < len(left)]]), left[np.concatenate([a, b[b < len(left)]])]
            far = ends != roots
            out = pd.concat([out, pd.DataFrame({"node": ends[far], "n": pd.array([None] * far.sum(), "Int64"), "v": pd.array(roots[far], "Int64")})])
        return out

    counted = met.select("root", F.least("tile", "other").alias("s"), F.greatest("tile", "other").alias("t"), "node", "weight", "unit", "tile", "other").groupBy("root", "s", "t").applyInPandas(compared, "node long, n long, v long")
    return counted.unionByName(proven.withColumn("v", F.lit(None).cast("long")))


def link_counts(nodes: DataFrame, links: DataFrame, exact: DataFrame) -> DataFrame:
    """node, n: the rows other than one of its own that a node links with, as listed but where ``exact`` has
    its node, n with itself."""
    weight = nodes.select("node", "weight")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(exact.select(F.col("node").alias("u")), "u", "left_anti")
    listed = both.join(weight.select(F.col("node").alias("v"), F.col("weight").alias("w")), "v").groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("listed"))
    return weight.join(exact, "node", "left").join(listed, "node", "left").select("node", (F.coalesce("n", F.coalesce("listed", F.lit(0)) + F.col("weight")) - 1).alias("n"))


def audited_recall(nodes: DataFrame, counts: DataFrame, n: int) -> float:
    """The least mean recall of a class of audited nodes, classes by the power of 2 of a node's links; all of them
    are compared with every node. A class holds ``LEAST_CLASS`` nodes or goes with the next."""
    seen = nodes.join(counts, "node")
    code = F.xxhash64("node", F.lit("audit"))
    queries = seen.orderBy(code).limit(AUDIT).unionByName(seen.where(F.col("n") > F.col("weight") - 1).orderBy(code).limit(AUDIT)).select("node", "weight", "unit").distinct().collect()
    if not queries:
        return 1.0
    shared = nodes.sparkSession.sparkContext.broadcast([(q["node"], bytes(q["unit"])) for q in queries])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([i for i, _ in shared.value])
        length = np.array([len(b) for _, b in shared.value])
        total = np.zeros(len(ids))
        for batch in batches:
            if not len(batch):
                continue
            x, w = _matrix(batch["unit"].to_pylist()), np.asarray(batch["weight"])
            same = np.flatnonzero(length == 8 * x.shape[1])
            if len(same):
                total[same] += ((_matrix([shared.value[i][1] for i in same]) @ x.T >= THRESHOLD) * w).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "true"])

    true = nodes.select("unit", "weight").mapInArrow(count, "node long, true double").groupBy("node").agg(F.sum("true").alias("true"))
    weight = {q["node"]: q["weight"] for q in queries}
    got = sorted((r["true"] - weight[r["node"]], r["n"] + 1 - weight[r["node"]]) for r in counts.join(F.broadcast(true), "node").collect())
    return least_mean_recall([g for g in got if g[0] > 0])


def least_mean_recall(got: list[tuple[float, float]]) -> float:
    """Of (links there are, links found) of nodes, a node counting once: the least mean of a class."""
    classes: list[list[float]] = []
    last = -1
    for true, found in sorted(got):
        size = int(math.log2(true))
        if not classes or (size != last and len(classes[-1]) >= LEAST_CLASS):
            classes.append([])
        classes[-1].append(min(1.0, found / true))
        last = size
    if len(classes) > 1 and len(classes[-1]) < LEAST_CLASS:
        classes[-2] += classes.pop()
    return min((sum(c) / len(c) for c in classes), default=1.0)


def compared_whole(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(link counts, links that connect what all links connect) from comparing all nodes with one another."""
    met = nodes.select("node", "weight", "unit", F.lit(0).cast("long").alias("root"), F.lit(False).alias("core"))
    both = saved(tiled_pairs(met, True), "nn-whole")
    exact = both.where("v is null").groupBy("node").agg(F.sum("n").alias("n"))
    return saved(exact.select("node", (F.col("n") - 1).alias("n")), "nn-counts"), saved(both.where("v is not null").select(F.col("node").alias("u"), "v"), "nn-links")


def near_duplicates(vectors: DataFrame) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept for every row; the audited recall)."""
    rows = saved(unit_rows(vectors).withColumn("code", F.xxhash64("unit")), "nn-rows")
    valid = rows.where("unit is not null")
    folded = valid.groupBy("code", "unit").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    # vectors that share a hash, should there be any, are numbered apart
    place = F.row_number().over(Window.partitionBy("code").orderBy("unit")) - 1
    numbered = folded.withColumn("node", F.when(place == 0, F.col("code")).otherwise(F.xxhash64("code", place)))
    everything = saved(numbered.withColumn("size", F.octet_length("unit")), "nn-nodes")
    found = []
    recall = 1.0
    for size in sorted(r["size"] for r in everything.select("size").distinct().collect()):
        nodes = everything.where(F.col("size") == size)
        counts, links, recall_here = _searched(nodes)
        found.append((counts, links))
        recall = min(recall, recall_here)
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")), recall
    counts, links = found[0]
    for c, e in found[1:]:
        counts, links = counts.unionByName(c), links.unionByName(e)
    roots = components(links, "nn-cc")
    named = everything.select("node", "code", "unit", "least", "weight").join(roots, "node", "left").join(counts, "node")
    named = saved(named.select("code", "unit", "least", "weight", F.col("n").cast("long").alias("n_links"), F.coalesce("root", "node").alias("root")), "nn-named")
    least = saved(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "nn-least")
    by_node = saved(spread_join(named, least, "root").select("code", F.col("unit").alias("own"), "n_links", "component_id", F.col("weight").alias("n")), "nn-by-node")
    whole = spread_join(rows.where("unit is not null"), by_node, "code").where("unit = own").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), recall


def _searched(nodes: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(link counts, links, recall) of nodes with vectors of one length."""
    n, k, lists = nodes.count(), K, None
    for attempt in range(TRIES):
        graph = first_graph(nodes, n, k, 5 + attempt)
        lists = saved(shortlist(graph if lists is None else lists.unionByName(graph), k), "nn-lists")
        before = -1
        while True:
            now = lists.where(F.col("cos") >= THRESHOLD).count()
            if now <= before:
                break
            before = now
            lists = saved(descend(nodes, lists, k), "nn-lists")
        links = bridged(nodes, n, lists, saved(exact_links(nodes, lists), "nn-links"), k, 100 + 10 * attempt)
        exact = saved(tiled(dense_members(nodes, links, k)), "nn-exact")
        counts = saved(link_counts(nodes, links, exact), "nn-counts")
        recall = audited_recall(nodes, counts, n)
        if recall >= RECALL:
            return counts, links, recall
        k *= 2
    return *compared_whole(nodes), 1.0


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))[0]
