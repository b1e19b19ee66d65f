"""Exact top-k inner-product search with M-trees: paged metric nodes, covering radii, parent distances."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from riskloom.session import materialise

SCALE = 1024
# entries of a node
PAGE = 64
# rows of one tree, cells of the first level (both bound what a task holds), queries that visit a tree together
TREE_ROWS, CELLS, QUERIES = 8192, 256, 2048


@dataclass
class Node:
    """``inner`` nodes route to children around ``vectors``; leaves hold rows. ``apart`` is the distance of every
    entry from the vector that the parent routes by."""

    inner: bool
    ids: np.ndarray
    vectors: np.ndarray
    lifts: np.ndarray
    radius: np.ndarray
    apart: np.ndarray


def distances(vectors: np.ndarray, lifts: np.ndarray, vector: np.ndarray, lift: float) -> np.ndarray:
    return np.sqrt(((vectors - vector) ** 2).sum(axis=1) + (lifts - lift) ** 2)


def build_tree(ids: np.ndarray, vectors: np.ndarray, lifts: np.ndarray) -> list[Node]:
    """Bulk load: every node routes by up to PAGE of its rows, each row goes to the nearest; node 0 is the root."""
    nodes: list[Node] = []

    def add(rows: np.ndarray, pivot: int | None) -> tuple[int, float]:
        """Builds the node of ``rows``; its number and the largest distance from the pivot."""
        number = len(nodes)
        nodes.append(None)  # its place, before its children's
        points, high = vectors[rows].astype(float), lifts[rows]
        apart = np.zeros(len(rows)) if pivot is None else distances(points, high, vectors[pivot].astype(float), lifts[pivot])
        reach = float(apart.max(initial=0.0))
        if len(rows) <= PAGE:
            nodes[number] = Node(False, ids[rows], vectors[rows], high, np.zeros(len(rows)), apart)
            return number, reach
        count = min(PAGE, -(-len(rows) // PAGE) + 1)
        chosen = np.linspace(0, len(rows) - 1, count).astype(int)
        squares = (points**2).sum(axis=1) + high**2
        products = points @ points[chosen].T + high[:, None] * high[chosen][None, :]
        nearest = np.argmin(squares[chosen][None, :] - 2 * products, axis=1)
        if (nearest == nearest[0]).all():  # equal rows: any even split will do
            nearest = np.arange(len(rows)) * count // len(rows)
        entries = []
        for group in np.unique(nearest):
            inside = rows[nearest == group]
            child, radius = add(inside, inside[0])
            entries.append((child, inside[0], radius))
        routes = np.array([e[1] for e in entries])
        to_parent = np.zeros(len(routes))
        if pivot is not None:
            to_parent = distances(vectors[routes].astype(float), lifts[routes], vectors[pivot].astype(float), lifts[pivot])
        nodes[number] = Node(True, np.array([e[0] for e in entries]), vectors[routes], lifts[routes], np.array([e[2] for e in entries]), to_parent)
        return number, reach

    if len(ids):
        add(np.arange(len(ids)), None)
    return nodes


class Best:
    """The k best (score, id) so far; ties go to the smaller id."""

    def __init__(self, k: int, floor: int | None):
        self.k, self.floor = k, floor
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]

    def least(self) -> int | None:
        """A score that the k-th best reaches at least."""
        own = int(self.scores[-1]) if len(self.ids) == self.k else None
        known = [s for s in (own, self.floor) if s is not None]
        return max(known) if known else None


def search_tree(nodes: list[Node], query: np.ndarray, own: int | None, best: Best, largest: int, exact: type) -> None:
    """Best-first over the nodes by their smallest possible distance.

    Rows are lifted by sqrt(largest - |x|^2), so that the squared distance of a query (lift 0) is
    |q|^2 + largest - 2 q.x: the nearest rows have the largest products. An entry whose stored distance to the
    routing vector already puts it beyond the k-th best is passed over without computing its own distance."""
    q = query.astype(exact)
    base = float((query.astype(float) ** 2).sum()) + largest
    slack = 1e-9 * np.sqrt(base) + 1e-6

    def limit() -> float:
        least = best.least()
        return np.inf if least is None else np.sqrt(max(0.0, base - 2.0 * least)) + slack

    heap: list[tuple[float, int, float | None]] = [(0.0, 0, None)]
    while heap:
        bound, number, routed = heapq.heappop(heap)
        reach = limit()
        if bound > reach:
            return
        node = nodes[number]
        wanted = slice(None)
        if routed is not None:
            wanted = np.abs(routed - node.apart) - node.radius <= reach
        ids, products = node.ids[wanted], node.vectors[wanted].astype(exact) @ q
        if node.inner:
            away = np.sqrt(np.maximum(0.0, base - 2.0 * products.astype(float)))
            for child, distance, radius in zip(ids.tolist(), away.tolist(), node.radius[wanted].tolist()):
                nearest = max(0.0, distance - radius)
                if nearest <= reach:
                    heapq.heappush(heap, (nearest, child, distance))
        else:
            mine = ids != own if own is not None else np.ones(len(ids), bool)
            scores = products.astype(np.int64)
            least = best.least()
            if least is not None:
                mine &= scores >= least
            if mine.any():
                best.offer(ids[mine], scores[mine])


def integer_vectors(embeddings: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(_id, _v): floor(scale * component) of the whole, finite vectors with a key."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = embeddings.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & ~bad)
    return whole.select(
        F.col(key).cast("bigint").alias("_id"), F.transform(values, lambda x: F.floor(F.lit(float(scale)) * x)).alias("_v")
    )


def matrix(lists, width: int) -> np.ndarray:
    """Shorter vectors are filled up with zeros, which add nothing to a product."""
    out = np.zeros((len(lists), width), np.int64)
    for row, values in enumerate(lists):
        out[row, : len(values)] = values
    return out


def packed_nodes(nodes: list[Node], cell: int, tree: int, width: int) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "cell": cell,
            "tree": tree,
            "node": range(len(nodes)),
            "inner": [n.inner for n in nodes],
            "ids": [n.ids.astype(np.int64).tobytes() for n in nodes],
            "vectors": [n.vectors.astype(np.int64).tobytes() for n in nodes],
            "lifts": [n.lifts.tobytes() for n in nodes],
            "radius": [n.radius.tobytes() for n in nodes],
            "apart": [n.apart.tobytes() for n in nodes],
        }
    )


def unpacked_nodes(rows: pd.DataFrame, width: int) -> list[Node]:
    rows = rows.sort_values("node")
    columns = (rows[c] for c in ("inner", "ids", "vectors", "lifts", "radius", "apart"))
    return [
        Node(bool(inner), np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int64).reshape(-1, width), *(np.frombuffer(b) for b in rest))
        for inner, ids, vectors, *rest in zip(*columns)
    ]


NODES = (
    "cell int, tree int, node int, inner boolean, ids binary, vectors binary, lifts binary, radius binary, apart binary"
)
FOUND = "query_id bigint, _print bigint, vec_id bigint, score bigint"


@dataclass
class Index:
    """Stored node pages, and the first level: at most CELLS routing vectors with covering radii."""

    nodes: DataFrame
    pivots: np.ndarray
    pivot_lifts: np.ndarray
    radius: np.ndarray
    trees: np.ndarray
    width: int
    largest: int
    exact: type


def lifted(vectors: np.ndarray, largest: int) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, largest - (vectors.astype(float) ** 2).sum(axis=1)))


def build_index(rows: DataFrame) -> Index:
    """``rows``: stored (_id, _v). The first level routes by rows with the smallest digests, the fewer the fewer
    rows; a cell of over TREE_ROWS rows is split by id into trees of about that size, however large it is."""
    squares = F.aggregate("_v", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)"))
    count, width, largest = rows.agg(F.count("*"), F.max(F.size("_v")), F.max(squares)).first()
    width, largest = width or 0, int(largest or 0)
    if largest >= 2**62:
        raise ValueError("inner products of these vectors do not fit into 64 bits")
    # products of doubles are exact below 2**53
    exact = float if largest < 2**52 else np.int64
    wanted = max(1, min(CELLS, count // (TREE_ROWS // 4)))
    sample = rows.orderBy(F.xxhash64("_id"), "_id", "_v").limit(wanted).collect()
    pivots = matrix([r["_v"] for r in sample], width)
    pivot_lifts = lifted(pivots, largest)
    spark = rows.sparkSession

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = (pivots.astype(float) ** 2).sum(axis=1) + pivot_lifts**2
        for batch in batches:
            vectors = matrix(batch.column(1).to_pylist(), width)
            lifts = lifted(vectors, largest)
            squared = level[None, :] - 2 * (vectors.astype(float) @ pivots.T.astype(float) + lifts[:, None] * pivot_lifts[None, :])
            cell = np.argmin(squared, axis=1)
            away = np.sqrt(((vectors - pivots[cell]).astype(float) ** 2).sum(axis=1) + (lifts - pivot_lifts[cell]) ** 2)
            columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_v", "cell", "away"])

    placed = rows.mapInArrow(assign, "_id bigint, _v array<bigint>, cell int, away double")
    placed = materialise(placed, "cells")
    trees, radius = np.zeros(len(pivots), int), np.zeros(len(pivots))
    for cell, size, reach in placed.groupBy("cell").agg(F.count("*"), F.max("away")).collect():  # CELLS rows at most
        trees[cell], radius[cell] = -(-size // TREE_ROWS), reach
    counts = F.array(*[F.lit(int(t)) for t in trees]) if len(trees) else F.array(F.lit(1))
    split = placed.withColumn("tree", F.pmod(F.xxhash64("_id", "_v"), F.get(counts, F.col("cell"))).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_id", kind="stable")
        vectors = matrix(group["_v"].tolist(), width)
        nodes = build_tree(group["_id"].to_numpy(), vectors, lifted(vectors, largest))
        return packed_nodes(nodes, int(group["cell"].iloc[0]), int(group["tree"].iloc[0]), width)

    nodes = split.select("cell", "tree", "_id", "_v").groupBy("cell", "tree").applyInPandas(build, NODES)
    return Index(materialise(nodes, "nodes"), pivots, pivot_lifts, radius, trees, width, largest, exact)


def visit(index: Index, visits: DataFrame, k: int) -> DataFrame:
    """``visits``: (cell, tree, _id, _print, _v, least), which query visits which tree. Queries meet a tree in
    groups of bounded size, so a tree is read once for every QUERIES of its visitors."""
    width, largest, exact = index.width, index.largest, index.exact
    groups = F.pmod(F.xxhash64("_id", "_print"), F.col("_groups")).cast("int")
    sizes = visits.groupBy("cell", "tree").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("_groups"))
    sizes = materialise(sizes, "visitors")
    asked = visits.join(sizes, ["cell", "tree"]).withColumn("group", groups).drop("_groups")
    pages = index.nodes.join(sizes, ["cell", "tree"])
    pages = pages.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_groups")

    def run(pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        nodes, out = unpacked_nodes(pages, width), []
        for own, text, values, least in zip(asked["_id"], asked["_print"], asked["_v"], asked["least"]):
            best = Best(k, None if pd.isna(least) else int(least))
            if nodes:
                search_tree(nodes, matrix([values], width)[0], own, best, largest, exact)
            out.append(pd.DataFrame({"query_id": own, "_print": text, "vec_id": best.ids, "score": best.scores}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "_print", "vec_id", "score"])

    keys = ["cell", "tree", "group"]
    return pages.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, FOUND)


def top_k(
    embeddings: DataFrame,
    queries: DataFrame,
    *,
    key: str = "node_id",
    vector: str = "embedding",
    k: int = 10,
    scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` the ``k`` rows of ``embeddings`` with the
    largest integer inner products, ties to the smaller key; rows with the query's own key take no part.

    Works on graph embeddings (one row per node, the components as an array) as on any keyed vectors; keys are
    integers. Components count as floor(scale * component). Vectors that are NULL or hold a NULL or non-finite
    component, and rows with a NULL key, take no part; shorter vectors are filled up with zeros. Repeated rows of
    ``embeddings`` are separate candidates; repeated query rows are answered once. Fewer candidates than ``k``
    give all; empty tables give nothing. Extra columns are ignored.

    Every query first searches a tree of its own cell. The k-th score found there bounds the rest: it goes on only
    to trees whose cell's covering radius can hold a better one. The answer is exact.
    """
    spark: SparkSession = embeddings.sparkSession
    rows = materialise(integer_vectors(embeddings, key, vector, scale), "vectors")
    index = build_index(rows)
    asked = integer_vectors(queries, key, vector, scale).distinct()
    asked = asked.withColumn("_print", F.xxhash64("_v"))
    pivots, pivot_lifts, radius, trees = index.pivots, index.pivot_lifts, index.radius, index.trees
    largest = index.largest
    # a query may be longer than every row
    wide = len(pivots[0]) if len(pivots) else 0

    def cut(lists) -> np.ndarray:
        return matrix([v[:wide] for v in lists], wide)

    def cells_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = (vectors.astype(float) ** 2).sum(axis=1)[:, None] + largest
        return base, np.sqrt(np.maximum(0.0, base - 2 * (vectors.astype(float) @ pivots.T.astype(float))))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = cut(batch.column("_v").to_pylist())
            _, away = cells_of(vectors)
            columns = [pa.array(np.argmin(away, axis=1).astype(np.int32)), batch.column("_id"), batch.column("_print"), pa.array(list(vectors), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "_id", "_print", "_v"])

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, own = cut(batch.column("_v").to_pylist()), batch.column("cell").to_numpy()
            base, away = cells_of(vectors)
            least = np.array([np.nan if s is None else s for s in batch.column("least").to_pylist()], float)
            reach = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(0.0, base[:, 0] - 2 * least)))
            reach = reach + 1e-9 * np.sqrt(base[:, 0]) + 1e-6
            for row, cell in zip(*np.nonzero((away - radius[None, :] <= reach[:, None]) & (trees > 0)[None, :])):
                begin = 1 if cell == own[row] else 0
                numbers = np.arange(begin, trees[cell], dtype=np.int32)
                if len(numbers):
                    one = batch.slice(row, 1).select(["_id", "_print", "_v", "least"])
                    columns = [pa.array(np.full(len(numbers), cell, np.int32)), pa.array(numbers)]
                    columns += [c.take(pa.array(np.zeros(len(numbers), np.int32))) for c in one.columns]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "tree", *one.schema.names])

    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not len(pivots):
        return spark.createDataFrame([], result)
    homes = materialise(asked.mapInArrow(home, "cell int, _id bigint, _print bigint, _v array<bigint>"), "homes")
    first = homes.select("cell", F.lit(0).alias("tree"), "_id", "_print", "_v", F.lit(None).cast("bigint").alias("least"))
    near = materialise(visit(index, first, k), "near")
    reached = near.groupBy(F.col("query_id").alias("_id"), "_print").agg(F.min("score").alias("_s"), F.count("*").alias("_n"))
    bounded = homes.join(reached, ["_id", "_print"], "left")
    bounded = bounded.select("_id", "_print", "_v", "cell", F.when(F.col("_n") == k, F.col("_s")).alias("least"))
    rest = bounded.mapInArrow(
        onward, "cell int, tree int, _id bigint, _print bigint, _v array<bigint>, least bigint"
    )
    far = visit(index, materialise(rest, "visits"), k)
    order = W.partitionBy("query_id", "_print").orderBy(F.desc("score"), "vec_id")
    ranked = near.union(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
