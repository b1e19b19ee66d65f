"""Iterative graph jobs: PageRank, weak components, communities, spectral embedding.

Common rules: round states are written tables in the shared folder (true sizes, no lineage, no grown
constraints); edges that every round reads are checkpointed in their partitioning; the driver sees
scalars and k x k matrices only; a vertex with very many edges is split over several partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.operators import moves
from riskloom.operators.graph import Graph, undirected_edges
from riskloom.session import cut_lineage, discard, materialise

# edges of one vertex that may share a partition key
EDGES_PER_SPLIT = 200_000
# arcs of a graph whose communities one task searches; it takes about 90 bytes for each
TASK_ARCS = 12_000_000


def split_edges(edges: DataFrame, key: str, other: str) -> tuple[DataFrame, DataFrame]:
    """Edges with a ``_part`` column that cuts hubs of ``key`` into pieces, and the pieces per hub.

    Returns (edges, pieces) where pieces has one row per key with more than one piece.
    """
    pieces = (
        edges.groupBy(key)
        .agg(F.count("*").alias("_n"))
        .select(key, F.ceil(F.col("_n") / EDGES_PER_SPLIT).cast("int").alias("_pieces"))
        .where("_pieces > 1")
    )
    spread = edges.join(pieces, key, "left").withColumn(
        "_part", F.pmod(F.xxhash64(other), F.coalesce("_pieces", F.lit(1))).cast("int")
    )
    return spread.drop("_pieces"), pieces


def spread_state(state: DataFrame, key: str) -> DataFrame:
    """Replicates the state row of a hub once per piece of its edges (``_pieces`` column)."""
    parts = F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_part")
    return state.select("*", parts).drop("_pieces")


def pin_edges(edges: DataFrame, key: str) -> DataFrame:
    """Edges hash-partitioned by (key, piece) once, so that the joins of later rounds shuffle vertex
    state only. A checkpoint keeps its partitioning only when planned without adaptive execution;
    that covers just the plain shuffle of the already stored edges."""
    spark = edges.sparkSession
    stored = save(edges)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(stored.repartition(partitions, key, "_part").sortWithinPartitions(key, "_part"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def save(state: DataFrame) -> DataFrame:
    return materialise(state, "state")


def pagerank(
    graph: Graph,
    *,
    weight: str = "total_amount",
    damping: float = 0.85,
    tolerance: float = 1e-6,
    max_rounds: int = 100,
    rounds_per_check: int = 5,
    fixed_rounds: int | None = None,
) -> DataFrame:
    """(node_id, pagerank), summing to 1.

    With teleport and dangling mass both spread uniformly, the PageRank vector is proportional to the
    solution of x = damping * A x + (1 - damping) / n, so dangling mass needs no per-round scalar: the
    result is normalised once at the end. Stops when the L1 change of a round falls below
    n * tolerance, or after ``fixed_rounds``; raises if it has not settled after ``max_rounds``.
    """
    vertices = graph.vertices.select("node_id")
    count = vertices.count()
    if count == 0:
        return vertices.withColumn("pagerank", F.lit(0.0))
    out = graph.edges.groupBy("src").agg(F.sum(weight).alias("_out")).where("_out <> 0")
    shares = graph.edges.join(out, "src").select("src", "dst", (F.col(weight) / F.col("_out")).alias("share"))
    spread, pieces = split_edges(shares, "src", "dst")
    # partitioned once; the rounds below shuffle ranks, not edges
    spread = pin_edges(spread, "src")
    pieces = pieces.select(F.col("src").alias("node_id"), "_pieces")
    base = save(
        vertices.join(pieces, "node_id", "left").select("node_id", F.coalesce("_pieces", F.lit(1)).alias("_pieces"))
    )
    teleport = (1.0 - damping) / count

    def step(ranks: DataFrame) -> DataFrame:
        sent = spread_state(ranks.select("node_id", "_pieces", "rank"), "node_id").withColumnRenamed("node_id", "src")
        flow = (
            spread.join(sent, ["src", "_part"])
            .groupBy(F.col("dst").alias("node_id"))
            .agg(F.sum(F.col("share") * F.col("rank")).alias("_in"))
        )
        # joined with the vertices, not with the previous ranks: a chain of rounds stays linear
        moved = F.lit(teleport) + damping * F.coalesce("_in", F.lit(0.0))
        return base.join(flow, "node_id", "left").select("node_id", "_pieces", moved.alias("rank"))

    ranks = base.withColumn("rank", F.lit(1.0 / count))
    done, limit = 0, fixed_rounds or max_rounds
    while done < limit:
        rounds = min(rounds_per_check, limit - done)
        for _ in range(rounds - 1):
            ranks = step(ranks)
        before = save(ranks)
        ranks = save(step(before))
        done += rounds
        if fixed_rounds is None:
            pairs = ranks.join(before.select("node_id", F.col("rank").alias("previous")), "node_id")
            change = pairs.agg(F.sum(F.abs(F.col("rank") - F.col("previous")))).first()[0]
            discard(before)
            if change < count * tolerance:
                break
    else:
        if fixed_rounds is None:
            raise RuntimeError(f"PageRank has not settled in {max_rounds} rounds (last change {change})")
    total = ranks.agg(F.sum("rank")).scalar()
    return ranks.select("node_id", (F.col("rank") / total).alias("pagerank"))


def local_pagerank(
    graph: Graph,
    seeds: DataFrame,
    *,
    weight: str = "total_amount",
    damping: float = 0.85,
    tolerance: float = 1e-6,
    max_rounds: int = 1000,
) -> DataFrame:
    """(seed, node_id, rank, residual): random walks from each account of ``seeds`` (node_id) that go on along an edge,
    by its share of the weight that its source sends, with chance ``damping``, and else return to the seed.

    Forward push: mass waits at nodes as a residual. In a round, the nodes whose residual is over ``tolerance`` keep
    what would return and pass the rest on; all others are not touched, so the work follows the neighbourhood that the
    walks reach and not the graph. A node that sends nothing passes its part to the seed. The ranks of a seed and its
    residuals add up to 1: what the residuals add up to bounds the error. Seeds that are not in the graph, and NULL,
    have no rows; a seed given twice counts once. Raises if a frontier is left after ``max_rounds``.
    """
    out = graph.edges.groupBy("src").agg(F.sum(weight).alias("_out")).where("_out <> 0")
    shares = save(graph.edges.join(out, "src").select("src", "dst", (F.col(weight) / F.col("_out")).alias("share")))
    known = seeds.select("node_id").distinct().join(graph.vertices.select("node_id"), "node_id", "left_semi")
    state = known.select(F.col("node_id").alias("seed"), "node_id", F.lit(0.0).alias("rank"), F.lit(1.0).alias("residual"))
    state = save(state)
    for _ in range(max_rounds):
        front = state.where(F.col("residual") > tolerance)
        if front.isEmpty():
            return state
        sent = front.join(shares.withColumnRenamed("src", "node_id"), "node_id", "left")
        target, part = F.coalesce("dst", "seed"), F.coalesce("share", F.lit(1.0))
        arrived = sent.select("seed", target.alias("node_id"), F.lit(0.0).alias("rank"), (damping * F.col("residual") * part).alias("residual"))
        pushed = F.col("residual") > tolerance
        kept = state.select(
            "seed",
            "node_id",
            (F.col("rank") + F.when(pushed, (1 - damping) * F.col("residual")).otherwise(0.0)).alias("rank"),
            F.when(pushed, 0.0).otherwise(F.col("residual")).alias("residual"),
        )
        moved = kept.union(arrived).groupBy("seed", "node_id").agg(F.sum("rank").alias("rank"), F.sum("residual").alias("residual"))
        ahead = save(moved)
        discard(state)
        state = ahead
    raise RuntimeError(f"local PageRank has not settled in {max_rounds} rounds")


def followed(pointers: DataFrame) -> DataFrame:
    """(node, root) after following (node, root) pointers to their ends; they lead to smaller nodes only."""
    while True:
        ahead = pointers.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        moved = (F.col("_next") != F.col("root")).alias("_moved")
        further = save(pointers.join(ahead, "root").select("node", F.col("_next").alias("root"), moved))
        discard(pointers)
        pointers = further.select("node", "root")
        if further.where("_moved").isEmpty():
            return pointers


def linked_roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b) that has a neighbour; the root is the smallest node of its
    component.

    A round points every node to its smallest neighbour if that is smaller, follows the pointers to their roots
    and replaces the links by those between different roots. Every node but the smallest of its neighbourhood
    disappears, so the number of rounds is logarithmic. All joins of a round are between stored tables: those on
    a hub, or on the root of a giant component, are plain shuffles that adaptive execution splits; minima are
    partially aggregated.
    """
    different = links.where("a <> b").select("a", "b")
    both = save(different.union(different.select("b", "a")).distinct())
    labels = None
    while True:
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"))
        roots = followed(save(least.select("node", F.least("node", "_least").alias("root"))))
        if labels is None:
            labels = roots
        else:
            onward = roots.select(F.col("node").alias("root"), F.col("root").alias("_onward"))
            joined = labels.join(onward, "root", "left")
            combined = save(joined.select("node", F.coalesce("_onward", "root").alias("root")))
            discard(labels)
            labels = combined
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        half = save(both.join(a, "a").select("_a", "b"))
        ends = half.join(b, "b").where("_a <> _b")
        contracted = save(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        discard(both, half, *([roots] if labels is not roots else []))
        both = contracted
        if both.isEmpty():
            return labels


def connected_components(graph: Graph) -> DataFrame:
    """(node_id, weak_component_id, weak_component_size); the id is the smallest node of the component."""
    links = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    roots = linked_roots(links).select(F.col("node").alias("node_id"), "root")
    labelled = graph.vertices.select("node_id").join(roots, "node_id", "left")
    labelled = save(labelled.select("node_id", F.coalesce("root", "node_id").alias("weak_component_id")))
    # stored, so that the join on the giant component can be split
    sizes = save(labelled.groupBy("weak_component_id").agg(F.count("*").alias("weak_component_size")))
    return labelled.join(sizes, "weak_component_id").select("node_id", "weak_component_id", "weak_component_size")


def modularity(arcs: DataFrame, assignment: DataFrame, total: float) -> float:
    """Modularity of a partition. ``arcs`` holds both directions (u, v, w); loops count twice."""
    placed = arcs.join(assignment.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(
        assignment.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v"
    )
    inner = placed.groupBy("cu").agg(
        F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inner"), F.sum("w").alias("degree")
    )
    score = F.sum(F.col("inner") / total - F.pow(F.col("degree") / total, 2))
    return float(inner.agg(score).first()[0] or 0.0)


def communities(
    graph: Graph,
    *,
    seed: int = 42,
    max_levels: int = 100,
    max_rounds: int = 2000,
    minimum_gain: float = 1e-7,
    share: float = 0.03,
) -> DataFrame:
    """(node_id, community_id, community_size): multi-level modularity optimisation with connected communities.

    A level has two phases. Nodes move to the neighbouring community with the best gain: in a round about half of the
    nodes may move, drawn by a hash, and only active nodes are rated, which are those that had to wait and the
    neighbours of the last moves; when fewer than one node in fifty gains, all of them may move. The change of
    modularity follows from the moved nodes and their arcs alone; a round that does not gain is replaced by those of its moves that share no community, which gain what they gain alone.
    The phase ends when no active node gains, or two rounds together gain less than ``minimum_gain``, or less than
    ``share`` of what the phase has gained: the rest is left to the next levels. Then every community is built anew
    from single nodes: nodes still alone join a part of their community that they are linked with and gain by, while
    that part holds still, so that every part is connected. Parts become the nodes of the next level and start it in
    their communities. The levels end when no node of a level has moved and the communities are the nodes, or no
    part has grown.

    At last the graph's own nodes move, from where the levels have brought them, until no active node gains or two
    rounds gain less than ``minimum_gain``, and communities that are not connected are split into their components,
    which only adds to the modularity. Ids are the smallest member. ``max_rounds`` a phase and ``max_levels`` are safety
    limits: they raise.

    From the level on whose arcs are at most TASK_ARCS, with bigint ids, one task makes the same moves on arrays
    (``moves``): a round is no set of jobs there. Larger levels, and the last phase of a larger graph, are distributed.
    """
    pairs = undirected_edges(graph.edges)
    weight = F.col("weight").cast("double")
    forward = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), weight.alias("w"))
    finest = save(forward.union(forward.select("v", "u", "w")))
    total = finest.agg(F.sum("w")).first()[0]
    membership = graph.vertices.select("node_id", F.col("node_id").alias("node"))
    if total:
        membership = save(membership)
        nodes = save(finest.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")))
        arcs, state = finest, save(nodes.withColumns({"community": F.col("node"), "volume": F.col("k")}))
        limits = {"max_levels": max_levels, "max_rounds": max_rounds, "minimum_gain": minimum_gain, "share": share}
        whole = False
        for level in range(max_levels):
            if _fits_a_task(arcs):
                whole = arcs is finest
                membership = _renamed(membership, _searched(arcs, state, total, seed=seed, level=level, last=whole, **limits))
                break
            links = arcs.where("u <> v")
            state, gained = _local_moves(links, state, total, seed + 1000 * level, max_rounds, minimum_gain, share)
            parts, grown = _connected_parts(links, state, total, seed + 1000 * level)
            counts = parts.agg(F.countDistinct("community"), F.countDistinct("part")).first()
            membership = _renamed(membership, parts.select("node", "part"))
            if not gained and (counts[0] == counts[1] or not grown):
                membership = _renamed(membership, parts.select(F.col("part").alias("node"), F.col("community").alias("part")).distinct())
                break
            a = parts.select(F.col("node").alias("u"), F.col("part").alias("pu"))
            b = parts.select(F.col("node").alias("v"), F.col("part").alias("pv"))
            ends = arcs.join(a, "u").join(b, "v").groupBy(F.col("pu").alias("u"), F.col("pv").alias("v"))
            smaller = save(ends.agg(F.sum("w").alias("w")))
            state = save(parts.groupBy(F.col("part").alias("node")).agg(F.sum("k").alias("k"), F.min("community").alias("community"), F.min("volume").alias("volume")))
            discard(parts, *([arcs] if arcs is not finest else []))
            arcs = smaller
        else:
            raise RuntimeError(f"the community search has not settled in {max_levels} levels")
        if not whole:
            # the nodes themselves, until none gains
            links, start = finest.where("u <> v"), membership.select(F.col("node_id"), F.col("node").alias("community"))
            state = save(_with_volumes(nodes.join(start.withColumnRenamed("node_id", "node"), "node")))
            state, _ = _local_moves(links, state, total, seed - 1000, max_rounds, minimum_gain, 0.0)
            membership = _renamed(graph.vertices.select("node_id", F.col("node_id").alias("node")), _components_inside(links, state))
    sizes = membership.groupBy("node").agg(
        F.count("*").alias("community_size"), F.min("node_id").alias("community_id")
    )
    return membership.join(sizes, "node").select("node_id", "community_id", "community_size")


def _fits_a_task(arcs: DataFrame) -> bool:
    return arcs.schema["u"].dataType.simpleString() == "bigint" and arcs.count() <= TASK_ARCS


def _searched(arcs: DataFrame, state: DataFrame, total: float, **options) -> DataFrame:
    """(node, part): the communities that ``moves.search`` finds in one task, from the communities of ``state``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, arcs = [], []
        for batch in batches:
            kind, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            states.append([c[kind == 1] for c in columns])
            arcs.append([c[kind == 0] for c in columns])
        node, community_of, degree = (np.concatenate(c) for c in zip(*states))
        ids = np.unique(np.concatenate([node, community_of]))
        # positions of 32 bits: the arcs are what takes the memory
        a, b, x = (list(c) for c in zip(*arcs))
        del arcs
        w = np.concatenate(x)
        del x
        u, v = (np.concatenate([np.searchsorted(ids, c).astype(np.int32) for c in side]) for side in (a, b))
        del a, b
        order = np.argsort(u, kind="stable")
        u = u[order]
        v = v[order]
        w = w[order]
        del order
        nodes = np.searchsorted(ids, node)
        community, k = np.arange(len(ids)), np.zeros(len(ids))
        community[nodes], k[nodes] = np.searchsorted(ids, community_of), degree
        nodes.sort()
        try:
            part = moves.search(u, v, w, nodes, community, k, ids, total, **options)
        except moves.Unsettled as reason:
            yield pa.RecordBatch.from_pydict({"node": [None], "part": [None], "reason": [str(reason)]}, _SEARCHED)
            return
        found = [pa.array(ids[nodes]), pa.array(ids[part[nodes]]), pa.nulls(len(nodes), pa.string())]
        yield from pa.Table.from_arrays(found, schema=_SEARCHED).to_batches(max_chunksize=100_000)

    rows = arcs.select(F.lit(0).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("w").alias("x"))
    rows = rows.union(state.select(F.lit(1), "node", "community", "k"))
    found = save(rows.coalesce(1).mapInArrow(run, "node bigint, part bigint, reason string"))
    failed = found.where("reason IS NOT NULL").select("reason").first()
    if failed:
        raise RuntimeError(failed.reason)
    return found.select("node", "part")


_SEARCHED = pa.schema([("node", pa.int64()), ("part", pa.int64()), ("reason", pa.string())])


def _renamed(membership: DataFrame, parts: DataFrame) -> DataFrame:
    """Members carried over to the nodes (``part``) that their nodes have become."""
    joined = membership.join(parts, "node", "left")
    return save(joined.select("node_id", F.coalesce("part", "node").alias("node")))


def _components_inside(links: DataFrame, state: DataFrame) -> DataFrame:
    """(node, part): the part is the component of the node among the links inside its community."""
    a = state.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    b = state.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    inner = links.select(F.col("u").alias("a"), F.col("v").alias("b")).join(a, "a").join(b, "b").where("ca = cb")
    return linked_roots(save(inner.select("a", "b"))).withColumnRenamed("root", "part")


def _with_volumes(state: DataFrame) -> DataFrame:
    """``state`` with the ``volume`` of each node's community."""
    # stored, so that the join on a giant community can be split
    volumes = save(state.groupBy("community").agg(F.sum("k").alias("volume")))
    return state.join(volumes, "community").select("node", "k", "community", "volume")


def _local_moves(
    links: DataFrame, state: DataFrame, total: float, seed: int, max_rounds: int, minimum_gain: float, share: float
) -> tuple[DataFrame, float]:
    """``state`` (node, k, community, volume) after the moves of a level, and their gain. ``links`` are the arcs between
    different nodes. Ends when no active node gains, or two rounds together gain less than ``minimum_gain``, or than ``share`` of what all
    rounds have gained."""
    active, gains, calm = None, [], False
    nodes = state.count()
    for round_number in range(max_rounds):
        # few gaining nodes seldom meet: all of them move
        turn = F.lit(True) if calm else F.pmod(F.xxhash64(F.lit(seed + round_number), F.col("node")), F.lit(2)) == 0
        rated = save(_rated(links, state, active, total, turn, minimum_gain))
        ahead, near, change, moves, waiting = _after(links, state, rated, rated.where("moves"), total)
        if moves and change < minimum_gain:
            # too many at once: those that touch no common community
            discard(ahead, near)
            apart = save(_moves_apart(rated.where("moves")))
            ahead, near, change, moves, _ = _after(links, state, apart, apart, total)
        gains.append(change)
        calm = 50 * (moves + waiting) < nodes
        if not moves and not waiting:
            discard(ahead, near, rated)
            return state, sum(gains)
        discard(state)
        state = ahead
        if moves and len(gains) > 1 and sum(gains[-2:]) < max(minimum_gain, share * sum(gains)):
            return state, sum(gains)
        # neighbours of the moves, unless they share the new community, and nodes that had to wait
        active = near.where("apart").select("node").union(rated.where("gains").select("node"))
    raise RuntimeError(f"the community search has not settled in {max_rounds} rounds of a level (last gain {gains[-1]})")


def _rated(
    links: DataFrame, state: DataFrame, active: DataFrame | None, total: float, turn, minimum_gain: float
) -> DataFrame:
    """(node, k, community, volume, best, best_volume, better, gains, moves) of the active nodes (all, if None): the
    best community among those of its neighbours, what it is better by, whether that is a gain, and whether the node
    moves now. Volumes come with the states, so that a round needs no other joins than those of the arcs' ends."""
    source = state if active is None else state.join(active, "node", "left_semi")
    source = source.select(F.col("node").alias("u"), "k", "community", F.col("volume").alias("_own"))
    target = state.select(F.col("node").alias("v"), F.col("community").alias("to"), F.col("volume").alias("_volume"))
    known = [F.first(c).alias(c) for c in ("k", "community", "_own", "_volume")]
    toward = links.join(source, "u").join(target, "v").groupBy(F.col("u").alias("node"), "to").agg(F.sum("w").alias("w"), *known)
    here = F.col("to") == F.col("community")
    gain = F.col("w") - F.col("k") * (F.col("_volume") - F.when(here, F.col("k")).otherwise(0.0)) / total
    # ties to the smallest community: min_by over a two-part order is partially aggregated
    choice = toward.withColumn("gain", gain).groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("k", "community", "_own")],
        F.min_by(F.struct("to", "_volume"), F.struct(-F.round("gain", 9), F.col("to"))).alias("_choice"),
        F.max("gain").alias("_best"),
        F.max(F.when(here, F.col("w"))).alias("_inner"),
    )
    stay = F.coalesce("_inner", F.lit(0.0)) - F.col("k") * (F.col("_own") - F.col("k")) / total
    better = F.col("_best") - stay
    best = F.col("_choice.to")
    # a move changes the modularity by 2 / total times what it is better by
    gains = (best != F.col("community")) & (better * 2 / total > 1e-3 * minimum_gain)
    rows = choice.select(
        "node", "k", "community", F.col("_own").alias("volume"), best.alias("best"),
        F.col("_choice._volume").alias("best_volume"), better.alias("better"), gains.alias("gains"),
    )
    return rows.withColumn("moves", F.col("gains") & turn)


def _after(
    links: DataFrame, state: DataFrame, rated: DataFrame, moved: DataFrame, total: float
) -> tuple[DataFrame, DataFrame, float, int, int]:
    """(state after the moves, their neighbours, change of modularity, moves, gaining nodes that did not move). The
    change follows from the arcs of the moved nodes and the volumes of the communities they leave and join. ``near`` (node, part, apart) has one row per
    neighbour: its share of the change, and whether a moved node has joined a community other than its own."""
    ends = F.array(
        F.struct(F.col("community").alias("c"), (-F.col("k")).alias("d"), F.col("volume").alias("volume")),
        F.struct(F.col("best").alias("c"), F.col("k").alias("d"), F.col("best_volume").alias("volume")),
    )
    spread = moved.select(F.explode(ends).alias("_s")).groupBy(F.col("_s.c").alias("community"))
    shifts = spread.agg(F.sum("_s.d").alias("_shift"), F.first("_s.volume").alias("_before"))
    better = moved.select("node", F.col("best").alias("_to"), F.col("best_volume").alias("_to_volume"))
    placed = state.join(better, "node", "left").select(
        "node", "k", F.coalesce("_to", "community").alias("community"), F.col("community").alias("previous"),
        F.coalesce("_to_volume", "volume").alias("volume"),
    )
    volume = F.col("volume") + F.coalesce("_shift", F.lit(0.0))
    ahead = save(placed.join(shifts, "community", "left").select("node", "k", "community", "previous", volume.alias("volume")))
    start = moved.select(F.col("node").alias("u"), F.col("community").alias("_from"), F.col("best").alias("_to"))
    other = ahead.select(F.col("node").alias("v"), F.col("community").alias("_new"), F.col("previous").alias("_old"))
    # both directions count; an arc between two moved nodes is met from either side
    sides = F.when(F.col("_new") == F.col("_old"), 2.0).otherwise(1.0)
    changed = (F.col("_to") == F.col("_new")).cast("double") - (F.col("_from") == F.col("_old")).cast("double")
    met = links.join(start, "u").join(other, "v").groupBy(F.col("v").alias("node"))
    near = save(met.agg(F.sum(sides * changed * F.col("w") / total).alias("part"), F.bool_or(F.col("_to") != F.col("_new")).alias("apart")))
    part = -F.col("_shift") * (2 * F.col("_before") + F.col("_shift")) / (total * total)
    zero = [F.lit(0).alias("moves"), F.lit(0).alias("waiting")]
    flags = [F.col("moves").cast("int").alias("moves"), (F.col("gains") & ~F.col("moves")).cast("int").alias("waiting")]
    counted = near.select("part", *zero).union(shifts.select(part.alias("part"), *zero)).union(rated.select(F.lit(0.0).alias("part"), *flags))
    change, moves, waiting = counted.agg(F.sum("part"), F.sum("moves"), F.sum("waiting")).first()
    return ahead.select("node", "k", "community", "volume"), near, float(change or 0.0), int(moves or 0), int(waiting or 0)


def _moves_apart(moved: DataFrame) -> DataFrame:
    """Keeps the moves that are the best of both communities they touch. No two of them share a community, so
    their gains add up exactly, and the best move of all is among them."""
    ends = moved.select("node", "better", F.explode(F.array("community", "best")).alias("end"))
    best = ends.groupBy("end").agg(F.min_by("node", F.struct(-F.col("better"), F.col("node"))).alias("node"))
    kept = best.groupBy("node").agg(F.count("*").alias("_ends")).where("_ends = 2").select("node")
    return moved.join(kept, "node", "left_semi")


def _connected_parts(links: DataFrame, state: DataFrame, total: float, seed: int, rounds: int = 4) -> tuple[DataFrame, bool]:
    """(node, k, community, volume, part), whether any part has grown: every community built anew from single nodes. In a
    round, nodes still alone that are drawn to move join the part of their own community with the best gain, among
    parts that do not move: those of several nodes, and nodes alone that were not drawn. A node joins a part that one
    of its links leads into and that nobody leaves, so parts are connected. Nodes that stay alone are parts."""
    a = state.select(F.col("node").alias("u"), F.col("community").alias("cu"))
    b = state.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    inner = save(links.join(a, "u").join(b, "v").where("cu = cv").select("u", "v", "w"))
    kept = ["node", "k", "community", "volume", "part"]
    parts, grown = state.withColumns({"part": F.col("node"), "single": F.lit(True), "part_volume": F.col("k")}), False
    for round_number in range(rounds):
        drawn = F.pmod(F.xxhash64(F.lit(seed + 500 + round_number), F.col("node")), F.lit(2)) == 0
        movers = parts.where(F.col("single") & drawn).select(F.col("node").alias("u"), "k")
        still = parts.where(~(F.col("single") & drawn)).select(F.col("node").alias("v"), "part", "part_volume")
        known = [F.first(c).alias(c) for c in ("k", "part_volume")]
        toward = inner.join(movers, "u").join(still, "v").groupBy("u", "part").agg(F.sum("w").alias("w"), *known)
        gain = F.col("w") - F.col("k") * F.col("part_volume") / total
        best = toward.withColumn("gain", gain).where("gain > 0").groupBy(F.col("u").alias("node"))
        best = best.agg(F.min_by("part", F.struct(-F.round("gain", 9), F.col("part"))).alias("_to"))
        joined = parts.join(best, "node", "left").select(*kept[:-1], F.coalesce("_to", "part").alias("part"), F.col("_to").isNotNull().alias("_moved"))
        joined = save(joined)
        grown = not joined.where("_moved").isEmpty() or grown
        members = joined.groupBy("part").agg((F.count("*") == 1).alias("single"), F.sum("k").alias("part_volume"))
        ahead = save(joined.join(members, "part").select(*kept, "single", "part_volume"))
        discard(joined, *([parts] if round_number else []))
        parts = ahead
    discard(inner)
    return parts.select(*kept), grown


def spectral_embedding(
    graph: Graph,
    *,
    dimensions: int = 16,
    weight: str = "edge_count",
    seed: int = 42,
    oversampling: int = 8,
    tolerance: float = 1e-3,
    max_power_rounds: int = 100,
) -> DataFrame:
    """(node_id, embedding_0..k-1): U * S of the rank-k truncated SVD of the weighted adjacency matrix.

    Randomised subspace iteration. The n x p blocks stay distributed as p double columns; a product
    with the matrix is one join and one aggregate, and the only thing that is written; Arrow batches are
    multiplied by p x p matrices on their way into the next product, and the driver only factors p x p
    Gram matrices. Rows that are all zero are left out of the blocks until the end. Rounds go on until none of the k singular
    values changes by more than ``tolerance`` of the largest; ``max_power_rounds`` is a safety limit that raises.
    """
    vertices = save(graph.vertices.select("node_id"))
    count = vertices.count()
    if count == 0:
        return vertices
    k = max(1, min(dimensions, count - 1))
    width = min(count, k + oversampling)
    columns = [f"x{i}" for i in range(width)]
    matrix = graph.edges.select("src", "dst", F.col(weight).cast("double").alias("w"))
    by_src, src_pieces = split_edges(matrix, "src", "dst")
    by_dst, dst_pieces = split_edges(matrix, "dst", "src")
    by_src, by_dst = pin_edges(by_src, "src"), pin_edges(by_dst, "dst")
    # stored, as every product asks for them
    src_pieces, dst_pieces = save(src_pieces), save(dst_pieces)

    def product(edges: DataFrame, pieces: DataFrame, block: DataFrame, read: str, write: str) -> DataFrame:
        hubs = pieces.select(F.col(read).alias("node_id"), "_pieces")
        sent = block.join(hubs, "node_id", "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))
        sent = spread_state(sent, "node_id").withColumnRenamed("node_id", read)
        return (
            edges.join(sent, [read, "_part"])
            .groupBy(F.col(write).alias("node_id"))
            .agg(*[F.expr(f"sum(w * {c})").alias(c) for c in columns])
        )

    schema = ", ".join(f"{c} double" for c in columns)
    id_type = vertices.schema["node_id"].dataType.simpleString()

    def gram(block: DataFrame) -> np.ndarray:
        def local(batches):
            # one width x width block per task
            total = np.zeros((width, width))
            for batch in batches:
                values = batch.to_numpy()
                total += values.T @ values
            yield pd.DataFrame(total, columns=columns).assign(i=np.arange(width))

        partial = block.select(*columns).mapInPandas(local, f"{schema}, i int")
        result = np.zeros((width, width))
        for row in partial.groupBy("i").agg(*[F.sum(c).alias(c) for c in columns]).collect():
            result[row["i"]] = [row[c] for c in columns]
        return result

    def combine(block: DataFrame, coefficients: np.ndarray, names: list[str]) -> DataFrame:
        def local(batches):
            for batch in batches:
                mixed = pd.DataFrame(batch[columns].to_numpy() @ coefficients, columns=names)
                mixed.insert(0, "node_id", batch["node_id"].to_numpy())
                yield mixed

        return block.mapInPandas(local, ", ".join([f"node_id {id_type}", *[f"{n} double" for n in names]]))

    def orthonormal(block: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """An orthonormal basis of the block's columns, and the block's k largest singular values."""
        values, vectors = np.linalg.eigh(gram(block))
        largest = np.sqrt(np.clip(values[::-1][:k], 0.0, None))
        keep = values > max(values.max(), 0.0) * 1e-12
        scale = np.where(keep, 1.0 / np.sqrt(np.where(keep, values, 1.0)), 0.0)
        return combine(block, vectors * scale, columns), largest

    def uniform(number: int):
        """In (0, 1], from the vertex and the number of the draw: independent of partitioning."""
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(number), F.col("node_id")), 11)
        return (bits.cast("double") + 1.0) / float(2**53)

    def normal(number: int):
        return F.sqrt(-2.0 * F.log(uniform(2 * number))) * F.cos(2.0 * np.pi * uniform(2 * number + 1))

    block = save(vertices.select("node_id", *[normal(i).alias(c) for i, c in enumerate(columns)]))
    # A x reads x at the edge target and adds up at its source; the transpose goes the other way
    sums = save(product(by_dst, dst_pieces, block, "dst", "src"))
    discard(block)
    basis, before = orthonormal(sums)
    for _ in range(max_power_rounds):
        across = save(product(by_src, src_pieces, basis, "src", "dst"))
        discard(sums)
        basis, _ = orthonormal(across)
        sums = save(product(by_dst, dst_pieces, basis, "dst", "src"))
        discard(across)
        basis, after = orthonormal(sums)
        settled = np.abs(after - before).max() <= tolerance * max(after.max(), 1e-300)
        before = after
        if settled:
            break
    else:
        raise RuntimeError(f"the spectral embedding has not settled in {max_power_rounds} rounds")
    # with Q orthonormal, Q^T A has the wanted singular values; its Gram matrix is p x p
    projected = save(product(by_src, src_pieces, basis, "src", "dst"))
    values, vectors = np.linalg.eigh(gram(projected))
    order = np.argsort(values)[::-1][:k]
    singular = np.sqrt(np.clip(values[order], 0.0, None))
    names = [f"embedding_{i}" for i in range(k)]
    turned = combine(basis, vectors[:, order] * singular, names)
    embedded = save(vertices.join(turned, "node_id", "left").fillna(0.0, subset=names))
    # the sign of a singular vector is free: make the entry of largest size positive
    strongest = embedded.agg(*[F.max_by(n, F.abs(F.col(n))).alias(n) for n in names]).first()
    signs = [-1.0 if (strongest[n] or 0.0) < 0 else 1.0 for n in names]
    return embedded.select("node_id", *[(F.col(n) * s).alias(n) for n, s in zip(names, signs)])
