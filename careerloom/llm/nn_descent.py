"""Approximate nearest neighbours by NN-descent.

Equal vectors are one node. Every node starts with neighbours from blocks of rows that random hyperplanes bring
together, then rounds of joins let each node introduce its neighbours, and the nodes that have it as a neighbour, to
each other, and the k nearest stay. Queries walk the graph: the nearest nodes found so far are opened, their neighbours
are joined in, until no node of the beam is unopened. Blocks and introductions have a fixed size whatever the degree.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do those whose length is
not the most common one. Of rows that repeat an id the least vector counts. With fewer nodes than neighbours wanted all
are found. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerloom.llm.common import stored

#: Neighbours kept per node, trees and block size of the start, neighbours introduced per kind, rounds at most.
NEIGHBOURS, TREES, BLOCK, INTRODUCED, MOST_ROUNDS = 32, 8, 192, 16, 12
#: Rounds end when fewer than this share of all neighbours changed; the walk makes up for the rest.
STILL = 0.15
#: Beam of a search, and nodes of the graph that searches start from.
BEAM, ENTRIES = 240, 128


def usable(rows: DataFrame, id_name: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec): one row per id, with the vectors that take part, in double precision."""
    vec = F.col(vector).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col(id_name).cast("long").alias("id"), vec.alias("vec")).where("id is not null and size(vec) > 0")
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0)).groupBy("id").agg(F.min("vec").alias("vec"))
    rows = stored(rows, "vectors")
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (common["d"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a small block."""
    norms = (x * x).sum(axis=1)
    return np.maximum(norms[:, None] + norms[None, :] - 2 * (x @ x.T), 0)


def _edges(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], ["u", "v", "d"])


def first_neighbours(nodes: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(u, v, d): for each tree, the nearest of each node within its block of rows in the order of hyperplane signs."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for tree in range(TREES):
                if not len(x):
                    continue
                planes = np.random.default_rng(seed * 1000 + tree).standard_normal((x.shape[1], 16))
                code = ((x @ planes) > 0) @ (1 << np.arange(15, -1, -1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree), pa.int64()), pa.array(code, pa.int64()), batch.column(0), batch.column(1)], ["tree", "code", "id", "vec"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in [*batches, None]:
            rest += [batch] if batch is not None else []
            rows = pa.Table.from_batches(rest).combine_chunks() if rest else None
            if rows is None:
                return
            last = batch is None
            for start in range(0, rows.num_rows if last else rows.num_rows // BLOCK * BLOCK, BLOCK):
                part = rows.slice(start, BLOCK).combine_chunks()
                ids, tree = part.column("id").to_numpy(), part.column("tree").to_numpy()
                x = _matrix(part.column("vec").combine_chunks() if isinstance(part.column("vec"), pa.ChunkedArray) else part.column("vec"))
                d = _distances(x)
                d[(tree[:, None] != tree[None, :]) | (ids[:, None] == ids[None, :])] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(d, near, axis=1)
                ok = np.isfinite(value)
                yield _edges(np.repeat(ids, near.shape[1])[ok.ravel()], ids[near][ok], value[ok])
            rest = rows.slice(rows.num_rows // BLOCK * BLOCK).to_batches()

    # so many partitions that each holds several full blocks, whatever the setting
    most = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, nodes.count() * TREES // (BLOCK * 4)))
    ranged = nodes.mapInArrow(coded, "tree long, code long, id long, vec array<double>")
    ranged = ranged.withColumn("tie", F.xxhash64("tree", "id")).repartitionByRange(parts, "tree", "code", "tie").sortWithinPartitions("tree", "code", "tie")
    return ranged.select("tree", "code", "id", "vec").mapInArrow(blocks, "u long, v long, d double")


def nearest_k(edges: DataFrame, k: int, *more: Column) -> DataFrame:
    """The ``k`` nearest distinct neighbours of each node."""
    once = edges.groupBy("u", "v").agg(F.min("d").alias("d"), *more)
    rank = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def introductions(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(u, v, d): pairs of neighbours of a common node that are nearer than what either has."""
    pick = F.row_number().over(Window.partitionBy("center", "fresh").orderBy(F.xxhash64("center", "member"), "member"))
    both = graph.select(F.col("u").alias("center"), F.col("v").alias("member"), "fresh").unionByName(
        graph.select(F.col("v").alias("center"), F.col("u").alias("member"), "fresh")
    )
    some = both.groupBy("center", "member").agg(F.max("fresh").alias("fresh")).withColumn("rank", pick).where(F.col("rank") <= INTRODUCED)
    worst = graph.groupBy("u").agg(F.max("d").alias("worst"), F.count(F.lit(1)).alias("n"))
    known = nodes.join(worst.withColumnRenamed("u", "id"), "id", "left").select(
        F.col("id").alias("member"), "vec", F.when(F.coalesce("n", F.lit(0)) < k, F.lit(float("inf"))).otherwise(F.col("worst")).alias("worst")
    )
    met = some.select("center", "member", "fresh").join(known, "member").repartition("center").sortWithinPartitions("center")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in [*batches, None]:
            rest += [batch] if batch is not None else []
            if not rest:
                return
            rows = pa.Table.from_batches(rest).combine_chunks()
            center = rows.column("center").to_numpy()
            edges = np.flatnonzero(np.append(True, np.diff(center) != 0)) if len(center) else np.empty(0, int)
            ends = np.append(edges[1:], len(center))
            if batch is not None and len(edges):  # the last group may go on
                edges, ends, cut = edges[:-1], ends[:-1], edges[-1]
            else:
                cut = len(center)
            member, fresh, worst = (rows.column(c).to_numpy() for c in ("member", "fresh", "worst"))
            vec = rows.column("vec").combine_chunks()
            x = _matrix(vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec)
            out = []
            for a, b in zip(edges.tolist(), ends.tolist()):
                d = _distances(x[a:b])
                new = fresh[a:b].astype(bool)
                useful = (d < worst[a:b, None]) & (new[:, None] | new[None, :])
                np.fill_diagonal(useful, False)
                i, j = np.nonzero(useful)
                out.append((member[a:b][i], member[a:b][j], d[i, j]))
            if out:
                yield _edges(*(np.concatenate(c) for c in zip(*out)))
            rest = rows.slice(cut).to_batches()

    return met.mapInArrow(run, "u long, v long, d double")


def build_graph(nodes: DataFrame, k: int = NEIGHBOURS, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(u, v, d): ``k`` near neighbours of each of ``nodes`` (id, vec)."""
    fresh = F.lit(1).alias("fresh")
    graph = stored(nearest_k(first_neighbours(nodes, k), k).select("u", "v", "d", fresh), "graph")
    for _ in range(rounds):
        met = introductions(graph, nodes, k).withColumn("old", F.lit(0))
        pool = graph.select("u", "v", "d", F.lit(1).alias("old")).unionByName(met)
        graph = stored(nearest_k(pool, k, F.max("old").alias("old")).select("u", "v", "d", (1 - F.col("old")).alias("fresh")), "graph")
        changed, edges = graph.agg(F.sum("fresh"), F.count(F.lit(1))).first()
        if not edges or changed < STILL * edges:
            break
    return graph.select("u", "v", "d")


def squared(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, a: s + a)


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query_id, node, d2): the beam of each of ``queries`` (query_id, vec) after a greedy walk of the graph.

    A query starts from the nearest of ENTRIES nodes, from all if there are no more, and, if its vector is itself a node,
    from there. A walk ends when its beam is opened: a node that left the beam is farther than all of it and stays out.
    """
    entries = nodes.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(ENTRIES).collect()
    ids, matrix = np.array([r["id"] for r in entries], np.int64), np.array([r["vec"] for r in entries])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(1))
            if not len(q) or not len(ids):
                continue
            d = ((q[:, None, :] - matrix[None]) ** 2).sum(axis=2)
            near = np.argsort(d, axis=1, kind="stable")[:, : 8 if len(ids) == ENTRIES else len(ids)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), near.shape[1])), pa.array(ids[near].ravel()), pa.array(np.take_along_axis(d, near, axis=1).ravel())], ["query_id", "node", "d2"]
            )

    asked = stored(queries.select("query_id", F.col("vec").alias("q")), "asked")
    found = queries.select("query_id", "vec").mapInArrow(start, "query_id long, node long, d2 double")
    own = asked.join(nodes, asked["q"] == nodes["vec"]).select("query_id", F.col("id").alias("node"), F.lit(0.0).alias("d2"))
    state = stored(found.unionByName(own).groupBy("query_id", "node").agg(F.min("d2").alias("d2")).withColumn("opened", F.lit(0)), "beam")
    links = graph.select(F.col("u").alias("node"), F.col("v").alias("next")).unionByName(graph.select(F.col("v").alias("node"), F.col("u").alias("next"))).distinct()
    links = stored(links, "links")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "node"))
    while not state.where("opened = 0").isEmpty():
        seen = state.withColumn("opened", F.lit(1))
        opening = state.where("opened = 0").select("query_id", "node").join(links, "node")
        opening = opening.select("query_id", F.col("next").alias("node"), F.lit(0).alias("opened"))
        reached = seen.select("query_id", "node", "opened").unionByName(opening).groupBy("query_id", "node").agg(F.max("opened").alias("opened"))
        reached = reached.where("opened = 0").join(nodes.withColumnRenamed("id", "node"), "node").join(asked, "query_id")
        pool = seen.unionByName(reached.select("query_id", "node", squared("q", "vec").alias("d2"), "opened"))
        state = stored(pool.withColumn("rank", best).where(F.col("rank") <= beam).drop("rank"), "beam")
    return state.select("query_id", "node", "d2")


def neighbours(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``."""
    vectors = usable(rows)
    classes = vectors.groupBy("vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes, "classes")
    nodes = stored(classes.select(F.col("node").alias("id"), "vec"), "nodes")
    graph = build_graph(nodes)
    queries = vectors.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vec")
    beams = search(queries, nodes, graph)
    # of equal vectors the k + 1 smallest ids can be in an answer
    rank = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    members = vectors.join(classes, "vec").select("node", "id").withColumn("rank", rank).where(F.col("rank") <= k + 1).select("node", "id")
    listed = beams.join(members, "node").where("id <> query_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "id"))
    return listed.withColumn("rank", order).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.sqrt("d2").alias("score")
    )
