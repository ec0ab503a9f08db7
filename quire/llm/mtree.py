"""Exact top-k search by inner product with best-first search of M-trees, for blocks of queries at once."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import bounds, stored, tidied, whole_groups

#: Entries of a leaf page, and pages of an inner node.
PAGE = 128
FANOUT = 16
#: Vectors of one tree, and queries of one block; a task searches a group of trees for one block.
TREE_VECTORS = 8192
BLOCK_QUERIES = 2048
#: Groups that the trees are dealt to, and trees from which there are more groups.
TREE_GROUPS = 4
GROUP_TREES = 64
#: Candidates of a block that are held before its best are taken from them.
HELD = 1 << 18
#: Different lengths of vectors in a table.
MOST_LENGTHS = 1000


class Node(NamedTuple):
    """A page. Its pivot is one of its vectors; ``radius`` covers all below it. ``distances`` are those of its entries
    (vectors of a leaf, pivots of the children otherwise) from its own pivot: the stored parent distances."""

    pivot: np.ndarray
    radius: float
    distances: np.ndarray
    ids: np.ndarray | None
    vectors: np.ndarray  # of the leaf, or the children's pivots
    radii: np.ndarray | None
    children: list | None
    rows: np.ndarray | None  # which row of the table each entry of a leaf is


def _distances(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = a.astype(np.float64) - p
    return np.sqrt(np.einsum("nd,nd->n", d, d))


def _central(vectors: np.ndarray) -> int:
    return int(_distances(vectors, vectors.mean(axis=0)).argmin())


def _leaves(places: np.ndarray, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Halve by which of two distant vectors is nearer, until the halves fit a page; neighbours stay neighbours."""
    if len(places) <= PAGE:
        return [(places, vectors)]
    one = vectors[_distances(vectors, vectors[0]).argmax()]
    other = vectors[_distances(vectors, one).argmax()]
    order = np.argsort(_distances(vectors, one) - _distances(vectors, other), kind="stable")
    half = len(places) // 2
    return [*_leaves(places[order[:half]], vectors[order[:half]]), *_leaves(places[order[half:]], vectors[order[half:]])]


def build(ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """M-tree of at least one vector, loaded from the leaves up. Rows that share an id are told apart by ``rows``."""
    rows = ids if rows is None else rows
    level = []
    for places, some in _leaves(np.arange(len(ids)), vectors):
        pivot = some[_central(some)]
        d = _distances(some, pivot)
        order = np.argsort(d, kind="stable")
        level.append((Node(pivot, float(d.max()), d[order], ids[places[order]], some[order], None, None, rows[places[order]]), some))
    while len(level) > 1:
        above = []
        for lo in range(0, len(level), FANOUT):
            group = level[lo : lo + FANOUT]
            below = np.concatenate([v for _, v in group])
            pivots = np.stack([n.pivot for n, _ in group])
            pivot = pivots[_central(pivots)]
            node = Node(pivot, float(_distances(below, pivot).max()), _distances(pivots, pivot), None, pivots, np.array([n.radius for n, _ in group]), [n for n, _ in group], None)
            above.append((node, below))
        level = above
    return level[0][0]


def _products(vectors: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; in double precision where every partial sum is a whole number below 2 ** 53."""
    return vectors.astype(np.float64) @ query.astype(np.float64) if exact else (vectors.astype(object) * query.astype(object)).sum(axis=1)


def search(root: Node, query: np.ndarray, own: int, k: int, exact: bool) -> list[tuple[int, int]]:
    """The k best (score, id) for a query, ties to smaller ids, without the query's ``own`` row.

    Since q.o <= q.p + |q| d(o, p), the product with a pivot and the stored distance bound the product with an entry,
    and the covering radius bounds all below a node. Nodes are opened in the order of their bounds until none can
    reach the k-th score; in a leaf, only entries whose stored distance leaves a chance are computed.
    """
    length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
    slack = lambda bound: bound + 1e-9 * abs(bound) + 1e-6  # noqa: E731  against rounding of the bounds
    best: list[tuple[float, int]] = []  # min-heap of (score, -id)
    at_pivot = float(_products(root.pivot[None], query, exact)[0])
    turn, count = [(-slack(at_pivot + length * root.radius), 0, at_pivot, root)], 1
    while turn:
        bound, _, at_pivot, node = heapq.heappop(turn)
        least = best[0][0] if len(best) == k else -np.inf
        if -bound < least:
            break
        reach = at_pivot + length * node.distances
        if node.children is None:
            chance = slice(int(np.searchsorted(reach, least - 1e-9 * abs(least) - 1e-6)), None) if least > -np.inf else slice(None)  # distances ascend
            scores = _products(node.vectors[chance], query, exact)
            ids, rows = node.ids[chance], node.rows[chance]
            good = np.flatnonzero(scores >= least) if least > -np.inf else np.arange(len(scores))
            if len(good) > k:
                good = good[np.lexsort((ids[good], -scores[good]))[: k + 1]]
            for i in good.tolist():
                if rows[i] != own:
                    entry = (scores[i] if not exact else float(scores[i]), -int(ids[i]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
        else:
            chance = np.flatnonzero(reach + length * node.radii >= least - 1e-9 * abs(least) - 1e-6) if least > -np.inf else np.arange(len(node.children))
            at = _products(node.vectors[chance], query, exact)
            for i, p in zip(chance.tolist(), at.tolist(), strict=True):
                upper = slack(float(p) + length * node.radii[i])
                if upper >= least:
                    heapq.heappush(turn, (-upper, count, float(p), node.children[i]))
                    count += 1
    return [(int(s), -i) for s, i in best]


class Best:
    """The k best (score, id) of every query of a block; ``least`` and ``last`` are those a candidate must beat."""

    def __init__(self, queries: int, k: int):
        self.k, self.held, self.waiting = k, 0, []
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.least, self.last = self.scores[:, -1], self.ids[:, -1]

    def offer(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((who, scores.astype(np.float64), ids))
        self.held += len(who)
        if self.held >= HELD:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        asked = np.unique(np.concatenate([w for w, _, _ in self.waiting]))
        who = np.concatenate([np.repeat(asked, self.k), *[w for w, _, _ in self.waiting]])
        scores = np.concatenate([self.scores[asked].ravel(), *[s for _, s, _ in self.waiting]])
        ids = np.concatenate([self.ids[asked].ravel(), *[i for _, _, i in self.waiting]])
        order = np.lexsort((ids, -scores, who))
        edges = bounds(who[order])
        first = order[(edges[:-1, None] + np.arange(self.k)).ravel()]  # each has k at least, those it had
        self.scores[asked], self.ids[asked] = scores[first].reshape(-1, self.k), ids[first].reshape(-1, self.k)
        self.held, self.waiting = 0, []


def _scan(leaf: Node, who: np.ndarray, at: np.ndarray, queries: np.ndarray, lengths: np.ndarray, own: np.ndarray, best: Best) -> None:
    """Offer the entries of a leaf that may be among the best of the queries ``who``, whose products with its pivot are ``at``."""
    least, size = best.least[who], lengths[who]
    needed = np.divide(least - 1e-9 * np.abs(least) - 1e-6 - at, size, out=np.full(len(who), -np.inf), where=(size > 0) & (least > -np.inf))
    chance = slice(int(np.searchsorted(leaf.distances, needed.min() * (1 - 1e-9) - 1e-9)), None)  # distances ascend
    scores = queries[who] @ leaf.vectors[chance].T.astype(queries.dtype)
    fresh = np.flatnonzero(least == -np.inf)
    if len(fresh) and scores.shape[1] > best.k:  # one more than k, as the query itself may be among them
        least[fresh] = np.partition(scores[fresh], -best.k - 1, axis=1)[:, -best.k - 1]
    i, j = np.nonzero(scores >= least[:, None])
    who, scores, ids, rows = who[i], scores[i, j], leaf.ids[chance][j], leaf.rows[chance][j]
    better = (rows != own[who]) & ((scores > best.least[who]) | (ids < best.last[who]))
    if better.any():
        best.offer(who[better], scores[better], ids[better])


def search_block(root: Node, queries: np.ndarray, own: np.ndarray, best: Best) -> None:
    """``search`` for the rows of ``queries`` (real numbers in which all sums are exact), going on from their ``best``.

    The queries go down together, each only where its bound reaches its k-th score so far. Each first opens the leaf with its highest
    bound, which raises that score; then the leaves are opened for the queries that they may still serve.
    """
    lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    bound = lambda at, size, reach: (b := at + size * reach) + 1e-9 * np.abs(b) + 1e-6  # noqa: E731  against rounding
    everyone = np.arange(len(queries))
    turn, leaves = [(root, everyone, (queries @ root.pivot.astype(queries.dtype)).astype(np.float64))], []
    while turn:
        node, who, at = turn.pop()
        upper = bound(at, lengths[who], node.radius)
        alive = upper >= best.least[who]
        who, at, upper = who[alive], at[alive], upper[alive]
        if not len(who):
            continue
        if node.children is None:
            leaves.append((node, who, at, upper))
            continue
        products = (queries[who] @ node.vectors.T.astype(queries.dtype)).astype(np.float64)
        for i, child in enumerate(node.children):
            near = bound(at, lengths[who], node.distances[i] + node.radii[i]) >= best.least[who]
            turn.append((child, who[near], products[near, i]))
    highest, first = np.full(len(queries), -np.inf), np.full(len(queries), -1)
    for n, (_, who, _, upper) in enumerate(leaves):
        higher = upper > highest[who]
        highest[who[higher]], first[who[higher]] = upper[higher], n
    for later in (False, True):
        for n, (leaf, who, at, upper) in enumerate(leaves):
            now = (first[who] != n) & (upper >= best.least[who]) if later else first[who] == n
            if now.any():
                _scan(leaf, who[now], at[now], queries, lengths, own, best)
        best.settle()


def _matrix(table: pa.Table, lo: int, hi: int, column: str = "_x") -> np.ndarray:
    """Vectors of equal length as whole numbers of as few bytes as hold them."""
    values = table.column(column).slice(lo, hi - lo).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
    low, high = values.min(), values.max()
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["_d", "_shard"]):
        d, shard = table.column("_d").to_numpy(), table.column("_shard").to_numpy()
        edges = bounds(d, shard)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            root = build(table.column("id").slice(lo, hi - lo).to_numpy(), _matrix(table, lo, hi), table.column("_row").slice(lo, hi - lo).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(d[lo : lo + 1]), pa.array(shard[lo : lo + 1]), pa.array([pickle.dumps(root, 5)], pa.binary())], ["_d", "_shard", "_tree"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["_d", "_block"]):
        d, block = table.column("_d").to_numpy(), table.column("_block").to_numpy()
        edges = bounds(d, block)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            held = pickle.dumps((table.column("id").slice(lo, hi - lo).to_numpy(), table.column("_row").slice(lo, hi - lo).to_numpy(), _matrix(table, lo, hi)), 5)
            yield pa.RecordBatch.from_arrays([pa.array(d[lo : lo + 1]), pa.array(block[lo : lo + 1]), pa.array([held], pa.binary())], ["_d", "_block", "_queries"])


def _found(query: np.ndarray, asked: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (query, asked, ids, scores)], ["query_id", "_asked", "vec_id", "score"])


def _searched(k: int):
    """The best of each block of queries among the trees that follow each other for it."""

    def taken(ids: np.ndarray, rows: np.ndarray, best: Best) -> pa.RecordBatch:
        i, j = np.nonzero(best.scores > -np.inf)
        return _found(ids[i], rows[i], best.ids[i, j], best.scores[i, j].astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None
        for batch in batches:
            for d, number, tree, queries in zip(*[batch.column(c) for c in ("_d", "_block", "_tree", "_queries")], strict=True):
                if block != (d.as_py(), number.as_py()):
                    if best is not None:
                        yield taken(ids, rows, best)
                    block = (d.as_py(), number.as_py())
                    ids, rows, vectors = pickle.loads(queries.as_py())
                    best, largest = Best(len(ids), k), float(np.abs(vectors.astype(np.float64)).max())
                root = pickle.loads(tree.as_py())
                most = largest * (float(np.abs(root.pivot.astype(np.float64)).max()) + root.radius) * vectors.shape[1]
                if most < 2**52:  # every partial sum is a whole number that the type holds
                    search_block(root, vectors.astype(np.float32 if most < 2**23 else np.float64), rows, best)
                    continue
                for q, row, v in zip(ids, rows, vectors, strict=True):
                    found = search(root, v, int(row), k, False)
                    yield _found([int(q)] * len(found), [int(row)] * len(found), [i for _, i in found], [s for s, _ in found])
        if best is not None:
            yield taken(ids, rows, best)

    return tidied(run)


def top_k(rows: DataFrame, is_query, k: int = 20, id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best rows for every row that ``is_query`` selects.

    Components become floor(scale * x); the score is the integer inner product, ties go to the smaller id, and a row
    never finds itself. Vectors that are null, empty or hold null or non-finite components, and null ids, take
    no part; vectors are compared with those of their own length. Every row has a number of its own, so rows that
    share an id find each other, and each query row has its own ``rank``.
    Vectors are dealt to trees of about ``TREE_VECTORS`` and queries to blocks. Every block meets every group of trees in a task that
    fetches both where they lie, so neither is copied or broadcast for it; only its k best per query are shuffled.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: F.coalesce(v.between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    sound = F.col(id).isNotNull() & F.coalesce((F.size(vector) > 0) & finite, F.lit(False))
    whole = F.transform(F.col(vector), lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    taken = stored(rows.where(sound).select(F.col(id).cast("long").alias("id"), F.monotonically_increasing_id().alias("_row"), whole.alias("_x"), F.size(vector).alias("_d"), is_query.alias("_query")), "whole")
    totals = taken.groupBy("_d").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_query"), 1)).alias("q")).limit(MOST_LENGTHS + 1).collect()
    if len(totals) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} lengths of vectors")
    sizes = {r["_d"]: (-(-r["n"] // TREE_VECTORS), max(1, -(-r["q"] // BLOCK_QUERIES))) for r in totals} or {0: (1, 1)}
    shards, blocks = (F.create_map(*[F.lit(v) for d, s in sizes.items() for v in (d, s[k])])[F.col("_d")] for k in (0, 1))
    dealt = taken.withColumn("_shard", F.pmod(F.xxhash64("_row"), shards).cast("int")).select("_d", "_shard", "id", "_row", "_x")
    trees = stored(dealt.repartition("_d", "_shard").sortWithinPartitions("_d", "_shard", "id", "_row").mapInArrow(_trees, "_d int, _shard int, _tree binary"), "trees")
    asked = taken.where("_query").withColumn("_block", F.pmod(F.xxhash64("_row", F.lit(3)), blocks).cast("int")).select("_d", "_block", "id", "_row", "_x")
    queries = stored(asked.repartition("_d", "_block").sortWithinPartitions("_d", "_block", "id", "_row").mapInArrow(_blocks, "_d int, _block int, _queries binary"), "queries")
    most = [max(s[k] for s in sizes.values()) for k in (0, 1)]
    groups = min(most[0], max(TREE_GROUPS, -(-most[0] // GROUP_TREES)))
    grid = trees.repartitionById(groups, F.col("_shard") % groups).withColumnRenamed("_d", "_length").drop("_shard")
    asking = queries.repartitionById(most[1], F.col("_block")).hint("shuffle_replicate_nl")
    found = asking.join(grid, F.col("_d") == F.col("_length")).select("_d", "_block", "_tree", "_queries").mapInArrow(_searched(k), "query_id long, _asked long, vec_id long, score long")
    order = Window.partitionBy("_asked").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
