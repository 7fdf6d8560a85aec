"""Exact top-k by inner product: best-first search in M-trees.

An inner product is no metric, so every vector x of a tree gets one more component, sqrt(M - |x|^2) with
M the largest squared norm of the tree, and a query gets 0 there. Then |q - x|^2 = |q|^2 + M - 2 q.x, and
the nearest vectors are those of the largest product.

Vectors are dealt to trees of about `TREE_ROWS` rows by a hash of their id, which no cluster or repeated
vector can skew. A tree has pages of entries: a routing vector, a covering radius around it, and the
distance to the parent's routing vector. A search takes the page with the best bound first. From the
distance d of the query to a page's routing vector, a child or entry at stored distance e from it (with
radius r) lies no nearer than |d - e| - r: what cannot beat the k-th result so far is skipped before its
own distance is computed. Searches stop when no page can hold a better result or a tie.

Queries go in blocks of at most about `BLOCK_ROWS`; each (tree, block) pair is one group, and its queries walk the
tree together: a page is met once, with the queries that it may still help. A query starts
from the k-th best score of a sample of `SAMPLE_ROWS` candidates, a valid lower bound for all trees.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; only
vectors of the query's length are compared; a repeated id counts once (its smallest vector); fewer
candidates than k give fewer rows; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.materialize import materialize

TREE_ROWS = 4096
BLOCK_ROWS = 2048
SAMPLE_ROWS = 1024
PAGE = 96
FAN_OUT = 12


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; through floating point only where every sum is exact."""
    most = max(1, int(np.abs(left).max(initial=0))) * max(1, int(np.abs(right).max(initial=0)))
    if most * left.shape[-1] < 1 << 53:
        return np.rint(left.astype(float) @ right.astype(float).T).astype(np.int64)
    return left @ right.T


class Tree:
    """Pages in arrays: `pages[i]` is (is leaf, children or rows, their parent distances, radii)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        square = (vectors.astype(float) ** 2).sum(axis=1)
        self.most = float(square.max())
        self.lifted = np.column_stack([vectors.astype(float), np.sqrt(np.maximum(self.most - square, 0))])
        self.pages: list = []
        self.routing: list[int] = []
        self.root = self._build(np.arange(len(ids)), int(np.argmin(ids)), np.random.default_rng(5))

    def _build(self, rows: np.ndarray, pivot: int, rng: np.random.Generator) -> int:
        """Page of these rows around the routing vector `pivot`."""
        apart = np.sqrt(((self.lifted[rows] - self.lifted[pivot]) ** 2).sum(axis=1))
        place = len(self.pages)
        self.pages.append(None)
        self.routing.append(pivot)
        if len(rows) <= PAGE:
            self.pages[place] = (True, rows, apart, None, None)
            return place
        chosen = rng.choice(rows, min(FAN_OUT, -(-len(rows) // PAGE) + 1), replace=False)
        gaps = ((self.lifted[rows][:, None, :] - self.lifted[chosen][None]) ** 2).sum(axis=2) if len(rows) <= 512 else (
            (self.lifted[rows] ** 2).sum(axis=1)[:, None] - 2 * self.lifted[rows] @ self.lifted[chosen].T + (self.lifted[chosen] ** 2).sum(axis=1)
        )
        near = gaps.argmin(axis=1)
        parts = [(rows[near == j], int(chosen[j])) for j in range(len(chosen)) if (near == j).any()]
        if len(parts) < 2 or max(len(p) for p, _ in parts) > 0.9 * len(rows):
            # equal (or nearly equal) vectors: even cuts by distance still give pages of bounded size
            order = rows[np.argsort(apart, kind="stable")]
            parts = [(cut, int(cut[len(cut) // 2])) for cut in np.array_split(order, min(FAN_OUT, -(-len(rows) // PAGE)))]
        children = [self._build(part, center, rng) for part, center in parts]
        centers = self.lifted[[center for _, center in parts]]
        radii = np.array([np.sqrt(((self.lifted[part] - c) ** 2).sum(axis=1)).max() for (part, _), c in zip(parts, centers, strict=True)])
        self.pages[place] = (False, np.array(children), np.sqrt(((centers - self.lifted[pivot]) ** 2).sum(axis=1)), radii, centers)
        return place

    def search(self, query: np.ndarray, own: int, k: int, least: float) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) of at least `least`, and how many distances were computed."""
        _, ids, scores, computed = self.search_block(query[None], np.array([own]), k, np.array([least]))
        return list(zip(scores.tolist(), ids.tolist(), strict=True)), computed

    def search_block(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Search of many queries in one walk: every page is met once, with the queries it may still help.

        Returns the row of the query, id and score of each result, a query's best first, and how many distances were
        computed. Bounds and limits are a query's own; the page that is nearest to any of its queries comes first.
        """
        square = (queries.astype(float) ** 2).sum(axis=1)
        base, slack = square + self.most, 0.5 + 1e-9 * (square + self.most)
        points = np.column_stack([queries.astype(float), np.zeros(len(queries))])
        far = lambda who, bound: np.sqrt(np.maximum(0.0, base[who] - 2 * (bound - slack[who])))  # noqa: E731  no result lies beyond
        bound, every = least.astype(float), np.arange(len(queries))
        limit = np.where(np.isfinite(bound), far(every, bound), np.inf)
        held = np.zeros((3, 0), np.int64)  # row of the query, score, id
        root = np.sqrt(((points - self.lifted[self.routing[self.root]]) ** 2).sum(axis=1))
        heap, computed = [(0.0, self.root, every, np.zeros(len(every)), root)], len(every)
        while heap:
            low, page, who, lows, apart = heapq.heappop(heap)
            if low > limit.max():
                break
            open_ = lows <= limit[who]
            who, apart = who[open_], apart[open_]
            if not len(who):
                continue
            leaf, children, stored, radii, centers = self.pages[page]
            if leaf:
                near = np.abs(apart[:, None] - stored) <= limit[who][:, None]
                some, rows = near.any(axis=1), near.any(axis=0)
                who, near, rows = who[some], near[some][:, rows], children[rows]
                if not len(who):
                    continue
                computed += int(near.sum())
                scores = products(queries[who], self.vectors[rows])
                at, place = np.nonzero(near & (scores >= bound[who][:, None]) & (self.ids[rows] != own[who][:, None]))
                if not len(at):
                    continue
                held = np.column_stack([held, np.stack([who[at], scores[at, place], self.ids[rows[place]]])])
                held = held[:, np.lexsort((held[2], -held[1], held[0]))]
                rank = np.arange(held.shape[1]) - np.searchsorted(held[0], held[0])
                held, rank = held[:, rank < k], rank[rank < k]
                full, worst = held[0, rank == k - 1], held[1, rank == k - 1]
                bound[full] = worst
                limit[full] = np.minimum(limit[full], far(full, worst))
                continue
            for child, gap, radius, center in zip(children.tolist(), stored, radii, centers, strict=True):
                near = np.abs(apart - gap) - radius <= limit[who]
                asked = who[near]
                computed += len(asked)
                gaps = np.sqrt(((points[asked] - center) ** 2).sum(axis=1))
                lows = np.maximum(gaps - radius, 0)
                left = lows <= limit[asked]
                if left.any():
                    heapq.heappush(heap, (float(lows[left].min()), child, asked[left], lows[left], gaps[left]))
        return held[0], held[2], held[1], computed


def usable(vectors: DataFrame, key: str, vector: str, whole: Column) -> DataFrame:
    """`id, vec` (array of long), one row an id, of the vectors that take part."""
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.col(key).isNotNull()
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(fine & finite).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(whole).alias("vec"))


def build_trees(vectors: DataFrame, rows: int = TREE_ROWS) -> tuple[DataFrame, int]:
    """`tree, dims, size, blob`: one row a tree, written to the shared folder; and the number of trees."""
    trees = max(1, -(-vectors.count() // rows))
    placed = vectors.withColumn("tree", F.pmod(F.xxhash64("id"), F.lit(trees)).cast("int")).withColumn("dims", F.size("vec"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        tree = Tree(group["id"].to_numpy(), np.stack(group["vec"].to_numpy()).astype(np.int64))
        made = {"tree": group["tree"].iloc[0], "dims": group["dims"].iloc[0], "size": len(group), "blob": pickle.dumps(tree, 5)}
        return pd.DataFrame([made])

    return materialize(placed.groupBy("tree", "dims").applyInPandas(build, "tree int, dims int, size int, blob binary")), trees


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k best of `vectors` (id, vec) for every row of `queries` (id, vec)."""
    trees, number = build_trees(vectors)
    sample = vectors.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(SAMPLE_ROWS).collect()
    ids = np.array([r["id"] for r in sample], dtype=np.int64)
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dims in {len(r["vec"]) for r in sample}:
        own = [i for i, r in enumerate(sample) if len(r["vec"]) == dims]
        by_size[dims] = ids[own], np.array([sample[i]["vec"] for i in own], dtype=np.int64)

    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    placed = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int")).withColumn("dims", F.size("vec"))
    asked = placed.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    shown = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(asking: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(asking) and len(tree):
            known: Tree = pickle.loads(tree["blob"].iloc[0])
            matrix, own = np.stack(asking["vec"].to_numpy()).astype(np.int64), asking["id"].to_numpy()
            some, rows = by_size.get(matrix.shape[1], (ids[:0], matrix[:0]))
            least = np.full(len(matrix), -np.inf)
            if len(some) > k:
                first = products(matrix, rows).astype(float)
                first[own[:, None] == some] = -np.inf
                least = np.partition(first, -k, axis=1)[:, -k]
            at, found, score, _ = known.search_block(matrix, own, k, least)
            out = {"query_id": own[at], "vec_id": found, "score": score}
        return pd.DataFrame(out).astype("int64")

    keys = ("tree", "block", "dims")
    found = asked.groupBy(*keys).cogroup(shown.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
