"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.llm.common import Columns, arrow_map, written

#: Vectors whose sorted lists are built and searched together, and queries that search them together.
#: Each block of vectors is sent to each block of queries, so the larger that is, the less is shuffled.
BLOCK, QUERIES = 4096, 1024
#: Blocks of vectors that one task passes for one block of queries.
SPAN = 8


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector is null or has a null or non-finite one."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class SortedLists:
    """The vectors of a block with a list for each dimension, sorted by component.

    A query walks a list from the end its own component points to: from the top if it is positive, from the
    bottom if negative; a zero adds nothing wherever it is, so that list isn't walked. seen_by(depth) is, for
    all queries at once, which vectors stand within the first `depth` places of a list that the query walks,
    and the bound: no vector that isn't among them can score more.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, 0)
        n, d = x.shape
        self.place = np.empty((n, d), np.int32)  # from the bottom
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.int32)[:, None], 0)

    def seen_by(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.x)
        if depth >= n:
            return np.ones((len(q), n), bool), np.full(len(q), -np.inf)
        top, bottom = (self.place >= n - depth).astype(np.float32), (self.place < depth).astype(np.float32)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        seen = (np.sign(up).astype(np.float32) @ top.T - np.sign(down).astype(np.float32) @ bottom.T) > 0
        bound = up @ self.sorted[n - 1 - depth] + down @ self.sorted[depth]
        return seen, bound


class TopK:
    """The k best (score, id) for each query of a block; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.scores, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def search(self, lists: SortedLists) -> int:
        """The threshold algorithm for all queries together; gives the number of scores computed.

        In each round every query still at work goes deeper into its lists, and all vectors seen are scored. It
        stops when its kth best score is above the bound on the unseen; at equality an unseen vector with a smaller
        id might still come first, so it goes on.
        """
        n, work, scored = len(lists.x), np.arange(len(self.ids)), 0
        depth, first = 1, True
        kept_scores, kept_ids = self.scores.copy(), self.found.copy()
        while len(work):
            if first:  # with depth 0 nothing is seen; the bound is that of the whole block
                q, bound = self.q[work], np.maximum(self.q[work], 0) @ lists.sorted[-1] + np.minimum(self.q[work], 0) @ lists.sorted[0]
            else:
                q = self.q[work]
                seen, bound = lists.seen_by(q, depth)
                columns = np.flatnonzero(seen.any(0))
                scores = q @ lists.x[columns].T
                scores[~seen[:, columns] | (lists.ids[columns][None, :] == self.ids[work][:, None])] = -np.inf
                scored += int(seen.sum())
                self._merge(work, scores, lists.ids[columns], kept_scores[work], kept_ids[work])
                depth *= 16
            work = work[(self.scores[work, -1] <= bound) & (bound > -np.inf)]
            if first:
                first, depth = False, max(1, n // 64)
            elif depth // 16 >= n:
                break
        return scored

    def _merge(self, work: np.ndarray, scores: np.ndarray, ids: np.ndarray, old_scores: np.ndarray, old_ids: np.ndarray) -> None:
        """Keep the k best of what came from earlier blocks and of what is seen in this one."""
        k = self.k
        if scores.shape[1] > 4 * k:  # every score from the kth best on, so that ties are whole
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
            rows, columns = np.nonzero(scores >= np.maximum(least, old_scores[:, -1])[:, None])
        else:
            rows, columns = np.nonzero(scores > -np.inf)
        ok = scores[rows, columns] > -np.inf
        rows, columns = rows[ok], columns[ok]
        all_rows = np.concatenate([rows, np.repeat(np.arange(len(work)), k)])
        all_scores = np.concatenate([scores[rows, columns], old_scores.ravel()])
        all_ids = np.concatenate([ids[columns], old_ids.ravel()])
        order = np.lexsort((all_ids, -all_scores, all_rows))
        r, s, i = all_rows[order], all_scores[order], all_ids[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        best = place < k
        self.scores[work[r[best]], place[best]], self.found[work[r[best]], place[best]] = s[best], i[best]


def _packed(batches: Iterator[Columns]) -> Iterator[Columns]:
    """Blocks of vectors as integers in bytes, of the least `width` that holds them. Scores are summed as doubles, exact below
    2**53; larger components are refused."""
    for b in batches:
        x = [np.array(v, np.int64).reshape(len(v), -1) for v in b["v"]]
        for m in x:
            if m.size and float(np.abs(m).max()) ** 2 * m.shape[1] >= 2**53:
                raise ValueError("components too large for exact scores")
        x = [m.astype(next(t for t in (np.int16, np.int32, np.int64) if not m.size or max(m.max(), -m.min()) <= np.iinfo(t).max)) for m in x]
        yield {k: b[k] for k in ("dim", "asks", "n")} | {"width": [m.itemsize for m in x], "ids": [np.array(i, np.int64).tobytes() for i in b["id"]], "x": [m.tobytes() for m in x]}


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """For each query row the k rows of highest integer inner product of floor(scale * x): (query_id, rank from 1, id,
    score). Ties go to the smaller id; a query's own row is no candidate; all candidates, if there are fewer than k.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part; vectors
    of different lengths are never compared; rows repeated under one id with equal vectors count once. An
    empty table gives an empty result; other columns are not read.

    The quantised vectors are written to the shared folder with a block number (a hash of the id modulo the
    number of blocks, so blocks are even whatever the ids are). Each block of queries is dealt to SPAN blocks of
    vectors at a time: a task streams them, sorts each block's lists and runs the threshold algorithm with the kth best
    score so far, holding one block at a time; the k best of each span are then merged. Nothing is collected or broadcast.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # a row holds a block
    own = vectors.select(vectors[id_col].cast("long").alias("id"), quantised(vectors[vector_col], scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = own.where(F.col("v").isNotNull() & F.col("id").isNotNull()).dropDuplicates(["id", "v"])
    rows = written(rows.withColumn("dim", F.size("v")), "topk")
    sizes = {(r["dim"], r["is_query"]): r["count"] for r in rows.groupBy("dim", "is_query").count().collect()}
    dims = sorted({d for d, _ in sizes})
    blocks = {d: -(-sum(n for (e, _), n in sizes.items() if e == d) // BLOCK) for d in dims}
    query_blocks = {d: -(-sizes.get((d, True), 0) // QUERIES) for d in dims}
    if not any(query_blocks.values()):
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")

    def of(counts: dict[int, int], least: int = 1) -> Column:
        out = F.lit(1)
        for d, n in counts.items():
            out = F.when(F.col("dim") == d, F.lit(max(n, least))).otherwise(out)
        return out

    place = F.xxhash64("id", F.lit(7))
    placed = rows.withColumn("block", F.pmod(place, of(blocks)).cast("int"))
    asked = placed.where("is_query").withColumn("q", F.pmod(F.xxhash64("id", F.lit(11)), of(query_blocks)).cast("int"))
    # each block becomes one row of packed numbers before it is dealt out: vectors to the blocks of queries of
    # their dimension, queries to the spans of blocks of vectors
    kinds = placed.select("dim", F.col("block").alias("n"), F.lit(False).alias("asks"), "id", "v").unionByName(asked.select("dim", F.col("q").alias("n"), F.lit(True).alias("asks"), "id", "v"))
    grouped = kinds.where(of(query_blocks, 0) >= 1).groupBy("dim", "asks", "n").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows"))
    packed = arrow_map(grouped.select("dim", "asks", "n", "rows.id", "rows.v"), _packed, "dim int, asks boolean, n int, width int, ids binary, x binary")
    to = F.when(F.col("asks"), F.floor((of(blocks) - 1) / SPAN)).otherwise(of(query_blocks) - 1).cast("int")
    dealt = packed.withColumn("other", F.explode(F.sequence(F.lit(0), to)))
    work = dealt.select(
        "dim",
        F.when(F.col("asks"), F.col("n")).otherwise(F.col("other")).alias("q"),
        F.when(F.col("asks"), F.col("other")).otherwise(F.floor(F.col("n") / SPAN).cast("int")).alias("span"),
        F.when(F.col("asks"), F.lit(-1)).otherwise(F.col("n")).alias("block"),
        "width",
        "ids",
        "x",
    )
    work = work.repartition(F.col("dim"), F.col("q"), F.col("span")).sortWithinPartitions("dim", "q", "span", "block")

    def search(batches: Iterator[Columns]) -> Iterator[Columns]:
        key, best = None, None

        def out() -> Columns:
            at, place = np.nonzero(best.scores > -np.inf)
            return {"query_id": best.ids[at], "vec": best.found[at, place], "score": best.scores[at, place].astype(np.int64)}

        for b in batches:
            for dim, q, span, block, width, ids, x in zip(*(b[c] for c in ("dim", "q", "span", "block", "width", "ids", "x")), strict=True):
                ids = np.frombuffer(ids, np.int64)
                x = np.frombuffer(x, f"i{width}").reshape(len(ids), dim).astype(np.float64)
                if block < 0:
                    if best is not None:
                        yield out()
                    key, best = (dim, q, span), TopK(ids, x, k)
                elif best is not None and key == (dim, q, span):
                    best.search(SortedLists(ids, x))
        if best is not None:
            yield out()

    found = arrow_map(work, search, "query_id long, vec long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec").alias(id_col), "score")
