"""Exact top-k search by inner product: elimination with a table of pivot distances.

A few rows are pivots. The distances of every row to all pivots are computed
once and kept beside the rows: the pivot table. By the triangle inequality the
distance of a query q and a row x is at least |d(q, p) - d(x, p)| for every
pivot p; the largest of these is the bound. As 2 q.x = |q|^2 + |x|^2 - d(q, x)^2,
a lower bound of the distance is an upper bound of the score.

Rows lie in blocks, by nearest pivot and the distance to it, and a block knows
the range of its distances to each pivot, which bounds all its rows at once.
Queries are taken in blocks too:

1. Each block of queries is held against the blocks of the best bounds; that
   gives each query its first k scores.
2. Of all other blocks those remain whose bound reaches the smallest k-th score
   of a query block. In a block, a query goes through the rows in the order of
   their bounds and stops where the next bound is below its k-th score.

Scores are whole numbers, bounds are rounded up, and a row whose bound equals
the k-th score is evaluated, so ties are settled by id as if all rows had been
scored. What is copied to the blocks of rows are blocks of queries, never more
than ``QUERY_BLOCK`` queries each; a task holds one pair of blocks.

Pivots are chosen far apart among ``PIVOT_SAMPLE`` rows; they steer how much work
is saved, never the result.

Defined cases: those of ``vectors``; a row is no candidate of itself, but rows
of equal id are candidates of each other; equal scores go by the smaller id,
null ids last, then by row; without queries or rows the result is empty; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm.tables import materialize, read_table
from innsight.llm.vectors import (
    dimensions,
    exact_matrix,
    id_arrays,
    in_blocks,
    integer_vectors,
    packed_blocks,
    vector_matrix,
)

TOP_K = 20
SCALE = 64
QUERY_STEP = 20  # ids divisible by it are queries
PIVOTS = 32
PIVOT_SAMPLE = 1_000  # rows among which the pivots are chosen
ROW_BLOCK = 4_096
QUERY_BLOCK = 256
FIRST_BLOCKS = 2  # blocks of rows that give a query its first scores
ROWS_AT_ONCE = 512  # rows scored between two looks at the bound

BLOCK_SCHEMA = (
    "n int, tags binary, ids binary, has_id binary, vecs binary, dists binary, norms binary,"
    " low array<double>, high array<double>, most double"
)
FOUND_SCHEMA = "q long, pos int, query_tag long, query_id long, tag long, id long, score long"


def choose_pivots(vectors: DataFrame, width: int, pivots: int, sample: int) -> np.ndarray:
    """Rows far apart: each is the one farthest from those before it."""
    rows = vectors.orderBy(F.xxhash64("vec"), "tag").limit(sample).select("vec").toArrow()["vec"].combine_chunks()
    points = vector_matrix(rows, width).astype(np.float64)
    if not len(points):
        return points
    chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < pivots and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``dist`` (to each pivot), ``norm`` (squared length), ``cell`` (nearest pivot), ``near``."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = vector_matrix(batch.column("vec"), width).astype(np.float64)
            norm = (matrix * matrix).sum(axis=1)
            dist = np.stack([np.sqrt(((matrix - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, dist.size + 1, dist.shape[1], dtype=np.int32)), pa.array(dist.ravel())
            )
            cell = dist.argmin(axis=1) if len(dist) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "tag": batch.column("tag"),
                    "id": batch.column("id"),
                    "vec": batch.column("vec"),
                    "dist": lists,
                    "norm": pa.array(norm),
                    "cell": pa.array(cell.astype(np.int32)),
                    "near": pa.array(dist.min(axis=1) if len(dist) else np.zeros(0)),
                }
            )

    schema = "tag long, id long, vec array<int>, dist array<double>, norm double, cell int, near double"
    return materialize(vectors.select("tag", "id", "vec").mapInArrow(run, schema), "pivot-table")


def _blocks(table: DataFrame, rows: int, width: int, label: str) -> DataFrame:
    def pack(items: dict) -> dict:
        ids, there = id_arrays(items["id"])
        dist = vector_values(items["dist"])
        norm = items["norm"].to_numpy()
        return {
            "n": np.int32(len(ids)),
            "tags": items["tag"].to_numpy().astype(np.int64).tobytes(),
            "ids": ids.tobytes(),
            "has_id": there.tobytes(),
            "vecs": vector_matrix(items["vec"], width).tobytes(),
            "dists": dist.tobytes(),
            "norms": norm.tobytes(),
            "low": dist.min(axis=0).tolist(),
            "high": dist.max(axis=0).tolist(),
            "most": float(norm.max()),
        }

    placed = in_blocks(table, ["cell", "near", "tag"], rows, f"{label}-order")
    return packed_blocks(placed, ["tag", "id", "vec", "dist", "norm"], pack, BLOCK_SCHEMA, label)


def vector_values(lists: pa.Array) -> np.ndarray:
    """Rows of a list array whose lists are of equal length."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def block_bound() -> Column:
    """Largest score that a row of block (low, high, most) can have with a query of block (q_low, q_high, q_most)."""
    gap = lambda i: F.greatest(
        F.get("low", i) - F.get("q_high", i), F.get("q_low", i) - F.get("high", i), F.lit(0.0)
    )
    apart = F.array_max(F.transform(F.sequence(F.lit(0), F.size("low") - 1), gap))
    return (F.col("most") + F.col("q_most") - apart * apart * (1 - 1e-9)) / 2 + 1


def _search(pairs: DataFrame, queries: DataFrame, rows: DataFrame, k: int, width: int) -> DataFrame:
    """The k best rows of each pair (q, block) for each query of q that reach the query's ``least`` score.

    ``queries`` may hold ``least``, a score per query below which none is wanted.
    """
    names = ["n", "tags", "ids", "has_id", "vecs", "dists", "norms"]
    asked = queries.select("q", "least", *[F.col(c).alias(f"q_{c}") for c in names])
    work = pairs.join(asked, "q").join(rows.select("block", *names), "block").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield best_of_block(row, k, width)

    return work.mapInArrow(run, FOUND_SCHEMA)


def best_of_block(row: dict, k: int, width: int) -> pa.RecordBatch:
    """The k best rows of a block for each query of a block of queries, by bounds and exact scores."""

    def part(prefix: str) -> tuple[np.ndarray, ...]:
        get = lambda name, kind: np.frombuffer(row[prefix + name], dtype=kind)
        n = row[prefix + "n"]
        return (
            get("tags", np.int64),
            get("ids", np.int64),
            get("has_id", bool),
            get("vecs", np.int32).reshape(n, width),
            get("dists", np.float64).reshape(n, -1),
            get("norms", np.float64),
        )

    q_tags, q_ids, _, q_vecs, q_dists, q_norms = part("q_")
    tags, ids, there, vecs, dists, norms = part("")
    exact_q, exact = exact_matrix(q_vecs, vecs)
    by_pivot = np.ascontiguousarray(dists.T)
    least = np.full(len(q_tags), -np.inf)
    if row["least"] is not None:
        least = np.array([-np.inf if x is None else x for x in row["least"]], dtype=np.float64)
    places, found, scores = [], [], []
    apart, gap = np.empty(len(tags)), np.empty(len(tags))
    for i in range(len(q_tags)):
        apart.fill(0.0)
        for p in range(len(by_pivot)):
            np.subtract(by_pivot[p], q_dists[i, p], out=gap)
            np.abs(gap, out=gap)
            np.maximum(apart, gap, out=apart)
        np.multiply(apart, apart, out=apart)
        bound = np.floor((norms + q_norms[i] - apart * (1 - 1e-9)) / 2 + 1)
        open_rows = np.flatnonzero((bound >= least[i]) & (tags != q_tags[i]))
        order = open_rows[np.argsort(-bound[open_rows], kind="stable")]
        best, best_scores, kth = order[:0], np.zeros(0, dtype=np.int64), least[i]
        for start in range(0, len(order), ROWS_AT_ONCE):
            if bound[order[start]] < kth:
                break
            some = order[start : start + ROWS_AT_ONCE]
            values = (exact[some] @ exact_q[i]).astype(np.int64)
            kept = values >= kth
            best = np.concatenate([best, some[kept]])
            best_scores = np.concatenate([best_scores, values[kept]])
            if len(best) > k:
                top = np.lexsort((tags[best], ids[best], ~there[best], -best_scores))[:k]
                best, best_scores = best[top], best_scores[top]
            if len(best) == k:
                kth = max(kth, float(best_scores.min()))
        places.append(np.full(len(best), i, dtype=np.int32))
        found.append(best)
        scores.append(best_scores)
    at = np.concatenate(places) if places else np.zeros(0, dtype=np.int32)
    rows = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_pydict(
        {
            "q": pa.array(np.full(len(at), row["q"], dtype=np.int64)),
            "pos": pa.array(at),
            "query_tag": pa.array(q_tags[at]),
            "query_id": pa.array(q_ids[at]),
            "tag": pa.array(tags[rows]),
            "id": pa.array(ids[rows], mask=~there[rows]),
            "score": pa.array(np.concatenate(scores) if scores else np.zeros(0, dtype=np.int64)),
        }
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_tag").orderBy(F.desc("score"), F.asc_nulls_last("id"), "tag")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_tables(
    df: DataFrame, id_col: str, vector_col: str, query_step: int, scale: int, pivots: int,
    row_block: int, query_block: int,
) -> tuple[DataFrame, DataFrame, DataFrame, int] | None:
    """(pairs with their bound, queries, rows, width): blocks of queries, of all rows, and each pair of them."""
    vectors = integer_vectors(df, id_col, vector_col, scale)
    width = dimensions(vectors)
    chosen = choose_pivots(vectors, width, pivots, PIVOT_SAMPLE)
    if not len(chosen):
        return None
    table = pivot_table(vectors, chosen)
    rows = _blocks(table, row_block, width, "row-blocks")
    queries = _blocks(table.filter(F.col("id") % query_step == 0), query_block, width, "query-blocks")
    queries = queries.withColumnRenamed("block", "q")
    blocks = queries.count()
    if not blocks:
        return None
    summary = queries.select("q", *[F.col(c).alias(f"q_{c}") for c in ("low", "high", "most")])
    pairs = (
        rows.select("block", "low", "high", "most", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"))
        .withColumn("q", F.col("q").cast("long"))
        .join(summary, "q")
        .select("q", "block", block_bound().alias("bound"))
    )
    return materialize(pairs, "block-pairs"), queries, rows, width


def top_k_inner_product(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_step: int = QUERY_STEP,
    k: int = TOP_K,
    scale: int = SCALE,
    pivots: int = PIVOTS,
    row_block: int = ROW_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows of highest score for every row whose id is divisible by ``query_step``."""
    tables = search_tables(df, id_col, vector_col, query_step, scale, pivots, row_block, query_block)
    if tables is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    pairs, queries, rows, width = tables
    turn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
    first_pairs = pairs.withColumn("turn", turn).filter(F.col("turn") <= FIRST_BLOCKS).select("q", "block")
    nothing = F.lit(None).cast("array<long>")
    first = materialize(
        _ranked(_search(first_pairs, queries.withColumn("least", nothing), rows, k, width), k), "first-found"
    )
    # a query's k-th score so far, in the order of its block
    kth = first.groupBy("q", "pos").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    kth = kth.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("pos", "kth"))).alias("kths"))
    reached = materialize(
        queries.join(kth, "q", "left").withColumn(
            "least", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at("kths", i))
        ).drop("kths"),
        "queries-reached",
    )
    smallest = F.when(F.forall("least", lambda x: x.isNotNull()), F.array_min("least"))
    rest = (
        pairs.join(first_pairs, ["q", "block"], "left_anti")
        .join(reached.select("q", smallest.alias("smallest")), "q")
        .filter(F.col("smallest").isNull() | (F.col("bound") >= F.col("smallest")))
        .select("q", "block")
    )
    found = first.drop("rank").unionByName(_search(rest, reached, rows, k, width))
    return _ranked(found, k).select("query_id", "rank", "id", "score")


def op13_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k_inner_product(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP13_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS tag, vec_id,
         list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.tag AS query_tag, q.vec_id AS query_id, c.vec_id, c.tag,
         list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: z[1] * z[2]))::bigint AS score
  FROM v AS q JOIN v AS c ON c.tag <> q.tag
  WHERE q.vec_id % {QUERY_STEP} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_tag ORDER BY score DESC, vec_id NULLS LAST, tag) AS rank
  FROM scored
)
SELECT query_id, rank::int AS rank, vec_id, score FROM ranked WHERE rank <= {TOP_K}
"""
