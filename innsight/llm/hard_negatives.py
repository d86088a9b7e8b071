"""Hard-negative mining with the threshold algorithm over sorted lists.

For an anchor, the positives are its best rows of the same label, and a hard
negative for a positive is a row of another label whose score lies in a window
below the positive's score. Scores are integer inner products.

All rows lie in shards of bounded size, by label. A shard keeps one list per
dimension, its rows sorted by that component. Searching a shard for an anchor
reads the lists from the top where the anchor's component is positive and from
the bottom where it is negative (sorted access), scores each row when it first
turns up in any list (random access), and knows that no row that has not turned
up can score more than the threshold: the anchor's product with the components
last read. It stops when the threshold is strictly below what every result still
asks for: the k-th score found for it, or the lower end of its window.

1. Anchors are taken in blocks by label and held against the shards that hold
   their label; the best ``positives`` rows of all shards are the positives.
2. With the windows they give, the blocks of anchors are held against all shards
   that hold another label, and the best ``negatives`` rows per window of all
   shards are ranked.

Both steps are equi-joins on shard numbers; what is copied are blocks of at most
``ANCHOR_BLOCK`` anchors, and a task holds one block and one shard, whatever
share of the rows a label has.

Defined cases: those of ``vectors``; rows with a null label take no part; an
anchor is not its own positive, but rows of equal id are different rows; equal
scores go by the smaller id, null ids last, then by row; a positive without rows
in its window has no result; an anchor whose label no other row has has none;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm.tables import column, materialize, read_table
from innsight.llm.vectors import (
    dimensions,
    exact_matrix,
    id_arrays,
    in_blocks,
    integer_vectors,
    packed_blocks,
    vector_matrix,
)

SCALE = 256
ANCHOR_STEP = 50  # ids divisible by it are anchors
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)  # per cent of the positive's score
SHARD = 4_096
ANCHOR_BLOCK = 256
FIRST_DEPTH = 16  # places read in each list before the first look at the threshold; doubled each time
# the query's labels: where the id is divisible by FLIP_STEP, the next of LABELS labels
FLIP_STEP = 7
LABELS = 10

SHARD_SCHEMA = "n int, tags binary, ids binary, has_id binary, labels binary, vecs binary, lists binary"
ANCHOR_SCHEMA = "n int, tags binary, ids binary, has_id binary, labels binary, vecs binary"
POSITIVE_SCHEMA = "a long, pos int, anchor_tag long, anchor_id long, tag long, id long, score long"
NEGATIVE_SCHEMA = "a long, pos int, anchor_tag long, anchor_id long, positive int, tag long, id long, score long"


def threshold_search(
    anchor: np.ndarray, vecs: np.ndarray, lists: np.ndarray, wanted: np.ndarray, asks: list[tuple[int, int]], k: int,
    rank,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (low, high) of ``asks`` the ``k`` best wanted rows with low <= score <= high, as (rows, scores).

    ``lists``: per dimension (a column) the rows from the largest component to
    the smallest. ``rank(rows, scores)`` orders rows, best first.
    """
    n = len(vecs)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    seen = ~wanted
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in asks]
    read, depth = 0, min(FIRST_DEPTH, n)
    while True:
        reached = np.zeros(n, dtype=bool)
        reached[lists[read:depth, up]] = True
        reached[lists[n - depth : n - read, down]] = True
        if depth == n:
            reached[:] = True  # also rows that no list of a nonzero component leads to
        new = np.flatnonzero(reached & ~seen)
        seen[new] = True
        scores = (vecs[new] @ anchor).astype(np.int64)
        threshold = int(
            (vecs[lists[depth - 1, up], up] * anchor[up]).sum() + (vecs[lists[n - depth, down], down] * anchor[down]).sum()
        )
        done = True
        for i, (low, high) in enumerate(asks):
            inside = (scores >= low) & (scores <= high)
            if len(found[i][0]) == k:  # rows below the k-th score can't enter
                inside &= scores >= found[i][1].min()
            rows = np.concatenate([found[i][0], new[inside]])
            values = np.concatenate([found[i][1], scores[inside]])
            if len(rows) > k:
                best = rank(rows, values)[:k]
                rows, values = rows[best], values[best]
            found[i] = rows, values
            least = int(values.min()) if len(rows) == k else low
            done &= threshold < least or low > high
        if done or depth == n:
            return found
        read, depth = depth, min(n, 2 * depth)


def _arrays(row: dict, prefix: str, width: int) -> dict[str, np.ndarray]:
    kinds = {"tags": np.int64, "ids": np.int64, "has_id": bool, "labels": np.int64}
    out = {name: np.frombuffer(row[prefix + name], dtype=kind) for name, kind in kinds.items()}
    out["vecs"] = np.frombuffer(row[prefix + "vecs"], dtype=np.int32).reshape(row[prefix + "n"], width)
    return out


def search_shard(row: dict, k: int, width: int, windows: bool) -> dict[str, pa.Array]:
    """What one shard holds for each anchor of a block: positives, or negatives of its windows."""
    anchors, shard = _arrays(row, "a_", width), _arrays(row, "", width)
    lists = np.frombuffer(row["lists"], dtype=np.int32).reshape(row["n"], width)
    exact_anchors, vecs = exact_matrix(anchors["vecs"], shard["vecs"])
    tags, ids, there, labels = (shard[x] for x in ("tags", "ids", "has_id", "labels"))
    rank = lambda rows, scores: np.lexsort((tags[rows], ids[rows], ~there[rows], -scores))
    everything = np.iinfo(np.int64).max
    at, positive, found, scores = [], [], [], []
    for i in range(len(anchors["tags"])):
        same = labels == anchors["labels"][i]
        if windows:
            asks, wanted = [tuple(w) for w in row["windows"][i] or []], ~same
        else:
            asks, wanted = [(-everything, everything)], same & (tags != anchors["tags"][i])
        if not asks or not wanted.any():
            continue
        for j, (rows, values) in enumerate(threshold_search(exact_anchors[i], vecs, lists, wanted, asks, k, rank)):
            at.append(np.full(len(rows), i, dtype=np.int32))
            positive.append(np.full(len(rows), j, dtype=np.int32))
            found.append(rows)
            scores.append(values)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    at, rows = join(at, np.int32), join(found, np.int64)
    out = {
        "a": pa.array(np.full(len(at), row["a"], dtype=np.int64)),
        "pos": pa.array(at),
        "anchor_tag": pa.array(anchors["tags"][at]),
        "anchor_id": pa.array(anchors["ids"][at]),
        "positive": pa.array(join(positive, np.int32)),
        "tag": pa.array(tags[rows]),
        "id": pa.array(ids[rows], mask=~there[rows]),
        "score": pa.array(join(scores, np.int64)),
    }
    if not windows:
        del out["positive"]
    return out


def _packed(rows: DataFrame, size: int, width: int, lists: bool, label: str) -> tuple[DataFrame, DataFrame]:
    """(blocks of rows by label, the labels of each block)."""

    def pack(items: dict) -> dict:
        ids, there = id_arrays(items["id"])
        vecs = vector_matrix(items["vec"], width)
        out = {
            "n": np.int32(len(ids)),
            "tags": items["tag"].to_numpy().astype(np.int64).tobytes(),
            "ids": ids.tobytes(),
            "has_id": there.tobytes(),
            "labels": items["label"].to_numpy().astype(np.int64).tobytes(),
            "vecs": vecs.tobytes(),
        }
        if lists:
            out["lists"] = np.argsort(-vecs, axis=0, kind="stable").astype(np.int32).tobytes()
        return out

    placed = in_blocks(rows, ["label", "tag"], size, f"{label}-order")
    schema = SHARD_SCHEMA if lists else ANCHOR_SCHEMA
    blocks = packed_blocks(placed, ["tag", "id", "label", "vec"], pack, schema, label)
    return blocks, placed.select("block", "label").distinct()


def _search(pairs: DataFrame, anchors: DataFrame, shards: DataFrame, k: int, width: int, windows: bool) -> DataFrame:
    kept = [c for c in anchors.columns if c not in ("a", "windows")]
    asked = anchors.select("a", *[F.col(c).alias(f"a_{c}") for c in kept], *["windows"] * windows)
    work = pairs.join(asked, "a").join(shards, "block").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict(search_shard(row, k, width, windows))

    return work.mapInArrow(run, NEGATIVE_SCHEMA if windows else POSITIVE_SCHEMA)


def _best(found: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "tag")
    return found.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def hard_negatives(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor_step: int = ANCHOR_STEP,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    scale: int = SCALE,
    shard: int = SHARD,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    ``label_col`` holds whole numbers. Negatives score between ``window`` per
    cent of the positive's score, both ends included.
    """
    label = column(df, label_col)
    vectors = integer_vectors(df.filter(label.isNotNull()), id_col, vector_col, scale, label=label.cast("long"))
    width = dimensions(vectors)
    shards, shard_labels = _packed(vectors, shard, width, True, "shards")
    anchor_rows = vectors.filter(F.col("id") % anchor_step == 0)
    anchors, anchor_labels = _packed(anchor_rows, anchor_block, width, False, "anchors")
    anchors = anchors.withColumnRenamed("block", "a")
    anchor_labels = materialize(anchor_labels.withColumnRenamed("block", "a"), "anchor-labels")
    shard_labels = materialize(shard_labels, "shard-labels")
    sharing = anchor_labels.join(shard_labels, "label").select("a", "block").distinct()
    found = _search(sharing, anchors, shards, positives, width, windows=False)
    best = materialize(_best(found, ["anchor_tag"], positives, "turn"), "positives")
    low, high = window
    # whole numbers: rounded up and down without a division of doubles
    span = F.struct(
        F.expr(f"(score * {low} + pmod(-score * {low}, 100)) div 100").alias("low"),
        F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100").alias("high"),
    )
    of_anchor = best.groupBy("a", "pos").agg(F.sort_array(F.collect_list(F.struct("turn", span.alias("span")))).alias("w"))
    of_anchor = of_anchor.select("a", "pos", F.transform("w", lambda w: F.array(w["span"]["low"], w["span"]["high"])).alias("w"))
    of_block = of_anchor.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("pos", "w"))).alias("w"))
    asking = materialize(
        anchors.join(of_block, "a").withColumn(
            "windows", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at("w", i))
        ).drop("w"),
        "anchors-asking",
    )
    blocks = anchor_labels.agg(F.max("a")).first()[0]
    # a block and a shard of one and the same label have no negatives for each other
    single = lambda labels, key, name: labels.groupBy(key).agg(
        F.when(F.min("label") == F.max("label"), F.min("label")).alias(name)
    )
    others = (
        single(shard_labels, "block", "only")
        .select("block", "only", F.explode(F.sequence(F.lit(0), F.lit(blocks or 0))).alias("a"))
        .withColumn("a", F.col("a").cast("long"))
        .join(single(anchor_labels, "a", "a_only"), "a")
        .filter(F.col("only").isNull() | F.col("a_only").isNull() | (F.col("only") != F.col("a_only")))
        .select("a", "block")
    )
    found = _search(others, asking, shards, negatives, width, windows=True)
    ranked = _best(found, ["anchor_tag", "positive"], negatives, "rank")
    return (
        ranked.withColumn("turn", F.col("positive") + 1)
        .withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        .join(
            best.select("anchor_tag", "turn", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
            ["anchor_tag", "turn"],
        )
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % FLIP_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(df.withColumn("label", moved))


OP11_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS tag, vec_id,
         CASE WHEN vec_id % {FLIP_STEP} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT a.tag AS anchor_tag, a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.tag, c.label,
         list_sum(list_transform(list_zip(a.vec, c.vec), lambda z: z[1] * z[2]))::bigint AS score
  FROM v AS a JOIN v AS c ON c.tag <> a.tag
  WHERE a.vec_id % {ANCHOR_STEP} = 0
), positives AS (
  SELECT anchor_tag, anchor_id, tag AS positive_tag, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_tag ORDER BY score DESC, vec_id NULLS LAST, tag) <= {POSITIVES}
)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_tag, positive_tag ORDER BY score DESC, vec_id NULLS LAST, tag)::int AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives AS p JOIN scored AS s ON s.anchor_tag = p.anchor_tag AND s.label <> s.anchor_label
WHERE {WINDOW[0]} * positive_score <= 100 * score AND 100 * score <= {WINDOW[1]} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
