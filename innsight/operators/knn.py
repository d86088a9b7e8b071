"""k nearest neighbours within a group (a city), exact and approximate.

``knn_exact`` returns, for every point, the ``k`` points of the same group with
the smallest Euclidean distance over the given feature columns -- the point
itself included, as in the source job -- or all of them when the group has
fewer than ``k``. Equal distances are ordered by neighbour id, so the result is
deterministic.

One plan for all sizes, block against block:

1. Points with equal features have equal neighbours, and of any number of them
   only the ``k`` smallest ids can be among a target's ``k`` nearest. So each
   distinct vector is searched once, against a pool of at most ``k`` points per
   vector; a place with a million equal points costs ``k`` rows.
2. The pool is laid out in leaves (``leaf_layout``). A group is cut into cells of
   at most ``FAN_OUT ** LEVELS`` leaves, consecutive along a curve through the
   features' quantiles, and a cell into leaves by repeated cuts at quantiles of
   its widest feature. Leaves follow the data: a dense core gets small boxes, and
   a leaf holds between half of ``leaf_size`` and ``leaf_size`` points whatever
   the group looks like. The cuts of a cell are windows over one partitioning, so
   the layout is two shuffles, however large the group.
3. Each block (the leaves that came from one cut, or two) is searched against
   itself. The k-th distance so found bounds a target's reach, and the largest
   in a leaf the leaf's reach.
4. Boxes are held against boxes: cells first, then leaves of near cells. A leaf
   farther from the target's leaf than that leaf's reach is dropped for all its
   targets at once.
5. Of the leaves that remain a target looks into those whose box is within its
   own reach; the top-k window (a ``WindowGroupLimit``) keeps ``k`` per target
   before the shuffle.

Distances are computed in Arrow batches (``nearest_at``), so pairs are rows only
where they are among the ``k`` nearest of a block or leaf. What is copied are
targets; a leaf's points only where more than ``ASKING_LEAVES`` leaves ask it.

``knn_lsh`` is the approximate search: random projections (Spark ML's
``BucketedRandomProjectionLSH``), as many per bucket as the group's size asks
for. A target also looks into the neighbouring buckets whose borders are nearest
to it, and then at the neighbours of the neighbours found. Targets whose buckets
hold too few candidates are searched exactly, so every target has min(k, n)
neighbours. ``knn_recall`` holds a result against the exact one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.fixed_values import COMP_SET_SIZE
from innsight.operators.nearest import deal, nearest_at
from innsight.plans.lineage import cut_lineage

TARGET_ID = "target_property_harp_ID"
NEIGHBOUR_ID = "harp_property_id_no"
DISTANCE = "knn_distance_metric"
RANK = "neighbour_rank"
DEFAULT_K = COMP_SET_SIZE
LEAF_SIZE = 96  # points of a leaf
BLOCK_SIZE = 384  # points among which a target finds its reach: the leaves that came from one cut, or two
FAN_OUT = 4  # pieces of one cut
ASKING_LEAVES = 256  # leaves that ask at one desk of a leaf
LEVELS = 3  # cuts of a cell, which so holds at most FAN_OUT ** LEVELS leaves
CURVE_BITS = 4  # the curve tells 2 ** bits quantiles of a feature apart
# LSH: points a bucket should hold on average, hash tables, neighbouring buckets looked into per table
DEFAULT_LSH_CANDIDATES = 50
DEFAULT_LSH_TABLES = 4
DEFAULT_LSH_PROBES = 4
STEPS = 1024  # places told apart across a bucket


def _squared_distance(n_features: int) -> Column:
    gaps = [F.col(f"_t{i}") - F.col(f"_n{i}") for i in range(n_features)]
    terms = [gap * gap for gap in gaps]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def top_k(pairs: DataFrame, key: str, k: int) -> DataFrame:
    """Keep the ``k`` closest neighbours per (key, target); adds ``neighbour_rank`` (1 = closest)."""
    order = Window.partitionBy(key, "_tid").orderBy(F.col("_d2"), F.col("_nid"))
    return pairs.withColumn(RANK, F.row_number().over(order)).filter(F.col(RANK) <= k)


def neighbour_pool(points: DataFrame, key: str, id_col: str, features: Sequence[str], k: int) -> DataFrame:
    """(key, _nid, _n<i>, _place): per distinct vector the points with the ``k`` smallest ids, _place 1 for the first.

    The limit works in each task before the shuffle, so many equal points do not meet.
    """
    vector = [f"_n{i}" for i in range(len(features))]
    rows = points.select(
        key,
        F.col(id_col).alias("_nid"),
        # -0.0 and 0.0 are one value, as in joins
        *[(F.col(f).cast("double") + F.lit(0.0)).alias(v) for f, v in zip(features, vector)],
    )
    place = F.row_number().over(Window.partitionBy(key, *vector).orderBy("_nid"))
    return rows.withColumn("_place", place).filter(F.col("_place") <= k)


def _curve(pool: DataFrame, key: str, n_features: int) -> DataFrame:
    """Add ``_code``: the place of a point along a curve that takes turns through the features' quantiles."""
    slices = 1 << CURVE_BITS
    seen = min(n_features, 62 // CURVE_BITS)
    at = [c / slices for c in range(1, slices)]
    cuts = pool.groupBy(key).agg(*[F.percentile_approx(f"_n{i}", at, 1000).alias(f"_cuts{i}") for i in range(seen)])
    below = lambda value: lambda cut: cut < F.col(value)
    slice_of = [F.size(F.filter(f"_cuts{i}", below(f"_n{i}"))) for i in range(seen)]
    rows = pool.join(cuts, key).select(*pool.columns, *[s.alias(f"_slice{i}") for i, s in enumerate(slice_of)])
    code = F.lit(0).cast("long")
    for bit in range(CURVE_BITS):
        for i in range(seen):
            code = code * 2 + F.shiftright(f"_slice{i}", CURVE_BITS - 1 - bit).bitwiseAND(1)
    return rows.select(*pool.columns, code.alias("_code"))


def leaf_layout(pool: DataFrame, key: str, n_features: int, leaf_size: int) -> DataFrame:
    """Add ``_cell``, ``_block`` and ``_leaf`` (numbers within the group) to the pool's points; written once.

    A point's place in its group along the curve is its place in a range
    partition plus the sizes of the group's earlier partitions, so a group of
    any size is numbered piece by piece.
    """
    vector = [f"_n{i}" for i in range(n_features)]
    order = [key, "_code", *vector, "_nid"]
    placed = _curve(pool, key, n_features).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()), label="knn-order")
    placed = placed.withColumn("_piece", F.shiftright("_at", 33))
    of_group = Window.partitionBy(key)
    earlier = of_group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        placed.groupBy(key, "_piece")
        .agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
        .select(
            key,
            "_piece",
            (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_size").over(of_group).alias("_all"),
        )
    )
    cells = F.ceil(F.col("_all") / F.lit(float(leaf_size * FAN_OUT**LEVELS)))
    cell = F.floor((F.col("_at") + F.col("_shift")) * cells / F.col("_all")).cast("long")
    rows = placed.join(pieces, [key, "_piece"]).select(*pool.columns, cell.alias("_cell"), F.lit(0).alias("_path"))
    rows = deal(rows, key, "_cell")
    for _ in range(LEVELS):
        piece = Window.partitionBy(key, "_cell", "_path")
        spread = [F.max(v).over(piece) - F.min(v).over(piece) for v in vector]
        rows = rows.select("*", F.count(F.lit(1)).over(piece).alias("_size"), F.array(*spread).alias("_spread"))
        # where nothing differs (or a value is no number) the first feature is as good as any
        widest = F.coalesce(F.array_position("_spread", F.array_max("_spread")).cast("int"), F.lit(1))
        rows = rows.withColumn("_v", F.element_at(F.array(*vector), widest))
        pieces_of = F.least(F.lit(FAN_OUT), F.ceil(F.col("_size") / F.lit(float(leaf_size))))
        turn = F.row_number().over(piece.orderBy("_v", "_nid")) - 1
        child = F.floor(turn * pieces_of / F.col("_size")).cast("int")
        rows = rows.withColumn("_child", child).select(
            *pool.columns, "_cell", (F.col("_path") * FAN_OUT + F.col("_child")).alias("_path")
        )
    leaf = F.col("_cell") * FAN_OUT**LEVELS + F.col("_path")
    cuts = max([c for c in range(LEVELS + 1) if leaf_size * FAN_OUT**c <= BLOCK_SIZE], default=0)
    rows = rows.select(*pool.columns, "_cell", leaf.alias("_leaf"))
    return cut_lineage(rows.withColumn("_block", F.expr(f"_leaf div {FAN_OUT**cuts}")), label="knn-leaves")


def _apart(n_features: int, low: str, high: str, other_low: str, other_high: str) -> Column:
    """Squared distance of two boxes; a point is a box whose corners are equal."""
    total = F.lit(0.0)
    for i in range(n_features):
        gap = F.greatest(
            F.col(f"{low}{i}") - F.col(f"{other_high}{i}"), F.col(f"{other_low}{i}") - F.col(f"{high}{i}"), F.lit(0.0)
        )
        total = total + gap * gap
    return total


def _near_pairs(reached: DataFrame, boxes: DataFrame, on: list[str], by: str, n_features: int) -> DataFrame:
    """(*on, by, _other<by>): of boxes that agree in ``on``, those within the reach of ``by``'s box."""
    corners = [f"_{s}{i}" for s in ("lo", "hi") for i in range(n_features)]
    others = boxes.select(*on, F.col(by).alias(f"_other{by}"), *[F.col(c).alias(f"_other{c}") for c in corners])
    near = _apart(n_features, "_lo", "_hi", "_other_lo", "_other_hi") <= F.col("_reach")
    return reached.join(others, on).filter(near).select(*on, by, f"_other{by}")


@dataclass
class BlockSearch:
    """What the own blocks give, and the other leaves each target must look into."""

    own: DataFrame  # key, _tid, _near: the k nearest of the own block
    visits: DataFrame  # key, _tid, _t<i>, _kth, _leaf, _desk
    desks: DataFrame  # key, _leaf, _desks: of the leaves asked, into how many desks the asking leaves are dealt


def block_search(layout: DataFrame, targets: DataFrame, key: str, n_features: int, k: int) -> BlockSearch:
    """Search the own blocks of ``targets`` (rows of the layout) and prune the other leaves, box against box."""
    vector = [f"_t{i}" for i in range(n_features)]
    corners = [f"_{s}{i}" for s in ("lo", "hi") for i in range(n_features)]
    t = targets.select(
        key, "_block", "_cell", "_leaf", F.col("_nid").alias("_tid"), *[F.col(f"_n{i}").alias(v) for i, v in enumerate(vector)],
        F.lit(float("inf")).alias("_kth"),
    )
    points = layout.select(key, "_block", "_nid", *[f"_n{i}" for i in range(n_features)])
    near = nearest_at(points, t, [key, "_block"], n_features, k, keep=["_cell", "_leaf"])
    # a little more than the k-th distance, for the rounding of box distances
    reach = F.when(F.size("_near") >= k, F.element_at("_near", k)["_d2"] * (1 + 1e-9) + 1e-12).otherwise(F.lit(float("inf")))
    own = cut_lineage(near.select(key, "_block", "_cell", "_leaf", "_tid", *vector, reach.alias("_kth"), "_near"), label="knn-own-block")
    t = own.drop("_near")

    low, high = ([f(f"_n{i}").alias(f"_{s}{i}") for i in range(n_features)] for f, s in ((F.min, "lo"), (F.max, "hi")))
    boxes = layout.groupBy(key, "_cell", "_block", "_leaf").agg(*low, *high)
    leaves = boxes.join(t.groupBy(key, "_leaf").agg(F.max("_kth").alias("_reach")), [key, "_leaf"])
    low, high = ([f(c).alias(c) for c in corners if s in c] for f, s in ((F.min, "lo"), (F.max, "hi")))
    cells = boxes.groupBy(key, "_cell").agg(*low, *high)
    asking = cells.join(leaves.groupBy(key, "_cell").agg(F.max("_reach").alias("_reach")), [key, "_cell"])
    near_cells = _near_pairs(asking, cells, [key], "_cell", n_features)
    # the leaves of a cell against those of the cells near it
    asking = leaves.drop("_block").join(near_cells, [key, "_cell"]).drop("_cell")
    other = boxes.drop("_block").withColumnRenamed("_cell", "_other_cell")
    near_leaves = _near_pairs(asking, other, [key, "_other_cell"], "_leaf", n_features)
    looks = near_leaves.select(key, "_leaf", F.col("_other_leaf").alias("_look"))
    looks = cut_lineage(looks.filter("_leaf <> _look"), label="knn-near-leaves")
    # a leaf that many others must look into has its points at several desks
    desks = looks.groupBy(key, "_look").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(ASKING_LEAVES))).cast("int").alias("_desks"))
    looked = boxes.select(key, F.col("_leaf").alias("_look"), F.col("_block").alias("_other_block"), *corners).join(desks, [key, "_look"])
    looks = looks.join(looked, [key, "_look"]).withColumn("_desk", F.pmod(F.xxhash64("_leaf"), F.col("_desks")).cast("int"))
    within = _apart(n_features, "_t", "_t", "_lo", "_hi") <= F.col("_kth")
    visits = t.join(looks, [key, "_leaf"]).filter((F.col("_block") != F.col("_other_block")) & within)
    visits = visits.select(key, "_tid", *vector, "_kth", F.col("_look").alias("_leaf"), "_desk")
    return BlockSearch(own.select(key, "_tid", "_near"), visits, desks.withColumnRenamed("_look", "_leaf"))


def search_pairs(search: BlockSearch, layout: DataFrame, key: str, n_features: int, k: int) -> DataFrame:
    """(key, _tid, _nid, _d2) with every pair that can be among a target's k nearest; the visits' ones are written."""
    vector = [f"_n{i}" for i in range(n_features)]
    points = layout.join(search.desks, [key, "_leaf"]).select(
        key, "_leaf", "_nid", *vector, F.explode(F.sequence(F.lit(0), F.col("_desks") - 1)).alias("_desk")
    )
    others = nearest_at(points, search.visits, [key, "_leaf", "_desk"], n_features, k)
    others = cut_lineage(others.select(key, "_tid", "_near"), label="knn-visits")
    return search.own.unionByName(others).select(key, "_tid", F.inline("_near"))


def candidate_pairs(layout: DataFrame, targets: DataFrame, key: str, n_features: int, k: int) -> int:
    """Number of distances the search computes: points of the own blocks and of the leaves looked into, summed over targets."""
    search = block_search(layout, targets, key, n_features, k)
    total = 0
    for asking, place in ((targets.select(key, "_block"), "_block"), (search.visits.select(key, "_leaf"), "_leaf")):
        sizes = layout.groupBy(key, place).agg(F.count(F.lit(1)).alias("_n"))
        looks = asking.groupBy(key, place).agg(F.count(F.lit(1)).alias("_looks")).join(sizes, [key, place])
        total += looks.agg(F.sum(F.col("_looks") * F.col("_n"))).first()[0] or 0
    return total


def knn_exact(
    points: DataFrame,
    features: Sequence[str],
    k: int = DEFAULT_K,
    key: str = "city_code",
    id_col: str = NEIGHBOUR_ID,
    leaf_size: int = LEAF_SIZE,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Exact k nearest neighbours of every point within its ``key`` group.

    ``points`` must have one row per (``key``, ``id_col``) and non-NULL
    features. ``targets`` (``key``, ``id_col``) limits the search to some of
    them. Output: ``key, target_property_harp_ID, harp_property_id_no,
    knn_distance_metric, neighbour_rank``. Runs jobs while it lays out the
    leaves and searches each against itself; the rest is lazy.
    """
    points = points.filter(F.col(key).isNotNull())
    nf = len(features)
    pool = neighbour_pool(points, key, id_col, features, k)
    # of a group in several leaves every leaf holds half of leaf_size at least, which must be k
    layout = leaf_layout(pool, key, nf, max(leaf_size, 2 * k))
    wanted = points.select(
        key, F.col(id_col).alias(TARGET_ID), *[(F.col(f).cast("double") + F.lit(0.0)).alias(f"_n{i}") for i, f in enumerate(features)]
    )
    vectors = [key, *[f"_n{i}" for i in range(nf)]]
    searched = layout.filter("_place = 1")
    if targets is not None:
        wanted = wanted.join(targets.select(key, F.col(id_col).alias(TARGET_ID)), [key, TARGET_ID], "left_semi")
        searched = searched.join(wanted, vectors, "left_semi")
    search = block_search(layout, searched, key, nf, k)
    found = top_k(search_pairs(search, layout, key, nf, k), key, k)
    # a vector's first point stands for all points with that vector
    first = layout.filter("_place = 1").select(*vectors, F.col("_nid").alias("_tid"))
    return (
        wanted.join(first, vectors)
        .select(key, TARGET_ID, "_tid")
        .join(found, [key, "_tid"])
        .select(key, TARGET_ID, F.col("_nid").alias(NEIGHBOUR_ID), F.sqrt("_d2").alias(DISTANCE), RANK)
    )


def _probes(at: Column, n_probes: int) -> Column:
    """Keys of a target's own bucket and of the ``n_probes`` neighbouring buckets nearest to it, in one table.

    ``at``: the target's places along the table's projections, in widths of a
    bucket. A neighbouring bucket is one step away along one projection; it is as
    far as the border in between.
    """
    own = F.transform(at, lambda v: F.floor(v))
    steps = F.transform(
        at,
        lambda v, i: F.array(
            F.struct((v - F.floor(v)).alias("far"), i.alias("i"), F.lit(-1).cast("long").alias("step")),
            F.struct((F.floor(v) + 1 - v).alias("far"), i.alias("i"), F.lit(1).cast("long").alias("step")),
        ),
    )
    nearest = F.slice(F.array_sort(F.flatten(steps)), 1, n_probes)
    moved = F.transform(
        nearest,
        lambda s: F.xxhash64(F.transform(own, lambda b, i: b + F.when(i == s["i"], s["step"]).otherwise(F.lit(0).cast("long")))),
    )
    return F.concat(F.array(F.xxhash64(own)), moved)


def _reach(k: int) -> Column:
    """The squared distance of a target's k-th neighbour so far."""
    return F.when(F.size("_near") >= k, F.element_at("_near", k)["_d2"]).otherwise(F.lit(float("inf")))


def _with_more(best: DataFrame, more: DataFrame, key: str, k: int) -> DataFrame:
    """``best`` with ``_near`` the k nearest of its own and of all ``_near`` of ``more``, by (key, _tid)."""
    more = more.groupBy(key, "_tid").agg(F.flatten(F.collect_list("_near")).alias("_more"))
    both = F.array_distinct(F.concat("_near", F.coalesce("_more", F.slice("_near", 1, 0))))
    rows = best.join(more, [key, "_tid"], "left")
    return rows.withColumn("_near", F.slice(F.sort_array(both), 1, k)).select(*best.columns)


def _neighbours_of_neighbours(best: DataFrame, key: str, k: int, n_features: int) -> DataFrame:
    """Add to each target's k nearest so far what its neighbours have found, and keep the k nearest.

    A target goes to its neighbours with its reach and the ids it has; only
    what is new and within reach goes back.
    """
    t = [f"_t{i}" for i in range(n_features)]
    asking = best.select(
        key, "_tid", *t, _reach(k).alias("_kth"), F.col("_near._nid").alias("_has"), F.explode("_near._nid").alias("_via")
    ).filter(F.col("_via") != F.col("_tid"))
    lists = best.select(key, F.col("_tid").alias("_via"), F.col("_near").alias("_hop")).hint("shuffle_hash")
    vector = [f"_n{i}" for i in range(n_features)]
    reached = (
        asking.join(lists, [key, "_via"])
        .select(key, "_tid", *t, "_kth", "_has", F.inline("_hop"))
        .filter(~F.array_contains("_has", F.col("_nid")))
        .withColumn("_d2", _squared_distance(n_features))
        .filter(F.col("_d2") <= F.col("_kth"))
        .select(key, "_tid", F.array(F.struct("_d2", "_nid", *vector)).alias("_near"))
    )
    return _with_more(best, reached, key, k)


def knn_lsh(
    points: DataFrame,
    features: Sequence[str],
    k: int = DEFAULT_K,
    key: str = "city_code",
    id_col: str = NEIGHBOUR_ID,
    bucket_candidates: int = DEFAULT_LSH_CANDIDATES,
    num_hash_tables: int = DEFAULT_LSH_TABLES,
    seed: int = 17,
    probes: int = DEFAULT_LSH_PROBES,
) -> DataFrame:
    """Approximate k nearest neighbours within ``key`` via random-projection LSH.

    A table's bucket is the first ``m`` of its projections together (an AND of
    hashes, the tables an OR); ``m`` and the bucket width are set per group so
    that a bucket holds about ``bucket_candidates`` points whatever the group's
    size, and as many projections are computed as the largest group needs.
    Candidates are the points in the target's bucket and, by the distance to the
    border, in the ``probes`` nearest neighbouring buckets of each table; a bucket
    gives a target its k nearest there within the reach it has so far, so
    candidate pairs are never rows. Then each target looks at the neighbours of
    its neighbours. Targets with fewer than min(k, n) candidates go
    to ``knn_exact``, so every target is complete. Same output columns as
    ``knn_exact``.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    nf = len(features)
    points = points.filter(F.col(key).isNotNull())
    pool = cut_lineage(neighbour_pool(points, key, id_col, features, k), label="lsh-pool")
    # Per group: a projection onto a random unit direction has variance about
    # (sum of feature variances) / d; buckets two of its deviations wide, and
    # m = log2(n / bucket_candidates) projections per bucket, leave about
    # ``bucket_candidates`` points in a bucket whatever the group's size.
    spread = pool.groupBy(key).agg(
        F.count(F.lit(1)).alias("_size"),
        sum((F.coalesce(F.var_samp(f"_n{i}"), F.lit(0.0)) for i in range(nf)), F.lit(0.0)).alias("_var"),
    )
    width = F.lit(2.0) * F.sqrt(F.col("_var") / nf)
    per_bucket = F.ceil(F.log2(F.col("_size") / F.lit(float(bucket_candidates))))
    spread = cut_lineage(
        spread.select(
            key,
            F.when(width > 0, width).otherwise(F.lit(1.0)).alias("_w"),
            F.greatest(F.lit(1), per_bucket).cast("int").alias("_m"),
        ),
        label="lsh-groups",
    )
    projections = spread.agg(F.max("_m")).first()[0] or 1
    vec = pool.join(spread, on=key).withColumn(
        "_vec", array_to_vector(F.array(*[F.col(f"_n{i}") / F.col("_w") for i in range(nf)]))
    )
    # a hash is the place along a projection in steps of a bucket's width, so it tells how near a border is
    model = BucketedRandomProjectionLSH(
        inputCol="_vec", outputCol="_hashes", bucketLength=1.0 / STEPS, numHashTables=num_hash_tables * projections, seed=seed
    ).fit(vec)
    places = F.transform("_hashes", lambda h: vector_to_array(h)[0] / STEPS)
    tables = F.array(*[F.slice(places, j * projections + 1, F.col("_m")) for j in range(num_hash_tables)])
    vector = [f"_n{i}" for i in range(nf)]
    # per table the own bucket, then the neighbouring ones
    looks = F.transform(tables, lambda at: _probes(at, probes)).alias("_looks")
    hashed = cut_lineage(model.transform(deal(vec, key, "_nid")).select(key, "_nid", "_place", *vector, looks), label="lsh-places")
    place, target = [key, "_table", "_bucket"], [f"_t{i}" for i in range(nf)]
    own = F.transform("_looks", lambda b: b[0])
    n = hashed.select(key, "_nid", *vector, F.posexplode(own).alias("_table", "_bucket"))
    # The own bucket of the first table bounds a target's reach, those of the others narrow it;
    # of the neighbouring buckets only what is within reach is given back.
    t = hashed.filter("_place = 1").select(
        key, F.col("_nid").alias("_tid"), *[F.col(a).alias(b) for a, b in zip(vector, target)], "_looks",
        F.lit(float("inf")).alias("_kth"), F.lit(0).alias("_table"), F.col("_looks")[0][0].alias("_bucket"),
    )
    best = nearest_at(n.filter("_table = 0"), t, place, nf, k, keep=["_looks"], vectors=True)
    best = cut_lineage(best.select(key, "_tid", *target, "_looks", "_near"), label="lsh-first-table")
    if num_hash_tables > 1:
        t = best.select(key, "_tid", *target, _reach(k).alias("_kth"), F.posexplode(own).alias("_table", "_bucket"))
        more = nearest_at(n.filter("_table > 0"), t.filter("_table > 0"), place, nf, k, vectors=True)
        best = cut_lineage(_with_more(best, more.select(key, "_tid", "_near"), key, k), label="lsh-own-buckets")
    if probes:
        t = best.select(key, "_tid", *target, _reach(k).alias("_kth"), F.posexplode("_looks").alias("_table", "_all"))
        t = t.select("*", F.explode(F.slice("_all", 2, probes)).alias("_bucket")).drop("_all")
        more = nearest_at(n, t, place, nf, k, vectors=True)
        best = _with_more(best, more.select(key, "_tid", "_near"), key, k)
    best = cut_lineage(best.drop("_looks"), label="lsh-found")
    found = cut_lineage(
        _neighbours_of_neighbours(best, key, k, nf).select(
            key, "_tid", F.transform("_near", lambda p: F.struct(p["_d2"].alias("_d2"), p["_nid"].alias("_nid"))).alias("_near")
        ),
        label="lsh-neighbours",
    )
    vectors = [key, *vector]
    first = hashed.filter("_place = 1").select(*vectors, F.col("_nid").alias("_tid"))
    wanted = points.select(
        key, F.col(id_col).alias(TARGET_ID), *[(F.col(f).cast("double") + F.lit(0.0)).alias(f"_n{i}") for i, f in enumerate(features)]
    )
    # a target is complete with k neighbours, or with all points of a small group
    counts = found.select(key, "_tid", F.size("_near").alias("_got"))
    group_sizes = points.groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
    of_target = cut_lineage(
        wanted.join(first, vectors)
        .join(counts, [key, "_tid"])
        .join(group_sizes, key)
        .select(key, TARGET_ID, "_tid", (F.col("_got") < F.least(F.lit(k), F.col("_all"))).alias("_short")),
        label="lsh-targets",
    )
    complete = (
        of_target.filter(~F.col("_short"))
        .join(found, [key, "_tid"])
        .select(key, TARGET_ID, F.posexplode("_near").alias("_at", "_p"))
        .select(
            key, TARGET_ID, F.col("_p._nid").alias(NEIGHBOUR_ID), F.sqrt("_p._d2").alias(DISTANCE), (F.col("_at") + 1).alias(RANK)
        )
    )
    short = of_target.filter("_short").select(key, F.col(TARGET_ID).alias(id_col))
    return complete.unionByName(knn_exact(points, features, k, key, id_col, targets=short))


def knn_recall(approximate: DataFrame, exact: DataFrame, key: str = "city_code") -> DataFrame:
    """(key, exact_pairs, found_pairs): how many pairs of the exact search the approximate one has, per group."""
    pair = [key, TARGET_ID, NEIGHBOUR_ID]
    hits = exact.select(*pair).join(approximate.select(*pair, F.lit(1).alias("_hit")), pair, "left")
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("exact_pairs"), F.count("_hit").alias("found_pairs"))


def attach(
    pairs: DataFrame,
    points: DataFrame,
    on_col: str,
    columns: dict[str, str],
    key: str = "city_code",
    id_col: str = NEIGHBOUR_ID,
) -> DataFrame:
    """Join point attributes onto ``pairs`` by (``key``, ``on_col``); ``columns`` maps source -> output name.

    The planner picks the join from the points' measured size.
    """
    side = points.select(key, F.col(id_col).alias(on_col), *[F.col(s).alias(o) for s, o in columns.items()])
    return pairs.join(side, on=[key, on_col])
