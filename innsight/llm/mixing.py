"""Mix sources to target weights along a time-varying curriculum.

Each source has a weight; its target is its share of all words, stopped at
``max_epochs`` times its own size, and what is stopped goes to the other sources
by weight. A source fills its target with whole passes over its documents and
one partial pass. The order of training comes from a schedule: while training
time t runs from 0 to 1, a source's demand follows a weight that changes
linearly from ``start`` to ``end`` times its average. The integral of that
schedule is the words asked of the source up to t; a document copy whose words
lie at c of the source's demand is trained at the t where the integral reaches
c. Documents are range-sorted by that position.

All steps are DataFrame operations. A source with any share of the rows is split
into buckets by a hash of the id, and only bucket sums meet (``ranks``).

Defined cases: a null text has size 0; a null source is a source of its own,
sorted last; a null id is hashed as an empty text; rows repeated whole count as
rows; documents without words are never taken (0 words, 0 copies) and have no
position; an empty table gives an empty result; other columns are ignored by
``mix_documents`` and kept by ``training_order``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm.ranks import bucket_digits, running_sum
from innsight.llm.tables import column, free_name, materialize, read_table

MAX_EPOCHS = 3  # a target stops at this many times its source's size
#: start and end of the weight schedule, as multiples of a source's average weight,
#: by its weight class: light sources fade in, heavy ones fade out
SCHEDULE = {1: (0.5, 1.5), 2: (1.0, 1.0), 3: (1.5, 0.5)}


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space; null counts as none."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return (F.length(words) - F.length(F.replace(words, F.lit("x"), F.lit("")))).cast("long")


def source_key(source: Column) -> Column:
    """A text that stands for the source, never null: sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def source_weights(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight): sources in order weigh 1, 2, 3, repeating.

    The rank of a source is its place in its range partition plus the sizes of
    the partitions before it, so no task holds all sources.
    """
    sources = materialize(
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .repartitionByRange("source")
        .withColumn("part", F.spark_partition_id()),
        "sources",
    )
    # one row per partition of the shuffle above: few rows, in one window
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sources.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")
    )
    rank = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1 + F.col("earlier")
    return sources.join(F.broadcast(earlier), "part").select(
        "source", "source_size", (rank % 3 + 1).cast("long").alias("weight")
    )


def source_targets(weights: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target``: the share by weight of all words, none above max_epochs times its size.

    Each round stops the sources that the current share would overfill and deals
    what is left to the others; it ends when a round stops none. Every round is
    one distributed sum, and the driver sees three numbers of it.
    """
    capacity = F.col("source_size") * max_epochs
    whole = weights.agg(F.sum("source_size")).first()[0] or 0
    level: tuple[int, int] | None = None  # words left, and the weight that shares them
    stopped = F.lit(False)
    seen = -1
    while True:
        n, used, weight = weights.agg(
            F.coalesce(F.sum(stopped.cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.when(stopped, capacity)), F.lit(0)),
            F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0)),
        ).first()
        if n == seen or weight == 0:
            break
        seen, level = n, (whole - used, weight)
        # target = weight * words left / weights left; compared without division
        over = (F.col("weight").cast("decimal(38,0)") * F.lit(level[0])) >= (
            capacity.cast("decimal(38,0)") * F.lit(level[1])
        )
        stopped = stopped | over
    if level is None:
        return weights.withColumn("target", F.lit(0.0))
    share = (F.col("weight") * F.lit(level[0])).cast("double") / F.lit(float(level[1]))
    return weights.withColumn("target", F.when(stopped, capacity.cast("double")).otherwise(share))


def demand_position(fraction: Column, start: Column, end: Column) -> Column:
    """The time t in [0, 1] at which a linear schedule from start to end has asked ``fraction``.

    The weights' integral up to t is start t + (end - start) t^2 / 2, and
    (start + end) / 2 at t = 1.
    """
    slope = (end - start) / 2
    asked = fraction * (start + end) / 2
    return F.when(F.abs(slope) < 1e-12, asked / start).otherwise(
        2 * asked / (start + F.sqrt(F.greatest(start * start + 4 * slope * asked, F.lit(0.0))))
    )


def _less(gaps: DataFrame, used: DataFrame) -> DataFrame:
    return gaps.join(used.select("source", "used"), "source", "left").select(
        "source", "partial", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")
    )


def mix_sizes(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Plan the mix of (id, source, size, key, tag): adds source_size, weight, target, copies, taken, before, place.

    ``key`` is a fixed hash that orders the documents of a source. Whole passes
    go to every document; the partial pass goes through the documents in the order
    of ``key`` and takes each that fits what is left of it. That is done in rounds:
    a round takes the documents up to the first that does not fit, and the next
    one goes on with those behind it that still fit, until none is left.
    ``before`` is the words ahead of a document in a whole pass, ``place`` in the
    partial pass. The tables of one row per source are written, so that Spark
    knows their size and broadcasts only small ones.
    """
    digits = bucket_digits(sizes.count())
    sizes = sizes.withColumn("bucket", F.substring("key", 1, digits) if digits else F.lit(""))
    targets = source_targets(source_weights(sizes), max_epochs)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = materialize(
        targets.withColumn("passes", passes.cast("long")).withColumn(
            "partial", F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
        ),
        "targets",
    )
    order = [F.col("key"), F.col("id"), F.col("size"), F.col("tag")]
    summed = running_sum(sizes, "source", "bucket", order, "size", "before")
    # one row per source and bucket, so that a large source is not one join key
    per_bucket = sizes.select("source", "bucket").distinct().join(targets, "source")
    fits = F.col("before") + F.col("size") <= F.col("partial")
    plan = materialize(
        summed.join(per_bucket, ["source", "bucket"]).withColumn("extra", fits.cast("long")), "mix"
    )
    gaps = plan.groupBy("source").agg(
        F.max("partial").alias("partial"),
        (F.max("partial") - F.sum(F.col("size") * F.col("extra"))).alias("gap"),
    )
    left = plan.filter("extra = 0 and size > 0").select("source", "bucket", "key", "id", "size", "tag")
    filled = []  # documents taken after the first round, with the words of the partial pass before them
    while True:
        gaps = materialize(gaps, "gaps")
        left = materialize(left.join(gaps, "source").filter("size <= gap"), "left")
        if left.isEmpty():
            break
        # the first in order always fits, so each round takes some of every source listed
        taken = materialize(
            running_sum(left, "source", "bucket", order, "size", "ahead")
            .filter("ahead + size <= gap")
            .select("source", "size", "tag", (F.col("partial") - F.col("gap") + F.col("ahead")).alias("place")),
            "filled",
        )
        filled.append(taken.select("tag", "place"))
        left = left.drop("partial", "gap").join(taken.select("tag"), "tag", "left_anti")
        gaps = _less(gaps, taken.groupBy("source").agg(F.sum("size").alias("used")))
    if filled:
        plan = plan.join(reduce(DataFrame.unionAll, filled), "tag", "left").withColumn(
            "extra", F.col("extra") + F.col("place").isNotNull().cast("long")
        )
    else:
        plan = plan.withColumn("place", F.lit(None).cast("long"))
    plan = plan.withColumn("place", F.coalesce("place", "before"))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("extra")).otherwise(0).cast("long")
    return plan.withColumn("copies", copies).withColumn("taken", F.col("size") * copies)


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    id_value = column(df, id_col)
    return materialize(
        df.select(
            id_value.alias("id"),
            source_key(column(df, source_col)).alias("source"),
            word_count(column(df, text_col)).alias("size"),
            id_hash(id_value).alias("key"),
            F.monotonically_increasing_id().alias("tag"),
        ),
        "sizes",
    )


def id_hash(id_value: Column) -> Column:
    return F.md5(F.coalesce(id_value.cast("string"), F.lit("")).cast("binary"))


def copy_positions(plan: DataFrame, schedule: dict[int, tuple[float, float]]) -> Column:
    """Array of the training positions of a document's copies, one per pass."""
    start = F.element_at(F.create_map(*[F.lit(x) for k, v in schedule.items() for x in (k, float(v[0]))]), F.col("weight").cast("int"))
    end = F.element_at(F.create_map(*[F.lit(x) for k, v in schedule.items() for x in (k, float(v[1]))]), F.col("weight").cast("int"))
    half = F.col("size") / 2

    def place(epoch: Column) -> Column:
        ahead = F.when(epoch < F.col("passes"), F.col("before")).otherwise(F.col("place"))
        asked = (epoch * F.col("source_size") + ahead + half) / F.greatest(F.col("target"), F.lit(1.0))
        return demand_position(F.least(asked, F.lit(1.0)), start, end)

    return F.when(
        F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), place)
    ).otherwise(F.array().cast("array<double>"))


def mix_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: int = MAX_EPOCHS,
    schedule: dict[int, tuple[float, float]] = SCHEDULE,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies, positions.

    Rows are range-sorted by their first position; documents not taken come last.
    """
    plan = mix_sizes(_sizes(df, id_col, text_col, source_col), max_epochs)
    placed = plan.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        "taken",
        "copies",
        copy_positions(plan, schedule).alias("positions"),
    )
    first = F.try_element_at("positions", F.lit(1))
    spread = F.coalesce(first, 1 + F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    return placed.repartitionByRange(spread).sortWithinPartitions(spread, id_col)


def training_order(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: int = MAX_EPOCHS,
    schedule: dict[int, tuple[float, float]] = SCHEDULE,
) -> DataFrame:
    """The rows of ``df`` in the order of training: each as often as the mix takes it, by position.

    Rows are matched to their plan by id, source and size, and rows that agree in
    all three by their number in the order of their texts' hashes, one to one. Rows
    and plan are dealt once by that key, and both numbering and matching are windows
    over this deal, so texts are shuffled twice: for it and for the order. The
    result's files, in the order of their names, hold the rows in order.
    """
    plan = mix_sizes(_sizes(df, id_col, text_col, source_col), max_epochs)
    row_text = lambda *parts: F.concat_ws("\x01", *[p.cast("string") for p in parts])
    whole = F.struct(*[column(df, c) for c in df.columns])
    empty = F.lit(None)
    planned = plan.select(
        row_text(F.col("key"), F.col("source"), F.col("size")).alias("row"),
        F.col("tag").alias("turn"),
        F.when(F.col("copies") > 0, copy_positions(plan, schedule)).alias("places"),
        empty.cast(df.schema).alias("whole"),
    )
    rows = df.select(
        row_text(
            id_hash(column(df, id_col)), source_key(column(df, source_col)), word_count(column(df, text_col))
        ).alias("row"),
        F.xxhash64(column(df, text_col)).alias("turn"),
        empty.cast(planned.schema["places"].dataType).alias("places"),
        whole.alias("whole"),
    )
    is_row = F.col("whole").isNotNull()
    dealt = rows.unionByName(planned).repartition("row").withColumn("is_row", is_row)
    numbered = dealt.withColumn("twin", F.row_number().over(Window.partitionBy("row", "is_row").orderBy("turn")))
    # of the two rows with a number, the plan's comes first
    matched = numbered.withColumn("places", F.lag("places").over(Window.partitionBy("row", "twin").orderBy("is_row")))
    place = free_name(df, "mix_position")
    return (
        matched.filter("is_row")
        .select("whole", F.explode("places").alias(place))
        .select("whole.*", place)
        .repartitionByRange(place)
        .sortWithinPartitions(place)
        .drop(place)
    )


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """The plan of each document, with its copies and the training position of the first (null: not taken)."""
    first = F.round(F.try_element_at("positions", F.lit(1)), 6)
    return mix_documents(read_table(spark, sf_dir, "documents")).withColumn("first_position", first).drop("positions")


def _op7_sql() -> str:
    def of_weight(place: int) -> str:
        return "CASE w " + " ".join(f"WHEN {k} THEN {v[place]}::double" for k, v in SCHEDULE.items()) + " END"

    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(doc_id::varchar, '')) AS key, row_number() OVER () AS tag
  FROM documents
), s AS (
  SELECT source, sum(size)::hugeint AS cap0, (row_number() OVER (ORDER BY source) - 1) % 3 + 1 AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, {MAX_EPOCHS} * cap0 AS cap,
         row_number() OVER (ORDER BY {MAX_EPOCHS} * cap0 / w::double, source) AS rk,
         sum(cap0) OVER () AS whole
  FROM s
), l AS (
  SELECT *, whole - coalesce(sum(cap) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
         sum(w) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
  FROM r
), open AS (
  SELECT min(rk) AS rk FROM l WHERE cap * weights_left > w * words_left
), t AS (
  SELECT l.source, w, cap0::bigint AS source_size,
         CASE WHEN l.rk < open.rk THEN cap::double
              ELSE (w * (SELECT words_left FROM l AS m WHERE m.rk = open.rk))::double
                   / (SELECT weights_left FROM l AS m WHERE m.rk = open.rk)::double END AS target
  FROM l, open
), t2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::bigint ELSE 0 END AS passes,
         floor(target - CASE WHEN source_size > 0 THEN floor(target / source_size)::bigint ELSE 0 END * source_size)::bigint AS partial
  FROM t
), p AS (
  SELECT d.*, t2.* EXCLUDE (source),
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size, tag
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         row_number() OVER (PARTITION BY d.source ORDER BY key, doc_id, size, tag) AS turn
  FROM d JOIN t2 USING (source)
), f AS (  -- through the documents of each source in order: one that fits the gap is taken
  SELECT source, 0::bigint AS turn, partial AS gap, NULL::bigint AS tag, 0::bigint AS extra, 0::bigint AS place FROM t2
  UNION ALL
  SELECT p.source, p.turn, gap - CASE WHEN p.size <= gap THEN p.size ELSE 0 END, p.tag,
         (p.size <= gap)::bigint, p.partial - gap
  FROM f JOIN p ON p.source = f.source AND p.turn = f.turn + 1
), m AS (
  SELECT p.*, CASE WHEN size > 0 THEN passes + extra ELSE 0 END AS copies, {of_weight(0)} AS s, {of_weight(1)} AS e,
         (CASE WHEN passes > 0 THEN before ELSE place END + size / 2) / greatest(target, 1.0) AS asked
  FROM p JOIN f USING (tag)
), a AS (
  SELECT *, least(asked, 1.0) * (s + e) / 2 AS demand, (e - s) / 2 AS slope FROM m
)
SELECT doc_id, size::bigint AS size, source_size, target, (size * copies)::bigint AS taken, copies,
       CASE WHEN copies > 0 THEN round(CASE WHEN abs(slope) < 1e-12 THEN demand / s
            ELSE 2 * demand / (s + sqrt(greatest(s * s + 4 * slope * demand, 0.0))) END, 6) END AS first_position
FROM a
"""


OP7_SQL = _op7_sql()
