"""Exact de-duplication with the frequent digests split off.

Two texts are equal when they are identical after every run of white space
became one space. Their digests are compared instead of the texts. A digest that
many rows share would send all of them to one task of a shuffle, so:

1. each partition keeps a Misra-Gries summary of ``counters`` digests, and the
   summaries are merged by adding counters;
2. the merged candidates are counted exactly (they are a bounded set that is
   broadcast; each task sends one partial count per candidate);
3. the verified frequent digests, with the row that stays, are broadcast and
   joined on the map side; no row of theirs is shuffled;
4. the other digests, each with at most a known share of the rows, go through an
   ordinary shuffle.

Defined cases: a null text counts as empty, so null and empty texts are equal to
each other; a null id sorts after every other id; rows repeated whole count as
members, and only one of them stays; an empty table gives an empty result; other
columns, whatever their names, are ignored by ``exact_duplicates`` and kept by
``drop_exact_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.tables import column, free_name, materialize

COUNTERS = 1_000  # digests a Misra-Gries summary holds; bounds every broadcast here


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text with every white-space run as one space."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(spaced.cast("binary"), 256)


def misra_gries(values: Iterator, counters: int) -> dict:
    """At most ``counters`` values with lower bounds of their counts.

    A value's count is short by at most n / (counters + 1) of the n values seen.
    """
    kept: dict = {}
    for value in values:
        if value in kept:
            kept[value] += 1
        elif len(kept) < counters:
            kept[value] = 1
        else:
            for key in [k for k, n in kept.items() if n == 1]:
                del kept[key]
            for key in kept:
                kept[key] -= 1
    return kept


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates (digest, at_least): every digest with over 3 n / counters of the n rows is there.

    A partition's summary misses at most its rows / counters of a digest, and it
    passes on only counters above that, so the sum over partitions misses at most
    2 n / counters. Sums above n / counters are kept: all that the promise names,
    and fewer than ``counters`` digests can have such a sum.
    """
    (name,) = digests.columns

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (v for b in batches for v in b.column(0).to_pylist())
        seen = 0

        def counted():
            nonlocal seen
            for v in rows:
                seen += 1
                yield v

        kept = misra_gries(counted(), counters)
        kept = {k: c for k, c in kept.items() if c * counters > seen}
        # a row of its own carries the number of rows seen
        yield pa.RecordBatch.from_arrays(
            [pa.array([*kept, None], pa.string()), pa.array([*kept.values(), seen], pa.int64())],
            names=["digest", "at_least"],
        )

    sums = (
        digests.select(column(digests, name).alias("digest"))
        .mapInArrow(summarise, "digest string, at_least long")
        .groupBy("digest")
        .agg(F.sum("at_least").alias("at_least"))
    )
    sums = materialize(sums, "misra-gries")
    n = sums.filter("digest is null").agg(F.coalesce(F.sum("at_least"), F.lit(0))).first()[0]
    return sums.filter(F.col("digest").isNotNull() & (F.col("at_least") * counters > n))


def _first_row(id_col: str, tag: str) -> Column:
    """The smallest of (id is null, id, row tag): the row of a group that stays."""
    return F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col(tag).alias("t")))


def exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep_id`` is the smallest id among equal texts, ``kept`` is true for exactly
    one row of each group.
    """
    rows = materialize(
        df.select(
            column(df, id_col).alias("id"),
            text_digest(column(df, text_col)).alias("digest"),
            F.monotonically_increasing_id().alias("tag"),
        ),
        "digests",
    )
    candidates = frequent_digests(rows.select("digest"), counters)
    winners = materialize(
        rows.join(F.broadcast(candidates.select("digest")), "digest")
        .groupBy("digest")
        .agg(_first_row("id", "tag").alias("first"), F.count(F.lit(1)).alias("size")),
        "frequent",
    )
    frequent = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(
        _first_row("id", "tag").alias("first"), F.count(F.lit(1)).alias("size")
    )
    both = frequent.unionByName(rest.join(groups, "digest"))
    return both.select(
        F.col("id").alias(id_col),
        F.col("first.i").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("tag") == F.col("first.t")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Copies of frequent digests other than those with the smallest id go on the
    map side; what is left has small groups and is grouped by digest.
    """
    digest, whole = free_name(df, "digest"), free_name(df, "whole")
    digests = materialize(
        df.select(column(df, id_col).alias("id"), text_digest(column(df, text_col)).alias("digest")),
        "digests",
    )
    candidates = frequent_digests(digests.select("digest"), counters)
    winners = materialize(
        digests.join(F.broadcast(candidates.select("digest")), "digest")
        .groupBy("digest")
        .agg(F.min("id").alias("keep")),
        "frequent",
    ).select(F.col("digest").alias("frequent_digest"), "keep")
    marked = df.select(
        F.struct(*[column(df, c) for c in df.columns]).alias(whole),
        text_digest(column(df, text_col)).alias(digest),
    )
    whole_id = F.col(whole).getField(id_col)
    left = marked.join(F.broadcast(winners), F.col(digest) == F.col("frequent_digest"), "left").filter(
        F.col("frequent_digest").isNull() | whole_id.eqNullSafe(F.col("keep"))
    )
    return (
        left.groupBy(digest)
        .agg(F.min_by(F.col(whole), F.struct(whole_id.isNull(), whole_id)).alias(whole))
        .select(f"{whole}.*")
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from innsight.llm.tables import read_table

    return exact_duplicates(read_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256)
"""
