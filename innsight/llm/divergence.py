"""Source divergence audit with hash-consed segment trees over term ids.

Every language has its terms, numbered from the most frequent to the rarest, and
every source of the language has a count for each term. A source's counts are
the leaves of a segment tree. Trees are hash-consed: a node is known by its two
children, a leaf by its count, so equal subtrees are one node, within a tree and
between the trees of all sources -- the long tail of terms that a source lacks
is a handful of nodes. Two sources are compared by walking both trees at once,
from the root down; a pair of nodes that comes up several times is followed
once, with the number of times it came up, and a pair of leaf counts is priced
once.

The price of a pair of counts is floor((p - q)^2 / (p + q)), where p and q are
the smoothed shares of the term in the two sources, in billionths.

Spark counts terms per document part, adds the counts up by (lang, source,
term), and cuts each language's term ids into subtrees of ``CHUNK`` leaves and
its sources into tiles of ``TILE``. A task holds one subtree of two tiles;
what it finds is added up over the subtrees. So neither a language with many
terms nor one with many sources, nor a source with a third of all documents,
ends in one task.

Defined cases: a null text, language or source counts as ''; texts without terms
still make their group; a language without kept terms has pairs of value 0 and
no terms; rows repeated whole count as documents; an empty table gives an empty
result; texts of any length are counted piece by piece; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm.tables import binary_values, column, materialize, read_table
from innsight.llm.vectors import numbered

MIN_DOCUMENTS = 10  # a language keeps the terms of at least so many of its documents
TOP_TERMS = 10
BILLION = 1_000_000_000
CHUNK = 4_096  # term ids of a subtree, a power of two
TILE = 32  # sources of a tile
PAIRS_AT_ONCE = 128
PIECE = 1 << 20  # bytes of a text that are split at once
HELD_TERMS = 200_000  # counts a task holds before it passes them on

# every byte that is no part of a term becomes a space, A-Z becomes a-z
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def text_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; a piece ends between terms."""
    clean, start = text.translate(_TERM_BYTES), 0
    while start < len(clean):
        end = clean.find(b" ", start + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end


def term_counts(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a null term for each group."""
    text_of = lambda name: F.coalesce(column(df, name).cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def pass_on() -> pa.RecordBatch:
            rows = [
                (lang, source, term, n, docs[term])
                for (lang, source), (occurrences, docs) in counts.items()
                for term, n in [(None, 0), *occurrences.items()]
            ]
            counts.clear()
            lang, source, term, n, docs = zip(*rows) if rows else [()] * 5
            return pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array(lang, pa.string()),
                    "source": pa.array(source, pa.string()),
                    "term": pa.array(term, pa.binary()).view(pa.string()),
                    "n": pa.array(n, pa.int64()),
                    "docs": pa.array(docs, pa.int64()),
                }
            )

        held, size = 0, 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, binary_values(batch.column("text"))):
                occurrences, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                before, terms = len(occurrences), set()
                for words in text_pieces(text):
                    occurrences.update(words)
                    terms.update(words)
                docs.update(terms)
                held += len(occurrences) - before
                size += len(text)
                if held > HELD_TERMS or size > 64 * PIECE:
                    yield pass_on()
                    held = size = 0
        yield pass_on()

    parts = df.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    parts = parts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, whole: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (whole + 2 terms)), digit by digit so that nothing overflows."""
    below = whole + 2 * terms
    out, rest = np.divmod(counts + 2, below)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digits
    return out + 1


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class ConsedTrees:
    """Segment trees over the rows of a count matrix, equal subtrees shared.

    Columns are filled up to a power of two with leaves of count -1, which price
    at nothing.
    """

    def __init__(self, counts: np.ndarray) -> None:
        width = 1 << max(0, counts.shape[1] - 1).bit_length()
        leaves = np.full((counts.shape[0], width), -1, dtype=np.int64)
        leaves[:, : counts.shape[1]] = counts
        self.counts, at = np.unique(leaves, return_inverse=True)
        at = at.reshape(leaves.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # children of each level's nodes, from the leaves up
        size = len(self.counts)
        while at.shape[1] > 1:
            nodes, inverse = np.unique(at[:, ::2] * size + at[:, 1::2], return_inverse=True)
            self.levels.append((nodes // size, nodes % size))
            at = inverse.reshape(at.shape[0], -1)
            size = len(nodes)
        self.roots = at[:, 0]

    def leaf_pairs(self, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, count, count, times): each pair of leaf counts of the trees ``one[i]`` and ``other[i]``, once."""
        pair, times = np.arange(len(one)), np.ones(len(one), dtype=np.int64)
        a, b = self.roots[one], self.roots[other]
        for level in range(len(self.levels) - 1, -1, -1):
            left, right = self.levels[level]
            size = len(self.levels[level - 1][0]) if level else len(self.counts)
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            key = (np.concatenate([pair, pair]) * size + a) * size + b
            order = np.argsort(key, kind="stable")
            key, times = key[order], np.concatenate([times, times])[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, times = key[first], np.add.reduceat(times, first)
            pair, a, b = key // (size * size), key // size % size, key % size
        return pair, self.counts[a], self.counts[b], times


def tile_pair_values(
    rows: np.ndarray, wholes: np.ndarray, one: np.ndarray, other: np.ndarray, terms: int
) -> np.ndarray:
    """Sum of prices over the columns of the count matrix for each pair (one[i], other[i]) of its rows."""
    out = np.zeros(len(one), dtype=np.int64)
    if not rows.shape[1]:
        return out
    trees = ConsedTrees(rows)
    for start in range(0, len(one), PAIRS_AT_ONCE):
        some = slice(start, start + PAIRS_AT_ONCE)
        pair, a, b, times = trees.leaf_pairs(one[some], other[some])
        there = a >= 0
        pair, a, b, times = pair[there], a[there], b[there], times[there]
        below_one, below_other = wholes[one[some]][pair], wholes[other[some]][pair]
        price = prices(shares(a, below_one, terms), shares(b, below_other, terms))
        np.add.at(out[some], pair, price * times)
    return out


def count_matrix(blocks: list[dict | None], sizes: list[int], width: int) -> np.ndarray:
    """Counts by (source, term) of the tiles' blocks; a block that is missing holds zeros."""
    out = np.zeros((sum(sizes), width), dtype=np.int64)
    top = 0
    for block, size in zip(blocks, sizes):
        if block is not None:
            slot, leaf = (np.frombuffer(block[x], dtype=np.int32) for x in ("slots", "leaves"))
            out[top + slot, leaf] = np.frombuffer(block["counts"], dtype=np.int64)
        top += size
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two tiles' blocks of a subtree: the value of each pair of sources."""
    for batch in batches:
        for row in batch.to_pylist():
            width = min(CHUNK, row["terms"] - row["chunk"] * CHUNK)
            same = row["tile"] == row["other_tile"]
            sizes = [len(row["wholes"])] if same else [len(row["wholes"]), len(row["other_wholes"])]
            wholes = np.array(row["wholes"] if same else row["wholes"] + row["other_wholes"], dtype=np.int64)
            counts = count_matrix([row["block"]] if same else [row["block"], row["other_block"]], sizes, max(0, width))
            if same:
                one, other = np.triu_indices(sizes[0], 1)
            else:
                one, other = (x.ravel() for x in np.meshgrid(np.arange(sizes[0]), np.arange(sizes[0], sum(sizes)), indexing="ij"))
            values = tile_pair_values(counts, wholes, one, other, row["terms"])
            number = np.concatenate(
                [row["tile"] * TILE + np.arange(sizes[0]), row["other_tile"] * TILE + np.arange(sum(sizes[1:]))]
            ).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([row["lang"]] * len(one), pa.string()),
                    "one": pa.array(number[one]),
                    "other": pa.array(number[other]),
                    "value": pa.array(values),
                }
            )


def _leading(top: int):
    """Rows of one tile's block of a subtree with the language's counts: each source's best terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                slots, leaves = (np.frombuffer(row["block"][x], dtype=np.int32) for x in ("slots", "leaves"))
                counts = np.frombuffer(row["block"]["counts"], dtype=np.int64)
                totals, turns = np.array(row["totals"], dtype=np.int64), np.array(row["turns"], dtype=np.int64)
                wholes = np.array(row["wholes"], dtype=np.int64)
                # equal pairs of counts have one price
                keys = np.stack([slots.astype(np.int64), counts, totals[leaves]])
                distinct, at = np.unique(keys, axis=1, return_inverse=True)
                p = shares(distinct[1], wholes[distinct[0]], row["terms"])
                q = shares(distinct[2], row["whole"], row["terms"])
                value = np.where(p > q, prices(p, q), -1)[at.ravel()]
                order = np.lexsort((turns[leaves], -value, slots))
                order = order[value[order] >= 0]
                slot = slots[order]
                starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, dtype=np.int64)
                rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
                best = order[rank < top]
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([row["lang"]] * len(best), pa.string()),
                        "number": pa.array(row["tile"] * TILE + slots[best].astype(np.int64)),
                        "id": pa.array(row["chunk"] * CHUNK + leaves[best].astype(np.int64)),
                        "value": pa.array(value[best]),
                    }
                )

    return run


def _packed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = []
        for cells in batch.column("cells"):
            items = cells.values
            get = lambda name, kind: items.field(name).to_numpy().astype(kind).tobytes()  # noqa: B023, E731
            blocks.append({"slots": get("slot", np.int32), "leaves": get("leaf", np.int32), "counts": get("n", np.int64)})
        yield pa.RecordBatch.from_pydict(
            {name: batch.column(name) for name in ("lang", "chunk", "tile")}
            | {"block": pa.array(blocks, pa.struct([("slots", pa.binary()), ("leaves", pa.binary()), ("counts", pa.binary())]))}
        )


def _from_first(rows: DataFrame) -> DataFrame:
    """Replace ``place`` by ``number``, which starts from 0 in each language."""
    first = rows.groupBy("lang").agg(F.min("place").alias("first"))
    return rows.join(first, "lang").withColumn("number", F.col("place") - F.col("first")).drop("place", "first")


def source_divergence(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from the others, and by which terms.

    Part ``pair``: the other sources, by value. Part ``term``: the ``top_terms``
    terms that the source uses more than its language, by what they add.
    """
    counts = materialize(term_counts(df, text_col, lang_col, source_col), "term-counts")
    kept = (
        counts.filter(F.col("term").isNotNull())
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= min_documents)
        .withColumn("falling", -F.col("total"))
    )
    kept = _from_first(numbered(kept, ["lang", "falling", "term"], "terms-order"))
    kept = materialize(kept.select("lang", "term", "total", F.col("number").alias("id")), "terms")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("whole"))

    cells = materialize(counts.join(kept.select("lang", "term", "id"), ["lang", "term"]).select("lang", "source", "id", "n"), "cells")
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    groups = counts.filter(F.col("term").isNull()).select("lang", "source")
    groups = _from_first(numbered(groups, ["lang", "source"], "groups-order"))
    groups = materialize(
        groups.join(sums, ["lang", "source"], "left")
        .join(of_lang.select("lang", "terms"), "lang", "left")
        .select(
            "lang",
            "source",
            "number",
            F.floor(F.col("number") / TILE).cast("long").alias("tile"),
            (F.col("number") % TILE).cast("int").alias("slot"),
            F.coalesce("whole", F.lit(0)).alias("whole"),
            F.coalesce("terms", F.lit(0)).alias("terms"),
        ),
        "groups",
    )
    blocks = (
        cells.join(groups.select("lang", "source", "tile", "slot"), ["lang", "source"])
        .select(
            "lang", "tile", "slot", "n",
            F.floor(F.col("id") / CHUNK).cast("long").alias("chunk"), (F.col("id") % CHUNK).cast("int").alias("leaf"),
        )
        .groupBy("lang", "chunk", "tile")
        .agg(F.collect_list(F.struct("slot", "leaf", "n")).alias("cells"))
        .mapInArrow(
            _packed_counts, "lang string, chunk long, tile long, block struct<slots: binary, leaves: binary, counts: binary>"
        )
    )
    blocks = materialize(blocks, "count-blocks")
    tiles = materialize(
        groups.groupBy("lang", "tile", "terms")
        .agg(F.sort_array(F.collect_list(F.struct("slot", "whole"))).alias("sources"))
        .select("lang", "tile", "terms", F.col("sources.whole").alias("wholes")),
        "tiles",
    )

    # each pair of tiles of a language, once, for each of its subtrees
    last_tile = tiles.groupBy("lang").agg(F.max("tile").alias("last_tile"))
    last_chunk = F.greatest(F.lit(0), F.floor((F.col("terms") - 1) / CHUNK)).cast("long")
    work = (
        tiles.join(last_tile, "lang")
        .select("lang", "tile", "terms", "wholes", F.explode(F.sequence("tile", "last_tile")).alias("other_tile"))
        .join(tiles.select("lang", F.col("tile").alias("other_tile"), F.col("wholes").alias("other_wholes")), ["lang", "other_tile"])
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)))
        .join(blocks, ["lang", "chunk", "tile"], "left")
        .join(blocks.select("lang", "chunk", F.col("tile").alias("other_tile"), F.col("block").alias("other_block")), ["lang", "chunk", "other_tile"], "left")
    )
    values = work.mapInArrow(_compare, "lang string, one long, other long, value long")
    values = values.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("one").alias("number"), F.col("other").alias("to")), F.struct(F.col("other").alias("number"), F.col("one").alias("to"))))
    names = groups.select("lang", "number", "source")
    pairs = (
        values.select("lang", "value", both.alias("ends"))
        .select("lang", "value", "ends.number", "ends.to")
        .join(names, ["lang", "number"])
        .join(names.select("lang", F.col("number").alias("to"), F.col("source").alias("item")), ["lang", "to"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )

    # the language's own counts by subtree, with the order of its terms by code point
    turn = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term"))
    of_chunk = (
        kept.withColumn("chunk", F.floor(F.col("id") / CHUNK).cast("long"))
        .withColumn("turn", turn)
        .groupBy("lang", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("id", "total", "turn"))).alias("all"))
        .select("lang", "chunk", F.col("all.total").alias("totals"), F.col("all.turn").alias("turns"))
    )
    terms = (
        blocks.join(of_chunk, ["lang", "chunk"])
        .join(tiles.select("lang", "tile", "wholes"), ["lang", "tile"])
        .join(of_lang, "lang")
        .mapInArrow(_leading(top_terms), "lang string, number long, id long, value long")
        .join(kept.select("lang", "id", F.col("term").alias("item")), ["lang", "id"])
        .join(names, ["lang", "number"])
        .select("lang", "source", F.lit("term").alias("part"), "item", "value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top_terms))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS text
  FROM documents
), t AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCUMENTS}
), groups AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n
  FROM groups AS g JOIN kept AS k USING (lang) LEFT JOIN c USING (lang, source, term)
), gp AS (
  SELECT *, (1 + {BILLION}::hugeint * (n + 2) // (sum(n) OVER (PARTITION BY lang, source)
             + 2 * count(*) OVER (PARTITION BY lang, source)))::bigint AS p
  FROM p
), l AS (
  SELECT lang, term, sum(n) AS n FROM p GROUP BY lang, term
), lq AS (
  SELECT lang, term, (1 + {BILLION}::hugeint * (n + 2) // (sum(n) OVER (PARTITION BY lang)
                      + 2 * count(*) OVER (PARTITION BY lang)))::bigint AS q
  FROM l
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint AS value
  FROM gp AS a JOIN gp AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM gp JOIN lq USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::int AS rank FROM pairs
UNION ALL
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::int AS rank FROM terms
QUALIFY rank <= {TOP_TERMS}
"""
