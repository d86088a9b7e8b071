"""Near-duplicates by MinHash bands, odd sketches and exact confirmation.

A document's set is its distinct word shingles, as 64-bit hashes. Two documents
are linked when their sets' similarity reaches the threshold; a link is only
made after the full sets were compared.

1. Documents with equal sets form a class; from here on only classes count.
2. Each class gets ``SAMPLES`` minimum hashes. Bands of ``ROWS`` of them are the
   bucket keys, as many bands as it takes for a pair at the threshold to miss
   every bucket with probability under ``MISS`` (24 at a similarity of 0.85).
3. All samples are folded into an odd sketch: sample i with value v toggles one
   of ``BITS`` bits. The bits in which two sketches differ estimate how many
   samples differ, and so the similarity; it is the more precise the higher the
   similarity. Bucket mates whose estimate is below the threshold by more than
   ``MARGIN`` (over five standard deviations) are not compared further.
4. What passes links classes to blocks. A bucket gives one link per member, to
   the smallest of the members joined with it, never all pairs; blocks are
   connected components, so any two classes that must be compared are in one.
5. Inside a block, classes not yet joined are compared on their full sets, and
   the confirmed links give the components of the result.

Buckets and blocks of more than ``TILE`` members are dealt into tiles, and the
pairs of tiles go to different tasks, so no task holds more than two tiles (a
member of a group of N is copied N / TILE times). Joins by bucket, block or class
keep frequent keys apart.

Defined cases: a text with fewer words than a shingle is one shingle of all its
words; null texts and texts without words have an empty set and link with
nothing; rows with a null id link with nothing and have a null component; rows
repeated whole share a class; an empty table gives an empty result; other
columns are ignored by ``near_duplicates`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.components import connected_components
from innsight.llm.tables import (
    binary_values,
    column,
    free_name,
    group_bounds,
    materialize,
    read_table,
    releasing,
    sorted_groups,
    worker_state,
)
from innsight.plans.joins import join_split

SAMPLES, ROWS = 192, 5
MISS = 1e-6
BITS = 512
MARGIN = 0.17
TILE = 256
CACHED_WORDS = 200_000  # word hashes a worker keeps


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], cache: dict) -> np.ndarray:
    """64-bit hashes of words, looked up in a bounded cache."""
    if len(cache) > CACHED_WORDS:
        cache.clear()
    out = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingle_set(text: bytes, width: int, cache: dict) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``width`` words; A-Z count as a-z."""
    words = text.lower().split()  # on bytes: lowers A-Z only, splits at 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words, cache)
    n = max(1, len(hashes) - width + 1)
    span = min(width, len(hashes))
    out = np.full(n, span, np.uint64)
    for k in range(span):
        out = _mix(out + hashes[k : k + n])
    return np.unique(out)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minimum_hashes(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of SAMPLES hash functions."""
    best = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        part = shingles[None, start : start + 2048] * multipliers[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def band_count(similarity: float) -> int:
    """Bands after which a pair of that similarity has missed every bucket with probability MISS."""
    needed = int(np.ceil(np.log(MISS) / np.log(1 - similarity**ROWS)))
    if needed * ROWS > SAMPLES:
        raise ValueError(f"a similarity of {similarity} needs {needed * ROWS} samples; there are {SAMPLES}")
    return needed


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit bucket key per band."""
    rows = samples[: bands * ROWS].reshape(bands, ROWS)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key + rows[:, r])
    return key


def odd_sketch(samples: np.ndarray) -> bytes:
    """Parity bitmap: each (sample number, value) toggles one of BITS bits."""
    place = _mix(samples + np.arange(len(samples), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = np.bincount((place % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def most_differing_bits(similarity: float) -> int:
    """How many bits two odd sketches of that similarity differ in on average."""
    return int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - similarity) / BITS)))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def describe_sets(df: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(id, n, set_key, bands, sketch) per row: everything but the set itself."""
    per_set = band_count(similarity)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, multipliers = worker_state("word_hashes", dict), _multipliers()
        for batch in batches:
            n, keys, bands, sketches = [], [], [], []
            for text in binary_values(batch.column("text")):
                s = shingle_set(text, width, cache)
                n.append(len(s))
                if len(s):
                    samples = minimum_hashes(s, multipliers)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(_signed(band_keys(samples, per_set)))
                    sketches.append(odd_sketch(samples))
                else:
                    keys.append(None)
                    bands.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(n, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                names=["id", "n", "set_key", "bands", "sketch"],
            )

    rows = df.select(
        column(df, id_col).cast("long").alias("id"), column(df, text_col).cast("binary").alias("text")
    )
    return rows.mapInArrow(releasing(describe), "id long, n long, set_key binary, bands array<long>, sketch binary")


def tile_pairs(members: Column, row: Column) -> Column:
    """Array of the (lo, hi, own) tile pairs that a member of a group of that size belongs to."""
    tiles = F.ceil(members / F.lit(TILE)).cast("int")
    own = F.pmod(F.xxhash64(row), tiles).cast("int")
    return F.transform(
        F.sequence(F.lit(0), tiles - 1),
        lambda t: F.struct(
            F.least(own, t).alias("lo"), F.greatest(own, t).alias("hi"), own.alias("own")
        ),
    )


def join_parts(ids: np.ndarray, same_side: np.ndarray | None, near, confirm) -> list[tuple[int, int]]:
    """Links of the parts of a group: each row with the smallest id of its part, as (smallest, id).

    ``near(i, js)`` keeps those of the rows js that may link with row i,
    ``confirm(i, j)`` decides; rows already in one part are not compared.
    ``same_side`` (for two different tiles) names each row's tile; only rows of
    different tiles are compared, as each tile also meets itself. Linking to the
    smallest id makes the buckets of one group give the same links.
    """
    size = len(ids)
    part = np.arange(size)
    for i in range(size - 1):
        js = np.arange(i + 1, size)
        js = js[part[js] != part[i]]
        if same_side is not None:
            js = js[same_side[js] != same_side[i]]
        for j in near(i, js) if len(js) else ():
            if part[j] != part[i] and confirm(i, j):
                part[part == part[j]] = part[i]
    smallest = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(smallest, part, ids)
    return [(int(s), int(i)) for s, i in zip(smallest[part], ids, strict=True) if s != i]


def _sketch_rows(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), BITS // 64)


def _differing_bits(sketches: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketches[js] ^ sketches[i]).sum(axis=1)


def _tile_of(group: pa.Table) -> np.ndarray | None:
    if group.column("lo")[0].as_py() == group.column("hi")[0].as_py():
        return None
    return group.column("own").to_numpy()


def candidate_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) whose components hold every pair of classes that may reach ``similarity``."""
    most = most_differing_bits(similarity - MARGIN)
    rows = classes.select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = materialize(shared, "buckets")
    mates = join_split(rows, shared, "bucket").join(classes.select("id", "sketch"), "id")
    tiled = mates.select("bucket", "id", "sketch", F.explode(tile_pairs(F.col("members"), F.col("id"))).alias("t"))
    tiled = tiled.select("bucket", "t.lo", "t.hi", "t.own", "id", "sketch")
    keys = ["bucket", "lo", "hi"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, keys):
            bounds = group_bounds(table, keys)
            ids = table.column("id").to_numpy()
            sketches = _sketch_rows(table.column("sketch").to_pylist())
            first = bounds[:-1][np.diff(bounds) == 2]  # buckets of two, all at once
            tile = table.column("own").to_numpy()
            one_tile = table.column("lo").to_numpy() == table.column("hi").to_numpy()
            met = one_tile[first] | (tile[first] != tile[first + 1])
            close = np.bitwise_count(sketches[first] ^ sketches[first + 1]).sum(axis=1) <= most
            first = first[met & close]
            a, b = [ids[first]], [ids[first + 1]]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 2:
                    own = sketches[lo:hi]
                    links = join_parts(
                        ids[lo:hi],
                        _tile_of(table.slice(lo, hi - lo)),
                        lambda i, js, own=own: js[_differing_bits(own, i, js) <= most],
                        lambda i, j: True,
                    )
                    if links:
                        pairs = np.array(links)
                        a.append(pairs[:, 0])
                        b.append(pairs[:, 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"]
            )

    return (
        tiled.repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(releasing(link), "a long, b long")
        .filter("a <> b")
        .distinct()
    )


def confirmed_links(
    df: DataFrame, blocks: DataFrame, id_col: str, text_col: str, width: int, percent: int
) -> DataFrame:
    """Links (a, b) of rows in one block whose full sets reach ``percent`` of their union."""
    most = most_differing_bits(percent / 100 - MARGIN)
    sizes = blocks.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    members = materialize(join_split(blocks, materialize(sizes, "sizes"), "component"), "blocks")
    texts = df.select(
        column(df, id_col).cast("long").alias("node"), column(df, text_col).cast("binary").alias("text")
    ).join(members, "node")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, multipliers = worker_state("word_hashes", dict), _multipliers()
        for batch in batches:
            sets = [shingle_set(t, width, cache) for t in binary_values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("component"),
                    batch.column("members"),
                    pa.array([odd_sketch(minimum_hashes(s, multipliers)) for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["node", "component", "members", "sketch", "shingles"],
            )

    sets = texts.select("node", "component", "members", "text").mapInArrow(
        to_sets, "node long, component long, members long, sketch binary, shingles binary"
    )
    tiled = sets.select(
        "component", "node", "sketch", "shingles", F.explode(tile_pairs(F.col("members"), F.col("node"))).alias("t")
    ).select("component", "t.lo", "t.hi", "t.own", "node", "sketch", "shingles")
    keys = ["component", "lo", "hi"]

    def confirm_group(group: pa.Table) -> list[tuple[int, int]]:
        own = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        sketches = _sketch_rows(group.column("sketch").to_pylist())
        length = np.array([len(s) for s in own])

        def near(i: int, js: np.ndarray) -> np.ndarray:
            small, large = np.minimum(length[js], length[i]), np.maximum(length[js], length[i])
            js = js[100 * small >= percent * large]
            return js[_differing_bits(sketches, i, js) <= most] if len(js) else js

        def confirm(i: int, j: int) -> bool:
            both = np.concatenate([own[i], own[j]])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            return 100 * shared >= percent * (len(both) - shared)

        return join_parts(group.column("node").to_numpy(), _tile_of(group), near, confirm)

    def confirm_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, keys):
            bounds = group_bounds(table, keys)
            links = [
                link
                for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)
                for link in confirm_group(table.slice(lo, hi - lo))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"]
            )

    return (
        tiled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(releasing(confirm_all), "a long, b long")
    )


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Ids are whole numbers. Links need ``100 * intersection >= percent * union``;
    ``component_id`` is the smallest id reached over links and equal sets.
    """
    sets = materialize(describe_sets(df, id_col, text_col, width, percent / 100), "sets")
    classes = materialize(
        sets.filter("n > 0 and id is not null")
        .groupBy("set_key")
        .agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    candidates = materialize(candidate_links(classes, percent / 100), "candidates")
    blocks = materialize(connected_components(candidates), "blocks-of-classes")
    links = materialize(confirmed_links(df, blocks, id_col, text_col, width, percent), "confirmed")
    components = connected_components(links)
    of_class = classes.join(components, F.col("id") == F.col("node"), "left").select(
        "set_key", F.coalesce("component", "id").alias("component")
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    of_class = materialize(of_class, "of-class")
    return join_split(sets.select("id", "n", "set_key"), of_class, "set_key", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``df`` that stay: of each component the one with the smallest id, null ids last.

    Rows are told apart by a number of their own, so ids may repeat, be null or be
    texts; of rows with the smallest id one stays, and rows of one id whose texts
    are unlike do not touch each other.
    """
    tag = free_name(df, "row")
    tagged = materialize(df.select("*", F.monotonically_increasing_id().alias(tag)), "tagged")
    found = near_duplicates(tagged.select(tag, column(tagged, text_col).alias("text")), tag, "text", width, percent)
    id_value = tagged.select(F.col(tag), column(tagged, id_col).alias("id"))
    members = materialize(
        found.filter("n_shingles > 0").select(tag, "component_id").join(id_value, tag), "near-copies"
    )
    keeper = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", tag))[tag].alias("keeper"))
    keeper = materialize(keeper, "keepers")
    gone = join_split(members, keeper, "component_id").filter(F.col(tag) != F.col("keeper")).select(tag)
    return tagged.join(gone, tag, "left_anti").drop(tag)


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(ws[i:i+2]) AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents AS d
LEFT JOIN n USING (doc_id)
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) AS r ON r.a = d.doc_id
"""
