"""Lempel-Ziv phrase fingerprints: how alike two texts are to a compressor.

A text is parsed into phrases as the LZ78 compressor does: from the current
place, the longest phrase already in the dictionary plus one more symbol becomes
a new phrase. Symbols are words, cut after every four code points whose hash
says so: text written without spaces falls into pieces that depend on the letters
around them and not on where the text begins, and a word is cut alike wherever it
stands. The phrase set is what a compressor would know after the text, so texts
with common passages have common phrases. The set's minimum hashes are the
fingerprint, and the share of equal ones estimates the sets' similarity.

``compare_with_next`` also fingerprints an edited text, whose second half comes
from the next document in descending order of ids. The documents are dealt into
ranges of ids; the first document of each range is also sent to the range before
it, so each task has every neighbour and only ranges, never the table, are
sorted in one task.

Defined cases: a null text counts as empty; an empty text and one of white space
have an empty phrase set, whose fingerprints are equal to each other and to no
other; null ids come last; rows with equal ids are ordered by a hash of their
text; a single document is its own next; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.near_dedup import _mix, word_hashes
from innsight.llm.tables import column, read_table, worker_state

SAMPLES = 128  # minimum hashes per fingerprint, of which 16 bits are kept
WINDOW = 4  # code points that decide on a cut after them
CUT_ONE_IN = 16  # windows with a cut, a power of two
BLOCK = 1 << 20  # code points looked through at a time
_K, _M = 0x9E3779B97F4A7C15, (1 << 64) - 1


_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def cut_places(text: str) -> list[int]:
    """Places inside words before which a new symbol begins: the WINDOW code points before hash to a cut."""
    places: list[int] = []
    for start in range(0, len(text), BLOCK):
        part = text[start : start + BLOCK + WINDOW]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        windows = len(codes) - WINDOW  # each with one code point after it
        if windows <= 0:
            break
        hashed = np.zeros(windows, np.uint32)
        for k in range(WINDOW):
            hashed = (hashed ^ codes[k : k + windows]) * np.uint32(0x9E3779B1)
            hashed ^= hashed >> np.uint32(15)
        found = np.flatnonzero(hashed % np.uint32(CUT_ONE_IN) == 0)
        around = codes[found[:, None] + np.arange(WINDOW + 1)]
        found = found[~np.isin(around, _SPACES).any(axis=1)]
        places.extend((found + (start + WINDOW)).tolist())
    return places


def symbols(text: str) -> list[bytes]:
    """The words of a text, cut where their letters say so."""
    places = cut_places(text)
    if places:
        text = " ".join([text[a:b] for a, b in zip([0, *places], [*places, len(text)], strict=True)])
    return [w.encode("utf-8", "surrogatepass") for w in text.split()]


def phrase_set(hashes: list[int]) -> set[int]:
    """Hashes of the phrases of the LZ78 parse of a sequence of symbols.

    A phrase's hash follows from the phrase it extends and its last symbol.
    """
    known: set[int] = set()
    phrase = 0
    for symbol in hashes:
        longer = (((phrase << 1) ^ symbol) * _K) & _M
        if longer in known:
            phrase = longer
        else:
            known.add(longer)
            phrase = 0
    return known


def fingerprint(text: str, cache: dict, multipliers: np.ndarray) -> np.ndarray:
    """SAMPLES 16-bit minimum hashes of the text's phrases; empty for an empty set."""
    known = phrase_set(word_hashes(symbols(text), cache).tolist())
    if not known:
        return np.zeros(0, np.uint16)
    values = _mix(np.fromiter(known, np.uint64, len(known)))
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), 2048):
        part = values[None, start : start + 2048] * multipliers[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return (_mix(best) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated similarity of two phrase sets; two empty sets are alike, an empty and another are not."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    return float((a == b).mean())


def _multipliers() -> np.ndarray:
    return np.random.default_rng(6).integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def as_hex(print_: np.ndarray) -> str:
    return print_.astype(">u2").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    """The text with its second half (rounded down) replaced by as much of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def range_bounds(df: DataFrame, id_col: str, ranges: int) -> list[float]:
    """Bounds of about ``ranges`` ranges of ids with as many rows each: approximate quantiles."""
    bounds = df.select(F.col(id_col).cast("double").alias("x")).approxQuantile(
        "x", [k / ranges for k in range(1, ranges)], 0.1 / ranges
    )
    splits = sorted({float("-inf"), float("inf"), *bounds})
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    return splits


def with_neighbours(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (range, halo, id, hash, text): each range holds its rows and, as halo, the row after its last."""
    rows = df.select(
        column(df, id_col).cast("long").alias("id"), F.coalesce(column(df, text_col), F.lit("")).alias("text")
    )
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits = range_bounds(rows, "id", 3 * partitions)
    count = len(splits) - 1
    number = Bucketizer(splits=splits, inputCol="x", outputCol="up", handleInvalid="keep")
    rows = number.transform(rows.withColumn("x", F.coalesce(F.col("id").cast("double"), F.lit(0.0))))
    rows = rows.withColumn(
        "range", F.when(F.col("id").isNull(), F.lit(count)).otherwise(count - 1 - F.col("up")).cast("int")
    ).withColumn("hash", F.xxhash64("text"))
    rows = rows.select("range", "id", "hash", "text")
    # one row per range: its first in descending order
    firsts = sorted(
        rows.groupBy("range").agg(F.max(F.struct("id", "hash")).alias("first")).collect(), key=lambda r: r.range
    )
    spark = df.sparkSession
    before = [firsts[i - 1].range for i in range(len(firsts))]  # the first range's is the last
    halo = spark.createDataFrame(
        [(r.range, r.first.id, r.first.hash, to) for r, to in zip(firsts, before, strict=True)],
        "own int, first_id long, first_hash long, to int",
    )
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    here = F.struct(F.col("range"), F.lit(0).alias("halo"))
    there = F.struct(F.col("to").alias("range"), F.lit(1).alias("halo"))
    return (
        rows.join(F.broadcast(halo), F.col("range") == F.col("own"))
        .withColumn("dest", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))))
        .select("dest.range", "dest.halo", "id", "hash", "text")
        .repartition("range")
        .sortWithinPartitions("range", "halo", F.desc_nulls_last("id"), F.desc("hash"))
    )


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, both fingerprints, near_edited, near_next."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, multipliers = worker_state("word_hashes", dict), _multipliers()
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        waiting = None  # the row before, until its next one is seen: (range, id, text, fingerprint)
        for batch in batches:
            out: list[tuple] = []
            ranges, halos, ids = (batch.column(c).to_pylist() for c in ("range", "halo", "id"))
            for row, text in enumerate(batch.column("text")):
                if waiting is None and halos[row]:
                    continue  # a further copy of the neighbour
                text = text.as_py()
                own = fingerprint(text, cache, multipliers)
                if waiting is not None:
                    _, id_, before, print_ = waiting
                    edited = edited_text(before, text)
                    edited_print = fingerprint(edited, cache, multipliers)
                    out.append(
                        (
                            id_,
                            len(before),
                            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            as_hex(print_),
                            as_hex(edited_print),
                            likeness(print_, edited_print),
                            likeness(print_, own),
                        )
                    )
                waiting = None if halos[row] else (ranges[row], ids[row], text, own)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

    return (
        with_neighbours(df, id_col, text_col)
        .mapInArrow(
            compare,
            "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double",
        )
        .withColumnRenamed("id", id_col)
    )


def op6_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents"))
