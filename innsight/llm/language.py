"""Language identification: known words first, shorter and shorter n-grams for the others.

The model holds per-language log frequencies of words, and of the character
n-grams of words, from ``MAX_GRAM`` letters (a word's start and end count as
letters) down to one. A text is scored word by word: a known word adds its log
frequencies; an unseen one is cut into the longest n-grams of which at least one
is known, and adds their mean. Every word counts as often as it stands in the
text.

Fitting uses a sample of the labelled rows whose size is a parameter
(``max_rows_per_language``), chosen by a fixed hash; the counting is a Spark
job. An entry must have a share of at least ``MIN_SHARE`` of some language's
words or n-grams, so a language has at most 1 / MIN_SHARE entries per table
whatever the size of the input, and the broadcast model is bounded.

Defined cases: a null text, an empty one and one without a letter get ``und``
and score 0; so does every text when no row is labelled; ties go to the first
language by code point; rows repeated whole get equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.tables import column, crc_remainder, free_name, materialize, read_table, releasing, worker_state

MAX_GRAM = 4
MIN_SHARE = 5e-5  # smallest share of a word or n-gram in some language
MAX_ROWS_PER_LANGUAGE = 2_000  # labelled rows that the model is fitted on, about
CACHED_CHUNKS = 150_000  # runs of text whose scores a worker keeps, in each of two generations
UNDETERMINED = "und"

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def word_counts(text: str) -> Counter:
    """The text's words (runs of letters, lower case) with their counts."""
    counts: Counter = Counter()
    for chunk, n in Counter(text.lower().split()).items():
        for word in (chunk,) if chunk.isalpha() else _LETTERS.findall(chunk):
            counts[word] += n
    return counts


def grams(word: str, size: int) -> list[str]:
    """Character n-grams of a word between its boundary marks; single letters without the marks."""
    if size == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


@dataclass
class Table:
    """Log frequencies of units: a row of ``values`` per unit, a column per language."""

    row: dict[str, int]
    values: np.ndarray


@dataclass
class Model:
    """tables[0] of words, tables[n] of n-grams."""

    languages: list[str]
    tables: list[Table] = field(default_factory=list)

    def word(self, word: str) -> np.ndarray | None:
        """Log frequency of a word per language, from the longest unit known."""
        known = self.tables[0].row.get(word)
        if known is not None:
            return self.tables[0].values[known]
        for size in range(MAX_GRAM, 0, -1):
            row = self.tables[size].row
            hits = [row[g] for g in grams(word, size) if g in row]
            if hits:
                return self.tables[size].values[hits].sum(axis=0) / len(hits)
        return None

    def scores(self, text: str, cache: ChunkScores) -> np.ndarray | None:
        """Posterior of each language, or None if no word of the text is scored."""
        counts = Counter(text.lower().split())
        cache.make_room(len(counts))
        rows = np.fromiter(map(cache.__getitem__, counts), np.int64, len(counts))
        weights = np.fromiter(counts.values(), float, len(counts))
        summed = weights @ cache.values[rows]
        if not summed[-1]:
            return None
        total = summed[:-1]
        odds = np.exp(total - total.max())
        return odds / odds.sum()


class ChunkScores(dict):
    """Run of text without white space -> row of ``values``: its words' scores summed, and how many are scored.

    Computed when asked for first. The table is bounded; when it is full, the
    runs that were not asked for since it was last full go.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.values = np.zeros((CACHED_CHUNKS, len(model.languages) + 1))
        self.older: tuple[dict, np.ndarray] = ({}, self.values)

    def make_room(self, wanted: int) -> None:
        """Room for ``wanted`` more runs."""
        if len(self) + wanted > len(self.values):
            self.older = (dict(self), self.values)
            self.values = np.zeros((max(CACHED_CHUNKS, wanted), self.values.shape[1]))
            self.clear()

    def __missing__(self, chunk: str) -> int:
        row = self[chunk] = len(self)
        older, values = self.older
        known = older.get(chunk)
        if known is not None:
            self.values[row] = values[known]
            return row
        for word in (chunk,) if chunk.isalpha() else _LETTERS.findall(chunk):
            found = self.model.word(word)
            if found is not None:
                self.values[row, :-1] += found
                self.values[row, -1] += 1
        return row


def fit(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    max_rows_per_language: int = MAX_ROWS_PER_LANGUAGE,
) -> Model:
    """Fit on the rows of ``df`` with a language; about ``max_rows_per_language`` of each."""
    rows = df.select(
        column(df, id_col).alias("id"), column(df, text_col).alias("text"), column(df, lang_col).alias("lang")
    ).filter("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return Model([])
    share = F.create_map(
        *[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, max_rows_per_language / n))]
    )
    place = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.filter(place < share[F.col("lang")]).select("text", "lang")

    def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(word_counts(text))
            for lang, of_lang in words.items():
                for size in range(MAX_GRAM + 1):
                    counts = of_lang if size == 0 else Counter()
                    if size:
                        for word, n in of_lang.items():
                            for gram in grams(word, size):
                                counts[gram] += n
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(counts), pa.string()),
                            pa.array([size] * len(counts), pa.int32()),
                            pa.array(list(counts), pa.string()),
                            pa.array(list(counts.values()), pa.int64()),
                        ],
                        names=["lang", "size", "unit", "n"],
                    )

    counts = materialize(
        sample.mapInArrow(releasing(count_units), "lang string, size int, unit string, n long")
        .groupBy("lang", "size", "unit")
        .agg(F.sum("n").alias("n")),
        "language-units",
    )
    totals = {(r.lang, r.size): r.n for r in counts.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(
        *[F.lit(x) for (lang, size), n in totals.items() for x in (f"{lang} {size}", n * MIN_SHARE)]
    )
    kept = counts.filter(F.col("n") >= least[F.concat_ws(" ", "lang", F.col("size").cast("string"))])
    # at most 1 / MIN_SHARE rows per language and size
    found = kept.toPandas()
    languages = sorted(sizes, key=lambda s: s.encode())
    model = Model(languages)
    for size in range(MAX_GRAM + 1):
        part = found[found["size"] == size].pivot_table(index="unit", columns="lang", values="n", fill_value=0)
        part = part.reindex(columns=languages, fill_value=0)
        total = np.array([totals.get((lang, size), 0) for lang in languages], dtype=float)
        # an entry a language lacks has fewer than MIN_SHARE of it; half of that stands in
        share_of = (part.to_numpy(dtype=float) + 0.0) / np.maximum(total, 1.0)
        logs = np.log(np.maximum(share_of, MIN_SHARE / 2))
        model.tables.append(Table({unit: i for i, unit in enumerate(part.index)}, logs))
    return model


def with_language(df: DataFrame, model: Model, text_col: str = "text", into: str = "language") -> DataFrame:
    """``df`` with a column ``into``: struct(lang, score)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    fitted_as = uuid.uuid4().hex

    @F.arrow_udf("lang string, score double")
    def identify(texts: pa.Array) -> pa.Array:
        fitted = shared.value
        caches = worker_state("language_scores", dict)  # of the model used last
        if fitted_as not in caches:
            caches.clear()
            caches[fitted_as] = ChunkScores(fitted)
        cache = caches[fitted_as]
        langs, scores = [], []
        for value in texts:
            text = value.as_py()
            posterior = fitted.scores(text, cache) if text and fitted.languages else None
            if posterior is None:
                # letters, but none that any language has: the first language, without confidence
                letters = bool(text) and bool(fitted.languages) and _LETTERS.search(text)
                langs.append(fitted.languages[0] if letters else UNDETERMINED)
                scores.append(0.0)
            else:
                best = int(posterior.argmax())
                langs.append(fitted.languages[best])
                scores.append(float(posterior[best]))
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"]
        )

    # so marked, Spark does not inline it into every filter and column that uses it
    return df.withColumn(into, identify.asNondeterministic()(column(df, text_col)))


def keep_identified(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose text has a language, a missing language filled in.

    Fitted on the rows of ``df`` that have one. A language that is given is never
    overruled; rows go whose text is null or has no letter, given language or not.
    A text with letters of which no word or letter is known to any language stays,
    under the first language if none is given.
    """
    found = free_name(df, "language")
    identified = with_language(df, fit(df, text_col, lang_col, id_col), text_col, found)
    kept = identified.filter(F.col(found)["lang"] != UNDETERMINED)
    return kept.withColumn(lang_col, F.coalesce(column(kept, lang_col), F.col(found)["lang"])).drop(found)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    model = fit(documents.filter(~held_out))
    found = with_language(documents.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )
