"""Quality classifier learned from trusted positives and unlabelled text.

Only positives are trusted; the other training text is unlabelled and holds good
and bad. With the share of good text (the class prior) estimated, the risk of a
classifier g is written without negatives,

    prior * E_pos[loss(g, 1)] + max(0, E_unl[loss(g, 0)] - prior * E_pos[loss(g, 0)]),

whose second term estimates the risk on negatives. It can't be negative; when
its estimate on a batch is, the classifier has begun to memorise positives, and
the step goes the other way until it isn't. The classifier is a small network on
features of a text's form: character classes, word and line repetition, lengths.

Features are computed and texts scored by Spark over whole texts; the network is
fitted on the driver on a sample of bounded size (``MAX_POSITIVES`` and
``MAX_UNLABELLED`` rows of FEATURES numbers).

Defined cases: null texts count as empty and are scored as such; repeated labels
of an id count once, and an id with both labels is no positive; without
positives every score is the prior; rows repeated whole get equal scores; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.tables import binary_values, column, crc_remainder, read_table

MAX_POSITIVES = 10_000  # rows the network is fitted on, about
MAX_UNLABELLED = 20_000
HIDDEN = 24
EPOCHS, BATCHES, RATE = 60, 12, 0.01

_CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t",
    b"\n\r",
    b".,;:'\"()-",
    b"!?",
    b"#$%&*@^~",
    b"|<>{}[]/\\=+_`",
]
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)  # the last class: bytes beyond ASCII and controls
for _k, _signs in enumerate(_CLASSES):
    _CLASS_OF[list(_signs)] = _k
FEATURES = len(_CLASSES) + 1 + 12


def features(text: bytes) -> np.ndarray:
    """Numbers that describe the form of a whole text."""
    out = np.zeros(FEATURES)
    size = len(text)
    if not size:
        return out
    per_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = np.bincount(_CLASS_OF, weights=per_byte, minlength=len(_CLASSES) + 1) / size
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    n = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    out[: len(shares)] = np.sqrt(shares)
    out[len(shares) :] = [
        np.log1p(size),
        np.log1p(len(words)),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        pairs / max(1, n - 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(size / max(1, len(lines))),
        lengths.mean() / 10,
        lengths.std() / 10,
        np.log1p(lengths.max()),
        np.log1p(len(lines)),
    ]
    return out


@dataclass
class Network:
    """One hidden layer; score(x) is the chance that a text is good."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]  # hidden, hidden bias, output, output bias

    def margin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights
        hidden = np.tanh(x @ w1 + b1)
        return hidden, hidden @ w2 + b2

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(self.margin(x)[1], -30, 30)))


def fit_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 2) -> Network:
    """Minimise the non-negative risk by Adam on batches of both samples."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    weights = [
        rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        np.zeros(1),
    ]
    net = Network(mean, scale, weights)
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0

    def gradients(x: np.ndarray, by_margin: np.ndarray, hidden: np.ndarray) -> list[np.ndarray]:
        back = by_margin[:, None] * weights[2] * (1 - hidden**2)
        return [x.T @ back, back.sum(axis=0), hidden.T @ by_margin, by_margin.sum(keepdims=True)]

    softplus = lambda z: np.logaddexp(0, z)
    for epoch in range(EPOCHS):
        parts = zip(
            np.array_split(rng.permutation(len(p)), BATCHES), np.array_split(rng.permutation(len(u)), BATCHES), strict=True
        )
        for ip, iu in parts:
            if not len(ip) or not len(iu):
                continue
            xp, xu = p[ip], u[iu]
            (hp, gp), (hu, gu) = net.margin(xp), net.margin(xu)
            sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
            negative = softplus(gu).mean() - prior * softplus(gp).mean()
            by_unlabelled = gradients(xu, su / len(iu), hu)
            if negative >= 0:  # loss of positives as positives, less their part of the unlabelled
                by_positive = gradients(xp, prior * ((sp - 1) - sp) / len(ip), hp)
                total = [a + b for a, b in zip(by_positive, by_unlabelled, strict=True)]
            else:
                by_positive = gradients(xp, -prior * sp / len(ip), hp)
                total = [-(a + b) for a, b in zip(by_positive, by_unlabelled, strict=True)]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for w, g, m, v in zip(weights, total, first, second, strict=True):
                g = g + 1e-4 * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _sample(df: DataFrame, rows: int, most: int) -> DataFrame:
    """About ``most`` of ``rows`` rows, chosen by a fixed hash of the id."""
    place = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return df if rows <= most else df.filter(place < most / rows)


def _collect_features(df: DataFrame) -> np.ndarray:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in binary_values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))],
                names=["id", "x"],
            )

    rows = df.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(describe, "id string, x array<double>")
    found = sorted(rows.collect())  # a bounded sample; sorted, so that reruns agree
    return np.array([r.x for r in found]).reshape(len(found), FEATURES)


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[Network | None, float]:
    """(network, prior) from training rows; ``labels`` has the id and 0 or 1.

    The prior is the share of good rows among the labelled ones: labels were
    given without regard to the text, so it is the share of the unlabelled too.
    """
    judged = (
        labels.select(column(labels, id_col).alias("id"), column(labels, label_col).alias("label"))
        .filter("id is not null and label is not null")
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    good, total = judged.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    prior = float(np.clip((good + 1) / (total + 2), 0.05, 0.95))
    rows = documents.select(column(documents, id_col).alias("id"), column(documents, text_col).alias("text"))
    positives = rows.join(_sample(judged.filter("label = 1"), good, MAX_POSITIVES).select("id"), "id", "left_semi")
    p = _collect_features(positives)
    u = _collect_features(_sample(rows, rows.count(), MAX_UNLABELLED))
    if not len(p) or not len(u):
        return None, prior
    return fit_network(p, u, prior), prior


def quality_score(df: DataFrame, network: Network | None, prior: float, text: Column) -> Column:
    """Score in 0..1 of a text column of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast((network, prior))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        fitted, base = shared.value
        rows = np.array([features(t) for t in binary_values(texts)]).reshape(len(texts), FEATURES)
        return pa.array(fitted.score(rows) if fitted else np.full(len(texts), base), pa.float64())

    return score(F.coalesce(text, F.lit("")).cast("binary"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = crc_remainder(F.col("doc_id"), 3) == 1
    network, prior = fit(documents.filter(~held_out), labels.filter(~held_out))
    scored = documents.select(
        "doc_id", held_out.alias("held_out"), quality_score(documents, network, prior, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
