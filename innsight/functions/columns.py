"""Column expressions shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``, so it
stays inside the JVM; no Python runs per row.

Spark 4 evaluates with ANSI semantics, where a malformed cast or a division by
zero raises. The source jobs ran without ANSI and got NULL in those cases, so
casts of free text use ``try_cast`` and ratios use ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from innsight.fixed_values import (  # noqa: F401  (re-exported)
    EARTH_RADIUS_KM,
    RATE_SORTED_RANK_LABEL,
    RATE_TYPE_LABEL,
    TOP_RANK_FIRST,
    TOP_RANK_LAST,
    UNMATCHED_RATE_BUCKET,
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label_qualifies(label: Column, only_one: Column) -> Column:
    """Whether a label counts; ``only_one`` tells whether it is its rate's only label."""
    return (
        (label["id"].isNull() & only_one)
        | ((label["id"] == RATE_SORTED_RANK_LABEL) & (label["type"] == RATE_SORTED_RANK_LABEL))
        | ((label["id"] == RATE_TYPE_LABEL) & (label["type"] == RATE_TYPE_LABEL))
    )


def qualifying_labels(labels: str | Column) -> Column:
    """The labels of a rate that count for the rank / type analysis.

    A label qualifies when its id equals its type and is one of the two known
    label ids, or when it is the only label and its id is null (such a rate is
    kept with an unknown type and rank). A null element counts as a label with
    a null id. An empty array gives an empty result and a null array NULL.
    """
    arr = _col(labels)
    return F.filter(arr, lambda e: label_qualifies(e, F.size(arr) == 1))


def label_value(qualified: str | Column, label_id: str) -> Column:
    """Value of the first qualifying label with ``label_id`` whose value is not null."""
    hits = F.filter(_col(qualified), lambda e: (e["id"] == label_id) & e["value"].isNotNull())
    return F.get(hits, 0)["value"]


def labels_text(labels: str | Column) -> Column:
    """Labels as one string, ``id:type:value`` joined by ``|`` (NULL fields as ``~``).

    A flat, comparable rendering of the label array for reports and CSV output.
    """

    def one(e: Column) -> Column:
        parts = [F.coalesce(e[f], F.lit("~")) for f in ("id", "type", "value")]
        return F.concat_ws(":", *parts)

    return F.array_join(F.transform(_col(labels), one), "|")


def top3_flag(rank_text: str | Column) -> Column:
    """1 when the rank text parses as a number in [1, 3], else 0 (int)."""
    rank = _col(rank_text).try_cast("float")
    return F.when(rank.between(TOP_RANK_FIRST, TOP_RANK_LAST), F.lit(1)).otherwise(F.lit(0))


def star_rating_number(star_rating: str | Column) -> Column:
    """Leading character of a star-rating text as int; NULL when it is not a digit."""
    return F.substring(_col(star_rating), 1, 1).try_cast("int")


def valid_star_rating(star_rating: str | Column) -> Column:
    """Star-rating texts kept for property metrics: not null and longer than one character."""
    s = _col(star_rating)
    return s.isNotNull() & (F.length(s) > 1)


def safe_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """``numerator / denominator`` with NULL instead of an error on a zero denominator."""
    return F.try_divide(_col(numerator), _col(denominator))


def valid_coordinates(lon: str | Column = "x", lat: str | Column = "y") -> Column:
    """Longitude in [-180, 180] and latitude in [-90, 90], inclusive."""
    return _col(lon).between(-180, 180) & _col(lat).between(-90, 90)


def haversine_km(
    lat_a: str | Column, lon_a: str | Column, lat_b: str | Column, lon_b: str | Column
) -> Column:
    """Great-circle distance in km between two points given in degrees.

    The haversine term is clamped at 1 so that rounding near antipodes cannot
    push ``asin`` out of its domain; NULL inputs give NULL.
    """
    phi_a, phi_b = F.radians(_col(lat_a)), F.radians(_col(lat_b))
    d_phi = phi_a - phi_b
    d_lambda = F.radians(_col(lon_a)) - F.radians(_col(lon_b))
    term = F.pow(F.sin(d_phi / 2), 2) + F.cos(phi_a) * F.cos(phi_b) * F.pow(F.sin(d_lambda / 2), 2)
    term = F.when(term > 1.0, F.lit(1.0)).otherwise(term)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(term))
