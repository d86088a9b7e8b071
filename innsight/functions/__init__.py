"""Column expressions (built-in Spark functions only)."""

from innsight.functions.columns import (
    EARTH_RADIUS_KM,
    RATE_SORTED_RANK_LABEL,
    RATE_TYPE_LABEL,
    UNMATCHED_RATE_BUCKET,
    haversine_km,
    label_value,
    qualifying_labels,
    safe_ratio,
    star_rating_number,
    top3_flag,
    valid_coordinates,
    valid_star_rating,
)

__all__ = [
    "EARTH_RADIUS_KM",
    "RATE_SORTED_RANK_LABEL",
    "RATE_TYPE_LABEL",
    "UNMATCHED_RATE_BUCKET",
    "haversine_km",
    "label_value",
    "qualifying_labels",
    "safe_ratio",
    "star_rating_number",
    "top3_flag",
    "valid_coordinates",
    "valid_star_rating",
]
