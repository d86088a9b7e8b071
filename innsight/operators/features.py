"""Feature assembly and per-city scaling.

The source job assembles ``x, y, star_rating_number, avg_adr`` into a vector and
fits a standard scaler *per city*: every feature is divided by its sample
standard deviation within the city and is **not** centred (the scaler's
default). A feature whose deviation is 0 -- or undefined, for a one-hotel
city -- scales to 0.0.

Here the deviations are one grouped aggregate keyed by ``city_code`` (partial
aggregation, one row per city) joined back to the rows, so there is no model
fit per city and no driver loop. A row with a NULL feature cannot be assembled
into a vector, so it is left out before the deviations are taken;
``left_out_rows`` counts such rows per city, and the job reports them.

Scaled features are kept as plain double columns (``scaled_<feature>``), which
keeps the distance arithmetic inside whole-stage codegen; ``features`` /
``scaledFeatures`` arrays are built for the report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.fixed_values import FEATURES

CITY = "city_code"


def scaled_name(feature: str) -> str:
    return f"scaled_{feature}"


def complete_features(df: DataFrame, features: Sequence[str] = FEATURES) -> Column:
    """True when every feature is not NULL."""
    cond = F.lit(True)
    for f in features:
        cond = cond & F.col(f).isNotNull()
    return cond


def left_out_rows(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Per city, how many rows there are and how many lack a feature and so are not scaled."""
    incomplete = F.sum((~complete_features(df, features)).cast("long"))
    return df.groupBy(CITY).agg(F.count(F.lit(1)).alias("property_rows"), incomplete.alias("left_out"))


def feature_deviations(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Per city, the sample standard deviation of each feature (``_sd_<feature>``)."""
    return df.groupBy(CITY).agg(
        *[F.stddev_samp(F.col(f).cast("double")).alias(f"_sd_{f}") for f in features]
    )


def scale_features(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Rows with complete features, plus ``scaled_<feature>`` = value / city std (0.0 if std is 0 or NULL)."""
    usable = df.filter(complete_features(df, features) & F.col(CITY).isNotNull())
    deviations = feature_deviations(usable, features)
    # One row per city, measured and broadcast by AQE when small.
    joined = usable.join(deviations, on=CITY, how="inner")
    scaled = {}
    for f in features:
        sd = F.col(f"_sd_{f}")
        scaled[scaled_name(f)] = F.when(sd > 0, F.col(f).cast("double") / sd).otherwise(F.lit(0.0))
    return joined.withColumns(scaled).drop(*[f"_sd_{f}" for f in features])


def feature_arrays(features: Sequence[str] = FEATURES) -> dict[str, Column]:
    """``features`` and ``scaledFeatures`` as ``array<double>`` columns."""
    return {
        "features": F.array(*[F.col(f).cast("double") for f in features]),
        "scaledFeatures": F.array(*[F.col(scaled_name(f)) for f in features]),
    }
