"""Values that must equal the source jobs' for the results to match.

Fixed values, in the order the analyses use them. Everything else in the
package (keys, plans, thresholds) is a choice of this package.
"""

# --- fixed values ------------------------------------------------------------
# Rate frequency
RATE_SORTED_RANK_LABEL = "CWT_RATE_SORTED_RANK"  # label id/type of a rate's rank in the response
RATE_TYPE_LABEL = "CWT_RATE_TYPE"  # label id/type of the rate type
UNMATCHED_RATE_BUCKET = "OTHER"  # bucket of rates missing from the lookup
TOP_RANK_FIRST, TOP_RANK_LAST = 1, 3  # inclusive rank range flagged as top 3
LABELS_COLUMN = "ratePlan_tpaExtensions_labels_label"
SEARCH_LOG_FIELDS = [  # declared schema of the search log, in its order
    ("year", "int"),
    ("month", "int"),
    ("day", "int"),
    ("res_sessionID", "string"),
    ("hotel_id", "string"),
    ("id", "string"),
    (LABELS_COLUMN, "labels"),
]
LABEL_FIELDS = ["id", "type", "value"]  # of a label, all text
DATE_PARTS = ["year", "month", "day"]
SESSION_KEYS = [*DATE_PARTS, "res_sessionID", "hotel_id"]
RATE_ROW_KEYS = [*SESSION_KEYS, "rate_id", "new_rate_bucket", LABELS_COLUMN]
FREQUENCY_KEYS = [*SESSION_KEYS, "new_rate_bucket", RATE_TYPE_LABEL, "top3_rate_flag"]
SUMMARY_KEYS = [*DATE_PARTS, RATE_TYPE_LABEL, "top3_rate_flag"]
# Competitive sets
LOCATION_KEYS = ["harp_property_id_no", "hotel_chain_name", "city_code", "x", "y"]
NAME_KEYS = ["harp_property_id_no", "hotel_name", "hotel_chain_name", "city_code", "x", "y"]
PERCENTILE_LOWER, PERCENTILE_UPPER = 0.03, 0.97  # coordinate tail trimming per city
FEATURES = ["x", "y", "star_rating_number", "avg_adr"]  # kNN features, scaled per city
COMP_SET_SIZE = 10  # neighbours per hotel, the hotel itself included
EARTH_RADIUS_KM = 6371.0  # great-circle distances
REPORT_COLUMNS = [  # column order of the competitive-set report
    "target_property_harp_ID",
    "target_property_name",
    "target_property_longitude",
    "target_property_latitude",
    "target_property_yield",
    "target_property_num_bookings",
    "harp_property_id_no",
    "hotel_name",
    "hotel_chain_name",
    "longitude",
    "latitude",
    "star_rating",
    "star_rating_number",
    "num_bookings",
    "avg_yield",
    "avg_adr",
    "features",
    "scaledFeatures",
    "knn_distance_metric",
    "distance_km",
    "compset_yield_vs_target_property_diff",
    "compset_yield_vs_target_property_ratio",
    "compset_yield_performance_rank",
    "compset_share_of_bookings",
    "compset_bookings_wrt_target_property_ratio",
    "compset_share_of_bookings_rank",
]
# -----------------------------------------------------------------------------
