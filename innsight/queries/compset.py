"""Registered competitive-set queries over the driver's tables (Spark side + DuckDB oracles).

Bookings come from ``orders`` x ``customer`` (``sources.fixtures``). Doubles are
rounded to 6 decimals on both sides, since the driver hashes values; vector
columns are shown as one scalar column per component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.operators import compset as cs
from innsight.operators import features as feat
from innsight.operators import geo, knn, properties
from innsight.plans.lineage import cut_lineage
from innsight.sources import fixtures as fx

DIGITS = 6
CITY = "city_code"
SCALED = [feat.scaled_name(f) for f in feat.FEATURES]


def _r(c: str, alias: str | None = None):
    return F.round(F.col(c), DIGITS).alias(alias or c)


def _bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.fixture_bookings(spark, sf_dir)


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.property_metrics(_bookings(spark, sf_dir))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(cs.prepare_points(_props(spark, sf_dir), materialize=True), label="points")


def _property_view(df: DataFrame) -> DataFrame:
    return df.select(*properties.NAME_KEYS[:4], "x", "y", "num_bookings", "star_rating",
                     "star_rating_number", _r("avg_yield"), _r("avg_adr"))


def bookings_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bookings created on or after the fixture's first date."""
    rows = properties.bookings_since(_bookings(spark, sf_dir), fx.FIXTURE_BOOKINGS_SINCE)
    return rows.select(*[c for c in rows.columns if c not in ("yield", "adr")], _r("yield"), _r("adr"))


def current_property_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 + W1 + F8: per property, the name(s) with the latest booking date (ties kept)."""
    return properties.current_property_names(_bookings(spark, sf_dir))


def bookings_current_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings joined to the current names on (property, chain, city, x, y)."""
    rows = properties.bookings_with_current_names(_bookings(spark, sf_dir))
    return rows.select(*properties.NAME_KEYS, "created_date", "star_rating", _r("yield"), _r("adr"))


def star_rating_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bookings with a star-rating text that is not null and longer than one character."""
    rows = _bookings(spark, sf_dir).filter(properties.valid_star_rating("star_rating"))
    return rows.select(properties.PROPERTY_ID, "created_date", "star_rating")


def star_rating_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading digit of the star-rating text as int."""
    rows = properties.with_star_rating_number(_bookings(spark, sf_dir))
    return rows.select(properties.PROPERTY_ID, "created_date", "star_rating", "star_rating_number")


def property_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings, star rating, mean yield and ADR per property (current name)."""
    return _property_view(_props(spark, sf_dir))


def property_metrics_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 from the joined bookings of J2 (must equal ``property_metrics``)."""
    joined = properties.bookings_with_current_names(_bookings(spark, sf_dir))
    valid = joined.filter(properties.valid_star_rating("star_rating"))
    folded = properties.fold_bookings(valid).groupBy(*properties.NAME_KEYS)
    return _property_view(folded.agg(*properties._metrics_of_folded()))


def distinct_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the cities having at least one property."""
    return _props(spark, sf_dir).select(CITY).distinct()


def _property_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All property rows, written once as the bounds and the filter both read them."""
    return cut_lineage(_props(spark, sf_dir), label="properties")


def geo_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 + F5: per city, the 3% / 97% discrete percentiles of distinct valid x and y."""
    return geo.geo_bounds(_property_rows(spark, sf_dir))


def geo_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 (F6, F7, J5): properties inside their city's coordinate bounds."""
    return _property_view(geo.geo_clean(_property_rows(spark, sf_dir)))


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features divided by the city's sample standard deviation."""
    pts = _points(spark, sf_dir)
    return pts.select(CITY, properties.PROPERTY_ID, *[_r(c) for c in SCALED])


def left_out_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per city, the clean property rows and how many of them lack a feature."""
    return feat.left_out_rows(geo.geo_clean(_property_rows(spark, sf_dir)))


def _knn(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return knn.knn_exact(_points(spark, sf_dir), SCALED, k=knn.DEFAULT_K, key=CITY,
                         id_col=properties.PROPERTY_ID, **options)


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 (J6, W5, O2): the 10 nearest properties of each property in its city."""
    pairs = _knn(spark, sf_dir)
    return pairs.select(CITY, knn.TARGET_ID, knn.NEIGHBOUR_ID, _r(knn.DISTANCE), knn.RANK)


def knn_exact_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 with leaves half the usual size (more leaves per target)."""
    pairs = _knn(spark, sf_dir, leaf_size=48)
    return pairs.select(CITY, knn.TARGET_ID, knn.NEIGHBOUR_ID, _r(knn.DISTANCE), knn.RANK)


def knn_exact_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 with the smallest leaves, k to 2k points each: as many leaves as large cities have."""
    pairs = _knn(spark, sf_dir, leaf_size=2 * knn.DEFAULT_K)
    return pairs.select(CITY, knn.TARGET_ID, knn.NEIGHBOUR_ID, _r(knn.DISTANCE), knn.RANK)


def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours, checked per city against the exact search.

    Targets, targets with min(k, n) neighbours, pairs, pairs whose distance is
    the exact distance of its two points, and whether at least nine tenths of the
    exact search's pairs are among them.
    """
    points = _points(spark, sf_dir)
    pairs = knn.knn_lsh(points, SCALED, k=knn.DEFAULT_K, key=CITY, id_col=properties.PROPERTY_ID)
    t, n = (
        points.select(CITY, F.col(properties.PROPERTY_ID).alias(col), F.array(*SCALED).alias(name))
        for col, name in ((knn.TARGET_ID, "_t"), (knn.NEIGHBOUR_ID, "_n"))
    )
    d2 = F.aggregate(
        F.zip_with("_t", "_n", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, v: total + v
    )
    size = points.groupBy(CITY).agg(F.count(F.lit(1)).alias("_size"))
    per_target = (
        pairs.join(t, [CITY, knn.TARGET_ID])
        .join(n, [CITY, knn.NEIGHBOUR_ID])
        .groupBy(CITY, knn.TARGET_ID)
        .agg(
            F.count(F.lit(1)).alias("_got"),
            F.sum((F.abs(F.sqrt(d2) - F.col(knn.DISTANCE)) < 1e-9).cast("long")).alias("_exact"),
        )
    )
    full = F.col("_got") == F.least(F.lit(knn.DEFAULT_K), F.col("_size"))
    exact = knn.knn_exact(points, SCALED, k=knn.DEFAULT_K, key=CITY, id_col=properties.PROPERTY_ID)
    recall = knn.knn_recall(pairs, exact, CITY)
    reached = F.col("found_pairs") * 10 >= F.col("exact_pairs") * 9
    return (
        per_target.join(size, CITY)
        .groupBy(CITY)
        .agg(
            F.count(F.lit(1)).alias("targets"),
            F.sum(full.cast("long")).alias("complete_targets"),
            F.sum("_got").alias("pairs"),
            F.sum("_exact").alias("pairs_with_exact_distance"),
        )
        .join(recall.select(CITY, reached.alias("recall_of_nine_tenths")), CITY)
    )


def _compset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.comp_set_metrics(cs.comp_set(_points(spark, sf_dir)))


def haversine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle km from every comp-set member to its target."""
    pairs = geo.with_distance_km(_compset(spark, sf_dir), "y", "x", "target_property_latitude",
                                 "target_property_longitude")
    return pairs.select(CITY, knn.TARGET_ID, knn.NEIGHBOUR_ID, _r("distance_km"))


def compset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yield difference / ratio, booking share / ratio and their ranks per set."""
    m = _compset(spark, sf_dir)
    return m.select(
        CITY, knn.TARGET_ID, knn.NEIGHBOUR_ID,
        _r("compset_yield_vs_target_property_diff"), _r("compset_yield_vs_target_property_ratio"),
        "compset_yield_performance_rank", _r("compset_share_of_bookings"),
        _r("compset_bookings_wrt_target_property_ratio"), "compset_share_of_bookings_rank",
    )


def compset_yield_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rank of the yield ratio within each set."""
    m = _compset(spark, sf_dir)
    return m.select(CITY, knn.TARGET_ID, knn.NEIGHBOUR_ID, "compset_yield_performance_rank")


def compset_booking_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 + W4: booking share of the set and dense rank of the booking ratio."""
    m = _compset(spark, sf_dir)
    return m.select(CITY, knn.TARGET_ID, knn.NEIGHBOUR_ID, _r("compset_share_of_bookings"),
                    "compset_share_of_bookings_rank")


def compset_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9 (P2, P5): the full report, vectors shown one component per column."""
    report = cs.comp_set_report(_bookings(spark, sf_dir))
    cols = []
    for c, t in report.dtypes:
        if c in ("features", "scaledFeatures"):
            cols += [F.round(F.col(c)[i], DIGITS).alias(f"{c}_{i}") for i in range(len(feat.FEATURES))]
        elif t == "double":
            cols.append(_r(c))
        else:
            cols.append(F.col(c))
    return report.select(*cols)


# --- DuckDB oracles ----------------------------------------------------------
_CHAIN = """
b as (
  select cast(c_custkey as varchar) harp_property_id_no, concat(c_name, '/', o_orderstatus) hotel_name,
         c_mktsegment hotel_chain_name, cast(c_nationkey as varchar) city_code,
         cast((c_custkey * 7919) % 3600 as double) / 10 - 180 x,
         cast((c_custkey * 104729) % 1800 as double) / 10 - 90 y,
         o_orderdate created_date, o_orderpriority star_rating,
         o_totalprice * 0.8 "yield", o_totalprice adr
  from orders join customer on o_custkey = c_custkey),
g as (select harp_property_id_no, hotel_name, hotel_chain_name, city_code, x, y,
             max(created_date) max_created_date from b group by all),
cur as (select harp_property_id_no, hotel_name, hotel_chain_name, city_code, x, y from (
          select *, dense_rank() over (partition by harp_property_id_no order by max_created_date desc) r from g)
        where r = 1),
bc as (select b.harp_property_id_no, cur.hotel_name, b.hotel_chain_name, b.city_code, b.x, b.y,
              b.created_date, b.star_rating, b."yield", b.adr
       from b join cur on b.harp_property_id_no = cur.harp_property_id_no
         and b.hotel_chain_name = cur.hotel_chain_name and b.city_code = cur.city_code
         and b.x = cur.x and b.y = cur.y),
pm as (select harp_property_id_no, hotel_name, hotel_chain_name, city_code, x, y,
              count(*) num_bookings, max(star_rating) star_rating,
              max(try_cast(substring(star_rating, 1, 1) as integer)) star_rating_number,
              avg("yield") avg_yield, avg(adr) avg_adr
       from bc where star_rating is not null and length(star_rating) > 1 group by all),
valid as (select * from pm where x between -180 and 180 and y between -90 and 90),
bx as (select city_code, percentile_disc(0.03) within group (order by x) x_lo,
              percentile_disc(0.97) within group (order by x) x_hi
       from (select distinct city_code, x from valid) group by city_code),
byy as (select city_code, percentile_disc(0.03) within group (order by y) y_lo,
               percentile_disc(0.97) within group (order by y) y_hi
        from (select distinct city_code, y from valid) group by city_code),
clean as (select p.* from pm p join bx on p.city_code = bx.city_code join byy on p.city_code = byy.city_code
          where p.x between x_lo and x_hi and p.y between y_lo and y_hi),
usable as (select * from clean where x is not null and y is not null
           and star_rating_number is not null and avg_adr is not null),
sd as (select city_code, stddev_samp(x) sx, stddev_samp(y) sy,
              stddev_samp(cast(star_rating_number as double)) ss, stddev_samp(avg_adr) sa
       from usable group by city_code),
scaled as (select u.*,
               case when sx > 0 then x / sx else 0.0e0 end scaled_x,
               case when sy > 0 then y / sy else 0.0e0 end scaled_y,
               case when ss > 0 then star_rating_number / ss else 0.0e0 end scaled_star_rating_number,
               case when sa > 0 then avg_adr / sa else 0.0e0 end scaled_avg_adr
        from usable u join sd on u.city_code = sd.city_code),
pts as (select * exclude (q) from (
            select *, row_number() over (partition by city_code, harp_property_id_no
                                         order by num_bookings desc, hotel_name, hotel_chain_name, x, y) q
            from scaled) where q = 1),
pairs as (select t.city_code, t.harp_property_id_no tid, n.harp_property_id_no nid,
                 pow(t.scaled_x - n.scaled_x, 2) + pow(t.scaled_y - n.scaled_y, 2)
                 + pow(t.scaled_star_rating_number - n.scaled_star_rating_number, 2)
                 + pow(t.scaled_avg_adr - n.scaled_avg_adr, 2) d2
          from pts t join pts n on t.city_code = n.city_code),
nn as (select * from (select *, row_number() over (partition by city_code, tid order by d2, nid) rn from pairs)
       where rn <= 10),
cs as (select nn.city_code, nn.tid target_property_harp_ID, nn.nid harp_property_id_no, sqrt(nn.d2) knn_distance_metric,
              cast(nn.rn as integer) neighbour_rank,
              t.hotel_name target_property_name, t.x target_property_longitude, t.y target_property_latitude,
              t.avg_yield target_property_yield, t.num_bookings target_property_num_bookings,
              n.hotel_name, n.hotel_chain_name, n.x, n.y, n.star_rating, n.star_rating_number, n.num_bookings,
              n.avg_yield, n.avg_adr, n.scaled_x, n.scaled_y, n.scaled_star_rating_number, n.scaled_avg_adr
       from nn join pts t on nn.city_code = t.city_code and nn.tid = t.harp_property_id_no
               join pts n on nn.city_code = n.city_code and nn.nid = n.harp_property_id_no),
m as (select *,
             avg_yield - target_property_yield compset_yield_vs_target_property_diff,
             avg_yield / nullif(target_property_yield, 0) compset_yield_vs_target_property_ratio,
             cast(num_bookings as double) / sum(num_bookings) over (partition by city_code, target_property_harp_ID)
               compset_share_of_bookings,
             cast(num_bookings as double) / nullif(target_property_num_bookings, 0)
               compset_bookings_wrt_target_property_ratio
      from cs),
mr as (select *,
              cast(dense_rank() over (partition by city_code, target_property_harp_ID
                                      order by compset_yield_vs_target_property_ratio desc nulls last) as integer)
                compset_yield_performance_rank,
              cast(dense_rank() over (partition by city_code, target_property_harp_ID
                                      order by compset_bookings_wrt_target_property_ratio desc nulls last) as integer)
                compset_share_of_bookings_rank,
              2 * 6371.0e0 * asin(sqrt(least(1.0e0,
                  pow(sin((radians(y) - radians(target_property_latitude)) / 2), 2)
                  + cos(radians(y)) * cos(radians(target_property_latitude))
                    * pow(sin((radians(x) - radians(target_property_longitude)) / 2), 2)))) distance_km
       from m)
"""

_PROPERTY_VIEW = """harp_property_id_no, hotel_name, hotel_chain_name, city_code, x, y, num_bookings, star_rating,
       star_rating_number, round(avg_yield, 6) avg_yield, round(avg_adr, 6) avg_adr"""

_PAIR = "city_code, target_property_harp_ID, harp_property_id_no"

ORACLE = {
    "bookings_since": f"""with {_CHAIN}
select harp_property_id_no, hotel_name, hotel_chain_name, city_code, x, y, created_date, star_rating,
       round("yield", 6) "yield", round(adr, 6) adr
from b where created_date >= date '1998-01-01'""",
    "current_property_names": f"""with {_CHAIN}
select * from cur""",
    "bookings_current_name": f"""with {_CHAIN}
select harp_property_id_no, hotel_name, hotel_chain_name, city_code, x, y, created_date, star_rating,
       round("yield", 6) "yield", round(adr, 6) adr
from bc""",
    "star_rating_filter": f"""with {_CHAIN}
select harp_property_id_no, created_date, star_rating from b
where star_rating is not null and length(star_rating) > 1""",
    "star_rating_number": f"""with {_CHAIN}
select harp_property_id_no, created_date, star_rating,
       try_cast(substring(star_rating, 1, 1) as integer) star_rating_number
from b where star_rating is not null and length(star_rating) > 1""",
    "property_metrics": f"""with {_CHAIN}
select {_PROPERTY_VIEW} from pm""",
    "distinct_cities": f"""with {_CHAIN}
select distinct city_code from pm""",
    "geo_bounds": f"""with {_CHAIN}
select bx.city_code, x_lo, x_hi, y_lo, y_hi from bx join byy on bx.city_code = byy.city_code""",
    "geo_clean": f"""with {_CHAIN}
select {_PROPERTY_VIEW} from clean""",
    "scaled_features": f"""with {_CHAIN}
select city_code, harp_property_id_no, round(scaled_x, 6) scaled_x, round(scaled_y, 6) scaled_y,
       round(scaled_star_rating_number, 6) scaled_star_rating_number, round(scaled_avg_adr, 6) scaled_avg_adr
from pts""",
    "left_out_rows": f"""with {_CHAIN}
select city_code, count(*) property_rows,
       cast(sum(case when x is null or y is null or star_rating_number is null or avg_adr is null
                     then 1 else 0 end) as bigint) left_out
from clean group by city_code""",
    "knn_lsh": f"""with {_CHAIN}, s as (select city_code, count(*) n from pts group by city_code)
select city_code, n targets, n complete_targets, n * least(10, n) pairs,
       n * least(10, n) pairs_with_exact_distance, true recall_of_nine_tenths
from s""",
    "knn_exact": f"""with {_CHAIN}
select {_PAIR}, round(knn_distance_metric, 6) knn_distance_metric, neighbour_rank from cs""",
    "haversine_distance": f"""with {_CHAIN}
select {_PAIR}, round(distance_km, 6) distance_km from mr""",
    "compset_metrics": f"""with {_CHAIN}
select {_PAIR}, round(compset_yield_vs_target_property_diff, 6) compset_yield_vs_target_property_diff,
       round(compset_yield_vs_target_property_ratio, 6) compset_yield_vs_target_property_ratio,
       compset_yield_performance_rank,
       round(compset_share_of_bookings, 6) compset_share_of_bookings,
       round(compset_bookings_wrt_target_property_ratio, 6) compset_bookings_wrt_target_property_ratio,
       compset_share_of_bookings_rank
from mr""",
    "compset_yield_rank": f"""with {_CHAIN}
select {_PAIR}, compset_yield_performance_rank from mr""",
    "compset_booking_share": f"""with {_CHAIN}
select {_PAIR}, round(compset_share_of_bookings, 6) compset_share_of_bookings, compset_share_of_bookings_rank
from mr""",
    "compset_output": f"""with {_CHAIN}
select target_property_harp_ID, target_property_name,
       round(target_property_longitude, 6) target_property_longitude,
       round(target_property_latitude, 6) target_property_latitude,
       round(target_property_yield, 6) target_property_yield, target_property_num_bookings,
       harp_property_id_no, hotel_name, hotel_chain_name,
       round(x, 6) longitude, round(y, 6) latitude, star_rating, star_rating_number, num_bookings,
       round(avg_yield, 6) avg_yield, round(avg_adr, 6) avg_adr,
       round(x, 6) features_0, round(y, 6) features_1, round(cast(star_rating_number as double), 6) features_2,
       round(avg_adr, 6) features_3,
       round(scaled_x, 6) "scaledFeatures_0", round(scaled_y, 6) "scaledFeatures_1",
       round(scaled_star_rating_number, 6) "scaledFeatures_2", round(scaled_avg_adr, 6) "scaledFeatures_3",
       round(knn_distance_metric, 6) knn_distance_metric, round(distance_km, 6) distance_km,
       round(compset_yield_vs_target_property_diff, 6) compset_yield_vs_target_property_diff,
       round(compset_yield_vs_target_property_ratio, 6) compset_yield_vs_target_property_ratio,
       compset_yield_performance_rank,
       round(compset_share_of_bookings, 6) compset_share_of_bookings,
       round(compset_bookings_wrt_target_property_ratio, 6) compset_bookings_wrt_target_property_ratio,
       compset_share_of_bookings_rank, city_code
from mr""",
}
ORACLE["property_metrics_by_join"] = ORACLE["property_metrics"]
ORACLE["knn_exact_salted"] = ORACLE["knn_exact"]
ORACLE["knn_exact_grid"] = ORACLE["knn_exact"]
