"""innsight: lodging-rate and competitive-set analytics on Spark DataFrames.

Two analyses, both expressed as DataFrame plans:

* rate frequency (``operators.rates``): how often each rate bucket, rate type and
  top-3 flag is returned per search session and hotel, and a daily summary;
* competitive sets (``operators.compset``): for every hotel, its k nearest hotels
  in the same city over scaled location / star / ADR features, with yield,
  booking-share and great-circle-distance metrics.

Subpackages: ``sources`` (readers and fixture adapters), ``operators`` (the
DataFrame -> DataFrame building blocks), ``functions`` (column expressions),
``plans`` (size-checked joins, lineage cuts, plan text) and ``sinks`` (writers).
``fixed_values`` holds the values that
must equal the source jobs'; ``jobs`` runs both analyses end to end from
``spark-submit``; ``registry`` lists the queries checked against DuckDB.
"""

__version__ = "0.1.0"
