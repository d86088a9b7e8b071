"""Session construction for local runs (tests, bench, driver smoke checks).

On a cluster the session comes from ``spark-submit``; nothing here is needed
there except that ``spark.checkpoint.dir`` names a shared folder.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every run of this package expects; the cluster-sized knobs
# (shuffle partitions, maxPartitionBytes, executors) belong to the deployment.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int = 8,
    app_name: str = "innsight",
    driver_memory: str = "8g",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """A ``local[cores]`` session; without ``spark.checkpoint.dir`` in ``extra_conf``, lineage cuts persist."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
    )
    for key, value in {**BASE_CONF, **(extra_conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
