"""Session settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and dynamic partition overwrite.

    Sizes (shuffle partitions, memory) belong to the cluster; pass them in ``conf``
    with dots replaced by double underscores, or as a plain mapping.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
