"""Session settings that the engine's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Timestamps carry no zone and ANSI errors replace silent wrap-around.
REQUIRED = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}


def get_session(app: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the required settings; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (REQUIRED | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
