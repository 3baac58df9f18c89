"""Site configurations from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright import schemas
from shelfwright.operators.validate import validate_site_configs

_CONFIGS = T.MapType(T.StringType(), schemas.SITE_CONFIG)


def read_site_configs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) configurations of ``{"sites": {name: …}}`` or a bare ``{name: …}``.

    Invalid ones keep their ``errors``.
    """
    text = spark.read.text(path, wholetext=True)
    inner = F.get_json_object("value", "$.sites")
    parsed = F.from_json(F.coalesce(inner, F.col("value")), _CONFIGS)
    sites = text.select(F.explode(parsed).alias("site_key", "config")).select(
        "site_key", "config.*"
    )
    checked = validate_site_configs(sites)
    return (
        checked.filter("valid").drop("errors", "valid"),
        checked.filter("NOT valid").drop("valid"),
    )
