import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from shelfwright import build_session

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.log.level": "ERROR",
        },
    )
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate a Column built from named text values."""

    def run(build, **texts):
        names = list(texts)
        df = spark.createDataFrame([tuple(texts.values())], ", ".join(f"{n} string" for n in names))
        from pyspark.sql import functions as F

        return df.select(build(*[F.col(n) for n in names]).alias("x")).first()["x"]

    return run
