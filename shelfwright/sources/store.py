"""A product store that a run adds to: five tables in buckets of the product id, one layer a run.

A run writes its own products and nothing else. Each table is laid out by run and, within it, by bucket of the product id, so
what belongs to one product lies in one bucket of all tables and all runs, and reading joins the tables without a
shuffle. Of a product stored in several runs the last one counts, with its children and no others. Layers are merged into one
when there are many, which a product takes part in only now and then.

A marker file names the layers that are current, so a run that fails leaves the store as it was, and its leftovers are
overwritten by the next one. One writer at a time.
"""

from __future__ import annotations

import hashlib
import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright import schemas
from shelfwright.operators.relational import TABLES, latest_products, to_relational

#: Layers beyond which a run merges all of them.
MOST_LAYERS = 8
KEYS = {name: "id" if name == "products" else "product_id" for name in TABLES}


class ProductStore:
    """The store below a folder. ``buckets`` counts when the store is made; afterwards the store knows it."""

    def __init__(self, spark: SparkSession, directory: str, buckets: int | None = None, most_layers: int = MOST_LAYERS):
        self.spark, self.root = spark, directory.rstrip("/")
        self.most_layers = most_layers
        empty = to_relational(spark.createDataFrame([], schemas.PRODUCT))
        self.schemas = {name: table.schema for name, table in empty.items()}
        state = self._state()
        if state is None:
            state = {"run": 0, "layers": [], "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))}
        self.run, self.layers, self.buckets = state["run"], state["layers"], state["buckets"]

    def _folder(self, path: str):
        """The file system of a path, and the path as it takes it."""
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(self.spark._jsc.hadoopConfiguration()), made

    def _runs(self) -> list[int]:
        fs, root = self._folder(self.root)
        if not fs.exists(root):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        return sorted(int(n[6:]) for n in names if n.startswith("ready-"))

    def _state(self) -> dict | None:
        runs = self._runs()
        if not runs:
            return None
        fs, marker = self._folder(f"{self.root}/ready-{runs[-1]}")
        stream = fs.open(marker)
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def _known(self, name: str) -> str:
        return f"store_{hashlib.md5(self.root.encode()).hexdigest()[:16]}_{name}"

    def _table(self, name: str) -> str:
        """The table in the session's catalogue, made anew over its files, as other sessions may have added to them."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schemas[name].fields)
        known = self._known(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {known}")
        self.spark.sql(
            f"CREATE TABLE {known} ({schema}, run BIGINT) USING parquet PARTITIONED BY (run)"
            f" CLUSTERED BY ({KEYS[name]}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'"
        )
        fs, folder = self._folder(f"{self.root}/{name}")
        if fs.exists(folder):
            self.spark.catalog.recoverPartitions(known)
        return known

    @contextmanager
    def _settings(self, **values: str):
        """Settings of the session while a step runs."""
        names = {key: f"spark.sql.{key.replace('__', '.')}" for key in values}
        before = {key: self.spark.conf.get(name) for key, name in names.items()}
        try:
            for key, name in names.items():
                self.spark.conf.set(name, values[key])
            yield
        finally:
            for key, name in names.items():
                self.spark.conf.set(name, before[key])

    def _write(self, tables: dict[str, DataFrame], run: int) -> None:
        """A layer; a task of the tables given holds the rows of one bucket, in order, and writes them as they come."""
        for name, table in tables.items():
            known = self._table(name)
            with self._settings(
                sources__partitionOverwriteMode="dynamic",
                sources__bucketing__autoBucketedScan__enabled="false",
                maxConcurrentOutputFileWriters="8",
            ):
                table.withColumn("run", F.lit(run).cast("long")).write.insertInto(known, overwrite=True)

    def _batch(self, products: DataFrame, order: str | None, path: str) -> DataFrame:
        """The last product of each id, stored in the buckets of the tables, in order of ids.

        The shuffle that finds the last ones deals the rows to the buckets, so the tables are cut without another.
        """
        known = self._known("batch")
        fields = [f for f in products.schema.fields if f.name in schemas.PRODUCT.names]
        latest = latest_products(products, order).select(*[f.name for f in fields])
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            latest = latest.repartition(self.buckets, "id").sortWithinPartitions("id")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        self.spark.sql(f"DROP TABLE IF EXISTS {known}")
        self.spark.sql(
            f"CREATE TABLE {known} ({schema}) USING parquet CLUSTERED BY (id) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        with self._settings(adaptive__coalescePartitions__enabled="false", maxConcurrentOutputFileWriters="8"):
            latest.write.insertInto(known, overwrite=True)
        return self.spark.table(known)

    def _mark(self, run: int, layers: list[int]) -> None:
        fs, marker = self._folder(f"{self.root}/ready-{run}")
        stream = fs.create(marker, True)
        stream.writeUTF(json.dumps({"run": run, "layers": layers, "buckets": self.buckets}))
        stream.close()
        for old in self._runs()[:-2]:
            fs.delete(self._folder(f"{self.root}/ready-{old}")[1], False)
        # Layers of the marker before this one stay, for readers that still use it.
        kept = {*layers, *self.layers, run}
        for gone in set(range(1, run)) - kept:
            for name in TABLES:
                fs.delete(self._folder(f"{self.root}/{name}/run={gone}")[1], True)
        self.run, self.layers = run, layers

    def add(self, products: DataFrame, order: str | None = None) -> None:
        """Add products; those stored under the same id are replaced. Of a repeated id the last by ``order`` stays, or by place.

        The batch is stored before it is cut into tables, so all five tables hold the same choice of rows.
        """
        run = self.run + 1
        batch = f"{self.root}/batch-{run}"
        try:
            self._write(to_relational(self._batch(products, order, batch)), run)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._known('batch')}")
            fs, path = self._folder(batch)
            fs.delete(path, True)
        self._mark(run, [*self.layers, run])
        if len(self.layers) > self.most_layers:
            self.merge()

    def merge(self) -> None:
        """Write what the layers hold now as one layer; a read of it has nothing to choose."""
        run = self.run + 1
        tables = (self.read() or {}).items()
        self._write({n: t.repartition(self.buckets, KEYS[n]).sortWithinPartitions(KEYS[n]) for n, t in tables}, run)
        self._mark(run, [run])

    def read(self) -> dict[str, DataFrame] | None:
        """The five tables as they are now; None before the first run."""
        if not self.layers:
            return None
        raw = {name: self.spark.table(self._table(name)).where(F.col("run").isin(self.layers)) for name in TABLES}
        if len(self.layers) == 1:
            return {name: t.drop("run") for name, t in raw.items()}
        # All rows of a product lie in one bucket, so its last run is found, and joined, without a shuffle.
        last = raw["products"].groupBy("id").agg(F.max("run").alias("run"))
        return {
            name: t.join(last.withColumnRenamed("id", KEYS[name]), [KEYS[name], "run"], "left_semi").drop("run")
            for name, t in raw.items()
        }
