"""Stage tables that a run owns: kept in its folder, reused after a failure, removed at its end.

::

    with StageRun(spark, "/shared/rice-2021", version="weather of 2021-12-31"):
        result = interpolate_region_climate(...)
        files.write_csv(result, target, keys)

All stage tables made inside the block lie in the folder, numbered in the order in which
they are made, each with an entry in a manifest that is written once its data are complete.
If the block fails, the folder stays; the same block run again takes the tables up to the
last complete one from there. If it ends well, the folder goes.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .tables import OWNER, partitioned_writer


class StageRun:
    """A context in which ``materialize`` writes into ``folder``, in reach of all executors.

    Results are lazy: write them inside the block. ``version`` names the inputs and
    settings; tables of another version, or with another label or schema, are made again,
    and so is everything after the first such table. ``keep`` leaves the folder in place.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str = "", keep: bool = False):
        if not folder:
            raise ValueError("name a folder that the driver and all executors can reach")
        self.spark, self.folder, self.version, self.keep = spark, folder.rstrip("/"), version, keep
        self.made: list[str] = []
        self.reused: list[str] = []

    def __enter__(self) -> StageRun:
        self.made, self.reused, self._reusing = [], [], True
        self._token = OWNER.set(self)
        return self

    def __exit__(self, kind, error, trace) -> None:
        OWNER.reset(self._token)
        if kind is None and not self.keep:
            self.remove()

    def remove(self) -> None:
        files, path = self._at(self.folder)
        files.delete(path, True)

    def stage(self, df: DataFrame, label: str, partition_by: Sequence[str] = (), rebalance: bool = True) -> DataFrame:
        """The next table of the run: read if it is complete, else written."""
        name = f"{len(self.made) + len(self.reused):04d}-{label}"
        target = f"{self.folder}/{name}"
        entry = {"version": self.version, "schema": df.schema.jsonValue(), "partition_by": list(partition_by)}
        self._reusing = self._reusing and self._manifest(name) == entry
        if self._reusing:
            self.reused.append(name)
        else:
            self._forget(name)
            partitioned_writer(df, partition_by, rebalance).mode("overwrite").parquet(target)
            self._record(name, entry)
            self.made.append(name)
        return self.spark.read.schema(df.schema).parquet(target).select(*df.columns)

    def _at(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _entry(self, name: str):
        return self._at(f"{self.folder}/_manifest/{name}.json")

    def _manifest(self, name: str) -> dict | None:
        files, path = self._entry(name)
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except (ValueError, Py4JJavaError):  # the driver was lost while it wrote
            return None
        finally:
            stream.close()

    def _forget(self, name: str) -> None:
        files, path = self._entry(name)
        files.delete(path, False)

    def _record(self, name: str, entry: dict) -> None:
        files, path = self._entry(name)
        stream = files.create(path, True)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
