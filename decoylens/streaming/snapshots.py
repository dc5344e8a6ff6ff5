"""The newest row per key from a stream of changes, kept in levelled runs of files.

Each batch of changes is a run of level 0. When ``FAN`` runs of a level have gathered, they are merged into one run of
the next level that holds the newest row of each key, so t batches leave fewer than FAN * log(t) runs. A pointer file
names the runs that count; it is replaced by an atomic rename, after the files it names are complete. So a reader sees
the table before or after a batch, never in between, and a batch that is replayed after a failure changes nothing:
either the pointer has it, or its half-written run is overwritten. Merged runs are removed one merge later, so that a
reader that holds the pointer before can finish.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

FAN = 8
BATCH = "_batch"


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._path, self._conf = hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = hadoop.fs.Path(self.path).getFileSystem(self._conf)

    def state(self) -> dict:
        """``runs`` (level, first and last batch, each in order of batches) and ``gone``, merged runs that still have files."""
        pointer = self._path(f"{self.path}/_pointer")
        if not self._fs.exists(pointer):
            return {"runs": [], "gone": []}
        stream = self._fs.open(pointer)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _point(self, state: dict) -> None:
        jvm, hadoop = self.spark.sparkContext._jvm, self.spark.sparkContext._jvm.org.apache.hadoop.fs
        new, old = self._path(f"{self.path}/_pointer.new"), self._path(f"{self.path}/_pointer")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        overwrite = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        qualified = self._fs.makeQualified(old)
        hadoop.FileContext.getFileContext(qualified.toUri(), self._conf).rename(self._fs.makeQualified(new), qualified, overwrite)

    def _folder(self, run: list[int]) -> str:
        return f"{self.path}/run-{run[0]}-{run[1]}-{run[2]}"

    def _newest(self, runs: list[list[int]]) -> DataFrame:
        rows = self.spark.read.parquet(*map(self._folder, runs))
        whole = F.struct(*rows.columns)
        return rows.groupBy(*self.keys).agg(F.max_by(whole, BATCH).alias("_row")).select("_row.*")

    def add(self, changes: DataFrame, batch: int) -> None:
        """Take in the changes of one batch; batches come in ascending order, the last perhaps again."""
        state = self.state()
        runs, gone = state["runs"], state["gone"]
        if runs and batch <= runs[-1][2]:
            return
        runs.append([0, batch, batch])
        changes.withColumn(BATCH, F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(self._folder(runs[-1]))
        self._point({"runs": runs, "gone": gone})
        merged: list[list[int]] = []
        while len(last := [r for r in runs if r[0] == runs[-1][0]]) >= FAN:
            whole = [last[0][0] + 1, last[0][1], last[-1][2]]
            self._newest(last).write.mode("overwrite").parquet(self._folder(whole))
            runs, merged = [*runs[: -len(last)], whole], [*merged, *last]
        if merged:
            self._point({"runs": runs, "gone": merged})
            for run in gone:
                self._fs.delete(self._path(self._folder(run)), True)

    def read(self) -> DataFrame | None:
        """The newest row per key; None before the first batch."""
        runs = self.state()["runs"]
        return self._newest(runs).drop(BATCH) if runs else None
