"""Tables that grow by a run for each batch: a log whose runs are merged, level by level, as it gets longer."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: So many runs of one level become one of the next.
FAN = 4


class Runs:
    """Rows in runs ``run-<first batch>-<last batch>``; ``merged`` says how rows of several runs with equal keys become one.

    A batch that runs again replaces its run.  Runs are merged before the next batch is written, so a run with several batches holds
    finished ones only; each row is rewritten as often as the log has levels, which is the logarithm of the number of batches.  A run without Spark's mark of success is no run.  Merged runs are
    deleted one merge later, so a table that was read before a batch is good until after it.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, merged: Callable[[DataFrame], DataFrame], fan: int = FAN):
        self.spark, self.folder, self.schema, self.merged, self.fan = spark, folder, schema, merged, fan
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _all(self) -> list[tuple[int, int]]:
        if not self._fs.exists(self._path("")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(""))]
        found = [(int(m[1]), int(m[2])) for n in names if (m := re.fullmatch(r"run-(\d+)-(\d+)", n)) and self._fs.exists(self._path(f"{n}/_SUCCESS"))]
        return sorted(found)

    def runs(self, before: int | None = None) -> list[tuple[int, int]]:
        """(first, last) of the runs that count, of batches before one only if that is given."""
        every = [r for r in self._all() if before is None or r[1] < before]
        return [r for r in every if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in every)]

    def _name(self, run: tuple[int, int]) -> str:
        return f"run-{run[0]:012d}-{run[1]:012d}"

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{self._name(r)}" for r in runs])

    def read(self, before: int | None = None) -> DataFrame:
        return self.merged(self._read(self.runs(before)))

    def rows(self) -> DataFrame:
        """All runs, not merged."""
        return self._read(self.runs())

    def append(self, rows: DataFrame, batch: int) -> None:
        self.compact(batch)
        self._write(rows, (batch, batch))

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        columns = [c.split(" ")[0] for c in re.split(r",\s*(?![^<]*>)", self.schema)]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{self._name(run)}")

    def _level(self, run: tuple[int, int]) -> int:
        level, size = 0, run[1] - run[0] + 1
        while size >= self.fan:
            level, size = level + 1, size // self.fan
        return level

    def compact(self, before: int) -> None:
        """Merge the last runs before a batch while ``fan`` of them are of one level."""
        now = self.runs(before)
        for run in self._all():
            if run[1] < before and run not in now:
                self._fs.delete(self._path(self._name(run)), True)
        while len(now) >= self.fan and len({self._level(r) for r in now[-self.fan :]}) == 1:
            last = now[-self.fan :]
            whole = (last[0][0], last[-1][1])
            self._write(self.merged(self._read(last)), whole)
            now = [*now[: -self.fan], whole]
