"""A Spark data source for flows kept as yearly CSV members of zip archives."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql import functions as F

_ROWS = 8192


@dataclass
class Member(InputPartition):
    """One CSV member of one archive, and the year in its name."""

    archive: str
    name: str
    year: int


class FlowArchive(DataSource):
    """Format `flow_archive`: rows (i, j, k, year, v) of archives whose members are named with their year.

    Options: `path`, an archive or a folder of archives that all executors can open; `pattern`, a regular expression with
    the year as its group. A member is a partition; conditions on `year` are met by the names, so other years' members are
    not opened. Members start with a header that names t, i, j, k, v (others are passed over, order is free); an empty
    value is null; a member that has no such header, or a row whose year is not its member's, is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "flow_archive"

    def schema(self) -> str:
        return "i long, j long, k string, year int, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], re.compile(options.get("pattern", r"_Y(\d{4})[^/]*\.csv$"))
        self.conditions: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == ("year",):
                self.conditions.append(f)
            else:
                yield f

    def _wanted(self, year: int) -> bool:
        tests = {EqualTo: lambda x: year == x, In: lambda x: year in x, GreaterThan: lambda x: year > x, GreaterThanOrEqual: lambda x: year >= x, LessThan: lambda x: year < x, LessThanOrEqual: lambda x: year <= x}
        return all(tests[type(f)](f.value) for f in self.conditions)

    def partitions(self) -> list[Member]:
        """Only directories of archives are read here."""
        import os

        path = self.path.removeprefix("file://") if self.path.startswith("file:/") else self.path
        archives = [path] if not os.path.isdir(path) else sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".zip"))
        out = []
        for a in archives:
            with zipfile.ZipFile(a) as z:
                out += [Member(a, n, int(m[1])) for n in z.namelist() if (m := self.pattern.search(n))]
        return [m for m in out if self._wanted(m.year)]

    def read(self, partition: Member | None) -> Iterator:
        import pyarrow as pa

        if partition is None:  # no member is wanted
            return
        kinds = {"i": (int, pa.int64()), "j": (int, pa.int64()), "k": (str, pa.string()), "t": (int, pa.int32()), "v": (float, pa.float64())}
        with zipfile.ZipFile(partition.archive) as z, z.open(partition.name) as raw:
            rows = csv.reader(io.TextIOWrapper(raw, "utf-8", newline=""))
            header = next(rows, [])
            if missing := set(kinds) - set(header):
                raise ValueError(f"{partition.name} lacks {sorted(missing)}")
            at = [header.index(c) for c in kinds]
            held: list[list] = []

            def batch():
                columns = [pa.array([None if (x := r[k].strip()) == "" else kind(x) for r in held], t) for k, (kind, t) in zip(at, kinds.values(), strict=True)]
                if any(y != partition.year for y in columns[3].to_pylist()):
                    raise ValueError(f"{partition.name} has rows of another year")
                return pa.RecordBatch.from_arrays(columns, names=["i", "j", "k", "year", "v"])

            for r in rows:
                held.append(r)
                if len(held) == _ROWS:
                    yield batch()
                    held = []
            if held:
                yield batch()


def read_archives(spark: SparkSession, path: str, years: list[int] | None = None, pattern: str | None = None) -> DataFrame:
    """Flows (i, j, k, year, v) of archived CSV files; product codes have six digits. Repeated years count once."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FlowArchive)
    reader = spark.read.format("flow_archive").option("path", path)
    df = (reader.option("pattern", pattern) if pattern else reader).load()
    df = df if years is None else df.where(F.col("year").isin(*sorted(set(years))))
    return df.withColumn("k", F.lpad("k", 6, "0"))


def write_archives(flows: DataFrame, path: str) -> None:
    """Flows as zip archives under `path`, a folder that all executors can write: one archive a year and task, with one member.

    A year's rows are dealt to as many tasks as a shuffle has, so a task's share does not grow to a whole year. A task that is run again writes the same name, so nothing is left twice.
    """
    import os

    folder = path.removeprefix("file://") if path.startswith("file:/") else path
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        now, held = None, None
        task = TaskContext.get().partitionId()

        def close():
            z, raw, text = held
            text.flush()
            text.detach()
            raw.close()
            z.close()
            os.replace(z.filename, z.filename.removesuffix(".part"))

        for b in batches:
            for i, j, k, year, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if year != now:
                    if held:
                        close()
                    z = zipfile.ZipFile(f"{folder}/flows-{year}-{task}.zip.part", "w", zipfile.ZIP_DEFLATED)
                    raw = z.open(f"flows_Y{year}.csv", "w", force_zip64=True)
                    text = io.TextIOWrapper(raw, "utf-8", newline="", write_through=True)
                    now, held, out = year, (z, raw, text), csv.writer(text)
                    out.writerow(["t", "i", "j", "k", "v"])
                out.writerow([year, i, j, k, "" if v is None else repr(v)])
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32())], names=["task"])

    tasks = int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flows.select("i", "j", "k", "year", "v").repartition(tasks, "year", F.pmod(F.xxhash64("i", "j", "k", "v"), F.lit(tasks))).sortWithinPartitions("year").mapInArrow(run, "task int").write.format("noop").mode("overwrite").save()
