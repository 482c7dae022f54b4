"""A table of bars in date partitions, changed batch by batch.

A version of the table is a manifest: for every partition the folder that holds its
rows. A batch reads and rewrites the partitions that it has rows of, into a folder
of its own, and commits a manifest that takes all others over as they are. Readers
follow the newest committed manifest, so they never see half a batch and files of
untouched partitions stay the same files. The manifest has a row per partition, and
so grows with the calendar, not with the bars.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import c
from .bars import keep_last, upsert

_MANIFEST = "part string, folder string, columns string"


@dataclass(frozen=True)
class BarStore:
    """keys identify a row; the last of them is the time that partitions it, by
    `period` (month, day, year)."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...] = ("symbol", "date")
    period: str = "month"

    def versions(self, before: int | None = None) -> list[int]:
        """Committed versions, oldest first."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        ids = sorted(int(n[2:]) for n in names if n.startswith("v="))
        done = lambda i: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self._manifest(i)}/_SUCCESS"))
        return [i for i in ids if (before is None or i < before) and done(i)]

    def folders(self, version: int | None = None) -> dict[str, str]:
        """Partition -> folder of a version, the newest by default."""
        return {part: folder for part, (folder, _) in self._entries(version).items()}

    def read(self, version: int | None = None, start=None, end=None) -> DataFrame | None:
        """The rows of a version; None before the first. Dates bound the partitions
        that are listed, then the rows."""
        entries = self._entries(version)
        if not entries:
            return None
        low, high = (None if d is None else str(self._part_of(d)) for d in (start, end))
        chosen = {p: e for p, e in entries.items() if (low is None or p >= low) and (high is None or p <= high)}
        df = self._rows(chosen or dict([next(iter(entries.items()))]))
        if start is not None:
            df = df.filter(c(self.keys[-1]) >= F.lit(start))
        return df if end is None else df.filter(c(self.keys[-1]) <= F.lit(end))

    def upsert(self, batch: DataFrame, version: int | None = None, order: Sequence[Column] | None = None) -> int:
        """Merge a batch: its values win, its gaps are filled from the stored row.

        Of several batch rows with the same keys the last in `order` counts (by
        default the greatest by all columns); rows without a time are left out.
        version: the number to commit, one more than the newest by default. A version that is committed
        already stays as it is, so a batch delivered twice counts once."""
        known = self.versions()
        version = (known[-1] + 1 if known else 0) if version is None else version
        if version in known:
            return version
        before = self._entries(max((v for v in known if v < version), default=None)) if known else {}
        time = self.keys[-1]
        rest = [c(x) for x in batch.columns if x not in self.keys]
        batch = batch.filter(c(time).isNotNull())
        batch = keep_last(batch, order or [F.struct(*rest) if rest else F.lit(0)], self.keys)
        # Written once: the partitions it touches are asked for, then it is merged.
        folder = f"{self.path}/data/v={version:010d}"
        staged = f"{self.path}/batch/v={version:010d}"
        batch.withColumn("__part", self._part(time)).write.mode("overwrite").parquet(staged)
        batch = self.spark.read.parquet(staged)
        touched = [r["__part"] for r in batch.select("__part").distinct().collect()]
        old = {p: before[p] for p in touched if p in before}
        out = batch.drop("__part")
        if old:
            out = upsert(self._rows(old), out, self.keys)
        out = out.withColumn("__part", self._part(time))
        # A month of a hot symbol is many rows: neither key decides the task alone.
        spread = F.pmod(F.xxhash64(*[c(k) for k in self.keys]), F.lit(8))
        out.repartition("__part", spread).write.mode("overwrite").partitionBy("__part").parquet(folder)
        columns = ",".join(x for x in out.columns if x != "__part")
        entries = {**before, **{p: (folder, columns) for p in touched}}
        rows = [(p, f, x) for p, (f, x) in sorted(entries.items())]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(self._manifest(version))
        return version

    def _rows(self, entries: dict[str, tuple[str, str]]) -> DataFrame:
        """Partitions of one batch are read together; batches may differ in columns."""
        groups: dict[tuple[str, str], list[str]] = {}
        for part, entry in sorted(entries.items()):
            groups.setdefault(entry, []).append(part)
        out = None
        for (folder, _), parts in groups.items():
            df = self.spark.read.parquet(*[f"{folder}/__part={p}" for p in parts])
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def _entries(self, version: int | None) -> dict[str, tuple[str, str]]:
        if version is None:
            known = self.versions()
            if not known:
                return {}
            version = known[-1]
        rows = self.spark.read.schema(_MANIFEST).json(self._manifest(version)).collect()
        return {r["part"]: (r["folder"], r["columns"]) for r in rows}

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/v={version:010d}"

    def _part(self, time: str) -> Column:
        return F.date_format(F.date_trunc(self.period, c(time)), "yyyyMMdd")

    def _part_of(self, day) -> str:
        return self.spark.range(1).select(F.date_format(F.date_trunc(self.period, F.lit(day).cast("timestamp")), "yyyyMMdd")).first()[0]
