"""Stored logs: appended batches, partition pruning, retention published in one step.

A store is a folder of tables. A batch of a table is a folder ``<table>/batch=<id>`` of Parquet files partitioned by day (and model),
and what readers see is the newest *snapshot*: a small file that names, for each table, the live batches and the first day of each that still counts.

* An append writes its batch and then publishes a snapshot that names it. The batch id makes it restartable: a batch that is
  there already is left alone, and one that was half written is written again, unseen until then.
* Several tables are published together, so a reader never sees a prediction without its mail, or half a clean-up.
* Retention drops whole days by raising the first day of the live batches (no data is read) and rewrites the day of
  the cut-off, and the old mails that predictions still refer to, as one new batch. ``vacuum`` deletes what no snapshot names.

A *branch* is a line of snapshots of its own over the same batches: a clean-up can be tried, and read, without a copy of the rows
and without the main line seeing it.

A snapshot is written beside its place and renamed; where another writer was first, its state is read and the change
applied again. Filters on ``day``, ``model_name`` and ``batch`` prune partitions when a table is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Partition columns beside the batch; each table has a ``timestamp``. Partial sums are a few rows a day: their day is a plain column.
PARTITIONS = {"emails": ("day",), "predictions": ("day", "model_name"), "user_activity": ("day",), "tracker": ("day",), "scores": ("day",),
              "tracker_hours": (), "prediction_days": ()}
_KEEP = 2  # snapshots that vacuum leaves for readers that are under way


class LogStore:
    def __init__(self, spark: SparkSession, root: str, branch: str = ""):
        self.spark, self.root, self.branch = spark, root.rstrip("/"), branch
        self._line = f"_snapshots-{branch}" if branch else "_snapshots"
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- files ----------------------------------------------------------------------------------------
    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def _names(self, *parts: str) -> list[str]:
        p = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _versions(self) -> list[str]:
        return [n for n in self._names(self._line) if n.isdigit()]

    def _load(self, version: str) -> dict:
        stream = self._fs.open(self._path(self._line, version))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def snapshot(self) -> dict:
        """{table: {"schema": ..., "batches": {batch: first day that counts, or None}}} as last published."""
        versions = self._versions()
        return self._load(versions[-1]) if versions else {}

    def _publish(self, change: Callable[[dict], dict]) -> None:
        """Apply ``change`` to the newest state and publish the result as the next version."""
        while True:
            versions = self._versions()
            state = change(self._load(versions[-1]) if versions else {})
            target = self._path(self._line, f"{int(versions[-1]) + 1 if versions else 1:012d}")
            part = self._path(self._line, f"_{uuid.uuid4().hex}")
            out = self._fs.create(part)
            try:
                out.write(bytearray(json.dumps(state).encode()))
            finally:
                out.close()
            if not self._fs.exists(target) and self._fs.rename(part, target):
                return
            self._fs.delete(part, False)

    def fork(self, branch: str) -> LogStore:
        """The branch of that name, begun with the present state where there is none yet."""
        out, state = LogStore(self.spark, self.root, branch), self.snapshot()
        if not out._versions():
            out._publish(lambda _: state)
        return out

    # -- writing ----------------------------------------------------------------------------------------
    def _write(self, table: str, rows: DataFrame, batch: str) -> str:
        """The batch's files; a rebalance on the partition columns keeps files few and splits a hot day."""
        by = PARTITIONS[table]
        rows = rows.withColumn("day", F.to_date("timestamp"))
        (rows.hint("rebalance", *by) if by else rows.coalesce(1)).write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{table}/batch={batch}")
        plain = [f for f in rows.schema.fields if f.name not in by]
        return T.StructType([*plain, *[rows.schema[c] for c in by], T.StructField("batch", T.StringType())]).json()

    def append(self, batch: str, **tables: DataFrame) -> bool:
        """Append rows to tables under one batch id, published together; False where the batch is there already."""
        if not batch.replace("-", "").replace("_", "").isalnum() or not batch[0].isalpha():
            raise ValueError(f"batch ids are letters, digits, - and _, and start with a letter: {batch!r}")
        state = self.snapshot()
        new = {t: rows for t, rows in tables.items() if batch not in state.get(t, {}).get("batches", {})}
        if not new:
            return False
        with ThreadPool(len(new)) as pool:   # the tables of a batch are written side by side
            schemas = dict(zip(new, pool.starmap(self._write, [(t, rows, batch) for t, rows in new.items()])))

        def change(state: dict) -> dict:
            for t, schema in schemas.items():
                entry = state.setdefault(t, {"schema": schema, "batches": {}})
                entry["batches"].setdefault(batch, None)
            return state
        self._publish(change)
        return True

    # -- reading ----------------------------------------------------------------------------------------
    def read(self, table: str) -> DataFrame:
        """All live rows, with the columns ``day`` and ``batch``."""
        entry = self.snapshot()[table]
        rows = self.spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{self.root}/{table}")
        by_day: dict = {}
        for batch, day in entry["batches"].items():
            by_day.setdefault(day, []).append(batch)
        live = F.lit(False)
        for day, batches in by_day.items():
            some = F.col("batch").isin(batches)
            live = live | (some if day is None else some & (F.col("day") >= F.lit(day).cast("date")))
        return rows.where(live)

    # -- retention --------------------------------------------------------------------------------------
    def retention(self, as_of: str, days: int = 90) -> bool:
        """Drop predictions and activity older than the cut-off, and old mails that no kept prediction refers to. False where this
        clean-up is published already."""
        from mailsignal.operators.analytics import cutoff
        from mailsignal.operators.retention import retention as kept_tables
        cut = self.spark.range(1).select(cutoff(as_of, days=days).alias("c")).first()["c"]
        batch, edge = f"kept-{cut:%Y%m%dT%H%M%S}", cut.date().isoformat()
        seen = self.snapshot()
        names = [t for t in ("emails", "predictions", "user_activity") if t in seen]
        if any(batch in seen[t]["batches"] for t in names):
            return False
        emails, preds, activity = (self.read(t) if t in seen else None for t in ("emails", "predictions", "user_activity"))
        limit = F.lit(edge).cast("date")
        kept_emails, kept_preds, kept_activity = kept_tables(emails, preds, activity if activity is not None else preds, as_of, days)
        # what stays of the cut-off's day, and the older mails still referred to; later days stay where they are
        stay = {"emails": kept_emails.where(F.col("day") <= limit), "predictions": kept_preds.where(F.col("day") == limit), "user_activity": kept_activity.where(F.col("day") == limit)}
        for t in names:
            self._write(t, stay[t].drop("day", "batch"), batch)
        after = self.spark.range(1).select(F.date_add(limit, 1).cast("string")).first()[0]

        def change(state: dict) -> dict:
            for t in names:
                live = state[t]["batches"]
                for b in seen[t]["batches"]:
                    if b in live:
                        live[b] = max(live[b] or after, after)
                live[batch] = None
            return state
        self._publish(change)
        return True

    def vacuum(self) -> None:
        """Delete old snapshots, batches that the kept ones of no branch name, and days before a batch's first day in all of them."""
        versions = self._versions()
        for old in versions[:-_KEEP]:
            self._fs.delete(self._path(self._line, old), False)
        lines = [n.removeprefix("_snapshots").removeprefix("-") for n in self._names() if n.startswith("_snapshots")]
        states = [line._load(v) for line in (LogStore(self.spark, self.root, b) for b in lines) for v in line._versions()[-_KEEP:]]
        for table in {t for s in states for t in s}:
            for folder in self._names(table):
                if not folder.startswith("batch="):
                    continue
                first = [s[table]["batches"][folder[6:]] for s in states if folder[6:] in s.get(table, {}).get("batches", {})]
                if not first:
                    self._fs.delete(self._path(table, folder), True)
                elif None not in first:
                    for day in self._names(table, folder):
                        if day.startswith("day=") and day[4:] < min(first):
                            self._fs.delete(self._path(table, folder, day), True)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Names, sizes and times of the files under ``paths``: another one when a table is written anew."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = []
    for p in paths:
        path = hadoop.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(sorted(out)))).replace("-", "")
