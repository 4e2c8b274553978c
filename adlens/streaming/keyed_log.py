"""An append-only log of mergeable rows, compacted by key bucket.

A streaming trigger appends its rows (partial sums, or new versions of records) under its
batch id; readers merge all rows of a key. Nothing is ever late: rows of any age merge with
what is there. A batch that runs again replaces what its earlier try wrote, so every batch
counts once.

``compact`` merges the batches since the last compaction into the *state*: one row per key,
in hash buckets of the key. Only the buckets those batches touch are rewritten, as a new
version; a bucket's newest committed version is its state. Reading costs the state and the
batches since, however many triggers there have been.

    path/log/batch_id=N/bucket=B/...     rows of batch N
    path/state/upto=N/bucket=B/...       merged rows of all batches up to N of a bucket they touch

A folder counts once Spark has committed it (``_SUCCESS``), so an interrupted append or
compaction leaves no trace. Files that a compaction replaces are deleted by the next one.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 16


class KeyedLog:
    """``merge`` maps rows of several versions or parts of keys to one row per key, with the same columns."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame],
                 buckets: int = BUCKETS, compact_every: int | None = 20):
        self.spark, self.path, self.keys, self.merge = spark, path.rstrip("/"), list(keys), merge
        self.buckets, self.compact_every = buckets, compact_every

    def _bucket(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Write one batch; a batch the state has already taken in is left alone."""
        done = self._versions("state")
        if done and batch_id <= max(done):
            return
        parts = rows.withColumn("bucket", self._bucket(*(F.col(k) for k in self.keys)))
        parts.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/log/batch_id={batch_id}")
        if self.compact_every and len(self._open_batches()) >= self.compact_every:
            self.compact()

    def compact(self) -> list[int]:
        """Merge the open batches into the state; returns the buckets rewritten."""
        batches = self._open_batches()
        if not batches:
            return []
        touched = sorted({b for own in batches.values() for b in own})
        before, state = self._versions("state"), self._state()
        old = {b: v for b, v in state.items() if b in touched}
        target = f"{self.path}/state/upto={max(batches)}"
        merged = self._merged(old, batches)
        if merged is None:  # empty batches only: nothing changes but the place in the log
            self.spark.range(0).write.mode("overwrite").parquet(target)
        else:
            (merged.withColumn("bucket", self._bucket(*(F.col(k) for k in self.keys)))
             .repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target))
        # what the version before this one had superseded; its own files stay for readers under way
        for batch in self._versions("log"):
            if batch <= max(before, default=-1):
                self._delete(f"log/batch_id={batch}")
        for version, own in before.items():
            for bucket in own:
                if state[bucket] != version:
                    self._delete(f"state/upto={version}/bucket={bucket}")
        return touched

    def read(self, **key) -> DataFrame | None:
        """One row per key; with a value for every key, of that key alone (one bucket is read). None before any row."""
        state, batches = self._state(), self._open_batches()
        if key:
            if set(key) != set(self.keys):
                raise ValueError(f"values are needed for all of {self.keys}")
            values = self.spark.range(1).select(*(F.lit(key[k]).alias(k) for k in self.keys))
            only = values.select(self._bucket(*(F.col(k).cast(self._type(k)) for k in self.keys)).alias("b")).first()["b"]
            state = {b: v for b, v in state.items() if b == only}
            batches = {n: [b for b in own if b == only] for n, own in batches.items()}
        out = self._merged(state, batches, key)
        return out

    def _merged(self, state: dict[int, int], batches: dict[int, list[int]], key: dict | None = None) -> DataFrame | None:
        paths = [f"{self.path}/state/upto={v}/bucket={b}" for b, v in state.items()]
        paths += [f"{self.path}/log/batch_id={n}/bucket={b}" for n, own in batches.items() for b in own]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths)
        for k, v in (key or {}).items():
            rows = rows.where(F.col(k).eqNullSafe(F.lit(v)))
        return self.merge(rows)

    def _type(self, column: str) -> str:
        some = next(iter([f"{self.path}/state/upto={v}/bucket={b}" for b, v in self._state().items()]
                         + [f"{self.path}/log/batch_id={n}/bucket={b}" for n, own in self._open_batches().items() for b in own]), None)
        return dict(self.spark.read.parquet(some).dtypes)[column] if some else "string"

    # --- folders ---

    def _fs(self, tail: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{tail}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, tail: str) -> list[str]:
        fs, path = self._fs(tail)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _versions(self, kind: str) -> dict[int, list[int]]:
        """Committed folders by number, with their buckets."""
        out = {}
        for name in self._names(kind):
            inside = self._names(f"{kind}/{name}")
            if "_SUCCESS" in inside:
                out[int(name.split("=")[1])] = sorted(int(x.split("=")[1]) for x in inside if x.startswith("bucket="))
        return out

    def _state(self) -> dict[int, int]:
        """The newest version of each bucket."""
        newest: dict[int, int] = {}
        for version, own in sorted(self._versions("state").items()):
            newest.update(dict.fromkeys(own, version))
        return newest

    def _open_batches(self) -> dict[int, list[int]]:
        upto = max(self._versions("state"), default=-1)
        return {n: own for n, own in sorted(self._versions("log").items()) if n > upto}

    def _delete(self, tail: str) -> None:
        fs, path = self._fs(tail)
        fs.delete(path, True)
