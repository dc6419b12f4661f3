"""Results and states of runs as tables in a folder."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = "run_id string, name string, version string"
STATUS = "run_id string, status string, stage string, pct int, error string, debug_error string, updated_at timestamp"


class RunStore:
    """Artifacts of runs below a root, and states as an append-only table.

    Each artifact is written to a folder of its own, `root/name/run_id=.../version=...`, and counts from when a row with
    its version is appended to `root/versions`, which Spark's committer does at once or not at all. So readers see the
    old artifact or the new one, never a gap or a part, and a writer that dies leaves the old one. The version before
    the current one is kept for readers that have begun with it; older ones go.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, run_id: str, name: str, df: DataFrame, fmt: str = "parquet") -> None:
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        df.write.format(fmt).save(f"{self.root}/{name}/run_id={run_id}/version={version}")
        row = self.spark.createDataFrame([(run_id, name, version)], VERSIONS)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        self._prune(run_id, name)

    def _versions(self) -> DataFrame:
        found = self._read("versions", schema=VERSIONS)
        return self.spark.createDataFrame([], VERSIONS) if found is None else found

    def _prune(self, run_id: str, name: str) -> None:
        """Deletes what was published and is older than the version before the current one."""
        known = sorted(r.version for r in self._versions().filter((F.col("run_id") == run_id) & (F.col("name") == name)).collect())
        for version in known[:-2]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/run_id={run_id}/version={version}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def find(self, run_id: str, name: str, fmt: str = "parquet") -> DataFrame | None:
        """The current version of an artifact; None if there is none."""
        last = self._versions().filter((F.col("run_id") == run_id) & (F.col("name") == name)).agg(F.max("version")).first()[0]
        return None if last is None else self._read(f"{name}/run_id={run_id}/version={last}", fmt)

    def load(self, run_id: str, name: str, fmt: str = "parquet") -> DataFrame:
        found = self.find(run_id, name, fmt)
        if found is None:
            raise FileNotFoundError(f"run {run_id} has no {name}")
        return found

    def all_runs(self, name: str) -> DataFrame | None:
        """The current versions of an artifact of all runs, with run_id; None if no run has it."""
        rows = self._read(name)
        if rows is None:
            return None
        last = self._versions().filter(F.col("name") == name).groupBy("run_id").agg(F.max("version").alias("version"))
        return rows.withColumns({c: F.col(c).cast("string") for c in ("run_id", "version")}).join(last, ["run_id", "version"], "left_semi").drop("version")

    def _read(self, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame | None:
        """The table at a path below the root; None if there is none. Other failures to read are raised."""
        reader = self.spark.read.format(fmt)
        try:
            return (reader.schema(schema) if schema else reader).load(f"{self.root}/{path}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def save_input(self, run_id: str, raw: DataFrame) -> None:
        """The rows as they were given, before anything is dropped or renamed."""
        self.save(run_id, "input", raw)

    def save_label_cache(self, run_id: str, cache: dict[str, str]) -> None:
        if cache:
            self.save(run_id, "label_cache", self.spark.createDataFrame(sorted(cache.items()), "key string, label string").coalesce(1))

    def label_cache(self, run_id: str) -> dict[str, str]:
        """Labels that a labeller gave in this run before; as few as its budget."""
        found = self.find(run_id, "label_cache")
        return {} if found is None else {r.key: r.label for r in found.collect()}

    def aspect_payload(self, run_id: str) -> tuple[DataFrame, DataFrame | None]:
        """The aspects of a run, and its granules where they were kept."""
        return self.load(run_id, "aspects"), self.find(run_id, "granules")

    def set_status(self, run_id: str, status: str, stage: str, pct: int, error: str | None = None, debug_error: str | None = None) -> None:
        row = self.spark.createDataFrame([(run_id, status, stage, max(0, min(100, pct)), error, debug_error)], "run_id string, status string, stage string, pct int, error string, debug_error string")
        row.withColumn("updated_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/status")

    def statuses(self) -> DataFrame:
        """The last state of each run."""
        rows = self._read("status", schema=STATUS)
        if rows is None:
            return self.spark.createDataFrame([], STATUS)
        fields = [f for f in rows.columns if f != "run_id"]
        return rows.groupBy("run_id").agg(F.max_by(F.struct(*fields), F.struct("updated_at", "pct")).alias("s")).select("run_id", *[f"s.{f}" for f in fields])

    def status(self, run_id: str) -> dict:
        found = self.statuses().filter(F.col("run_id") == run_id).first()
        return found.asDict() if found else {"run_id": run_id, "status": "queued", "stage": "queued", "pct": 0, "error": None}

    def recent(self, limit: int = 20) -> DataFrame:
        """The last runs, newest first, with the number of items and clusters of those that have got so far."""
        out, kept, seen = self.statuses(), self.all_runs("items"), self.all_runs("overview")
        none = F.lit(None).cast("long")
        # the overview has the number of those that have ended, the items of those that have got so far
        counts = kept.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count("*").alias("n_kept")) if kept is not None else self.spark.createDataFrame([], "run_id string, n_kept long")
        ended = seen.select(F.col("run_id").cast("string").alias("run_id"), F.col("items").alias("n_seen"), F.col("clusters").alias("cluster_count")) if seen is not None else self.spark.createDataFrame([], "run_id string, n_seen long, cluster_count int")
        out = out.join(ended, "run_id", "left").join(counts, "run_id", "left").withColumn("item_count", F.coalesce("n_seen", "n_kept", none)).drop("n_seen", "n_kept")
        return out.orderBy(F.col("updated_at").desc()).limit(max(1, min(100, limit)))

    def require_completed(self, run_id: str) -> None:
        state = self.status(run_id)
        if state["status"] == "failed":
            raise RuntimeError(state.get("error") or "the run failed")
        if state["status"] != "completed":
            raise RuntimeError("the run is not completed")
