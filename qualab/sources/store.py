"""Parquet-backed stores: dataset catalog (S4-S8), run history (H1-H8), audit log, reports.

Every store is a table under one root folder on shared storage, made of parts and a manifest.  A write puts its
rows into a part of its own, then publishes the part with one manifest row, a single small file that is there or
not: readers see whole writes only, and writers never touch each other's files.  ``compact`` merges the parts of a
table into one and publishes a manifest row that adds it and takes the merged ones away; it counts only if all of
these are still there in the order of the manifest, so of two compactions of the same parts one wins.
Deletes append a tombstone row; readers take the latest event per id.  No database, no
driver-side state: a lookup is a filtered scan.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DATASET_SCHEMA = ("id string, name string, description string, created_at timestamp_ntz, user_id string, "
                  "path string, n_rows bigint, n_columns bigint, op string")
RUN_SCHEMA = ("run_id string, user_id string, created_at timestamp_ntz, problem_type string, target string, "
              "predictors array<string>, dataset string, best_model string, main_metric string, main_value double, "
              "n_models bigint, n_failed bigint, duration_s double, payload string")
HISTORY_SCHEMA = ("run_id string, user_id string, created_at timestamp_ntz, dataset string, target string, "
                  "problem_type string, best_model string, metric string, value double")
CONFIG_SCHEMA = ("config_id string, user_id string, created_at timestamp_ntz, problem_type string, "
                 "target string, predictors array<string>, test_size double")
AUDIT_SCHEMA = ("user_id string, action string, entity string, entity_id string, details string, "
                "created_at timestamp_ntz, session_id string, event_date date")
REPORT_SCHEMA = ("report_id string, name string, kind string, created_at timestamp_ntz, user_id string, "
                 "session_id string, run_id string, dataset string, section string, item string, value string")
MANIFEST_SCHEMA = "created_at timestamp_ntz, added array<string>, removed array<string>"


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


class Store:
    """All tables of one deployment under ``root`` (a shared, durable folder)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # ------------------------------------------------------------------ plumbing
    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, schema: str | None, *paths: str) -> DataFrame | None:
        """The Parquet files below ``paths``, or None where there are none."""
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.parquet(*paths)
        except AnalysisException as missing:
            if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _history(self, name: str) -> tuple[list[str], list[tuple[str, dt.datetime]]]:
        """The table's live parts, oldest first, and the dead ones (merged, or of a compaction that lost) with the time."""
        manifest = self._read(f"{MANIFEST_SCHEMA}, commit string", self.path(f"{name}/manifest"))
        live: dict[str, None] = {}
        dead = []
        for row in manifest.orderBy("created_at", "commit").collect() if manifest is not None else []:
            won = all(part in live for part in row["removed"])
            if won:
                for part in row["removed"]:
                    del live[part]
                live.update(dict.fromkeys(row["added"]))
            dead += [(part, row["created_at"]) for part in (row["removed"] if won else row["added"])]
        return list(live), dead

    def parts(self, name: str) -> list[str]:
        """The table's parts, oldest first: one manifest row a write, so the list is short after ``compact``."""
        return self._history(name)[0]

    def _publish(self, name: str, added: Sequence[str], removed: Sequence[str] = ()) -> None:
        # a folder of its own: Spark's writers to one folder take each other's temporary files away
        row = self._rows([(_now(), list(added), list(removed))], MANIFEST_SCHEMA)
        row.coalesce(1).write.parquet(self.path(f"{name}/manifest/commit=c{uuid.uuid4().hex}"))

    def table(self, name: str, schema: str) -> DataFrame:
        """Current contents of a store table (empty with the right schema when absent)."""
        return self._rows_of(name, schema, self.parts(name))

    def _rows_of(self, name: str, schema: str, parts: Sequence[str]) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        if not parts:
            return empty
        rows = self.spark.read.schema(schema).option("basePath", self.path(name)).parquet(*[self.path(f"{name}/{p}") for p in parts])
        return rows.select(*empty.columns)

    def append(self, name: str, rows: DataFrame, partition_by: Sequence[str] = ()) -> None:
        part = f"part=p{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").partitionBy(*partition_by).parquet(self.path(f"{name}/{part}"))
        self._publish(name, [part])

    def compact(self, name: str, schema: str, partition_by: Sequence[str] = (), files: int = 1) -> bool:
        """Merges the table's parts into one of about ``files`` files; False where there is nothing to merge or another
        compaction came first.  Readers of the merged parts go on undisturbed until ``sweep``."""
        old = self.parts(name)
        if len(old) < 2:
            return False
        part = f"part=p{uuid.uuid4().hex}"
        self._rows_of(name, schema, old).coalesce(files).write.mode("errorifexists").partitionBy(*partition_by).parquet(self.path(f"{name}/{part}"))
        self._publish(name, [part], old)
        return part in self.parts(name)

    def sweep(self, name: str, schema: str, older_than: dt.timedelta = dt.timedelta(days=1)) -> int:
        """Takes the rows of parts away that have been dead for ``older_than``; how many parts."""
        dead = [part for part, since in self._history(name)[1] if _now() - since >= older_than]
        for part in dead:
            self._empty(self.path(f"{name}/{part}"), schema)
        return len(dead)

    def _empty(self, path: str, schema) -> None:
        """Takes the rows below ``path`` away (an empty file stays)."""
        self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # ------------------------------------------------------------------ S4-S8 datasets
    def save_dataset(self, df: DataFrame, name: str, description: str = "", user_id: str | None = None) -> str:
        """Write the table as Parquet (never over an existing folder) and append its catalog
        row; the data folder is removed if the catalog append fails."""
        ds_id = uuid.uuid4().hex
        path = self.path(f"datasets/{ds_id}")
        df.write.mode("errorifexists").parquet(path)
        try:
            saved = self.spark.read.parquet(path)
            n = saved.count()
            row = self._rows([(ds_id, name, description, _now(), user_id, path, n, len(df.columns), "add")],
                             DATASET_SCHEMA)
            self.append("catalog_datasets", row)
        except Exception:
            self._empty(path, df.schema)
            raise
        return ds_id

    def datasets(self, user_id: str | None = None) -> DataFrame:
        """Live catalog rows, newest first.  An id is given once, so a delete event ends it
        whatever the clock says."""
        events = self.table("catalog_datasets", DATASET_SCHEMA)
        gone = events.where(F.col("op") == "delete").select("id")
        live = events.where(F.col("op") == "add").drop("op").join(gone, "id", "left_anti")
        if user_id is not None:
            live = live.where(F.col("user_id") == user_id)
        return live.orderBy(F.col("created_at").desc(), F.col("id"))

    def dataset(self, ds_id: str) -> DataFrame:
        """Point lookup (0 or 1 row)."""
        return self.datasets().where(F.col("id") == ds_id).limit(1)

    def load_dataset(self, ds_id: str) -> DataFrame | None:
        """The stored table, or None when the id or its files are missing."""
        row = self.dataset(ds_id).select("path").first()
        return None if row is None else self._read(None, row["path"])

    def delete_dataset(self, ds_id: str) -> bool:
        """Append a delete event, then take the rows away: a reader never finds a listed dataset empty."""
        row = self.dataset(ds_id).first()
        if row is None:
            return False
        tomb = self._rows([(ds_id, row["name"], row["description"], _now(), row["user_id"], row["path"],
                            row["n_rows"], row["n_columns"], "delete")], DATASET_SCHEMA)
        self.append("catalog_datasets", tomb)
        stored = self._read(None, row["path"])
        if stored is not None:
            self._empty(row["path"], stored.schema)
        return True

    # ------------------------------------------------------------------ H1-H8 runs
    def save_run(self, run: dict, run_metrics: DataFrame) -> None:
        """H1: append the run's headline row and its long metrics (run_id, model, metric, value)."""
        row = (run["run_id"], run.get("user_id"), run.get("created_at") or _now(), run.get("problem_type"),
               run.get("target"), list(run.get("predictors") or []), run.get("dataset"), run.get("best_model"),
               run.get("main_metric"), run.get("main_value"), run.get("n_models"), run.get("n_failed"),
               run.get("duration_s"), json.dumps(run.get("payload") or {}, default=str))
        self.append("runs", self._rows([row], RUN_SCHEMA))
        self.append("run_metrics", run_metrics.select("run_id", "model", "metric", F.col("value").cast("double")))

    def runs(self) -> DataFrame:
        return self.table("runs", RUN_SCHEMA)

    def run_metrics(self) -> DataFrame:
        return self.table("run_metrics", "run_id string, model string, metric string, value double")

    def save_history(self, rows: DataFrame) -> None:
        """H5 append."""
        self.append("history", rows.select(*[c.split(" ")[0] for c in HISTORY_SCHEMA.split(", ")]))

    def history(self) -> DataFrame:
        return self.table("history", HISTORY_SCHEMA)

    def save_config(self, config: dict) -> str:
        """H7 append."""
        cid = config.get("config_id") or uuid.uuid4().hex
        row = (cid, config.get("user_id"), config.get("created_at") or _now(), config.get("problem_type"),
               config.get("target"), list(config.get("predictors") or []), config.get("test_size"))
        self.append("configs", self._rows([row], CONFIG_SCHEMA))
        return cid

    def configs(self) -> DataFrame:
        return self.table("configs", CONFIG_SCHEMA)

    # ------------------------------------------------------------------ H8, R5 audit
    def audit(self, user_id: str, action: str, entity: str, entity_id: str = "", details: str = "",
              session_id: str | None = None) -> bool:
        """H8: append one audit event (partitioned by date); never raises to the caller."""
        try:
            now = _now()
            self.append("audit", self._rows([(user_id, action, entity, entity_id, details, now, session_id,
                                              now.date())], AUDIT_SCHEMA), partition_by=["event_date"])
            return True
        except Exception:  # noqa: BLE001 - auditing must not break the caller
            return False

    def audit_batch(self, events: DataFrame) -> None:
        """H8 for many events at once (a DataFrame with the audit columns)."""
        self.append("audit", events.withColumn("event_date", F.to_date("created_at")), partition_by=["event_date"])

    def audit_log(self) -> DataFrame:
        return self.table("audit", AUDIT_SCHEMA)

    # ------------------------------------------------------------------ O6 reports
    def save_report(self, sections: DataFrame, name: str, kind: str = "complete", user_id: str | None = None,
                    session_id: str | None = None, run_id: str | None = None, dataset: str | None = None) -> str:
        """Append a report as long rows (section, item, value) plus a JSON content row."""
        rid = uuid.uuid4().hex
        blob = sections.agg(F.to_json(F.collect_list(F.struct("section", "item", "value"))).alias("value"))
        body = sections.select("section", "item", F.col("value").cast("string"))
        body = body.unionByName(blob.select(F.lit("_content").alias("section"), F.lit("json").alias("item"), "value"))
        meta = [F.lit(rid).alias("report_id"), F.lit(name).alias("name"), F.lit(kind).alias("kind"),
                F.lit(_now()).cast("timestamp_ntz").alias("created_at"), F.lit(user_id).cast("string").alias("user_id"),
                F.lit(session_id).cast("string").alias("session_id"), F.lit(run_id).cast("string").alias("run_id"),
                F.lit(dataset).cast("string").alias("dataset")]
        self.append("reports", body.select(*meta, "section", "item", "value"))
        return rid

    def report(self, report_id: str) -> DataFrame:
        return self.table("reports", REPORT_SCHEMA).where(F.col("report_id") == report_id)


# ---------------------------------------------------------------------- H2-H7 queries
def latest(df: DataFrame, order_col: str = "created_at", user_id: str | None = None, n: int = 1) -> DataFrame:
    """H2 / H4 / H6 / H7: newest ``n`` rows, optionally for one user (top-k, no full sort)."""
    if user_id is not None:
        df = df.where(F.col("user_id") == user_id)
    return df.orderBy(F.col(order_col).desc(), *[F.col(c) for c in df.columns if c != order_col]).limit(n)


def main_metric_rows(runs: DataFrame, run_metrics: DataFrame) -> DataFrame:
    """H5: one history row per run with the best model's main metric (accuracy for
    classification, r2 for regression)."""
    main = F.when(F.col("problem_type") == "clasificacion", F.lit("accuracy")).otherwise(F.lit("r2"))
    r = runs.select("run_id", "user_id", "created_at", "dataset", "target", "problem_type", main.alias("metric"))
    m = run_metrics.select("run_id", "model", F.col("metric").alias("m"), "value")
    j = r.join(m, (r["run_id"] == m["run_id"]) & (r["metric"] == m["m"])).drop(m["run_id"])
    w = Window.partitionBy("run_id").orderBy(F.col("value").desc_nulls_last(), F.col("model"))
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        "run_id", "user_id", "created_at", "dataset", "target", "problem_type",
        F.col("model").alias("best_model"), "metric", "value")


def run_by_id(runs: DataFrame, run_metrics: DataFrame, run_id: str, model: str | None = None) -> DataFrame:
    """H3: one run's metrics (optionally one model's), joined to its headline row."""
    m = run_metrics.where(F.col("run_id") == run_id)
    if model is not None:
        m = m.where(F.col("model") == model)
    return runs.where(F.col("run_id") == run_id).select("run_id", "problem_type", "target").join(m, "run_id")
