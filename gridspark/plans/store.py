"""Stored models: versioned Parquet tables, written once and resolved by run key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.models import scoring

# The tables of a stored model.
TABLES = ("model_scaler", "model_coef", "cv_folds", "cv_summary")
KEYS = ("ptf", "depth", "date")


@dataclass(frozen=True)
class StoredModel:
    """Tables of one run, as read back."""

    version: int
    scaler: DataFrame
    coefficients: DataFrame
    folds: DataFrame | None
    summary: DataFrame | None

    @property
    def features(self) -> list[str]:
        return [r["feature"] for r in self.scaler.orderBy("feature").select("feature").collect()]  # one row per feature


class ModelStore:
    """Models below one folder: ``<folder>/<table>/ptf=/depth=/date=/version=``.

    A version is never changed.  ``model_coef`` is written last, so a version whose writing was cut off has no
    coefficients and is not found; its number is not used again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str, key: Mapping[str, str]) -> str:
        if sorted(key) != sorted(KEYS):
            raise ValueError(f"a run key has {', '.join(KEYS)}")
        bad = [v for v in key.values() if not str(v) or set(str(v)) & set("/=\\ \t\n")]
        if bad:
            raise ValueError(f"not a key value: {bad[0]!r}")
        return "/".join([self.folder, table, *(f"{k}={key[k]}" for k in KEYS)])

    def _versions(self, table: str, key: Mapping[str, str]) -> list[int]:
        """Versions with a folder of ``table``, finished or not."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table, key))
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        names = [f.getPath().getName() for f in system.listStatus(path)]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def versions(self, key: Mapping[str, str]) -> list[int]:
        """Finished versions of a run, oldest first."""
        path = self._path("model_coef", key)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        done = []
        for v in self._versions("model_coef", key):
            mark = hadoop(f"{path}/version={v}/_SUCCESS")
            if mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark):
                done.append(v)
        return done

    def save(self, key: Mapping[str, str], scaler: DataFrame, coefficients: DataFrame, folds: DataFrame | None = None,
             summary: DataFrame | None = None) -> int:
        """Write the tables as the run's next version and return its number."""
        version = 1 + max((v for t in TABLES for v in self._versions(t, key)), default=0)
        tables = {"model_scaler": scaler, "cv_folds": folds, "cv_summary": summary, "model_coef": coefficients}
        for name, table in tables.items():
            if table is not None:
                table.write.mode("errorifexists").parquet(f"{self._path(name, key)}/version={version}")
        return version

    def save_run(self, key: Mapping[str, str], result) -> int:
        """Store a finished :class:`dsi.DsiResult`."""
        return self.save(key, result.scaler, result.coefficients, result.nested.folds, result.cv_summary)

    def load(self, key: Mapping[str, str], version: int | None = None) -> StoredModel:
        """A run's tables: its newest finished version unless one is named."""
        found = self.versions(key)
        if not found or (version is not None and version not in found):
            raise LookupError(f"no stored model {dict(key)}" + (f" version {version}" if version else ""))
        version = version or found[-1]
        read = {}
        for name in TABLES:
            read[name] = (self.spark.read.parquet(f"{self._path(name, key)}/version={version}")
                          if version in self._versions(name, key) else None)
        return StoredModel(version, read["model_scaler"], read["model_coef"], read["cv_folds"], read["cv_summary"])

    def listing(self, table: str = "model_coef") -> DataFrame:
        """All rows of one table with their run keys and versions."""
        return self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(f"{self.folder}/{table}/*/*/*/version=*")

    def apply(self, key: Mapping[str, str], cells: DataFrame, features: Sequence[str] | None = None,
              version: int | None = None) -> DataFrame:
        """``cells`` with probability ``p`` of the stored model; only its few parameter rows are read before scoring."""
        model = self.load(key, version)
        return scoring.predict_proba(cells, model.scaler, model.coefficients, list(features or model.features))


def apply_years(store: ModelStore, key: Mapping[str, str], scenarios: Mapping[str, DataFrame | None], features: Sequence[str],
                threshold: float = 4000.0) -> tuple[DataFrame, DataFrame]:
    """Separability per scenario of a stored model, and (label, status, reason) of every scenario.

    A scenario that is None, or lacks a column, is reported and left out; the others run in one plan.  A scenario
    without a complete cell is reported as empty.
    """
    model = store.load(key)
    needed = ["row", "col", *features, "disco"]
    good, status = {}, []
    for label, cells in scenarios.items():
        lacking = [c for c in needed if cells is not None and c not in cells.columns]
        if cells is None or lacking:
            status.append((label, "failed", "no table" if cells is None else "no column " + ", ".join(lacking)))
        else:
            good[label] = cells
    named = store.spark.createDataFrame(status, "label string, status string, reason string")
    if not good:
        return store.spark.createDataFrame([], "label string"), named
    scored = scoring.score_scenarios(good, model.scaler, model.coefficients, features, threshold)
    counted = scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labels = store.spark.createDataFrame([(x,) for x in good], "label string")
    ran = labels.join(F.broadcast(counted), "label", "left").select(  # a row per scenario on both sides
        "label", F.when(F.col("n") > 0, "done").otherwise("empty").alias("status"),
        F.when(F.col("n").isNull(), "no complete cell").alias("reason"))
    return scoring.separability(scored), named.unionByName(ran)
