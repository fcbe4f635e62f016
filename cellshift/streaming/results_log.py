"""Results as a table that grows fold by fold and can be resumed.

A fold's rows are written under a fresh name, then a manifest that lists every fold with the folder that counts for it is
put in place by a rename. Readers follow the newest manifest: they never see a fold half-written or twice, and one
that reads while a fold is replaced keeps the rows it began with. What a broken run has written but not committed is not read.
A manifest has one line per fold (lines x compound groups at most).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellshift.operators.normalize import RESULTS_COLUMNS, SORT_KEYS
from cellshift.session import delete, file_names, read_text, rename, write_text

MANIFEST = "manifest-"


class ResultsLog:
    def __init__(self, spark: SparkSession, path: str, key: str):
        """`key` identifies the configuration, so a resumed run never mixes results of two."""
        self.spark, self.path = spark, f"{path.rstrip('/')}/results_{key}"

    def _newest(self) -> tuple[int, list[dict]]:
        """Number and entries (split, fold, data) of the newest manifest."""
        numbers = [int(n.removeprefix(MANIFEST)) for n in file_names(self.spark, self.path) if n.startswith(MANIFEST)]
        last = max(numbers, default=0)
        return last, json.loads(read_text(self.spark, f"{self.path}/{MANIFEST}{last}")) if last else []

    def append(self, results: DataFrame) -> None:
        """Write the folds of these rows and commit them together; they replace folds of the same name."""
        self.commit(self.stage(results))

    def stage(self, results: DataFrame) -> str:
        """Write rows that no reader sees yet; returns the name of their folder."""
        name = f"data-{uuid.uuid4().hex}"
        results.write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, name: str) -> None:
        staged = self.spark.read.parquet(f"{self.path}/{name}").select("split", "fold").distinct().collect()  # a few names
        fresh = [{"split": r["split"], "fold": r["fold"], "data": name} for r in staged]
        replaced = {(e["split"], e["fold"]) for e in fresh}
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        while True:  # another writer may have committed in between
            last, entries = self._newest()
            kept = [e for e in entries if (e["split"], e["fold"]) not in replaced]
            write_text(self.spark, draft, json.dumps(kept + fresh))
            if rename(self.spark, draft, f"{self.path}/{MANIFEST}{last + 1}"):
                return

    def clear(self) -> None:
        delete(self.spark, self.path)

    def read(self, regimes: list[str] | None = None) -> DataFrame | None:
        """All committed folds, or those of the named regimes."""
        entries = self._newest()[1]
        if not entries:
            return None
        rows = self.spark.read.parquet(*sorted({f"{self.path}/{e['data']}" for e in entries}))
        folder = F.regexp_extract(F.col("_metadata.file_path"), "/(data-[0-9a-f]{32})/", 1)
        counts = F.concat_ws("|", folder, "split", "fold").isin([f"{e['data']}|{e['split']}|{e['fold']}" for e in entries])
        rows = rows.where(counts).select(*RESULTS_COLUMNS)
        return rows.where(F.col("split").isin(regimes)) if regimes else rows

    def completed(self) -> DataFrame | None:
        """(split, fold) of every committed fold."""
        entries = self._newest()[1]
        return self.spark.createDataFrame([(e["split"], e["fold"]) for e in entries], "split string, fold string") if entries else None

    def export_csv(self, path: str, regimes: list[str] | None = None) -> None:
        """One sorted CSV file with a header; undefined values are empty fields."""
        self.read(regimes).orderBy(*SORT_KEYS).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
