"""Tables whose documents are replaced by key, with versions that readers see whole (K6, K9)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trajecta.sources.files import create_once, names, read_text, remove, write_text


class VersionedTable:
    """A table at a path: data files that never change, and numbered versions that list the files of every key.

    A version is a manifest, written whole under a name of its own, and then a pointer of its
    number, which only one writer can create. A writer that comes second reads the newer
    version and merges again; its data files stay as they are. A reader takes the last pointer
    whose manifest is there, and that manifest's files, so it sees all of a write or nothing.
    Manifests hold a line a key: keys are documents (a dataset, scene and method), not rows.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _pointer(self, number: int) -> dict | None:
        mark = read_text(self.spark, f"{self.path}/versions/{number}")
        text = read_text(self.spark, f"{self.path}/manifests/{mark}.json") if mark else None
        return json.loads(text) if text else None

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in names(self.spark, f"{self.path}/versions") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, of the last whole one by default: version, schema, entries of key and files; None before the first."""
        for number in reversed(self._numbers()) if version is None else [version]:
            found = self._pointer(number)
            if found is not None:
                return found
        return None

    def read(self, version: int | None = None) -> DataFrame | None:
        now = self.manifest(version)
        if now is None:
            return None
        files = [f for e in now["entries"] for f in e["files"]]
        schema = StructType.fromJson(now["schema"])
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def upsert(self, rows: DataFrame, tries: int = 20) -> int:
        """Replace the documents whose keys are among the rows', keep the others; the new version's number. Columns must be those of the table."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        parts = [f"_of_{k}" for k in self.keys]
        rows.withColumns({p: F.col(k) for p, k in zip(parts, self.keys, strict=True)}).write.partitionBy(*parts).parquet(folder)
        written = self.spark.read.schema(rows.schema).parquet(folder).groupBy(*self.keys).agg(F.array_sort(F.collect_set("_metadata.file_path")).alias("files"))
        new = [{"key": [r[k] for k in self.keys], "files": r["files"]} for r in written.collect()]  # a row a document
        replaced = {json.dumps(e["key"]) for e in new}
        schema = json.loads(rows.schema.json())
        for _ in range(tries):
            last = self.manifest()
            if last is not None and [f["name"] for f in last["schema"]["fields"]] != rows.columns:
                raise ValueError(f"columns {rows.columns} are not those of the table")
            number = (self._numbers() or [0])[-1] + 1
            kept = [e for e in last["entries"] if json.dumps(e["key"]) not in replaced] if last else []
            mark = uuid.uuid4().hex
            write_text(self.spark, f"{self.path}/manifests/{mark}.json", json.dumps({"version": number, "schema": schema, "entries": kept + new}))
            if create_once(self.spark, f"{self.path}/versions/{number}", mark):
                return number
            remove(self.spark, f"{self.path}/manifests/{mark}.json")
        raise RuntimeError(f"{tries} other writers came first")
