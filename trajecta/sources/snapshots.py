"""A streaming source of JSON documents that are rewritten in place."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from trajecta.sources.files import file_system

SNAPSHOT_SCHEMA = "name string, status string, content string, seen_ms long, version long"


class SnapshotReader(DataSourceStreamReader):
    """Polls the documents once a trigger; what has changed is first written to a log, of which offsets are the lengths.

    So a batch that runs again after a failure reads what it read before, though the documents
    have changed meanwhile, and after a restart only documents are told that differ from the
    last log entry about them. Entries that all batches have done with are deleted, but for the
    last one of each document.
    """

    def __init__(self, folder: str, names: list[str], log: str) -> None:
        self.folder, self.names, self.log = folder, names, log

    def _entries(self) -> list[int]:
        fs, place = file_system(self.log)
        if fs.get_file_info(place).type != FileType.Directory:
            return []
        found = (f.base_name.removesuffix(".json") for f in fs.get_file_info(FileSelector(place)) if f.base_name.endswith(".json"))
        return sorted(int(n) for n in found if n.isdigit())

    def _entry(self, number: int) -> dict:
        fs, place = file_system(self.log)
        with fs.open_input_stream(f"{place}/{number}.json") as f:
            return json.loads(f.read())

    def _append(self, number: int, entry: dict) -> None:
        fs, place = file_system(self.log)
        fs.create_dir(place, recursive=True)
        with fs.open_output_stream(f"{place}/{number}.part") as f:
            f.write(json.dumps(entry).encode())
        fs.move(f"{place}/{number}.part", f"{place}/{number}.json")

    def _look(self, name: str) -> tuple[str, str | None]:
        """`missing` without a file, `invalid` where it is no JSON (it may be half written), else `ok`."""
        fs, place = file_system(self.folder)
        if fs.get_file_info(f"{place}/{name}").type != FileType.File:
            return "missing", None
        try:
            with fs.open_input_stream(f"{place}/{name}") as f:
                text = f.read().decode("utf-8")
            json.loads(text)
        except FileNotFoundError:
            return "missing", None
        except ValueError:
            return "invalid", None
        return "ok", text

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        known = self._entries()
        told = {}
        for number in known:
            entry = self._entry(number)
            told[entry["name"]] = entry
        n = known[-1] + 1 if known else 0
        for name in self.names:
            status, text = self._look(name)
            mark = hashlib.sha256((text or "").encode()).hexdigest()
            last = told.get(name)
            if status == "invalid" or last is not None and (last["status"], last["mark"]) == (status, mark):
                continue  # a half-written document is looked at again by the next trigger
            version = last["version"] + 1 if last else 0
            self._append(n, {"name": name, "status": status, "content": text, "mark": mark, "seen_ms": int(time.time() * 1000), "version": version})
            n += 1
        return {"n": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((start["n"], end["n"]))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        a, b = partition.value
        for number in range(a, b):
            e = self._entry(number)
            yield e["name"], e["status"], e["content"], e["seen_ms"], e["version"]

    def commit(self, end: dict) -> None:
        fs, place = file_system(self.log)
        last = {}
        for number in self._entries():
            last[self._entry(number)["name"]] = number
        for number in self._entries():
            if number < end["n"] and number not in last.values():
                fs.delete_file(f"{place}/{number}.json")


class SnapshotSource(DataSource):
    """Options: path (the folder of the documents), names (joined by commas) and log (a folder of the stream's own, beside its checkpoint)."""

    @classmethod
    def name(cls) -> str:
        return "json_snapshots"

    def schema(self) -> str:
        return SNAPSHOT_SCHEMA

    def streamReader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options["path"], [n for n in self.options["names"].split(",") if n], self.options["log"])


def snapshot_stream(spark: SparkSession, folder: str, names: list[str], log: str) -> DataFrame:
    """A row whenever a document has other content than it had, is missing, or is back: (name, status, content, seen_ms, version).

    The documents are small ones that a service rewrites (a pose, a path, a state), so one task
    reads what a trigger has found. Changes between two triggers are not seen, as by any poll.
    """
    spark.dataSource.register(SnapshotSource)
    return spark.readStream.format("json_snapshots").option("path", folder).option("names", ",".join(names)).option("log", log).load()
