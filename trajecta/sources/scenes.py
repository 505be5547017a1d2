"""Datasets as data sources: a partition a scene, and only the scenes that are asked for.

Scenes are chosen by an argument, not by pushed filters: Spark 4.1 keeps the reader that one query's
filter has made for all later queries over the same DataFrame, which then lose rows. A filter on
a DataFrame is right as always, and is applied to all scenes' rows.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trajecta.sources.files import file_system


class SceneDataset(ABC):
    """What a dataset has to say: its scenes, and the rows of one. `schema` are the columns after `scene`.

    It is built on the driver from the options of the read, and sent to the tasks.
    """

    schema: str

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    @abstractmethod
    def scenes(self) -> list[str]: ...

    @abstractmethod
    def frames(self, scene: str) -> Iterator[tuple]:
        """Rows of a scene, in order, without the scene itself; a task reads them one by one."""


class SceneReader(DataSourceReader):
    """A partition a scene; of `asked` scenes those that the dataset has."""

    def __init__(self, dataset: SceneDataset, asked: set[str] | None) -> None:
        self.dataset, self.asked = dataset, asked

    def partitions(self) -> list[InputPartition]:
        found = [s for s in self.dataset.scenes() if self.asked is None or s in self.asked]
        return [InputPartition(s) for s in found] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            for row in self.dataset.frames(partition.value):
                yield partition.value, *row


def scene_source(name: str, dataset: type[SceneDataset]) -> type[DataSource]:
    """The data source class of a dataset, to be registered under a name."""

    class SceneSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"scene string, {dataset.schema}"

        def reader(self, schema) -> SceneReader:
            asked = self.options.get("scenes")
            return SceneReader(dataset(dict(self.options)), None if asked is None else set(json.loads(asked)))

    return SceneSource


def read_scenes(spark: SparkSession, name: str, dataset: type[SceneDataset], scenes: list[str] | None = None, **options: str) -> DataFrame:
    """(scene, ...) of a dataset, of all scenes or of the given ones: the files of others are not opened."""
    spark.dataSource.register(scene_source(name, dataset))
    reader = spark.read.format(name).options(**options)
    return (reader if scenes is None else reader.option("scenes", json.dumps(scenes))).load()


class PoseFolders(SceneDataset):
    """A folder a scene, with poses.txt: a frame number and twelve numbers a line; blank lines and those with `#` first are skipped."""

    schema = "frame_idx int, m array<double>"

    def scenes(self) -> list[str]:
        fs, place = file_system(self.options["path"])
        return sorted(f.base_name for f in fs.get_file_info(FileSelector(place)) if f.type == FileType.Directory)

    def frames(self, scene: str) -> Iterator[tuple]:
        import io

        fs, place = file_system(self.options["path"])
        with fs.open_input_stream(f"{place}/{scene}/poses.txt") as raw:
            for line in io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8"):
                if line.strip() and not line.startswith("#"):
                    number, *m = line.split()
                    if len(m) != 12:
                        raise ValueError(f"{scene}: a pose has twelve numbers, not {len(m)}")
                    yield int(number), [float(x) for x in m]
