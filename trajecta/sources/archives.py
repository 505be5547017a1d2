"""Members of zip archives as rows, and arrays stored in them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trajecta.functions.geometry import invert_affine
from trajecta.sources.files import file_system

MEMBER_SCHEMA = "archive string, member string, size long, content binary"


class ZipReader(DataSourceReader):
    """Lists members from the archives' central directories; a task opens an archive and reads a stretch of members of about `stretch` bytes."""

    def __init__(self, path: str, prefix: str, suffix: str, stretch: int) -> None:
        self.path, self.prefix, self.suffix, self.stretch = path, prefix, suffix, stretch

    def _wanted(self, member: str) -> bool:
        return member.startswith(self.prefix) and member.endswith(self.suffix)

    def partitions(self) -> list[InputPartition]:
        fs, place = file_system(self.path)
        info = fs.get_file_info(place)
        files = [info.path] if info.is_file else sorted(f.path for f in fs.get_file_info(FileSelector(place, recursive=True)) if f.is_file and f.path.endswith(".zip"))
        out = []
        for file in files:
            with fs.open_input_file(file) as f, zipfile.ZipFile(f) as z:
                held, size = [], 0
                for m in sorted((m for m in z.infolist() if not m.is_dir() and self._wanted(m.filename)), key=lambda m: m.filename):
                    if held and size + m.file_size > self.stretch:
                        out.append(InputPartition((file, held)))
                        held, size = [], 0
                    held.append(m.filename)
                    size += m.file_size
                if held:
                    out.append(InputPartition((file, held)))
        return out or [InputPartition(("", []))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        file, members = partition.value
        if not members:
            return
        fs, _ = file_system(self.path)
        with fs.open_input_file(file) as f, zipfile.ZipFile(f) as z:
            for m in members:
                content = z.read(m)
                yield file, m, len(content), content


class ZipSource(DataSource):
    """Options: path (an archive, or a folder of archives), prefix and suffix of the members' names, and stretchBytes (of a task).

    Names are chosen by options and not by pushed filters, for the reason that scenes.py states.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"], self.options.get("prefix", ""), self.options.get("suffix", ""), int(self.options.get("stretchBytes", 64 << 20)))


def zip_members(spark: SparkSession, path: str, prefix: str = "", suffix: str = "", stretch: int = 64 << 20) -> DataFrame:
    """(archive, member, size, content), ascending by name in an archive; members whose names do not begin and end as asked are not unpacked.

    A member is one row, so it must fit a task.
    """
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_members").option("path", path).option("prefix", prefix).option("suffix", suffix).option("stretchBytes", stretch).load()


def first_existing(members: DataFrame, by: list[str], candidates: list[str]) -> DataFrame:
    """Per group, the member whose name ends with the earliest of the candidates; groups without any have no row."""
    place = F.coalesce(*[F.when(F.endswith("member", F.lit(c)), F.lit(k)) for k, c in enumerate(candidates)])
    return members.withColumn("_p", place).where("_p is not null").groupBy(*by).agg(F.min_by(F.struct(*[c for c in members.columns if c not in by]), F.struct("_p", "member")).alias("r")).select(*by, "r.*")


def npz_arrays(rows: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Arrays of .npz files: (keys, name, shape, values), values as doubles in row-major order. Arrays of objects are an error: they would be unpickled."""
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                with np.load(io.BytesIO(row[content]), allow_pickle=False) as arrays:
                    for name in arrays.files:
                        a = arrays[name]
                        yield pd.DataFrame({**{k: [row[k]] for k in keys}, "name": [name], "shape": [list(a.shape)], "values": [a.astype(np.float64).ravel().tolist()]})

    return rows.select(*keys, content).mapInPandas(read, f"{kinds}name string, shape array<long>, values array<double>")


def camera_to_world(values: Column) -> Column:
    """A pose from the 16 (or 12) row-major numbers of a world-to-camera matrix."""
    return invert_affine(F.slice(values, 1, 12))


def npz_cameras(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fx, fy, cx, cy, m) of rows that npz_arrays gave: `intrinsics` (3, 3) and `extrinsics` (4, 4), world to camera; files without both have no row, other shapes are an error."""
    checked = F.when((F.col("name") == "intrinsics") & (F.array_join(F.col("shape").cast("array<string>"), ",") != "3,3") | (F.col("name") == "extrinsics") & ~F.array_join(F.col("shape").cast("array<string>"), ",").isin("4,4", "3,4"), F.raise_error(F.lit("cameras need intrinsics (3, 3) and extrinsics (4, 4)")).cast("array<double>")).otherwise(F.col("values"))
    wide = arrays.where(F.col("name").isin("intrinsics", "extrinsics")).withColumn("values", checked).groupBy(*keys).agg(*[F.first(F.when(F.col("name") == n, F.col("values")), True).alias(n) for n in ("intrinsics", "extrinsics")])
    k = F.col("intrinsics")
    return wide.where("intrinsics is not null and extrinsics is not null").select(*keys, k[0].alias("fx"), k[4].alias("fy"), k[2].alias("cx"), k[5].alias("cy"), camera_to_world(F.col("extrinsics")).alias("m"))


def raw_depth(rows: DataFrame, keys: list[str], width: int, height: int, content: str = "content") -> DataFrame:
    """Pixels (keys, u, v, depth) of raw little-endian 32-bit floats, row by row; another size is an error, values that are not finite or not positive are null.

    A file is unpacked by its task as a whole: an image, whatever its name ends with.
    """
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                if len(row[content]) != 4 * width * height:
                    raise ValueError(f"a depth image of {width} by {height} has {4 * width * height} bytes, not {len(row[content])}")
                depth = np.frombuffer(row[content], dtype="<f4").astype(float)
                depth = np.where(np.isfinite(depth) & (depth > 0), depth, np.nan)
                n = np.arange(width * height)
                out = pd.DataFrame({"u": (n % width).astype(np.int32), "v": (n // width).astype(np.int32), "depth": pd.array(depth, dtype="Float64")})
                out["depth"] = out["depth"].mask(np.isnan(depth))
                for k in reversed(keys):
                    out.insert(0, k, row[k])
                yield out

    return rows.select(*keys, content).mapInPandas(read, f"{kinds}u int, v int, depth double")
