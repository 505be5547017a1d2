"""PLY clouds by a data source (S6, S7, K3) and PGM grids."""

from __future__ import annotations

import contextlib
import io
import itertools
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from trajecta.operators.grids import MAX_CELLS
from trajecta.sources.files import file_system, write_bytes, write_text

# Fixed values of the PLY format: scalar names and their numpy kinds.
PLY_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}
POINT_SCHEMA = "file string, point_id long, x double, y double, z double, r double, g double, b double, distance double"


def parse_ply(data: bytes) -> tuple[int, str, np.dtype, int]:
    """Number of vertices, format, record type and where the records begin."""
    end = data.index(b"end_header")
    body = data.index(b"\n", end) + 1
    head = data[:end].decode("ascii").split("\n")
    if head[0].strip() != "ply":
        raise ValueError("no PLY file")
    form, n, fields, here = "", 0, [], False
    for line in (h.split() for h in head[1:]):
        if line[:1] == ["format"]:
            form = line[1]
        elif line[:1] == ["element"]:
            here = line[1] == "vertex"
            n = int(line[2]) if here else n
        elif line[:1] == ["property"] and here:
            if line[1] == "list":
                raise ValueError("list properties of vertices are not supported")
            fields.append((line[2], "<" + PLY_TYPES[line[1]]))
    if form not in ("ascii", "binary_little_endian") or not {"x", "y", "z"} <= {f for f, _ in fields}:
        raise ValueError("a PLY cloud needs x, y, z in ASCII or little-endian form")
    return n, form, np.dtype(fields), body


class PlyReader(DataSourceReader):
    """Binary clouds in ranges of records, of which a task reads only its bytes; text clouds one file a task, line by line. At most max_points of a file are read."""

    def __init__(self, path: str, max_points: int | None, rows: int) -> None:
        self.path, self.max_points, self.rows = path, max_points, rows

    def partitions(self) -> list[InputPartition]:
        fs, place = file_system(self.path)
        info = fs.get_file_info(place)
        found = [info] if info.is_file else [f for f in fs.get_file_info(FileSelector(place, recursive=True)) if f.is_file and f.path.endswith(".ply")]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            with fs.open_input_file(f.path) as file:
                n, form, kind, body = parse_ply(_head(file))
            if form != "ascii" and f.size - body < n * kind.itemsize:
                raise ValueError(f"{f.path} ends early")
            n = n if self.max_points is None else min(n, self.max_points)
            step = n if form == "ascii" else self.rows
            out += [InputPartition((f.path, a, min(step, n - a))) for a in range(0, n, max(step, 1))]
        return out or [InputPartition(("", 0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        place, start, n = partition.value
        fs, _ = file_system(self.path)
        at = start
        while at < start + n:
            with fs.open_input_file(place) as file:
                _, form, kind, body = parse_ply(_head(file))
                if form == "ascii":
                    yield from self._lines(fs, place, kind, n)
                    return
                size = min(200_000, start + n - at)
                file.seek(body + at * kind.itemsize)
                points = np.frombuffer(file.read(size * kind.itemsize), dtype=kind)
            yield _point_batch(place, at, points, {k for k in kind.names if kind[k] == np.uint8})
            at += size

    def _lines(self, fs, place: str, kind: np.dtype, n: int) -> Iterator[pa.RecordBatch]:
        plain = np.dtype([(k, "f8") for k in kind.names])
        with fs.open_input_stream(place) as raw:
            lines = io.TextIOWrapper(io.BufferedReader(raw), encoding="ascii")
            while lines.readline().strip() != "end_header":
                pass
            for at in range(0, n, 100_000):
                own = [tuple(map(float, line.split()[: len(kind)])) for line in itertools.islice(lines, min(100_000, n - at))]
                if len(own) < min(100_000, n - at):
                    raise ValueError(f"{place} ends early")
                yield _point_batch(place, at, np.array(own, dtype=plain), {k for k in kind.names if kind[k].kind == "u"})


def _head(file) -> bytes:
    data = b""
    while b"end_header" not in data or b"\n" not in data[data.index(b"end_header") :]:
        more = file.read(4096)
        if not more or len(data) > 1 << 20:
            raise ValueError("no PLY head")
        data += more
    return data


def _point_batch(place: str, at: int, points: np.ndarray, bytes_: set[str]) -> pa.RecordBatch:
    """Points as a batch: colours of bytes in 0..1, missing attributes null."""
    columns = [pa.array([place] * len(points)), pa.array(np.arange(at, at + len(points)))] + [pa.array(points[c].astype(float)) for c in "xyz"]
    for names in (("red", "r"), ("green", "g"), ("blue", "b"), ("distance",)):
        have = next((c for c in names if c in points.dtype.names), None)
        columns.append(pa.nulls(len(points), pa.float64()) if have is None else pa.array(points[have].astype(float) / (255 if have in bytes_ else 1)))
    return pa.RecordBatch.from_arrays(columns, names=["file", "point_id", "x", "y", "z", "r", "g", "b", "distance"])


class PlyWriter(DataSourceArrowWriter):
    """Little-endian PLY files of at most points_per_file points, written aside and moved in place when all tasks are done; a failed job leaves nothing.

    Columns x, y, z, with r, g, b in 0..1 where all three are there, and with distance where it is.
    """

    def __init__(self, path: str, columns: list[str], overwrite: bool, points_per_file: int) -> None:
        self.path, self.columns, self.overwrite, self.most, self.job = path, columns, overwrite, points_per_file, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        colour = {"r", "g", "b"} <= set(self.columns)
        kind = np.dtype([(c, "<f4") for c in "xyz"] + ([(c, "u1") for c in ("red", "green", "blue")] if colour else []) + ([("distance", "<f4")] if "distance" in self.columns else []))
        context = TaskContext.get()
        fs, place = file_system(self.path)
        aside = f"{place}/_aside-{self.job}"
        fs.create_dir(aside, recursive=True)
        files, held, n = [], [], 0

        def flush() -> None:
            head = f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n" + "".join(f"property {'float' if kind[c] == '<f4' else 'uchar'} {c}\n" for c in kind.names) + "end_header\n"
            name = f"part-{context.partitionId():05d}-{len(files):03d}-{self.job}.ply"
            with fs.open_output_stream(f"{aside}/{name}.{context.attemptNumber()}") as out:
                out.write(head.encode())
                for part in held:
                    out.write(part)
            files.append((f"{aside}/{name}.{context.attemptNumber()}", name))

        for batch in iterator:
            for at in range(0, batch.num_rows, self.most):
                own = batch.slice(at, self.most)
                if n + own.num_rows > self.most:
                    flush()
                    held, n = [], 0
                points = np.zeros(own.num_rows, dtype=kind)
                for c in kind.names:
                    values = own.column({"red": "r", "green": "g", "blue": "b"}.get(c, c)).to_numpy(zero_copy_only=False).astype(float)
                    points[c] = np.clip(np.nan_to_num(values) * 255, 0, 255).astype(np.uint8) if kind[c] == np.uint8 else values
                held.append(points.tobytes())
                n += own.num_rows
        if n or not files:
            flush()
        return PlyWritten(files)

    def commit(self, messages: list) -> None:
        """New files come in before old ones go, so a commit that breaks off leaves some twice, but loses none."""
        fs, place = file_system(self.path)
        old = [f.path for f in fs.get_file_info(FileSelector(place)) if f.is_file and f.path.endswith(".ply")] if self.overwrite else []
        for m in messages:
            for aside, name in m.files if m is not None else ():
                fs.move(aside, f"{place}/{name}")
        for file in old:
            fs.delete_file(file)
        self._sweep(fs, place)

    def abort(self, messages: list) -> None:
        """Tasks that are being stopped may still write, so the folder is swept until it stays away."""
        away = 0
        for _ in range(100):
            away = 0 if self._sweep(*file_system(self.path)) else away + 1
            if away == 5:
                return
            time.sleep(0.1)

    def _sweep(self, fs: FileSystem, place: str) -> bool:
        aside = f"{place}/_aside-{self.job}"
        if fs.get_file_info(aside).type != FileType.Directory:
            return False
        with contextlib.suppress(OSError):  # a file that comes meanwhile goes with the next sweep
            fs.delete_dir(aside)
        return True


@dataclass
class PlyWritten(WriterCommitMessage):
    files: list


class PlySink(DataSource):
    """Spark.read.format("ply").load(path) and df.write.format("ply").save(folder), in any store that pyarrow's file systems reach.

    Options: maxPoints (of each file) and rowsPerPartition; pointsPerFile when writing.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return POINT_SCHEMA

    def reader(self, schema) -> PlyReader:
        most = self.options.get("maxPoints")
        return PlyReader(self.options["path"], None if most is None else int(most), int(self.options.get("rowsPerPartition", 1_000_000)))

    def writer(self, schema, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], schema.fieldNames(), overwrite, int(self.options.get("pointsPerFile", 4_000_000)))


def read_ply(spark: SparkSession, path: str, max_points: int | None = None, rows: int = 1_000_000) -> DataFrame:
    """Points of all PLY files; colours of bytes are scaled to 0..1, missing attributes are null. A short file is an error."""
    spark.dataSource.register(PlySink)
    reader = spark.read.format("ply").option("rowsPerPartition", rows)
    return (reader if max_points is None else reader.option("maxPoints", max_points)).load(path)


def parse_pgm(data: bytes) -> np.ndarray:
    """A binary grey map of bytes; comments are allowed in the head."""
    tokens, at = [], 0
    while len(tokens) < 4:
        line_end = data.index(b"\n", at) if data[at : at + 1] == b"#" else -1
        if line_end >= 0:
            at = line_end + 1
        elif data[at : at + 1].isspace():
            at += 1
        else:
            stop = at
            while not data[stop : stop + 1].isspace():
                stop += 1
            tokens.append(data[at:stop])
            at = stop
    if tokens[0] != b"P5" or tokens[3] != b"255":
        raise ValueError("only P5 maps of 255 levels are supported")
    width, height = int(tokens[1]), int(tokens[2])
    return np.frombuffer(data, dtype=np.uint8, count=width * height, offset=at + 1).reshape(height, width)


def read_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of map.pgm whose size map.json confirms: (map_id, px, py, value, meters_per_pixel, origin_u_m, origin_v_m)."""
    meta = spark.read.option("multiLine", True).json(f"{folder}/map.json").select("meters_per_pixel", "origin_u_m", "origin_v_m", "width_px", "height_px")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                grid = parse_pgm(data)
                for y in range(len(grid)):
                    yield pd.DataFrame({"map_id": path, "px": np.arange(grid.shape[1], dtype=np.int32), "py": np.int32(y), "value": grid[y].astype(np.int32), "w": np.int32(grid.shape[1]), "h": np.int32(len(grid))})

    raw = spark.read.format("binaryFile").load(f"{folder}/map.pgm").select("path", "content")
    cells = raw.mapInPandas(parse, "map_id string, px int, py int, value int, w int, h int").crossJoin(F.broadcast(meta))  # one row
    same = (F.col("w") == F.col("width_px")) & (F.col("h") == F.col("height_px"))
    value = F.when(same, F.col("value")).otherwise(F.raise_error(F.lit("map.pgm and map.json differ in size")).cast("int"))
    return cells.select("map_id", "px", "py", value.alias("value"), "meters_per_pixel", "origin_u_m", "origin_v_m")


def write_grid(cells: DataFrame, meta: dict, folder: str, fill: int = 205) -> None:
    """K8: map.pgm and map.json, in any store that Hadoop reaches.

    Rows of the raster are made in tasks, a row one group of at most width_px cells; what comes to
    the driver is the raster itself, a byte a cell, whose size the limit of cells bounds. Cells
    outside it are an error.
    """
    width, height = meta["width_px"], meta["height_px"]
    if width * height > MAX_CELLS:
        raise ValueError("the grid has over 64 million cells")

    def row(own: pd.DataFrame) -> pd.DataFrame:
        line = np.full(width, fill, dtype=np.uint8)
        line[own["px"].to_numpy()] = own["value"].to_numpy()
        return pd.DataFrame({"py": own["py"].iloc[:1], "line": [line.tobytes()]})

    inside = F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)
    px = F.when(inside, F.col("px")).otherwise(F.raise_error(F.lit("a cell lies outside the grid")).cast("int"))
    lines = {r["py"]: r["line"] for r in cells.select(px.cast("int").alias("px"), F.col("py").cast("int").alias("py"), F.col("value").cast("int").alias("value")).groupBy("py").applyInPandas(row, "py int, line binary").toLocalIterator()}
    empty = bytes([fill]) * width
    body = b"".join(bytes(lines.get(y, empty)) for y in range(height))
    spark = cells.sparkSession
    write_bytes(spark, f"{folder}/map.pgm", f"P5\n{width} {height}\n255\n".encode() + body)
    write_text(spark, f"{folder}/map.json", json.dumps(meta))
