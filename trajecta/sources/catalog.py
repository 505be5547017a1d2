"""Workspace catalogue, completion records, metric tables and report exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scenes(artifacts: DataFrame) -> DataFrame:
    """Scenes of each dataset with their index from 0 in name order."""
    w = Window.partitionBy("dataset").orderBy("scene")
    return artifacts.select("dataset", "scene").distinct().withColumn("scene_index", F.row_number().over(w) - 1)


def methods(artifacts: DataFrame) -> DataFrame:
    """Methods of complete artifacts of each scene, ground truth first."""
    w = Window.partitionBy("dataset", "scene").orderBy(F.col("method") != "gt", "method")
    return artifacts.where("complete and method <> 'eval'").select("dataset", "scene", "method").distinct().withColumn("pos", F.row_number().over(w) - 1)


def datasets(artifacts: DataFrame, evaluated: DataFrame, excluded: list[str]) -> DataFrame:
    """Datasets that have a scene or an evaluation, but for names set apart."""
    return artifacts.select("dataset").union(evaluated.select("dataset")).distinct().where(~F.col("dataset").isin(excluded))


def to_do(work: DataFrame, artifacts: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Work whose artifact is not complete."""
    return work if force else work.join(artifacts.where("complete").select(*keys), keys, "left_anti")


def work_items(dataset_configs: DataFrame, method_configs: DataFrame) -> DataFrame:
    """Every dataset configuration with every method configuration; both are small tables of settings."""
    return dataset_configs.crossJoin(method_configs)


def with_both(scenes_: DataFrame, a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Scenes for which both tables have a row."""
    return scenes_.join(a.select(*keys), keys, "left_semi").join(b.select(*keys), keys, "left_semi")


def allowed(rows: DataFrame, column: str, deny_suffixes: DataFrame) -> DataFrame:
    """Rows whose name ends with none of the suffixes (a small table)."""
    return rows.join(F.broadcast(deny_suffixes), F.col(column).endswith(F.col("suffix")), "left_anti")


def copy_plan(files: DataFrame) -> DataFrame:
    """K9: one source for each destination, the first by name."""
    return files.groupBy("dest").agg(F.min("src").alias("src"))


def export_csv(rows: DataFrame, path: str) -> None:
    """RFC 4180, null as empty."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def metadata(spark, path: str, schema: str) -> DataFrame:
    """JSON documents; a corrupt one has nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
