"""Datasets, methods and evaluators by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from trajecta.operators.lineage import cut


@dataclass
class Dataset:
    """How a dataset gives its scenes(dataset, scene), its frames(scene, frame_idx, ...) and, where it has one, its cloud; X2: its own evaluation of clouds."""

    name: str
    scenes: Callable[[SparkSession], DataFrame]
    frames: Callable[[SparkSession, DataFrame], DataFrame]
    cloud: Callable[[SparkSession, DataFrame], DataFrame] | None = None
    evaluate_cloud: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    save: Callable[[DataFrame, str], None] | None = None  # X4: instead of Parquet
    load: Callable[[SparkSession, str], DataFrame] | None = None


@dataclass
class Method:
    """A table function over the frames of one scene; `schema` is what it gives, `needs` the columns that must not be null there."""

    name: str
    run: Callable[[pd.DataFrame], pd.DataFrame]
    schema: str
    needs: tuple[str, ...] = ()


@dataclass
class Registry:
    datasets: dict[str, Dataset] = field(default_factory=dict)
    methods: dict[str, Method] = field(default_factory=dict)

    def add(self, entry: Dataset | Method) -> None:
        table = self.datasets if isinstance(entry, Dataset) else self.methods
        if entry.name in table:
            raise ValueError(f"{entry.name} is registered twice")
        table[entry.name] = entry

    def dataset(self, name: str) -> Dataset:
        if name not in self.datasets:
            raise KeyError(f"no dataset {name}; there are {sorted(self.datasets)}")
        return self.datasets[name]

    def method(self, name: str) -> Method:
        if name not in self.methods:
            raise KeyError(f"no method {name}; there are {sorted(self.methods)}")
        return self.methods[name]

    def process(self, spark: SparkSession, dataset: str, method: str, by: tuple[str, ...] = ("scene",)) -> DataFrame:
        """The method over every scene's frames. A scene is one group, for the method sees it whole; a missing needed value fails the job."""
        d, m = self.dataset(dataset), self.method(method)

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            out = m.run(rows.sort_values("frame_idx"))
            bad = [c for c in m.needs if c not in out.columns or out[c].isna().any()]
            if bad:
                raise ValueError(f"method {m.name} gives no {', '.join(bad)}")
            return out

        return d.frames(spark, d.scenes(spark)).groupBy(*by).applyInPandas(run, m.schema)

    def save(self, dataset: str, rows: DataFrame, path: str) -> None:
        """By the dataset's own way, else as Parquet."""
        own = self.dataset(dataset).save
        own(rows, path) if own is not None else rows.write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, dataset: str, path: str) -> DataFrame:
        own = self.dataset(dataset).load
        return own(spark, path) if own is not None else spark.read.parquet(path)

    def evaluate_cloud(self, dataset: str, pred: DataFrame, gt: DataFrame, otherwise: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """By the dataset's own evaluation, else by the common one."""
        return (self.dataset(dataset).evaluate_cloud or otherwise)(pred, gt)


def run_evaluators(
    evaluators: dict[str, Callable[[], DataFrame]], done: set[str] = frozenset(), force: bool = False
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Tables of independent evaluators by name, and the message of each that failed; those in `done` are skipped."""
    found, failed = {}, {}
    for name, make in evaluators.items():
        if name in done and not force:
            continue
        try:
            found[name] = cut(make())
        except Exception as e:  # an evaluator's failure is its own
            failed[name] = f"{type(e).__name__}: {e}"
    return found, failed
