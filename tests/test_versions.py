"""Versioned tables: replaced keys, two writers, half-written versions."""

import pytest

from trajecta.sources import versions
from trajecta.sources.versions import VersionedTable

SCHEMA = "dataset string, method string, metric string, value double"


def test_upserts_replace_documents_and_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    rows = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    t = VersionedTable(spark, f"{tmp_path}/t", ["dataset", "method"])
    assert t.read() is None and t.manifest() is None
    assert t.upsert(rows(("a", "m", "ate", 1.0), ("a", "m", "rpe", 2.0), ("a", "n", "ate", 3.0), (None, "m", "ate", 9.0))) == 1
    before = t.read()
    assert t.upsert(rows(("a", "m", "ate", 5.0), ("b", "m", "ate", 6.0))) == 2
    now = sorted(map(tuple, t.read().collect()), key=str)
    assert now == [("a", "m", "ate", 5.0), ("a", "n", "ate", 3.0), ("b", "m", "ate", 6.0), (None, "m", "ate", 9.0)]  # rpe was of the old document
    assert before.count() == 4 and t.read(1).count() == 4  # a reader that had begun keeps its version

    # another writer comes between reading the last version and creating the next: both writes stay
    first = versions.create_once

    def late(spark_, path, text):
        monkeypatch.setattr(versions, "create_once", first)
        VersionedTable(spark, f"{tmp_path}/t", ["dataset", "method"]).upsert(rows(("c", "m", "ate", 7.0)))
        return first(spark_, path, text)

    monkeypatch.setattr(versions, "create_once", late)
    assert t.upsert(rows(("d", "m", "ate", 8.0))) == 4
    assert {r.dataset for r in t.read().collect()} == {"a", "b", "c", "d", None}

    # a pointer without text, or without its manifest, is not seen
    (tmp_path / "t/versions/5").write_text("")
    (tmp_path / "t/versions/6").write_text("gone")
    assert t.manifest()["version"] == 4
    assert t.upsert(rows(("e", "m", "ate", 1.0))) == 7 and t.manifest()["version"] == 7
    with pytest.raises(ValueError, match="columns"):
        t.upsert(spark.createDataFrame([("a", "m", 1.0)], "dataset string, method string, x double"))
