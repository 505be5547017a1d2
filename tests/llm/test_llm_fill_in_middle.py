"""Fill-in-the-middle against a plain Python version on odd texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from trajecta.llm.fill_in_middle import fill_in_middle, op11_fill_in_middle, restore

SCHEMA = "doc_id long, text string, lang string, n string, form int, prefix string, output string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, a, b - a, sha(out), sha(text))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    odd = ["a", "|", "~", "~0", "~1|~~|", "\n", "\r\n", "é", "é", "😀", "👩‍👩‍👧", "<P", "<P>", "x<S>y<M>", "$0\\$1", " \t ", " |\u0000|", "<<P<", "S>P>M>"]
    made = [None, "", *odd, "🙂|" * 300, "~|" * 20_000, "long word " * 30_000]
    made += ["".join(rnd.choice(odd) for _ in range(rnd.randrange(1, 60))) for _ in range(300)]
    made += ["".join(rnd.choice("ab |~\n😀<>PSM") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    out = list(enumerate(made))
    return [*out, (None, "a text without an id"), (None, None), (7, "same id"), (7, "same id"), (2**62, "large id"), (-3, "below zero")]


def test_against_python(spark, rows, tmp_path):
    # columns that clash with those of the result are not read
    spark.createDataFrame([(i, t, "en", "x", 1, "x", "x") for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11_fill_in_middle(spark, str(tmp_path)).collect()), key=str)
    want = sorted((brute(*r) for r in rows), key=str)
    assert got == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    empty = spark.createDataFrame([], SCHEMA)
    assert fill_in_middle(empty).collect() == []


UNITS = {"word": r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+", "line": r"[^\n]*\n|[^\n]+"}


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units(spark, rows, unit):
    docs = spark.createDataFrame([(i, t) for i, t in rows if i is not None], "doc_id long, text string")
    got = fill_in_middle(docs, seed="7", plain_percent=0, spm_percent=50, unit=unit)
    got = got.withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["back"] == r["text"]
        if r["form"] != "plain":
            assert r["prefix"] + r["middle"] + r["suffix"] == r["text"]
            units = re.findall(UNITS[unit], r["text"])
            a = r["n_prefix"]
            assert (r["n"], r["prefix"], r["middle"]) == (len(units), "".join(units[:a]), "".join(units[a : a + r["n_middle"]]))


def test_every_row_keeps_its_place_in_the_plan(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    plan = fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
