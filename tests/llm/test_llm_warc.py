"""WARC archives and their index against plain Python, on odd pages, small splits and many runs."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trajecta.llm import warc
from trajecta.llm.warc import LoserTree, captures, index_archives, op12_warc, read_warc, url_key, write_warc

SCHEMA = "page_id long, url string, html string, record_type string, payload_digest int, offset string, run string, value string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """Counts of (page_id, bytes, digest, type, refers_to)."""
    groups = {}
    for page_id, _, html in rows:
        payload = html or ""
        groups.setdefault(payload, []).append(page_id)
    out = []
    for payload, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        size = len(payload.encode())
        revisits = size >= 100 and len(ids) > 1 and known
        for i in known[:1] if revisits else ids:
            out.append((i, size, sha(payload), "response", None))
        if revisits:
            out += [(i, size, sha(payload), "revisit", known[0]) for i in [*known[1:], *[None] * (len(ids) - len(known))]]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    odd = ["", None, "x" * 99, "x" * 100, "é" * 50, "é" * 49, "\r\n\r\n" * 40, "a\r\n\r\nWARC/1.1\r\nX-Archive-Token: 0\r\n" * 5, "\r\n", "<p>😀</p>" * 30, "z" * 300_000, "end\r\n", "\u0000" * 120]
    urls = [None, "", "http://a.org", "HTTP://WWW2.A.org:80/x?b=2&a=1#f", "https://user@a.org:443/Path", "a: b", "x\r\nContent-Length: 5", "http://ü.example/é?q=ß", "mailto:me"]
    rows = [(k, rnd.choice(urls) if k % 3 else "http://hot.example.com/one", rnd.choice([*odd, f"own {k} " * 30, "shared " * 40])) for k in range(300)]
    rows += [(None, "http://n.org", "shared " * 40), (None, None, None), (None, "http://n.org/2", "no ids " * 40), (None, "http://n.org/3", "no ids " * 40)]
    rows += [(500, "http://r.org", "repeated " * 30)] * 7 + [(501, "http://r.org", "repeated " * 30), (0, "http://s.org", "shared " * 40), (0, "http://s.org", "shared " * 40)]
    return rnd.sample(rows, len(rows))


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1000", "spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in keys}
    yield lambda: [spark.conf.set(k, v) for k, v in keys.items()]
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("broadcast_groups", [warc.BROADCAST_GROUPS, 0])
def test_query_against_python(spark, rows, tmp_path, monkeypatch, broadcast_groups):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", broadcast_groups)
    spark.createDataFrame([(*r, "x", 1, "x", "x", "x") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = op12_warc(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert op12_warc(spark, str(tmp_path)).collect() == []


def test_files_splits_and_index(spark, rows, tmp_path, small_splits):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    path = f"{tmp_path}/warc"
    token = write_warc(pages, path, F.coalesce("page_id", F.lit(0)) * 86_400, records_per_file=100)
    small_splits()
    records = read_warc(spark, path).collect()
    want = brute(rows)
    responses = sorted((len(r["payload"]), hashlib.sha256(r["payload"]).hexdigest()) for r in records if r["head"]["WARC-Type"] == "response")
    assert responses == sorted(r[1:3] for r in want if r[3] == "response")
    assert all(r["payload"] == b"" for r in records if r["head"]["WARC-Type"] == "revisit") and len(records) == len(rows)
    index = index_archives(spark, path, token).orderBy("position").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index), key=str) == want
    keys = [(r.url_key, r.timestamp, r.page_id is not None, r.page_id or 0, r.file, r.offset) for r in index]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert len({r.file for r in index}) > 3
    for r in index:  # random access by file, offset and length
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            record = f.read(r.length)
        head, rest = record.split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(rest) - 4
        assert fields.get("X-Page") == (None if r.page_id is None else str(r.page_id)) and fields["WARC-Type"] == r.record_type
        if r.record_type == "response":
            assert sha(rest[:-4].split(b"\r\n\r\n", 1)[1].decode()) == r.payload_digest == fields["WARC-Payload-Digest"].removeprefix("sha256:")
    sizes = {}
    for r in index:
        sizes[r.file] = max(sizes.get(r.file, 0), r.offset + r.length)
    assert all(Path(f.removeprefix("file:")).stat().st_size == n for f, n in sizes.items())
    ids = [r["head"]["WARC-Record-ID"] for r in records]
    refers = {r["head"].get("WARC-Refers-To") for r in records} - {None}
    assert refers <= set(ids)


def test_broken_records_stop_the_read(spark, tmp_path):
    write_warc(spark.createDataFrame([(1, "http://a.b", "text " * 50)], "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w", F.lit(0))
    file = next(Path(f"{tmp_path}/w").glob("part-*"))
    body = file.read_bytes().replace(b"text text", b"text", 1)
    file.unlink()
    (file.parent / "part-0.txt").write_bytes(body)
    with pytest.raises(Exception, match="broken record"):
        captures(read_warc(spark, f"{tmp_path}/w")).collect()


def test_url_keys(spark):
    want = {
        "HTTP://WWW2.A.org:80/x?b=2&a=1#f": "org,a)/x?a=1&b=2", "https://user@a.org:443/Path": "org,a)/Path", "http://a.org": "org,a)/", "a: b": "a: b", None: "", "http://a.org?": "org,a)/",
        "//b.c/d": "c,b)/d", "http://ü.example/é?q=ß": "example,ü)/é?q=ß",
    }
    got = spark.createDataFrame([(u,) for u in want], "url string").select("url", url_key(F.col("url")).alias("k")).collect()
    assert {r.url: r.k for r in got} == want


def test_loser_tree():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16, 21):
        keys, starts, ends = [], [], []
        for _ in range(k):
            starts.append(len(keys))
            keys += sorted(rnd.randrange(50) for _ in range(rnd.choice([0, 1, 5, 40])))
            ends.append(len(keys))
        order = list(LoserTree(keys, starts, ends))
        assert order == sorted(range(len(keys)), key=lambda i: (keys[i], i))
