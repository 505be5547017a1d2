"""WARC archives of pages with revisits, and their capture index by an external merge (operator 12).

Archives are written by Spark's text writer, a record a value, so that its committer drops what
lost tasks leave. All records of one write carry a token that is drawn for it, right after their
first line; no payload can hold it, so readers split files of any size at it, in parallel, and the
lengths in the records prove every cut. Captures are then sorted where they were read (the runs)
and merged by url key and time: ranges of keys that are even by count, in each of which a loser
tree merges the runs' slices.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.common import discard, hot_join, materialize, read_table, shared_path
from trajecta.sources.files import remove

END = "\r\n\r\n"
TOKEN_FIELD = "X-Archive-Token"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: payloads under this are never revisits
LEAST_BYTES = 100
#: groups of equal payloads (about 150 bytes each) up to which their table is broadcast; beyond, it is joined by digest
BROADCAST_GROUPS = 100_000
KEY_ORDER = ["url_key", "timestamp", "page_id", "file", "offset"]
CAPTURE = "url_key string, timestamp string, page_id long, file string, offset long, length long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: Column) -> Column:
    """The key that puts captures of one site side by side: host labels from the right, `)`, path and sorted arguments.

    User names, the usual ports, a leading www and the fragment go; a url without `//` is its own
    key, and a null one the empty key.
    """
    whole = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", "")
    pattern = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)([^?]*)(.*)$"
    host = F.lower(F.regexp_extract(whole, pattern, 1))
    for gone in (r"^.*@", r":(80|443)?$", r"^www[0-9]*\."):
        host = F.regexp_replace(host, gone, "")
    path = F.regexp_extract(whole, pattern, 2)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    query = F.regexp_extract(whole, pattern, 3)
    asked = F.array_join(F.array_sort(F.split(F.substring(query, 2, 2**31 - 1), "&")), "&")
    return F.when(F.regexp_like(whole, F.lit(pattern)), F.concat(key, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))).otherwise(whole)


def _uuid(*parts: Column) -> Column:
    d = F.md5(F.concat_ws(":", *parts))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[d.substr(a, n) for a, n in cut]), F.lit(">"))


def mark_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages(page_id, payload, ...) with payload_bytes, payload_digest and refers_to, which is null for responses.

    Of equal payloads of `least` bytes or more, the row of the smallest page_id is the response;
    of rows that repeat it too, one. Rows without a page_id refer to it as well; where none of a
    group has one, all are responses. Digests are counted first, without payloads; only the
    groups of two rows and more meet the pages again, in a broadcast table or, where these are
    many, by a join that deals large groups over many tasks.
    """
    told = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    large = told.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = large.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.min_by("n", "page_id").alias("_leads"), F.sum("n").alias("_n"))
    groups = materialize(groups.where("_n > 1 and _first is not null"), "copies")
    n_groups, repeated, total = groups.agg(F.count(F.lit(1)), F.count_if(F.col("_leads") > 1), F.sum("_n")).first()
    if not n_groups:
        discard(groups)
        return told.withColumn("refers_to", F.lit(None).cast("long"))
    if n_groups <= BROADCAST_GROUPS:
        met = told.join(F.broadcast(groups), "payload_digest", "left")
    else:
        hot = [r[0] for r in groups.where(F.col("_n") * 512 > total).select("payload_digest").collect()]  # 511 at most
        met = hot_join(told, groups, ["payload_digest"], "payload_digest", hot, "left")
    lead = F.coalesce(F.col("page_id") == F.col("_first"), F.lit(False))
    once = met.where(~lead | F.col("_first").isNull() | (F.col("_leads") == 1)) if repeated else met
    once = once.withColumn("refers_to", F.when(~lead, F.col("_first"))).select(*told.columns, "refers_to")
    if not repeated:
        return once
    again = materialize(met.where(lead & (F.col("_leads") > 1)).withColumn("_copy", F.monotonically_increasing_id()), "repeated")
    first = again.groupBy("payload_digest").agg(F.min("_copy").alias("_chosen"))
    hot = [r[0] for r in groups.where((F.col("_leads") > 1) & (F.col("_n") * 512 > total)).select("payload_digest").collect()]
    chosen = hot_join(again, first, ["payload_digest"], "payload_digest", hot)
    return once.unionByName(chosen.withColumn("refers_to", F.when(F.col("_copy") != F.col("_chosen"), F.col("_first"))).select(*once.columns))


def _line(name: str, value: Column) -> Column:
    """A header line, none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_warc(pages: DataFrame, path: str, captured: Column, least: int = LEAST_BYTES, records_per_file: int = 200_000) -> str:
    """One WARC/1.1 record a row of pages(page_id, url, html) into uncompressed files at `path`; gives the write's token.

    `captured` are whole seconds since 1970. The payload is the html in UTF-8 (null: empty). A revisit
    holds the HTTP head, without the payload. Line ends in urls are percent-encoded; null urls and
    page_ids leave their fields out; other columns are not read; rows that repeat a page_id are
    records of their own. A table without rows gives no record.
    """
    token = uuid.uuid4().hex
    told = mark_revisits(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), captured.cast("long").alias("captured")), least)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    when = F.coalesce(F.expr("cast(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, captured) as string)"), F.lit("1970-01-01 00:00:00"))
    number = F.when(revisit, F.monotonically_increasing_id().cast("string"))
    head = F.concat(
        F.lit(f"WARC/1.1\r\n{TOKEN_FIELD}: {token}\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _uuid(F.col("page_id").cast("string"), F.col("payload_digest"), number)),
        _line("WARC-Date", F.concat(F.replace(when, F.lit(" "), F.lit("T")), F.lit("Z"))),
        _line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        _line("WARC-Refers-To", F.when(revisit, _uuid(F.col("refers_to").cast("string"), F.col("payload_digest")))),
        _line("X-Refers-To-Page", F.col("refers_to").cast("string")),
        _line("X-Page", F.col("page_id").cast("string")),
        F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))).cast("string"), F.lit(END),
    )
    record = F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    told.select(record.alias("value")).write.option("lineSep", END).option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path)
    return token


def archive_token(spark: SparkSession, path: str) -> str | None:
    """The token of the archives at a path, from their first record."""
    first = spark.read.option("lineSep", "\r\n").text(path).where(F.startswith("value", F.lit(f"{TOKEN_FIELD}: "))).first()
    return first[0].removeprefix(f"{TOKEN_FIELD}: ") if first else None


def read_warc(spark: SparkSession, path: str, token: str | None = None) -> DataFrame:
    """A row a record: file, split, at (its turn in the split), length, the header fields as a map `head`, http (its head) and payload (bytes).

    Files are split anywhere; a record is read by the task in whose split it begins. A record
    whose length is not the one that it states stops the read.
    """
    start = f"WARC/1.1\r\n{TOKEN_FIELD}: {token or archive_token(spark, path)}\r\n"
    rows = spark.read.option("lineSep", END + start).text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("split"))
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    whole = F.when(F.startswith("value", F.lit(start)), F.substring("value", len(start) + 1, 2**31 - 1)).otherwise(F.col("value"))
    rows = rows.select(F.col("file_path").alias("file"), "split", "at", whole.alias("value")).withColumn("_top", F.substring_index("value", END, 1))
    rows = rows.withColumn("head", F.str_to_map("_top", F.lit("\r\n"), F.lit(": "))).withColumn("_size", F.col("head")["Content-Length"].cast("int"))
    before = F.octet_length("_top") + len(END)
    odd = F.coalesce(~(F.octet_length("value") - before - F.col("_size")).isin(0, len(END)), F.lit(True))
    block = F.expr(f"substring(cast(value as binary), octet_length(_top) + {len(END) + 1}, _size)")
    cut = rows.select(
        "file", "split", "at", "head", F.when(odd, F.raise_error(F.concat(F.lit("broken record in "), "file"))).otherwise(before + F.col("_size") + len(start) + len(END)).cast("long").alias("length"), block.alias("_block")
    ).withColumn("http", F.substring_index(F.col("_block").cast("string"), END, 1))
    return cut.withColumn("payload", F.expr(f"substring(_block, octet_length(http) + {len(END) + 1}, octet_length(_block))")).drop("_block")


def captures(records: DataFrame) -> DataFrame:
    """The index rows of records, with each one's offset in its file; digests and lengths of responses are of the bytes read."""
    head = F.col("head")
    response = head["WARC-Type"] == "response"
    date = F.regexp_replace(head["WARC-Date"], "[^0-9]", "")
    stated = F.regexp_extract("http", r"(?i)\r\nContent-Length: ([0-9]+)", 1).cast("long")
    rows = records.select(
        "file", "split", "at", "length", head["WARC-Target-URI"].alias("url"), date.alias("timestamp"), head["X-Page"].cast("long").alias("page_id"),
        head["WARC-Type"].alias("record_type"), head["X-Refers-To-Page"].cast("long").alias("refers_to"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(stated).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index(head["WARC-Payload-Digest"], ":", -1)).alias("payload_digest"),
    )
    earlier = Window.partitionBy("file").orderBy("split", "at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).withColumn("url_key", url_key(F.col("url")))
    return rows.select(*[c.split()[0] for c in CAPTURE.split(", ")])


def sorted_runs(rows: DataFrame) -> DataFrame:
    """Captures sorted in the tasks where they lie: a run a task, with each row's turn in it."""
    own = rows.sortWithinPartitions(*KEY_ORDER)
    return materialize(own.withColumn("run", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "runs")


class LoserTree:
    """Merges sorted stretches keys[starts[k]:ends[k]]: a place is out after log2(k) comparisons, each with the loser that waits on its way up."""

    def __init__(self, keys: list, starts: list[int], ends: list[int]) -> None:
        self.keys, self.at, self.ends, self.k = keys, list(starts), ends, len(starts)
        self.losers = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (b, a) if self._before(b, a) else (a, b)
        self.winner = winners[1] if self.k else 0

    def _before(self, a: int, b: int) -> bool:
        if self.at[a] == self.ends[a]:
            return False
        if self.at[b] == self.ends[b]:
            return True
        x, y = self.keys[self.at[a]], self.keys[self.at[b]]
        return x < y or x == y and a < b

    def __iter__(self) -> Iterator[int]:
        """Places of keys in ascending order; of equal keys, that of the earlier stretch first."""
        if not self.k:
            return
        while self.at[self.winner] < self.ends[self.winner]:
            own = self.winner
            yield self.at[own]
            self.at[own] += 1
            node = (own + self.k) // 2
            while node:
                if self._before(self.losers[node], own):
                    own, self.losers[node] = self.losers[node], own
                node //= 2
            self.winner = own


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    rows = pd.concat([b for b in batches if len(b)] or [pd.DataFrame()])
    if not len(rows):
        return
    page = rows["page_id"].astype("Int64")
    keys = list(zip(rows["url_key"], rows["timestamp"], page.notna(), page.fillna(0).astype("int64"), rows["file"], rows["offset"].tolist(), strict=True))
    starts = np.flatnonzero(np.diff(rows["run"].to_numpy(), prepend=-1)).tolist()
    order = np.fromiter(LoserTree(keys, starts, [*starts[1:], len(keys)]), dtype=np.int64, count=len(keys))
    out = rows.iloc[order].assign(page_id=page.iloc[order], refers_to=rows["refers_to"].astype("Int64").iloc[order], part=TaskContext.get().partitionId(), place=np.arange(len(rows)))
    yield out.drop(columns=["run", "seq"])


def merge_runs(runs: DataFrame, rows_per_range: int = 20_000) -> DataFrame:
    """All captures in order of url key, time, page_id, file and offset: the index, with `position` from 0.

    Ranges of the whole key are even by count even where one url holds most captures, as time and
    place are part of it. A task holds one range, about rows_per_range rows; of a run it gets a
    slice that is sorted as the run is.
    """
    n = runs.count() // rows_per_range + 1
    dealt = runs.repartitionByRange(n, *KEY_ORDER).sortWithinPartitions("run", "seq")
    merged = materialize(dealt.mapInPandas(_merge, f"{CAPTURE}, part int, place long"), "index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return merged.join(parts, "part").withColumn("position", F.col("_start") + F.col("place")).drop("part", "place", "_start")


def index_archives(spark: SparkSession, path: str, token: str | None = None) -> DataFrame:
    """The capture index of the archives at a path."""
    runs = sorted_runs(captures(read_warc(spark, path, token)))
    index = merge_runs(runs)
    discard(runs)
    return index


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, read back and indexed; the archives go when they are indexed.

    The table has no capture times: page_id seconds (within ten years) after 2020 stand for them.
    """
    pages = read_table(spark, sf_dir, "pages")
    path = shared_path(spark, "warc")
    token = write_warc(pages, path, F.lit(1_577_836_800) + F.coalesce(F.pmod("page_id", F.lit(315_360_000)), F.lit(0)))
    index = index_archives(spark, path, token)
    remove(spark, path)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


ORACLE_SQL = r"""
WITH told AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         regexp_replace(coalesce(url, ''), '(?s)#.*$', '') AS u FROM pages),
first AS (SELECT payload_digest, min(page_id) AS lead FROM told WHERE payload_bytes >= 100 GROUP BY payload_digest),
cut AS (
  SELECT t.*, lead, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)([^?]*)(.*)$', 1)),
                '^.*@', ''), ':(80|443)?$', ''), '^www[0-9]*\.', '') AS host,
         regexp_extract(u, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)([^?]*)(.*)$', 2) AS p,
         regexp_extract(u, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)([^?]*)(.*)$', 3) AS q
  FROM told t LEFT JOIN first USING (payload_digest)),
keyed AS (
  SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN p = '' THEN '/' ELSE p END
            || CASE WHEN length(q) > 1 THEN '?' || array_to_string(list_sort(string_split(q[2:], '&')), '&') ELSE '' END AS url_key FROM cut)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN lead IS NULL OR lead = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN lead <> page_id THEN lead END AS refers_to, url_key, row_number() OVER (ORDER BY url_key, page_id) - 1 AS position
FROM keyed
"""
