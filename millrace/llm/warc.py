"""WARC archives of web pages, and their index as globally ordered capture histories.

Writing: every page becomes a record (WARC/1.1, one HTTP response each); of equal payloads the first is a
response and the others are revisits. Records are lines of Spark's text writer with the separator that ends
a WARC record, so archives go to any file system that Spark writes to, in files of bounded size.

Reading: files are read whole (their size is bounded by the writer) and cut by Content-Length; payload
digests are computed anew.

Index: the captures of each file, sorted by URL key and time, are a run. Runs are dealt out by key ranges
(page ids and times included, so one URL with a third of all captures still falls into many ranges), and each
range merges its pieces of all runs by a loser tree. Ranges in order form the whole index.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import durable, scratch_path

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 100
FILE_BYTES = 16 << 20


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, digest, bytes and refers_to (null: a response).

    Only digests that occur more than once are joined with; that table holds one row for each.
    """
    html = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    several = known.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    joined = known.join(durable(several.select("digest", "first"), "payloads"), "digest", "left")
    refers = F.when((F.col("bytes") >= least) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", "bytes", refers.alias("refers_to"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def default_time(page_id: Column) -> Column:
    """Where captures have no time of their own: one second per page id from a fixed day on."""
    seconds = F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(page_id, F.lit(0)))
    return F.date_format(F.to_utc_timestamp(seconds, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame, time: Column | None = None) -> DataFrame:
    """The text of each page's record, without the separator after it; input as of ``with_revisits``."""
    line = F.lit("\r\n")
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    profile = F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("refers_to")), line)).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")), F.lit("\r\nWARC-Date: "), default_time(F.col("page_id")) if time is None else time,
        F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), line, profile,
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return pages.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, least: int = LEAST_REVISIT) -> None:
    """Write all pages (page_id, url, html) as WARC files of about ``file_bytes`` under ``path``, which must be new."""
    size = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    per_file = max(1, int(file_bytes / (size + 600)))
    records(with_revisits(pages, least)).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def url_key(url: str) -> str:
    """Host labels from the top-level domain down, then path and query; scheme, www and fragment do not count."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^#]*)", url)
    host, rest = m.group(1).lower().rpartition("@")[2], m.group(2) or "/"
    host = host.removeprefix("www.")
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + rest


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers with lower-case names, block) of each record of an archive."""
    at = 0
    while at < len(content):
        stop = content.find(END.encode(), at)
        if stop < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = content[at:stop].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin = stop + len(END)
        end = begin + int(headers["content-length"])
        if content[end : end + len(END)] != END.encode():
            raise ValueError(f"record at byte {at} does not end where it should")
        yield at, end + len(END) - at, headers, content[begin:end]
        at = end + len(END)


CAPTURE = "url_key string, time string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, offset long, length long, intact boolean"
NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
SCHEMA = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in CAPTURE.split(", "))])


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[8], row[9]


def captures(file: str, content: bytes) -> list[tuple]:
    """The run of an archive: a row of CAPTURE for each record, sorted. A payload is checked against its digest."""
    out = []
    for offset, length, h, block in parse(content):
        http, _, payload = block.partition(END.encode())
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
        revisit = h["warc-type"] == "revisit"
        digest = h["warc-payload-digest"].removeprefix("sha256:")
        intact = not payload if revisit else len(payload) == size and hashlib.sha256(payload).hexdigest() == digest
        out.append((url_key(h["warc-target-uri"]), h["warc-date"], _page(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], digest, size, _page(h.get("warc-refers-to")), file, offset, length, intact))
    return sorted(out, key=_order)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``, each file's in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = captures(file.as_py().rpartition("/")[2], content.as_py())
                for i in range(0, len(rows), 5000):
                    yield _batch(rows[i : i + 5000])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CAPTURE)


class LoserTree:
    """Merges sorted lists: the root holds the smallest head, every inner node the loser of its match."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.keys = [_order(r[0]) if r else None for r in runs]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k else -1

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, node: int) -> int:
        """Fill the tree below ``node`` (leaves are k to 2k - 1) and return its winner."""
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[self.winner] is not None:
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.keys[w] = _order(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            node = (w + self.k) // 2
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def ascending(rows: list[tuple]) -> list[list[tuple]]:
    """Cut rows into stretches that ascend: the pieces of the runs, however the shuffle has laid them."""
    runs: list[list[tuple]] = []
    last: tuple | None = None
    for row in rows:
        key = _order(row)
        if last is None or key < last:
            runs.append([])
        runs[-1].append(row)
        last = key
    return runs


def merged_index(found: DataFrame, partitions: int | None = None) -> DataFrame:
    """All captures in one order (URL key, time, page id): sorted within each partition, partitions in order.

    ``found`` should be stored; finding the ranges reads its keys once more.
    """
    spark = found.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        out: list[tuple] = []
        for row in LoserTree(ascending(rows)):
            out.append(row)
            if len(out) == 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    page = F.coalesce("page_id", F.lit(-1))
    return found.select(*NAMES).repartitionByRange(n, F.col("url_key"), F.col("time"), page, F.col("file"), F.col("offset")).mapInArrow(run, CAPTURE)


def archive(pages: DataFrame, path: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html), read the archives back and return their merged index.

    A null html is an empty payload, a null url an empty one. Payloads under 100 bytes are all responses; of
    longer equal ones that with the smallest page_id is the response (rows that repeat its page_id are
    responses, too). A null page_id stays null. Repeated rows have a record each. An empty table gives an empty
    index. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, file_bytes)
    return merged_index(durable(read_archives(spark, path), "captures"))


def write_index(index: DataFrame, path: str) -> None:
    """The index as text in its order: URL key, compact time and a JSON object on each line."""
    fields = F.to_json(F.struct(*[c for c in NAMES if c not in ("url_key", "time")]))
    index.select(F.concat_ws(" ", "url_key", F.regexp_replace("time", r"\D", ""), fields)).write.text(path)
