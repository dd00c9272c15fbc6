"""WARC archives written and read by Spark, and their capture index merged from sorted runs.

Archives: each record is one row of Spark's text writer with the four bytes that end a WARC
record as its line separator, so files are committed by Spark, on any file system it can
write, and a task that is lost is written again. Index: every archive read back gives one run,
sorted by URL key, capture time and page; ranges of keys are dealt out by sampled bounds, and
within a range a loser tree merges the k runs' segments, which leaves all histories in global
order over (range_id, range_pos).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, new_path

#: The alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
#: Pages have no time of their own: the first page is captured then, each next one a second later, and after so many seconds (95 years) from there again.
FIRST_CAPTURE, CAPTURE_SPAN = 1704067200, 3_000_000_000
#: What an archive holds at most, before compression, and how many times the mean size a payload is of its kind.
RECORDS, FILE_BYTES, LARGE = 5000, 256 << 20, 8
INDEX_FIELDS = [
    ("url_key", pa.string()), ("capture_ts", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("record_offset", pa.int64()),
]
INDEX_DDL = "url_key string, capture_ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long"


def base32_of_sha1(hexed: Column) -> Column:
    """A hex SHA-1 in base32: each five hex digits are four characters."""
    parts = []
    for g in range(8):
        v = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, _body and _sha1."""
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("_body")).withColumn("_sha1", F.sha1(F.encode("_body", "UTF-8")))


def payloads(pages: DataFrame) -> DataFrame:
    """_sha1, _max (the largest page_id), _again (whether an id has the payload more than once), _n and _bytes of each payload.

    Only digests and ids are grouped, by payload and id before they are by payload, so that a
    payload of any number of pages is combined where it is read.
    """
    rows = with_digests(pages).select("_sha1", "page_id", F.octet_length("_body").cast("long").alias("_bytes"))
    by_id = rows.groupBy("_sha1", "page_id").agg(F.count("*").alias("_n"), F.max("_bytes").alias("_bytes"))
    return by_id.groupBy("_sha1").agg(F.max("page_id").alias("_max"), (F.max("_n") > 1).alias("_again"), F.sum("_n").alias("_n"), F.max("_bytes").alias("_bytes"))


def with_roles(rows: DataFrame, first: DataFrame, min_bytes: int, repeats: bool) -> DataFrame:
    """rows (of with_digests) with _first, the page_id of the response to revisit, else null, and _ord, which tells records of one id and payload apart.

    Of equal payloads of at least min_bytes the one with the largest page_id is the response.
    Payloads move once, to their digest's response; those of repeated ids, which must be
    numbered, once more, by id.
    """
    joined = rows.join(first.select("_sha1", "_max", "_again").hint("shuffle_hash"), "_sha1")
    if repeats:
        again = joined.filter("_again").repartition("_sha1", "page_id")
        number = F.row_number().over(Window.partitionBy("_sha1", "page_id").orderBy("url")) - 1
        joined = joined.filter("NOT _again").withColumn("_ord", F.lit(0)).unionByName(again.withColumn("_ord", number))
    else:
        joined = joined.withColumn("_ord", F.lit(0))
    revisits = (F.octet_length("_body") >= min_bytes) & F.col("_max").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_max"))
    return joined.withColumn("_first", F.when(revisits, F.col("_max"))).drop("_max", "_again")


def record_text(first: Column) -> Column:
    """The WARC record of a row of with_roles(), without the bytes that end it."""
    line = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x), F.lit("\r\n"))
    name = lambda c, n: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(":"), F.substring("_sha1", 1, 24), F.lit(":"), n.cast("string"), F.lit(">"))
    size = F.octet_length("_body").cast("string")
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", size), F.lit("\r\n"))
    when = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(CAPTURE_SPAN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    block = F.when(first.isNull(), F.concat(http, F.col("_body"))).otherwise(http)
    return F.concat(
        line("WARC/1.1"),
        line("WARC-Type: ", F.when(first.isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID: ", name(F.col("page_id"), F.col("_ord"))),
        line("WARC-Date: ", when),
        F.coalesce(line("WARC-Target-URI: ", url), F.lit("")),
        line("WARC-Payload-Digest: sha1:", base32_of_sha1(F.col("_sha1"))),
        F.when(first.isNull(), F.lit("")).otherwise(line("WARC-Refers-To: ", name(first, F.lit(0)))),
        F.when(first.isNull(), F.lit("")).otherwise(line(f"WARC-Profile: {REVISIT_PROFILE}")),
        line("Content-Type: application/http;msgtype=response"),
        line("Content-Length: ", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record for each row of pages (page_id, url, html) into gzipped archives under path.

    An archive holds at most records_per_file records and file_bytes bytes of payload, or one
    record: payloads of up to LARGE times the mean size go to archives of as many records as
    may be, the larger ones to archives of as many of the largest as fit.
    """
    first = materialize(payloads(pages), "payloads")
    n, total, most, repeats = first.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.col("_n") * F.col("_bytes")), F.lit(0)), F.coalesce(F.max("_bytes"), F.lit(0)), F.coalesce(F.max("_again"), F.lit(False))).first()
    usual = max(LARGE * math.ceil(total / max(n, 1)), file_bytes // records_per_file)
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    kinds = [(pages, min(most, usual))] if most <= usual else [(pages.filter(size <= usual), usual), (pages.filter(size > usual), most)]
    for part, largest in kinds:
        records = max(1, min(records_per_file, file_bytes // max(largest, 1)))
        rows = with_roles(with_digests(part), first, min_bytes, repeats)
        rows.select(record_text(F.col("_first")).alias("value")).write.mode("append").option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parse_records(stream: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset (in the stream as read), headers (names in lower case) and block of each record; one record is in memory at a time."""
    at = 0
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        size, headers = len(version), {}
        while (line := stream.readline()) != b"\r\n":
            name, colon, value = line.decode().rstrip("\r\n").partition(": ")
            if not colon:
                raise ValueError(f"the header of the record at {at} doesn't end")
            headers[name.lower()] = value
            size += len(line)
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it says")
        yield at, headers, block
        at += size + len(line) + len(block) + 4


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: host labels reversed, no scheme, port, www or fragment."""
    if not url:
        return ""
    rest = url.split("#", 1)[0]
    rest = rest.split("://", 1)[1] if "://" in rest else rest
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host = rest[:cut].rsplit("@", 1)[-1].split(":", 1)[0].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:] or "/")


def _page(name: str | None) -> int | None:
    number = name.removeprefix("<urn:page:").split(":", 1)[0] if name else "null"
    return None if number == "null" else int(number)


def entry_of(archive: str, at: int, headers: dict[str, str], block: bytes) -> tuple:
    """A line of the index; a response's digest is worked out from its bytes and must be the recorded one."""
    http, _, body = block.partition(b"\r\n\r\n")
    said = headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    kind = headers["warc-type"]
    if kind == "response":
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()  # noqa: S324  the format's digest
        if (digest, len(body)) != (said, size):
            raise ValueError(f"{archive} at {at}: payload and digest differ")
    when = headers["warc-date"]
    stamp = "".join(c for c in when if c.isdigit())
    return url_key(headers.get("warc-target-uri")), stamp, _page(headers["warc-record-id"]), size, said, kind, _page(headers.get("warc-refers-to")), archive, at


def order_of(row: tuple) -> tuple:
    """URL key, capture time, page (null first), then the place in the archives."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def read_runs(spark, path: str) -> DataFrame:
    """The archives' records as index lines, each archive's sorted: one run per archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                archive = name.as_py().rsplit("/", 1)[-1]
                with gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())) as data:
                    rows = sorted((entry_of(archive, *r) for r in parse_records(io.BufferedReader(data))), key=order_of)
                for lo in range(0, len(rows), 4096):
                    yield _batch(rows[lo : lo + 4096], INDEX_FIELDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX_DDL)


class LoserTree:
    """Merges k sorted iterators: inner nodes hold the losers of their matches, so each row replays one path."""

    def __init__(self, runs: list[Iterable[tuple]], key) -> None:
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.k
        self.winner = self._build()

    def _beats(self, a: int, b: int) -> bool:
        """Whether leaf a comes out before leaf b; ended runs come last, ties go to the earlier run."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _build(self) -> int:
        won = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return won[1] if self.k > 1 else 0

    def __iter__(self) -> Iterator[tuple]:
        while self.keys[self.winner] is not None:
            leaf = self.winner
            yield self.heads[leaf]
            head = next(self.runs[leaf], None)
            self.heads[leaf], self.keys[leaf] = head, None if head is None else self.key(head)
            node = (leaf + self.k) // 2
            while node >= 1:
                if self._beats(self.losers[node], leaf) if self.k > 1 else False:
                    self.losers[node], leaf = leaf, self.losers[node]
                node //= 2
            self.winner = leaf


def merge_runs(runs: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """Merges the runs of read_runs() into one order; adds range_id and range_pos, which give it.

    Ranges are bounded by sampled keys of URL, time and page, so that one URL or host with many
    captures takes as many ranges as it needs; a task holds one range of about range_rows lines.
    """
    fields = [*INDEX_FIELDS, ("range_id", pa.int32()), ("range_pos", pa.int64())]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a run's rows come in its order, in one block or several; a block that doesn't go on where the last one ended is a run of its own
        segments: list[list[tuple]] = []
        at: dict[str, int] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = at.get(row[7])
                if k is None or order_of(row) < order_of(segments[k][-1]):
                    k = at[row[7]] = len(segments)
                    segments.append([])
                segments[k].append(row)
        range_id, out, pos = TaskContext.get().partitionId(), [], 0
        for row in LoserTree(segments, order_of):
            out.append((*row, range_id, pos))
            pos += 1
            if len(out) == 4096:
                yield _batch(out, fields)
                out = []
        if out:
            yield _batch(out, fields)

    spark = runs.sparkSession
    kept = materialize(runs, "captures")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(kept.count() / range_rows))
    return kept.repartitionByRange(ranges, "url_key", "capture_ts", "page_id", "archive", "record_offset").mapInArrow(merge, f"{INDEX_DDL}, range_id int, range_pos long")


def with_positions(merged: DataFrame) -> DataFrame:
    """merged (of merge_runs) with position, each line's place in the global order, from 0. Only a count for each range comes to the driver."""
    kept = materialize(merged, "merged")
    starts, at = [], 0
    for r in kept.groupBy("range_id").agg(F.count("*").alias("n")).orderBy("range_id").collect():
        starts.append((r.range_id, at))
        at += r.n
    known = kept.sparkSession.createDataFrame(starts, "range_id int, _start long")
    return kept.join(F.broadcast(known), "range_id").withColumn("position", F.col("_start") + F.col("range_pos")).drop("_start")


def capture_histories(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC, reads the archives back and merges their index.

    One row per row of pages: page_id, payload_bytes, payload_digest (base32 SHA-1 of the full
    payload), record_type, refers_to, url_key, capture_ts, position (in the global order of
    those, page_id and place), archive, record_offset (in the archive uncompressed), range_id,
    range_pos. Any long is a page_id. A null html is an empty payload; a null url has key ""; a
    null page_id is less than any other, and is a response only where no equal payload has an
    id. Rows that repeat a page_id and payload are records of their own, with ids of their own,
    all response or all revisit. Very long payloads go to archives of few records and are read one
    at a time. Other columns are ignored, whatever their names. No pages, no rows. Archives go to
    path, or to the shared folder until the driver ends.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    pages = pages.select("page_id", "url", "html")
    write_archives(pages, path, min_bytes)
    merged = with_positions(merge_runs(read_runs(spark, path)))
    first = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_ts", "position"]
    return merged.select(*first, *(c for c in merged.columns if c not in first))
