"""Web archives with a globally ordered capture index.

Pages are written as WARC files by Spark's text writer, read back as binary
files and parsed by Content-Length. Each archive yields one run of captures
sorted by URL key and time. The runs are cut at common key ranges, and within a
range a loser tree merges the k pieces, so that the ranges in order are the
capture history of all archives.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize, shared_dir

# Payloads below this size are always stored again.
REVISIT_BYTES = 1000
# Payload bytes per archive file: a file is one row when it is read back.
ARCHIVE_BYTES = 16 << 20
# Captures one task merges.
MERGE_ROWS = 100_000

CRLF = "\r\n"
# Fixed values of the format.
VERSION = "WARC/1.0"
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

RUN = ("url_key string, captured string, page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, "
       "payload_digest string, archive string, offset bigint, length bigint")


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, without scheme, ``www``, port,
    fragment and case; then path and query."""
    lowered = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(lowered, r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r"(^www\.|:\d+$)", "")
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("capture "), F.coalesce(page_id.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, left out where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def with_revisits(pages: DataFrame, smallest: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` with ``payload``, ``payload_bytes``, ``payload_digest`` and
    ``refers_to``: of equal payloads of at least ``smallest`` bytes, the largest
    page_id is stored, the others refer to it."""
    pages = pages.withColumn("payload", F.coalesce("html", F.lit("")))
    pages = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1("payload")})
    shared = materialize(
        pages.filter(F.col("payload_bytes") >= smallest).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("_stored"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "payloads")
    # The stored side has a measured size: small, it is broadcast; else the join shuffles both and can split a hot payload.
    joined = pages.join(shared, ["payload_digest", "payload_bytes"], "left")
    refers = F.when(F.col("_stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_stored")), F.col("_stored"))
    return joined.withColumn("refers_to", refers.cast("bigint")).drop("_stored")


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, smallest: int = REVISIT_BYTES) -> None:
    """Write one WARC record per row of ``pages`` (page_id, url, html, captured)
    to gzipped archives in ``path``. A null html is an empty payload."""
    size = pages.agg(F.sum(F.octet_length("html") + 600)).first()[0] or 0
    rows = with_revisits(pages, smallest)
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " ")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        _line("Content-Length", F.col("payload_bytes")), F.lit(CRLF),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(VERSION + CRLF),
        F.when(revisit, F.lit(f"WARC-Type: revisit{CRLF}WARC-Profile: {IDENTICAL}{CRLF}")).otherwise(F.lit(f"WARC-Type: response{CRLF}")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
        _line("WARC-Target-URI", url),
        _line("WARC-Date", F.col("captured")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        # Own fields: the row's id, that of the stored payload, and its size.
        _line("X-Page-Id", F.col("page_id")),
        _line("X-Refers-To-Page", F.col("refers_to")),
        _line("X-Payload-Bytes", F.col("payload_bytes")),
        _line("X-Url-Key", F.regexp_replace(url_key(F.col("url")), "[\r\n]", " ")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _line("Content-Length", F.octet_length("_block")), F.lit(CRLF),
    )
    records = rows.withColumn("_block", block).select(F.concat(head, "_block").alias("value"))
    files = max(1, math.ceil(size / archive_bytes))
    writer = records.repartition(files).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
    writer.text(path)


def parse_archive(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Records of an archive: offset, length, header fields and block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        yield at, stop + 4 - at, fields, data[start:stop]
        at = stop + 4


def _runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in RUN.split(", ")]
    for part in parts:
        for path, content in zip(part["path"], part["content"]):
            rows = []
            for offset, length, f, block in parse_archive(zlib.decompress(content, 31)):
                payload = block.split(b"\r\n\r\n", 1)[1]
                kind = f["WARC-Type"]
                digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload at {offset} of {path} doesn't match its digest")
                rows.append((f["X-Url-Key"], f.get("WARC-Date"), _whole(f.get("X-Page-Id")), kind, _whole(f.get("X-Refers-To-Page")),
                             len(payload) if kind == "response" else int(f["X-Payload-Bytes"]), digest, path, offset, length))
            rows.sort(key=lambda r: (r[0], r[1] or "", -1 if r[2] is None else r[2]))
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def _whole(text: str | None) -> int | None:
    return None if text is None else int(text)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of captures per archive, checked against the digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInPandas(_runs, RUN)


class LoserTree:
    """Merge of k sorted sources: each inner node keeps the loser of its match,
    so that replacing the winner replays one path from leaf to root."""

    def __init__(self, sources: Iterable[Iterator[tuple]]):
        self.sources = [iter(s) for s in sources]
        self.heads = [next(s, None) for s in self.sources]
        k = len(self.sources)
        self.nodes = [-1] * max(k, 1)
        for leaf in range(k):
            self._replay(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _replay(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + len(self.sources)) // 2
        while node > 0:
            other = self.nodes[node]
            if other < 0:
                if building:
                    self.nodes[node] = winner
                    return
            elif self._beats(other, winner):
                self.nodes[node], winner = winner, other
            node //= 2
        self.nodes[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.heads and self.heads[self.nodes[0]] is not None:
            first = self.nodes[0]
            yield self.heads[first]
            self.heads[first] = next(self.sources[first], None)
            self._replay(first)


def _merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [p for p in parts if len(p)]
    if not frames:
        return
    rows = pd.concat(frames, ignore_index=True)
    # Rows arrive by run, each run in order; a source is one run's piece.
    cut = rows["archive"].ne(rows["archive"].shift()).to_numpy().nonzero()[0].tolist() + [len(rows)]
    keys = list(zip(rows["url_key"], rows["captured"].fillna(""), rows["page_id"].fillna(-1), range(len(rows))))
    order = [key[-1] for key in LoserTree(iter(keys[a:b]) for a, b in zip(cut, cut[1:]))]
    yield rows.iloc[order]


def merge_runs(runs: DataFrame, rows_per_task: int = MERGE_ROWS) -> DataFrame:
    """All runs in one order of URL key, time and page, over range partitions.
    A URL captured without end spreads over several ranges by time and page."""
    runs = materialize(runs, "runs")
    ranges = max(1, math.ceil(runs.count() / rows_per_task))
    pieces = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "offset")
    pieces = pieces.sortWithinPartitions("archive", "url_key", F.coalesce("captured", F.lit("")), F.coalesce("page_id", F.lit(-1)))
    return pieces.mapInPandas(_merge, RUN)


def archive_pages(pages: DataFrame, captured: Column, smallest: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES,
                  rows_per_task: int = MERGE_ROWS) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives, read them back and
    return the ordered captures: url_key, captured, page_id, record_type,
    refers_to, payload_bytes, payload_digest, archive, offset and length (the
    last two in the unpacked archive). ``captured`` gives the time of a row as text.

    A null url has the key ``)``; line breaks in a url become spaces in the
    record. Of rows with equal payloads all that have the largest page_id are
    responses; a row without page_id is a revisit then. Other columns are not archived.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/parcela-warc-{uuid.uuid4().hex}"
    write_archives(pages.select("page_id", "url", "html", captured.alias("captured")), path, archive_bytes, smallest)
    return merge_runs(read_runs(spark, path), rows_per_task)
