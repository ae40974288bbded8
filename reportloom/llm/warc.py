"""WARC archives written and read as a chunked record table.

A payload of more than ``CHUNK`` characters is split at code points into the segments of the WARC format: the first
record has segment number 1, ``continuation`` records follow it in the same file, and the last one states the total
length. One row is one chunk (record identifier, chunk number), both when writing and when reading, so no task holds
a whole archive, and readers never hold a whole record: the SHA-256 and the length are carried from chunk to chunk.

Payloads of at least ``LEAST`` bytes that repeat an earlier page's are written as ``revisit`` records without a body
that refer to the response with the smallest page_id.

Null payloads count as empty. Rows with a null page_id are written and read back with a null id; they are never
referred to. Repeated rows stay repeated; copies of the row with the smallest id are all responses. Null urls are left
out of the header. Extra columns are ignored. Line breaks in urls are percent-encoded. No rows give an empty archive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.common import checkpointed

#: Code points of a chunk; a chunk has at most four times as many bytes.
CHUNK = 16_384
#: Payloads shorter than this, in bytes, are never replaced by a reference.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record_id string, chunk int, record_type string, refers_to string, stated_digest string, stated_bytes long, data binary, bytes_so_far long, digest_so_far string, last boolean, intact boolean"


def _record(kind: str, head: list[tuple[str, object]], body: str) -> str:
    fields = [("WARC-Type", kind), *head, ("Content-Length", len(body.encode("utf-8")))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"\r\n{body}\r\n"


def _writer(chunk: int):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Archive text, a chunk a row; the writer's line end closes each record."""
        name = lambda i, k=1: f"<urn:page:{'null' if i is None else i}{f':{k}' if k > 1 else ''}>"
        for b in batches:
            out, size = [], 0
            for page, url, html, digest, n, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                url = url and re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
                shared = [("WARC-Target-URI", url), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", n)]
                if refers is not None:
                    out.append(_record("revisit", [("WARC-Record-ID", name(page)), *shared, ("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers))], ""))
                    continue
                last = max(1, -(-len(html) // chunk))
                for k in range(1, last + 1):
                    part = html[(k - 1) * chunk : k * chunk]
                    number = k if last > 1 else None
                    if k == 1:
                        out.append(_record("response", [("WARC-Record-ID", name(page)), *shared, ("Content-Type", "application/http; msgtype=response"), ("WARC-Segment-Number", number)], HTTP + part))
                    else:
                        total = len(HTTP) + n if k == last else None
                        out.append(_record("continuation", [("WARC-Record-ID", name(page, k)), ("WARC-Segment-Number", number), ("WARC-Segment-Origin-ID", name(page)), ("WARC-Segment-Total-Length", total)], part))
                    size += len(part)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_pydict({"value": out})
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"value": out})

    return written


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> None:
    """Writes one record per row of ``df`` as gzip archives under ``path`` through Spark's own writer."""
    html = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    raw = F.encode("html", "utf-8")
    rows = rows.withColumns({"digest": F.sha2(raw, 256), "n": F.octet_length(raw).cast("long")})
    repeated = rows.where(F.col("n") >= LEAST).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("c")).where("c > 1")
    first = checkpointed(repeated.select("digest", "first"))  # so that a skewed digest can be split in the join
    refers = F.when(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    dealt = rows.join(first, "digest", "left").select("page", "url", "html", "digest", "n", refers.alias("refers"))
    dealt.mapInArrow(_writer(chunk), "value string").write.mode("overwrite").option("lineSep", "\r\n").option("compression", "gzip").text(path)


class _Records:
    """A state machine over lines; a body is as long as its header says, whatever lines it holds."""

    def __init__(self, with_data: bool):
        self.with_data, self.rows = with_data, []
        self.file = self.head = self.left = self.open = None

    def line(self, file: str, line: bytes) -> None:
        if file != self.file:
            self.end()
            self.file = file
        if self.left is not None:
            self._body(line)
        elif self.head is None:
            if line.startswith(b"WARC/"):
                self.head = {}
        elif line:
            k, _, v = line.partition(b":")
            self.head[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
        else:
            self._begin()

    def end(self) -> None:
        """The file ends: what is open was cut short."""
        if self.head and self.left is None:  # inside a header
            self._begin()
        if self.open is not None:
            self._emit(last=True, whole=False)
        self.head = self.left = None

    def _begin(self) -> None:
        """A header is complete."""
        head, size = self.head, _number(self.head.get("content-length"))
        continues = head.get("warc-type") == "continuation"
        if not (continues and self.open is not None and head.get("warc-segment-origin-id") == self.open.get("warc-record-id")):
            if self.open is not None:  # its last segments are missing
                self._emit(last=True, whole=False)
            self.open, self.chunk, self.n, self.raw, self.sha = head, 0, 0, 0, hashlib.sha256()
            self.sound = not continues
        self.sound &= size is not None
        self.left, self.held = max(0, size or 0), bytearray()
        self.http, self.first, self.join = head.get("warc-type") == "response", True, False
        if not self.left:
            self._close()

    def _body(self, line: bytes) -> None:
        whole = line if self.first else b"\r\n" + line
        piece = whole[: self.left]
        self.sound &= len(piece) == len(whole)  # else the line goes on behind the body's end
        self.left -= len(piece)
        self.raw += len(piece)
        if not self.http:
            self.held += piece if self.join or self.first else piece[2:]
            self.join = True
        elif not line and not self.first:  # the HTTP header ends; the line end before the next line is a part of it
            self.http = False
        self.first = False
        if not self.left:
            self._close()
        elif len(self.held) >= 4 * CHUNK:
            self._emit(last=False)

    def _close(self) -> None:
        """A segment is complete."""
        total = self.head.get("warc-segment-total-length")
        self.sound &= total is None or _number(total) == self.raw
        self._emit(last=total is not None or "warc-segment-number" not in self.head)
        self.head = self.left = None

    def _emit(self, last: bool, whole: bool = True) -> None:
        self.sha.update(self.held)
        self.chunk += 1
        self.n += len(self.held)
        head = self.open
        kind, label = head.get("warc-type"), head.get("warc-payload-digest", "")
        stated, size = label[7:] if label.startswith("sha256:") else "", _number(head.get("x-payload-length"))
        if last or self.with_data:
            same = kind != "response" or (not stated or stated == self.sha.hexdigest()) and (size is None or size == self.n)
            name = head.get("warc-segment-origin-id" if kind == "continuation" else "warc-record-id")
            data = bytes(self.held) if self.with_data else None
            self.rows.append((name, self.chunk, kind, head.get("warc-refers-to"), stated, -1 if size is None else size, data, self.n, self.sha.hexdigest(), last, whole and self.sound and same if last else None))
        self.held = bytearray()
        if last:
            self.open = None


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


def _chunks(with_data: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CHUNKS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        records = _Records(with_data)

        def taken() -> pa.RecordBatch:
            columns = zip(*records.rows, strict=True) if records.rows else [[] for _ in names]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
            records.rows = []
            return batch

        for b in batches:
            for file, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                records.line(file, line)
            yield taken()
        records.end()
        yield taken()

    return parse


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives under ``path``; without data, only each record's last chunk.

    A record of another writer, in one segment, comes in chunks too. ``intact`` is told on the last chunk. It is false if the
    record's file ends before its body or before its last segment, if its lines go on behind the length that is stated, if a
    segment has no first one, if a number is none, and if a response's payload has another length or SHA-256 than the header
    states; what was read is given. A gzip file that is cut short is an error of Spark's reader, unless
    ``spark.sql.files.ignoreCorruptFiles`` lets it go on with what it has read.

    Archives are compressed whole, so a file is read by one task from its start, line by line.
    """
    lines = spark.read.option("lineSep", "\r\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_chunks(with_data), CHUNKS)


def archive_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    A revisit has no payload of its own; its length and digest are those that its header states. Records that are damaged
    stay, with the length and digest of what was read, and are not ``intact``; a segment without a first one is a
    ``continuation`` of its own. Records of other types are told with their type.
    """
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    revisit = F.col("record_type").eqNullSafe("revisit")
    return read_chunks(spark, path, with_data=False).where("last").select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type",
        F.when(revisit, page("refers_to")).alias("refers_to"),
        "intact",
    )
