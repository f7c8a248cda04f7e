"""WARC archives: a writer and a sequential reader.

Every record is a gzip member of its own. The reader takes a stream of chunks, decompresses incrementally,
frames each record by its Content-Length, checks that exactly that many bytes and the closing line ends
follow, that the member ends there, and that block and payload digests are right.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_written, new_path, salted_join, ship, written

#: payloads from this size on are stored once; an archive is closed at this size; bytes read at a time
MIN_SHARED, ARCHIVE_BYTES, CHUNK = 1000, 1 << 30, 1 << 18
#: compression and the date that is written where a page has none: archives of equal input are equal
LEVEL, DATE = 6, "1970-01-01T00:00:00Z"
#: plain bytes inflated at a time, and those of a header at most
INFLATE, MAX_HEADER = 1 << 20, 1 << 20
#: names that Hadoop has for stores which pyarrow knows by another
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs"}
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class WarcError(ValueError):
    """An archive that breaks the format or a digest."""


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member. Line ends in header values become blanks."""
    lines = ["WARC/1.1", *(f"{k}: {' '.join(v.split())}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode("utf-8", "replace")) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The record of a page: a response, or a revisit without payload if it refers to another page."""
    key = "null" if page_id is None else str(page_id)
    block = HTTP_HEAD if refers_to is not None else HTTP_HEAD + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(f"page:{key}")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url or ""),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("X-Page-ID", key),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_id(f"page:{refers_to}")), ("X-Refers-To-Page", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return record(headers, block)


def read_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of a stream; raises WarcError where it is broken."""
    feed, left, ended = iter(chunks), b"", False

    def more() -> bytes:
        nonlocal ended
        for c in feed:
            if c:
                return c
        ended = True
        return b""

    while True:
        if not left:
            left = more()
            if ended:
                return
        z = zlib.decompressobj(31)
        plain, need, headers, start, seen = bytearray(), None, None, 0, 0
        while not z.eof:
            if not left:
                left = more()
                if ended:
                    raise WarcError("the archive ends inside a record")
            try:
                plain += z.decompress(left, INFLATE)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            left = z.unused_data if z.eof else z.unconsumed_tail
            if headers is None and (at := plain.find(b"\r\n\r\n", seen)) >= 0:
                head = plain[:at].decode("utf-8", "replace").split("\r\n")
                if not head[0].startswith("WARC/"):
                    raise WarcError("no WARC version line")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
                start = at + 4
                try:
                    need = start + int(headers["content-length"]) + 4
                except (KeyError, ValueError) as e:
                    raise WarcError("no Content-Length") from e
            seen = max(0, len(plain) - 3)
            if len(plain) > (MAX_HEADER if need is None else need):
                raise WarcError("a header without end" if need is None else "more bytes than Content-Length says")
        if need is None or len(plain) != need or plain[-4:] != b"\r\n\r\n":
            raise WarcError("the member doesn't end with the record")
        block = bytes(plain[start:-4])
        if not _agrees(headers.get("warc-block-digest"), block):
            raise WarcError("wrong block digest")
        yield headers, block


def _hex(digest: str | None) -> str | None:
    """A SHA-1 digest header as lower-case hex, whether it is in hex or in base 32; None for none or another algorithm."""
    algorithm, _, value = (digest or "").partition(":")
    if algorithm.lower() != "sha1":
        return None
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except ValueError as e:
            raise WarcError("a digest that is none") from e
    return value.lower()


def _agrees(digest: str | None, data: bytes) -> bool:
    want = _hex(digest)
    return want is None or want == hashlib.sha1(data).hexdigest()


def payload_of(headers: dict[str, str], block: bytes) -> bytes | None:
    """The payload of a response, its digest checked; None for other records. A block that isn't HTTP is its payload."""
    if headers.get("warc-type") != "response":
        return None
    payload = block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block
    if not _agrees(headers.get("warc-payload-digest"), payload):
        raise WarcError("wrong payload digest")
    return payload


def row_of(headers: dict[str, str], body: bytes | None, payloads: bool) -> tuple:
    """The row of a record. What other writers leave out is null, or follows from the payload."""
    number = lambda k: int(headers[k]) if headers.get(k, "null") != "null" else None
    size = number("x-payload-length")
    if body is not None and size is not None and len(body) != size:
        raise WarcError("wrong payload length")
    digest = _hex(headers.get("warc-payload-digest"))
    if body is not None:
        size, digest = len(body), digest or hashlib.sha1(body).hexdigest()
    return number("x-page-id"), headers.get("warc-target-uri"), headers.get("warc-type"), digest, size, number("x-refers-to-page"), body if payloads else None


def _filesystem(path: str):
    """(file system, path in it) of a URI, for Python workers: any store that pyarrow knows, not only local ones."""
    from pyarrow import fs

    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, _, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_shared: int = MIN_SHARED) -> DataFrame:
    """Writes one record a row; returns a written table (path, records) of the archives.

    The payload is the UTF-8 html (null: empty). Of rows with equal payloads of at least min_shared bytes, that
    of the largest id is the response, the others revisit it; rows that share that id are all responses, as
    are rows with a null id. Each task writes its archives under a name of its own attempt, and the table
    lists those of the attempts that succeeded: a task that runs twice leaves no doubt.
    """
    spark = pages.sparkSession
    ship(spark)
    text = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    small = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(text).alias("digest"), F.octet_length(text).alias("size"))
    small = written(small.where(F.col("id").isNotNull() & (F.col("size") >= min_shared)), "digests")
    kept = small.groupBy("digest", "size").agg(F.max("id").alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # ids of rows that revisit; no payload's copies meet in one task, neither their ids nor (joined back by id) their texts
    visits = salted_join(small, kept, ["digest", "size"], "n", small.count()).where("id <> to").select("id", "to", F.col("digest").alias("of")).distinct()
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text.alias("html"), F.sha1(text).alias("digest"))
    named = rows.where("id is not null").join(visits, "id", "left").unionAll(rows.where("id is null").withColumns({"to": F.lit(None).cast("long"), "of": F.lit(None).cast("string")}))
    named = named.select("id", "url", "html", "digest", F.when(F.col("of") == F.col("digest"), F.col("to")).alias("to"))
    folder = new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(folder)
        fs.create_dir(top, recursive=True)
        out, done, n, size = None, [], 0, 0
        for batch in batches:
            cols = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page, url, html, digest, to = (c[i].as_py() for c in cols)
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(f"{top}/{name}", compression=None), 0, 0
                data = page_record(page, url, html.encode("utf-8", "replace"), digest, to)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "records"])

    out = written(named.mapInArrow(run, "path string, records long"), "archives")
    drop_written(small)
    return out


_RECORD = T.StructType([T.StructField(c, t) for c, t in (("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("payload_digest", T.StringType()), ("payload_bytes", T.LongType()), ("refers_to", T.LongType()), ("payload", T.BinaryType()))])


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (path): page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    Archives of other writers are read, too, if each record is a member of its own: their record types are kept,
    page_id and refers_to are null, digests may be in base 32.

    An archive is read from its start to its end by one task; records stream through it. A broken archive fails
    the job. Digest and length of a revisit are those that its header gives of the full payload. payload is
    null for revisits, and for all if payloads is false (it is checked all the same).
    """
    spark = archives.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = _filesystem(path)
                rows, size = [], 0
                with fs.open_input_stream(at, compression=None) as f:
                    for h, block in read_records(iter(lambda f=f: f.read(CHUNK), b"")):
                        rows.append(row_of(h, payload_of(h, block), payloads))
                        size += len(block) if payloads else 64
                        if len(rows) >= 4096 or size >= 1 << 22:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(run, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _RECORD.fieldNames())


def resolved(records: DataFrame) -> DataFrame:
    """Adds `found` to revisits: whether the response they refer to is there with the same digest and length."""
    responses = records.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_n")).distinct()
    visits = records.where("record_type = 'revisit'").join(responses, "refers_to", "left")
    same = (F.col("_d") == F.col("payload_digest")) & (F.col("_n") == F.col("payload_bytes"))
    return visits.withColumn("found", F.coalesce(same, F.lit(False))).drop("_d", "_n")
