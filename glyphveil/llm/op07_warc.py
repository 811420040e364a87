"""WARC archives: written, normalised to one gzip member a record with an index beside it, and read back.

A monolithic archive is one gzip stream over all its records, so that no record can be reached without
inflating all before it. The normaliser inflates such a file once, as a stream of small blocks, and
writes every record as a member of its own; a sidecar index holds each member's offset and length. A
reader then inflates single members. Files lie in a folder that all machines share, opened by its URI;
every attempt of a task writes files of its own name, and only names that a finished task has
reported, in a table, are read on. So lost executors leave files that nobody reads, nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphveil.llm.common import scratch_path, staged

BLOCK = 1 << 18
#: Payloads of fewer bytes are stored again rather than referred to.
LEAST_SHARED = 1000
_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(uri: str, write: bool):
    fs, path = pafs.FileSystem.from_uri(uri)
    if write:
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return fs.open_output_stream(path, compression=None)
    return fs.open_input_file(path)


def _attempt() -> str:
    c = TaskContext.get()
    return f"{c.partitionId():06d}-{c.taskAttemptId()}" if c else "local"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with the payload, or a revisit that names the response with the same payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "") or "urn:none"
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line at ''."""
    first, *rest = raw.decode("utf-8", "replace").split("\r\n")
    out = {"": first}
    for line in rest:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class Inflated:
    """The inflated bytes of a gzip file of one or more members, read forward in blocks."""

    def __init__(self, file) -> None:
        self.file, self.inflate, self.held, self.raw, self.ended = file, zlib.decompressobj(31), b"", b"", False

    def more(self) -> bool:
        """Adds the next block to held; False at the end of the file."""
        while not self.ended:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data or self.raw
                self.inflate = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.file.read(BLOCK)
                if not self.raw:
                    self.ended = True
                    break
            got = self.inflate.decompress(self.raw, BLOCK)
            self.raw = b"" if self.inflate.eof else self.inflate.unconsumed_tail
            if got:
                self.held += got
                return True
            if self.inflate.eof and not self.inflate.unused_data:
                self.raw = b""
        return False

    def head(self) -> bytes | None:
        """Up to the next empty line; None at the end."""
        at = 0
        while (k := self.held.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(self.held) - 3)
            if not self.more():
                if self.held:
                    raise ValueError("the archive ends within a record")
                return None
        out, self.held = self.held[:k], self.held[k + 4 :]
        return out

    def body(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self.more():
                raise ValueError("the archive ends within a record")
            part, self.held = self.held[:size], self.held[size:]
            size -= len(part)
            yield part


def normalise_file(source, target, index) -> int:
    """Rewrites the records of a gzip file, each as a member of its own; index gets offset, length and id. Returns how many."""
    stream, at, n = Inflated(source), 0, 0
    while (head := stream.head()) is not None:
        fields = headers(head)
        if not fields[""].startswith("WARC/") or not fields.get("content-length", "").isdigit():
            raise ValueError("not a WARC record")
        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
        target.write(gz.compress(head + b"\r\n\r\n"))
        for part in stream.body(int(fields["content-length"])):
            target.write(gz.compress(part))
        for part in stream.body(4):
            target.write(gz.compress(part))
        target.write(gz.flush())
        written = target.tell() - at
        index.write(f"{at}\t{written}\t{fields.get('warc-record-id', '')}\n".encode())
        at += written
        n += 1
    return n


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, payload digest, type and refers_to of an inflated record; a response's from its payload, a revisit's from its headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    f = headers(head)
    http, _, payload = rest[: int(f["content-length"])].partition(b"\r\n\r\n")
    told = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    if f["warc-type"] == "revisit":
        return number(f["warc-record-id"]), int(headers(http)["content-length"]), told, "revisit", number(f["warc-refers-to"])
    if (digest := hashlib.sha1(payload).hexdigest()) != told:
        raise ValueError(f"the payload of {f['warc-record-id']} has another digest")
    return number(f["warc-record-id"]), len(payload), digest, "response", None


def _over_files(files: DataFrame, run: Callable[[str, str], tuple], ddl: str, kinds: list[pa.DataType]) -> DataFrame:
    """run(path, index) for each row of files, a file a task as far as it goes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from run(path, index)

    return files.select("path", "index").repartition(max(1, files.count())).mapInArrow(each, ddl)


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """(path, index) of the archives written, one a partition of pages (page_id, url, html, digest, refers_to); index is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, path, gz = None, f"{folder}/whole-{_attempt()}.warc.gz", zlib.compressobj(1, zlib.DEFLATED, 31)
        for batch in batches:
            for page_id, url, html, digest, refers in zip(*batch.columns, strict=True):
                file = file or _open(path, True)
                payload = (html.as_py() or "").encode()
                file.write(gz.compress(record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers.as_py())))
        if file:
            file.write(gz.flush())
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None], type=pa.string())], names=["path", "index"])

    return staged(pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, index string"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(path, index) of the archives of archives (path, ...) with one member a record, and of their sidecar indexes."""

    def run(path: str, _: str) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{path.rsplit('/', 1)[1].removesuffix('.warc.gz')}-{_attempt()}"
        out, index = f"{name}.warc.gz", f"{name}.idx"
        with _open(path, False) as source, _open(out, True) as target, _open(index, True) as side:
            normalise_file(source, target, side)
        yield pa.RecordBatch.from_arrays([pa.array([out]), pa.array([index])], names=["path", "index"])

    return staged(_over_files(archives, run, "path string, index string", []), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of normalised archives (path, index): page_id, payload_bytes, payload_digest, record_type, refers_to."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def run(path: str, index: str) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=names)
        with _open(path, False) as file, _open(index, False) as side:
            held = b""
            while part := side.read(BLOCK):
                *lines, held = (held + part).split(b"\n")
                for line in lines:
                    at, size = map(int, line.split(b"\t")[:2])
                    file.seek(at)
                    rows.append(parse_record(zlib.decompress(file.read(size), 31)))
                    if len(rows) >= 4096:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()

    return _over_files(archives, run, _FOUND, kinds)


def with_references(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """pages (page_id, url, html) with digest and refers_to: the largest page_id with the same payload of at least `least` bytes, null for that one itself.

    Only digests that occur twice are kept, staged; so the planner knows their size and broadcasts
    them only below its threshold, else it joins by shuffle. A null html is an empty payload.
    """
    html = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    twice = known.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 AND largest IS NOT NULL")
    twice = staged(twice.select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "largest"), "twice")
    joined = known.join(twice, (known["digest"] == twice["d"]) & (known["bytes"] == twice["b"]), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("largest").eqNullSafe(F.col("page_id")), F.col("largest")).alias("refers_to"))


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """What the archives of pages say, read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Repeated rows give a record each; rows that share the largest page_id of a payload are all
    responses; a null page_id stays null; an empty table gives no archive and no row.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_archives(normalise(write_monolithic(with_references(pages), f"{folder}/whole"), f"{folder}/members"))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS bytes FROM pages),
m AS (SELECT *, CASE WHEN bytes >= {LEAST_SHARED} THEN max(page_id) OVER (PARTITION BY html) END AS largest FROM p)
SELECT page_id, bytes AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN largest IS NOT NULL AND largest IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN largest IS DISTINCT FROM page_id THEN largest END AS refers_to
FROM m
"""
