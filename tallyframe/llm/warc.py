"""Operator 2: WARC archives, normalised from one gzip stream to a member per record.

``write_archives`` writes pages as *monolithic* archives: one gzip stream over a whole file,
in which no record can be reached without inflating all before it. ``normalise`` inflates
each such stream once, in constant memory, rewrites every record as a gzip member of its
own and writes a sidecar index of (offset, length, record id, type, digest). ``read_records``
then reads every member by its offset.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest id is
written as a response; the others are revisit records that refer to it. The choice is a
partial maximum per digest, so a payload shared by a third of all pages makes no hot task.

Files go to the folder named by the caller (by default a fresh one under
``spark.checkpoint.dir``) through Arrow's file systems. A task writes to a name of its own
attempt and renames it when complete, so a repeated task replaces whole files only.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import sized, written
from tallyframe.session import scratch_path

MIN_REVISIT = 1000
LEVEL = 4
BLOCK = 1 << 18
_GZIP = 31      # zlib's window bits for a gzip wrapper
PAGE_ID = "page-id"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its payload's length and digest stay in
    the header."""
    kind = "response" if refers_to is None else "revisit"
    target = "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in (url or "").encode("utf-8")).encode("latin-1")
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(),
            b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")).encode(),
            b"WARC-Date: 2000-01-01T00:00:00Z", b"WARC-Target-URI: " + target,
            b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Length: %d" % len(payload)]
    if page_id is not None:
        head.append(b"X-Page-ID: %d" % page_id)
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 b"X-Refers-To-Page-ID: %d" % refers_to]
        payload = b""
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


class RecordReader:
    """Cuts a fed byte stream into records; holds one record and one block at a time."""

    def __init__(self):
        self.held, self.need = bytearray(), None

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += data
        while True:
            if self.need is None:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = bytes(self.held[:end]).decode("latin-1").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
                self.head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                self.start, self.need = end + 4, end + 8 + int(self.head["content-length"])
            if len(self.held) < self.need:
                return
            whole = bytes(self.held[:self.need])
            del self.held[:self.need]
            self.need = None
            yield self.head, whole


def _replace(system: fs.FileSystem, part: str, path: str) -> None:
    """Puts ``part`` in the place of ``path``: in one step where the file system can."""
    try:
        system.move(part, path)
    except OSError:
        if system.get_file_info(path).type == fs.FileType.NotFound:
            raise
        system.delete_file(path)
        system.move(part, path)


def _write_task(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, out, records = f"{root}/part-{task.partitionId():06d}.warc.gz", None, 0
        part = f"{name}.{task.taskAttemptId()}"
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
        for batch in batches:
            for page, url, html, digest, refers in zip(*batch.columns):
                out = out or system.open_output_stream(part, compression=None)
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                out.write(pack.compress(record(page.as_py(), url.as_py(), payload, digest.as_py(), refers.as_py())))
                records += 1
        if out:
            out.write(pack.flush())
            out.close()
            _replace(system, part, name)
            yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([records], pa.int64())],
                                             ["file", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Monolithic archives of ``pages`` in ``folder``; returns (file, records)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                     F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    # Only payloads that occur more than once matter, and of each one number.
    last = (p.where(F.col("size") >= MIN_REVISIT).groupBy("digest")
            .agg(F.max("page").alias("last"), F.count("*").alias("k")).where("k > 1").select("digest", "last"))
    p = p.join(sized(written(last, "warc-shared")), "digest", "left").select("page", "url", "html", "digest", F.when(
        ~F.col("page").eqNullSafe(F.col("last")) & (F.col("size") >= MIN_REVISIT), F.col("last")).alias("refers"))
    return written(p.mapInArrow(_write_task(folder), "file string, records long"), "warc-files")


def _inflated(stream) -> Iterator[bytes]:
    """The plain bytes of a gzip stream of one member or several (zero bytes may pad them), in
    pieces of bounded size. A member that is cut off is an error."""
    inflate, begun = zlib.decompressobj(_GZIP), False
    while data := stream.read(BLOCK):
        while data:
            if not begun and not (data := data.lstrip(b"\0")):
                break
            begun = True
            yield inflate.decompress(data, 4 * BLOCK)
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate, begun = inflate.unused_data, zlib.decompressobj(_GZIP), False
    if begun:
        yield inflate.flush()
        if not inflate.eof:
            raise ValueError("the stream ends within a gzip member")


def _normalise_task(source: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(source)
        there, goal = _open(target)
        there.create_dir(goal, recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                path, offset, count = f"{goal}/{name}", 0, 0
                part = f"{path}.{TaskContext.get().taskAttemptId()}"
                reader = RecordReader()
                with (system.open_input_stream(f"{root}/{name}", compression=None) as stream,
                      there.open_output_stream(part, compression=None) as out, there.open_output_stream(f"{part}.index") as index):
                    for plain in _inflated(stream):
                        for head, whole in reader.feed(plain):
                            pack = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
                            member = pack.compress(whole) + pack.flush()
                            out.write(member)
                            index.write(json.dumps({
                                "offset": offset, "length": len(member), "record": head["warc-record-id"],
                                "type": head["warc-type"], "digest": head["warc-payload-digest"]}).encode() + b"\n")
                            offset, count = offset + len(member), count + 1
                if reader.held:
                    raise ValueError(f"{name}: the stream ends within a record")
                _replace(there, part, path)
                _replace(there, f"{part}.index", f"{path}.index")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["file", "records"])

    return run


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites the archives (file) of ``source``, each of one gzip member or several, into ``target``, with a member
    per record and an index ``<file>.index`` (JSON lines); returns (file, records)."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(files.select("file").repartition(n, "file").mapInArrow(
        _normalise_task(source, target), "file string, records long"), "warc-normal")


def _read_task(folder: str):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with (system.open_input_file(f"{root}/{name}") as data,
                      system.open_input_stream(f"{root}/{name}.index") as index):
                    left = b""
                    while block := index.read(BLOCK):
                        *lines, left = (left + block).split(b"\n")
                        for line in map(json.loads, lines):
                            data.seek(line["offset"])
                            whole = zlib.decompress(data.read(line["length"]), _GZIP)
                            (head, _), = RecordReader().feed(whole)
                            size = int(head["content-length"])
                            payload = whole[len(whole) - 4 - size:len(whole) - 4]
                            revisit = head["warc-type"] == "revisit"
                            digest = (head["warc-payload-digest"].removeprefix("sha1:") if revisit
                                      else hashlib.sha1(payload).hexdigest())
                            page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                            rows.append((page and int(page), int(head["x-payload-length"]) if revisit else size, digest,
                                         head["warc-type"], refers and int(refers), name, line["offset"]))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset) of every
    record, each read by its offset; responses are hashed anew from what was read."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(n, "file").mapInArrow(_read_task(folder), (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, "
        "offset long"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes, normalises and reads ``pages`` in fresh shared folders.

    Null html counts as empty, a null url as an empty one; rows without an id are written and
    read back without one and, if their payload is shared, are never referred to. Rows that
    share the largest id of a payload are all responses. No pages: no files, no rows."""
    raw, normal = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    files = normalise(write_archives(pages, raw), raw, normal)
    return read_records(files, normal)
