"""WARC archives: writing, normalising monolithic gzip streams, and reading by offset.

A writer puts the records of each partition into one archive.  Archives that come as one whole-file gzip
stream can only be read from their start; the normaliser inflates such a stream once, piece by piece,
rewrites every record as a gzip member of its own, and writes a sidecar index (offset and length of each member)
next to the new archive, so that any record can be read alone.

Files are named by partition and moved into place when complete, so a task that runs again leaves the same
files.  Paths go through pyarrow's file systems: any store that it knows will do.  What is held in memory
is one record, never an archive.

Rules: a null payload counts as empty; of records with equal payloads of at least `least` bytes those with the
smallest id are responses and the others revisit them; null ids come last and rows that repeat the smallest
id are responses each; a null url is written as empty; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

CHUNK, LEVEL = 1 << 20, 6
FIXED_DATE = datetime(2020, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
#: Bytes of a row of digests that may be broadcast.
ROW = 96


def digest(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(text: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else "%20" for c in text)


def record(page_id, url: str, payload: bytes, sha: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, whose Content-Length is the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {FIXED_DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def records(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records, byte for byte, from the pieces of an inflated stream."""
    left, pieces = bytearray(), iter(pieces)
    while True:
        while (end := left.find(b"\r\n\r\n")) < 0:
            piece = next(pieces, None)
            if piece is None:
                if left.strip(b"\r\n"):
                    raise ValueError("the stream ends within a record's head")
                return
            left += piece
        size = end + 4 + int(headers(bytes(left[:end]))["content-length"]) + 4
        if len(left) < size:
            parts, have = [bytes(left)], len(left)
            while have < size:
                piece = next(pieces, None)
                if piece is None:
                    raise ValueError("the stream ends within a record")
                parts.append(piece)
                have += len(piece)
            left = bytearray(b"".join(parts))
        yield bytes(left[:size])
        del left[:size]


def inflate(file) -> Iterator[bytes]:
    """Pieces of a gzip file of one or more members, inflated in bounded memory."""
    engine = zlib.decompressobj(31)
    while data := file.read(CHUNK):
        while data:
            if engine.eof:
                engine = zlib.decompressobj(31)
            piece = engine.decompress(data, CHUNK)
            if piece:
                yield piece
            data = engine.unused_data if engine.eof else engine.unconsumed_tail
    if not engine.eof:
        raise ValueError("the gzip stream is cut off")


def _whole(uri: str, write: Callable) -> None:
    """Write a file under a name of this attempt and move it into place."""
    fs, path = place(uri)
    attempt = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
    with fs.open_output_stream(attempt, compression=None) as out:
        write(out)
    fs.move(attempt, path)


def revisits(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, payload binary, refers_to): refers_to is the response's id, null for responses."""
    rows = pages.select(pages[id_col].alias("id"), F.coalesce(pages[url_col], F.lit("")).alias("url"), F.coalesce(pages[payload_col].cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("sha", F.sha1("payload"))
    counted = keyed.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    many = common.cut(counted, "copies")
    if (copies := many.count()) * ROW <= common.BROADCAST_BYTES:  # payloads stay where they are
        found = keyed.join(F.broadcast(many.select("sha", "first")), "sha", "left")
    else:  # payloads that hold more than their share of the copies, so a bounded number, stay where they are; the others meet by digest
        total = many.agg(F.sum("n")).first()[0]
        hot = F.broadcast(many.where(F.col("n") * min(copies, common.BROADCAST_BYTES // ROW) > total).select("sha", "first"))
        rest = keyed.join(hot.select("sha"), "sha", "left_anti").join(many.select("sha", "first"), "sha", "left")
        found = keyed.join(hot, "sha").unionByName(rest)
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return found.select("id", "url", "payload", F.when(other, F.col("first")).alias("refers_to"))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """(path, n): writes revisits()'s rows as one monolithic gzip archive a partition; lazy until used."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = place(folder)
        fs.create_dir(path, recursive=True)
        name, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0

        def fill(out) -> None:
            nonlocal n
            engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for batch in batches:
                for i, url, payload, to in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    out.write(engine.compress(record(i, url, payload, digest(payload), to)))
                    n += 1
            out.write(engine.flush())

        _whole(name, fill)
        yield pa.RecordBatch.from_pydict({"path": [name], "n": pa.array([n], pa.int64())})

    return common.map_rows(rows, run, "path string, n long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(path, index, n): a normalised archive and its sidecar index for each archive in column path; lazy until used."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = place(folder)
        fs.create_dir(path, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name, n = f"{folder}/{source.rsplit('/', 1)[-1].removesuffix('.warc.gz')}", 0
                index: list[str] = []

                def fill(out) -> None:
                    nonlocal n
                    at = 0
                    from_fs, from_path = place(source)
                    with from_fs.open_input_stream(from_path, compression=None) as file:
                        for whole in records(inflate(file)):
                            member = gzip.compress(whole, LEVEL, mtime=0)
                            out.write(member)
                            h = headers(whole[: whole.find(b"\r\n\r\n")])
                            index.append(json.dumps({"offset": at, "length": len(member), "id": h.get("warc-record-id"), "type": h.get("warc-type"), "uri": h.get("warc-target-uri")}, ensure_ascii=False))
                            at += len(member)
                            n += 1

                _whole(f"{name}.norm.warc.gz", fill)
                _whole(f"{name}.index.jsonl", lambda out: out.write("".join(x + "\n" for x in index).encode()))
                yield pa.RecordBatch.from_pydict({"path": [f"{name}.norm.warc.gz"], "index": [f"{name}.index.jsonl"], "n": pa.array([n], pa.int64())})

    return common.map_rows(archives.select("path"), run, "path string, index string, n long")


def read_member(file, offset: int, length: int) -> bytes:
    """One record by its place in a normalised archive."""
    file.seek(offset)
    return gzip.decompress(file.read(length))


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of normalised archives (columns path and index), each read alone by its offset.

    (record_id, uri, record_type, refers_to, payload_bytes, payload_digest, payload): the digest of a response
    is computed again and must be the header's; a revisit has both of the full payload, and no payload.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"][: 7 if with_payload else 6]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
                (fs, at), (index_fs, index_at) = place(path), place(index)
                with index_fs.open_input_stream(index_at, compression=None) as file:
                    entries = [json.loads(x) for x in file.read().splitlines() if x]
                with fs.open_input_file(at) as file:
                    rows, held = [], 0
                    for e in entries:
                        rows.append(_parsed(read_member(file, e["offset"], e["length"]), with_payload))
                        held += e["length"] + (len(rows[-1][-1] or b"") if with_payload else 0)
                        if len(rows) >= common.BATCH_ROWS or held > common.BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return common.map_rows(archives.select("path", "index"), run, "record_id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload)


def _parsed(whole: bytes, with_payload: bool) -> tuple:
    end = whole.find(b"\r\n\r\n")
    head = headers(whole[:end])
    block = whole[end + 4 : -4]
    body = block.find(b"\r\n\r\n") + 4
    payload, sha = block[body:], head["warc-payload-digest"].removeprefix("sha1:")
    size = int(headers(block[: body - 4])["content-length"])
    response = head["warc-type"] == "response"
    if response and (digest(payload) != sha or len(payload) != size):
        raise ValueError(f"{head['warc-record-id']}: the payload is not what its head says")
    name = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x else None
    return (name(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], name(head.get("warc-refers-to")), size, sha, *((payload if response else None,) if with_payload else ()))


def archive(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write pages as archives, normalise them, and return (path, index, n) of the normalised ones.  The monolithic archives go once they are rewritten."""
    spark = pages.sparkSession
    written = common.cut(write(revisits(pages, least, id_col, url_col, payload_col), f"{folder}/monolithic"), "archives")
    files = written.count()
    done = common.cut(normalise(written.repartition(max(1, files)), f"{folder}/normalised"), "normalised")
    common.remove(spark, f"{folder}/monolithic")
    return done
