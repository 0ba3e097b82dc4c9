"""WARC archives: written as one gzip stream, normalised to one member per record, read back.

``write_streams`` writes every page as a response record, each task into files of its own
that are one gzip stream from end to end. ``normalise`` takes such whole-file streams,
inflates each once, and writes every record again as a gzip member of its own, next to a
sidecar with the offset and length of every member; on the way, records whose payload
another record already has become revisits. ``read_archives`` seeks every member by its
sidecar, inflates it alone and parses it.

Pages are never moved between tasks: which records are revisits is decided on the narrow
index that the writers return. Files have new random names, and only the index of the
attempt that Spark commits is read, so a lost executor or a second attempt leaves at most
files that nothing refers to. All files lie in the shared folder and are reached by its
address, local or remote.

Defined cases: a null payload is empty; a null id is carried, ranks behind all others and
is named by no revisit unless all ids are null; of equal rows one is the response; an
address may hold anything, control characters are escaped; other columns are not read; an
empty table gives no archives and an empty table.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import durable, scratch_path

#: Payloads from this size on may be revisits.
MIN_SHARED_BYTES = 100
#: Size before compression from which a writer begins a new file.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Compression of the passing stream and of the members that stay.
STREAM_LEVEL, MEMBER_LEVEL = 1, 4

# Names of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Schemes that Arrow opens, by their names in Spark.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def arrow_address(address: str) -> str:
    """An address as Arrow names it; a scheme that it cannot open is an error."""
    scheme, _, rest = address.partition(":")
    if scheme not in SCHEMES:
        raise ValueError(f"archives cannot be written to {address}: use one of {', '.join(SCHEMES)}")
    return f"{SCHEMES[scheme]}:{rest}"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder on the file system that Spark means by it: without a scheme that is the
    default one of the cluster, and no disk of an executor."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    address = arrow_address(str(system.makeQualified(target)))
    # a path stays one where the default is the local disk, as in tests
    return address if "://" in folder or not address.startswith("file:") else folder


def locate(address: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address, with or without a scheme."""
    if "://" in address:
        return fs.FileSystem.from_uri(address)
    return fs.LocalFileSystem(), address.removeprefix("file:")


def _create(address: str):
    system, path = locate(address)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


# ------------------------------------------------------------------- records


def _escaped(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, record_id: str, fields: dict[str, str | None], block: bytes) -> bytes:
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        **fields,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items() if v is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _http_head(payload_bytes: int) -> bytes:
    return (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n"
    ).encode()


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Head and block of every record of a stream, holding one record at a time."""
    held = bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        searched = 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("archive ends inside a record")
                return
        head = parse_head(bytes(held[:end]))
        size = int(head["Content-Length"])
        total = end + 4 + size + 4
        if not fill(total):
            raise ValueError("archive ends inside a record")
        yield head, bytes(held[end + 4 : end + 4 + size])
        del held[:total]


def inflate(source) -> Iterator[bytes]:
    """The contents of a gzip file, piece by piece; several members follow each other."""
    engine = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            if plain := engine.decompress(data):
                yield plain
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
            else:
                break


def _as_number(value: str | None) -> int | None:
    return int(value) if value else None


# ------------------------------------------------------------------- writing


def write_streams(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes the pages and returns ``file, ordinal, id, payload_bytes, payload_digest``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, stream, name, size, ordinal = None, None, "", 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for page, address, body in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, size, ordinal = _create(name), 0, 0
                    stream = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=STREAM_LEVEL, mtime=0)
                body = body or b""
                digest = hashlib.sha256(body).hexdigest()
                data = record(
                    "response",
                    f"urn:uuid:{uuid.uuid4()}",
                    {
                        "WARC-Target-URI": None if address is None else _escaped(address),
                        "WARC-Payload-Digest": f"sha256:{digest}",
                        "X-Page-Id": None if page is None else str(page),
                    },
                    _http_head(len(body)) + body,
                )
                stream.write(data)
                rows.append((name, ordinal, page, len(body), digest))
                ordinal, size = ordinal + 1, size + len(data)
                if size >= archive_bytes:
                    stream.close()
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                if rows
                else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())],
                ["file", "ordinal", "id", "payload_bytes", "payload_digest"],
            )
        if out is not None:
            stream.close()
            out.close()

    rows = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(payload).cast("binary"))
    schema = "file string, ordinal long, id long, payload_bytes long, payload_digest string"
    return durable(rows.mapInArrow(write, schema))


def revisits(index: DataFrame, min_bytes: int = MIN_SHARED_BYTES) -> DataFrame:
    """``file, ordinal, refers_to`` of the records whose payload another record stands for."""
    large = index.where(F.col("payload_bytes") >= min_bytes)
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "file", "ordinal")
    first = large.groupBy("payload_digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return (
        large.join(first, "payload_digest")
        .where((F.col("file") != F.col("first.file")) | (F.col("ordinal") != F.col("first.ordinal")))
        .select("file", "ordinal", F.col("first.id").alias("refers_to"))
    )


def normalise(index: DataFrame, folder: str, min_bytes: int = MIN_SHARED_BYTES) -> DataFrame:
    """Rewrites every stream of the index and returns ``archive, sidecar, records``."""
    # a file is small, and so is the list of its revisits
    changes = revisits(index, min_bytes).groupBy("file").agg(F.collect_list(F.struct("ordinal", "refers_to")).alias("revisits"))
    files = index.select("file").distinct().join(changes, "file", "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                refers = {r["ordinal"]: r["refers_to"] for r in row["revisits"] or []}
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                entries, offset = [], 0
                system, path = locate(row["file"])
                with system.open_input_stream(path, compression=None) as source, _create(name) as out:
                    for ordinal, (head, block) in enumerate(split_records(inflate(source))):
                        kind = "revisit" if ordinal in refers else "response"
                        fields = {k: head.get(k) for k in ("WARC-Target-URI", "WARC-Payload-Digest", "X-Page-Id")}
                        if kind == "revisit":
                            block = block[: block.index(b"\r\n\r\n") + 4]
                            to = refers[ordinal]
                            fields |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-Id": None if to is None else str(to)}
                        data = record(kind, head["WARC-Record-ID"][1:-1], fields, block)
                        member = gzip.compress(data, MEMBER_LEVEL, mtime=0)
                        out.write(member)
                        entries.append({"offset": offset, "length": len(member), "type": kind, "id": _as_number(fields["X-Page-Id"])})
                        offset += len(member)
                with _create(f"{name}.index") as out:
                    out.write("".join(json.dumps(e, sort_keys=True) + "\n" for e in entries).encode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([f"{name}.index"]), pa.array([len(entries)], pa.int64())],
                    ["archive", "sidecar", "records"],
                )

    tasks = files.sparkSession.sparkContext.defaultParallelism
    # round robin: every task gets files, whatever their names
    return durable(files.repartition(max(tasks, index.rdd.getNumPartitions())).mapInArrow(rewrite, "archive string, sidecar string, records long"))


# ------------------------------------------------------------------- reading


def read_member(data: bytes) -> tuple[dict[str, str], bytes]:
    """Head and block of the one record of a member."""
    return next(split_records(iter([gzip.decompress(data)])))


def read_archives(archives: DataFrame) -> DataFrame:
    """``id, url, payload, payload_bytes, payload_digest, record_type, refers_to, archive,
    offset, length`` of every record; a revisit has no payload of its own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = locate(row["sidecar"])
                with system.open_input_stream(path, compression=None) as source:
                    entries = [json.loads(line) for line in source.read().splitlines()]
                system, path = locate(row["archive"])
                rows, held = [], 0
                with system.open_input_file(path) as source:
                    for entry in entries:
                        rows.append(_row(row["archive"], entry, source.read_at(entry["length"], entry["offset"])))
                        held += len(rows[-1]["payload"] or b"")
                        if held > CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, _READ)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    return archives.select("archive", "sidecar").mapInArrow(
        read,
        "id long, url string, payload binary, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, archive string, offset long, length long",
    )


_READ = pa.schema(
    [("id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


def _row(archive: str, entry: dict, data: bytes) -> dict:
    head, block = read_member(data)
    end = block.index(b"\r\n\r\n") + 4
    stated = head["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = head["WARC-Type"]
    size = int(parse_head(block[: end - 4])["Content-Length"])
    payload = block[end:] if kind == "response" else None
    if payload is not None and (hashlib.sha256(payload).hexdigest() != stated or len(payload) != size):
        raise ValueError(f"{archive} at {entry['offset']}: the payload is not the one written")
    return {
        "id": _as_number(head.get("X-Page-Id")),
        "url": head.get("WARC-Target-URI"),
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": stated,
        "record_type": kind,
        "refers_to": _as_number(head.get("X-Refers-To-Page-Id")),
        "archive": archive,
        "offset": entry["offset"],
        "length": entry["length"],
    }


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, **names: str) -> DataFrame:
    """Writes, normalises and lists: ``archive, sidecar, records`` in the shared folder."""
    folder = qualified(spark, folder or scratch_path(spark, "warc"))
    index = write_streams(pages, f"{folder}/streams", **names)
    archives = normalise(index, f"{folder}/archives")
    # the streams have served; the archives are on disk and listed
    system, path = locate(f"{folder}/streams")
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
    return archives
