"""Zstandard WARC archives: one frame per record, the dictionary in a leading skippable frame.

Tasks write archives straight into the shared folder and return their paths; only paths of committed tasks are read back,
so a lost or repeated attempt leaves at most a file that nobody lists. Reading streams an archive frame by frame and
validates magic, header, lengths and digest of every record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices, staged

DICTIONARY_MAGIC, FRAME_MAGIC = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes sampled for a dictionary, size of a dictionary, and compressed bytes after which an archive is closed
SAMPLED, DICTIONARY, ROLL = 512 << 10, 16 << 10, 256 << 20
#: Known repeated payloads up to this number (about 30 MB) are broadcast, else joined by a shuffle
BROADCAST_ROWS = 1 << 18
READ_SCHEMA = (
    "archive string, position bigint, record_type string, record_id string, refers_to string, target_uri string, date string, "
    "payload_bytes bigint, payload_digest string, payload binary, error string"
)


def _at(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(pages: DataFrame, id_col: str, payload: Column, min_bytes: int = 0) -> DataFrame:
    """Adds ``_payload`` (bytes, null as empty) and ``_refers_to``: the smallest id of an equal payload of at least
    ``min_bytes`` bytes, null for that record itself, for smaller payloads and where no equal payload has an id."""
    held = pages.withColumn("_payload", F.coalesce(payload.cast("string"), F.lit("")).cast("binary")).withColumn("_sha", F.sha1("_payload"))
    first = staged(
        held.filter(F.octet_length("_payload") >= min_bytes).groupBy("_sha").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1 and _first is not null").select("_sha", "_first"), "repeated",
    )
    few = first.count() <= BROADCAST_ROWS
    joined = held.join(F.broadcast(first) if few else first, "_sha", "left")
    other = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col(id_col))
    return joined.withColumn("_refers_to", F.when(other, F.col("_first"))).drop("_sha", "_first")


def record(kind: str, record_id: str, refers_to: str | None, uri: str | None, date: str, payload: bytes) -> bytes:
    """One WARC record; a revisit carries the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", quote(uri, safe="!#$%&'()*+,/:;=?@[]~")))
    fields.append(("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record; ``error`` names the first fault of an invalid one."""
    cut = raw.find(b"\r\n\r\n")
    if cut < 0 or not raw.startswith(b"WARC/1."):
        return {"error": "no WARC header"}
    fields = {}
    for line in raw[:cut].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return {"error": "bad header line"}
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]:
        return {"error": f"no {missing[0]}"}
    size, start = fields["content-length"], cut + 4
    if not size.isdecimal() or len(raw) != start + int(size) + 4 or raw[-4:] != b"\r\n\r\n":
        return {"error": "length mismatch"}
    block = raw[start:-4]
    uri = fields.get("warc-target-uri")
    out = {
        "record_type": fields["warc-type"], "record_id": fields["warc-record-id"].strip("<>"), "date": fields["warc-date"],
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "target_uri": uri,
    }
    head, gap, payload = block.partition(b"\r\n\r\n")
    if out["record_type"] not in ("response", "revisit") or not gap:
        return out | {"payload": block, "payload_bytes": len(block), "payload_digest": payload_digest(block)}
    told = [x.split(b":", 1)[1].strip() for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    length = int(told[0]) if told and told[0].isdigit() else None
    if out["record_type"] == "revisit":
        return out | ({"payload_bytes": length, "payload_digest": digest} if length is not None and digest else {"error": "revisit without length or digest"})
    if length is not None and length != len(payload):
        return out | {"error": "payload length mismatch"}
    if digest and digest != payload_digest(payload):
        return out | {"error": "payload digest mismatch"}
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": payload_digest(payload)}


class _Archive:
    def __init__(self, uri: str, samples: list[bytes]):
        self.uri, self.records, self.bytes = uri, 0, 0
        system, path = _at(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        try:
            trained = zstandard.train_dictionary(DICTIONARY, samples)
        except zstandard.ZstdError:  # too few or too small samples: frames without a dictionary
            trained = None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
        if trained:
            raw = trained.as_bytes()
            self._put(DICTIONARY_MAGIC + struct.pack("<I", len(raw)) + raw)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, raw: bytes) -> None:
        self._put(self.compressor.compress(raw))
        self.records += 1


def write_archives(
    pages: DataFrame, folder: str, id_col: str, payload: Column, uri: Column, date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0
) -> DataFrame:
    """Writes every row as a record below ``folder`` and returns (archive, records, bytes), one row per archive.

    The record id is ``urn:row:`` and the percent-encoded id (nothing after it for a null id). Null payloads are empty.
    A null URI is left out. An empty table writes nothing. The returned table is written: use it as often as needed.
    """
    marked = mark_revisits(pages.select(F.col(id_col).alias("id"), payload.alias("p"), uri.cast("string").alias("uri")), "id", F.col("p"), min_bytes)
    rows = marked.select(F.col("id").cast("string").alias("id"), F.col("_refers_to").cast("string").alias("refers_to"), "uri", F.col("_payload").alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        archives: list[_Archive] = []
        urn = lambda x: f"urn:row:{'' if x is None else quote(x, safe='')}"
        for batch in batches:
            for part in slices(batch, "payload"):
                held = part.to_pylist()
                for row in held:
                    if not archives or archives[-1].bytes >= ROLL:
                        if archives:
                            archives[-1].out.close()
                        samples, total = [], 0
                        for x in held:
                            if total >= SAMPLED:
                                break
                            samples.append(x["payload"][: SAMPLED // 8])
                            total += len(samples[-1])
                        archives.append(_Archive(f"{name}-{len(archives)}.warc.zst", samples))
                    kind = "response" if row["refers_to"] is None else "revisit"
                    archives[-1].add(record(kind, urn(row["id"]), urn(row["refers_to"]), row["uri"], date, row["payload"]))
        if archives:
            archives[-1].out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([a.uri for a in archives], pa.string()), pa.array([a.records for a in archives], pa.int64()),
             pa.array([a.bytes for a in archives], pa.int64())], names=["archive", "records", "bytes"])

    return staged(rows.mapInArrow(write, "archive string, records bigint, bytes bigint"), "archives")


def frames(stream, step: int = 32 << 10) -> Iterator[tuple[bytes | None, str | None]]:
    """(record bytes, None) per frame of one archive, or (None, fault); a fault ends the archive."""
    buffer, decompressor = stream.read(step), zstandard.ZstdDecompressor()

    def more() -> bool:
        nonlocal buffer
        data = stream.read(step)
        buffer += data
        return bool(data)

    first = True
    while buffer or more():
        while len(buffer) < 8 and more():
            pass
        if 0x50 <= buffer[0] <= 0x5F and buffer[1:4] == DICTIONARY_MAGIC[1:]:
            if len(buffer) < 8:
                yield None, "truncated frame"
                return
            size = 8 + struct.unpack("<I", buffer[4:8])[0]
            while len(buffer) < size and more():
                pass
            if len(buffer) < size:
                yield None, "truncated frame"
                return
            body, own = buffer[8:size], buffer[:4] == DICTIONARY_MAGIC
            buffer = buffer[size:]
            if own and first:
                try:
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(body) if body[:4] == FRAME_MAGIC else body
                    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                except zstandard.ZstdError:
                    yield None, "bad dictionary"
                    return
            first = False
            continue
        first = False
        if buffer[:4] != FRAME_MAGIC:
            yield None, "bad frame magic" if len(buffer) >= 4 else "truncated frame"
            return
        frame, parts = decompressor.decompressobj(), []
        try:
            while True:
                parts.append(frame.decompress(buffer))
                if frame.eof:
                    buffer = frame.unused_data
                    break
                buffer = stream.read(step)
                if not buffer:
                    yield None, "truncated frame"
                    return
        except zstandard.ZstdError:
            yield None, "corrupt frame"
            return
        yield b"".join(parts), None


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record (READ_SCHEMA) of the archives in column ``archive``. Invalid records and archives that break off
    give a row with ``error`` set; ``payload`` stays null for revisits and when ``with_payload`` is False."""
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = {"position": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                rows, held = [], 0
                system, path = _at(uri)
                with system.open_input_stream(path) as stream:
                    for position, (raw, fault) in enumerate(frames(stream)):
                        row = {"error": fault} if raw is None else parse(raw)
                        if not with_payload:
                            row.pop("payload", None)
                        rows.append(row | {"archive": uri, "position": position})
                        held += len(raw or b"") if with_payload else 512
                        if held > 8 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    count = archives.count()
    spread = archives.select("archive").repartition(max(1, min(count, 20_000)))
    return spread.mapInArrow(read, READ_SCHEMA)


def row_id(record_id: Column) -> Column:
    """The id that ``write_archives`` put into a record id, as text; null where it was null."""
    tail = F.regexp_extract(record_id, "^urn:row:(.*)$", 1)
    return F.when(F.length(tail) > 0, F.url_decode(tail))
