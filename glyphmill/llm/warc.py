"""WARC archives under Zstandard with a dictionary: writer, reader and the round trip of pages.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, raw or itself compressed; each record is one frame. The reader loads that dictionary,
decodes one frame at a time from a stream, and checks version, header lines, content length, record end and payload digest, so its memory is one record.

Archives are written by tasks straight into the shared folder, under names that no other attempt uses, and the committed manifest says which count: a lost
executor or a second attempt leaves files that nothing reads. Identical payloads are found on digests alone; pages move only if the list of revisits is too large to broadcast.

Defined results: null html is an empty payload, a null url is written as "urn:none"; control characters in urls are escaped; a page id with
several payloads gives a record for each, and repeated rows give repeated records; an empty table gives no archive and no rows; extra columns aren't read. A broken archive raises ValueError with its place.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .shared import discard, work_dir, written

#: Frame magics, version and profile of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Payloads from so many bytes on may be revisits.
LEAST_REVISIT = 1000
#: An archive is closed beyond so many compressed bytes; a dictionary has so many bytes and is trained on so many of payload at most.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAIN_BYTES = 64 << 20, 32 << 10, 2 << 20
#: A record is known by its page and payload, so that a page id with several payloads has several records.
_RECORD_ID = "<urn:page:{}:{}>"


def file_system(uri: str):
    """(file system, path) for a folder or file of the shared store."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    sha1 = hashlib.sha1(payload)
    digest = "sha1:" + base64.b32encode(sha1.digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if refers_to is not None else payload)
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "urn:none")
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_RECORD_ID.format(page_id, sha1.hexdigest())}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: {digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_RECORD_ID.format(refers_to, sha1.hexdigest())}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for the records of an archive; where samples are too few to train one, some of their bytes serve as raw content."""
    import zstandard

    try:
        if len(samples) >= 16 and sum(map(len, samples)) > 8 * size:
            return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        pass
    raw = b"".join(s[:512] for s in samples)[-size:]
    return raw if len(raw) >= 8 else VERSION + b"\r\nWARC-Type: response\r\n"


class ArchiveWriter:
    def __init__(self, out, dictionary: bytes, level: int = 3):
        import zstandard

        self.out, self.size = out, 0
        packed = zstandard.ZstdCompressor(level=level).compress(dictionary)
        self.frames = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, rec: bytes) -> None:
        self._put(self.frames.compress(rec))


def parse(rec: bytes, where: str = "") -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, checked."""
    head, gap, rest = rec.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError(f"{where}: no {VERSION.decode()} header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"{where}: bad header line {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"{where}: no {name}")
    n = headers["content-length"]
    if not n.isascii() or not n.isdigit() or len(rest) != int(n) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"{where}: content length {n} doesn't fit the record")
    return headers, rest[:-4]


def read_archive(stream, where: str = "", chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive from a binary stream."""
    import zstandard

    head = stream.read(8)
    if not head:
        return
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICTIONARY_MAGIC:
        raise ValueError(f"{where}: no leading dictionary frame")
    dictionary = b""
    while len(dictionary) < size:
        part = stream.read(size - len(dictionary))
        if not part:
            raise ValueError(f"{where}: dictionary frame cut short")
        dictionary += part
    if dictionary[:4] == FRAME_MAGIC:
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    rest, k = b"", 0
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        one, parts = frames.decompressobj(), []
        try:
            while not one.eof:
                if not rest:
                    rest = stream.read(chunk)
                    if not rest:
                        raise ValueError(f"{where}: frame {k} cut short")
                parts.append(one.decompress(rest))
                rest = one.unused_data if one.eof else b""
        except zstandard.ZstdError as e:
            raise ValueError(f"{where}: frame {k}: {e}") from e
        yield parse(b"".join(parts), f"{where}, frame {k}")
        k += 1


def payload_of(headers: dict[str, str], block: bytes, where: str = "") -> tuple[int, str, bytes | None]:
    """(bytes of the full payload, its digest in hex, the payload or None for a revisit), with the digest checked where the payload is there."""
    head, gap, body = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
    kind, _, coded = headers.get("warc-payload-digest", "").partition(":")
    if not gap or kind != "sha1" or b"content-length" not in fields:
        raise ValueError(f"{where}: no HTTP header or no SHA-1 digest")
    size, digest = int(fields[b"content-length"]), base64.b32decode(coded).hex()
    if headers["warc-type"] == "revisit":
        if "warc-refers-to" not in headers or body:
            raise ValueError(f"{where}: a revisit needs its target and no payload")
        return size, digest, None
    if len(body) != size or hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"{where}: payload doesn't fit its length or digest")
    return size, digest, body


def _page_of(record_id: str) -> int:
    return int(record_id.removeprefix("<urn:page:").partition(":")[0])


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages: (page_id, url, html, refers_to). Writes archives below folder; returns the committed manifest (archive, records, bytes)."""
    import pyarrow as pa

    ship(pages.sparkSession)

    def run(batches):
        import uuid

        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        held, size = [], 0
        writer = out = None
        done = []

        def close():
            nonlocal writer
            if writer is not None:
                out.close()
                done.append((name, count, writer.size))
                writer = None

        def opened(samples):
            name = f"{uuid.uuid4().hex}.warc.zst"
            stream = fs.open_output_stream(f"{base}/{name}", compression=None)
            return name, stream, ArchiveWriter(stream, train(samples))

        name, count = "", 0
        pending = True
        for row in rows:
            rec = record(row[0], row[1], (row[2] or "").encode("utf-8", "surrogatepass"), row[3])
            if pending:  # a bounded beginning is held to train the dictionary
                held.append(rec)
                size += len(rec)
                if size < TRAIN_BYTES:
                    continue
            if writer is None:
                name, out, writer = opened(held or [rec])
                count = 0
            for r in held if pending else [rec]:
                writer.add(r)
                count += 1
            held, pending = [], False
            if writer.size > archive_bytes:
                close()
                pending, size = True, 0
        if held:
            name, out, writer = opened(held)
            count = len(held)
            for r in held:
                writer.add(r)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["archive", "records", "bytes"])

    return written(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, records long, bytes long"))


def read_archives(manifest: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """(page_id, target_uri, record_type, payload_bytes, payload_digest, refers_to[, payload]) of every record in the manifest's archives."""
    import pyarrow as pa

    names = ["page_id", "target_uri", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if keep_payload else [])]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *([pa.binary()] if keep_payload else [])]

    ship(manifest.sparkSession)

    def run(batches):
        fs, base = file_system(folder)
        for batch in batches:
            for archive, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, seen = [], 0
                with fs.open_input_stream(f"{base}/{archive}", compression=None) as stream:
                    for headers, block in read_archive(io.BufferedReader(stream) if isinstance(stream, io.RawIOBase) else stream, archive):
                        size, digest, body = payload_of(headers, block, archive)
                        to = headers.get("warc-refers-to")
                        row = (_page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], size, digest, _page_of(to) if to else None)
                        rows.append(row + ((body,) if keep_payload else ()))
                        seen += 1
                        if len(rows) == (64 if keep_payload else 4096):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                if seen != expected:
                    raise ValueError(f"{archive}: {seen} records, not {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    shape = "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if keep_payload else "")
    archives = manifest.count()
    return manifest.select("archive", "records").repartition(max(1, archives)).mapInArrow(run, shape)


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, mark, refers_to) of pages whose payload, known by its mark, a page with a larger id has as well."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marks = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(body, 256).alias("mark"), F.octet_length(body).alias("n")).where(F.col("n") >= LEAST_REVISIT)
    shared = marks.groupBy("mark").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = shared.select(F.concat("mark", F.lit("")).alias("mark"), "refers_to")
    return marks.join(shared, "mark").where("page_id <> refers_to").select("page_id", "mark", "refers_to").distinct()


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives and reads those back: one row per record, revisits with length and digest of the record that they refer to."""
    spark = pages.sparkSession
    folder = work_dir(spark)
    later = written(revisits(pages))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256).alias("mark"))
    manifest = write_archives(plain.join(later, ["page_id", "mark"], "left"), folder)
    found = written(read_archives(manifest, folder))
    targets = found.where("record_type = 'response'").select(F.col("page_id").alias("to"), F.col("payload_bytes").alias("to_bytes"), F.col("payload_digest").alias("to_digest")).distinct()
    revisit = found.where("record_type = 'revisit'").join(targets, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("to_digest")), "left")
    checked = revisit.select(
        "page_id", F.when(F.col("payload_bytes") == F.col("to_bytes"), F.col("to_bytes")).otherwise(F.raise_error(F.lit("a revisit has no target with its payload")).cast("long")).alias("payload_bytes"),
        F.col("to_digest").alias("payload_digest"), "record_type", "refers_to",
    )
    discard(later)
    return found.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(checked)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return round_trip(table(spark, sf_dir, "pages"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
