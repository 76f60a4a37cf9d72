"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a footer lists the frames' sizes (the seekable format: a skippable frame
after the data), so a reader finds any frame by two reads. An index maps each record's identifier to its bundle, frame
and offset inside the frame. Bundles are written into a folder that all executors share, each under a name of its own
attempt; only those that the index names count, so a task that runs twice leaves no wrong bundle behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import SMALL, lookup, qualified, shared_dir, stored

#: Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

#: Tasks that read bundles at once; each then has several.
MOST_READERS = 10_000

INDEX = "record_id string, bundle string, frame int, frame_offset long, offset long, length long"
RECORDS = "record_id string, record_type string, payload_digest string, refers_to string, payload_bytes long, intact boolean"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit that keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    lines.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class BundleWriter:
    """Writes records one after the other; close() ends the last frame and adds the seek table."""

    def __init__(self, stream, frame_bytes: int, level: int = 3):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.frames: list[tuple[int, int]] = []
        self.at, self.pending, self.size = 0, [], 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, where it begins in the bundle, offset in the frame) of the record."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self._end_frame()
        place = len(self.frames), self.at, self.size
        self.pending.append(data)
        self.size += len(data)
        return place

    def _end_frame(self) -> None:
        if self.pending:
            packed = self.compress(b"".join(self.pending))
            self.stream.write(packed)
            self.frames.append((len(packed), self.size))
            self.at, self.pending, self.size = self.at + len(packed), [], 0

    def close(self) -> None:
        self._end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.stream.close()


def seek_table(stream) -> list[tuple[int, int, int]]:
    """(offset, packed size, size) of each frame, from the footer alone."""
    size = stream.size()
    stream.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    stream.seek(size - 9 - 8 * n)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", stream.read(8 * n)):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(stream, at: int, packed: int, plain: int) -> bytes:
    stream.seek(at)
    return zstandard.ZstdDecompressor().decompress(stream.read(packed), max_output_size=max(1, plain))


def roles(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int = 0) -> DataFrame:
    """(id, url, payload, digest, refers): refers is set for revisits, to the largest id of that payload.

    Ids and digests alone are grouped. Payloads stay where they are while the digests that occur twice are few; else
    they are joined by id and digest, so no frequent page gathers its copies in one task.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    named = rows.where(F.octet_length("payload") >= least_bytes).select("id", "digest")
    twice = stored(named.groupBy("digest").agg(F.max("id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n"))
    if twice.count() <= SMALL:
        found = rows.join(F.broadcast(twice), "digest", "left")
    else:
        marks = lookup(stored(named.distinct()), twice, "digest").withColumnsRenamed({"id": "__id", "digest": "__digest"})
        found = rows.join(marks, rows["id"].eqNullSafe(marks["__id"]) & (rows["digest"] == marks["__digest"]), "left")
    other = F.col("largest").isNotNull() & ~F.col("largest").eqNullSafe(F.col("id"))
    return found.select("id", "url", "payload", "digest", F.when(other, F.col("largest")).alias("refers"))


def write_bundles(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 27,
) -> DataFrame:
    """Writes all pages as records below folder and returns the index: record_id, bundle, frame, frame_offset, offset, length.

    Of records with equal payloads of at least least_bytes, that with the largest id is the response and the others
    revisit it; a null payload is empty. Rows that share the largest id, or have a null id and no other to refer to,
    are responses. A record larger than frame_bytes has a frame of its own. A row's record identifier is
    urn:x-page:<id>; repeated rows have equal ones, each with an index row. Other columns aren't read.
    """

    folder = qualified(pages.sparkSession, folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        n, written, writer, name = 0, 0, None, ""
        for batch in batches:
            found = []
            for page, url, payload, refers in zip(batch["id"], batch["url"], batch["payload"], batch["refers"]):
                if writer is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{n:04d}.warc.zst"
                    writer, n, written = BundleWriter(fs.open_output_stream(f"{base}/{name}", compression=None), frame_bytes), n + 1, 0
                urn = f"urn:x-page:{'null' if pd.isna(page) else int(page)}"
                data = record(urn, url, bytes(payload), None if pd.isna(refers) else f"urn:x-page:{int(refers)}")
                frame, begins, offset = writer.add(data)
                found.append((urn, name, frame, begins, offset, len(data)))
                written += len(data)
                if written >= bundle_bytes:
                    writer.close()
                    writer = None
            yield pd.DataFrame(found, columns=["record_id", "bundle", "frame", "frame_offset", "offset", "length"])
        if writer is not None:
            writer.close()

    whole = lambda c: F.col(c).cast("decimal(20,0)").cast("string").alias(c)  # noqa: E731  longs with nulls pass pandas as text
    rows = roles(pages, id_col, url_col, html_col, least_bytes).select(whole("id"), "url", "payload", whole("refers"))
    return stored(rows.mapInPandas(write, INDEX))


def _open(folder: str, name: str):
    fs, base = pafs.FileSystem.from_uri(folder)
    return fs.open_input_file(f"{base}/{name}")


def _described(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    intact = revisit or (len(payload) == stated and sha1_base32(payload) == digest)
    return fields["warc-record-id"].strip("<>"), fields["warc-type"], digest, fields["warc-refers-to"].strip("<>") if revisit else None, stated, intact


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Every record of every bundle of the index, frame by frame: RECORDS. intact: length and digest hold for the payload."""
    folder = qualified(index.sparkSession, folder)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["bundle"]:
                with _open(folder, name) as stream:
                    for at, packed, plain in seek_table(stream):
                        yield pd.DataFrame([_described(*x) for x in parse_records(read_frame(stream, at, packed, plain))], columns=[x.split()[0] for x in RECORDS.split(", ")])

    bundles = stored(index.select("bundle").distinct())
    # by range, so that each of the readers has a bundle
    return bundles.repartitionByRange(max(1, min(MOST_READERS, bundles.count())), "bundle").mapInPandas(read, RECORDS)


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """(record_id, data binary) of the index rows given, each by seeking to its frame alone."""
    folder = qualified(index.sparkSession, folder)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rows in batch.groupby("bundle"):
                with _open(folder, name) as stream:
                    table = seek_table(stream)
                    for frame, some in rows.groupby("frame"):
                        data = read_frame(stream, *table[frame])
                        yield pd.DataFrame({"record_id": some["record_id"], "data": [data[o : o + n] for o, n in zip(some["offset"], some["length"])]})

    return index.mapInPandas(read, "record_id string, data binary")


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
