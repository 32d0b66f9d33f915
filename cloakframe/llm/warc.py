"""WARC archives as seekable Zstandard bundles.

A task writes its records to bundles: groups of records are compressed as independent frames, and a bundle ends with
a skippable frame that holds the seek table (compressed and decompressed size of each frame). The index maps a record
to its bundle, its frame and its offset inside that frame, so one record is read by seeking to one frame.

Of records with equal payloads of at least REVISIT_BYTES the one with the largest id is the response and the others
are revisits of it; smaller payloads are all responses. A revisit has no payload of its own but names the digest.

Bundles are written under names of their own by each attempt of a task, and the index, written by the same task, names
only those of the attempt that succeeded: a lost executor leaves at most an unnamed file. Defined results: a null
payload is empty, a null url an empty target; rows that repeat the largest id are all responses; where all ids of equal
payloads are null, all are responses.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, written

REVISIT_BYTES = 1000
#: Bytes of records in a frame before it is closed, and of a bundle before the next one begins.
FRAME_BYTES, BUNDLE_BYTES = 512 << 10, 64 << 20
#: Fixed values of the seekable format: a skippable frame's magic number and the one that ends a seek table.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record(kind: str, ident: str, url: str, payload: bytes, digest: str, length: int, refers_to: str | None) -> bytes:
    """One WARC record. length and digest are the full payload's; a revisit's own payload is left out."""
    body = payload if kind == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:cloakframe:{ident}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:cloakframe:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + http + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's own headers, its HTTP headers and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = lambda lines: dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    own = named(head.decode().split("\r\n")[1:])
    block = rest[: int(own["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return own, named(http.decode().split("\r\n")[1:]), payload


class BundleWriter:
    """Frames of records, then the seek table."""

    def __init__(self, out):
        self.out, self.sizes, self.pending, self.size, self.written = out, [], [], 0, 0
        self.press = zstandard.ZstdCompressor(level=3)

    def add(self, raw: bytes) -> tuple[int, int]:
        """Frame number and offset inside the frame of the record."""
        if self.size and self.size + len(raw) > FRAME_BYTES:
            self.flush()
        at = len(self.sizes), self.size
        self.pending.append(raw)
        self.size += len(raw)
        return at

    def flush(self) -> None:
        if self.pending:
            packed = self.press.compress(b"".join(self.pending))
            self.out.write(packed)
            self.sizes.append((len(packed), self.size))
            self.written += len(packed)
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *pair) for pair in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class BundleReader:
    """Any frame of a bundle, found through the seek table at its end."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        file.seek(end - 9)
        frames, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the bundle's end")
        file.seek(end - 9 - 8 * frames)
        sizes = [struct.unpack_from("<II", raw, 8 * n) for raw in [file.read(8 * frames)] for n in range(frames)]
        self.sizes, self.starts = sizes, [0]
        for packed, _ in sizes:
            self.starts.append(self.starts[-1] + packed)
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, n: int) -> bytes:
        self.file.seek(self.starts[n])
        packed, size = self.sizes[n]
        return self.unpack.decompress(self.file.read(packed), max_output_size=size)


def planned(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """pages with payload_digest, payload_bytes, record_type and refers_to."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    sized = pages.withColumns({"payload_digest": F.sha1(payload), "payload_bytes": F.octet_length(payload).cast("long")})
    latest = sized.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max(id_col).alias("__latest"), F.count("*").alias("__n")).where(F.col("__n") > 1).drop("__n")
    older = F.col("__latest").isNotNull() & ~F.coalesce(F.col(id_col) == F.col("__latest"), F.lit(False))
    return sized.join(latest, "payload_digest", "left").withColumns({"record_type": F.when(older, "revisit").otherwise("response"), "refers_to": F.when(older, F.col("__latest"))}).drop("__latest")


def write_archive(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages to bundles in folder; the index (page id, bundle, frame, offset, bytes), written beside them."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = fs.FileSystem.from_uri(folder)
        attempt, bundle, writer = uuid.uuid4().hex, 0, None
        for batch in batches:
            rows = []
            for page, url, html, digest, length, kind, refers in zip(*(batch[c] for c in ("id", "url", "html", "payload_digest", "payload_bytes", "record_type", "refers_to")), strict=True):
                if writer is None:
                    store.create_dir(path, recursive=True)
                    name = f"part-{attempt}-{bundle:05d}.warc.zst"
                    writer = BundleWriter(store.open_output_stream(f"{path}/{name}", compression=None))
                known = not pd.isna(page)
                raw = record(kind, str(int(page)) if known else "null", url or "", (html or "").encode("utf-8"), digest, int(length), None if pd.isna(refers) else str(int(refers)))
                frame, offset = writer.add(raw)
                rows.append((int(page) if known else None, name, frame, offset, len(raw)))
                if writer.written >= BUNDLE_BYTES:
                    writer.close()
                    writer, bundle = None, bundle + 1
            yield pd.DataFrame(rows, columns=["page_id", "bundle", "frame", "offset", "bytes"]).astype({"page_id": "Int64"})
        if writer is not None:
            writer.close()

    plan = planned(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html")), id_col="id", payload_col="html")
    index = plan.select("id", "url", "html", "payload_digest", "payload_bytes", "record_type", "refers_to").mapInPandas(write, "page_id long, bundle string, frame int, offset long, bytes long")
    return written(index, "warc-index")


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """The indexed records, each read from its frame: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for a revisit)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = fs.FileSystem.from_uri(folder)
        name, reader, at, frame = None, None, -1, b""
        for batch in batches:
            rows, size = [], 0
            for bundle, n, offset, length in zip(batch["bundle"], batch["frame"], batch["offset"], batch["bytes"], strict=True):
                if bundle != name:
                    name, reader, at = bundle, BundleReader(store.open_input_file(f"{path}/{bundle}")), -1
                if n != at:
                    at, frame = n, reader.frame(n)
                own, http, payload = parse(frame[offset : offset + length])
                ident = lambda v: None if v in (None, "<urn:cloakframe:null>") else int(v[len("<urn:cloakframe:") : -1])
                rows.append((ident(own["WARC-Record-ID"]), own["WARC-Target-URI"], own["WARC-Type"], ident(own.get("WARC-Refers-To")), own["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"]), payload if own["WARC-Type"] == "response" else None))
                size += len(payload)
                if size > 16 << 20:
                    yield _records(rows)
                    rows, size = [], 0
            if rows:
                yield _records(rows)

    return index.select("bundle", "frame", "offset", "bytes").mapInPandas(read, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def _records(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_folder(spark) -> str:
    return new_folder(spark, "warc")
