"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

A monolithic archive is one gzip stream over a whole file, which cannot be read from the middle. `normalise` inflates
such a stream once, in blocks, rewrites every record as a gzip member of its own and writes a sidecar index with the
offset and length of every member. Records are then read by offset, independently of each other.

Of records with equal payloads that with the largest page_id is a response; the others are revisits that name it.
Equal payloads are found by digest, with maxima combined before the shuffle.

Files go to the shared folder through a filesystem named by URI; a task writes under a name of its own attempt and its
manifest row names the file, so a repeated task never mixes with an earlier one.

Defined results: a null html is an empty payload, and empty payloads are equal to each other; rows that repeat the
largest page_id are all responses; a row with a null page_id revisits the largest page_id of its group, and is a
response if there is none; long payloads are streamed in blocks while normalising; an empty table gives an empty
result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import urllib.parse
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import join_facts, text_bytes, values
from millrace.session import materialize, new_shared_path, remove_shared

BLOCK = 1 << 20
DATE = "1970-01-01T00:00:00Z"
#: Bytes of uncompressed records after which a writer begins its next archive.
ARCHIVE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{url}')}>"


def build_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response or revisit record, uncompressed."""
    target = urllib.parse.quote(url or "", safe="".join(map(chr, range(33, 127))))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, target)}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)} | {"version": lines[0]}


def parse_record(raw: bytes) -> dict:
    """Fields, HTTP fields and body of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = parse_head(head)
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": parse_head(http), "body": body}


class _Inflated:
    """Reads from a gzip stream of one or more members, block by block."""

    def __init__(self, source):
        self.source, self.z, self.held, self.raw = source, zlib.decompressobj(31), bytearray(), b""

    def fill(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(BLOCK)
                if not self.raw:
                    if not self.z.eof:
                        raise EOFError("the gzip stream ends early")
                    return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(self.raw, BLOCK)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at a clean end."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.fill():
                if self.held.strip():
                    raise EOFError("a record ends early")
                return None
        return self.take(found + len(mark))

    def skip_breaks(self) -> None:
        """Pass over the line breaks behind a record."""
        while self.held or self.fill():
            left = self.held.lstrip(b"\r\n")
            del self.held[: len(self.held) - len(left)]
            if self.held:
                return

    def take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def body(self, n: int):
        while n:
            if not self.held and not self.fill():
                raise EOFError("a record ends early")
            part = self.take(min(n, len(self.held)))
            n -= len(part)
            yield part


def normalise(source, out, level: int = 6):
    """Rewrite a whole-file gzip stream record by record; yields the index entry of each member as it is written.

    ``out.write`` returns the number of bytes written.
    """
    stream, offset = _Inflated(source), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = parse_head(head)
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        length = out.write(z.compress(head))
        for part in stream.body(int(fields["content-length"])):
            length += out.write(z.compress(part))
        length += out.write(z.compress(b"\r\n\r\n") + z.flush())
        stream.skip_breaks()
        yield {"offset": offset, "length": length, "type": fields["warc-type"], "record": fields["warc-record-id"], "digest": fields.get("warc-payload-digest")}
        offset += length


class _Counting:
    """Writer that counts, over a stream whose own count is not relied on."""

    def __init__(self, f):
        self.f, self.n = f, 0

    def write(self, data: bytes) -> int:
        self.f.write(data)
        self.n += len(data)
        return len(data)


def roles(pages: DataFrame) -> DataFrame:
    """``pages`` as ``(page, url, html, refers_to)``; ``refers_to`` is null for responses."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), body.alias("html"), F.sha1(F.encode(body, "UTF-8")).alias("sha"))
    groups = materialize(base.groupBy("sha").agg(F.max("page").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1 AND best IS NOT NULL"))
    refers = F.when(F.col("page").isNull() | (F.col("page") != F.col("best")), F.col("best"))
    return join_facts(base, groups, ["sha"], "best", ["page", "url"]).select("page", "url", "html", refers.alias("refers_to"))


def write_archives(rows: DataFrame, uri: str, mono_level: int = 1, level: int = 4) -> DataFrame:
    """Write monolithic archives of all rows and normalise each; returns the manifest ``(archive, index, records)``."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        name, n, z, out, size = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, None, 0
        done: list[tuple[str, str, int]] = []

        def close():
            nonlocal n, z, out, size
            out.write(z.flush())
            out.close()
            count = 0
            with fs.open_input_stream(f"{name}-{n}.mono.gz", compression=None, buffer_size=BLOCK) as source, fs.open_output_stream(f"{name}-{n}.warc.gz", compression=None, buffer_size=BLOCK) as f, fs.open_output_stream(f"{name}-{n}.idx", compression=None, buffer_size=BLOCK) as idx:
                for entry in normalise(source, _Counting(f), level):
                    idx.write(json.dumps(entry | {"archive": f"{name}-{n}.warc.gz"}).encode() + b"\n")
                    count += 1
            fs.delete_file(f"{name}-{n}.mono.gz")
            done.append((f"{name}-{n}.warc.gz", f"{name}-{n}.idx", count))
            n, z, out, size = n + 1, None, None, 0

        for batch in batches:
            pages, urls, refer = (values(batch, c) for c in ("page", "url", "refers_to"))
            for i, html in text_bytes(batch, "html"):
                if out is None:
                    z, out = zlib.compressobj(mono_level, zlib.DEFLATED, 31), fs.open_output_stream(f"{name}-{n}.mono.gz", compression=None, buffer_size=BLOCK)
                record = build_record(pages[i], urls[i], html, refer[i])
                out.write(z.compress(record))
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        a, i, c = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(i, pa.string()), pa.array(c, pa.int64())], ["archive", "index", "records"])

    return materialize(rows.mapInArrow(run, "archive string, index string, records long"))


def read_archives(manifest: DataFrame, uri: str) -> DataFrame:
    """One row per record: the index of every archive is read, and each record by its own offset."""

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for archive, index in zip(values(batch, "archive"), values(batch, "index")):
                with fs.open_input_stream(index, compression=None) as f:
                    entries = [json.loads(x) for x in io.TextIOWrapper(f, "utf-8")]
                with fs.open_input_file(archive) as f:
                    for at in range(0, len(entries), 1000):
                        rows = []
                        for e in entries[at : at + 1000]:
                            f.seek(e["offset"])
                            r = parse_record(zlib.decompress(f.read(e["length"]), 31))
                            fields, kind = r["fields"], r["fields"]["warc-type"]
                            said = fields["warc-payload-digest"].removeprefix("sha1:")
                            size = int(r["http"]["content-length"])
                            if kind == "response" and (len(r["body"]) != size or payload_digest(r["body"]) != said):
                                raise ValueError(f"{archive} at {e['offset']}: the payload differs from its digest")
                            page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                            rows.append((None if page is None else int(page), size, said, kind, None if refers is None else int(refers)))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.select("archive", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to normalised archives in the shared folder and read them back.

    The archives are deleted once what was read is materialized; `write_archives` leaves its archives to the caller.
    """
    uri = new_shared_path(pages.sparkSession, "warc")
    found = materialize(read_archives(write_archives(roles(pages), uri), uri))
    remove_shared(pages.sparkSession, uri)
    return found
