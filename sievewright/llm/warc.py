"""WARC archives as tables of chunks: written, and read back in chunk rows with running digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import maybe_in
from .util import cut, map_batches

#: Bytes of an archive's chunk row, and of a payload's chunk row.
CHUNK = 1 << 20
#: Payloads below this are stored each time.
REVISIT_FROM = 100
#: Bytes of an archive after which a task begins another one: what one task reads is that and a record at most.
ARCHIVE = 1 << 26
#: Bytes of the name of a header's field before the archive counts as broken. Values may be of any length, as a
#: page's address may.
MAX_NAME = 1 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Broken(ValueError):
    """The archive contradicts the format."""


def headers(page_id: int | None, url: str | None, kind: str, digest: str, size: int, first: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or 'urn:x-page:none', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{first}>"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


def write(pages: DataFrame, chunk: int = CHUNK, revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE) -> DataFrame:
    """archive string, seq long, data binary: the data of an archive, by seq, are a WARC 1.1 file. A task writes
    archives of at least `archive_bytes` each but for its last, and holds one chunk and one row.

    Of records with equal payloads of at least `revisit_from` bytes that with the smallest page_id is a response,
    others are revisits without a payload; their HTTP header keeps the length. The smallest ids are minima by
    digest, combined before the shuffle, and only digests that occur twice go back to the pages. Pages that a bit set
    of those digests shows to be the only ones with theirs are written where they are read; the others are joined."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    firsts = base.select("page_id", "digest", "size").where(F.col("size") >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts, _ = cut(firsts, "digests")
    shared, _ = maybe_in(F.xxhash64("digest"), firsts.select(F.xxhash64("digest").alias("x")))
    alone = base.where(~shared).withColumn("first", F.lit(None).cast("long"))
    known = alone.select("page_id", "url", "payload", "digest", "first").union(base.where(shared).join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", "first"))

    def run(batches: Iterator[pa.RecordBatch]):
        task, number, seq, held = f"{TaskContext.get().partitionId():08d}", 0, 0, bytearray()

        def whole(least: int):
            nonlocal seq
            while len(held) >= least and held:
                yield {"archive": [f"{task}-{number:06d}"], "seq": [seq], "data": [bytes(held[:chunk])]}
                seq += 1
                del held[:chunk]

        for b in batches:
            for row in range(b.num_rows):
                page_id, url, data, digest, first = (b.column(k)[row].as_py() for k in range(5))
                kind = "revisit" if first is not None and first != page_id else "response"
                held += headers(page_id, url, kind, digest, len(data), first)
                body = memoryview(data) if kind == "response" else memoryview(b"")
                for at in range(0, len(body), chunk):
                    held += body[at : at + chunk]
                    yield from whole(chunk)
                held += b"\r\n\r\n"
                yield from whole(chunk)
                if seq * chunk + len(held) >= archive_bytes:
                    yield from whole(1)
                    number, seq = number + 1, 0
        yield from whole(1)

    return map_batches(known, run, "archive string, seq long, data binary")


class Parser:
    """Takes an archive in pieces of any size, gives chunk rows; holds one chunk at most besides one header."""

    def __init__(self, archive: str, chunk: int, with_data: bool) -> None:
        self.archive, self.chunk, self.with_data = archive, chunk, with_data
        self.held, self.record = bytearray(), None
        self.searched = self.checked = 0  # of a header that isn't there whole

    def head(self) -> bytes | None:
        """The header, once it is there whole. What can be no header is found out before it piles up."""
        end = self.held.find(b"\r\n\r\n", max(0, self.searched - 3))
        if end < 0:
            self.searched = len(self.held)
            while (line := self.held.find(b"\r\n", self.checked)) >= 0:
                self.name(self.held[self.checked : line])
                self.checked = line + 2
            if b":" not in self.held[self.checked : self.checked + MAX_NAME] and len(self.held) - self.checked >= MAX_NAME:
                raise Broken(f"archive {self.archive}: headers without an end")
            return None
        out = bytes(self.held[:end])
        del self.held[: end + 4]
        self.searched = self.checked = 0
        return out

    def name(self, line: bytes) -> None:
        if not line.startswith((b"WARC/", b"HTTP/")) and b":" not in line[:MAX_NAME]:
            raise Broken(f"archive {self.archive}: a header's line without a name")

    @staticmethod
    def fields(head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    def feed(self, data: bytes) -> Iterator[dict]:
        self.held += data
        while True:
            r = self.record
            if r is None:
                while self.held[:2] == b"\r\n":
                    del self.held[:2]
                head = self.head()
                if head is None:
                    return
                if not head.startswith(b"WARC/"):
                    raise Broken(f"archive {self.archive}: no record where one should start")
                f = self.fields(head)
                self.record = {"f": f, "left": int(f["content-length"]), "http": None, "sha": hashlib.sha256(), "n": 0, "chunk_no": 0}
            elif r["http"] is None:
                before = len(self.held)
                head = self.head()
                if head is None:
                    return
                r["http"] = self.fields(head)
                r["left"] -= before - len(self.held)
            else:
                take = min(r["left"], self.chunk)
                if len(self.held) < take:
                    return
                part = bytes(self.held[:take])
                del self.held[:take]
                r["left"] -= take
                r["n"] += take
                r["sha"].update(part)
                yield self.row(r, part)
                r["chunk_no"] += 1
                if not r["left"]:
                    self.record = None

    def row(self, r: dict, part: bytes) -> dict:
        f, last = r["f"], not r["left"]
        digest, n, kind = r["sha"].hexdigest(), r["n"], f["warc-type"]
        stated = f.get("warc-payload-digest", "").removeprefix("sha256:")
        if last and kind == "revisit":
            digest, n = stated, int(r["http"]["content-length"])
        elif last and stated and digest != stated:
            raise Broken(f"record {f.get('warc-record-id')}: the payload differs from its digest")
        number = lambda x: int(x) if x else None
        bare = lambda x: (x or "").removeprefix("<urn:x-page:").removesuffix(">")
        return {
            "archive": self.archive, "record_id": f.get("warc-record-id"), "page_id": number(bare(f.get("warc-record-id"))), "record_type": kind, "target_uri": f.get("warc-target-uri"), "refers_to": number(bare(f.get("warc-refers-to"))),
            "chunk_no": r["chunk_no"], "is_last": last, "bytes_so_far": n, "digest_so_far": digest, "data": part if self.with_data else None,
        }

    def end(self) -> None:
        if self.record is not None or self.held.strip(b"\r\n"):
            raise Broken(f"archive {self.archive} is cut off")


CHUNKS = "archive string, record_id string, page_id long, record_type string, target_uri string, refers_to long, chunk_no long, is_last boolean, bytes_so_far long, digest_so_far string, data binary"


def read(archives: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """A row per record and chunk of its payload, with the SHA-256 and the bytes up to it; one row (of no data) for
    empty payloads and revisits, whose digest and length are those stated. Archives stream through their tasks in
    the order of seq; a payload is never held whole."""

    def run(batches: Iterator[pa.RecordBatch]):
        parser: Parser | None = None
        rows: list[dict] = []
        size = 0

        def out():
            return {k: [r[k] for r in rows] for k in rows[0]}

        for b in batches:
            for row in range(b.num_rows):
                archive = b.column(0)[row].as_py()
                if parser is None or parser.archive != archive:
                    if parser:
                        parser.end()
                    parser = Parser(archive, chunk, with_data)
                for r in parser.feed(b.column(2)[row].as_py()):
                    rows.append(r)
                    size += 200 + len(r["data"] or b"")
                    if size > 8 << 20:
                        yield out()
                        rows, size = [], 0
        if parser:
            parser.end()
        if rows:
            yield out()

    return map_batches(archives.select("archive", "seq", "data").repartition("archive").sortWithinPartitions("archive", "seq"), run, CHUNKS)


def export(archives: DataFrame, uri: str) -> DataFrame:
    """Write each archive to uri/<archive>.warc in a store that pyarrow.fs reads; one row per file. A file appears
    under its name only when whole, so a task that runs again replaces it."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        name, out, n = None, None, 0

        def close():
            out.close()
            store.move(f"{root}/{name}.part{TaskContext.get().taskAttemptId()}", f"{root}/{name}.warc")
            return {"path": [f"{root}/{name}.warc"], "bytes": [n]}

        for b in batches:
            for archive, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if archive != name:
                    if out:
                        yield close()
                    name, n = archive, 0
                    out = store.open_output_stream(f"{root}/{name}.part{TaskContext.get().taskAttemptId()}")
                out.write(data)
                n += len(data)
        if out:
            yield close()

    return map_batches(archives.select("archive", "seq", "data").repartition("archive").sortWithinPartitions("archive", "seq"), run, "path string, bytes long")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the written archives.

    A null html is an empty payload, always a response. Of repeated rows with the smallest page_id all are
    responses; rows with a null page_id revisit like others but are referred to only if no copy has an id, which
    makes them responses. No rows give no rows; other columns are ignored, whatever their names."""
    archives, _ = cut(write(pages), "warc")
    return read(archives, with_data=False).where("is_last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"
    )
