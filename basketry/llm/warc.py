"""WARC archives: a writer with revisit records, and a reader that salvages what follows damage.

Archives are files of gzip members, one record each, in a folder that all executors reach by a pyarrow file system. A
task writes files of its own attempt and names them in its rows, so what a lost or repeated attempt left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import marked
from .shared import gone_at_exit, settle, shared_dir, small_batches

#: Compressed bytes after which a writer begins another file.
FILE_BYTES = 64 << 20
_CHUNK = 1 << 18
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: Bytes at the start of a damaged file in which the first mark of either kind is looked for.
_FIRST_MARK = 1 << 20

RECORD_SCHEMA = (
    "path string, offset long, length long, record_id string, record_type string, target_uri string, payload binary, "
    "payload_bytes long, payload_digest string, refers_to string, problem string"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: Any, url: str | None, payload: bytes, digest: str, refers_to: Any = None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record of an HTTP response, or a revisit that names the response with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, payload, revisit, refers_to) and returns (path, records).

    The result is computed once and read from the shared folder; only files that it names belong to the archive.
    """
    small_batches(pages.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _opened(folder)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, size, count, n = None, 0, 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, payload, revisit, refers_to in zip(batch["page_id"], batch["url"], batch["payload"], batch["revisit"], batch["refers_to"]):
                payload = bytes(payload or b"")  # null: empty
                if out is None:
                    path = f"{base}/{name}-{n}.warc.gz"
                    out, size, count, n = files.open_output_stream(path, compression=None), 0, 0, n + 1
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = member.compress(record(page_id, url, payload, sha1_base32(payload), refers_to, revisit)) + member.flush()
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count))
        yield pd.DataFrame(done, columns=["path", "records"])

    files, base = _opened(folder)
    files.create_dir(base, recursive=True)
    ids = pages.select(F.col("page_id").cast("string"), "url", "payload", "revisit", F.col("refers_to").cast("string"))
    return settle(ids.mapInPandas(write, "path string, records long"))


class _Window:
    """A file, seen from any offset that is not yet let go."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.data, self.base, self.ended = file, b"", 0, False

    def upto(self, stop: int) -> bytes:
        """Reads on until ``stop``, if the file is that long."""
        parts = [self.data]
        have = self.base + len(self.data)
        while have < stop and not self.ended:
            part = self.file.read(max(_CHUNK, stop - have))
            self.ended = not part
            parts.append(part)
            have += len(part)
        self.data = b"".join(parts)
        return self.data

    def at(self, start: int, size: int) -> bytes:
        self.upto(start + size)
        return self.data[start - self.base : start - self.base + size]

    def let_go(self, start: int) -> None:
        self.data, self.base = self.data[start - self.base :], start

    def find(self, what: bytes, start: int) -> int:
        while True:
            found = self.data.find(what, start - self.base)
            if found >= 0:
                return self.base + found
            start = max(start, self.base + len(self.data) - len(what) + 1)
            self.let_go(min(start, self.base + len(self.data)))
            before = len(self.data)
            if len(self.upto(self.base + before + _CHUNK)) == before:
                return -1

    def end(self) -> int:
        return self.base + len(self.data)


class _Bad(Exception):
    pass


def _parsed(data: bytes) -> tuple[dict, int]:
    """(record, its length) from bytes that begin with one; _Bad says what check failed."""
    if not data.startswith(_VERSION):
        raise _Bad("no version line")
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        raise _Bad("no end of headers")
    head: dict[str, str] = {}
    for line in data[:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise _Bad("a header without a colon")
        head[name.strip().lower()] = value.strip()
    if not re.fullmatch("[0-9]{1,15}", head.get("content-length", "")) or "warc-type" not in head:
        raise _Bad("no content length or type")
    size = int(head["content-length"])
    block = data[stop + 4 : stop + 4 + size]
    if len(block) < size or data[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
        raise _Bad("the block does not end where its length says")
    if (want := head.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != sha1_base32(block):
        raise _Bad("block digest differs")
    kind = head["warc-type"]
    payload = block
    if "application/http" in head.get("content-type", "") and (cut := block.find(b"\r\n\r\n")) >= 0:
        payload = block[cut + 4 :]
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    length: int | None = len(payload)
    if kind == "revisit":
        length = int(n) if (n := head.get("x-payload-length", "")).isdecimal() else None
    elif digest and digest != sha1_base32(payload):
        raise _Bad("payload digest differs")
    found = {
        "record_id": head.get("warc-record-id"), "record_type": kind, "target_uri": head.get("warc-target-uri"), "payload": None if kind == "revisit" else payload,
        "payload_bytes": length, "payload_digest": digest or sha1_base32(payload), "refers_to": head.get("warc-refers-to"), "problem": None,
    }
    return found, stop + 8 + size


class _Inflated:
    """The bytes of the gzip member at ``start`` as a file that ends with it, or where it is damaged: ``problem`` says why then."""

    def __init__(self, window: _Window, start: int) -> None:
        self.window, self.at, self.inflate, self.problem = window, start, zlib.decompressobj(31), ""

    def read(self, _: int) -> bytes:
        while not self.inflate.eof and not self.problem:
            data = self.window.at(self.at, _CHUNK)
            if not data:
                self.problem = "the file ends in a member"
                break
            try:
                out = self.inflate.decompress(data)
            except zlib.error as e:
                self.problem = f"gzip: {e}"
                break
            self.at += len(data) - len(self.inflate.unused_data)
            if out:
                return out
        return b""


def _member(window: _Window, start: int) -> Iterator[dict]:
    """The records in the gzip member at ``start``, the last of them with the member's length; _Bad at its end if it is damaged.

    A member with a single record is whole or bad; of one with several, those before damage count, and those after a record
    that fails its own checks. What is read of a member is let go as its records are given.
    """
    source = _Inflated(window, start)
    inner, at, gap, why, held, given = _Window(source), 0, -1, "", None, 0
    if not inner.at(0, len(_VERSION)).startswith(_VERSION):
        raise _Bad(source.problem or "no version line")
    while inner.at(at, 1):
        try:
            found, size = _plain(inner, at)
        except _Bad as e:
            if gap < 0:
                gap, why = at, str(e)
            inner.let_go(at)
            at = inner.find(_VERSION, at + 1)
            if at < 0:
                break
            continue
        if held is not None:
            yield {"offset": start, "length": 0, **held}
            given += 1
            window.let_go(source.at)
        if gap >= 0:
            yield {"offset": start, "length": 0, "problem": f"{why}: {at - gap} inflated bytes"}
            gap = -1
        held, at = found, at + size
        inner.let_go(at)
    if held is None or source.problem and not given:
        raise _Bad(source.problem or why)
    if source.problem:
        yield {"offset": start, "length": 0, **held}
        raise _Bad(source.problem)
    if gap >= 0:
        yield {"offset": start, "length": 0, "problem": f"{why}: {inner.end() - gap} inflated bytes"}
    yield {"offset": start, "length": source.at - start, **held}


def _record(window: _Window, start: int) -> Iterator[dict]:
    """The record at ``start`` of a file without compression."""
    found, size = _plain(window, start)
    yield {"offset": start, "length": size, **found}


def _plain(window: _Window, start: int) -> tuple[dict, int]:
    """The record at ``start`` of a file without compression, and its length.

    Headers may be of any length, but what is read of them must be lines with a colon, and where a block's digest is met at a
    version line before the end that the length says, the length is wrong: damage does not make it read on for long.
    """
    size, checked, looked = _CHUNK, 0, 0
    while True:
        data = window.at(start, size)
        stop = data.find(b"\r\n\r\n")
        if stop < 0 and len(data) == size:
            whole = data.rfind(b"\r\n")
            lines = data[checked:whole].split(b"\r\n") if whole > checked else []
            if any(b":" not in line for line in lines[not checked :]):
                raise _Bad("a header without a colon")
            size, checked = size * 2, max(checked, whole + 2 if whole > 0 else 0)
            continue
        length = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,15})", data[: stop + 2]) if stop >= 0 else None
        need = stop + 8 + int(length[1]) if length else 0
        if need <= len(data) or len(data) < size:
            return _parsed(data)
        if digest := re.search(rb"(?i)\r\nwarc-block-digest:[ \t]*sha1:([A-Z2-7]{32})", data[: stop + 2]):
            mark = b"\r\n\r\n" + _VERSION
            looked = max(looked, stop + 4)
            while (end := data.find(mark, looked)) >= 0:
                if sha1_base32(data[stop + 4 : end]).encode() == digest[1]:
                    raise _Bad("the block ends before its length says")
                looked = end + 1
            looked = max(looked, len(data) - len(mark))
            need = min(need, 2 * len(data))
        size = need


def salvage(file: BinaryIO) -> Iterator[dict]:
    """Records of a .warc or .warc.gz file in order, and a row with ``problem`` set for each gap of quarantined bytes.

    After a failed check, the reader goes on at the next member magic or version line from which a whole valid record
    can be read, and the bytes from the failure up to there are one gap. A member may hold several records: the last has its
    length, the others none, and gaps between them are told in inflated bytes. Memory is bounded by twice the largest record;
    a damaged length of a block without a digest, in a file without compression, is read up to the file's end.
    """
    window = _Window(file)
    at, gap, why = 0, -1, ""
    packed = window.at(0, 3) == _MAGIC
    if not packed and not window.at(0, 7).startswith(_VERSION):  # damaged from the start: whichever mark comes first
        window.upto(_FIRST_MARK)
        marks = [(p, m) for m in (_MAGIC, _VERSION) if (p := window.data.find(m)) >= 0]
        packed = min(marks)[1] == _MAGIC if marks else False
    mark, read = (_MAGIC, _member) if packed else (_VERSION, _record)
    while window.at(at, 1):
        try:
            for row in read(window, at):
                if gap >= 0:
                    yield _gap(gap, at, why)
                    gap = -1
                yield row
        except _Bad as e:
            if gap < 0:
                gap, why = at, str(e)
            at = max(at + 1, window.base)
            window.let_go(at - 1 if at > window.base else at)
            at = window.find(mark, at)
            if at < 0:
                break
            continue
        at += row["length"]
        window.let_go(at)
    if gap >= 0:
        yield _gap(gap, window.end(), why)


def _gap(start: int, stop: int, why: str) -> dict:
    return {"offset": start, "length": stop - start, "problem": why}


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """(path) -> RECORD_SCHEMA: a row for each record, and for each quarantined gap one whose ``problem`` says why.

    Without ``payloads`` their bytes are checked but not returned. A path read by no pyarrow file system raises. Paths are dealt
    evenly over as many tasks as there are; null paths are left out.
    """
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:  # of objects: gaps lack most columns
        return pd.DataFrame([[row.get(n) for n in names] for row in rows], columns=names, dtype=object)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                files, inner = _opened(path)
                rows, size = [], 0
                with files.open_input_stream(inner, compression=None) as file:
                    for row in salvage(file):
                        size += len(row.get("payload") or b"")
                        rows.append(row | {"path": path} | ({} if payloads else {"payload": None}))
                        if len(rows) >= 2000 or size >= 8 << 20:
                            yield frame(rows)
                            rows, size = [], 0
                if rows:
                    yield frame(rows)

    named = paths.select("path").where("path is not null")
    return named.repartition(max(1, named.count())).mapInPandas(read, RECORD_SCHEMA)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, revisit, refers_to): of equal payloads, the largest page_id is the response of the others.

    A null html is an empty payload. Rows that repeat the largest id are responses too; so is a payload's only row, and
    rows whose equals all lack an id. A row without an id revisits one with.
    """
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    first = settle(own.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"))
    # payloads that nothing repeats stay where they are
    asked = marked(own, first, "digest")
    clear = asked.where("not maybe").select("page_id", "url", "payload", F.lit(False).alias("revisit"), F.lit(None).cast(own.schema["page_id"].dataType).alias("refers_to"))
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    rest = asked.where("maybe").join(first.hint("merge"), "digest", "left")
    return clear.unionByName(rest.select("page_id", "url", "payload", other.alias("revisit"), F.when(other, F.col("first")).alias("refers_to")))


def page_of(record_id: Column | str) -> Column:
    """The page_id in a record id that ``record`` made; null for one of no page_id."""
    return F.regexp_extract(record_id, "<urn:x-page:(-?[0-9]+)>", 1).try_cast("long")


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives pages in ``folder`` (else a new one in the shared folder) and reads the archives back: read_archives' rows without payloads.

    Raises if any file gives back another number of records than were written to it. Null htmls are empty payloads; repeated rows
    are records of their own; an empty table gives no record.
    """
    if folder is None:
        folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
        gone_at_exit(spark, folder)
    written = write_archives(with_revisits(pages), folder)
    found = settle(read_archives(written, payloads=False))
    whole = found.where("problem is null").groupBy("path").agg(F.count("*").alias("found"))
    lost = written.join(whole, "path", "left").where("not (records <=> found)").take(1)
    if lost:
        raise RuntimeError(f"{lost[0]['path']}: {lost[0]['records']} records written, {lost[0]['found']} read")
    return found
