"""WARC archives of pages: a writer with revisits, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Generator, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import new_path, saved

WINDOW = 8 << 20  # bytes of an archive that are read at a time
CUT = "cut"
_SHORT = 64  # bytes within which a magic, a version line or a record's last newlines may be cut
ARCHIVE_BYTES = 16 << 20  # an archive is closed when it has grown beyond this
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_VERSION = re.compile(rb"(?<=\n)WARC/1\.[01]\r?\n")
_BLANK, _TAIL = re.compile(rb"\r?\n\r?\n"), re.compile(rb"(?:\r?\n){0,2}")
_MEMBER = b"\x1f\x8b\x08"

#: start and end are bytes of the archive. inner_start and inner_end are bytes of the unpacked member there; null for a gap that is not in one.
FOUND = "uri string, start bigint, end bigint, inner_start bigint, inner_end bigint, kind string, page_id string, url string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def _sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: str | None) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None = None, revisit: bool = False, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One record: a response with its payload, or a revisit that only has the digest and length of its own."""
    block = (_HTTP % len(payload)).encode() + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f]", "", url or "")), ("WARC-Payload-Digest", f"sha1:{_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{_sha1(block)}"), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Marks:
    """The next blank line and the next version line from a place on. Searches go forward, so each byte is searched once."""

    def __init__(self, data: bytes) -> None:
        self.data, self.held = data, {}

    def next(self, pattern: re.Pattern, at: int) -> re.Match | None:
        since, found = self.held.get(pattern, (len(self.data) + 1, None))
        if at < since or (found and found.start() < at):
            since, found = at, pattern.search(self.data, at)
            self.held[pattern] = since, found
        return found


def _parsed(data: bytes, at: int, marks: _Marks, proven: bool = False) -> tuple[dict, int] | str | None:
    """The record that starts at a version line, and where it ends; None if it fails a check, CUT if the data ends first.
    proven: a digest must confirm it.

    A header may be of any length; it ends at a blank line, before which no other version line stands.
    """
    line = _LINE.match(data, at)
    cut, other = (marks.next(_BLANK, at), marks.next(_VERSION, at + 1)) if line else (None, None)
    if not cut or (other and other.start() < cut.start()):
        return CUT if line and not other else None
    fields = {}
    for row in data[line.end() : cut.start()].splitlines():
        key, _, value = row.decode("utf-8", "replace").partition(":")
        fields[key.strip().lower()] = value.strip()
    size, kind = fields.get("content-length", ""), fields.get("warc-type", "")
    if not kind or "warc-record-id" not in fields or not re.fullmatch("[0-9]{1,18}", size):
        return None
    if cut.end() + int(size) > len(data):
        return CUT
    end = cut.end() + int(size)
    block = data[cut.end() : end]
    said, digest = fields.get("warc-block-digest"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if said and said != f"sha1:{_sha1(block)}":
        return None
    head = _BLANK.search(block) if fields.get("content-type", "").startswith("application/http") else None
    payload = block[head.end() :] if head else block
    length = len(payload)
    if kind == "revisit":
        length, payload = int(fields["x-payload-length"]) if re.fullmatch("[0-9]{1,18}", fields.get("x-payload-length", "")) else None, None
    elif digest and digest != _sha1(payload):
        return None
    if proven and not said and not (digest and payload is not None):
        return None
    page = lambda k: unquote(m[1]) if (m := re.fullmatch(r"<urn:page:([^<>]*)>", fields.get(k, ""))) else None
    found = {"kind": kind, "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "refers_to": page("warc-refers-to"), "payload_digest": digest or None, "payload_bytes": length, "payload": payload}
    return found, _TAIL.match(data, end).end()


def _unpacked(data: memoryview, at: int) -> tuple[bytes, int | None, bool]:
    """What the gzip member at a place unpacks to, and where it ends: None if it is damaged or cut off, then what comes before; and is it cut off?"""
    for most in (1 << 20, 64):  # small slices lose the least before an error
        unpack, parts, k, step = zlib.decompressobj(31), [], at, min(4096, most)
        try:
            while k < len(data) and not unpack.eof:
                parts.append(unpack.decompress(data[k : k + step]))
                k, step = min(k + step, len(data)), min(2 * step, most)
            return b"".join(parts), k - len(unpack.unused_data) if unpack.eof else None, not unpack.eof
        except zlib.error:
            pass
    return b"".join(parts), None, False


def _within(plain: bytes, whole: bool) -> Iterator[dict]:
    """Records of an unpacked member, and gaps between them: after a failed check the next version line is tried."""
    at, lost, marks = 0, None, _Marks(plain)
    while at < len(plain):
        if (one := _parsed(plain, at, marks, not whole)) and one is not CUT:
            if lost is not None:
                yield {"kind": "gap", "inner_start": lost, "inner_end": at}
                lost = None
            yield one[0] | {"inner_start": at, "inner_end": one[1]}
            at = one[1]
            continue
        lost = at if lost is None else lost
        line = marks.next(_VERSION, at + 1)
        at = line.start() if line else len(plain)
    if lost is not None:
        yield {"kind": "gap", "inner_start": lost, "inner_end": len(plain)}


def salvage(data: bytes, final: bool = True, at: int = 0, lost: int | None = None) -> Generator[dict, None, tuple[int, int | None]]:
    """Records of an archive (gzip members or plain), each with start and end; a gap (kind "gap") for bytes that no valid one covers.

    After a failed check the search goes on at the next version line of the unpacked member, then at the next gzip
    magic, or at the next version line of a plain archive. A member that is damaged or cut off gives up the records
    before the damage that their own digests confirm; its gap lists where in the member they end. Each byte is searched
    once and unpacked a bounded number of times. Empty data: nothing.
    Unless final, data is the beginning of more: then what its end may cut stays undecided. Returned are the place of
    the first undecided byte and where the gap before it began, with which a later call, given more data, goes on.
    """
    view, marks = memoryview(data), _Marks(data)
    nexts = {"member": -1, "line": -1}

    def resume(at: int) -> int:
        if nexts["member"] < at:
            nexts["member"] = k if (k := data.find(_MEMBER, at)) >= 0 else len(data)
        if nexts["line"] < at:
            nexts["line"] = m.start() if (m := marks.next(_VERSION, at)) else len(data)
        return min(nexts.values())

    if lost is not None:
        begun, at = at, resume(at)
        if not final and at == len(data):  # a magic or a version line may begin in the last bytes
            return max(begun, len(data) - _SHORT), lost
    while at < len(data):
        if not final and len(data) - at < _SHORT:
            return at, lost
        rows, end = [], None
        if data.startswith(_MEMBER, at):
            plain, end, cut = _unpacked(view, at)
            if not final and cut:
                return at, lost
            rows = list(_within(plain, end is not None))
        elif one := _parsed(data, at, marks):
            if not final and (one is CUT or one[1] > len(data) - _SHORT):
                return at, lost
            if one is not CUT:
                rows, end = [one[0]], one[1]
        good = any(x["kind"] != "gap" for x in rows)
        after = resume(at + 1 if end is None else end) if end is None or not good else end
        if not final and after == len(data) and end is None and good:
            return at, lost
        if good and lost is not None:
            yield {"kind": "gap", "start": lost, "end": at}
            lost = None
        if end is not None and good:
            for row in rows:
                yield row | {"start": at, "end": end}
            at = end
            continue
        if good:  # the head of a damaged member
            yield from (row | {"start": at, "end": after} for row in rows if row["kind"] != "gap")
            yield {"kind": "gap", "start": at, "end": after, "inner_start": max(row["inner_end"] for row in rows if row["kind"] != "gap")}
        elif lost is None:
            lost = at
        if not final and after == len(data):
            return max(at + 1, len(data) - _SHORT), lost
        at = after
    if final and lost is not None:
        yield {"kind": "gap", "start": lost, "end": len(data)}
    return at, lost


def salvage_stream(read: Callable[[int], bytes], window: int = WINDOW) -> Iterator[dict]:
    """salvage of an archive of any size, of which a window is held, or as much as its largest member or record takes.

    read(n) gives the next n bytes, or what is left.
    """
    base, data, at, lost, want, final = 0, b"", 0, None, window, False
    while not final:
        more = read(want)
        final = len(more) < want
        data += more
        found, before = salvage(data, final, at, lost), at
        while True:
            try:
                row = next(found)
            except StopIteration as e:
                at, lost = e.value
                break
            yield row | {"start": row["start"] + base, "end": row["end"] + base}
        keep = max(0, at - 1)  # a version line is told by the byte before it
        want = window if at > before else 2 * want
        data, base, at, lost = data[keep:], base + keep, at - keep, None if lost is None else lost - keep


def _writer(folder: str, limit: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, done, n = None, [], 0
        for batch in batches:
            for page, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(base, recursive=True)
                    path = f"{name}-{len(done):05d}.warc.gz"
                    out, n = store.open_output_stream(f"{base}/{path}", compression=None), 0
                out.write(member(record(page, url, html.encode("utf-8", "replace"), first, first is not None)))
                n += 1
                if out.tell() > limit:
                    out.close()
                    done.append((f"{folder}/{path}", n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["uri", "records"])

    return of


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and returns the manifest (uri, records) of the archives.

    Of rows with equal payloads of at least `least` bytes, that with the largest page_id is a response and the others
    revisit it; rows that share that page_id are all responses, and so are rows whose group has no page_id; a row
    without one revisits. Null html is an empty payload, a null url an empty one. Ids of any type that sorts are written
    as text. Repeated rows are a record each; other columns are not read, whatever their names; an empty table writes no
    archive. Archives have names of their own per task attempt; only those in the manifest count, so a repeated task
    leaves no record twice. Copies meet only as digests; payloads meet their row's reference by page and digest, so no
    payload that many pages share gathers them in a task.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary")))
    keys = saved(rows.select("page_id", digest.alias("digest")).filter("digest is not null"), "digests")
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("k")).filter("k > 1").select("digest", "first")
    to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    marks = saved(keys.join(groups, "digest").select("page_id", "digest", to.alias("to")).filter("to is not null").distinct(), "revisits")
    own, said = rows.withColumn("digest", digest), marks.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("to").cast("string").alias("to"))
    placed = own.join(said, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    texts = placed.select(F.col("page_id").cast("string"), "url", "html", "to")
    return saved(texts.mapInArrow(_writer(folder, limit), "uri string, records bigint").filter("uri is not null"), "manifest")


def _reader(payloads: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = [x.split(" ")[0] for x in FOUND.split(", ")]
        kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split(" ")[1]] for x in FOUND.split(", ")]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                held: list[dict] = []
                size = 0
                with store.open_input_stream(path, compression=None) as f:
                    for row in salvage_stream(f.read):
                        size += len(row.get("payload") or b"")
                        held.append(row if payloads else row | {"payload": None})
                        if size > 1 << 22 or len(held) == 1 << 14:
                            yield pa.RecordBatch.from_arrays([pa.array([uri if n == "uri" else x.get(n) for x in held], t) for n, t in zip(names, kinds)], names)
                            held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([uri if n == "uri" else x.get(n) for x in held], t) for n, t in zip(names, kinds)], names)

    return of


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives in manifest.uri: columns FOUND.

    Archives are dealt in turn, some each task. A task holds a window of an archive and one unpacked member at a time. An
    empty manifest gives an empty result, a null uri is skipped; an archive that is listed twice is read twice.
    """
    named = manifest.select("uri").filter("uri is not null")
    width, count = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), named.count()
    return named.repartition(max(1, min(count, max(width, count // 32)))).mapInArrow(_reader(payloads), FOUND)


def quarantine(found: DataFrame, path: str | None = None) -> DataFrame:
    """The log of byte ranges that no valid record covers, kept as a table (in the shared folder unless path is given)."""
    gaps = found.filter("kind = 'gap'").select("uri", "start", "end", (F.col("end") - F.col("start")).alias("lost_bytes"), "inner_start", "inner_end")
    if path is None:
        return saved(gaps, "quarantine")
    gaps.write.mode("error").parquet(path)
    return found.sparkSession.read.schema(gaps.schema).parquet(path)


def sound(found: DataFrame) -> DataFrame:
    """found, of archives that must have no gap: a gap is an error."""
    gap = F.concat(F.lit("damaged archive "), F.col("uri"), F.lit(" at byte "), F.col("start").cast("string"))
    return found.filter(F.when(F.col("kind") == "gap", F.raise_error(gap).cast("boolean")).otherwise(F.lit(True)))


def report(found: DataFrame, id_type: str = "bigint") -> DataFrame:
    of = lambda c: F.col(c).cast(id_type).alias(c)
    return found.filter("kind <> 'gap'").select(of("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), of("refers_to"))
