"""Web archives with a two-level capture index.

Writing: every row becomes a WARC/1.1 record, a gzip member of its own; of rows with equal payloads of
at least `revisit_from` bytes that with the smallest id is a response, the others revisit it. Each task
writes one archive and reports where its records are; only archives of finished tasks are referred to.

Index: the captures' keys (host name reversed, then path and query, then id) are sorted by range over the
cluster. A task turns its range into one index file of gzip blocks of `LINES` lines; the sparse directory
has one row per block (file, first key, place). A lookup finds the file among the files' ranges, the block
by binary search in the file's directory, reads that byte range and searches the lines in it.

Reading: places found are sorted by archive and offset, and neighbours are read in one go.

Files go through pyarrow's file systems, so the folder may be local, hdfs:// or s3://; it must be one that
all executors share.

Defined results: a null payload is empty; a null or unusable address has key `-`; a null id is never the
one revisited unless no row of its payload has an id; rows that repeat the smallest id are all responses;
rows alike in address and id are found together.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chartloom.llm.store import new_path, shuffle_partitions, stage

LINES = 1_000
NEAR = 256 << 10          # bytes between two places that are still read in one go
SPAN = 2 << 20            # bytes read at once, at most (a longer record is read by itself)
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
CAPTURE = "key string, archive string, offset long, length long"
RECORD = "page_id {id}, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {id}"


def reversed_host(url: str | None) -> str:
    """`http://www.a.example.org:80/x?q` -> `org,example,a)/x?q`; `-` if there is no host."""
    try:
        parts = urlsplit(url or "")
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return "-"
    if not host:
        return "-"
    host = re.sub(r"^www\d*\.", "", host)
    usual = {"http": 80, "https": 443}.get(parts.scheme.lower())
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != usual else "")
    return _plain(f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""))


def _plain(text: str) -> str:
    """Without characters that end a line or a field."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def key_of(url: str | None, page_id) -> str:
    return f"{reversed_host(url)}\t{'' if page_id is None else format(page_id, '020d')}"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, not yet compressed. `refers_to` is None for a response, else (id,)."""
    http = HTTP.format(n=len(payload)).encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_plain(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{'' if refers_to[0] is None else refers_to[0]}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """(page id, url, payload or None, payload bytes, digest, type, refers to) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(fields[name][10:-1]) if name in fields and fields[name] != "<urn:page:>" else None
    if fields["WARC-Type"] == "response":
        if len(payload) != size or sha1_base32(payload) != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    else:
        payload = None
    return (number("WARC-Record-ID"), fields.get("WARC-Target-URI"), payload, size, digest, fields["WARC-Type"], number("WARC-Refers-To"))


def _files(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def _gzip(data: bytes) -> bytes:
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def _numbered(pages: DataFrame, id_col: str, url: str, payload: str, revisit_from: int) -> DataFrame:
    """page_id, url, payload, first (the response's id; null if the row is a response), is_revisit."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url}`").alias("url"),
                        F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    sizes = rows.select("page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= revisit_from)
    firsts = (sizes.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
              .where("copies > 1").select("digest", "first", F.lit(True).alias("copied")))
    # few rows beside the payloads, and a plain table: a digest very many rows share can be split
    joined = rows.join(stage(firsts, "copies"), "digest", "left")
    again = F.coalesce("copied", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "first", again.alias("is_revisit"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html",
                   revisit_from: int = 0) -> DataFrame:
    """Archives below `folder`; returns (key, archive, offset, length) of each record, as a stored table."""
    def write(batches):
        store, path = _files(folder)
        store.create_dir(path, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            rows = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first", "is_revisit"))):
                page, address, body, first, again = row
                body = body.encode()
                data = _gzip(record(page, address, body, sha1_base32(body), (first,) if again else None))
                out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                out.write(data)
                rows.append((key_of(address, page), name, at, len(data)))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "archive", "offset", "length"])
        if out:
            out.close()

    return stage(_numbered(pages, id_col, url, payload, revisit_from).mapInArrow(write, CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Index files below `folder`; returns the directory (part, first, last, offset, length)."""
    def block(batches):
        store, path = _files(folder)
        store.create_dir(path, recursive=True)
        name, out, at, held = f"{uuid.uuid4().hex}.idx.gz", None, 0, []

        def put(rows):
            nonlocal out, at
            data = _gzip("".join(f"{k}\t{a}\t{o}\t{n}\n" for k, a, o, n in rows).encode())
            out = out or store.open_output_stream(f"{path}/{name}", compression=None)
            out.write(data)
            at += len(data)
            return pa.RecordBatch.from_pydict(
                {"part": [name], "first": [rows[0][0]], "last": [rows[-1][0]], "offset": [at - len(data)], "length": [len(data)]})

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "archive", "offset", "length")))
            while len(held) >= lines:
                yield put(held[:lines])
                del held[:lines]
        if held:
            yield put(held)
        if out:
            out.close()

    ordered = captures.repartitionByRange(shuffle_partitions(captures.sparkSession), "key", "archive", "offset").sortWithinPartitions(
        "key", "archive", "offset")
    return stage(ordered.mapInArrow(block, "part string, first string, last string, offset long, length long"), "directory")


def look_up(directory: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """(key, archive, offset, length) of every capture whose key starts with one of `keys` (key).

    A whole key finds the captures of one row; `reversed_host(url) + tab` all captures of an address.
    """
    # one row per index file, as many as there are partitions
    parts = sorted((r.low, r.high, r.part) for r in directory.groupBy("part").agg(
        F.min("first").alias("low"), F.max("last").alias("high")).collect())
    lows, highs = [p[0] for p in parts], [p[1] for p in parts]

    def place(batches):
        for batch in batches:
            out = []
            for key in batch.column("key").to_pylist():
                out += [(key, parts[i][2]) for i in range(bisect_left(highs, key), bisect_right(lows, key + "\U0010ffff"))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], names=["key", "part"])

    def find(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        rows, blocks = [], sorted(blocks.to_pylist(), key=lambda b: b["offset"])
        if blocks and asked.num_rows:
            store, path = _files(folder)
            ends, open_block, lines = [b["last"] for b in blocks], -1, []
            with store.open_input_file(f"{path}/{blocks[0]['part']}") as file:
                for key in sorted(asked.column("key").to_pylist()):
                    at = bisect_left(ends, key)
                    while at < len(blocks) and blocks[at]["first"] <= key + "\U0010ffff":
                        if at != open_block:
                            file.seek(blocks[at]["offset"])
                            data = zlib.decompress(file.read(blocks[at]["length"]), 31).decode()
                            open_block, lines = at, data.split("\n")[:-1]
                        i = bisect_left(lines, key)
                        while i < len(lines) and lines[i].startswith(key):
                            found, archive, offset, length = lines[i].rsplit("\t", 3)
                            rows.append((found, archive, int(offset), int(length)))
                            i += 1
                        if i < len(lines):
                            break
                        at += 1
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "archive", "offset", "length"])

    asked = keys.select("key").where("key IS NOT NULL").distinct().mapInArrow(place, "key string, part string")
    return directory.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(find, CAPTURE)


def read_records(places: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """The records at (archive, offset, length), parsed and with their digests checked."""
    def read(batches):
        store, path = _files(folder)
        name, file = None, None
        for batch in batches:
            places_ = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))))
            i = 0
            while i < len(places_):
                archive, start, length = places_[i]
                end, j = start + length, i + 1
                while (j < len(places_) and places_[j][0] == archive and places_[j][1] - end <= NEAR
                       and places_[j][1] + places_[j][2] - start <= SPAN):
                    end = max(end, places_[j][1] + places_[j][2])
                    j += 1
                if archive != name:
                    if file:
                        file.close()
                    name, file = archive, store.open_input_file(f"{path}/{archive}")
                file.seek(start)
                data = file.read(end - start)
                rows = [parse_record(zlib.decompress(data[o - start:o - start + n], 31)) for _, o, n in places_[i:j]]
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[
                    "page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                i = j
        if file:
            file.close()

    ordered = places.repartitionByRange(shuffle_partitions(places.sparkSession), "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(read, RECORD.format(id=id_type))


def archive_round_trip(pages: DataFrame, revisit_from: int = 0, id_col: str = "page_id", url: str = "url",
                       payload: str = "html") -> DataFrame:
    """Write the rows to archives, index them, look every row up and read its record."""
    folder = new_path(pages.sparkSession, "warc")
    captures = write_archives(pages, f"{folder}/archives", id_col, url, payload, revisit_from)
    directory = write_index(captures, f"{folder}/index")

    def name(batches):
        for batch in batches:
            keys = [key_of(u, p) for u, p in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])

    keys = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url")).mapInArrow(name, "key string")
    return read_records(look_up(directory, f"{folder}/index", keys), f"{folder}/archives")
