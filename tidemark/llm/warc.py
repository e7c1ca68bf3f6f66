"""WARC archives with a two-level capture index.

Tasks write archives of one gzip member per record.  Captures are sorted by
their reversed-host URL key into blocks, each a gzip member of an index file;
the sparse directory has a row for each block.  Keys are looked up in bulk: each
goes to the parts of the directory that may hold it, where a task binary-searches
the part's rows, range-reads the blocks that it needs, and binary-searches those.
The records that they name are read in the order of the archives.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import parallelism, scratch, stored
from tidemark.llm.files import opened, read_range, task_name

ROLL_BYTES = 256 << 20
#: Captures in a part of the index: what a task that looks keys up has of it.
PART_LINES = 1 << 18
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # the pages have no date; a fixed one keeps archives reproducible


def url_key(url: Column) -> Column:
    """Reversed-host key: scheme, fragment and default port dropped, host in lower case; null gives ``)/``."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?:]*)", 1))
    port = F.regexp_extract(bare, r"^[^/?:]*:(\d+)", 1)
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    shown = F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), shown, F.lit(")"), path)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(url: str | None, page_id: int | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record's bytes; a revisit (``refers_to`` given) holds no payload but tells its digest and size."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:capture:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:capture:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload; of a response, from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda x: int(x) if (x := x[len("<urn:capture:") : -1]) else None
    out = {"page_id": number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": None, "payload": None}
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if out["record_type"] == "revisit":
        out["refers_to"] = number(fields["WARC-Refers-To"])
    else:
        out["payload"] = block.partition(b"\r\n\r\n")[2]
        if (payload_digest(out["payload"]), len(out["payload"])) != told:
            raise ValueError(f"record {out['page_id']} does not have the payload that it tells of")
    return out | {"payload_digest": told[0], "payload_bytes": told[1]}


def _responses(pages: DataFrame) -> DataFrame:
    """Pages with ``refers_to``: the largest id of equal payloads, null for that page itself."""
    pages = pages.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    repeated = pages.groupBy("digest").agg(F.max("page_id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "lead")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("lead")), F.col("lead"))
    return pages.join(repeated, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the records below ``folder``; returns the captures (url_key, page_id, archive, offset, length).

    A file that an attempt left unfinished is never named by a capture.
    """
    rows = _responses(pages).select(url_key(F.col("url")).alias("url_key"), "page_id", "url", "html", "refers_to")

    def run(batches):
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        number, out, path, at = 0, None, None, 0
        for batch in batches:
            found = {"url_key": [], "page_id": [], "archive": [], "offset": [], "length": []}
            for i in range(batch.num_rows):
                if out is None or at >= ROLL_BYTES:
                    if out is not None:
                        out.close()
                    path, at, number = f"{task_name()}-{number:04d}.warc.gz", 0, number + 1
                    out = system.open_output_stream(f"{root}/{path}", compression=None)
                key, page_id, url, html, refers_to = (column[i].as_py() for column in batch.columns)
                data = gzip.compress(warc_record(url, page_id, (html or "").encode(), refers_to), 3, mtime=0)
                out.write(data)
                for name, value in zip(found, (key, page_id, path, at, len(data)), strict=True):
                    found[name].append(value)
                at += len(data)
            yield pa.RecordBatch.from_pydict(found, schema=_CAPTURE)
        if out is not None:
            out.close()

    return rows.mapInArrow(run, "url_key string, page_id long, archive string, offset long, length long")


_CAPTURE = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_DIRECTORY = pa.schema([("part", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())])


def write_index(captures: DataFrame, folder: str, block_lines: int = 1000) -> DataFrame:
    """Writes sorted captures as compressed blocks; returns the directory, a row for each block.

    ``part`` numbers the ranges of keys that the writing tasks have, of about
    PART_LINES captures at most, which is what a search holds.  A key of very many captures fills blocks of several parts.
    """
    n = max(parallelism(captures.sparkSession), -(-captures.count() // PART_LINES))
    ranged = captures.repartitionByRange(n, "url_key", "page_id").sortWithinPartitions("url_key", "page_id", "archive", "offset")

    def run(batches):
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        out, path, at, lines, keys = None, f"{task_name()}.cdxj.gz", 0, [], []
        part = TaskContext.get().partitionId()

        def flush():
            nonlocal out, at
            if out is None:
                out = system.open_output_stream(f"{root}/{path}", compression=None)
            data = gzip.compress("".join(lines).encode(), 6, mtime=0)
            out.write(data)
            row = {"part": [part], "first_key": [keys[0]], "last_key": [keys[-1]], "file": [path], "offset": [at], "length": [len(data)], "lines": [len(lines)]}
            at += len(data)
            lines.clear()
            keys.clear()
            return pa.RecordBatch.from_pydict(row, schema=_DIRECTORY)

        for batch in batches:
            for capture in batch.to_pylist():
                keys.append(capture.pop("url_key"))
                lines.append(json.dumps([keys[-1], capture]) + "\n")
                if len(lines) == block_lines:
                    yield flush()
        if lines:
            yield flush()
        if out is not None:
            out.close()

    return ranged.mapInArrow(run, "part int, first_key string, last_key string, file string, offset long, length long, lines long")


def block_captures(folder: str, row: dict) -> list[tuple[str, dict]]:
    """The (key, capture) lines of the block that a directory row names."""
    data = zlib.decompress(read_range(f"{folder}/{row['file']}", row["offset"], row["length"]), 31)
    return [tuple(json.loads(line)) for line in data.decode().splitlines()]


_FOUND = "url_key string, page_id long, archive string, offset long, length long"
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("url_key", pa.string())])


@dataclass
class CaptureArchive:
    """Archives below ``folder``/records, index blocks below ``folder``/index, and the directory."""

    folder: str
    directory: DataFrame

    def captures(self, keys: DataFrame) -> DataFrame:
        """The captures of the keys (url_key, each once) by way of the index; a key that is not there has none."""
        folder = self.folder
        # one row for each part: a directory of the directory
        ranges = self.directory.groupBy("part").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).orderBy("part").collect()
        parts, firsts, lasts = [r["part"] for r in ranges], [r["first"] for r in ranges], [r["last"] for r in ranges]

        def dealt(batches):
            for batch in batches:
                out = {"part": [], "url_key": []}
                for key in batch.column("url_key").to_pylist():
                    for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                        out["part"].append(parts[k])
                        out["url_key"].append(key)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int32()), ("url_key", pa.string())]))

        def search(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
            out = {name: [] for name in _CAPTURE.names}
            rows = sorted(blocks.to_pylist(), key=lambda r: (r["file"], r["offset"]))  # the order of the keys
            ends, at, lines = [r["last_key"] for r in rows], None, []
            for key in sorted(wanted.column("url_key").to_pylist()):
                block = bisect.bisect_left(ends, key)
                while block < len(rows) and rows[block]["first_key"] <= key:
                    if block != at:
                        at, lines = block, block_captures(f"{folder}/index", rows[block])
                    line = bisect.bisect_left(lines, key, key=lambda x: x[0])
                    while line < len(lines) and lines[line][0] == key:
                        for name, value in {"url_key": key, **lines[line][1]}.items():
                            out[name].append(value)
                        line += 1
                    block += 1
            return pa.Table.from_pydict(out, schema=_CAPTURE)

        asked = keys.select("url_key").mapInArrow(dealt, "part int, url_key string")
        return asked.groupBy("part").cogroup(self.directory.groupBy("part")).applyInArrow(search, _FOUND)

    def records(self, keys: DataFrame, payloads: bool = False) -> DataFrame:
        """The records of the keys: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key; with ``payloads`` also a response's payload."""
        folder, names = self.folder, [n for n in _RECORD.names if payloads or n != "payload"]
        schema = pa.schema([_RECORD.field(n) for n in names])

        def read(batches):
            system, root = opened(f"{folder}/records")
            name, f = None, None
            for batch in batches:
                rows = []
                for key, archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("url_key", "archive", "offset", "length")), strict=True):
                    if archive != name:
                        name, f = archive, system.open_input_file(f"{root}/{archive}")
                    f.seek(offset)
                    rows.append({"url_key": key} | {k: v for k, v in parse_record(zlib.decompress(f.read(length), 31)).items() if k in names})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        n = parallelism(self.directory.sparkSession)
        found = self.captures(keys).select("url_key", "archive", "offset", "length")
        found = found.repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
        kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
        return found.mapInArrow(read, ", ".join(f"{x.name} {kinds[x.type]}" for x in schema))

    def lookup(self, urls: list[str]) -> list[dict]:
        """All records of some URLs, with their payloads."""
        asked = self.directory.sparkSession.createDataFrame([(u,) for u in urls], "url string")
        keys = asked.select(url_key(F.col("url")).alias("url_key")).distinct()
        return [r.asDict() for r in self.records(keys, payloads=True).collect()]


def archive(pages: DataFrame, folder: str, block_lines: int = 1000) -> CaptureArchive:
    """Archives ``pages`` (page_id, url, html) below ``folder``, a URI of shared storage that must not exist yet.

    Of equal payloads (null html is the empty one) the record of the largest
    page_id is the response and the others revisit it.  Rows of that same id
    and payload are all responses.  A null id is smaller than any other and a
    payload whose ids are all null is a response each time.  Null URLs are
    archived under the key ``)/``; URLs that share a key are all found by it.
    An empty table gives an empty archive; very long pages are held whole in a
    task, one at a time; other columns are ignored.
    """
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    captures = stored(write_archives(given, f"{folder}/records"), "warc-captures")
    return CaptureArchive(folder, stored(write_index(captures, f"{folder}/index", block_lines), "warc-directory"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives pages in the shared scratch folder and looks up every page's key in the index: its records, read back."""
    kept = archive(pages, scratch(spark, "warc"))
    keys = pages.select(url_key(F.col("url")).alias("url_key")).distinct()
    return kept.records(keys).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), g AS (
  SELECT payload, max(page_id) AS lead FROM p GROUP BY payload
), h AS (
  SELECT p.page_id, p.payload, g.lead, sha1(p.payload) AS hex FROM p JOIN g ON p.payload = g.payload
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM h
"""
