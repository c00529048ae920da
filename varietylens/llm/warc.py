"""WARC archives with a two-level capture index.

Writing: every task writes gzip-member records to files of its own in the
shared folder and returns one capture row per record; only the rows of
committed tasks name files, so a lost executor leaves at most unused files.

Index: captures are range-partitioned and sorted by reversed-host URL key.
Each index shard holds compressed blocks of sorted lines, then the sparse
block directory (first key and place of every block). The list of shards
(first and last key) is one row per shard, bounded by their number.

Reading: a key finds its shards, then its block in the directory and its
lines in the block by binary search; only that block and the records it names
are read, by range.

Null html is an empty payload, a null URL an empty key. Records with equal
payloads of at least ``least`` bytes: rows with the smallest page_id are
responses, the others revisit it (null ids last). Repeated rows are records
of their own.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, in_arrow, materialize, open_store, partitions

LEAST = 100
BLOCK = 512
_FOOT = "<qq"
_CAPTURE = ["key", "page_id", "file", "at", "size"]


def url_key(url: str | None) -> str:
    """Reversed-host key: ``com,example,www)/path?query``; no blanks. URLs that
    differ in case alone share a key."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname or "", parts.port
    except ValueError:  # no proper URL: kept as it is
        return quote(url, safe="/?&=%:;,+~@!*'().-_[]")
    if not host:
        return quote(url or "", safe="/?&=%:;,+~@!*'().-_[]")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/").lower()
    return quote(key + ("?" + parts.query.lower() if parts.query else ""), safe="/?&=%:;,+~@!*'().-_[]")


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {'-' if page_id is None else f'{page_id:020d}'}"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {quote(url or '', safe=':/?&=%#[]@!$+,;~')}",
             f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """type, page_id, refers_to, payload, and the digest and length of the full
    payload (a revisit has them too) of a record's gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[:int(fields["Content-Length"])]

    def page(name: str) -> int | None:
        found = fields.get(name, "<urn:page:None>")[len("<urn:page:"):-1]
        return None if found == "None" else int(found)
    return {"type": fields["WARC-Type"], "page_id": page("WARC-Record-ID"), "refers_to": page("WARC-Refers-To"),
            "payload": payload, "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            "length": int(fields["X-Payload-Length"])}


class Archive:
    """Where an archive lies: its folder, and its shards in key order as
    (first key, last key, file)."""

    def __init__(self, folder: str, shards: list[tuple[str, str, str]]):
        self.folder, self.shards = folder, shards


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
          least: int = LEAST) -> Archive:
    """Write all pages and their index below the shared folder."""
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    heads = (rows.where(F.octet_length("html") >= least).groupBy("digest")
                 .agg(F.min("page_id").alias("head"), F.count("*").alias("n")).where("n > 1")
                 .select(F.col("digest").alias("h_digest"), "head"))
    linked = rows.join(heads, rows["digest"] == heads["h_digest"], "left")
    other = F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("page_id"))
    linked = linked.select("page_id", "url", "html", "digest", F.when(other, F.col("head")).alias("refers_to"))

    def store(batches):
        fs, base = open_store(folder)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                found = []
                for page, link, body, digest, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member = record(page, link, body.encode("utf-8", "surrogatepass"), digest, head)
                    out.write(member)
                    found.append((capture_key(link, page), page, name, at, len(member)))
                    at += len(member)
                yield _rows(found, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], _CAPTURE)
        finally:
            if out is not None:
                out.close()

    captures = materialize(in_arrow(linked, store, "key string, page_id long, file string, at long, size long"))
    return Archive(folder, _index(captures, folder))


def _rows(rows: list, types: list, names: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _index(captures: DataFrame, folder: str) -> list[tuple[str, str, str]]:
    """Write the index shards; their (first key, last key, file) in order."""
    spark = captures.sparkSession

    def store(batches):
        fs, base = open_store(folder)
        name = f"{uuid.uuid4().hex}.index"
        out, at, lines, directory, last = None, 0, [], [], ""

        def block():
            nonlocal at
            packed = zlib.compress("\n".join(x for _, x in lines).encode(), 4)
            out.write(packed)
            directory.append((lines[0][0], at, len(packed)))
            at += len(packed)
            lines.clear()

        for batch in batches:
            for key, page, file, place, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                lines.append((key, f"{key}\t{json.dumps([page, file, place, size])}"))
                last = key
                if len(lines) == BLOCK:
                    block()
        if out is not None:
            if lines:
                block()
            packed = zlib.compress(json.dumps(directory).encode(), 4)
            out.write(packed + struct.pack(_FOOT, at, len(packed)))
            out.close()
            yield _rows([(directory[0][0], last, name)], [pa.string()] * 3, ["first", "last", "file"])

    sort = ["key", "file", "at"]  # equal keys may span shards
    shards = (in_arrow(captures.repartitionByRange(partitions(spark), *sort).sortWithinPartitions(*sort), store, "first string, last string, file string"))
    return sorted(tuple(r) for r in materialize(shards).collect())  # one row per shard


def lookup(archive: Archive, queries: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Records at the keys of the (url, page_id) asked for, each once: page_id,
    record_type, refers_to, payload, and of the full payload (which a revisit
    does not hold) payload_digest and payload_bytes."""
    spark = queries.sparkSession
    shards, folder = archive.shards, archive.folder
    firsts, lasts = [s[0] for s in shards], [s[1] for s in shards]

    def route(batches):
        for batch in batches:
            found = []
            for link, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = capture_key(link, page)
                lo, hi = bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)
                found += [(i, key) for i in range(lo, hi)]
            yield _rows(found, [pa.int32(), pa.string()], ["shard", "key"])

    def read(batches):
        fs, base = open_store(folder)
        shard = index = last = None
        directory, starts, held, lines, keys = [], [], None, [], []
        files: dict[str, pa.NativeFile] = {}

        def fetch(name: str, at: int, size: int) -> bytes:
            if name not in files:
                if len(files) >= 64:
                    files.pop(next(iter(files))).close()
                files[name] = fs.open_input_file(f"{base}/{name}")
            return files[name].read_at(size, at)

        for batch in batches:
            wanted = []
            for i, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i != shard:
                    shard, index, held = i, shards[i][2], None
                    size = fs.get_file_info(f"{base}/{index}").size
                    place, length = struct.unpack(_FOOT, fetch(index, size - 16, 16))
                    directory = json.loads(zlib.decompress(fetch(index, place, length)))
                    starts, last = [d[0] for d in directory], None
                if key == last:  # asked for in several spellings
                    continue
                last = key
                b = max(0, bisect.bisect_left(starts, key) - 1)  # equal keys may begin in the block before
                while b < len(starts) and starts[b] <= key:
                    if held != b:
                        held = b
                        lines = zlib.decompress(fetch(index, directory[b][1], directory[b][2])).decode().split("\n")
                        keys = [x.partition("\t")[0] for x in lines]
                    for x in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                        wanted.append(tuple(json.loads(lines[x].partition("\t")[2])[1:]))
                    b += 1
            wanted.sort()  # by file and place
            for at in range(0, len(wanted), 1000):
                found = [parse(fetch(*w)) for w in wanted[at:at + 1000]]
                yield _rows([(f["page_id"], f["type"], f["refers_to"], f["payload"], f["digest"], f["length"]) for f in found],
                            [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()],
                            ["page_id", "record_type", "refers_to", "payload", "payload_digest", "payload_bytes"])

    asked = queries.select(F.col(url).alias("url"), F.col(page_id).cast("long").alias("page_id")).distinct()
    routed = in_arrow(asked, route, "shard int, key string")
    return (in_arrow(routed.repartition(max(1, min(len(shards), partitions(spark))), "shard").sortWithinPartitions("shard", "key"), read, "page_id long, record_type string, refers_to long, payload binary, payload_digest string, payload_bytes long"))
