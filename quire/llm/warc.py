"""WARC archives of pages, with a two-level capture index, and their reading through range requests.

Archives hold one gzip member per record. Index lines, sorted by reversed-host url key, are cut into compressed
blocks; beside each index shard lies a sparse directory with the first key, offset and length of every block. A
lookup finds the shard, then the block by binary search in the directory, then the line by binary search in the block,
and reads only the record's own bytes from its archive. All files lie in one folder that executors share.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import scratch, slices, stored

#: Payloads below this size are never revisits.
LEAST_SHARED = 100
#: Index lines per compressed block.
BLOCK_LINES = 500
#: Most shards of an index; their first keys travel with the tasks that look up.
MOST_SHARDS = 4096
#: Adjacent records are read together up to this many bytes.
READ_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = "surt string, page_id long, file string, offset long, length long, record_type string, payload_digest string"


class Archive(NamedTuple):
    """Folder of the archives and the index, captures as a table, and the first (surt, page_id) of every index shard."""

    folder: str
    captures: DataFrame
    shards: list[tuple[str, int, str]]  # first surt, first page_id, file


def surt(url: str | None) -> str:
    """Key of a url: host reversed by labels, then the rest; a url without host is kept behind a bare bracket."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return ")" + (url or "")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return ",".join(reversed(host.lower().split("."))) + ")" + rest[len(host) :]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers only, with the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {_line(url or '')}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")

    def fields(lines: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}

    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def index_key(url_key: str, page: int | None) -> tuple[str, bool, int]:
    """Place of a capture in the index; those without an id come first under their url key."""
    return url_key, page is not None, page or 0


def write(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> Archive:
    """Write a record per row of ``pages`` and index the captures.

    Of rows with equal payloads of at least 100 bytes, the one with the smallest id is a response and the others revisit
    it; all other rows are responses. A null payload is empty. A row without id is a response, found by its
    url; rows that share an id and a payload are alike. Only ids and digests are shuffled to find equals.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = rows.where((F.length("payload") >= LEAST_SHARED) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    again = large.join(firsts, "digest").where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    joined = rows.join(again, ["page_id", "digest"], "left")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        name, out, at = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for some in slices(batch, "payload"):
                found = []
                for row in some.to_pylist():
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])) + packer.flush()
                    out = out or system.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(data)
                    found.append((surt(row["url"]), row["page_id"], name, at, len(data), "response" if row["refers_to"] is None else "revisit", row["digest"]))
                    at += len(data)
                yield _batch(found, CAPTURE)
        if out:
            out.close()

    captures = stored(joined.mapInArrow(archive, CAPTURE), "captures")
    return Archive(folder, captures, _index(spark, folder, captures))


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _index(spark: SparkSession, folder: str, captures: DataFrame) -> list[tuple[str, int, str]]:
    """Write the blocks and directories of all shards; their first keys are few enough to return."""
    parts = min(MOST_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = captures.repartitionByRange(parts, "surt", "page_id").sortWithinPartitions("surt", "page_id", "file", "offset")
    schema = "surt string, page_id long, file string"  # the key of a shard's first line, and its name

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        name, directory, waiting, at, out = f"index-{uuid.uuid4().hex}", [], [], 0, None

        def block() -> None:
            nonlocal at, out
            out = out or system.open_output_stream(f"{path}/{name}.cdxj.gz", compression=None)
            data = zlib.compress("\n".join(json.dumps(x) for x in waiting).encode())
            out.write(data)
            directory.append((waiting[0][0], waiting[0][1], waiting[0][2], at, len(data)))
            at += len(data)
            waiting.clear()

        for batch in batches:
            for row in batch.to_pylist():
                waiting.append((*index_key(row["surt"], row["page_id"]), {"file": row["file"], "offset": row["offset"], "length": row["length"], "type": row["record_type"], "digest": row["payload_digest"]}))
                if len(waiting) == BLOCK_LINES:
                    block()
        if waiting:
            block()
        if out:
            out.close()
            with system.open_output_stream(f"{path}/{name}.directory", compression=None) as file:
                file.write("\n".join(map(json.dumps, directory)).encode())
            yield _batch([(directory[0][0], directory[0][2] if directory[0][1] else None, name)], schema)

    return sorted(map(tuple, stored(ordered.mapInArrow(shard, schema), "shards").collect()), key=lambda r: index_key(*r[:2]))


def lookup(archive: Archive, wanted: DataFrame, id: str = "page_id", url: str = "url") -> DataFrame:
    """Captures (file, offset, length, ...) of the wanted (url, id) rows; a row that is not in the archive has none.

    Wanted rows are dealt to the shards by their keys, and each task reads the directories and blocks it needs.
    """
    firsts, names, folder = [index_key(s, p) for s, p, _ in archive.shards], [n for _, _, n in archive.shards], archive.folder

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(surt(u), i) for u, i in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), strict=True)]
            found = [(max(0, bisect_right(firsts, index_key(*k)) - 1), *k) for k in keys]
            # equal keys may run over into the next shards
            more = [(s, *k) for (at, *k) in found for s in range(at - 1, -1, -1) if s >= bisect_left(firsts, index_key(*k)) - 1]
            yield _batch([*found, *more] if firsts else [], "shard int, surt string, page_id long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        current, directory, file, number, lines = None, [], None, -1, []
        for batch in batches:
            found = []
            for shard_number, key, page in zip(*(batch.column(c).to_pylist() for c in ("shard", "surt", "page_id")), strict=True):
                if shard_number != current:
                    if file:
                        file.close()
                    name = names[shard_number]
                    with system.open_input_stream(f"{path}/{name}.directory", compression=None) as stream:
                        directory = [tuple(json.loads(x)) for x in stream.read().decode().split("\n")]
                    file, current, number = system.open_input_file(f"{path}/{name}.cdxj.gz"), shard_number, -1
                wanted_key = index_key(key, page)
                k = max(0, bisect_left(directory, wanted_key) - 1)
                while k < len(directory) and directory[k][:3] <= wanted_key:
                    if k != number:
                        lines, number = [json.loads(x) for x in zlib.decompress(file.read_at(directory[k][4], directory[k][3])).decode().split("\n")], k
                    for place in range(bisect_left(lines, list(wanted_key), key=lambda x: x[:3]), len(lines)):
                        if lines[place][:3] != list(wanted_key):
                            break
                        c = lines[place][3]
                        found.append((key, page, c["file"], c["offset"], c["length"], c["type"], c["digest"]))
                    k += 1
            yield _batch(found, CAPTURE)
        if file:
            file.close()

    asked = wanted.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url")).distinct()
    dealt = asked.mapInArrow(deal, "shard int, surt string, page_id long")
    return dealt.repartition("shard").sortWithinPartitions("shard", "surt", "page_id").mapInArrow(search, CAPTURE)


def read(archive: Archive, captures: DataFrame) -> DataFrame:
    """Records of the captures, by range reads: ``page_id``, ``url``, ``payload``, ``payload_bytes``, ``payload_digest``,
    ``record_type`` and ``refers_to``. A revisit has a null payload; the digest of a response is that of the bytes read,
    and a record whose bytes do not fit its digest fails the job."""
    folder = archive.folder
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        name, file, held, begin = None, None, b"", 0
        for batch in batches:
            found, size = [], 0
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for k, (own, offset, length) in enumerate(rows):
                if own != name:
                    if file:
                        file.close()
                    name, file, held = own, system.open_input_file(f"{path}/{own}"), b""
                if not begin <= offset <= offset + length <= begin + len(held):
                    end, j = offset + length, k + 1  # what follows at once is read along
                    while j < len(rows) and rows[j][:2] == (own, end) and end + rows[j][2] - offset <= READ_BYTES:
                        end, j = end + rows[j][2], j + 1
                    held, begin = file.read_at(end - offset, offset), offset
                warc, http, payload = parse(zlib.decompress(held[offset - begin : offset - begin + length], 31))
                digest = warc["warc-payload-digest"].removeprefix("sha256:")
                revisit = warc["warc-type"] == "revisit"
                if not revisit and sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{own} at {offset}: payload does not fit its digest")
                number = warc["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                first = int(warc["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">")) if revisit else None
                found.append((None if number == "None" else int(number), warc["warc-target-uri"], None if revisit else payload, int(http["content-length"]), digest, warc["warc-type"], first))
                size += len(payload)
                if size > READ_BYTES:
                    yield _batch(found, schema)
                    found, size = [], 0
            yield _batch(found, schema)
        if file:
            file.close()

    spread = captures.select("file", "offset", "length", F.floor(F.col("offset") / (16 << 20)).alias("_chunk"))
    return spread.repartition("file", "_chunk").sortWithinPartitions("file", "offset").mapInArrow(fetch, schema)
