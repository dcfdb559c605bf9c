"""WARC archives: written as one gzip stream each, then normalised to one gzip member per record with an offset index.

`write_archives` writes rows as response records into archives that are single gzip streams, as many crawlers leave
them. `normalise` inflates each such stream once, front to back, rewrites every record as a gzip member of its own and
writes a sidecar with offset, length and type of each, so that any record can be read without the others. On the way,
records whose payload an earlier key already has become revisit records. `read_archives` reads members by the index.

Files lie in the shared folder. Every attempt of a task writes under a name of its own and only names that a finished
task has returned are used, so a lost executor's half-written files are never read. Archives are closed at
`archive_bytes` of payload; a task holds one record at a time.

Null payloads are empty, a null URL is an empty header, line breaks in URLs become spaces. A null key sorts after all
others; of rows with equal key and payload one is the response and the others revisit it. An empty table has no archives.
"""
from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import column
from barloom.session import cut_lineage, shared_folder

# Fixed values of the format.
VERSION, PROFILE = b"WARC/1.0", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END, GZIP, READ = b"\r\n\r\n", 31, 1 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: dict[str, str], body: list[bytes]) -> list[bytes]:
    """Pieces of one record; the body is given in pieces so that a payload is not copied."""
    head = "".join(f"\r\n{k}: {v}" for k, v in fields.items()) + f"\r\nContent-Length: {sum(map(len, body))}"
    return [VERSION, head.encode(), END, *body, END]


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    return {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and body of each record of an uncompressed stream that comes in pieces."""
    held = bytearray()

    def until(n: int) -> bool:
        while len(held) < n:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        at = held.find(END)
        while at < 0:
            seen = len(held)
            if not until(seen + 1):
                if held.strip():
                    raise ValueError("the stream ends inside a record's header")
                return
            at = held.find(END, max(0, seen - len(END)))
        fields = parse_head(bytes(held[:at]))
        stop = at + len(END) + int(fields["Content-Length"])
        if not until(stop + len(END)):
            raise ValueError("the stream ends inside a record")
        yield fields, bytes(held[at + len(END):stop])
        del held[:stop + len(END)]


def inflate(stream) -> Iterator[bytes]:
    """Uncompressed pieces of a gzip file of one or more members. A member that ends early, its checksum included, is an error."""
    unpack, begun = zlib.decompressobj(GZIP), False
    while data := stream.read(READ):
        while data:
            begun = True
            yield unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                unpack, begun = zlib.decompressobj(GZIP), False
            else:
                break
    if begun:
        raise ValueError("the gzip stream ends before its trailer")


RECORDS = "archive string, ordinal bigint, key bigint, digest string, bytes bigint"


def writer(folder: str, archive_bytes: int, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        name = out = pack = None
        written = ordinal = 0
        for batch in batches:
            rows = []
            for key, url, payload in zip(batch["key"].to_pylist(), batch["url"].to_pylist(), batch["payload"].cast(pa.large_binary())):
                payload = payload.as_py() or b""
                if out is None:
                    name, written, ordinal = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    files.create_dir(f"{base}/raw", recursive=True)
                    out, pack = files.open_output_stream(f"{base}/raw/{name}", compression=None), zlib.compressobj(level, wbits=GZIP)
                digest = digest_of(payload)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                fields = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z",
                          "WARC-Target-URI": " ".join((url or "").split()), "WARC-Source-Key": "" if key is None else str(key),
                          "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
                pieces = record(fields, [http, payload])
                for piece in pieces:
                    out.write(pack.compress(piece))
                rows.append((name, ordinal, key, digest, len(payload)))
                written, ordinal = written + sum(map(len, pieces)), ordinal + 1   # headers count: an archive of empty pages ends, too
                if written >= archive_bytes:
                    out.write(pack.flush())
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))],
                                             ["archive", "ordinal", "key", "digest", "bytes"])
        if out is not None:
            out.write(pack.flush())
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Write every row as a response record; returns archive, ordinal, key, digest and bytes of each record. No shuffle."""
    rows = pages.select(column(key).cast("long").alias("key"), column(url).alias("url"), column(payload).alias("payload"))
    return cut_lineage(rows.mapInArrow(writer(folder, archive_bytes, level), RECORDS))


def normaliser(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, revisits in zip(batch["archive"].to_pylist(), batch["revisits"].to_pylist()):
                again = {r["ordinal"]: r["first"] for r in revisits or ()}
                target = f"{uuid.uuid4().hex}-{name}"
                files.create_dir(f"{base}/warc", recursive=True)
                offset, index = 0, []
                with files.open_input_stream(f"{base}/raw/{name}", compression=None) as source, files.open_output_stream(f"{base}/warc/{target}", compression=None) as out:
                    for k, (fields, body) in enumerate(split_records(inflate(source))):
                        del fields["Content-Length"]
                        if k in again:
                            fields |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To-Key": "" if again[k] is None else str(again[k])}
                            body = body[:body.index(END) + len(END)]   # the HTTP header alone
                        pack = zlib.compressobj(level, wbits=GZIP)
                        member = b"".join([*(pack.compress(p) for p in record(fields, [body])), pack.flush()])
                        out.write(member)
                        index.append({"key": fields["WARC-Source-Key"], "type": fields["WARC-Type"], "offset": offset, "length": len(member)})
                        offset += len(member)
                with files.open_output_stream(f"{base}/warc/{target}.idx", compression=None) as side:
                    side.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_pydict({"archive": [target], "records": [len(index)], "size": [offset]})

    return run


def spread(rows: DataFrame, archives: int) -> DataFrame:
    """One archive per row: as many partitions as archives, since a small row stands for much work."""
    return rows.repartition(max(1, archives), "archive")


def normalise(records: DataFrame, folder: str, revisit_bytes: int = 0, level: int = 4) -> DataFrame:
    """Rewrite the archives of `records` (from write_archives); returns archive, records and size of each new one.

    Of records with equal payloads of at least `revisit_bytes`, the one with the smallest key stays a response.
    """
    order = F.struct(F.col("key").isNull().alias("none"), "key", "archive", "ordinal")
    first = (records.filter(F.col("bytes") >= revisit_bytes).groupBy("digest", "bytes").agg(F.min(order).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select("digest", "bytes", "first"))
    again = (records.join(first, ["digest", "bytes"]).filter("archive <> first.archive OR ordinal <> first.ordinal")
             .groupBy("archive").agg(F.collect_list(F.struct("ordinal", F.col("first.key").alias("first"))).alias("revisits")))   # bounded by the archive's size
    archives = records.select("archive").distinct().join(again, "archive", "left")
    return cut_lineage(spread(archives, records.select("archive").distinct().count()).mapInArrow(normaliser(folder, level), "archive string, records bigint, size bigint"))


def reader(folder: str):
    names = ["key", "url", "bytes", "digest", "type", "refers", "archive", "offset"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["archive"].to_pylist():
                with files.open_input_stream(f"{base}/warc/{name}.idx", compression=None) as side:
                    index = [json.loads(x) for x in side.read().splitlines()]
                rows = []
                with files.open_input_file(f"{base}/warc/{name}") as source:
                    for entry in index:
                        source.seek(entry["offset"])
                        (fields, body), = split_records(iter([zlib.decompress(source.read(entry["length"]), GZIP)]))
                        cut = body.index(END) + len(END)
                        http = parse_head(b"WARC/" + body[:cut - len(END)])
                        if fields["WARC-Type"] == "response" and f"sha1:{digest_of(body[cut:])}" != fields["WARC-Payload-Digest"]:
                            raise ValueError(f"{name}: the payload at {entry['offset']} is damaged")
                        number = [int(fields[f]) if fields.get(f) else None for f in ("WARC-Source-Key", "WARC-Refers-To-Key")]
                        rows.append((number[0], fields["WARC-Target-URI"], int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], number[1], name, entry["offset"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)

    return read


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of normalised archives: key, url, bytes and digest of the full payload, type, refers (the key of
    the response that a revisit stands for), archive and offset. Payloads are checked against their digests."""
    return spread(archives.select("archive"), archives.count()).mapInArrow(
        reader(folder), "key bigint, url string, bytes bigint, digest string, type string, refers bigint, archive string, offset bigint")


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
