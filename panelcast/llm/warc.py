"""Web archives in Zstandard: records compressed one by one with a dictionary that leads each archive.

Writing. Equal payloads are found by their SHA-256; the row with the smallest id keeps the payload (`response`), the others
refer to it (`revisit`). Rows are marked by a join with one row per payload, which adaptive execution splits where a
payload is very common. Each task then writes archives of bounded size: a dictionary is built from records
of the archive, put into a skippable frame at its start, and every record becomes a frame of its own, so a single record can
be read by its offset. Archives get names that no other attempt of a task uses; only those listed in the index, which Spark
commits once, count. A task that is run again leaves at most files that nothing refers to.

Reading. Tasks take archives from the index and read them record by record, each payload is held against its digest.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import text as tx
from panelcast.llm.tables import shared_folder, text_or_empty, written

SKIPPABLE = 0x184D2A5D
REVISIT_FROM = 100
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:panelcast:page"
#: Records have no time of their own in a table of pages.
DATE = "1970-01-01T00:00:00Z"
URI_SAFE = "%/:?#[]@!$&'()*+,;=-._~"
BYTES_PER_READER = 64 << 20

INDEX = "id string, record_type string, path string, offset bigint, length bigint, archive_bytes bigint"
INDEX_ARROW = pa.schema([("id", pa.string()), ("record_type", pa.string()), ("path", pa.string()), ("offset", pa.int64()),
                         ("length", pa.int64()), ("archive_bytes", pa.int64())])
RECORD = "id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string"


def elect(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(id, url, html, digest, response_id): `response_id` is the smallest id of an equal payload, null where that is the row itself.

    Payloads under `revisit_from` bytes are never referred to. A null html is empty; rows without an id come after all
    others and stay responses where no row of their payload has one; rows that repeat the smallest id stay responses.
    """
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), text_or_empty(html).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    first = rows.where(F.octet_length("html") >= revisit_from).groupBy("digest").agg(F.min("id").alias("response_id"))
    of_other = F.col("id").isNull() | (F.col("id") > F.col("response_id"))
    return rows.join(first, "digest", "left").select(
        F.col("id").cast("string").alias("id"), "url", "html", "digest",
        F.when(of_other, F.col("response_id")).cast("string").alias("response_id"))


def urn(page: str | None) -> str:
    return f"<{URN}:{quote(page, safe='')}>" if page is not None else f"<{URN}>"


def page_of(name: str | None) -> str | None:
    if name is None or name == f"<{URN}>":
        return None
    if not name.startswith(f"<{URN}:"):
        raise ValueError(f"not a record of this writer: {name}")
    return unquote(name[len(URN) + 2 : -1])


def record(page: str | None, url: str | None, payload: bytes, digest: str, response: str | None) -> bytes:
    """One WARC record; a revisit has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: {urn(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=URI_SAFE)}")
    if response is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(response)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return b"\r\n".join([*(line.encode() for line in head), b"", block, b"", b""])


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES) -> zstd.ZstdCompressionDict:
    """A dictionary from evenly spread records; where they are too few to train one, their own bytes serve."""
    total = sum(map(len, records))
    size = max(256, min(size, total // 32))  # in a small archive a large dictionary would not pay
    stride = max(1, -(-total // sample))
    chosen = [r[: 128 << 10] for r in records[::stride]]
    try:
        return zstd.train_dictionary(size, chosen, k=256, d=8)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(chosen)[-size:], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = LEVEL) -> tuple[bytes, list[tuple[int, int]]]:
    """The archive's bytes, and the offset and length of each record's frame."""
    trained = dictionary(records)
    lead = trained.as_bytes()
    trained.precompute_compress(level=level)
    packer = zstd.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
    out, at, places = [struct.pack("<II", SKIPPABLE, len(lead)), lead], 8 + len(lead), []
    for item in records:
        frame = packer.compress(item)
        out.append(frame)
        places.append((at, len(frame)))
        at += len(frame)
    return b"".join(out), places


def unpacker(data: bytes) -> tuple[zstd.ZstdDecompressor, int]:
    """A decompressor with the dictionary that leads the archive, and where the records begin."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start of the archive")
    return zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data[8 : 8 + size])), 8 + size


def parse(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; ends with the stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, block


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of all records of an archive; every payload that is there is held against its digest."""
    reader, start = unpacker(data)
    stream = io.BufferedReader(reader.stream_reader(memoryview(data)[start:], read_across_frames=True), 1 << 20)
    for headers, block in parse(stream):
        http, _, payload = block.partition(b"\r\n\r\n")
        lengths = [int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        headers["payload-length"] = str(lengths[0])
        if headers["warc-type"] == "response":
            digest = "sha256:" + hashlib.sha256(payload).hexdigest()
            if digest != headers["warc-payload-digest"] or len(payload) != lengths[0]:
                raise ValueError(f"damaged payload in {headers['warc-record-id']}")
        yield headers, payload


def _writer(folder: str, limit: int):
    @tx.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for batch in tx.slices(batches, "html", limit):
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "digest", "response_id")))
            made = [record(page, url, html.encode(), digest, response) for page, url, html, digest, response in rows]
            data, places = archive(made)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{top}/{name}") as out:
                out.write(data)
            n = batch.num_rows
            kinds = ["response" if r is None else "revisit" for r in batch.column("response_id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(kinds), pa.array([f"{folder}/{name}"] * n), pa.array([p[0] for p in places], pa.int64()),
                 pa.array([p[1] for p in places], pa.int64()), pa.array([len(data)] * n, pa.int64())], schema=INDEX_ARROW)
    return run


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html",
                   revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row into archives in `folder`; returns the stored index, a row per record with its frame's place.

    `folder` is a path or URI that all executors reach, by default a new one below the checkpoint folder. An archive holds up
    to `archive_bytes` of payload, or one longer page. No rows make no archive. Ids may be of any type that casts to a
    string; other columns are not looked at. See `elect` for nulls, ties and repeated rows.
    """
    spark = pages.sparkSession
    top = shared_folder(spark, "warc")
    folder = folder or f"{top}/archives"
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    rows = elect(pages, page_id, url, html, revisit_from)
    return written(rows.mapInArrow(_writer(folder, archive_bytes), INDEX), f"{top}/index")


def _reader(payloads: bool):
    schema = pa.schema([("id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + ([("payload", pa.binary())] if payloads else []))

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    @tx.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as source:
                    data = source.read()
                rows, held = [], 0
                for headers, payload in records_of(data):
                    row = (page_of(headers["warc-record-id"]), headers["warc-type"], headers.get("warc-target-uri"),
                           page_of(headers.get("warc-refers-to")), int(headers["payload-length"]),
                           headers["warc-payload-digest"].removeprefix("sha256:"))
                    revisit = headers["warc-type"] == "revisit"
                    rows.append((*row, None if revisit else payload) if payloads else row)
                    held += len(payload) if payloads else 0
                    if len(rows) == 4096 or held > 8 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)
    return run


def read_archives(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives that `index` lists: a row each, with the payload if wanted (null for a revisit).

    `payload_bytes` and `payload_digest` describe the full payload, also of a revisit. Archives are dealt out by
    path in tasks of about 64 MB.
    """
    files = index.groupBy("path").agg(F.first("archive_bytes").alias("archive_bytes"))
    total, count = files.agg(F.coalesce(F.sum("archive_bytes"), F.lit(0)), F.count("*")).first()
    parallel = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(count, max(total // BYTES_PER_READER, 2 * parallel)))
    return files.select("path").repartition(tasks, "path").mapInArrow(_reader(payloads), RECORD + (", payload binary" if payloads else ""))
