"""Web archives: exact round trips, revisits, the dictionary's frame, records by offset."""

from __future__ import annotations

import hashlib
import struct

import pytest
import zstandard as zstd
from pyarrow import fs

from panelcast.llm import warc

LONG = "<html>" + "the same page again " * 20 + "</html>"
PAGES = [
    (5, "http://a.example/é ü?x=1", LONG, "r"), (3, "http://b.example/", LONG, "r"), (9, None, LONG, "r"), (3, "http://b.example/", LONG, "r"),
    (1, "http://c.example/\nline", "short", "r"), (2, "", "short", "r"), (4, "u", None, "r"), (6, "u", "", "r"), (7, "u", "é" * 50, "r"),
    (8, "u", "é" * 50, "r"), (10, "u", "x" * 99, "r"), (11, "u", "x" * 99, "r"), (None, "u", LONG, "r"), (12, "u", "\r\n\r\nWARC/1.1\r\n" * 30, "r"),
    (13, "u", "<p>" + "lang " * 400_000, "r"), (None, "u", "y" * 200, "r"),
]
SCHEMA = "page_id bigint, url string, html string, digest string"


def expected(pages):
    first = {}
    for page, _, html, _ in pages:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, _, html, _ in pages:
        data = (html or "").encode()
        origin = first.get(data)
        revisit = origin is not None and (page is None or page > origin)
        out.append((str(page), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", str(origin) if revisit else None,
                    None if revisit else data))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [warc.ARCHIVE_BYTES, 300])
def test_round_trip(spark, limit):
    index = warc.write_archives(spark.createDataFrame(PAGES, SCHEMA).repartition(2), archive_bytes=limit)
    rows = warc.read_archives(index, payloads=True).collect()
    got = sorted(((str(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                   None if r["payload"] is None else bytes(r["payload"])) for r in rows), key=str)
    assert got == expected(PAGES)
    assert {r["target_uri"] for r in rows} >= {"http://a.example/%C3%A9%20%C3%BC?x=1", "http://c.example/%0Aline", None}
    assert sorted(str(r["id"]) for r in index.collect()) == sorted(str(p[0]) for p in PAGES)
    assert warc.read_archives(index).count() == len(PAGES) and "payload" not in warc.read_archives(index).columns


def test_archives_begin_with_their_dictionary_and_records_stand_alone(spark):
    pages = [(k, f"http://x.example/{k}", f"<html><head><title>Page {k}</title></head><body><p>{'some shared text of all pages ' * 5}{k * 7919}</p></body></html>", "")
             for k in range(400)]
    index = warc.write_archives(spark.createDataFrame(pages, SCHEMA).coalesce(1)).collect()
    store, name = fs.FileSystem.from_uri(index[0]["path"])
    data = store.open_input_stream(name).read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and 0 < size <= warc.DICTIONARY_BYTES and len(data) == index[0]["archive_bytes"]
    held = zstd.ZstdCompressionDict(data[8 : 8 + size])
    assert held.dict_id() != 0  # trained, as there are enough records
    reader = zstd.ZstdDecompressor(dict_data=held)
    for row in index[::37]:
        frame = data[row["offset"] : row["offset"] + row["length"]]
        text = reader.decompress(frame, max_output_size=1 << 20)
        assert text.startswith(b"WARC/1.1\r\n") and f"page:{row['id']}>".encode() in text and zstd.frame_content_size(frame) == len(text)
    plain = zstd.ZstdCompressor(level=warc.LEVEL)
    assert len(data) < 0.7 * sum(len(plain.compress(warc.record(str(k), u, h.encode(), "0" * 64, None))) for k, u, h, _ in pages)


def test_damage_is_noticed():
    made = [warc.record(str(k), None, b"payload %d" % k * 30, hashlib.sha256(b"payload %d" % k * 30).hexdigest(), None) for k in range(3)]
    data, _ = warc.archive(made)
    assert [h["warc-type"] for h, _ in warc.records_of(data)] == ["response"] * 3
    wrong, _ = warc.archive([made[0].replace(b"payload 0", b"payload 9", 1)])
    with pytest.raises(ValueError, match="damaged"):
        list(warc.records_of(wrong))
    cut, _ = warc.archive([made[0][:-10]])
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records_of(cut))
    with pytest.raises(ValueError, match="no dictionary"):
        list(warc.records_of(data[1:]))


def test_no_pages(spark):
    index = warc.write_archives(spark.createDataFrame([], SCHEMA))
    assert index.collect() == [] and warc.read_archives(index, payloads=True).collect() == []
