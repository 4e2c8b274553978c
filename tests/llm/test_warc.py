"""WARC segmentation, revisits and reassembly against direct results."""

import hashlib
import random

import pytest

from adlens.llm import warc
from adlens.llm.common import shared_path

PAGES = "page_id long, url string, html string, record_type string, digest string"


def expected(rows):
    by = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= warc.REVISIT_BYTES and i is not None:
            by[b] = max(by.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        last = by.get(b)
        again = last is not None and last != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def got(df):
    return sorted([tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()],
                  key=repr)


def test_round_trip_with_small_segments(spark):
    rnd = random.Random(0)
    big = "".join(rnd.choice("abc\r\n<é>") for _ in range(20_000))
    rows = [(1, "http://a/\r\nX: y", "<p>small</p>"), (2, None, None), (3, "u", ""), (4, "u", big), (5, "v", big), (6, "w", big),
            (7, "x", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n" * 60), (8, "y", "s" * 999), (9, "y", "s" * 999),
            (10, "z", "t" * 1000), (11, "z", "t" * 1000), (11, "z", "t" * 1000), (None, "n", "t" * 1000), (None, None, None)]
    assert got(warc.round_trip(table(spark, rows), segment=700)) == expected(rows)


def test_payloads_come_back_and_segments_shrink_records(spark):
    html = "é\r\n" * 5000
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, [(1, "u", html)]), path, segment=1000)
    records = warc.parsed(spark, path, with_payload=True)
    sizes = [len(r["block"]) for r in records.collect()]
    assert len(sizes) > 10 and max(sizes) == 1000
    assert warc.reassembled(records, with_payload=True).first()["payload"].decode() == html


def test_empty_table(spark):
    assert got(warc.round_trip(table(spark, []))) == []


def test_chunk_framing():
    for body in (b"", b"a", bytes(range(256)) * 40):
        for size in (1, 7, 4096):
            assert warc.dechunked(warc.chunked(body, size)) == body
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_assembly_verifies():
    s = lambda n, b, t=None: {"number": n, "block": b, "total": t}
    assert warc.assemble([s(2, b"cd", 4), s(1, b"ab")]) == b"abcd"
    for bad in ([s(2, b"cd", 4)], [s(1, b"ab"), s(1, b"ab"), s(2, b"c", 5)], [s(1, b"ab"), s(2, b"c", 4)]):
        with pytest.raises(ValueError):
            warc.assemble(bad)


def test_foreign_archives_parse():
    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    import gzip
    assert [b for _, b in warc.parse(gzip.compress(one) + gzip.compress(one))] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.parse(one[:-6]))
