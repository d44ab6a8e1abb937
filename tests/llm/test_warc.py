import base64
import hashlib
import io
import zlib

import pytest

from priorframe.llm import warc as W


def brute(rows, least):
    first = {}
    for k, _, html in rows:
        p = (html or "").encode()
        if len(p) >= least and k is not None:
            first[p] = min(first.get(p, k), k)
    out = []
    for k, _, html in rows:
        p = (html or "").encode()
        low = first.get(p) if len(p) >= least else None
        revisit = low is not None and low != k
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((k, len(p), digest, "revisit" if revisit else "response", low if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert result(W.archive_round_trip(pages)) == brute([tuple(r) for r in pages.collect()], 0)


@pytest.mark.parametrize("least", [0, 5])
def test_odd_pages(spark, least):
    rows = [(5, "http://a/\r\nX: y", None), (3, None, ""), (9, "ü", "<p>é</p>"), (9, "ü", "<p>é</p>"), (4, "u", "<p>é</p>\r\n\r\n" * 3), (7, "u", "<p>é</p>"), (None, "u", "<p>é</p>"), (None, "u", "only"), (8, "u", "x" * 3_000_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, revisit int, payload string")
    assert result(W.archive_round_trip(df, min_revisit=least)) == brute(rows, least)
    assert result(W.archive_round_trip(df, min_revisit=least, archive_bytes=1)) == brute(rows, least)
    assert W.archive_round_trip(df.limit(0)).count() == 0


def stream(data, step=7):
    source = io.BytesIO(data)
    return lambda n: source.read(min(n, step))


def test_reader_takes_small_blocks():
    data = b"".join(W.make_record(k, "u", b"p" * k, None, False) for k in range(20))
    assert [r.payload_bytes for r in W.read_records(stream(data))] == list(range(20))


def remade(change):
    raw = zlib.decompress(W.make_record(1, "u", b"payload", None, False), 31)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(change(raw)) + pack.flush()


@pytest.mark.parametrize("data", [
    remade(lambda r: r.replace(b"payload", b"pay1oad")), remade(lambda r: r[:-4]), remade(lambda r: b"X" + r), remade(lambda r: b"WARC/1.1\r\n"),
    W.make_record(1, "u", b"payload", None, False)[:-9], b"plain text",
])
def test_broken_archives_are_refused(data):
    with pytest.raises(W.WarcError):
        for record in W.read_records(stream(data)):
            record.payload_bytes
