import base64
import gzip
import hashlib
import random

import pytest

from cloudgrid.llm import warc
from cloudgrid.llm.common import local_path, open_file


def test_loser_tree():
    r = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(r.randint(0, 50) for _ in range(r.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs], lambda v: v)) == sorted(v for x in runs for v in x)


@pytest.mark.parametrize("url, key", [("http://www.Example.com/A?b#c", "com,example,www)/a?b"), (None, ""), ("odd", "odd"), ("x://h", "h)")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


ROWS = [
    (5, "http://b.com/1", "same"),
    (3, "http://a.com/2", "same"),
    (9, "http://a.com/1", "same"),
    (7, None, None),
    (8, "http://a.com/\r\nX: y", ""),
    (2, "http://é.com/", "ünï\r\n\r\ncode \x00"),
    (4, "http://a.com/1", "x" * 300_000),
    (11, "http://z.com/", "twice"),
    (11, "http://z.com/", "twice"),
    (None, "http://n.com/", "same"),
    (None, "http://n.com/", "alone"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "page_id bigint, url string, html string, record_type string").repartition(3)


def expected(min_bytes=0):
    first = {}
    for i, _, h in ROWS:
        b = (h or "").encode()
        first[b] = min([v for v in (first.get(b), i) if v is not None], default=None)
    out = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        copies = sum((x or "").encode() == b for _, _, x in ROWS)
        revisit = len(b) >= min_bytes and copies > 1 and first[b] is not None and first[b] != i
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((i, len(b), digest, "revisit" if revisit else "response", first[b] if revisit else None, b"" if revisit else b))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(pages, monkeypatch, min_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    index = warc.merge(warc.write(pages, min_bytes=min_bytes))
    got = [(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in warc.read(index).collect()]
    assert sorted(got, key=str) == expected(min_bytes)


def test_index_is_in_global_order(pages):
    rows = sorted(warc.merge(warc.write(pages)).collect(), key=lambda r: (r.range_no, r.range_pos))
    order = [(r.url_key, r.captured, r.id is not None, r.id or 0) for r in rows]
    assert order == sorted(order) and len(rows) == len(ROWS)


def test_archives_are_plain_gzip_members(pages):
    runs = warc.write(pages)
    for path in {r.path for r in runs.select("path").collect()}:
        with open_file(path) as f:
            text = gzip.decompress(f.read())
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and local_path(path)


def test_a_run_out_of_order_is_cut():
    row = lambda k, run: (k, "d", 1, run, 0)
    runs = warc.sorted_runs([row("b", "r"), row("c", "r"), row("a", "r"), row("a", "s")])
    assert sorted(len(r) for r in runs) == [1, 1, 2]


def test_empty(pages):
    assert warc.read(warc.merge(warc.write(pages.limit(0)))).count() == 0


def test_captures_of_one_url_in_order_of_time(spark, monkeypatch):
    """Runs are merged by URL key, then time, then row id; a null time is the default date."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40)
    urls, r = ["http://a.com/x", "http://b.com/", "http://a.com/"], random.Random(3)
    rows = [(k, r.choice(urls), f"text {k}", None if k % 9 == 0 else f"20{r.randint(10, 20)}-03-0{r.randint(1, 9)} 04:05:06") for k in range(120)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, at string").repartition(5)
    index = warc.merge(warc.write(df, time_col="at"))
    got = sorted(index.collect(), key=lambda x: (x.range_no, x.range_pos))
    stamp = {k: (at.replace(" ", "T") + "Z") if at else warc.DATE for k, _, _, at in rows}
    want = sorted((warc.url_key(u), stamp[k], k) for k, u, _, _ in rows)
    assert [(x.url_key, x.captured, x.id) for x in got] == want
    assert len({x.run for x in got}) > 20 and {x.id for x in warc.read(index).collect()} == set(stamp)
    with open_file(got[0].path) as f:
        f.seek(got[0].offset)
        assert f"WARC-Date: {got[0].captured}".encode() in gzip.decompress(f.read(got[0].length))
