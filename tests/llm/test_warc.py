import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from matchfold.llm import queries, warc
from matchfold.session import scratch_path
from tests.llm.data import SF

PAGES = "page_id long, url string, html string, run string, place long, digest string, n long"


def awkward():
    rng = random.Random(6)
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3
    long = "é日😀" * 200_000
    same = "p" * 150
    htmls = [None, "", "", "x" * 99, "x" * 99, "é" * 50, "é" * 50, same, same, same, trap, trap, long, long, "\r\n\r\n" * 40, "\x00\x1c" * 80]
    urls = ["http://WWW.Example.com/a?q=1#top", None, "", "https://example.com", "a\r\nb", "http://example.com/ü", "//x"]
    rows = [(i, urls[i % len(urls)], h, "r", 1, "d", 2) for i, h in enumerate(htmls)]
    rows += [(100 + i, "http://hot.example.com/", rng.choice([same, "y" * i, "z" * 500]), None, None, None, None) for i in range(120)]
    return rows + [(None, "http://e.com/", same, None, None, None, None), (None, None, "only a null id " * 20, None, None, None, None), rows[8]]


def expected(rows):
    first = {}
    for page, _, html, *_ in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        to = first.get(html or "", page) if len(raw) >= 100 else page
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to == page else "revisit", None if to == page else to))
    return sorted(out, key=str)


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def of(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.select(*NAMES).collect()), key=str)


@pytest.mark.parametrize("archive_bytes, range_rows", [(32_000_000, 100_000), (900, 10)])
def test_round_trip(spark, archive_bytes, range_rows):
    pages = spark.createDataFrame(awkward(), PAGES)
    index = warc.archive_index(pages, F.lit(1_600_000_000) + F.coalesce("page_id", F.lit(0)) % 7, archive_bytes, range_rows).cache()
    assert of(index) == expected(awkward())
    # the whole index is in the order of URL key and time, places included
    rows = index.orderBy("place").collect()
    keys = [(r["url_key"], r["captured"], "" if r["page_id"] is None else str(r["page_id"])) for r in rows]
    assert keys == sorted(keys) and len({r["place"] for r in rows}) == len(rows)
    if archive_bytes < 1000:
        assert len({r["run"] for r in rows}) > 20


def test_files_are_archives_of_records(spark):
    pages = spark.createDataFrame(awkward(), PAGES).repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, F.lit(0))
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()]
    payloads = {}
    for f in files:
        raw = gzip.decompress(f)
        for offset, names, http, pieces in warc.records(f):
            assert raw[offset : offset + 10] == b"WARC/1.1\r\n" and names["WARC-Date"] == "1970-01-01T00:00:00Z"
            body = b"".join(pieces)
            if names["WARC-Type"] == "response":
                assert int(http["Content-Length"]) == len(body)
                payloads.setdefault(names.get("X-Page-Id"), set()).add(body)
            else:
                assert body == b"" and names["WARC-Profile"].endswith("identical-payload-digest")
    for page, _, html, *_ in awkward()[:6]:
        assert (html or "").encode() in payloads[str(page)]


def test_broken_archives_are_not_passed_over():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 8\r\n\r\nH 1\r\n\r\nx\r\n\r\n"
    assert [b"".join(p) for *_, p in warc.records(gzip.compress(good))] == [b"x"]
    for bad in (good[:-4], good[:-5], good[:20], b"junk\r\n\r\nmore", good + b"WARC"):
        with pytest.raises(ValueError):
            for *_, pieces in warc.records(gzip.compress(bad)):
                b"".join(pieces)


def test_loser_tree_merges():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted(rng.randint(0, 9) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_packed_members_and_small_steps():
    raw = bytes(random.Random(2).randrange(256) for _ in range(30_000))
    stream = warc._Unpacked(gzip.compress(raw[:10_000]) + gzip.compress(raw[10_000:]), step=37)
    assert b"".join([stream.take(5), *stream.pieces(len(raw) - 5)]) == raw and not stream.more()


def test_empty_table(spark):
    assert warc.archive_index(spark.createDataFrame([], PAGES), F.lit(0)).count() == 0


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert of(queries.op13_warc(spark, SF)) == expected(rows)
