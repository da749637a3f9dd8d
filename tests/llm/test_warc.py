"""WARC writing, index merging and reading against brute force."""

import glob
import gzip
import hashlib
from collections import Counter

import numpy as np
import pytest


def plain(rows):
    first = {}
    for i, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 100:
            first[payload] = min(first.get(payload, i), i)
    for i, html in rows:
        payload = (html or "").encode()
        to = first.get(payload, i)
        yield i, len(payload), hashlib.sha256(payload).hexdigest(), "response" if to == i else "revisit", None if to == i else to


def made():
    body = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 10
    return [(9, "http://B.example.com/x?y=1", body), (4, "http://b.example.com/x?y=1", body), (5, None, body), (1, "not a url", None),
            (2, "http://[bad", ""), (3, "http://a.b/\r\nX: y", "tiny"), (6, "http://a.b", "tiny"), (7, "https://c.d/" + "z" * 3000, "q" * 200_000)]


@pytest.mark.parametrize("which", ["made", "pages"])
def test_round_trip(spark, sf, which):
    from tidemark.llm.warc import round_trip

    if which == "made":
        pages = spark.createDataFrame(made(), "page_id long, url string, html string").repartition(3)
    else:
        pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = Counter(tuple(r)[:5] for r in round_trip(pages).collect())
    assert got == Counter(plain([(r["page_id"], r["html"]) for r in pages.collect()]))
    assert round_trip(pages.limit(0)).count() == 0


def test_archives_are_gzip_members_and_index_is_ordered(spark, sf, tmp_path):
    from tidemark.llm.warc import merge_index, write_archives

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.union(pages.selectExpr("page_id + 100000", "url", "html")).repartition(5)
    runs = write_archives(pages, str(tmp_path)).cache()
    merged = sorted(merge_index(runs).collect(), key=lambda r: r["part"])  # rows of a part are stored in order
    assert len({r["part"] for r in merged}) > 1
    merged = [(r["url_key"], r["timestamp"], r["run"], r["offset"]) for r in merged]
    assert merged == sorted((r["url_key"], r["timestamp"], r["run"], r["offset"]) for r in runs.collect())
    whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in sorted(glob.glob(f"{tmp_path}/*.warc.gz")))
    assert whole.count(b"WARC-Record-ID: ") == len(merged) == pages.count()


def test_captures_are_counted_in_the_order_of_the_merge(spark):
    """One URL with a third of all pages, whose history spans the range partitions."""
    from tidemark.llm.warc import round_trip

    rows = [(i * 7 % 900, "http://a.b/hot" if i % 3 == 0 else f"http://a.b/{i % 50}?q#top", f"page {i}", "x", 1, "d") for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, k long, payload_bytes string").repartition(6)
    got = {r["page_id"]: (r["url_key"], r["capture"]) for r in round_trip(pages).collect()}
    seen, want = Counter(), {}
    for i, url, *_ in sorted(rows):
        key = "b,a)" + url.removeprefix("http://a.b").removesuffix("#top")
        seen[key] += 1
        want[i] = (key, seen[key])
    assert got == want and max(seen.values()) == 300


def test_missing_and_repeated_ids(spark):
    from tidemark.llm.warc import round_trip

    html = "x" * 150
    rows = [(None, "u", html), (3, "u", html), (3, "u", html), (None, None, None)]
    got = round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == Counter([(None, "revisit", 3), (3, "response", None), (3, "revisit", 3), (None, "response", None)])


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    from tidemark.llm.warc import LoserTree

    rng = np.random.default_rng(k)
    runs = [sorted((int(x),) for x in rng.integers(0, 50, rng.integers(0, 40))) for _ in range(k)]
    assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)
