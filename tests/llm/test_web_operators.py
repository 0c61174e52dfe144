"""Operators 3 and 7 on small fixtures: round trips, brute force, nulls, repeats."""

import base64
import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from partledger.llm import urlfilter, warc
from partledger.llm.common import new_path

FALSE = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\ny"


def test_archives_round_trip(spark):
    rows = [(5, "http://a/5", "same é"), (3, "http://a/3", "same é"), (9, "http://a/9", ""), (8, None, None), (2, "u\r\nWARC-Type: x", FALSE), (7, "u", "WARC/1.1\r\n" * 3), (3, "http://a/3", "same é"), (11, "u", "big " * 50000), (None, "u", "null id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit("clash"))
    path = new_path(spark, "test-archives")
    warc.write_archives(pages, path, archive_bytes=3000)
    records = warc.read_archives(spark, path)
    assert records.count() == len(rows)
    got = sorted(((r.page_id if r.page_id is not None else -1), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(records).collect())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and first[h or ""] != i
        want.append((i if i is not None else -1, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=lambda w: (w[0], w[1]))


def test_empty_archives(spark):
    path = new_path(spark, "test-archives")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolved(warc.read_archives(spark, path)).count() == 0


def test_false_heads_are_not_reached():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: %d\r\n\r\n"
    body = FALSE.encode()
    archive = head % len(body) + body + b"\r\n\r\n"
    found = list(warc.candidates(archive))
    assert [f[0] for f in found] == [0, archive.index(b"WARC/1.1", 5)] and found[0][1] == len(archive)


def test_url_filter_matches_brute_force(spark):
    at = lambda d: datetime(2024, 1 + d // 28, 1 + d % 28)
    entries = [("example.com", at(5), True), ("example.com", at(40), False), ("example.com", at(200), True), ("a.b.org", at(90), True), ("b.org", at(100), True), ("b.org", at(100), False), ("net", at(1), True), (None, at(1), True), ("x.y", None, True), ("null.flag", at(3), None)]
    captures = [(u, at(d) if d is not None else None) for u in ("http://example.com/x", "HTTPS://User@www.Example.com:80", "ftp://notexample.com", "http://a.b.org.", "http://c.b.org?q=http://example.com", None, "garbage", "http://z.net/") for d in (0, 5, 39, 40, 120, 200, 300, None)] + [("http://example.com/far", datetime(9999, 12, 30)), ("http://" + "x" * 5000 + ".example.com/" + "y" * 50000, at(6))]
    given = spark.createDataFrame(captures + captures[:3], "url string, fetched_at timestamp").withColumn("domain", F.lit("clash")).withColumn("blocked", F.lit("clash"))
    listed = spark.createDataFrame(entries, "domain string, at timestamp, listed boolean")
    got = urlfilter.filter_urls(given, listed).collect()
    assert len(got) == len(captures) + 3
    for r in got:
        states = {}
        for d, t, y in sorted((e for e in entries if e[0] and e[1]), key=lambda e: (e[1], bool(e[2]))):
            if r.fetched_at is not None and t <= r.fetched_at:
                states[d] = bool(y)
        on = [d for d, y in states.items() if y and (r.host == d or r.host.endswith("." + d)) and "." in d]
        assert r.blocked == bool(on) and r.n_active == len(on) and r.active_domain == (max(on, key=len) if on else None)
    assert urlfilter.filter_urls(given, listed.limit(0)).filter("blocked").count() == 0
    assert urlfilter.filter_urls(given.limit(0), listed).count() == 0
