"""Operator 3: WARC archives, written with deduplication and read back by boundary-chain verification."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partledger.llm.common import new_path, table, written

#: Bytes of records that an archive gets, about, before gzip. A task writes several, one after the other, and reads one at a time.
ARCHIVE_BYTES, ARCHIVES_PER_TASK = 8 << 20, 4
#: Payloads of fewer bytes are never made revisits.
LEAST_BYTES = 0

VERSION, GAP = "WARC/1.1", "\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: five hex digits are four base-32 digits."""
    hexed = F.sha1(data)
    digits = F.concat(*(F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_types(pages: DataFrame, least_bytes: int = LEAST_BYTES, partitions: int = 1) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the response that a revisit stands for, else null.

    Only ids and digests are grouped by digest; partial aggregation takes the weight off a digest that many pages share.
    Payloads are dealt out once, by id and digest, into so many partitions, and meet their types there.
    """
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("name")
    narrow = written(pages.select("page_id", name, base32_sha1(F.encode("payload", "UTF-8")).alias("digest"), F.octet_length("payload").alias("bytes")), "digests")
    first = written(narrow.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "first")
    copies = narrow.filter(F.col("bytes") >= least_bytes).join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = written(copies.select("name", "digest", F.col("first").alias("refers_to")).distinct(), "revisits")
    keyed = pages.select(name, base32_sha1(F.encode("payload", "UTF-8")).alias("digest"), "page_id", "url", "payload").repartition(partitions, "name", "digest")
    held = keyed.join(revisits.hint("shuffle_hash"), ["name", "digest"], "left")
    return held.select("page_id", "url", "payload", "digest", "refers_to")


def record(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A WARC record up to the gap after its block; a revisit has an empty block."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    again = refers_to.isNotNull()
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(page_id)),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, r"[\x00-\x20\x7F]", "")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(refers_to))),
        F.when(again, F.lit(f"WARC-Profile: {SAME_PAYLOAD}")),
        F.concat(F.lit("Content-Length: "), F.when(again, 0).otherwise(F.octet_length(payload)).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(GAP), F.when(again, "").otherwise(payload))


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A WARC record for each row, in gzipped archives of about archive_bytes (before gzip) under path, by Spark's text sink.

    The sink ends each record with the gap that the format asks for, and its commit protocol leaves whole archives if
    executors are lost. A null payload is empty, a null id is written as "null", a null url is left out. Of equal payloads
    (of least_bytes or more) the smallest id is the response, every row of that id too; the others revisit it. Other columns of
    pages are not read, whatever their names. A record is never cut, however long its payload is.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    total, most = rows.agg(F.coalesce(F.sum(F.octet_length("payload") + 500), F.lit(0)), F.count("*")).first()
    tasks = int(total // (ARCHIVES_PER_TASK * archive_bytes)) + 1
    records = max(1, int(most * archive_bytes // max(total, 1)))
    typed = with_types(rows, least_bytes, tasks)
    out = typed.select(record(F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("refers_to")))
    out.write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")


def candidates(archive: bytes) -> Iterator[tuple]:
    """(offset, successor, page_id, type, payload bytes, payload digest, stated digest, refers_to) wherever a record could begin."""
    for m in HEAD.finditer(archive):
        head = {}
        for line in m[1].decode("utf-8", "replace").split("\r\n"):
            k, _, v = line.partition(":")
            head.setdefault(k.strip().lower(), v.strip())
        length = head.get("content-length", "")
        if not length.isdigit():
            continue
        payload = archive[m.end() : m.end() + int(length)]
        after = m.end() + int(length) + len(GAP)
        if after > len(archive) or archive[after - len(GAP) : after] != GAP.encode():
            continue
        number = lambda k: re.sub(r"^<urn:page:|>$", "", head.get(k, ""))
        yield m.start(), after, number("warc-record-id"), head.get("warc-type", ""), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), head.get("warc-payload-digest", "").removeprefix("sha1:"), number("warc-refers-to")


FIELDS = ["offset", "successor", "page_id", "type", "bytes", "digest", "stated", "refers_to"]


def reachable(found: DataFrame) -> DataFrame:
    """The (archive, offset) that a chain of successors reaches from offset 0, by pointer jumping.

    Each round marks where the marked candidates' pointers lead and doubles the length of all pointers, so n records
    in an archive take log2(n) rounds.
    """
    chain = written(found.select("archive", "offset", F.col("successor").alias("to"), (F.col("offset") == 0).alias("reached")).dropDuplicates(["archive", "offset"]), "chain")
    marked = -1
    while True:
        now = chain.filter("reached").count()
        if now == marked:
            return chain.filter("reached").select("archive", "offset")
        marked = now
        ahead = chain.select("archive", F.col("offset").alias("to"), F.col("to").alias("further"))
        doubled = chain.join(ahead, ["archive", "to"], "left").select("archive", "offset", F.col("further").alias("to"), "reached")
        hit = chain.filter("reached and to is not null").select("archive", F.col("to").alias("offset"), F.lit(None).cast("long").alias("to"), F.lit(True).alias("reached"))
        known = doubled.withColumn("own", F.lit(True)).unionByName(hit.withColumn("own", F.lit(False)))
        merged = known.groupBy("archive", "offset").agg(F.max("to").alias("to"), F.max("reached").alias("reached"), F.max("own").alias("own"))
        chain = written(merged.filter("own").drop("own"), "chain")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, offset, page_id, type, bytes, digest, stated, refers_to) of the records of the archives under path.

    Every place that looks like a record's head is a candidate, also within payloads; a record counts if the chain of
    boundaries from its archive's start reaches it; offsets count bytes before gzip. Ids are strings here. A task holds one
    archive at a time, so archives are to be of bounded size, as write_archives makes them.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for name, content in zip(part["path"], part["content"], strict=True):
                rows = pd.DataFrame(list(candidates(gzip.decompress(content) if name.endswith(".gz") else bytes(content))), columns=FIELDS)
                rows.insert(0, "archive", name)
                yield rows

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = written(files.mapInPandas(each, "archive string, offset long, successor long, page_id string, type string, bytes long, digest string, stated string, refers_to string"), "records")
    return found.join(reachable(found), ["archive", "offset"], "left_semi").drop("successor")


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a revisit's payload is that of the response it refers to."""
    given = records.filter("type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("digest").alias("d")).agg(F.max("bytes").alias("of_bytes"))
    asked = records.filter("type = 'revisit'").select("refers_to").distinct()
    given = written(given.join(asked, given.of == asked.refers_to, "left_semi"), "responses")
    of = lambda name: F.when(F.col(name) != "null", F.col(name).cast("long"))
    plain = records.filter("type = 'response'").select(of("page_id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = records.filter("type = 'revisit'").join(given, (F.col("refers_to") == F.col("of")) & (F.col("stated") == F.col("d")), "left")
    again = again.select(of("page_id").alias("page_id"), F.col("of_bytes").alias("payload_bytes"), F.col("stated").alias("payload_digest"), F.col("type").alias("record_type"), of("refers_to").alias("refers_to"))
    return plain.unionByName(again)


def op3_warc(spark, sf_dir):
    path = new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved(read_archives(spark, path))


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, translate(list_aggregate(list_transform(range(0, 8), lambda i: lpad(to_base(('0x' || substr(h, 1 + 5 * i, 5))::BIGINT, 32), 4, '0')), 'string_agg', ''),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
