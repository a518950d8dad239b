"""WARC archives whose repeated payloads are revisit records.

Records are text: headers and payload are UTF-8, and the blank line pair that
ends a record is the line separator of Spark's text writer, so archives can lie
in any store that Spark writes to.  Reading goes by ``Content-Length``, never by
searching for separators, so payloads may hold anything.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.scratch import Scratch

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    """``least``: payload bytes from which equal payloads are revisits.
    ``records`` and ``megabytes``: what one archive file holds at most, before compression,
    so that no archive outgrows a reading task; a single record may be larger.
    ``written``: the time in the headers, in UTC; that of writing unless given."""

    least: int = 100
    records: int = 2_000
    megabytes: int = 512
    written: datetime | None = None


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, payload_bytes) of each row: all that is shuffled by digest."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def resolve(found: DataFrame, scratch: Scratch, params: WarcParams = WarcParams()) -> DataFrame:
    """(page_id, payload_digest, refers_to) of each page that revisits another.

    The smallest page_id of a payload is its original; ids are compared with null
    last, so a null id is original only among nulls.  Rows that repeat the
    original's id are originals too.  The digest groups are reduced before the
    shuffle and joined back from a written table, so that Spark can split the
    partition of a payload that very many pages share.
    """
    large = found.where(F.col("payload_bytes") >= params.least)
    groups = large.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    groups = scratch.save(groups.where("n > 1").select("payload_digest", "original"), "originals")
    shared = large.select("page_id", "payload_digest").join(groups, "payload_digest")
    return shared.where(~F.col("page_id").eqNullSafe(F.col("original"))).select("page_id", "payload_digest", F.col("original").alias("refers_to")).distinct()


def _clean(text: Column) -> Column:
    """A header's value: no line ends."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _date(written: datetime | None) -> Column:
    """The time of writing as WARC has it."""
    if written is not None:
        return F.lit(written.strftime("%Y-%m-%dT%H:%M:%SZ"))
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame, revisits: DataFrame, written: datetime | None = None) -> DataFrame:
    """One text column ``value``, a whole record a row, with fresh headers.

    The payload is shuffled once, by (page_id, digest); a page of any digest goes
    to its own place, so the size of a group of copies doesn't matter.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha2(payload.cast("binary"), 256)
    rows = pages.select("page_id", "url", payload.alias("html"), digest.alias("payload_digest"))
    marked = revisits.select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), "refers_to", F.lit(True).alias("revisit"))
    rows = rows.join(marked, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    revisit = F.coalesce(F.col("revisit"), F.lit(False))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(F.col("html").cast("binary")).cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _id(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), _date(written)),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _id(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block.cast("binary")).cast("string")),
    )
    return rows.select(F.concat(head, F.lit("\r\n\r\n"), block).alias("value"))


def write(pages: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Write deduplicated archives of all rows of ``pages`` (page_id, url, html) to ``path``."""
    scratch = Scratch(pages.sparkSession, "warc")
    found = scratch.save(headers(pages), "headers")
    revisits = scratch.save(resolve(found, scratch, params), "revisits")
    largest = (found.agg(F.max("payload_bytes").alias("n")).first()["n"] or 0) + 4_096  # and its headers
    most = max(1, min(params.records, params.megabytes * 1_000_000 // largest))
    out = records(pages, revisits, params.written).write.mode("overwrite").option("compression", "gzip")
    out.option("lineSep", END).option("maxRecordsPerFile", most).text(path)
    scratch.close()


def parse(archive: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record; one record is held at a time."""
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            continue  # line ends between records
        fields: dict[str, str] = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, archive.read(int(fields["content-length"]))


_PAGE = re.compile(r"<urn:x-page:(-?\d+)>")


def _page(uri: str | None) -> int | None:
    found = _PAGE.fullmatch(uri or "")
    return int(found[1]) if found else None


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data in batch["content"]:
            rows = []
            for fields, block in parse(gzip.GzipFile(fileobj=io.BytesIO(data))):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind = fields["warc-type"]
                length = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields["warc-payload-digest"].removeprefix("sha256:")
                rows.append((_page(fields["warc-record-id"]), length if kind == "revisit" else len(payload), digest, kind, _page(fields.get("warc-refers-to")), fields["warc-target-uri"]))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
            yield out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in ``path``; of responses, size and digest are of the payload as read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(_rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
