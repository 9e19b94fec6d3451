"""Legacy ARC archives and their conversion to WARC.

An ARC file starts with a version block; version 1 header lines have five fields, version 2 lines ten, and
the last field declares how many bytes follow. ``convert`` reads each file by those declared lengths and
synthesises WARC/1.1 records: record ids (named UUIDs of the capture, so reruns agree), ISO dates from the
14-digit stamps, types from the content (HTTP captures become responses, others resources), SHA-1 payload
and block digests. Captures with an equal payload of at least ``min_bytes`` become revisits of the one with
the largest page number; only slim index rows are grouped for that, payloads are never shuffled.

Files are written by Spark's text writer from raw bytes, one file per task of bounded size, gzip-compressed,
and read back whole, one file a row. Defined results: a null payload is empty, a null address is written as
``-``, a null page number stays null and is smaller than any number; rows that tie on number and payload
keep the first in (file, offset) as the response; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import scratch_path, shuffle_width

FILE_BYTES = 8 << 20
#: The fast level: less CPU for about a tenth more space.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
MIN_REVISIT_BYTES = 1000
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2024, 1, 1)


def http_block(page_id: int | None, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
    if page_id is not None:
        head += f"X-Page-Id: {page_id}\r\n"
    return head.encode() + b"\r\n" + payload


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, payload


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 palimpsest\n{FIELDS[version]}\n".encode()
    if version == 1:
        line = f"filedesc://{name} 0.0.0.0 20240101000000 text/plain {len(body)}"
    else:
        line = f"filedesc://{name} 0.0.0.0 20240101000000 text/plain 200 - - 0 {name} {len(body)}"
    return line.encode() + b"\n" + body


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> int:
    """Write one ARC record per row; files alternate between both header versions. Returns the file count."""
    spark = pages.sparkSession
    total = pages.agg(F.sum(F.octet_length(payload).cast("long") + 400)).first()[0] or 0
    files = max(shuffle_width(spark), math.ceil(total / FILE_BYTES))

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        version, name, offset = 1 + number % 2, f"part-{number:06d}.arc", 0
        for batch in batches:
            out = []
            if not offset:
                out.append(version_block(version, name))
                offset = len(out[0]) + 1
            for page_id, address, source in zip(batch["key"], batch["url"], batch["payload"]):
                page_id = None if pd.isna(page_id) else int(page_id)
                body = http_block(page_id, (source or "").encode())
                stamp = (EPOCH + timedelta(seconds=abs(page_id or 0) % 31_536_000)).strftime("%Y%m%d%H%M%S")
                target = quote(address, safe="!#$%&'()*+,/:;=?@[]~-._|{}^`<>\"\\") if address else "-"
                line = f"{target} 0.0.0.0 {stamp} text/html"
                if version == 2:
                    line += f" 200 {hashlib.md5(body).hexdigest()} - {offset} {name}"
                out.append(f"{line} {len(body)}\n".encode() + body)
                offset += len(out[-1]) + 1
            yield pd.DataFrame({"value": out})

    (
        pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload"))
        .repartition(files).mapInPandas(records, "value binary").select(F.col("value").cast("string"))
        .write.mode("overwrite").option("lineSep", "\n").options(**GZIP).text(path)
    )
    return files


def open_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def parse_arc(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of every record after the version block."""
    at, version, names = 0, None, []
    while at < len(raw):
        end = raw.index(b"\n", at)
        values = raw[at:end].decode("utf-8").split(" ")
        size = int(values[-1])
        block = raw[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"ARC record at {at} declares {size} bytes, {len(block)} are there")
        if version is None:
            version = int(block.split(b" ", 1)[0])
            names = FIELDS[version].split(" ")
        else:
            if len(values) != len(names):
                raise ValueError(f"ARC record at {at} has {len(values)} fields, version {version} has {len(names)}")
            yield at, dict(zip(names, values)), block
        at = end + 1 + size + 1


def capture(fields: dict[str, str], block: bytes) -> dict:
    """What a WARC record needs to know of an ARC record."""
    is_http = block.startswith(b"HTTP/")
    head, payload = split_http(block) if is_http else ({}, block)
    sha1 = hashlib.sha1(payload).digest()
    stamp = fields["Archive-date"].ljust(14, "0")[:14]
    date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
    page = head.get("x-page-id")
    return {
        "page_id": None if page is None else int(page), "uri": fields["URL"], "ip": fields["IP-address"], "date": date,
        "type": "response" if is_http else "resource", "mime": fields["Content-type"], "payload": payload, "sha1": sha1,
        "id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{fields['URL']} {date} {page} {sha1.hex()}')}>",
    }


def sha1_name(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = [*headers, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block


def to_warc(c: dict, block: bytes, revisits: dict | None) -> bytes:
    """``revisits``: id, uri, date and page_id of the response, if this capture repeats one."""
    headers = [("WARC-Type", "revisit" if revisits else c["type"]), ("WARC-Record-ID", c["id"]), ("WARC-Date", c["date"])]
    if c["uri"] != "-":
        headers.append(("WARC-Target-URI", c["uri"]))
    if c["ip"] != "0.0.0.0":
        headers.append(("WARC-IP-Address", c["ip"]))
    headers.append(("WARC-Payload-Digest", sha1_name(c["sha1"])))
    if revisits:
        block = block[: len(block) - len(c["payload"])]
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", revisits["id"]), ("WARC-Refers-To-Date", revisits["date"])]
        if revisits["uri"] != "-":
            headers.append(("WARC-Refers-To-Target-URI", revisits["uri"]))
        if revisits["page_id"] is not None:
            headers.append(("X-Refers-To-Page-Id", str(revisits["page_id"])))
    headers.append(("WARC-Block-Digest", sha1_name(hashlib.sha1(block).digest())))
    headers.append(("Content-Type", "application/http; msgtype=response" if c["type"] == "response" else c["mime"]))
    return warc_record(headers, block)


def index_arc(files: DataFrame) -> DataFrame:
    """One slim row per ARC record: path, offset, page_id, bytes, digest and what a revisit refers to."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = [(path, at, capture(f, b)) for at, f, b in parse_arc(gzip.decompress(content))]
                if not rows:
                    continue  # a file may hold its header only
                yield pd.DataFrame({
                    "path": [r[0] for r in rows], "offset": [r[1] for r in rows],
                    "page_id": pd.array([r[2]["page_id"] for r in rows], dtype="Int64"),
                    "bytes": [len(r[2]["payload"]) for r in rows], "digest": [r[2]["sha1"] for r in rows],
                    "id": [r[2]["id"] for r in rows], "uri": [r[2]["uri"] for r in rows], "date": [r[2]["date"] for r in rows],
                })

    return files.mapInPandas(of, "path string, offset long, page_id long, bytes long, digest binary, id string, uri string, date string")


def convert(spark: SparkSession, arc: str, warc: str, files: int, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Convert every ARC file under ``arc`` to a WARC file under ``warc``."""
    index = index_arc(open_files(spark, arc)).where(F.col("bytes") >= min_bytes)
    # the response: largest number, then the first place
    best = index.groupBy("digest", "bytes").agg(
        F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"),
    ).where("n > 1")
    found = index.join(best, ["digest", "bytes"])
    first = (
        found.where(F.col("page_id").eqNullSafe(F.col("top"))).groupBy("digest", "bytes")
        .agg(F.min(F.struct("path", "offset", "page_id", "id", "uri", "date")).alias("to"))
    )
    revisits = (
        index.join(first, ["digest", "bytes"])
        .where(~((F.col("path") == F.col("to.path")) & (F.col("offset") == F.col("to.offset"))))
        .groupBy("path").agg(F.collect_list(F.struct("offset", "to.page_id", "to.id", "to.uri", "to.date")).alias("revisits"))
    )

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, known in zip(batch["content"], batch["revisits"]):
                repeats = {r["offset"]: r for r in known} if known is not None else {}
                out = [warc_record([
                    ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'palimpsest')}>"),
                    ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields"),
                ], b"software: palimpsest\r\nformat: WARC File Format 1.1\r\n")]
                held = 0
                for at, fields, block in parse_arc(gzip.decompress(content)):
                    to = repeats.get(at)
                    if to is not None:
                        to = {"page_id": None if pd.isna(to["page_id"]) else int(to["page_id"]), "id": to["id"], "uri": to["uri"], "date": to["date"]}
                    out.append(to_warc(capture(fields, block), block, to))
                    held += len(out[-1])
                    if held > 1 << 22:
                        yield pd.DataFrame({"value": out})
                        out, held = [], 0
                if out:
                    yield pd.DataFrame({"value": out})

    (
        open_files(spark, arc).repartition(files, "path").join(revisits.repartition(files, "path"), "path", "left")
        .select("content", "revisits").mapInPandas(of, "value binary").select(F.col("value").cast("string"))
        .write.mode("overwrite").option("lineSep", "\r\n\r\n").options(**GZIP).text(warc)
    )


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(headers["content-length"])
        yield headers, raw[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per capture: page_id, url, date, record_type, payload_bytes, payload_digest, refers_to."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for h, block in parse_warc(gzip.decompress(content)):
                    if h["warc-type"] == "warcinfo":
                        continue
                    http, payload = split_http(block) if h["content-type"].startswith("application/http") else ({}, block)
                    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:"))
                    size = int(http.get("content-length", len(payload)))
                    if h["warc-type"] != "revisit" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
                        raise ValueError(f"record {h['warc-record-id']} does not hold the payload that it names")
                    rows.append((
                        int(http["x-page-id"]) if "x-page-id" in http else None, h.get("warc-target-uri"), h["warc-date"],
                        h["warc-type"], size, digest.hex(),
                        int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None, payload,
                    ))
                if not rows:
                    continue
                out = pd.DataFrame(rows, columns=["page_id", "url", "date", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
                out[["page_id", "refers_to"]] = out[["page_id", "refers_to"]].astype("Int64")
                yield out if with_payload else out.drop(columns="payload")

    schema = "page_id long, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    return open_files(spark, path).mapInPandas(of, schema + (", payload binary" if with_payload else ""))


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages to ARC files, those to WARC files, and the captures read back from the latter."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archives")
    files = write_arc(pages, f"{path}/arc")
    convert(spark, f"{path}/arc", f"{path}/warc", files)
    return read_warc(spark, f"{path}/warc")
