"""WARC archives: written with revisits, segments and chunked framing, and read back by reassembling segments.

A page's HTTP response is one block. Its body uses chunked transfer framing, and a chunk ends inside any string that, with the line end
of a frame or its own, could pass for a record's first line; a header that ends so gets a space after it. So that line marks records alone and Spark's text
source can split an archive on it, at any size and in parallel. Blocks over ``segment_bytes`` are cut in segments: the first record has segment number 1, the
others are continuation records with the first's id as origin, the last with the total length. The reader groups continuation records by
origin, orders them by segment number, checks that no number is missing or repeated and that the total length holds, then decodes the framing.

Of records with equal payloads of at least ``least_revisit`` bytes, the one with the smallest id is the response and the rest are
revisits that refer to it.

Defined results: a null payload counts as empty; a null url becomes an empty target. Rows that repeat an id are records of
their own; of such rows with equal large payloads one is the response and the others are revisits of it. An empty table gives an empty archive and
result. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.llm.shared import materialize, scratch, spread_join

#: Fixed values of the format.
MARK = b"WARC/1.1\r\n"
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(body: bytes, size: int = 8192) -> bytes:
    """Chunked transfer framing; no chunk holds the whole of a record mark less its line end, which a frame's line end could complete."""
    out, at, found = [], 0, -1
    while at < len(body):
        if found < at:
            found = body.find(VERSION, at)
            found = len(body) if found < 0 else found
        end = min(at + size, len(body), max(found + 4, at + 1))
        out.append(b"%x\r\n%s\r\n" % (end - at, body[at:end]))
        at = end
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body of chunked framing. Extensions and trailers are read over; a broken frame is an error."""
    out, at = [], 0
    while True:
        line = data.index(b"\r\n", at)
        size = int(data[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(data[at : at + size])
        at += size + 2


def _headers(fields: list[tuple[str, str]]) -> bytes:
    return b"".join(f"{k}: {v}{' ' * v.endswith(VERSION.decode())}\r\n".encode() for k, v in fields) + b"\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def records(record_id: str, url: str, payload: bytes, digest: str, refers: str | None, segment_bytes: int) -> list[bytes]:
    """The records of one page, each without the two line ends after it. ``refers``: the response's record id, for a revisit."""
    base = [("WARC-Date", DATE), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Transfer-Encoding", "chunked")])
    if refers:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), *base, ("WARC-Refers-To", refers), ("WARC-Profile", REVISIT_PROFILE), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http)))]
        return [MARK + _headers(fields) + http]
    block = http + chunked(payload)
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    out = []
    for n, part in enumerate(parts, 1):
        own = record_id if n == 1 else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#{n}')}>"
        fields = [("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", own), *base]
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", str(n)))
            if n > 1:
                fields.append(("WARC-Segment-Origin-ID", record_id))
            if n == len(parts):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(part)))]
        out.append(MARK + _headers(fields) + part)
    return out


def _write(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                rows = whole.slice(k, 200).to_pylist()
                out = []
                for r in rows:
                    refers = _record_id(r["refers_to"], r["ref_nth"]) if r["is_revisit"] else None
                    own = _record_id(r["page_id"], r["nth"])
                    out += records(own, r["url"] or "", r["payload"], r["digest"], refers, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def _record_id(page_id: int | None, nth: str) -> str:
    """A record id that holds the page's id, and the row's name."""
    return f"<urn:page:{'' if page_id is None else page_id}:{nth}>"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 100, segment_bytes: int = 32_768) -> None:
    """Writes a record per row, as plain WARC files of the folder ``path``."""
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # A row is named by what it holds, so that a task which is run again finds the names that the others have; rows that are alike in all are told apart by number.
    name = F.md5(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.concat(F.lit("-"), "url"), F.lit("")), F.lit("\n"), "digest"))
    rows = rows.withColumn("nth", name)
    named = materialize(rows.select("page_id", "nth", "digest", F.length("payload").alias("size")), "warc_names")
    alike = materialize(named.groupBy("nth").count().where("count > 1").select("nth"), "warc_alike")
    if not alike.isEmpty():
        held = [F.first(c).alias(c) for c in ("page_id", "url", "payload", "digest")]
        again = rows.join(alike, "nth", "left_semi").groupBy("nth").agg(*held, F.count(F.lit(1)).alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")))).drop("copies")
        rows = rows.join(alike, "nth", "left_anti").withColumn("copy", F.lit(0)).unionByName(again)
    else:
        rows = rows.withColumn("copy", F.lit(0))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "nth")
    first = named.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("f")).where("n > 1")
    first = materialize(first.select(F.col("digest").alias("of"), F.col("f.page_id").alias("refers_to"), F.col("f.nth").alias("ref_nth")), "warc_first")
    both = rows.join(first, (F.col("digest") == F.col("of")) & (F.length("payload") >= least_revisit), "left")
    both = both.withColumn("is_revisit", F.col("ref_nth").isNotNull() & ((F.col("ref_nth") != F.col("nth")) | (F.col("copy") > 0)))
    own = F.when(F.col("copy") > 0, F.concat_ws("-", "nth", "copy")).otherwise(F.col("nth")).alias("nth")
    blobs = both.select("page_id", own, "url", "payload", "digest", "refers_to", "ref_nth", "is_revisit").mapInArrow(_write(segment_bytes), "record binary")
    # A record's bytes as a string value, unchanged; the text sink puts the two line ends after each.
    blobs.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "type", "origin", "segment", "total", "refers_to", "digest", "url", "block"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for raw in b.column(0).to_pylist():
            if not raw:
                continue
            split = raw.index(b"\r\n\r\n")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw[:split].decode("utf-8").split("\r\n"))}
            block = raw[split + 4 : split + 4 + int(head["content-length"])]
            if len(block) != int(head["content-length"]):
                raise ValueError(f"record {head.get('warc-record-id')} is cut off")
            number = int(head.get("warc-segment-number", 0))
            own = head["warc-record-id"]
            total = head.get("warc-segment-total-length")
            row = (own, head["warc-type"], head.get("warc-segment-origin-id", own), number, int(total) if total else None, head.get("warc-refers-to"), head.get("warc-payload-digest", "").removeprefix("sha256:"), head.get("warc-target-uri"), block)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def read_records(spark: SparkSession, path: str, version: str = "1.1") -> DataFrame:
    """All records of the archives in ``path``, plain or compressed (.gz, then one task a file): record_id, type, origin, segment (0 if whole), total, refers_to, digest, url, block. A record that is cut off is an error."""
    lines = spark.read.option("lineSep", f"WARC/{version}\r\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("raw")).mapInArrow(_parse, "record_id string, type string, origin string, segment int, total long, refers_to string, digest string, url string, block binary")


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        payloads = []
        for blocks, kind, digest in zip(*(b.column(c).to_pylist() for c in ("blocks", "type", "digest")), strict=True):
            head, _, body = b"".join(blocks).partition(b"\r\n\r\n")
            body = unchunked(body) if kind != "revisit" and b"transfer-encoding: chunked" in head.lower() else body
            if kind == "response" and digest and sha256(body).hexdigest() != digest:
                raise ValueError("a payload doesn't have its digest")
            payloads.append(body)
        keep = [b.column(c) for c in ("record_id", "type", "refers_to", "digest", "url")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(payloads, pa.binary())], ["record_id", "type", "refers_to", "digest", "url", "payload"])


def read_archives(spark: SparkSession, path: str, version: str = "1.1") -> DataFrame:
    """Whole records: record_id, type (response or revisit), refers_to, digest, url, payload (empty for a revisit)."""
    found = read_records(spark, path, version)  # read once for whole records and once for segments, rather than kept a second time
    whole = found.where("segment = 0").withColumn("blocks", F.array("block")).drop("origin", "segment", "total", "block")
    parts = F.sort_array(F.collect_list(F.struct("segment", "block", "total", "record_id", "type", "refers_to", "digest", "url")))
    groups = found.where("segment > 0").groupBy("origin").agg(parts.alias("p")).withColumn("blocks", F.col("p.block"))
    size = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    sound = (F.col("p.segment") == F.sequence(F.lit(1), F.size("p"))) & (size == F.element_at("p.total", -1))
    checked = groups.withColumn("blocks", F.when(F.coalesce(sound, F.lit(False)), F.col("blocks")).otherwise(F.raise_error(F.concat(F.lit("segments of "), "origin", F.lit(" are not whole")))))
    first = F.element_at("p", 1)
    joined = checked.select(first["record_id"].alias("record_id"), first["type"].alias("type"), first["refers_to"].alias("refers_to"), first["digest"].alias("digest"), first["url"].alias("url"), "blocks")
    return whole.unionByName(joined).mapInArrow(_payload, "record_id string, type string, refers_to string, digest string, url string, payload binary")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    id_of = lambda c: F.nullif(F.split_part(c, F.lit(":"), F.lit(3)), F.lit("")).cast("long")
    back = read_archives(pages.sparkSession, path)
    back = materialize(back.select("record_id", "type", "refers_to", "digest", F.length("payload").cast("long").alias("bytes"), F.when(F.col("type") == "response", F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest")), "warc_back")
    # A revisit's payload is its response's.
    named = back.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("bytes").alias("of_bytes"))
    full = spread_join(back.where("type = 'revisit'"), named, ["refers_to"], ["record_id"]).unionByName(back.where("type <> 'revisit'").withColumn("of_bytes", F.lit(None).cast("long")))
    return full.select(
        id_of(F.col("record_id")).alias("page_id"),
        F.coalesce("of_bytes", "bytes").alias("payload_bytes"),
        "payload_digest",
        F.col("type").alias("record_type"),
        id_of(F.col("refers_to")).alias("refers_to"),
    )
