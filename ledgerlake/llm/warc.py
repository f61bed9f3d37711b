"""WARC archives: pages written as request, response and metadata records, read back, and assembled into captures.

Writing: each page becomes three records, which name each other by WARC-Concurrent-To: a request, a response or (for a
payload written elsewhere) a revisit, and metadata with the page's id. Records are text that Spark's own writer puts
into gzip files, with the end of a record as line separator, so a task's files are published only when it has ended.
Of pages with equal payloads (by SHA-1) of at least `least` bytes the one with the largest id is the response and the
others revisit it, by its URI and digest; should rows share that id and payload, each is a response.

Reading: a file is read whole (so it is bounded when written, at about `file_bytes` before compression) and parsed as a
stream of gzip members or plain bytes; payloads are measured and digested piece by piece, and kept only if asked for. A
record that is cut off or has no valid length is left out, and bytes between records are skipped.

Assembly: a capture is a response, revisit or resource record; the others belong to it if they name it, it names them, or
they name one that belongs to it. It is one nested row, whose requests and metadata must fit into a row. A capture that is
there twice gives two rows with all copies of its members.

A null payload is empty; null or odd URIs have a fixed one, or %20 for their blanks and control characters; a null id is
written as no id and read back as null, and is never the largest unless all are null. Repeated rows are pages of their
own. Texts of any length are written and read whole. An empty table writes no record and gives no rows; columns besides
the three named are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ledgerlake.llm.shared import shared_folder, stored

END = "\r\n\r\n"
NO_URI = "urn:none"
CAPTURES = ("response", "revisit", "resource")
RECORD = "record_id string, type string, target string, date string, concurrent array<string>, refers_target string, declared string, fields map<string,string>, payload_bytes long, sha1 string, payload binary"


def _lines(*parts) -> F.Column:
    """Header lines: name and value in turn; a line whose value is null is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in zip(parts[::2], parts[1::2], strict=True)])


def _record(kind, ident, uri, date, content: str, block, *more) -> F.Column:
    length = F.octet_length(block).cast("string")
    head = _lines("WARC-Type", kind, "WARC-Record-ID", ident, "WARC-Target-URI", uri, "WARC-Date", F.lit(date), *more, "Content-Type", F.lit(content), "Content-Length", length)
    return F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), block)


def transactions(pages: DataFrame, url: str = "url", payload: str = "html", ident: str = "page_id", date: str = "1970-01-01T00:00:00Z", least: int = 1000) -> DataFrame:
    """(value) of every page: its three records as text, without the last one's end."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    uri = F.coalesce(F.regexp_replace(F.col(url).cast("string"), "[\\x00-\\x20\\x7f]", "%20"), F.lit(NO_URI))
    rows = pages.select(F.col(ident).cast("long").alias("_id"), uri.alias("_uri"), body.alias("_body"), F.sha1(body.cast("binary")).alias("_sha1"))
    large = rows.filter(F.octet_length("_body") >= least)
    held = large.groupBy(F.col("_sha1").alias("_digest")).agg(F.max(F.struct("_id", "_uri")).alias("_held"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    held = stored(held.select("_digest", F.col("_held._id").alias("_first"), F.col("_held._uri").alias("_first_uri")), "held")
    both = rows.join(held, (F.col("_sha1") == F.col("_digest")) & (F.octet_length("_body") >= least), "left")
    again = F.col("_digest").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    named = both.select("*", again.alias("_again"), *[F.format_string("<urn:uuid:%s>", F.expr("uuid()")).alias(x) for x in ("_request", "_response", "_metadata")])
    host, path = F.coalesce(F.parse_url("_safe", F.lit("HOST")), F.lit("")), F.coalesce(F.parse_url("_safe", F.lit("FILE")), F.lit("/"))
    # URIs that a parser would refuse have no host or path
    named = named.withColumn("_safe", F.when(F.col("_uri").rlike("^[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9.:-]+(/[A-Za-z0-9/._~-]*)?$"), F.col("_uri")))
    request = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("_body").cast("string"), F.lit(END))
    response = F.concat(head, F.when(F.col("_again"), F.lit("")).otherwise(F.col("_body")))
    metadata = _lines("page-id", F.col("_id").cast("string"))
    profile = F.when(F.col("_again"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    kind = F.when(F.col("_again"), F.lit("revisit")).otherwise(F.lit("response"))
    value = F.concat_ws(
        END,
        _record(F.lit("request"), F.col("_request"), F.col("_uri"), date, "application/http; msgtype=request", request, "WARC-Concurrent-To", F.col("_response")),
        _record(
            kind, F.col("_response"), F.col("_uri"), date, "application/http; msgtype=response", response, "WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1")),
            "WARC-Profile", profile, "WARC-Refers-To-Target-URI", F.when(F.col("_again"), F.col("_first_uri")), "WARC-Refers-To-Date", F.when(F.col("_again"), F.lit(date)),
        ),
        _record(F.lit("metadata"), F.col("_metadata"), F.col("_uri"), date, "application/warc-fields", metadata, "WARC-Concurrent-To", F.col("_response")),
    )
    return named.select(value.alias("value"))


def write(pages: DataFrame, path: str, payload: str = "html", file_bytes: int = 64_000_000, **names) -> None:
    """The pages as WARC files below `path`, of about `file_bytes` each before compression."""
    size = pages.agg(F.avg(F.coalesce(F.octet_length(payload), F.lit(0)))).first()[0] or 0
    most = max(1, int(file_bytes / (size + 1500)))
    transactions(pages, payload=payload, **names).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def pieces(content: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, of all gzip members if it has such, in pieces."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[i : i + most] for i in range(0, len(content), most))
        return
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        rest: bytes | memoryview = memoryview(content)
        while not member.eof:
            out = member.decompress(rest, most)
            rest = member.unconsumed_tail
            if out:
                yield out
            elif not rest:
                break
        content = member.unused_data


class Source:
    """Lines and runs of bytes from pieces."""

    def __init__(self, content: bytes):
        self.more, self.held, self.at = pieces(content), b"", 0

    def fill(self) -> bool:
        piece = next(self.more, b"")
        self.held, self.at = self.held[self.at :] + piece, 0
        return bool(piece)

    def line(self) -> bytes | None:
        """The next line without its end, or None where bytes end."""
        seen = 0
        while (stop := self.held.find(b"\n", self.at + seen)) < 0:
            seen = len(self.held) - self.at
            if not self.fill():
                return None
        out, self.at = self.held[self.at : stop], stop + 1
        return out.removesuffix(b"\r")

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces, or fewer where bytes end."""
        while n > 0 and (self.at < len(self.held) or self.fill()):
            out = self.held[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out

    def fields(self) -> tuple[dict[str, list[str]], int]:
        """Header lines up to an empty one, and the bytes they took, ends included if those are two each."""
        out: dict[str, list[str]] = {}
        used = 0
        while line := self.line():
            used += len(line) + 2
            name, _, value = line.decode(errors="replace").partition(":")
            out.setdefault(name.strip().lower(), []).append(value.strip())
        return out, used + 2


def parsed(content: bytes, keep: bool) -> Iterator[dict]:
    """The records of a file as rows of RECORD; payloads only if kept."""
    source = Source(content)
    while (line := source.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        head, _ = source.fields()
        length = head.get("content-length", [""])[0]
        if not length.isdecimal():
            continue
        left = int(length)
        kind = head.get("content-type", [""])[0]
        http = kind.startswith("application/http")
        digest, held, n, seen = hashlib.sha1(), [], 0, b""
        fields = kind.startswith("application/warc-fields")
        for piece in source.take(left):
            left -= len(piece)
            if http:  # up to the empty line it's the message's own head
                seen += piece
                if (stop := seen.find(b"\r\n\r\n")) < 0:
                    continue
                piece, http, seen = seen[stop + 4 :], False, b""
            digest.update(piece)
            n += len(piece)
            if keep or fields:
                held.append(piece)
        if left:
            continue
        one = lambda name: head.get(name, [None])[0]  # noqa: B023, E731
        block = b"".join(held)
        yield {
            "record_id": one("warc-record-id"), "type": one("warc-type"), "target": one("warc-target-uri"), "date": one("warc-date"), "concurrent": head.get("warc-concurrent-to", []),
            "refers_target": one("warc-refers-to-target-uri"), "declared": (one("warc-payload-digest") or "").partition("sha1:")[2] or None,
            "fields": [tuple(x.strip() for x in f.decode(errors="replace").split(":", 1)) for f in block.splitlines() if b":" in f] if fields else [],
            "payload_bytes": n, "sha1": digest.hexdigest(), "payload": block if keep else None,
        }


def records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records (RECORD) of all archives below a path."""
    schema = to_arrow_schema(_parse_datatype_string(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for row in parsed(batch.column(0)[k].as_py(), payloads):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def captures(found: DataFrame) -> DataFrame:
    """(capture, requests, metadata): one row for each response, revisit or resource; the members are arrays of records.

    The records are read several times, so hand over stored ones.
    """
    main = found.filter(F.col("type").isin(*CAPTURES))
    rest = found.filter(F.col("type").isin("request", "metadata"))
    heads = main.filter("record_id is not null").select(F.col("record_id").alias("_head"), "concurrent")
    ids = heads.select("_head").distinct()
    named = rest.select(F.col("record_id").alias("_member"), F.explode("concurrent").alias("_to"))
    forward = named.join(ids, F.col("_to") == F.col("_head")).select("_head", "_member")
    backward = heads.select("_head", F.explode("concurrent").alias("_member"))
    direct = forward.unionByName(backward).distinct()
    # they name a member: a request that names the response, say
    through = named.join(direct.select("_head", F.col("_member").alias("_via")), F.col("_to") == F.col("_via")).select("_head", "_member")
    links = direct.unionByName(through).distinct()
    own = links.join(rest, F.col("_member") == F.col("record_id")).withColumn("_row", F.struct(*rest.columns))
    pick = lambda kind: F.collect_list(F.when(F.col("type") == kind, F.col("_row")))
    members = own.groupBy("_head").agg(pick("request").alias("requests"), pick("metadata").alias("metadata"))
    none = lambda name: F.coalesce(name, F.array().cast(members.schema[name].dataType)).alias(name)
    return main.select(F.struct(*main.columns).alias("capture")).join(members, F.col("capture.record_id") == F.col("_head"), "left").select("capture", none("requests"), none("metadata"))


def archived(pages: DataFrame, least: int = 1000, **names) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, written to archives and read back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least=least, **names)
    each = captures(stored(records(spark, path), "records"))
    page = F.try_element_at(F.try_element_at("metadata.fields", F.lit(1)), F.lit("page-id")).cast("long")
    rows = each.select(page.alias("page_id"), F.col("capture.type").alias("record_type"), F.col("capture.payload_bytes").alias("_n"), F.col("capture.sha1").alias("_sha1"), F.col("capture.declared").alias("_declared"))
    rows = stored(rows, "captures")
    first = rows.filter((F.col("record_type") == "response") & (F.col("_n") >= least)).groupBy(F.col("_sha1").alias("_of")).agg(F.max("page_id").alias("_first"), F.max("_n").alias("_bytes"))
    again = rows.filter("record_type = 'revisit'").join(first, F.col("_declared") == F.col("_of"), "left").select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_declared").alias("payload_digest"), "record_type", F.col("_first").alias("refers_to"))
    own = rows.filter("record_type <> 'revisit'").select("page_id", F.col("_n").alias("payload_bytes"), F.col("_sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(again)
