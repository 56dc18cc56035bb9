"""WARC archives compressed with Zstandard: a dictionary frame first, then one frame per record.

An archive is one row (path, content), the shape of Spark's binaryFile source, so .warc.zst files on disk (up to the
2 GB that source can hold in a row) and archives kept in a table are read alike. Those written here have a bounded size;
archives are written and read in parallel. Records of others are read by their type: HTTP responses and revisits have
their HTTP header taken off; the block of all other records (warcinfo, request, metadata, resource, ...) is the payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Magic numbers of the skippable frame that holds the dictionary, of a Zstandard frame, and of any skippable frame but
#: for its last four bits (fixed by the formats).
DICT_MAGIC, FRAME_MAGIC, SKIPPABLE = 0x184D2A5D, 0xFD2FB528, 0x184D2A50
ARCHIVE_BYTES, DICT_BYTES, MIN_REVISIT = 8 << 20, 16 << 10, 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
ARCHIVE = "path string, content binary"
RECORD = "path string, record int, record_id string, page_id long, record_type string, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to long, error string"


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record. A revisit has the HTTP header alone; its Content-Length is the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if payload is None else http + payload
    head = {
        "WARC-Type": "response" if payload is not None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join((url or "").splitlines()).strip(),
        "WARC-Payload-Digest": f"sha-256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if payload is None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": PROFILE}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def pack_archive(records: list[bytes], dict_bytes: int = DICT_BYTES, level: int = 3) -> bytes:
    """Records as one archive. Too few records to train a dictionary: none is written, as the format allows."""
    head, trained = b"", None
    if len(records) >= 16:
        try:
            trained = zstandard.train_dictionary(dict_bytes, records, k=64, d=8)
        except zstandard.ZstdError:
            trained = None
    if trained:
        body = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
        head = struct.pack("<II", DICT_MAGIC, len(body)) + body
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    return head + b"".join(packer.compress(r) for r in records)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at `at` ends: its header, its blocks, its checksum."""
    p = zstandard.get_frame_parameters(data[at : at + 18])
    end = at + zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        if end + 3 > len(data):
            raise ValueError("frame is cut off")
        block = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        end += 3 + (1 if kind == 1 else size)
    end += 4 * p.has_checksum
    if end > len(data):
        raise ValueError("frame is cut off")
    return end


def archive_records(content: bytes) -> Iterator[tuple[bytes, str | None]]:
    """Each record's bytes, or b"" and what is wrong with the frame. Nothing can be read behind a broken frame."""
    data, at, trained = memoryview(content), 0, None
    try:
        if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
            size = struct.unpack_from("<I", data, 4)[0]
            if 8 + size > len(data):
                raise ValueError("dictionary frame is cut off")
            raw, at = bytes(data[8 : 8 + size]), 8 + size
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                raw = zstandard.ZstdDecompressor().decompress(raw)
            trained = zstandard.ZstdCompressionDict(raw)
        unpacker = zstandard.ZstdDecompressor(dict_data=trained)
        while at < len(data):
            if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] & ~15 == SKIPPABLE:
                at += 8 + struct.unpack_from("<I", data, at + 4)[0]
                continue
            end = frame_end(data, at)
            p = zstandard.get_frame_parameters(data[at : at + 18])
            if p.dict_id and (trained is None or trained.dict_id() != p.dict_id):
                raise ValueError("frame needs another dictionary")
            yield unpacker.decompressobj().decompress(data[at:end]), None
            at = end
    except (ValueError, zstandard.ZstdError) as e:
        yield b"", f"archive: {e}"


def fields_of(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-cased name; a line that starts with white space goes on with the one before."""
    joined: list[bytes] = []
    for line in lines:
        if line[:1] in (b" ", b"\t") and joined:
            joined[-1] += b" " + line.strip()
        else:
            joined.append(line)
    split = (x.decode("utf-8", "replace").partition(":") for x in joined)
    return {k.strip().lower(): v.strip() for k, _, v in split}


def digest_differs(stated: str | None, *data: bytes) -> bool:
    """Whether a digest like sha1:BASE32 or sha-256:hex is that of none of data. Unknown algorithms say nothing."""
    name, sep, value = (stated or "").partition(":")
    name = name.lower().replace("-", "")
    if not sep or name not in ("md5", "sha1", "sha256", "sha512"):
        return False
    for x in data:
        found = hashlib.new(name, x)
        if value.lower() == found.hexdigest() or value.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("="):
            return False
    return True


def dechunked(body: bytes) -> bytes | None:
    """The content of a chunked HTTP body, or None if it is not chunked."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip()
        if end < 0 or not size or size.strip(b"0123456789abcdefABCDEF"):
            return None
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def parse_record(raw: bytes) -> dict:
    """The record's fields; error says what fails: version, headers, lengths, digest."""
    out: dict = {"error": None}
    head, sep, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not sep or not version.startswith(b"WARC/1."):
        return out | {"error": "no WARC version line or end of headers"}
    fields = fields_of(lines)
    if missing := [k for k in NEEDED if not fields.get(k)]:
        return out | {"error": f"missing {', '.join(missing)}"}
    length, kind = fields["content-length"], fields["warc-type"].lower()
    if not length.isascii() or not length.isdigit() or str(len(rest) - 4) != (length.lstrip("0") or "0") or rest[-4:] != b"\r\n\r\n":
        return out | {"error": "Content-Length is not the block's length"}
    block, digest = rest[:-4], fields.get("warc-payload-digest")
    out |= {"record_type": kind, "target_uri": fields.get("warc-target-uri"), "record_id": fields["warc-record-id"]}
    number = lambda x: int(x) if (x := (x or "").removeprefix("<urn:page:").removesuffix(">")).lstrip("-").isdigit() and x.isascii() else None
    out |= {"page_id": number(fields["warc-record-id"]), "refers_to": number(fields.get("warc-refers-to"))}
    out["payload_digest"] = digest.removeprefix("sha-256:") if digest else None
    if digest_differs(fields.get("warc-block-digest"), block):
        return out | {"error": "block digest differs"}
    if kind == "revisit":
        if not (fields.get("warc-refers-to") or fields.get("warc-refers-to-target-uri") or digest):
            return out | {"error": "revisit refers to nothing"}
    elif kind != "response" or not fields.get("content-type", "application/http").lower().startswith("application/http"):
        if digest_differs(digest, block):
            return out | {"error": "payload digest differs"}
        return out | {"payload": block, "payload_bytes": len(block)}
    http, sep, body = block.partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    if kind == "revisit" and not block:
        return out
    if not sep or not status.startswith(b"HTTP/"):
        return out | {"error": "no HTTP header"}
    header = fields_of(lines)
    stated = header.get("content-length")
    if stated is not None and not (stated.isascii() and stated.isdigit()):
        return out | {"error": "HTTP Content-Length is no number"}
    if kind == "revisit":
        out["payload_bytes"] = None if stated is None else int(stated)
        return out | {"error": "revisit with a payload"} if body else out
    content = dechunked(body) if "chunked" in header.get("transfer-encoding", "").lower() else None
    payload = body if content is None else content
    out["payload_bytes"] = len(payload)
    if stated is not None and int(stated) != len(body) and content is None and not fields.get("warc-truncated"):
        return out | {"error": "HTTP Content-Length is not the payload's length"}
    if digest_differs(digest, payload, body):
        return out | {"error": "payload digest differs"}
    return out | {"payload": payload}


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """records: page_id, url, payload (null in revisits), payload_bytes, payload_digest, refers_to -> archives."""

    def pack(batches):
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                held.append(record_bytes(*r))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"path": [f"part-{part:05d}-{n:05d}.warc.zst"], "content": [pack_archive(held)]}, _schema(ARCHIVE))
                    n, held, size = n + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"path": [f"part-{part:05d}-{n:05d}.warc.zst"], "content": [pack_archive(held)]}, _schema(ARCHIVE))

    columns = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
    return records.select(*columns).mapInArrow(pack, ARCHIVE)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """archives (path, content), as from spark.read.format("binaryFile") -> one row per record.

    A record that fails has its reason in error and what could be read elsewhere; callers decide whether to stop (see
    checked()). page_id and refers_to are set for records written here, record_id always. payload_digest is as stated,
    but for a bare hexadecimal SHA-256. A chunked response is put together. Null and empty contents have no records.
    """

    def read(batches):
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                rows: list[dict] = []
                size = 0
                for i, (raw, error) in enumerate(archive_records(content.as_py() or b"")):
                    rows.append({"path": path.as_py(), "record": i} | ({"error": error} if error else parse_record(raw)))
                    if not payloads:
                        rows[-1].pop("payload", None)
                    size += len(raw) if payloads else 100
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _schema(RECORD))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _schema(RECORD))

    return archives.select("path", "content").mapInArrow(read, RECORD)


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """pages (page_id, url, html) as records to write.

    Of equal payloads of at least `least` bytes that with the smallest page_id stays a response, the others revisit
    it. Rows that repeat one page_id: all rows with the smallest id stay responses. Null html is an empty payload.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = common.stored(first.where("n > 1"))
    joined = common.heavy_join(rows, first, ["payload_digest"], F.col("page_id"))
    again = F.coalesce((F.col("n") > 1) & (F.col("page_id") > F.col("first")), F.lit(False))
    return joined.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(again, F.col("first")).alias("refers_to"))


def checked(records: DataFrame) -> DataFrame:
    """records; the job fails on a record that does not validate."""
    return records.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(" ", "path", "record", "error")).cast("boolean")).otherwise(F.lit(True)))


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = common.stored(write_archives(with_revisits(pages)), compression="uncompressed")
    records = checked(read_archives(archives, payloads=False))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
