"""A deterministic sharded WARC writer, and its reader.

Writing.  Digests are taken in the plan; of equal payloads the record with the smallest id is the response, all others
revisit it and carry no payload.  Records are sorted by range: shard bounds are quantiles of the keys with the smallest hashes, so
the same records give the same shards whatever the cluster or the partitioning.  A task writes its shard's
records, each a gzip member of its own, under temporary names and begins a new file when the one before has reached
its compressed size.  What a task has written is a row (file, records, bytes, digest) of a table that Spark commits, so that
files of lost or repeated attempts are in nobody's table.  A second job gives the files their names, which can be
repeated, and the manifest, a Parquet table written last, is the commit: readers open the files it lists and no others.

Reading.  A task a file streams its members, checks lengths and digests of blocks, payloads and files, and gives a row a record.

Files are opened through pyarrow's file systems: local and mounted folders, HDFS, S3 and others by their URI.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import discard, masked, ready, scratch, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SHARD_BYTES = 512 << 20  # payload bytes of a shard, before compression
SHARDS = 32  # at least, so that small inputs are spread too
ROLL_BYTES = 128 << 20  # compressed bytes after which a file is closed
KEYS = 64  # sampled keys a shard, a million at most; they place bounds and leave no record out
SMALLEST = 100  # payloads of fewer bytes are never revisits
FIRSTS = 1_000_000  # repeated payloads that are sent to all tasks; with more they are joined by digest
PIECE = 1 << 20  # bytes read at a time

WRITTEN = "shard int, part int, temporary string, file string, records long, bytes long, sha256 string"


def file_at(path: str):
    """(pyarrow file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if re.match(r"file:/(?!//)", path):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# Records


def record_id(page_id: int | None, digest: str, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def uri(url: str | None, page_id: int | None) -> str:
    """A URL that fits into a header line: control characters and spaces as percent escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def digest_label(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=").lower()


def render(page_id, url, digest: str, size: int, payload: bytes | None, refers_to, date: str) -> bytes:
    """A record with headers made anew; without a payload it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        ("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest, url)), ("WARC-Date", date),
        ("WARC-Target-URI", uri(url, page_id)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", digest_label(block)), ("X-Payload-Length", size),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if url is not None:
        head.append(("X-Page-Url", base64.b64encode(url.encode()).decode()))
    if payload is None:
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", refers_to)]
    return "WARC/1.1\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


class Inflow:
    """The members of a gzip file as one stream; counts and hashes what was read of the file."""

    def __init__(self, source):
        self.source, self.buffer, self.inflate, self.rest = source, bytearray(), zlib.decompressobj(31), b""
        self.sha, self.bytes = hashlib.sha256(), 0

    def _more(self) -> bool:
        data = self.rest or self.source.read(PIECE)
        if not self.rest:
            self.sha.update(data)
            self.bytes += len(data)
        self.rest = b""
        if not data:
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.buffer += self.inflate.decompress(data)
        self.rest = self.inflate.unused_data
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end of the file."""
        seen = 0
        while (i := self.buffer.find(mark, max(seen - len(mark), 0))) < 0:
            seen = len(self.buffer)
            if not self._more():
                if self.buffer:
                    raise ValueError("a record is cut off")
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("a record is cut off")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(stream: Inflow):
    """(headers by lower-case name, block) of each record; ValueError where a length or a digest is wrong."""
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        block = stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        if fields.get("warc-block-digest", digest_label(block)) != digest_label(block):
            raise ValueError(f"{fields.get('warc-record-id')}: the block does not have its digest")
        yield fields, block


# Writing


def _shard_of(bounds: list[str]):
    """The shard of a key; where a key equals several bounds, its rows are dealt over the shards that these begin."""
    first = np.array(bounds, object)

    @F.pandas_udf("int")
    def shard(key: pd.Series, place: pd.Series) -> pd.Series:
        k = key.to_numpy(object)
        lo, hi = np.searchsorted(first, k, "left"), np.searchsorted(first, k, "right")
        return pd.Series(np.where(hi > lo, lo + 1 + place.to_numpy(np.int64) % np.maximum(hi - lo, 1), lo).astype(np.int32))

    return shard


def _key() -> Column:
    """A text that sorts like (page_id, digest, url), null ids first."""
    signed = F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.coalesce(signed, F.lit("")), F.lit(" "), F.col("digest"), F.lit(" "), F.sha2(F.coalesce("url", F.lit("")).cast("binary"), 256))


def _writer(folder: str, roll: int, date: str):
    def run(frames):
        fs, base = file_at(folder)
        sink = name = shard = None
        count = size = part = 0
        sha = None

        def close():
            sink.close()
            return pd.DataFrame([(shard, part, name, f"shard-{shard:06d}-{part:04d}.warc.gz", count, size, sha.hexdigest())], columns=["shard", "part", "temporary", "file", "records", "bytes", "sha256"])

        for f in frames:
            for s, i, known, url, digest, n, payload, first, revisit in zip(
                f["shard"], f["page_id"], f["known"], f["url"], f["digest"], f["payload_bytes"], f["payload"], f["first"], f["revisit"]
            ):
                if sink is not None and (s != shard or size >= roll):
                    yield close()
                    part, sink = (part + 1 if s == shard else 0), None
                if sink is None:
                    shard, name, count, size, sha = int(s), f"{uuid.uuid4().hex}.warc.gz", 0, 0, hashlib.sha256()
                    sink = fs.open_output_stream(f"{base}/_temporary/{name}", compression=None)
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                text = render(int(i) if known else None, url, digest, int(n), None if revisit else bytes(payload), int(first), date)
                data = deflate.compress(text) + deflate.flush()
                sink.write(data)
                sha.update(data)
                count, size = count + 1, size + len(data)
        if sink is not None:
            yield close()

    return run


def _renamed(folder: str):
    def run(frames):
        fs, base = file_at(folder)
        for f in frames:
            for temporary, name in zip(f["temporary"], f["file"]):
                if fs.get_file_info(f"{base}/_temporary/{temporary}").is_file:  # else an attempt before has done it
                    fs.move(f"{base}/_temporary/{temporary}", f"{base}/{name}")
            yield f.drop(columns="temporary")

    return run


def _narrow(rows: DataFrame) -> DataFrame:
    """page_id, payload_bytes, digest and key of each row, written: what places and kinds of records depend on."""
    return written(rows.select("page_id", "payload_bytes", "digest", _key().alias("key")), "keys")


def _firsts(keys: DataFrame) -> DataFrame:
    """(digest, first): the smallest id of each payload that repeats and is not too small."""
    firsts = keys.where(f"payload_bytes >= {SMALLEST}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return written(firsts.where("n > 1 and first is not null").select("digest", "first"), "firsts")


def write_warc(
    pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, shards: int = SHARDS, roll_bytes: int = ROLL_BYTES, date: str = "1970-01-01T00:00:00Z"
) -> str:
    """Writes (page_id, url, html) as WARC files under a folder that all executors share; returns the folder.

    A null html is an empty payload, a null url is named by the id.  Rows of one id and one payload are all responses where that
    id is the smallest with that payload; a null id is never the smallest; where all ids are null all are
    responses.  Files are the same byte for byte for the same rows, except that rows which are equal in everything may change
    shards.  An empty table gives an empty manifest.  A folder that has a manifest is refused.
    """
    spark = pages.sparkSession
    ready(spark)
    fs, base = file_at(folder)
    if fs.get_file_info(f"{base}/manifest/_SUCCESS").is_file:
        raise FileExistsError(f"{folder} has a manifest")
    fs.create_dir(f"{base}/_temporary", recursive=True)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    keys = _narrow(rows)
    n = max(shards, -(-(keys.agg(F.sum("payload_bytes")).first()[0] or 0) // shard_bytes))
    sample = sorted(r["key"] for r in keys.select("key").orderBy(F.xxhash64("key"), "key").limit(min(KEYS * n, 1_000_000)).collect())
    bounds = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []
    firsts = _firsts(keys)
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    rows = rows.join(F.broadcast(firsts) if firsts.count() <= FIRSTS else firsts, "digest", "left").withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    rows = rows.withColumn("key", _key())
    rows = rows.withColumn("shard", _shard_of(bounds)("key", F.monotonically_increasing_id()))
    ready_rows = rows.select(
        "shard", F.coalesce("page_id", F.lit(0)).alias("page_id"), F.col("page_id").isNotNull().alias("known"), "url", "digest", "payload_bytes",
        F.when(~F.col("revisit"), F.col("payload")).alias("payload"), F.coalesce("first", F.lit(0)).alias("first"), "revisit", "key",
    )
    sorted_rows = ready_rows.repartition(n, "shard").sortWithinPartitions("shard", "key")
    files = written(sorted_rows.drop("key").mapInPandas(_writer(folder, roll_bytes, date), WRITTEN), "files")
    named = files.repartition("temporary").mapInPandas(_renamed(folder), WRITTEN.replace("temporary string, ", ""))
    named.write.mode("overwrite").parquet(f"{folder}/manifest")
    fs.delete_dir(f"{base}/_temporary")
    discard(files, keys, firsts)
    return folder


# Reading

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string, file string, number long"


def _reader(folder: str, payloads: bool):
    def rows(fs, base, f):
        with fs.open_input_stream(f"{base}/{f.file}", compression=None) as source:
            stream, count = Inflow(source), 0
            for fields, block in records(stream):
                kind, body = fields["warc-type"], block.partition(b"\r\n\r\n")[2]
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response":
                    size, found = len(body), hashlib.sha256(body).hexdigest()
                    if found != digest:
                        raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
                else:
                    size = int(fields["x-payload-length"])
                url = fields.get("x-page-url")
                yield (
                    int(fields.get("x-page-id", 0)), "x-page-id" in fields, base64.b64decode(url).decode() if url is not None else None, kind, int(fields.get("x-refers-to-page-id", 0)),
                    kind == "revisit", size, digest, body if payloads and kind == "response" else None, fields["warc-record-id"], f.file, count,
                )
                count += 1
            if (count, stream.bytes, stream.sha.hexdigest()) != (f.records, f.bytes, f.sha256):
                raise ValueError(f"{f.file} is not the file of the manifest")

    def framed(batch):
        i, known, url, kind, refers, revisit, size, digest, payload, rid, file, number = (pd.Series(x) for x in zip(*batch))
        return pd.DataFrame({
            "page_id": masked(i.astype("int64"), known), "url": url, "record_type": kind, "refers_to": masked(refers.astype("int64"), revisit), "payload_bytes": size,
            "payload_digest": digest, "payload": payload, "record_id": rid, "file": file, "number": number,
        })

    def run(frames):
        fs, base = file_at(folder)
        for frame in frames:
            for f in frame.itertuples():
                batch, held = [], 0
                for r in rows(fs, base, f):
                    batch.append(r)
                    held += len(r[8] or b"") + 500
                    if held >= 8 << 20:
                        yield framed(batch)
                        batch, held = [], 0
                if batch:
                    yield framed(batch)

    return run


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row a record of the files that the manifest lists; revisits have no payload of their own.

    A file that is not as the manifest says, or a record that is not as its headers say, is an error.
    """
    ready(spark)
    files = spark.read.schema(WRITTEN.replace("temporary string, ", "")).parquet(f"{folder}/manifest")
    n = max(1, min(files.count(), 100_000))
    return files.repartition(n, "file").mapInPandas(_reader(folder, payloads), RECORDS)


def archive_digest(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each row, read back from archives written for it."""
    spark = pages.sparkSession
    folder = write_warc(pages, scratch(spark, "warc"))
    return read_warc(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
