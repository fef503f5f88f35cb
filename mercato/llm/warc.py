"""Deterministic sharded WARC archives.

Records are cut into shards by ranges of their id, each of about the same
number of bytes, and sorted within; the cuts come from exact byte counts, so
they are the same in every run. A task writes a shard as files of one gzip
member per record and starts a new file when the compressed size is reached.
A file is written under a temporary name of the attempt and renamed when it is whole. Its
content depends on the records alone, so a repeated task writes the same bytes
under the same name; a file that is there stays, and no whole file is ever deleted. The manifest is a table that Spark commits at the end; only files it
lists are archives.

Headers, record ids and digests are made anew from the records. Files are written with
pyarrow's file systems: a local or shared path, hdfs or s3.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import utf8

SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
#: Payloads of this many bytes or more are stored once.
REVISIT_BYTES = 100
#: Bytes that a record takes besides its payload, about.
HEADER_BYTES = 600
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TEMPORARY = "_temporary-"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "file string, shard bigint, records bigint, bytes bigint, sha256 string"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def store_at(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


# --- shards -----------------------------------------------------------------


@dataclass
class Shards:
    """Upper ends of id ranges, and into how many parts each range is dealt by digest.

    Only a range of one id has several parts. Range 0 is that of null ids.
    """

    ends: list[int] = field(default_factory=list)
    parts: list[int] = field(default_factory=lambda: [1])

    @property
    def count(self) -> int:
        return sum(self.parts)

    def number(self):
        """An Arrow function from (id, digest number) to the shard."""
        ends, parts = np.array(self.ends, np.int64), np.array(self.parts, np.int64)
        first = np.concatenate([[0], np.cumsum(parts)[:-1]])

        @F.arrow_udf("bigint")
        def run(ids: pa.Array, digests: pa.Array) -> pa.Array:
            given = np.asarray(ids.is_valid())
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            places = np.where(given, 1 + np.searchsorted(ends, values), 0)
            return pa.array(first[places] + digests.to_numpy(zero_copy_only=False) % parts[places])

        return run


def plan_shards(sizes: DataFrame, target: int) -> Shards:
    """Shards of about ``target`` bytes for rows of (id, size).

    Byte counts are exact. Ranges of equal width are counted first, and a range
    with too many bytes is divided again, until it is small enough or one id. The
    driver sees a few counts for each shard.
    """
    plan = Shards()
    whole = sizes.agg(
        F.min("id").alias("low"),
        F.max("id").alias("high"),
        F.sum("size").alias("size"),
        F.sum(F.when(F.col("id").isNull(), F.col("size"))).alias("null"),
    ).first()
    plan.parts[0] = max(1, -(-int(whole["null"] or 0) // target))
    if whole["low"] is None:
        return plan
    total = int(whole["size"]) - int(whole["null"] or 0)
    ranges = [(int(whole["low"]), int(whole["high"]), total)]
    while heavy := [r for r in ranges if r[2] > target and r[0] < r[1]]:
        done = [r for r in ranges if not (r[2] > target and r[0] < r[1])]
        case, widths = F.lit(None).cast("int"), []
        for k, (low, high, size) in enumerate(heavy):
            pieces = 8 * (size // target + 1)
            widths.append(max(1, -(-(high - low + 1) // pieces)))
            case = F.when(F.col("id").between(low, high), k).otherwise(case)
        lows = F.array(*[F.lit(str(r[0])).cast("decimal(20,0)") for r in heavy])
        steps = F.array(*[F.lit(str(w)).cast("decimal(20,0)") for w in widths])
        counted = (
            sizes.withColumn("k", case)
            .filter(F.col("k").isNotNull())
            .withColumn(
                "at",
                F.call_function(
                    "div", F.col("id").cast("decimal(20,0)") - F.get(lows, F.col("k")), F.get(steps, F.col("k"))
                ),
            )
            .groupBy("k", "at")
            .agg(F.sum("size").alias("size"))
            .collect()
        )
        ranges = done
        for row in counted:
            low, high, _ = heavy[row["k"]]
            start = low + int(row["at"]) * widths[row["k"]]
            ranges.append((start, min(high, start + widths[row["k"]] - 1), int(row["size"])))
    held = 0
    for low, high, size in sorted(ranges):
        if plan.ends and held and (held + size > target or size > target):
            held = 0
        if held:
            plan.ends[-1] = high
        else:
            plan.ends.append(high)
            plan.parts.append(max(1, -(-size // target)) if low == high else 1)
        held += size
        if size > target:
            held = 0
    # Ids above the last end cannot occur, but a search must land somewhere.
    plan.ends[-1] = (1 << 63) - 1
    return plan


# --- records ------------------------------------------------------------------


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}:{digest}')}>"


def _line(value: str) -> str:
    """A header value: blanks and controls percent-encoded, so that it stays one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One record as a gzip member; the same input gives the same bytes."""
    head = "".join(f"{name}: {value}\r\n" for name, value in headers)
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def page_record(page, url, payload: bytes, digest: str, original, is_revisit: bool, date: str, level: int) -> bytes:
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if is_revisit else http + payload
    # A revisit of the same page, repeated, needs another id than the page's own record.
    name = record_id(page, f"revisit:{digest}" if is_revisit else digest)
    headers = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", name),
        ("WARC-Date", date),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", _line(url)))
    headers += [
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page is not None:
        headers.append(("X-Page-Id", str(page)))
    if is_revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original, digest))]
        if original is not None:
            headers.append(("X-Refers-To-Page-Id", str(original)))
    return record(headers, block, level)


class Roller:
    """Writes the files of a shard one after another."""

    def __init__(self, folder: str, attempt: str, roll_bytes: int, date: str, level: int):
        self.fs, self.path = store_at(folder)
        self.attempt, self.roll_bytes, self.date, self.level = attempt, roll_bytes, date, level
        self.shard, self.number, self.file = None, 0, None

    def add(self, shard: int, member: bytes) -> Iterator[dict]:
        """Append a record; gives the manifest rows of files that this completes."""
        if shard != self.shard:
            yield from self.close()
            self.shard, self.number = shard, 0
        elif self.file is not None and self.size >= self.roll_bytes:
            yield from self.close()
        if self.file is None:
            self._open()
        self._put(member)
        self.records += 1

    def _open(self) -> None:
        self.name = f"shard-{self.shard:08d}-{self.number:05d}.warc.gz"
        self.number += 1
        self.temporary = f"{self.path}/{TEMPORARY}{self.name}-{self.attempt}"
        self.file = self.fs.open_output_stream(self.temporary, compression=None)
        self.size, self.records, self.sha = 0, 0, hashlib.sha256()
        info = f"software: mercato\r\nformat: WARC File Format 1.1\r\nisPartOf: shard-{self.shard:08d}\r\n"
        headers = [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", record_id(None, self.name)),
            ("WARC-Date", self.date),
            ("WARC-Filename", self.name),
            ("Content-Type", "application/warc-fields"),
        ]
        self._put(record(headers, info.encode(), self.level))

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> Iterator[dict]:
        if self.file is None:
            return
        self.file.close()
        self.file = None
        final = f"{self.path}/{self.name}"
        there = self.fs.get_file_info(final)
        if there.type == arrow_fs.FileType.NotFound:
            self.fs.move(self.temporary, final)
        elif there.size == self.size:
            # Another attempt was first. Attempts write the same bytes, so its file stays.
            self.fs.delete_file(self.temporary)
        else:
            raise OSError(f"{final} is not of this archive")
        yield {
            "file": self.name,
            "shard": self.shard,
            "records": self.records,
            "bytes": self.size,
            "sha256": self.sha.hexdigest(),
        }


def _writer(folder: str, roll_bytes: int, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        roller = Roller(folder, f"{task.taskAttemptId()}", roll_bytes, date, level)
        schema = pa.schema(
            [("file", pa.string()), ("shard", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
        )
        mark, taken = None, False
        for batch in batches:
            done = []
            for shard, page, digest, original, url, payload in zip(*batch.columns):
                page, digest, original, payload = page.as_py(), digest.as_py(), original.as_py(), payload.as_py()
                if payload is None:  # a mark: the records of this id and payload have copies
                    mark, taken = (page, digest, original), False
                    continue
                copied = mark is not None and mark[:2] == (page, digest)
                if copied:
                    original = mark[2]
                # Of rows with the response's id and payload the first in order is the response.
                first = not copied or (page == original and not taken)
                taken = taken or first
                member = page_record(page, url.as_py(), payload, digest, original, not first, date, level)
                done += roller.add(shard.as_py(), member)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        done = list(roller.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    date: str = DATE,
    level: int = 6,
) -> DataFrame:
    """Write a record per row and return the manifest, see the module.

    Null html is an empty payload; a null url or id leaves its header out. Of
    equal payloads of ``REVISIT_BYTES`` or more, the one with the smallest id is a
    response and the others refer to it; repeated ids count in the order of
    their urls, null ids after all others. An empty table gives an empty manifest. Other columns are left out.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), utf8(html).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    size = F.length("payload") + HEADER_BYTES
    shards = plan_shards(pages.select(F.col(f"`{id}`").cast("bigint").alias("id"), utf8(html).alias("payload")).select("id", size.alias("size")), shard_bytes)
    part = F.conv(F.substring("digest", 1, 12), 16, 10).cast("bigint")
    shard = shards.number()(F.col("id"), part).alias("shard")
    copies = (
        rows.filter(F.length("payload") >= REVISIT_BYTES)
        .select("id", "digest")
        .withColumn("spread", F.xxhash64("digest"))
    )
    originals = copies.groupBy("digest").agg(F.min("id").alias("original"), F.count("*").alias("n"))
    originals = originals.filter(F.col("n") > 1).select("digest", "original", F.xxhash64("digest").alias("spread"))
    # Payloads are shuffled once. What a payload's row must know of its copies travels as
    # a mark without payload, which sorts before the rows of its id and digest. The
    # second key asks for a fresh shuffle, so a hot digest can be split.
    marks = copies.distinct().join(originals, ["digest", "spread"])
    none = F.lit(None)
    ordered = (
        rows.select(shard, "id", "digest", none.cast("bigint").alias("original"), "url", "payload")
        .unionByName(
            marks.select(
                shard, "id", "digest", "original", none.cast("string").alias("url"), none.cast("binary").alias("payload")
            )
        )
        .repartitionByRange(shards.count, "shard")
        .sortWithinPartitions("shard", "id", "digest", F.col("payload").isNotNull(), "url")
    )
    store, path = store_at(folder)
    store.create_dir(path)
    ordered.mapInArrow(_writer(folder, roll_bytes, date, level), MANIFEST).write.parquet(f"{folder}/manifest")
    # What attempts that died have left.
    for left in store.get_file_info(arrow_fs.FileSelector(path)):
        if left.base_name.startswith(TEMPORARY):
            store.delete_file(left.path)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


# --- reading ------------------------------------------------------------------


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, unpacked one at a time."""
    rest = stream.read(size)
    while rest:
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest:
                rest = stream.read(size)
                if not rest:
                    raise EOFError("the archive ends within a record")
            out.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        yield b"".join(out)
        if not rest:
            rest = stream.read(size)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, body[: int(headers["Content-Length"])]


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_at(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for file, sha256 in zip(batch.column("file").to_pylist(), batch.column("sha256").to_pylist()):
                with store.open_input_stream(f"{path}/{file}", compression=None) as raw:
                    source = _Hashed(raw)
                    rows, held = [], 0
                    for member in members(source):
                        headers, block = parse(member)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_row(headers, block))
                        held += len(block)
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield packed(rows)
                            rows, held = [], 0
                    if rows:
                        yield packed(rows)
                    if source.sha.hexdigest() != sha256:
                        raise ValueError(f"{file} differs from its manifest")

    return run


class _Hashed:
    """A stream that hashes what is read."""

    def __init__(self, stream):
        self.stream, self.sha = stream, hashlib.sha256()

    def read(self, size: int) -> bytes:
        data = self.stream.read(size)
        self.sha.update(data)
        return data


def _row(headers: dict[str, str], block: bytes) -> tuple:
    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"{headers['WARC-Record-ID']} differs from its block digest")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    length = int(headers["X-Payload-Length"])
    payload = None
    if headers["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
    page, original = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
    return (
        None if page is None else int(page),
        headers.get("WARC-Target-URI"),
        length,
        digest,
        headers["WARC-Type"],
        None if original is None else int(original),
        payload,
    )


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The page records of the files that the manifest lists, checked against their digests.

    A revisit has no payload; its length and digest are those of the payload it stands for.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    spread = manifest.select("file", "sha256").repartition("file")
    return spread.mapInArrow(_reader(folder), RECORD)
