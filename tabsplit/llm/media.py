"""Media columns: a Spark data source over archives of images, and the columns that are read back from them.

Texts are stored losslessly as 8-bit grey samples: bytes padded with 0 to a positive multiple of 64 become a PNG image
64 pixels wide. Images are members of ZIP archives, uncompressed there, so that any one can be read by its offset.

Writing: each task streams its rows into archives of its own; the commit lists the archives of successful tasks in a
manifest, so that files of failed or repeated attempts are never read.
Reading: the plan cuts each archive into byte ranges, whatever its number of members. A task reads its archive's
directory, takes the members whose offset lies in its range, and streams them in Arrow batches of bounded bytes. Each
member is checked and retried alone, at its own offset, through a new handle; one that cannot be read gives a row with
`error` set, and the others are not affected.

Defined results: null texts count as empty (one row of 64 zeros), long texts make high images, equal texts make equal
images, rows may repeat and doc_id may be null, an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MANIFEST = "_manifest.json"
FORMAT = "image_archive"
#: Bytes of an archive before the next is begun, of one planned range, and of one Arrow batch; attempts at a member.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, ATTEMPTS = 256 << 20, 16 << 20, 4 << 20, 3
MEMBER_SCHEMA = "doc_id long, media binary, error string"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(text: bytes) -> bytes:
    """A grey PNG whose samples are the bytes and their padding; its n_bytes text entry tells how many were given."""
    padded = text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))
    rows = np.frombuffer(padded, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"n_bytes\0%d" % len(text)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + chunk(b"IEND", b"")


def decode_image(media: bytes) -> tuple[np.ndarray, int]:
    """The samples of such an image, row by row, and the number of bytes before padding."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, parts, given = 8, [], -1
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            parts.append(data)
        elif kind == b"tEXt" and data.startswith(b"n_bytes\0"):
            given = int(data[8:])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(-1, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not written here")
    return lines[:, 1:].reshape(-1), given


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def members(path: str) -> list[zipfile.ZipInfo]:
    """An archive's directory, read from its end, by offset."""
    store, name = place(path)
    with store.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
        return sorted(archive.infolist(), key=lambda x: x.header_offset)


def read_member(path: str, info: zipfile.ZipInfo, opened: list) -> bytes:
    """One member by its offset; `opened` holds the handle, which is replaced on each retry."""
    for attempt in range(ATTEMPTS):
        try:
            if not opened:
                store, name = place(path)
                opened.append(store.open_input_file(name))
            opened[0].seek(info.header_offset)
            head = opened[0].read(30)
            if head[:4] != b"PK\x03\x04":
                raise OSError(f"no member at {info.header_offset}")
            opened[0].seek(info.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
            data = opened[0].read(info.file_size)
            if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                raise OSError(f"the member at {info.header_offset} is damaged")
            return data
        except OSError:
            while opened:
                opened.pop().close()
            if attempt + 1 == ATTEMPTS:
                raise
    raise AssertionError


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archives: list


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Range]:
        store, name = place(self.folder)
        with store.open_input_stream(f"{name}/{MANIFEST}") as file:
            listed = json.loads(file.read())
        return [Range(f"{self.folder}/{x}", k, min(k + RANGE_BYTES, size)) for x, size in listed for k in range(0, size, RANGE_BYTES)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        held, opened, size = [], [], 0
        for info in members(partition.path):
            if not partition.start <= info.header_offset < partition.end:
                continue
            told = info.filename.rsplit("/", 1)[1].removesuffix(".png")
            try:
                held.append((None if told == "null" else int(told), read_member(partition.path, info, opened), None))
            except OSError as error:
                held.append((None if told == "null" else int(told), None, str(error)))
            size += info.file_size
            if size >= BATCH_BYTES:
                yield self.batch(held)
                held, size = [], 0
        if held:
            yield self.batch(held)
        while opened:
            opened.pop().close()

    @staticmethod
    def batch(held: list) -> pa.RecordBatch:
        ids, media, errors = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary()), pa.array(errors, pa.string())], ["doc_id", "media", "error"])


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, name = place(self.folder)
        store.create_dir(name, recursive=True)
        done, archive, file, own, k = [], None, None, "", 0

        def close() -> None:
            if archive:
                archive.close()
                done.append((own, file.tell()))
                file.close()

        for batch in iterator:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None or file.tell() >= ARCHIVE_BYTES:
                    close()
                    own, k = f"{uuid.uuid4().hex}.zip", 0
                    file = store.open_output_stream(f"{name}/{own}")
                    archive = zipfile.ZipFile(file, "w", zipfile.ZIP_STORED, allowZip64=True)
                info = zipfile.ZipInfo(f"{k:08d}/{'null' if doc_id is None else doc_id}.png")
                archive.writestr(info, encode_image((text or "").encode()))
                k += 1
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, name = place(self.folder)
        store.create_dir(name, recursive=True)
        with store.open_output_stream(f"{name}/{MANIFEST}") as file:
            file.write(json.dumps(sorted(x for m in messages if m for x in m.archives)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files of a failed job stay unlisted."""


class ImageArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make format("image_archive") known; the classes travel by value, so that planning needs no import path."""
    import tabsplit.llm.media as own

    cloudpickle.register_pickle_by_value(own)
    try:
        spark.dataSource.register(ImageArchive)
    finally:
        cloudpickle.unregister_pickle_by_value(own)


def write_archive(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text") -> None:
    register(docs.sparkSession)
    docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).write.format(FORMAT).mode("append").save(folder)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, media and error of every member."""
    register(spark)
    return spark.read.format(FORMAT).load(folder)


def feature(samples: np.ndarray) -> str:
    """Size, mean and deviation of the samples, the share of changes along the rows, and a histogram of 8 bins."""
    x = samples.astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    bins = np.bincount(samples >> 5, minlength=8)
    change = int(np.abs(np.diff(x)).sum())
    return f"{WIDTH}x{n // WIDTH} mean={total / n:.4f} var={(squares * n - total * total) / (n * n):.4f} change={change / n:.4f} bins={','.join(map(str, bins.tolist()))}"


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of the payload that each image holds; a row without media keeps its error."""

    def one(doc_id: int | None, stored: bytes | None, error: str | None) -> tuple:
        if stored is None:
            return (doc_id, None, None, None, None, None, None, None, error)
        digest = hashlib.sha256(stored).hexdigest()
        try:
            samples, given = decode_image(stored)
        except (ValueError, zlib.error, struct.error) as bad:
            return (doc_id, None, None, None, None, len(stored), digest, None, str(bad))
        payload = samples.tobytes()
        return (doc_id, given, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), digest, feature(samples), None)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURE_SCHEMA.split(", ")]
        for batch in batches:
            rows = [one(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "media", "error")), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("doc_id", "media", "error").mapInArrow(run, FEATURE_SCHEMA)
