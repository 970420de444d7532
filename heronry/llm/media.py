"""Media columns: archives of media members as a Spark data source with byte-range partitions.

`heronry_archive` writes each task's members into ZIP archives (members stored, so a member's bytes stand at one offset) in a
directory of shared storage, and reads such directories: the driver plans byte ranges from the archives' sizes alone, each task
reads an archive's own directory of members, takes those whose header starts in its range, and streams them through Arrow in
batches of bounded bytes. A member that can't be read, or whose CRC differs, is tried again alone from its offset; when all
tries fail, its row carries the error and the other members stand.

Only archives named in a committed manifest are read, so what an attempt left behind when its executor was lost is ignored.

Texts become 8-bit greyscale PNG pictures 64 samples wide. Null text counts as empty (64 zero bytes); null doc_id stays null;
repeated rows become members of their own; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import sys
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from heronry.llm.common import id_and_text, lean, small_batches, table
from heronry.scratch import scratch_path

# Spark plans a Python source in processes that may not know the driver's sys.path: its classes travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 64
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
MEMBERS = "member string, media binary, error string"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def pad64(data: bytes) -> bytes:
    """data with zero bytes appended up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with its filter, 0: none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """Samples of a greyscale picture that encode_png has written; ValueError for anything else."""
    if media[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, data = 8, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR" and struct.unpack(">IIBBBBB", body)[2:] != (8, 0, 0, 0, 0):
            raise ValueError("not 8-bit greyscale")
        data += [body] if kind == b"IDAT" else []
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter is not supported")
    return rows[:, 1:].tobytes()


def picture_feature(samples: np.ndarray) -> str:
    """Mean and spread of the samples, a 16-bin histogram in sixteenths, and a 64-bit difference hash of 8 x 9 block means."""
    bins = np.bincount(samples >> 4, minlength=16)
    share = "".join(f"{x:x}" for x in np.minimum(15, bins * 16 // len(samples)))
    edges = (np.arange(72) * len(samples)) // 72
    sums = np.add.reduceat(samples.astype(np.int64), edges)
    sizes = np.maximum(1, np.diff(np.append(edges, len(samples))))
    means = (sums / sizes).reshape(8, 9)
    bits = np.packbits((means[:, 1:] > means[:, :-1]).ravel()).tobytes().hex()
    return f"mean={samples.mean():.3f};spread={samples.std():.3f};bins={share};diff={bits}"


# --- the archive data source ---------------------------------------------------------------------------------------------


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Committed(WriterCommitMessage):
    files: list


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int

    def __init__(self, file: str, start: int, end: int):
        super().__init__(None)
        self.file, self.start, self.end = file, start, end


class ArchiveSource(DataSource):
    """Options: path; max_archive_bytes (a new archive begins beyond it); range_bytes (size of a planned range); tries."""

    @classmethod
    def name(cls) -> str:
        return "heronry_archive"

    def schema(self) -> str:
        return MEMBERS

    def writer(self, schema, overwrite: bool):
        return ArchiveWriter(self.options)

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.most = options["path"].rstrip("/"), int(options.get("max_archive_bytes", 128 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, archive, sink, number = [], None, None, 0
        for batch in iterator:
            for member, media in zip(batch.column("member"), batch.column("media"), strict=True):
                if archive is None:
                    name = f"part-{uuid.uuid4().hex}.zip"
                    sink = fs.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(_Counting(sink), "w", zipfile.ZIP_STORED)
                    files.append(name)
                archive.writestr(zipfile.ZipInfo(f"{number:08d}/{member.as_py()}"), media.as_py())
                number += 1
                if archive.fp.tell() > self.most:
                    archive.close()
                    sink.close()
                    archive = None
        if archive is not None:
            archive.close()
            sink.close()
        return Committed([(name, fs.get_file_info(f"{root}/{name}").size) for name in files])

    def commit(self, messages) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([entry for m in messages if m for entry in m.files]).encode())

    def abort(self, messages) -> None:
        fs, root = _filesystem(self.path)
        for name, _ in (entry for m in messages if m for entry in m.files):
            fs.delete_file(f"{root}/{name}")


class _Counting(io.RawIOBase):
    """A forward-only stream that knows its position, as the ZIP writer wants it."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0

    def write(self, data) -> int:
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def flush(self) -> None:
        pass


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.range_bytes, self.tries = int(options.get("range_bytes", 32 << 20)), int(options.get("tries", 3))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))

    def partitions(self) -> list[ByteRange]:
        fs, root = _filesystem(self.path)
        out = []
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("manifest-"):
                with fs.open_input_stream(info.path) as f:
                    for name, size in json.loads(f.read()):
                        out += [ByteRange(name, at, min(size, at + self.range_bytes)) for at in range(0, size, self.range_bytes)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, root = _filesystem(self.path)
        path = f"{root}/{partition.file}"
        with fs.open_input_file(path) as f:
            members = [x for x in zipfile.ZipFile(f).infolist() if partition.start <= x.header_offset < partition.end]
        source, rows, held = _Source(fs, path), [], 0
        for info in members:
            media, error = read_member(source, info, self.tries)
            rows.append((info.filename, media, error))
            held += len(media or b"")
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)
        source.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    member, media, error = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(member, pa.string()), pa.array(media, pa.binary()), pa.array(error, pa.string())], names=["member", "media", "error"])


class _Source:
    """An archive's bytes by offset, read in blocks; `reset` forgets the open file, so the next read opens it anew."""

    def __init__(self, fs, path: str, block: int = 1 << 20):
        self.fs, self.path, self.block, self.file, self.at, self.held = fs, path, block, None, 0, b""

    def get(self, at: int, size: int) -> bytes:
        if not self.at <= at <= at + size <= self.at + len(self.held):
            if self.file is None:
                self.file = self.fs.open_input_file(self.path)
            self.held, self.at = self.file.read_at(max(size, self.block), at), at
        return self.held[at - self.at : at - self.at + size]

    def reset(self) -> None:
        self.close()
        self.held = b""

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def read_member(source, info: zipfile.ZipInfo, tries: int) -> tuple[bytes | None, str | None]:
    """The member's bytes, or the last error after `tries` reads from its offset."""
    error = None
    for _ in range(max(1, tries)):
        try:
            head = source.get(info.header_offset, 30)
            if head[:4] != b"PK\x03\x04":
                raise OSError("no member header at the offset")
            name, extra = struct.unpack_from("<HH", head, 26)
            data = source.get(info.header_offset + 30 + name + extra, info.file_size)
            if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                raise OSError("the member's bytes are short or differ from its checksum")
            return data, None
        except Exception as err:  # noqa: BLE001  whatever the store raises, the member is tried again alone
            error = f"{type(err).__name__}: {err}"
            source.reset()
    return None, error


# --- texts as pictures -----------------------------------------------------------------------------------------------------


def write_pictures(docs: DataFrame, path: str, most: int = 4 << 20) -> None:
    """Store every text as a picture; a member's name holds doc_id (empty: null) and the text's bytes."""

    def members(names, media):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], names=["member", "media"])

    def encode(batches):
        for batch in batches:
            names, media, held = [], [], 0
            for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                data = text.as_buffer().to_pybytes()
                names.append(f"{'' if key.as_py() is None else key.as_py()}_{len(data)}.png")
                media.append(encode_png(pad64(data)))
                held += len(media[-1])
                if held >= most:  # a batch of texts leaves in parts of bounded bytes
                    yield members(names, media)
                    names, media, held = [], [], 0
            if names:
                yield members(names, media)

    small_batches(docs.sparkSession)
    docs.sparkSession.dataSource.register(ArchiveSource)
    id_and_text(docs).mapInArrow(lean(encode), "member string, media binary").write.format("heronry_archive").mode("append").save(path)


def read_members(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows (member, media, error) of all archives in a directory."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("heronry_archive").options(**options).load(path)


def picture_features(members: DataFrame) -> DataFrame:
    """Features of stored pictures; an unreadable member gives nulls and its error."""

    def describe(batches):
        for batch in batches:
            rows = []
            for member, media, error in zip(batch.column("member"), batch.column("media"), batch.column("error"), strict=True):
                key, _, size = member.as_py().rpartition("/")[2].removesuffix(".png").rpartition("_")
                row, stored = [int(key) if key else None, int(size)], media.as_py()
                try:
                    if stored is None:
                        raise ValueError(error.as_py())
                    payload = decode_png(stored)
                    row += [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), picture_feature(np.frombuffer(payload, np.uint8)), None]
                except (ValueError, zlib.error) as err:
                    row += [None] * 6 + [str(err)]
                rows.append(row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return members.mapInArrow(lean(describe), FEATURES)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    write_pictures(table(spark, sf_dir, "documents"), path)
    return picture_features(read_members(spark, path))
