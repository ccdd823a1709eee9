"""Media columns (operator 3): content-addressed payloads in tar shards.

A payload is a text's bytes, filled up with bytes 255 to a whole number of 576; it is stored as a grey picture of 8-bit
samples, 576 in a line, in PNG. Each task writes tar shards into the shared folder, each different payload once, named
by its SHA-256. Rows carry digest, shard, offset and length; of the same payload in several shards the first place is
everyone's. Reading is by range: the header alone fills the metadata columns (width, height, bits), a second range
gives the stored bytes, from which payload and features come. No text is shuffled; a retried task writes shards of
other names, and those that no row names are never read.

Null text: as an empty one, one line of 255s. Equal texts have equal values. Whole texts are stored, of any length."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

#: Samples in a line.
LINE = 576
SHARD_BYTES = 256 << 20
# What the formats fix.
_PNG, _TAR = b"\x89PNG\r\n\x1a\n", 512
_HEADER = 33


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\xff" * ((-len(data)) % LINE or (0 if data else LINE))


def picture(payload: bytes) -> bytes:
    """The payload as a grey PNG, 8 bits a sample, no filter."""

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    lines = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    raw = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes()
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def header_of(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first bytes of a picture."""
    if data[:8] != _PNG:
        raise ValueError("no picture is stored there")
    return struct.unpack(">IIB", data[16:25])


def samples(data: bytes) -> bytes:
    """The payload of a whole stored picture."""
    width, height, _ = header_of(data)
    packed, at = [], 8
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def difference_hash(payload: bytes) -> str:
    """64 bits as hex: the payload in 8 rows of 9 cells, a bit for each cell that is darker than the next one."""
    cells = np.frombuffer(payload, np.uint8).reshape(8, 9, -1).sum(axis=2, dtype=np.int64)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


class Shards:
    """Writes payloads into tar files of about SHARD_BYTES below a folder, each digest once."""

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.stream, self.known = None, {}

    def put(self, digest: bytes, payload: bytes) -> tuple[str, int, int]:
        if digest not in self.known:
            data = picture(payload)
            if self.stream is None or self.stream.tell() > SHARD_BYTES:
                self.close()
                self.name = f"{uuid.uuid4().hex}.tar"
                self.stream = self.files.open_output_stream(f"{self.folder}/{self.name}")
            entry = tarfile.TarInfo(f"{digest.hex()}.png")
            entry.size = len(data)
            self.stream.write(entry.tobuf(tarfile.USTAR_FORMAT))
            self.known[digest] = self.name, self.stream.tell(), len(data)
            self.stream.write(data + bytes(-len(data) % _TAR))
        return self.known[digest]

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(bytes(2 * _TAR))
            self.stream.close()


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """key, n_bytes, digest, shard, offset and length of each row, and the folder of the shards."""
    folder = scratch(docs.sparkSession, "media-shards")
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path)
        shards = Shards(folder)
        for b in batches:
            columns: list[list] = [[] for _ in range(5)]
            for t in b.column(1).to_pylist():
                payload = payload_of(t)
                digest = hashlib.sha256(payload).digest()
                for c, v in zip(columns, (len((t or "").encode()), digest, *shards.put(digest, payload)), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[key, "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return stored(src.mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, digest binary, shard string, offset bigint, length bigint"), "media-rows"), folder


def places(rows: DataFrame) -> DataFrame:
    """digest (its bytes) and the first of the places where it is stored."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


_META = "width int, height int, bits int"
_FEATURES = "payload_bytes bigint, tail_crc32 bigint, media_sha256 binary, feature string"


def _read(found: DataFrame, folder: str, schema: str, of) -> DataFrame:
    """digest, shard, offset, length and what of(file, offset, length) gives, one shard's places together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder)
        name, f = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                d, out = b.to_pydict(), []
                for digest, shard, offset, length in zip(d["digest"], d["shard"], d["offset"], d["length"], strict=True):
                    if shard != name:
                        if f is not None:
                            f.close()
                        name, f = shard, files.open_input_file(f"{path}/{shard}")
                    out.append(of(f, digest, offset, length))
                values = [pa.array([x[i] for x in out]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*b.columns, *(v.cast(k) for v, k in zip(values, kinds, strict=True))], names=["digest", "shard", "offset", "length", *names])

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    ordered = found.select("digest", "shard", "offset", "length").repartition("shard").sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(run, f"digest binary, shard string, offset bigint, length bigint, {schema}")


def _header(f, digest: bytes, offset: int, length: int) -> tuple:
    return header_of(f.read_at(_HEADER, offset))


def _whole(f, digest: bytes, offset: int, length: int) -> tuple:
    meta = _header(f, digest, offset, length)
    data = f.read_at(length, offset)
    payload = samples(data)
    read = hashlib.sha256(payload).digest()
    if read != digest:
        raise ValueError(f"the payload {digest.hex()} reads back as {read.hex()}")
    return *meta, len(payload), zlib.crc32(payload[-32:]), hashlib.sha256(data).digest(), difference_hash(payload)


def headers(found: DataFrame, folder: str) -> DataFrame:
    """places with width, height and bits: only the headers are read."""
    return _read(found, folder, _META, _header)


def features(found: DataFrame, folder: str) -> DataFrame:
    """places with the metadata and what the stored bytes give."""
    return _read(found, folder, f"{_META}, {_FEATURES}", _whole)


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, the features, the metadata, and shard, offset and length of each row."""
    rows, folder = store(docs, key, text)
    found = stored(features(places(rows), folder), "media-features")
    hexed = lambda c: F.lower(F.hex(c))
    both = rows.select(key, "n_bytes", "digest").join(found, "digest")
    return both.select(
        key, "n_bytes", "payload_bytes", hexed("digest").alias("payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), hexed("media_sha256").alias("media_sha256"), "feature",
        "shard", "offset", "length", "width", "height", "bits",
    )
