"""Media columns: payloads in tar shards, addressed by their content.

A payload becomes an 8-bit greyscale PNG image of ``width`` samples a row (lossless). Its SHA-256 is
the name of its member in a tar shard; rows carry digest, shard, offset and length and never
the bytes. A task writes each content once into the shard that is open, however many rows have it: a text in very many rows
is stored once for each shard that one of them falls into, and all of these members have the same name. Metadata
columns are filled from the first 33 bytes of a member, read by range; features need the whole one.

Shards are written under names that no other attempt has, and the table of rows lists those of
finished tasks only. It is settled before anything is read, so that a lost executor costs the
reading alone. Null texts count as empty; equal texts have equal media wherever they stand.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm import arrays as A
from causeway.llm.storage import folder, reader
from causeway.runtime import new_folder, settled

HEADER = 33
READ_BYTES = 256 << 20
_START = b"\x89PNG\r\n\x1a\n"


def padded(text: str | None, unit: int = 576, fill: bytes = b"\xff") -> tuple[int, bytes]:
    """The length of the text's UTF-8, and these bytes filled up to a positive multiple of ``unit``."""
    data = (text or "").encode()
    return len(data), data + fill * (-len(data) % unit if data else unit)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = 576) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each begins with its filter, 0: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"".join((_START, _chunk(b"IHDR", head), _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)), _chunk(b"IEND", b"")))


def png_header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample, from the first bytes."""
    if start[:8] != _START or start[12:16] != b"IHDR" or len(start) < HEADER or zlib.crc32(start[12:29]) != struct.unpack(">I", start[29:33])[0]:
        raise ValueError("not the header of a PNG image")
    return struct.unpack(">IIB", start[16:25])


def from_png(media: bytes) -> bytes:
    """The samples of an image as to_png() writes them."""
    width, height, bits = png_header(media[:HEADER])
    at, data = HEADER, []
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged image")
        if kind == b"IDAT":
            data.append(body)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if bits != 8 or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit samples are read")
    return lines[:, 1:].tobytes()


def sample_feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and a 64-bit average hash: which 64ths are lighter than the whole."""
    x = np.frombuffer(payload, np.uint8)
    edges = np.linspace(0, len(x), 65).astype(np.int64)
    sums = np.add.reduceat(x.astype(np.int64), edges[:-1])
    lighter = sums * len(x) > int(sums.sum()) * np.diff(edges)
    return f"{x.mean():.4f}:{x.std():.4f}:{np.packbits(lighter).tobytes().hex()}"


class _Shards:
    """Tar files of one task; a new one begins where the last holds ``size`` bytes."""

    def __init__(self, at: str, size: int):
        (self.fs, self.top), self.size, self.out, self.name, self.offset = folder(at), size, None, "", 0
        self.at: dict[str, tuple[str, int, int]] = {}

    def put(self, media: bytes) -> tuple[str, str, int, int]:
        digest = hashlib.sha256(media).hexdigest()
        if digest not in self.at:
            if self.out is None:
                self.name, self.offset = f"{uuid.uuid4().hex}.tar", 0
                self.out = self.fs.open_output_stream(f"{self.top}/{self.name}")
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + media + b"\0" * (-len(media) % 512))
            place = self.name, self.offset + 512, len(media)
            self.at[digest] = place
            self.offset += 512 + len(media) + -len(media) % 512
            if self.offset >= self.size:
                self.close()
                self.at = {}
            return digest, *place
        return digest, *self.at[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


_ROWS = "media_sha256 string, shard string, media_offset long, media_bytes long, n_bytes long"


def _store(batches: Iterator[pa.RecordBatch], at: str, size: int) -> Iterator[pa.RecordBatch]:
    shards = _Shards(at, size)
    try:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                n, payload = padded(text.as_py())
                rows.append((*shards.put(to_png(payload)), n))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            names = [x.split()[0] for x in _ROWS.split(", ")]
            arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), *(pa.array(c, pa.int64()) for c in columns[2:])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], ["doc_id", *names])
    finally:
        shards.close()


def store(docs: DataFrame, at: str | None = None, shard_bytes: int = 64 << 20) -> tuple[str, DataFrame]:
    """The folder of the shards, and for each row of ``docs`` (doc_id, text) where its payload is."""
    at = at or new_folder(docs.sparkSession, "media")
    A.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(lambda it: _store(it, at, shard_bytes), f"doc_id {kind}, {_ROWS}")
    return at, settled(rows, "media-rows")


def _fetched(rows: DataFrame, at: str, names: list[tuple[str, str]], length: int | None, use: Callable[[bytes, str], tuple], remember: int = 4096) -> DataFrame:
    """``rows`` with columns from the first ``length`` bytes (None: all) of each row's member; equal members are read once in a run."""
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = T.StructType([*(f for f in rows.schema.fields if f.name not in dict(names)), *(T.StructField(a, {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}[b]) for a, b in names)])

    def read(batches):
        with ExitStack() as opened:
            yield from found(batches, opened)

    def found(batches, opened):
        fs, top = reader(at)
        known: OrderedDict[tuple, tuple] = OrderedDict()
        file, name = None, None
        for batch in batches:
            out = []
            for key in zip(*(batch[c].to_pylist() for c in ("shard", "media_offset", "media_bytes", "media_sha256")), strict=True):
                if key not in known:
                    if name != key[0]:
                        opened.close()  # one shard at a time
                        file, name = opened.enter_context(fs.open_input_file(f"{top}/{key[0]}")), key[0]
                    file.seek(key[1])
                    known[key] = use(file.read(key[2] if length is None else length), key[3])
                    if len(known) > remember:
                        known.popitem(last=False)
                out.append(known[key])
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            kept = [c for c in batch.schema.names if c not in dict(names)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *(pa.array(c, arrow[k]) for c, (_, k) in zip(columns, names, strict=True))], [*kept, *(n for n, _ in names)])

    # as many tasks as the members' bytes need, and no fewer than the session's number
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (rows.agg(F.sum("media_bytes")).first()[0] or 0) // READ_BYTES)
    dealt = rows.repartition(n, "shard").sortWithinPartitions("shard", "media_offset")
    return dealt.mapInArrow(read, schema)


def fill_metadata(rows: DataFrame, at: str) -> DataFrame:
    """``rows`` with width, height and bit_depth, by reads of the headers alone."""
    return _fetched(rows, at, [("width", "int"), ("height", "int"), ("bit_depth", "int")], HEADER, lambda start, _: png_header(start))


def _features(media: bytes, digest: str) -> tuple:
    if hashlib.sha256(media).hexdigest() != digest:
        raise ValueError("a member's content isn't what its name says")
    payload = from_png(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), sample_feature(payload)


def features(rows: DataFrame, at: str) -> DataFrame:
    """``rows`` with payload_bytes, payload_sha256, tail_crc32 and feature, from the members read back and checked."""
    return _fetched(rows, at, [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("feature", "string")], None, _features)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store, header reads and features of each row of ``docs``: without the place, which differs from run to run."""
    at, rows = store(docs)
    return features(fill_metadata(rows, at), at).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("width"), F.col("height"), F.col("bit_depth"))
