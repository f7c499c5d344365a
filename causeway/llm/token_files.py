"""Token ids in files of length-delimited binary records with a separate offset index.

A record is the length of its payload (8 bytes, little-endian), the masked CRC-32C of these
8 bytes, the payload and the masked CRC-32C of the payload: the public TFRecord framing. A
payload is the document's id (8 bytes), whether it is null (1), the width of an id in bytes (1) and
the token ids, in 2 bytes each where all of the record's are below 65536, else in 4. The index of a file holds, for each record, its offset, its length, the number of ids
before it in the file and of its own (8 bytes each), so that readers can fetch any record, in any order.

Documents are dealt by ranges of ids, so that files in order hold ascending ids (null ids first,
equal ids ordered by text; the ranges go by the first characters of texts too, so that one id of many texts is many files). A file is written under a name that no other attempt has, and the
table of files lists those of finished tasks only: a lost executor leaves a file that nothing
refers to. Null texts count as empty; ids must be of a whole-number type (ValueError otherwise). Repeated rows are records each; an
empty table gives no files. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm import arrays as A
from causeway.llm.storage import folder, reader
from causeway.llm.tokens import encoder
from causeway.runtime import new_folder, settled

FILE_BYTES = 256 << 20
#: Characters of a text that tell ranges of equal ids apart.
LEAD = 32
_SPAN = 256
_BATCH = 1024
_INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("before", "<u8"), ("ids", "<u8")])
_tables: list[np.ndarray] = []


def _crc_tables() -> list[np.ndarray]:
    """For the byte at each distance from a span's end its share of the sum; for each byte of a sum what it becomes a span later."""
    if not _tables:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0x82F63B78), step >> 1)  # the Castagnoli polynomial, reflected
        shares = np.empty((_SPAN, 256), np.uint32)
        shares[0] = step
        for k in range(1, _SPAN):
            shares[k] = (shares[k - 1] >> 8) ^ step[shares[k - 1] & 0xFF]
        ahead = shares[_SPAN - 4 :][::-1]
        _tables.extend((shares, ahead))
    return _tables


def crc32c(data: bytes) -> int:
    return crc32c_many([data])[0]


def crc32c_many(parts: list[bytes]) -> list[int]:
    """CRC-32C of each part, many spans at a time: the sum is linear, so that bytes contribute by place.

    Leading zeros don't change a sum that begins with 0, so parts are filled up at the front; the
    usual first value is the same as turning the first four bytes.
    """
    shares, ahead = _crc_tables()
    filled, counts = [], []
    for part in parts:
        lead = -len(part) % _SPAN
        filled += (bytes(lead), (int.from_bytes(part[:4], "little") ^ 0xFFFFFFFF).to_bytes(4, "little")[: len(part)], part[4:])
        counts.append((lead + len(part)) // _SPAN)
    data = np.frombuffer(b"".join(filled), np.uint8).reshape(-1, _SPAN)
    place = np.arange(_SPAN - 1, -1, -1, dtype=np.int32) * 256
    sums = np.bitwise_xor.reduce(shares.ravel()[data + place], axis=1).tolist()
    a, b, c, d = (ahead[k].tolist() for k in range(4))
    out, at = [], 0
    for part, n in zip(parts, counts, strict=True):
        crc = 0
        for s in sums[at : at + n]:
            crc = a[crc & 0xFF] ^ b[crc >> 8 & 0xFF] ^ c[crc >> 16 & 0xFF] ^ d[crc >> 24] ^ s
        at += n
        # of fewer than four bytes the rest of the first value is left, moved down
        out.append((crc ^ 0xFFFFFFFF >> 8 * len(part) if len(part) < 4 else crc) ^ 0xFFFFFFFF)
    return out


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    sums = crc32c_many([*heads, *payloads])
    of_heads, of_payloads = sums[: len(heads)], sums[len(heads) :]
    return [b"".join((h, struct.pack("<I", masked(x)), p, struct.pack("<I", masked(y)))) for h, x, p, y in zip(heads, of_heads, payloads, of_payloads, strict=True)]


def frame(payload: bytes) -> bytes:
    return frames([payload])[0]


def unframe_many(records: list[bytes]) -> list[bytes]:
    """The payloads; ValueError if a length or a checksum is wrong."""
    sums = crc32c_many([*(r[:8] for r in records), *(r[12:-4] for r in records)])
    for record, x, y in zip(records, sums[: len(records)], sums[len(records) :], strict=True):
        if struct.unpack_from("<Q", record)[0] != len(record) - 16 or masked(x) != struct.unpack_from("<I", record, 8)[0]:
            raise ValueError("damaged length of a record")
        if masked(y) != struct.unpack("<I", record[-4:])[0]:
            raise ValueError("damaged record")
    return [r[12:-4] for r in records]


def unframe(record: bytes) -> bytes:
    return unframe_many([record])[0]


def _write(batches: Iterator[pa.RecordBatch], at: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, fs, top = encoder(path).encode, *folder(at)
    part, name, index, offset, ids_before = TaskContext.get().partitionId(), "", [], 0, 0
    with ExitStack() as opened:
        out = None
        for batch in batches:
            for k in range(0, len(batch), _BATCH):
                few = batch.slice(k, _BATCH)
                payloads = []
                for doc_id, ids in zip(few["doc_id"].to_pylist(), encode(few["text"].to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    width = 2 if ids.max() < 65536 else 4
                    payloads.append(struct.pack("<q?B", doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes())
                    index.append([0, 0, ids_before, len(ids)])
                    ids_before += len(ids)
                if out is None:
                    name = f"{part:06d}-{uuid.uuid4().hex[:12]}"
                    out = opened.enter_context(fs.open_output_stream(f"{top}/{name}.rec"))
                records = frames(payloads)
                for entry, record in zip(index[-len(records) :], records, strict=True):
                    entry[:2] = offset, len(record)
                    offset += len(record)
                out.write(b"".join(records))
    if out is not None:
        with fs.open_output_stream(f"{top}/{name}.idx") as side:
            side.write(np.array([tuple(x) for x in index], _INDEX).tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "records": [len(index)], "ids": [ids_before], "bytes": [offset]}, _FILES)


_FILES = pa.schema([("part", pa.int64()), ("name", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 0, at: str | None = None) -> tuple[str, DataFrame]:
    """The folder of the files, and a row for each of them in order: part, name, records, ids, bytes, start (ids in the files before it)."""
    spark = docs.sparkSession
    at = at or new_folder(spark, "tokens")
    A.small_batches(spark)
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be a whole number: records hold it in 8 bytes")
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes // FILE_BYTES)  # no file needs more than its share of the text
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id", F.substring("text", 1, LEAD)).sortWithinPartitions("doc_id", "text")
    files = settled(ordered.mapInArrow(lambda it: _write(it, at, tokenizer, end_id), "part long, name string, records long, ids long, bytes long"), "files")
    # one row per file: the running sum is over a few numbers, however long the files are
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return at, settled(files.withColumn("start", F.coalesce(before, F.lit(0).cast("long"))), "files")


def read_records(at: str, name: str, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(number, ids before it in the file, doc_id, ids) of the records ``wanted`` of a file, all by default."""
    fs, top = reader(at)
    with fs.open_input_stream(f"{top}/{name}.idx") as side:
        index = np.frombuffer(side.read(), _INDEX)
    wanted = np.arange(len(index)) if wanted is None else wanted
    with fs.open_input_file(f"{top}/{name}.rec") as file:
        for at in range(0, len(wanted), _BATCH):
            some = wanted[at : at + _BATCH]
            records = []
            for k in some:
                file.seek(int(index["offset"][k]))
                records.append(file.read(int(index["length"][k])))
            for k, payload in zip(some, unframe_many(records), strict=True):
                doc_id, null, width = struct.unpack_from("<q?B", payload)
                yield int(k), int(index["before"][k]), None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def _read(batches: Iterator[pa.RecordBatch], at: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, start in zip(batch["name"].to_pylist(), batch["start"].to_pylist(), strict=True):
            rows = [(doc_id, start + before, len(ids), zlib.crc32(ids.tobytes())) for _, before, doc_id, ids in read_records(at, name)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_summary(at: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, from the files; one task reads some files one after another."""
    n = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), (files.agg(F.sum("bytes")).first()[0] or 0) // FILE_BYTES)
    dealt = files.select("name", "start").repartition(n, "name")
    return dealt.mapInArrow(lambda it: _read(it, at), "doc_id long, start long, n_tokens long, ids_crc32 long")
