"""Token ids as length-delimited binary records with a separate offset index.

A data file is a run of records::

    u64 length | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload

all little-endian; the mask rotates right by 15 and adds 0xA282EAD8, so that a
checksum over data that holds checksums stays sound. A payload is a 16-byte
header (u8 1 if there is an id, u8 bytes a token id, 6 zero bytes, i64 id) and
the ids, in 2 bytes each if the vocabulary allows, else 4. The index file beside
it holds, for each record, u64 offset and u64 number of ids, then a masked
CRC-32 of all that; a reader can seek to any record, so records can be read in
any order.

Documents are range-partitioned by id; each task writes one data file under a
name of its own and reports it in a manifest, and only files of the manifest
are ever read. A task that is run again leaves an unlisted file and no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .store import new_path, stage, width

_MASK = 0xA282EAD8
_HEAD = struct.Struct("<BB6xq")


def masked(data) -> int:
    return _mask(zlib.crc32(data))


def _mask(c: int) -> int:
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data, at: int = 0) -> tuple[memoryview, int]:
    """(payload, place after the record); ValueError if a length or checksum is wrong."""
    view = memoryview(data)
    if len(view) < at + 12:
        raise ValueError("a record is cut short")
    (size,), (check,) = struct.unpack_from("<Q", view, at), struct.unpack_from("<I", view, at + 8)
    if masked(view[at : at + 8]) != check:
        raise ValueError("a record's length is damaged")
    end = at + 12 + size
    if len(view) < end + 4:
        raise ValueError("a record is cut short")
    payload = view[at + 12 : end]
    if masked(payload) != struct.unpack_from("<I", view, end)[0]:
        raise ValueError("a record's payload is damaged")
    return payload, end + 4


def pack(doc_id: int | None, ids: np.ndarray, wide: int) -> bytes:
    return _HEAD.pack(doc_id is not None, wide, doc_id or 0) + ids.astype(f"<u{wide}").tobytes()


def unpack(payload) -> tuple[int | None, np.ndarray]:
    has, wide, doc_id = _HEAD.unpack_from(payload, 0)
    return (doc_id if has else None), np.frombuffer(payload, f"<u{wide}", offset=_HEAD.size)


def native_uri(uri: str) -> str:
    """A folder that Spark names, as pyarrow names it."""
    scheme, colon, rest = uri.partition(":")
    if scheme == "file" and not rest.startswith("///"):
        uri = "file:///" + rest.lstrip("/")
    elif scheme in ("s3a", "s3n"):
        uri = "s3:" + rest
    elif scheme in ("wasb", "wasbs", "abfs"):
        uri = "abfss:" + rest.replace(".blob.", ".dfs.", 1)
    elif not colon:
        uri = "file://" + uri
    return uri


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(native_uri(uri))


class _File:
    """A data file and its index, written side by side."""

    def __init__(self, path: str, part: int):
        self.fs, self.folder = filesystem(path)
        self.fs.create_dir(self.folder, recursive=True)
        self.name = f"{part:05d}-{uuid.uuid4().hex}"
        self.records, self.index = (self.fs.open_output_stream(f"{self.folder}/{self.name}{end}") for end in (".rec", ".idx"))
        self.size = self.n_docs = self.n_tokens = self.crc = 0

    def add(self, records: list[bytes], counts: np.ndarray) -> None:
        for r in records:
            self.records.write(r)
        lengths = np.array([len(r) for r in records], np.int64)
        body = np.stack([self.size + np.cumsum(lengths) - lengths, counts], axis=1).astype("<u8").tobytes()
        self.index.write(body)
        self.crc = zlib.crc32(body, self.crc)
        self.size, self.n_docs, self.n_tokens = self.size + int(lengths.sum()), self.n_docs + len(records), self.n_tokens + int(counts.sum())

    def close(self) -> None:
        self.records.close()
        self.index.write(struct.pack("<I", _mask(self.crc)))
        self.index.close()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, file_bytes: int = 256 << 20) -> DataFrame:
    """Write ``docs`` below ``path`` in ascending order of id; return the manifest (part, number, file, n_docs, n_tokens).

    Null text is empty and gives the end id alone; a null id comes first. Rows
    that repeat an id stay together, ordered by their text. An empty table
    gives an empty manifest. Each of ``files`` tasks goes on to a new file when
    one has ``file_bytes``; ``number`` is the file's among its task's.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(files or width(spark), "id").sortWithinPartitions("id", "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, number, wide = TaskContext.get().partitionId(), None, 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.record_batch({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "file": [out.name], "n_docs": pa.array([out.n_docs], pa.int64()), "n_tokens": pa.array([out.n_tokens], pa.int64())})

        for batch in batches:
            if not wide:
                vocabulary = tokens.encoder(tokenizer).tokenizer.get_vocab_size()
                wide = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
            for rows, ids, first in tokens.encoded(batch, "text", tokenizer):
                if out is not None and out.size >= file_bytes:
                    yield done()
                    out, number = None, number + 1
                out = out or _File(path, part)
                of = zip(rows.column("id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True)
                out.add([frame(pack(doc_id, np.append(ids[a:b], np.uint32(end_id)), wide)) for doc_id, a, b in of], np.diff(first) + 1)
        if out is not None:
            yield done()

    return stage(rows.mapInArrow(put, "part int, number int, file string, n_docs long, n_tokens long"), "token-manifest")


#: Index entries that are read at once.
_ENTRIES = 1 << 14


def read(spark: SparkSession, path: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every record of the listed files.

    Every length and checksum is verified, and the index against the data. The
    manifest has one row a file; only it comes to the driver.
    """
    listed, first = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (r.part, r.number)):
        listed.append((r.file, first, r.n_docs))
        first += r.n_tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not listed:
        return spark.createDataFrame([], schema)

    def records(name: str, base: int, n_docs: int) -> Iterator[tuple]:
        fs, folder = filesystem(path)
        with fs.open_input_stream(f"{folder}/{name}.idx") as entries, fs.open_input_stream(f"{folder}/{name}.rec") as f:
            at = crc = 0
            for k in range(0, n_docs, _ENTRIES):
                body = entries.read(16 * min(_ENTRIES, n_docs - k))
                crc = zlib.crc32(body, crc)
                for offset, n in np.frombuffer(body, "<u8").reshape(-1, 2).astype(np.int64).tolist():
                    if offset != at:
                        raise ValueError(f"the index of {name} doesn't fit its data")
                    size = f.read(12)
                    length = struct.unpack_from("<Q", size)[0] if masked(size[:8]) == struct.unpack_from("<I", size, 8)[0] else -1
                    payload, _ = unframe(size + f.read(length + 4)) if length >= 0 else unframe(size)
                    doc_id, ids = unpack(payload)
                    if len(ids) != n:
                        raise ValueError(f"the index of {name} doesn't fit its data")
                    ids = ids.astype("<u4")
                    yield doc_id, base, n, zlib.crc32(ids), ids if with_ids else None
                    base, at = base + n, at + length + 16
            if entries.read() != struct.pack("<I", _mask(crc)):
                raise ValueError(f"the index of {name} is damaged")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 64 if with_ids else 10_000
        for batch in batches:
            for row in batch.to_pylist():
                found = records(row["file"], row["first"], row["n_docs"])
                while out := list(islice(found, most)):
                    yield _rows(out, with_ids)

    files = spark.createDataFrame(listed, "file string, first long, n_docs long").repartition(len(listed))
    return files.mapInArrow(get, schema)


def _rows(out: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
    if with_ids:
        arrays.append(pa.array([c.astype(np.int32) for c in cols[4]], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)


def read_at(path: str, name: str, offset: int) -> tuple[int | None, np.ndarray]:
    """(id, ids) of the record at ``offset`` of one file, by a seek: what a shuffled reader does."""
    fs, folder = filesystem(path)
    with fs.open_input_file(f"{folder}/{name}.rec") as f:
        size = f.read_at(12, offset)
        return unpack(unframe(size + f.read_at(struct.unpack_from("<Q", size)[0] + 4, offset + 12))[0])


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, **named) -> DataFrame:
    """Write ``docs`` to ``path`` (a new folder of the shared one if none is given) and read the files back."""
    path = path or new_path(docs.sparkSession, "token-records")
    return read(docs.sparkSession, path, write(docs, path, tokenizer, end_id, **named))
