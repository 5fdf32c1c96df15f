"""Token ids as length-delimited binary records with masked checksums, and a separate offset index.

A data file is a run of records ``length (u64) | masked crc32 of the 8 length bytes (u32) | payload | masked crc32 of
the payload (u32)``, all little-endian. The mask rotates a checksum right by 15 bits and adds a constant, so that a
checksum stored inside other checksummed data does not look like one. A payload is one serialised sequence:
``flags (u8: 1 = no doc_id) | id width (u8: 2 or 4 bytes) | doc_id (i64) | count (u32) | ids``.

The index file beside it has one entry per record, ``doc_id (i64) | offset (u64) | length (u64) | count (u64)``, and
a masked crc32 at its end; readers that shuffle seek by it without reading the data file through.

Files hold documents in ascending doc_id order (null first): rows are range-partitioned on doc_id before they are
encoded, so file k ends where file k + 1 starts. Tasks write through ``pyarrow.fs``, batch by batch, under a new name
per attempt; only files named in the manifest table (written by Spark's own commit) count, so lost or repeated tasks
leave nothing behind that a reader would see. The folder must be on storage that all executors share.

Nulls: a null text is an empty sequence (the end id alone); a null doc_id is written with flag 1. Repeated rows are
records of their own, ordered by a hash of the text. Empty tables write no file. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.llm.common import prepare, scratch_folder, write_table
from textlake.llm.tokens import encoder as encoder_of

# Fixed values of the file format.
MASK_DELTA = 0xA282EAD8
HEAD, PAYLOAD, ENTRY, CRC = struct.Struct("<Q"), struct.Struct("<BBqI"), struct.Struct("<qQQQ"), struct.Struct("<I")

MANIFEST = "part long, path string, index string, n_records long, n_tokens long, n_bytes long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = HEAD.pack(len(payload))
    return b"".join((head, CRC.pack(masked(head)), payload, CRC.pack(masked(payload))))


def serialise(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One sequence; two bytes per id where all ids fit."""
    width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    return PAYLOAD.pack(doc_id is None, width, doc_id or 0, len(ids)) + ids.astype(f"<u{width}").tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, width, doc_id, n = PAYLOAD.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=PAYLOAD.size)
    if len(ids) != n:
        raise ValueError("record count does not match its payload")
    return (None if flags & 1 else doc_id), ids.astype("<u4")


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file URI as Spark writes it (``file:/x`` too)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_frame(stream) -> bytes | None:
    """The next payload, checked; None at the end of the file. A damaged record raises."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    rest = stream.read(CRC.size)
    if len(rest) != CRC.size or CRC.unpack(rest)[0] != masked(head):
        raise ValueError("damaged record length")
    n = HEAD.unpack(head)[0]
    payload, rest = stream.read(n), stream.read(CRC.size)
    if len(payload) != n or len(rest) != CRC.size or CRC.unpack(rest)[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    store, base = open_fs(folder)
    data = index = None
    part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
    path, at, n_tokens, entries, encoder = f"{base}/part-{part:06d}-{name}.rec", 0, 0, [], None
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        if data is None:
            store.create_dir(base, recursive=True)
            data, encoder = store.open_output_stream(path), encoder_of(tokenizer)
        ids_of = encoder.encode(batch.column(1))
        for doc_id, raw in zip(batch.column(0).to_pylist(), ids_of, strict=True):
            ids = np.frombuffer(raw + end, "<u4")
            record = frame(serialise(doc_id, ids))
            data.write(record)
            entries.append(ENTRY.pack(doc_id or 0, at, len(record), len(ids)))
            at, n_tokens = at + len(record), n_tokens + len(ids)
    if data is None:
        return
    data.close()
    body = b"".join(entries)
    with store.open_output_stream(path[:-4] + ".idx") as index:
        index.write(body + CRC.pack(masked(body)))
    yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "index": path[:-4] + ".idx", "n_records": len(entries),
                                       "n_tokens": n_tokens, "n_bytes": at}])


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode and write ``docs (doc_id, text)``; returns the manifest, one row per data file in doc_id order."""
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or scratch_folder(spark, "records")
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
               .repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")))
    return write_table(ordered.mapInArrow(lambda it: _write(it, folder, tokenizer, end_id), MANIFEST), "manifest")


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in frames:
        for path, start in zip(files["path"], files["start"], strict=True):
            store, where = open_fs(path)
            with store.open_input_stream(where, buffer_size=1 << 20) as stream:
                rows, at, held = [], int(start), 0
                while (payload := read_frame(stream)) is not None:
                    doc_id, ids = parse(payload)
                    rows.append((doc_id, at, len(ids), ids.tobytes()))
                    at, held = at + len(ids), held + len(payload)
                    if held > 8_000_000:
                        yield _frame(rows)
                        rows, held = [], 0
                yield _frame(rows)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
    return out.assign(doc_id=pd.array([r[0] for r in rows], "Int64"))


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.assign(ids_crc32=[zlib.crc32(x) for x in f["ids"]]).drop(columns="ids")


def _files(manifest: DataFrame) -> DataFrame:
    """Manifest with each file's first token position, a file or a few per task. Numbered over files, not documents."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return files.repartition(max(1, manifest.count()), "part")


def read_records(manifest: DataFrame) -> DataFrame:
    """Every sequence read back from its file and checked: ``(doc_id, start, n_tokens, ids)``, ids as u32 bytes."""
    return _files(manifest).select("path", "start").mapInPandas(
        _read, "doc_id long, start long, n_tokens long, ids binary")


def record_digests(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files; ids stay in the task that read them."""
    return _files(manifest).select("path", "start").mapInPandas(
        lambda it: _digests(_read(it)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in frames:
        for path, index in zip(files["path"], files["index"], strict=True):
            store, where = open_fs(index)
            with store.open_input_stream(where) as stream:
                raw = stream.read()
            if CRC.unpack(raw[-4:])[0] != masked(raw[:-4]):
                raise ValueError("damaged index")
            got = np.frombuffer(raw[:-4], np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("length", "<i8"),
                                                    ("n_tokens", "<i8")]))
            yield pd.DataFrame(got).assign(path=path)


def _seek(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for path, part in f.groupby("path", sort=False):
            store, where = open_fs(path)
            with store.open_input_file(where) as file:
                for offset, pos in zip(part["offset"], part["pos"], strict=True):
                    file.seek(int(offset))
                    doc_id, ids = parse(read_frame(file))
                    rows.append((doc_id, pos, len(ids), ids.tobytes()))
        yield _frame(rows).rename(columns={"start": "pos"})


def read_shuffled(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """Sequences in a seeded random order, ``(doc_id, pos, n_tokens, ids)`` with ``pos`` the place's sort key.

    Only the index is shuffled; each task then seeks its own records. Rows are range-partitioned on ``pos``.
    """
    index = manifest.select("path", "index").repartition(max(1, manifest.count())).mapInPandas(
        _index, "doc_id long, offset long, length long, n_tokens long, path string")
    placed = index.withColumn("pos", F.xxhash64("path", "offset", F.lit(seed)))
    return placed.repartitionByRange("pos").select("path", "offset", "pos").mapInPandas(
        _seek, "doc_id long, pos long, n_tokens long, ids binary")


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` and return the digests of what the files hold."""
    return record_digests(write_records(docs, tokenizer or default_tokenizer()))
