"""Token ids in binary files with Elias-Fano coded document boundaries.

A file holds consecutive documents of the ascending ``doc_id`` order: a head, the
Elias-Fano code of the document ids, that of the boundaries (n + 1 offsets into
the ids) and the concatenated ids, 16 bits each if the vocabulary allows it.

Files are bounded (``file_ids``; a longer document has a file of its own). Tasks
write them whole under a final name that depends only on the task's range, so a
repeated task replaces a file by the same bytes. One manifest row per file comes
back; global offsets are sums over the manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantaint.llm.batches import keep_texts
from quantaint.llm.elias_fano import EliasFano
from quantaint.llm.tokens import encoder, token_bytes
from quantaint.sources.store import fresh_path

FILE_IDS = 4_000_000
# Documents of a file that are read at once.
READ_DOCS = 4096
_MAGIC = b"QTOK"
_HEAD = struct.Struct("<4sBBHQQqII")
_VERSION = 1
_MANIFEST = "part long, seq long, n_docs long, n_ids long"
_DOCS = "part long, seq long, place long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def pack_file(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One file's bytes. ``ids``: little-endian 32-bit ids of each document; null ids come first."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], dtype=np.int64)
    lowest = int(known[0]) if len(known) else 0
    names = EliasFano.encode(known - lowest).to_bytes()
    sizes = [len(x) // 4 for x in ids]
    borders = EliasFano.encode(np.cumsum([0, *sizes])).to_bytes()
    flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(f"<u{width}")
    head = _HEAD.pack(
        _MAGIC, _VERSION, width, 0, len(ids), nulls, lowest, len(names), len(borders)
    )
    return b"".join((head, names, borders, flat.tobytes()))


class TokenFile:
    """A file's documents; ``ids(i)`` reads one of them through ``select``."""

    def __init__(self, data: bytes):
        magic, version, width, _, self.n_docs, nulls, lowest, names, borders = _HEAD.unpack_from(data)
        if magic != _MAGIC or version != _VERSION:
            raise ValueError("not a token file")
        view = memoryview(data)
        at = _HEAD.size
        known = EliasFano.from_bytes(view[at : at + names]).decode() + lowest
        self.doc_ids: list[int | None] = [None] * nulls + known.tolist()
        self.borders = EliasFano.from_bytes(view[at + names : at + names + borders])
        self.flat = np.frombuffer(view[at + names + borders :], dtype=f"<u{width}")

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.borders.select(i) : self.borders.select(i + 1)]


def write_token_files(
    documents: DataFrame, tokenizer: str, end_id: int, folder: str, file_ids: int = FILE_IDS
) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, write files; the manifest is returned.

    Documents are ordered by ``doc_id`` (nulls first), repeated ids by text. A null
    text counts as empty and yields the end id alone. Only ``doc_id`` and ``text`` are read.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = 2 if max(encode.size, end_id + 1) <= 1 << 16 else 4
        end = token_bytes(end_id)
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            _replace(folder, f"{part:08d}-{seq:08d}.qtok", pack_file(names, ids, width))
            row = {"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_ids": [held]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            texts = batch.column("text")
            for name, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                got = encode.encode(text.as_py()) + end
                if ids and held + len(got) // 4 > file_ids:
                    yield flush()
                    names, ids, held, seq = [], [], 0, seq + 1
                names.append(name)
                ids.append(got)
                held += len(got) // 4
        if ids:
            yield flush()

    return keep_texts(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


def _replace(folder: str, name: str, data: bytes) -> None:
    """Write under another name, then move: readers never see half a file."""
    store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        fs.LocalFileSystem(),
        folder,
    )
    store.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{root}/{name}")


def file_starts(manifest: DataFrame) -> DataFrame:
    """(part, seq, file_start): ids in all files before each file.

    Only one row per task meets in a single window; files are summed within their task.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "part").select(
        "part",
        "seq",
        (F.col("part_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("file_start"),
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of all files: its place, ids' checksum and local offset.

    Boundaries come from ``select``; no table of a file's offsets is built.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.qtok")
        .load(folder)
        .select(
            F.regexp_extract("path", r"(\d+)-\d+\.qtok$", 1).cast("long").alias("part"),
            F.regexp_extract("path", r"\d+-(\d+)\.qtok$", 1).cast("long").alias("seq"),
            "content",
        )
    )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, content in zip(*batch.columns, strict=True):
                held = TokenFile(content.as_buffer())
                for first in range(0, held.n_docs, READ_DOCS):
                    last = min(first + READ_DOCS, held.n_docs)
                    borders = [held.borders.select(i) for i in range(first, last + 1)]
                    spans = list(zip(borders[:-1], borders[1:], strict=True))
                    n = last - first
                    columns = [
                        [part.as_py()] * n,
                        [seq.as_py()] * n,
                        list(range(first, last)),
                        held.doc_ids[first:last],
                        borders[:-1],
                        [b - a for a, b in spans],
                        [zlib.crc32(held.flat[a:b].astype("<u4")) for a, b in spans],
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in columns],
                        names=[x.split()[0] for x in _DOCS.split(", ")],
                    )

    return files.mapInArrow(read, _DOCS)


def token_offsets(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the token files, read them back: (doc_id, start, n_tokens, ids_crc32).

    ``start`` counts the ids of all documents before; an empty table gives no rows.
    """
    spark = documents.sparkSession
    folder = fresh_path(spark, "token-files")
    manifest = write_token_files(documents, tokenizer, end_id, folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    starts = file_starts(manifest)
    return (
        read_token_files(spark, folder)
        .join(starts, ["part", "seq"])
        .select(
            "doc_id",
            (F.col("file_start") + F.col("local_start")).alias("start"),
            "n_tokens",
            "ids_crc32",
        )
    )
