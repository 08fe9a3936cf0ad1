"""Token ids in binary files of zstandard-compressed bit planes with a chunk index (operator 10).

A file holds whole documents in ascending doc_id order: their ids, each document closed by an end
id, run on in chunks of CHUNK ids. A chunk is transposed into bit planes (plane b: bit b of each
id, eight ids to a byte) or byte planes; each plane is one zstandard frame, and planes above the
chunk's largest id are not stored. The footer holds the chunk index (start, ids, length of each
plane), the document index and the number of ids; any range of ids is read from its chunks alone.

Layout: MAGIC, planes of chunk 0, planes of chunk 1, ..., zstandard(JSON footer), uint32 length
of the footer, MAGIC.

Cases: a null text is empty and still gets its end id; null doc_ids come first; rows with the same
doc_id are ordered by a hash of their text; a very long document lies in one file over several
chunks; an empty table writes no file and reads back as no row; other columns are not written."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_objects, partitions_for, scratch, table, written
from .tokens import encoder, tokenizer_path

MAGIC = b"QBITPL01"
CHUNK = 1 << 16
#: A file is closed by the document that takes it to so many ids.
FILE_IDS = 1 << 21
END_ID = 1


def planes(ids: np.ndarray, kind: str) -> list[bytes]:
    if kind == "byte":
        n = max(1, (int(ids.max()).bit_length() + 7) // 8)
        return [np.ascontiguousarray(ids.view("u1").reshape(-1, 4)[:, b]).tobytes() for b in range(n)]
    small = ids.astype("<u2") if int(ids.max()) < 1 << 16 else ids
    return [np.packbits(((small >> b) & 1).astype(bool)).tobytes() for b in range(max(1, int(ids.max()).bit_length()))]


def from_planes(parts: list[bytes], n: int, kind: str) -> np.ndarray:
    ids = np.zeros(n, "<u4")
    for b, part in enumerate(parts):
        if kind == "byte":
            ids |= np.frombuffer(part, "u1").astype("<u4") << np.uint32(8 * b)
        else:
            ids |= np.unpackbits(np.frombuffer(part, "u1"), count=n).astype("<u4") << np.uint32(b)
    return ids


class FileWriter:
    """Builds one file in memory: at most FILE_IDS ids and one document more."""

    def __init__(self, kind: str = "bit", chunk: int = CHUNK, level: int = 3):
        import zstandard

        self.zip, self.kind, self.size = zstandard.ZstdCompressor(level=level), kind, chunk
        self.out, self.at, self.chunks, self.docs, self.total = [MAGIC], len(MAGIC), [], [], 0
        self.held, self.n_held = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, self.total, len(ids) // 4))
        self.total += len(ids) // 4
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.size:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        upto = len(ids) if last else len(ids) // self.size * self.size
        for i in range(0, upto, self.size):
            part = ids[i : min(i + self.size, upto)]
            frames = [self.zip.compress(p) for p in planes(part, self.kind)]
            self.chunks.append([self.at, len(part), [len(x) for x in frames]])
            self.out += frames
            self.at += sum(map(len, frames))
        self.held, self.n_held = [ids[upto:].tobytes()], len(ids) - upto

    def close(self) -> bytes:
        if self.n_held:
            self.flush(True)
        d = self.docs
        footer = {"kind": self.kind, "chunk": self.size, "chunks": self.chunks, "n_ids": self.total, "doc_ids": [x[0] for x in d], "doc_starts": [x[1] for x in d], "doc_lengths": [x[2] for x in d]}
        packed = self.zip.compress(json.dumps(footer).encode())
        return b"".join([*self.out, packed, struct.pack("<I", len(packed)), MAGIC])


class FileReader:
    """Reads ranges of ids from a file's bytes; decodes a chunk only when a range touches it."""

    def __init__(self, content: bytes):
        import zstandard

        if content[: len(MAGIC)] != MAGIC or content[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token file, or one cut short")
        self.unzip, self.content = zstandard.ZstdDecompressor(), content
        (n,) = struct.unpack("<I", content[-len(MAGIC) - 4 : -len(MAGIC)])
        self.footer = json.loads(self.unzip.decompress(content[-len(MAGIC) - 4 - n : -len(MAGIC) - 4]))
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def chunk(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            at, n, lengths = self.footer["chunks"][k]
            parts = []
            for size in lengths:
                parts.append(self.unzip.decompress(self.content[at : at + size]))
                at += size
            self.last = (k, from_planes(parts, n, self.footer["kind"]))
        return self.last[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        size, out = self.footer["chunk"], []
        for k in range(start // size, (start + n - 1) // size + 1 if n else 0):
            out.append(self.chunk(k)[max(0, start - k * size) : start + n - k * size])
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_files(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = END_ID, kind: str = "bit", chunk: int = CHUNK, file_ids: int = FILE_IDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files into folder, a new folder of a store that pyarrow's filesystems reach.

    Returns (part, seq, file, n_docs, n_ids), one row for each file. A file appears under its name
    only when whole, and a task that is run again writes the same bytes under the same name."""
    path = tokenizer or tokenizer_path()

    def write(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        enc, end, found = encoder(path), struct.pack("<I", end_id), []
        w = FileWriter(kind, chunk)

        def close() -> None:
            name = f"part-{part:06d}-{len(found):06d}.qbp"
            with fs.open_output_stream(f"{base}/.{name}.{attempt}") as f:
                f.write(w.close())
            fs.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")
            found.append((part, len(found), name, len(w.docs), w.total))

        for pdf in batches:
            for d, t in zip(pdf["d"].array, pdf["t"].array, strict=True):
                w.add(int(d) if isinstance(d, str) else None, enc.encode(t if isinstance(t, str) else "") + end)
                if w.total >= file_ids:
                    close()
                    w = FileWriter(kind, chunk)
        if w.docs:
            close()
        yield as_objects(pd.DataFrame(found, columns=["part", "seq", "file", "n_docs", "n_ids"]).astype({"part": int, "seq": int, "n_docs": int, "n_ids": int}))

    # doc_id goes as text: pandas would turn a column of integers and nulls into floats.
    rows = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t"), F.col(doc_id).cast("long").alias("o"), F.xxhash64(text).alias("h"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    dealt = rows.repartitionByRange(partitions_for(docs.sparkSession, size), "o", "h").sortWithinPartitions("o", "h", "t").select("d", "t")
    out = dealt.mapInPandas(write, "part int, seq int, file string, n_docs long, n_ids long")
    # a row for each file: few, so that they go into few files
    return written(out.repartition(docs.sparkSession.sparkContext.defaultParallelism), "token-index")


def read_files(spark, folder: str) -> DataFrame:
    """(part, seq, ord, doc_id, start_in_file, n_tokens, ids binary), one row for each document."""

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                part, seq = map(int, name.rsplit("/", 1)[-1][5:-4].split("-"))
                r = FileReader(content)
                f = r.footer
                for at in range(0, len(f["doc_ids"]), 2000):
                    ids = [r.ids(s, n).tobytes() for s, n in zip(f["doc_starts"][at : at + 2000], f["doc_lengths"][at : at + 2000], strict=True)]
                    yield pd.DataFrame({"part": part, "seq": seq, "ord": range(at, at + len(ids)), "doc_id": pd.array(f["doc_ids"][at : at + 2000], dtype="Int64"), "start_in_file": f["doc_starts"][at : at + 2000], "n_tokens": f["doc_lengths"][at : at + 2000], "ids": ids})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.qbp").load(folder).select("path", "content")
    return files.mapInPandas(read, "part int, seq int, ord long, doc_id long, start_in_file long, n_tokens long, ids binary")


def starts(files: DataFrame) -> DataFrame:
    """(part, seq, before): ids in all earlier files. Parts are as many as shuffle partitions; a part's files are summed in it."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("p"))
    inside = files.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("s"))
    return inside.join(before, "part").select("part", "seq", (F.col("p") + F.col("s")).alias("before"))


def op10_bit_planes(spark, sf_dir):
    folder = scratch(spark, "token-files")
    index = write_files(table(spark, sf_dir, "documents"), folder)
    if index.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    back = read_files(spark, folder)
    at = starts(index)
    read = back.select("part", "seq", "doc_id", "start_in_file", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return read.join(at, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
