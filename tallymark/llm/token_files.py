"""Token ids as flat binary files with 64-bit document offsets, and their reading by memory map.

A data set is a folder in a shared file system with, for each part k:

* ``<k>.bin``: ids of the part's documents one after the other, little-endian unsigned integers without a header, of 2
  bytes where all ids of the tokenizer fit, else of 4;
* ``<k>.idx``: eight little-endian 64-bit numbers (FORMAT, bytes an id, documents, documents without an id, tokens, three
  zeros), then documents + 1 unsigned offsets in tokens from the part's start, then the documents' ids as signed integers;
* ``manifest.parquet``: part, documents, tokens, and the sums of both over the parts before (its bases).

Documents stand in ascending order over all parts, so a document's global start is its part's base and its own offset.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import _tokenizer, tokenizer_path
from .common import groups_for, shared_folder, table, total_bytes

FORMAT = 0x314B4F544D544C54
#: Bytes of text that a part holds on average.
PART = 64 << 20
#: Distinct units that a worker remembers from text to text, and rows taken out of a batch at once.
KNOWN, TOGETHER = 1 << 20, 256
#: White space of the tokenizer's pattern (Unicode's White_Space).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(rf" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+(?=[!-@\[-`{{-~{_WHITE}]|\Z)| ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")


class Encoder(dict):
    """Ids of texts by a byte-level tokenizer of the tokenizers library, each distinct unit encoded once.

    A unit is a run of letters before white space or ASCII punctuation, or else up to the next white space, with the
    blank before it; or white space before such a unit. The tokenizer's pattern never spans the end of a unit, so the ids
    of a text are those of its units. A text that holds an added token is encoded as a whole. The encoder is the map from
    units to their ids' bytes.
    """

    def __init__(self, path: str, dtype: str) -> None:
        self.tokenizer, self.code = _tokenizer(path), {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, text: str) -> bytes:
        ids = array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, unit: str) -> bytes:
        self[unit] = ids = self._whole(unit)
        return ids

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian bytes of the encoder's type."""
        if any(a in text for a in self.added):
            return self._whole(text)
        if len(self) > KNOWN:
            self.clear()
        return b"".join(map(self.__getitem__, _UNITS.findall(text)))


@lru_cache(2)
def _encoder(path: str, dtype: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, dtype)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI and its path there."""
    if urlsplit(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlsplit(path).path
    return pafs.FileSystem.from_uri(path)


def _put(folder: str, name: str, write) -> None:
    """A file under a name of its own, then moved: a task that runs twice leaves one whole file."""
    fs, at = file_system(folder)
    draft = f"{at}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        write(out)
    fs.move(draft, f"{at}/{name}")


def _write(folder: str, tokenizer: str, end_id: int | None, dtype: str):
    """Write one partition as one part and give its counts."""
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer, dtype)
        sizes: list[int] = []
        ids: list[np.ndarray] = []
        nameless = 0

        def write(out) -> None:
            nonlocal nameless
            for batch in batches:
                for i in range(0, batch.num_rows, TOGETHER):
                    some = batch.slice(i, TOGETHER)
                    nameless += some.column(0).null_count
                    ids.append(some.column(0).fill_null(0).to_numpy())
                    for t in some.column(1).to_pylist():
                        raw = encoder.encode(t or "") + end
                        out.write(raw)
                        sizes.append(len(raw) // width)

        name = f"{part:08d}"
        _put(folder, f"{name}.bin", write)
        offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.uint64))).astype("<u8")
        head = np.array([FORMAT, width, len(sizes), nameless, offsets[-1], 0, 0, 0], "<u8")
        numbers = np.concatenate(ids).astype("<i8") if ids else np.zeros(0, "<i8")
        _put(folder, f"{name}.idx", lambda out: out.write(head.tobytes() + offsets.tobytes() + numbers.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(sizes)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())], ["part", "documents", "tokens"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = 0) -> None:
    """Encode each row's whole text and write the folder described above; it must not exist yet.

    Rows are dealt by ranges of doc_id and, so that rows without an id and repeated ids don't meet in one task, of a hash
    of the text and the place in the input; each range is sorted and written by one task. Order: doc_id, nulls first, then
    the text's hash; wholly equal rows are interchangeable. end_id closes each document (None: nothing does). A null text
    is empty; other columns are ignored; an empty table gives parts without documents, or none.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path("byte_bpe_50k.json")
    dtype = "<u2" if max(_tokenizer(path).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else "<u4"
    fs, at = file_system(folder)
    if fs.get_file_info(at).type != pafs.FileType.NotFound:
        raise ValueError(f"{folder} exists")
    fs.create_dir(at)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    parts = groups_for(spark, total_bytes(docs, "text"), PART)
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie", "place").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "place")
    counts = ordered.select("doc_id", "text").mapInArrow(_write(folder, path, end_id, dtype), "part long, documents long, tokens long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    bases = [F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(f"{c}_before") for c in ("documents", "tokens")]
    counts.select("part", "documents", "tokens", *bases).coalesce(1).write.parquet(f"{folder}/manifest.parquet")


def _buffer(fs: pafs.FileSystem, path: str) -> pa.Buffer:
    """A whole file: mapped into memory where the file system is local or mounted, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


class Part:
    """One part of a folder: offsets and ids of its documents, and its tokens as a mapped array."""

    def __init__(self, folder: str, part: int) -> None:
        fs, at = file_system(folder)
        index = _buffer(fs, f"{at}/{part:08d}.idx")
        form, width, n, self.nameless, tokens = np.frombuffer(index, "<u8", 5).tolist()
        if form != FORMAT or width not in (2, 4):
            raise ValueError(f"part {part} isn't an index of token files")
        self.offsets = np.frombuffer(index, "<u8", n + 1, 64).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", n, 64 + 8 * (n + 1))
        raw = _buffer(fs, f"{at}/{part:08d}.bin")
        if raw.size != tokens * width or self.offsets[-1] != tokens:
            raise ValueError(f"part {part} has {raw.size} bytes for {tokens} tokens")
        self.tokens = np.frombuffer(raw, f"<u{width}")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, k: int) -> tuple[int | None, np.ndarray]:
        """doc_id and ids of the k-th document; documents without an id come first."""
        return None if k < self.nameless else int(self.doc_ids[k]), self.tokens[self.offsets[k] : self.offsets[k + 1]]


class TokenFiles:
    """Random access to a folder by a document's global number or a token's global place."""

    def __init__(self, folder: str) -> None:
        fs, at = file_system(folder)
        m = pq.read_table(f"{at}/manifest.parquet", filesystem=fs).sort_by("part").to_pydict()
        self.folder, self.parts, self._open = folder, m["part"], {}
        self.documents, self.tokens = m["documents_before"], m["tokens_before"]
        self.n_documents, self.n_tokens = sum(m["documents"]), sum(m["tokens"])

    def _part(self, i: int) -> Part:
        if i not in self._open:
            self._open[i] = Part(self.folder, self.parts[i])
        return self._open[i]

    def document(self, number: int) -> tuple[int | None, np.ndarray]:
        if not 0 <= number < self.n_documents:
            raise IndexError(number)
        i = bisect_right(self.documents, number) - 1
        return self._part(i).document(number - self.documents[i])

    def slice(self, start: int, n: int) -> np.ndarray:
        """n ids from a global place on, over documents and parts."""
        out, at = [], max(start, 0)
        stop = min(start + n, self.n_tokens)
        while at < stop:
            i = bisect_right(self.tokens, at) - 1
            part = self._part(i)
            some = part.tokens[at - self.tokens[i] : stop - self.tokens[i]]
            out.append(some)
            at += len(some)
        return np.concatenate(out) if out else np.zeros(0, np.uint16)


def _read(folder: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = Part(folder, k)
                for i in range(0, len(part), 4096):
                    j = min(i + 4096, len(part))
                    at = part.offsets[i : j + 1]
                    ids = part.tokens[at[0] : at[-1]].astype("<u4")
                    raw, cut = memoryview(ids.tobytes()), (4 * (at - at[0])).tolist()
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    names = pa.array(part.doc_ids[i:j], pa.int64(), mask=np.arange(i, j) < part.nameless)
                    columns = [names, pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return run


def read_token_files(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids_crc32 of each document, read from the files of
    a folder by memory map, a part in a task; ids: also the ids, as an array of int. ids_crc32 is the unsigned crc32 of
    the ids as little-endian unsigned 32-bit integers."""
    parts = spark.read.parquet(f"{folder}/manifest.parquet").where("documents > 0").select("part", "tokens_before")
    dealt = parts.repartitionByRange(max(parts.count(), 1), "part")
    return dealt.mapInArrow(_read(folder, ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    """The documents' token files, written to a folder of their own in the shared folder and read back."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder)


QUERIES = {"op13_token_files": op13_token_files}
ORACLES: dict[str, str] = {}
