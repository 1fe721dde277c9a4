"""BPE encoding and decoding over a table of distinct words.

1. One scan packs documents into chunks, named by a hash of what they hold; chunks are shuffled once.
2. Each chunk sends its distinct words to the words' buckets. There every distinct word of the corpus is encoded once:
   the table of words and their ids.
3. That table's ids are joined with the tokenizer's table of ids and pieces, which gives each word's decoded text.
4. Ids and pieces of its words go back to each chunk and are put in place by position.

The tokenizer's pieces never span white space, nor the end of a run of letters before ASCII punctuation, and its
normaliser works on each side of these alone (not so for U+0130, whose lower case ends with a combining mark, which
joins the punctuation: it is left out of the letters), so the ids of a text are its words' ids one after the other, and its
decoded text is its words' decoded texts with a blank between. A special token's text starts with punctuation and
stays whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, free_names, shuffle_partitions, table, total_bytes

#: Bytes of text in one chunk; a longer text is a chunk of its own.
CHUNK = 8 << 20
#: Bytes of the corpus for each bucket of words, at most.
BUCKET = 128 << 20
_WORDS = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+(?=[!-/:-@\[-`{-~\x20\x09-\x0D]|\Z)|" + WORD_RE)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """id and piece: a row for each id of the tokenizer, from its file's vocabulary and added tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    by_id = {i: p for p, i in model["model"]["vocab"].items()} | {t["id"]: t["content"] for t in model["added_tokens"]}
    return spark.createDataFrame(list(by_id.items()), "id int, piece string")


def _chunk(ids: list, texts: list[str]) -> pa.RecordBatch:
    """One chunk as a row; its name is a hash of its rows, so a task that runs again gives the same."""
    raw = [t.encode() for t in texts]
    body = zstandard.ZstdCompressor(level=6).compress(np.array([len(r) for r in raw], np.uint64).tobytes() + b"".join(raw))
    name = int.from_bytes(hashlib.blake2b(body + repr(ids).encode(), digest_size=8).digest(), "little", signed=True)
    return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([body], pa.binary())], ["chunk", "ids", "body"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of about CHUNK bytes."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                size += len(t or "")
                if size >= CHUNK:
                    yield _chunk(ids, texts)
                    ids, texts, size = [], [], 0
    if ids:
        yield _chunk(ids, texts)


def _texts(docs: pa.Table) -> Iterator[tuple[int | None, str]]:
    """(doc_id, text) of the chunks in a table."""
    unpack = zstandard.ZstdDecompressor()
    for ids, body in zip(docs["ids"].to_pylist(), docs["body"], strict=True):
        raw = unpack.decompress(body.as_py())
        at = 8 * len(ids)
        for i, n in zip(ids, np.frombuffer(raw, np.uint64, len(ids)).tolist(), strict=True):
            yield i, raw[at : at + n].decode()
            at += n


def _by_bucket(docs: pa.Table, buckets: int) -> dict[int, list[str]]:
    """The distinct words of a chunk's texts, in order, by bucket."""
    words: set[str] = set()
    for _, t in _texts(docs):
        words.update(_WORDS.findall(t))
    by: dict[int, list[str]] = {}
    for w in sorted(words):
        by.setdefault(zlib.crc32(w.encode()) % buckets, []).append(w)
    return by


def _split(buckets: int):
    """(bucket, chunk, its distinct words)"""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary())])

    def run(docs: pa.Table) -> pa.Table:
        by = _by_bucket(docs, buckets)
        pack = zstandard.ZstdCompressor(level=6)
        rows = [pack.compress("\n".join(ws).encode()) for ws in by.values()]
        return pa.table([pa.array(list(by), pa.int32()), pa.array([docs["chunk"][0].as_py()] * len(by), pa.int64()), pa.array(rows, pa.binary())], schema=schema)

    return run


def _asked(t: pa.Table) -> list[list[str]]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x.as_py()).decode().split("\n") for x in t["words"]]


def _encode(path: str):
    """bucket, word, ids: a row for each distinct word of a bucket, encoded once."""
    schema = pa.schema([("bucket", pa.int32()), ("word", pa.string()), ("ids", pa.list_(pa.int32()))])

    def run(t: pa.Table) -> pa.Table:
        words = sorted(set().union(*_asked(t)))
        ids = []
        for i in range(0, len(words), 4096):
            ids += [e.ids for e in _tokenizer(path).encode_batch(words[i : i + 4096], add_special_tokens=False)]
        return pa.table([pa.array([t["bucket"][0].as_py()] * len(words), pa.int32()), pa.array(words), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return run


def _answer(asked: pa.Table, words: pa.Table) -> pa.Table:
    """Ids and decoded texts of the words that each chunk asked for, packed in the order of asking."""
    flat = words["ids"].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    at, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False).astype(np.uint32)
    place = {w: k for k, w in enumerate(words["word"].to_pylist())}
    text = words["decoded"].to_pylist()
    pack, answers, many = zstandard.ZstdCompressor(level=6), [], []
    for ws in _asked(asked):
        ks = [place[w] for w in ws]
        sizes = (at[[k + 1 for k in ks]] - at[ks]).astype(np.uint32)
        ids = np.concatenate([values[at[k] : at[k + 1]] for k in ks])
        # byte planes: the high bytes of sizes and ids are mostly zero
        planes = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4).T.tobytes() for x in (sizes, ids)]
        answers.append(pack.compress(planes[0] + planes[1] + "\n".join([text[k] for k in ks]).encode()))
        many.append(len(ws))
    return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "n": pa.array(many, pa.int64()), "answer": pa.array(answers, pa.binary())})


def _planes(raw: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view(np.uint32).ravel()


def _place(finish, schema: pa.Schema, buckets: int):
    """Put the words' ids and pieces in place by position in each text of a chunk."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        ids_of: dict[str, bytes] = {}
        text_of: dict[str, str] = {}
        by = _by_bucket(docs, buckets)
        for b, n, a in zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["answer"], strict=True):
            raw = unpack.decompress(a.as_py())
            sizes = _planes(raw, 0, n)
            total = int(sizes.sum())
            flat = _planes(raw, 4 * n, total).tobytes()
            cuts = (4 * np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))).tolist()
            for w, d, i, j in zip(by[b], raw[4 * (n + total) :].decode().split("\n"), cuts[:-1], cuts[1:], strict=True):
                ids_of[w] = flat[i:j]
                text_of[w] = d
        out = []
        for d, text in _texts(docs):
            words = _WORDS.findall(text)
            decoded = " ".join([t for t in map(text_of.__getitem__, words) if t])
            out.append((d, *finish(b"".join(map(ids_of.__getitem__, words)), decoded)))
        return pa.table([_column(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else schema.empty_table()

    return run


def _digest(ids: bytes, text: str) -> tuple:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _ids(ids: bytes, text: str) -> tuple:
    return ids, hashlib.sha256(text.encode()).hexdigest()


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """A column; lists of ids come as their bytes."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    ends = np.cumsum([0, *(len(v) // 4 for v in values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(values), "<i4")))


def _joined(rows: DataFrame, key: list[str], table_of_pieces: DataFrame, *carried: str) -> DataFrame:
    """Adds decoded to rows (key, ids array<int>, carried): each id joined with its piece, put in order, a blank between.

    The table of pieces has a row for each id of a tokenizer, so it may be broadcast. A key's ids are in one task, so
    they are aggregated before the shuffle.
    """
    first = [F.first(c).alias(c) for c in ("ids", *carried)]
    one = rows.select(*key, "ids", *carried, F.posexplode_outer("ids").alias("pos", "id"))
    named = one.join(F.broadcast(table_of_pieces), "id", "left")
    of = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "piece")))
    return named.groupBy(*key).agg(*first, F.array_join(F.transform(F.array_sort(of), lambda x: x["piece"]), " ").alias("decoded"))


def _run(docs: DataFrame, path: str, finish, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    buckets = max(shuffle_partitions(spark), -(-total_bytes(texts, "text") // BUCKET))
    chunks = texts.mapInArrow(_documents, "chunk long, ids array<long>, body binary")
    asked = chunks.groupBy("chunk").applyInArrow(_split(buckets), "bucket int, chunk long, words binary")
    words = asked.groupBy("bucket").applyInArrow(_encode(path), "bucket int, word string, ids array<int>")
    decoded = _joined(words.repartition("bucket"), ["bucket", "word"], pieces(spark, path))
    answers = asked.groupBy("bucket").cogroup(decoded.groupBy("bucket")).applyInArrow(_answer, "chunk long, bucket int, n long, answer binary")
    schema = pa.schema([("doc_id", pa.int64()), *[(a, t) for a, _, t in fields]])
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_place(finish, schema, buckets), "doc_id long, " + ", ".join(f"{a} {s}" for a, s, _ in fields))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded_sha256 (of the text decoded from them) of each row's whole text.

    Null and empty texts have no ids; rows repeat as they come, null doc_ids included; other columns are ignored; an
    empty table gives none.
    """
    return _run(docs, path or tokenizer_path(), _ids, [("ids", "array<int>", pa.list_(pa.int32())), ("decoded_sha256", "string", pa.string())])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (with a column ids, array of int) and the text of each row's ids: ids joined with the table of pieces.

    Rows repeat as they come; null or empty ids give an empty text; an id that the tokenizer doesn't have gives nothing;
    a column text of the input is replaced.
    """
    spark = encoded.sparkSession
    rest = [c for c in encoded.columns if c not in ("ids", "text")]
    (key,) = free_names(encoded, "key")
    rows = encoded.select(*rest, "ids", F.monotonically_increasing_id().alias(key))
    return _joined(rows, [key], pieces(spark, path or tokenizer_path()), *rest).withColumnRenamed("decoded", "text").select(*rest, "ids", "text")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256; rows as in encode()."""
    fields = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _run(docs, path or tokenizer_path(), _digest, fields)


def op6_bpe_words(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op6_bpe_words": op6_bpe_words}
ORACLES: dict[str, str] = {}
