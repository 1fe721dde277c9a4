"""Fill-in-the-middle transformation: texts are cut between units (lines) and their parts put in another order.

Cuts are found on 64-bit words: a batch's UTF-8 bytes are viewed as uint64, the bytes that end a unit are marked by
arithmetic on whole words (SWAR), marks are counted by word, the wanted unit's word is found in the cumulative counts,
and its byte by clearing lower marks of that word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text looked at together; a longer text is looked at alone.
BLOCK = 8 << 20
_U = np.uint64
_EACH, _HIGH, _LOW7 = _U(0x0101010101010101), _U(0x8080808080808080), _U(0x7F7F7F7F7F7F7F7F)


def as_words(raw: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, padded with zero bytes."""
    out = np.zeros(-(-len(raw) // 8) * 8, np.uint8)
    out[: len(raw)] = raw
    return out.view("<u8")


def equal_marks(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of each byte that equals the given one; exact, no carry passes from byte to byte."""
    x = words ^ (_EACH * _U(byte))
    return ~(((x & _LOW7) + _LOW7) | x | _LOW7)


def continuation_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte 10xxxxxx, which continues a code point."""
    return words & ~(words << _U(1)) & _HIGH


class Marks:
    """Rank and select over the marked bytes of a buffer."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.upto = np.concatenate(([0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each position."""
        word, bit = at >> 3, ((at & 7) << 3).astype(_U)
        part = np.zeros(len(at), np.int64)
        inside = np.flatnonzero(bit)
        part[inside] = np.bitwise_count(self.marks[word[inside]] & ((_U(1) << bit[inside]) - _U(1)))
        return self.upto[word] + part

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th marked byte, counted from 0."""
        word = np.searchsorted(self.upto, k, "right") - 1
        rest, left = k - self.upto[word], self.marks[word]
        for i in range(1, 8):
            more = rest >= i
            left[more] &= left[more] - _U(1)
        lowest = left & (~left + _U(1))
        return (word << 3) + (np.bitwise_count(lowest - _U(1)).astype(np.int64) >> 3)


def _hashes(seed: str, ids: list[int | None]) -> np.ndarray:
    """The first four 8-digit groups of the hex sha256 of seed:id, for each id."""
    raw = b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def cut(raw: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts raw[at[i]:at[i+1]]: units, byte ends of prefix and middle, code points of prefix and middle.

    A unit ends with a line feed or with its text. h: the random numbers of each text.
    """
    words = as_words(raw)
    ends, inner = Marks(equal_marks(words, 10)), Marks(continuation_marks(words))
    start, stop = at[:-1], at[1:]
    before = ends.rank(start)
    feeds = ends.rank(stop) - before
    n = feeds.copy()
    full = np.flatnonzero(stop > start)
    n[full] += raw[stop[full] - 1] != 10

    def edge(units: np.ndarray) -> np.ndarray:
        out = np.where(units == 0, start, stop)
        found = np.flatnonzero((units > 0) & (units <= feeds))
        out[found] = ends.select(before[found] + units[found] - 1) + 1
        return out

    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    a, b = edge(np.minimum(one, two)), edge(np.maximum(one, two))
    at_start, at_a, at_b = inner.rank(start), inner.rank(a), inner.rank(b)
    return n, a - start, b - start, (a - start) - (at_a - at_start), (b - a) - (at_b - at_a)


def _transform(schema: pa.Schema, seed: str, fim_rate: int, spm_rate: int, marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    def block(ids: list[int | None], texts: list[bytes], others: list[pa.Array]) -> pa.RecordBatch:
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        h = _hashes(seed, ids)
        n, a, b, prefix, middle = cut(np.frombuffer(b"".join(texts), np.uint8), at, h)
        forms, out, chars = [], [], np.ones(len(ids), bool)
        for k, (t, i, j) in enumerate(zip(texts, a.tolist(), b.tolist(), strict=True)):
            if not t or p in t or s in t or m in t or h[k, 2] % 100 >= fim_rate:
                forms.append("plain")
                out.append(t)
                chars[k] = False
            elif h[k, 3] % 100 < spm_rate:
                forms.append("spm")
                out.append(b"".join((s, t[j:], p, t[:i], m, t[i:j])))
            else:
                forms.append("psm")
                out.append(b"".join((p, t[:i], s, t[j:], m, t[i:j])))
        made = [pa.array(n), pa.array(forms), pa.array(prefix, mask=~chars), pa.array(middle, mask=~chars), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([pa.array(ids, pa.int64()), *others, *made], schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            size = np.cumsum(np.array(pc.fill_null(pc.binary_length(raw), 0), np.int64))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + BLOCK, "right")))
                texts = [t or b"" for t in raw.slice(i, j - i).to_pylist()]
                yield block(batch.column(0).slice(i, j - i).to_pylist(), texts, [c.slice(i, j - i) for c in batch.columns[2:]])
                i = j

    return run


def fill_in_middle(docs: DataFrame, keep: tuple[str, ...] = (), seed: str = "7", fim_rate: int = 100, spm_rate: int = 50, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """doc_id, the columns in keep, n (units), form, prefix_chars, middle_chars and output (text) of each row.

    Units are lines with their line feeds. Random numbers h1 to h4 are 32 bits each of sha256(seed:doc_id). The prefix
    ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger, the suffix is the rest.
    A text is left plain if it is empty, holds one of the marks, or h3 % 100 >= fim_rate; else h4 % 100 < spm_rate gives
    the form spm (suffix, prefix, middle), otherwise psm (prefix, suffix, middle), each after its mark. Lengths are in
    code points and null in plain rows. Null texts are empty; a null doc_id is hashed as `None`; rows repeat as they come
    and equal doc_ids with equal texts give equal rows; columns that aren't in keep are ignored, whatever their names; an
    empty table gives none. Marks must not overlap one another: each starts with a character that it doesn't hold again.
    """
    if any(not x or x[0] in y[1:] for x in marks for y in marks) or len(set(marks)) < 3:
        raise ValueError("marks must be three different texts that can't overlap")
    rows = docs.select("doc_id", "text", *keep)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    if clash := {*keep} & {"doc_id", *made}:
        raise ValueError(f"names of the result: {sorted(clash)}")
    empty = rows.select("doc_id", *keep).limit(0).withColumns({k: F.lit(None).cast(t) for k, t in made.items()})
    spec = ", ".join([f"doc_id {kinds['doc_id']}", *(f"`{k}` {kinds[k]}" for k in keep), *(f"{k} {t}" for k, t in made.items())])
    return rows.mapInArrow(_transform(to_arrow_schema(empty.schema), seed, fim_rate, spm_rate, marks), spec)


def restored(output: Column | str, form: Column | str, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that fill_in_middle() made an output of, rebuilt from output and form alone."""
    out, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    p, s, m = (F.lit(x) for x in marks)

    def between(first: Column, last: Column | None) -> Column:
        begin = F.position(first, out) + F.length(first)
        return F.substring(out, begin, (F.position(last, out) - begin) if last is not None else F.length(out))

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(out)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


_SQL = r"""
WITH base AS (
  SELECT doc_id, COALESCE(text, '') AS text, sha256('7:' || COALESCE(CAST(doc_id AS VARCHAR), 'None')) AS h FROM documents
), cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM base
), edge AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM cut
), part AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:a], '') AS p, array_to_string(u[a+1:b], '') AS m, array_to_string(u[b+1:n], '') AS s
  FROM edge
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM part
"""

QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {"op11_fill_in_middle": _SQL}
