"""Exact Jaccard self-join of word n-gram sets with skipping by set relations, and its components.

Tokens (hashed n-grams) stand in one global order, rare ones first. A set of n tokens that reaches the threshold
with another shares one of its first n - ceil(t n) + 1 tokens with it, so only those are indexed.

* Index lists hold each set's position of the token and are cut in blocks of equal position. Two sets share at most
  min(|x| - i, |y| - j) tokens from positions i and j on, so by its largest and the other's smallest set a pair of
  blocks is skipped whole, unread, where that can't reach the threshold; sizes bound the partners in the rest.
* Equal sets are one class. A long list first compares only one of its sets, its head c, with the others. The
  answers of all others derive from the head's: |x & c| + |y & c| - |c| <= |x & y| <= min(|x & c|, |y & c|) +
  min(|x - c|, |y - c|). Sets much like c are linked or parted by these bounds alone; only pairs that they leave open are
  compared, and for components only those that aren't connected yet.
* Lists of more than BLOCK sets are dealt to tasks by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, shuffle_partitions, table, total_bytes
from .components import components
from .hashing import BYTE, M1, M2, M3, mix, pair, runs

#: Threshold: intersection * DOWN >= union * UP.
UP, DOWN = 75, 100
N = 5
SLICE = 1 << 20
FLUSH = 1 << 19
#: Lists up to this length give all their pairs at once.
SHORT = 6
ATTEMPTS = 2
#: Sets of one list that are compared in one task; more are dealt by pairs of blocks.
BLOCK = 1024
#: Bytes of text for each bucket of index lists.
BUCKET = 16 << 20
#: Words of 64 bits of the map of documents that pairs name; its size bounds what is broadcast.
MAP_WORDS = 1 << 18
#: Tokens known as frequent: found at least this often in a task's slice of documents; this many at most.
OFTEN, FREQUENT = 2, 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = BYTE[_LOWER]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x5851F42D4C957F2D)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + (SLICE >> 2))
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64)))) for x in (_STEP, inverse)]
    return _powers[0], _powers[1]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (letters A-Z in lower case) and its first byte's place."""
    blank = np.concatenate(([True], _BLANK[data], [True]))
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    begin, end = turn[::2], turn[1::2]
    up, down = _power_tables(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up[: len(data)])))
    h = (total[end] - total[begin]) * down[begin]
    h ^= (end - begin).astype(np.uint64) * M3
    return mix(h), begin


def _documents(ids: list, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, word hashes, document of each word) of about SLICE bytes of whole texts at a time."""
    docs, held, size = [], [], 0

    def out():
        data = np.concatenate([x for r in held for x in (r, np.array([32], np.uint8))])
        ends = np.cumsum([len(r) + 1 for r in held])
        h, begin = _word_hashes(data)
        return np.array(docs, np.int64), h, np.searchsorted(ends, begin, "right")

    for doc, text in zip(ids, texts, strict=True):
        if doc is None:
            continue
        raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and text.as_buffer().size else np.zeros(0, np.uint8)
        if len(raw) > 4 * SLICE:  # a very long text by pieces, cut at blanks, so that no array has its length
            parts, at = [], 0
            while at < len(raw):
                end = min(at + SLICE, len(raw))
                while end < len(raw) and not _BLANK[raw[end]]:
                    end += 1
                parts.append(_word_hashes(raw[at:end])[0])
                at = end
            h = np.concatenate(parts)
            yield np.array([doc], np.int64), h, np.zeros(len(h), np.int64)
            continue
        docs.append(doc)
        held.append(raw)
        size += len(raw) + 1
        if size >= SLICE:
            yield out()
            docs, held, size = [], [], 0
    if docs:
        yield out()


def shingles(words: np.ndarray, of: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as (set, token), sorted; a set of fewer than n words has all of them as one."""
    size = np.bincount(of) if len(of) else np.zeros(0, np.int64)
    h, at = words, of
    for k in range(1, n):
        h = pair(h[:-1], words[k:]) if len(words) > k else h[:0]
    full = at[: len(h)] == at[n - 1 :] if len(h) else np.zeros(0, bool)
    tokens, sets = [mix(h[full].copy())], [at[: len(h)][full]]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        first = np.searchsorted(of, short)
        few = words[first] ^ (size[short].astype(np.uint64) * M2)
        for k in range(1, n - 1):
            more = size[short] > k
            few[more] = pair(few[more], words[first[more] + k])
        tokens.append(mix(few * M1))
        sets.append(short)
    token, of_set = np.concatenate(tokens), np.concatenate(sets)
    order = np.lexsort((token, of_set))
    token, of_set = token[order], of_set[order]
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (of_set[1:] != of_set[:-1]))) if len(token) else np.zeros(0, bool)
    return of_set[new], token[new]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens that occur OFTEN in one task's stretch of documents, with their counts."""
    held, n = [], 0

    def flush():
        token = np.sort(np.concatenate(held))
        start = runs(token)
        count = np.diff(np.concatenate((start, [len(token)])))
        many = count >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(token[start][many].view(np.int64)), pa.array(count[many])], ["token", "n"])

    for batch in batches:
        for _, words, of in _documents(batch.column(0).to_pylist(), batch.column(1)):
            token = shingles(words, of)[1]
            held.append(token)
            n += len(token)
            if n >= 8 * FLUSH:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


ENTRY = np.dtype([("token", "<u8"), ("key", "<u8"), ("doc", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def _pack(a: np.ndarray) -> bytes:
    cols = [np.ascontiguousarray(a[n]) for n in ENTRY.names]
    return b"".join(c.tobytes() if n in ("token", "key") else c.view(np.uint8).reshape(len(a), c.itemsize).T.tobytes() for n, c in zip(ENTRY.names, cols, strict=True))


def _unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // ENTRY.itemsize
    a, at = np.empty(n, ENTRY), 0
    for name in ENTRY.names:
        kind = ENTRY[name]
        part = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        at += n * kind.itemsize
        a[name] = part.view(kind) if name in ("token", "key") else np.ascontiguousarray(part.reshape(kind.itemsize, n).T).view(kind).ravel()
    return a


def _first_of_class(a: np.ndarray) -> np.ndarray:
    """One entry (the least document) for each token and class of equal sets, by token, then size and position."""
    a = a[np.lexsort((a["doc"], a["key"], a["token"]))]
    if len(a):
        a = a[np.concatenate(([True], (a["token"][1:] != a["token"][:-1]) | (a["key"][1:] != a["key"][:-1])))]
    return a[np.lexsort((a["doc"], a["pos"], a["n"], a["token"]))]


def set_keys(sets: np.ndarray, token: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set and two 64-bit keys that only equal sets share."""
    n = np.bincount(sets, minlength=count)
    start = np.cumsum(n) - n
    keys = []
    for salt in (M1, M2):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(token * salt))))
        keys.append(mix(total[start + n] - total[start] + n.astype(np.uint64) * M3))
    return n, keys[0], keys[1]


def _index(frequent: np.ndarray, count: np.ndarray, buckets: int):
    """Entries of the tokens to index, packed by bucket; and one row for each document (bucket -1).

    Of equally rare tokens a set indexes its least ones, so tokens are mixed (one to one) before their high bits name the
    bucket: the least ones would crowd the first buckets.
    """
    shift = np.uint64(64) - np.uint64(buckets.bit_length() - 1)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        a = np.concatenate(held)
        a["token"] = mix(a["token"] * M1)
        a = _first_of_class(a)
        bucket = (a["token"] >> shift).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = [(b, _pack(a[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if j > i]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for docs, words, of in _documents(batch.column(0).to_pylist(), batch.column(1)):
                sets, token = shingles(words, of)
                n, key, _ = set_keys(sets, token, len(docs))
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
                    often = np.where(frequent[at] == token, count[at], 0)
                    order = np.lexsort((token, often, sets))
                    sets, token = sets[order], token[order]
                start = np.cumsum(n) - n
                pos = np.arange(len(token)) - start[sets]
                own = n[sets]
                keep = pos < own - (-(-UP * own // DOWN)) + 1
                a = np.empty(int(keep.sum()), ENTRY)
                a["token"], a["key"], a["doc"], a["n"], a["pos"] = token[keep], key[sets][keep], docs[sets][keep], own[keep], pos[keep]
                held.append(a)
                total += len(a)
                if total >= FLUSH:
                    yield flush(held)
                    held, total = [], 0
        if total:
            yield flush(held)

    return run


def wanted(x, y):
    """Least intersection of sets of x and y tokens that reaches the threshold."""
    return -(-UP * (x + y) // (UP + DOWN))


LIST_SCHEMA = "kind int, token long, a long, b long, n long, pos long, nh long"


def _candidates(t: pa.Table) -> pa.Table:
    """kind 0: pairs (a, b); kind 1: entries of long lists (b of the list that a heads, which has nh tokens)."""
    e = _first_of_class(np.concatenate([_unpack(x.as_py()) for x in t["entries"]]))
    start = runs(e["token"])
    size = np.diff(np.concatenate((start, [len(e)])))
    n, pos, doc = e["n"].astype(np.int64), e["pos"].astype(np.int64), e["doc"]
    left, right, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    heads = [np.zeros(0, np.int64)]
    for gap in range(1, SHORT):
        for length in range(gap + 1, SHORT + 1):
            s = start[size == length]
            for k in range(length - gap):
                left.append(s + k)
                right.append(s + k + gap)
    for s, m in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
        head = s + int(mix(doc[s : s + m].astype(np.uint64)).argmin())  # lists of much the same sets mostly agree on it
        own = np.arange(s, s + m)
        rest = own[own != head]
        left.append(np.full(len(rest), head))
        right.append(rest)
        lists.append(own)
        heads.append(np.full(m, head))
    x, y = np.concatenate(left), np.concatenate(right)
    few, many = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    ok = (DOWN * few >= UP * many) & (1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1 >= wanted(n[x], n[y]))
    x, y = x[ok], y[ok]
    a, b = np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])
    once = np.lexsort((b, a))
    a, b = a[once], b[once]
    if len(a):
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        a, b = a[new], b[new]
    own, head = np.concatenate(lists), np.concatenate(heads)
    zero = np.zeros(len(a), np.int64)
    return pa.table(
        {
            "kind": np.repeat(np.array([0, 1], np.int32), (len(a), len(own))),
            "token": np.concatenate((zero, e["token"][own].view(np.int64))),
            "a": np.concatenate((a, doc[head])),
            "b": np.concatenate((b, doc[own])),
            "n": np.concatenate((zero, n[own])),
            "pos": np.concatenate((zero, pos[own])),
            "nh": np.concatenate((zero, n[head])),
        }
    )


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, na, nb, common for pairs that come with both texts."""
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            texts, sets = {}, {}
            for ids, col in ((a, part.column(2)), (b, part.column(3))):
                for d, t in zip(ids, col, strict=True):
                    texts.setdefault(d, t)
            ids = list(texts)
            for docs, words, of in _documents(ids, list(texts.values())):
                s, token = shingles(words, of)
                cuts = np.searchsorted(s, np.arange(len(docs) + 1))
                for k, d in enumerate(docs.tolist()):
                    sets[d] = token[cuts[k] : cuts[k + 1]]
            common = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)]
            na, nb = [len(sets[x]) for x in a], [len(sets[y]) for y in b]
            cols = [part.column(0), part.column(1), *(pa.array(v, pa.int64()) for v in (na, nb, common))]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "na", "nb", "common"])


def _named(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose doc_id is among ids (column id), and few others.

    A map of MAP_WORDS words of bits over hashes of the ids is broadcast, so its size doesn't grow with the data; where
    very many ids fill it, more rows than needed pass.
    """
    at = F.pmod(F.xxhash64("id"), F.lit(64 * MAP_WORDS))
    word, bit = F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    bits = ids.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    rows = texts.select("doc_id", "text", F.col("doc_id").cast("long").alias("id")).withColumn("word", word)
    return rows.join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0).select("doc_id", "text")


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Exact overlaps of candidate pairs: a, b, na, nb, common.

    Texts that pairs name meet them in two joins on doc_id; those joins shuffle at every size.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = _named(docs.where("doc_id is not null"), ids)
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(_overlaps, "a long, b long, na long, nb long, common long")


def _open(n, pos, common, nh, comp, block, doc, head) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, derived) of a list's sets, sorted by position and size, that may link: derived ones surely do.

    common is |x & head|, -1 where it isn't known. Blocks of equal position are skipped whole where no pair of theirs can
    reach the threshold; block (all equal, or two values) allows pairs of different values only.
    """
    starts = runs(pos)
    ends = np.concatenate((starts[1:], [len(pos)]))
    small, large, at = n[starts], n[ends - 1], pos[starts]
    split = block[0] != block[-1] or (block != block[0]).any()
    rest = n - common
    for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        # need <= |x| - i means (UP + DOWN) i <= DOWN |x| - UP |y|
        fits = (DOWN * large[k] - UP * small[k:] >= (UP + DOWN) * at[k]) & (DOWN * large[k:] - UP * small[k] >= (UP + DOWN) * at[k:])
        held = np.flatnonzero(fits) + k
        if not len(held):
            continue
        y = np.concatenate([np.arange(starts[q], ends[q]) for q in held.tolist()])
        for x0 in range(s, e, 256):
            x = np.arange(x0, min(x0 + 256, e))[:, None]
            need = wanted(n[x], n[y])
            few, many = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            ok = (y > x) & (comp[x] != comp[y]) & (doc[x] != head) & (doc[y] != head) & (DOWN * few >= UP * many)
            ok &= np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need
            if split:
                ok &= block[x] != block[y]
            known = (common[x] >= 0) & (common[y] >= 0)
            ok &= ~known | (np.minimum(common[x], common[y]) + np.minimum(rest[x], rest[y]) >= need)
            i, j = np.nonzero(ok)
            if len(i):
                sure = known[i, j] & ((common[x] + common[y])[i, j] - nh >= need[i, j])
                yield x[i, 0], y[j], sure


def _open_pairs(attempt: int | None, derive: bool):
    """a, b, derived: pairs in different components that nothing known rules out, over a task's lists.

    With an attempt, one open partner of each set only, another one in each attempt. With derive, pairs that the head's
    answers link come as such, one for each pair of components; without, they are open too.
    """

    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["b"].to_numpy(), t["n"].to_numpy(), t["pos"].to_numpy(), t["hi"].to_numpy(), t["lo"].to_numpy(), t["token"].to_numpy()))
        token, lo, hi, doc, n, pos, common, comp, block, nh, head = (t[c].to_numpy()[order] for c in ("token", "lo", "hi", "b", "n", "pos", "common", "component", "block", "nh", "a"))
        cut = np.concatenate(([True], (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
        draw = mix(doc.astype(np.uint64) * M2 + np.uint64(attempt or 0))
        found: set[tuple[int, int]] = set()
        sure_of: dict[tuple[int, int], tuple[int, int]] = {}
        starts = np.flatnonzero(cut).tolist()
        for s, e in zip(starts, [*starts[1:], len(token)], strict=True):
            if (comp[s:e] == comp[s]).all():
                continue
            best: dict[int, tuple[int, int]] = {}
            for i, j, sure in _open(n[s:e], pos[s:e], common[s:e], int(nh[s]), comp[s:e], block[s:e], doc[s:e], int(head[s])):
                x, y = doc[s:e][i], doc[s:e][j]
                if derive:
                    for c, d, u, v in zip(comp[s:e][i[sure]].tolist(), comp[s:e][j[sure]].tolist(), x[sure].tolist(), y[sure].tolist(), strict=True):
                        sure_of.setdefault((c, d) if c < d else (d, c), (u, v) if u < v else (v, u))
                    x, y, i, j = x[~sure], y[~sure], i[~sure], j[~sure]
                if attempt is None:
                    found.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))
                    continue
                for u, v, d in zip(x.tolist(), y.tolist(), (draw[s:e][i] ^ draw[s:e][j]).tolist(), strict=True):
                    if u not in best or d < best[u][0]:
                        best[u] = (d, v)
            found.update((u, v) if u < v else (v, u) for u, (_, v) in best.items())
        pairs = [*sorted(found), *sorted(sure_of.values())]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64()), "derived": pa.array([False] * len(found) + [True] * len(sure_of), pa.bool_())})

    return run


def _units(lists: DataFrame, attempt: int | None) -> DataFrame:
    """Entries of the lists with more than one component, with a task (unit), and the pair of blocks (lo, hi) and own block there.

    A list of at most BLOCK sets is one block, and lists of one head go together, as many as its size allows. A longer one
    has blocks of its own by a hash: with an attempt each is alone; without, sets outside the list's largest component
    meet all blocks, the others only the former's.
    """
    by = lists.groupBy("token", "component").agg(F.count("*").alias("m"))
    stats = by.groupBy("token").agg(F.count("*").alias("parts"), F.sum("m").alias("total"), F.max_by("component", F.struct("m", "component")).alias("major"), F.max("m").alias("most")).where("parts > 1")
    rows = lists.join(stats, "token").drop("parts")
    one = F.col("total") <= BLOCK
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    if attempt is None:
        minor, less, more = F.col("component") != F.col("major"), blocks(F.col("total") - F.col("most")), blocks(F.col("most"))
        rows = rows.withColumn("block", F.when(one, 0).when(minor, F.pmod(F.xxhash64("b"), less)).otherwise(less + F.pmod(F.xxhash64("b"), more)).cast("int"))
        others = F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.when(minor, less + more).otherwise(less) - 1))
        rows = rows.withColumn("other", F.explode(others))
        rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    else:
        rows = rows.withColumn("block", F.when(one, 0).otherwise(F.pmod(F.xxhash64("b", F.lit(attempt)), blocks(F.col("total")))).cast("int")).withColumns({"lo": F.col("block"), "hi": F.col("block")})
    dealt = F.pmod(F.xxhash64("token"), F.ceil(F.col("nh") / 64))
    unit = F.when(one, F.xxhash64("a", dealt)).otherwise(F.xxhash64("token", "lo", "hi"))
    return rows.select(unit.alias("unit"), "token", "lo", "hi", "block", "a", "b", "n", "pos", "common", "nh", "component")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs, words, of in _documents(batch.column(0).to_pylist(), batch.column(1)):
            sets, token = shingles(words, of)
            n, k1, k2 = set_keys(sets, token, len(docs))
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(n, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], ["doc_id", "n_shingles", "k1", "k2"])


def frequent_tokens(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens with their counts, FREQUENT at most: those above the least level of a histogram of
    counts that so many reach, so that no more than these go to the driver."""
    counts = materialize(texts.mapInArrow(_frequent, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n") * 8).cast("int")
    above, cut = 0, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred levels
        above += r["count"]
        if above > FREQUENT:
            break
        cut = r["level"]
    top = counts.where(level >= cut).toArrow() if cut is not None else pa.table({"token": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    release(counts)
    token, count = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(token)
    return token[order], count[order]


def _index_lists(texts: DataFrame) -> DataFrame:
    """LIST_SCHEMA: candidate pairs of short lists and of heads, and the entries of long lists, written once."""
    frequent, count = frequent_tokens(texts)
    buckets = 1 << (max(4 * shuffle_partitions(texts.sparkSession), -(-total_bytes(texts, "text") // BUCKET)) - 1).bit_length()
    packed = texts.mapInArrow(_index(frequent, count, buckets), "bucket int, entries binary")
    return materialize(packed.groupBy("bucket").applyInArrow(_candidates, LIST_SCHEMA))


def _linked(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("common") * DOWN >= (F.col("na") + F.col("nb") - F.col("common")) * UP)


def _long_lists(found: DataFrame, first: DataFrame) -> DataFrame:
    """Entries of the long lists with what each has in common with its head."""
    known = first.select("a", "b", "common").unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b"), "common"))
    lists = found.where("kind = 1").drop("kind").join(known, ["a", "b"], "left")
    return materialize(lists.withColumn("common", F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.coalesce("common", F.lit(-1)))))


def jaccard_links(docs: DataFrame) -> DataFrame:
    """a, b (a < b), na, nb, common: every pair of different sets that link, each set named by the least doc_id that has it
    (or had it where they first met); copies of a set aren't expanded. jaccard_components() tells which ids share a set.

    Sets as there. All pairs that bounds leave open are compared, connected or not. An empty table gives none.
    """
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    found = _index_lists(texts)
    tried = materialize(found.where("kind = 0").select("a", "b").distinct())
    first = materialize(verify(tried, texts))
    out = _linked(first)
    lists = _long_lists(found, first)
    if not lists.isEmpty():
        units = _units(lists.withColumn("component", F.col("b")), None)
        more = units.groupBy("unit").applyInArrow(_open_pairs(None, False), "a long, b long, derived boolean").select("a", "b").distinct()
        more = materialize(more.join(tried, ["a", "b"], "left_anti"))
        out = out.unionByName(_linked(verify(more, texts)))
    release(found, tried)
    return out


def _set_components(texts: DataFrame) -> DataFrame:
    """id and component of the sets that link."""
    found = _index_lists(texts)
    tried = materialize(found.where("kind = 0").select("a", "b").distinct())
    first = materialize(verify(tried, texts))
    links = _linked(first).select("a", "b")
    linked = components(links)
    lists = _long_lists(found, first)
    release(found)
    if lists.isEmpty():
        return linked
    texts_of = materialize(_named(texts, lists.select(F.col("b").alias("id"))))
    # most open pairs fall together after a few attempts at one partner of each set; then all that are still open
    attempts: list[int | None] = [*range(ATTEMPTS), None]
    while attempts:
        attempt = attempts.pop(0)
        entry = lists.join(linked.select(F.col("id").alias("b"), "component"), "b", "left").withColumn("component", F.coalesce("component", "b"))
        more = _units(entry, attempt).groupBy("unit").applyInArrow(_open_pairs(attempt, True), "a long, b long, derived boolean")
        more = more.groupBy("a", "b").agg(F.max("derived").alias("derived"))
        more = materialize(more.join(tried, ["a", "b"], "left_anti"))
        if more.isEmpty():
            attempts = attempts[-1:]
            continue
        tried = tried.unionByName(more.select("a", "b"))
        new = materialize(_linked(verify(more.where("not derived").select("a", "b"), texts_of)).select("a", "b").unionByName(more.where("derived").select("a", "b")))
        if not new.isEmpty():
            links = links.unionByName(new)
            linked = components(links)
    release(texts_of, lists)
    return linked


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs.

    Sets are the distinct shingles of N lower-cased words of whole texts (fewer words: the whole sequence as one;
    none or null: empty, linked with nothing). Sets link when DOWN * |x & y| >= UP * |x | y|. component_id is the least
    doc_id reachable by links; pairs that are connected already aren't compared (jaccard_links() does). doc_id must name
    one text; repeated equal rows come out once each with the same result; rows with null doc_id have a null component_id
    and link with nothing. Other columns are ignored. An empty table gives none. Tokens are 64-bit hashes.
    """
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    linked = _set_components(texts)
    schema = "doc_id long, n_shingles long, k1 long, k2 long"
    keys = materialize(texts.mapInArrow(_keys, schema))
    classes = keys.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    several = classes.where("size > 1").select("k1", "k2", "n_shingles", "rep")
    out = keys.join(several, ["k1", "k2", "n_shingles"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(linked.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    nameless = docs.where("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(_keys, schema)
    null = F.lit(None).cast("long")
    return out.unionByName(nameless.select(null.alias("doc_id"), "n_shingles", null.alias("component_id")))


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op7_ngram_jaccard_join": op7_ngram_jaccard_join}
ORACLES: dict[str, str] = {}
