"""Exact substring deduplication over a sparse enhanced suffix array.

Every string of ``min_len`` bytes holds a minimizer: the least hash among its k-grams, of equal ones the first. Equal
strings hold the same one at the same offset, so text positions that are minimizers ("anchors") and the bytes around them
(the "context", as far as the strings of min_len bytes that have the anchor as their minimizer reach) decide every repeat.
Each string belongs to one anchor. Where groups are listed, contexts are wide: all equal least k-grams are anchors, and
every string of min_len bytes around one counts, so that longer strings are seen as one.

1. Anchors of all texts, packed by hash bucket, one shuffle. Anchors that occur once are dropped; occurrences
   with an equal context form one leaf of the common-prefix interval tree and are a repeat group of that context.
2. Where one anchor has several contexts, the contexts' bytes are fetched and put in a suffix array sampled at the
   anchors. A stack scan over its longest-common-prefix values gives the interval tree; in every interval the
   left sides are tested for diversity, and each left-diverse, right-maximal set of occurrences whose common string
   has min_len bytes or more is a repeat group with all its occurrences.
   An anchor with more contexts than HOT doesn't go to one task: there, the strings of min_len bytes around each of its
   occurrences are grouped by hash in Spark: at most one row for each byte of the text.
3. A byte goes if a group covers it at an occurrence that isn't the group's first.

Equality of contexts means equal 64-bit hashes of both the anchor and its context (two different contexts of one anchor
agree with a chance of 2^-64). maximal_repeats() compares bytes as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_names, materialize, release, shuffle_partitions, total_bytes
from .hashing import mix, pair, runs, sliding, window_hash

LOG2_GRAM = 5
GRAM = 1 << LOG2_GRAM
SLICE = 1 << 20
FLUSH = 1 << 19
#: Contexts of one anchor that are put in one suffix array, at most.
HOT = 2048
#: Strings of such anchors in one sorted range.
RANGE = 1 << 20
#: Bytes of text for each bucket of anchors and for each part of the documents.
BUCKET, PART = 16 << 20, 32 << 20

ANCHOR = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("left", "u1"), ("size", "u1")])
COVER_SCHEMA = "grp long, doc_id long, lo long, hi long, first boolean"
FOUND_SCHEMA = "kind int, grp long, doc_id long, lo long, hi long, left int, first boolean"


def _slices(ids: list, texts: pa.ChunkedArray | pa.Array, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about SLICE at a time: data, starts of pieces, their ends, doc_ids and offsets in their document.

    A longer document comes in pieces that overlap by enough for every window to lie inside one of them.
    """
    parts, sizes, docs, offs, total = [], [], [], [], 0

    def out():
        ends = np.cumsum(sizes)
        return np.concatenate(parts), ends - sizes, ends, np.array(docs, np.int64), np.array(offs, np.int64)

    for doc, text in zip(ids, texts, strict=True):
        raw = text.as_buffer() if doc is not None and text.is_valid else None
        if raw is None or raw.size < overlap:
            continue
        data = np.frombuffer(raw, np.uint8)
        at = 0
        while True:
            piece = data[at : at + SLICE]
            parts.append(piece)
            sizes.append(len(piece))
            docs.append(doc)
            offs.append(at)
            total += len(piece)
            if total >= SLICE:
                yield out()
                parts, sizes, docs, offs, total = [], [], [], [], 0
            if at + len(piece) >= len(data):
                break
            at += SLICE - overlap
    if parts:
        yield out()


def _anchors(data, starts, ends, docs, offs, min_len: int, wide: bool = False) -> np.ndarray:
    """Anchors of one slice whose context can hold a string of min_len bytes."""
    reach = min_len - GRAM
    if len(data) < min_len:
        return np.zeros(0, ANCHOR)
    h = window_hash(data, LOG2_GRAM)
    if wide:
        least = sliding(np.minimum, h, reach + 1)
        # p is an anchor if some window's least value equals its own: the largest of the leasts around it
        pad = np.zeros(reach, np.uint64)
        most = sliding(np.maximum, np.concatenate((pad, least, pad)), reach + 1)
        p = np.flatnonzero(most[: len(h)] == h)
        begin, end = p - reach, p + min_len
    else:
        # a window's anchor is the first of its least values by their high bits (the same in every slice); it moves on with the window,
        # so that an anchor's windows are neighbours
        low = np.uint64((1 << (2 * SLICE - 1).bit_length()) - 1)
        of_window = sliding(np.minimum, (h & ~low) | np.arange(len(h), dtype=np.uint64), reach + 1) & low
        begin = runs(of_window)
        p, end = of_window[begin].astype(np.int64), np.append(begin[1:], len(of_window)) - 1 + min_len
    of = np.searchsorted(ends, p, "right")
    lo, hi = np.maximum(starts[of], begin), np.minimum(ends[of], end)
    ok = (hi - lo >= min_len) & (p + GRAM <= hi)
    p, of, lo, hi = p[ok], of[ok], lo[ok], hi[ok]
    c = (p - lo).astype(np.uint64) << np.uint64(8)
    c |= (hi - lo - min_len).astype(np.uint64)
    for j in range(-(-(2 * min_len - GRAM) // GRAM)):
        c = pair(c, h[np.minimum(lo + j * GRAM, hi - GRAM)])
    out = np.empty(len(p), ANCHOR)
    out["h"], out["c"], out["doc"], out["lo"], out["left"], out["size"] = h[p], mix(c), docs[of], lo - starts[of] + offs[of], p - lo, hi - lo
    return out


def _position(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return a["doc"], a["lo"].astype(np.int64) + a["left"]


def _by_class(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (h, c, position); starts of classes; which occurrences stand after the first position of their class."""
    doc, at = _position(a)
    a = a[np.lexsort((at, doc, a["c"], a["h"]))]
    first = np.concatenate(([True], (a["h"][1:] != a["h"][:-1]) | (a["c"][1:] != a["c"][:-1]))) if len(a) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    doc, at = _position(a)
    of = np.cumsum(first) - 1
    later = (doc != doc[start][of]) | (at != at[start][of]) if len(a) else first
    return a, start, later


def _pack(a: np.ndarray) -> bytes:
    """Column after column, positions as byte planes, so that the shuffle's codec finds their zeros."""
    cols = [np.ascontiguousarray(a[n]) for n in ANCHOR.names]
    return b"".join(c.view(np.uint8).reshape(len(a), c.itemsize).T.tobytes() if n in ("doc", "lo") else c.tobytes() for n, c in zip(ANCHOR.names, cols, strict=True))


def _unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // ANCHOR.itemsize
    a, at = np.empty(n, ANCHOR), 0
    for name in ANCHOR.names:
        kind = ANCHOR[name]
        part = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        at += n * kind.itemsize
        a[name] = np.ascontiguousarray(part.reshape(kind.itemsize, n).T).view(kind).ravel() if name in ("doc", "lo") else part.view(kind)
    return a


def _group_ids(a: np.ndarray) -> np.ndarray:
    return pair(a["h"], a["c"]).view(np.int64)


def _cover(a: np.ndarray, first: np.ndarray) -> dict:
    lo = a["lo"].astype(np.int64)
    return {"grp": _group_ids(a), "doc_id": a["doc"], "lo": lo, "hi": lo + a["size"], "first": first}


def _map_anchors(min_len: int, buckets: int, wide: bool):
    schema = pa.schema([("bucket", pa.int32()), ("anchors", pa.binary()), ("later", pa.binary())])
    shift = np.uint64(64) - np.uint64(buckets.bit_length() - 1)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        # equal contexts meet here first: only the earliest of a task's batch goes on to be compared with others
        a, _, later = _by_class(np.concatenate(held))
        # anchors are least hashes: by their own high bits most of them would meet in the first buckets
        bucket = (mix(a["h"].copy()) >> shift).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        a, later = a[order], later[order]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(b, _pack(a[i:j][~later[i:j]]), _pack(a[i:j][later[i:j]])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for piece in _slices(batch.column(0).to_pylist(), batch.column(1), min_len):
                a = _anchors(*piece, min_len, wide)
                held.append(a)
                n += len(a)
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _reduce_anchors(with_first: bool):
    """Leaves of the tree: covers of equal contexts, and requests (kind 1) for the bytes of differing ones."""

    def run(t: pa.Table) -> pa.Table:
        late = np.concatenate([_unpack(x.as_py()) for x in t["later"]])
        a, start, later = _by_class(np.concatenate([_unpack(x.as_py()) for x in t["anchors"]]))
        rep = a[start]
        many = np.zeros(len(rep), bool)  # anchors with more than one context
        same = rep["h"][1:] == rep["h"][:-1]
        many[1:] |= same
        many[:-1] |= same
        ask = rep[many]
        parts = [_cover(late, np.zeros(len(late), bool)), _cover(a[later], np.zeros(int(later.sum()), bool))]
        lefts = np.zeros(len(late) + int(later.sum()), np.int32)
        if with_first:
            held = np.isin(_group_ids(rep), np.concatenate([p["grp"] for p in parts]))
            parts.append(_cover(rep[held], np.ones(int(held.sum()), bool)))
            lefts = np.concatenate((late["left"], a["left"][later], rep["left"][held])).astype(np.int32)
        cover = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        lo = ask["lo"].astype(np.int64)
        asked = {"grp": ask["h"].view(np.int64), "doc_id": ask["doc"], "lo": lo, "hi": lo + ask["size"], "first": np.zeros(len(ask), bool)}
        n, m = len(cover["grp"]), len(ask)
        out = {k: np.concatenate((cover[k], asked[k])) for k in cover}
        out["kind"] = np.repeat(np.array([0, 1], np.int32), (n, m))
        out["left"] = np.concatenate((lefts, ask["left"].astype(np.int32)))
        return pa.table({k: out[k] for k in ("kind", "grp", "doc_id", "lo", "hi", "left", "first")})

    return run


def _fetch(key, asked: pa.Table, texts: pa.Table) -> pa.Table:
    """Bytes of the contexts asked for."""
    at = {}
    for doc, text in zip(texts["doc_id"].to_pylist(), texts["text"], strict=True):
        if doc is not None and text.is_valid and doc not in at:
            at[doc] = text.as_buffer()
    lo, hi = asked["lo"].to_numpy(), asked["hi"].to_numpy()
    ctx = [at[d][i:j].to_pybytes() for d, i, j in zip(asked["doc_id"].to_pylist(), lo.tolist(), hi.tolist(), strict=True)]
    return pa.table({"grp": asked["grp"], "doc_id": asked["doc_id"], "lo": asked["lo"], "left": asked["left"], "ctx": pa.array(ctx, pa.binary())})


def _order(key: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order by key, then bytes; of rows that differ only in zero bytes at their end, the shorter first."""
    wide = -(-rows.shape[1] // 8) * 8
    words = np.zeros((len(rows), wide), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(">u8").astype(np.uint64)
    return np.lexsort((sizes, *words.T[::-1], key))


def _common(rows: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows i and j."""
    differ = rows[i] != rows[j]
    n = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(n, np.minimum(sizes[i], sizes[j]))


def _intervals(lcp: list[int], i: int, j: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, end) of each common-prefix interval of the sorted suffixes i..j-1, by a stack scan; lcp[k] is that of k-1 and k."""
    stack: list[list[int]] = []
    for k in range(i + 1, j + 1):
        depth, left = (lcp[k] if k < j else 0), k - 1
        while stack and stack[-1][0] > depth:
            d, left = stack.pop()
            yield d, left, k
        if depth and (not stack or stack[-1][0] < depth):
            stack.append([depth, left])


def repeat_groups(key: np.ndarray, doc: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, min_len: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeat groups of sampled suffixes: (bytes left of the anchor, right of it, members).

    key: the anchors' hash; right: rows of bytes from the anchor on; left: of bytes before it, nearest first.
    """
    order = _order(key, right, n_right)
    lcp = np.zeros(len(order), np.int64)
    same = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
    lcp[same] = _common(right, n_right, order[same - 1], order[same])
    by_left = np.empty(len(order), np.int64)
    lefts = _order(key, left, n_left)
    by_left[lefts] = np.arange(len(lefts))
    starts = runs(key[order])
    depth = lcp.tolist()
    width = left.shape[1]
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        if j - i == 2:  # one interval of two: both sides are maximal at once
            members = order[i:j]
            n = int(_common(left, n_left, members[:1], members[1:])[0])
            if n + depth[i + 1] >= min_len:
                yield n, depth[i + 1], members
            continue
        for d, a, b in _intervals(depth, i, j):
            if d + width < min_len:
                continue
            members = order[a:b]
            members = members[np.argsort(by_left[members])]
            shared = np.concatenate(([0], _common(left, n_left, members[:-1], members[1:])))
            shared[shared + d < min_len] = 0
            # left-extension diversity: the same scan over the reversed left sides; each of its intervals ends where lefts part
            ends = list(_intervals(shared.tolist(), 0, len(members)))
            if d >= min_len:
                ends.append((0, 0, len(members)))
            for n, x, y in ends:
                yield n, d, members[x:y]


def _at_first(doc: np.ndarray, at: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which members stand at the earliest position."""
    low = doc[m].min()
    return (doc[m] == low) & (at[m] == at[m][doc[m] == low].min())


def _search(min_len: int, with_first: bool):
    reach = min_len - GRAM

    def run(t: pa.Table) -> pa.Table:
        key, doc, lo, n_left = (t[c].to_numpy() for c in ("grp", "doc_id", "lo", "left"))
        n_left = n_left.astype(np.int64)
        raw = [x.as_buffer() for x in t["ctx"]]
        size = np.array([x.size for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.cumsum(size) - size
        n_right = size - n_left
        anchor = (begin + n_left)[:, None]
        span = np.arange(min_len)
        right = np.where(span < n_right[:, None], data[np.minimum(anchor + span, len(data) - 1)], 0)
        span = np.arange(reach)
        left = np.where(span < n_left[:, None], data[np.maximum(anchor - 1 - span, 0)], 0)
        at = lo + n_left
        groups = repeat_groups(key, doc, at, left, right, n_left, n_right, min_len)
        if with_first:
            out = {k: [np.zeros(0, np.int64)] for k in ("grp", "doc_id", "lo", "hi", "at")} | {"first": [np.zeros(0, bool)], "whole": [np.zeros(0, bool)]}
            for n, d, m in groups:
                string = data[begin[m[0]] + n_left[m[0]] - n : begin[m[0]] + n_left[m[0]] + d]
                if not (sliding(np.minimum, window_hash(string, LOG2_GRAM), reach + 1) == key.view(np.uint64)[m[0]]).any():
                    continue  # no string of min_len bytes of it has this minimizer: other places of it may lack the anchor
                string = string.tobytes()
                grp = int.from_bytes(hashlib.blake2b(key[m[:1]].tobytes() + bytes([n]) + string, digest_size=8).digest(), "little", signed=True)
                for k, v in (("grp", np.full(len(m), grp)), ("doc_id", doc[m]), ("lo", at[m] - n), ("hi", at[m] + d), ("first", _at_first(doc, at, m)), ("at", at[m]), ("whole", (n_left[m] == n) & (n_right[m] == d))):
                    out[k].append(v)
            return pa.table({k: np.concatenate(v) for k, v in out.items()})
        # all groups of an occurrence hold its anchor, so what they cover of it is one stretch
        before, after = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for n, d, m in groups:
            m = m[~_at_first(doc, at, m)]
            before[m], after[m] = np.maximum(before[m], n), np.maximum(after[m], d)
        hit = after > 0
        return pa.table({"grp": key[hit], "doc_id": doc[hit], "lo": (at - before)[hit], "hi": (at + after)[hit], "first": np.zeros(int(hit.sum()), bool)})

    return run


def _windows(min_len: int, wide: bool):
    """grp, h, doc_id, at, lo: every string of min_len bytes in each context that has the anchor as a minimizer (of contexts that
    aren't wide: every one), as a hash."""
    log2, reach = min_len.bit_length() - 1, min_len - GRAM
    schema = pa.schema([("grp", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("lo", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            grp, doc, lo, left = (batch.column(c).to_numpy() for c in ("grp", "doc_id", "lo", "left"))
            size = np.array([x.as_buffer().size for x in batch.column("ctx")], np.int64)
            if not len(size):
                continue
            data = np.frombuffer(b"".join(x.as_py() for x in batch.column("ctx")), np.uint8)
            begin = np.cumsum(size) - size
            h = window_hash(data, log2)
            h = pair(h[: len(data) - min_len + 1], h[min_len - (1 << log2) : len(data) - (1 << log2) + 1])  # two windows that cover it
            many = size - min_len + 1
            row = np.repeat(np.arange(len(size)), many)
            off = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            if wide:
                least = sliding(np.minimum, window_hash(data, LOG2_GRAM), reach + 1)
                own = least[begin[row] + off] == grp.view(np.uint64)[row]
                row, off = row[own], off[own]
            cols = (grp[row], h[begin[row] + off].view(np.int64), doc[row], lo[row] + left[row], lo[row] + off)
            for i in range(0, len(row), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)], pa.int64()) for c in cols], schema=schema)

    return run


def _mark_later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grp, h, doc_id, at, lo and place of sorted strings of one range, with head (like the range's first string) and later
    (the range has the same string at an earlier place; a place with several equal anchors is one place)."""
    begin = known = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a = np.stack([batch.column(c).to_numpy() for c in ("grp", "h", "doc_id", "lo")], 1)
        begin, known = (a[0, :2], a[0]) if begin is None else (begin, known)
        new = (a[:, :2] != np.concatenate((known[None], a[:-1]))[:, :2]).any(1)
        run = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        first = np.where((run >= 0)[:, None], a[np.maximum(run, 0)], known)
        known = first[-1]
        marks = [pa.array((a[:, :2] == begin).all(1)), pa.array((a[:, 2:] != first[:, 2:]).any(1))]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("grp", "h", "doc_id", "at", "lo", "place")], *marks], ["grp", "h", "doc_id", "at", "lo", "place", "head", "later"])


def _search_hot(contexts: DataFrame, min_len: int, with_first: bool) -> DataFrame:
    """What _search() gives, for anchors of any number of contexts: groups are strings of min_len bytes.

    Strings stand sorted in ranges, equal ones in order of their places, so that rows before tell whether one is the first of
    its like; only a range's first string may have begun in the range before. Nothing is joined, and no key meets in one task.
    """
    spark = contexts.sparkSession
    rows = materialize(contexts.mapInArrow(_windows(min_len, with_first), "grp long, h long, doc_id long, at long, lo long"))
    key = ["grp", "h", "doc_id", "lo"]
    placed = rows.repartitionByRange(max(shuffle_partitions(spark), -(-rows.count() // RANGE)), *key).sortWithinPartitions(*key).withColumn("place", F.spark_partition_id())
    marked = materialize(placed.mapInArrow(_mark_later, "grp long, h long, doc_id long, at long, lo long, place int, head boolean, later boolean"))
    release(rows)
    ends = marked.groupBy("place").agg(F.min(F.struct("grp", "h")).alias("b"), F.max(F.struct("grp", "h")).alias("e"))
    before = F.lag("e").over(Window.orderBy("place"))  # a row per range
    begun = [r.place for r in ends.withColumn("before", before).where("before = b").select("place").collect()]
    hits = marked.withColumn("later", F.col("later") | (F.col("head") & F.col("place").isin(begun))) if begun else marked
    if with_first:
        hits = hits.join(hits.where("later").select("grp", "h").distinct(), ["grp", "h"], "left_semi")
        return hits.select(F.xxhash64("grp", "h").alias("grp"), "doc_id", "lo", (F.col("lo") + min_len).alias("hi"), (~F.col("later")).alias("first"), "at", F.lit(True).alias("whole"))
    return hits.where("later").groupBy("grp", "doc_id", "at").agg(F.min("lo").alias("lo"), (F.max("lo") + min_len).alias("hi")).select("grp", "doc_id", "lo", "hi", F.lit(False).alias("first"))


def _by_document(docs: DataFrame, parts: int, keep: tuple[str, ...] = ()) -> DataFrame:
    row = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select("doc_id", "text", *keep, F.pmod(row, F.lit(parts)).cast("int").alias("part"))


def _parts(docs: DataFrame, n_bytes: int | None = None) -> int:
    """Parts of the documents: they follow the bytes of text, so that none grows with the corpus."""
    n_bytes = total_bytes(docs, "text") if n_bytes is None else n_bytes
    return max(2 * shuffle_partitions(docs.sparkSession), -(-n_bytes // PART))


def _with_classes(leaves: DataFrame, searched: DataFrame) -> DataFrame:
    """Groups with all members: an interval's representatives stand for all occurrences of their contexts.

    A class whose whole context is an interval's string is that interval's group and none of its own.
    """
    leaves = leaves.select(F.col("grp").alias("class"), "doc_id", "lo", "hi", "first", (F.col("lo") + F.col("left")).alias("at"))
    heads = leaves.where("first").select("class", "doc_id", "at")
    ranges = searched.join(heads, ["doc_id", "at"]).select("class", "grp", (F.col("lo") - F.col("at")).alias("before"), (F.col("hi") - F.col("at")).alias("after"), "whole")
    others = ranges.join(leaves.where("not first"), "class").select("grp", "doc_id", (F.col("at") + F.col("before")).alias("lo"), (F.col("at") + F.col("after")).alias("hi"), F.lit(False).alias("first"))
    alone = leaves.join(ranges.where("whole").select("class"), "class", "left_anti").select(F.col("class").alias("grp"), "doc_id", "lo", "hi", "first")
    return alone.unionByName(searched.select("grp", "doc_id", "lo", "hi", "first")).unionByName(others).distinct()


def find_repeats(docs: DataFrame, min_len: int = 100, with_first: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences of repeat groups: grp, doc_id, lo, hi (bytes), first.

    Each group is a string of min_len bytes or more with all its occurrences: from its anchor it reaches as far to
    both sides as its occurrences agree, or as strings of min_len bytes around the anchor go (without with_first, those that
    have no other anchor); a longer repeat is a chain of groups. Without with_first, occurrences at a group's earliest position
    are left out, and what the suffix array's groups cover of an occurrence is one row. keep names columns that a later step wants with the same shuffle of texts. Rows with null doc_id or text, or a text shorter than min_len, have none.
    """
    if not GRAM < min_len <= 140:
        raise ValueError(f"min_len must be in {GRAM + 1}..140")
    n_bytes = total_bytes(docs, "text")
    buckets = 1 << (max(4 * shuffle_partitions(docs.sparkSession), -(-n_bytes // BUCKET)) - 1).bit_length()
    packed = docs.select("doc_id", "text").mapInArrow(_map_anchors(min_len, buckets, with_first), "bucket int, anchors binary, later binary")
    found = materialize(packed.groupBy("bucket").applyInArrow(_reduce_anchors(with_first), FOUND_SCHEMA))
    many = _parts(docs, n_bytes)
    asked = found.where("kind = 1").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(many)).cast("int"))
    contexts = asked.groupBy("part").cogroup(_by_document(docs, many, keep).groupBy("part")).applyInArrow(_fetch, "grp long, doc_id long, lo long, left int, ctx binary")
    hot = materialize(asked.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("grp"))
    some = not hot.isEmpty()
    if some:
        contexts = materialize(contexts)
    searched = (
        (contexts.join(hot, "grp", "left_anti") if some else contexts)
        .withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(many)).cast("int"))
        .groupBy("bucket")
        .applyInArrow(_search(min_len, with_first), COVER_SCHEMA + ", at long, whole boolean" if with_first else COVER_SCHEMA)
    )
    if some:
        searched = searched.unionByName(_search_hot(contexts.join(hot, "grp", "left_semi"), min_len, with_first))
    if with_first:
        return _with_classes(found.where("kind = 0"), materialize(searched))
    return found.where("kind = 0").select("grp", "doc_id", "lo", "hi", "first").unionByName(searched)


def _common_ends(a: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Bytes that the least and the greatest of a group's right and left sides, hence all, have in common."""
    for row in a.to_pylist():
        out = []
        for x, y in ((row["r0"], row["r1"]), (row["l0"], row["l1"])):
            n = min(len(x), len(y))
            p, q = np.frombuffer(x, np.uint8, n), np.frombuffer(y, np.uint8, n)
            out.append(int((p != q).argmax()) if (p != q).any() else n)
        yield out[0], out[1]


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = list(_common_ends(batch))
        cols = [batch.column(0), pa.array([x for x, _ in both], pa.int64()), pa.array([x for _, x in both], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["grp", "after", "before"])


def maximal_repeats(docs: DataFrame, min_len: int = 100, step: int = 1024) -> DataFrame:
    """grp, doc_id, lo, hi, first: every maximal repeat group that find_repeats() comes upon, with all its occurrences.

    The groups of find_repeats(), whose strings end where contexts do, are extended to both sides by comparing bytes, step
    by step, until their occurrences part or a text ends; groups that become one string are one. A string each of whose
    stretches around an anchor also stands elsewhere is listed as these stretches' strings. Rows as in find_repeats().
    """
    open_ = materialize(find_repeats(docs, min_len, True))
    raw = docs.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.min(F.col("text").cast("binary")).alias("raw"))
    done = None
    while not open_.isEmpty():
        sides = open_.join(raw, "doc_id").select(
            "grp", F.expr(f"substring(raw, int(hi) + 1, {step})").alias("r"), F.expr(f"unhex(reverse(hex(substring(raw, int(greatest(lo - {step}, 0)) + 1, int(lo - greatest(lo - {step}, 0))))))").alias("l")
        )
        ends = sides.groupBy("grp").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("l").alias("l0"), F.max("l").alias("l1"))
        grown = open_.join(ends.mapInArrow(_extend, "grp long, after long, before long"), "grp")
        grown = materialize(grown.select("grp", "doc_id", (F.col("lo") - F.col("before")).alias("lo"), (F.col("hi") + F.col("after")).alias("hi"), "first", ((F.col("before") == step) | (F.col("after") == step)).alias("more")))
        ready = grown.where("not more").drop("more")
        done = ready if done is None else done.unionByName(ready)
        release(open_)
        open_ = materialize(grown.where("more").drop("more"))
    if done is None:
        return open_
    once = done.where("first").groupBy("doc_id", "lo", "hi").agg(F.min("grp").alias("grp")).select("grp")
    return done.join(once, "grp")


DIGEST_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(texts_out: bool, keep: tuple[str, ...]):
    def run(key, spans: pa.Table, texts: pa.Table) -> pa.Table:
        doc, lo, hi = (spans[c].to_numpy() for c in ("doc_id", "lo", "hi"))
        order = np.lexsort((lo, doc))
        doc, lo, hi = doc[order], lo[order], hi[order]
        out = []
        ids = texts["doc_id"].to_pylist()
        wanted = np.array([-1 if d is None else d for d in ids], np.int64)
        first, last = np.searchsorted(doc, wanted, "left"), np.searchsorted(doc, wanted, "right")
        for d, text, i, j in zip(ids, texts["text"], first.tolist(), last.tolist(), strict=True):
            raw = bytes(text.as_buffer()) if text.is_valid else b""
            n = len(raw)
            if d is None or i == j:
                removed, spans_n, kept = 0, 0, raw
            else:
                a, most = lo[i:j], np.maximum.accumulate(hi[i:j])
                head = np.flatnonzero(np.concatenate(([True], a[1:] > most[:-1])))
                ends = np.concatenate((most[head[1:] - 1], most[-1:]))
                begins = a[head]
                removed, spans_n = int((ends - begins).sum()), len(head)
                kept = b"".join(raw[x:y] for x, y in zip([0, *ends.tolist()], [*begins.tolist(), n], strict=True))
            row = (d, n, removed, spans_n)
            out.append((*row, (kept.decode("utf-8", "ignore") if removed else text.as_py()) if texts_out else hashlib.sha256(kept).hexdigest()))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "text" if texts_out else "kept_sha256"]
        types = [pa.int64()] * 4 + [pa.string()]
        done = {n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, types, strict=True))}
        return pa.table(done | {c: texts[c] for c in keep})

    return run


def _apart(docs: DataFrame) -> DataFrame | None:
    """doc_id, h and key: where one doc_id has several texts, a key for each id and text in order of doc_id and the text's hash."""
    ids = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h")).distinct()
    if ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        return None
    return materialize(ids.orderBy("doc_id", "h").withColumn("key", F.monotonically_increasing_id()))


def remove_repeats(docs: DataFrame, min_len: int = 100, texts: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove each byte that a string of min_len bytes covers which also starts earlier (smaller doc_id, or same
    document and earlier start).

    One row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 or, with
    texts, the remaining text (bytes of a character cut in two go as well). Wholly repeated rows all get the same result,
    as one document; different texts under one doc_id are documents of their own, in order of a hash. Null text: 0 bytes
    (with texts it stays null); null doc_id: kept whole and earlier than nothing. An empty table gives none. Columns other
    than doc_id and text are left out but for those in keep.
    """
    keys = _apart(docs)
    if keys is not None:
        (own,) = free_names(docs, "own_id")
        h = docs.withColumn("h", F.xxhash64("text"))
        docs = h.join(keys, ["doc_id", "h"], "left").select("text", *keep, F.col("doc_id").alias(own), F.col("key").alias("doc_id"))
        out = remove_repeats(materialize(docs), min_len, texts, (*keep, own))
        return out.withColumn("doc_id", F.col(own)).drop(own)
    many = _parts(docs)
    spans = find_repeats(docs, min_len, keep=keep).where("not first").select("doc_id", "lo", "hi", F.pmod(F.xxhash64("doc_id"), F.lit(many)).cast("int").alias("part"))
    schema = DIGEST_SCHEMA.replace("kept_sha256", "text") if texts else DIGEST_SCHEMA
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) if keep else ""
    return spans.groupBy("part").cogroup(_by_document(docs, many, keep).groupBy("part")).applyInArrow(_apply(texts, keep), schema)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
ORACLES: dict[str, str] = {}
