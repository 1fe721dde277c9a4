"""Prefix trie of conversations: which beginnings they share and what sharing them saves.

1. Turns become digests of role and text and the text's size; they get places by a range sort with prefix sums over its
   parts, and the conversations are rebuilt from them.
2. A conversation's turns go into segments of at most SEGMENT turns, one row each. Segments of one level are sorted by
   (segments before, turns, conversation) in ranges, and each range is cut into shards of bounded size.
3. A shard's trie is encoded as balanced parentheses: findclose by range min-max blocks of the excess delimits a subtree,
   the rank of "()" counts its leaves, differences of cumulative arrays give its members and savings.
4. Only nodes on the path of a shard's first or last row (its spines) can stand in other shards as well. They are merged
   by their prefix's digest; what a spine node adds itself goes up one path by a window.
5. Where conversations are longer than a segment, levels are worked from the deepest up; a piece's root hands its totals
   to the node that it hangs on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import groups_for, materialize, release, table

#: Turns of a segment, rows and bytes of a shard, conversations in one piece of a node's list of ends.
SEGMENT, ROWS, BYTES, PIECE = 1024, 8192, 8 << 20, 1024
#: Bytes of a turn's digest.
WIDTH = 16
#: Bytes of segments that a task sorts on average.
TASK = 64 << 20
_NONE = hashlib.sha256(b"").hexdigest()
_FAR = np.iinfo(np.int64).max


class Parentheses:
    """Balanced parentheses with a tree of least excess over blocks."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int64)
        blocks = -(-len(bits) // self.BLOCK)
        size = 1 << max(blocks - 1, 0).bit_length()
        self.least = np.full(2 * size, _FAR)
        if blocks:
            self.least[size : size + blocks] = np.minimum.reduceat(self.excess, np.arange(0, len(bits), self.BLOCK))
        for k in range(size - 1, 0, -1):
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])
        self.size = size
        # rank of "()": pairs that open before each position
        self.pairs = np.concatenate(([0], np.cumsum(np.append(bits[:-1] & ~bits[1:], False), dtype=np.int64)))

    def _scan(self, at: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each position on to the end of its block: the first with the goal's excess, and whether there is one."""
        at = at.copy()
        done = np.zeros(len(at), bool)
        live = np.flatnonzero(at < len(self.bits))
        while len(live):
            hit = self.excess[at[live]] == goal[live]
            done[live[hit]] = True
            live = live[~hit]
            at[live] += 1
            live = live[(at[live] % self.BLOCK != 0) & (at[live] < len(self.bits))]
        return at, done

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        goal = self.excess[at] - 1
        out = at + 1
        inside = np.flatnonzero(out % self.BLOCK != 0)
        found = np.zeros(len(at), bool)
        out[inside], found[inside] = self._scan(out[inside], goal[inside])
        rest = np.flatnonzero(~found)
        if len(rest):
            need, node = goal[rest], self.size + at[rest] // self.BLOCK
            up = np.ones(len(rest), bool)
            while up.any():
                k = np.flatnonzero(up)
                turn = (node[k] % 2 == 0) & (self.least[node[k] + 1] <= need[k])
                node[k] = np.where(turn, node[k] + 1, node[k] // 2)
                up[k] = ~turn
            while (k := np.flatnonzero(node < self.size)).size:
                left = 2 * node[k]
                node[k] = np.where(self.least[left] <= need[k], left, left + 1)
            out[rest], ok = self._scan((node - self.size) * self.BLOCK, need)
            if not ok.all():
                raise ValueError("parentheses aren't balanced")
        return out


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two rows of digests share at their beginning."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[: high * WIDTH] == b[: high * WIDTH]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * WIDTH] == b[: mid * WIDTH] else (low, mid - 1)
    return low


def _least(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of values[start:stop] for each pair, by minima over powers of two."""
    rows = [values]
    while 2 << (len(rows) - 1) <= len(values):
        half = 1 << (len(rows) - 1)
        rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
    k = np.frexp((stop - start).astype(np.float64))[1] - 1
    out = np.empty(len(start), np.int64)
    for i, row in enumerate(rows):
        some = np.flatnonzero(k == i)
        out[some] = np.minimum(row[start[some]], row[stop[some] - (1 << i)])
    return out


def _sha(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else _NONE


_FIELDS = [
    ("kind", pa.string()), ("shard", pa.int64()), ("side", pa.int32()), ("slot", pa.int32()), ("root", pa.binary()), ("id", pa.binary()), ("parent", pa.binary()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()),
    ("ends", pa.string()), ("bytes", pa.int64()), ("t_children", pa.int64()), ("t_leaves", pa.int64()), ("t_saved", pa.int64()), ("t_ends", pa.string()), ("pieces", pa.list_(pa.list_(pa.int64()))),
]
_SCHEMA = pa.schema(_FIELDS)
_SPEC = (
    "kind string, shard long, side int, slot int, root binary, id binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved long, ends string, bytes long, t_children long, t_leaves long, t_saved long, t_ends string, pieces array<array<long>>"
)


def shard_trie(rows: list[tuple], shard: int, base: int) -> pa.RecordBatch:
    """Nodes of one shard. rows: (root, key, conv_id, sizes, t_children, t_leaves, t_saved, t_ends), sorted by the first three.

    kind node: whole, with a parent that is; top: whole, below the spine node (side, slot); spine: its share in this shard
    of what other nodes of its subtree add, without what spine nodes add themselves.
    """
    counts, parent, start_row, ends_at = [], [], [], []
    path: list[int] = []
    before, length = None, -1
    depth_of, size_of = [], []
    first_path: list[int] = []
    for r, (root, key, _, sizes, *_rest) in enumerate(rows):
        n = len(key) // WIDTH
        same = before is not None and before[0] == root
        keep = _shared(before[1], key) + 1 if same else 0
        counts += [length + 1 - keep, n + 1 - keep]
        new = len(parent)
        for d in range(keep, n + 1):
            parent.append(new + d - keep - 1 if d > keep else (path[keep - 1] if keep else -1))
            depth_of.append(d)
            size_of.append(sizes[d - 1] if d else 0)
            start_row.append(r)
        path[keep:] = range(new, new + n + 1 - keep)
        ends_at.append(path[n])
        before, length = (root, key), n
        if not r:
            first_path = list(path)
    counts.append(length + 1)
    bits = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
    tree = Parentheses(bits)
    opens = np.flatnonzero(bits)
    close = tree.findclose(opens)
    n = len(opens)
    number = np.arange(n)
    after = number + (close - opens + 1) // 2
    parents, end_node, convs = np.array(parent), np.array(ends_at), np.array([x[2] for x in rows], np.int64)
    spine = np.zeros(n, bool)
    spine[first_path], spine[path] = True, True
    members = np.concatenate(([0], np.cumsum(np.bincount(end_node, minlength=n))))
    n_convs = members[after] - members[number]
    at_end = np.full(n, _FAR)
    np.minimum.at(at_end, end_node, convs)
    conv = _least(at_end, number, after)
    kids = np.bincount(parents[(parents >= 0) & ~spine], minlength=n)
    below = np.array([[-1, 0, 0]] * n, np.int64)
    below_ends: dict[int, str] = {}
    for node, (*_key, t_children, t_leaves, t_saved, t_ends) in zip(ends_at, rows, strict=True):
        if t_children is not None:
            below[node] = t_children, t_leaves, t_saved
            below_ends[node] = t_ends
    on = below[:, 0] >= 0
    own = (n_convs - 1) * np.array(size_of, np.int64) + below[:, 2]
    weight = np.where(on, np.maximum(below[:, 1], 1), 1)
    leaf = bits[opens] & ~bits[opens + 1]
    leaves_upto = np.concatenate(([0], np.cumsum(np.where(spine, 0, weight)[leaf])))
    saved_upto = np.concatenate(([0], np.cumsum(np.where(spine, 0, own))))
    n_leaves = leaves_upto[tree.pairs[close]] - leaves_upto[tree.pairs[opens]]
    saved = saved_upto[after] - saved_upto[number]
    of_end: dict[int, list[int]] = {}
    for node, c, on_row in zip(ends_at, convs.tolist(), rows, strict=True):
        if on_row[4] is None:
            of_end.setdefault(node, []).append(c)

    out: dict[str, list] = {name: [] for name in _SCHEMA.names}

    def add(**values) -> None:
        for name in out:
            out[name].append(values.get(name))

    place = {node: (0, d) for d, node in enumerate(first_path)} | {node: (1, d) for d, node in enumerate(path) if node not in set(first_path)}
    for v in np.flatnonzero(~spine).tolist():
        up = parent[v]
        top = up >= 0 and spine[up]
        side, slot = place[up] if top else (None, None)
        add(
            kind="top" if top else "node", shard=shard, side=side, slot=slot, root=rows[start_row[v]][0] if up < 0 else None, conv_id=int(conv[v]), depth=base + depth_of[v], parent_conv_id=None if top or up < 0 else int(conv[up]),
            n_convs=int(n_convs[v]), n_children=int(below[v, 0] if on[v] else kids[v]), n_leaves=int(n_leaves[v]), saved=int(saved[v]), ends=below_ends.get(v) or _sha(of_end.get(v, [])),
        )
    for side, nodes in enumerate((first_path, path)):
        root, key = rows[0 if side == 0 else -1][:2]
        above, name = None, hashlib.blake2b(root, digest_size=WIDTH).digest()
        for d, v in enumerate(nodes):
            if d:
                above, name = name, hashlib.blake2b(name + key[(d - 1) * WIDTH : d * WIDTH], digest_size=WIDTH).digest()
            here = place[v][0] == side  # else the row only stands for a place on this path
            ids = of_end.get(v, []) if here else []
            add(
                kind="spine", shard=shard, side=side, slot=d, root=root if not d else None, id=name, parent=above, conv_id=int(conv[v]), depth=base + d, n_convs=int(n_convs[v]) * here, n_children=int(kids[v]) * here,
                n_leaves=int(n_leaves[v]) * here, saved=int(saved[v]) * here, bytes=size_of[v], t_children=int(below[v, 0]) if on[v] else None, t_leaves=int(below[v, 1]) if on[v] else None, t_saved=int(below[v, 2]) if on[v] else None,
                t_ends=below_ends.get(v), pieces=[ids[i : i + PIECE] for i in range(0, len(ids), PIECE)] or None,
            )
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)


def _shards(base: int, most_rows: int, most_bytes: int):
    """Cut sorted rows into shards and encode each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    rows.append(row)
                    size += len(row[1])
                    if len(rows) >= most_rows or size >= most_bytes:
                        yield shard_trie(rows, shard, base)
                        shard, rows, size = shard + 1, [], 0
        if rows:
            yield shard_trie(rows, shard, base)

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each id's comma-joined numbers; rows come sorted, one piece of numbers each."""
    name, state = None, None
    for batch in batches:
        done = []
        for key, ids in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
            text = ",".join(map(str, ids)).encode()
            if key == name:
                state.update(b"," + text)
            else:
                if name is not None:
                    done.append((name, state.hexdigest()))
                name, state = key, hashlib.sha256(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done])], ["id", "ends"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], ["id", "ends"])


def _merge(made: DataFrame) -> DataFrame:
    """Nodes of all shards of one level, the spines' shares put together."""
    spine = made.where("kind = 'spine'")
    most = [F.max(c).alias(c) for c in ("root", "parent", "depth", "bytes", "t_children", "t_leaves", "t_saved", "t_ends")]
    nodes = spine.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("kids"), F.min(F.struct("shard", "side")).alias("home"), *most)
    spine_kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("spine_kids"))
    nodes = nodes.join(spine_kids, "id", "left").withColumn("n_children", F.expr("kids + coalesce(spine_kids, 0) + coalesce(t_children, 0)"))
    nodes = materialize(
        nodes.withColumns(
            {
                "own_leaf": F.expr("CASE WHEN t_children IS NOT NULL THEN greatest(t_leaves, 1) WHEN n_children = 0 THEN 1 ELSE 0 END"),
                "own_saved": F.expr("(n_convs - 1) * bytes + coalesce(t_saved, 0)"),
            }
        )
    )
    path = Window.partitionBy("shard", "side").orderBy(F.desc("slot"))
    placed = spine.select("id", "shard", "side", "slot", "n_leaves", "saved").join(nodes.select("id", F.col("conv_id").alias("at_conv"), "home", "own_leaf", "own_saved"), "id")
    here = F.col("home") == F.struct("shard", "side")
    placed = materialize(
        placed.select(
            "id", "shard", "side", "slot", "at_conv",
            (F.col("n_leaves") + F.sum(F.when(here, F.col("own_leaf")).otherwise(0)).over(path)).alias("n_leaves"),
            (F.col("saved") + F.sum(F.when(here, F.col("own_saved")).otherwise(0)).over(path)).alias("saved"),
        )
    )
    sums = placed.groupBy("id").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    pieces = spine.where("pieces IS NOT NULL").select("id", F.explode("pieces").alias("ids")).withColumn("least", F.col("ids")[0])
    ends = pieces.repartition("id").sortWithinPartitions("id", "least").select("id", "ids").mapInArrow(_hash_ends, "id binary, ends string")
    above = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    final = nodes.join(sums, "id").join(ends, "id", "left").join(above, "parent", "left")
    shown = ["root", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    whole = final.select(*shown, F.coalesce("t_ends", "ends", F.lit(_NONE)).alias("ends"))
    tops = made.where("kind = 'top'").drop("parent_conv_id").join(placed.select("shard", "side", "slot", F.col("at_conv").alias("parent_conv_id")), ["shard", "side", "slot"])
    return whole.unionByName(tops.select(*shown, "ends")).unionByName(made.where("kind = 'node'").select(*shown, "ends"))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (place in the conversation from 0), n (its turns), digest (hex) and bytes of each turn, by turn (null first).

    Turns of equal number are ordered by the digest of role and text; wholly equal rows count each. Rows are numbered by a
    range sort, so a conversation of very many turns isn't in one task.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).alias("bytes"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    parts = groups_for(spark, 64 * conversations.count(), TASK)
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = materialize(ordered.select("conv_id", "digest", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    by_conv = Window.partitionBy("conv_id")
    runs = numbered.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("some"))
    before = F.coalesce(F.sum("some").over(by_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("conv_id", "part", (before - F.col("first")).alias("shift"), F.sum("some").over(by_conv).alias("n"))
    return numbered.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("shift")).alias("pos"), "n", "digest", "bytes")


def rebuilt(turn_rows: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """conv_id, pos, digest and bytes of each turn of the rebuilt conversations, and a row without digest at each one's end.

    Conversation c begins with the first h turns of conversation c - c % group (the remainder has c's sign), h being the
    unsigned crc32 of c's decimal digits modulo most + 1; its own turns from the h-th on follow.
    """
    convs = turn_rows.where("pos = 0").select("conv_id", "n").withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    heads = turn_rows.where((F.col("pos") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "pos", F.col("n").alias("n_base"), "digest", "bytes")
    begun = convs.join(heads, "base").where("pos < h").select("conv_id", "pos", "digest", "bytes", "n_base")
    info = materialize(convs.join(heads.where("pos = 0").select("base", "n_base"), "base", "left").select("conv_id", F.expr("least(h, coalesce(n_base, 0))").alias("taken"), "h", "n"))
    own = turn_rows.join(info.select("conv_id", "taken", "h"), "conv_id").where("pos >= h").select("conv_id", F.expr("pos - h + taken").alias("pos"), "digest", "bytes")
    end = info.select("conv_id", F.expr("taken + greatest(n - h, 0)").alias("pos"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("int").alias("bytes"))
    return own.unionByName(begun.drop("n_base")).unionByName(end)


def prefix_trie(sequences: DataFrame, segment: int = SEGMENT, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """Nodes of the trie of sequences (conv_id, pos, digest in hex, bytes; a row without digest at each one's end).

    Returns conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 for each distinct beginning; conv_id and depth name a node. Turns are equal if their
    digests of 128 bits are. An empty table has no node, not even a root.
    """
    spark = sequences.sparkSession
    turn = F.when(F.col("digest").isNotNull(), F.struct("pos", "digest", "bytes"))
    packed = sequences.groupBy("conv_id", F.expr(f"pos div {segment}").cast("int").alias("level")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    segments = materialize(packed.select("conv_id", "level", F.unhex(F.array_join("t.digest", "")).alias("key"), F.col("t.bytes").alias("sizes")))
    deepest, n_bytes = segments.agg(F.max("level"), F.sum(40 + 2 * F.length("key"))).first()
    if deepest is None:
        deepest, n_bytes = 0, 0
    levels = [segments.where("level = 0").withColumn("root", F.lit(b""))]
    following = F.when(F.size("sizes") == segment, F.substring(F.unhex(F.sha2(F.concat("root", "key"), 256)), 1, WIDTH))
    for k in range(1, deepest + 1):
        on = levels[-1].select("conv_id", following.alias("root")).where("root IS NOT NULL")
        levels.append(materialize(segments.where(F.col("level") == k).join(on, "conv_id")))
    parts = groups_for(spark, n_bytes, TASK)
    totals, out = None, []
    names = ["t_children", "t_leaves", "t_saved", "t_ends"]
    for k in range(deepest, -1, -1):
        rows = levels[k]
        ending = {c: F.lit(None).cast("string" if c == "t_ends" else "long") for c in names}
        if totals is None:
            rows = rows.withColumns(ending)
        else:  # most rows end here: they have no key to join by
            rows = rows.withColumn("next", following)
            rows = rows.where("next IS NULL").withColumns(ending).unionByName(rows.where("next IS NOT NULL").join(totals, "next", "left"))
        key = ["root", "key", "conv_id"]
        ordered = rows.select(*key, "sizes", *names).repartitionByRange(parts, *key).sortWithinPartitions(*key)
        found = _merge(materialize(ordered.mapInArrow(_shards(k * segment, most_rows, most_bytes), _SPEC)))
        if k:
            found = materialize(found)
            totals = found.where("root IS NOT NULL").select(F.col("root").alias("next"), F.col("n_children").alias("t_children"), F.expr("IF(n_children = 0, 0, n_leaves)").alias("t_leaves"), F.col("saved").alias("t_saved"), F.col("ends").alias("t_ends"))
            found = found.where("root IS NULL")
        out.append(found)
        release(levels[k])
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    release(segments if deepest else None)
    return result.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int = 5, most: int = 8, **limits) -> DataFrame:
    """prefix_trie() of the conversations rebuilt by rebuilt().

    Null roles and texts are empty, null turns come first, ties are ordered by a digest of role and text, repeated rows
    count as turns of their own; rows without a conv_id belong to no conversation and are left out; other columns are
    ignored, whatever their names. Very long texts are only hashed where they lie; a very long conversation goes in
    segments.
    """
    return prefix_trie(rebuilt(materialize(turns(conversations)), group, most), **limits)


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


_SQL = """
WITH t AS (
  SELECT conv_id, COALESCE(text, '') AS text, sha256(CAST(strlen(COALESCE(role, '')) AS VARCHAR) || ':' || COALESCE(role, '') || COALESCE(text, '')) AS digest, turn
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT conv_id, strlen(text) AS bytes, substr(digest, 1, 32) AS digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(digest, 1, 32)) - 1 AS pos FROM t
), conv AS (
  SELECT conv_id, xor(list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM placed)
), seq AS (
  SELECT c.conv_id, 0 AS own, p.pos, p.digest, p.bytes FROM conv c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % 5 AND p.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1, p.pos, p.digest, p.bytes FROM conv c JOIN placed p ON p.conv_id = c.conv_id AND p.pos >= c.h
), member AS (
  SELECT conv_id, row_number() OVER w AS depth, bytes, string_agg(digest, '') OVER w AS path FROM seq WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM conv
), node AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM member GROUP BY depth, path
), kids AS (
  SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
), own AS (
  SELECT n.*, COALESCE(k.n_children, 0) AS n_children FROM node n LEFT JOIN kids k ON k.path = n.path
), sums AS (
  SELECT m.path, sum(CASE WHEN o.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((o.n_convs - 1) * o.bytes) AS saved_tokens
  FROM own o JOIN member m ON m.conv_id = o.conv_id AND m.depth <= o.depth GROUP BY m.path
), last AS (
  SELECT conv_id, max(depth) AS depth FROM member GROUP BY conv_id
), ends AS (
  SELECT m.path, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) AS ids FROM member m JOIN last USING (conv_id, depth) GROUP BY m.path
)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, CAST(o.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(COALESCE(e.ids, '')) AS ends_sha256
FROM own o JOIN sums s ON s.path = o.path LEFT JOIN ends e ON e.path = o.path
LEFT JOIN node p ON o.depth > 0 AND p.path = substr(o.path, 1, 32 * (o.depth - 1))
"""

QUERIES = {"op12_conversation_trie": op12_conversation_trie}
ORACLES = {"op12_conversation_trie": _SQL}
