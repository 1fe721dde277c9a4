"""Near-duplicate vectors by spherical-cap filters with random product codes.

Vectors are turned at random and cut in two blocks; each block has a code of random unit directions, and a filter is
a pair of codewords. A vector passes the filters whose direction it exceeds a threshold with; they are listed by
decoding: block scores are sorted, so only codewords that can still reach the threshold are looked at. Vectors that share
a filter are compared. The threshold gives vectors so many filters, on average, that two of them at the least cosine
share SHARED of them, expectedly; where the code is thin, a vector's threshold sinks until it has that many.

A vector travels once to each group of filters with one first codeword (its filters are mostly such neighbours), not once
to each filter. Filters with more than BLOCK vectors are taken out of these groups and compared block by block, each
pair of blocks in a task of its own: the count of direct links needs every linked pair to be looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, table
from .components import components

COSINE = 0.95
SHARED = 10
#: Vectors of one filter, expectedly; compared in one task, at most; of one group of filters, expectedly.
USUAL, BLOCK, GROUP = 64, 1024, 16384
#: Codewords of a block, at most: a filter's number fits 31 bits.
WORDS = 46_340


def plan_filters(n: int, cosine: float = COSINE, shared: float = SHARED) -> tuple[int, float, int]:
    """Codewords of a block, threshold in standard deviations of a random direction's product, filters of a vector, for n vectors."""
    normal = NormalDist()

    def keeps(z: float) -> float:
        """Chance that y passes if x does, for unit normal x, y with correlation cosine."""
        x = np.linspace(z, z + 8, 800)
        tail = np.array([0.5 * math.erfc((z - cosine * v) / math.sqrt(2 * (1 - cosine**2))) for v in x])
        density = np.exp(-x * x / 2)
        return float((tail * density).sum() / density.sum())

    listed = 4.0
    while True:
        words = min(WORDS, max(24, math.ceil(math.sqrt(n * listed / USUAL))))
        z = normal.inv_cdf(1 - min(0.4, listed / words**2))
        if listed * keeps(z) >= shared:
            return words, z, math.ceil(listed)
        listed *= 1.1


@lru_cache(2)
def codes(dim: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and the two blocks' codewords (scaled, so that a filter's score is the sum of its two products); drawn once
    in a worker."""
    rng = np.random.Generator(np.random.PCG64([seed, dim, words]))
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    half = -(-dim // 2)
    out = []
    for d in (half, max(dim - half, 1)):
        c = rng.standard_normal((words, d))
        out.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(2))
    return turn, out[0], out[1]


def list_decode(vectors: np.ndarray, words: int, z: float, listed: int, seed: int) -> list[np.ndarray]:
    """All filters that each unit vector passes; its best ones, listed in number, where it passes fewer."""
    dim = vectors.shape[1]
    turn, c1, c2 = codes(dim, words, seed)
    half = -(-dim // 2)
    v = vectors @ turn
    s1 = v[:, :half] @ c1.T
    s2 = v[:, half:] @ c2.T if dim > half else np.zeros((len(v), words))
    order2 = np.argsort(-s2, axis=1)
    # the best sums are among the i-th and j-th best of the blocks with i * j <= listed
    pairs = [(i, j) for i in range(min(words, listed)) for j in range(min(words, listed // (i + 1)))]
    i, j = np.array(pairs).T
    best = np.sort(s1, axis=1)[:, ::-1][:, i] + np.take_along_axis(s2, order2, 1)[:, j]
    k = min(listed, best.shape[1])
    lows = np.minimum(z / math.sqrt(dim), np.partition(best, -k, axis=1)[:, -k] - 1e-12)
    out = []
    for a, b, by, least in zip(s1, s2, order2, lows.tolist(), strict=True):
        down = b[by]
        first = np.flatnonzero(a + down[0] >= least)
        reach = np.searchsorted(-down, a[first] - least, "right")
        found = np.concatenate([i * words + by[:k] for i, k in zip(first.tolist(), reach.tolist(), strict=True)])
        out.append(np.sort(found))
    return out


def _decode(words: int, z: float, listed: int, seed: int):
    step = max(16, min(1024, (1 << 23) // words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                vectors = [np.array(x, np.float64) for x in batch.column("embedding").to_pylist()]
                found: list = [None] * len(vectors)
                for dim in {len(v) for v in vectors}:
                    at = [k for k, v in enumerate(vectors) if len(v) == dim]
                    m = np.array([vectors[k] for k in at])
                    m = m / np.abs(m).max(1, keepdims=True)
                    m = m / np.linalg.norm(m, axis=1, keepdims=True)
                    for k, f in zip(at, list_decode(m, words, z, listed, seed), strict=True):
                        found[k] = f.astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("size"), batch.column("embedding"), pa.array(found, pa.list_(pa.int32()))], ["id", "size", "embedding", "filters"])

    return run


def _meet_before(own: int, lists: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows share a filter below own: products of the rows' 0/1 matrix over the filters they share."""
    used = np.unique(np.concatenate((i, j)))
    low = [lists[k][lists[k] < own] for k in used.tolist()]
    row = np.repeat(np.arange(len(used)), [len(x) for x in low])
    name, code, times = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    row, code = row[shared], code[shared]
    common = np.zeros((len(used), len(used)), np.float32)
    for at in range(0, len(name), 1024):
        part = (code >= at) & (code < at + 1024)
        if part.any():
            m = np.zeros((len(used), 1024), np.float32)
            m[row[part], code[part] - at] = 1
            m = m[:, m.any(0)]
            common += m @ m.T
    return common[np.searchsorted(used, i), np.searchsorted(used, j)] > 0


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    one = column.combine_chunks()
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
    return one.offsets.to_numpy(), one.values.to_numpy(zero_copy_only=False)


def _compare(cosine: float):
    """Links of the vectors of each filter of a group, or of one filter's pair of blocks, each pair at its least common filter only."""

    def run(t: pa.Table) -> pa.Table:
        lo, hi, block, ids, size = (t[c].to_numpy() for c in ("lo", "hi", "block", "id", "size"))
        v_at, v_all = _lists(t["embedding"])
        f_at, f_all = _lists(t["filters"])
        o_at, o_all = _lists(t["own"])
        v = v_all[v_at[0] : v_at[-1]].reshape(len(ids), -1).astype(np.float64)  # a group's vectors have one length
        v /= np.abs(v).max(1, keepdims=True)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        held = o_all[o_at[0] : o_at[-1]]
        row = np.repeat(np.arange(len(ids)), np.diff(o_at))
        order = np.lexsort((ids[row], held))
        held, row = held[order], row[order]
        cuts = [*np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))).tolist(), len(held)]
        out_id, out_n, out_a, out_b = [], [], [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s < 2:
                continue
            rows = row[s:e]
            near = np.triu(v[rows] @ v[rows].T >= cosine, 1)
            if lo[rows[0]] != hi[rows[0]]:
                near &= block[rows][:, None] != block[rows][None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            first = ~_meet_before(held[s], [f_all[f_at[r] : f_at[r + 1]] for r in rows], i, j)
            i, j = i[first], j[first]
            n = np.bincount(i, size[rows][j], len(rows)) + np.bincount(j, size[rows][i], len(rows))
            hit = np.flatnonzero(n)
            out_id.append(ids[rows][hit])
            out_n.append(n[hit].astype(np.int64))
            # as many links as keep the vectors of this filter together
            up = list(range(len(rows)))

            def top(k: int, up=up) -> int:
                while up[k] != k:
                    up[k] = up[up[k]]
                    k = up[k]
                return k

            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                p, q = top(x), top(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    out_a.append(int(ids[rows[x]]))
                    out_b.append(int(ids[rows[y]]))
        n_id = np.concatenate(out_id) if out_id else np.zeros(0, np.int64)
        n_n = np.concatenate(out_n) if out_n else np.zeros(0, np.int64)
        a, b = np.array(out_a, np.int64), np.array(out_b, np.int64)
        return pa.table({"a": np.concatenate((n_id, a)), "b": np.concatenate((np.full(len(n_id), -1), b)), "n": np.concatenate((n_n, np.zeros(len(a), np.int64))), "link": np.repeat(np.array([False, True]), (len(n_id), len(a)))})

    return run


def _work(decoded: DataFrame, words: int, ranges: int) -> DataFrame:
    """grp, lo, hi, block, id, size, embedding, filters and own (the filters to compare there) of every vector and group.

    A group is a first codeword and a range of the second (lo = hi = -1), or a pair of blocks (lo, hi) of one filter of
    more than BLOCK vectors. Only ids and filters are shuffled to find these.
    """
    dim = F.size("embedding").cast("long")
    width = -(-words // ranges)
    listed = decoded.select("id", F.explode("filters").alias("filter"), dim.alias("dim"))
    full = materialize(listed.groupBy("dim", "filter").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    rows = decoded.select("id", "size", "embedding", "filters", dim.alias("dim"))
    hot = None
    if not full.isEmpty():
        hot = materialize(listed.join(full, ["dim", "filter"]).select("id", "filter", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
        rows = rows.join(hot.groupBy("id").agg(F.collect_list("filter").alias("hot")), "id", "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<int>")))
    else:
        rows = rows.withColumn("hot", F.array().cast("array<int>"))
    number = lambda f: F.floor(f / words) * ranges + F.floor((f % words) / width)
    cold = rows.withColumn("cold", F.array_except("filters", "hot"))
    cold = cold.withColumn("at", F.explode(F.array_distinct(F.transform("cold", number))))
    part = lambda lo, hi, block: [F.lit(x).cast("int").alias(n) if isinstance(x, int) else x.alias(n) for n, x in (("lo", lo), ("hi", hi), ("block", block))]
    out = cold.select((F.col("dim") * (1 << 32) + F.col("at")).alias("grp"), *part(-1, -1, 0), "id", "size", "embedding", "filters", F.filter("cold", lambda f: number(f) == F.col("at")).alias("own"))
    if hot is None:
        return out
    many = decoded.join(hot, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grp = -1 - (dim * (1 << 32) + F.col("filter"))
    return out.unionByName(many.select(grp.alias("grp"), *part(F.least("block", "other"), F.greatest("block", "other"), F.col("block")), "id", "size", "embedding", "filters", F.array("filter").alias("own")))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id long, embedding array of float or double).

    Pairs that share a filter and whose cosine (in double precision) is at least cosine are linked; n_links counts
    other vectors linked directly, component_id is the least vec_id reachable, kept marks it. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, and vectors of different length don't link. Equal
    vectors are one class and always linked; repeated rows count as vectors of their own. Null vec_ids come back with null
    component_id and kept, and link with nothing. Different vectors under one vec_id aren't told apart: each gets the links
    of all of them. Other columns are ignored. An empty table gives none.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").withColumn("fine", F.coalesce(fine & F.col("vec_id").isNotNull(), F.lit(False)))
    classes = materialize(rows.where("fine").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("size")))
    n = classes.count()
    words, z, listed = plan_filters(max(n, 2), cosine)
    ranges = min(words, max(1, -(-n * listed // (words * GROUP))))
    decoded = materialize(classes.select("id", "size", "embedding").mapInArrow(_decode(words, z, listed, seed), f"id long, size long, embedding {dict(classes.dtypes)['embedding']}, filters array<int>"))
    work = _work(decoded, words, ranges)
    found = materialize(work.groupBy("grp", "lo", "hi").applyInArrow(_compare(cosine), "a long, b long, n long, link boolean"))
    release(decoded)
    links = found.where("not link").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    linked = components(found.where("link").select("a", "b"))
    info = classes.join(links, "id", "left").join(linked, "id", "left").select("embedding", F.coalesce("component", "id").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n"))
    good = rows.where("fine").join(info, "embedding").select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    bad = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embedding_dedup": op9_embedding_dedup}
ORACLES: dict[str, str] = {}
