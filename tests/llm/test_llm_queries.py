"""Registered queries on the given tables: against their SQL, or against brute force."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from sqlcheck import SMALL, compare
from test_text_operators import WORD, jaccard, removed, water
from tokenizers import Tokenizer

from tallymark.llm import queries, sharding

NAMES = queries.queries()
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    compare(spark, NAMES[name], SQL[name])


def test_operators():
    assert {n.split("_")[0] for n in NAMES} == {f"op{k}" for k in range(1, 14)}


@pytest.mark.parametrize("name", sorted(set(NAMES) - set(SQL)))
def test_rows(spark, name):
    rows = NAMES[name](spark, SMALL)
    table = "embeddings" if name.startswith("op9") else "documents"
    assert rows.count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


@pytest.fixture(scope="module")
def given(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]


def answers(spark, name, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in NAMES[name](spark, SMALL).collect()}


def test_given_repeats(spark, given):
    got = answers(spark, "op2_suffix_array_dedup", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed([d[:2] for d in given]) and any(v[1] for v in got.values())


def test_given_mix(spark, given):
    """Targets by bisection; each source's taken words within its largest document of them, no document more than twice."""
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in given}
    names = sorted({s for *_, s in given}, key=lambda s: (s is None, s or ""))
    total = [sum(sizes[i] for i, _, s in given if s == n) for n in names]
    targets = dict(zip(names, water(total, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(total), 2), strict=True))
    got = answers(spark, "op3_source_mixing", "size", "source_size", "target", "taken")
    taken = dict.fromkeys(names, 0)
    for i, _, s in given:
        size, of_source, target, n = got[i]
        assert (size, of_source) == (sizes[i], total[names.index(s)]) and abs(target - targets[s]) < 1e-6 * sum(total) and n in (0, size, 2 * size)
        taken[s] += n
    assert all(abs(taken[n] - targets[n]) <= max(sizes[i] for i, _, s in given if s == n) for n in names)


def test_given_languages(spark, given):
    """Every document has a prediction; those that weren't learned from are nearly all right."""
    rows = NAMES["op5_language_id"](spark, SMALL).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()}
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in given}
    judged = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out and langs[r.doc_id] is not None]
    assert len(judged) > 30 and sum(judged) >= 0.95 * len(judged) and all(0 <= r.score <= 1 for r in rows)


def test_given_ids(spark, given):
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_padding()
    library.no_truncation()
    want = {}
    for i, t, _ in given:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert answers(spark, "op6_bpe_words", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_given_components(spark, given):
    got = answers(spark, "op7_ngram_jaccard_join", "n_shingles", "component_id")
    assert got == jaccard([d[:2] for d in given]) and any(c != i for i, (_, c) in got.items())


def test_given_shards(spark, given):
    """The row number is the place in the order of doc_id; shard and slot follow from it alone."""
    place = sharding.Permutation(len(given), 11).place
    want = {}
    for row, (i, t, _) in enumerate(sorted(given)):
        raw = (t or "").encode()
        want[i] = (len(raw) + 1, zlib.crc32(raw), "rows", *place(row, 8), None)
    assert answers(spark, "op8_feistel_sharding", "size", "text_crc32", "law", "shard", "slot", "grown_shard") == want


def test_given_vectors(spark):
    vectors = {r.vec_id: r for r in NAMES["op9_embedding_dedup"](spark, SMALL).collect()}
    frame = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r[0], np.array(r[1], float)) for r in frame.select("vec_id", [c for c, t in frame.dtypes if t.startswith("array")][0]).collect()]
    ids, m = [i for i, _ in rows], np.array([v / np.linalg.norm(v) for _, v in rows])
    near = m @ m.T >= 0.95
    assert {i: vectors[i].n_links for i in ids} == {i: int(near[k].sum()) - 1 for k, i in enumerate(ids)}
    assert all(r.kept == (r.vec_id == r.component_id) for r in vectors.values())
