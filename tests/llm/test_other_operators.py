"""Sharding, vectors, fixity, components and the pipeline against brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import common, embedding_dedup, fixity, sharding
from tallymark.llm.components import components


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    p = sharding.Permutation(n, 3)
    out = p.forward(np.arange(n))
    assert sorted(out.tolist()) == list(range(n)) and (p.inverse(out) == np.arange(n)).all()
    assert p.place(n - 1, 8) == (int(out[-1]) % 8, int(out[-1]) // 8)


def feistel(x: int, n: int, seed: int) -> int:
    """The permutation on plain numbers, round by round."""
    import hashlib

    half, mask = max(1, -(-max(n - 1, 1).bit_length() // 2)), (1 << 64) - 1
    while True:
        a, b = x >> half, x & ((1 << half) - 1)
        for r in range(6):
            key = int.from_bytes(hashlib.blake2b(f"{seed}/{r}".encode(), digest_size=8).digest(), "little")
            y = (b ^ key) * 0x9E3779B97F4A7C15 & mask
            y = (y ^ y >> 32) * 0xD6E8FEB86659FD93 & mask
            a, b = b, a ^ ((y ^ y >> 29) & ((1 << half) - 1))
        x = a << half | b
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 5, 300])
def test_permutation_on_plain_numbers(n):
    assert sharding.Permutation(n, 9).forward(np.arange(n)).tolist() == [feistel(x, n, 9) for x in range(n)]


def test_sharding_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(i, i * 2, "s", "p", "b") for i in range(20)], "doc_id long, slice long, place string, p string, before string").withColumn("shard", F.lit("old"))
    out = sharding.shard(df, 4, "doc_id").collect()
    n = {r.doc_id: (r.slice, r.place, r.p, r.before) for r in out}
    assert n == {i: (i * 2, "s", "p", "b") for i in range(20)} and {r.shard for r in out} == {0, 1, 2, 3}


def test_numbers_of_equal_rows_and_nulls(spark, monkeypatch):
    """Numbers follow the order wherever ranges end; thousands of equal rows are split among ranges; nulls come first."""
    rows = [(None, "n"), (None, None), *[(7, "same")] * 5000, *[(i, "x") for i in range(300)]]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for size, parts in ((1_000_000, 3), (100, 5)):
        monkeypatch.setattr(sharding, "SLICE", size)
        df = spark.createDataFrame(rows, "a long, b string").repartition(parts, "b")
        out = sharding.number_rows(df, "a", "b").collect()
        assert [(r.a, r.b) for r in sorted(out, key=lambda r: r.row)] == want and sorted(r.row for r in out) == list(range(len(rows)))
    written = []
    monkeypatch.setattr(sharding, "materialize", lambda rows: written.append(common.materialize(rows)) or written[-1])
    sharding.number_rows(df.where("a = 7"), "a", "b")
    counts = [r["count"] for r in written[0].groupBy("part").count().collect()]
    assert len(counts) > 10 and sum(counts) == 5001 and max(counts) < 1000


def test_sharding(spark, docs, corpus, empty):
    rows = docs.select("doc_id", "text")
    out = sharding.shard(rows, 8, "doc_id", "text").collect()
    again = sharding.shard(rows.repartition(2), 8, "doc_id", "text").collect()
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in again}
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert sharding.Permutation(len(corpus), 11).place(r.row, 8) == (r.shard, r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(out) == len(corpus)
    assert sharding.shard(empty.select("doc_id", "text"), 8, "doc_id", "text").count() == 0
    twice = spark.createDataFrame([(None,), (1,), (1,), (1,)], "doc_id long")
    assert sorted(r.row for r in sharding.shard(twice, 8, "doc_id").collect()) == [0, 1, 2, 3]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i % 5] + rng.standard_normal(16) * 0.12]) for i in range(60)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, [2 * x for x in rows[1][1]]), (303, None), (304, [0.0] * 16), (305, [float("nan")] * 16), (306, [None, 1.0]), (307, []), (308, [1.0, 2.0]), (309, [1.0, 2.0]), (310, [1e300] * 16), (311, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).repartition(3)
    good = [(i, np.array(v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good}
    near = {i: {j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= 0.95} for i in unit}
    comp = {i: i for i, _ in rows}
    for _ in rows:
        for i, js in near.items():
            comp[i] = min([comp[i], *(comp[j] for j in js)])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (len(near.get(i, ())), comp[i], comp[i] == i) for i, _ in rows}
    assert embedding_dedup.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_vectors_recall(spark):
    """The given vectors among 10,000 others, with 2,000 partners planted at cosines from 0.9505 up, against all pairs."""
    own = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("embedding").collect()], np.float64)
    rng = np.random.default_rng(6)
    base = np.concatenate((own, rng.standard_normal((10_000, own.shape[1]))))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    some = base[:2000]
    side = rng.standard_normal(some.shape)
    side -= (side * some).sum(1, keepdims=True) * some
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9505, 1, 2000)[:, None]
    u = np.concatenate((base, cos * some + np.sqrt(1 - cos**2) * side))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(u.tolist())], "vec_id long, embedding array<double>").repartition(8)
    close = np.concatenate([(u[i : i + 1000] @ u.T >= 0.95).sum(1) for i in range(0, len(u), 1000)]) - 1
    got = np.array([n for _, n in sorted((r.vec_id, r.n_links) for r in embedding_dedup.near_duplicates(df).collect())])
    assert close.sum() >= 4000 and (got <= close).all() and got.sum() >= 0.9 * close.sum()


def test_vectors_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    rng = np.random.default_rng(4)
    v = rng.standard_normal(32) + rng.standard_normal((150, 32)) * 0.1
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert want.max() > 50 and [got[i] for i in range(150)] == want.tolist()


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 150), (150, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 140)}, 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fixity(spark):
    rows = [(i, f"http://h/{i}", "x" * (i % 7)) for i in range(700)]
    a = spark.createDataFrame(rows + [(None, None, None)], "page_id long, url string, html string")
    b = [(i, u, ("y" + h[1:]) if i == 5 and h else h) for i, u, h in rows if i != 255]
    b[300] = (b[300][0], b[300][1], b[300][2] + "longer")
    b.append((9000, "http://new", "z"))
    b = spark.createDataFrame(b + [(None, None, None)], "page_id long, url string, html string")
    ours, theirs = (fixity.leaves(fixity.warc_records(x, 256)) for x in (a, b))
    got = {r.page_id: r.status for r in fixity.audit(ours, theirs, 256).collect()}
    assert got[5] == "corrupt" and got[255] == "missing" and got[9000] == "extra" and got[None] == "ok" and got[301] == "corrupt" and got[302] == "moved" and got[300] == "ok" and got[600] == "ok"
    record = fixity.warc_records(a, 256).where("page_id = 3").first().record.decode()
    head, body = record.split("\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
    assert head.startswith("WARC/1.0\r\n") and fields["Content-Length"] == "3" and body == "xxx\r\n\r\n"
    assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Type"} <= set(fields)
    assert fixity.audit(ours, theirs.where("file IS NULL"), 256).where("status <> 'missing'").count() == 0


def test_fixity_losses_and_additions_inside_files(spark):
    rows = [(i, f"http://h/{i}", "x" * (i % 7)) for i in range(600) if i not in (40, 300)]
    rows += [(7, "http://h/7", f"copy {k}") for k in range(4)] + [(None, f"http://n/{k}", "n") for k in range(3)]
    theirs = [r for r in rows if r[0] != 100 and r[2] != "copy 1" and r[1] != "http://n/0"]
    theirs += [(300, "http://h/300", "new"), (None, "http://n/9", "n")]
    theirs = [(i, u, "ruined" if i == 420 else h) for i, u, h in theirs]
    schema = "page_id long, url string, html string"
    a, b = (fixity.leaves(fixity.warc_records(spark.createDataFrame(r, schema), 256)) for r in (rows, theirs))
    got = fixity.audit(a, b, 256).collect()
    start = {(r.page_id, r.hash): r.start for r in b.collect()}
    mine = {(r.page_id, r.hash): r.start for r in a.collect()}
    assert len(mine) == len(rows) and len(start) == len(theirs)
    want = {}
    for k, s in mine.items():
        want[k] = "corrupt" if k[0] == 420 else "missing" if k not in start else "ok" if start[k] == s else "moved"
    want |= {k: "extra" for k in start if k not in mine and k[0] != 420}
    assert {(r.page_id, r.hash): r.status for r in got} == want and len(got) == len(want)
    named = {s: sorted((k[0] is None, k[0] or 0) for k, t in want.items() if t == s) for s in ("corrupt", "missing", "extra")}
    assert named == {"corrupt": [(False, 420)], "missing": [(False, 7), (False, 100), (True, 0)], "extra": [(False, 300), (True, 0)]}


def test_fixity_of_written_files(spark, tmp_path):
    """WARC files are read back as written; a byte changed, a record cut out and a length ruined are found in the files."""
    rows = [(i, f"http://h/{i} a\nb", "é" * (i % 9) + "\r\n\r\nWARC") for i in range(120)] + [(None, None, None), (30, "", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"file": F.lit("x"), "record": F.lit(1), "hash": F.lit(2)})
    records = fixity.warc_records(pages, 64)
    fixity.write_warc(records, str(tmp_path / "a"))
    stored = fixity.stored_leaves(fixity.read_warc(spark, str(tmp_path / "a")))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    ours = fixity.leaves(records)
    assert sorted(map(key, stored.collect())) == sorted(map(key, ours.collect()))
    assert fixity.leaves(fixity.warc_records(pages.limit(0))).count() == 0
    fixity.write_warc(records, str(tmp_path / "b"))
    for path in (tmp_path / "b" / "file=0").glob("part-*"):
        raw = path.read_bytes()
        start = {r.page_id: r.start for r in ours.where("file = 0").collect()}
        cut = raw[: start[40] - 5] + b"?" + raw[start[40] - 4 : start[50]] + raw[start[51] :].replace(b"Content-Length: 20", b"Content-Length: 2x", 1)
        path.write_bytes(cut)
    for path in (tmp_path / "b").glob("file=*/.*.crc"):
        path.unlink()
    theirs = fixity.stored_leaves(fixity.read_warc(spark, str(tmp_path / "b")))
    got = {(r.page_id, r.status) for r in fixity.audit(ours, theirs, 64).collect() if r.status not in ("ok", "moved")}
    assert (39, "corrupt") in got and (50, "missing") in got and len(got) == 3


def test_fixity_of_repeated_pages(spark, monkeypatch):
    """Many records under one page_id, equal ones among them."""
    rows = [(5, f"u{i % 1500}", "x") for i in range(3000)]
    schema = "page_id long, url string, html string"
    a, b = (fixity.leaves(fixity.warc_records(spark.createDataFrame(r, schema))) for r in (rows, rows[:-1]))
    got = [r.status for r in fixity.audit(a, b).collect()]
    assert got.count("missing") == 1 and len(got) == 3000 and set(got) <= {"ok", "moved", "missing"}


def test_shared_folder_on_a_cluster(spark, monkeypatch):
    from tallymark.llm import common

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session())


def test_tables_are_released(spark):
    from tallymark.llm import common

    df = common.materialize(spark.range(3))
    path = df.scratch_path
    common.release(df, df, spark.range(1), None)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


def test_pipeline(spark, docs, corpus, tmp_path):
    import corpus_pipeline as p
    from test_text_operators import jaccard, removed

    got, stages = docs, {}
    for name, stage in p.STAGES:
        out = str(tmp_path / name)
        stage(spark, got, "").write.parquet(out)
        got = spark.read.parquet(out)
        stages[name] = got.collect()
        if name != p.STAGES[-1][0]:
            assert got.columns == list(p.COLUMNS)
    first = {r.doc_id: r for r in stages["language_id"]}
    assert {i for i, t, *_ in corpus if t and any(c.isalpha() for c in t)} >= set(first) and len(first) > 60
    linked = jaccard([(i, r.text) for i, r in first.items()])
    second = {r.doc_id: r.text for r in stages["ngram_jaccard_join"]}
    assert set(second) == {i for i, (_, c) in linked.items() if c == i}
    gone = removed(list(second.items()))
    third = {r.doc_id: r for r in stages["suffix_array_dedup"]}
    assert set(third) == {i for i, g in gone.items() if g[1] == 0 or g[1] < g[0]}
    assert all(third[i].text == second[i] for i in third if gone[i][1] == 0)
    times = {}
    for r in stages["source_mixing"]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r.text == third[r.doc_id].text
    assert max(times.values()) <= 2
    from tallymark.llm import bpe
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    last = stages["bpe_words"]
    assert len(last) == sum(times.values())
    for r in last:
        assert r.ids == t.encode(third[r.doc_id].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_pipeline_without_labels(spark, docs, corpus):
    """No row is labelled: every row with a letter stays."""
    import corpus_pipeline as p

    kept = p.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").collect()
    assert sorted(r.doc_id for r in kept) == [i for i, t, *_ in corpus if t and any(map(str.isalpha, t))] and {r.lang for r in kept} == {None}


def test_pipeline_on_nothing(spark, empty):
    import corpus_pipeline as p

    got = empty
    for _, stage in p.STAGES:
        got = stage(spark, got, "")
    assert got.count() == 0


def test_crc_third(spark):
    from tallymark.llm.language_id import third

    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", third()).collect()}
    assert all(got[i] == zlib.crc32(str(i).encode()) % 3 for i in range(50)) and got[None] == 0
