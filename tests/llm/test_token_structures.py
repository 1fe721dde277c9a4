"""Fill-in-the-middle, conversation trie and token files against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallymark.llm import conversation_trie, fill_middle, token_files
from tallymark.llm.common import shared_folder


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill in the middle


def fim_by_hand(doc_id, text, fim_rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_rate:
        return len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return len(units), form, len(p), len(m), out


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["a", "bc ", "\n", "\n\n", "é", "日本", "🙂", "<P", "<S>", "P>", "\r\n", "x" * 9, "ä\n", "\x00", "<", ">"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 64, 1 << 20])
def test_fim_as_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    texts = [*odd_texts(400), None, "", "\n", "no end", "end\n", "w\n" * 40_000 + "last", "é" * 100_000]
    rows = [(None if i % 97 == 5 else i // 2, t, i, "clash", "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, other string, extra string").repartition(3)
    got = {r["row"]: r for r in fill_middle.fill_in_middle(docs, keep=("row", "extra")).withColumn("back", fill_middle.restored("output", "form")).collect()}
    assert len(got) == len(rows)
    for doc_id, text, row, *_ in rows:
        r = got[row]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == fim_by_hand(doc_id, text), (doc_id, text)
        assert r["back"] == (text or "") and r["extra"] == "x" and r["doc_id"] == doc_id
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_fim_rates_and_names(spark, empty):
    rows = [(i, f"line {i}\nmore\n") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_middle.fill_in_middle(docs, fim_rate=60, spm_rate=10).collect()
    assert all((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == fim_by_hand(r["doc_id"], rows[r["doc_id"]][1], 60, 10) for r in got)
    assert fill_middle.fill_in_middle(empty).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs.withColumnRenamed("text", "n").withColumn("text", fill_middle.F.lit("a")), keep=("n",))
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, marks=("<P>", "<S>", "<<>"))


def test_marks_on_words():
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 256, 1003).astype(np.uint8)
    raw[rng.integers(0, 1003, 300)] = 10
    marks = fill_middle.Marks(fill_middle.equal_marks(fill_middle.as_words(raw), 10))
    where = np.flatnonzero(raw == 10)
    assert (marks.select(np.arange(len(where))) == where).all()
    at = np.arange(len(raw))
    assert (marks.rank(at) == np.searchsorted(where, at)).all()
    inner = fill_middle.Marks(fill_middle.continuation_marks(fill_middle.as_words(raw)))
    assert (inner.select(np.arange(int(inner.upto[-1]))) == np.flatnonzero((raw & 0xC0) == 0x80)).all()


# ---- conversation trie


def trie_by_hand(rows):
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            digest = sha(f"{len((role or '').encode())}:{role or ''}{text or ''}")[:32]
            by.setdefault(c, []).append(((t is not None, t or 0), digest, len((text or "").encode())))
    own = {c: [(d, n) for _, d, n in sorted(ts)] for c, ts in by.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seqs[c] = own.get(base, [])[:h] + ts[h:]
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(x for x, _ in s[:d]), []).append((c, s[d - 1][1] if d else 0, d == len(s)))
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = (0 if kids.get(p) else 1), (len(nodes[p]) - 1) * nodes[p][0][1]
        for k in kids.get(p, []):
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = set()
    for p, ms in nodes.items():
        ends = sorted(c for c, _, e in ms if e)
        parent = min(c for c, *_ in nodes[p[:-1]]) if p else None
        out.add((min(c for c, *_ in ms), len(p), parent, len(ms), len(kids.get(p, [])), *below(p), sha(",".join(map(str, ends)))))
    return out


def talk(seed, n=60, words=3, most=9):
    rng = random.Random(seed)
    rows = []
    for c in range(-6, n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 2, 3, most])):
            turn = None if rng.random() < 0.05 else t if rng.random() < 0.9 else 1
            rows.append((c, turn, rng.choice(["user", "bot", None]) if rng.random() < 0.2 else "user", rng.choice([None, "", "é", "same", *(f"w{k}" for k in range(words))]) if rng.random() < 0.5 else "same"))
    copies = [(100 + 5 * k, t, "user", f"copy {t}") for k in range(40) for t in range(12)]
    return rows + copies + [(None, 0, "user", "lost"), (3, 1, "user", "same"), (3, 1, "user", "same")]


def trie_rows(df):
    return sorted(tuple(r) for r in df.collect()) if df.columns[2] != "parent_conv_id" else [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(("segment", "rows"), [(1024, 8192), (1024, 3), (2, 8192), (2, 4), (3, 1)])
def test_trie_as_by_hand(spark, segment, rows):
    talks = talk(segment + rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in talks], "conv_id long, turn long, role string, text string, depth string, n_convs int").repartition(4)
    got = trie_rows(conversation_trie.conversation_trie(df, segment=segment, most_rows=rows))
    assert len(got) == len(set(got))
    assert set(got) == trie_by_hand(talks)


def test_trie_of_very_long_and_no_conversations(spark):
    long = [(c, t, "user", "x" * (t % 7)) for c in (0, 5, 10) for t in range(300 + c)] + [(15, 0, "user", "y" * 300_000)]
    df = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    assert set(trie_rows(conversation_trie.conversation_trie(df, segment=64, most_rows=2))) == trie_by_hand(long)
    assert conversation_trie.conversation_trie(df.where("conv_id > 99")).count() == 0


def test_findclose():
    rng = random.Random(2)
    for n in (1, 2, 50, 700):
        bits, level, left = [], 0, n
        while left or level:
            up = left and (not level or rng.random() < 0.52)
            bits.append(bool(up))
            level, left = (level + 1, left - 1) if up else (level - 1, left)
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.flatnonzero(bits)
        assert conversation_trie.Parentheses(np.array(bits)).findclose(opens).tolist() == [want[i] for i in opens.tolist()]


# ---- token files


def expected(rows, tokenizer, end=0):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{random.getrandbits(60):x}"


def test_token_files_as_the_library(spark, corpus, monkeypatch):
    monkeypatch.setattr(token_files, "PART", 20_000)
    monkeypatch.setattr(token_files, "KNOWN", 500)  # units are forgotten on the way
    rows = [(r[0] * 3 - 50, r[1]) for r in corpus] + [(10_000, "long é \n" * 60_000), (10_001, None)]
    rows += [(None, "one null")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, start string, ids int").repartition(4)
    at = folder(spark, "tokens")
    token_files.write_token_files(docs, at)
    tokenizer = token_files._tokenizer(token_files.tokenizer_path("byte_bpe_50k.json"))
    want = expected(rows, tokenizer)
    got = token_files.read_token_files(spark, at, ids=True).collect()
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got), key=lambda r: r[1]) == want
    files = token_files.TokenFiles(at)
    assert (files.n_documents, files.n_tokens) == (len(want), want[-1][1] + want[-1][2])
    for k in (0, 1, 40, len(want) - 1):
        doc_id, ids = files.document(k)
        assert (doc_id, ids.tolist()) == (want[k][0], want[k][4])
    flat = [i for w in want for i in w[4]]
    assert files.slice(1000, 5000).tolist() == flat[1000:6000] and files.slice(len(flat) - 3, 99).tolist() == flat[-3:]
    assert files._part(0).tokens.dtype == np.dtype("<u2")
    with pytest.raises(IndexError):
        files.document(len(want))
    with pytest.raises(ValueError):
        token_files.write_token_files(docs, at)


def test_token_files_repeats_and_empty(spark, empty):
    rows = [(7, "same text")] * 50 + [(7, "other")] * 3 + [(None, f"n {i}") for i in range(9)] + [(8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    at = folder(spark, "tokens")
    token_files.write_token_files(docs, at, end_id=None)
    got = sorted(tuple(r) for r in token_files.read_token_files(spark, at).select("start", "n_tokens").collect())
    tokenizer = token_files._tokenizer(token_files.tokenizer_path("byte_bpe_50k.json"))
    want = expected(rows, tokenizer, None)
    assert sum(n for _, n in got) == sum(w[2] for w in want) and len(got) == len(rows)
    assert [s for s, _ in got] == [sum(n for _, n in got[:i]) for i in range(len(got))]
    counts = sorted((str(r["doc_id"]), r["ids_crc32"]) for r in token_files.read_token_files(spark, at).collect())
    assert counts == sorted((str(w[0]), w[3]) for w in want)
    at = folder(spark, "tokens")
    token_files.write_token_files(empty, at)
    assert token_files.read_token_files(spark, at).count() == 0
    assert token_files.TokenFiles(at).n_tokens == 0


def test_encoder_on_odd_texts():
    """20,000 texts of odd white space, marks, contractions and special tokens get the library's ids."""
    path = token_files.tokenizer_path("byte_bpe_50k.json")
    encoder, tokenizer = token_files.Encoder(path, "<u2"), token_files._tokenizer(path)
    rng = random.Random(3)
    bits = [" ", " ", "\n", "\t", "a", "bé", "'s", "'", "İ", "1", "23", ".", "!", " ", "\x85", "　", " ", "\x1c", "\x1f", "日", "<|endoftext|>", "\U0001f642", "\r\n", "  ", "don't", "́", "﻿", "​", "\x00", "[", "_x"]
    for _ in range(20):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1000)]
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u2").tolist() for x in map(encoder.encode, texts)] == want


def test_documents_token_files(spark):
    """The registered query over the whole small table."""
    sf = "/root/testdata/sf0.001"
    tokenizer = token_files._tokenizer(token_files.tokenizer_path("byte_bpe_50k.json"))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in token_files.op13_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == [w[:4] for w in expected(rows, tokenizer)]
