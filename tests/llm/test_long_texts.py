"""Very long texts and repeated rows."""

import random

import pytest
from test_text_operators import jaccard
from test_token_structures import fim_by_hand

from tallymark.llm import fill_middle, language_id, ngram_join


@pytest.fixture(scope="module")
def long_rows():
    """Texts of about five million bytes: two that differ in few words, one of other words; and short ones beside them."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(60_000)]
    one = [rng.choice(words) for _ in range(800_000)]
    two = [w if k % 400 else "changed" for k, w in enumerate(one)]
    other = [rng.choice(words) for _ in range(800_000)]
    lines = lambda w: "\n".join(" ".join(w[k : k + 50]) for k in range(0, len(w), 50))
    return [(1, lines(one)), (2, "short text of six words here"), (3, lines(two).upper()), (4, lines(other)), (5, "Short text of six words here"), (6, "y" * 3_000_000)]


def test_jaccard_of_long_texts(spark, long_rows):
    assert max(len(t) for _, t in long_rows) > 4 * ngram_join.SLICE
    ascii_rows = [(i, t.replace("É", "é")) for i, t in long_rows]  # only A to Z are lowered
    df = spark.createDataFrame(ascii_rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    want = jaccard(ascii_rows)
    assert got == want and {i: c for i, (_, c) in got.items()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 2, 6: 6}


def test_middle_of_long_texts(spark, long_rows):
    df = spark.createDataFrame(long_rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored("output", "form")).collect()}
    for doc_id, text in long_rows:
        r = got[doc_id]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == fim_by_hand(doc_id, text) and r["back"] == text, doc_id


def test_language_of_long_and_repeated_rows(spark, docs, corpus):
    """Each row of a repeated one has its own result, equal to the others; a text of millions of characters has one too."""
    long = spark.createDataFrame([(900, " ".join(r[1] for r in corpus if r[1] and r[2] == "de") * 400, None)], "doc_id long, text string, lang string")
    assert len(long.first().text) > 1_000_000
    rows = docs.select("doc_id", "text", "lang")
    found = language_id.predict_language(rows.unionByName(rows).unionByName(long), model=language_id.fit(docs)).collect()
    assert len(found) == 2 * len(corpus) + 1
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert all(len(v) == 1 for v in by.values()) and {x for x, _ in by[900]} <= {"de", "en"}
