import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Small documents with copies, near copies, shared passages, odd and missing texts."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeäéñst") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    docs = [text(rng.randint(1, 200)) for _ in range(60)]
    docs += [docs[3]] * 4 + [f"{docs[5]} {passage}\n{text(30)}", f"{passage} {passage}", f"{text(40)}\n{passage}"]
    for k in range(8):
        words = docs[10 + k].split(" ")
        if len(words) > 20:
            words[len(words) // 2] = "ZZZ"
        docs.append(" ".join(words).upper() if k % 2 else " ".join(words))
    docs += [None, "", " \n\t ", "a", "one two three four", "ONE two three four", "ab " * 300, "#" * 500, "x" * 3000, "日本語 テキスト ΣΑΣ é <|endoftext|>"]
    langs = ["de", "en", None]
    return [(i, t, langs[i % 3], None if i % 11 == 0 else f"s{i % 4}", None if t is None else len(t), "clash", i % 2) for i, t in enumerate(docs)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, hash int"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
