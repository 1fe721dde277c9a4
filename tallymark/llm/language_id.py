"""Language identification with a blended-spectrum string kernel, Nyström landmarks and one-versus-rest ridge.

A text's features are the presences of its character n-grams (1 to ORDER characters, letters lower-cased, other
characters a single blank). The kernel of two texts is the blend over n of |common n-grams| / sqrt(|a| |b|). m
landmark texts give the Nyström feature map K_mm^(-1/2) k(x); one ridge regression for each language is solved in it.
Since the kernel is linear in the presences, landmarks, map and weights fold into one matrix for each n, and a batch
of texts is scored by the product of its presence matrix with these. A batch's matrices have a column only for n-grams
that its texts hold, so no matrix of all rows by the whole vocabulary is ever built.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

ORDER = 3
BLEND = (0.2, 0.3, 0.5)
#: Bounds of the labelled sample: rows of each language; rows of all (with very many languages each has fewer, one at
#: least); characters of a sampled text.
ROWS_PER_LANGUAGE, SAMPLE, MAX_CHARS = 150, 30_000, 20_000
LANDMARKS = 256
RIDGE = 1e-2
#: Directions of the landmarks' kernel below this share of the largest eigenvalue are left out.
THRESH = 1e-4
#: Texts in one product.
BATCH = 64
_OTHER = re.compile(r"[\W\d_]+")
_PLAIN = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """Whether a text holds a character of Unicode's letter categories."""
    return bool(text) and (_PLAIN.search(text) is not None or any(map(str.isalpha, text)))


def grams(text: str) -> list[np.ndarray]:
    """The distinct n-grams of a text for n = 1..ORDER, as sorted codes."""
    codes = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out, code = [], codes
    for n in range(1, ORDER + 1):
        if n > 1:
            code = (code[:-1] << 21) + codes[n - 1 :] if len(codes) >= n else code[:0]
        out.append(_distinct(code))
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _presence(sets: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries of the vocabulary any of the sets holds, and the 0/1 matrix of sets by these, scaled to unit rows."""
    size = np.array([len(x) for x in sets])
    code, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    at = np.minimum(np.searchsorted(vocabulary, code), max(len(vocabulary) - 1, 0))
    hit = vocabulary[at] == code if len(vocabulary) else np.zeros(len(code), bool)
    used, column = np.unique(at[hit], return_inverse=True)
    present = np.zeros((len(sets), len(used)), np.float32)
    present[of[hit], column] = 1
    return used, present / np.sqrt(np.maximum(size, 1), dtype=np.float32)[:, None]


@dataclass
class Model:
    languages: list[str]
    vocabulary: list[np.ndarray]
    weights: list[np.ndarray]  # of each n: n-grams of the vocabulary x languages
    bias: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        total = np.tile(self.bias, (len(texts), 1))
        sets = [grams(t) for t in texts]
        for n, (vocabulary, weights) in enumerate(zip(self.vocabulary, self.weights, strict=True)):
            used, present = _presence([s[n] for s in sets], vocabulary)
            total += BLEND[n] * (present @ weights[used])
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        live = [i for i, t in enumerate(texts) if has_letter(t)]
        name, score = ["und"] * len(texts), [0.0] * len(texts)
        for at in range(0, len(live) if self.languages else 0, BATCH):
            part = live[at : at + BATCH]
            s = self.scores([texts[i] for i in part])
            best = s.argmax(1)
            p = np.exp(8 * (s - s.max(1, keepdims=True)))
            p = 1 / p.sum(1)
            for k, i in enumerate(part):
                name[i], score[i] = self.languages[best[k]], float(p[k])
        return name, score


def landmarks(labels: list[str], many: int) -> list[int]:
    """Places of about `many` landmarks: the languages take turns, each gives one at least."""
    turn, seen = [], {}
    for i, label in enumerate(labels):
        seen[label] = seen.get(label, -1) + 1
        turn.append((seen[label], label, i))
    turn.sort()
    return sorted(i for _, _, i in turn[: max(many, len(seen))])


def kernel(sets: list[list[np.ndarray]], marks: list[int]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Blended kernel of all sets with the marks, and of each n the marks' vocabulary and their scaled presences (mark, entry, value)."""
    out, vocabularies, entries = np.zeros((len(sets), len(marks))), [], []
    for n in range(ORDER):
        own = [sets[i][n] for i in marks]
        size = np.array([len(x) for x in own])
        code, of = np.concatenate(own), np.repeat(np.arange(len(own)), size)
        vocabulary, column = np.unique(code, return_inverse=True)
        by = np.argsort(column, kind="stable")
        mark, value = of[by], (1 / np.sqrt(np.maximum(size, 1)))[of[by]].astype(np.float32)
        start = np.concatenate((np.searchsorted(column[by], np.arange(len(vocabulary))), [len(by)]))
        for i in range(0, len(sets), BATCH):
            used, present = _presence([s[n] for s in sets[i : i + BATCH]], vocabulary)
            if not len(used):
                continue
            many = start[used + 1] - start[used]
            row = np.repeat(np.arange(len(used)), many)
            at = np.repeat(start[used], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            held = np.zeros((len(used), len(marks)), np.float32)
            held[row, mark[at]] = value[at]
            out[i : i + BATCH] += BLEND[n] * (present @ held)
        vocabularies.append(vocabulary)
        entries.append((mark, column[by], value))
    return out, vocabularies, entries


def train(texts: list[str], labels: list[str], many: int = LANDMARKS) -> Model:
    """Fit on the sample given, in its order; no rows or one language are fine."""
    languages = sorted(set(labels))
    if not texts:
        return Model([], [np.zeros(0, np.int64)] * ORDER, [np.zeros((0, 0), np.float32)] * ORDER, np.zeros(0))
    sets = [grams(t) for t in texts]
    marks = landmarks(labels, many)
    k, vocabulary, entries = kernel(sets, marks)
    value, vector = np.linalg.eigh(k[marks])
    keep = value > THRESH * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = np.hstack([k @ root, np.ones((len(texts), 1))])
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None], 1.0, -1.0)
    penal = RIDGE * np.eye(phi.shape[1])
    penal[-1, -1] = 1e-9
    w = np.linalg.solve(phi.T @ phi + penal, phi.T @ y)
    folded = (root @ w[:-1]).astype(np.float32)
    weights = []
    for v, (mark, column, scaled) in zip(vocabulary, entries, strict=True):
        out = np.zeros((len(v), len(languages)), np.float32)
        for at in range(0, len(mark), 1 << 16):  # rows are added by entry of the vocabulary
            part = slice(at, at + (1 << 16))
            np.add.at(out, column[part], folded[mark[part]] * scaled[part, None])
        weights.append(out)
    return Model(languages, vocabulary, weights, w[-1])


def labelled_sample(docs: DataFrame, held_out) -> tuple[list[str], list[str]]:
    """At most ROWS_PER_LANGUAGE rows of each language (the least by a hash of doc_id), SAMPLE in all where there are so
    few languages, of at most MAX_CHARS characters."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out & (F.length("text") <= MAX_CHARS) & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    each = max(1, min(ROWS_PER_LANGUAGE, SAMPLE // max(1, docs.select("lang").distinct().count())))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    first = rows.select("doc_id", "lang", "h").withColumn("n", F.row_number().over(order)).where(f"n <= {each}").drop("n").distinct().collect()
    if not first:
        return [], []
    wanted = docs.sparkSession.createDataFrame([(h,) for h in {r["h"] for r in first}], "h long")  # as many as the sample
    texts = {r["h"]: r["text"] for r in rows.join(F.broadcast(wanted), "h").groupBy("h").agg(F.min("text").alias("text")).collect()}
    first.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["h"]))
    return [texts[r["h"]] for r in first], [r["lang"] for r in first]


def third(doc_id="doc_id"):
    """crc32 of doc_id as text, modulo 3; null ids count as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)), F.lit(0))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                name, score = model.predict(part.column("_text").to_pylist())
                rest = part.drop_columns(["_text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(name, pa.string()), pa.array(score, pa.float64())], [*rest.schema.names, "lang_pred", "score"])

    return run


def fit(docs: DataFrame, held_out=None) -> Model:
    """Learn from rows of docs with text and lang outside held_out (by default crc32(doc_id) mod 3 = 1)."""
    return train(*labelled_sample(docs, third() == 1 if held_out is None else held_out))


def predict_language(docs: DataFrame, held_out=None, keep: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """The columns keep of docs (by default all but text), then lang_pred (a learned value, `und` for null texts and
    texts without a letter) and score (0 to 1; 0 for `und`). Whole texts are read.

    Without a model, learns from docs as fit() does; if nothing could be learned, all is `und`. lang, source and doc_id
    are no input of a prediction. Equal texts get equal results; rows repeat as they come; among languages of one score
    the first in order wins. An empty table gives none. Columns of docs named lang_pred or score are left out.
    """
    model = model or fit(docs, held_out)
    kept = [c for c in (keep or [c for c in docs.columns if c != "text"]) if c not in ("lang_pred", "score")]
    rows = docs.select(*kept, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema)
    return rows.mapInArrow(_score(model), f"{schema}, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict_language(docs).select("doc_id", (third() == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
