"""Operators on texts against brute force, with odd rows."""

import hashlib
import random
import re
import struct
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.llm import bpe, language_id, license_scan, mixing, ngram_join, quality_rules, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_measures(docs, corpus, empty):
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert len(got) == len(corpus)
    for i, t, *_ in corpus:
        w = WORD.findall(t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(empty).count() == 0


def test_quality_is_native(docs):
    plan = quality_rules.apply_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("Exchange RoundRobin", "").replace("Exchange SinglePartition", "")


def removed(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                m[p : p + n] = True
            seen.add(b[p : p + n])
        kept = bytes(np.frombuffer(b, np.uint8)[~m])
        out[i] = (len(b), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(docs, corpus, empty):
    want = removed([(r[0], r[1]) for r in corpus])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 2000
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_in_pieces(spark, monkeypatch):
    """Texts with periods and edits, shorter strings, and rows without an id or twice."""
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("ab"), 400)) for _ in range(6)]
    texts = base + [base[0][:150] + "X" + base[1][20:300], "ab" * 200, "ba" * 150 + base[2][100:260], base[3][50:] + base[3][:120], base[4] + base[5]]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, base[0]), (4, base[4])], "doc_id long, text string")
    got = substring_dedup.remove_repeats(df, 60).collect()
    want = removed(rows, 60)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.n_removed for r in got if r.doc_id is None] == [0] and len(got) == len(texts) + 2


@pytest.mark.parametrize("hot", [1, 2048])
def test_substring_dedup_of_hot_anchors_and_slices(spark, monkeypatch, hot):
    """A passage in many different surroundings, and texts longer than a slice."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SLICE", 1000)
    rng = np.random.default_rng(8)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    common, long = word(150), word(5000)
    rows = [(i, f"{word(int(rng.integers(5, 90)))}{common[: int(rng.integers(100, 151))]}{word(int(rng.integers(5, 90)))}") for i in range(40)]
    rows += [(50, long), (51, long[700:2900] + word(50) + long[100:400]), (52, word(30) + long[4000:])]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(rows)


@pytest.mark.parametrize("hot", [1, 2048])
def test_substring_dedup_of_periods_and_zero_bytes(spark, monkeypatch, hot):
    """A place with several equal anchors is one place, strings begin in one range and go on in others, and texts end in zero bytes."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "RANGE", 64)
    rng = np.random.default_rng(21)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    a, b = word(37), word(90)
    rows = [(i, word(i) + a * 5 + word(20)) for i in range(12)] + [(20, "ab" * 200), (21, word(9) + "ab" * 90 + word(5)), (22, "x" * 500), (23, "xx" + "x" * 300 + word(3))]
    rows += [(30, b + "\0" * 9), (31, word(30) + b + "\0" * 40), (32, b + "\0" * 30), (33, b + "\0" * 12 + word(8)), (34, "\0" * 200), (35, word(4) + "\0" * 120 + b), (36, "\0" * 30 + b), (37, "\0" * 20 + b + "q")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(rows)


@pytest.mark.parametrize("size", [1 << 20, 1000])
def test_each_string_has_one_anchor(monkeypatch, size):
    """Strings of texts with periods are in one anchor's context each (two where pieces of a text meet), equal ones at the same place of it."""
    monkeypatch.setattr(substring_dedup, "SLICE", size)
    rng = np.random.default_rng(4)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    common = word(150)
    texts = [word(40) + "the " * 90 + word(60), "of " * 150 + word(3) + common, word(120) + common + "x" * 400, "y" * 99, "z" * 100, word(31) + common + "the " * 300]
    raw = [t.encode() for t in texts]
    anchors, seen = {}, Counter()
    for piece in substring_dedup._slices(list(range(len(texts))), pa.array(texts), 100):
        for h, _, doc, lo, left, n in substring_dedup._anchors(*piece, 100).tolist():
            for k in range(n - 99):
                anchors.setdefault(raw[doc][lo + k : lo + k + 100], set()).add((h, left - k))
                seen[doc, lo + k] += 1
    assert set(seen) == {(d, p) for d, t in enumerate(raw) for p in range(len(t) - 99)}
    assert all(len(v) == 1 for v in anchors.values())
    assert sum(seen.values()) - len(seen) <= sum(len(t) for t in raw) // 900


def test_substring_dedup_of_clashing_ids(spark):
    """Texts under one id are documents of their own, in order of the text's hash."""
    a, b, c = ("".join(chr(97 + (k * m) % 26) for k in range(300)) for m in (1, 3, 7))
    df = spark.createDataFrame([(1, a), (1, a + b), (1, a), (2, b), (3, c), (3, None), (None, c)], "doc_id long, text string").withColumn("own_id", F.lit("x"))
    order = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    ranked = sorted({(1, a), (1, a + b), (2, b), (3, c)}, key=lambda r: (r[0], order[r[1]]))
    want = removed([(k, t) for k, (_, t) in enumerate(ranked)])
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.own_id) for r in substring_dedup.remove_repeats(df, keep=("own_id",)).collect())
    expect = [(i, *want[k][:2], "x") for k, (i, t) in enumerate(ranked) for _ in range(2 if t == a else 1)] + [(3, 0, 0, "x"), (0, 300, 0, "x")]
    assert got == sorted(expect)


def places(text, s):
    return sorted((d, p) for d, t in text.items() for p in range(len(t) - len(s) + 1) if t.startswith(s, p))


@pytest.mark.parametrize("hot", [1, 2048])
def test_maximal_repeats(spark, monkeypatch, hot):
    """Groups are maximal to both sides, hold all occurrences, and cover every repeated string of the least length."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = np.random.default_rng(11)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    x, y, z = word(700), word(450), word(130)
    rows = [(0, x + y), (1, word(40) + x[100:] + word(20)), (2, word(60) + y + word(10) + z), (3, x[300:] + y[:200]), (4, word(20) + z + word(30)), (5, z), (6, None), (7, word(500))]
    text = {i: (t or "").encode() for i, t in rows}
    groups = {}
    for r in substring_dedup.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string"), step=512).collect():
        groups.setdefault(r.grp, []).append(r)
    covered = set()
    for members in groups.values():
        s = text[members[0].doc_id][members[0].lo : members[0].hi]
        at = sorted((r.doc_id, r.lo) for r in members)
        assert at == places(text, s) and len(at) > 1 and sum(r.first for r in members) == 1
        assert len({text[d][p - 1 : p] if p else (d, p) for d, p in at}) > 1 and len({text[d][p + len(s) : p + len(s) + 1] or (d, p) for d, p in at}) > 1
        covered |= {(d, p + k) for d, p in at for k in range(len(s) - 99)}
    windows = Counter(t[p : p + 100] for t in text.values() for p in range(len(t) - 99))
    assert covered == {(d, p) for d, t in text.items() for p in range(len(t) - 99) if windows[t[p : p + 100]] > 1}
    strings = {text[m[0].doc_id][m[0].lo : m[0].hi] for m in groups.values()}
    assert {x[100:].encode(), y.encode(), z.encode()} <= strings and len(strings) == len(groups)


def test_repeat_groups_have_all_occurrences(docs, corpus):
    rows = substring_dedup.find_repeats(docs, with_first=True).collect()
    text = {r[0]: (r[1] or "").encode() for r in corpus}
    groups = {}
    for r in rows:
        groups.setdefault(r.grp, []).append(r)
    assert groups
    for members in groups.values():
        strings = {text[r.doc_id][r.lo : r.hi] for r in members}
        assert len(strings) == 1 and len(min(strings)) >= 100
        s = min(strings)
        places = {(d, p) for d, t in text.items() for p in range(len(t) - len(s) + 1) if t.startswith(s, p)}
        assert {(r.doc_id, r.lo) for r in members} <= places
        assert sum(r.first for r in members) == 1 and len({(r.doc_id, r.lo) for r in members}) > 1


def test_repeat_groups_of_many_equal_contexts(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    common, before, after = word(120), word(90), word(90)
    rows = [(i, f"{before}{common}{after}") for i in range(40)] + [(100, f"{word(90)}{common}{word(90)}"), (101, f"{word(90)}{common}"), (102, common)]
    text = {i: t.encode() for i, t in rows}
    groups = {}
    for r in substring_dedup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), with_first=True).collect():
        groups.setdefault(r.grp, []).append(r)
    for members in groups.values():
        s = text[members[0].doc_id][members[0].lo : members[0].hi]
        assert sorted((r.doc_id, r.lo) for r in members) == sorted((d, p) for d, t in text.items() for p in range(len(t) - len(s) + 1) if t.startswith(s, p))
        assert sum(r.first for r in members) == 1
    assert {len(m) for m in groups.values()} >= {40, 43}


def test_mixing(spark, docs, corpus, empty):
    rows = mixing.mix(mixing.sized_documents(docs, "source")).collect()
    again = mixing.mix(mixing.sized_documents(docs.repartition(3), "source")).collect()
    key = lambda r: r.doc_id
    assert [(r.doc_id, r.taken) for r in sorted(rows, key=key)] == [(r.doc_id, r.taken) for r in sorted(again, key=key)]
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in corpus}
    assert {r.doc_id: r.size for r in rows} == size
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    of = [sum(r.size for r in by[s]) for s in names]
    want = mixing.target_sizes(of, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    for s, z, t in zip(names, of, want, strict=True):
        assert all(r.source_size == z and abs(r.target - t) < 1e-6 for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - t) <= max(r.size for r in by[s])
    assert mixing.mix(mixing.sized_documents(empty)).count() == 0


def water(sizes, weights, total, most):
    """Targets by bisection on the level: each source's is its weight times the level, at most `most` times its size."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(w * mid, most * z) for w, z in zip(weights, sizes, strict=True)) < total:
            low = mid
        else:
            high = mid
    return [min(w * low, most * z) for w, z in zip(weights, sizes, strict=True)]


def test_targets_against_bisection():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 40):
        sizes = [int(x) for x in rng.integers(1, 1000, n)]
        weights = [(3, 1, 2)[i % 3] for i in range(n)]
        assert mixing.target_sizes(sizes, weights, 1.5, 2) == pytest.approx(water(sizes, weights, 1.5 * sum(sizes), 2), rel=1e-6)


def test_mixing_of_rows_without_id(spark):
    """Ties: rows with one id or none and equal sizes; the mix is near its targets and reruns agree on the sums."""
    rows = [(None, f"t{i}", "a" if i % 3 else "b") for i in range(500)] + [(7, "same text", "c")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(mixing.sized_documents(df, "source", "text"), spread=("text_hash",)).collect()
    by = {s: sum(r.taken for r in out if r.source == s) for s in "abc"}
    sizes = [333, 167, 400]
    assert len(out) == 700 and all(abs(by[s] - t) <= 2 for s, t in zip("abc", water(sizes, (3, 1, 2), 1350, 2), strict=True))


def test_targets_and_flow():
    assert mixing.target_sizes([10, 100, 100], [3, 1, 2], 1.5, 2) == pytest.approx([20, 295 / 3, 590 / 3])
    assert mixing.target_sizes([], [], 1.5, 2) == [] and mixing.target_sizes([0, 0], [1, 1], 1.5, 2) == [0, 0]
    # the shared documents go where the alone ones don't suffice
    flow = mixing.route([(0,), (0, 1), (1,)], [10, 10, 50], [20, 40], 2)
    assert sum(f.get(0, 0) for f in flow) == 20 and sum(f.get(1, 0) for f in flow) == 40
    assert flow[0][0] == 10 and flow[1][0] == 10
    # repeats cost: nothing is repeated while fresh words are left
    assert [sum(f.values()) for f in mixing.route([(0,), (0,)], [10, 10], [20], 2)] == [10, 10]


def test_mixing_overlapping_sources(spark):
    rows = [(i, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "b"], 10) for i in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, sources array<string>, size long"), weights=(1, 1), share=1.0).collect()
    assert sum(r.taken for r in out) == pytest.approx(3000, abs=30) and max(r.taken for r in out) <= 20


def test_mixing_many_sources(spark):
    rows = [(i, [f"s{i % 1500:04}"], 10 + i % 7) for i in range(6000)] + [(9000 + i, ["x", "y"] if i % 2 else ["x"], 10) for i in range(100)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")).collect()
    of = {}
    for _, many, z in rows:
        for s in many:
            of[s] = of.get(s, 0) + z
    names = sorted(of)
    want = dict(zip(names, mixing.target_sizes([of[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2, sum(z for *_, z in rows)), strict=True))
    taken = {}
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[tuple(r.sources)] = taken.get(tuple(r.sources), 0) + r.taken
    assert len(out) == len(rows) and len(taken) == 1502
    assert all(abs(t - want[k[0]]) <= 16 for k, t in taken.items() if k[0] not in "xy")


def test_license_scan(spark, empty):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    rows = [(1, bsd), (2, "x\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (3, "All rights reserved."), (4, None), (5, ""), (6, "mit licence, they say")]
    got = {r.doc_id: (r.n_licence_sentences, r.licences, r.unresolved) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, "BSD-2-Clause", False), 2: (2, "MIT,Apache-2.0", False), 3: (1, "", True), 4: (0, "", False), 5: (0, "", False), 6: (0, "", False)}
    assert license_scan.scan(empty).count() == 0


def test_license_scan_standard_notices(spark):
    warranty = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    gpl = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    notices = {
        "MIT": ["Copyright (c) 2020 A. Person", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", warranty],
        "Apache-2.0": ["Copyright 2020 A. Person", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
        "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
        "GPL-3.0-or-later": ["Copyright (C) 2020 A. Person", f"This program is free software: {gpl}, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."],
        "GPL-2.0-or-later": ["Copyright (C) 2020 A. Person", f"This program is free software; {gpl}; either version 2 of the License, or (at your option) any later version."],
        "LGPL-2.1-or-later": [f"This library is free software; {gpl.replace('General', 'Lesser General')}; either version 2.1 of the License, or (at your option) any later version."],
        "AGPL-3.0-or-later": [f"This program is free software: {gpl.replace('General', 'Affero General')}, either version 3 of the License, or (at your option) any later version."],
        "ISC": ["Copyright (c) 2020, A. Person", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
        "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
        "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
        "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
        "Unlicense": ["This is free and unencumbered software released into the public domain."],
    }
    forms = {
        "wrapped": lambda ps: "\n\n".join(textwrap.fill(p, 70) for p in ps),
        "crlf": lambda ps: "\r\n\r\n".join(textwrap.fill(p, 70).replace("\n", "\r\n") for p in ps),
        "comment": lambda ps: "/*\n" + "\n *\n".join(textwrap.fill(p, 60, initial_indent=" * ", subsequent_indent=" * ") for p in ps) + "\n */\nint x;",
        "hash": lambda ps: "\n#\n".join(textwrap.fill(p, 60, initial_indent="# ", subsequent_indent="# ") for p in ps) + "\nimport os",
        "paragraphs": "\n\n".join,
        "line": " ".join,
    }
    rows = [(f"{name} {form}", f(ps)) for name, ps in notices.items() for form, f in forms.items()]
    rows += [(f"{x} spdx", f"#!/bin/sh\n# SPDX-License-Identifier: {x}\necho") for x in ("MIT", "Apache-2.0", "GPL-3.0-or-later")]
    rows.append(("near miss", "Permission is hereby granted, free of charge, to any person obtaining a copy of this book, to read it."))
    rows.append(("other spdx", "SPDX-License-Identifier: MIT-Modern-Variant"))
    rows.append(("blank line", "Released under\n\nthe MIT License."))
    rows.append(("inside", "it was never released under the MIT License by us"))
    got = {r.doc_id: r.licences for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {k: k.split(" ")[0] if k.split(" ")[0] in notices else "" for k, _ in rows}
    rule = {"MIT": "mit_grant,mit_notice,asis_warranty", "Apache-2.0": "apache2_short,apache2_comply,apache2_asis", "BSD-3-Clause": "bsd_grant,bsd_source,bsd_binary,bsd_endorse"}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        assert "spdx" in r.doc_id or r.sequence == rule.get(r.doc_id.split(" ")[0], r.sequence)
    import duckdb
    import pandas as pd

    documents = pd.DataFrame([*rows, *rows[:2], ("null", None), ("empty", "")], columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(license_scan.ORACLES["op4_license_scan"]).fetchall()
    clash = spark.createDataFrame([*rows, *rows[:2], ("null", None), ("empty", "")], "doc_id string, text string").withColumns({"sequence": F.lit(1), "seq": F.lit(2), "ids": F.lit(3)})
    assert sorted(tuple(r) for r in license_scan.scan(clash).collect()) == sorted(want)


def test_language_id_is_kernel_ridge():
    """With all rows as landmarks, scores are those of kernel ridge regression solved directly."""
    rng = np.random.default_rng(3)
    alphabets = {"x": "abcdefg ", "y": "efghijk ", "z": "mnopabc "}
    rows = [("".join(rng.choice(list(alphabets[k]), 60)), k) for k in alphabets for _ in range(9)]
    texts, labels = [t for t, _ in rows], [k for _, k in rows]

    def kernel(a, b):
        sets = [[{t[i : i + n] for i in range(len(t) - n + 1)} for t in (f" {' '.join(s.split())} " for s in (a, b))] for n in (1, 2, 3)]
        return sum(w * len(x & y) / np.sqrt(len(x) * len(y)) for w, (x, y) in zip((0.2, 0.3, 0.5), sets, strict=True))

    gram = np.array([[kernel(a, b) for b in texts] for a in texts])
    y = np.where(np.array(labels)[:, None] == np.array(sorted(alphabets))[None], 1.0, -1.0)
    n = len(texts)
    system = np.block([[gram + language_id.RIDGE * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    solved = np.linalg.solve(system, np.vstack([y, np.zeros((1, 3))]))
    asked = ["".join(rng.choice(list("abcdefghijkmnop "), 50)) for _ in range(70)]
    want = np.array([[kernel(a, b) for b in texts] for a in asked]) @ solved[:-1] + solved[-1]
    assert np.allclose(language_id.train(texts, labels, 1000).scores(asked), want, atol=1e-3)
    few = language_id.train(texts, labels, 12)
    assert few.predict(texts)[0] == labels


def test_language_id_of_many_languages(spark, monkeypatch):
    """More labels than rows of the sample allow: each still has one row; digits and fractions are no letters."""
    monkeypatch.setattr(language_id, "SAMPLE", 150)
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 20, f"l{i:03}") for i in range(201)] * 2 + [(900 + k, t, None) for k, t in enumerate(("½²Ⅷ①", "12", "é", "日本"))]
    got = {r.doc_id: r.lang_pred for r in language_id.predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held_out=F.lit(False)).collect()}
    assert len(got) == 205 and len({got[i] for i in range(201)}) > 150 and got[900] == got[901] == "und" and got[902] != "und" != got[903]


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.predict_language(docs).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").where(language_id.third() == 1)
    hits = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert hits[0] >= 0.97 and 0 <= hits[1] <= hits[2] <= 1


def test_language_id_edges(spark, docs, empty):
    rows = {r.doc_id: r for r in language_id.predict_language(docs, keep=["doc_id", "text"]).collect()}
    for r in rows.values():
        assert (r.lang_pred == "und") == (not r.text or not re.sub(r"[\W\d_]", "", r.text)), r.doc_id
        assert r.lang_pred in ("de", "en", "und") and 0 <= r.score <= 1
    assert language_id.predict_language(empty).count() == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predict_language(none).collect()} == {"und"}


def test_bpe(docs, corpus, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert len(got) == len(corpus)
    for i, text, *_ in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want = t.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(want.encode()).hexdigest()), (i, text)
    back = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    assert all(hashlib.sha256(back[i].text.encode()).hexdigest() == got[i].decoded_sha256 == back[i].decoded_sha256 for i in got)
    assert bpe.digests(empty).count() == 0


def jaccard(rows):
    sets = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = top(x), top(y)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_jaccard(docs, corpus, empty):
    want = jaccard([(r[0], r[1]) for r in corpus])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == want and any(c != i for i, (_, c) in want.items())
    assert ngram_join.jaccard_components(empty).count() == 0


def test_jaccard_links(docs, corpus, spark, empty):
    """Every pair of different sets that link, connected or not; rows without an id are in no link."""
    sets, lower = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(r[0], r[1]) for r in corpus] + [(500 + i, " ".join(f"w{k}" if k != 7 * i else f"x{i}" for k in range(90))) for i in range(12)]
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        if s:
            sets.setdefault(s, i)
    want = {tuple(sorted((i, j))): len(a & b) for a, i in sets.items() for b, j in sets.items() if i < j and 100 * len(a & b) >= 75 * len(a | b)}
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(3)
    got = ngram_join.jaccard_links(df).collect()
    first = {i: sets[s] for s, i in sets.items()}
    assert {(r.a, r.b): r.common for r in got if r.a in first and r.b in first} == want and len(want) > 60
    assert ngram_join.jaccard_links(empty).count() == 0
    nameless = [r for r in ngram_join.jaccard_components(df).collect() if r.doc_id is None]
    assert len(nameless) == 1 and nameless[0].component_id is None and nameless[0].n_shingles > 0


@pytest.mark.parametrize("block", [30, 1024])
def test_jaccard_long_lists(spark, monkeypatch, block):
    """A large group of near copies, some of them at the edge, and a chain: lists are long and pairs stay open."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.choice(200, int(rng.integers(0, 9)), replace=False):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words[: int(rng.integers(150, 200))])))
    rows += [(200 + i, " ".join(f"c{k}" for k in range(10 * i, 10 * i + 100))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == jaccard(rows)


@pytest.mark.parametrize("map_words", [1, 1 << 18])
def test_named_texts(spark, monkeypatch, map_words):
    """The map of named documents never loses one, full or not; missing ids and a clashing column don't matter."""
    monkeypatch.setattr(ngram_join, "MAP_WORDS", map_words)
    docs = spark.createDataFrame([(i, f"t{i}", i) for i in range(-500, 500)] + [(None, "x", 0)], "doc_id long, text string, id long")
    ids = spark.createDataFrame([(i,) for i in range(-500, 500, 7)], "id long")
    got = {r.doc_id: r.text for r in ngram_join._named(docs, ids).collect()}
    assert {i: f"t{i}" for i in range(-500, 500, 7)}.items() <= got.items()
    assert map_words == 1 or len(got) < 200
    assert ngram_join._named(docs, ids.where("false")).count() == 0


def test_jaccard_with_a_full_map(docs, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "MAP_WORDS", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == jaccard([(r[0], r[1]) for r in corpus])


def test_licences_with_names(spark):
    """Names stand where the published texts have the holder's: with an abbreviation's full stop, wrapped, in comments."""
    head = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
    tail = "may be used to endorse or promote products derived from this software without specific prior written permission."
    names = ["Neither the name of Google Inc. nor the names of its contributors", "Neither the name of the University of California, Berkeley nor the names of its contributors", "Neither the name of Foo\n * Bar & Co. nor the names of\n * its contributors", "Neither the name of the copyright holder nor the names of its contributors", "Neither the name of ACME nor the names of contributors"]
    rows = [(i, "\n".join([*head, f"{n} {tail}"])) for i, n in enumerate(names)]
    rows += [(10, "\n".join(head)), (11, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND ACME LTD. DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.")]
    rows += [(12, f"Neither the name of {'a ' * 20}nor the names of its contributors {tail}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.licences for r in license_scan.scan(df).collect()}
    assert got == {**{i: "BSD-3-Clause" for i in range(5)}, 10: "BSD-2-Clause", 11: "ISC", 12: ""}
    documents = df.toPandas()  # noqa: F841
    assert {r[0]: r[3] for r in duckdb.sql(license_scan.ORACLES["op4_license_scan"]).fetchall()} == got


def test_words_are_whole_for_the_library(spark, monkeypatch):
    """Odd letters, marks and punctuation in small chunks get the library's ids and decoded text."""
    monkeypatch.setattr(bpe, "CHUNK", 2000)
    rng = random.Random(11)
    bits = [" ", " ", "a", "B", "\u0130", "\u0131", "\u00df", "\u01c5", "\u1e9e", "\u0307", "\u00e9", "e\u0301", ".", ",", "!", "'s", "'", "-", "1", "\n", "\t", "\u00a0", "\u2003", "\u65e5", "_", "@", "\U0001f642", "<|endoftext|>", "<|startoftext|>", "Merkez: \u0130STANBUL\u0130.", "\u0149", "\u01f0", "\ufb01"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(6000)] + ["long \u0130. " * 3000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    t = bpe._tokenizer(bpe.tokenizer_path())
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in bpe.encode(df).collect()}
    bad = [(texts[i], got[i][0], w) for i, w in enumerate(want) if got[i] != (w, hashlib.sha256(t.decode(w, skip_special_tokens=False).encode()).hexdigest())]
    assert not bad, (len(bad), bad[:3])


def test_licences_of_published_texts(spark):
    """Notices as they are published, on one line, wrapped and as a comment; two alternatives are one expression."""
    texts = {
        "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
        "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "EPL-1.0": "Eclipse Public License - v 1.0",
        "LGPL-2.0-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "LGPL-2.0": "GNU LIBRARY GENERAL PUBLIC LICENSE\n Version 2, June 1991",
        "MIT": "This project is licensed under the terms of the MIT license.",
        "MIT OR Apache-2.0": "Licensed under the Apache License, Version 2.0 <LICENSE-APACHE or http://www.apache.org/licenses/LICENSE-2.0> or the MIT license <LICENSE-MIT or http://opensource.org/licenses/MIT>, at your option. This file may not be copied, modified, or distributed except according to those terms.",
        "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal",
    }
    more = [("BSL-1.0", "// SPDX-License-Identifier: BSL-1.0"), ("Zlib", "# SPDX-License-Identifier: Zlib"), ("MIT OR Apache-2.0", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."), ("", "The origin of this software must not be misrepresented."), ("", "x " * 100_000)]
    wanted = []
    for name, text in [*texts.items(), *more]:
        parts = text.split("\n")
        wrapped = ["\n".join(textwrap.fill(p, 60) if p else p for p in parts)] if name else []
        wanted += [(name, t) for t in [text, *wrapped, *("\n".join(f" * {x}".rstrip() for x in w.split("\n")) for w in wrapped)]]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(wanted)], "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.unresolved) for r in license_scan.scan(df).collect()}
    assert {i: got[i][0] for i in got} == {i: name for i, (name, _) in enumerate(wanted)}
    assert [got[i][1] for i, (name, _) in enumerate(wanted) if not name] == [True, False]
    documents = df.toPandas()  # noqa: F841
    assert {r[0]: (r[3], r[4]) for r in duckdb.sql(license_scan.ORACLES["op4_license_scan"]).fetchall()} == got
