"""Licence scan: sentences become known identifiers, sequences of identifiers match ordered licence rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Licence sentences in normal form (lower case, letters and digits, single spaces) by identifier; NAME is a
# name of one to NAME_WORDS words.
SENTENCES = {
    "apache2_short": (
        "licensed under the apache license version 2 0", "released under the apache license version 2 0", "licensed under the apache license version 2 0 the license",
        "licensed under the terms of the apache license version 2 0", "distributed under the apache license version 2 0",
    ),
    "apache2_title": ("apache license version 2 0 january 2004",),
    "apache2_comply": ("you may not use this file except in compliance with the license",),
    "apache2_asis": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "mit_short": (
        "released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "licensed under the terms of the mit license",
        "this project is licensed under the terms of the mit license", "released under the terms of the mit license", "distributed under the mit license",
    ),
    "mit_or_apache2": (
        "licensed under either of apache license version 2 0 or mit license at your option",
        "licensed under either the mit license or the apache license version 2 0 at your option",
        "licensed under the apache license version 2 0 license apache or http www apache org licenses license 2 0 or the mit license license mit or http opensource org licenses mit at your option",
        "licensed under the apache license version 2 0 license apache or https www apache org licenses license 2 0 or the mit license license mit or https opensource org licenses mit at your option",
    ),
    "mit_grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "asis_warranty": (
        "the software is provided as is without warranty of any kind express or implied",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "zero_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "isc_warranty": ("the software is provided as is and NAME disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "bsd_grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_endorse": (
        "neither the name of NAME nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of NAME nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the names of NAME nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of NAME may not be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "mpl2_form": ("this source code form is subject to the terms of the mozilla public license v",),
    "mpl2_copy": (
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    ),
    "mpl2_title": ("mozilla public license version 2 0",),
    "gpl3_short": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"),
    "zlib_asis": ("this software is provided as is without any express or implied warranty",),
    "zlib_grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "zlib_origin": ("the origin of this software must not be misrepresented",),
    "bsl1_title": ("boost software license version 1 0 august 17th 2003",),
    "bsl1_short": ("distributed under the boost software license version 1 0", "licensed under the boost software license version 1 0"),
    "epl1_title": ("eclipse public license v 1 0",),
    "epl1_terms": ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",),
    "epl2_title": ("eclipse public license v 2 0",),
    "epl2_terms": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    ),
    "lgpl2_title": ("gnu library general public license version 2 june 1991",),
    "gpl2_title": ("gnu general public license version 2 june 1991",),
    "gpl3_title": ("gnu general public license version 3 29 june 2007",),
    "lgpl21_title": ("gnu lesser general public license version 2 1 february 1999",),
    "lgpl3_title": ("gnu lesser general public license version 3 29 june 2007",),
    "agpl3_title": ("gnu affero general public license version 3 19 november 2007",),
    "ccbync4": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "released under cc by nc 4 0"),
    "ccby4": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0", "released under cc by 4 0"),
    "cc0": ("cc0 1 0 universal", "released under cc0 1 0", "this work is dedicated to the public domain under cc0 1 0"),
    "cc0_waiver": ("has waived all copyright and related or neighboring rights to this work",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "all_rights": ("all rights reserved",),
}
# GNU licences (name in their notices, SPDX prefix, identifier prefix, versions) and Creative Commons 4.0 (name, SPDX).
GNU = (("general", "GPL", "gpl", ("2", "3")), ("library general", "LGPL", "lgpl_library", ("2",)), ("lesser general", "LGPL", "lgpl", ("2 1", "3")), ("affero general", "AGPL", "agpl", ("3",)))
CREATIVE = (
    ("attribution", "CC-BY-4.0"), ("attribution sharealike", "CC-BY-SA-4.0"), ("attribution noncommercial", "CC-BY-NC-4.0"), ("attribution noderivatives", "CC-BY-ND-4.0"),
    ("attribution noncommercial sharealike", "CC-BY-NC-SA-4.0"), ("attribution noncommercial noderivatives", "CC-BY-NC-ND-4.0"),
)
# Names after SPDX-License-Identifier.
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Zlib", "BSL-1.0", "EPL-1.0", "EPL-2.0", "MIT OR Apache-2.0", "Apache-2.0 OR MIT",
)
#: Ordered rules: the identifiers that must follow each other (others may stand between), licence.
RULES = [
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"), "BSD-3-Clause"),
    (("bsd_grant", "bsd_source", "bsd_binary"), "BSD-2-Clause"),
    (("mit_grant", "mit_notice", "asis_warranty"), "MIT"),
    (("mit_short",), "MIT"),
    (("mit_or_apache2",), "MIT OR Apache-2.0"),
    (("zlib_asis", "zlib_grant", "zlib_origin"), "Zlib"),
    (("bsl1_title",), "BSL-1.0"),
    (("bsl1_short",), "BSL-1.0"),
    (("epl1_title",), "EPL-1.0"),
    (("epl1_terms",), "EPL-1.0"),
    (("epl2_title",), "EPL-2.0"),
    (("epl2_terms",), "EPL-2.0"),
    (("lgpl2_title",), "LGPL-2.0"),
    (("apache2_short", "apache2_comply", "apache2_asis"), "Apache-2.0"),
    (("apache2_short",), "Apache-2.0"),
    (("apache2_title",), "Apache-2.0"),
    (("isc_grant", "isc_warranty"), "ISC"),
    (("zero_grant", "isc_warranty"), "0BSD"),
    (("mpl2_form", "mpl2_copy"), "MPL-2.0"),
    (("mpl2_title",), "MPL-2.0"),
    (("gpl3_short",), "GPL-3.0"),
    (("gpl2_title",), "GPL-2.0"),
    (("gpl3_title",), "GPL-3.0"),
    (("lgpl21_title",), "LGPL-2.1"),
    (("lgpl3_title",), "LGPL-3.0"),
    (("agpl3_title",), "AGPL-3.0"),
    (("ccbync4",), "CC-BY-NC-4.0"),
    (("ccby4",), "CC-BY-4.0"),
    (("cc0",), "CC0-1.0"),
    (("cc0_waiver",), "CC0-1.0"),
    (("unlicense",), "Unlicense"),
]


def _normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def _add_families() -> None:
    """Sentences and rules that follow a pattern: GNU notices, Creative Commons lines, SPDX lines."""
    for name, short, key, versions in GNU:
        free = f"you can redistribute it and or modify it under the terms of the gnu {name} public license"
        SENTENCES[f"{key}_free"] = (f"{free} as published by the free software foundation",)
        for v in versions:
            spdx, id_ = f"{short}-{v.replace(' ', '.') if ' ' in v else v + '.0'}", f"{key}{v.replace(' ', '')}"
            later = f"either version {v} of the license or at your option any later version"
            SENTENCES[f"gnu{v.replace(' ', '')}_later"] = (later,)
            SENTENCES[f"{id_}_grant"] = (f"{free} as published by the free software foundation {later}",)
            SENTENCES[f"{id_}_only"] = (f"{free} version {v} as published by the free software foundation",)
            RULES.append(((f"{key}_free", f"gnu{v.replace(' ', '')}_later"), f"{spdx}-or-later"))
            RULES.append(((f"{id_}_grant",), f"{spdx}-or-later"))
            RULES.append(((f"{id_}_only",), f"{spdx}-only"))
    for name, spdx in CREATIVE:
        id_ = "cc_" + "".join(w[0] for w in name.split()) + "_" + name.split()[-1]
        SENTENCES[id_] = (f"this work is licensed under a creative commons {name} 4 0 international license", f"licensed under a creative commons {name} 4 0 international license")
        RULES.append(((id_,), spdx))
    for spdx in SPDX:
        id_ = "spdx_" + _normal(spdx).replace(" ", "_")
        SENTENCES[id_] = (f"spdx license identifier {_normal(spdx)}",)
        RULES.append(((id_,), spdx))


_add_families()
_ID = {s: i for i, many in SENTENCES.items() for s in many}
#: Sentences of so many words may also start inside a sentence, as after a copyright line or an address without an end.
LONG = 10
#: Every known sentence holds one of these; texts without any aren't looked at further.
HINTS = ("licen", "redistribut", "permission", "copyright", "warrant", "rights", "mozilla", "mpl", "cc0", "released", "misrepresent")
assert all(any(h in s for h in HINTS) for s in _ID)


#: Words that a name in a sentence may have.
NAME_WORDS = 12


def _any_of(many, blank: str) -> str:
    name = rf"[a-z0-9]+(?:\x01*{blank}[a-z0-9]+){{0,{NAME_WORDS - 1}}}?\x01*"  # with the full stop of an Inc.
    return "(?:" + "|".join(s.replace(" ", blank).replace("NAME", name) for s in sorted(many, key=lambda s: (-len(s), s))) + ")"


#: How a sentence with a name is told from its words before and after it, and the sentence as it stands above.
_NAMED = [(f"^{s.replace('NAME', '.+')}$", s) for s in _ID if "NAME" in s]


_LONG = [s for s in _ID if s.count(" ") >= LONG - 1]
_END = r"(?= ?(?:\z|[\n\x01]))"
_KNOWN = rf"(?<=\A|\A |[\n\x01]|\x01 ){_any_of(_ID, '[ \n]')}{_END}|(?<=[ \n]){_any_of(_LONG, '[ \n]')}{_END}"


def _nameless(sentence: Column) -> Column:
    for pattern, known in _NAMED:
        sentence = F.regexp_replace(sentence, pattern, known)
    return sentence


def sentences(text: Column) -> Column:
    """Known sentences of a text in normal form, in text order.

    A sentence starts and ends at . ! ? ; : before white space or at a line's start and end; inside it, line feeds with
    the comment marks around them are blanks, but a blank line ends it. The colon after SPDX-License-Identifier ends
    nothing.
    """
    one = F.regexp_replace(F.translate(text, "\x01", " "), r"(?i)(spdx-license-identifier):", "$1 ")
    cut = F.regexp_replace(one, r"[.!?;:](?=[\x20\x09-\x0D])", "\x01")
    plain = F.regexp_replace(F.regexp_replace(F.lower(cut), r"[^a-z0-9\n\x01]+", " "), " ?\n ?", "\n")
    found = F.transform(F.regexp_extract_all(plain, F.lit(_KNOWN), F.lit(0)), lambda s: _nameless(F.translate(s, "\n", " ")))
    low = F.lower(text)
    hint = F.lit(False)
    for h in HINTS:
        hint = hint | F.contains(low, F.lit(h))
    return F.when(hint, found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_licence_sentences, sequence (identifiers in text order, comma-separated), licences (all whose rule
    matches, in the rules' order, without those that an earlier rule of the same first sentence covers),
    unresolved (identifiers stand there, but no rule matches).

    A rule matches if its identifiers follow each other in the sequence. Null and empty texts have none; rows repeat
    as they come; other columns are ignored; an empty table gives none. All in one projection; no shuffle.
    """
    known = sentences(F.coalesce("text", F.lit("")))
    ids = F.create_map(*[F.lit(x) for kv in _ID.items() for x in kv])
    found = docs.select("doc_id", known.alias("known")).select("doc_id", F.transform("known", lambda s: F.element_at(ids, s)).alias("ids"))
    seq = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    found = found.select("doc_id", F.size("ids").cast("long").alias("n_licence_sentences"), F.array_join("ids", ",").alias("sequence"), seq.alias("seq"))
    hits, before = [], []
    for members, name in RULES:
        match = F.col("seq").rlike("," + ",(.*,)?".join(members) + ",")
        hit = match
        for m, earlier in before:
            if m[0] == members[0]:
                hit = hit & ~earlier
        before.append((members, match))
        hits.append(F.when(hit, F.lit(name)))
    licences = F.when(F.col("n_licence_sentences") > 0, F.array_join(F.array_distinct(F.array_compact(F.array(*hits))), ",")).otherwise("")
    out = found.withColumn("licences", licences)
    return out.withColumn("unresolved", (F.col("n_licence_sentences") > 0) & (F.col("licences") == "")).drop("seq")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _rule_sql() -> str:
    out = []
    for k, (members, name) in enumerate(RULES):
        tests = [f"regexp_matches(seq, '{',' + ',(.*,)?'.join(members) + ','}')"]
        tests += [f"NOT regexp_matches(seq, '{',' + ',(.*,)?'.join(m) + ','}')" for m, _ in RULES[:k] if m[0] == members[0]]
        out.append(f"CASE WHEN {' AND '.join(tests)} THEN '{name}' END")
    return ",\n    ".join(out)


def _nameless_sql(sentence: str) -> str:
    for pattern, known in _NAMED:
        sentence = f"regexp_replace({sentence}, '{pattern}', '{known}')"
    return sentence


_IDS_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _ID.items()) + "}"
# Ends are doubled, so that a match may take one and leave the other to the next: this engine has no look-around. A long
# sentence inside another is found from the blank before it.
_BLANK_SQL = r"(?: |\n\n)"
_START_SQL = rf"(?:^ ?|[\n\x01] ?){_any_of(_ID, _BLANK_SQL)} ?(?:$|[\n\x01])"
_INSIDE_SQL = rf"[ \n]{_any_of(_LONG, _BLANK_SQL)} ?(?:$|[\n\x01])"
ORACLES = {
    "op4_license_scan": rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '(spdx-license-identifier):', '\1 ', 'gi') AS t FROM documents
), c AS (
  SELECT r, doc_id, regexp_replace(regexp_replace(lower(regexp_replace(t, '[.!?;:]([\x20\x09-\x0D])', chr(1) || '\1', 'g')), '[^a-z0-9\n\x01]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS t FROM t
), s AS (
  SELECT r, doc_id, replace(replace(t, chr(10), chr(10) || chr(10)), chr(1), chr(1) || chr(1)) AS t FROM c
), k AS (
  SELECT r, doc_id, list_transform(regexp_extract_all(t, '{_START_SQL}|{_INSIDE_SQL}'), lambda x: {_nameless_sql("trim(regexp_replace(x, '[\\n\\x01 ]+', ' ', 'g'))")}) AS known FROM s
), i AS (
  SELECT r, doc_id, list_transform(known, lambda y: {_IDS_SQL}[y]) AS ids FROM k
), q AS (
  SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_licence_sentences, coalesce(array_to_string(ids, ','), '') AS sequence,
         ',' || coalesce(array_to_string(ids, ','), '') || ',' AS seq FROM i
), l AS (
  SELECT doc_id, n_licence_sentences, sequence, list_filter([
    {_rule_sql()}], lambda x: x IS NOT NULL) AS hits FROM q
), u AS (
  SELECT *, coalesce(array_to_string(list_filter(hits, lambda x, n: list_position(hits, x) = n), ','), '') AS licences FROM l
)
SELECT doc_id, n_licence_sentences, sequence, licences, n_licence_sentences > 0 AND licences = '' AS unresolved FROM u"""
}
QUERIES = {"op4_license_scan": op4_license_scan}
