"""Licence scans (operator 10): sentence-rule recognition with DataFrame functions alone.

A text is cut into sentences, each is brought to a normal form and looked up among the known licence sentences; the
identifiers found, in order, are matched against the ordered rules. A rule fires where its identifiers follow one another
among the known sentences of the text. At each place the first rule that fits claims its identifiers, and matching goes
on behind them: a text of the three-clause licence is not also one of the two-clause licence.

Sentences end at signs before white space and at blank lines. One that is not known as a whole is looked up line by line,
so that headings and tags on lines of their own are found, and so are wrapped paragraphs. The normal form is lower case,
everything but a-z and 0-9 as one space, with what frames a licence's name ("this project is licensed under the ...",
"... see the file for details") reduced to `under` and the name, and "or later" and "+" as one word.

A short sentence that is not known is parted at its "or", "and" and "with": in a frame every name in it counts, without one it is an
expression of names ("MIT OR Apache-2.0") if every part is a name, and counts where a label stands before it, as a bare name does.
Every text is cut; no word decides whether a text is looked at.

Defined cases: a null or empty text has no sentences and no licence; a repeated sentence counts as often as it stands;
a text with several licences lists each once, in the order of the rules; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence notices, as their licences word them. A rule is a notice's sentences in order; `least` says how many
# of the first ones are enough.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. "
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at{} "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_GNU = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. "
    "This {0} is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. "
    "See the GNU {1} Public License for more details."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_0BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_CC0 = "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."
_BOOST = "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt."
NOTICES = (
    ("MIT", _MIT, 2),
    ("BSD-3-Clause", "All rights reserved. " + _BSD + _BSD_NAMES, 5),
    ("BSD-3-Clause", _BSD + _BSD_NAMES, 4),
    ("BSD-2-Clause", "All rights reserved. " + _BSD, 4),
    ("BSD-2-Clause", _BSD, 3),
    ("Apache-2.0", _APACHE.format(" http://www.apache.org/licenses/LICENSE-2.0."), 2),
    ("Apache-2.0", _APACHE.format(": the address."), 3),
    *((f"GPL-{v}.0-or-later", _GNU.format("program", "General", v), 2) for v in (2, 3)),
    ("AGPL-3.0-or-later", _GNU.format("program", "Affero General", 3), 2),
    *((f"LGPL-{v}-or-later", _GNU.format(what, "Lesser General", v.removesuffix(".0")), 2) for v in ("2.1", "3.0") for what in ("library", "program")),
    ("MPL-2.0", _MPL, 1),
    ("Zlib", _ZLIB, 3),
    ("ISC", _ISC, 1),
    ("0BSD", _0BSD, 1),
    ("Unlicense", _UNLICENSE, 1),
    ("CC0-1.0", _CC0, 1),
    ("BSL-1.0", _BOOST, 2),
)
# Names of licences in normal form. Those with the word licence in them are also titles on lines of their own.
NAMES = {
    "MIT": ("mit license", "mit licence", "mit", "mit license mit", "expat license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache version 2 0", "apache software license version 2 0", "apache license v2 0"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "bsd 3 clause", "new bsd license", "modified bsd license", "bsd 3 clause new or revised license"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "bsd 2 clause", "simplified bsd license"),
    "ISC": ("isc license", "isc"),
    "Zlib": ("zlib license", "zlib"),
    "Unlicense": ("unlicense",),
    "MPL-2.0": ("mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v2 0", "mpl 2 0", "mpl 2 0 license"),
    "CC0-1.0": ("cc0 1 0 universal", "cc0 1 0", "cc0", "creative commons zero v1 0 universal license", "creative commons cc0 1 0 universal license"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0", "bsl 1 0"),
    "EPL-2.0": ("eclipse public license 2 0", "eclipse public license version 2 0", "epl 2 0"),
}
# The families whose names are made by rule, and the parts of a Creative Commons licence.
GNU = {"GPL": ("gnu general public license", "gnu gpl", "gpl"), "LGPL": ("gnu lesser general public license", "gnu lgpl", "lgpl"), "AGPL": ("gnu affero general public license", "gnu agpl", "agpl")}
GNU_VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2 1", "3"), "AGPL": ("3",)}
CC = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
CC_KINDS = (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# What stands before a bare name, the exceptions that a licence can come with, and the line that reserves all rights.
LABELS = ("license", "licence", "spdx license identifier", "spdx licence identifier", "licensed under", "license name")
EXCEPTIONS = {
    "Classpath-exception-2.0": ("classpath exception 2 0", "classpath exception", "the classpath exception"),
    "GCC-exception-3.1": ("gcc exception 3 1", "gcc runtime library exception"),
    "LLVM-exception": ("llvm exception", "llvm exceptions"),
    "Linux-syscall-note": ("linux syscall note",),
    "Autoconf-exception-3.0": ("autoconf exception 3 0",),
    "OpenSSL-exception": ("openssl exception",),
}
_TITLED = "licen"  # a name with this in it is also a title on a line of its own
_SHORT = 160  # letters of the longest sentence that is parted at its conjunctions
_JOINED = " (or|and|with) (the |a |an )?"
_UNDER = "^(.* )?under (the |a |an )?"
RESERVED = "LicenseRef-All-Rights-Reserved"


def _made_names() -> dict[str, tuple[str, ...]]:
    """Names by rule: GNU licences with and without later versions, Creative Commons licences of all kinds."""
    out = {}
    for family, stems in GNU.items():
        for v in GNU_VERSIONS[family]:
            whole = v if " " in v else f"{v} 0"
            exact = [f"{s} {joined}{x}" for s in stems for joined in ("version ", "v", "") for x in dict.fromkeys((v, whole))]
            out[f"{family}-{whole.replace(' ', '.')}"] = (*exact, *(f"{family.lower()}{v}", f"{family.lower()}v{v}", f"{family.lower()} {whole} only"))
            out[f"{family}-{whole.replace(' ', '.')}-or-later"] = tuple(f"{e} orlater" for e in (*exact, f"{family.lower()}v{v}"))
    for kind in CC_KINDS:
        short, long = " ".join(kind), " ".join(CC[k] for k in kind)
        for v in CC_VERSIONS:
            places = (" international",) if v == "4 0" else (" unported", " generic")
            full = tuple(f"creative commons {long} {v}{p} license" for p in ("", *places))
            out[f"CC-{'-'.join(kind).upper()}-{v.replace(' ', '.')}"] = (f"cc {short} {v}", f"cc {short} {v} license", f"creative commons {long} {v}", *full)
    return out


# The frame of a name, and what may follow one; both engines' regular expressions read these alike.
_SUBJECT = "((this|the|our|its|all) )?(([a-z0-9]+ )?(project|work|works|software|program|programs|file|files|code|library|package|document|repository|content|text|texts|module|page|dataset) (is |are )?)?"
_FRAME = f"^{_SUBJECT}(dual )?(licensed|licenced|released|distributed|published|available|provided|offered) under (the )?((terms|conditions) of )?(the |a |an )?"
_AFTER = "( the license)?( see .*| for (details|more).*)?$"
_HOLDER = "^neither the name of .* nor the names of its contributors may be used"
_NAMED = "neither the name of the copyright holder nor the names of its contributors may be used"
# White space is spelled out, so that all regular expression engines agree on it.
_PLUS = "([0-9])[+]"
_LATER = " or (any )?later( versions?)?"
_END = "[.;:!?]+([ \\t\\r\\n]+|$)|\\n[ \\t\\r*#/-]*\\n"


def normal(sentence: str) -> str:
    """The normal form of a sentence, as the DataFrame expression makes it."""
    s = re.sub(_PLUS, r"\1 or later", sentence.lower())
    s = re.sub("[^a-z0-9]+", " ", s).strip(" ")
    s = re.sub(_LATER, " orlater", s)
    s = re.sub(_FRAME, "under ", s)
    s = re.sub(_HOLDER, _NAMED, s)
    return re.sub(_AFTER, "", s) if s.startswith("under ") else s


def sentences(text: str) -> list[str]:
    return [n for n in map(normal, re.sub(_END, "\x01", text).split("\x01")) if n]


_NAME, _TITLE, _LABEL = 1000, 2000, 3000


def _tables() -> tuple[dict[str, int], dict[str, int], list[tuple[str, tuple[int, ...]]]]:
    """Normal sentence -> identifier; bare name -> identifier; and the ordered rules. Identifiers of a notice's sentences are
    below 1000; a licence's name has one in a frame (from 1000), and another as a title (from 2000)."""
    known: dict[str, int] = dict.fromkeys(LABELS, _LABEL)
    bare: dict[str, int] = {}
    names = NAMES | _made_names() | EXCEPTIONS
    for i, own in enumerate(names.values()):
        for n in own:
            known.setdefault(f"under {n}", _NAME + i)
            bare.setdefault(n, _NAME + i)
            if _TITLED in n:
                known.setdefault(n, _TITLE + i)
                known.setdefault(f"the {n}", _TITLE + i)
    fresh = iter(range(_NAME))
    number = lambda s: known[s] if s in known else known.setdefault(s, next(fresh))
    rules: list[tuple[str, tuple[int, ...]]] = []
    for licence, text, least in NOTICES:
        ids = tuple(number(s) for s in sentences(text) if len(s.split()) > 2)
        rules += [(licence, ids[:n]) for n in range(len(ids), least - 1, -1)]
    rules.sort(key=lambda r: -len(r[1]))  # the longest notice that fits claims its sentences; equals keep their order
    for i, licence in enumerate(names):
        rules += [(licence, (_LABEL, _NAME + i)), (licence, (_LABEL, _TITLE + i)), (licence, (_TITLE + i,)), (licence, (_NAME + i,))]
    rules.append((RESERVED, (number("all rights reserved"),)))
    return known, bare, rules


KNOWN, BARE, RULES = _tables()
_KNOWN_CODE = {s: f"<{i}>" for s, i in KNOWN.items()}
#: A bare name alone is no licence: it counts where the identifier before it is a label, or (c) where it goes on a list that does.
_BARE_CODE = {n: f"<{i}b>" for n, i in BARE.items() if n not in KNOWN}
_LISTED = {n: f"<{i}c>" for n, i in BARE.items()}
_GOES_ON = f"(<{_LABEL}><[0-9]+b?>)<([0-9]+)c>"  # after a label and a name, a further name counts as if it had the label as well
_MOST_LISTED = 5


def _patterns() -> list[tuple[str, str]]:
    """Licence and the string of codes of each rule, in order; a label takes a bare name as well."""
    out = []
    for licence, ids in RULES:
        out.append((licence, "".join(f"<{i}>" for i in ids)))
        if len(ids) == 2 and ids[0] == _LABEL and ids[1] < _TITLE:
            out.append((licence, f"<{ids[0]}><{ids[1]}b>"))
    said = {*_KNOWN_CODE.values(), *_BARE_CODE.values()}
    first = {p: (licence, p) for licence, p in reversed(out) if said.issuperset(re.findall("<[^>]+>", p))}
    return list(first.values())[::-1]


PATTERNS = _patterns()
def _normal(s: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), _PLUS, "$1 or later"), "[^a-z0-9]+", " "))
    plain = F.regexp_replace(plain, _LATER, " orlater")
    framed = F.regexp_replace(F.regexp_replace(plain, _FRAME, "under "), _HOLDER, _NAMED)
    return F.when(framed.startswith("under "), F.regexp_replace(framed, _AFTER, "")).otherwise(framed)


def _table(codes: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_sentences (known ones, and names in lists), sentence_ids (their codes in order), rules (numbers of the rules that fired, ascending)
    and licences (distinct, in rule order) of each whole text."""
    known, bare, listed = _table(_KNOWN_CODE), _table(_BARE_CODE), _table(_LISTED)

    def list_code(s: Column) -> Column:
        """The codes of a list of names: those known, in a frame; all or none, without one."""
        framed = s.startswith("under ")
        names = F.split(F.regexp_replace(s, _JOINED, "\u0001"), "\u0001")
        inside = F.transform(names, lambda n: F.try_element_at(known, F.concat(F.lit("under "), F.regexp_replace(n, _UNDER, ""))))
        loose = F.transform(names, lambda n: F.try_element_at(listed, n))
        first = F.regexp_replace(F.array_join(loose, ""), "^<([0-9]+)c>", "<$1b>")
        code = F.when(framed, F.array_join(inside, "")).when(~F.exists(loose, lambda c: c.isNull()), first)
        return F.when((F.length(s) <= _SHORT) & s.rlike(_JOINED) & (code != ""), code)

    def code(pieces: Column) -> Column:
        look = lambda s: F.when(s != "", F.coalesce(F.try_element_at(known, s), F.try_element_at(bare, s), list_code(s)))
        found = F.transform(F.transform(pieces, _normal), look)
        return F.transform(F.arrays_zip(pieces.alias("p"), found.alias("c")), lambda x: x)

    whole = code(F.split(F.regexp_replace(F.col(text), _END, "\u0001"), "\u0001"))
    lines = lambda p: F.array_join(F.transform(code(F.split(p, "[\\r\\n]+")), lambda x: x["c"]), "")
    each = F.transform(whole, lambda x: F.coalesce(x["c"], F.when(x["p"].contains("\n"), lines(x["p"]))))
    ids = F.col("sentence_ids")
    for _ in range(_MOST_LISTED):
        ids = F.regexp_replace(ids, _GOES_ON, f"$1<{_LABEL}><$2b>")
    found = docs.select(key, text).select(key, F.array_join(each, "").alias("sentence_ids")).withColumn("named_ids", ids)
    number = F.create_map(*[F.lit(x) for i, (_, p) in enumerate(PATTERNS) for x in (p, i)])
    fired = F.regexp_extract_all("named_ids", F.lit("|".join(p for _, p in PATTERNS)), F.lit(0))
    names = F.array(*[F.lit(n) for n, _ in PATTERNS])
    ids = F.coalesce("sentence_ids", F.lit(""))
    found = found.select(key, ids.alias("sentence_ids"), F.array_sort(F.array_distinct(F.transform(fired, lambda p: F.try_element_at(number, p)))).alias("rules"))
    return found.select(
        key,
        (F.length("sentence_ids") - F.length(F.translate("sentence_ids", "<", ""))).cast("long").alias("n_sentences"),
        "sentence_ids",
        F.coalesce("rules", F.array().cast("array<int>")).alias("rules"),
        F.coalesce(F.array_distinct(F.transform("rules", lambda i: F.get(names, i))), F.array().cast("array<string>")).alias("licences"),
    )


def oracle(key: str = "doc_id") -> str:
    """The same scan in DuckDB SQL, by joins of sentences and of the parts of lists with the tables."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = lambda codes: ", ".join(f"({quoted(s)}, '{c}')" for s, c in codes.items())
    rules = ", ".join(f"({i}, {quoted(name)}, '{p}')" for i, (name, p) in enumerate(PATTERNS))

    def form(s: str) -> str:
        plain = f"trim(regexp_replace(regexp_replace(lower({s}), {quoted(_PLUS)}, '\\1 or later', 'g'), '[^a-z0-9]+', ' ', 'g'))"
        plain = f"regexp_replace({plain}, {quoted(_LATER)}, ' orlater', 'g')"
        framed = f"regexp_replace(regexp_replace({plain}, {quoted(_FRAME)}, 'under '), {quoted(_HOLDER)}, {quoted(_NAMED)})"
        return f"CASE WHEN starts_with({framed}, 'under ') THEN regexp_replace({framed}, {quoted(_AFTER)}, '') ELSE {framed} END"

    ids = "ids"
    for _ in range(_MOST_LISTED):
        ids = f"regexp_replace({ids}, {quoted(_GOES_ON)}, '\\1<{_LABEL}><\\2b>', 'g')"

    def coded(pieces: str) -> str:
        """Pieces with their code: as a whole, or put together from the parts of a list."""
        return f"""
  SELECT p.*, coalesce(known.code, bare.code, lists.code) AS code
  FROM {pieces} p LEFT JOIN known ON known.s = f LEFT JOIN bare ON bare.s = f LEFT JOIN lists ON lists.f = p.f"""

    return f"""
WITH known(s, code) AS (VALUES {table(_KNOWN_CODE)}), bare(s, code) AS (VALUES {table(_BARE_CODE)}), listed(s, code) AS (VALUES {table(_LISTED)}), rules(i, licence, pattern) AS (VALUES {rules}),
pieces AS (
  SELECT *, {form('s')} AS f FROM (
    SELECT {key}, unnest(p) AS s, generate_subscripts(p, 1) AS nth
    FROM (SELECT {key}, string_split(regexp_replace(text, {quoted(_END)}, chr(1), 'g'), chr(1)) AS p FROM documents))),
lines AS (
  SELECT *, {form('s')} AS f FROM (
    SELECT {key}, nth, unnest(l) AS s, generate_subscripts(l, 1) AS line
    FROM (SELECT {key}, nth, regexp_split_to_array(s, '[\r\n]+') AS l FROM pieces WHERE contains(s, chr(10))))),
parts AS (
  SELECT f, unnest(l) AS n, generate_subscripts(l, 1) AS nth
  FROM (SELECT f, string_split(regexp_replace(f, {quoted(_JOINED)}, chr(1), 'g'), chr(1)) AS l
    FROM (SELECT f FROM pieces UNION SELECT f FROM lines) WHERE length(f) <= {_SHORT} AND regexp_matches(f, {quoted(_JOINED)}))),
lists AS (
  SELECT f, CASE WHEN starts_with(f, 'under ') THEN string_agg(known.code, '' ORDER BY nth)
    WHEN count(listed.code) = count(*) THEN regexp_replace(string_agg(listed.code, '' ORDER BY nth), '^<([0-9]+)c>', '<\\1b>') END AS code
  FROM parts LEFT JOIN known ON known.s = 'under ' || regexp_replace(n, {quoted(_UNDER)}, '') LEFT JOIN listed ON listed.s = n GROUP BY f),
whole AS ({coded('pieces')}),
found AS (
  SELECT {key}, nth, 0 AS line, code FROM whole WHERE code IS NOT NULL
  UNION ALL SELECT {key}, nth, line, code FROM ({coded('lines')}) JOIN (SELECT {key}, nth FROM whole WHERE code IS NULL) USING ({key}, nth)),
ids AS (SELECT {key}, string_agg(code, '' ORDER BY nth, line) AS ids FROM found GROUP BY 1),
fired AS (
  SELECT DISTINCT {key}, i, licence
  FROM (SELECT {key}, unnest(regexp_extract_all({ids}, '{"|".join(p for _, p in PATTERNS)}')) AS m FROM ids WHERE ids IS NOT NULL) JOIN rules ON pattern = m),
firsts AS (SELECT {key}, licence, min(i) AS i FROM fired GROUP BY 1, 2),
named AS (SELECT {key}, string_agg(licence, ',' ORDER BY i) AS licences FROM firsts GROUP BY 1),
numbered AS (SELECT {key}, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS rules FROM fired GROUP BY 1)
SELECT d.{key}, CAST(length(coalesce(ids, '')) - length(replace(coalesce(ids, ''), '<', '')) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(rules, '') AS rules, coalesce(licences, '') AS licences
FROM documents d LEFT JOIN ids USING ({key}) LEFT JOIN named USING ({key}) LEFT JOIN numbered USING ({key})"""
