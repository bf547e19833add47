"""Language ID, quality rules, fingerprints and licence scans."""

import hashlib
import re
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brackwater.llm import fingerprints, language, licences, quality, queries

DIR = "/root/testdata/sf0.01"
ODD = [None, "", "  ", "12 !?", "Straße", "STRASSE", "a  b\tc", "A B C", "x y z " * 40, "w " * 5000, "one\none\n\n \none two\n|a|b <&>", "ﬁn", "FIN", "é", "é"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", "s") for i, t in enumerate(ODD)] + [(6, ODD[6], "en", "s"), (None, "no key", "de", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_language_held_out(spark, docs):
    got = queries.op1_language_id(spark, DIR).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    aside = got[got.held_out]
    assert len(got) == 1000 and 0.25 < got.held_out.mean() < 0.42
    assert (aside.lang_pred == aside.lang).mean() > 0.97
    assert (aside[~aside.rejected].lang_pred == aside[~aside.rejected].lang).mean() > 0.98
    assert aside.rejected.mean() < 0.02 and got.score.between(0, 1).all()


def test_language_odd(odd, docs):
    known = language.fit_dictionaries(docs)
    got = {r.doc_id: r for r in language.identify(odd, known).collect()}
    for i, t in enumerate(ODD):
        assert (got[i].lang_pred == "und") == (not re.search(r"[^\W\d_]", t or "")), t
    assert language.identify(odd.limit(0), known).count() == 0
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.fit_dictionaries(odd.limit(0)) == {}


def plain_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 3000 else set(range(len(words)))
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)]


def test_statistics_by_brute_force(odd, docs):
    for df in (odd, docs.limit(150)):
        want = sorted([(r.doc_id or -1, plain_counts(r.text)) for r in df.collect()])
        got = sorted([(r.doc_id or -1, [r[c] for c in quality.COUNTS]) for r in quality.measure(df).collect()])
        assert got == want


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3)).astype(np.float32)
    y = ((x[:, 0] + rng.normal(0, 0.1, 2000) < 0.5) & (x[:, 2] < 0.8)).astype(float)
    model = quality.grow(x, y, np.array([-1, 0, 0]), trees=20)
    grid = np.repeat(x[:50], 40, 0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    steps = np.diff(model.score(grid).reshape(50, 40), axis=1)
    assert (steps <= 1e-12).all() and steps.min() < -0.01
    assert ((model.score(x) > 0.5) == y).mean() > 0.8

    def walk(tree, row):
        node = model.roots[tree]
        while model.left[node] != node:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        return model.value[node]

    by_hand = [1 / (1 + np.exp(-(model.base + sum(walk(t, r) for t in range(20))))) for r in x[:20]]
    assert np.allclose(by_hand, model.score(x[:20]))


def test_quality_keeps_clean(spark, docs, odd):
    got = queries.op5_quality_rules(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").toPandas()
    fine = got[(got.quality == 1) & ~got.base_failed]
    assert fine.kept.mean() > 0.98 and got[got.quality == 0].kept.mean() < 0.1
    none = quality.fit_trees(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert none is None
    r = quality.judge(odd, None).toPandas()
    assert len(r) == len(ODD) + 2 and (r.kept == ~r.base_failed).all() and quality.judge(odd.limit(0), None).count() == 0


def test_edited_fingerprints_by_brute_force(spark, docs, odd):
    for df, parts in ((docs, None), (odd.dropDuplicates(["doc_id"]), None)):
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, -(r[0] or 0)))
        got = {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}
        assert len(got) == len(rows)
        for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
            n = len(t) // 3
            edited = t[: len(t) - n] + after[:n]
            form = fingerprints.canonical
            want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), float(form(t) == form(edited)), float(form(t) == form(after)))
            assert (got[k].n_chars, got[k].edited_sha256, got[k].near_edited, got[k].near_next) == want
    assert fingerprints.edited_fingerprints(odd.limit(0)).count() == 0


def test_partition_edges(spark, docs, monkeypatch):
    whole = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    monkeypatch.setattr(fingerprints, "_partitions", lambda *a: 7)
    assert whole == {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}


@pytest.mark.parametrize("most", [0, 500_000])
def test_canonical_and_groups(spark, docs, odd, most):
    c = fingerprints.canonical
    assert c("Straße") == c("STRASSE") and c("a  b\tc") == c("A B C") and c("ﬁn") == c("FIN") and c("é") == c("é") and c(None) == c("  ") == b""
    groups = {r.class_id: r.n_copies for r in fingerprints.copy_groups(odd.filter("doc_id is not null"), most_broadcast=most).collect()}
    assert groups[0] == 3 and groups[4] == 2 and groups[6] == 3 and groups[11] == 2 and groups[13] == 2
    assert fingerprints.copy_groups(odd.limit(0), most_broadcast=most).count() == 0
    forms = Counter(c(r.text) for r in docs.collect())
    rows = fingerprints.copy_groups(docs, most_broadcast=most).collect()
    assert sorted(r.n_copies for r in rows) == sorted(forms.values()) and all((r.canonical is None) == (r.n_copies == 1) for r in rows)


def test_equal_fingerprints_of_unlike_texts(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "AA", "b", "c", "cc"])], "doc_id long, text string")
    inner = fingerprints.fingerprint
    monkeypatch.setattr(fingerprints, "fingerprint", lambda *a, **k: inner(*a, **k).withColumn("fingerprint", F.lit("same")))
    assert sorted((r.class_id, r.n_copies) for r in fingerprints.copy_groups(df).collect()) == [(0, 2), (2, 1), (3, 1), (4, 1)]


def test_classes_of_all_documents(spark, docs):
    got = queries.op8_fingerprints(spark, DIR).toPandas()
    forms = {}
    for r in docs.collect():
        forms.setdefault(fingerprints.canonical(r.text), []).append(r.doc_id)
    want = {k: (min(ks), len(ks)) for ks in forms.values() for k in ks}
    assert {r.doc_id: (r.class_id, r.n_copies) for r in got.itertuples()} == want and (got.n_forms == 1).all()


def test_following_parts(spark):
    parts = [0, 1, 2, 5, 6, 13, 14, 40]
    df = spark.createDataFrame([(p,) for p in parts], "part int")
    assert {r.part: r.next for r in fingerprints.following(df, 4).collect()} == dict(zip(parts, parts[1:] + parts[:1], strict=True))
    assert {r.part: r.next for r in fingerprints.following(df.limit(1), 4).collect()} == {0: 0}


def test_several_rows_of_one_key(spark):
    texts = ["Aa bb", "x", "", "aa  BB", "zz " * 50, None]
    rows = [(k, t) for k in (None, 3, 3, 9) for t in texts]
    got = Counter((r.doc_id, r.n_chars, r.fingerprint) for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((k, len(t or ""), fingerprints.digest(fingerprints.canonical(t))) for k, t in rows)


TEXTS = {
    1: "Intro.\nLicensed under the Apache License, Version 2.0.\nMore",
    2: "Permission is hereby granted",
    3: "Released under the MIT License. All rights reserved.\nreleased UNDER the mit license!",
    4: None,
    5: "",
    6: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    7: "This project is licensed under the MIT License (see LICENSE).",
    8: "# SPDX-License-Identifier: AGPL-3.0-or-later\nimport os",
    9: "## License\n\nMIT\n\n## Install",
    10: "mit and isc are words.\n\nisc\n",
    11: "The texts are published under CC BY-NC-SA 4.0; see the licence.",
    12: "/* SPDX-License-Identifier: CC0-1.0 */",
    13: "This library is distributed under the terms of the GNU Lesser General Public License v2.1 or later.",
}


def scanned(df):
    return {r.doc_id: r for r in licences.scan(df).collect()}


def by_oracle(df):
    db = duckdb.connect()
    db.register("documents", df.select("doc_id", "text").toPandas())
    return {k: tuple(r) for k, *r in db.execute(f"SELECT doc_id, n_sentences, sentence_ids, rules, licences FROM ({licences.oracle()})").fetchall()}


def flat(r):
    return r.n_sentences, r.sentence_ids, ",".join(map(str, r.rules)), ",".join(r.licences)


def test_licence_rules(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in [*TEXTS.items(), (14, "word " * 200_000 + ".\nMIT License")]], "doc_id long, text string, naming string, rules string")
    got = scanned(df)
    want = {1: ["Apache-2.0"], 3: ["MIT", licences.RESERVED], 7: ["MIT"], 8: ["AGPL-3.0-or-later"], 9: ["MIT"], 11: ["CC-BY-NC-SA-4.0"], 12: ["CC0-1.0"], 13: ["LGPL-2.1-or-later"], 14: ["MIT"]}
    assert {k: r.licences for k, r in got.items()} == {k: want.get(k, []) for k in got}
    assert got[3].n_sentences == 3 and got[4].n_sentences == got[5].n_sentences == 0
    assert licences.scan(df.limit(0)).count() == 0
    assert {k: flat(r) for k, r in got.items()} == by_oracle(df)


def wrapped(text, width, before):
    return "\n".join(before + line for line in textwrap.wrap(text, width))


def test_every_notice_claims_its_sentences(spark):
    rows = [(i, name, wrap(text)) for i, (name, text, _) in enumerate(licences.NOTICES) for wrap in (lambda t: t, lambda t: wrapped(t, 72, ""), lambda t: wrapped(t.upper(), 60, " * "), lambda t: "Copyright (c) 2020 Some One\n\n" + t + "\n\nMore words follow here.")]
    df = spark.createDataFrame([(n, t) for n, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = scanned(df)
    for n, (_, name, _) in enumerate(rows):
        assert got[n].licences == [name] and len(got[n].rules) == 1, (rows[n], got[n])
    assert {k: flat(r) for k, r in got.items()} == by_oracle(df)


def test_every_rule_can_fire(spark):
    said = {}
    for codes in (licences._KNOWN_CODE, licences._BARE_CODE):
        for s, c in codes.items():
            said.setdefault(c, s.replace("under ", "licensed under the ", 1) if s.startswith("under ") else s)
    texts = [" . ".join(said[c] for c in re.findall("<[^>]+>", p)) + " . licence terms follow ." for _, p in licences.PATTERNS]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = scanned(df)
    for i, (name, _) in enumerate(licences.PATTERNS):
        assert got[i].rules == [i] and got[i].licences == [name], (texts[i], got[i])
    assert {k: flat(r) for k, r in got.items()} == by_oracle(df)


def test_licence_oracle(spark):
    got = queries.op10_licence_scan(spark, DIR).toPandas().sort_values("doc_id").reset_index(drop=True)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = db.execute(licences.oracle()).df().sort_values("doc_id").reset_index(drop=True)
    assert got[list(want.columns)].equals(want) and (got.licences != "").sum() > 10


def test_wrapped_sentences_against_the_oracle(spark):
    gaps = (" ", "\n", "\r\n", "  ", "\t", "\n# ", " * ", "\n// ")
    some = [s for s, i in licences.KNOWN.items() if i < 1000] + ["released under the mit license", "this work is licensed under the gnu general public license version 3", "available under cc by 4 0 license"]
    texts = [f"{a}{s.upper().replace(' ', gap)}{b}" for s in some for gap in gaps for a, b in (("", ""), ("Some words before. ", ".\nMore after."))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {k: flat(r) for k, r in scanned(df).items()}
    assert got == by_oracle(df)
    assert all(r[0] == 1 for r in got.values())


# Lines written by hand: what each names, and lines that name none.
NAMED = {
    "This project is released under GPL-3.0.": "GPL-3.0",
    "Distributed under the MIT.": "MIT",
    "Available under Apache 2.0.": "Apache-2.0",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0 MIT",
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause": "Apache-2.0 BSD-3-Clause MIT",
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "Classpath-exception-2.0 GPL-2.0",
    "/* SPDX-License-Identifier: GPL-2.0-or-later WITH Linux-syscall-note */": "GPL-2.0-or-later Linux-syscall-note",
    "Licensed under the MIT license and the Apache License 2.0.": "Apache-2.0 MIT",
    "Dual licensed under MIT or Apache-2.0": "Apache-2.0 MIT",
    "License: GPLv2+": "GPL-2.0-or-later",
    "License: LGPL-2.1+": "LGPL-2.1-or-later",
    "License: GPLv3": "GPL-3.0",
    "This library is licensed under either the MIT License or the Boost Software License 1.0.": "BSL-1.0",
    "The code is published under the ISC license, with thanks to all.": "ISC",
    "Released under the terms of the GNU Affero General Public License version 3 or later.": "AGPL-3.0-or-later",
    "The dataset is distributed under CC BY-SA 4.0 and the code under the MIT license.": "CC-BY-SA-4.0 MIT",
    "you must not claim that you wrote the original software": "",
    "The team worked under pressure and with care.": "",
    "mit or isc": "",
    "He lives under the apache moon or the zlib sun.": "",
    "License: proprietary or other": "",
    "They study at MIT and with Apache riders.": "",
    "Rust 1.2+ or C++ with care": "",
}


def test_hand_written_lines(spark):
    df = spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string")
    got = scanned(df)
    assert {t: " ".join(sorted(got[i].licences)) for i, t in enumerate(NAMED)} == NAMED
    assert {k: flat(r) for k, r in got.items()} == by_oracle(df)
    assert got[list(NAMED).index("you must not claim that you wrote the original software")].n_sentences == 1


def test_no_sentence_needs_another_word(spark):
    """Every known sentence is found in a text of nothing else."""
    known = list(licences.KNOWN)
    df = spark.createDataFrame(list(enumerate(known)), "doc_id long, text string")
    got = scanned(df)
    assert all(got[i].sentence_ids == licences._KNOWN_CODE[s] for i, s in enumerate(known))
    assert {k: flat(r) for k, r in got.items()} == by_oracle(df)


def test_a_labelled_key_on_many_rows(spark, docs, monkeypatch):
    """A key on a third of all rows is one row of what the trees learn from."""
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    seen = []
    inner = quality._fit
    monkeypatch.setattr(quality, "_fit", lambda x, y, passed, keep: seen.append(x.tolist()) or inner(x, y, passed, keep))
    hot = labels.orderBy("doc_id").first().doc_id
    copies = docs.limit(500).withColumn("doc_id", F.lit(hot))
    quality.fit_trees(docs.unionByName(copies), labels)
    assert len(seen[0]) == labels.select("doc_id").distinct().join(docs, "doc_id").count()
    quality.fit_trees(docs.repartition(5).unionByName(copies.repartition(3)), labels)
    assert seen[0] == seen[1]
