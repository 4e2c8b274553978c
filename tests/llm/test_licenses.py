"""License scans: base places against a direct search, rules against the same fold in Python."""

import re

from adlens.llm import licenses
from llm_fixtures import DOCS, frame, simple

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def direct_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def direct_base(words):
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k:k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return places, sorted(labels)


def fold(found):
    kept, end, last = [], -1, 0
    for s, e, p, label in sorted(found):
        if -e <= end or (s <= end and -p < last):
            continue
        if s <= end and -p > last:
            kept.pop()
        kept.append((s, -e, -p, label))
        end, last = -e, -p
    return kept


def place(match):
    return int(re.match(r"[^#]*#(\d+)", match)[1]), -int(re.search(r"#(\d+)$", match)[1])


def direct_spans(text, words):
    if not any(s in f" {' '.join(words)} " for s in licenses.STEMS):
        return []
    padded, line = f" {' '.join(words)} ", " ".join(f"{w}#{i}" for i, w in enumerate(words))
    found = []
    for label, keywords, own in licenses.rules():
        if not any(f" {k} " in padded for k in keywords):
            continue
        for priority, context, pattern, group in own:
            if context in padded:
                found += [(*place(m[group]), -priority, label) for m in re.finditer(pattern, line)]
    return fold(found)


def check(spark, df):
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for r in df.collect():
        ws = direct_words(r["text"])
        places, labels = direct_base(ws)
        want = (len(ws), len(places), min(places, default=None), max(places, default=None), labels, direct_spans(r["text"], ws))
        assert want in [(g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"],
                         [tuple(s) for s in g["spans"]]) for g in got[r["doc_id"]]], r["text"][:200]


TEXTS = [
    "Released under the MIT License.", "under the mit license under the MIT license", "CC BY-NC 4.0 cc-by-nc CC.BY.NC",
    "Licensed under the Apache License, Version 2.0.", "apache license version 2", "apache license version 20",
    "SPDX-License-Identifier: GPL-3.0-or-later", "This work is licensed under the GNU General Public License, version 3.",
    "GPLv2 or later", "distributed under the terms of the GNU Lesser General Public License v2.1",
    "CC BY-NC-SA 4.0 and CC BY 4.0", "Creative Commons Attribution Share Alike 3.0", "released into the public domain",
    "Mozilla Public License 2.0 (MPL 2.0)", "license: BSD 3-Clause", "the new BSD license, the simplified BSD licence",
    "mit dem Hund", "licensed to kill", "under the mïT license", "under the KMIT license", "UNDER_THE_MIT_LICENSE",
    "under the mit licenses", "xunder the mit license", "Licensed under Apache-2.0 and MIT license or ISC licence",
    "word " * 3000 + "under the mit license " * 200 + "GPL 2 " * 100,
]


def test_texts(spark):
    check(spark, simple(spark, TEXTS))


def test_odd_rows_and_empty(spark):
    check(spark, frame(spark))
    assert licenses.digest(licenses.scan(spark.createDataFrame([], DOCS))).count() == 0


def test_digest(spark):
    rows = {r["doc_id"]: r for r in licenses.digest(licenses.scan(simple(spark, TEXTS))).collect()}
    assert rows[0]["labels"] == "mit" and rows[0]["score"] == 0.95 and (rows[1]["first_word"], rows[1]["last_word"]) == (0, 4)
    assert rows[3]["labels"] == "apache-2" and rows[2]["base_labels"] == "cc-by-nc"
    assert rows[6]["labels"] == "gpl-3" and rows[6]["base_labels"] == "" and rows[6]["score"] == 1.0
    assert rows[7]["labels"] == "gpl-3" and rows[9]["labels"] == "lgpl-2.1"
    assert rows[10]["labels"] == "cc-by,cc-by-nc,cc-by-nc-sa"  # the base phrase stays beside the longer name
    assert rows[16]["labels"] == "" and rows[16]["score"] == 0.0


def test_rules_are_hundreds_and_ordered():
    assert sum(len(own) for _, _, own in licenses.rules()) > 200
    for _, _, own in licenses.rules():
        assert [p for p, *_ in own] == sorted((p for p, *_ in own), reverse=True)


def test_no_python_in_the_plan(spark):
    plan = licenses.digest(licenses.scan(frame(spark)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def ungated_spans(words):
    """The fold over every rule, none of them behind a keyword."""
    line = " ".join(f"{w}#{i}" for i, w in enumerate(words))
    return fold([(*place(m[group]), -priority, label) for label, _, own in licenses.rules()
                 for priority, _, pattern, group in own for m in re.finditer(pattern, line)])


UNGATED = [
    "BSD 3-Clause", "code is MPL 2.0 or CC0 1.0", "the GNU General Public, version 2", "GNU Lesser General Public v3", "Affero General Public",
    "Released under Apache 2.0", "distributed under the terms of the MIT", "available under ISC", "provided under a zlib", "covered under the X11",
    "FreeBSD and the Unlicense", "creative commons zero", "placed in the public domain", "a common library of the commercial domain",
    "under water, in python", "published under Python", "simplified bsd", "library general public",
]


def test_no_gate_hides_a_match(spark):
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in licenses.scan(simple(spark, TEXTS + UNGATED)).collect()}
    for i, t in enumerate(TEXTS + UNGATED):
        assert got[i] == ungated_spans(direct_words(t)), t[:200]
    labels = {t: {s[3] for s in got[len(TEXTS) + i]} for i, t in enumerate(UNGATED)}
    assert labels["BSD 3-Clause"] == {"bsd-3-clause"} and labels["code is MPL 2.0 or CC0 1.0"] == {"mpl-2", "cc0"}
    assert labels["Released under Apache 2.0"] == {"apache-2"} and not labels["under water, in python"]


def strings(expression):
    """Every string of an expression of words, alternatives and optional groups."""
    def of(parts):
        out = [""]
        for op, arg in parts:
            if str(op) == "LITERAL":
                some = [chr(arg)]
            elif str(op) == "MAX_REPEAT":
                assert arg[:2] == (0, 1)
                some = ["", *of(arg[2])]
            elif str(op) == "SUBPATTERN":
                some = of(arg[-1])
            elif str(op) == "BRANCH":
                some = [x for branch in arg[1] for x in of(branch)]
            else:
                some = [chr(c) for kind, c in arg if str(kind) == "LITERAL"]
                assert str(op) == "IN" and len(some) == len(arg)
            out = [a + b for a in out for b in some]
        return out
    return of(re._parser.parse(expression))


def test_every_match_holds_its_keywords():
    for label, (keywords, name, _) in licenses.FAMILIES.items():
        assert all(any(f" {k} " in f" {x} " for k in keywords) for x in strings(name)), label
    for label, (keywords, expressions) in licenses.SIGNATURES.items():
        assert all(any(f" {k} " in f" {x} " for k in keywords) for e in expressions for x in strings(e)), label
    for _, keyword, context in licenses.CONTEXTS:
        assert all(keyword in f" {x} " for x in strings(context.replace("{}", "name")))
    for phrase in licenses.PHRASES:
        stems = [any(s in f" {phrase} " for s in some) for some in (licenses.STEMS, [kw for _, kw, _ in licenses.CONTEXTS], licenses.BARE_STEMS)]
        assert stems[0] and (stems[1] or stems[2]), phrase


NOTICES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
    "Neither the name of X nor the names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-3-clause",
    "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl-2",
    "the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License": "lgpl-2.1",
    "the GNU Affero General Public License, version 3": "agpl-3",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "In no event will the authors be held liable for any damages arising from the use of this software.": "zlib",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "http://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa", "https://www.apache.org/licenses/LICENSE-2.0": "apache-2",
    "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2,mit", "SPDX-License-Identifier: GPL-2.0-only AND MIT AND BSD-3-Clause": "bsd-3-clause,gpl-2,mit",
    "Licensed under the MIT License, Apache License Version 2.0": "apache-2,mit",
    "our proprietary license terms apply. The license is python": "", "a commercial license for python": "",
    "This file is PROPRIETARY AND CONFIDENTIAL": "proprietary", "the license of a proprietary product is commercial": "",
}


def test_texts_and_notices(spark):
    rows = {r["doc_id"]: r["labels"] for r in licenses.digest(licenses.scan(simple(spark, list(NOTICES)))).collect()}
    assert {t: rows[i] for i, t in enumerate(NOTICES)} == NOTICES
    check(spark, simple(spark, list(NOTICES)))


def test_clean_prose_has_no_labels(spark):
    prose = ["The apache helicopter landed, and the mit of the old town stood under the x11 lamp.", "Python is a commercial success; the library of the domain is general.",
             "He was licensed to drive, the artistic director said, with permission of the public.", "Under the boost of the eclipse, zlib was compiled with openssl."]
    assert {r["labels"] for r in licenses.digest(licenses.scan(simple(spark, prose))).collect()} == {""}
