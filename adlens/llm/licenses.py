"""License scans with ordered signature rules, in DataFrame functions only.

Texts are read as words (runs of ASCII letters, digits and non-ASCII characters). A rule is
a regular expression over words with a keyword, a label and a priority: the sentences by
which license texts and notices are known (``SIGNATURES``), and the names of license families,
each in the contexts below (a few hundred in all). A family is tried only if one of its
keywords occurs, and a rule only if its context's keyword does; every match of a rule holds
both, so no gate hides one. A text in which no rule is tried, that is without any of ``STEMS``
or with neither a context's keyword nor one of ``BARE_STEMS``, is passed over but for the base.

To give matches their places, the words of a gated text are numbered (``mit#17``), so a
match carries the number of its first and last word. Detections are sorted by place, longer
and higher-priority ones first, and folded: one inside a kept one is suppressed; of one that
overlaps the kept one before it, that with the lower priority goes (both stay if equal).

``PHRASES`` are plain phrases whose consecutive words always count (the base); their labels
stay whatever the rules find.

Defined results: a null text is empty; empty texts have no words, no places, empty labels
and score 0; null ids and repeated rows are scanned like others; an empty table gives an
empty result; other columns are not read. All work is inside a row, so there is no shuffle
and no hot key; the fold is linear in a text's detections but for the copying of kept ones.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

# What separates words, the base phrases and their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
BASE_SCORE = 0.95

# label: keywords (every name holds one of them as a word), name as an expression over words, whether the
# bare name is a signature of its own.
FAMILIES = {
    "mit": (["mit", "expat"], "(mit|expat)", False),
    "mit-0": (["mit"], "mit (0|no attribution)", False),
    "x11": (["x11"], "x11", False),
    "isc": (["isc"], "isc", False),
    "apache-2": (["apache"], "apache( software)?( foundation)?( license| licence)?( version| v)? (2 0|2|v2 0|v2)", False),
    "apache-1.1": (["apache"], "apache( software)?( license| licence)?( version)? 1 1", False),
    "apache": (["apache"], "apache( software)?", False),
    "bsd-2-clause": (["bsd", "freebsd"], "(bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", True),
    "bsd-3-clause": (["bsd"], "(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", True),
    "bsd-4-clause": (["bsd"], "(bsd 4 clause|4 clause bsd|original bsd)", True),
    "bsd": (["bsd"], "bsd", False),
    "gpl-1": (["gnu", "gpl"], "(gnu general public( license)?|gnu gpl|gpl)( version| v)? 1( 0)?( only| or later)?", False),
    "gpl-2": (["gnu", "gpl", "gplv2"], "((gnu general public( license| licence)?|gnu gpl|gpl)( version| v)? (2 0|2|v2)|gplv2)( only| or later)?", True),
    "gpl-3": (["gnu", "gpl", "gplv3"], "((gnu general public( license| licence)?|gnu gpl|gpl)( version| v)? (3 0|3|v3)|gplv3)( only| or later)?", True),
    "gpl": (["gnu", "gpl"], "(gnu general public( license| licence)?|gnu gpl|gpl)", True),
    "lgpl-2.1": (["lesser", "lgpl", "lgplv2"], "((gnu )?lesser general public( license)?|(gnu )?lgpl)( version| v)? (2 1|v2 1)( only| or later)?", True),
    "lgpl-3": (["lesser", "lgpl", "lgplv3"], "(((gnu )?lesser general public( license)?|(gnu )?lgpl)( version| v)? (3 0|3|v3)|lgplv3)( only| or later)?", True),
    "lgpl": (["lesser", "library", "lgpl"], "((gnu )?(lesser|library) general public( license)?|(gnu )?lgpl)", True),
    "agpl-3": (["affero", "agpl", "agplv3"], "(((gnu )?affero general public( license)?|(gnu )?agpl)( version| v)? (3 0|3|v3)|agplv3)( only| or later)?", True),
    "agpl": (["affero", "agpl"], "((gnu )?affero general public( license)?|(gnu )?agpl)", True),
    "fdl": (["gnu", "gfdl"], "(gnu free documentation|gfdl)", False),
    "mpl-2": (["mozilla", "mpl"], "(mozilla public( license)?|mpl)( version| v)? (2 0|2|v2)", True),
    "mpl-1.1": (["mozilla", "mpl"], "(mozilla public( license)?|mpl)( version| v)? 1 1", True),
    "mpl": (["mozilla"], "mozilla public", False),
    "epl-2": (["eclipse", "epl"], "(eclipse public( license)?|epl)( version| v)? (2 0|2)", False),
    "epl-1": (["eclipse", "epl"], "(eclipse public( license)?|epl)( version| v)? (1 0|1)", False),
    "cddl": (["cddl", "common"], "(common development and distribution|cddl)( version| v)?( 1 0| 1 1)?", False),
    "cc0": (["cc0", "creative"], "(cc0( 1 0)?|creative commons (zero|cc0))", True),
    "cc-by": (["cc", "creative"], "(cc by|creative commons attribution)( 1 0| 2 0| 2 5| 3 0| 4 0)?", True),
    "cc-by-sa": (["cc", "creative"], "(cc by sa|creative commons attribution (share alike|sharealike))( 2 0| 2 5| 3 0| 4 0)?", True),
    "cc-by-nd": (["cc", "creative"], "(cc by nd|creative commons attribution (no derivatives|noderivatives))( 2 0| 3 0| 4 0)?", True),
    "cc-by-nc": (["cc", "creative"], "(cc by nc|creative commons attribution (non commercial|noncommercial))( 2 0| 2 5| 3 0| 4 0)?", True),
    "cc-by-nc-sa": (["cc", "creative"], "(cc by nc sa|creative commons attribution (non commercial|noncommercial) (share alike|sharealike))( 2 0| 3 0| 4 0)?", True),
    "cc-by-nc-nd": (["cc", "creative"], "(cc by nc nd|creative commons attribution (non commercial|noncommercial) (no derivatives|noderivatives))( 2 0| 3 0| 4 0)?", True),
    "unlicense": (["unlicense"], "(the )?unlicense", True),
    "public-domain": (["domain"], "(dedicated to|released into|placed in|in) the public domain", True),
    "boost": (["boost", "bsl"], "(boost software|bsl)( version| v)?( 1 0)?", False),
    "zlib": (["zlib"], "zlib( libpng)?", False),
    "wtfpl": (["wtfpl"], "wtfpl", False),
    "artistic-2": (["artistic"], "artistic( license)?( version| v)? (2 0|2)", False),
    "artistic": (["artistic"], "artistic", False),
    "python": (["python", "psf"], "(python software foundation|psf|python 2 0)", False),
    "postgresql": (["postgresql"], "postgresql", False),
    "openssl": (["openssl"], "openssl", False),
    "ofl": (["sil", "ofl"], "(sil open font|ofl)( version)?( 1 1)?", False),
    "eupl": (["eupl", "european"], "(european union public|eupl)( version| v)?( 1 1| 1 2)?", False),
    "ms-pl": (["microsoft", "ms"], "(microsoft public|ms pl)", False),
    "odbl": (["odbl", "database"], "(open database|odbl)", False),
    "cecill": (["cecill"], "cecill( b| c)?( version)?( 2 0| 2 1)?", False),
}

# label: keywords (every expression holds one of them as a word), expressions over words by which texts and notices
# of the license are known. Words that are common elsewhere (proprietary, commercial, python) count in these alone.
_PUBLISHED = "(license|licence)( as published by the free software foundation| published by the free software foundation)?"
_OPTION = "( of the (license|licence))?( or at your option any later version| or any later version| or later| only)?"
SIGNATURES = {
    "mit": (["hereby", "portions"], [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"]),
    "isc": (["hereby"], [
        "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted"]),
    "postgresql": (["hereby"], [
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"]),
    "boost": (["hereby", "boost"], [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "boost software license version 1 0"]),
    "bsd": (["redistribution"], [
        "redistribution and use in source and binary forms with or without modification are permitted"]),
    "bsd-3-clause": (["endorse"], [
        "may not be used to endorse or promote products derived from this software without specific prior written permission"]),
    "bsd-4-clause": (["advertising"], [
        "all advertising materials mentioning features or use of this software must display the following acknowledgement"]),
    "apache-2": (["apache"], [
        "apache( software)?( foundation)? (license|licence)( version| v)? (2 0|2|v2 0|v2)",
        "apache org licenses license 2 0"]),
    "gpl-1": (["gnu"], ["gnu general public " + _PUBLISHED + "( either)? version 1" + _OPTION]),
    "gpl-2": (["gnu"], ["gnu general public " + _PUBLISHED + "( either)? version 2" + _OPTION]),
    "gpl-3": (["gnu"], ["gnu general public " + _PUBLISHED + "( either)? version 3" + _OPTION]),
    "lgpl-2": (["gnu"], ["gnu library general public " + _PUBLISHED + "( either)? version 2" + _OPTION]),
    "lgpl-2.1": (["gnu"], ["gnu lesser general public " + _PUBLISHED + "( either)? version 2 1" + _OPTION]),
    "lgpl-3": (["gnu"], ["gnu lesser general public " + _PUBLISHED + "( either)? version 3" + _OPTION]),
    "agpl-3": (["affero"], ["gnu affero general public " + _PUBLISHED + "( either)? version 3" + _OPTION]),
    "mpl-2": (["mozilla"], [
        "this source code form is subject to the terms of the mozilla public license( version| v)? (2 0|v2 0)"]),
    "mpl-1.1": (["mozilla"], ["the contents of this file are subject to the mozilla public license version 1 1"]),
    "epl-2": (["eclipse"], ["made available under the terms of the eclipse public license( version| v)? (2 0|v2 0)"]),
    "epl-1": (["eclipse"], ["made available under the terms of the eclipse public license( version| v)? (1 0|v1 0)"]),
    "zlib": (["liable"], [
        "in no event will the authors be held liable for any damages arising from the use of this software"]),
    "unlicense": (["unencumbered"], ["this is free and unencumbered software released into the public domain"]),
    "wtfpl": (["fuck"], ["do what the fuck you want to( public license)?"]),
    "ofl": (["sil"], ["this font software is licensed under the sil open font license( version 1 1)?"]),
    "cc0": (["creativecommons", "dedicated"], [
        "creativecommons org publicdomain zero 1 0",
        "the person who associated a work with this deed has dedicated the work to the public domain"]),
    "cc-by": (["creativecommons"], ["creativecommons org licenses by( 1 0| 2 0| 2 5| 3 0| 4 0)"]),
    "cc-by-sa": (["creativecommons", "creative"], [
        "creativecommons org licenses by sa", "creative commons attribution sharealike( 3 0| 4 0)( international| unported)?( public)? license"]),
    "cc-by-nd": (["creativecommons"], ["creativecommons org licenses by nd"]),
    "cc-by-nc": (["creativecommons"], ["creativecommons org licenses by nc( 1 0| 2 0| 2 5| 3 0| 4 0)"]),
    "cc-by-nc-sa": (["creativecommons"], ["creativecommons org licenses by nc sa"]),
    "cc-by-nc-nd": (["creativecommons"], ["creativecommons org licenses by nc nd"]),
    "proprietary": (["proprietary", "unauthorized", "unauthorised"], [
        "proprietary and confidential", "(unauthorized|unauthorised) copying of this (file|software)( via any medium)? is strictly prohibited"]),
    "commercial": (["commercial"], ["a commercial (license|licence) (is|must be) (required|purchased|obtained)"]),
}
SIGNATURE_PRIORITY, CHAIN_PRIORITY = 95, 99

# priority, keyword (every match holds it), expression; {} stands for the family's name.
CONTEXTS = (
    (100, "spdx", "spdx license identifier {}"),
    (90, " under ", "(licensed|released|distributed|available|published|provided|covered) under( the)?( terms of)?( the| a| an)? {}( license| licence)?"),
    (80, "licen", "(under|to|by|with|of|per) the( terms of the)? {} (license|licence)"),
    (70, "licen", "(license|licence)( is| type| name)? {}"),
    (60, "licen", "{} (license|licence)( agreement| terms| text)?"),
)
BARE_PRIORITY = 50

# What the keywords let through, as words; those of names and signatures that need no context.
STEMS = tuple(dict.fromkeys(f" {k} " for keywords, *_ in [*FAMILIES.values(), *SIGNATURES.values()] for k in keywords))
BARE_STEMS = tuple(dict.fromkeys(f" {k} " for keywords in [*(k for k, _, bare in FAMILIES.values() if bare), *(k for k, _ in SIGNATURES.values())]
                                 for k in keywords))


def _words(expression: str) -> str:
    return re.sub(r"[a-z0-9]+", r"\g<0>#[0-9]+", expression)


def numbered(expression: str) -> str:
    """An expression over words as one over numbered words."""
    return "(?<![^ ])" + _words(expression) + "(?= |$)"


def chained(name: str) -> str:
    """A further name of an SPDX expression (``MIT OR Apache-2.0``), as group 1."""
    return ("(?<![^ ])" + _words("spdx license identifier") + "(?: [^ ]+){1,8} " + _words("(?:or|and)")
            + " (" + _words(name) + ")(?= |$)")


def rules() -> list[tuple[str, list[str], list[tuple[int, str, str, int]]]]:
    """(label, keywords, [(priority, context keyword, expression over numbered words, group)]) in order."""
    out = [(label, keywords, [(SIGNATURE_PRIORITY, "", numbered(x), 0) for x in expressions])
           for label, (keywords, expressions) in SIGNATURES.items()]
    for label, (keywords, name, bare) in FAMILIES.items():
        own = [(p, kw, numbered(c.format(name)), 0) for p, kw, c in CONTEXTS]
        own.insert(1, (CHAIN_PRIORITY, "spdx", chained(name), 1))
        if bare:
            own.append((BARE_PRIORITY, "", numbered(name), 0))
        out.append((label, keywords, own))
    return out


def _rule_table() -> Column:
    """The rules as one constant array."""
    return F.array(*(F.struct(
        F.lit(label).alias("label"), F.array(*(F.lit(f" {k} ") for k in keywords)).alias("keywords"),
        F.array(*(F.struct(F.lit(p).alias("priority"), F.lit(kw).alias("context"), F.lit(x).alias("pattern"), F.lit(g).alias("group"))
                  for p, kw, x, g in own)).alias("rules")) for label, keywords, own in rules()))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" ")))


def _detections(padded: Column) -> Column:
    """(start, -end, -priority, label) of every match of every rule that the keywords let through."""
    def of_text(ws: Column) -> Column:
        words = F.split(F.trim(ws), " ")
        line = F.array_join(F.transform(words, lambda w, i: F.concat(w, F.lit("#"), i.cast("string"))), " ")

        def of_line(text: Column) -> Column:
            def of_rule(label):
                def found(r):
                    number = lambda m, at: F.regexp_extract(m, at, 1).cast("int")
                    return F.transform(
                        F.regexp_extract_all(text, r["pattern"], r["group"]),
                        lambda m: F.struct(number(m, r"^[^#]*#([0-9]+)").alias("start"),
                                           (-number(m, r"#([0-9]+)$")).alias("minus_end"),
                                           (-r["priority"]).alias("minus_priority"), label.alias("label")))
                return found

            families = F.filter(_rule_table(), lambda f: F.exists(f["keywords"], lambda k: F.contains(ws, k)))
            return F.flatten(F.transform(families, lambda f: F.flatten(F.transform(
                F.filter(f["rules"], lambda r: F.contains(ws, r["context"])), of_rule(f["label"])))))

        return _let(line, of_line)

    return _let(padded, of_text)


_SPANS = "array<struct<start:int,minus_end:int,minus_priority:int,label:string>>"


def _suppressed(found: Column) -> Column:
    """The detections that stay, in order."""
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("priority"), F.array().cast(_SPANS).alias("kept"))

    def step(acc, d):
        end, priority = -d["minus_end"], -d["minus_priority"]
        inside, overlaps = end <= acc["end"], d["start"] <= acc["end"]
        before = F.when(overlaps & (priority > acc["priority"]), F.slice(acc["kept"], 1, F.size(acc["kept"]) - 1)).otherwise(acc["kept"])
        return F.when(inside | (overlaps & (priority < acc["priority"])), acc).otherwise(
            F.struct(end.alias("end"), priority.alias("priority"), F.concat(before, F.array(d)).alias("kept")))

    return F.aggregate(F.array_sort(found), start, step, lambda acc: acc["kept"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places and first/last word of the base phrases, base_labels and spans (start, end, priority, label)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.concat(F.lit(" "), F.trim(F.regexp_replace(text, SEPARATORS, " ")), F.lit(" ")).alias("words"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.lower("words")  # lower case beyond ASCII too, so only for the gate; the scan maps A-Z alone
    some_of = lambda found: reduce(or_, (low.contains(s) for s in found))
    gate = some_of(STEMS) & (some_of(dict.fromkeys(kw for _, kw, _ in CONTEXTS)) | some_of(BARE_STEMS))
    rows = words.select("doc_id", F.when(F.length("words") <= 2, 0).otherwise(_spaces(F.col("words")) - 1).cast("long").alias("n_words"),
                        F.when(gate, F.translate("words", upper, lower)).alias("words"))
    parts = rows.select("doc_id", "n_words", "words", *(
        F.split("words", f"(?<= ){p}(?= )").alias(f"p{i}") for i, p in enumerate(PHRASES)))
    hits, firsts, lasts, labels = [], [], [], []
    for i, (p, label) in enumerate(PHRASES.items()):
        cut, n = F.col(f"p{i}"), p.count(" ") + 1
        many = F.coalesce(F.size(cut) - 1, F.lit(0))
        some = F.col("words").isNotNull() & (F.size(cut) > 1)
        hits.append(F.when(some, many).otherwise(0))
        firsts.append(F.when(some, _spaces(F.element_at(cut, 1)) - 1))
        lasts.append(F.when(some, F.col("n_words") - (_spaces(F.element_at(cut, -1)) - 1) - n))
        labels.append(F.when(some, F.lit(label)))
    found = F.when(F.col("words").isNotNull(), _suppressed(_detections(F.col("words")))).otherwise(F.array().cast(_SPANS))
    spans = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["minus_end"]).alias("end"),
                                                  (-d["minus_priority"]).alias("priority"), d["label"].alias("label")))
    return parts.select(
        "doc_id", "n_words", sum(hits).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base_labels"), spans.alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """The labels of :func:`scan` as joined strings and the score: the strongest signature's priority, 0 to 1."""
    all_labels = F.array_sort(F.array_union("base_labels", F.transform("spans", lambda s: s["label"])))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["priority"])) / 100.0, F.lit(0.0))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                          F.array_join("base_labels", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
                          F.greatest(best, F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0.0)).cast("double").alias("score"))
