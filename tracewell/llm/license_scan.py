"""License scans by ordered signature rules, with DataFrame functions only.

A rule is a label, a keyword, a regular expression and a priority. Rules are written as phrases: the words that must stand in a row, whatever
separates them. Names are built from a table of licenses (family, full names, versions): full name, name with version, SPDX identifier, address, and
a license field. Of an SPDX identifier or a field the first license of an expression such as A OR B has one rule, the second and third theirs, of less important priorities, so that
the longer detection doesn't suppress the shorter. So have names that prose joins (licensed under the MIT or Apache 2.0 license). Short names (GPLv3) are rules for themselves. NOTICES are signatures of the licenses' own words: grants and notices that stand in
files which never name their license. A rule's expression runs on a text only if the text has the rule's keyword,
and no rule runs on a text that has none of the keywords. Detections are ordered by start, longest first; one is suppressed
if an earlier detection of the same or a more important priority contains it.

The base phrases always count, at every place, whatever the rules suppress.

Everything happens in the row of the document, so nothing is shuffled and nothing depends on other rows: nulls in doc_id, repeated rows and
columns of any other name make no difference. A text that is null is read as empty: no words, no labels, score 0. Detections that tie in
place go by priority, then by the order of the rules. The score is the surviving detections' highest weight by priority, or BASE_SCORE
where only a base phrase stands.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TOGETHER, held, in_parts, match_spans

#: Phrases and labels of the base.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
BASE_SCORE = 0.6
#: By priority: an SPDX identifier, a name with its version, an address, a name.
WEIGHTS = (1.0, 0.95, 0.9, 0.8)

#: label: (keyword, names, versions, SPDX stem, addresses). A version goes into labels and SPDX identifiers.
LICENSES = {
    "gpl": ("gnu", ["gnu general public license", "gnu gpl"], ["1.0", "2.0", "3.0"], "GPL", ["gnu.org/licenses/gpl"]),
    "lgpl": ("gnu", ["gnu lesser general public license", "gnu library general public license", "gnu lgpl"], ["2.0", "2.1", "3.0"], "LGPL", ["gnu.org/licenses/lgpl"]),
    "agpl": ("gnu", ["gnu affero general public license", "gnu agpl"], ["3.0"], "AGPL", ["gnu.org/licenses/agpl"]),
    "gfdl": ("gnu", ["gnu free documentation license"], ["1.1", "1.2", "1.3"], "GFDL", ["gnu.org/licenses/fdl"]),
    "apache": ("apache", ["apache license", "apache software license"], ["1.0", "1.1", "2.0"], "Apache", ["apache.org/licenses/license"]),
    "mit": ("mit", ["mit license", "expat license"], [], "MIT", ["opensource.org/licenses/mit"]),
    "bsd-2-clause": ("bsd", ["bsd 2 clause license", "simplified bsd license", "freebsd license"], [], "BSD-2-Clause", ["opensource.org/licenses/bsd 2"]),
    "bsd-3-clause": ("bsd", ["bsd 3 clause license", "new bsd license", "modified bsd license", "revised bsd license"], [], "BSD-3-Clause", ["opensource.org/licenses/bsd 3"]),
    "bsd": ("bsd", ["bsd license", "bsd style license"], [], "BSD", []),
    "mpl": ("mozilla", ["mozilla public license"], ["1.0", "1.1", "2.0"], "MPL", ["mozilla.org/mpl"]),
    "epl": ("eclipse", ["eclipse public license"], ["1.0", "2.0"], "EPL", ["eclipse.org/legal/epl"]),
    "cddl": ("distribution", ["common development and distribution license"], ["1.0", "1.1"], "CDDL", []),
    "cpl": ("common", ["common public license"], ["1.0"], "CPL", []),
    "ibm-pl": ("ibm", ["ibm public license"], ["1.0"], "IPL", []),
    "eupl": ("european", ["european union public licence", "european union public license"], ["1.0", "1.1", "1.2"], "EUPL", []),
    "artistic": ("artistic", ["artistic license"], ["1.0", "2.0"], "Artistic", []),
    "boost": ("boost", ["boost software license"], ["1.0"], "BSL", ["boost.org/license"]),
    "zlib": ("zlib", ["zlib license", "zlib libpng license"], [], "Zlib", []),
    "isc": ("isc", ["isc license"], [], "ISC", []),
    "unlicense": ("unlicense", ["the unlicense", "free and unencumbered software released into the public domain"], [], "Unlicense", ["unlicense.org"]),
    "wtfpl": ("public", ["do what the fuck you want to public license"], ["2.0"], "WTFPL", ["wtfpl.net"]),
    "psf": ("python", ["python software foundation license"], ["2.0"], "PSF", []),
    "python": ("python", ["python license"], ["2.0"], "Python", []),
    "php": ("php", ["php license"], ["3.0", "3.01"], "PHP", ["php.net/license"]),
    "ruby": ("ruby", ["ruby license"], [], "Ruby", []),
    "openssl": ("openssl", ["openssl license"], [], "OpenSSL", []),
    "ofl": ("font", ["sil open font license", "open font license"], ["1.0", "1.1"], "OFL", ["scripts.sil.org/ofl"]),
    "ms-pl": ("microsoft", ["microsoft public license"], [], "MS-PL", []),
    "ms-rl": ("microsoft", ["microsoft reciprocal license"], [], "MS-RL", []),
    "odbl": ("database", ["open database license"], ["1.0"], "ODbL", ["opendatacommons.org/licenses/odbl"]),
    "odc-by": ("commons", ["open data commons attribution license"], ["1.0"], "ODC-By", ["opendatacommons.org/licenses/by"]),
    "pddl": ("domain", ["public domain dedication and license"], ["1.0"], "PDDL", []),
    "cc0": ("cc0", ["cc0", "creative commons zero"], ["1.0"], "CC0", ["creativecommons.org/publicdomain/zero"]),
    "cc-by": ("cc", ["cc by", "creative commons attribution"], ["1.0", "2.0", "2.5", "3.0", "4.0"], "CC-BY", ["creativecommons.org/licenses/by"]),
    "cc-by-sa": ("cc", ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"], ["1.0", "2.0", "2.5", "3.0", "4.0"], "CC-BY-SA", ["creativecommons.org/licenses/by sa"]),
    "cc-by-nd": ("cc", ["cc by nd", "creative commons attribution noderivatives"], ["1.0", "2.0", "2.5", "3.0", "4.0"], "CC-BY-ND", ["creativecommons.org/licenses/by nd"]),
    "cc-by-nc": ("cc", ["cc by nc", "creative commons attribution noncommercial"], ["1.0", "2.0", "2.5", "3.0", "4.0"], "CC-BY-NC", ["creativecommons.org/licenses/by nc"]),
    "cc-by-nc-sa": ("cc", ["cc by nc sa", "creative commons attribution noncommercial sharealike"], ["1.0", "2.0", "2.5", "3.0", "4.0"], "CC-BY-NC-SA", ["creativecommons.org/licenses/by nc sa"]),
    "cc-by-nc-nd": ("cc", ["cc by nc nd", "creative commons attribution noncommercial noderivatives"], ["1.0", "2.0", "2.5", "3.0", "4.0"], "CC-BY-NC-ND", ["creativecommons.org/licenses/by nc nd"]),
    "academic-free": ("academic", ["academic free license"], ["1.1", "1.2", "2.0", "2.1", "3.0"], "AFL", []),
    "open-software": ("open", ["open software license"], ["1.0", "1.1", "2.0", "2.1", "3.0"], "OSL", []),
    "proprietary": ("rights", ["all rights reserved"], [], "", []),
}
#: (label, keyword, words): sentences of notices and texts that only one license or family has.
NOTICES = (
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("boost-1.0", "granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("gpl", "gnu", "it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", "gnu", "either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "gnu", "either version 3 of the license or at your option any later version"),
    ("lgpl", "gnu", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "gnu", "it under the terms of the gnu library general public license as published by the free software foundation"),
    ("agpl", "gnu", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("apache-2.0", "apache", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "applicable", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1.1"),
    ("epl", "eclipse", "the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "common", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
    ("python-2.0", "python", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php", "php", "this product includes php software freely available from"),
    ("cc-by", "creative", "this work is licensed under a creative commons attribution license"),
    ("proprietary", "confidential", "this software is confidential and proprietary information of"),
)
#: Families whose short names stand with a version: GPLv3, LGPL 2.1.
SHORT = ("gpl", "lgpl", "agpl")
#: Places of an SPDX expression that have rules.
OPERANDS = 3
#: How prose says under what a work is, and a name with what joins it to the next.
UNDER = f"(?<!{WORD})(?:licensed|released|distributed|published|available){NOT_WORD}+under{NOT_WORD}+(?:(?:either|both|of|the|a|terms){NOT_WORD}+){{0,5}}"
JOINED = f"[A-Za-z0-9.+-]{{1,30}}(?:{NOT_WORD}+(?:licen[cs]e|version|v?[0-9][0-9.]{{0,9}})){{0,3}}(?:,|\\x20(?:or|and|and/or))(?:{NOT_WORD}+(?:or|and|the)(?!{WORD})){{0,2}}"
#: No rule is tried on a text that has none of these, nor the letters cc and by as words in a row.
GATE = (
    "licen", "spdx", "gnu", "cc0", "wtfpl", "unencumbered", "creative", "mozilla", "eclipse", "scripts", "rights",
    "granted", "redistribution", "permission", "advertising", "misrepresented", "confidential", "gpl", "openssl", "php software", "do what the",
)


def _phrase(words: str) -> str:
    """An expression for words in a row, bounded by what isn't a word."""
    return f"(?<!{WORD})" + f"{NOT_WORD}+".join(w.replace(".", "\\.") for w in words.split()) + f"(?!{WORD})"


@lru_cache(maxsize=1)
def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, expression, priority) in order; priority 0 is the most important."""
    out = []
    for label, (keyword, names, versions, spdx, addresses) in LICENSES.items():
        any_word = f"{NOT_WORD}+"
        for v in ["", *versions]:
            short = v.removesuffix(".0")
            number = f"{v.replace('.', any_word)}|{short}" if v != short else v.replace(".", any_word)
            if spdx:
                tag = "-".join(x for x in (spdx, v) if x)
                out.append((f"{label}-{v}" if v else label, "spdx", f"(?i)spdx{any_word}license{any_word}identifier{any_word}{_phrase(tag.replace('-', ' '))}", 0))
                fields = {"spdx": f"spdx{any_word}license{any_word}identifier", "license": "license"}
                for place in range(OPERANDS):
                    # One operand after the other, each by an operator; a field needs its sign.
                    before = f"(?:[A-Za-z0-9.+-]+[\\x20)]*\\x20(?:OR|AND|WITH)[\\x20(]+){{{place}}}"
                    end = f"(?:-only|-or-later|\\+)?(?!-?{WORD})"
                    for keyword_of, field in fields.items():
                        if place or keyword_of == "license":
                            out.append((f"{label}-{v}" if v else label, spdx.split("-")[0].lower(), f"(?i){field}[\\x20\"']*[:=][\\x20(\"']*{before}{tag.replace('.', '[.]')}{end}", place))
            if spdx:
                # Names that prose joins: one after the other, in a sentence that says license.
                name = spdx.split("-")[0] if label in ("bsd", "cc-by") else spdx.replace("-", any_word)
                version = f"(?:{any_word}licen[cs]e)?{any_word}(?:version{any_word}|v)?(?:{number})" if v else ""
                for place in range(OPERANDS):
                    before = f"(?:{JOINED}{any_word}){{{place}}}" if place else ""
                    out.append((f"{label}-{v}" if v else label, spdx.split("-")[0].lower(), f"(?i){UNDER}{before}{name}{version}(?!{WORD})(?=[\\x00-\\x7F]{{0,60}}licen[cs]e)", 1 + place))
            if label in SHORT and v:
                out.append((f"{label}-{v}", label, f"(?i)(?<!{WORD}){label}{NOT_WORD}*(?:version{any_word}|v)?{NOT_WORD}*(?:{number})(?!{WORD})", 1))
            for name in names:
                if v:
                    start = _phrase(name).removesuffix(f"(?!{WORD})")
                    out.append((f"{label}-{v}", keyword, f"(?i){start}{any_word}(?:version{any_word}|v)?(?:{number})(?!{WORD})", 1))
                else:
                    out.append((label, keyword, f"(?i){_phrase(name)}", 3))
        out += [(label, keyword if keyword in address else address.split(".")[0].split("/")[-1].split()[0], "(?i)" + f"{NOT_WORD}+".join(w for w in address.replace("/", " ").replace(".", " ").split()) + f"(?!{WORD})", 2) for address in addresses]
    out += [(label, keyword, f"(?i){_phrase(words)}", 2) for label, keyword, words in NOTICES]
    # A keyword that isn't part of what the expression has to have would hide it.
    return [(a, _keyword(k, e), e, p) for a, k, e, p in out]


def _keyword(keyword: str, expression: str) -> str:
    """The keyword if the expression can't match without it, else the longest word that it has to have."""
    import re

    plain = re.sub(r"\(\?[^)]*\)|\[[^\]]*\]\+?|\(\?:.*?\)\??|\\\.", " ", expression).lower()
    words = re.findall(r"[a-z0-9]{2,}", plain)
    return keyword if keyword in words else max(words, key=len)


def _base_places(phrase: str) -> tuple[Column, Column, Column]:
    """Of one phrase: the number of places, and the first and last word of them; text is the column _t, its words are counted in _n."""
    size = len(phrase.split())
    parts = F.split("_t", "(?i)" + _phrase(phrase), -1)
    n = F.size(parts) - 1
    return n, F.when(n > 0, _count(parts[0])), F.when(n > 0, F.col("_n") - _count(F.element_at(parts, -1)) - size)


def _count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+"))


def _detections() -> Column:
    """Of the text _t, whose lower case is _low: an array of (start, end, priority, rule, label)."""
    known = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(a).alias("label"), F.lit(k).alias("keyword"), F.lit(e).alias("pattern"), F.lit(p).alias("priority")) for i, (a, k, e, p) in enumerate(rules())])
    # Most rules that a keyword lets through have no match: the text is cut up only for those that have one.
    gated = F.filter(known, lambda r: F.contains(F.col("_low"), r["keyword"]) & F.rlike(F.col("_t"), r["pattern"]))

    def found(r: Column) -> Column:
        return F.transform(match_spans(F.col("_t"), r["pattern"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")))

    return F.flatten(F.transform(gated, found))


def _surviving(detections: Column) -> Column:
    """Those that no earlier one of the same or a more important priority contains, in one pass over their order."""
    ordered = F.sort_array(F.transform(detections, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"))))
    kind = "array<struct<start:int,back:int,priority:int,rule:int,label:string>>"
    none, ends = F.array().cast(kind), F.array(*[F.lit(-1)] * len(WEIGHTS))

    def step(s: Column, d: Column) -> Column:
        reach = F.array_max(F.slice(s["ends"], F.lit(1), d["priority"] + 1))
        ends = F.transform(s["ends"], lambda e, i: F.when(i == d["priority"], F.greatest(e, -d["back"])).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(reach >= -d["back"], s["out"]).otherwise(F.concat(s["out"], F.array(d))).alias("out"))

    def lot(s: Column, some: Column) -> Column:
        """As many as match_spans takes together, so that no long array is copied for each."""
        return F.aggregate(some, F.struct(s["ends"].alias("ends"), none.alias("out")), step, lambda r: F.struct(r["ends"].alias("ends"), F.concat(s["lots"], F.array(r["out"])).alias("lots")))

    lots = F.array().cast(f"array<{kind}>")
    return held(ordered, lambda every: F.aggregate(in_parts(every, TOGETHER), F.struct(ends.alias("ends"), lots.alias("lots")), lot, lambda s: F.flatten(s["lots"])))


def scan(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of carry; n_words, n_base, first_word, last_word (long); base_labels, labels (string), score (double); and
    detections: array of (label, start, end, priority), the surviving ones, in code points of the text."""
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    rows, low = rows.withColumn("_low", F.lower("_t")), F.col("_low")
    gate = F.contains(low, F.lit("cc")) & low.rlike(f"cc{NOT_WORD}+by")
    for word in GATE:
        gate = F.contains(low, F.lit(word)) | gate
    rows = rows.withColumn("_n", _count(F.col("_t"))).withColumn("_gate", gate)
    places = {label: _base_places(phrase) for phrase, label in BASE.items()}
    gate = F.col("_gate")
    base = F.when(gate, F.struct(*[F.struct(n.alias("n"), a.alias("first"), b.alias("last")).alias(f"b{i}") for i, (n, a, b) in enumerate(places.values())]))
    rows = rows.withColumn("_b", base).withColumn("_d", F.when(gate, _surviving(_detections())))
    of = lambda k: [F.col(f"_b.b{i}.{k}") for i in range(len(BASE))]
    long = lambda c: c.cast("bigint")
    base_labels = F.filter(F.array(*[F.when(F.col(f"_b.b{i}.n") > 0, F.lit(x)) for i, x in enumerate(places)]), lambda x: x.isNotNull())
    every = F.array_sort(F.array_distinct(F.concat(base_labels, F.coalesce(F.transform("_d", lambda d: d["label"]), F.array().cast("array<string>")))))
    best = F.array_min(F.transform("_d", lambda d: d["priority"]))
    weight = F.coalesce(F.get(F.array(*map(F.lit, WEIGHTS)), best), F.when(F.size(base_labels) > 0, F.lit(BASE_SCORE)), F.lit(0.0))
    return rows.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        long(F.col("_n")).alias("n_words"),
        long(F.coalesce(sum(of("n")[1:], of("n")[0]), F.lit(0))).alias("n_base"),
        long(F.least(*of("first"))).alias("first_word"),
        long(F.greatest(*of("last"))).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        weight.alias("score"),
        F.transform("_d", lambda d: F.struct(d["label"].alias("label"), d["start"].alias("start"), (-d["back"]).alias("end"), d["priority"].alias("priority"))).alias("detections"),
    )
