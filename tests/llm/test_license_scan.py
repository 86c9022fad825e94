import random
import re

from tracewell.llm import license_scan

SCHEMA = "doc_id long, text string, labels string, _t int, r string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    found = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def plain_detections(text):
    """Every rule on every text; whatever an earlier one of the same or a more important priority contains goes."""
    found = []
    for i, (label, _, expression, priority) in enumerate(license_scan.rules()):
        found += [(m.start(), -m.end(), priority, i, label) for m in re.finditer(expression, text, re.A)]
    found.sort()
    return [(d[4], d[0], -d[1], d[2]) for k, d in enumerate(found) if not any(-e[1] >= -d[1] and e[2] <= d[2] for e in found[:k])]


def texts():
    r = random.Random(2)
    pieces = [
        "Licensed under CC BY-NC 4.0.", "the GNU General Public License, version 3.", "Apache License, Version 2.0", "Released under the MIT License.",
        "SPDX-License-Identifier: Apache-2.0", "spdx license identifier GPL-2.0", "see https://www.gnu.org/licenses/gpl.html", "GNU\n * General Public\tLicense v2",
        "cc\n\nby", "CC0 1.0", "éapache license", "apache licenseé", "apache license2", "Mit LICENSE mit license", "accord by", "gnu", "All rights reserved.",
        "mozilla.org/MPL", "BSD 3-Clause License", "Größe — ça", "word", "GNU Lesser General Public License v2.1", "the Unlicense", "creative commons attribution 4.0",
    ]
    out = [None, "", " ", "plain text of no license"]
    for _ in range(120):
        out.append(r.choice([" ", "\n", " .. ", ""]).join(r.choices(pieces, k=r.randrange(1, 7))))
    return [*out, "x " * 60_000 + "mit license", "cc by " * 300]


def test_hundreds_of_rules_pass_the_gate():
    rules = license_scan.rules()
    assert len(rules) > 200
    for _, keyword, expression, _ in rules:
        plain = expression.replace(license_scan.NOT_WORD + "+", " ").replace(f"(?<!{license_scan.WORD})", "").replace(f"(?!{license_scan.WORD})", "").lower()
        assert keyword in plain
        assert any(w in plain for w in license_scan.GATE) or "cc by" in plain


def test_against_plain_scan(spark):
    every = texts()
    docs = spark.createDataFrame([(i if i % 7 else None, t, str(i), 1, "r") for i, t in enumerate(every)], SCHEMA)
    got = license_scan.scan(docs.withColumnRenamed("labels", "i"), carry=("doc_id", "i")).collect()
    assert len(got) == len(every)
    for x in got:
        t = every[int(x.i)]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == plain_base(t)
        want = plain_detections(t or "")
        assert [tuple(d) for d in x.detections or []] == want
        assert x.labels == ",".join(sorted({d[0] for d in want} | set(filter(None, x.base_labels.split(",")))))
        assert 0 <= x.score <= 1 and (x.score > 0) == bool(x.labels)


def test_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "mit license", "a", 2, "b"), (1, "mit license", "a", 2, "b")], SCHEMA)
    assert [(x.doc_id, x.labels) for x in license_scan.scan(docs).collect()] == [(1, "mit")] * 2
    assert license_scan.scan(docs.where("false")).count() == 0


def test_notices_fields_and_expressions(spark):
    """Each with a text that has it and one that nearly has."""
    cases = [
        ('Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated documentation files (the "Software")', "mit"), ("Permission is hereby granted to leave early", ""),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided", "bsd"), ("Redistribution and use of heat in source and binary stars", ""),
        ("it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "gpl,gpl-3.0"),
        ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", "apache-2.0"), ("Unless required by applicable law", ""),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"), ("GPLv3", "gpl-3.0"), ("LGPL v2.1 or later", "lgpl-2.1"), ("the gplv3x file", ""),
        ("License: MIT", "mit"), ("license = \"BSD-3-Clause\"", "bsd-3-clause"), ("License: MITRE corporation", ""), ("the license of ruby gems", ""),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2.0,mit"), ("SPDX-License-Identifier: GPL-2.0-only WITH x AND MIT", "gpl-2.0,mit"), ("License: MIT OR Apache-2.0 OR ISC", "apache-2.0,isc,mit"), ("MIT OR nothing", ""),
    ]
    docs = spark.createDataFrame([(i, t, "", 0, "") for i, (t, _) in enumerate(cases)], SCHEMA)
    got = {x.doc_id: x.labels for x in license_scan.scan(docs).collect()}
    bad = [(t, want, got[i]) for i, (t, want) in enumerate(cases) if got[i] != want]
    assert not bad, bad


def test_twenty_thousand_matches(spark):
    import time

    docs = spark.createDataFrame([(1, "mit license, apache license; " * 10_000, "", 0, "")], SCHEMA)
    license_scan.scan(docs.limit(0)).collect()
    start = time.time()
    x = license_scan.scan(docs).first()
    assert x.n_base == 20_000 and len(x.detections) == 20_000 and time.time() - start < 60


def test_names_joined_in_prose(spark):
    told = {
        "Licensed under the MIT or Apache 2.0 license": "apache-2.0,mit",
        "released under the terms of the BSD, MIT and Apache License version 2.0 licenses": "apache-2.0,bsd,mit",
        "dual licensed under either of the ISC and MIT licenses": "isc,mit",
        "Distributed under the Zlib or\nISC license": "isc,zlib",
        "released under the bridge of MIT": "",
        "distributed under MIT rules, as the school says": "",
        "the MIT and the Apache tribe were available": "",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "doc_id long, text string")
    got = {x.doc_id: x.labels for x in license_scan.scan(docs).collect()}
    assert [set(got[i].split(",")) >= set(w.split(",")) if w else got[i] == "" for i, w in enumerate(told.values())] == [True] * len(told), got
