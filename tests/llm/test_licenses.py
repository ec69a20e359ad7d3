"""License scans against brute force with Python's regular expressions."""

import re

from rootstone.llm import licenses
from rootstone.llm.license_rules import GATES, PASSAGES, PRIORITIES, rules, stem

SCHEMA = "doc_id long, text string, low string, places string, detections string, id string"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
    "gnu - general\npublic (LICENSE) gnu general public licenses", "GNU Lesser General Public License v2.1 and GNU General Public License v2", "SPDX-License-Identifier: GPL-3.0-or-later\nSPDX-License-Identifier: MIT",
    "see https://www.apache.org/licenses/LICENSE-2.0 or https://creativecommons.org/licenses/by-sa/3.0/", "Creative Commons Attribution-ShareAlike 4.0 and cc-by", "CC  BY cc.by ccby Cc\tBy", "All rights reserved. mit lizenz",
    "Mozilla Public License 2.0, Eclipse Public License - v 1.0", "permission is hereby granted, free of charge, to any person obtaining a copy", "the unlicense; public domain; released into the public domain; CC0-1.0",
    "Neither the name of the X nor the names of its contributors. Redistribution and use in source and binary forms", "BSD 3-Clause License; the 3-clause BSD license; New BSD License; BSD license", None, "", " . ", "ünï 漢字 mit license ₤license",
    "mit license " * 300, "word " * 20_000 + "apache license", "Apache License 2.0.1 apache license version 1.1", "Licence GPL 2 licensed under gpl-2.0 licensed as mpl 2.0",
]


def brute(text):
    low = (text or "").translate(UP)
    words, places = WORDS.findall(low), []
    for phrase, label in licenses.PHRASES.items():
        k = phrase.split()
        places += [(label, i) for i in range(len(words)) if words[i : i + len(k)] == k]
    all_ = [(m.start(), m.end(), r.label, r.priority, n) for n, r in enumerate(rules()) if r.keyword in low for m in re.finditer(r.pattern, low, re.ASCII)]
    inside = lambda d, e: e[0] <= d[0] and e[1] >= d[1] and (e[3] > d[3] or e[3] == d[3] and (e[:2] != d[:2] or e[4] < d[4]))
    kept = [d for d in all_ if not any(inside(d, e) for e in all_)] if len(all_) < 2000 else None
    return len(words), sorted(places), kept


def test_against_brute_force(frame):
    df = frame([(i, t, "l", "p", "d", "x") for i, t in enumerate(TEXTS)], SCHEMA)
    found = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert len(found) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        n, places, kept = brute(text)
        r = found[i]
        assert r.n_words == n and sorted(tuple(p) for p in r.places) == places
        assert sorted(tuple(d) for d in r.detections) == sorted(kept), text
        assert r.labels == sorted({p[0] for p in places} | {d[2] for d in kept})
        assert 0 <= r.score <= 1
    assert found[0].labels == ["apache", "apache-2.0", "some-license"] and found[3].labels == ["cc-by", "cc-by-nc-4.0", "some-license"]
    assert found[16].score == 0 and found[16].n_words == 0 and found[0].score > found[2].score


def test_rules():
    all_ = rules()
    assert len(all_) > 600 and len(PASSAGES) > 150 and len({(r.label, r.pattern) for r in all_}) == len(all_)
    for r in all_:
        re.compile(r.pattern)
        assert stem(r.keyword) in r.keyword and r.priority in PRIORITIES, r
    assert {"gpl-3.0", "apache-2.0", "mit", "cc-by-nc-4.0", "bsd-3-clause"} <= {r.label for r in all_}


def test_gates_pass_all_that_rules_match():
    for text in TEXTS:
        low = (text or "").translate(UP)
        for r in rules():
            if r.keyword in low and re.search(r.pattern, low, re.ASCII) and stem(r.keyword) in GATES:
                assert re.search(GATES[stem(r.keyword)], low)


def test_many_matches(frame):
    text = "mit license, gnu general public license v2. " * 3000
    (r,) = licenses.scan(frame([(1, text, *"abcd")], SCHEMA)).collect()
    assert len(r.detections) == 6000 and {d.label for d in r.detections} == {"mit", "gpl-2.0"}
    assert all(text[d.start : d.end].startswith(("mit", "gnu")) for d in r.detections)


def test_nothing(frame):
    assert licenses.scan(frame([], SCHEMA)).count() == 0
    twice = licenses.scan(frame([(None, TEXTS[0], *"abcd"), (None, TEXTS[0], *"abcd")], SCHEMA)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
