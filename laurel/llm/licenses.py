"""License scan: ordered signature rules behind a keyword prefilter.

Method: a text becomes lower-case words (A-Z folded, every other ASCII character but digits is a separator). One
Aho-Corasick pass finds the keywords; only rules whose keyword is present run their pattern over the words. Rules
have a priority; a detection whose word interval lies inside that of a detection with a higher priority, or of a
longer one with the same priority, is suppressed. The rest give labels and a score, the highest confidence.

Base phrases always count: every place where their words stand consecutively, whatever is suppressed.

Defined cases: null and empty texts have no words, no labels and score 0. Texts are read whole. Equal rows each give
a row. Only the named columns are read.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm.common import LOWER_ALNUM, per_text, utf8

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Licence families as label, names in words, versions ("" is the bare name).
FAMILIES = [
    ("gpl", ("gnu general public license", "gnu general public licence", "gnu gpl"), ("1 0", "2 0", "3 0", "2", "3")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl"), ("2 0", "2 1", "3 0", "2", "3")),
    ("agpl", ("gnu affero general public license", "gnu agpl"), ("1 0", "3 0", "3")),
    ("gfdl", ("gnu free documentation license",), ("1 1", "1 2", "1 3")),
    ("apache", ("apache license", "apache software license", "asf license"), ("1 0", "1 1", "2 0")),
    ("mpl", ("mozilla public license",), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public license",), ("1 0", "2 0")),
    ("cddl", ("common development and distribution license",), ("1 0", "1 1")),
    ("cpl", ("common public license",), ("1 0",)),
    ("eupl", ("european union public licence", "european union public license"), ("1 0", "1 1", "1 2")),
    ("osl", ("open software license",), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", ("academic free license",), ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", ("artistic license", "perl artistic license"), ("1 0", "2 0")),
    ("cecill", ("cecill free software license agreement", "cecill license"), ("1 0", "2 0", "2 1")),
    ("ofl", ("sil open font license",), ("1 0", "1 1")),
    ("bsl", ("boost software license",), ("1 0",)),
    ("psf", ("python software foundation license",), ("2",)),
    ("php", ("php license",), ("3 0", "3 01")),
    ("zpl", ("zope public license",), ("1 1", "2 0", "2 1")),
    ("lppl", ("latex project public license",), ("1 0", "1 2", "1 3")),
    ("odbl", ("open database license",), ("1 0",)),
    ("apsl", ("apple public source license",), ("1 0", "1 1", "1 2", "2 0")),
    ("ms-pl", ("microsoft public license",), ()),
    ("ms-rl", ("microsoft reciprocal license",), ()),
    ("mit", ("mit license", "mit licence", "expat license", "x11 license"), ()),
    ("isc", ("isc license",), ()),
    ("zlib", ("zlib license", "zlib libpng license"), ()),
    ("unlicense", ("unlicense",), ()),
    ("wtfpl", ("do what the fuck you want to public license",), ("2",)),
    ("cc-by", ("creative commons attribution",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", ("creative commons attribution sharealike", "creative commons attribution share alike"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", ("creative commons attribution noncommercial", "creative commons attribution non commercial"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", ("creative commons attribution noderivatives", "creative commons attribution no derivatives"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", ("creative commons attribution noncommercial sharealike",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc0", ("creative commons zero", "cc0"), ("1 0",)),
    ("cc-by-sa", ("cc by sa",), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", ("cc by nc",), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", ("cc by nd",), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", ("cc by nc sa",), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", ("cc by nc nd",), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", ("cc by",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("bsd-2-clause", ("bsd 2 clause", "simplified bsd license", "freebsd license"), ()),
    ("bsd-3-clause", ("bsd 3 clause", "new bsd license", "modified bsd license", "revised bsd license"), ()),
    ("bsd-4-clause", ("bsd 4 clause", "original bsd license"), ()),
    ("bsd", ("bsd license", "bsd style license"), ()),
]

# Sentences of licence texts and notices, as word patterns.
NOTICES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote products"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("gpl-or-later", r"gnu general public license as published by the free software foundation either version [123](?: 0)? of the license or (?:at your option )?any later version"),
    ("lgpl-or-later", r"gnu lesser general public license as published by the free software foundation either version [23](?: [01])? of the license or (?:at your option )?any later version"),
    ("apache-2.0", r"licensed under the apache license version 2 0"),
    ("apache-2.0", r"you may not use this file except in compliance with the license"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", r"(?:is|are|placed|released|dedicated) (?:in|into|to) the public domain"),
    ("wtfpl", r"you just do what the fuck you want to"),
    ("proprietary", r"all rights reserved(?: \S+){0,6} (?:confidential|proprietary)"),
    ("proprietary", r"unauthorized (?:copying|use|distribution) of this (?:file|software|document)"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("cc", r"(?:work|content|text|article|file) is licensed under (?:a|the) creative commons"),
]

# Identifiers used in file tags, as words.
TAGS = (
    "mit, isc, zlib, unlicense, wtfpl, x11, ncsa, postgresql, ruby, vim, w3c, openssl, ms pl, ms rl, cc0 1 0, 0bsd, bsl 1 0, "
    "bsd 2 clause, bsd 3 clause, bsd 4 clause, apache 1 0, apache 1 1, apache 2 0, mpl 1 0, mpl 1 1, mpl 2 0, epl 1 0, epl 2 0, "
    "gpl 1 0, gpl 2 0, gpl 3 0, lgpl 2 0, lgpl 2 1, lgpl 3 0, agpl 3 0, gfdl 1 1, gfdl 1 2, gfdl 1 3, eupl 1 1, eupl 1 2, "
    "cddl 1 0, cddl 1 1, ofl 1 0, ofl 1 1, osl 3 0, afl 3 0, artistic 1 0, artistic 2 0, cecill 2 1, "
    "cc by 1 0, cc by 2 0, cc by 2 5, cc by 3 0, cc by 4 0, cc by sa 2 0, cc by sa 2 5, cc by sa 3 0, cc by sa 4 0, "
    "cc by nc 3 0, cc by nc 4 0, cc by nd 3 0, cc by nd 4 0, cc by nc sa 3 0, cc by nc sa 4 0, cc by nc nd 3 0, cc by nc nd 4 0"
).split(", ")

# Addresses of licence texts, as words.
ADDRESSES = [
    ("gpl", "gnu org licenses gpl"), ("lgpl", "gnu org licenses lgpl"), ("agpl", "gnu org licenses agpl"),
    ("gfdl", "gnu org licenses fdl"), ("apache-2.0", "apache org licenses license 2 0"), ("mpl-2.0", "mozilla org mpl 2 0"),
    ("mit", "opensource org licenses mit"), ("bsd-3-clause", "opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause"), ("cc-by", "creativecommons org licenses by"),
    ("cc-by-sa", "creativecommons org licenses by sa"), ("cc-by-nc", "creativecommons org licenses by nc"),
    ("cc-by-nd", "creativecommons org licenses by nd"), ("cc-by-nc-sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd"), ("cc0", "creativecommons org publicdomain zero"),
    ("unlicense", "unlicense org"), ("wtfpl", "wtfpl net"), ("bsl", "boost org license 1 0"), ("ofl", "scripts sil org ofl"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    pattern: str
    keyword: str


def _keyword(words: str) -> str:
    """The longest plain word that every match of the pattern holds."""
    plain = re.sub(r"\((?:[^()]|\([^()]*\))*\)\S*|\[[^]]*\]\S*", " | ", words)
    return max((w for w in plain.split() if w.isalnum()), key=len)


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    found = [Rule(label, 5, 1.0, text, _keyword(text)) for label, text in NOTICES]
    for tag in TAGS:
        words = f"spdx license identifier {tag}(?: or later| only)?"
        label = re.sub(r"(\d) (?=\d)", r"\1.", tag).replace(" ", "-")
        found.append(Rule(label, 4, 1.0, words, "spdx"))
    found += [Rule(label, 4, 0.95, words, _keyword(words)) for label, words in ADDRESSES]
    for label, names, versions in FAMILIES:
        for name in names:
            found.append(Rule(label, 1, 0.6, name, _keyword(name)))
            for version in versions:
                dotted = f"{label}-{version.replace(' ', '.')}"
                numbered = f"{name} (?:version |v |v)?{version}"
                found.append(Rule(dotted, 2, 0.9, numbered, _keyword(name)))
                found.append(Rule(f"{dotted}-or-later", 3, 0.95, f"{numbered} or (?:at your option )?(?:any )?later", _keyword(name)))
    return tuple(sorted(set(found), key=lambda r: (-r.priority, r.label, r.pattern)))


@functools.cache
def _compiled():
    """Patterns and the keyword automaton, built once per process."""
    automaton = ahocorasick.Automaton()
    gated: dict[str, list[int]] = {}
    for number, rule in enumerate(rules()):
        gated.setdefault(rule.keyword, []).append(number)
    for keyword, numbers in gated.items():
        automaton.add_word(f" {keyword} ", tuple(numbers))
    automaton.make_automaton()
    patterns = [re.compile(f" {rule.pattern}(?= )") for rule in rules()]
    base = [(re.compile(f" {phrase}(?= )"), label) for phrase, label in BASE.items()]
    return automaton, patterns, base


def unsuppressed(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Detections (priority, start, end, rule) not inside one of higher priority, or longer at the same priority."""
    kept: list[tuple[int, int, int, int]] = []
    for level in sorted({hit[0] for hit in found}, reverse=True):
        above = sorted((start, end) for _, start, end, _ in kept)
        starts, reach = [a for a, _ in above], list(accumulate((b for _, b in above), max))
        last, before, upto = (-1, -1), -1, -1  # furthest end of earlier intervals, without and with equals of the last
        for hit in sorted({h for h in found if h[0] == level}, key=lambda h: (h[1], -h[2], h[3])):
            start, end = hit[1:3]
            if (start, end) != last:
                last, before = (start, end), upto
            upto = max(upto, end)
            covered = bisect_right(starts, start)
            if before < end and not (covered and reach[covered - 1] >= end):
                kept.append(hit)
    return kept


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = text.translate(LOWER_ALNUM).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0
    joined = " " + b" ".join(words).decode() + " "
    automaton, patterns, base = _compiled()
    numbers = sorted({n for _, group in automaton.iter(joined) for n in group})
    starts, base_labels = [], set()
    if numbers:  # every base phrase holds a rule's keyword
        for pattern, label in base:
            places = [m.start() for m in pattern.finditer(joined)]
            if places:
                base_labels.add(label)
                starts += places
    found = [
        (rules()[n].priority, m.start(), m.end(), n) for n in numbers for m in patterns[n].finditer(joined)
    ]
    detected = [rules()[n] for _, _, _, n in unsuppressed(found)]
    labels = base_labels | {rule.label for rule in detected}
    score = max([rule.confidence for rule in detected] + [0.5] * bool(base_labels), default=0.0)
    places = [joined.count(" ", 0, start) for start in (min(starts), max(starts))] if starts else [None, None]
    return len(words), len(starts), *places, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


KIND = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
_FIELDS = pa.struct([(name, _ARROW[kind]) for name, kind in (part.split() for part in KIND.split(", "))])
scan_udf = per_text(scan, _FIELDS)


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key and what the scan found."""
    return docs.select(F.col(key), scan_udf(utf8(text)).alias("found")).select(key, "found.*")
