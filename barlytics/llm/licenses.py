"""License statements by ordered signature rules.

A text without any keyword is done after one pass of the keyword automaton. In others,
each rule whose own keyword occurs is run as a regular expression. Detections are taken
in order of priority, then length; one that lies inside a detection already taken is
suppressed. Base phrases (words that stand one after another) are always reported.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlytics.llm.tables import slices, strings

#: Phrases and labels of the contract (fixed values).
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Label, names as regular expressions, identifiers, addresses. Each line gives several rules.
FAMILIES = [
    ("mit", r"mit|expat|x11", "MIT X11 MIT-0", r"opensource\.org/licenses?/mit"),
    ("apache", r"apache(?: software)?", "Apache-2.0 Apache-1.1 Apache-1.0", r"apache\.org/licenses"),
    ("gpl", r"(?:gnu )?(?:general public|gpl)", "GPL-2.0 GPL-3.0 GPL-1.0", r"gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?gpl"),
    ("lgpl", r"(?:gnu )?(?:(?:lesser|library) general public|lgpl)", "LGPL-2.1 LGPL-3.0 LGPL-2.0", r"gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?lgpl"),
    ("agpl", r"(?:gnu )?(?:affero general public|agpl)", "AGPL-3.0 AGPL-1.0", r"gnu\.org/licenses/agpl"),
    ("gfdl", r"(?:gnu )?(?:free documentation|gfdl)", "GFDL-1.1 GFDL-1.2 GFDL-1.3", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    ("bsd", r"(?:(?:new|modified|simplified|revised|[234]-clause) )?bsd", "BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD", r"opensource\.org/licenses?/bsd"),
    ("isc", r"isc", "ISC", r"opensource\.org/licenses?/isc"),
    ("mpl", r"mozilla public|mpl", "MPL-1.0 MPL-1.1 MPL-2.0", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", r"eclipse public|epl", "EPL-1.0 EPL-2.0", r"eclipse\.org/legal/epl"),
    ("edl", r"eclipse distribution|edl", "EDL-1.0", r"eclipse\.org/org/documents/edl"),
    ("cddl", r"common development and distribution|cddl", "CDDL-1.0 CDDL-1.1", r"opensource\.org/licenses?/cddl"),
    ("cpl", r"common public", "CPL-1.0", r"opensource\.org/licenses?/cpl"),
    ("ipl", r"ibm public", "IPL-1.0", r"opensource\.org/licenses?/ibmpl"),
    ("artistic", r"artistic", "Artistic-1.0 Artistic-2.0", r"opensource\.org/licenses?/artistic"),
    ("boost", r"boost software", "BSL-1.0", r"boost\.org/license"),
    ("busl", r"business source", "BUSL-1.1", r"mariadb\.com/bsl"),
    ("zlib", r"zlib(?:/libpng)?", "Zlib zlib-acknowledgement", r"zlib\.net/zlib_license"),
    ("libpng", r"libpng", "Libpng libpng-2.0", r"libpng\.org/pub/png/src/libpng-license"),
    ("openssl", r"openssl", "OpenSSL", r"openssl\.org/source/license"),
    ("php", r"php", "PHP-3.0 PHP-3.01", r"php\.net/license"),
    ("python", r"python(?: software foundation)?|psf", "PSF-2.0 Python-2.0", r"docs\.python\.org/\S*license"),
    ("ruby", r"ruby", "Ruby", r"ruby-lang\.org/\S*license"),
    ("perl", r"perl", "Artistic-1.0-Perl", r"dev\.perl\.org/licenses"),
    ("postgresql", r"postgresql", "PostgreSQL", r"postgresql\.org/about/licence"),
    ("unlicense", r"unlicense", "Unlicense", r"unlicense\.org"),
    ("wtfpl", r"do what the f\S+ you want to public|wtfpl", "WTFPL", r"wtfpl\.net"),
    ("cc0", r"cc0|creative commons zero", "CC0-1.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-nd", r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:nc|non-?commercial)[ -](?:nd|no-?deriv\w+)", "CC-BY-NC-ND-2.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:nc|non-?commercial)[ -](?:sa|share-?alike)", "CC-BY-NC-SA-2.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:nc|non-?commercial)", "CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:nd|no-?deriv\w+)", "CC-BY-ND-2.0 CC-BY-ND-3.0 CC-BY-ND-4.0", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:sa|share-?alike)", "CC-BY-SA-2.0 CC-BY-SA-3.0 CC-BY-SA-4.0", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", r"(?:cc|creative commons)[ -](?:by|attribution)", "CC-BY-2.0 CC-BY-3.0 CC-BY-4.0", r"creativecommons\.org/licenses/by/"),
    ("odbl", r"open database", "ODbL-1.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", r"open data commons attribution", "ODC-By-1.0", r"opendatacommons\.org/licenses/by"),
    ("pddl", r"public domain dedication and", "PDDL-1.0", r"opendatacommons\.org/licenses/pddl"),
    ("ofl", r"(?:sil )?open font", "OFL-1.0 OFL-1.1", r"scripts\.sil\.org/ofl"),
    ("eupl", r"european union public|eupl", "EUPL-1.1 EUPL-1.2", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("cecill", r"cecill(?:-[bc])?", "CECILL-2.1 CECILL-B CECILL-C", r"cecill\.info/licen"),
    ("osl", r"open software", "OSL-1.0 OSL-2.1 OSL-3.0", r"opensource\.org/licenses?/osl"),
    ("afl", r"academic free", "AFL-2.1 AFL-3.0", r"opensource\.org/licenses?/afl"),
    ("ms-pl", r"microsoft public|ms-pl", "MS-PL", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", r"microsoft reciprocal|ms-rl", "MS-RL", r"opensource\.org/licenses?/ms-rl"),
    ("ncsa", r"(?:university of illinois/)?ncsa(?: open source)?", "NCSA", r"opensource\.org/licenses?/ncsa"),
    ("sspl", r"server side public|sspl", "SSPL-1.0", r"mongodb\.com/licensing/server-side-public"),
    ("elastic", r"elastic", "Elastic-2.0", r"elastic\.co/licensing/elastic"),
    ("polyform", r"polyform \w+", "PolyForm-Noncommercial-1.0.0 PolyForm-Small-Business-1.0.0", r"polyformproject\.org/licenses"),
    ("upl", r"universal permissive", "UPL-1.0", r"oss\.oracle\.com/licenses/upl"),
    ("qpl", r"q public", "QPL-1.0", r"opensource\.org/licenses?/qpl"),
    ("vim", r"vim", "Vim", r"vimhelp\.org/uganda"),
    ("w3c", r"w3c software(?: notice and)?", "W3C", r"w3\.org/consortium/legal"),
    ("zpl", r"zope public", "ZPL-2.1", r"opensource\.org/licenses?/zpl"),
    ("mulan", r"mulan (?:psl|permissive software)", "MulanPSL-2.0", r"license\.coscl\.org\.cn/mulan"),
    ("hippocratic", r"hippocratic", "Hippocratic-2.1", r"firstdonoharm\.dev"),
    ("openrail", r"(?:creativeml )?open ?rail(?:-[ms])?", "CreativeML-OpenRAIL-M", r"huggingface\.co/spaces/\S*license"),
]

#: Sentences of license texts and notices: label, keyword, expression.
SENTENCES = [
    ("mit", "hereby", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("mit", "restriction", r"deal in the software without restriction"),
    ("isc", "permission", r"permission to use, copy, modify,? and/?o?r? distribute this software"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms"),
    ("bsd", "neither", r"neither the name of [\s\S]{1,80}? nor the names of (?:its|their) contributors"),
    ("gpl", "redistribute", r"redistribute it and/or modify it under the terms of the gnu general public"),
    ("lgpl", "redistribute", r"redistribute it and/or modify it under the terms of the gnu lesser"),
    ("agpl", "redistribute", r"redistribute it and/or modify it under the terms of the gnu affero"),
    ("apache", "compliance", r"you may not use this file except in compliance with the license"),
    ("mpl", "mozilla", r"source code form is subject to the terms of the mozilla public"),
    ("zlib", "altered", r"altered source versions must be plainly marked"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("public-domain", "domain", r"(?:dedicated to|placed in|released (?:in)?to|is in) the public domain"),
    ("proprietary", "reserved", r"all rights reserved"),
    ("copyright", "copyright", r"copyright\s+(?:\(c\)|©|\d{4})[^\n]{0,80}"),
    ("copyright", "©", r"©\s*(?:\d{4}|[^\W\d_]+ \d{4})"),
]


def wrapped(expression: str) -> str:
    """The expression with any white space, line ends and comment marks included, where it has one space outside a set."""
    return re.sub(r" (\??)(?![^\[]*\])", lambda m: r"(?:[\s*#/;]+)" + m[1], expression)


class Rule(NamedTuple):
    label: str
    keyword: str
    expression: str
    priority: int
    weight: float


@lru_cache(1)
def rules() -> list[Rule]:
    """All signature rules, in order: identifiers and addresses before names before sentences."""
    found = []
    for label, names, identifiers, address in FAMILIES:
        for identifier in identifiers.split():
            found.append(Rule(label, "spdx-license-identifier", rf"spdx-license-identifier:\s*{re.escape(identifier.lower())}(?![\w.]|-\d)[+\w-]*", 40, 0.99))
        found.append(Rule(label, address.replace("\\", "").split("(")[0].split("/")[0], rf"(?:https?://)?(?:www\.)?{address}\S*", 30, 0.9))
        found.append(Rule(label, "under", rf"(?:released|licen[sc]ed|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?(?:{names})(?: licen[sc]e)?\b[^\w\n]{{0,2}}(?:v(?:ersion)? ?\d[\d.]*)?", 25, 0.95))
        found.append(Rule(label, "licen", rf"\b(?:{names}) licen[sc]e\b(?:,? v(?:ersion)? ?\d[\d.]*)?", 20, 0.8))
    found += [Rule(label, keyword, expression, 10, 0.5) for label, keyword, expression in SENTENCES]
    return [r._replace(expression=wrapped(r.expression)) for r in found]


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = [(r, re.compile(r.expression)) for r in rules()]
        self.words = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        self.base = [(tuple(p.encode().split()), label) for p, label in BASE]
        self.automaton = ahocorasick.Automaton()
        for keyword in {r.keyword for r in rules()} | {p.split()[-1] for p, _ in BASE}:
            self.automaton.add_word(keyword, keyword)
        self.automaton.make_automaton()

    def detections(self, text: str, keywords: set[str]) -> list[tuple[int, int, Rule]]:
        """(begin, end, rule) that remain after suppression, by begin."""
        hits = [
            (m.start(), m.end(), -rule.priority, k)
            for k, (rule, match) in enumerate(self.rules) if rule.keyword in keywords for m in match.finditer(text) if m[0]
        ]
        # A detection goes if one of higher priority, or of the same and longer, covers it. What covers
        # the covering one covers it too, so it does not matter whether that one remains.
        hits.sort(key=lambda h: (h[0], -h[1], h[2], h[3]))
        kept = []
        for level in {h[2] for h in hits}:
            reach = -1
            for begin, end, order, k in hits:
                if order <= level:
                    if order == level and end > reach:
                        kept.append((begin, end, self.rules[k][0]))
                    reach = max(reach, end)
        return sorted(kept, key=lambda d: d[:2])

    def scan(self, text: str) -> tuple:
        raw = text.encode().lower()  # A-Z only
        low = raw.decode()
        keywords = {k for _, k in self.automaton.iter(low)}
        words = self.words.findall(raw)
        places: list[tuple[int, str]] = []
        if b"license" in raw:
            for phrase, label in self.base:
                last, n = phrase[-1], len(phrase)
                at = n - 1
                while True:
                    try:
                        at = words.index(last, at)
                    except ValueError:
                        break
                    if tuple(words[at - n + 1 : at + 1]) == phrase:
                        places.append((at - n + 1, label))
                    at += 1
        found = self.detections(low, keywords) if keywords else []
        base = {label for _, label in places}
        miss = 1.0
        for _, _, rule in found:
            miss *= 1 - rule.weight
        score = max(1 - miss, 0.95 if base else 0.0)
        labels = base | {rule.label for _, _, rule in found}
        starts = [p for p, _ in places]
        return (
            len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score,
            [{"label": r.label, "begin": b, "end": e} for b, e, r in found],
        )


_scanner: list[Scanner] = []
SCAN = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, detections array<struct<label:string,begin:long,end:long>>"
)
_TYPES = [
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
    pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])),
]


def scan(docs: DataFrame) -> DataFrame:
    """License findings of each row of ``docs`` (doc_id, text).

    Null and empty texts have no words and no labels; repeated rows are scanned one by one.
    ``detections`` holds the spans, in code points, that remain after suppression.
    """

    def run(batches):
        if not _scanner:
            _scanner.append(Scanner())
        names = [c.split()[0] for c in SCAN.split(", ")]
        for part in slices(batches):
            columns = zip(*map(_scanner[0].scan, strings(part["text"])))
            arrays = [pa.array(list(c), t) for c, t in zip(columns, _TYPES)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *arrays], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {SCAN}")
