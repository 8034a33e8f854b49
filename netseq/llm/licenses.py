"""License detection by ordered signature rules.

A text is reduced to its words in lower case. Each rule is a regular expression over words with a keyword
that every match contains; only rules whose keyword occurs are tried. Overlaps are resolved by containment:
a detection inside another of the same or a higher priority is suppressed. All of it stays within the row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netseq.llm.common import let, whole_text
from netseq.spec import quoted

# Runs of these characters separate words once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words without lower-casing first.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Confidence of a detection by priority; 1 is the most specific.
CONFIDENCE = {1: 1.0, 2: 0.8, 3: 0.6}


@dataclass(frozen=True)
class Signature:
    """``pattern`` is a regular expression over words; one blank stands for any gap between words."""

    label: str
    priority: int
    keyword: str
    pattern: str
    base: bool = False

    @property
    def over_gaps(self) -> str:
        """The pattern for text in which every word carries a blank on both sides."""
        return " (" + self.pattern.replace(" ", "  ") + ") "


BASE = (
    Signature("mit", 3, "license", "mit license", True),
    Signature("apache", 3, "license", "apache license", True),
    Signature("gpl", 3, "license", "general public license", True),
)

# label; priority; keyword; pattern over words
_PHRASES = """
mit; 1; permission; permission is hereby granted free of charge to any person obtaining a copy
mit; 2; mit; (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit(?: license| licence)?
mit; 2; mit; the mit licen[sc]e mit
mit; 2; mit; spdx license identifier mit
mit-0; 1; mit; mit no attribution
x11; 2; x11; x11 licen[sc]e
expat; 2; expat; expat licen[sc]e
isc; 1; permission; permission to use copy modify and or distribute this software for any purpose with or without fee
isc; 2; isc; isc licen[sc]e
isc; 2; isc; spdx license identifier isc
0bsd; 2; 0bsd; spdx license identifier 0bsd
bsd; 3; bsd; bsd(?: style)? licen[sc]e
bsd; 2; redistributions; redistributions of source code must retain the above copyright notice
bsd; 2; redistributions; redistributions in binary form must reproduce the above copyright notice
bsd-2-clause; 1; bsd; (?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)?
bsd-3-clause; 1; bsd; (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?
bsd-3-clause; 1; endorse; may be used to endorse or promote products derived from this software
bsd-4-clause; 1; bsd; (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e)?
bsd-4-clause; 1; advertising; all advertising materials mentioning features or use of this software
apache; 2; apache; (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?apache(?: software)?(?: license| licence)?
apache-2.0; 1; apache; licensed under the apache license version 2 0
apache-2.0; 1; apache; apache(?: software)? licen[sc]e(?: version| v)? 2(?: 0)?
apache-2.0; 1; apache; apache licen[sc]e v2(?: 0)?
apache-2.0; 1; apache; spdx license identifier apache 2 0
apache-2.0; 1; apache; apache org licenses license 2 0
apache-1.1; 1; apache; apache(?: software)? licen[sc]e(?: version| v)? 1 1
apache-1.0; 1; apache; apache(?: software)? licen[sc]e(?: version| v)? 1 0
gpl; 2; gpl; (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl
gpl; 2; gnu; gnu general public licen[sc]e
gpl; 2; gnu; terms of the gnu general public license as published by the free software foundation
gpl; 3; gpl; gnu gpl
lgpl; 2; lesser; (?:gnu )?lesser general public licen[sc]e
lgpl; 2; library; (?:gnu )?library general public licen[sc]e
lgpl; 3; lgpl; (?:gnu )?lgpl
agpl; 2; affero; (?:gnu )?affero general public licen[sc]e
agpl; 3; agpl; (?:gnu )?agpl
gfdl; 2; documentation; (?:gnu )?free documentation licen[sc]e
gfdl; 3; gfdl; (?:gnu )?gfdl
mpl; 2; mozilla; mozilla public licen[sc]e
npl; 2; netscape; netscape public licen[sc]e
cddl; 2; cddl; (?:common development and distribution license )?cddl
cddl; 2; development; common development and distribution licen[sc]e
epl; 2; eclipse; eclipse public licen[sc]e
edl; 2; eclipse; eclipse distribution licen[sc]e
eupl; 2; european; european union public licen[sc]e
cecill; 2; cecill; cecill(?: [abc])?(?: licen[sc]e)?
ofl; 2; sil; sil open font licen[sc]e
ofl; 2; font; open font licen[sc]e
artistic; 2; artistic; artistic licen[sc]e
perl; 3; perl; (?:same terms as|under the same terms as) perl(?: itself)?
python; 2; python; python(?: software foundation)? licen[sc]e
ruby; 2; ruby; ruby licen[sc]e
php; 2; php; php licen[sc]e
zend; 2; zend; zend(?: engine)? licen[sc]e
zlib; 2; zlib; zlib(?: libpng)? licen[sc]e
zlib; 1; misrepresented; the origin of this software must not be misrepresented
libpng; 2; libpng; libpng licen[sc]e
openssl; 2; openssl; openssl licen[sc]e
postgresql; 2; postgresql; postgresql licen[sc]e
boost; 2; boost; boost software licen[sc]e
wtfpl; 2; wtfpl; wtfpl
wtfpl; 1; what; do what the fuck you want to public licen[sc]e
beerware; 2; beerware; beerware(?: licen[sc]e)?
unlicense; 1; unencumbered; free and unencumbered software released into the public domain
unlicense; 2; unlicense; the unlicense
public-domain; 3; domain; (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain; 3; domain; public domain(?: dedication| software| work)
cc0; 1; cc0; (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0; 1; commons; creative commons zero
cc0; 1; publicdomain; creativecommons org publicdomain zero 1 0
cc; 3; commons; creative commons(?: licen[sc]e)?
odbl; 2; database; open(?: data commons open)? database licen[sc]e
odbl; 2; odbl; odbl
odc-by; 2; attribution; open data commons attribution licen[sc]e
pddl; 2; domain; open data commons public domain dedication and licen[sc]e
ms-pl; 2; microsoft; microsoft public licen[sc]e
ms-rl; 2; microsoft; microsoft reciprocal licen[sc]e
ibm-public; 2; ibm; ibm public licen[sc]e
common-public; 2; common; common public licen[sc]e
sun-public; 2; sun; sun public licen[sc]e
apple-public; 2; apple; apple public source licen[sc]e
intel; 2; intel; intel open source licen[sc]e
nokia; 2; nokia; nokia open source licen[sc]e
academic-free; 2; academic; academic free licen[sc]e
open-software; 2; open; open software licen[sc]e
educational-community; 2; educational; educational community licen[sc]e
universal-permissive; 2; universal; universal permissive licen[sc]e
w3c; 2; w3c; w3c(?: software)?(?: notice and)? licen[sc]e
unicode; 2; unicode; unicode(?: data files and software)? licen[sc]e
ncsa; 2; illinois; university of illinois ncsa open source licen[sc]e
qpl; 2; q; (?:the )?q public licen[sc]e
qpl; 2; qpl; qpl licen[sc]e
sleepycat; 2; sleepycat; sleepycat licen[sc]e
vim; 2; vim; vim licen[sc]e
latex; 2; latex; latex project public licen[sc]e
mulan; 2; mulan; mulan (?:permissive software|public) licen[sc]e
blue-oak; 2; oak; blue oak model licen[sc]e
elastic; 2; elastic; elastic licen[sc]e
sspl; 2; server; server side public licen[sc]e
busl; 2; business; business source licen[sc]e
openrail; 2; openrail; (?:bigscience |creativeml )?openrail(?: m)?
llama; 2; llama; llama(?: 2| 3)? community licen[sc]e
mit; 1; notice; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
as-is; 3; merchantability; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
isc; 1; fee; permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
isc; 2; disclaims; the software is provided as is and the author disclaims all warranties with regard to this software
bsd; 2; contributors; this software is provided by the (?:copyright holders|regents) and contributors as is
bsd-3-clause; 1; contributors; neither the name of the copyright holder nor the names of its contributors may be used
bsd-4-clause; 1; acknowledgement; must display the following acknowledgement
apache-2.0; 1; compliance; you may not use this file except in compliance with the license
apache-2.0; 1; agreed; unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0; 1; asf; licensed to the apache software foundation asf under one or more contributor license agreements
apache-1.1; 1; includes; this product includes software developed by the apache software foundation
gpl; 2; redistribute; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl; 3; franklin; you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc 51 franklin street
lgpl; 2; redistribute; this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl; 2; redistribute; this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
or-later; 3; version; (?:either )?version (?:1|2|2 1|3)(?: 0)? of the license or at your option any later version
gfdl; 2; documentation; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0; 1; form; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0; 1; distributed; if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1; 1; mozilla; the contents of this file are subject to the mozilla public license version 1 1
cddl; 1; cddl; the contents of this file are subject to the terms of the common development and distribution license the cddl
epl-1.0; 1; accompanying; this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0; 1; accompanying; this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
eupl; 1; eupl; licensed under the eupl
ofl-1.1; 1; font; this font software is licensed under the sil open font license version 1 1
zlib; 1; altered; altered source versions must be plainly marked as such
zlib; 2; liable; in no event will the authors be held liable for any damages arising from the use of this software
bsl-1.0; 1; organization; permission is hereby granted free of charge to any person or organization obtaining a copy
postgresql; 1; documentation; permission to use copy modify and distribute this software and its documentation for any purpose without fee
hpnd; 1; documentation; permission to use copy modify distribute and sell this software and its documentation for any purpose
wtfpl; 1; fuck; you just do what the fuck you want to
unlicense; 1; compile; anyone is free to copy modify publish use compile sell or distribute this software
cc0; 1; waived; has waived all copyright and related or neighboring rights
cc; 2; creative; this work is licensed under (?:a|the) creative commons
python; 1; psf; this license agreement is between the python software foundation psf
openssl; 1; openssl; this product includes software developed by the openssl project
mulan; 1; mulan; is licensed under mulan psl v2
public-domain; 2; domain; this (?:file|work|code|software) (?:is|has been put) in the public domain
proprietary; 2; unauthorized; unauthorized copying of this file via any medium is strictly prohibited
proprietary; 2; permission; no part of this (?:publication|work|document) may be reproduced without (?:the )?prior written permission
proprietary; 2; confidential; this (?:document|file|message) contains confidential information
proprietary; 3; reserved; all rights reserved
proprietary; 2; proprietary; (?:proprietary and confidential|confidential and proprietary)
proprietary; 2; may; you may not (?:copy|modify|redistribute)(?: or redistribute)?
"""


def _versions() -> list[Signature]:
    """Versioned names: one signature for each license, version and way of writing the version."""
    found = []
    gnu = {"gpl": ("general public", ("1", "2", "3")), "lgpl": ("lesser general public", ("2", "2 1", "3")),
           "agpl": ("affero general public", ("1", "3")), "gfdl": ("free documentation", ("1 1", "1 2", "1 3"))}
    for short, (name, numbers) in gnu.items():
        keyword = name.split()[0]
        for n in numbers:
            label = f"{short}-{n.replace(' ', '.')}" + ("" if " " in n else ".0")
            zero = "" if " " in n else "(?: 0)?"
            number = rf"(?:version|v) {n}{zero}|v{n}{zero}"
            published = rf"(?:gnu )?{name} licen[sc]e as published by the free software foundation (?:either )?version {n}{zero}"
            found += [
                Signature(label, 1, keyword, rf"(?:gnu )?{name} licen[sc]e(?: {short})? (?:{number})"),
                Signature(label, 1, "version", rf"version {n}{zero} of the (?:gnu )?{name} licen[sc]e"),
                # "version 3 of the License" says nothing by itself: the name belongs to the detection
                Signature(label, 1, "published", rf"{published}(?: of the license)?(?: or at your option any later version)?"),
                Signature(label, 1, short, rf"{short} (?:{number}|{n}{zero})"),
                Signature(label, 1, f"{short}v{n.split()[0]}", rf"{short}v{n}{zero}"),
                Signature(label, 1, f"{short}{n.split()[0]}", rf"{short}{n}"),
                Signature(label, 1, "identifier", rf"spdx license identifier {short} {n}{' 0' if zero else ''}(?: only| or later)?"),
            ]
    others = {"mpl": ("mozilla public", ("1 0", "1 1", "2 0")), "epl": ("eclipse public", ("1 0", "2 0")),
              "cddl": ("common development and distribution", ("1 0", "1 1")),
              "eupl": ("european union public", ("1 0", "1 1", "1 2")), "osl": ("open software", ("1 0", "2 0", "3 0")),
              "afl": ("academic free", ("1 2", "2 0", "2 1", "3 0")), "bsl": ("boost software", ("1 0",)),
              "artistic": ("artistic", ("1 0", "2 0")), "lppl": ("latex project public", ("1 0", "1 3")),
              "ofl": ("open font", ("1 0", "1 1")), "ecl": ("educational community", ("1 0", "2 0"))}
    for short, (name, numbers) in others.items():
        for n in numbers:
            label = f"{short}-{n.replace(' ', '.')}"
            found += [
                Signature(label, 1, name.split()[0], rf"{name} licen[sc]e(?: {short})?(?: version| v)? {n}"),
                Signature(label, 1, short, rf"{short} {n}"),
                Signature(label, 1, "identifier", rf"spdx license identifier {short} {n}"),
            ]
    parts = {"by": "attribution", "sa": "share(?: )?alike", "nc": "non(?: )?commercial", "nd": "no(?: )?deriv(?:ative)?s"}
    for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        long_name = " ".join(parts[p] for p in kind.split())
        for n in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{kind.replace(' ', '-')}-{n.replace(' ', '.')}"
            found += [
                Signature(label, 1, "cc", rf"cc {kind} {n}"),
                Signature(label, 1, "creativecommons", rf"creativecommons org licenses {kind} {n}"),
                Signature(label, 1, "attribution", rf"(?:creative commons )?{long_name} {n}(?: international| unported)?"),
            ]
    return found


def signatures() -> tuple[Signature, ...]:
    """All rules in order: the base phrases, the written phrases, the versioned names."""
    written = [[p.strip() for p in line.split(";")] for line in _PHRASES.strip().splitlines()]
    return (*BASE, *[Signature(x[0], int(x[1]), x[2], x[3]) for x in written], *_versions())


# Every match contains the keyword of its rule, so a text without any of them holds no license.
GATE = tuple(sorted({r.keyword for r in signatures()}))


def _literals(rules: tuple[Signature, ...]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.label).alias("label"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(r.over_gaps).alias("pattern"),
                F.lit(r.base).alias("base"),
            )
            for r in rules
        ]
    )


def lowered(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def normal_words(text: Column) -> Column:
    """Lower-case words, each with one blank on both sides."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(text), GAP, "  ")), F.lit(" "))


def keywords(normal: Column, rules: tuple[Signature, ...]) -> Column:
    """The keywords of the rules that are words of the text, found in one pass over its words."""
    known = F.array(*[F.lit(k) for k in sorted({r.keyword for r in rules})])
    return F.array_intersect(F.split(F.trim(normal), "  "), known)


def detections(normal: Column, present: Column, rules: tuple[Signature, ...]) -> Column:
    """Array of (first, last_neg, priority, label, base) of all matches; words count from 0."""

    def places(rule: Column) -> Column:
        marked = F.regexp_replace(normal, rule["pattern"], F.lit(" \u0001$1 "))
        at = F.transform(F.split(F.trim(marked), "  "), lambda w, i: F.when(w.startswith("\u0001"), i))
        return F.filter(at, lambda i: i.isNotNull())

    def of(rule: Column) -> Column:
        return F.zip_with(
            places(rule),
            F.regexp_extract_all(normal, rule["pattern"], F.lit(1)),
            lambda first, match: F.struct(
                first.cast("bigint").alias("first"),
                (-(first + F.size(F.split(match, "  ")) - 1)).cast("bigint").alias("last_neg"),
                rule["priority"].alias("priority"),
                rule["label"].alias("label"),
                rule["base"].alias("base"),
            ),
        )

    tried = F.filter(_literals(rules), lambda r: F.array_contains(present, r["keyword"]))
    return F.flatten(F.transform(tried, of))


def resolved(found: Column) -> Column:
    """(labels, priority) of the detections that stay: distinct labels, and the best priority or null.

    Ordered by first word, longest first, then priority and label, whatever contains a detection comes
    before it; so it is enough to carry the farthest last word seen for each priority.
    """
    ends = {p: f"end{p}" for p in CONFIDENCE}
    start = F.struct(
        *[F.lit(-1).cast("bigint").alias(e) for e in ends.values()],
        F.array().cast("array<string>").alias("labels"),
        F.lit(None).cast("int").alias("best"),
    )

    def step(acc: Column, x: Column) -> Column:
        last = -x["last_neg"]
        inside = reduce(Column.__or__, [(x["priority"] >= p) & (acc[e] >= last) for p, e in ends.items()])
        return F.struct(
            *[F.when(x["priority"] == p, F.greatest(acc[e], last)).otherwise(acc[e]).alias(e) for p, e in ends.items()],
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x["label"]))).alias("labels"),
            F.when(inside, acc["best"]).otherwise(F.least(acc["best"], x["priority"])).alias("best"),
        )

    return F.aggregate(F.sort_array(found), start, step, lambda acc: F.struct(acc["labels"], acc["best"]))


def scan(docs: DataFrame, text: str = "text", rules: tuple[Signature, ...] | None = None, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words: counts and score are 0, label lists empty, places null. Base labels
    are never suppressed. The score is the confidence of the best detection that stays, 0 without one.
    Repeated rows are scanned each for itself, long texts whole; an empty table gives no rows. New names start
    with ``prefix``; one that ``docs`` has already is an error.
    """
    names = {c: prefix + c for c in ("n_words", *RESULT)}
    clash = sorted(set(names.values()) & set(docs.columns))
    if clash:
        raise ValueError(f"columns {clash} are there already; give a prefix")
    rules = rules or signatures()
    whole = whole_text(text)
    none = F.lit(None).cast("bigint")

    def summary(found: Column) -> Column:
        base = F.filter(found, lambda x: x["base"])

        def put(base: Column, kept: Column) -> Column:
            own = F.array_distinct(F.transform(base, lambda x: x["label"]))
            best = F.least(kept["best"], F.when(F.size(base) > 0, F.lit(max(CONFIDENCE))))
            scored = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
            return F.struct(
                F.size(base).cast("bigint").alias("n_base"),
                F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"),
                F.array_max(F.transform(base, lambda x: x["first"])).alias("last_word"),
                F.array_join(F.sort_array(own), ",").alias("base_labels"),
                F.array_join(F.sort_array(F.array_union(own, kept["labels"])), ",").alias("labels"),
                F.coalesce(F.element_at(scored, best), F.lit(0.0)).alias("score"),
            )

        return let(base, lambda b: let(resolved(found), lambda kept: put(b, kept)))

    empty = F.struct(
        F.lit(0).cast("bigint").alias("n_base"),
        none.alias("first_word"),
        none.alias("last_word"),
        F.lit("").alias("base_labels"),
        F.lit("").alias("labels"),
        F.lit(0.0).alias("score"),
    )

    def scanned(normal: Column) -> Column:
        def tried(present: Column) -> Column:
            return F.when(F.size(present) > 0, let(detections(normal, present, rules), summary)).otherwise(empty)

        return let(keywords(normal, rules), tried)

    own = [F.col(quoted(c)) for c in docs.columns]
    counted = F.regexp_count(whole, F.lit(WORD_ANY_CASE)).cast("bigint").alias(names["n_words"])
    held = "scanned" + "_" * max(map(len, [*docs.columns, ""]))  # longer than any other name
    found = docs.select(*own, counted, let(normal_words(whole), scanned).alias(held))
    return found.select(*own, names["n_words"], *[F.col(held)[c].alias(names[c]) for c in RESULT])


RESULT = ("n_base", "first_word", "last_word", "base_labels", "labels", "score")
