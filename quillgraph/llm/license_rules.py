"""Signature rules of the license scan.

A rule is a regular expression over words in lower case that are joined by single spaces. It holds from its first word on, which is a plain word:
the keyword that gates the rule. `{l}` is license or licence, `{v}` an optional "version". Rules come in the order of their levels:
1 tags and whole notices, 2 statements ("licensed under the ..."), 3 names with a version, 4 names, 5 short forms.
"""

from __future__ import annotations

from dataclasses import dataclass

MAX_WORDS = 32
WEIGHT = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.6, 5: 0.4}
LATER = "(?: or(?: at your option)?(?: any)? later(?: version)?| only)?"


@dataclass(frozen=True)
class Rule:
    level: int
    label: str
    regex: str

    @property
    def key(self) -> str:
        return self.regex.split(" ")[0].split("(")[0]


#: label | versions | full names | short forms (a short form may have the version glued on: gplv3, gpl3).
FAMILIES = """
gpl | 1 2 3 | gnu general public {l} ; general public {l} ; gnu gpl | gpl
lgpl | 2 2.1 3 | gnu lesser general public {l} ; gnu library general public {l} ; lesser general public {l} ; gnu lgpl | lgpl
agpl | 1 3 | gnu affero general public {l} ; affero general public {l} ; gnu agpl | agpl
gfdl | 1.1 1.2 1.3 | gnu free documentation {l} ; free documentation {l} ; gnu fdl | gfdl
apache | 1 1.1 2 | apache software {l} ; apache {l} | asl
mpl | 1 1.1 2 | mozilla public {l} | mpl
epl | 1 2 | eclipse public {l} | epl
edl | 1 | eclipse distribution {l} | edl
cddl | 1 1.1 | common development and distribution {l} | cddl
cpl | 1 | common public {l} | cpl
cpal | 1 | common public attribution {l} | cpal
eupl | 1 1.1 1.2 | european union public {l} | eupl
osl | 1 2 2.1 3 | open software {l} | osl
afl | 1.1 1.2 2 2.1 3 | academic free {l} | afl
artistic | 1 2 | artistic {l} ; perl artistic {l} |
boost | 1 | boost software {l} ; boost {l} | bsl
ofl | 1 1.1 | sil open font {l} ; open font {l} ; sil ofl | ofl
lppl | 1 1.1 1.2 1.3 | latex project public {l} | lppl
zpl | 1.1 2 2.1 | zope public {l} | zpl
python | 2 | python software foundation {l} ; psf {l} ; python {l} |
php | 3 3.01 | php {l} |
upl | 1 | universal permissive {l} | upl
cecill | 1 2 2.1 | cecill free software {l} ; cecill {l} | cecill
apsl | 1 1.1 2 | apple public source {l} | apsl
rpl | 1.1 1.5 | reciprocal public {l} | rpl
qpl | 1 | q public {l} | qpl
ms-pl | | microsoft public {l} ; ms pl |
ms-rl | | microsoft reciprocal {l} ; ms rl |
mit | | mit x11 {l} ; mit expat {l} ; mit {l} ; expat {l} ; mit no attribution {l} |
x11 | | x11 {l} ; x consortium {l} |
isc | | isc {l} ; internet systems consortium {l} |
bsd-2-clause | | bsd 2 clause(?: {l})? ; 2 clause bsd(?: {l})? ; two clause bsd(?: {l})? ; simplified bsd {l} ; freebsd {l} |
bsd-3-clause | | bsd 3 clause(?: {l})? ; 3 clause bsd(?: {l})? ; three clause bsd(?: {l})? ; modified bsd {l} ; new bsd {l} ; revised bsd {l} |
bsd-4-clause | | bsd 4 clause(?: {l})? ; original bsd {l} ; four clause bsd(?: {l})? |
bsd | | bsd style {l} ; bsd {l} |
0bsd | | zero clause bsd(?: {l})? ; bsd zero clause(?: {l})? ; 0bsd |
zlib | | zlib libpng {l} ; zlib {l} |
libpng | | libpng {l} |
ncsa | | university of illinois ncsa open source {l} ; ncsa open source {l} ; ncsa {l} |
openssl | | openssl {l} |
postgresql | | postgresql {l} |
ruby | | ruby {l} |
vim | | vim {l} |
curl | | curl {l} |
w3c | | w3c software(?: and document)?(?: notice and)? {l} ; w3c {l} |
sleepycat | | sleepycat {l} |
unlicense | | unlicense |
wtfpl | | do what the fuck you want to public {l} ; wtfpl |
beerware | | beerware {l} ; beer ware {l} |
json | | json {l} |
ijg | | independent jpeg group {l} ; ijg {l} |
icu | | icu {l} ; unicode {l} ; unicode terms of use |
odbl | 1 | open database {l} ; open data commons open database {l} | odbl
odc-by | 1 | open data commons attribution {l} | odc by
pddl | 1 | open data commons public domain dedication(?: and {l})? | pddl
cc0 | 1 | creative commons zero ; cc zero ; creative commons public domain dedication | cc0
cc-by-nc-nd | 1 2 2.5 3 4 | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? ; cc by nc nd |
cc-by-nc-sa | 1 2 2.5 3 4 | creative commons attribution non ?commercial share ?alike ; cc by nc sa |
cc-by-nc | 1 2 2.5 3 4 | creative commons attribution non ?commercial ; cc by nc |
cc-by-nd | 1 2 2.5 3 4 | creative commons attribution no ?deriv(?:ative)?s?(?: works)? ; cc by nd |
cc-by-sa | 1 2 2.5 3 4 | creative commons attribution share ?alike ; cc by sa |
cc-by | 1 2 2.5 3 4 | creative commons attribution ; cc by |
"""

#: Whole notices and tags (level 1): label | regex.
NOTICES = """
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
isc | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution and use in source and binary forms with or without modification are permitted
apache-2.0 | except in compliance with the {l}
zlib | software is provided as is without any express or implied warranty in no event will the authors be held liable
boost | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | free and unencumbered software released into the public domain
gpl | program is free software you can redistribute it and or modify it under the terms of the gnu general public {l}
lgpl | library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public {l}
agpl | program is free software you can redistribute it and or modify it under the terms of the gnu affero general public {l}
mpl-2.0 | source code form is subject to the terms of the mozilla public {l}{v} 2 0
beerware | retain this notice you can do whatever you want with this stuff
artistic | intent of this document is to state the conditions under which a package may be copied
public-domain | released into the public domain
public-domain | dedicated to the public domain
public-domain | placed in the public domain
cc-by | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons org licenses by sa [1-4] [05]
cc-by-nc | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons org licenses by nc nd [1-4] [05]
cc0 | creativecommons org publicdomain zero 1 0
gpl-3.0 | gnu org licenses gpl 3 0
gpl-2.0 | gnu org licenses gpl 2 0
gpl | gnu org licenses gpl
lgpl | gnu org licenses lgpl
agpl | gnu org licenses agpl
apache-2.0 | apache org licenses {l} 2 0
mit | opensource org licenses mit
bsd-2-clause | opensource org licenses bsd 2 clause
bsd-3-clause | opensource org licenses bsd 3 clause
isc | opensource org licenses isc
all-rights-reserved | rights reserved
"""

#: label -> words of its identifier behind "spdx license identifier" (level 1).
TAGS = """
gpl-1.0 gpl 1 0 | gpl-2.0 gpl 2 0 | gpl-3.0 gpl 3 0 | lgpl-2.0 lgpl 2 0 | lgpl-2.1 lgpl 2 1 | lgpl-3.0 lgpl 3 0 | agpl-3.0 agpl 3 0 | gfdl-1.3 gfdl 1 3
apache-2.0 apache 2 0 | apache-1.1 apache 1 1 | mpl-1.1 mpl 1 1 | mpl-2.0 mpl 2 0 | epl-1.0 epl 1 0 | epl-2.0 epl 2 0 | cddl-1.0 cddl 1 0 | eupl-1.2 eupl 1 2
mit mit | mit-0 mit 0 | isc isc | zlib zlib | 0bsd 0bsd | bsd-2-clause bsd 2 clause | bsd-3-clause bsd 3 clause | bsd-4-clause bsd 4 clause | boost-1.0 bsl 1 0
unlicense unlicense | wtfpl wtfpl | ncsa ncsa | postgresql postgresql | ofl-1.1 ofl 1 1 | osl-3.0 osl 3 0 | afl-3.0 afl 3 0 | artistic-2.0 artistic 2 0 | ms-pl ms pl
cc0-1.0 cc0 1 0 | cc-by-4.0 cc by 4 0 | cc-by-sa-4.0 cc by sa 4 0 | cc-by-nc-4.0 cc by nc 4 0 | cc-by-nd-4.0 cc by nd 4 0 | cc-by-nc-sa-4.0 cc by nc sa 4 0 | cc-by-nc-nd-4.0 cc by nc nd 4 0
"""
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def _lines(block: str) -> list[list[str]]:
    fill = lambda s: s.replace("{l}", "licen[cs]e").replace("{v}", "(?: version| ver| v)?").strip()
    return [[fill(cell) for cell in line.split("|")] for line in block.strip().split("\n")]


def _split(cell: str) -> list[str]:
    return [x.strip() for x in cell.split(";") if x.strip()]


def _names() -> list[tuple[int, str, str]]:
    """level, label, regex of every name, with and without its version."""
    out = []
    for label, versions, names, short in _lines(FAMILIES):
        for version in versions.split():
            major, _, minor = version.partition(".")
            number = f"{major} {minor}" if minor else f"{major}(?: 0)?"
            named = f"{label}-{version if minor else version + '.0'}"
            tail = "(?: international| unported| generic)?" if label.startswith("cc") else LATER
            out += [(3, named, f"{n}(?: version| ver| v)? {number}{tail}") for n in _split(names) + _split(short)]
            out += [(3, named, f"{n}{glue}{major}{' ' + minor if minor else '(?: 0)?'}{tail}") for n in _split(short) for glue in ("v", "")]
        out += [(4, label, n) for n in _split(names)] + [(5, label, n) for n in _split(short)]
    return out


def _build() -> list[Rule]:
    rules = [Rule(1, label, regex) for label, regex in _lines(NOTICES)]
    for label, *words in (cell.split() for line in _lines(TAGS) for cell in line):
        rules.append(Rule(1, label, f"spdx licen[cs]e identifier {' '.join(words)}"))
    names = _names()
    for level in (3, 4, 5):
        by = {}
        for _, label, regex in (n for n in names if n[0] == level):
            by.setdefault(label, []).append(regex)
        rules += [Rule(2, label, f"under(?: the)?(?: terms of(?: the)?| conditions of(?: the)?| a| an)? (?:{'|'.join(r)})") for label, r in by.items()]
    rules += [Rule(*n) for n in names]
    return sorted(rules, key=lambda r: r.level)


RULES = _build()
