"""Signature rules of license scans.

A pattern is written as words with a space between them; a word is a regular expression for one whole
word, and one in parentheses may be missing. Each rule has a level, 0 the strongest: sentences of the
license itself, a tag, a statement that something is under a license, a full name, a short name.
"""

from __future__ import annotations

import re
from typing import NamedTuple

TEXT, TAG, STATEMENT, NAME, MENTION = range(5)
#: How sure a detection of each level is.
SURE = (1.0, 0.95, 0.9, 0.7, 0.4)


class Rule(NamedTuple):
    label: str
    level: int
    pattern: str
    base: bool = False


#: Phrases that always count, with their labels (fixed by contract).
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label, words of the identifier, and the names that a license goes by.
LICENSES = (
    ("0bsd", "0bsd", ("zero clause bsd", "bsd zero clause")),
    ("aal", "aal", ("attribution assurance licen[cs]e",)),
    ("afl-3.0", "afl 3 0", ("academic free licen[cs]e (version) v?3 (0)",)),
    ("agpl-3.0", "agpl 3 0 (only|or) (later)", ("(gnu) affero general public licen[cs]e", "(gnu) agpl v?3", "agplv3")),
    ("apache-1.1", "apache 1 1", ("apache (software) licen[cs]e (version) v?1 1",)),
    ("apache-2.0", "apache 2 0", ("apache (software) licen[cs]e (version) v?2 (0)", "apache 2 0 licen[cs]e", "alv2|asl2")),
    ("apsl-2.0", "apsl 2 0", ("apple public source licen[cs]e",)),
    ("artistic-1.0", "artistic 1 0 (perl)", ("artistic licen[cs]e (version) v?1 (0)", "perl artistic licen[cs]e")),
    ("artistic-2.0", "artistic 2 0", ("artistic licen[cs]e (version) v?2 (0)",)),
    ("beerware", "beerware", ("beer ware licen[cs]e", "beerware licen[cs]e")),
    ("blueoak-1.0.0", "blueoak 1 0 0", ("blue oak model licen[cs]e",)),
    ("bsd-2-clause", "bsd 2 clause", ("(the) (simplified) bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd licen[cs]e")),
    ("bsd-3-clause", "bsd 3 clause", ("(the) bsd 3 clause", "3 clause bsd", "three clause bsd", "new|modified|revised bsd licen[cs]e")),
    ("bsd-4-clause", "bsd 4 clause", ("4 clause bsd", "four clause bsd", "original bsd", "old bsd licen[cs]e")),
    ("bsl-1.0", "bsl 1 0", ("boost software licen[cs]e",)),
    ("busl-1.1", "busl 1 1", ("business source licen[cs]e",)),
    ("bzip2", "bzip2 1 0 6", ("bzip2 (and) (libbzip2) licen[cs]e",)),
    ("cc-by-3.0", "cc by 3 0", ("creative commons attribution 3 0", "cc by v?3 (0)")),
    ("cc-by-4.0", "cc by 4 0", ("creative commons attribution 4 0", "cc by v?4 (0)")),
    ("cc-by-nc", "cc by nc (\\d) (0)", ("creative commons attribution non commercial", "creative commons attribution noncommercial")),
    ("cc-by-nc-nd", "cc by nc nd (\\d) (0)", ("creative commons attribution noncommercial no(derivs|derivatives)", "attribution non commercial no derivatives")),
    ("cc-by-nc-sa", "cc by nc sa (\\d) (0)", ("creative commons attribution noncommercial sharealike", "attribution non commercial share alike")),
    ("cc-by-nd", "cc by nd (\\d) (0)", ("creative commons attribution no(derivs|derivatives)", "creative commons attribution no derivatives")),
    ("cc-by-sa", "cc by sa (\\d) (0)", ("creative commons attribution sharealike", "creative commons attribution share alike")),
    ("cc0-1.0", "cc0 1 0", ("creative commons zero", "cc0 (1) (0) (universal)", "cc zero")),
    ("cddl-1.0", "cddl 1 [01]", ("common development and distribution licen[cs]e",)),
    ("cecill-2.1", "cecill 2 1", ("cecill (free) (software) licen[cs]e", "licence cecill")),
    ("cpl-1.0", "cpl 1 0", ("common public licen[cs]e",)),
    ("curl", "curl", ("curl licen[cs]e",)),
    ("ecl-2.0", "ecl 2 0", ("educational community licen[cs]e",)),
    ("efl-2.0", "efl 2 0", ("eiffel forum licen[cs]e",)),
    ("elastic-2.0", "elastic 2 0", ("elastic licen[cs]e",)),
    ("epl-1.0", "epl 1 0", ("eclipse public licen[cs]e (version) v?1 (0)",)),
    ("epl-2.0", "epl 2 0", ("eclipse public licen[cs]e (version) v?2 (0)",)),
    ("eupl-1.2", "eupl 1 [12]", ("european union public licen[cs]e",)),
    ("fsfap", "fsfap", ("gnu all permissive licen[cs]e",)),
    ("gfdl", "gfdl 1 [123] (only|or) (later)", ("gnu free documentation licen[cs]e", "gnu fdl")),
    ("gpl-1.0", "gpl 1 0 (only|or) (later)", ("gnu general public licen[cs]e (as) (published) (version) v?1", "gplv1", "gpl v?1")),
    ("gpl-2.0", "gpl 2 0 (only|or) (later)", ("gnu general public licen[cs]e (version) v?2", "gplv2", "gpl v?2")),
    ("gpl-3.0", "gpl 3 0 (only|or) (later)", ("gnu general public licen[cs]e (version) v?3", "gplv3", "gpl v?3")),
    ("hpnd", "hpnd", ("historical permission notice and disclaimer",)),
    ("icu", "icu", ("icu licen[cs]e", "unicode (inc) licen[cs]e agreement")),
    ("ijg", "ijg", ("independent jpeg group licen[cs]e",)),
    ("ipl-1.0", "ipl 1 0", ("ibm public licen[cs]e",)),
    ("isc", "isc", ("isc licen[cs]e", "internet systems consortium licen[cs]e")),
    ("json", "json", ("json licen[cs]e",)),
    ("lgpl-2.0", "lgpl 2 0 (only|or) (later)", ("gnu library general public licen[cs]e", "lgpl v?2 0")),
    ("lgpl-2.1", "lgpl 2 1 (only|or) (later)", ("gnu lesser general public licen[cs]e (version) v?2 (1)", "lgplv2|lgplv21", "lgpl v?2 1")),
    ("lgpl-3.0", "lgpl 3 0 (only|or) (later)", ("gnu lesser general public licen[cs]e (version) v?3", "lgplv3", "lgpl v?3")),
    ("libpng", "libpng (2) (0)", ("libpng licen[cs]e", "png reference library licen[cs]e")),
    ("lpl-1.02", "lpl 1 (0|02)", ("lucent public licen[cs]e",)),
    ("lppl", "lppl 1 3 (a|c)", ("latex project public licen[cs]e",)),
    ("mit", "mit", ("mit licen[cs]e", "expat licen[cs]e", "x11 licen[cs]e")),
    ("mit-0", "mit 0", ("mit no attribution", "mit zero")),
    ("mpl-1.1", "mpl 1 1", ("mozilla public licen[cs]e (version) v?1 (1)", "mpl v?1 1")),
    ("mpl-2.0", "mpl 2 0", ("mozilla public licen[cs]e (version) v?2 (0)", "mpl v?2 (0)")),
    ("ms-pl", "ms pl", ("microsoft public licen[cs]e",)),
    ("ms-rl", "ms rl", ("microsoft reciprocal licen[cs]e",)),
    ("mulanpsl-2.0", "mulanpsl 2 0", ("mulan permissive software licen[cs]e", "木兰宽松许可证")),
    ("ncsa", "ncsa", ("university of illinois (ncsa) open source licen[cs]e", "ncsa open source licen[cs]e")),
    ("nasa-1.3", "nasa 1 3", ("nasa open source agreement",)),
    ("odbl-1.0", "odbl 1 0", ("open (data) (commons) (open) database licen[cs]e", "odbl")),
    ("odc-by-1.0", "odc by 1 0", ("open data commons attribution licen[cs]e",)),
    ("ofl-1.1", "ofl 1 1", ("sil open font licen[cs]e", "open font licen[cs]e")),
    ("oldap-2.8", "oldap 2 8", ("openldap public licen[cs]e",)),
    ("openssl", "openssl", ("openssl licen[cs]e", "ssleay licen[cs]e")),
    ("osl-3.0", "osl 3 0", ("open software licen[cs]e (version) v?3 (0)",)),
    ("pddl-1.0", "pddl 1 0", ("public domain dedication and licen[cs]e",)),
    ("php-3.01", "php 3 (0|01)", ("php licen[cs]e",)),
    ("postgresql", "postgresql", ("postgresql licen[cs]e",)),
    ("psf-2.0", "psf 2 0", ("python software foundation licen[cs]e", "psf licen[cs]e")),
    ("python-2.0", "python 2 0", ("python licen[cs]e",)),
    ("qpl-1.0", "qpl 1 0", ("q public licen[cs]e",)),
    ("rpl-1.5", "rpl 1 5", ("reciprocal public licen[cs]e",)),
    ("ruby", "ruby", ("ruby licen[cs]e",)),
    ("sissl", "sissl", ("sun industry standards source licen[cs]e",)),
    ("sleepycat", "sleepycat", ("sleepycat licen[cs]e", "berkeley database licen[cs]e")),
    ("sspl-1.0", "sspl 1 0", ("server side public licen[cs]e",)),
    ("tcl", "tcl", ("tcl tk licen[cs]e", "tcl licen[cs]e")),
    ("unicode-3.0", "unicode 3 0", ("unicode licen[cs]e v?3",)),
    ("unlicense", "unlicense", ("(the) unlicen[cs]e",)),
    ("upl-1.0", "upl 1 0", ("universal permissive licen[cs]e",)),
    ("vim", "vim", ("vim licen[cs]e",)),
    ("w3c", "w3c", ("w3c software (notice) (and) licen[cs]e",)),
    ("watcom-1.0", "watcom 1 0", ("sybase open watcom public licen[cs]e",)),
    ("wtfpl", "wtfpl", ("do what the fuck you want to public licen[cs]e",)),
    ("xfree86-1.1", "xfree86 1 1", ("xfree86 licen[cs]e",)),
    ("zlib", "zlib", ("zlib (libpng) licen[cs]e",)),
    ("zpl-2.1", "zpl 2 [01]", ("zope public licen[cs]e",)),
)

#: Sentences that stand in licenses and notices themselves.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "the above copyright notice and this permission notice shall be included in all"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of .* nor the names of its contributors may be used"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license"),
    ("gpl", "see the gnu general public license for more details"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser|library general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license"),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", "remote network interaction use with the gnu general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "altered source versions must be plainly marked as such"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("cc0-1.0", "to the extent possible under law .* waived all copyright"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("openssl", "this product includes software developed by the openssl project"),
    ("fsfap", "copying and distribution of this file with or without modification are permitted in any medium"),
    ("vim", "vim is charityware"),
    ("json", "the software shall be used for good not evil"),
    ("sspl-1.0", "making the functionality of the program available to third parties as a service"),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal with the software"),
    ("public-domain", "released|placed|dedicated in|into|to the public domain"),
    ("public-domain", "this file|work|software|code is in the public domain"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
)

#: Words so common in licenses that they can't gate a rule while a rarer one stands in it.
COMMON = frozenset("a above all and any are as available be by can charge code common copy copyright distribute distribution do document file for form free general granted hereby held in included is it its law license licensed made may mentioning modify more must names no not notice of on open or original permission permitted permit person program provided public released right rights reserved see shall should software source state such terms that the this to two three four under use used version versions want whatever with without work you your x new old 0 1 2 3 4 5 6 8".split())

_STATEMENTS = "(is) licen[cs]ed|released|distributed|available|published|provided|covered under (the) (terms) (of) (the)"


def _forms(label: str, ident: str, names: tuple[str, ...]) -> list[Rule]:
    """The rules of a license: its tag, statements and names; and its identifier before the word license."""
    rules = [Rule(label, TAG, f"spdx license identifier {ident}"), Rule(label, MENTION, f"{ident} licen[cs]ed?")]
    for name in names:
        rules += [Rule(label, STATEMENT, f"{_STATEMENTS} {name}"), Rule(label, NAME, name)]
    return rules


RULES: tuple[Rule, ...] = (
    *(Rule(label, TEXT, words) for label, words in SENTENCES),
    *(rule for entry in LICENSES for rule in _forms(*entry)),
    Rule("gpl", NAME, "gnu general public licen[cs]e"), Rule("lgpl", NAME, "gnu lesser general public licen[cs]e"), Rule("bsd", NAME, "bsd (style) licen[cs]e"), Rule("apache", NAME, "apache (software) licen[cs]e"),
    Rule("mpl", NAME, "mozilla public licen[cs]e"), Rule("epl", NAME, "eclipse public licen[cs]e"), Rule("artistic", NAME, "artistic licen[cs]e"), Rule("cc", NAME, "creative commons"), Rule("cc-by", NAME, "creative commons attribution"),
    *(Rule(label, MENTION, words, True) for words, label in BASE),
)


def parsed(pattern: str) -> list[tuple[str, bool]]:
    """(expression, may be missing) of each word of a pattern; `.*` stands for one to eight words of any kind."""
    words = re.findall(r"\([^ ()]*\)(?= |$)|\S+", pattern)
    return [(w[1:-1], True) if w.startswith("(") and w.endswith(")") else (w, False) for w in words]


def compiled(pattern: str) -> str:
    """The pattern as an expression over a text whose every word has a space of its own on either side."""
    out = []
    for word, optional in parsed(pattern):
        out.append("(?: [^ ]+ ){1,8}?" if word == ".*" else f"(?: (?:{word}) )" + ("?" if optional else ""))
    return "".join(out)


def keywords(pattern: str) -> list[str]:
    """Words one of which stands in every match: the alternatives of the needed word that is rarest by COMMON and, then, longest."""
    plain = [w.split("|") for w, optional in parsed(pattern) if not optional and re.fullmatch(r"[^\W_]+(\|[^\W_]+)*", w)]
    plain += [[w.replace("[cs]", c).replace("d?", "") for c in "cs"] for w, optional in parsed(pattern) if not optional and "[cs]" in w and w.startswith("unlicen")]
    plain = plain or [[w.replace("v?", v) for v in ("", "v")] for w, optional in parsed(pattern) if not optional and w.startswith("v?")]
    return min(plain, key=lambda ws: (any(w in COMMON for w in ws), -min(map(len, ws))))
