"""The signature rules of the license scan.

A rule is a regular expression over words of lower-case letters and digits, written with one
space between words. ``2.1`` is the two words ``2 1``. Each rule names an anchor, one of a few
stems without which no document needs a closer look, and a key that every match of it holds;
both are plain substrings. Forms give the context a name stands in and with it a priority.
"""

from __future__ import annotations

from typing import NamedTuple

# Stems; every match of a rule holds its anchor.
ANCHORS = (
    "licen", "gpl", " cc", "creative", "domain", "permission", "permitted", "redistribut",
    "warrant", "copyright", "reserved", "advertising",
)


class Form(NamedTuple):
    name: str
    priority: int
    confidence: float


TAG = Form("tag", 5, 1.0)
TEXT = Form("text", 4, 0.95)
GRANT = Form("grant", 3, 0.9)
NAME = Form("name", 2, 0.75)
BASE = Form("base", 1, 0.6)


class Rule(NamedTuple):
    label: str
    form: Form
    anchor: str
    key: str
    pattern: str


LICENSE = "licen[sc]e"
LATER = "(?: or later| or any later version| only)?"


def version(major: int, minor: int | None = None) -> str:
    """``version 2 0``, ``v 2 0``, ``v2 0`` or ``2 0``; a zero behind the point may be left out."""
    tail = "" if minor is None else f"(?: {minor})?" if minor == 0 else f" {minor}"
    return f"(?:version |v |v){major}{tail}|{major}{tail}"


def versioned(name: str, *numbers: int) -> str:
    return f"{name} (?:the )?(?:{version(*numbers)}){LATER}"


# The phrases every scan counts, and their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

GPL = f"(?:gnu )?general public {LICENSE}"
LGPL = f"(?:gnu )?(?:lesser|library) general public {LICENSE}"
AGPL = f"(?:gnu )?affero general public {LICENSE}"
GFDL = f"(?:gnu )?free documentation {LICENSE}"
CC = f"(?:creative commons|cc) (?:by|attribution)"
NC = "(?:nc|non commercial|noncommercial)"
SA = "(?:sa|share alike|sharealike)"
ND = "(?:nd|no derivatives|noderivatives|no derivs|noderivs)"
CC_END = f"(?: international| unported| generic)?(?: public)?(?: {LICENSE})?"

# (label, anchor, key, name). A name stands for itself and behind a grant such as
# "licensed under the".
NAMES = (
    ("gpl-1.0", "licen", "general", versioned(GPL, 1, 0)),
    ("gpl-2.0", "licen", "general", versioned(GPL, 2, 0)),
    ("gpl-3.0", "licen", "general", versioned(GPL, 3, 0)),
    ("gpl-1.0", "gpl", "gpl", f"(?:gnu )?(?:gplv1|gpl (?:{version(1, 0)}))(?: 0)?{LATER}"),
    ("gpl-2.0", "gpl", "gpl", f"(?:gnu )?(?:gplv2|gpl (?:{version(2, 0)}))(?: 0)?{LATER}"),
    ("gpl-3.0", "gpl", "gpl", f"(?:gnu )?(?:gplv3|gpl (?:{version(3, 0)}))(?: 0)?{LATER}"),
    ("lgpl-2.0", "licen", "general", f"gnu library general public {LICENSE} (?:{version(2, 0)}){LATER}"),
    ("lgpl-2.1", "licen", "general", versioned(LGPL, 2, 1)),
    ("lgpl-3.0", "licen", "general", versioned(LGPL, 3, 0)),
    ("lgpl-2.1", "gpl", "lgpl", f"(?:gnu )?(?:lgplv2|lgpl (?:version |v |v)?2) 1{LATER}"),
    ("lgpl-3.0", "gpl", "lgpl", f"(?:gnu )?(?:lgplv3|lgpl (?:{version(3, 0)}))(?: 0)?{LATER}"),
    ("lgpl", "licen", "general", LGPL),
    ("agpl-1.0", "licen", "affero", f"affero general public {LICENSE} (?:{version(1, 0)})"),
    ("agpl-3.0", "licen", "affero", versioned(AGPL, 3, 0)),
    ("agpl-3.0", "gpl", "agpl", f"(?:gnu )?(?:agplv3|agpl (?:{version(3, 0)}))(?: 0)?{LATER}"),
    ("agpl", "licen", "affero", AGPL),
    ("gpl-classpath-exception", "gpl", "classpath", "gpl (?:[a-z0-9]+ )?(?:[a-z0-9]+ )?with (?:the )?classpath exception"),
    ("gfdl-1.1", "licen", "documentation", versioned(GFDL, 1, 1)),
    ("gfdl-1.2", "licen", "documentation", versioned(GFDL, 1, 2)),
    ("gfdl-1.3", "licen", "documentation", versioned(GFDL, 1, 3)),
    ("gfdl", "licen", "documentation", f"gnu free documentation {LICENSE}"),
    ("apache-1.0", "licen", "apache", versioned(f"apache (?:software )?{LICENSE}", 1, 0)),
    ("apache-1.1", "licen", "apache", versioned(f"apache (?:software )?{LICENSE}", 1, 1)),
    ("apache-2.0", "licen", "apache", versioned(f"apache (?:software )?{LICENSE}", 2, 0)),
    ("apache-2.0", "licen", "apache", f"apache (?:v2|v2 0|2|2 0) {LICENSE}"),
    ("cc-by-1.0", " cc", "cc", f"cc by (?:{version(1, 0)}){CC_END}"),
    ("cc-by-2.0", " cc", "cc", f"cc by (?:{version(2, 0)}){CC_END}"),
    ("cc-by-2.5", " cc", "cc", f"cc by (?:{version(2, 5)}){CC_END}"),
    ("cc-by-3.0", " cc", "cc", f"cc by (?:{version(3, 0)}){CC_END}"),
    ("cc-by-4.0", " cc", "cc", f"cc by (?:{version(4, 0)}){CC_END}"),
    ("cc-by-sa-2.0", " cc", "cc", f"cc by {SA} (?:{version(2, 0)}){CC_END}"),
    ("cc-by-sa-2.5", " cc", "cc", f"cc by {SA} (?:{version(2, 5)}){CC_END}"),
    ("cc-by-sa-3.0", " cc", "cc", f"cc by {SA} (?:{version(3, 0)}){CC_END}"),
    ("cc-by-sa-4.0", " cc", "cc", f"cc by {SA} (?:{version(4, 0)}){CC_END}"),
    ("cc-by-nd-3.0", " cc", "cc", f"cc by {ND} (?:{version(3, 0)}){CC_END}"),
    ("cc-by-nd-4.0", " cc", "cc", f"cc by {ND} (?:{version(4, 0)}){CC_END}"),
    ("cc-by-nc-2.0", " cc", "cc", f"cc by {NC} (?:{version(2, 0)}){CC_END}"),
    ("cc-by-nc-3.0", " cc", "cc", f"cc by {NC} (?:{version(3, 0)}){CC_END}"),
    ("cc-by-nc-4.0", " cc", "cc", f"cc by {NC} (?:{version(4, 0)}){CC_END}"),
    ("cc-by-nc-sa-3.0", " cc", "cc", f"cc by {NC} {SA} (?:{version(3, 0)}){CC_END}"),
    ("cc-by-nc-sa-4.0", " cc", "cc", f"cc by {NC} {SA} (?:{version(4, 0)}){CC_END}"),
    ("cc-by-nc-nd-3.0", " cc", "cc", f"cc by {NC} {ND} (?:{version(3, 0)}){CC_END}"),
    ("cc-by-nc-nd-4.0", " cc", "cc", f"cc by {NC} {ND} (?:{version(4, 0)}){CC_END}"),
    ("cc-by-sa", " cc", "cc", f"cc by {SA}"),
    ("cc-by-nd", " cc", "cc", f"cc by {ND}"),
    ("cc-by-nc", " cc", "cc", f"cc by {NC}"),
    ("cc-by-nc-sa", " cc", "cc", f"cc by {NC} {SA}"),
    ("cc-by-nc-nd", " cc", "cc", f"cc by {NC} {ND}"),
    ("cc-by-3.0", "creative", "creative", f"creative commons attribution (?:{version(3, 0)}){CC_END}"),
    ("cc-by-4.0", "creative", "creative", f"creative commons attribution (?:{version(4, 0)}){CC_END}"),
    ("cc-by-sa-3.0", "creative", "creative", f"creative commons attribution {SA} (?:{version(3, 0)}){CC_END}"),
    ("cc-by-sa-4.0", "creative", "creative", f"creative commons attribution {SA} (?:{version(4, 0)}){CC_END}"),
    ("cc-by-nc-4.0", "creative", "creative", f"creative commons attribution {NC} (?:{version(4, 0)}){CC_END}"),
    ("cc-by-nd-4.0", "creative", "creative", f"creative commons attribution {ND} (?:{version(4, 0)}){CC_END}"),
    ("cc-by-nc-sa-4.0", "creative", "creative", f"creative commons attribution {NC} {SA} (?:{version(4, 0)}){CC_END}"),
    ("cc-by-nc-nd-4.0", "creative", "creative", f"creative commons attribution {NC} {ND} (?:{version(4, 0)}){CC_END}"),
    ("cc-by", "creative", "creative", f"creative commons attribution(?: {LICENSE})?"),
    ("cc0-1.0", " cc", "cc0", "cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc0-1.0", "creative", "creative", "creative commons (?:zero|public domain dedication)(?: 1 0)?(?: universal)?"),
    ("mit-0", "licen", "attribution", f"mit no attribution {LICENSE}"),
    ("x11", "licen", "x11", f"x11 {LICENSE}"),
    ("mit", "licen", "expat", f"expat {LICENSE}"),
    ("bsd-4-clause", "licen", "bsd", f"(?:original|4 clause|four clause) bsd {LICENSE}"),
    ("bsd-4-clause", "licen", "bsd", f"bsd (?:4|four) clause(?: original)? {LICENSE}"),
    ("bsd-3-clause", "licen", "bsd", f"(?:new|revised|modified|3 clause|three clause) bsd {LICENSE}"),
    ("bsd-3-clause", "licen", "bsd", f"bsd (?:3|three) clause(?: new| revised)? {LICENSE}"),
    ("bsd-2-clause", "licen", "bsd", f"(?:simplified bsd|freebsd|2 clause bsd|two clause bsd) {LICENSE}"),
    ("bsd-2-clause", "licen", "bsd", f"bsd (?:2|two) clause(?: simplified)? {LICENSE}"),
    ("0bsd", "licen", "bsd", f"(?:zero clause bsd|0bsd|bsd zero clause) {LICENSE}"),
    ("bsd", "licen", "bsd", f"bsd(?: style)? {LICENSE}"),
    ("isc", "licen", "isc", f"isc {LICENSE}"),
    ("mpl-1.0", "licen", "mozilla", versioned(f"mozilla public {LICENSE}", 1, 0)),
    ("mpl-1.1", "licen", "mozilla", versioned(f"mozilla public {LICENSE}", 1, 1)),
    ("mpl-2.0", "licen", "mozilla", versioned(f"mozilla public {LICENSE}", 2, 0)),
    ("mpl", "licen", "mozilla", f"mozilla public {LICENSE}"),
    ("epl-1.0", "licen", "eclipse", versioned(f"eclipse public {LICENSE}", 1, 0)),
    ("epl-2.0", "licen", "eclipse", versioned(f"eclipse public {LICENSE}", 2, 0)),
    ("epl", "licen", "eclipse", f"eclipse public {LICENSE}"),
    ("edl-1.0", "licen", "eclipse", f"eclipse distribution {LICENSE}(?: v 1 0| v1 0| 1 0)?"),
    ("cddl-1.0", "licen", "common", f"common development and distribution {LICENSE}(?: version 1 0| v 1 0| v1 0| 1 0)?"),
    ("cddl-1.1", "licen", "common", f"common development and distribution {LICENSE} (?:version |v |v)?1 1"),
    ("cpl-1.0", "licen", "common", f"common public {LICENSE}(?: version 1 0| v 1 0| v1 0| 1 0)?"),
    ("ipl-1.0", "licen", "ibm", f"ibm public {LICENSE}(?: version 1 0| v 1 0| v1 0| 1 0)?"),
    ("eupl-1.1", "licen", "union", versioned(f"european union public {LICENSE}", 1, 1)),
    ("eupl-1.2", "licen", "union", versioned(f"european union public {LICENSE}", 1, 2)),
    ("eupl", "licen", "union", f"european union public {LICENSE}"),
    ("ms-pl", "licen", "microsoft", f"microsoft public {LICENSE}"),
    ("ms-rl", "licen", "microsoft", f"microsoft reciprocal {LICENSE}"),
    ("artistic-1.0", "licen", "artistic", versioned(f"artistic {LICENSE}", 1, 0)),
    ("artistic-2.0", "licen", "artistic", versioned(f"artistic {LICENSE}", 2, 0)),
    ("artistic", "licen", "artistic", f"artistic {LICENSE}"),
    ("bsl-1.0", "licen", "boost", f"boost software {LICENSE}(?: version 1 0| v 1 0| v1 0| 1 0)?"),
    ("busl-1.1", "licen", "business", f"business source {LICENSE}(?: version 1 1| v 1 1| v1 1| 1 1)?"),
    ("sspl-1.0", "licen", "server", f"server side public {LICENSE}(?: version 1| v 1| v1)?"),
    ("elastic-2.0", "licen", "elastic", versioned(f"elastic {LICENSE}", 2, 0)),
    ("zlib", "licen", "zlib", f"zlib(?: libpng)? {LICENSE}"),
    ("libpng", "licen", "libpng", f"libpng {LICENSE}"),
    ("openssl", "licen", "openssl", f"openssl {LICENSE}"),
    ("python-2.0", "licen", "python", f"python software foundation {LICENSE}(?: version 2)?"),
    ("php-3.01", "licen", "php", f"php {LICENSE} (?:version |v |v)?3 01"),
    ("php", "licen", "php", f"php {LICENSE}"),
    ("ruby", "licen", "ruby", f"ruby {LICENSE}"),
    ("postgresql", "licen", "postgresql", f"postgresql {LICENSE}"),
    ("w3c", "licen", "w3c", f"w3c (?:software |document )?(?:notice and )?{LICENSE}"),
    ("unicode", "licen", "unicode", f"unicode (?:inc )?{LICENSE}(?: agreement)?"),
    ("ofl-1.1", "licen", "font", f"(?:sil )?open font {LICENSE}(?: version 1 1| v 1 1| v1 1| 1 1)?"),
    ("odbl-1.0", "licen", "database", f"open (?:data commons open )?database {LICENSE}(?: version 1 0| v1 0| 1 0)?"),
    ("odc-by-1.0", "licen", "commons", f"open data commons attribution {LICENSE}(?: version 1 0| v1 0| 1 0)?"),
    ("pddl-1.0", "licen", "domain", f"(?:open data commons )?public domain dedication and {LICENSE}"),
    ("ogl-uk-3.0", "licen", "government", f"open government {LICENSE} (?:version |v |v)?3(?: 0)?"),
    ("ogl-uk", "licen", "government", f"open government {LICENSE}"),
    ("osl-3.0", "licen", "open", versioned(f"open software {LICENSE}", 3, 0)),
    ("afl-3.0", "licen", "academic", versioned(f"academic free {LICENSE}", 3, 0)),
    ("afl", "licen", "academic", f"academic free {LICENSE}"),
    ("ecl-2.0", "licen", "educational", versioned(f"educational community {LICENSE}", 2, 0)),
    ("ncsa", "licen", "ncsa", f"(?:university of illinois )?ncsa open source {LICENSE}"),
    ("upl-1.0", "licen", "universal", f"universal permissive {LICENSE}(?: version 1 0| v 1 0| v1 0| 1 0)?"),
    ("qpl-1.0", "licen", "q", f"q public {LICENSE}(?: version 1 0| v1 0| 1 0)?"),
    ("lppl-1.3c", "licen", "latex", f"latex project public {LICENSE}(?: version 1 3c?| v1 3c?| 1 3c?)?"),
    ("wtfpl", "licen", "want", f"do what the f[a-z]+ you want to public {LICENSE}"),
    ("unlicense", "licen", "unlicense", "(?:the )?unlicense"),
    ("rail", "licen", "rail", f"(?:open|creativeml open|bigscience) rail(?: m)? {LICENSE}"),
    ("osl", "licen", "open", f"open software {LICENSE}"),
    ("mulan-psl-2.0", "licen", "mulan", f"mulan permissive software {LICENSE} (?:version |v |v)?2(?: 0)?"),
    ("proprietary", "licen", "proprietary", f"proprietary(?: software)? {LICENSE}"),
    ("commercial", "licen", "commercial", f"commercial(?: software)? {LICENSE}(?: agreement)?"),
)

# (label, words of the identifier)
TAGS = (
    ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3.0", "lgpl 3 0"),
    ("agpl-3.0", "agpl 3 0"), ("apache-2.0", "apache 2 0"), ("apache-1.1", "apache 1 1"), ("mit", "mit"),
    ("mit-0", "mit 0"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause"), ("0bsd", "0bsd"), ("isc", "isc"), ("mpl-1.1", "mpl 1 1"),
    ("mpl-2.0", "mpl 2 0"), ("epl-1.0", "epl 1 0"), ("epl-2.0", "epl 2 0"), ("cddl-1.0", "cddl 1 0"),
    ("cc-by-3.0", "cc by 3 0"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-sa-3.0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0"), ("cc-by-nc-4.0", "cc by nc 4 0"), ("cc-by-nd-4.0", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"), ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"), ("cc0-1.0", "cc0 1 0"),
    ("unlicense", "unlicense"), ("zlib", "zlib"), ("bsl-1.0", "bsl 1 0"), ("busl-1.1", "busl 1 1"),
    ("sspl-1.0", "sspl 1 0"), ("artistic-2.0", "artistic 2 0"), ("eupl-1.2", "eupl 1 2"), ("ofl-1.1", "ofl 1 1"),
    ("odbl-1.0", "odbl 1 0"), ("wtfpl", "wtfpl"), ("ms-pl", "ms pl"), ("upl-1.0", "upl 1 0"),
    ("postgresql", "postgresql"), ("python-2.0", "python 2 0"), ("ncsa", "ncsa"), ("x11", "x11"),
    ("afl-3.0", "afl 3 0"), ("osl-3.0", "osl 3 0"),
)

# (label, anchor, key, wording of the license itself)
TEXTS = (
    ("mit", "permission", "granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", "modify", "permission to use copy modify and or distribute this software for any purpose"),
    ("hpnd", "permission", "modify", "permission to use copy modify and distribute this software and its documentation"),
    ("bsd", "redistribut", "permitted", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "permission", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-2-clause", "redistribut", "disclaimer", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("gpl", "redistribut", "redistribute", "this program is free software you can redistribute it and or modify it"),
    ("gpl", "licen", "general", f"see the gnu general public {LICENSE} for more details"),
    ("gpl", "licen", "version", f"either version [0-9]+ of the {LICENSE} or at your option any later version"),
    ("lgpl", "redistribut", "library", "this library is free software you can redistribute it and or modify it"),
    ("agpl", "licen", "affero", f"see the gnu affero general public {LICENSE} for more details"),
    ("apache-2.0", "licen", "compliance", f"you may not use this file except in compliance with the {LICENSE}"),
    ("apache-2.0", "warrant", "warranties", "on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mpl-2.0", "licen", "form", f"this source code form is subject to the terms of the mozilla public {LICENSE} v 2 0"),
    ("mpl-1.1", "licen", "contents", f"the contents of this file are subject to the mozilla public {LICENSE} version 1 1"),
    ("unlicense", "domain", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", "domain", "no copyright (?:[a-z]+ )?public domain"),
    ("zlib", "permission", "permission", "permission is granted to anyone to use this software for any purpose"),
    ("zlib", "warrant", "implied", "this software is provided as is without any express or implied warranty"),
    ("wtfpl", "licen", "everyone", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("gpl", "permitted", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("bsl-1.0", "permission", "granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("ofl-1.1", "licen", "font", f"this font software is licensed under the sil open font {LICENSE}"),
    ("epl-1.0", "licen", "eclipse", f"this program and the accompanying materials are made available under the terms of the eclipse public {LICENSE}"),
    ("cddl-1.0", "licen", "common", f"the contents of this file are subject to the terms of the common development and distribution {LICENSE}"),
    ("gfdl", "permission", "document", "permission is granted to copy distribute and or modify this document under the terms of the"),
    ("cc-by", "licen", "creative", f"this work is licensed under a creative commons attribution"),
    ("cc-by", "creative", "creativecommons", "creativecommons org licenses by [0-9] [0-9]"),
    ("cc-by-sa", "creative", "creativecommons", "creativecommons org licenses by sa [0-9] [0-9]"),
    ("cc-by-nc", "creative", "creativecommons", "creativecommons org licenses by nc [0-9] [0-9]"),
    ("cc-by-nd", "creative", "creativecommons", "creativecommons org licenses by nd [0-9] [0-9]"),
    ("cc-by-nc-sa", "creative", "creativecommons", "creativecommons org licenses by nc sa [0-9] [0-9]"),
    ("cc-by-nc-nd", "creative", "creativecommons", "creativecommons org licenses by nc nd [0-9] [0-9]"),
    ("cc0-1.0", "creative", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("apache-2.0", "licen", "apache", "apache org licenses license 2 0"),
    ("gpl", "licen", "gnu", "gnu org licenses (?:old licenses )?gpl(?: [0-9] [0-9])?"),
    ("lgpl", "licen", "gnu", "gnu org licenses (?:old licenses )?lgpl(?: [0-9] [0-9])?"),
    ("agpl", "licen", "gnu", "gnu org licenses agpl(?: [0-9] [0-9])?"),
    ("mit", "licen", "opensource", "opensource org licenses mit(?: license)?(?: php| html)?"),
    ("bsd", "licen", "opensource", "opensource org licenses bsd (?:[0-9]+ clause|license)(?: php| html)?"),
    ("all-rights-reserved", "reserved", "rights", "all rights reserved"),
)

GIVEN = (
    "(?:licensed|released|distributed|available|provided|published|covered|dual licensed|offered) "
    "(?:to you )?(?:under|by|with) (?:the )?(?:terms of )?(?:the |a |an )?"
)


def rules() -> list[Rule]:
    """All rules in order: among equal intervals of equal priority the first one stays."""
    found = [
        Rule(label, TAG, "licen", "spdx", f"spdx {LICENSE} identifier {words}{LATER}") for label, words in TAGS
    ]
    found += [Rule(label, TEXT, anchor, key, words) for label, anchor, key, words in TEXTS]
    for form, lead in ((GRANT, GIVEN), (NAME, "")):
        found += [Rule(label, form, anchor, key, f"{lead}(?:{name})") for label, anchor, key, name in NAMES]
    grant = [(label, words.replace("license", LICENSE), words.split()[0]) for label, words in PHRASES]
    found += [Rule(label, GRANT, " cc" if key == "cc" else "licen", key, f"{GIVEN}{words}") for label, words, key in grant]
    found += [Rule(label, BASE, " cc" if "cc" in words else "licen", words.split()[0], words) for label, words in PHRASES]
    return found
