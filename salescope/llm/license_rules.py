"""Signature rules of the licence scan, over texts normalised to lower-case
words joined by single spaces.

A rule is (id, priority, keyword, regex, label, relevance, base).  The table is
built from the licences below times the ways of citing one; a rule without a
label is a false-positive signature: it suppresses what it covers."""

from __future__ import annotations

import re

# Label, SPDX id words, name as a regex over normalised words.
LICENCES = [
    ("agpl-3.0", "agpl 3 0", r"(?:gnu )?affero general public licen[sc]e(?: version 3| v3)?"),
    ("apache-1.1", "apache 1 1", r"apache (?:software )?licen[sc]e (?:version )?1 1"),
    ("apache-2.0", "apache 2 0", r"apache (?:software )?licen[sc]e (?:version |v)?2(?: 0)?"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e"),
    ("artistic-1.0", "artistic 1 0", r"artistic licen[sc]e (?:version )?1(?: 0)?"),
    ("artistic-2.0", "artistic 2 0", r"artistic licen[sc]e (?:version )?2(?: 0)?"),
    ("beerware", "beerware", r"beer ?ware licen[sc]e"),
    ("blueoak-1.0.0", "blueoak 1 0 0", r"blue oak model licen[sc]e"),
    ("bsd-2-clause", "bsd 2 clause", r"(?:simplified|freebsd|2 clause) bsd licen[sc]e|bsd 2 clause licen[sc]e"),
    ("bsd-3-clause", "bsd 3 clause", r"(?:modified|new|revised|3 clause) bsd licen[sc]e|bsd 3 clause licen[sc]e"),
    ("bsd-4-clause", "bsd 4 clause", r"(?:original|old|4 clause) bsd licen[sc]e|bsd 4 clause licen[sc]e"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("bsl-1.0", "bsl 1 0", r"boost software licen[sc]e"),
    ("busl-1.1", "busl 1 1", r"business source licen[sc]e"),
    ("cc-by-nc-nd", "cc by nc nd 4 0", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?derivatives|no derivs)(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc by nc sa 4 0", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)(?: [1-4] 0)?"),
    ("cc-by-nc", "cc by nc 4 0", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)(?: [1-4] 0)?"),
    ("cc-by-nd", "cc by nd 4 0", r"(?:cc|creative commons) (?:by|attribution) (?:nd|no ?derivatives|no derivs)(?: [1-4] 0)?"),
    ("cc-by-sa", "cc by sa 4 0", r"(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)(?: [1-4] 0)?"),
    ("cc-by", "cc by 4 0", r"(?:cc|creative commons) (?:by|attribution)(?: [1-4] 0)?"),
    ("cc0-1.0", "cc0 1 0", r"cc0(?: 1 0)?|creative commons zero"),
    ("cddl-1.0", "cddl 1 0", r"common development and distribution licen[sc]e"),
    ("cecill-2.1", "cecill 2 1", r"cecill(?: free software)? licen[sc]e"),
    ("cpl-1.0", "cpl 1 0", r"common public licen[sc]e"),
    ("ecl-2.0", "ecl 2 0", r"educational community licen[sc]e"),
    ("epl-1.0", "epl 1 0", r"eclipse public licen[sc]e (?:version |v)?1(?: 0)?"),
    ("epl-2.0", "epl 2 0", r"eclipse public licen[sc]e (?:version |v)?2(?: 0)?"),
    ("epl", "epl", r"eclipse public licen[sc]e"),
    ("eupl-1.2", "eupl 1 2", r"european union public licen[sc]e"),
    ("gfdl-1.3", "gfdl 1 3", r"(?:gnu )?free documentation licen[sc]e"),
    ("gpl-1.0", "gpl 1 0", r"(?:gnu )?general public licen[sc]e (?:version |v)1"),
    ("gpl-2.0", "gpl 2 0", r"(?:gnu )?general public licen[sc]e (?:version |v)2|gplv2"),
    ("gpl-3.0", "gpl 3 0", r"(?:gnu )?general public licen[sc]e (?:version |v)3|gplv3"),
    ("gpl", "gpl", r"gnu (?:general public licen[sc]e|gpl)"),
    ("hpnd", "hpnd", r"historical permission notice and disclaimer"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("lgpl-2.1", "lgpl 2 1", r"(?:gnu )?(?:lesser|library) general public licen[sc]e (?:version |v)2(?: 1)?"),
    ("lgpl-3.0", "lgpl 3 0", r"(?:gnu )?lesser general public licen[sc]e (?:version |v)3"),
    ("lgpl", "lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("lppl-1.3c", "lppl 1 3c", r"latex project public licen[sc]e"),
    ("mit-0", "mit 0", r"mit (?:no attribution|0) licen[sc]e|mit no attribution"),
    ("mit", "mit", r"(?:mit|expat|x11) licen[sc]e"),
    ("mpl-1.1", "mpl 1 1", r"mozilla public licen[sc]e (?:version |v)?1 1"),
    ("mpl-2.0", "mpl 2 0", r"mozilla public licen[sc]e (?:version |v)?2(?: 0)?"),
    ("mpl", "mpl", r"mozilla public licen[sc]e"),
    ("ms-pl", "ms pl", r"microsoft public licen[sc]e"),
    ("ms-rl", "ms rl", r"microsoft reciprocal licen[sc]e"),
    ("mulanpsl-2.0", "mulanpsl 2 0", r"mulan permissive software licen[sc]e"),
    ("ncsa", "ncsa", r"university of illinois ncsa open source licen[sc]e"),
    ("odbl-1.0", "odbl 1 0", r"open (?:data commons open )?database licen[sc]e"),
    ("odc-by-1.0", "odc by 1 0", r"open data commons attribution licen[sc]e"),
    ("ofl-1.1", "ofl 1 1", r"(?:sil )?open font licen[sc]e"),
    ("osl-3.0", "osl 3 0", r"open software licen[sc]e"),
    ("pddl-1.0", "pddl 1 0", r"public domain dedication and licen[sc]e"),
    ("php-3.01", "php 3 01", r"php licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("psf-2.0", "psf 2 0", r"python software foundation licen[sc]e"),
    ("qpl-1.0", "qpl 1 0", r"q public licen[sc]e"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("sspl-1.0", "sspl 1 0", r"server side public licen[sc]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("upl-1.0", "upl 1 0", r"universal permissive licen[sc]e"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("w3c", "w3c", r"w3c software(?: notice and)? licen[sc]e"),
    ("wtfpl", "wtfpl", r"do what the fuck you want to public licen[sc]e|wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("zpl-2.1", "zpl 2 1", r"zope public licen[sc]e"),
]

# How a licence is cited, with {name} for its name: form, priority, relevance, regex.
FORMS = [
    ("notice", 3, 1.0, r"(?:licen[sc]ed|released|distributed|published|available|provided|covered)(?: to you)? (?:under|by|with)(?: the)?(?: terms of)?(?: the)?(?: conditions of the)? (?:{name})"),
    ("subject", 3, 0.95, r"subject to(?: the)?(?: terms(?: and conditions)? of)?(?: the)? (?:{name})"),
    ("header", 3, 0.95, r"licen[sc]e (?:type |name )?(?:is )?(?:the )?(?:{name})"),
    ("name", 2, 0.8, r"(?:{name})"),
]

# Other signatures: id, priority, relevance, label, keyword, regex.
OTHERS = [
    ("all-rights", 3, 0.9, "proprietary", "reserved", r"all rights reserved"),
    ("confidential", 3, 0.9, "proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("copyright-line", 1, 0.3, "copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("public-domain", 3, 0.9, "public-domain", "domain", r"(?:in|into|to|released in|dedicated to) the public domain"),
    ("mit-grant", 3, 1.0, "mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc-grant", 3, 1.0, "isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-grant", 3, 1.0, "bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib-grant", 3, 1.0, "zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("boost-grant", 3, 1.0, "bsl-1.0", "hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("not-licensed", 4, 0.0, "", "licen", r"not (?:licen[sc]ed|released|covered) (?:under|by)(?: the)? (?:[^ ]+ ){0,6}?licen[sc]e"),
    ("driving", 4, 0.0, "", "licen", r"(?:driving|drivers?|fishing|hunting|marriage|liquor) licen[sc]es?"),
]

# The base phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"),
        ("cc by", "cc-by"), ("mit license", "mit")]


def _word_rule(regex: str) -> str:
    """Whole words only: the normalised text has a space on both ends."""
    return f"(?<= )(?:{regex})(?= )"


def _outside_groups(regex: str) -> list[str]:
    """The top-level alternatives of a regex without their parenthesised groups."""
    depth, out = 0, [""]
    for ch in regex:
        depth += (ch == "(") - (ch == ")")
        if depth == 0 and ch == "|":
            out.append("")
        elif depth == 0 and ch != ")":
            out[-1] += ch
        elif ch == ")":
            out[-1] += "~"
    return out


def _keyword(name: str) -> str:
    """A substring of every text that the name's regex matches ('': none known, the rule is always tried)."""
    parts = [set(re.findall(r"[a-z0-9]{3,}(?![a-z0-9?*\[])", x)) - {"public"} for x in _outside_groups(name)]
    common = set.intersection(*parts)
    if common:
        return max(sorted(common), key=len)
    return "licen" if all("licen[sc]e" in x for x in _outside_groups(name)) else ""


def rules() -> list[dict]:
    out = []

    def add(rule, priority, relevance, label, keyword, regex, base=False):
        out.append({"rule": rule, "priority": priority, "relevance": relevance, "label": label,
                    "keyword": keyword, "regex": _word_rule(regex), "base": base})

    for label, spdx, name in LICENCES:
        for form, priority, relevance, regex in FORMS:
            add(f"{label}/{form}", priority, relevance, label, _keyword(name), regex.format(name=name))
        add(f"{label}/spdx", 3, 1.0, label, "spdx", rf"spdx licen[sc]e identifier {spdx}(?: only| or later)?")
    for rule, priority, relevance, label, keyword, regex in OTHERS:
        add(rule, priority, relevance, label, keyword, regex)
    for phrase, label in BASE:
        add(f"base/{label}", 2, 0.7, label, phrase, phrase, base=True)
    return out
