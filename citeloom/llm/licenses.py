"""License scans by ordered signature rules.

Rules are regexes over the normalised words of a text. A rule runs only if its anchor and
its keyword occur. Overlapping detections are resolved by priority: one that lies within
the words of a kept detection of at least its priority is suppressed. A notice that something
is *not* under a license suppresses the detections within it and is none itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import in_python

# Base phrases with their labels.
BASE_PHRASES = (
    (b"mit license", "mit"),
    (b"apache license", "apache"),
    (b"general public license", "gpl"),
)

def _version(*numbers: str) -> str:
    """A version behind a name, as a word of its own or joined to it; "2" is not "2 1"."""
    found = [n if " " in n else rf"{n}(?! \d)" for n in numbers]
    return rf"(?: ?v(?:er(?:sion)?)? ?| ?)(?:{'|'.join(found)})"


_GPL = r"(?:gnu )?(?:gpl|general public licen[sc]e)"
_LGPL = r"(?:gnu )?(?:lgpl|(?:lesser|library) (?:gpl|general public licen[sc]e))"
_AGPL = r"(?:gnu )?(?:agpl|affero (?:gpl|general public licen[sc]e))"
_MPL = r"(?:mpl|mozilla public licen[sc]e)"
_EPL = r"(?:epl|eclipse public licen[sc]e)"
_CC = r"(?: ?v?\d(?: \d)?)?(?: (?:international|unported|generic))?"

# Names by label, as regexes over normalised words (letters and digits only, lower case).
NAMES = {
    "mit": r"(?:mit|expat)(?: x11)?",
    "mit-0": r"(?:mit 0|mit no attribution)",
    "x11": r"x11",
    "isc": r"isc",
    "apache": r"(?:apache(?: software)?|asl)",
    "apache-2.0": r"(?:apache(?: software)?(?: licen[sc]e)?|asl)" + _version("2 0", "2"),
    "apache-1.1": r"(?:apache(?: software)?(?: licen[sc]e)?|asl)" + _version("1 1"),
    "gpl": r"(?:gnu )?(?:gpl|general public)",
    "gpl-1.0": _GPL + _version("1 0", "1"),
    "gpl-2.0": _GPL + _version("2 0", "2"),
    "gpl-3.0": _GPL + _version("3 0", "3"),
    "lgpl": r"(?:gnu )?(?:lgpl|(?:lesser|library) general public)",
    "lgpl-2.0": _LGPL + _version("2 0", "2"),
    "lgpl-2.1": _LGPL + _version("2 1"),
    "lgpl-3.0": _LGPL + _version("3 0", "3"),
    "agpl": r"(?:gnu )?(?:agpl|affero general public)",
    "agpl-3.0": _AGPL + _version("3 0", "3"),
    "gfdl": r"(?:gnu )?(?:gfdl|fdl|free documentation)" + rf"(?:{_version('1 [123]')})?",
    "bsd": r"(?:bsd|berkeley software distribution)",
    "bsd-2": r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)",
    "bsd-3": r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)",
    "bsd-4": r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|(?:original|old) bsd)",
    "0bsd": r"(?:0bsd|zero clause bsd|bsd zero clause)",
    "mpl": r"(?:mpl|mozilla public)",
    "mpl-1.1": _MPL + _version("1 1"),
    "mpl-2.0": _MPL + _version("2 0", "2"),
    "epl": r"(?:epl|eclipse public)",
    "epl-1.0": _EPL + _version("1 0", "1"),
    "epl-2.0": _EPL + _version("2 0", "2"),
    "edl": r"(?:edl|eclipse distribution)(?: v?1 0)?",
    "cddl": r"(?:cddl|common development and distribution)(?: v?1 [01])?",
    "cpl": r"(?:cpl|common public)(?: v?1 0)?",
    "ipl": r"ibm public(?: v?1 0)?",
    "ms-pl": r"(?:ms pl|mspl|microsoft public)",
    "ms-rl": r"(?:ms rl|msrl|microsoft reciprocal)",
    "artistic": r"artistic",
    "artistic-2.0": r"artistic(?: licen[sc]e)?" + _version("2 0", "2"),
    "zlib": r"zlib(?: libpng)?",
    "libpng": r"libpng",
    "boost": r"(?:bsl 1 0|boost software)",
    "unlicense": r"(?:the )?unlicense",
    "wtfpl": r"(?:wtfpl|do what the fuck you want to public)",
    "postgresql": r"postgres(?:ql)?",
    "python": r"(?:psf|python(?: software foundation)?)(?: 2 0)?",
    "openssl": r"openssl",
    "php": r"php(?: v?3 01)?",
    "ruby": r"ruby",
    "ofl": r"(?:sil )?(?:ofl|open font)(?: 1 1)?",
    "eupl": r"(?:eupl|european union public)(?: v?1 [012])?",
    "ecl-2.0": r"(?:ecl|educational community)(?: v?2 0)?",
    "afl-3.0": r"(?:afl|academic free)(?: v?3 0)?",
    "osl-3.0": r"(?:osl|open software)(?: v?3 0)?",
    "qpl": r"(?:qpl|q public)(?: 1 0)?",
    "sleepycat": r"sleepycat",
    "ncsa": r"(?:ncsa|university of illinois)(?: open source)?",
    "upl": r"(?:upl 1 0|universal permissive)",
    "vim": r"vim",
    "w3c": r"w3c(?: software)?",
    "bsl-1.1": r"(?:busl 1 1|business source)(?: 1 1)?",
    "sspl": r"(?:sspl|server side public)(?: v?1(?: 0)?)?",
    "elastic-2.0": r"elastic(?: licen[sc]e)? (?:v(?:ersion)? ?)?2(?: 0)?",
    "cc0": r"(?:cc ?0|creative commons (?:zero|0))(?: 1 0)?(?: universal)?",
    "cc-by": r"(?:cc by|creative commons attribution)" + _CC,
    "cc-by-sa": r"(?:cc by sa|creative commons attribution share ?alike)" + _CC,
    "cc-by-nc": r"(?:cc by nc|creative commons attribution non ?commercial)" + _CC,
    "cc-by-nd": r"(?:cc by nd|creative commons attribution no ?deriv[a-z]*)" + _CC,
    "cc-by-nc-sa": r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)" + _CC,
    "cc-by-nc-nd": r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv[a-z]*)" + _CC,
    "odbl": r"(?:odbl|open database)(?: 1 0)?",
    "odc-by": r"(?:odc by|open data commons attribution)(?: 1 0)?",
    "pddl": r"(?:pddl|public domain dedication)(?: 1 0)?",
}

# What a text must hold for a name to occur, by the start of its label.
_KEYS = {
    "mit": "mit|expat", "x11": "x11", "isc": "isc", "apache": "apache|asl", "gpl": "gpl|general public",
    "lgpl": "lgpl|lesser|library", "agpl": "agpl|affero", "gfdl": "fdl|documentation",
    "bsd": "bsd|berkeley", "0bsd": "bsd", "mpl": "mpl|mozilla", "epl": "epl|eclipse", "edl": "edl|eclipse",
    "cddl": "cddl|common development", "cpl": "cpl|common public", "ipl": "ibm", "ms": "ms|microsoft",
    "artistic": "artistic", "zlib": "zlib", "libpng": "libpng", "boost": "bsl|boost",
    "unlicense": "unlicense", "wtfpl": "wtfpl|fuck", "postgresql": "postgres", "python": "psf|python",
    "openssl": "openssl", "php": "php", "ruby": "ruby", "ofl": "ofl|open font",
    "eupl": "eupl|european", "ecl": "ecl|educational", "afl": "afl|academic free", "osl": "osl|open software",
    "qpl": "qpl|q public", "sleepycat": "sleepycat", "ncsa": "ncsa|illinois", "upl": "upl|universal permissive",
    "vim": "vim", "w3c": "w3c", "bsl": "busl|business source", "sspl": "sspl|server side",
    "elastic": "elastic", "cc0": "cc|creative commons", "cc": "cc by|creative commons", "odbl": "odbl|open database",
    "odc": "odc|open data", "pddl": "pddl|public domain",
}

_LIC = r"(?: licen[sc]es?)?"
_LATER = r"(?: only| or (?:at your option )?(?:any )?later(?: version)?)?"
_GIVEN = r"(?:licen[sc]ed|released|distributed|available|provided|published|redistributed|offered|covered|governed)"

#: A rule of this label suppresses what lies within it and adds no label of its own.
NEGATED = ""

# (rule name, priority, anchor that must occur, regex around a license name), best first.
PHRASES = (
    ("negated", 110, "not ", r"(?:not|no longer|never) (?:be |been )?" + _GIVEN
     + r" under (?:the )?(?:terms of )?(?:the )?{name}" + _LIC),
    ("spdx", 100, "spdx", r"spdx license identifier {name}" + _LATER),
    ("licensed", 90, "under",
     r"(?:is |are )?(?:dual |multi )?licen[sc]ed (?:under|with|by) (?:the )?(?:terms of )?(?:the |an? )?{name}"
     + _LIC + r"(?: v(?:ersion)? ?\d(?: \d)?)?" + _LATER),
    ("released", 80, "under",
     r"(?:released|distributed|available|provided|published|redistributed|offered|covered|governed)"
     r" (?:under|by) (?:the )?(?:terms of )?(?:the |an? )?{name}" + _LIC + r"(?: v(?:ersion)? ?\d(?: \d)?)?"),
    ("terms", 70, "terms", r"(?:under )?(?:the )?terms (?:and conditions )?of (?:the )?{name}" + _LIC),
    ("versioned", 60, "licen", r"{name} licen[sc]e v(?:ersion)? ?\d(?: \d)?"),
    ("field", 55, "licen", r"licen[sc]es?(?: type| name| id| is)? {name}" + _LATER),
    ("named", 40, "licen", r"{name} licen[sc]e" + _LATER),
)

# Names that stand for themselves wherever they occur, by label: (priority, anchor, regex).
BARE = {
    "mit": ((39, "mit or", r"mit or (?:apache|bsd|gpl|lgpl|isc|zlib|unlicense|cc0|mpl)"),
            (39, "or mit", r"(?:apache 2 0|clause|only|later|isc|zlib|unlicense|mpl 2 0|cc0 1 0) or mit"),
            (39, "and mit", r"(?:apache 2 0|clause|only|later|isc|zlib) and mit"),
            (39, "mit and", r"mit and (?:apache 2 0|bsd \d clause|isc|zlib|ofl 1 1)"),
            (38, "mit expat", r"mit expat"), (38, "mit x11", r"mit x11")),
    "mit-0": ((39, "mit 0", r"mit 0"),),
    "apache-2.0": ((39, "apache", r"apache(?: licen[sc]e)?(?: v(?:ersion)? ?| )2 0"),
                   (38, "apache", r"apache ?v?2"), (38, "asl", r"asl ?v?2(?: 0)?")),
    "apache-1.1": ((39, "apache", r"apache(?: licen[sc]e)?(?: v(?:ersion)? ?| )1 1"),),
    "gpl-1.0": ((39, "gpl", r"gpl 1 0" + _LATER),),
    "gpl-2.0": ((39, "gpl", r"gpl 2 0" + _LATER), (38, "gpl", r"gpl ?v ?2(?: 0)?" + _LATER), (38, "gpl2", r"gpl2"),
                (39, "classpath", r"gpl 2 0 with classpath exception(?: 2 0)?"),
                (38, "general public", r"general public licen[sc]e v(?:ersion)? ?2" + _LATER)),
    "gpl-3.0": ((39, "gpl", r"gpl 3 0" + _LATER), (38, "gpl", r"gpl ?v ?3(?: 0)?" + _LATER), (38, "gpl3", r"gpl3"),
                (38, "general public", r"general public licen[sc]e v(?:ersion)? ?3" + _LATER)),
    "lgpl-2.0": ((39, "lgpl", r"lgpl 2 0" + _LATER), (38, "lgpl", r"lgpl ?v ?2(?: 0|(?! \d))" + _LATER)),
    "lgpl-2.1": ((39, "lgpl", r"lgpl 2 1" + _LATER), (38, "lgpl", r"lgpl ?v ?2 1" + _LATER)),
    "lgpl-3.0": ((39, "lgpl", r"lgpl 3 0" + _LATER), (38, "lgpl", r"lgpl ?v ?3(?: 0)?" + _LATER)),
    "agpl-3.0": ((39, "agpl", r"agpl 3 0" + _LATER), (38, "agpl", r"agpl ?v ?3(?: 0)?" + _LATER)),
    "gfdl": ((39, "gfdl", r"gfdl 1 [123]" + _LATER),),
    "bsd-2": ((39, "clause", r"bsd 2 clause(?: patent| views)?"), (38, "clause", r"(?:2|two) clause bsd")),
    "bsd-3": ((39, "clause", r"bsd 3 clause(?: clear| attribution)?"), (38, "clause", r"(?:3|three) clause bsd")),
    "bsd-4": ((39, "clause", r"bsd 4 clause"), (38, "clause", r"(?:4|four) clause bsd")),
    "0bsd": ((39, "0bsd", r"0bsd"),),
    "mpl-1.1": ((39, "mpl", r"mpl ?v? ?1 1"),),
    "mpl-2.0": ((39, "mpl", r"mpl 2 0"), (38, "mpl", r"mpl ?v ?2(?: 0)?"), (38, "mpl2", r"mpl2")),
    "epl-1.0": ((39, "epl", r"epl ?v? ?1 0"),),
    "epl-2.0": ((39, "epl", r"epl ?v? ?2 0"),),
    "cddl": ((39, "cddl", r"cddl ?v? ?1 [01]"),),
    "artistic-2.0": ((39, "artistic", r"artistic 2 0"),),
    "boost": ((39, "bsl", r"bsl 1 0"),),
    "zlib": ((38, "zlib", r"zlib libpng licen[sc]e"),),
    "wtfpl": ((39, "wtfpl", r"wtfpl"),),
    "unlicense": ((38, "unlicense", r"the unlicense"),),
    "ofl": ((39, "ofl", r"ofl 1 1"),),
    "eupl": ((39, "eupl", r"eupl ?v? ?1 [012]"),),
    "upl": ((39, "upl", r"upl 1 0"),),
    "sspl": ((39, "sspl", r"sspl ?v? ?1(?: 0)?"),),
    "bsl-1.1": ((39, "busl", r"busl 1 1"),),
    "cc0": ((39, "cc0", r"cc0(?: 1 0)?(?: universal)?"),),
    "cc-by": ((39, "cc by", r"cc by \d 0"),),
    "cc-by-sa": ((39, "cc by", r"cc by sa(?: \d 0)?"),),
    "cc-by-nc": ((39, "cc by", r"cc by nc(?: \d 0)?"),),
    "cc-by-nd": ((39, "cc by", r"cc by nd(?: \d 0)?"),),
    "cc-by-nc-sa": ((39, "cc by", r"cc by nc sa(?: \d 0)?"),),
    "cc-by-nc-nd": ((39, "cc by", r"cc by nc nd(?: \d 0)?"),),
    "odbl": ((39, "odbl", r"odbl 1 0"),),
    "pddl": ((39, "pddl", r"pddl 1 0"),),
}

# (label, priority, anchor, regex): sentences and titles of license texts and file headers.
SENTENCES = (
    ("mit", 95, "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 85, "the above copyright", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", 70, "without limitation", r"without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("isc", 95, "permission", r"permission to use copy modify and (?:or )?distribute this software for any purpose"),
    ("x11", 85, "x consortium", r"the name of the x consortium shall not be used in advertising"),
    ("bsd", 85, "redistribution", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd", 75, "redistributions", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice"),
    ("bsd-3", 90, "endorse", r"neither the names? of .{0,200}? may be used to endorse or promote products"),
    ("bsd-4", 90, "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", 70, "bsd style", r"bsd style licen[sc]e"),
    ("bsd", 70, "use of this source", r"use of this source code is governed by an? bsd style licen[sc]e"),
    ("mit", 72, "use of this source", r"use of this source code is governed by an? mit style licen[sc]e"),
    ("mit", 72, "mit style", r"mit style licen[sc]e"),
    ("gpl", 95, "free software", r"is free software you can redistribute it and or modify it"),
    ("gpl", 90, "general public", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation"),
    ("lgpl", 92, "general public", r"under the terms of the gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation"),
    ("agpl", 92, "general public", r"under the terms of the gnu affero general public licen[sc]e as published by the free software foundation"),
    ("gpl", 80, "you should have received", r"you should have received a copy of the gnu general public licen[sc]e"),
    ("lgpl", 82, "you should have received", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", 82, "you should have received", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("gpl-2.0", 91, "either version", r"either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0", 91, "either version", r"either version 3 of the licen[sc]e or at your option any later version"),
    ("lgpl-2.1", 91, "either version", r"either version 2 1 of the licen[sc]e or at your option any later version"),
    ("gpl-2.0", 60, "june 1991", r"gnu general public licen[sc]e version 2 june 1991"),
    ("gpl-3.0", 60, "june 2007", r"gnu general public licen[sc]e version 3 29 june 2007"),
    ("lgpl-3.0", 62, "june 2007", r"gnu lesser general public licen[sc]e version 3 29 june 2007"),
    ("lgpl-2.1", 62, "february 1999", r"gnu lesser general public licen[sc]e version 2 1 february 1999"),
    ("agpl-3.0", 62, "november 2007", r"gnu affero general public licen[sc]e version 3 19 november 2007"),
    ("gpl", 45, "copyleft", r"copyleft licen[sc]e"),
    ("gfdl", 90, "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("apache-2.0", 95, "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", 75, "january 2004", r"apache licen[sc]e version 2 0 january 2004"),
    ("apache-2.0", 70, "licenses license 2 0", r"(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache", 75, "contributor license", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", 80, "apache software", r"this product includes software developed by the apache software foundation"),
    ("mpl-2.0", 95, "source code form", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-1.1", 90, "contents of this file", r"the contents of this file are subject to the mozilla public licen[sc]e"),
    ("mpl-2.0", 70, "mozilla org", r"mozilla org mpl 2 0"),
    ("cddl", 90, "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("epl", 90, "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("boost", 95, "boost software", r"distributed under the boost software licen[sc]e"),
    ("zlib", 90, "freely", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib", 80, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("openssl", 90, "openssl project", r"this product includes software developed by the openssl project"),
    ("python", 85, "python software", r"python software foundation licen[sc]e version 2"),
    ("ofl", 90, "font software", r"this font software is licensed under the sil open font licen[sc]e"),
    ("wtfpl", 90, "do what", r"you just do what the fuck you want to"),
    ("unlicense", 95, "unencumbered", r"free and unencumbered software released into the public domain"),
    ("cc0", 85, "waived", r"waived all copyright and related or neighboring rights"),
    ("cc-by", 75, "creativecommons", r"creativecommons org licenses by \d 0"),
    ("cc-by-sa", 75, "creativecommons", r"creativecommons org licenses by sa \d 0"),
    ("cc-by-nc", 75, "creativecommons", r"creativecommons org licenses by nc \d 0"),
    ("cc-by-nd", 75, "creativecommons", r"creativecommons org licenses by nd \d 0"),
    ("cc-by-nc-sa", 75, "creativecommons", r"creativecommons org licenses by nc sa \d 0"),
    ("cc-by-nc-nd", 75, "creativecommons", r"creativecommons org licenses by nc nd \d 0"),
    ("cc0", 75, "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("creative-commons", 40, "creative commons", r"creative commons licen[sc]e"),
    ("creative-commons", 35, "some rights", r"some rights reserved"),
    ("public-domain", 65, "public domain", r"(?:this work|this file|this software|it) (?:is|has been placed) (?:in|into) the public domain"),
    ("public-domain", 60, "public domain", r"(?:in|into|to) the public domain"),
    ("public-domain", 50, "public domain", r"public domain"),
    ("proprietary", 70, "rights reserved", r"copyright (?:c )?\d{4}(?: \d{4})? .{0,100}? all rights reserved"),
    ("proprietary", 50, "rights reserved", r"all rights reserved"),
    ("proprietary", 60, "confidential", r"proprietary and confidential"),
    ("proprietary", 60, "confidential", r"confidential and proprietary"),
    ("proprietary", 60, "trade secret", r"trade secrets? of"),
    ("proprietary", 60, "redistribut", r"not (?:be )?redistribut(?:ed|able)"),
    ("proprietary", 60, "unauthori", r"unauthori[sz]ed (?:copying|use|distribution|reproduction)"),
    ("proprietary", 60, "written permission", r"without (?:the )?(?:prior |express )?written permission"),
    ("proprietary", 45, "commercial licen", r"commercial licen[sc]e"),
    ("proprietary", 45, "end user licen", r"end user licen[sc]e agreement"),
    ("non-commercial", 60, "commercial use", r"(?:for )?non ?commercial use only"),
    ("non-commercial", 60, "commercial purposes", r"not (?:be used )?for commercial purposes"),
    ("research-only", 60, "research", r"(?:for )?(?:academic|research)(?: and \w+)? (?:use|purposes) only"),
    ("evaluation", 60, "evaluation", r"(?:for )?evaluation purposes only"),
    ("freeware", 50, "freeware", r"freeware"),
    ("shareware", 50, "shareware", r"shareware"),
    ("warranty", 40, "warranty", r"(?:provided )?as is without warranty of any kind"),
    ("warranty", 35, "warranties", r"without warranties or conditions of any kind"),
    ("warranty", 30, "warranty", r"without warranty of any kind"),
    ("warranty", 30, "warranty", r"without any warranty"),
    ("warranty", 30, "warranty", r"implied warranty of merchantability"),
    ("warranty", 30, "liable", r"in no event shall .{0,120}? be liable"),
    ("warranty", 30, "as is", r"provided as is"),
    ("copyright", 25, "copyright", r"copyright (?:c )?\d{4}(?: \d{4})?"),
    ("copyright", 20, "copyright", r"copyright (?:c )?(?:by |the )"),
)


class Rule(NamedTuple):
    name: str
    label: str
    priority: int
    anchor: bytes
    keywords: tuple[bytes, ...]  # one of them must occur
    pattern: re.Pattern


def rules() -> list[Rule]:
    """All rules, best first: bare names, every phrase around every name, and the sentences."""

    def whole(body: str) -> re.Pattern:
        return re.compile(rf"(?<![^ ]){body}(?![^ ])".encode())

    made = [
        Rule(
            f"{kind}:{label}", NEGATED if kind == "negated" else label, priority, anchor.encode(),
            tuple(_KEYS[label.split("-")[0]].encode().split(b"|")), whole(body.replace("{name}", name)),
        )
        for kind, priority, anchor, body in PHRASES
        for label, name in NAMES.items()
    ]
    made += [
        Rule(f"bare:{label}:{i}", label, priority, anchor.encode(), (anchor.encode(),), whole(body))
        for label, found in BARE.items()
        for i, (priority, anchor, body) in enumerate(found)
    ]
    made += [
        Rule(f"sentence:{i}", label, priority, anchor.encode(), (anchor.encode(),), whole(body))
        for i, (label, priority, anchor, body) in enumerate(SENTENCES)
    ]
    return sorted(made, key=lambda r: (-r.priority, r.name))


# Everything but letters, digits and non-ASCII bytes separates words; A-Z is folded.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)
_BASE = [(re.compile(rb"(?<![^ ])" + phrase + rb"(?![^ ])"), label) for phrase, label in BASE_PHRASES]


def detect(joined: bytes, ordered: list[Rule]) -> list[tuple[str, str, int, int, int]]:
    """Kept detections (rule, label, priority, first word, word after), in rule order.

    ``joined`` are the words of one text with single spaces between. A detection goes if a
    kept one of an earlier rule contains it: of those that start no later, one ends no
    sooner. The matches of one rule do not overlap, so a rule is settled at once, against
    the running furthest end of the kept ones by start.
    """
    there: dict[bytes, bool] = {}

    def occurs(text: bytes) -> bool:
        if text not in there:
            there[text] = text in joined
        return there[text]

    kept: list[tuple[str, str, int, int, int]] = []
    blanks = None
    starts = furthest = np.empty(0, np.int64)
    for rule in ordered:
        if not (occurs(rule.anchor) and any(map(occurs, rule.keywords))):
            continue
        spans = [m.span() for m in rule.pattern.finditer(joined)]
        if not spans:
            continue
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        # A word's number is the number of blanks before it.
        first, after = np.searchsorted(blanks, np.array(spans)).T
        after = after + 1
        if len(starts):
            at = np.searchsorted(starts, first, side="right")
            fresh = (at == 0) | (furthest[at - 1] < after)
            first, after = first[fresh], after[fresh]
        if not len(first):
            continue
        kept += [(rule.name, rule.label, rule.priority, a, b) for a, b in zip(first.tolist(), after.tolist())]
        starts, ends = np.append(starts, first), np.append(furthest, after)
        order = np.argsort(starts, kind="stable")
        starts, furthest = starts[order], np.maximum.accumulate(ends[order])
    return kept


def _narrowest_first(ordered: list[Rule]) -> list[Rule]:
    """Within a priority, rules of the more specific (longer) names first."""
    return sorted(ordered, key=lambda r: (-r.priority, -len(r.label), r.name))


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string,"
    " labels string, score double, detections array<struct<rule:string, label:string,"
    " priority:int, first_word:long, word_after:long>>"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
    ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()),
    ("detections", pa.list_(pa.struct([
        ("rule", pa.string()), ("label", pa.string()), ("priority", pa.int32()),
        ("first_word", pa.int64()), ("word_after", pa.int64()),
    ]))),
])


def _ends(starts: list[int]) -> tuple[int | None, int | None]:
    return min(starts, default=None), max(starts, default=None)


def scan_text(text: bytes, ordered: list[Rule]) -> dict:
    """All columns but doc_id for one text."""
    words = text.translate(_FOLD).split()
    joined = b" ".join(words)
    starts, base = [], set()
    for pattern, label in _BASE if b"license" in joined else ():
        at = [m.start() for m in pattern.finditer(joined)]
        starts += at
        base |= {label} if at else set()
    first, last = (joined.count(b" ", 0, at) if at is not None else None for at in _ends(starts))
    kept = [k for k in detect(joined, ordered) if k[1] != NEGATED]
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": first,
        "last_word": last,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {k[1] for k in kept})),
        "score": max((k[2] for k in kept), default=0) / 100,
        "detections": [dict(zip(("rule", "label", "priority", "first_word", "word_after"), k)) for k in kept],
    }


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per input row: base phrase places, labels, score and the kept detections.

    ``score`` is the priority of the strongest kept detection, as a share of 100. Null and
    empty texts have no words, no labels (empty strings) and score 0. Null and repeated
    doc_ids are kept as they are, an empty table gives no rows, other columns are ignored.
    Each text is read whole by one narrow pass; nothing is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = _narrowest_first(rules())
        for batch in batches:
            ids, texts = (batch.column(i) for i in range(2))
            rows = [
                {"doc_id": i, **scan_text(t or b"", ordered)}
                for i, t in zip(ids.to_pylist(), texts.to_pylist())
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return in_python(read, scan, SCHEMA)
