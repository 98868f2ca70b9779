"""Signature rules of the license scan.

Texts are matched after normalisation to lower-case words joined by single
spaces, so every pattern is written over words: ``gpl 2 0`` for "GPL-2.0".
A rule is (label, priority, keyword, pattern). The keyword is a word that any
match contains; rules whose keyword a text lacks are never tried on it.
Priorities: 3 = license notice or identifier, 2 = named license with a
version or an unmistakable sentence, 1 = a bare mention.
"""

from __future__ import annotations

#: label | keyword | the license's name as words (a pattern) | identifiers as words (a pattern)
FAMILIES = """
gpl-1.0|general|gnu general public licen[sc]e (?:version |v )?1(?: 0)?|gpl v?1(?: 0)?(?: only| or later)?
gpl-2.0|general|gnu general public licen[sc]e (?:version |v )?2(?: 0)?|gpl ?v?2(?: 0)?(?: only| or later)?
gpl-3.0|general|gnu general public licen[sc]e (?:version |v )?3(?: 0)?|gpl ?v?3(?: 0)?(?: only| or later)?
lgpl-2.0|library|gnu library general public licen[sc]e(?: version 2(?: 0)?)?|lgpl ?v?2(?: 0)?(?: only| or later)?
lgpl-2.1|lesser|gnu lesser general public licen[sc]e (?:version |v )?2 1|lgpl ?v?2 1(?: only| or later)?
lgpl-3.0|lesser|gnu lesser general public licen[sc]e (?:version |v )?3(?: 0)?|lgpl ?v?3(?: 0)?(?: only| or later)?
agpl-3.0|affero|gnu affero general public licen[sc]e(?: (?:version |v )?3(?: 0)?)?|agpl ?v?3(?: 0)?(?: only| or later)?
gfdl-1.3|documentation|gnu free documentation licen[sc]e(?: version 1 [123])?|gfdl 1 [123](?: only| or later)?
apache-1.1|apache|apache (?:software )?licen[sc]e (?:version |v )?1 [01]|apache 1 [01]
apache-2.0|apache|apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?|apache 2 0
mit-0|mit|mit no attribution(?: licen[sc]e)?|mit 0
mit|mit|(?:the )?mit x11 licen[sc]e|mit
bsd-2-clause|bsd|(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[sc]e|bsd 2 clause
bsd-3-clause|bsd|(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[sc]e|bsd 3 clause
bsd-4-clause|bsd|(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd) licen[sc]e|bsd 4 clause
0bsd|bsd|(?:zero clause bsd|bsd zero clause|0 clause bsd) licen[sc]e|0bsd
isc|isc|isc licen[sc]e|isc
mpl-1.1|mozilla|mozilla public licen[sc]e (?:version |v )?1 [01]|mpl 1 [01]
mpl-2.0|mozilla|mozilla public licen[sc]e (?:version |v )?2(?: 0)?|mpl 2 0
epl-1.0|eclipse|eclipse public licen[sc]e (?:version |v )?1(?: 0)?|epl 1 0
epl-2.0|eclipse|eclipse public licen[sc]e (?:version |v )?2(?: 0)?|epl 2 0
edl-1.0|eclipse|eclipse distribution licen[sc]e(?: (?:version |v )?1(?: 0)?)?|edl 1 0
cddl-1.0|distribution|common development and distribution licen[sc]e(?: (?:version |v )?1 [01])?|cddl 1 [01]
cpl-1.0|common|common public licen[sc]e(?: (?:version |v )?1(?: 0)?)?|cpl 1 0
ipl-1.0|ibm|ibm public licen[sc]e(?: (?:version |v )?1(?: 0)?)?|ipl 1 0
artistic-1.0|artistic|artistic licen[sc]e (?:version |v )?1(?: 0)?|artistic 1 0
artistic-2.0|artistic|artistic licen[sc]e (?:version |v )?2(?: 0)?|artistic 2 0
bsl-1.0|boost|boost software licen[sc]e(?: (?:version |v )?1(?: 0)?)?|bsl 1 0
busl-1.1|business|business source licen[sc]e(?: (?:version |v )?1 1)?|busl 1 1
sspl-1.0|side|server side public licen[sc]e(?: (?:version |v )?1)?|sspl 1 0
elastic-2.0|elastic|elastic licen[sc]e(?: (?:version |v )?2(?: 0)?)?|elastic 2 0
zlib|zlib|(?:zlib libpng|zlib) licen[sc]e|zlib
libpng|libpng|libpng licen[sc]e(?: version 2)?|libpng(?: 2 0)?
unlicense|unlicense|(?:the )?unlicense|unlicense
wtfpl|want|do what the fuck you want to public licen[sc]e|wtfpl
cc0-1.0|commons|creative commons zero(?: v?1(?: 0)?)?(?: universal)?|cc0 1 0
cc-by-1.0|commons|creative commons attribution 1 0(?: generic)?|cc by 1 0
cc-by-2.0|commons|creative commons attribution 2 0(?: generic)?|cc by 2 0
cc-by-2.5|commons|creative commons attribution 2 5(?: generic)?|cc by 2 5
cc-by-3.0|commons|creative commons attribution 3 0(?: unported)?|cc by 3 0
cc-by-4.0|commons|creative commons attribution 4 0(?: international)?|cc by 4 0
cc-by-sa-2.0|commons|creative commons attribution share ?alike 2 [05](?: generic)?|cc by sa 2 [05]
cc-by-sa-3.0|commons|creative commons attribution share ?alike 3 0(?: unported)?|cc by sa 3 0
cc-by-sa-4.0|commons|creative commons attribution share ?alike 4 0(?: international)?|cc by sa 4 0
cc-by-nc-3.0|commons|creative commons attribution non ?commercial 3 0(?: unported)?|cc by nc 3 0
cc-by-nc-4.0|commons|creative commons attribution non ?commercial 4 0(?: international)?|cc by nc 4 0
cc-by-nd-4.0|commons|creative commons attribution no ?derivatives 4 0(?: international)?|cc by nd 4 0
cc-by-nc-sa-4.0|commons|creative commons attribution non ?commercial share ?alike 4 0(?: international)?|cc by nc sa [34] 0
cc-by-nc-nd-4.0|commons|creative commons attribution non ?commercial no ?derivatives 4 0(?: international)?|cc by nc nd [34] 0
odbl-1.0|database|open database licen[sc]e(?: (?:version |v )?1(?: 0)?)?|odbl 1 0
odc-by-1.0|commons|open data commons attribution licen[sc]e(?: v?1 0)?|odc by 1 0
pddl-1.0|domain|(?:open data commons )?public domain dedication and licen[sc]e|pddl 1 0
python-2.0|python|python software foundation licen[sc]e(?: (?:version |v )?2(?: 0)?)?|(?:psf|python) 2 0
php-3.01|php|php licen[sc]e(?: (?:version |v )?3 01)?|php 3 01
ruby|ruby|ruby licen[sc]e|ruby
postgresql|postgresql|postgresql licen[sc]e|postgresql
openssl|openssl|openssl licen[sc]e|openssl
ssleay|ssleay|original ssleay licen[sc]e|ssleay
curl|curl|curl licen[sc]e|curl
x11|x11|x11 licen[sc]e|x11
ncsa|illinois|university of illinois ncsa open source licen[sc]e|ncsa
ofl-1.1|font|sil open font licen[sc]e(?: (?:version |v )?1 [01])?|ofl 1 [01]
upl-1.0|universal|universal permissive licen[sc]e(?: (?:version |v )?1(?: 0)?)?|upl 1 0
eupl-1.2|union|european union public licen[sc]e(?: (?:version |v )?1 [12])?|eupl 1 [12]
cecill-2.1|cecill|cecill (?:free software )?licen[sc]e(?: agreement)?|cecill 2 [01]
ms-pl|microsoft|microsoft public licen[sc]e|ms pl
ms-rl|microsoft|microsoft reciprocal licen[sc]e|ms rl
apsl-2.0|apple|apple public source licen[sc]e(?: (?:version |v )?2(?: 0)?)?|apsl 2 0
osl-3.0|open|open software licen[sc]e(?: (?:version |v )?3(?: 0)?)?|osl 3 0
afl-3.0|academic|academic free licen[sc]e(?: (?:version |v )?3(?: 0)?)?|afl 3 0
ecl-2.0|educational|educational community licen[sc]e(?: (?:version |v )?2(?: 0)?)?|ecl 2 0
mulanpsl-2.0|mulan|mulan permissive software licen[sc]e(?: (?:version |v )?2(?: 0)?)?|mulanpsl 2 0
lppl-1.3|latex|latex project public licen[sc]e(?: (?:version |v )?1 3[ac]?)?|lppl 1 3[ac]?
vim|vim|vim licen[sc]e|vim
w3c|w3c|w3c software notice and licen[sc]e|w3c
zpl-2.1|zope|zope public licen[sc]e(?: (?:version |v )?2 [01])?|zpl 2 [01]
sleepycat|sleepycat|sleepycat licen[sc]e|sleepycat
beerware|beerware|beerware licen[sc]e|beerware
json|json|json licen[sc]e|json
icu|icu|icu licen[sc]e|icu
hpnd|historical|historical permission notice and disclaimer|hpnd
ftl|freetype|freetype (?:project )?licen[sc]e|ftl
imagemagick|imagemagick|imagemagick licen[sc]e|imagemagick
ijg|jpeg|independent jpeg group licen[sc]e|ijg
qpl-1.0|q|q public licen[sc]e(?: version 1 0)?|qpl 1 0
nposl-3.0|profit|non profit open software licen[sc]e(?: 3 0)?|nposl 3 0
rpl-1.5|reciprocal|reciprocal public licen[sc]e(?: 1 5)?|rpl 1 5
polyform-nc-1.0|polyform|polyform noncommercial licen[sc]e(?: 1 0 0)?|polyform noncommercial 1 0 0
openrail|responsible|(?:open responsible ai|responsible ai) licen[sc]e|openrail
"""

#: label | priority | keyword | sentence pattern: notices and bodies known by their wording
SENTENCES = """
mit|3|permission|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|3|sublicense|to use copy modify merge publish distribute sublicense and or sell copies
isc|3|permission|permission to use copy modify and or distribute this software for any purpose
cc0-1.0|2|cc0|cc0(?: 1 0)?(?: universal)?
python-2.0|2|psf|psf licen[sc]e
bsd|3|redistribution|redistribution and use in source and binary forms with or without modification
bsd-3-clause|3|endorse|neither the name of .{1,80}? nor the names of its contributors may be used to endorse
bsd-2-clause|2|freebsd|freebsd licen[sc]e
bsd-2-clause|3|licensed|licensed under (?:the )?(?:terms of )?(?:the )?freebsd licen[sc]e
bsd-2-clause|2|redistributions|redistributions in binary form must reproduce the above copyright notice
apache-2.0|3|apache|licensed under the apache licen[sc]e version 2 0
apache-2.0|3|compliance|you may not use this file except in compliance with the licen[sc]e
gpl-2.0|3|redistribute|you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e(?: as published by the free software foundation)? (?:either )?version 2
gpl-3.0|3|redistribute|you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e(?: as published by the free software foundation)? (?:either )?version 3
lgpl-2.1|3|redistribute|you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e(?: as published by the free software foundation)? (?:either )?version 2 1
gpl|2|warranty|but without any warranty without even the implied warranty of merchantability or fitness
gpl|2|foundation|published by the free software foundation
mpl-2.0|3|mozilla|subject to the terms of the mozilla public licen[sc]e v 2 0
zlib|3|altered|altered source versions must be plainly marked as such
zlib|2|origin|the origin of this software must not be misrepresented
unlicense|3|unencumbered|this is free and unencumbered software released into the public domain
public-domain|2|domain|(?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain|1|domain|public domain
cc-by-4.0|3|creativecommons|creativecommons org licenses by 4 0
cc-by-3.0|3|creativecommons|creativecommons org licenses by 3 0
cc-by-sa-4.0|3|creativecommons|creativecommons org licenses by sa 4 0
cc-by-sa-3.0|3|creativecommons|creativecommons org licenses by sa 3 0
cc-by-nc-4.0|3|creativecommons|creativecommons org licenses by nc 4 0
cc-by-nd-4.0|3|creativecommons|creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0|3|creativecommons|creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0|3|creativecommons|creativecommons org licenses by nc nd 4 0
cc0-1.0|3|creativecommons|creativecommons org publicdomain zero 1 0
gpl-2.0|3|gnu|gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0|3|gnu|gnu org licenses gpl 3 0
apache-2.0|3|apache|apache org licenses license 2 0
mit|3|opensource|opensource org licenses mit
cc-by|1|cc|cc by
cc-by-sa|1|cc|cc by sa
cc-by-nc|1|cc|cc by nc
cc-by-nd|1|cc|cc by nd
cc-by-nc-sa|1|cc|cc by nc sa
cc-by-nc-nd|1|cc|cc by nc nd
cc|1|commons|creative commons(?: attribution)?(?: licen[sc]e)?
gpl|1|general|gnu general public licen[sc]e
lgpl|1|lesser|gnu lesser general public licen[sc]e
agpl|1|affero|affero general public licen[sc]e
gpl|1|gpl|gpl
lgpl|1|lgpl|lgpl
agpl|1|agpl|agpl
apache|1|apache|apache (?:software )?licen[sc]e
mit|1|mit|mit licen[sc]e
bsd|1|bsd|bsd licen[sc]e
mpl|1|mozilla|mozilla public licen[sc]e
epl|1|eclipse|eclipse public licen[sc]e
artistic|1|artistic|artistic licen[sc]e
proprietary|2|reserved|all rights reserved
proprietary|2|confidential|proprietary and confidential
proprietary|2|redistribution|redistribution (?:in any form )?is (?:strictly )?prohibited
commercial|2|commercial|commercial licen[sc]e
non-commercial|2|commercial|for non commercial use only
non-commercial|2|noncommercial|for noncommercial use only
"""


def rules() -> list[tuple[str, int, str, str]]:
    """All rules, highest priority first; each family gives its name, its
    identifier tag and its "licensed under" notice."""
    out = []
    for line in FAMILIES.strip().split("\n"):
        label, key, name, tag = line.split("|", 3)
        # alternations hold "|" too: the tag starts after the last bar outside brackets
        body = line.split("|", 2)[2]
        cut, depth = 0, 0
        for i, ch in enumerate(body):
            depth += (ch == "(") - (ch == ")")
            if ch == "|" and not depth:
                cut = i
        name, tag = body[:cut], body[cut + 1 :]
        out.append((label, 2, key, name))
        out.append((label, 3, "spdx", f"spdx license identifier (?:{tag})"))
        out.append((label, 3, "licensed", f"licensed under (?:the )?(?:terms of )?(?:the )?(?:{name}|{tag}(?: licen[sc]e)?)"))
    for line in SENTENCES.strip().split("\n"):
        label, priority, key, body = line.split("|", 3)
        out.append((label, int(priority), key, body))
    return sorted(out, key=lambda r: (-r[1], r[0], r[3]))
