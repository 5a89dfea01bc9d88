"""Ordered licence signatures, written for normalised text: lower-case words
joined by single blanks (``2.0`` is ``2 0``, ``CC-BY`` is ``cc by``).

One rule a line: ``label | priority | keywords | regex``. Rules come in order of
precedence. Priority: 4 identifiers and grant texts, 3 a named licence with its
version, 2 a named licence, 1 a general notice. A rule is only tried where one
of its keywords (whole words) occurs; every match holds one of them. A regex
matches whole words only.
"""

from __future__ import annotations

import re

RULES_TEXT = r"""
spdx-apache-2.0 | 4 | spdx | spdx license identifier apache 2 0
spdx-mit | 4 | spdx | spdx license identifier mit
spdx-bsd-3-clause | 4 | spdx | spdx license identifier bsd 3 clause
spdx-bsd-2-clause | 4 | spdx | spdx license identifier bsd 2 clause
spdx-gpl-3.0-or-later | 4 | spdx | spdx license identifier gpl 3 0 or later
spdx-gpl-3.0-only | 4 | spdx | spdx license identifier gpl 3 0 only
spdx-gpl-2.0-or-later | 4 | spdx | spdx license identifier gpl 2 0 or later
spdx-gpl-2.0-only | 4 | spdx | spdx license identifier gpl 2 0 only
spdx-lgpl | 4 | spdx | spdx license identifier lgpl [23] [01] (?:or later|only)
spdx-agpl | 4 | spdx | spdx license identifier agpl 3 0 (?:or later|only)
spdx-mpl-2.0 | 4 | spdx | spdx license identifier mpl 2 0
spdx-epl-2.0 | 4 | spdx | spdx license identifier epl [12] 0
spdx-isc | 4 | spdx | spdx license identifier isc
spdx-zlib | 4 | spdx | spdx license identifier zlib
spdx-cc0-1.0 | 4 | spdx | spdx license identifier cc0 1 0
spdx-cc-by-4.0 | 4 | spdx | spdx license identifier cc by 4 0
spdx-cc-by-sa-4.0 | 4 | spdx | spdx license identifier cc by sa 4 0
spdx-unlicense | 4 | spdx | spdx license identifier unlicense
spdx-other | 1 | spdx | spdx license identifier \S+
apache-2.0-grant | 4 | licensed | licensed under the apache license version 2 0 the license
apache-2.0-compliance | 4 | license | you may not use this file except in compliance with the license
apache-2.0-copy | 4 | license | you may obtain a copy of the license at
apache-2.0-as-is | 4 | license | distributed under the license is distributed on an as is basis
mit-grant | 4 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit-notice | 4 | copyright | the above copyright notice and this permission notice shall be included
mit-warranty | 4 | warranty | the software is provided as is without warranty of any kind
bsd-redistribution | 4 | redistribution | redistribution and use in source and binary forms with or without modification
bsd-source-clause | 4 | redistributions | redistributions of source code must retain the above copyright notice
bsd-binary-clause | 4 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-endorsement | 4 | permission | without specific prior written permission
bsd-warranty | 4 | warranties | this software is provided by .{1,60} as is and any express or implied warranties
isc-grant | 4 | permission | permission to use copy modify and or distribute this software for any purpose
gpl-redistribute | 4 | redistribute | this program is free software you can redistribute it and or modify it
gpl-warranty | 4 | warranty | without any warranty without even the implied warranty of merchantability
gpl-received-copy | 4 | license | you should have received a copy of the gnu general public license
lgpl-received-copy | 4 | license | you should have received a copy of the gnu (?:lesser|library) general public license
agpl-received-copy | 4 | license | you should have received a copy of the gnu affero general public license
mpl-2.0-grant | 4 | license | this source code form is subject to the terms of the mozilla public license
epl-grant | 4 | license | made available under the terms of the eclipse public license
boost-grant | 4 | license | distributed under the boost software license version 1 0
zlib-grant | 4 | warranty | provided as is without any express or implied warranty
unlicense-grant | 4 | domain | this is free and unencumbered software released into the public domain
wtfpl-grant | 4 | wtfpl | do what the fuck you want to public license wtfpl
cc0-grant | 4 | cc0,commons | (?:waived all copyright|dedicated to the public domain) .{0,80}(?:cc0|creative commons)
cc-share | 4 | commons | this work is licensed under a creative commons
cc-view-copy | 4 | license | to view a copy of this license visit
ofl-grant | 4 | license | this font software is licensed under the sil open font license
gfdl-grant | 4 | license | under the terms of the gnu free documentation license
artistic-grant | 4 | license | under the (?:same )?terms (?:of the artistic license|as perl itself under the license)
afl-grant | 4 | licensed | licensed under the academic free license
osl-grant | 4 | licensed | licensed under the open software license
cddl-grant | 4 | license | subject to the terms of the common development and distribution license
ms-pl-grant | 4 | license | this license governs use of the accompanying software
eupl-grant | 4 | licensed,licence | licensed under the eupl|european union public licence
psf-grant | 4 | licensed,license | python software foundation license(?: version 2)?
curl-grant | 4 | permission | permission to use copy modify and distribute this software for any purpose with or without fee
ntp-grant | 4 | permission | permission to use copy modify and distribute this software and its documentation
x11-endorsement | 4 | contained | except as contained in this notice the name of .{1,40} shall not be used
openssl-ack | 4 | redistributions | redistributions of any form whatsoever must retain the following acknowledgment
json-good | 4 | copyright,license | license .{0,40}shall be used for good not evil
beerware | 4 | license | beer ware license|beerware license
cc-by-nc-nd-4.0 | 3 | cc | cc by nc nd 4 0
cc-by-nc-nd-3.0 | 3 | cc | cc by nc nd 3 0
cc-by-nc-sa-4.0 | 3 | cc | cc by nc sa 4 0
cc-by-nc-sa-3.0 | 3 | cc | cc by nc sa 3 0
cc-by-nc-4.0 | 3 | cc | cc by nc 4 0
cc-by-nc-3.0 | 3 | cc | cc by nc 3 0
cc-by-nc-2.5 | 3 | cc | cc by nc 2 5
cc-by-sa-4.0 | 3 | cc | cc by sa 4 0
cc-by-sa-3.0 | 3 | cc | cc by sa 3 0
cc-by-sa-2.5 | 3 | cc | cc by sa 2 5
cc-by-sa-2.0 | 3 | cc | cc by sa 2 0
cc-by-nd-4.0 | 3 | cc | cc by nd 4 0
cc-by-nd-3.0 | 3 | cc | cc by nd 3 0
cc-by-4.0 | 3 | cc | cc by 4 0
cc-by-3.0 | 3 | cc | cc by 3 0
cc-by-2.5 | 3 | cc | cc by 2 5
cc-by-2.0 | 3 | cc | cc by 2 0
cc-by-1.0 | 3 | cc | cc by 1 0
cc0-1.0 | 3 | cc0 | cc0 1 0(?: universal)?
cc-by-nc-nd-long | 3 | commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nc-sa-long | 3 | commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-long | 3 | commons | creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-sa-long | 3 | commons | creative commons attribution share ?alike(?: [1-4] [05])?
cc-by-nd-long | 3 | commons | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-long | 3 | commons | creative commons attribution(?: [1-4] [05])?
cc0-long | 3 | commons | creative commons zero(?: v?1 0)?
cc-international | 3 | license | attribution (?:\S+ )?4 0 international(?: public)? license
gpl-3.0 | 3 | gpl,license | (?:gnu )?general public license,? v(?:ersion )?3(?: 0)?
gpl-2.0 | 3 | gpl,license | (?:gnu )?general public license v(?:ersion )?2(?: 0)?
gpl-1.0 | 3 | license | (?:gnu )?general public license v(?:ersion )?1(?: 0)?
gpl-3.0-or-later | 3 | license | general public license .{0,60}either version 3 of the license or at your option any later version
gpl-2.0-or-later | 3 | license | general public license .{0,60}either version 2 of the license or at your option any later version
gpl-3-short | 3 | gpl,gplv3,gpl3 | gnu gpl v? ?3|gpl ?v?3(?: 0)?|gpl v 3|gplv3
gpl-2-short | 3 | gpl,gplv2,gpl2 | gnu gpl v? ?2|gpl ?v?2(?: 0)?|gpl v 2|gplv2
lgpl-3.0 | 3 | license | (?:gnu )?lesser general public license v(?:ersion )?3(?: 0)?
lgpl-2.1 | 3 | license | (?:gnu )?lesser general public license v(?:ersion )?2 1
lgpl-2.0 | 3 | license | (?:gnu )?library general public license v(?:ersion )?2(?: 0)?
lgpl-short | 3 | lgpl,lgplv3,lgplv2,lgpl3,lgpl2 | lgpl ?v?[23](?: [01])?|lgplv[23]
agpl-3.0 | 3 | license | (?:gnu )?affero general public license v(?:ersion )?3(?: 0)?
agpl-short | 3 | agpl,agplv3,agpl3 | agpl ?v?3(?: 0)?|agplv3
apache-2.0 | 3 | license | apache license v(?:ersion )?2(?: 0)?
apache-2.0-short | 3 | license,licence | apache 2(?: 0)? licen[cs]e
apache-1.1 | 3 | license | apache (?:software )?license v(?:ersion )?1 1
apache-1.0 | 3 | license | apache (?:software )?license v(?:ersion )?1 0
bsd-4-clause | 3 | license,licence | (?:original|old|4 clause|four clause) bsd licen[cs]e|bsd 4 clause licen[cs]e
bsd-3-clause | 3 | license,licence | (?:new|modified|revised|3 clause|three clause) bsd licen[cs]e|bsd 3 clause licen[cs]e
bsd-2-clause | 3 | license,licence | (?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e|bsd 2 clause licen[cs]e
bsd-0-clause | 3 | license,licence | (?:zero clause|0 clause|free public) (?:bsd )?licen[cs]e|0bsd licen[cs]e
mpl-2.0 | 3 | license | mozilla public license v(?:ersion )?2(?: 0)?
mpl-1.1 | 3 | license | mozilla public license v(?:ersion )?1 1
mpl-1.0 | 3 | license | mozilla public license v(?:ersion )?1 0
epl-2.0 | 3 | license | eclipse public license v(?:ersion )?2(?: 0)?
epl-1.0 | 3 | license | eclipse public license v(?:ersion )?1(?: 0)?
edl-1.0 | 3 | license | eclipse distribution license v(?:ersion )?1 0
cpl-1.0 | 3 | license | common public license v(?:ersion )?1 0
ipl-1.0 | 3 | license | ibm public license v(?:ersion )?1 0
eupl-1.2 | 3 | licence | european union public licence v ?1 2
eupl-1.1 | 3 | licence | european union public licence v ?1 1
cddl-1.1 | 3 | license | common development and distribution license v(?:ersion )?1 1
cddl-1.0 | 3 | license | common development and distribution license v(?:ersion )?1 0
ms-pl | 3 | license | microsoft public license
ms-rl | 3 | license | microsoft reciprocal license
boost-1.0 | 3 | license | boost software license v(?:ersion )?1 0
artistic-2.0 | 3 | license | artistic license v?(?:ersion )?2 0
artistic-1.0 | 3 | license | artistic license v?(?:ersion )?1 0
ofl-1.1 | 3 | license | sil open font license v?(?:ersion )?1 1
ofl-1.0 | 3 | license | sil open font license v?(?:ersion )?1 0
osl-3.0 | 3 | license | open software license v?(?:ersion )?3 0
afl-3.0 | 3 | license | academic free license v?(?:ersion )?3 0
afl-2.1 | 3 | license | academic free license v?(?:ersion )?2 1
gfdl-1.3 | 3 | license | free documentation license v?(?:ersion )?1 3
gfdl-1.2 | 3 | license | free documentation license v?(?:ersion )?1 2
odbl-1.0 | 3 | license | open database license v?(?:ersion )?1 0|open data commons open database license
odc-by-1.0 | 3 | license | open data commons attribution license
pddl-1.0 | 3 | license,licence | open data commons public domain dedication (?:and|&)? ?licen[cs]e|public domain dedication and licen[cs]e
cecill-2.1 | 3 | license,licence | cecill (?:free software )?licen[cs]e(?: agreement)?(?: v?(?:ersion )?2 1)?
cecill-b | 3 | license,licence | cecill b licen[cs]e
cecill-c | 3 | license,licence | cecill c licen[cs]e
upl-1.0 | 3 | license | universal permissive license(?: v?(?:ersion )?1 0)?
ncsa | 3 | license | university of illinois ncsa open source license
postgresql | 3 | license,licence | postgresql licen[cs]e
php-3.01 | 3 | license | php license v?(?:ersion )?3 01
ruby | 3 | license | ruby license
zpl-2.1 | 3 | license | zope public license v?(?:ersion )?2 1
w3c | 3 | license | w3c software (?:notice and )?license
openssl | 3 | license | openssl license
oldap-2.8 | 3 | license | openldap public license(?: v?(?:ersion )?2 8)?
lppl-1.3 | 3 | license | latex project public license(?: v?(?:ersion )?1 3c?)?
qpl-1.0 | 3 | license | q public license(?: v?(?:ersion )?1 0)?
sleepycat | 3 | license | sleepycat license
vim | 3 | license | vim license
mulan-psl-2 | 3 | license | mulan permissive software license v?(?:ersion )?2
bsl-1.1 | 3 | license | business source license(?: v?(?:ersion )?1 1)?
sspl-1.0 | 3 | license | server side public license(?: v?(?:ersion )?1)?
elastic-2.0 | 3 | license | elastic license(?: v?(?:ersion )?2(?: 0)?)?
commons-clause | 3 | commons | commons clause license condition(?: v?1 0)?|commons clause
polyform-nc | 3 | license | polyform noncommercial license(?: 1 0 0)?
polyform-shield | 3 | license | polyform shield license(?: 1 0 0)?
openrail-m | 3 | license | (?:bigscience |creativeml )?open ?rail ?m license
rail | 3 | license,licenses | responsible ai licenses?
llama-community | 3 | license | llama \d+ community license
hippocratic | 3 | license | hippocratic license(?: \d \d)?
blue-oak-1.0.0 | 3 | license | blue oak model license(?: 1 0 0)?
ecl-2.0 | 3 | license | educational community license(?: v?(?:ersion )?2 0)?
nasa-1.3 | 3 | license | nasa open source agreement.{0,20} license|nasa open source license
cpal-1.0 | 3 | license | common public attribution license(?: v?(?:ersion )?1 0)?
rpl-1.5 | 3 | license | reciprocal public license(?: 1 5)?
sun-public | 3 | license | sun public license(?: v?(?:ersion )?1 0)?
intel-oss | 3 | license | intel open source license
netscape-1.1 | 3 | license | netscape public license(?: v?(?:ersion )?1 1)?
apple-2.0 | 3 | license | apple public source license(?: 2 0)?
open-government-3.0 | 3 | licence | open government licence(?: v?(?:ersion )?3 0)?
etalab-2.0 | 3 | licence,license | etalab(?: open)? licen[cs]e(?: 2 0)?|licence ouverte(?: 2 0)?
dl-de-by-2.0 | 3 | license,licence | data licen[cs]e germany attribution(?: version)?(?: 2 0)?
norwegian-nlod | 3 | licence,license | norwegian licen[cs]e for open government data
canada-ogl | 3 | licence | open government licence canada
free-art-1.3 | 3 | license | free art license(?: 1 3)?
wtfpl | 2 | wtfpl | wtfpl
unlicense | 2 | unlicense | (?:the )?unlicense
cc0 | 2 | cc0 | cc0
cc-by-nc-nd | 2 | cc | cc by nc nd
cc-by-nc-sa | 2 | cc | cc by nc sa
cc-by-nc | 2 | cc | cc by nc
cc-by-sa | 2 | cc | cc by sa
cc-by-nd | 2 | cc | cc by nd
cc-license | 2 | commons | creative commons(?: public)? licen[cs]e|creative commons
mit | 2 | license,licence | (?:the )?mit licen[cs]e
mit-expat | 2 | license,licence | expat licen[cs]e
mit-x11 | 2 | license,licence | (?:mit )?x11 licen[cs]e
apache | 2 | license,licence | apache (?:software )?licen[cs]e
bsd | 2 | license,licence | bsd(?: style)? licen[cs]e
isc | 2 | license,licence | isc licen[cs]e
zlib | 2 | license,licence | zlib(?: libpng)? licen[cs]e
lgpl | 2 | license,licence | (?:gnu )?(?:lesser|library) general public licen[cs]e
agpl | 2 | license,licence | (?:gnu )?affero general public licen[cs]e
gnu-gpl | 2 | license,licence | gnu general public licen[cs]e
gpl-name | 2 | gpl | (?:gnu )?gpl
mpl | 2 | license,licence | mozilla public licen[cs]e
epl | 2 | license,licence | eclipse public licen[cs]e
eupl | 2 | licence,license | european union public licen[cs]e
boost | 2 | license,licence | boost software licen[cs]e
artistic | 2 | license,licence | artistic licen[cs]e
ofl | 2 | license,licence | open font licen[cs]e
gfdl | 2 | license,licence | free documentation licen[cs]e
odbl | 2 | license,licence | open database licen[cs]e
public-domain | 2 | domain | (?:released into|placed in|dedicated to|in) the public domain
proprietary | 2 | proprietary | proprietary and confidential|proprietary software
confidential | 2 | confidential | (?:strictly )?confidential(?: and proprietary)? (?:information|material)
commercial | 2 | license,licence | (?:commercial|enterprise) licen[cs]e(?: agreement)?
eula | 2 | license,licence | end user licen[cs]e agreement
non-commercial | 2 | license,licensed,licence,licenced | licen[cs]ed? (?:only )?for non ?commercial (?:use|purposes)
personal-use | 2 | license,licensed,licence,licenced | licen[cs]ed? for personal use(?: only)?
research-only | 2 | license,licensed,licence,licenced | licen[cs]ed? for research (?:use|purposes)(?: only)?
no-derivatives | 2 | permission | no part of this (?:publication|work|document) may be reproduced .{0,120}permission
copyleft | 1 | copyleft | copyleft
copyright-year | 1 | copyright | copyright (?:c )?(?:19|20)\d\d
copyright-holder | 1 | copyright | copyright (?:c |by )(?:the )?\S+
copyright-notice | 1 | copyright | copyright notice
licensed-under | 1 | licensed | licensed under(?: the)?(?: terms of)?
patent-grant | 1 | patent | (?:patent license|grant of patent license)
trademark-notice | 1 | trademark,trademarks | (?:registered )?trademarks? of
warranty-disclaimer | 1 | warranty,warranties | (?:without|no) warrant(?:y|ies)(?: of any kind)?
permission-required | 1 | permission | (?:used|reprinted|reproduced) (?:with|by) permission
license-file | 1 | license,licence | see (?:the )?(?:file )?licen[cs]e(?: file)?(?: for details| for more information)?
"""

# The places that count for n_base: label and phrase.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

# A text can only hold a keyword if it holds one of these stems.
STEMS = ["licen", "copyright", "copyleft", "reserved", "cc", "warrant", "domain", "commons", "gpl", "spdx",
         "permission", "contained", "proprietary", "confidential", "redistribut", "wtfpl", "patent", "trademark"]


def required_words(regex: str) -> list[str]:
    """Words that every match of a rule's regex holds: the plain words outside
    all groups, none if the regex has alternatives at its top level."""
    depth, flat = 0, ""
    for c in regex:
        depth += (c == "(") - (c == ")")
        if depth == 0 or c == "(":
            flat += "\0" if c in "()" else c
    if "|" in flat:
        return []
    return [w for w in flat.replace(" ?", "\0").split(" ") if re.fullmatch("[a-z0-9]+", w)]


def rules() -> list[dict]:
    """The rules in order, base phrases first."""
    out = [{"label": label, "priority": 2, "keywords": [phrase.split()[-1] if label != "cc-by" else "cc"],
            "regex": phrase, "base": True} for label, phrase in BASE]
    for line in RULES_TEXT.strip().splitlines():
        label, priority, keywords, regex = (x.strip() for x in line.split(" | ", 3))
        out.append({"label": label, "priority": int(priority), "keywords": keywords.split(","), "regex": regex,
                    "base": False})
    for i, r in enumerate(out):
        r["id"] = i
        r["must"] = required_words(r["regex"])
        r["regex"] = f"(?<![^ ])(?:{r['regex'].strip()})(?![^ ])"
        for k in r["keywords"]:
            if not any(s in k for s in STEMS):
                raise ValueError(f"keyword {k} of {r['label']} holds no stem")
    return out
