"""License scan: ordered signature rules behind a keyword prefilter.

229 expressions are written by hand, one a line below; two more come from each of 99 SPDX identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Signatures, one a line: label | priority | words that the text must hold | regular expression.
# The expressions run over the text's words joined by one space, with a space at either end.
# A higher priority is a more specific reading; of two places that are the same, it wins.
SIGNATURES = r"""
apache-2.0 | 80 | apache | apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?
apache-2.0 | 78 | apache | www apache org licenses license 2 0
apache-2.0 | 76 | apache | apache 2(?: 0)? licen[sc]ed?
apache-1.1 | 80 | apache | apache (?:software )?licen[sc]e (?:version |v )?1 1
apache-1.0 | 80 | apache | apache (?:software )?licen[sc]e (?:version |v )?1 0
apache | 40 | apache | apache (?:software )?licen[sc]e
mit | 60 | mit | (?:the )?mit licen[sc]e
mit | 60 | mit expat | (?:the )?mit expat licen[sc]e
mit | 70 | permission charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 50 | mit | licensed under (?:the )?(?:terms of the )?mit
mit | 50 | opensource mit | opensource org licenses mit
mit-0 | 80 | mit attribution | mit no attribution
expat | 55 | expat | expat licen[sc]e
x11 | 60 | x11 | x11 licen[sc]e
gpl-3.0-or-later | 90 | gnu later | gnu general public license version 3 (?:of the license )?or (?:at your option )?any later version
gpl-3.0-or-later | 90 | gnu later | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later | 90 | gnu later | gnu general public license version 2 (?:of the license )?or (?:at your option )?any later version
gpl-2.0-or-later | 90 | gnu later | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0 | 80 | gnu | gnu general public license (?:version |v )?3(?: 0)?
gpl-2.0 | 80 | gnu | gnu general public license (?:version |v )?2(?: 0)?
gpl-1.0 | 80 | gnu | gnu general public license (?:version |v )?1(?: 0)?
gpl-3.0 | 70 | gpl | gpl (?:version |v )?3(?: 0)?
gpl-2.0 | 70 | gpl | gpl (?:version |v )?2(?: 0)?
gpl-3.0 | 70 | gplv3 | gplv3
gpl-2.0 | 70 | gplv2 | gplv2
gpl | 40 | gnu | gnu general public licen[sc]e
gpl | 35 | gpl | (?:gnu )?gpl licen[sc]ed?
gpl | 35 | gnu gpl | gnu gpl
lgpl-3.0 | 80 | lesser | gnu lesser general public license (?:version |v )?3(?: 0)?
lgpl-2.1 | 80 | lesser | gnu lesser general public license (?:version |v )?2 1
lgpl-2.0 | 80 | library | gnu library general public license (?:version |v )?2(?: 0)?
lgpl | 45 | lesser | (?:gnu )?lesser general public licen[sc]e
lgpl | 45 | library | (?:gnu )?library general public licen[sc]e
lgpl-3.0 | 70 | lgplv3 | lgplv3
lgpl-2.1 | 70 | lgplv2 | lgplv2(?: 1)?
lgpl-3.0 | 70 | lgpl | lgpl (?:version |v )?3(?: 0)?
lgpl-2.1 | 70 | lgpl | lgpl (?:version |v )?2 1
lgpl | 35 | lgpl | (?:gnu )?lgpl
agpl-3.0 | 80 | affero | gnu affero general public license (?:version |v )?3(?: 0)?
agpl | 45 | affero | (?:gnu )?affero general public licen[sc]e
agpl-3.0 | 70 | agplv3 | agplv3
agpl-3.0 | 70 | agpl | agpl (?:version |v )?3(?: 0)?
agpl | 35 | agpl | (?:gnu )?agpl
gfdl-1.3 | 80 | documentation | gnu free documentation license (?:version |v )?1 3
gfdl-1.2 | 80 | documentation | gnu free documentation license (?:version |v )?1 2
gfdl | 45 | documentation | gnu free documentation licen[sc]e
gfdl | 35 | gfdl | gfdl
cc-by-nc-nd | 72 | cc nd | cc by nc nd
cc-by-nc-sa | 72 | cc sa | cc by nc sa
cc-by-nc | 70 | cc nc | cc by nc
cc-by-nd | 70 | cc nd | cc by nd
cc-by-sa | 70 | cc sa | cc by sa
cc-by | 60 | cc by | cc by
cc0-1.0 | 80 | cc0 | cc0 1 0(?: universal)?
cc0-1.0 | 70 | cc0 | cc0
cc0-1.0 | 70 | creative zero | creative commons zero
cc-by-nc-nd | 62 | creative attribution | creative commons attribution non ?commercial no ?derivatives
cc-by-nc-nd | 62 | creative attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
cc-by-nc-sa | 62 | creative attribution | creative commons attribution non ?commercial share ?alike
cc-by-nc | 60 | creative attribution | creative commons attribution non ?commercial
cc-by-nc | 60 | creative commercial | creative commons attribution non commercial
cc-by-nd | 60 | creative noderivs | creative commons attribution noderivs
cc-by-sa | 60 | creative sharealike | creative commons attribution sharealike
cc-by-sa | 60 | creative alike | creative commons attribution share alike
cc-by | 50 | creative | creative commons attribution
cc | 30 | creative | creative commons(?: licen[sc]ed?)?
cc-by-nc-nd | 64 | creativecommons | creativecommons org licenses by nc nd
cc-by-nc-sa | 64 | creativecommons | creativecommons org licenses by nc sa
cc-by-nc | 63 | creativecommons | creativecommons org licenses by nc
cc-by-nd | 63 | creativecommons | creativecommons org licenses by nd
cc-by-sa | 63 | creativecommons | creativecommons org licenses by sa
cc-by | 62 | creativecommons | creativecommons org licenses by
cc0-1.0 | 64 | creativecommons | creativecommons org publicdomain zero
public-domain | 50 | public domain | (?:released |dedicated |placed )?(?:in|into|to) the public domain
public-domain | 45 | public domain | public domain dedication
pddl-1.0 | 70 | pddl | pddl(?: 1 0)?
odbl-1.0 | 70 | odbl | odbl(?: 1 0)?
odbl-1.0 | 70 | database | open database licen[sc]e
odc-by-1.0 | 70 | odc | odc by(?: 1 0)?
bsd-3-clause | 75 | bsd | (?:new|modified|revised) bsd licen[sc]e
bsd-3-clause | 75 | bsd | (?:3|three) clause bsd(?: licen[sc]e)?
bsd-3-clause | 75 | bsd | bsd (?:3|three) clause(?: licen[sc]e)?
bsd-2-clause | 75 | bsd | (?:simplified|freebsd) bsd licen[sc]e
bsd-2-clause | 75 | bsd | (?:2|two) clause bsd(?: licen[sc]e)?
bsd-2-clause | 75 | bsd | bsd (?:2|two) clause(?: licen[sc]e)?
bsd-4-clause | 75 | bsd | (?:4|four) clause bsd(?: licen[sc]e)?
bsd-4-clause | 75 | bsd | bsd (?:4|four) clause(?: licen[sc]e)?
bsd-0-clause | 75 | bsd | (?:zero|0) clause bsd(?: licen[sc]e)?
bsd | 40 | bsd | bsd(?: style)? licen[sc]ed?
bsd | 55 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
isc | 60 | isc | isc licen[sc]e
isc | 60 | permission fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-2.0 | 80 | mozilla | mozilla public license (?:version |v )?2(?: 0)?
mpl-1.1 | 80 | mozilla | mozilla public license (?:version |v )?1 1
mpl-1.0 | 80 | mozilla | mozilla public license (?:version |v )?1 0
mpl | 40 | mozilla | mozilla public licen[sc]e
mpl-2.0 | 70 | mpl | mpl (?:version |v )?2(?: 0)?
epl-2.0 | 80 | eclipse | eclipse public license (?:version |v )?2(?: 0)?
epl-1.0 | 80 | eclipse | eclipse public license (?:version |v )?1(?: 0)?
epl | 40 | eclipse | eclipse public licen[sc]e
edl-1.0 | 70 | eclipse distribution | eclipse distribution licen[sc]e
eupl-1.2 | 80 | eupl | eupl (?:version |v )?1 2
eupl | 40 | eupl | eupl
eupl | 45 | european | european union public licen[sc]e
cddl-1.0 | 70 | cddl | cddl (?:version |v )?1 0
cddl-1.1 | 70 | cddl | cddl (?:version |v )?1 1
cddl | 45 | distribution | common development and distribution licen[sc]e
cpl-1.0 | 60 | common | common public license(?: version 1 0)?
ms-pl | 60 | microsoft | microsoft public licen[sc]e
ms-rl | 60 | microsoft | microsoft reciprocal licen[sc]e
artistic-2.0 | 80 | artistic | artistic license 2(?: 0)?
artistic-1.0 | 80 | artistic | artistic license 1(?: 0)?
artistic | 40 | artistic | artistic licen[sc]e
bsl-1.0 | 70 | boost | boost software license(?: (?:version |v )?1 0)?
busl-1.1 | 70 | business | business source license(?: (?:version |v )?1 1)?
sspl-1.0 | 70 | sspl | sspl(?: (?:version |v )?1)?
sspl-1.0 | 70 | server | server side public licen[sc]e
elastic-2.0 | 70 | elastic | elastic license(?: (?:version |v )?2(?: 0)?)?
zlib | 60 | zlib | zlib(?: libpng)? licen[sc]e
libpng | 60 | libpng | libpng licen[sc]e
openssl | 60 | openssl | openssl licen[sc]e
python-2.0 | 60 | python | python(?: software foundation)? license(?: (?:version |v )?2(?: 0)?)?
php-3.01 | 70 | php | php license (?:version |v )?3 01
php | 40 | php | php licen[sc]e
ruby | 40 | ruby | ruby licen[sc]e
perl | 50 | perl | same terms as perl(?: itself)?
postgresql | 60 | postgresql | postgresql licen[sc]e
ofl-1.1 | 70 | sil | sil open font license(?: (?:version |v )?1 1)?
ofl-1.1 | 60 | ofl | ofl(?: 1 1)?
unlicense | 60 | unlicense | (?:the )?unlicense
unlicense | 60 | unencumbered | free and unencumbered software released into the public domain
wtfpl | 60 | wtfpl | wtfpl
beerware | 60 | beerware | beerware(?: licen[sc]e)?
vim | 50 | vim | vim licen[sc]e
w3c | 60 | w3c | w3c software(?: notice and)? licen[sc]e
ncsa | 60 | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
upl-1.0 | 60 | universal permissive | universal permissive licen[sc]e
osl-3.0 | 70 | osl | osl (?:version |v )?3(?: 0)?
afl-3.0 | 70 | academic | academic free license(?: (?:version |v )?3 0)?
qpl-1.0 | 60 | qpl | qpl(?: 1 0)?
cecill-2.1 | 70 | cecill | cecill (?:version |v )?2 1
cecill | 40 | cecill | cecill(?: [bc])?
ecl-2.0 | 60 | educational | educational community license(?: (?:version |v )?2 0)?
json | 55 | json | json licen[sc]e
curl | 50 | curl | curl licen[sc]e
hpnd | 50 | historical | historical permission notice and disclaimer
icu | 50 | icu | icu licen[sc]e
unicode | 50 | unicode | unicode(?: terms of use| licen[sc]e)
ogl-uk-3.0 | 70 | government | open government license(?: (?:version |v )?3(?: 0)?)?
llama | 60 | llama | llama (?:2|3|3 1|3 2|3 3|4)? ?community licen[sc]e(?: agreement)?
openrail | 60 | openrail | (?:creativeml )?openrail(?: m)?(?: licen[sc]e)?
openrail | 60 | open rail | (?:creativeml )?open rail(?: m)?(?: licen[sc]e)?
gemma | 50 | gemma | gemma terms of use
proprietary | 30 | rights | all rights reserved
proprietary | 35 | proprietary | proprietary and confidential
proprietary | 35 | redistribute | you may not (?:copy or )?redistribute
proprietary | 30 | end user agreement | end user licen[sc]e agreement
apache-2.0 | 82 | apache compliance | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | 74 | compliance | you may not use this file except in compliance with the license
apache-2.0 | 72 | apache | apache (?:2 0|2) license(?:d)?
gpl | 55 | redistribute program | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | 58 | redistribute library | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
gpl | 42 | gnu received | you should have received a copy of the gnu general public license
lgpl | 46 | gnu lesser | you should have received a copy of the gnu lesser general public license
agpl | 46 | gnu affero | you should have received a copy of the gnu affero general public license
gpl-2.0 | 75 | gnu gpl | gnu gpl (?:version |v )?2(?: 0)?
gpl-3.0 | 75 | gnu gpl | gnu gpl (?:version |v )?3(?: 0)?
lgpl-2.1 | 75 | gnu lgpl | gnu lgpl (?:version |v )?2 1
lgpl-3.0 | 75 | gnu lgpl | gnu lgpl (?:version |v )?3(?: 0)?
agpl-3.0 | 75 | gnu agpl | gnu agpl (?:version |v )?3(?: 0)?
gpl-2.0-classpath | 92 | gnu classpath | gnu general public license version 2 with (?:the )?classpath exception
gpl-linking | 60 | gpl linking | gpl with (?:a )?linking exception
gfdl | 50 | documentation license | terms of the gnu free documentation license
warranty | 8 | warranty license | without even the implied warranty of merchantability or fitness for a particular purpose see the license
warranty | 8 | rights warranty | all rights reserved without warranty of any kind
bsd-3-clause | 72 | redistribution neither | redistribution and use in source and binary forms (?:with or without modification )?neither the name
bsd-3-clause | 65 | permission names contributors | names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd | 58 | redistributions copyright | redistributions of source code must retain the above copyright notice
bsd | 58 | redistributions copyright | redistributions in binary form must reproduce the above copyright notice
bsd-2-clause-patent | 76 | bsd patent | bsd (?:2 clause )?(?:plus |with )?patent licen[sc]e
bsd-4-clause | 74 | bsd | (?:original|old) bsd licen[sc]e
mit | 62 | mit style | mit style licen[sc]e
mit | 58 | permission copies | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-modern | 60 | permission royalty | permission is hereby granted without written agreement and without license or royalty fees
isc | 62 | permission notice | provided that the above copyright notice and this permission notice appear in all copies
mpl-2.0 | 82 | mozilla source | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 60 | mozilla | mozilla org mpl 2 0
epl | 48 | eclipse program | this program and the accompanying materials are made available under the terms of the eclipse public license
epl-2.0 | 70 | epl license | epl (?:version |v )?2(?: 0)? license
epl-1.0 | 70 | epl license | epl (?:version |v )?1(?: 0)? license
cddl | 50 | cddl license | common development and distribution license cddl
cpl-1.0 | 62 | common license | ibm common public license
eupl-1.1 | 80 | eupl | eupl (?:version |v )?1 1
cc-by-4.0 | 74 | creative international | creative commons attribution (?:4 0 international|international 4 0)(?: public)? license
cc-by-sa-4.0 | 76 | creative international | creative commons attribution share ?alike (?:4 0 international|international 4 0)(?: public)? license
cc-by-nc-4.0 | 76 | creative international | creative commons attribution non ?commercial (?:4 0 international|international 4 0)(?: public)? license
cc-by-nc-sa-4.0 | 78 | creative international | creative commons attribution non ?commercial share ?alike (?:4 0 international|international 4 0)(?: public)? license
cc-by-nc-nd-4.0 | 78 | creative international | creative commons attribution non ?commercial no ?derivatives (?:4 0 international|international 4 0)(?: public)? license
cc-by-3.0 | 74 | creative unported | creative commons attribution 3 0 unported(?: license)?
cc-by-sa-3.0 | 76 | creative unported | creative commons attribution share ?alike 3 0 unported(?: license)?
cc0-1.0 | 72 | cc0 waived | cc0 (?:has )?waived all copyright
cc-pdm | 60 | domain mark | public domain mark(?: 1 0)?
cc-by | 48 | creative attribution | attribution license of creative commons
odbl-1.0 | 72 | open database | open data commons open database license(?: odbl)?
odc-by-1.0 | 72 | open attribution license | open data commons attribution license
pddl-1.0 | 72 | open domain license | open data commons public domain dedication and license
ogl | 45 | government license | open government license
ofl-1.1 | 65 | open font license | open font license(?: version)? 1 1
ubuntu-font | 60 | ubuntu | ubuntu font licen[sc]e
arphic | 60 | arphic license | arphic public license
bsl-1.0 | 65 | boost license | boost license 1 0
artistic-2.0 | 72 | artistic license | the artistic license 2 0
perl | 52 | perl license | under the same license as perl(?: itself)?
python | 45 | psf license | psf license(?: agreement)?
zlib | 58 | zlib license | zlib style license
openssl-ssleay | 62 | openssl license | openssl and ssleay license
ncsa | 62 | illinois license | university of illinois open source license
mulan | 60 | mulan license | mulan (?:permissive|public) (?:software )?license(?: v2)?
osl | 45 | open license | open software license(?: v? ?3 0)?
sspl-1.0 | 72 | mongodb license | mongodb server side public license
commons-clause | 75 | commons license | commons clause license condition
polyform | 70 | polyform license | polyform (?:noncommercial|small business|shield|strict) license
confidential | 32 | rights confidential | confidential all rights reserved
evaluation | 34 | license evaluation | for evaluation purposes only (?:under|see) (?:the |this )?license
research-only | 36 | license research | (?:for )?non commercial research (?:use |purposes )?only license
copyright | 10 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
generic | 5 | licensed | licensed under
generic | 5 | license | (?:this|the) license
generic | 5 | licence | (?:this|the) licence
"""

#: Identifiers of the public SPDX list; each gives a tag rule and a "licensed under" rule.
SPDX_IDS = """0BSD AAL AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0
APSL-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause
BSL-1.0 BUSL-1.1 CAL-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0
CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-3.0
CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2
GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ISC LGPL-2.0
LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0
MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 ODC-By-1.0 OFL-1.1 OGL-UK-3.0 OpenSSL OSL-3.0 PDDL-1.0 PostgreSQL Python-2.0 QPL-1.0
Ruby SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"""

#: Any text with a rule's place or a base phrase holds one of these.
PREFILTER = r"licen[sc]|mit[^a-z]+no|gnu|gpl|gfdl|cc[^a-z]+by|cc0|creative|spdx|copyright|domain|rights|permission|mozilla|mpl|eupl|cddl|cecill|sspl|wtfpl|beerware|redistribut|ofl|osl|odbl|odc|pddl|qpl|perl|bsd|notice|gemma|unicode|rail|proprietary"


def rules() -> list[tuple[str, int, list[str], str]]:
    """(label, priority, words that must occur, expression) of every rule, in order."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        label, priority, words, pattern = (x.strip() for x in line.split(" | "))
        out.append((label, int(priority), words.split(), pattern))
    for spdx in SPDX_IDS.split():
        words = spdx.lower().replace("-", " ").replace(".", " ")
        out.append((spdx.lower(), 95, ["spdx"], f"spdx license identifier {words}"))
        out.append((spdx.lower(), 85, ["licensed", "under"], f"licensed under (?:the )?(?:terms of the )?{words}"))
    return out


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Items of a part of a growing array: appending copies a part, not all that was found before.
PART = 128


def _grown(state: str, item: str) -> str:
    """SQL fields ``parts`` and ``part`` of a state with an item more."""
    full = f"size({state}.part) >= {PART}"
    return f"'parts', if({full}, array_append({state}.parts, {state}.part), {state}.parts), 'part', if({full}, array({item}), array_append({state}.part, {item}))"


_PLACE = "struct<s:int,e:int,priority:int,rank:int,label:string>"


def _places() -> str:
    """SQL over ``ns`` and a rule ``r``: the places [s, e) of the rule's expression in ``ns``."""
    item = "named_struct('s', acc.pos + x.a, 'e', acc.pos + x.a + x.b, 'priority', r.priority, 'rank', r.rank, 'label', r.label)"
    return f"""aggregate(
      zip_with(split(ns, r.pattern, -1), concat(regexp_extract_all(ns, r.pattern, 0), array('')), (a, b) -> named_struct('a', length(a), 'b', length(b))),
      named_struct('pos', 0, 'parts', cast(array() as array<array<{_PLACE}>>), 'part', cast(array() as array<{_PLACE}>)),
      (acc, x) -> if(x.b > 0, named_struct('pos', acc.pos + x.a + x.b, {_grown('acc', item)}), named_struct('pos', acc.pos + x.a + x.b, 'parts', acc.parts, 'part', acc.part)),
      acc -> flatten(array_append(acc.parts, acc.part)))"""


def _stay() -> str:
    """SQL over ``found``: the places that aren't suppressed, in order.

    One sweep: a place that holds another begins no later, and of those that begin together the longer, the more important and the
    earlier rule comes first. So it is enough to know how far the places of each priority have reached."""
    priorities = sorted({p for _, p, _, _ in rules()})
    level = " ".join(f"when {p} then {k}" for k, p in enumerate(priorities))
    ordered = """array_sort(found, (a, b) -> case when a.s <> b.s then a.s - b.s when a.e <> b.e then b.e - a.e when a.priority <> b.priority then b.priority - a.priority else a.rank - b.rank end)"""
    reached = f"array_max(slice(acc.ends, (case x.priority {level} end) + 1, {len(priorities)})) >= x.e"
    ends = f"transform(acc.ends, (v, k) -> if(k = (case x.priority {level} end), greatest(v, x.e), v))"
    return f"""aggregate({ordered}, named_struct('ends', array_repeat(-1, {len(priorities)}), 'parts', cast(array() as array<array<{_PLACE}>>), 'part', cast(array() as array<{_PLACE}>)),
      (acc, x) -> if({reached}, acc, named_struct('ends', {ends}, {_grown('acc', 'x')})),
      acc -> flatten(array_append(acc.parts, acc.part)))"""


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find license phrases and notices in each text; one row a document, no shuffle.

    A text without any keyword of the prefilter is only counted. Else each rule whose words occur
    runs over the text's words joined by a space. Of the places found, one that lies within
    another of at least its priority, or that is another's place with a lower priority (or later rule), is
    suppressed; a specific notice within a longer vague one stays. ``labels`` are the base phrases' labels and those of the
    places that stay, ``score`` the highest priority of these over 100. ``detections`` has the places.

    Nulls and empty texts have no words, null positions, empty labels and score 0; a null id is
    carried along; repeated rows give repeated results; other columns are not looked at.
    """
    rule_rows = ", ".join(f"named_struct('label', {_literal(label)}, 'priority', {priority}, 'rank', {k}, 'need', array({', '.join(map(_literal, words))}), 'pattern', {_literal(f'(?<= )(?:{pattern})(?= )')})" for k, (label, priority, words, pattern) in enumerate(rules()))
    keywords = ", ".join(map(_literal, sorted({w for _, _, need, _ in rules() for w in need})))
    low = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("doc_id"), low.alias("low"))
    counted = base.select("doc_id", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"), F.when(F.col("low").rlike(PREFILTER), F.col("low")).alias("low"))

    found = []
    for phrase, label in BASE_PHRASES.items():
        parts = phrase.split()
        same = " AND ".join(f"w[i + {k}] = {_literal(p)}" for k, p in enumerate(parts))
        found.append(f"IF(size(w) < {len(parts)}, cast(array() as array<struct<at:int,label:string>>), transform(filter(sequence(0, greatest(size(w) - {len(parts)}, 0)), i -> {same}), i -> named_struct('at', i, 'label', {_literal(label)})))")
    places = f"""flatten(transform(
        filter(array({rule_rows}), r -> forall(r.need, k -> array_contains(kw, k))), r -> {_places()}))"""
    # transform(array(x), name -> ...)[0] binds a value that is used again and again
    scan = f"""transform(array(regexp_extract_all(low, {_literal("(" + WORD + ")")}, 1)), w -> named_struct(
        'base', array_sort(concat({", ".join(found)})),
        'all', transform(array(named_struct('ns', concat(' ', array_join(w, ' '), ' '), 'kw', array_intersect(w, array({keywords})))),
            b -> transform(array(b.ns), ns -> transform(array(b.kw), kw -> {places})[0])[0])[0]))[0]"""
    scanned = counted.withColumn("scan", F.when(F.col("low").isNotNull(), F.expr(scan)))
    kept = scanned.select("doc_id", "n_words", F.col("scan.base").alias("base"), F.expr(f"transform(array(scan.all), found -> {_stay()})[0]").alias("detections"))
    base_labels = F.coalesce(F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"]))), F.array().cast("array<string>"))
    own = F.coalesce(F.transform("detections", lambda x: x["label"]), F.array().cast("array<string>"))
    return kept.select(
        "doc_id",
        "n_words",
        F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["at"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: x["priority"])).cast("double") / 100, F.lit(0.0)).alias("score"),
        F.coalesce(F.transform("detections", lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), x["label"].alias("label"), x["priority"].alias("priority"))), F.array().cast("array<struct<start:int,end:int,label:string,priority:int>>")).alias("detections"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents")).drop("detections")
