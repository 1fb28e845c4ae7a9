"""Signature rules of the license scan.

Each family has a label, the SPDX ids that stand for it, a title pattern and, for most, a URL or
notice pattern. A rule is made for each form of each family; the forms differ in priority. All
patterns are matched on lower-cased text whose white space is collapsed (SPACE), so names and notices
may be wrapped, also inside comments. `need` is a literal that every match of the pattern holds. A
rule with a group claims the group only: the SPDX rules claim one id each of an expression.
"""

from __future__ import annotations

# Label | spdx ids | title need ; title pattern | url or notice need ; pattern
_FAMILIES = r"""
agpl-3.0 | agpl-3\.0(?:-only|-or-later)? | affero ; (?:gnu )?affero general public licen[cs]e(?:,? v(?:ersion)?\.? ?3(?:\.0)?)? | licenses/agpl ; gnu\.org/licenses/agpl[-\w.]*
gpl-1.0 | gpl-1\.0(?:-only|-or-later)? | general public ; gnu general public licen[cs]e,? v(?:ersion)?\.? ?1(?:\.0)?\b | licenses/gpl-1 ; gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0[-\w.]*
gpl-2.0 | gpl-2\.0(?:-only|-or-later)? | general public ; gnu general public licen[cs]e,? v(?:ersion)?\.? ?2(?:\.0)?\b | licenses/gpl-2 ; gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0[-\w.]*
gpl-3.0 | gpl-3\.0(?:-only|-or-later)? | general public ; gnu general public licen[cs]e,? v(?:ersion)?\.? ?3(?:\.0)?\b | licenses/gpl-3 ; gnu\.org/licenses/gpl-3\.0[-\w.]*
gpl | gpl | general public ; gnu general public licen[cs]e | licenses/gpl ; gnu\.org/licenses/gpl\b
lgpl-2.0 | lgpl-2\.0(?:-only|-or-later)? | library general ; gnu library general public licen[cs]e(?:,? v(?:ersion)?\.? ?2(?:\.0)?)? | licenses/lgpl-2.0 ; gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0[-\w.]*
lgpl-2.1 | lgpl-2\.1(?:-only|-or-later)? | lesser general ; gnu lesser general public licen[cs]e,? v(?:ersion)?\.? ?2\.1 | licenses/lgpl-2.1 ; gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1[-\w.]*
lgpl-3.0 | lgpl-3\.0(?:-only|-or-later)? | lesser general ; gnu lesser general public licen[cs]e(?:,? v(?:ersion)?\.? ?3(?:\.0)?)? | licenses/lgpl-3 ; gnu\.org/licenses/lgpl-3\.0[-\w.]*
gfdl-1.3 | gfdl-1\.[123](?:-only|-or-later)? | free documentation ; gnu free documentation licen[cs]e(?:,? v(?:ersion)?\.? ?1\.[123])? | licenses/fdl ; gnu\.org/licenses/fdl[-\w.]*
apache-1.1 | apache-1\.[01] | apache ; apache (?:software )?licen[cs]e,? v(?:ersion)?\.? ?1\.[01] | apache.org ; apache\.org/licenses/license-1\.[01]
apache-2.0 | apache-2\.0 | apache ; apache (?:software )?licen[cs]e,? v(?:ersion)?\.? ?2(?:\.0)? | license-2.0 ; apache\.org/licenses/license-2\.0
apache | apache | apache ; apache (?:software )?licen[cs]e | apache.org/licenses ; apache\.org/licenses/?
mit | mit | mit ; \bmit licen[cs]e | licenses/mit ; opensource\.org/licenses/mit\b
mit-0 | mit-0 | mit ; \bmit no attribution(?: licen[cs]e)? | licenses/mit-0 ; opensource\.org/licenses/mit-0
x11 | x11 | x11 ; \bx11 licen[cs]e | without restriction ; permission is hereby granted, free of charge, to any person obtaining a copy.{0,400}?without restriction
isc | isc | isc ; \bisc licen[cs]e | licenses/isc ; opensource\.org/licenses/isc\b
bsd-1-clause | bsd-1-clause | bsd ; \bbsd[- ](?:1|one)[- ]clause(?: licen[cs]e)? | licenses/bsd-1 ; opensource\.org/licenses/bsd-1-clause
bsd-2-clause | bsd-2-clause | bsd ; \b(?:simplified bsd|freebsd|bsd[- ](?:2|two)[- ]clause)(?: licen[cs]e)? | licenses/bsd-2 ; opensource\.org/licenses/bsd-2-clause
bsd-3-clause | bsd-3-clause | bsd ; \b(?:new bsd|modified bsd|bsd[- ](?:3|three)[- ]clause)(?: licen[cs]e)? | licenses/bsd-3 ; opensource\.org/licenses/bsd-3-clause
bsd-4-clause | bsd-4-clause | bsd ; \b(?:original bsd|bsd[- ](?:4|four)[- ]clause)(?: licen[cs]e)? | all advertising materials ; all advertising materials mentioning features or use of this software
bsd | bsd | bsd ; \bbsd(?:-style)? licen[cs]e | redistribution and use ; redistribution and use in source and binary forms
0bsd | 0bsd | zero ; zero[- ]clause bsd(?: licen[cs]e)? | licenses/0bsd ; opensource\.org/licenses/0bsd
mpl-1.1 | mpl-1\.[01] | mozilla ; mozilla public licen[cs]e,? v(?:ersion)?\.? ?1\.[01] | mpl/1 ; mozilla\.org/(?:en-us/)?mpl/1\.[01]
mpl-2.0 | mpl-2\.0(?:-no-copyleft-exception)? | mozilla ; mozilla public licen[cs]e(?:,? v(?:ersion)?\.? ?2(?:\.0)?)? | mpl/2 ; mozilla\.org/(?:en-us/)?mpl/2\.0
epl-1.0 | epl-1\.0 | eclipse ; eclipse public licen[cs]e,? v(?:ersion)?\.? ?1(?:\.0)? | epl-v10 ; eclipse\.org/legal/epl-v10
epl-2.0 | epl-2\.0 | eclipse ; eclipse public licen[cs]e(?:,? v(?:ersion)?\.? ?2(?:\.0)?)? | epl-2.0 ; eclipse\.org/legal/epl-2\.0
edl-1.0 | edl-1\.0 | eclipse ; eclipse distribution licen[cs]e | edl-v10 ; eclipse\.org/org/documents/edl-v10
cddl-1.0 | cddl-1\.[01] | common development ; common development and distribution licen[cs]e | licenses/cddl ; opensource\.org/licenses/cddl-1\.0
cpl-1.0 | cpl-1\.0 | common public ; common public licen[cs]e(?! attribution) | licenses/cpl ; opensource\.org/licenses/cpl1?\.?0?
cpal-1.0 | cpal-1\.0 | common public attribution ; common public attribution licen[cs]e | licenses/cpal ; opensource\.org/licenses/cpal-1\.0
artistic-1.0 | artistic-1\.0(?:-perl|-cl8)? | artistic ; artistic licen[cs]e,? (?:v(?:ersion)?\.? ?)?1(?:\.0)? | licenses/artistic-1 ; opensource\.org/licenses/artistic-1\.0
artistic-2.0 | artistic-2\.0 | artistic ; artistic licen[cs]e(?:,? (?:v(?:ersion)?\.? ?)?2(?:\.0)?)? | licenses/artistic-2 ; opensource\.org/licenses/artistic-2\.0
bsl-1.0 | bsl-1\.0 | boost ; boost software licen[cs]e | license_1_0 ; boost\.org/license_1_0\.txt
busl-1.1 | busl-1\.1 | business source ; business source licen[cs]e(?: 1\.1)? | mariadb.com/bsl ; mariadb\.com/bsl11
sspl-1.0 | sspl-1\.0 | server side ; server side public licen[cs]e | server-side-public ; mongodb\.com/licensing/server-side-public-license
elastic-2.0 | elastic-2\.0 | elastic ; elastic licen[cs]e(?: 2\.0)? | elastic-license ; elastic\.co/licensing/elastic-license
zlib | zlib(?:-acknowledgement)? | zlib ; \bzlib(?:/libpng)? licen[cs]e | licenses/zlib ; opensource\.org/licenses/zlib
libpng | libpng(?:-2\.0)? | libpng ; \blibpng licen[cs]e | libpng.org ; libpng\.org/pub/png/src/libpng-license\.txt
unlicense | unlicense | unlicense ; \bthe unlicense\b | unlicense.org ; unlicense\.org/?
wtfpl | wtfpl | what the ; do what the f\S+ you want to public licen[cs]e | wtfpl ; \bwtfpl\b
cc0-1.0 | cc0-1\.0 | cc0 ; \bcc0(?: 1\.0)?(?: universal)? | publicdomain/zero ; creativecommons\.org/publicdomain/zero/1\.0
public-domain | cc-pddc | public domain ; (?:dedicated|released|placed) (?:in)?to the public domain | publicdomain/mark ; creativecommons\.org/publicdomain/mark/1\.0
cc-by-nc-nd | cc-by-nc-nd-[1234]\.0 | by-nc-nd ; \bcc[- ]by-nc-nd(?: [1234]\.0)? | licenses/by-nc-nd ; creativecommons\.org/licenses/by-nc-nd/[1234]\.0
cc-by-nc-sa | cc-by-nc-sa-[1234]\.0 | by-nc-sa ; \bcc[- ]by-nc-sa(?: [1234]\.0)? | licenses/by-nc-sa ; creativecommons\.org/licenses/by-nc-sa/[1234]\.0
cc-by-nc | cc-by-nc-[1234]\.0 | by-nc ; \bcc[- ]by-nc(?: [1234]\.0)? | licenses/by-nc/ ; creativecommons\.org/licenses/by-nc/[1234]\.0
cc-by-nd | cc-by-nd-[1234]\.0 | by-nd ; \bcc[- ]by-nd(?: [1234]\.0)? | licenses/by-nd/ ; creativecommons\.org/licenses/by-nd/[1234]\.0
cc-by-sa | cc-by-sa-[1234]\.0 | by-sa ; \bcc[- ]by-sa(?: [1234]\.0)? | licenses/by-sa/ ; creativecommons\.org/licenses/by-sa/[1234]\.0
cc-by-4.0 | cc-by-[1234]\.0 | by ; \bcc[- ]by(?: [1234]\.0)? | licenses/by/ ; creativecommons\.org/licenses/by/[1234]\.0
cc-by-nc-nd | cc-by-nc-nd | noncommercial ; creative commons attribution[- ]noncommercial[- ]noderiv\w* | attribution-noncommercial-noderiv ; attribution-noncommercial-noderiv\w* [1234]\.0
cc-by-nc-sa | cc-by-nc-sa | noncommercial ; creative commons attribution[- ]noncommercial[- ]sharealike | attribution-noncommercial-sharealike ; attribution-noncommercial-sharealike [1234]\.0
cc-by-nc | cc-by-nc | noncommercial ; creative commons attribution[- ]noncommercial | attribution-noncommercial ; attribution-noncommercial [1234]\.0
cc-by-sa | cc-by-sa | sharealike ; creative commons attribution[- ]sharealike | attribution-sharealike ; attribution-sharealike [1234]\.0
cc-by-nd | cc-by-nd | noderiv ; creative commons attribution[- ]noderiv\w* | attribution-noderiv ; attribution-noderiv\w* [1234]\.0
cc-by-4.0 | cc-by | creative commons ; creative commons attribution(?: [1234]\.0)? | under a creative commons ; under a creative commons licen[cs]e
ofl-1.1 | ofl-1\.[01](?:-no-rfn|-rfn)? | open font ; (?:sil )?open font licen[cs]e(?:,? v(?:ersion)?\.? ?1\.[01])? | sil.org/ofl ; scripts\.sil\.org/ofl
odbl-1.0 | odbl-1\.0 | open database ; open database licen[cs]e | odbl ; opendatacommons\.org/licenses/odbl
odc-by-1.0 | odc-by-1\.0 | open data commons ; open data commons attribution licen[cs]e | opendatacommons ; opendatacommons\.org/licenses/by
pddl-1.0 | pddl-1\.0 | public domain dedication ; (?:open data commons )?public domain dedication (?:and|&) licen[cs]e | licenses/pddl ; opendatacommons\.org/licenses/pddl
eupl-1.1 | eupl-1\.[01] | european union ; european union public licen[cs]e,? v(?:ersion)?\.? ?1\.[01] | eupl-1.1 ; \beupl-1\.1\b
eupl-1.2 | eupl-1\.2 | european union ; european union public licen[cs]e(?:,? v(?:ersion)?\.? ?1\.2)? | eupl-1.2 ; \beupl-1\.2\b
cecill-2.1 | cecill-(?:1\.[01]|2\.[01]|b|c) | cecill ; \bcecill(?:-[bc])?(?: free software)? licen[cs]e(?: agreement)? | cecill.info ; cecill\.info/licences
osl-3.0 | osl-[123]\.[01] | open software ; open software licen[cs]e(?:,? v(?:ersion)?\.? ?[123]\.[01])? | licenses/osl ; opensource\.org/licenses/osl-3\.0
afl-3.0 | afl-[123]\.[012] | academic free ; academic free licen[cs]e(?:,? v(?:ersion)?\.? ?[123]\.[012])? | licenses/afl ; opensource\.org/licenses/afl-3\.0
ms-pl | ms-pl | microsoft ; microsoft public licen[cs]e | licenses/ms-pl ; opensource\.org/licenses/ms-pl
ms-rl | ms-rl | microsoft ; microsoft reciprocal licen[cs]e | licenses/ms-rl ; opensource\.org/licenses/ms-rl
apsl-2.0 | apsl-[12]\.[012] | apple ; apple public source licen[cs]e | licenses/apsl ; opensource\.org/licenses/apsl-2\.0
ipl-1.0 | ipl-1\.0 | ibm ; ibm public licen[cs]e | licenses/ipl ; opensource\.org/licenses/ipl-1\.0
ncsa | ncsa | ncsa ; (?:university of illinois/)?ncsa (?:open source )?licen[cs]e | licenses/ncsa ; opensource\.org/licenses/ncsa
psf-2.0 | (?:psf|python)-2\.0(?:\.1)? | python ; python (?:software foundation )?licen[cs]e(?: agreement)? | docs.python.org ; docs\.python\.org/\S*/license
php-3.01 | php-3\.0?1? | php ; \bphp licen[cs]e(?:,? v(?:ersion)?\.? ?3\.01)? | php.net/license ; php\.net/license/3_01\.txt
ruby | ruby | ruby ; \bruby licen[cs]e | ruby-lang ; ruby-lang\.org/\S*license
postgresql | postgresql | postgresql ; \bpostgresql licen[cs]e | licenses/postgresql ; opensource\.org/licenses/postgresql
openssl | openssl | openssl ; \bopenssl(?: and ssleay)? licen[cs]e | openssl.org ; openssl\.org/source/license
vim | vim | vim ; \bvim licen[cs]e | vimdoc ; vimdoc\.sourceforge\.net/htmldoc/uganda
w3c | w3c(?:-20150513)? | w3c ; \bw3c (?:software|document)(?: notice and)? licen[cs]e | consortium/legal ; w3\.org/consortium/legal/\S+
upl-1.0 | upl-1\.0 | universal permissive ; universal permissive licen[cs]e | licenses/upl ; oss\.oracle\.com/licenses/upl
blueoak-1.0.0 | blueoak-1\.0\.0 | blue oak ; blue oak model licen[cs]e | blueoakcouncil ; blueoakcouncil\.org/license/1\.0\.0
beerware | beerware | beerware ; \bbeerware licen[cs]e | buy me a beer ; can buy me a beer in return
json | json | json ; \bjson licen[cs]e | not evil ; shall be used for good, not evil
lppl-1.3c | lppl-1\.[0123][ac]? | latex ; latex project public licen[cs]e | lppl ; latex-project\.org/lppl
openrail | (?:bigscience-|creativeml-)?openrail(?:-m|\+\+)? | rail ; \b(?:bigscience |creativeml )?open ?rail(?:-m|\+\+)?(?: licen[cs]e)? | responsible ai ; responsible ai licen[cs]e
llama-community | llama[23](?:\.\d)? | llama ; llama [23](?:\.\d)? community licen[cs]e(?: agreement)? | llama.meta.com ; llama\.meta\.com/llama[23](?:_\d)?/license
"""

#: Priority and confidence of each form.
FORMS = {"spdx": (3, 0.99), "url": (2, 0.9), "title": (1, 0.8)}

#: What becomes one space: runs of white space, and a line's end with the comment marks of the next line.
SPACE = r"[\s\xa0]*[\r\n][\s\xa0*#/;%>|-]*|[\s\xa0]{2,}|[\t\x0b\f\xa0]"
#: The tag, and the ids and operators of an expression before an id.
SPDX = r"spdx-license-identifier\s*:[\s(]*(?:[-\w.+:]+(?:[\s()]+(?:and|or|with)[\s()]+|[\s()]*[,/][\s()]*)){0,200}?"

#: Every rule's pattern holds one of these literals; a text without any of them skips the rules.
ANCHORS = ("licen", "spdx", "creative", "attribution", "public domain", "publicdomain", "cc by", "cc-by", "cc0", "wtfpl", "eupl", "bsd", "permission is hereby", "redistribution and use",
           "advertising materials", "mpl/", "epl-", "edl-", "sil.org/ofl", "mariadb.com/bsl", "openrail", "open rail", "mit no", "consortium/legal", "uganda", "buy me a beer", "not evil", "lppl")


def rules() -> list[dict]:
    """One dict per rule: label, need, pattern, priority, confidence, ordinal, grouped."""
    out: list[dict] = []

    def add(label: str, form: str, need: str, pattern: str) -> None:
        priority, confidence = FORMS[form]
        out.append({"label": label, "need": need, "pattern": pattern, "priority": priority, "confidence": confidence, "ordinal": len(out), "grouped": form == "spdx"})

    for line in _FAMILIES.strip().split("\n"):
        label, spdx, title, url = (x.strip() for x in line.split(" | "))
        add(label, "spdx", "spdx-license-identifier", rf"{SPDX}({spdx})(?![-\w]|\.\w)")
        add(label, "url", *(x.strip() for x in url.split(" ; ")))
        add(label, "title", *(x.strip() for x in title.split(" ; ")))
    return out
