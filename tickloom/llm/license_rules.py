"""Hand-written signatures of licences, in order of priority.

Patterns are read over words: texts are lower-cased and everything but letters, digits and non-ASCII characters
separates words, so ``CC BY-NC 4.0`` reads ``cc by nc 4 0``.  A blank in a pattern is one step from a word to the
next.  Each rule names gate words; a text without any of them can't match, and the rule is not run on it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Priorities, highest first, and how sure a detection of each kind is.
TAG, NOTICE, GRANT, LINK, NAME, MENTION, BASE = range(7)
SURE = {TAG: 1.0, NOTICE: 0.95, GRANT: 0.9, LINK: 0.85, NAME: 0.75, MENTION: 0.6, BASE: 0.5}

# Fixed phrases and labels; every place of these counts, and none is ever suppressed.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

_ANY = "(?: or (?:at your option )?(?:any )?(?:later|newer|greater)(?: versions?)?)"
_GPL = "(?:the )?(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: gpl)?"
_LGPL = "(?:the )?(?:(?:gnu )?lesser general public licen[cs]e|gnu library general public licen[cs]e|(?:gnu )?lesser gpl|gnu library gpl|(?:gnu )?lgpl)(?: lgpl)?"
_AGPL = "(?:the )?(?:gnu )?(?:affero general public licen[cs]e|affero gpl|agpl)(?: agpl)?"
_FDL = "(?:the )?(?:gnu free documentation licen[cs]e|gnu fdl|fdl|gfdl)(?: gfdl| fdl)?"
_CC = "(?:creative commons|cc)(?: cc)?(?: licen[cs]e)?"
_SAY = "(?:licen[cs]ed|released|distributed|re ?distributed|available|provided|published|offered|covered|governed|dual licensed|redistribute it and or modify it)"
_UNDER = f"{_SAY} (?:to you )?(?:under|by|with|subject to|according to|in accordance with)(?: (?:the|a|an))?(?: (?:terms|conditions|terms and conditions|provisions) of)?(?: (?:the|a|an))?"

# label | gate words | name with version | identifier (empty: none) | address (empty: none)
_VERSIONED = f"""
gpl-1.0 | gnu gpl gplv1 | (?:{_GPL} (?:version |v ?)?1(?: 0)?|gplv1) | gpl 1 0(?: only| or later)? | gnu org licenses (?:old licenses )?gpl 1 0
gpl-2.0 | gnu gpl gplv2 | (?:{_GPL} (?:version |v ?)?2(?: 0)?|gplv2) | gpl 2 0 only | gnu org licenses (?:old licenses )?gpl 2 0
gpl-2.0-or-later | gnu gpl gplv2 | (?:{_GPL} (?:version |v ?)?2(?: 0)?|gplv2)(?: of the license)?{_ANY} | gpl 2 0 or later |
gpl-3.0 | gnu gpl gplv3 | (?:{_GPL} (?:version |v ?)?3(?: 0)?|gplv3) | gpl 3 0 only | gnu org licenses gpl 3 0
gpl-3.0-or-later | gnu gpl gplv3 | (?:{_GPL} (?:version |v ?)?3(?: 0)?|gplv3)(?: of the license)?{_ANY} | gpl 3 0 or later |
lgpl-2.0 | gnu lesser lgpl lgplv2 | (?:{_LGPL} (?:version |v ?)?2(?: 0)?|lgplv2) | lgpl 2 0(?: only| or later)? | gnu org licenses (?:old licenses )?lgpl 2 0
lgpl-2.1 | gnu lesser lgpl lgplv2 | (?:{_LGPL} (?:version |v ?)?2 1|lgplv2 1) | lgpl 2 1(?: only| or later)? | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | gnu lesser lgpl lgplv3 | (?:{_LGPL} (?:version |v ?)?3(?: 0)?|lgplv3) | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl 3 0
agpl-1.0 | affero agpl agplv1 | (?:{_AGPL} (?:version |v ?)?1(?: 0)?|agplv1) | agpl 1 0(?: only| or later)? | affero org oagpl
agpl-3.0 | affero agpl agplv3 | (?:{_AGPL} (?:version |v ?)?3(?: 0)?|agplv3) | agpl 3 0(?: only| or later)? | gnu org licenses agpl 3 0
gfdl-1.1 | fdl gfdl gnu | {_FDL} (?:version |v ?)?1 1 | gfdl 1 1(?: only| or later| invariants only| no invariants only)? | gnu org licenses (?:old licenses )?fdl 1 1
gfdl-1.2 | fdl gfdl gnu | {_FDL} (?:version |v ?)?1 2 | gfdl 1 2(?: only| or later| invariants only| no invariants only)? | gnu org licenses (?:old licenses )?fdl 1 2
gfdl-1.3 | fdl gfdl gnu | {_FDL} (?:version |v ?)?1 3 | gfdl 1 3(?: only| or later| invariants only| no invariants only)? | gnu org licenses fdl 1 3
apache-1.0 | apache | apache (?:software )?licen[cs]e (?:version |v ?)?1 0 | apache 1 0 | apache org licenses license 1 0
apache-1.1 | apache | apache (?:software )?licen[cs]e (?:version |v ?)?1 1 | apache 1 1 | apache org licenses license 1 1
apache-2.0 | apache asl | (?:apache (?:software |public )?(?:licen[cs]e )?(?:version |v ?)?2(?: 0)?(?: licen[cs]e)?|asl 2 0) | apache 2 0 | apache org licenses license 2 0
mpl-1.0 | mozilla mpl | (?:mozilla public licen[cs]e(?: mpl)?|mpl) (?:version |v ?)?1 0 | mpl 1 0 | mozilla org mpl mpl 1 0
mpl-1.1 | mozilla mpl | (?:mozilla public licen[cs]e(?: mpl)?|mpl) (?:version |v ?)?1 1 | mpl 1 1 | mozilla org mpl mpl 1 1
mpl-2.0 | mozilla mpl | (?:mozilla public licen[cs]e(?: mpl)?|mpl) (?:version |v ?)?2 0 | mpl 2 0(?: no copyleft exception)? | mozilla org mpl 2 0
epl-1.0 | eclipse epl | (?:eclipse public licen[cs]e(?: epl)?|epl) (?:version |v ?)?1 0 | epl 1 0 | eclipse org legal epl v10
epl-2.0 | eclipse epl | (?:eclipse public licen[cs]e(?: epl)?|epl) (?:version |v ?)?2 0 | epl 2 0 | eclipse org legal epl (?:v20|2 0)
edl-1.0 | eclipse edl | (?:eclipse distribution licen[cs]e(?: edl)?|edl) (?:version |v ?)?1 0 | | eclipse org org documents edl v10
eupl-1.1 | eupl european | (?:european union public licen[cs]e(?: eupl)?|eupl) (?:version |v ?)?1 1 | eupl 1 1 |
eupl-1.2 | eupl european | (?:european union public licen[cs]e(?: eupl)?|eupl) (?:version |v ?)?1 2 | eupl 1 2 | joinup ec europa eu (?:[^ ]+ )?eupl
cddl-1.0 | cddl | (?:common development and distribution licen[cs]e )?cddl (?:version |v ?)?1 0 | cddl 1 0 | opensource org licenses cddl 1 0
cddl-1.1 | cddl | (?:common development and distribution licen[cs]e )?cddl (?:version |v ?)?1 1 | cddl 1 1 |
cpl-1.0 | cpl | (?:common public licen[cs]e )?cpl (?:version |v ?)?1 0 | cpl 1 0 | opensource org licenses cpl 1 0
ipl-1.0 | ibm | ibm public licen[cs]e (?:version |v ?)?1 0 | ipl 1 0 |
artistic-1.0 | artistic | artistic licen[cs]e (?:version |v ?)?1 0 | artistic 1 0(?: perl| cl8)? | opensource org licenses artistic license 1 0
artistic-2.0 | artistic | artistic licen[cs]e (?:version |v ?)?2 0 | artistic 2 0 | opensource org licenses artistic license 2 0
afl-3.0 | afl academic | (?:academic free licen[cs]e|afl) (?:version |v ?)?3 0 | afl 3 0 |
afl-2.1 | afl academic | (?:academic free licen[cs]e|afl) (?:version |v ?)?2 1 | afl 2 1 |
osl-3.0 | osl | (?:open software licen[cs]e )?osl (?:version |v ?)?3 0 | osl 3 0 | opensource org licenses osl 3 0
osl-2.1 | osl | (?:open software licen[cs]e )?osl (?:version |v ?)?2 1 | osl 2 1 |
bsl-1.0 | boost bsl | (?:boost software licen[cs]e|bsl)(?: boost)? (?:version |v ?)?1 0 | bsl 1 0 | boost org license 1 0
zpl-2.1 | zope zpl | (?:zope public licen[cs]e(?: zpl)?|zpl) (?:version |v ?)?2 1 | zpl 2 1 |
zpl-2.0 | zope zpl | (?:zope public licen[cs]e(?: zpl)?|zpl) (?:version |v ?)?2 0 | zpl 2 0 |
php-3.01 | php | php licen[cs]e (?:version |v ?)?3 01 | php 3 01 | php net license 3 01
php-3.0 | php | php licen[cs]e (?:version |v ?)?3 0 | php 3 0 | php net license 3 0
python-2.0 | python psf | (?:python software foundation|psf|python) licen[cs]e (?:agreement )?(?:version |v ?)?2(?: 0)? | (?:python|psf) 2 0 | docs python org 3 license
ruby | ruby | ruby licen[cs]e | ruby | ruby lang org en about license
openssl | openssl | openssl licen[cs]e | openssl | openssl org source license
ofl-1.0 | font ofl | (?:sil )?(?:open font licen[cs]e|ofl) (?:version |v ?)?1 0 | ofl 1 0 |
ofl-1.1 | font ofl | (?:sil )?(?:open font licen[cs]e|ofl) (?:version |v ?)?1 1 | ofl 1 1(?: rfn| no rfn)? | scripts sil org ofl
ms-pl | microsoft ms | (?:microsoft|ms) public licen[cs]e(?: ms pl)? | ms pl | opensource org licenses ms pl
ms-rl | microsoft ms | (?:microsoft|ms) reciprocal licen[cs]e(?: ms rl)? | ms rl | opensource org licenses ms rl
cecill-2.1 | cecill | cecill (?:free software )?(?:licen[cs]e )?(?:version |v ?)?2 1 | cecill 2 1 | cecill info licences licence cecill v2 1
cecill-b | cecill | cecill b(?: licen[cs]e)? | cecill b | cecill info licences licence cecill b
cecill-c | cecill | cecill c(?: licen[cs]e)? | cecill c | cecill info licences licence cecill c
odbl-1.0 | odbl odc | (?:open (?:data commons )?(?:open )?database licen[cs]e )?odbl(?: (?:version |v ?)?1 0)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by-1.0 | odc | (?:open data commons attribution licen[cs]e )?odc by(?: (?:version |v ?)?1 0)? | odc by 1 0 | opendatacommons org licenses by
pddl-1.0 | pddl | (?:public domain dedication and licen[cs]e )?pddl(?: (?:version |v ?)?1 0)? | pddl 1 0 | opendatacommons org licenses pddl
cc0-1.0 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
cc-by-1.0 | cc creative | {_CC} (?:by|attribution)(?: cc by)? 1 0(?: (?:generic|international|unported))? | cc by 1 0 | creativecommons org licenses by 1 0
cc-by-2.0 | cc creative | {_CC} (?:by|attribution)(?: cc by)? 2 0(?: (?:generic|international|unported))? | cc by 2 0 | creativecommons org licenses by 2 0
cc-by-2.5 | cc creative | {_CC} (?:by|attribution)(?: cc by)? 2 5(?: (?:generic|international|unported))? | cc by 2 5 | creativecommons org licenses by 2 5
cc-by-3.0 | cc creative | {_CC} (?:by|attribution)(?: cc by)? 3 0(?: (?:generic|international|unported))? | cc by 3 0 | creativecommons org licenses by 3 0
cc-by-4.0 | cc creative | {_CC} (?:by|attribution)(?: cc by)? 4 0(?: (?:generic|international|unported))? | cc by 4 0 | creativecommons org licenses by 4 0
cc-by-sa-1.0 | cc creative | {_CC} (?:by sa|attribution share ?alike) 1 0 | cc by sa 1 0 | creativecommons org licenses by sa 1 0
cc-by-sa-2.0 | cc creative | {_CC} (?:by sa|attribution share ?alike) 2 0 | cc by sa 2 0 | creativecommons org licenses by sa 2 0
cc-by-sa-2.5 | cc creative | {_CC} (?:by sa|attribution share ?alike) 2 5 | cc by sa 2 5 | creativecommons org licenses by sa 2 5
cc-by-sa-3.0 | cc creative | {_CC} (?:by sa|attribution share ?alike) 3 0 | cc by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | cc creative | {_CC} (?:by sa|attribution share ?alike) 4 0 | cc by sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-nd-3.0 | cc creative | {_CC} (?:by nd|attribution no ?deriv(?:ative)?s?) 3 0 | cc by nd 3 0 | creativecommons org licenses by nd 3 0
cc-by-nd-4.0 | cc creative | {_CC} (?:by nd|attribution no ?deriv(?:ative)?s?) 4 0 | cc by nd 4 0 | creativecommons org licenses by nd 4 0
cc-by-nc-2.0 | cc creative | {_CC} (?:by nc|attribution non ?commercial) 2 0 | cc by nc 2 0 | creativecommons org licenses by nc 2 0
cc-by-nc-3.0 | cc creative | {_CC} (?:by nc|attribution non ?commercial) 3 0 | cc by nc 3 0 | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | cc creative | {_CC} (?:by nc|attribution non ?commercial) 4 0 | cc by nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nc-sa-3.0 | cc creative | {_CC} (?:by nc sa|attribution non ?commercial share ?alike) 3 0 | cc by nc sa 3 0 | creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 | cc creative | {_CC} (?:by nc sa|attribution non ?commercial share ?alike) 4 0 | cc by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0 | cc creative | {_CC} (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?) 3 0 | cc by nc nd 3 0 | creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0 | cc creative | {_CC} (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?) 4 0 | cc by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
bsd-2-clause | bsd freebsd | (?:(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: style)?(?: licen[cs]e)?|freebsd licen[cs]e) | bsd 2 clause(?: patent| views)? | opensource org licenses bsd 2 clause
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: style)?(?: licen[cs]e)? | bsd 3 clause(?: clear| lbnl| attribution)? | opensource org licenses bsd 3 clause
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: style)?(?: licen[cs]e)? | bsd 4 clause(?: uc)? | directory fsf org wiki license bsd 4clause
0bsd | bsd 0bsd | (?:0bsd|zero clause bsd|bsd zero clause|bsd 0 clause)(?: licen[cs]e)? | 0bsd | opensource org licenses 0bsd
mit | mit expat x11 | (?:mit|expat|x11|mit x11|mit expat)(?: style)? licen[cs]e | mit | opensource org licen[cs]es? mit
mit-0 | mit | (?:mit no attribution|mit 0)(?: licen[cs]e)? | mit 0 | github com aws mit 0
isc | isc consortium | (?:isc|internet (?:systems|software) consortium) licen[cs]e | isc | opensource org licenses isc
zlib | zlib libpng | (?:zlib|libpng|zlib libpng) licen[cs]e | zlib | zlib net zlib license
unlicense | unlicense | (?:the )?unlicense(?: licen[cs]e)? | unlicense | unlicense org
wtfpl | wtfpl fuck | (?:wtfpl|do what the fuck you want to public licen[cs]e) | wtfpl | wtfpl net
ncsa | ncsa | (?:university of illinois )?ncsa (?:open source )?licen[cs]e | ncsa | opensource org licenses (?:uoi )?ncsa
postgresql | postgresql | postgresql licen[cs]e | postgresql | postgresql org about licence
curl | curl | curl licen[cs]e | curl | curl se docs copyright
vim | vim | vim licen[cs]e | vim |
beerware | beerware beer | (?:beerware|beer ware) licen[cs]e | beerware |
jpl-image | jpl | jpl image use policy | jpl image |
bittorrent-1.1 | bittorrent | bittorrent open source licen[cs]e (?:version |v ?)?1 1 | bittorrent 1 1 |
nposl-3.0 | profit nposl | non profit open software licen[cs]e (?:version |v ?)?3 0 | nposl 3 0 |
upl-1.0 | upl universal | (?:universal permissive licen[cs]e(?: upl)?|upl) (?:version |v ?)?1 0 | upl 1 0 | oss oracle com licenses upl
mulanpsl-2.0 | mulan mulanpsl | (?:mulan permissive software licen[cs]e|mulan psl|mulanpsl) (?:version |v ?)?2 | mulanpsl 2 0 | license coscl org cn mulanpsl2
blueoak-1.0.0 | blue blueoak | blue oak model licen[cs]e(?: (?:version |v ?)?1 0 0)? | blueoak 1 0 0 | blueoakcouncil org license 1 0 0
elastic-2.0 | elastic | elastic licen[cs]e (?:version |v ?)?2(?: 0)? | elastic 2 0 | elastic co licensing elastic license
sspl-1.0 | sspl | (?:server side public licen[cs]e )?sspl(?: (?:version |v ?)?1(?: 0)?)? | sspl 1 0 | mongodb com licensing server side public license
busl-1.1 | business busl | (?:business source licen[cs]e|busl) (?:version |v ?)?1 1 | busl 1 1 | mariadb com bsl11
polyform-noncommercial | polyform | polyform non ?commercial(?: licen[cs]e)?(?: 1 0 0)? | polyform noncommercial 1 0 0 | polyformproject org licenses noncommercial
polyform-small-business | polyform | polyform small business(?: licen[cs]e)?(?: 1 0 0)? | polyform small business 1 0 0 | polyformproject org licenses small business
openrail-m | openrail rail | (?:bigscience )?(?:creativeml )?open ?rail m(?: licen[cs]e)? | | huggingface co (?:[^ ]+ )*license openrail
"""

# label | gate words | sentence that only texts and headers of that licence have
_NOTICES = """
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | endorse | neither the name of (?:[^ ]+ ){1,12}(?:nor|or) the names of its contributors may be used to endorse or promote products derived from this software
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2.0 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | license | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1 | apache | this product includes software developed by the apache software foundation
gpl | gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | gnu | you should have received a copy of the gnu general public license along with this program
gpl | warranty | this program is distributed in the hope that it will be useful but without any warranty
gpl-2.0-or-later | gnu | the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | gnu | the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0 | gnu | the gnu general public license as published by the free software foundation version 2(?: of the license)?
gpl-3.0 | gnu | the gnu general public license as published by the free software foundation version 3(?: of the license)?
lgpl | gnu | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | gnu | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)
agpl | affero | you should have received a copy of the gnu affero general public license along with this program
gfdl | gnu | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
cddl | distribution | the contents of this file are subject to the terms of the common development and distribution license(?: cddl)?
bsl-1.0 | boost | distributed under the boost software license version 1 0
bsl-1.0 | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | origin | the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | you just do what the fuck you want to
beerware | retain | as long as you retain this notice you can do whatever you want with this stuff
ofl-1.1 | font | this font software is licensed under the sil open font license version 1 1
python-2.0 | psf | psf is making python available to licensee on an as is basis
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 | php | this product includes php software freely available from
postgresql | permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
cc0-1.0 | waived | to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright and related or neighboring rights
cc-by-4.0 | creative | this work is licensed under (?:a|the) creative commons attribution 4 0 international license
cc-by-sa-4.0 | creative | this work is licensed under (?:a|the) creative commons attribution share ?alike 4 0 international license
cc-by-nc-4.0 | creative | this work is licensed under (?:a|the) creative commons attribution non ?commercial 4 0 international license
cc-by-nc-sa-4.0 | creative | this work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike 4 0 international license
cc-by-nc-nd-4.0 | creative | this work is licensed under (?:a|the) creative commons attribution non ?commercial no ?derivatives 4 0 international license
public-domain | domain | (?:this (?:work|file|text|software|image|document) (?:is|was)|has been|is hereby) (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | domain | no (?:known )?copyright restrictions public domain
all-rights-reserved | reserved | copyright (?:c )?(?:[^ ]+ ){1,8}all rights reserved
proprietary | confidential | proprietary and confidential unauthorized copying
proprietary | proprietary confidential | this (?:software|program|material|document) (?:is|contains) (?:the )?(?:proprietary|confidential)(?: and (?:proprietary|confidential))?(?: information)?
proprietary | permission | may not be (?:reproduced|copied|distributed|republished|redistributed) without (?:the )?(?:prior |express |prior written |express written |written )?permission
"""

# label | gate words | name without a version
_MENTIONS = f"""
gpl | gpl gpls gnugpl | (?:gnu )?gpl(?:s| licen[cs]e[ds]?)?
gpl | gnu | gnu general public licen[cs]es?
lgpl | lgpl | (?:gnu )?lgpl(?: licen[cs]e[ds]?)?
lgpl | gnu lesser | (?:(?:gnu )?lesser|gnu library) general public licen[cs]e
agpl | agpl | (?:gnu )?agpl(?: licen[cs]e[ds]?)?
agpl | affero | (?:gnu )?affero general public licen[cs]e
gfdl | gfdl gnu | (?:gfdl|gnu free documentation licen[cs]e)
apache | apache | apache (?:software |public )?licen[cs]e[ds]?
mpl | mozilla mpl | (?:mozilla public licen[cs]e|mpl)
epl | eclipse | eclipse public licen[cs]e
edl | eclipse | eclipse distribution licen[cs]e
eupl | eupl european | (?:european union public licen[cs]e|eupl)
cddl | cddl development | (?:common development and distribution licen[cs]e(?: cddl)?|cddl)
cpl | public | common public licen[cs]e
bsd | bsd | bsd(?: style)? licen[cs]e[ds]?
mit | mit | mit licen[cs]e[ds]
artistic | artistic | artistic licen[cs]e
afl | academic | academic free licen[cs]e
osl | software | open software licen[cs]e
bsl | boost | boost software licen[cs]e
ofl | font | open font licen[cs]e
php | php | php licen[cs]e
python | python psf | (?:python software foundation|psf|python) licen[cs]e(?: agreement)?
cecill | cecill | cecill(?: licen[cs]e)?
odbl | database | open (?:data commons )?(?:open )?database licen[cs]e
elastic | elastic | elastic licen[cs]e
sspl | server | server side public licen[cs]e
busl | business | business source licen[cs]e
cc | creative | creative commons(?: licen[cs]e[ds]?)?
cc0 | public | public domain dedication
cc-by | cc creative | {_CC} (?:by|attribution)
cc-by-sa | cc creative | {_CC} (?:by sa|attribution share ?alike)
cc-by-nd | cc creative | {_CC} (?:by nd|attribution no ?deriv(?:ative)?s?)
cc-by-nc | cc creative | {_CC} (?:by nc|attribution non ?commercial)
cc-by-nc-sa | cc creative | {_CC} (?:by nc sa|attribution non ?commercial share ?alike)
cc-by-nc-nd | cc creative | {_CC} (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?)
public-domain | domain | (?:in|into|to) the public domain
proprietary | reserved | all rights reserved
copyleft | copyleft | copyleft(?: licen[cs]e)?
"""


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    gates: tuple[str, ...]
    pattern: str  # over words


def _rows(table: str) -> list[list[str]]:
    """Fields are set apart by a bar between blanks; alternatives in patterns have none before theirs."""
    return [[f.strip() for f in re.split(r" \|(?= |$)", line)] for line in table.strip().split("\n")]


def _all_rules() -> list[Rule]:
    out = []
    for label, gates, name, tag, link in _rows(_VERSIONED):
        words = tuple(gates.split())
        if tag:
            out.append(Rule(label, TAG, ("spdx",), f"spdx license identifier {tag}"))
        out.append(Rule(label, GRANT, words, f"{_UNDER} {name}"))
        if link:
            # An address is run on texts with one of its own words, not the family's.
            out.append(Rule(label, LINK, tuple(w for w in link.split() if w.isalnum())[:1], f"(?:https? )?(?:www )?{link}"))
        out.append(Rule(label, NAME, words, name))
    out += [Rule(label, NOTICE, tuple(gates.split()), text) for label, gates, text in _rows(_NOTICES)]
    out += [Rule(label, MENTION, tuple(gates.split()), name) for label, gates, name in _rows(_MENTIONS)]
    out += [Rule(label, BASE, tuple(phrase.split())[:1], phrase) for label, phrase in PHRASES]
    return sorted(out, key=lambda r: r.priority)


RULES = _all_rules()


def over_words(pattern: str) -> str:
    """The pattern for texts in which every word stands between two blanks of its own."""
    return f" {pattern.replace(' ?', 'BLANK?').replace(' ', '  ').replace('BLANK?', '(?:  )?')} "
