"""Signature rules for licences, written by hand.

A rule is a line `label | keyword / keyword | pattern`; it is tried only where one of the keywords occurs. Every alternative
of a pattern holds one, but for ms-pl, whose sentence ms-rl has as well. Patterns see a text's words,
lower-cased and joined by single spaces, so `version 2.0` reads `version 2 0`. Rules of an earlier tier win over those of
a later one. Gaps are bounded, so a pattern takes time in proportion to the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Tier -> confidence of a detection.
CONFIDENCE = {"text": 1.0, "tag": 0.95, "version": 0.9, "name": 0.7}

#: Sentences of the licences' own texts and standard notices.
TEXT = r"""
mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | without restriction including without limitation | deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit-0 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy(?: \S+){1,60} and to permit persons to whom the software is furnished to do so the software is provided
x11 | name of the x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
isc | permission to use copy modify and | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
0bsd | permission to use copy modify and | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
hpnd | permission to use copy modify and distribute this | permission to use copy modify and distribute this software and its documentation for any purpose
bsd-4-clause | advertising materials mentioning | all advertising materials mentioning features or use of this software must display
bsd-3-clause | nor the names of its contributors | neither the name of(?: \S+){1,12} nor the names of its contributors may be used to endorse or promote
bsd-2-clause | redistribution and use in source | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-source-code | redistributions of source code must | redistributions of source code must retain the above copyright notice
apache-2.0 | you may not use this file except | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | terms and conditions for use reproduction | apache license version 2 0 january 2004(?: \S+){0,12} terms and conditions for use reproduction and distribution
apache-1.1 | developed by the apache software foundation | this product includes software developed by the apache software foundation
apache-1.0 | developed by the apache group | this product includes software developed by the apache group
gpl-2.0-or-later | either version 2 of the license | gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-3.0-or-later | either version 3 of the license | gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
gpl-1.0-or-later | either version 1 | gnu general public license as published by the free software foundation either version 1(?: of the license)? or (?:at your option )?any later version
gpl-2.0-only | version 2 of the license | gnu general public license as published by the free software foundation version 2 of the license
gpl-3.0-only | version 3 of the license | gnu general public license as published by the free software foundation version 3 of the license
gpl | received a copy of the gnu general public | you should have received a copy of the gnu general public license along with
lgpl-2.1-or-later | either version 2 1 of the license | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
lgpl-3.0-or-later | either version 3 of the license | gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
lgpl-2.0-or-later | gnu library general public | gnu library general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
lgpl | gnu lesser general public | you should have received a copy of the gnu lesser general public license along with
agpl-3.0-or-later | gnu affero general public | gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
agpl | gnu affero general public | you should have received a copy of the gnu affero general public license along with
fdl | gnu free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0 | mozilla public license v 2 0 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla public license version 1 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | mozilla public license version 1 0 | the contents of this file are subject to the mozilla public license version 1 0
npl-1.1 | netscape public license | the contents of this file are subject to the netscape public license version 1 1
epl-2.0 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version) ?2 0
epl-1.0 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version) ?1 0
epl-1.0 | eclipse public license agreement | the accompanying program is provided under the terms of this eclipse public license agreement
cpl-1.0 | common public license | the accompanying program is provided under the terms of this common public license
ipl-1.0 | ibm public license | the accompanying program is provided under the terms of this ibm public license
cddl-1.0 | common development and distribution | the contents of this file are subject to the terms of the common development and distribution license
cc0-1.0 | waived all copyright and related | has waived all copyright and related or neighboring rights
cc0-1.0 | dedicate any and all copyright | dedicate any and all copyright interest(?: \S+){0,6} to the public domain
unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy modify | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | everyone is permitted to copy and distribute | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
zlib | without any express or implied | this software is provided as is without any express or implied warranty in no event will the authors be held liable
bsl-1.0 | to any person or organization obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
bsl-1.0 | to any person or organization obtaining | free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
artistic-2.0 | everyone is permitted to copy | the artistic license 2 0(?: \S+){0,20} everyone is permitted to copy and distribute verbatim copies
artistic-1.0 | artistic control over the development | the copyright holder maintains some semblance of artistic control over the development of the package
psf-2.0 | between the python software foundation | this license agreement is between the python software foundation
ofl-1.1 | sil open font license | this font software is licensed under the sil open font license version 1 1
ncsa | university of illinois | developed by(?: \S+){1,20} university of illinois
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | cryptographic software written by eric young | this product includes cryptographic software written by eric young
php-3.01 | php software freely available | this product includes php software freely available from
afl-3.0 | academic free license | licensed under the academic free license version 3 0
osl-3.0 | open software license | licensed under the open software license version 3 0
eupl-1.2 | licensed under the eupl | licensed under the eupl version 1 2 or(?: [–—])? as soon they will be approved by the european commission(?: [–—])? subsequent versions
upl-1.0 | associated documentation and or data | any person obtaining a copy of this software associated documentation and or data collectively the software
ms-pl | microsoft public license | this license governs use of the accompanying software if you use the software you accept this license
odbl-1.0 | open database license | made available under the open database license
odc-by | open data commons attribution | made available under the open data commons attribution license
pddl-1.0 | public domain dedication and license | made available under the public domain dedication and license
ogl-uk-3.0 | open government licence | contains public sector information licensed under the open government licence v3 0
proprietary | all rights reserved | all rights reserved (?:no part of|unauthorized|reproduction|may not be)
proprietary | confidential and proprietary | (?:this (?:software|document|material) is |strictly )?confidential and proprietary(?: information)?
proprietary | no part of this publication | no part of this publication may be reproduced
"""

#: Machine-readable identifiers, behind `SPDX-License-Identifier:` or as a `license:` field.
TAG = r"""
mit | identifier mit | spdx license identifier mit\b(?! 0)
mit-0 | identifier mit 0 | spdx license identifier mit 0
apache-2.0 | identifier apache | spdx license identifier apache 2 0
apache-1.1 | identifier apache | spdx license identifier apache 1 1
gpl-2.0-only | identifier gpl | spdx license identifier gpl 2 0(?: only)?\b(?! or later)
gpl-2.0-or-later | identifier gpl | spdx license identifier gpl 2 0 or later
gpl-3.0-only | identifier gpl | spdx license identifier gpl 3 0(?: only)?\b(?! or later)
gpl-3.0-or-later | identifier gpl | spdx license identifier gpl 3 0 or later
lgpl-2.1-only | identifier lgpl | spdx license identifier lgpl 2 1(?: only)?\b(?! or later)
lgpl-2.1-or-later | identifier lgpl | spdx license identifier lgpl 2 1 or later
lgpl-3.0-only | identifier lgpl | spdx license identifier lgpl 3 0(?: only)?\b(?! or later)
lgpl-3.0-or-later | identifier lgpl | spdx license identifier lgpl 3 0 or later
agpl-3.0-only | identifier agpl | spdx license identifier agpl 3 0(?: only)?\b(?! or later)
agpl-3.0-or-later | identifier agpl | spdx license identifier agpl 3 0 or later
bsd-2-clause | identifier bsd | spdx license identifier bsd 2 clause
bsd-3-clause | identifier bsd | spdx license identifier bsd 3 clause
bsd-4-clause | identifier bsd | spdx license identifier bsd 4 clause
0bsd | identifier 0bsd | spdx license identifier 0bsd
isc | identifier isc | spdx license identifier isc
zlib | identifier zlib | spdx license identifier zlib
mpl-1.1 | identifier mpl | spdx license identifier mpl 1 1
mpl-2.0 | identifier mpl | spdx license identifier mpl 2 0
epl-1.0 | identifier epl | spdx license identifier epl 1 0
epl-2.0 | identifier epl | spdx license identifier epl 2 0
cddl-1.0 | identifier cddl | spdx license identifier cddl 1 0
cc0-1.0 | identifier cc0 | spdx license identifier cc0 1 0
cc-by-4.0 | identifier cc by | spdx license identifier cc by 4 0
cc-by-3.0 | identifier cc by | spdx license identifier cc by 3 0
cc-by-sa-4.0 | identifier cc by | spdx license identifier cc by sa 4 0
cc-by-sa-3.0 | identifier cc by | spdx license identifier cc by sa 3 0
cc-by-nc-4.0 | identifier cc by | spdx license identifier cc by nc 4 0
cc-by-nc-sa-4.0 | identifier cc by | spdx license identifier cc by nc sa 4 0
cc-by-nd-4.0 | identifier cc by | spdx license identifier cc by nd 4 0
cc-by-nc-nd-4.0 | identifier cc by | spdx license identifier cc by nc nd 4 0
unlicense | identifier unlicense | spdx license identifier unlicense
wtfpl | identifier wtfpl | spdx license identifier wtfpl
bsl-1.0 | identifier bsl | spdx license identifier bsl 1 0
artistic-2.0 | identifier artistic | spdx license identifier artistic 2 0
psf-2.0 | identifier psf | spdx license identifier psf 2 0
ofl-1.1 | identifier ofl | spdx license identifier ofl 1 1
eupl-1.2 | identifier eupl | spdx license identifier eupl 1 2
ms-pl | identifier ms pl | spdx license identifier ms pl
ncsa | identifier ncsa | spdx license identifier ncsa
upl-1.0 | identifier upl | spdx license identifier upl 1 0
odbl-1.0 | identifier odbl | spdx license identifier odbl 1 0
pddl-1.0 | identifier pddl | spdx license identifier pddl 1 0
sspl-1.0 | identifier sspl | spdx license identifier sspl 1 0
busl-1.1 | identifier busl | spdx license identifier busl 1 1
proprietary | identifier licenseref | spdx license identifier licenseref(?: \S+){1,3}
"""

#: Names with a version, and addresses of licences.
VERSION = r"""
gpl-2.0 | general public license | gnu general public license (?:gpl )?(?:v|version )?2(?: 0)?\b
gpl-3.0 | general public license | gnu general public license (?:gpl )?(?:v|version )?3(?: 0)?\b
gpl-1.0 | general public license | gnu general public license (?:gpl )?(?:v|version )?1(?: 0)?\b
gpl-2.0 | gnu gpl | gnu gpl (?:v|version )?2(?: 0)?\b
gpl-3.0 | gnu gpl | gnu gpl (?:v|version )?3(?: 0)?\b
gpl-2.0 | gplv2 | \bgplv2\b
gpl-3.0 | gplv3 | \bgplv3\b
gpl-2.0 | gpl 2 0 | \bgpl 2 0\b
gpl-3.0 | gpl 3 0 | \bgpl 3 0\b
gpl-2.0-or-later | gpl 2 0 or later | \bgpl 2 0 or later\b
gpl-3.0-or-later | gpl 3 0 or later | \bgpl 3 0 or later\b
gpl-2.0 | licenses gpl 2 0 | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | licenses gpl 3 0 | gnu org licenses gpl 3 0
lgpl-2.0 | library general public | gnu library general public license (?:v|version )?2(?: 0)?\b
lgpl-2.1 | lesser general public | gnu lesser general public license (?:lgpl )?(?:v|version )?2 1\b
lgpl-3.0 | lesser general public | gnu lesser general public license (?:lgpl )?(?:v|version )?3(?: 0)?\b
lgpl-2.1 | lgpl 2 1 | \blgpl 2 1\b
lgpl-3.0 | lgpl 3 0 | \blgpl 3 0\b
lgpl-2.1 | lgplv2 | \blgplv2 ?1?\b
lgpl-3.0 | lgplv3 | \blgplv3\b
agpl-3.0 | affero general public | gnu affero general public license (?:agpl )?(?:v|version )?3(?: 0)?\b
agpl-1.0 | affero general public | affero general public license (?:v|version )?1(?: 0)?\b
agpl-3.0 | agplv3 | \bagplv3\b
agpl-3.0 | agpl 3 0 | \bagpl 3 0\b
fdl-1.3 | free documentation license | gnu free documentation license (?:v|version )?1 3\b
fdl-1.2 | free documentation license | gnu free documentation license (?:v|version )?1 2\b
fdl-1.1 | free documentation license | gnu free documentation license (?:v|version )?1 1\b
apache-2.0 | apache license | apache license (?:v|version )?2(?: 0)?\b
apache-1.1 | apache license / apache software license | apache (?:software )?license (?:v|version )?1 1\b
apache-1.0 | apache license / apache software license | apache (?:software )?license (?:v|version )?1 0\b
apache-2.0 | apache software license | apache software license (?:v|version )?2(?: 0)?\b
apache-2.0 | apache 2 0 license | apache 2 0 licensed?\b
apache-2.0 | licenses license 2 0 | apache org licenses license 2 0
bsd-2-clause | bsd license | (?:2|two) clause bsd license
bsd-3-clause | bsd license | (?:3|three) clause bsd license
bsd-4-clause | bsd license | (?:4|four) clause bsd license
bsd-2-clause | bsd 2 clause | \bbsd 2 clause\b
bsd-3-clause | bsd 3 clause | \bbsd 3 clause\b
bsd-4-clause | bsd 4 clause | \bbsd 4 clause\b
bsd-2-clause | simplified bsd | simplified bsd license
bsd-3-clause | new bsd license | (?:the )?new bsd license
bsd-3-clause | modified bsd | modified bsd license
bsd-2-clause | freebsd license | freebsd license
mit | licenses mit / license mit | opensource org licenses? mit\b
isc | licenses isc / license isc | opensource org licenses? isc\b
bsd-3-clause | licenses bsd 3 / license bsd 3 | opensource org licenses? bsd 3 clause
bsd-2-clause | licenses bsd 2 / license bsd 2 | opensource org licenses? bsd 2 clause
mpl-1.0 | mozilla public license | mozilla public license (?:mpl )?(?:v ?|version )?1 0\b
mpl-1.1 | mozilla public license | mozilla public license (?:mpl )?(?:v ?|version )?1 1\b
mpl-2.0 | mozilla public license | mozilla public license (?:mpl )?(?:v ?|version )?2(?: 0)?\b
mpl-2.0 | mozilla org mpl | mozilla org mpl 2 0
mpl-2.0 | mpl 2 0 | \bmpl 2 0\b
epl-1.0 | eclipse public license | eclipse public license (?:epl )?(?:v ?|version )?1(?: 0)?\b
epl-2.0 | eclipse public license | eclipse public license (?:epl )?(?:v ?|version )?2(?: 0)?\b
epl-1.0 | legal epl v10 | eclipse org legal epl v10
epl-2.0 | legal epl 2 0 | eclipse org legal epl 2 0
cddl-1.0 | development and distribution license | common development and distribution license (?:cddl )?(?:v ?|version )?1 0\b
cddl-1.1 | development and distribution license | common development and distribution license (?:cddl )?(?:v ?|version )?1 1\b
cpl-1.0 | common public license | common public license (?:v ?|version )?1 0\b
ipl-1.0 | ibm public license | ibm public license (?:v ?|version )?1 0\b
cc-by-1.0 | cc by 1 0 | \bcc by 1 0\b
cc-by-2.0 | cc by 2 0 | \bcc by 2 0\b
cc-by-2.5 | cc by 2 5 | \bcc by 2 5\b
cc-by-3.0 | cc by 3 0 | \bcc by 3 0\b
cc-by-4.0 | cc by 4 0 | \bcc by 4 0\b
cc-by-sa-2.0 | cc by sa 2 0 | \bcc by sa 2 0\b
cc-by-sa-2.5 | cc by sa 2 5 | \bcc by sa 2 5\b
cc-by-sa-3.0 | cc by sa 3 0 | \bcc by sa 3 0\b
cc-by-sa-4.0 | cc by sa 4 0 | \bcc by sa 4 0\b
cc-by-nc-2.0 | cc by nc 2 0 | \bcc by nc 2 0\b
cc-by-nc-3.0 | cc by nc 3 0 | \bcc by nc 3 0\b
cc-by-nc-4.0 | cc by nc 4 0 | \bcc by nc 4 0\b
cc-by-nc-sa-3.0 | cc by nc sa 3 0 | \bcc by nc sa 3 0\b
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | \bcc by nc sa 4 0\b
cc-by-nc-nd-3.0 | cc by nc nd 3 0 | \bcc by nc nd 3 0\b
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | \bcc by nc nd 4 0\b
cc-by-nd-3.0 | cc by nd 3 0 | \bcc by nd 3 0\b
cc-by-nd-4.0 | cc by nd 4 0 | \bcc by nd 4 0\b
cc0-1.0 | cc0 1 0 | \bcc0 1 0(?: universal)?\b
cc-by-4.0 | commons attribution 4 0 | creative commons attribution 4 0 (?:international|license)
cc-by-3.0 | commons attribution 3 0 | creative commons attribution 3 0 (?:unported|license)
cc-by-sa-4.0 | attribution sharealike 4 0 | creative commons attribution sharealike 4 0
cc-by-sa-4.0 | attribution share alike 4 0 | creative commons attribution share alike 4 0
cc-by-sa-3.0 | attribution sharealike 3 0 | creative commons attribution sharealike 3 0
cc-by-sa-3.0 | attribution share alike 3 0 | creative commons attribution share alike 3 0
cc-by-nc-4.0 | attribution noncommercial 4 0 | creative commons attribution noncommercial 4 0
cc-by-nc-4.0 | attribution non commercial 4 0 | creative commons attribution non commercial 4 0
cc-by-nc-sa-4.0 | noncommercial sharealike 4 0 | creative commons attribution noncommercial sharealike 4 0
cc-by-nc-nd-4.0 | noncommercial noderivatives 4 0 | creative commons attribution noncommercial noderivatives 4 0
cc-by-nd-4.0 | attribution noderivatives 4 0 | creative commons attribution noderivatives 4 0
cc-by-4.0 | licenses by 4 0 | creativecommons org licenses by 4 0
cc-by-3.0 | licenses by 3 0 | creativecommons org licenses by 3 0
cc-by-2.0 | licenses by 2 0 | creativecommons org licenses by 2 0
cc-by-sa-4.0 | licenses by sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | licenses by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | licenses by nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | licenses by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | licenses by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
cc-by-nd-4.0 | licenses by nd 4 0 | creativecommons org licenses by nd 4 0
cc0-1.0 | publicdomain zero 1 0 | creativecommons org publicdomain zero 1 0
artistic-1.0 | artistic license | artistic license (?:v ?|version )?1 0\b
artistic-2.0 | artistic license | artistic license (?:v ?|version )?2 0\b
bsl-1.0 | boost software license | boost software license (?:v ?|version )?1 0\b
busl-1.1 | business source license | business source license (?:v ?|version )?1 1\b
sspl-1.0 | server side public license | server side public license (?:v ?|version )?1(?: 0)?\b
elastic-2.0 | elastic license | elastic license (?:v ?|version )?2(?: 0)?\b
ofl-1.1 | open font license | (?:sil )?open font license (?:v ?|version )?1 1\b
ofl-1.0 | open font license | (?:sil )?open font license (?:v ?|version )?1 0\b
eupl-1.1 | union public licen | european union public licen[cs]e (?:v ?|version )?1 1\b
eupl-1.2 | union public licen | european union public licen[cs]e (?:v ?|version )?1 2\b
psf-2.0 | python software foundation license | python software foundation license (?:v ?|version )?2(?: 0)?\b
zpl-2.1 | zope public license | zope public license (?:zpl )?(?:v ?|version )?2 1\b
afl-2.1 | academic free license | academic free license (?:v ?|version )?2 1\b
afl-3.0 | academic free license | academic free license (?:v ?|version )?3 0\b
osl-2.1 | open software license | open software license (?:v ?|version )?2 1\b
osl-3.0 | open software license | open software license (?:v ?|version )?3 0\b
lppl-1.3c | latex project public license | latex project public license (?:v ?|version )?1 3c?\b
php-3.0 | php license | php license (?:v ?|version )?3 0\b
php-3.01 | php license | php license (?:v ?|version )?3 01\b
upl-1.0 | universal permissive license | universal permissive license (?:v ?|version )?1 0\b
ecl-2.0 | educational community license | educational community license (?:v ?|version )?2 0\b
odbl-1.0 | open database license | open database license (?:odbl )?(?:v ?|version )?1 0\b
odc-by-1.0 | open data commons attribution | open data commons attribution license (?:v ?|version )?1 0\b
ogl-uk-1.0 | open government licen | open government licen[cs]e (?:v ?|version )?1 ?0\b
ogl-uk-2.0 | open government licen | open government licen[cs]e (?:v ?|version )?2 ?0\b
ogl-uk-3.0 | open government licen | open government licen[cs]e (?:v ?|version )?3 ?0\b
openrail-m | openrail | (?:creativeml|bigscience|bigcode) openrail m\b
llama-2 | community license | llama 2 community license
llama-3 | community license | (?:meta )?llama 3(?: \d)? community license
"""

#: Bare names and short phrases.
NAME = r"""
gpl | general public license | (?:gnu )?general public license
gpl | gnu gpl | gnu gpl\b
gpl | under the gpl | under the gpl\b
lgpl | lesser general public / library general public | (?:gnu )?(?:lesser|library) general public license
lgpl | under the lgpl | under the lgpl\b
agpl | affero general public | (?:gnu )?affero general public license
agpl | under the agpl | under the agpl\b
fdl | free documentation license | (?:gnu )?free documentation license
apache | apache license / apache software license | apache (?:software )?license
apache | apache licensed | \bapache licensed\b
mit | mit license | \bmit license\b
mit | mit licensed | \bmit licensed\b
mit | mit licence | \bmit licence\b
mit | expat license | \bexpat license\b
x11 | x11 license | \bx11 license\b
bsd | bsd license | \bbsd license\b
bsd | bsd style license | \bbsd style license\b
bsd | berkeley software distribution | berkeley software distribution license
isc | isc license | \bisc license\b
zlib | zlib license / zlib libpng license | \bzlib(?: libpng)? license\b
mpl | mozilla public license | mozilla public license
epl | eclipse public license | eclipse public license
cddl | development and distribution license | common development and distribution license
cpl | common public license | common public license
artistic | artistic license | (?:perl )?artistic license
bsl | boost software license | boost software license
busl | business source license | business source license
sspl | server side public license | server side public license
elastic | elastic license | \belastic license\b
ofl | open font license | (?:sil )?open font license
eupl | union public licen | european union public licen[cs]e
psf | python software foundation license | python software foundation license
afl | academic free license | academic free license
osl | open software license | open software license
lppl | latex project public license | latex project public license
php | php license | \bphp license\b
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal license | microsoft reciprocal license
upl | universal permissive license | universal permissive license
wtfpl | what the fuck you want | do what the fuck you want to public license
unlicense | unlicense org | \bunlicense org\b
unlicense | the unlicense | \bthe unlicense\b
beerware | beerware | \bbeerware license\b
beerware | beer ware license | \bbeer ware license\b
json | good not evil | shall be used for good not evil
cc-by | cc by | \bcc by\b
cc-by-sa | cc by sa | \bcc by sa\b
cc-by-nc | cc by nc | \bcc by nc\b
cc-by-nd | cc by nd | \bcc by nd\b
cc-by-nc-sa | cc by nc sa | \bcc by nc sa\b
cc-by-nc-nd | cc by nc nd | \bcc by nc nd\b
cc-by | creative commons attribution | creative commons attribution (?:licen[cs]e|international|unported)
cc-by-sa | attribution sharealike / attribution share alike | creative commons attribution share ?alike
cc-by-nc | attribution noncommercial / attribution non commercial | creative commons attribution non ?commercial
creative-commons | creative commons licen | creative commons licen[cs]e
cc0-1.0 | cc0 | \bcc0\b
public-domain | the public domain | (?:is|are|been placed|released|dedicated|placed) (?:in|into|to) the public domain
public-domain | public domain mark | public domain mark
odbl | open database license | open database license
odc-by | open data commons attribution | open data commons attribution
pddl | public domain dedication | public domain dedication and license
ogl | open government licen | open government licen[cs]e
openrail | openrail | \bopenrail\b
proprietary | all rights reserved | all rights reserved
proprietary | proprietary license / proprietary licence | \bproprietary licen[cs]e\b
proprietary | not for redistribution | not for redistribution
"""


@dataclass(frozen=True)
class Rule:
    label: str
    tier: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


def rules() -> list[Rule]:
    """All rules, highest priority first."""
    out = []
    for tier, (name, lines) in enumerate((("text", TEXT), ("tag", TAG), ("version", VERSION), ("name", NAME))):
        for line in lines.strip().splitlines():
            label, keywords, pattern = (x.strip() for x in line.split(" | ", 2))
            out.append(Rule(label, tier, CONFIDENCE[name], tuple(keywords.split(" / ")), re.compile(rf"(?<= )(?:{pattern})(?= )")))
    return out
