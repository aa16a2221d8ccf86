"""License scans by ordered signature rules, with built-in expressions alone.

A text is brought to its words: A-Z lower-cased, everything but letters a-z, digits and non-ASCII characters to one
space. A rule is a regular expression over words, a label, a priority, a relevance and a keyword. Rules run only on
texts that hold their keyword. What they find are runs of words; a find that lies within a find of a higher priority
(or of the same priority and longer, or the same run by an earlier rule) is suppressed. The labels of what is left
are the text's labels, with those of the base phrases; its score is the greatest relevance left.

Defined cases: a null text counts as empty; a text without words has no finds and score 0; overlapping finds of
which neither holds the other both stay; one rule's finds do not overlap each other; repeated rows are scanned one
by one; an empty table gives an empty result; other columns pass through unless a result column takes the name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases that are found wherever their words stand one after another, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

NUMBER = "(?:version |v(?:er)? ?)?"

#: keyword, which all that the expression matches must hold | label | priority | relevance | expression over words. V stands for an optional word for "version".
SIGNATURES = r"""
gnu general public license | gpl | 2 | 70 | (?:the )?gnu general public license
gnu general public license | gpl-1.0 | 3 | 90 | gnu general public license V1(?: 0)?
gnu general public license | gpl-2.0-only | 3 | 90 | gnu general public license V2(?: 0)?(?: only)?
gnu general public license | gpl-2.0-or-later | 4 | 95 | gnu general public license V2(?: 0)? or (?:any )?later(?: version)?
gnu general public license | gpl-3.0-only | 3 | 90 | gnu general public license V3(?: 0)?(?: only)?
gnu general public license | gpl-3.0-or-later | 4 | 95 | gnu general public license V3(?: 0)? or (?:any )?later(?: version)?
gnu general public license | gpl-2.0-or-later | 4 | 100 | terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gnu general public license | gpl-3.0-or-later | 4 | 100 | terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gnu general public license | gpl-1.0-or-later | 4 | 100 | terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version
gnu general public license | gpl | 3 | 80 | (?:distributed|released|licensed|available) under (?:the )?(?:terms of )?(?:the )?gnu general public license
gnu general public license | gpl | 3 | 80 | you should have received a copy of the gnu general public license
gpl | gpl-1.0 | 3 | 85 | gnu ?gpl V1(?: 0)?|gplv1|gpl V1(?: 0)?
gpl | gpl-2.0 | 3 | 85 | gnu gpl V2(?: 0)?|gplv2|gpl V2(?: 0)?
gpl | gpl-3.0 | 3 | 85 | gnu gpl V3(?: 0)?|gplv3|gpl V3(?: 0)?
gpl | gpl-2.0-only | 4 | 95 | gpl 2 0 only|gplv2 only|gpl v?2 only
gpl | gpl-2.0-or-later | 4 | 95 | gpl 2 0 or later|gplv2 or later|gpl v?2 or later|gpl 2 0\+|gpl2\+
gpl | gpl-3.0-only | 4 | 95 | gpl 3 0 only|gplv3 only|gpl v?3 only
gpl | gpl-3.0-or-later | 4 | 95 | gpl 3 0 or later|gplv3 or later|gpl v?3 or later
gpl | gpl | 2 | 50 | (?:under|with|the) (?:the )?gpl(?: license| licence)?
gpl | gpl-classpath | 4 | 95 | gpl (?:v?2 (?:0 )?)?with classpath exception
gpl | lgpl-2.0 | 3 | 85 | lgplv2|lgpl V2(?: 0)?
gpl | lgpl-2.1 | 3 | 85 | lgplv2 1|lgpl V2 1
gpl | lgpl-3.0 | 3 | 85 | lgplv3|lgpl V3(?: 0)?
gpl | lgpl-2.1-only | 4 | 95 | lgpl 2 1 only
gpl | lgpl-2.1-or-later | 4 | 95 | lgpl 2 1 or later
gpl | lgpl-3.0-only | 4 | 95 | lgpl 3 0 only
gpl | lgpl-3.0-or-later | 4 | 95 | lgpl 3 0 or later
gpl | lgpl | 2 | 60 | (?:gnu )?lgpl
gpl | agpl-3.0 | 3 | 85 | agplv3|agpl V3(?: 0)?
gpl | agpl-3.0-only | 4 | 95 | agpl 3 0 only
gpl | agpl-3.0-or-later | 4 | 95 | agpl 3 0 or later
gpl | agpl | 2 | 60 | (?:gnu )?agpl
lesser general public | lgpl | 2 | 75 | (?:gnu )?lesser general public licen[sc]e
lesser general public | lgpl-2.1-only | 3 | 90 | (?:gnu )?lesser general public licen[sc]e V2 1(?: only)?
lesser general public | lgpl-2.1-or-later | 4 | 95 | (?:gnu )?lesser general public licen[sc]e V2 1 or (?:any )?later(?: version)?
lesser general public | lgpl-3.0-only | 3 | 90 | (?:gnu )?lesser general public licen[sc]e V3(?: 0)?(?: only)?
lesser general public | lgpl-3.0-or-later | 4 | 95 | (?:gnu )?lesser general public licen[sc]e V3(?: 0)? or (?:any )?later(?: version)?
lesser general public | lgpl-2.1-or-later | 4 | 100 | lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
library general public | lgpl-2.0 | 3 | 85 | (?:gnu )?library general public licen[sc]e(?: V2(?: 0)?)?
affero | agpl | 2 | 75 | (?:gnu )?affero general public licen[sc]e
affero | agpl-1.0 | 3 | 90 | affero general public licen[sc]e V1(?: 0)?
affero | agpl-3.0-only | 3 | 90 | (?:gnu )?affero general public licen[sc]e V3(?: 0)?(?: only)?
affero | agpl-3.0-or-later | 4 | 95 | (?:gnu )?affero general public licen[sc]e V3(?: 0)? or (?:any )?later(?: version)?
free documentation | gfdl | 2 | 75 | (?:gnu )?free documentation licen[sc]e
free documentation | gfdl-1.1 | 3 | 90 | (?:gnu )?free documentation licen[sc]e V1 1
free documentation | gfdl-1.2 | 3 | 90 | (?:gnu )?free documentation licen[sc]e V1 2
free documentation | gfdl-1.3 | 3 | 90 | (?:gnu )?free documentation licen[sc]e V1 3
free documentation | gfdl | 3 | 85 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | gfdl | 2 | 60 | gfdl
gfdl | gfdl-1.2 | 3 | 85 | gfdl 1 2(?: or later| only)?
gfdl | gfdl-1.3 | 3 | 85 | gfdl 1 3(?: or later| only)?
apache | apache | 2 | 70 | (?:the )?apache (?:software )?licen[sc]e
apache | apache-1.0 | 3 | 90 | apache (?:software )?licen[sc]e V1 0
apache | apache-1.1 | 3 | 90 | apache (?:software )?licen[sc]e V1 1
apache | apache-2.0 | 3 | 90 | apache (?:software )?licen[sc]e V2(?: 0)?
apache | apache-2.0 | 4 | 100 | licensed under the apache license version 2 0(?: the license)?
apache | apache-2.0 | 3 | 95 | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache | apache-2.0 | 3 | 80 | apache V2 0
asl 2 0 | apache-2.0 | 3 | 85 | asl 2 0
apache | apache-2.0 | 3 | 85 | apachev2
apache | apache-2.0-llvm | 4 | 95 | apache (?:license )?V?2 0 with llvm exceptions?
apache | apache | 1 | 40 | licensed to the apache software foundation asf under one or more contributor license agreements
mit | mit | 2 | 70 | (?:the )?mit licen[sc]e
mit | mit | 3 | 80 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mit(?: licen[sc]e)?
mit | mit-0 | 3 | 90 | mit no attribution|mit 0
mit | mit | 3 | 80 | mit x11(?: licen[sc]e)?|x11 mit(?: licen[sc]e)?
mit | mit | 3 | 90 | opensource org licenses mit(?: license)?(?: php| html)?
mit | mit-or-apache-2.0 | 4 | 95 | (?:dual )?licensed under (?:either )?(?:the )?mit (?:license )?(?:or|and) (?:the )?apache(?: license)?(?: V?2 0)?
permission is hereby granted | mit | 4 | 100 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
permission is hereby granted | bsl-1.0 | 4 | 100 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
permission is hereby granted | icu | 4 | 95 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute and or sell copies
permission is hereby granted | ofl | 4 | 95 | permission is hereby granted free of charge to any person obtaining a copy of the font software
permission to use | postgresql | 3 | 70 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
permission to use | isc | 4 | 100 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
permission to use | isc | 4 | 95 | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
permission to use | postgresql | 4 | 100 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
permission to use | hpnd | 3 | 80 | permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose
bsd | bsd | 2 | 60 | (?:the )?bsd(?: style)? licen[sc]e
bsd | bsd-1-clause | 3 | 90 | bsd (?:1|one) clause(?: licen[sc]e)?|(?:1|one) clause bsd(?: licen[sc]e)?
bsd | bsd-2-clause | 3 | 90 | bsd (?:2|two) clause(?: licen[sc]e)?|(?:2|two) clause bsd(?: licen[sc]e)?
bsd | bsd-3-clause | 3 | 90 | bsd (?:3|three) clause(?: licen[sc]e)?|(?:3|three) clause bsd(?: licen[sc]e)?
bsd | bsd-4-clause | 3 | 90 | bsd (?:4|four) clause(?: licen[sc]e)?|(?:4|four) clause bsd(?: licen[sc]e)?
bsd | bsd-2-clause | 3 | 85 | simplified bsd(?: licen[sc]e)?|freebsd licen[sc]e
bsd | bsd-3-clause | 3 | 85 | (?:new|modified|revised) bsd(?: licen[sc]e)?
bsd | bsd-4-clause | 3 | 85 | (?:original|old) bsd(?: licen[sc]e)?
bsd | 0bsd | 3 | 90 | (?:bsd )?zero clause bsd(?: licen[sc]e)?|bsd zero clause(?: licen[sc]e)?|0bsd
bsd | bsd-2-clause-patent | 4 | 95 | bsd 2 clause plus patent(?: license)?|bsd 2 clause patent
bsd | bsd-3-clause-clear | 4 | 95 | bsd 3 clause clear(?: license)?|clear bsd(?: license)?
redistribution and use | bsd | 3 | 85 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
redistributions | bsd | 1 | 40 | redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice
endorse or promote products | bsd-3-clause | 4 | 95 | neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products derived from this software
all advertising materials | bsd-4-clause | 4 | 95 | all advertising materials mentioning features or use of this software must display the following acknowledg?e?ment
mozilla | mpl | 2 | 75 | mozilla public licen[sc]e
mozilla | mpl-1.0 | 3 | 90 | mozilla public licen[sc]e V1(?: 0)?
mozilla | mpl-1.1 | 3 | 90 | mozilla public licen[sc]e V1 1
mozilla | mpl-2.0 | 3 | 90 | mozilla public licen[sc]e V2(?: 0)?
mozilla | mpl-2.0 | 4 | 100 | this source code form is subject to the terms of the mozilla public license V2 0
mozilla | mpl-2.0 | 3 | 95 | mozilla org mpl 2 0
mozilla | mpl-1.1 | 4 | 95 | the contents of this file are subject to the mozilla public license version 1 1
mpl | mpl-1.1 | 3 | 80 | mpl V1 1|mplv1 1
mpl | mpl-2.0 | 3 | 80 | mpl V2(?: 0)?|mplv2
mpl | mpl-2.0-no-copyleft-exception | 4 | 90 | mpl 2 0 no copyleft exception
eclipse | epl | 2 | 75 | eclipse public licen[sc]e
eclipse | epl-1.0 | 3 | 90 | eclipse public licen[sc]e V1(?: 0)?
eclipse | epl-2.0 | 3 | 90 | eclipse public licen[sc]e V2(?: 0)?
eclipse | edl-1.0 | 3 | 90 | eclipse distribution licen[sc]e(?: V1(?: 0)?)?
eclipse | epl-2.0 | 3 | 90 | eclipse org legal epl (?:v20|2 0)
eclipse | epl-1.0 | 3 | 90 | eclipse org legal epl (?:v10|1 0)
epl | epl-1.0 | 3 | 75 | epl V1 0
epl | epl-2.0 | 3 | 75 | epl V2 0
common development and distribution | cddl | 2 | 75 | common development and distribution licen[sc]e
common development and distribution | cddl-1.0 | 3 | 90 | common development and distribution licen[sc]e(?: cddl)? V1 0
common development and distribution | cddl-1.1 | 3 | 90 | common development and distribution licen[sc]e(?: cddl)? V1 1
cddl | cddl | 2 | 60 | cddl
cddl | cddl-1.0 | 3 | 80 | cddl V1 0
cddl | cddl-1.1 | 3 | 80 | cddl V1 1
common public license | cpl-1.0 | 2 | 75 | common public license(?: V1 0)?
ibm public license | ipl-1.0 | 2 | 75 | ibm public license(?: V1 0)?
artistic license | artistic | 2 | 70 | artistic license
artistic license | artistic-1.0 | 3 | 90 | artistic license V1(?: 0)?
artistic license | artistic-2.0 | 3 | 90 | artistic license V2(?: 0)?
same terms as perl itself | artistic-1.0-perl | 3 | 85 | same terms as perl itself
artistic license | artistic-1.0-perl | 3 | 85 | artistic license (?:and|or) (?:the )?gnu general public license
boost software license | bsl-1.0 | 2 | 80 | boost software license
boost software license | bsl-1.0 | 3 | 95 | boost software license V1 0
business source license | busl-1.1 | 3 | 90 | business source license(?: V1 1)?
zlib | zlib | 2 | 70 | zlib(?: libpng)? licen[sc]e
zlib | zlib | 3 | 80 | (?:licensed|released|distributed) under the zlib(?: license)?
as is without any express or implied | zlib | 4 | 95 | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
unlicense | unlicense | 2 | 80 | (?:the )?unlicense
unlicense | unlicense | 3 | 90 | (?:https? )?unlicense org
public domain | public-domain | 2 | 60 | public domain
public domain | public-domain | 3 | 80 | (?:placed|released|dedicated|is) (?:in|into|to) the public domain
public domain | unlicense | 4 | 100 | this is free and unencumbered software released into the public domain
public domain | cc0-1.0 | 3 | 90 | cc0 (?:1 0 )?(?:universal )?(?:1 0 )?public domain dedication
public domain | cc-pdm-1.0 | 3 | 90 | (?:creative commons )?public domain mark(?: 1 0)?
public domain | odc-pddl-1.0 | 3 | 90 | public domain dedication and license(?: V?1 0)?
what the fuck | wtfpl | 3 | 90 | do what the fuck you want to(?: public license)?
wtfpl | wtfpl | 3 | 85 | wtfpl(?: V2)?
isc licen | isc | 2 | 75 | (?:the )?isc licen[sc]e
beerware | beerware | 3 | 80 | beerware(?: license)?
beer ware | beerware | 3 | 80 | beer ware(?: license)?
beer ware | beerware | 3 | 80 | the beer ware license
sil open font | ofl | 2 | 80 | sil open font licen[sc]e
sil open font | ofl-1.0 | 3 | 90 | sil open font licen[sc]e V1 0
sil open font | ofl-1.1 | 3 | 95 | sil open font licen[sc]e V1 1
python software foundation | psf-2.0 | 2 | 80 | python software foundation license(?: V2(?: 0)?)?
psf license | psf-2.0 | 2 | 75 | psf license(?: agreement)?
php license | php | 2 | 70 | php license
php license | php-3.0 | 3 | 90 | php license V3 0
php license | php-3.01 | 3 | 90 | php license V3 01
ruby license | ruby | 2 | 75 | (?:the )?ruby license
openssl | openssl | 2 | 75 | openssl license
openssl | openssl | 3 | 80 | includes software developed by the openssl project
postgresql licen | postgresql | 2 | 80 | postgresql licen[sc]e
microsoft | ms-pl | 3 | 90 | microsoft public license(?: ms pl)?
microsoft | ms-rl | 3 | 90 | microsoft reciprocal license(?: ms rl)?
microsoft | ms-rsl | 3 | 85 | microsoft reference source license
ms pl | ms-pl | 3 | 75 | ms pl
ms rl | ms-rl | 3 | 75 | ms rl
european union public | eupl | 2 | 80 | european union public licen[sc]e
european union public | eupl-1.1 | 3 | 90 | european union public licen[sc]e V1 1
european union public | eupl-1.2 | 3 | 90 | european union public licen[sc]e V1 2
eupl | eupl | 2 | 60 | eupl
eupl | eupl-1.1 | 3 | 85 | eupl V1 1
eupl | eupl-1.2 | 3 | 85 | eupl V1 2
cecill | cecill | 2 | 75 | cecill
cecill | cecill-2.1 | 3 | 85 | cecill(?: license)? V2 1
cecill | cecill-b | 3 | 85 | cecill b(?: license)?
cecill | cecill-c | 3 | 85 | cecill c(?: license)?
academic free license | afl | 2 | 75 | academic free license
academic free license | afl-2.1 | 3 | 90 | academic free license V2 1
academic free license | afl-3.0 | 3 | 90 | academic free license V3 0
open software license | osl | 2 | 70 | open software license
open software license | osl-3.0 | 3 | 90 | open software license V3 0
educational community | ecl-2.0 | 2 | 80 | educational community license(?: V2(?: 0)?)?
universal permissive | upl-1.0 | 2 | 80 | universal permissive license(?: V1 0)?
university of illinois | ncsa | 2 | 80 | university of illinois(?: ncsa)? open source license
w3c software | w3c | 2 | 75 | w3c software (?:and document )?(?:notice and )?license
unicode license | unicode | 2 | 80 | unicode license(?: V3)?
unicode inc license | unicode-dfs | 3 | 90 | unicode inc license agreement data files and software
sleepycat | sleepycat | 2 | 75 | sleepycat(?: public)? license
server side public | sspl-1.0 | 2 | 85 | server side public license(?: V1)?
elastic license | elastic | 2 | 75 | elastic license
elastic license | elastic-2.0 | 3 | 90 | elastic license V2(?: 0)?
commons clause | commons-clause | 3 | 85 | commons clause(?: license)?(?: condition)?(?: V1 0)?
open database license | odbl-1.0 | 2 | 85 | open database license(?: odbl)?(?: V?1 0)?
open data commons | odc-by-1.0 | 3 | 85 | open data commons attribution license(?: V?1 0)?
odbl | odbl-1.0 | 2 | 70 | odbl(?: V?1 0)?
community data license | cdla-permissive | 3 | 85 | community data license agreement permissive(?: V?[12] 0)?
community data license | cdla-sharing | 3 | 85 | community data license agreement sharing(?: V?1 0)?
open government | ogl-uk | 2 | 75 | open government licen[sc]e
open government | ogl-uk-3.0 | 3 | 90 | open government licen[sc]e V3(?: 0)?
openrail | openrail | 2 | 75 | (?:bigscience |creativeml |bigcode )?openrail(?: m)?(?: license)?
llama | llama-2 | 3 | 80 | llama 2 community license(?: agreement)?
llama | llama-3 | 3 | 80 | llama 3(?: [123])? community license(?: agreement)?
free art license | fal-1.3 | 2 | 80 | free art license(?: V?1 3)?
licence art libre | fal-1.3 | 2 | 80 | licence art libre(?: V?1 3)?
vim licen | vim | 2 | 75 | vim licen[sc]e
tcl | tcl | 2 | 70 | tcl(?: tk)? license
curl license | curl | 2 | 75 | curl license
libpng | libpng | 2 | 70 | libpng license(?: V?2)?
freetype | ftl | 2 | 80 | freetype (?:project )?license
ijg | ijg | 2 | 65 | ijg license
independent jpeg group | ijg | 2 | 65 | independent jpeg group(?: s)? license
bzip2 | bzip2 | 2 | 75 | bzip2(?: and libbzip2)? license
blue oak | blueoak-1.0.0 | 2 | 85 | blue oak model license(?: 1 0 0)?
parity | parity-7.0.0 | 2 | 75 | parity public license(?: 7 0 0)?
polyform | polyform-noncommercial-1.0.0 | 2 | 85 | polyform noncommercial license(?: 1 0 0)?
polyform | polyform-small-business-1.0.0 | 2 | 85 | polyform small business license(?: 1 0 0)?
netscape | npl-1.1 | 2 | 75 | netscape public license(?: V1 [01])?
reciprocal public license | rpl-1.5 | 2 | 80 | reciprocal public license(?: V?1 [15])?
mulan | mulan-psl-2.0 | 2 | 85 | mulan (?:permissive software license|psl)(?: V?2)?
creative commons | cc | 2 | 60 | creative commons(?: licen[sc]e)?
creative commons | cc | 3 | 70 | (?:licensed|released|available|distributed) under (?:a |the )?creative commons(?: licen[sc]e)?
creative commons | cc0-1.0 | 3 | 90 | creative commons zero(?: V?1 0)?(?: universal)?
creativecommons | cc0-1.0 | 4 | 95 | creativecommons org publicdomain zero 1 0
creativecommons | cc-pdm-1.0 | 4 | 95 | creativecommons org publicdomain mark 1 0
cc0 | cc0-1.0 | 2 | 80 | cc0(?: 1 0)?(?: universal)?
spdx license identifier | spdx | 2 | 60 | spdx license identifier [^ ]+
all rights reserved | proprietary | 1 | 40 | all rights reserved
all rights reserved | proprietary | 2 | 50 | (?:copyright|c) (?:[^ ]+ ){1,6}all rights reserved
copyright | copyright | 1 | 20 | copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
confidential and proprietary | proprietary | 2 | 70 | confidential and proprietary
unauthorized copying | proprietary | 2 | 70 | unauthorized copying of this file via any medium is strictly prohibited
dual licensed | dual | 1 | 40 | dual licensed(?: under)?
see the license file | unknown-reference | 1 | 30 | see the license file(?: for details)?
license file | unknown-reference | 1 | 30 | (?:found|described|given) in the license file
licen | unknown-notice | 1 | 20 | (?:licensed|released|distributed) under (?:the|a|an) [^ ]+ licen[sc]e
"""

#: Creative Commons conditions, each with every published version and as words, as an address and as a short name.
_CC = {
    "by": "attribution",
    "by-sa": "attribution share ?alike",
    "by-nd": "attribution no ?deriv(?:ative)?s?",
    "by-nc": "attribution non ?commercial",
    "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Identifiers that stand after "SPDX-License-Identifier:".
_SPDX = "MIT MIT-0 Apache-1.1 Apache-2.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 Artistic-2.0 BSL-1.0 Zlib Unlicense CC0-1.0 OFL-1.1 EUPL-1.2 WTFPL PostgreSQL NCSA UPL-1.0 MS-PL".split()


@dataclass(frozen=True)
class Signature:
    keyword: str
    label: str
    priority: int
    relevance: float
    words: str

    @property
    def pattern(self) -> str:
        """Over text whose words each follow one space, the last followed by one."""
        return f" (?:{self.words})(?= )"


def _generated() -> list[Signature]:
    out = []
    for kind, words in _CC.items():
        short = kind.replace("-", " ")
        out.append(Signature("cc by", f"cc-{kind}", 3, 0.7, f"cc {short}"))
        out.append(Signature("creative commons", f"cc-{kind}", 3, 0.85, f"creative commons {words}(?: licen[sc]e)?"))
        for version in _CC_VERSIONS:
            v = version.replace(".", " ")
            out.append(Signature("cc by", f"cc-{kind}-{version}", 4, 0.95, f"cc {short} {v}"))
            out.append(Signature("creative commons", f"cc-{kind}-{version}", 4, 0.95, f"creative commons {words} (?:{v}|licen[sc]e {v})(?: (?:international|unported|generic))?(?: licen[sc]e)?"))
            out.append(Signature("creativecommons", f"cc-{kind}-{version}", 4, 0.95, f"creativecommons org licenses {short} {v}"))
    out += [Signature("spdx license identifier", x.lower(), 5, 1.0, f"spdx license identifier {re.sub('[-.]', ' ', x.lower())}") for x in _SPDX]
    return out


def signatures() -> list[Signature]:
    """All rules in order: the written ones, then the generated."""
    rows = [[c.strip() for c in line.split(" | ", 4)] for line in SIGNATURES.strip().splitlines()]
    return [Signature(k, label, int(p), int(r) / 100, words.replace("V", NUMBER)) for k, label, p, r, words in rows] + _generated()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, computed once wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def word_text(text: Column) -> Column:
    """A space before each word and one after the last; one space for no words."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spaced = F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.when(F.startswith(spaced, F.lit(" ")), "").otherwise(" "), spaced, F.when(F.endswith(spaced, F.lit(" ")) | (spaced == ""), "").otherwise(" "))


def _finds(words: Column, keywords: Column, rules: list[Signature]) -> Column:
    """All finds: array<struct<order, priority, relevance, label, first, last>> in word positions, last included."""
    table = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(r.priority).alias("priority"), F.lit(r.relevance).alias("relevance"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern")) for i, r in enumerate(rules)])

    def of_rule(rule: Column) -> Column:
        return _let(F.split(words, rule["pattern"], -1), lambda between: F.when(F.size(between) == 1, nothing).otherwise(places(rule, between, F.regexp_extract_all(words, rule["pattern"], F.lit(0)))))

    def places(rule: Column, between: Column, texts: Column) -> Column:
        gaps = F.zip_with(F.slice(between, F.lit(1), F.size(between) - 1), texts, lambda b, t: F.struct(_spaces(b).alias("skip"), _spaces(t).alias("words")))
        start = F.struct(F.lit(0).alias("at"), nothing.alias("found"))

        def step(acc: Column, gap: Column) -> Column:
            first = acc["at"] + gap["skip"]
            find = F.struct(rule["order"].alias("order"), rule["priority"].alias("priority"), rule["relevance"].alias("relevance"), rule["label"].alias("label"), first.alias("first"), (first + gap["words"] - 1).alias("last"))
            return F.struct((first + gap["words"]).alias("at"), F.concat(acc["found"], F.array(find)).alias("found"))

        return F.aggregate(gaps, start, step, lambda acc: acc["found"])

    nothing = F.array().cast("array<struct<order:int,priority:int,relevance:double,label:string,first:int,last:int>>")
    return F.flatten(F.transform(F.filter(table, lambda r: F.array_contains(keywords, r["keyword"])), of_rule))


def _unsuppressed(finds: Column) -> Column:
    def rank(x: Column) -> Column:
        return F.struct(x["priority"], x["last"] - x["first"], -x["order"], -x["first"])

    def within(x: Column, y: Column) -> Column:
        return (y["first"] <= x["first"]) & (y["last"] >= x["last"]) & (rank(y) > rank(x))

    return _let(finds, lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: within(x, y))))


def scan(docs: DataFrame, *, rules: list[Signature] | None = None, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and finds."""
    rules = signatures() if rules is None else rules
    own = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "finds"]
    keep = [c for c in docs.columns if c.lower() not in own]
    df = docs.select(*keep, word_text(F.col(text_col).cast("string")).alias("_l_words"))
    words = F.col("_l_words")
    n_words = (_spaces(words) - 1).cast("long")
    sieve = F.array_compact(F.array(*[F.when(F.contains(words, F.lit(k)), F.lit(k)) for k in dict.fromkeys(r.keyword for r in rules)]))

    def places(phrase: str) -> Column:
        def of(between: Column) -> Column:
            last = _spaces(words) - _spaces(F.element_at(between, -1)) - (phrase.count(" ") + 1)
            return F.struct((F.size(between) - 1).alias("n"), _spaces(F.get(between, F.lit(0))).alias("first"), last.alias("last"))

        return F.when(F.contains(words, F.lit(f" {phrase} ")), _let(F.split(words, f" {phrase}(?= )", -1), of))

    of_phrase = {label: places(phrase) for phrase, label in BASE_PHRASES.items()}
    df = df.select(*keep, words, n_words.alias("n_words"), sieve.alias("_l_keywords"), *[c.alias(f"_l_{k}") for k, c in of_phrase.items()])
    at = {k: F.col(f"_l_{k}") for k in of_phrase}
    base = F.array_sort(F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(k)) for k, c in at.items()])))
    df = df.select(
        *keep,
        "n_words",
        sum((F.coalesce(c["n"], F.lit(0)) for c in at.values()), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[c["first"] for c in at.values()]).cast("long").alias("first_word"),
        F.greatest(*[c["last"] for c in at.values()]).cast("long").alias("last_word"),
        base.alias("_l_base"),
        F.when(F.size("_l_keywords") > 0, _unsuppressed(_finds(words, F.col("_l_keywords"), rules))).alias("_l_finds"),
    )
    finds = F.coalesce(F.col("_l_finds"), F.array().cast("array<struct<order:int,priority:int,relevance:double,label:string,first:int,last:int>>"))
    return df.select(
        *keep,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_l_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.transform(finds, lambda x: x["label"]), F.col("_l_base"))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(finds, lambda x: x["relevance"])), F.lit(0.0)).alias("score"),
        finds.alias("finds"),
    )


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text", "finds")


__all__ = ["BASE_PHRASES", "Signature", "op2_license", "scan", "signatures", "word_text"]
