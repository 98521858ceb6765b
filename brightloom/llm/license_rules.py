"""Signature rules of the license scan, in order.

A rule is ``priority | label | keyword | regex``. Rules see the text as its
lower-case words with one space between them, so punctuation is gone: "version
2.0" reads "version 2 0". A rule is tried only where its keyword stands in that
text, and its match starts and ends at word borders. Priority 1: an identifier
or a grant; 2: a license's name or address; 3: a sentence typical of it.
"""

from __future__ import annotations

from typing import NamedTuple

RULES_TEXT = r"""
1 | apache-2.0 | spdx | spdx license identifier apache 2 0
1 | apache-2.0 | apache | licensed under the apache license,? version 2 0
1 | apache-2.0 | apache | licensed to the apache software foundation asf under one or more contributor license agreements
1 | apache-2.0 | apache | released under (?:the )?apache(?: license)? (?:v|version )?2(?: 0)?
2 | apache-2.0 | apache | apache license(?: version)? 2 0(?: january 2004)?
2 | apache-2.0 | apache | apache(?: software)? license v2(?: 0)?
2 | apache-2.0 | apache | www apache org licenses license 2 0(?: txt| html)?
2 | apache-2.0 | opensource | opensource org licenses apache 2 0
3 | apache-2.0 | as is | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
3 | apache-2.0 | limitations | see the license for the specific language governing permissions and limitations under the license
2 | apache-1.1 | apache | apache software license version 1 1
1 | apache-1.1 | spdx | spdx license identifier apache 1 1
3 | apache-1.1 | apache | this product includes software developed by the apache software foundation
2 | apache-1.0 | apache | apache(?: software)? license version 1 0
2 | apache | apache | apache(?: software)? license
1 | mit | spdx | spdx license identifier mit
1 | mit | mit | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit(?: x11)? licen[sc]e
2 | mit | mit | the mit licen[sc]e(?: mit)?
2 | mit | mit | mit(?: x11| expat)? licen[sc]e
2 | mit | opensource | opensource org licenses mit(?: license)?(?: php| html)?
2 | mit | expat | expat licen[sc]e
1 | mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
3 | mit | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
3 | mit | warranty | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
1 | mit-0 | spdx | spdx license identifier mit 0
2 | mit-0 | no attribution | mit no attribution(?: licen[sc]e)?
2 | x11 | x11 | x11 licen[sc]e
1 | isc | spdx | spdx license identifier isc
1 | isc | isc | (?:licensed|released|distributed) under (?:the )?(?:terms of the )?isc licen[sc]e
2 | isc | isc | (?:the )?isc licen[sc]e
1 | isc | permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
3 | isc | in no event | in no event shall the author be liable for any special direct indirect or consequential damages
1 | 0bsd | spdx | spdx license identifier 0bsd
2 | 0bsd | bsd | (?:bsd zero clause|zero clause bsd|0bsd) licen[sc]e
1 | bsd-2-clause | spdx | spdx license identifier bsd 2 clause
2 | bsd-2-clause | bsd | (?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e
2 | bsd-2-clause | bsd | bsd 2 clause(?: simplified)?(?: licen[sc]e)?
2 | bsd-2-clause | opensource | opensource org licenses bsd 2 clause
1 | bsd-3-clause | spdx | spdx license identifier bsd 3 clause
2 | bsd-3-clause | bsd | (?:new|modified|revised|3 clause|three clause) bsd licen[sc]e
2 | bsd-3-clause | bsd | bsd 3 clause(?: new or revised)?(?: licen[sc]e)?
2 | bsd-3-clause | opensource | opensource org licenses bsd 3 clause
3 | bsd-3-clause | endorse | neither the name of (?:[^ ]+ ){1,14}nor the names of (?:its|his|their|any) contributors may be used to endorse or promote products
1 | bsd-4-clause | spdx | spdx license identifier bsd 4 clause
2 | bsd-4-clause | bsd | (?:original|old|4 clause|four clause) bsd licen[sc]e
3 | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
2 | bsd | bsd | (?:the |a )?bsd(?: style)? licen[sc]e
1 | bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
3 | bsd | redistributions | redistributions of source code must retain the above copyright notice
3 | bsd | redistributions | redistributions in binary form must reproduce the above copyright notice
1 | gpl-1.0 | spdx | spdx license identifier gpl 1 0(?: only| or later)?
1 | gpl-2.0-only | spdx | spdx license identifier gpl 2 0(?: only)?
1 | gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
1 | gpl-3.0-only | spdx | spdx license identifier gpl 3 0(?: only)?
1 | gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
1 | gpl-2.0-or-later | general public | gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
1 | gpl-3.0-or-later | general public | gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
1 | gpl-2.0-only | general public | gnu general public license version 2 as published by the free software foundation
1 | gpl-3.0-only | general public | gnu general public license version 3 as published by the free software foundation
2 | gpl-1.0 | general public | gnu general public license(?: gpl)? version 1(?: 0)?
2 | gpl-2.0 | general public | gnu general public license(?: gpl)? version 2(?: 0)?(?: june 1991)?
2 | gpl-3.0 | general public | gnu general public license(?: gpl)? version 3(?: 0)?(?: 29 june 2007)?
2 | gpl-2.0 | gpl | (?:gnu )?gpl ?(?:v|version )?2(?: 0)?
2 | gpl-3.0 | gpl | (?:gnu )?gpl ?(?:v|version )?3(?: 0)?
2 | gpl-2.0 | gnu org | www gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?
2 | gpl-3.0 | gnu org | www gnu org licenses gpl 3 0(?: txt| html)?
2 | gpl | gnu org | www gnu org licenses gpl(?: txt| html)?
2 | gpl-2.0 | opensource | opensource org licenses gpl 2 0
2 | gpl-3.0 | opensource | opensource org licenses gpl 3 0
2 | gpl | general public | gnu general public license
2 | gpl | gnu gpl | gnu gpl
3 | gpl | warranty | this program is distributed in the hope that it will be useful but without any warranty
3 | gpl | general public | you should have received a copy of the gnu general public license along with this program
3 | gpl | free software | (?:this (?:program|library|file)|[^ ]+) is free software you can redistribute it and or modify it under the terms of
1 | lgpl-2.0 | spdx | spdx license identifier lgpl 2 0(?: only| or later)?
1 | lgpl-2.1-only | spdx | spdx license identifier lgpl 2 1(?: only)?
1 | lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
1 | lgpl-3.0-only | spdx | spdx license identifier lgpl 3 0(?: only)?
1 | lgpl-3.0-or-later | spdx | spdx license identifier lgpl 3 0 or later
1 | lgpl-2.1-or-later | lesser general | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
1 | lgpl-3.0-or-later | lesser general | gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
2 | lgpl-2.1 | lesser general | gnu lesser general public license(?: lgpl)? version 2 1
2 | lgpl-3.0 | lesser general | gnu lesser general public license(?: lgpl)? version 3(?: 0)?
2 | lgpl-2.0 | library general | gnu library general public license(?: lgpl)?(?: version 2(?: 0)?)?
2 | lgpl-2.1 | lgpl | (?:gnu )?lgpl ?(?:v|version )?2 1
2 | lgpl-3.0 | lgpl | (?:gnu )?lgpl ?(?:v|version )?3(?: 0)?
2 | lgpl-2.1 | gnu org | www gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html)?
2 | lgpl-3.0 | gnu org | www gnu org licenses lgpl 3 0(?: txt| html)?
2 | lgpl | lesser general | (?:gnu )?lesser general public license
2 | lgpl | lgpl | gnu lgpl
1 | agpl-3.0-only | spdx | spdx license identifier agpl 3 0(?: only)?
1 | agpl-3.0-or-later | spdx | spdx license identifier agpl 3 0 or later
1 | agpl-3.0-or-later | affero | gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
2 | agpl-3.0 | affero | gnu affero general public license(?: agpl)? version 3(?: 0)?
2 | agpl-3.0 | agpl | (?:gnu )?agpl ?(?:v|version )?3(?: 0)?
2 | agpl-3.0 | gnu org | www gnu org licenses agpl(?: 3 0)?(?: txt| html)?
2 | agpl | affero | (?:gnu )?affero general public license
2 | agpl-1.0 | affero | affero general public license version 1
1 | gfdl-1.3 | spdx | spdx license identifier gfdl 1 3(?: only| or later)?
1 | gfdl-1.2 | spdx | spdx license identifier gfdl 1 2(?: only| or later)?
2 | gfdl-1.3 | free documentation | gnu free documentation license version 1 3
2 | gfdl-1.2 | free documentation | gnu free documentation license version 1 2
2 | gfdl-1.1 | free documentation | gnu free documentation license version 1 1
2 | gfdl | free documentation | gnu free documentation license
3 | gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
2 | classpath-exception | classpath | classpath exception(?: 2 0)?
3 | linking-exception | special exception | as a special exception the copyright holders (?:of this library )?give you permission to link
1 | mpl-1.0 | spdx | spdx license identifier mpl 1 0
1 | mpl-1.1 | spdx | spdx license identifier mpl 1 1
1 | mpl-2.0 | spdx | spdx license identifier mpl 2 0(?: no copyleft exception)?
1 | mpl-2.0 | mozilla | subject to the terms of the mozilla public license v ?2 0
1 | mpl-1.1 | mozilla | subject to the mozilla public license version 1 1
2 | mpl-2.0 | mozilla | mozilla public license(?: mpl)?(?: v| version)? 2 0
2 | mpl-1.1 | mozilla | mozilla public license(?: mpl)?(?: v| version)? 1 1
2 | mpl-1.0 | mozilla | mozilla public license(?: mpl)?(?: v| version)? 1 0
2 | mpl-2.0 | mozilla | (?:www )?mozilla org (?:en us )?mpl 2 0
2 | mpl | mozilla | mozilla public license
2 | npl-1.1 | netscape | netscape public license(?: version 1 1)?
1 | epl-1.0 | spdx | spdx license identifier epl 1 0
1 | epl-2.0 | spdx | spdx license identifier epl 2 0
2 | epl-1.0 | eclipse | eclipse public license(?: v| version)? 1 0
2 | epl-2.0 | eclipse | eclipse public license(?: v| version)? 2 0
2 | epl-1.0 | eclipse | www eclipse org legal epl v10(?: html)?
2 | epl-2.0 | eclipse | www eclipse org legal epl (?:2 0|v20)(?: html)?
2 | epl | eclipse | eclipse public license
2 | edl-1.0 | eclipse | eclipse distribution license(?: v| version)? 1 0
2 | cpl-1.0 | common public | common public license(?: version)? 1 0
2 | ipl-1.0 | ibm | ibm public license(?: version)?(?: 1 0)?
1 | cddl-1.0 | spdx | spdx license identifier cddl 1 0
1 | cddl-1.1 | spdx | spdx license identifier cddl 1 1
2 | cddl-1.0 | common development | common development and distribution license(?: cddl)?(?: v| version)? 1 0
2 | cddl-1.1 | common development | common development and distribution license(?: cddl)?(?: v| version)? 1 1
2 | cddl | common development | common development and distribution license
1 | artistic-1.0 | spdx | spdx license identifier artistic 1 0(?: perl| cl8)?
1 | artistic-2.0 | spdx | spdx license identifier artistic 2 0
2 | artistic-2.0 | artistic | (?:the )?artistic license(?: version)? 2 0
2 | artistic-1.0 | artistic | (?:the )?artistic license(?: version)? 1 0
2 | artistic | artistic | (?:the )?artistic license
3 | perl | perl itself | under the same terms as perl itself
1 | bsl-1.0 | spdx | spdx license identifier bsl 1 0
2 | bsl-1.0 | boost | boost software license(?: version)?(?: 1 0)?
2 | bsl-1.0 | boost | www boost org license 1 0 txt
2 | busl-1.1 | business source | business source license(?: version)?(?: 1 1)?
1 | busl-1.1 | spdx | spdx license identifier busl 1 1
2 | elastic-2.0 | elastic | elastic license(?: version)? 2(?: 0)?
2 | elastic | elastic | elastic license
1 | sspl-1.0 | spdx | spdx license identifier sspl 1 0
2 | sspl-1.0 | server side | server side public license(?: version 1)?
2 | commons-clause | commons clause | commons clause(?: license)? condition(?: v1 0)?
1 | zlib | spdx | spdx license identifier zlib
2 | zlib | zlib | (?:the )?zlib(?: libpng)? licen[sc]e
3 | zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
3 | zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented
2 | libpng | libpng | libpng licen[sc]e
2 | openssl | openssl | openssl licen[sc]e
3 | openssl | openssl | this product includes software developed by the openssl project
2 | curl | curl | curl licen[sc]e
1 | python-2.0 | spdx | spdx license identifier (?:python|psf) 2 0
2 | python-2.0 | python | python software foundation license(?: version 2)?
2 | php-3.01 | php | php license(?: version)? 3 01
2 | php-3.0 | php | php license(?: version)? 3 0
2 | ruby | ruby | (?:the )?ruby license
2 | postgresql | postgresql | postgresql licen[sc]e
1 | postgresql | spdx | spdx license identifier postgresql
2 | ncsa | ncsa | (?:university of illinois )?ncsa open source license
1 | ncsa | spdx | spdx license identifier ncsa
2 | w3c | w3c | w3c software(?: notice)?(?: and)?(?: document)? license
2 | unicode | unicode | unicode(?: inc)? license agreement(?: data files and software)?
2 | icu | icu | icu license
2 | ofl-1.1 | open font | sil open font license(?: version)?(?: 1 1)?
1 | ofl-1.1 | spdx | spdx license identifier ofl 1 1
2 | ofl-1.1 | ofl | scripts sil org ofl
1 | unlicense | spdx | spdx license identifier unlicense
1 | unlicense | public domain | this is free and unencumbered software released into the public domain
2 | unlicense | unlicense | (?:the )?unlicense(?: org)?
1 | wtfpl | spdx | spdx license identifier wtfpl
2 | wtfpl | do what the | do what the (?:fuck|f ck) you want to public license(?: version 2)?
2 | wtfpl | wtfpl | wtfpl(?: licen[sc]e)?
2 | beerware | beer | beer ?ware licen[sc]e
3 | beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
1 | cc0-1.0 | spdx | spdx license identifier cc0 1 0
1 | cc0-1.0 | creative | creative commons (?:zero|cc0)(?: v?1 0)?(?: universal)?(?: public domain dedication)?
2 | cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
2 | cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
3 | cc0-1.0 | waived | to the extent possible under law (?:[^ ]+ ){1,12}waived all copyright and related or neighboring rights
2 | public-domain-mark | creativecommons | creativecommons org publicdomain mark 1 0
1 | cc-by-1.0 | spdx | spdx license identifier cc by 1 0
1 | cc-by-2.0 | spdx | spdx license identifier cc by 2 0
1 | cc-by-2.5 | spdx | spdx license identifier cc by 2 5
1 | cc-by-3.0 | spdx | spdx license identifier cc by 3 0
1 | cc-by-4.0 | spdx | spdx license identifier cc by 4 0
2 | cc-by-1.0 | cc by | cc by 1 0
2 | cc-by-2.0 | cc by | cc by 2 0
2 | cc-by-2.5 | cc by | cc by 2 5
2 | cc-by-3.0 | cc by | cc by 3 0
2 | cc-by-4.0 | cc by | cc by 4 0(?: international)?
1 | cc-by-sa-2.0 | cc by sa | cc by sa 2 0
1 | cc-by-sa-2.5 | cc by sa | cc by sa 2 5
1 | cc-by-sa-3.0 | cc by sa | cc by sa 3 0
1 | cc-by-sa-4.0 | cc by sa | cc by sa 4 0
2 | cc-by-sa | cc by sa | cc by sa
1 | cc-by-nd-3.0 | cc by nd | cc by nd 3 0
1 | cc-by-nd-4.0 | cc by nd | cc by nd 4 0
2 | cc-by-nd | cc by nd | cc by nd
1 | cc-by-nc-2.0 | cc by nc | cc by nc 2 0
1 | cc-by-nc-3.0 | cc by nc | cc by nc 3 0
1 | cc-by-nc-4.0 | cc by nc | cc by nc 4 0
2 | cc-by-nc | cc by nc | cc by nc
1 | cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa 3 0
1 | cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
2 | cc-by-nc-sa | cc by nc sa | cc by nc sa
1 | cc-by-nc-nd-3.0 | cc by nc nd | cc by nc nd 3 0
1 | cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
2 | cc-by-nc-nd | cc by nc nd | cc by nc nd
2 | cc-by | creativecommons | creativecommons org licenses by [1-4] [05]
2 | cc-by-sa | creativecommons | creativecommons org licenses by sa [1-4] [05]
2 | cc-by-nc | creativecommons | creativecommons org licenses by nc [1-4] [05]
2 | cc-by-nd | creativecommons | creativecommons org licenses by nd [1-4] [05]
2 | cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
2 | cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
2 | cc-by | creative commons | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
2 | cc-by-sa | creative commons | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
2 | cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international| unported)?
2 | cc-by-nc | creative commons | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?
2 | cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?
2 | cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international| unported)?
3 | creative-commons | creative commons | creative commons(?: public)? licen[sc]e
1 | odbl-1.0 | spdx | spdx license identifier odbl 1 0
2 | odbl-1.0 | open database | open database license(?: odbl)?(?: v1 0)?
2 | odc-by-1.0 | open data commons | open data commons attribution license(?: odc by)?(?: v1 0)?
2 | pddl-1.0 | open data commons | open data commons public domain dedication(?: and)? licen[sc]e(?: pddl)?
2 | cdla-permissive | community data | community data license agreement permissive(?: version)?(?: [12] 0)?
2 | cdla-sharing | community data | community data license agreement sharing(?: version)?(?: 1 0)?
2 | ogl-uk | open government | open government licen[sc]e(?: v[123](?: 0)?)?
1 | eupl-1.2 | spdx | spdx license identifier eupl 1 2
2 | eupl-1.2 | european union | european union public licen[sc]e(?: eupl)?(?: v ?| version )?1 2
2 | eupl-1.1 | european union | european union public licen[sc]e(?: eupl)?(?: v ?| version )?1 1
2 | eupl | european union | european union public licen[sc]e
2 | cecill-2.1 | cecill | cecill(?: free software)? licen[sc]e(?: agreement)?(?: v| version)? 2 1
2 | cecill | cecill | cecill(?: [bc])?(?: free software)? licen[sc]e
2 | mulan-psl-2.0 | mulan | mulan psl v2
2 | mulan-psl-2.0 | mulan | mulan permissive software license version 2
2 | ms-pl | microsoft | microsoft public license(?: ms pl)?
2 | ms-rl | microsoft | microsoft reciprocal license(?: ms rl)?
2 | osl-3.0 | open software | open software license(?: v ?| version )?3 0
2 | afl-3.0 | academic free | academic free license(?: v ?| version )?3 0
2 | afl-2.1 | academic free | academic free license(?: v ?| version )?2 1
2 | qpl-1.0 | q public | q public license(?: version 1 0)?
2 | lppl-1.3c | latex project | latex project public license(?: version)?(?: 1 3c?)?
2 | sleepycat | sleepycat | sleepycat license
2 | vim | vim license | vim license
2 | json | json license | json license
3 | json | good not evil | the software shall be used for good not evil
2 | upl-1.0 | universal permissive | universal permissive license(?: upl)?(?: version)?(?: 1 0)?
2 | blueoak-1.0.0 | blue oak | blue oak model license(?: 1 0 0)?
2 | openrail | rail | (?:creativeml |bigscience )?open ?rail(?: [ms])?(?: licen[sc]e)?
2 | bigscience-rail | rail | bigscience rail license(?: v?1 0)?
2 | cpal-1.0 | common public attribution | common public attribution license(?: version 1 0)?
2 | rpl-1.5 | reciprocal | reciprocal public license(?: version)?(?: 1 5)?
2 | apsl-2.0 | apple | apple public source license(?: ver(?:sion)? 2 0)?
2 | nasa-1.3 | nasa | nasa open source agreement(?: version)?(?: 1 3)?
2 | ecl-2.0 | educational community | educational community license(?: version)?(?: 2 0)?
2 | hpnd | historical permission | historical permission notice and disclaimer
2 | ftl | freetype | freetype(?: project)? license
2 | ijg | jpeg | independent jpeg group(?: s)?(?: software| licen[sc]e)?
1 | public-domain | public domain | (?:released|placed|dedicated) (?:in ?to|to|in) the public domain
2 | public-domain | public domain | (?:is|are) in the public domain
2 | public-domain | no rights | no rights reserved
1 | proprietary | proprietary | (?:confidential and proprietary|proprietary and confidential)
2 | proprietary | unauthori | unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: or (?:copying|use|reproduction|distribution))? of this (?:file|document|material|software)
2 | proprietary | without the prior | (?:may not|no part of this [^ ]+ may) be (?:copied|reproduced|redistributed)(?: [^ ]+){0,8} without the prior written (?:permission|consent)
2 | proprietary | end user | end user licen[sc]e agreement
2 | reserved | rights reserved | (?:all|some) rights reserved(?: worldwide)?
2 | copyright | copyright | copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)?[0-9][0-9])*
3 | copyright | copyright | copyright (?:c|by|of)
3 | license-reference | license file | see (?:the )?(?:accompanying )?license file(?: for details)?
3 | license-reference | licensed under | licensed under (?:the )?(?:terms of )?
"""


class Rule(NamedTuple):
    id: int
    priority: int
    label: str
    keyword: str
    regex: str


def rules() -> list[Rule]:
    found = []
    for line in RULES_TEXT.strip().splitlines():
        priority, label, keyword, regex = (x.strip() for x in line.split(" | ", 3))
        found.append(Rule(len(found), int(priority), label, keyword, f"(?<= )(?:{regex})(?= )"))
    return found
