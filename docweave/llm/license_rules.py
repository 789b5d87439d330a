"""The signature rules of the license scan, in order: priority | label | keyword | regex.

Regexes run on lower-cased UTF-8 bytes; a blank matches white space and comment marks, ` ?` may match nothing. All
words of a keyword must occur for its regex to run, so every alternative of a regex holds them.
Priorities: 1 whole notices and tags, 2 named with version, 3 named, 4 mentions.
"""

RULES = r"""
# tags
2 | spdx | spdx-license-identifier | spdx-license-identifier:\s*\(?[a-z0-9][\w.+-]{0,80}
1 | apache-2.0 | spdx-license-identifier | spdx-license-identifier:\s*\(?apache-2\.0
1 | mit | spdx-license-identifier | spdx-license-identifier:\s*\(?mit\b
1 | gpl-2.0 | spdx-license-identifier | spdx-license-identifier:\s*\(?gpl-2\.0(?:-only|-or-later|\+)?
1 | gpl-3.0 | spdx-license-identifier | spdx-license-identifier:\s*\(?gpl-3\.0(?:-only|-or-later|\+)?
1 | lgpl-2.1 | spdx-license-identifier | spdx-license-identifier:\s*\(?lgpl-2\.1(?:-only|-or-later|\+)?
1 | lgpl-3.0 | spdx-license-identifier | spdx-license-identifier:\s*\(?lgpl-3\.0(?:-only|-or-later|\+)?
1 | agpl-3.0 | spdx-license-identifier | spdx-license-identifier:\s*\(?agpl-3\.0(?:-only|-or-later|\+)?
1 | mpl-2.0 | spdx-license-identifier | spdx-license-identifier:\s*\(?mpl-2\.0
1 | bsd-2-clause | spdx-license-identifier | spdx-license-identifier:\s*\(?bsd-2-clause
1 | bsd-3-clause | spdx-license-identifier | spdx-license-identifier:\s*\(?bsd-3-clause
1 | isc | spdx-license-identifier | spdx-license-identifier:\s*\(?isc\b
1 | unlicense | spdx-license-identifier | spdx-license-identifier:\s*\(?unlicense
1 | cc0-1.0 | spdx-license-identifier | spdx-license-identifier:\s*\(?cc0-1\.0
1 | epl-2.0 | spdx-license-identifier | spdx-license-identifier:\s*\(?epl-2\.0
# whole notices
1 | mit | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
1 | mit | the software is provided | the software is provided as is,? without warranty of any kind, express or implied
1 | isc | permission to use | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
1 | hpnd | permission to use | permission to use, copy, modify,? (?:and )?distribute(?:,? and sell)? this software and its documentation for any purpose
1 | ntp | permission to use | permission to use, copy, modify,? and distribute this software and its documentation for any purpose with or without fee
1 | bsd | redistribution and use | redistribution and use in source and binary forms,? with or without modification,? are permitted
1 | bsd-3-clause | neither the name | neither the names? of .{1,120}? may be used to endorse or promote products
1 | bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software
1 | bsd-2-clause | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice
1 | zlib | altered source versions | altered source versions must be plainly marked as such
1 | zlib | the origin of this software | the origin of this software must not be misrepresented
1 | apache-2.0 | licensed under the apache | licensed under the apache license,? version 2(?:\.0)?
1 | apache-1.1 | licensed under the apache | licensed under the apache (?:software )?license,? version 1\.1
1 | apache-1.0 | licensed under the apache | licensed under the apache (?:software )?license,? version 1\.0
1 | apache-2.0 | you may not use this file | you may not use this file except in compliance with the license
1 | apache-2.0 | apache.org/licenses | apache\.org/licenses/license-2\.0
1 | apache-1.1 | apache.org/licenses | apache\.org/licenses/license-1\.1
1 | gpl | this program is free software | this program is free software[:;,]? you can redistribute it and(?:/or)? modify it under the terms of the gnu general public license
1 | gpl | warranty of merchantability | without even the implied warranty of merchantability or fitness for a particular purpose
1 | lgpl | this library is free software | this library is free software[:;,]? you can redistribute it and(?:/or)? modify it under the terms of the gnu (?:lesser|library) general public license
1 | agpl | affero general public | under the terms of the gnu affero general public license
1 | gpl-2.0 | general public license | gnu general public license,? (?:as published by the free software foundation[;,]? )?(?:either )?v(?:ersion|\.)? ?2(?:\.0)?\b
1 | gpl-3.0 | general public license | gnu general public license,? (?:as published by the free software foundation[;,]? )?(?:either )?v(?:ersion|\.)? ?3(?:\.0)?\b
1 | gpl-1.0 | general public license | gnu general public license,? (?:as published by the free software foundation[;,]? )?(?:either )?v(?:ersion|\.)? ?1(?:\.0)?\b
1 | mpl-2.0 | mozilla public license | this source code form is subject to the terms of the mozilla public license,? v(?:ersion|\.)? ?2\.0
1 | mpl-1.1 | mozilla public license | the contents of this file are subject to the mozilla public license version 1\.1
1 | mpl-1.0 | mozilla public license | the contents of this file are subject to the mozilla public license version 1\.0
1 | epl-1.0 | eclipse public license | made available under the terms of the eclipse public license v(?:ersion|\.)? ?1\.0
1 | epl-2.0 | eclipse public license | made available under the terms of the eclipse public license v(?:ersion|\.)? ?2\.0
1 | cddl-1.0 | common development and | the contents of this file are subject to the terms of the common development and distribution license
1 | unlicense | released into the public domain | this is free and unencumbered software released into the public domain
1 | cc0-1.0 | dedicated all copyright | dedicated all copyright and related and neighboring rights to this software to the public domain
1 | wtfpl | do what the fuck | you just do what the fuck you want to
1 | bsl-1.0 | boost software license | distributed under the boost software license,? version 1\.0
1 | artistic-2.0 | artistic license | under the terms of the artistic license \(?2\.0\)?
1 | psf-2.0 | python software foundation | python software foundation license,? version 2
1 | beerware | beer-ware | the beer-ware license\W+revision 42
1 | ofl-1.1 | open font license | licensed under the sil open font license,? version 1\.1
1 | eupl-1.2 | licensed under the eupl | licensed under the eupl,? version 1\.2
1 | odbl-1.0 | open database license | made available under the open database license
1 | curl | permission to use | permission to use, copy, modify,? and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
1 | mit-modern | permission is hereby granted | permission is hereby granted, without written agreement and without license or royalty fees
1 | unicode | unicode data files | permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files
1 | x11 | x consortium | except as contained in this notice, the name of the x consortium shall not be used
1 | openssl | openssl project | this product includes software developed by the openssl project
1 | php-3.01 | php license | this source file is subject to version 3\.01 of the php license
1 | zpl-2.1 | zope public license | zope public license,? version 2\.1
1 | w3c | w3c | w3c software notice and license
# named with version
2 | cc-by-4.0 | creativecommons.org | creativecommons\.org/licenses/by/4\.0
2 | cc-by-3.0 | creativecommons.org | creativecommons\.org/licenses/by/3\.0
2 | cc-by-2.5 | creativecommons.org | creativecommons\.org/licenses/by/2\.5
2 | cc-by-2.0 | creativecommons.org | creativecommons\.org/licenses/by/2\.0
2 | cc-by-sa-4.0 | creativecommons.org | creativecommons\.org/licenses/by-sa/4\.0
2 | cc-by-sa-3.0 | creativecommons.org | creativecommons\.org/licenses/by-sa/3\.0
2 | cc-by-sa-2.5 | creativecommons.org | creativecommons\.org/licenses/by-sa/2\.5
2 | cc-by-nc-4.0 | creativecommons.org | creativecommons\.org/licenses/by-nc/4\.0
2 | cc-by-nc-3.0 | creativecommons.org | creativecommons\.org/licenses/by-nc/3\.0
2 | cc-by-nd-4.0 | creativecommons.org | creativecommons\.org/licenses/by-nd/4\.0
2 | cc-by-nd-3.0 | creativecommons.org | creativecommons\.org/licenses/by-nd/3\.0
2 | cc-by-nc-sa-4.0 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/4\.0
2 | cc-by-nc-sa-3.0 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/3\.0
2 | cc-by-nc-nd-4.0 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/4\.0
2 | cc-by-nc-nd-3.0 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/3\.0
2 | cc0-1.0 | creativecommons.org | creativecommons\.org/publicdomain/zero/1\.0
2 | cc-pdm-1.0 | creativecommons.org | creativecommons\.org/publicdomain/mark/1\.0
2 | cc-by-4.0 | cc by | \bcc[ -]by 4\.0
2 | cc-by-3.0 | cc by | \bcc[ -]by 3\.0
2 | cc-by-2.0 | cc by | \bcc[ -]by 2\.[05]
2 | cc-by-sa-4.0 | cc by-sa | \bcc by-sa 4\.0
2 | cc-by-sa-3.0 | cc by-sa | \bcc by-sa 3\.0
2 | cc-by-nc-4.0 | cc by-nc | \bcc by-nc 4\.0
2 | cc-by-nc-3.0 | cc by-nc | \bcc by-nc 3\.0
2 | cc-by-nd-4.0 | cc by-nd | \bcc by-nd 4\.0
2 | cc-by-nd-3.0 | cc by-nd | \bcc by-nd 3\.0
2 | cc-by-nc-sa-4.0 | cc by-nc-sa | \bcc by-nc-sa 4\.0
2 | cc-by-nc-sa-3.0 | cc by-nc-sa | \bcc by-nc-sa 3\.0
2 | cc-by-nc-nd-4.0 | cc by-nc-nd | \bcc by-nc-nd 4\.0
2 | cc-by-nc-nd-3.0 | cc by-nc-nd | \bcc by-nc-nd 3\.0
2 | cc-by-4.0 | creative commons attribution | creative commons attribution 4\.0
2 | cc-by-3.0 | creative commons attribution | creative commons attribution 3\.0
2 | cc-by-sa-4.0 | creative commons attribution | creative commons attribution share-?alike 4\.0
2 | cc-by-sa-3.0 | creative commons attribution | creative commons attribution share-?alike 3\.0
2 | cc-by-nc-4.0 | creative commons attribution | creative commons attribution non-?commercial 4\.0
2 | cc-by-nc-3.0 | creative commons attribution | creative commons attribution non-?commercial 3\.0
2 | cc-by-nd-4.0 | creative commons attribution | creative commons attribution no-?deriv(?:ative)?s 4\.0
2 | cc-by-nc-sa-4.0 | creative commons attribution | creative commons attribution non-?commercial share-?alike 4\.0
2 | cc-by-nc-nd-4.0 | creative commons attribution | creative commons attribution non-?commercial no-?deriv(?:ative)?s 4\.0
2 | cc0-1.0 | cc0 | \bcc0 1\.0
2 | cc0-1.0 | creative commons zero | creative commons zero(?: v(?:ersion)?\.? ?1\.0)?
2 | apache-2.0 | apache | \bapache license,? v(?:ersion|\.)? ?2(?:\.0)?\b
2 | apache-2.0 | apache | \bapache(?:-| )2\.0\b
2 | apache-1.1 | apache | \bapache (?:software )?license,? v(?:ersion|\.)? ?1\.1\b
2 | gpl-2.0 | gpl | \bgplv?[ -]?2(?:\.0)?\b
2 | gpl-3.0 | gpl | \bgplv?[ -]?3(?:\.0)?\b
2 | lgpl-2.0 | lgpl | \blgplv?[ -]?2(?:\.0)?\b(?!\.1)
2 | lgpl-2.1 | lgpl | \blgplv?[ -]?2\.1\b
2 | lgpl-3.0 | lgpl | \blgplv?[ -]?3(?:\.0)?\b
2 | agpl-3.0 | agpl | \bagplv?[ -]?3(?:\.0)?\b
2 | agpl-1.0 | agpl | \bagplv?[ -]?1(?:\.0)?\b
2 | lgpl-2.1 | lesser general public | lesser general public license,? v(?:ersion|\.)? ?2\.1
2 | lgpl-3.0 | lesser general public | lesser general public license,? v(?:ersion|\.)? ?3
2 | lgpl-2.0 | library general public | library general public license,? v(?:ersion|\.)? ?2
2 | agpl-3.0 | affero general public | affero general public license,? v(?:ersion|\.)? ?3
2 | agpl-1.0 | affero general public | affero general public license,? v(?:ersion|\.)? ?1
2 | gpl-2.0 | general public license | general public license,? v(?:ersion|\.)? ?2(?:\.0)?\b
2 | gpl-3.0 | general public license | general public license,? v(?:ersion|\.)? ?3(?:\.0)?\b
2 | mpl-2.0 | mpl | \bmpl[ -]?(?:v(?:ersion)?\.? ?)?2\.0\b
2 | mpl-1.1 | mpl | \bmpl[ -]?(?:v(?:ersion)?\.? ?)?1\.1\b
2 | mpl-2.0 | mozilla public license | mozilla public license,? (?:v(?:ersion|\.)? ?)?2\.0
2 | mpl-1.1 | mozilla public license | mozilla public license,? (?:v(?:ersion|\.)? ?)?1\.1
2 | mpl-1.0 | mozilla public license | mozilla public license,? (?:v(?:ersion|\.)? ?)?1\.0
2 | epl-1.0 | eclipse public license | eclipse public license,? (?:v(?:ersion|\.)? ?)?1\.0
2 | epl-2.0 | eclipse public license | eclipse public license,? (?:v(?:ersion|\.)? ?)?2\.0
2 | epl-1.0 | epl | \bepl[ -]?(?:v ?)?1\.0\b
2 | epl-2.0 | epl | \bepl[ -]?(?:v ?)?2\.0\b
2 | cpl-1.0 | common public license | common public license,? (?:v(?:ersion|\.)? ?)?1\.0
2 | ipl-1.0 | ibm public license | ibm public license,? (?:v(?:ersion|\.)? ?)?1\.0
2 | cddl-1.0 | cddl | \bcddl[ -]?(?:v ?)?1\.0\b
2 | cddl-1.1 | cddl | \bcddl[ -]?(?:v ?)?1\.1\b
2 | bsl-1.0 | boost software license | boost software license,? (?:-| )?(?:v(?:ersion|\.)? ?)?1\.0
2 | artistic-1.0 | artistic license | artistic license,? (?:v(?:ersion|\.)? ?)?1\.0
2 | artistic-2.0 | artistic license | artistic license,? (?:v(?:ersion|\.)? ?)?2\.0
2 | eupl-1.1 | eupl | \beupl[ -]?(?:v(?:ersion)?\.? ?)?1\.1
2 | eupl-1.2 | eupl | \beupl[ -]?(?:v(?:ersion)?\.? ?)?1\.2
2 | ofl-1.1 | open font license | open font license,? (?:v(?:ersion|\.)? ?)?1\.1
2 | ofl-1.0 | open font license | open font license,? (?:v(?:ersion|\.)? ?)?1\.0
2 | odbl-1.0 | odbl | \bodbl[ -]?(?:v ?)?1\.0\b
2 | odc-by-1.0 | odc-by | \bodc-by(?:[ -]?1\.0)?\b
2 | pddl-1.0 | pddl | \bpddl[ -]?(?:v ?)?1\.0\b
2 | osl-3.0 | open software license | open software license,? (?:v(?:ersion|\.)? ?)?3\.0
2 | osl-2.1 | open software license | open software license,? (?:v(?:ersion|\.)? ?)?2\.1
2 | afl-3.0 | academic free license | academic free license,? (?:v(?:ersion|\.)? ?)?3\.0
2 | afl-2.1 | academic free license | academic free license,? (?:v(?:ersion|\.)? ?)?2\.1
2 | gfdl-1.1 | free documentation license | free documentation license,? (?:v(?:ersion|\.)? ?)?1\.1
2 | gfdl-1.2 | free documentation license | free documentation license,? (?:v(?:ersion|\.)? ?)?1\.2
2 | gfdl-1.3 | free documentation license | free documentation license,? (?:v(?:ersion|\.)? ?)?1\.3
2 | cecill-2.1 | cecill | \bcecill[ -]?(?:v(?:ersion)?\.? ?)?2\.1
2 | cecill-2.0 | cecill | \bcecill[ -]?(?:v(?:ersion)?\.? ?)?2(?:\.0)?\b
2 | cecill-b | cecill | \bcecill-b\b
2 | cecill-c | cecill | \bcecill-c\b
2 | lppl-1.3 | latex project public | latex project public license,? (?:v(?:ersion|\.)? ?)?1\.3[abc]?
2 | qpl-1.0 | q public license | q public license,? (?:v(?:ersion|\.)? ?)?1\.0
2 | ms-pl | microsoft public license | microsoft public license(?: \(ms-pl\))?
2 | ms-rl | microsoft reciprocal | microsoft reciprocal license(?: \(ms-rl\))?
2 | upl-1.0 | universal permissive | universal permissive license,? (?:v(?:ersion|\.)? ?)?1\.0
2 | sspl-1.0 | server side public | server side public license(?:,? (?:v(?:ersion|\.)? ?)?1)?
2 | busl-1.1 | business source license | business source license(?:,? (?:v(?:ersion|\.)? ?)?1\.1)?
2 | elastic-2.0 | elastic license | elastic license,? (?:v(?:ersion|\.)? ?)?2(?:\.0)?
2 | mulan-psl-2.0 | mulan | mulan (?:psl|permissive software license),? v(?:ersion)?\.? ?2
2 | apsl-2.0 | apple public source | apple public source license,? (?:v(?:ersion|\.)? ?)?2\.0
2 | ecl-2.0 | educational community | educational community license,? (?:v(?:ersion|\.)? ?)?2\.0
2 | ncsa | university of illinois | university of illinois/?\W*ncsa open source license
2 | blueoak-1.0.0 | blue oak model | blue oak model license(?:,? (?:v(?:ersion)?\.? ?)?1\.0\.0)?
2 | openrail-m | rail | \b(?:bigscience |creativeml )?open ?rail(?:-m|\+\+-m)?\b
2 | llama-2 | llama 2 community | llama 2 community license
2 | llama-3 | llama 3 community | llama 3(?:\.\d)? community license
2 | ogl-3.0 | open government licen | open government licen[cs]e,? (?:v(?:ersion)?\.? ?)?3\.0
2 | ogl-2.0 | open government licen | open government licen[cs]e,? (?:v(?:ersion)?\.? ?)?2\.0
2 | etalab-2.0 | etalab | \betalab[ -]?(?:open licence )?2\.0
2 | dl-de-by-2.0 | datenlizenz | datenlizenz deutschland,? namensnennung,? (?:version )?2\.0
2 | cdla-permissive-2.0 | community data license | community data license agreement,? permissive,? (?:version )?2\.0
2 | cdla-sharing-1.0 | community data license | community data license agreement,? sharing,? (?:version )?1\.0
# named
3 | mit | mit license | \b(?:the )?mit license\b
3 | mit | mit licence | \b(?:the )?mit licence\b
3 | mit | licensed under mit | \blicensed under mit\b
3 | mit | expat license | \bexpat license\b
3 | x11 | x11 license | \bx11 license\b
3 | isc | isc license | \bisc license\b
3 | bsd | bsd license | \b(?:new |modified |simplified |free)?bsd license\b
3 | bsd | bsd-style | \bbsd-style licen[cs]e\b
3 | bsd-2-clause | 2-clause bsd | \b2-clause bsd\b
3 | bsd-3-clause | 3-clause bsd | \b3-clause bsd\b
3 | bsd-2-clause | bsd-2-clause | \bbsd-2-clause\b
3 | bsd-3-clause | bsd-3-clause | \bbsd-3-clause\b
3 | 0bsd | 0bsd | \b0bsd\b
3 | 0bsd | zero-clause bsd | \bzero-clause bsd\b
3 | apache | apache license | \b(?:the )?apache (?:software )?license\b
3 | apache | apache licence | \bapache licence\b
3 | gpl | general public license | \bgnu general public license\b
3 | gpl | gnu gpl | \bgnu gpl\b
3 | lgpl | lesser general public | \b(?:gnu )?lesser general public license\b
3 | lgpl | library general public | \b(?:gnu )?library general public license\b
3 | agpl | affero general public | \b(?:gnu )?affero general public license\b
3 | lgpl | gnu lgpl | \bgnu lgpl\b
3 | agpl | gnu agpl | \bgnu agpl\b
3 | gfdl | free documentation license | \b(?:gnu )?free documentation license\b
3 | mpl | mozilla public license | \bmozilla public license\b
3 | epl | eclipse public license | \beclipse public license\b
3 | cddl | common development and | \bcommon development and distribution license\b
3 | cc-by-nc-nd | cc by-nc-nd | \bcc by-nc-nd\b
3 | cc-by-nc-sa | cc by-nc-sa | \bcc by-nc-sa\b
3 | cc-by-nc | cc by-nc | \bcc by-nc\b(?!-)
3 | cc-by-nd | cc by-nd | \bcc by-nd\b
3 | cc-by-sa | cc by-sa | \bcc by-sa\b
3 | cc-by-nc-nd | cc-by-nc-nd | \bcc-by-nc-nd\b
3 | cc-by-nc-sa | cc-by-nc-sa | \bcc-by-nc-sa\b
3 | cc-by-nc | cc-by-nc | \bcc-by-nc\b(?!-[sn])
3 | cc-by-nd | cc-by-nd | \bcc-by-nd\b
3 | cc-by-sa | cc-by-sa | \bcc-by-sa\b
3 | cc-by | cc-by | \bcc-by\b(?!-[sn])
3 | cc-by | creative commons attribution | \bcreative commons attribution(?: license)?\b
3 | cc | creative commons | \bcreative commons(?: licen[cs]e)?\b
3 | cc0 | cc0 | \bcc0\b
3 | public-domain | public domain | \b(?:in|into|to) the public domain\b
3 | unlicense | unlicense | \bthe unlicense\b
3 | wtfpl | wtfpl | \bwtfpl\b
3 | zlib | zlib license | \bzlib(?:/libpng)? license\b
3 | libpng | libpng license | \blibpng license\b
3 | bsl | boost software license | \bboost software license\b
3 | artistic | artistic license | \bartistic license\b
3 | psf | python software foundation | \bpython software foundation license\b
3 | php | php license | \bphp license\b
3 | ruby | ruby license | \bruby(?:'s)? license\b
3 | perl | same terms as perl | \bsame terms as perl(?: itself)?\b
3 | ofl | open font license | \b(?:sil )?open font license\b
3 | eupl | european union public | \beuropean union public licen[cs]e\b
3 | odbl | open database license | \bopen (?:data commons )?database license\b
3 | odc-by | open data commons | \bopen data commons attribution license\b
3 | pddl | public domain dedication | \bpublic domain dedication (?:and|&) licen[cs]e\b
3 | osl | open software license | \bopen software license\b
3 | afl | academic free license | \bacademic free license\b
3 | lppl | latex project public | \blatex project public license\b
3 | beerware | beerware | \bbeerware\b
3 | openssl | openssl license | \bopenssl license\b
3 | vim | vim license | \bvim license\b
3 | postgresql | postgresql licen | \bpostgresql licen[cs]e\b
3 | w3c | w3c software | \bw3c software (?:notice|license)\b
3 | zpl | zope public license | \bzope public license\b
3 | ogl | open government licen | \bopen government licen[cs]e\b
3 | sleepycat | sleepycat | \bsleepycat license\b
3 | freetype | freetype | \bfreetype (?:project )?license\b
3 | ijg | independent jpeg | \bindependent jpeg group(?:'s)? (?:software|license)\b
3 | imagemagick | imagemagick license | \bimagemagick license\b
3 | jasper | jasper license | \bjasper license\b
3 | naist | naist | \bnaist license\b
3 | proprietary | proprietary | \b(?:this is )?proprietary (?:and confidential|software|license|information)\b
3 | proprietary | confidential | \bconfidential and proprietary\b
3 | all-rights-reserved | rights reserved | \ball rights (?:are )?reserved\b
3 | all-rights-reserved | droits | \btous droits r\xc3\xa9serv\xc3\xa9s\b
3 | all-rights-reserved | rechte vorbehalten | \balle rechte vorbehalten\b
3 | all-rights-reserved | derechos reservados | \btodos los derechos reservados\b
3 | some-rights-reserved | some rights reserved | \bsome rights reserved\b
3 | non-commercial | commercial use | \b(?:for )?non-?commercial use only\b
3 | evaluation | evaluation | \bfor evaluation (?:purposes|use) only\b
3 | no-derivatives | derivative works | \bno derivative works\b
# mentions
4 | gpl | gpl | \bgpl(?:'?d)?\b
4 | lgpl | lgpl | \blgpl\b
4 | agpl | agpl | \bagpl\b
4 | copyleft | copyleft | \bcopyleft\b
4 | copyright | copyright | \bcopyright (?:\(c\) |\xc2\xa9 )?(?:\d{4}(?: ?- ?\d{4})?)
4 | copyright | (c) | \(c\) (?:19|20)\d\d\b
4 | copyright | © | \xc2\xa9 ?(?:19|20)\d\d\b
4 | dual-license | dual | \bdual[- ]licen[cs]ed\b
4 | eula | end user license | \bend[- ]user license agreement\b
4 | eula | eula | \beula\b
4 | terms | terms of use | \bsubject to (?:the )?terms of use\b
4 | warranty-disclaimer | without warrant | \bwithout warrant(?:y|ies) of any kind\b
4 | open-source | open source licen | \bopen source licen[cs]e\b
4 | free-software | free software licen | \bfree software licen[cs]e\b
"""
