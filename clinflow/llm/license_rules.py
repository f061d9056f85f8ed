"""Signature rules for licences, in the order of their priority.

One rule a line: label, keywords (one of them must be a word of the text), pattern. Patterns read the words of a
text in lower case with one space between them, whatever stood between them before, and match whole words. What a rule finds is worth
as much as its section says. A find inside one of an earlier rule isn't reported.
"""

import re
from typing import NamedTuple

#: Section: (what a find is worth, rules). Within a section the more special rule comes first.
SECTIONS: dict[str, tuple[float, str]] = {
    "tag": (1.0, r"""
agpl-3.0 | spdx | spdx licen[cs]e identifier agpl 3 0(?: only| or later)?
lgpl-3.0 | spdx | spdx licen[cs]e identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 | spdx | spdx licen[cs]e identifier lgpl 2 1(?: only| or later)?
lgpl-2.0 | spdx | spdx licen[cs]e identifier lgpl 2 0(?: only| or later)?
gpl-2.0-classpath | spdx | spdx licen[cs]e identifier gpl 2 0(?: only| or later)? with classpath exception 2 0
gpl-2.0-linux-note | spdx | spdx licen[cs]e identifier gpl 2 0(?: only| or later)? with linux syscall note
gpl-3.0 | spdx | spdx licen[cs]e identifier gpl 3 0(?: only| or later)?
gpl-2.0 | spdx | spdx licen[cs]e identifier gpl 2 0(?: only| or later)?
gpl-1.0 | spdx | spdx licen[cs]e identifier gpl 1 0(?: only| or later)?
gfdl-1.3 | spdx | spdx licen[cs]e identifier gfdl 1 3(?: only| or later)?
apache-2.0-llvm | spdx | spdx licen[cs]e identifier apache 2 0 with llvm exception
apache-2.0 | spdx | spdx licen[cs]e identifier apache 2 0
apache-1.1 | spdx | spdx licen[cs]e identifier apache 1 1
mit-0 | spdx | spdx licen[cs]e identifier mit 0
mit | spdx | spdx licen[cs]e identifier mit
bsd-2-clause-patent | spdx | spdx licen[cs]e identifier bsd 2 clause patent
bsd-2-clause | spdx | spdx licen[cs]e identifier bsd 2 clause
bsd-3-clause-clear | spdx | spdx licen[cs]e identifier bsd 3 clause clear
bsd-3-clause | spdx | spdx licen[cs]e identifier bsd 3 clause
bsd-4-clause | spdx | spdx licen[cs]e identifier bsd 4 clause
0bsd | spdx | spdx licen[cs]e identifier 0bsd
mpl-2.0 | spdx | spdx licen[cs]e identifier mpl 2 0
mpl-1.1 | spdx | spdx licen[cs]e identifier mpl 1 1
epl-2.0 | spdx | spdx licen[cs]e identifier epl 2 0
epl-1.0 | spdx | spdx licen[cs]e identifier epl 1 0
cddl-1.0 | spdx | spdx licen[cs]e identifier cddl 1 0
isc | spdx | spdx licen[cs]e identifier isc
zlib | spdx | spdx licen[cs]e identifier zlib
bsl-1.0 | spdx | spdx licen[cs]e identifier bsl 1 0
busl-1.1 | spdx | spdx licen[cs]e identifier busl 1 1
unlicense | spdx | spdx licen[cs]e identifier unlicense
wtfpl | spdx | spdx licen[cs]e identifier wtfpl
cc0-1.0 | spdx | spdx licen[cs]e identifier cc0 1 0
cc-by-nc-nd-4.0 | spdx | spdx licen[cs]e identifier cc by nc nd 4 0
cc-by-nc-sa-4.0 | spdx | spdx licen[cs]e identifier cc by nc sa 4 0
cc-by-nc-4.0 | spdx | spdx licen[cs]e identifier cc by nc 4 0
cc-by-nd-4.0 | spdx | spdx licen[cs]e identifier cc by nd 4 0
cc-by-sa-4.0 | spdx | spdx licen[cs]e identifier cc by sa 4 0
cc-by-sa-3.0 | spdx | spdx licen[cs]e identifier cc by sa 3 0
cc-by-4.0 | spdx | spdx licen[cs]e identifier cc by 4 0
cc-by-3.0 | spdx | spdx licen[cs]e identifier cc by 3 0
artistic-2.0 | spdx | spdx licen[cs]e identifier artistic 2 0
postgresql | spdx | spdx licen[cs]e identifier postgresql
psf-2.0 | spdx | spdx licen[cs]e identifier (?:psf|python) 2 0
ofl-1.1 | spdx | spdx licen[cs]e identifier ofl 1 1
ecl-2.0 | spdx | spdx licen[cs]e identifier ecl 2 0
eupl-1.2 | spdx | spdx licen[cs]e identifier eupl 1 2
ms-pl | spdx | spdx licen[cs]e identifier ms pl
sspl-1.0 | spdx | spdx licen[cs]e identifier sspl 1 0
odbl-1.0 | spdx | spdx licen[cs]e identifier odbl 1 0
ncsa | spdx | spdx licen[cs]e identifier ncsa
"""),
    "notice": (0.95, r"""
gpl-3.0 | redistribute | free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3
gpl-2.0 | redistribute | free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2
agpl-3.0 | redistribute | free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3
lgpl-2.1 | redistribute | free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1
lgpl-3.0 | redistribute | free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3
lgpl-2.0 | redistribute | free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation (?:either )?version 2
apache-2.0 | apache | licensed under the apache license version 2 0(?: the license)? you may not use this (?:file|work|software) except in compliance with the license
apache-2.0 | distributed | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [a-z ]{0,160}without restriction including without limitation the rights to [a-z ]{0,120}sell copies of the software and to permit persons to whom the software is furnished to do so
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause | endorse | neither the names? of [^ ]+(?: [^ ]+){0,12} nor the names of (?:its|the|his|their) contributors may be used to endorse or promote products
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause-clear | patent | no express or implied licenses to any partys? patent rights are granted by this license
isc | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl-2.0 | eclipse | made available under the terms of the eclipse public license (?:v )?2 0
epl-1.0 | eclipse | made available under the terms of the eclipse public license v1 0
cddl | cddl | the contents of this file are subject to the terms of (?:either [a-z0-9 ]{0,80})?(?:the )?common development and distribution license
unlicense | encumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | do what the fuck you want to public license
bsl-1.0 | boost | distributed under the boost software license version 1 0
cc0-1.0 | waive | to the extent possible under law [^ ]+(?: [^ ]+){0,12} (?:has|have) waived all copyright and related or neighbou?ring rights
cc0-1.0 | waived | to the extent possible under law [^ ]+(?: [^ ]+){0,12} (?:has|have) waived all copyright and related or neighbou?ring rights
gfdl | gnu | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
ofl-1.1 | sil | this font software is licensed under the sil open font license version 1 1
psf-2.0 | python | psf is making python available to licensee on an as is basis
artistic-2.0 | artistic | you can redistribute it and or modify it under the terms of the artistic license (?:version )?2 0
perl | perl | you can redistribute it and or modify it under the same terms as perl itself
x11 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
hpnd | suitability | makes no representations about the suitability of this software for any purpose it is provided as is
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 | php | this product includes php software freely available from http www php net software
apache-1.1 | apache | this product includes software developed by the apache software foundation http www apache org
beerware | beer | you can buy me a beer in return
json | evil | the software shall be used for good not evil
curl | curl | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice [a-z ]{0,40}curl
unicode | unicode | distributed under the terms of use in https? www unicode org copyright html
proprietary | confidential | this (?:document|file|software|material) (?:is|contains) (?:proprietary and confidential|confidential and proprietary)(?: information)?
proprietary | unauthorized | unauthorized (?:copying|use|distribution|reproduction)(?: or (?:copying|use|distribution|reproduction))* (?:of this [a-z]+ )?(?:via any medium )?is strictly prohibited
"""),
    "address": (0.9, r"""
agpl-3.0 | agpl | gnu org licen[cs]es agpl(?: 3 0)?(?: html| txt)?
lgpl-3.0 | lgpl | gnu org licen[cs]es lgpl 3 0(?: html| txt)?
lgpl-2.1 | lgpl | gnu org licen[cs]es (?:old licen[cs]es )?lgpl 2 1(?: html| txt)?
gpl-3.0 | gpl | gnu org licen[cs]es gpl 3 0(?: html| txt)?
gpl-2.0 | gpl | gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0(?: html| txt)?
gpl | gpl gnu | gnu org licen[cs]es(?: gpl)?(?: html| txt)?
gfdl | fdl | gnu org (?:copyleft|licen[cs]es) fdl(?: 1 [0-9])?(?: html| txt)?
apache-2.0 | apache | apache org licen[cs]es licen[cs]e 2 0(?: html| txt)?
mit | mit | opensource org licen[cs]es? mit(?: licen[cs]e)?(?: php| html)?
bsd-3-clause | bsd | opensource org licen[cs]es? bsd 3 clause
bsd-2-clause | bsd | opensource org licen[cs]es? bsd 2 clause
bsd | bsd | opensource org licen[cs]es? bsd licen[cs]e(?: php| html)?
isc | isc | opensource org licen[cs]es? isc
apache-2.0 | opensource | opensource org licen[cs]es? apache 2 0
mpl-2.0 | mpl | mozilla org (?:en us )?mpl 2 0
mpl-1.1 | mpl | mozilla org mpl 1 1|mozilla org mpl mpl 1 1(?: html| txt)?
epl-2.0 | epl eclipse | eclipse org (?:legal|org documents) epl 2 0(?: html| txt)?
epl-1.0 | epl eclipse | eclipse org (?:legal|org documents) epl v10(?: html| txt)?
bsl-1.0 | boost | boost org licen[cs]e 1 0 txt
unlicense | unlicense | unlicense org
wtfpl | wtfpl | wtfpl net
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
pdm-1.0 | creativecommons | creativecommons org publicdomain mark 1 0
cc-by-nc-nd-4.0 | creativecommons | creativecommons org licen[cs]es by nc nd 4 0
cc-by-nc-nd-3.0 | creativecommons | creativecommons org licen[cs]es by nc nd 3 0
cc-by-nc-sa-4.0 | creativecommons | creativecommons org licen[cs]es by nc sa 4 0
cc-by-nc-sa-3.0 | creativecommons | creativecommons org licen[cs]es by nc sa 3 0
cc-by-nc-4.0 | creativecommons | creativecommons org licen[cs]es by nc 4 0
cc-by-nc-3.0 | creativecommons | creativecommons org licen[cs]es by nc 3 0
cc-by-nd-4.0 | creativecommons | creativecommons org licen[cs]es by nd 4 0
cc-by-nd-3.0 | creativecommons | creativecommons org licen[cs]es by nd 3 0
cc-by-sa-4.0 | creativecommons | creativecommons org licen[cs]es by sa 4 0
cc-by-sa-3.0 | creativecommons | creativecommons org licen[cs]es by sa 3 0
cc-by-4.0 | creativecommons | creativecommons org licen[cs]es by 4 0
cc-by-3.0 | creativecommons | creativecommons org licen[cs]es by 3 0
cc-by-2.0 | creativecommons | creativecommons org licen[cs]es by 2 0
odbl-1.0 | opendatacommons | opendatacommons org licen[cs]es odbl(?: 1 0)?
pddl-1.0 | opendatacommons | opendatacommons org licen[cs]es pddl(?: 1 0)?
odc-by-1.0 | opendatacommons | opendatacommons org licen[cs]es by(?: 1 0)?
ofl-1.1 | ofl sil | (?:scripts )?sil org ofl
artistic-2.0 | artistic | opensource org licen[cs]es? artistic(?: licen[cs]e)? 2 0
ogl-3.0 | nationalarchives | nationalarchives gov uk doc open government licen[cs]e version 3
eupl | eupl | joinup ec europa eu (?:[a-z]+ )*eupl
"""),
    "name and version": (0.9, r"""
agpl-3.0 | affero agplv3 agpl | (?:gnu )?affero general public licen[cs]e(?: version| v)? v?3(?: 0)?|agpl(?: licen[cs]e)?(?: version| v)? ?v?3(?: 0)?
lgpl-3.0 | lesser lgplv3 lgpl | (?:gnu )?lesser general public licen[cs]e(?: version| v)? v?3(?: 0)?|lgpl(?: licen[cs]e)?(?: version| v)? ?v?3(?: 0)?
lgpl-2.1 | lesser lgplv2 lgpl | (?:gnu )?lesser general public licen[cs]e(?: version| v)? v?2 1|lgpl(?: licen[cs]e)?(?: version| v)? ?v?2 1
lgpl-2.0 | library lgplv2 lgpl | (?:gnu )?library general public licen[cs]e(?: version| v)? v?2(?: 0)?|lgpl(?: licen[cs]e)?(?: version| v)? ?v?2(?: 0)?
gpl-2.0-classpath | classpath | (?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? ?v?2(?: 0)? with (?:the )?classpath exception
gpl-3.0 | general gplv3 gpl gpl3 | (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? v?3(?: 0)?(?: or (?:any )?later(?: version)?)?|(?:gnu )?gpl(?: licen[cs]e)?(?: version| v)? ?v?3(?: 0)?
gpl-2.0 | general gplv2 gpl gpl2 | (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? v?2(?: 0)?(?: or (?:any )?later(?: version)?)?|(?:gnu )?gpl(?: licen[cs]e)?(?: version| v)? ?v?2(?: 0)?
gpl-1.0 | general gplv1 | (?:gnu )?general public licen[cs]e(?: version| v)? v?1(?: 0)?|gplv1
gfdl-1.3 | documentation gfdl | (?:gnu )?free documentation licen[cs]e(?: version| v)? v?1 3|gfdl v?1 3
gfdl-1.2 | documentation gfdl | (?:gnu )?free documentation licen[cs]e(?: version| v)? v?1 2|gfdl v?1 2
apache-2.0 | apache asl2 | apache(?: software)?(?: foundation)?(?: public)?(?: licen[cs]e)?(?: version| v)? v?2(?: 0)?|asl ?2(?: 0)?
apache-1.1 | apache | apache(?: software)?(?: licen[cs]e)(?: version| v)? v?1 1
apache-1.0 | apache | apache(?: software)?(?: licen[cs]e)(?: version| v)? v?1 0
mpl-2.0 | mozilla mpl mplv2 | mozilla public licen[cs]e(?: mpl)?(?: version| v)? v?2(?: 0)?|mpl ?v?2(?: 0)?
mpl-1.1 | mozilla mpl | mozilla public licen[cs]e(?: mpl)?(?: version| v)? v?1 1|mpl v?1 1
mpl-1.0 | mozilla mpl | mozilla public licen[cs]e(?: mpl)?(?: version| v)? v?1 0|mpl v?1 0
epl-2.0 | eclipse epl | eclipse public licen[cs]e(?: epl)?(?: version| v)? v?2(?: 0)?|epl v?2(?: 0)?
epl-1.0 | eclipse epl | eclipse public licen[cs]e(?: epl)?(?: version| v)? v?1(?: 0)?|epl v?1(?: 0)?
edl-1.0 | eclipse | eclipse distribution licen[cs]e(?: version| v)? v?1(?: 0)?
cpl-1.0 | common | common public licen[cs]e(?: version| v)? v?1(?: 0)?
cddl-1.1 | cddl distribution | common development and distribution licen[cs]e(?: cddl)?(?: version| v)? v?1 1|cddl v?1 1
cddl-1.0 | cddl distribution | common development and distribution licen[cs]e(?: cddl)?(?: version| v)? v?1(?: 0)?|cddl v?1(?: 0)?
cpal-1.0 | attribution cpal | common public attribution licen[cs]e(?: version| v)? v?1(?: 0)?|cpal(?: 1 0)
apsl-2.0 | apple | apple public source licen[cs]e(?: version| v)? v?2(?: 0)?
artistic-2.0 | artistic | artistic licen[cs]e(?: version| v)? v?2(?: 0)?
artistic-1.0 | artistic | artistic licen[cs]e(?: version| v)? v?1(?: 0)?
bsl-1.0 | boost | boost software licen[cs]e(?: version| v)? v?1(?: 0)?
busl-1.1 | business busl | business source licen[cs]e(?: version| v)? v?1 1|busl 1 1
elastic-2.0 | elastic | elastic licen[cs]e(?: version| v)? v?2(?: 0)?
sspl-1.0 | server sspl | server side public licen[cs]e(?: version| v)? v?1(?: 0)?|sspl v?1(?: 0)?
ecl-2.0 | educational | educational community licen[cs]e(?: version| v)? v?2(?: 0)?
eupl-1.2 | european eupl | european union public licen[cs]e(?: version| v)? v?1 2|eupl v?1 2
eupl-1.1 | european eupl | european union public licen[cs]e(?: version| v)? v?1 1|eupl v?1 1
osl-3.0 | open osl | open software licen[cs]e(?: version| v)? v?3(?: 0)?|osl v?3 0
afl-3.0 | academic afl | academic free licen[cs]e(?: version| v)? v?3(?: 0)?|afl v?3 0
upl-1.0 | universal | universal permissive licen[cs]e(?: version| v)? v?1(?: 0)?
ofl-1.1 | sil ofl | (?:sil )?open font licen[cs]e(?: ofl)?(?: version| v)? v?1 1|ofl v?1 1
psf-2.0 | python psf | python software foundation licen[cs]e(?: version| v)? v?2(?: 0)?|psf v?2(?: 0)?
php-3.01 | php | php licen[cs]e(?: version| v)? v?3 01
php-3.0 | php | php licen[cs]e(?: version| v)? v?3(?: 0)?
zpl-2.1 | zope zpl | zope public licen[cs]e(?: zpl)?(?: version| v)? v?2 1|zpl v?2 1
ms-pl | microsoft | microsoft public licen[cs]e(?: ms pl)?
ms-rl | microsoft | microsoft reciprocal licen[cs]e(?: ms rl)?
bsd-2-clause | bsd freebsd simplified | (?:2|two) clause(?: simplified)? bsd(?: licen[cs]e)?|bsd (?:2|two) clause(?: licen[cs]e)?|simplified bsd(?: licen[cs]e)?|freebsd licen[cs]e
bsd-3-clause | bsd | (?:3|three) clause(?: new| revised| modified)? bsd(?: licen[cs]e)?|bsd (?:3|three) clause(?: licen[cs]e)?|(?:new|revised|modified) bsd(?: licen[cs]e)?
bsd-4-clause | bsd | (?:4|four) clause bsd(?: licen[cs]e)?|bsd (?:4|four) clause(?: licen[cs]e)?|original bsd licen[cs]e
0bsd | 0bsd bsd | 0bsd|zero clause bsd(?: licen[cs]e)?
cc0-1.0 | cc0 zero | cc0(?: 1 0)?(?: universal)?|creative commons (?:cc0|zero)(?: v?1 0)?(?: universal)?
cc-by-nc-nd-4.0 | nd noderivatives noderivs derivatives | cc by nc nd v?4(?: 0)?|attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? 4 0(?: international)?
cc-by-nc-nd-3.0 | nd noderivatives noderivs derivatives | cc by nc nd v?3(?: 0)?|attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? 3 0(?: unported)?
cc-by-nc-nd-2.0 | nd noderivatives noderivs derivatives | cc by nc nd v?2(?: 0)?|attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? 2 0
cc-by-nc-sa-4.0 | sa sharealike share | cc by nc sa v?4(?: 0)?|attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-sa-3.0 | sa sharealike share | cc by nc sa v?3(?: 0)?|attribution non ?commercial share ?alike 3 0(?: unported)?
cc-by-nc-sa-2.0 | sa sharealike share | cc by nc sa v?2(?: 0)?|attribution non ?commercial share ?alike 2 0
cc-by-nc-4.0 | nc noncommercial commercial | cc by nc v?4(?: 0)?|attribution non ?commercial 4 0(?: international)?
cc-by-nc-3.0 | nc noncommercial commercial | cc by nc v?3(?: 0)?|attribution non ?commercial 3 0(?: unported)?
cc-by-nc-2.0 | nc noncommercial commercial | cc by nc v?2(?: 0)?|attribution non ?commercial 2 0
cc-by-nd-4.0 | nd noderivatives noderivs derivatives | cc by nd v?4(?: 0)?|attribution no ?deriv(?:ative)?s?(?: works)? 4 0(?: international)?
cc-by-nd-3.0 | nd noderivatives noderivs derivatives | cc by nd v?3(?: 0)?|attribution no ?deriv(?:ative)?s?(?: works)? 3 0(?: unported)?
cc-by-sa-4.0 | sa sharealike share | cc by sa v?4(?: 0)?|attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0 | sa sharealike share | cc by sa v?3(?: 0)?|attribution share ?alike 3 0(?: unported)?
cc-by-sa-2.5 | sa sharealike share | cc by sa 2 5|attribution share ?alike 2 5
cc-by-sa-2.0 | sa sharealike share | cc by sa v?2(?: 0)?|attribution share ?alike 2 0
cc-by-4.0 | cc attribution | cc by v?4(?: 0)?|creative commons attribution(?: licen[cs]e)? 4 0(?: international)?|attribution 4 0 international
cc-by-3.0 | cc attribution | cc by v?3(?: 0)?|creative commons attribution(?: licen[cs]e)? 3 0(?: unported)?|attribution 3 0 unported
cc-by-2.5 | cc attribution | cc by 2 5|creative commons attribution(?: licen[cs]e)? 2 5
cc-by-2.0 | cc attribution | cc by v?2(?: 0)?|creative commons attribution(?: licen[cs]e)? 2 0
odbl-1.0 | odbl database | (?:odc )?open (?:data commons open )?database licen[cs]e(?: odbl)?(?: v)? ?v?1 0|odbl(?: v)? ?v?1 0
odc-by-1.0 | odc commons | open data commons attribution licen[cs]e(?: v)? ?v?1 0|odc by(?: 1 0)?
pddl-1.0 | pddl dedication | (?:open data commons )?public domain dedication and licen[cs]e(?: v?1 0)?|pddl(?: 1 0)?
ogl-3.0 | government ogl | open government licen[cs]e(?: version| v)? ?v?3 0|ogl v?3 0
ogl-2.0 | government ogl | open government licen[cs]e(?: version| v)? ?v?2 0|ogl v?2 0
etalab-2.0 | etalab ouverte | licence ouverte(?: open licence)?(?: version| v)? ?v?2(?: 0)?|etalab 2 0
dl-de-by-2.0 | datenlizenz | datenlizenz deutschland namensnennung(?: version)? 2 0
llama-2 | llama | llama 2 community licen[cs]e(?: agreement)?
llama-3 | llama | llama 3(?: [0-9])? community licen[cs]e(?: agreement)?
openrail-m | openrail rail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)?
cecill-2.1 | cecill | cecill(?: free software licen[cs]e(?: agreement)?)?(?: version| v)? ?v?2 1
mulan-2.0 | mulan | mulan(?: permissive software)?(?: psl)?(?: licen[cs]e)?(?: version| v)? ?v?2
"""),
    "name": (0.7, r"""
agpl | affero agpl | (?:gnu )?affero(?: general public)? licen[cs]e|(?:gnu )?agpl
lgpl | lesser library lgpl | (?:gnu )?(?:lesser|library) general public licen[cs]e|(?:gnu )?lgpl
gpl | general gpl | (?:gnu )?general public licen[cs]e|gnu gpl|gpl licen[cs]e
gfdl | documentation gfdl | (?:gnu )?free documentation licen[cs]e|gfdl
apache | apache | apache(?: software)?(?: public)? licen[cs]e|apache(?: software)? foundation licen[cs]e
mit | mit expat x11 | (?:the )?mit(?: x11)?(?: open source)? licen[cs]e|expat licen[cs]e|mit licensed|licensed under mit
x11 | x11 | x11 licen[cs]e
bsd | bsd | bsd(?: style| type)? licen[cs]e|berkeley software distribution licen[cs]e
isc | isc | isc(?: style)? licen[cs]e
zlib | zlib libpng | zlib(?: libpng)? licen[cs]e|libpng licen[cs]e
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
cddl | distribution cddl | common development and distribution licen[cs]e|cddl
cpl | common | common public licen[cs]e
ipl | ibm | ibm public licen[cs]e
npl | netscape | netscape public licen[cs]e
sissl | sun | sun industry standards source licen[cs]e
spl | sun | sun public licen[cs]e
apsl | apple | apple public source licen[cs]e
artistic | artistic | (?:perl )?artistic licen[cs]e
boost | boost | boost(?: software)? licen[cs]e
busl | business | business source licen[cs]e
commons-clause | clause | commons clause(?: licen[cs]e)?(?: condition)?
elastic | elastic | elastic licen[cs]e
sspl | sspl server | server side public licen[cs]e|sspl
eupl | european | european union public licen[cs]e
cecill | cecill | cecill(?: [bc])?(?: licen[cs]e)?
ofl | sil font | (?:sil )?open font licen[cs]e
psf | python | python(?: software foundation)? licen[cs]e
php | php | php licen[cs]e
ruby | ruby | ruby licen[cs]e|same terms as ruby
postgresql | postgresql | postgresql licen[cs]e
openssl | openssl | openssl licen[cs]e
ncsa | ncsa illinois | (?:university of illinois )?ncsa open source licen[cs]e
wtfpl | wtfpl | wtfpl
unlicense | unlicense | (?:the )?unlicense
w3c | w3c | w3c(?: software)?(?: and document)?(?: notice and)? licen[cs]e
zope | zope | zope public licen[cs]e
vim | vim | vim licen[cs]e
tcl | tcl | tcl(?: tk)? licen[cs]e
ijg | jpeg | independent jpeg group licen[cs]e
libtiff | libtiff | libtiff licen[cs]e
unicode | unicode | unicode(?: data files and software)? licen[cs]e(?: agreement)?
odbl | odbl database | open database licen[cs]e|odbl
ogl | government | open government licen[cs]e
cdla | community cdla | community data licen[cs]e agreement(?: permissive| sharing)?|cdla (?:permissive|sharing)
cc-by-nc-nd | nd noderivatives noderivs derivatives | cc by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa | sa sharealike share | cc by nc sa|attribution non ?commercial share ?alike
cc-by-nc | nc noncommercial commercial | cc by nc|attribution non ?commercial
cc-by-nd | nd noderivatives noderivs derivatives | cc by nd|attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-sa | sa sharealike share | cc by sa|attribution share ?alike
cc-by | cc attribution | cc by|creative commons attribution(?: licen[cs]e)?|licence creative commons attribution
creative-commons | creative | creative commons(?: public)?(?: licen[cs]e)?|licen(?:ce|cia) creative commons|creative commons lizenz
public-domain | domain dominio domaine gemeinfrei | (?:in|into|to) the public domain|public domain (?:work|dedication|mark)|dominio publico|domaine public|gemeinfrei
"""),
    "hint": (0.4, r"""
reserved | reserved reservados rechte droits | all rights? reserved|todos los derechos reservados|alle rechte vorbehalten|tous droits reserves
copyright | copyright | copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*
proprietary | proprietary | proprietary(?: software)? licen[cs]e|proprietary and confidential
eula | eula agreement | end user licen[cs]e agreement|eula
terms-of-service | terms | terms of (?:service|use) apply|subject to (?:the|our|these) terms of (?:service|use)
no-redistribution | redistributed redistribute | (?:may|must) not be (?:reproduced|copied|redistributed)(?: or (?:reproduced|copied|redistributed))*|do not redistribute
non-commercial | commercial noncommercial | for non ?commercial (?:use|purposes)(?: only)?|no commercial use
research-only | research | for (?:academic(?: and| or) )?research (?:use|purposes) only
licensed | licensed | licensed under(?: the)? (?:terms|conditions)
"""),
}


class Rule(NamedTuple):
    label: str
    worth: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern


def rules() -> list[Rule]:
    out = []
    for worth, lines in SECTIONS.values():
        for line in lines.strip().splitlines():
            label, keywords, pattern = line.split(" | ", 2)
            whole = rf"(?<![^ ])(?:{pattern})(?![^ ])".encode()
            out.append(Rule(label, worth, tuple(keywords.encode().split()), re.compile(whole)))
    return out
