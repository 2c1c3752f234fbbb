"""Signatures of licences, in order of precedence inside each level.

A line has a label, a level, the keyword that gates the rule and a pattern over words in lower case with single spaces
between them (``GPL-2.0+`` reads ``gpl 2 0``).  The keyword stands in the pattern as a word; the first place it has there is the
one that is met in the text.  Levels: 1 machine-readable tags and sentences of the licence itself, 2 names with a version, 3 names
alone, 4 hints.  A pattern spans at most ``REACH`` words on either side of its keyword.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Words that a window shows on either side of a keyword.
REACH = 24
#: How sure a detection of each level is.
SURE = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}

SIGNATURES = r"""
apache-2.0 1 identifier license identifier apache 2 0
apache-1.1 1 identifier license identifier apache 1 1
mit 1 identifier license identifier mit
mit-0 1 identifier license identifier mit 0
isc 1 identifier license identifier isc
0bsd 1 identifier license identifier 0bsd
bsd-2-clause 1 identifier license identifier bsd 2 clause
bsd-3-clause 1 identifier license identifier bsd 3 clause
bsd-4-clause 1 identifier license identifier bsd 4 clause
gpl-1.0 1 identifier license identifier gpl 1 0(?: only| or later)?
gpl-2.0 1 identifier license identifier gpl 2 0(?: only)?
gpl-2.0+ 1 identifier license identifier gpl 2 0 or later
gpl-3.0 1 identifier license identifier gpl 3 0(?: only)?
gpl-3.0+ 1 identifier license identifier gpl 3 0 or later
lgpl-2.0 1 identifier license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 1 identifier license identifier lgpl 2 1(?: only)?
lgpl-2.1+ 1 identifier license identifier lgpl 2 1 or later
lgpl-3.0 1 identifier license identifier lgpl 3 0(?: only)?
lgpl-3.0+ 1 identifier license identifier lgpl 3 0 or later
agpl-3.0 1 identifier license identifier agpl 3 0(?: only| or later)?
mpl-1.1 1 identifier license identifier mpl 1 1
mpl-2.0 1 identifier license identifier mpl 2 0
epl-1.0 1 identifier license identifier epl 1 0
epl-2.0 1 identifier license identifier epl 2 0
cddl-1.0 1 identifier license identifier cddl 1 0
cddl-1.1 1 identifier license identifier cddl 1 1
eupl-1.1 1 identifier license identifier eupl 1 1
eupl-1.2 1 identifier license identifier eupl 1 2
bsl-1.0 1 identifier license identifier bsl 1 0
busl-1.1 1 identifier license identifier busl 1 1
zlib 1 identifier license identifier zlib
unlicense 1 identifier license identifier unlicense
wtfpl 1 identifier license identifier wtfpl
cc0-1.0 1 identifier license identifier cc0 1 0
cc-by-3.0 1 identifier license identifier cc by 3 0
cc-by-4.0 1 identifier license identifier cc by 4 0
cc-by-sa-3.0 1 identifier license identifier cc by sa 3 0
cc-by-sa-4.0 1 identifier license identifier cc by sa 4 0
cc-by-nc-4.0 1 identifier license identifier cc by nc 4 0
cc-by-nd-4.0 1 identifier license identifier cc by nd 4 0
cc-by-nc-sa-4.0 1 identifier license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 1 identifier license identifier cc by nc nd 4 0
artistic-2.0 1 identifier license identifier artistic 2 0
python-2.0 1 identifier license identifier (?:python|psf) 2 0
postgresql 1 identifier license identifier postgresql
ofl-1.1 1 identifier license identifier ofl 1 1
ncsa 1 identifier license identifier ncsa
openssl 1 identifier license identifier openssl
vim 1 identifier license identifier vim
ms-pl 1 identifier license identifier ms pl
odbl-1.0 1 identifier license identifier odbl 1 0
spdx-other 4 identifier spdx license identifier [^ ]+
apache-2.0 1 compliance you may not use this file except in compliance with the license
apache-2.0 1 asis distributed on an asis basis without warranties or conditions
apache-2.0 1 conditions as is basis without warranties or conditions of any kind
apache-2.0 1 contributor each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
mit 1 sublicense to use copy modify merge publish distribute sublicense and or sell copies of the software
mit 1 hereby permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 1 noninfringement fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable
isc 1 hereby permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 1 disclaims the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
bsd 1 redistribution redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd 1 redistributions redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 1 redistributions redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause 1 endorse neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products derived
bsd-4-clause 1 acknowledgement all advertising materials mentioning features or use of this software must display the following acknowledgement
gpl 1 redistribute you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0+ 1 option either version 2 of the license or at your option any later version
gpl-3.0+ 1 option either version 3 of the license or at your option any later version
lgpl-2.1+ 1 option either version 2 1 of the license or at your option any later version
lgpl 1 redistribute you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl 1 redistribute you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl 1 hope distributed in the hope that it will be useful but without any warranty
gpl 1 merchantability without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
lgpl 1 merchantability without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license
gpl 1 received you should have received a copy of the gnu general public license along with
lgpl 1 received you should have received a copy of the gnu (?:lesser|library) general public license along with
agpl 1 received you should have received a copy of the gnu affero general public license along with
mpl-2.0 1 mozilla this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-1.1 1 mozilla the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 1 eclipse made available under the terms of the eclipse public license v1 0
epl-2.0 1 eclipse made available under the terms of the eclipse public license 2 0
cddl-1.0 1 development subject to the terms of the common development and distribution license
zlib 1 misrepresented the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib 1 altered altered source versions must be plainly marked as such and must not be misrepresented
bsl-1.0 1 derivative must be included in all copies of the software in whole or in part and all derivative works of the software
unlicense 1 unencumbered this is free and unencumbered software released into the public domain
wtfpl 1 fuck you just do what the fuck you want to
cc0-1.0 1 waived (?:has|have) waived all copyright and related or neighboring rights
cc0-1.0 1 dedicated (?:has|have) dedicated (?:the|this) work to the public domain
ofl-1.1 1 font this font software is licensed under the sil open font license version 1 1
ncsa 1 deal with the software without restriction to deal with the software
openssl 1 openssl this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 1 php this source file is subject to version 3 0?1 of the php license
postgresql 1 postgresql portions copyright (?:c )?(?:[0-9]+ ){1,2}(?:the )?postgresql global development group
boost 1 boost distributed under the boost software license version 1 0
cc-by 1 adapt you are free to share and adapt
cc-by-nc 1 noncommercial you may not use the material for commercial purposes noncommercial
cc-by-nc 1 commercial you may not use the (?:material|work) for commercial purposes
cc-by-nd 1 remix if you remix transform or build upon the material you may not distribute the modified material
cc-by-sa 1 remix if you remix transform or build upon the material you must distribute your contributions under the same license
apache-2.0 2 apache apache (?:software )?licen[sc]e(?: version| v)? ?2(?: 0)?
apache-2.0 2 apache apache licen[sc]e v2(?: 0)?
apache-2.0 2 apache apache v?2 0(?: licen[sc]e)?
apache-1.1 2 apache apache (?:software )?licen[sc]e(?: version| v)? 1 1
apache-1.0 2 apache apache (?:software )?licen[sc]e(?: version| v)? 1 0
apache-2.0 2 apache apache org licenses license 2 0
apache-2.0 2 asl asl 2 0
apache 3 apache apache (?:software )?licen[sc]e[ds]?
apache 3 apache licensed to the apache software foundation
gpl-1.0 2 gpl (?:gnu )?gpl(?: version| v)? 1(?: 0)?
gpl-2.0 2 gpl (?:gnu )?gpl(?: version| v)? 2(?: 0)?(?: only)?
gpl-2.0+ 2 gpl (?:gnu )?gpl(?: version| v)? 2(?: 0)? or (?:any )?(?:later|newer|above)
gpl-3.0 2 gpl (?:gnu )?gpl(?: version| v)? 3(?: 0)?(?: only)?
gpl-3.0+ 2 gpl (?:gnu )?gpl(?: version| v)? 3(?: 0)? or (?:any )?(?:later|newer|above)
gpl-2.0 2 gplv2 (?:gnu )?gplv2(?: 0)?
gpl-2.0+ 2 gplv2 (?:gnu )?gplv2(?: 0)? or (?:any )?(?:later|newer)
gpl-3.0 2 gplv3 (?:gnu )?gplv3(?: 0)?
gpl-3.0+ 2 gplv3 (?:gnu )?gplv3(?: 0)? or (?:any )?(?:later|newer)
gpl-2.0 2 gpl2 gpl2
gpl-3.0 2 gpl3 gpl3
gpl-1.0 2 general (?:gnu )?general public licen[sc]e(?: version| v)? 1(?: 0)?
gpl-2.0 2 general (?:gnu )?general public licen[sc]e(?: version| v)? 2(?: 0)?(?: only)?
gpl-2.0+ 2 general (?:gnu )?general public licen[sc]e(?: version| v)? 2(?: 0)? or (?:any )?(?:later|newer)
gpl-3.0 2 general (?:gnu )?general public licen[sc]e(?: version| v)? 3(?: 0)?(?: only)?
gpl-3.0+ 2 general (?:gnu )?general public licen[sc]e(?: version| v)? 3(?: 0)? or (?:any )?(?:later|newer)
gpl-2.0 2 general (?:gnu )?general public licen[sc]e v2(?: 0)?
gpl-3.0 2 general (?:gnu )?general public licen[sc]e v3(?: 0)?
gpl-2.0 2 general version 2 (?:0 )?of the (?:gnu )?general public licen[sc]e
gpl-3.0 2 general version 3 (?:0 )?of the (?:gnu )?general public licen[sc]e
gpl 3 general gnu general public licen[sc]e
gpl 3 gpl (?:gnu )?gpl
gpl-classpath 2 classpath (?:gpl|general public license) (?:[^ ]+ ){0,5}with (?:the )?classpath exception
gpl-classpath 2 classpath classpath exception
gcc-exception 2 gcc gcc runtime library exception(?: version)?(?: 3 1)?
lgpl-2.0 2 lgpl (?:gnu )?lgpl(?: version| v)? 2(?: 0)?
lgpl-2.1 2 lgpl (?:gnu )?lgpl(?: version| v)? 2 1(?: only)?
lgpl-2.1+ 2 lgpl (?:gnu )?lgpl(?: version| v)? 2 1 or (?:any )?(?:later|newer)
lgpl-3.0 2 lgpl (?:gnu )?lgpl(?: version| v)? 3(?: 0)?(?: only)?
lgpl-3.0+ 2 lgpl (?:gnu )?lgpl(?: version| v)? 3(?: 0)? or (?:any )?(?:later|newer)
lgpl-2.1 2 lgplv2 lgplv2 1
lgpl-2.0 2 lgplv2 lgplv2
lgpl-3.0 2 lgplv3 lgplv3(?: 0)?
lgpl-2.1 2 lesser (?:gnu )?lesser general public licen[sc]e(?: version| v)? 2 1
lgpl-2.1+ 2 lesser (?:gnu )?lesser general public licen[sc]e(?: version| v)? 2 1 or (?:any )?(?:later|newer)
lgpl-3.0 2 lesser (?:gnu )?lesser general public licen[sc]e(?: version| v)? 3(?: 0)?
lgpl-3.0+ 2 lesser (?:gnu )?lesser general public licen[sc]e(?: version| v)? 3(?: 0)? or (?:any )?(?:later|newer)
lgpl-2.0 2 library (?:gnu )?library general public licen[sc]e(?: version| v)? 2(?: 0)?
lgpl 3 lesser (?:gnu )?lesser general public licen[sc]e
lgpl 3 library (?:gnu )?library general public licen[sc]e
lgpl 3 lgpl (?:gnu )?lgpl
agpl-3.0 2 agpl (?:gnu )?agpl(?: version| v)? 3(?: 0)?
agpl-3.0 2 agplv3 (?:gnu )?agplv3(?: 0)?
agpl-3.0 2 affero (?:gnu )?affero general public licen[sc]e(?: version| v)? 3(?: 0)?
agpl-3.0+ 2 affero (?:gnu )?affero general public licen[sc]e(?: version| v)? 3(?: 0)? or (?:any )?(?:later|newer)
agpl-1.0 2 affero affero general public licen[sc]e(?: version| v)? 1(?: 0)?
agpl 3 affero (?:gnu )?affero general public licen[sc]e
agpl 3 agpl (?:gnu )?agpl
gfdl-1.1 2 documentation (?:gnu )?free documentation licen[sc]e(?: version| v)? 1 1
gfdl-1.2 2 documentation (?:gnu )?free documentation licen[sc]e(?: version| v)? 1 2
gfdl-1.3 2 documentation (?:gnu )?free documentation licen[sc]e(?: version| v)? 1 3
gfdl 3 documentation (?:gnu )?free documentation licen[sc]e
gfdl-1.3 2 gfdl (?:gnu )?gfdl(?: version| v)? 1 3
gfdl-1.2 2 gfdl (?:gnu )?gfdl(?: version| v)? 1 2
gfdl 3 gfdl (?:gnu )?gfdl
sspl-1.0 2 sspl sspl(?: version| v)?(?: 1)?(?: 0)?
sspl-1.0 2 server server side public licen[sc]e(?: version| v)?(?: 1)?(?: 0)?
mit 3 mit (?:the )?mit licen[sc]e[ds]?
mit 3 mit mit x11 licen[sc]e
mit 3 mit licensed under (?:the )?(?:terms of the )?mit
mit 3 mit licen[sc]e mit
mit 3 expat expat licen[sc]e
x11 3 x11 x11 (?:style )?licen[sc]e
mit 2 opensource opensource org licenses mit(?: license)?
apache-2.0 2 opensource opensource org licenses apache 2 0
bsd-3-clause 2 opensource opensource org licenses bsd 3 clause
bsd-2-clause 2 opensource opensource org licenses bsd 2 clause
gpl-3.0 2 opensource opensource org licenses gpl 3 0
isc 2 opensource opensource org licenses isc
osi-other 4 opensource opensource org licenses [^ ]+
bsd-2-clause 2 bsd (?:simplified bsd licen[sc]e|bsd simplified)
bsd-2-clause 2 bsd bsd 2 clause(?: licen[sc]e)?
bsd-2-clause 2 bsd (?:2|two) clause bsd(?: licen[sc]e)?
bsd-3-clause 2 bsd bsd 3 clause(?: clear)?(?: licen[sc]e)?
bsd-3-clause 2 bsd (?:3|three) clause bsd(?: licen[sc]e)?
bsd-3-clause 2 bsd (?:new|revised|modified) bsd licen[sc]e
bsd-4-clause 2 bsd bsd 4 clause(?: licen[sc]e)?
bsd-4-clause 2 bsd (?:4|four) clause bsd(?: licen[sc]e)?
bsd-4-clause 2 bsd (?:original|old) bsd licen[sc]e
bsd-2-clause 2 freebsd freebsd (?:documentation )?licen[sc]e
0bsd 2 0bsd 0bsd(?: licen[sc]e)?
0bsd 2 zero zero clause bsd(?: licen[sc]e)?
bsd 3 bsd (?:the )?bsd (?:style |type |like )?licen[sc]e[ds]?
bsd 3 bsd licen[sc]e bsd
isc 3 isc (?:the )?isc licen[sc]e[ds]?
mpl-1.0 2 mozilla mozilla public licen[sc]e(?: version| v)? 1 0
mpl-1.1 2 mozilla mozilla public licen[sc]e(?: version| v)? 1 1
mpl-2.0 2 mozilla mozilla public licen[sc]e(?: version| v)? 2(?: 0)?
mpl-2.0 2 mpl mpl(?: version| v)? 2(?: 0)?
mpl-1.1 2 mpl mpl(?: version| v)? 1 1
mpl 3 mozilla mozilla public licen[sc]e
mpl-2.0 2 mozilla mozilla org mpl 2 0
mpl-2.0 2 mplv2 mplv2(?: 0)?
epl-1.0 2 eclipse eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?
epl-1.0 2 eclipse eclipse public licen[sc]e v1 0
epl-2.0 2 eclipse eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?
epl-2.0 2 eclipse eclipse public licen[sc]e v2 0
edl-1.0 2 eclipse eclipse distribution licen[sc]e(?: version| v)?(?: 1)?(?: 0)?
epl 3 eclipse eclipse public licen[sc]e
epl-2.0 2 epl epl(?: version| v)? 2(?: 0)?
epl-1.0 2 epl epl(?: version| v)? 1(?: 0)?
cpl-1.0 2 common common public licen[sc]e(?: version| v)?(?: 1)?(?: 0)?
cpal-1.0 2 attribution common public attribution licen[sc]e(?: version| v)?(?: 1)?(?: 0)?
cddl-1.0 2 cddl cddl(?: version| v)? 1 0
cddl-1.1 2 cddl cddl(?: version| v)? 1 1
cddl 3 cddl cddl(?: licen[sc]e)?
cddl-1.0 2 development common development and distribution licen[sc]e(?: version| v)? 1 0
cddl-1.1 2 development common development and distribution licen[sc]e(?: version| v)? 1 1
cddl 3 development common development and distribution licen[sc]e
ipl-1.0 2 ibm ibm public licen[sc]e(?: version| v)?(?: 1)?(?: 0)?
eupl-1.1 2 eupl eupl(?: version| v)? 1 1
eupl-1.2 2 eupl eupl(?: version| v)? 1 2
eupl 3 eupl eupl
eupl 3 european european union public licen[sc]e
eupl-1.2 2 european european union public licen[sc]e(?: version| v)? 1 2
eupl-1.1 2 european european union public licen[sc]e(?: version| v)? 1 1
cecill-2.1 2 cecill cecill(?: licen[sc]e)?(?: version| v)? 2 1
cecill-b 2 cecill cecill b(?: licen[sc]e)?
cecill-c 2 cecill cecill c(?: licen[sc]e)?
cecill 3 cecill cecill(?: licen[sc]e)?
osl-3.0 2 open open software licen[sc]e(?: version| v)? 3(?: 0)?
osl 3 open open software licen[sc]e
afl-3.0 2 academic academic free licen[sc]e(?: version| v)? 3(?: 0)?
afl-2.1 2 academic academic free licen[sc]e(?: version| v)? 2 1
afl 3 academic academic free licen[sc]e
ecl-2.0 2 educational educational community licen[sc]e(?: version| v)? 2(?: 0)?
ecl 3 educational educational community licen[sc]e
bsl-1.0 2 boost boost software licen[sc]e(?: version| v)?(?: 1)?(?: 0)?
zlib 3 zlib (?:the )?zlib(?: libpng)? licen[sc]e
libpng 3 libpng (?:the )?libpng licen[sc]e
unlicense 3 unlicense (?:the )?unlicense
unlicense 2 unlicense unlicense org
wtfpl 3 wtfpl wtfpl(?: version| v)?(?: 2)?
wtfpl 2 fuck do what the fuck you want to public licen[sc]e
artistic-1.0 2 artistic artistic licen[sc]e(?: version| v)? 1(?: 0)?
artistic-2.0 2 artistic artistic licen[sc]e(?: version| v)? 2(?: 0)?
artistic 3 artistic (?:perl )?artistic licen[sc]e
perl 3 perl (?:under )?the same terms as perl(?: itself)?
psf-2.0 2 python python software foundation licen[sc]e(?: version| v)? 2(?: 0)?
psf 3 python python software foundation licen[sc]e
psf 3 psf psf licen[sc]e(?: agreement)?
python 3 python python licen[sc]e
php-3.01 2 php php licen[sc]e(?: version| v)? 3 0?1
php-3.0 2 php php licen[sc]e(?: version| v)? 3 0
php 3 php php licen[sc]e
ruby 3 ruby ruby (?:s )?licen[sc]e
vim 3 vim vim licen[sc]e
tcl 3 tcl tcl tk licen[sc]e
w3c 3 w3c w3c software (?:notice and )?(?:document )?licen[sc]e
postgresql 3 postgresql (?:the )?postgresql licen[sc]e
openssl 3 openssl openssl (?:and ssleay )?licen[sc]e
ssleay 3 ssleay (?:original )?ssleay licen[sc]e
curl 3 curl curl licen[sc]e
ncsa 3 ncsa (?:university of illinois )?ncsa (?:open source )?licen[sc]e
unicode 3 unicode unicode (?:data files and software )?licen[sc]e(?: agreement)?
icu 3 icu icu licen[sc]e
ofl-1.1 2 ofl (?:sil )?ofl(?: version| v)? 1 1
ofl-1.1 2 font (?:sil )?open font licen[sc]e(?: version| v)? 1 1
ofl 3 font (?:sil )?open font licen[sc]e
ms-pl 2 microsoft microsoft public licen[sc]e(?: ms pl)?
ms-rl 2 microsoft microsoft reciprocal licen[sc]e(?: ms rl)?
ms-eula 4 microsoft microsoft software license terms
apsl-2.0 2 apple apple public source licen[sc]e(?: version| v)?(?: 2)?(?: 0)?
intel 3 intel intel (?:open source|simplified software) licen[sc]e
nvidia 3 nvidia nvidia (?:software|source code) licen[sc]e(?: agreement)?
beerware 3 beerware (?:the )?beerware licen[sc]e(?: revision 42)?
beerware 3 beer (?:the )?beer ware licen[sc]e
json 3 evil the software shall be used for good not evil
jquery 3 jquery jquery licen[sc]e
mulan-2.0 2 mulan mulan (?:psl|permissive software licen[sc]e)(?: version| v)? 2
mulan 3 mulan mulan (?:psl|permissive software licen[sc]e)
upl-1.0 2 universal universal permissive licen[sc]e(?: version| v)?(?: 1)?(?: 0)?
busl-1.1 2 business business source licen[sc]e(?: version| v)?(?: 1)?(?: 1)?
elastic-2.0 2 elastic elastic licen[sc]e(?: version| v)? 2(?: 0)?
elastic 3 elastic elastic licen[sc]e
commons-clause 2 clause commons clause(?: licen[sc]e condition)?(?: version| v)?(?: 1)?(?: 0)?
polyform-nc 2 polyform polyform noncommercial licen[sc]e(?: version| v)?(?: 1)?(?: 0)?(?: 0)?
polyform 3 polyform polyform (?:shield|small business|strict|free trial|perimeter) licen[sc]e
openrail 3 openrail (?:creativeml |bigscience )?(?:bigcode )?openrail(?: m)?(?: licen[sc]e)?
llama 3 llama llama (?:[0-9]+ )?community licen[sc]e(?: agreement)?
cc0-1.0 2 cc0 cc0(?: 1 0)?(?: universal)?
cc0-1.0 2 zero creative commons zero(?: v?1 0)?(?: universal)?
cc-by-1.0 2 cc cc by 1 0
cc-by-2.0 2 cc cc by 2 0
cc-by-2.5 2 cc cc by 2 5
cc-by-3.0 2 cc cc by 3 0
cc-by-4.0 2 cc cc by 4 0
cc-by-sa-2.0 2 cc cc by sa 2 0
cc-by-sa-2.5 2 cc cc by sa 2 5
cc-by-sa-3.0 2 cc cc by sa 3 0
cc-by-sa-4.0 2 cc cc by sa 4 0
cc-by-nc-2.0 2 cc cc by nc 2 0
cc-by-nc-2.5 2 cc cc by nc 2 5
cc-by-nc-3.0 2 cc cc by nc 3 0
cc-by-nc-4.0 2 cc cc by nc 4 0
cc-by-nd-2.0 2 cc cc by nd 2 0
cc-by-nd-3.0 2 cc cc by nd 3 0
cc-by-nd-4.0 2 cc cc by nd 4 0
cc-by-nc-sa-2.0 2 cc cc by nc sa 2 0
cc-by-nc-sa-3.0 2 cc cc by nc sa 3 0
cc-by-nc-sa-4.0 2 cc cc by nc sa 4 0
cc-by-nc-nd-2.0 2 cc cc by nc nd 2 0
cc-by-nc-nd-3.0 2 cc cc by nc nd 3 0
cc-by-nc-nd-4.0 2 cc cc by nc nd 4 0
cc-by-nc-nd 3 cc cc by nc nd
cc-by-nc-sa 3 cc cc by nc sa
cc-by-sa 3 cc cc by sa
cc-by-nc 3 cc cc by nc
cc-by-nd 3 cc cc by nd
cc-by-4.0 2 creativecommons creativecommons org licenses by 4 0
cc-by-3.0 2 creativecommons creativecommons org licenses by 3 0
cc-by-sa-4.0 2 creativecommons creativecommons org licenses by sa 4 0
cc-by-sa-3.0 2 creativecommons creativecommons org licenses by sa 3 0
cc-by-nc-4.0 2 creativecommons creativecommons org licenses by nc 4 0
cc-by-nd-4.0 2 creativecommons creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 2 creativecommons creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 2 creativecommons creativecommons org licenses by nc nd 4 0
cc0-1.0 2 creativecommons creativecommons org publicdomain zero 1 0
cc-pdm-1.0 2 creativecommons creativecommons org publicdomain mark 1 0
cc-other 4 creativecommons creativecommons org (?:licenses|publicdomain) [^ ]+
cc-by 2 commons creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-sa 2 commons creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nc 2 commons creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nd 2 commons creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nc-sa 2 commons creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nc-nd 2 commons creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-other 4 commons creative commons(?: licen[sc]e)?
odbl-1.0 2 database open (?:data commons open )?database licen[sc]e(?: version| v)?(?: 1)?(?: 0)?
odbl-1.0 2 odbl odbl(?: version| v)?(?: 1)?(?: 0)?
odc-by-1.0 2 commons open data commons attribution licen[sc]e(?: version| v)?(?: 1)?(?: 0)?
pddl-1.0 2 dedication public domain dedication and licen[sc]e(?: version| v)?(?: 1)?(?: 0)?
cdla-permissive 2 cdla cdla permissive(?: [12] 0)?
cdla-sharing 2 cdla cdla sharing(?: 1 0)?
ogl-uk-3.0 2 government open government licen[sc]e(?: version| v)? ?3(?: 0)?
ogl-uk 3 government open government licen[sc]e
public-domain 3 domain (?:is |are )?(?:in|into|to) the public domain
public-domain 3 domain public domain (?:work|software|dedication|mark)
us-government 3 government work of the (?:united states|us|u s) government
proprietary 3 proprietary proprietary and confidential
proprietary 3 confidential confidential and proprietary
proprietary 3 unauthorized unauthorized (?:copying|use|reproduction|distribution) (?:[^ ]+ ){0,8}is (?:strictly )?prohibited
proprietary 3 eula (?:end user )?eula
proprietary 3 user end user licen[sc]e agreement
proprietary 4 permission no part of this (?:publication|work|book|document) may be reproduced (?:[^ ]+ ){0,16}without (?:the )?(?:prior )?(?:written )?permission
proprietary 4 permission without (?:the )?(?:express |prior )?written permission
noncommercial 4 noncommercial (?:for )?noncommercial (?:use|purposes)(?: only)?
noncommercial 4 commercial (?:for )?non commercial (?:use|purposes)(?: only)?
research-only 4 research for (?:academic|research) (?:and )?(?:research )?(?:use|purposes) only
dual-license 4 dual dual licen[sc]ed?
copyright 4 copyright copyright (?:c )?(?:[12][0-9]{3} ){1,2}(?:by )?[^ ]+
copyright 4 copyright copyright (?:c|by) [^ ]+
copyright 4 copyrighted copyrighted (?:material|work)
rights-reserved 4 reserved (?:all|some|no) rights (?:are )?reserved
rights-reserved 4 vorbehalten alle rechte vorbehalten
rights-reserved 4 réservés tous droits réservés
rights-reserved 4 reservados todos los derechos reservados
license-reference 4 licensed (?:is |are |be )?licensed under (?:the )?(?:terms of (?:the )?)?[^ ]+(?: licen[sc]e)?
license-reference 4 licence licence agreement
license-reference 4 license license (?:agreement|terms|file|text)
license-reference 4 license see (?:the )?license(?: file)? for (?:more )?(?:details|information)
license-reference 4 released released under (?:the )?(?:terms of (?:the )?)?[^ ]+(?: licen[sc]e)?
license-reference 4 distributed distributed under (?:the )?(?:terms of (?:the )?)?[^ ]+(?: licen[sc]e)?
"""


@dataclass(frozen=True)
class Rule:
    label: str
    level: int
    keyword: str
    pattern: str
    base: bool = False


def read(lines: str) -> list[Rule]:
    """Rules of lines as in ``SIGNATURES``."""
    return [Rule(label, int(level), keyword, pattern) for label, level, keyword, pattern in (x.split(" ", 3) for x in lines.strip().splitlines())]


#: Phrases that are always reported, with the rarest word of each as its keyword.
PHRASES = [Rule("cc-by", 3, "cc", "cc by", True), Rule("gpl", 3, "license", "general public license", True), Rule("reserved", 4, "reserved", "all rights reserved", True)]

RULES = PHRASES + read(SIGNATURES)


def anchored(rule: Rule) -> str:
    """The pattern with its keyword marked, for whole words of a window whose keyword is marked."""
    return "(?<= )(?:" + re.sub(rf"(?<![a-z0-9é]){rule.keyword}(?![a-z0-9é])", "=" + rule.keyword, rule.pattern, count=1) + ")(?= )"
