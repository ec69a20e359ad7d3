"""Signature rules of licences: regular expressions over lower-cased text, each with a literal keyword that gates it.

Two kinds. PASSAGES are written one by one, each for a sentence that a licence's text or notice has. NAMES are made from a licence's name, versions
and site: per version for its tag, its site, its short name after a grant and its full name; without a version, for the name alone. More
specific forms have the higher priority.
"""

from __future__ import annotations

from typing import NamedTuple

GAP = r"[\s,;:()\"'-]+"
TAG, SITE, TEXT, LONG, SHORT, NAME, HINT = 100, 90, 85, 80, 70, 50, 20
#: All priorities, highest first.
PRIORITIES = (TAG, SITE, TEXT, LONG, SHORT, NAME, HINT)


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int


class Licence(NamedTuple):
    stem: str
    keyword: str
    name: str
    versions: tuple[str, ...] = ()
    site: str = ""  # {v}: the version


# Names, keywords and sites, by family.
LICENCES = [
    Licence("gpl", "general public licen", r"(?:gnu )?general public licen[sc]e", ("1.0", "2.0", "3.0"), r"gnu\.org/licenses/(?:old-licenses/)?gpl-{v}"),
    Licence("lgpl", "general public licen", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", ("2.0", "2.1", "3.0"), r"gnu\.org/licenses/(?:old-licenses/)?lgpl-{v}"),
    Licence("agpl", "general public licen", r"(?:gnu )?affero general public licen[sc]e", ("1.0", "3.0"), r"gnu\.org/licenses/agpl-{v}"),
    Licence("gfdl", "documentation licen", r"(?:gnu )?free documentation licen[sc]e", ("1.1", "1.2", "1.3"), r"gnu\.org/licenses/(?:old-licenses/)?fdl-{v}"),
    Licence("apache", "apache", r"apache (?:software )?licen[sc]e", ("1.0", "1.1", "2.0"), r"apache\.org/licenses/license-{v}"),
    Licence("mit", "mit licen", r"\bmit licen[sc]e", (), r"opensource\.org/licenses?/mit\b"),
    Licence("x11", "x11 licen", r"\bx11 licen[sc]e"),
    Licence("expat", "expat licen", r"\bexpat licen[sc]e"),
    Licence("isc", "isc licen", r"\bisc licen[sc]e", (), r"opensource\.org/licenses?/isc\b"),
    Licence("bsd-2-clause", "bsd", r"(?:2|two)-clause (?:\"?simplified\"? )?bsd licen[sc]e|simplified bsd licen[sc]e|freebsd licen[sc]e", (), r"opensource\.org/licenses?/bsd-2-clause"),
    Licence("bsd-3-clause", "bsd", r"(?:3|three)-clause bsd licen[sc]e|(?:new|modified|revised) bsd licen[sc]e", (), r"opensource\.org/licenses?/bsd-3-clause"),
    Licence("bsd-4-clause", "bsd", r"(?:4|four)-clause bsd licen[sc]e|original bsd licen[sc]e"),
    Licence("0bsd", "bsd", r"zero-clause bsd licen[sc]e|\b0bsd\b", (), r"opensource\.org/licenses?/0bsd"),
    Licence("bsd", "bsd", r"\bbsd(?:-style)? licen[sc]e"),
    Licence("mpl", "mozilla public", r"mozilla public licen[sc]e", ("1.0", "1.1", "2.0"), r"mozilla\.org/(?:en-us/)?mpl/{v}"),
    Licence("epl", "eclipse public", r"eclipse public licen[sc]e", ("1.0", "2.0"), r"eclipse\.org/legal/epl-(?:v10|{v})"),
    Licence("edl", "eclipse distribution", r"eclipse distribution licen[sc]e", ("1.0",), r"eclipse\.org/org/documents/edl-v10"),
    Licence("cpl", "common public", r"common public licen[sc]e", ("1.0",)),
    Licence("ipl", "ibm public", r"ibm public licen[sc]e", ("1.0",)),
    Licence("cddl", "common development", r"common development and distribution licen[sc]e", ("1.0", "1.1")),
    Licence("eupl", "european union public", r"european union public licen[sc]e", ("1.0", "1.1", "1.2")),
    Licence("osl", "open software licen", r"open software licen[sc]e", ("1.0", "2.0", "2.1", "3.0")),
    Licence("afl", "academic free", r"academic free licen[sc]e", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    Licence("artistic", "artistic licen", r"artistic licen[sc]e", ("1.0", "2.0"), r"opensource\.org/licenses?/artistic-license-{v}"),
    Licence("bsl", "boost software", r"boost software licen[sc]e", ("1.0",), r"boost\.org/license_1_0"),
    Licence("busl", "business source", r"business source licen[sc]e", ("1.1",)),
    Licence("cecill", "cecill", r"\bcecill(?:-[bc])?(?: free software)? licen[sc]e", ("1.0", "2.0", "2.1")),
    Licence("lppl", "latex project public", r"latex project public licen[sc]e", ("1.0", "1.1", "1.2", "1.3c")),
    Licence("ofl", "open font licen", r"(?:sil )?open font licen[sc]e", ("1.0", "1.1"), r"scripts\.sil\.org/ofl"),
    Licence("ms-pl", "microsoft public", r"microsoft public licen[sc]e"),
    Licence("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e"),
    Licence("ncsa", "ncsa", r"(?:university of illinois[/ ])?ncsa open source licen[sc]e"),
    Licence("postgresql", "postgresql licen", r"postgresql licen[sc]e"),
    Licence("psf", "python software foundation", r"python software foundation licen[sc]e", ("2.0",)),
    Licence("python", "python licen", r"\bpython licen[sc]e", ("2.0",)),
    Licence("php", "php licen", r"\bphp licen[sc]e", ("3.0", "3.01")),
    Licence("ruby", "ruby licen", r"\bruby licen[sc]e"),
    Licence("zlib", "zlib licen", r"\bzlib licen[sc]e", (), r"opensource\.org/licenses?/zlib"),
    Licence("libpng", "libpng licen", r"\blibpng licen[sc]e", ("2.0",)),
    Licence("openssl", "openssl licen", r"\bopenssl licen[sc]e"),
    Licence("curl", "curl licen", r"\bcurl licen[sc]e"),
    Licence("unlicense", "unlicense", r"\bthe unlicense\b", (), r"unlicense\.org"),
    Licence("wtfpl", "do what the", r"do what the f\w+ you want to public licen[sc]e", ("1.0", "2.0")),
    Licence("zpl", "zope public", r"zope public licen[sc]e", ("1.1", "2.0", "2.1")),
    Licence("w3c", "w3c software", r"w3c software (?:notice and )?licen[sc]e"),
    Licence("vim", "vim licen", r"\bvim licen[sc]e"),
    Licence("sleepycat", "sleepycat licen", r"sleepycat licen[sc]e"),
    Licence("qpl", "q public", r"\bq public licen[sc]e", ("1.0",)),
    Licence("npl", "netscape public", r"netscape public licen[sc]e", ("1.0", "1.1")),
    Licence("spl", "sun public", r"sun public licen[sc]e", ("1.0",)),
    Licence("apsl", "apple public source", r"apple public source licen[sc]e", ("1.0", "1.1", "1.2", "2.0")),
    Licence("upl", "universal permissive", r"universal permissive licen[sc]e", ("1.0",)),
    Licence("sspl", "server side public", r"server side public licen[sc]e", ("1.0",)),
    Licence("elastic", "elastic licen", r"elastic licen[sc]e", ("2.0",)),
    Licence("mulanpsl", "mulan", r"mulan permissive software licen[sc]e", ("1.0", "2.0")),
    Licence("ecl", "educational community", r"educational community licen[sc]e", ("1.0", "2.0")),
    Licence("rpl", "reciprocal public", r"reciprocal public licen[sc]e", ("1.1", "1.5")),
    Licence("odbl", "open database", r"open (?:data commons )?(?:open )?database licen[sc]e", ("1.0",), r"opendatacommons\.org/licenses/odbl"),
    Licence("odc-by", "open data commons", r"open data commons attribution licen[sc]e", ("1.0",), r"opendatacommons\.org/licenses/by"),
    Licence("pddl", "public domain dedication", r"public domain dedication and licen[sc]e", ("1.0",), r"opendatacommons\.org/licenses/pddl"),
    Licence("cdla-permissive", "community data", r"community data licen[sc]e agreement\W+permissive", ("1.0", "2.0")),
    Licence("cdla-sharing", "community data", r"community data licen[sc]e agreement\W+sharing", ("1.0",)),
    Licence("openrail", "openrail", r"\bopenrail(?:-?[+m]+)?(?: licen[sc]e)?"),
    Licence("llama", "llama", r"\bllama(?: [23](?:\.\d)?)? community licen[sc]e"),
    Licence("ogl-uk", "open government", r"open government licen[sc]e", ("1.0", "2.0", "3.0")),
]
# Creative Commons: the terms as they are written short and long.
COMMONS = [
    ("cc-by-nc-nd", r"by[- ]nc[- ]nd", r"attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?"),
    ("cc-by-nc-sa", r"by[- ]nc[- ]sa", r"attribution[- ]non-?commercial[- ]share-?alike"),
    ("cc-by-nc", r"by[- ]nc", r"attribution[- ]non-?commercial"),
    ("cc-by-nd", r"by[- ]nd", r"attribution[- ]no-?deriv(?:ative)?s?"),
    ("cc-by-sa", r"by[- ]sa", r"attribution[- ]share-?alike"),
    ("cc-by", r"by", r"attribution"),
]
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Rules that stand alone.
OTHERS = [
    Rule("cc0", "cc0", r"\bcc0(?:[- ]1\.0)?\b", SHORT),
    Rule("cc0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero", SITE),
    Rule("public-domain", "public domain", r"(?:dedicated to|placed in(?:to)?|released into|in) the public domain", NAME),
    Rule("proprietary", "all rights reserved", r"\ball rights reserved\b", HINT),
    Rule("gpl", "gnu gpl", r"\bgnu gpl\b", NAME),
    Rule("lgpl", "gnu lgpl", r"\bgnu lgpl\b", NAME),
    Rule("agpl", "gnu agpl", r"\bgnu agpl\b", NAME),
    Rule("some-license", "licen", r"\blicen[sc]ed under\b", HINT),
]
# Sentences of licences: label, keyword, pattern. White space between words is any.
PASSAGES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", "the software without restriction", r"to deal in the software without restriction, including without limitation the rights"),
    ("mit", "substantial portions of the software", r"shall be included in all copies or substantial portions of the software"),
    ("mit-0", "mit no attribution", r"mit no attribution"),
    ("mit-modern", "use, copy, modify, and distribute this software", r"permission is hereby granted, without written agreement and without license or royalty fees, to use, copy, modify, and distribute"),
    ("x11", "x consortium", r"except as contained in this notice, the name of the x consortium shall not be used"),
    ("x11-distribute", "modifications or use with modifications", r"to deal in the software without restriction .{1,120}? distribute with modifications"),
    ("isc", "permission to use, copy", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the software is provided \"as is\" and the author", r"the software is provided \"as is\" and the author disclaims all warranties"),
    ("0bsd", "permission to use, copy", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software"),
    ("hpnd", "permission to use, copy", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose and without fee"),
    ("ntp", "permission to use, copy", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose with(?: or without)? fee"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name", r"neither the names? of .{1,80}? nor the names? of (?:its|their) contributors may be used to endorse"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party", r"no express or implied licenses to any party's patent rights are granted"),
    ("bsd-3-clause-no-nuclear", "nuclear facility", r"not designed, licensed or intended for use in the design, construction, operation or maintenance of any nuclear facility"),
    ("bsd-2-clause-patent", "patent license to make", r"hereby grants to each recipient .{1,80}? patent license to make, have made, use"),
    ("bsd-source-code", "redistributions of source code", r"redistributions of source code must retain the copyright notice, this list of conditions and no others"),
    ("bsd-attribution", "acknowledgment", r"redistributions of any form whatsoever must retain the following acknowledgment"),
    ("apache-2.0", "you may not use this file except", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis"),
    ("apache-2.0", "contributor hereby grants to you", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("apache-2.0", "licensed under the apache license", r"licensed under the apache license, version 2\.0 \(the \"license\"\)"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache group", r"this product includes software developed by the apache group"),
    ("apache", "apache software foundation", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("gpl", "redistribute it and/or modify it", r"redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl-2.0-or-later", "either version 2", r"general public license as published by the free software foundation; either version 2 of the license, or \(at your option\) any later version"),
    ("gpl-3.0-or-later", "either version 3", r"general public license as published by the free software foundation, either version 3 of the license, or \(at your option\) any later version"),
    ("gpl-2.0-only", "version 2 of the license", r"under the terms of version 2 of the gnu general public license"),
    ("gpl-2.0-only", "version 2 as published", r"general public license version 2 as published by the free software foundation"),
    ("gpl-2.0", "freedom to share and change", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "free, copyleft license for software", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl", "copy of the gnu general public license", r"you should have received a copy of the gnu general public license along with"),
    ("gpl-classpath-exception", "classpath exception", r"classpath exception"),
    ("gpl-classpath-exception", "linking this library statically", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-autoconf-exception", "configure scripts", r"unlimited permission to copy, distribute and modify the configure scripts"),
    ("gpl-bison-exception", "bison parser skeleton", r"you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-font-exception", "embeds this font", r"if you create a document which uses this font, and embed this font"),
    ("gcc-exception", "runtime library exception", r"gcc runtime library exception"),
    ("linux-syscall-note", "user programs that use kernel services", r"does \*?not\*? cover user programs that use kernel services by normal system calls"),
    ("lgpl", "redistribute it and/or modify it", r"redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", "lesser general public license, version 2.1", r"gnu lesser general public license, version 2\.1"),
    ("lgpl-2.1-or-later", "either version 2.1", r"either version 2\.1 of the license, or \(at your option\) any later version"),
    ("lgpl-3.0", "terms and conditions of version 3", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("lgpl", "copy of the gnu lesser general public license", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("wxwindows", "wxwindows library", r"wxwindows library licen[sc]e"),
    ("agpl-3.0", "remote network interaction", r"remote network interaction; use with the gnu general public license"),
    ("agpl-3.0", "specifically designed to ensure cooperation", r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("agpl", "redistribute it and/or modify it", r"redistribute it and/or modify it under the terms of the gnu affero general public license"),
    ("gfdl", "copy, distribute and/or modify this document", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("gfdl-no-invariants", "no invariant sections", r"with no invariant sections, no front-cover texts,? and no back-cover texts"),
    ("fsf-unlimited", "gives unlimited permission", r"the free software foundation gives unlimited permission to copy and/or distribute it"),
    ("all-permissive", "copying and distribution of this file", r"copying and distribution of this file, with or without modification, are permitted in any medium without royalty"),
    ("mpl-1.1", "mozilla public license version 1.1", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-1.0", "mozilla public license version 1.0", r"the contents of this file are subject to the mozilla public license version 1\.0"),
    ("mpl-2.0", "this source code form is subject", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("mpl-2.0-no-copyleft", "incompatible with secondary licenses", r"this source code form is \"incompatible with secondary licenses\""),
    ("epl-1.0", "accompanying materials are made available", r"made available under the terms of the eclipse public license v1\.0"),
    ("epl-2.0", "accompanying materials are made available", r"made available under the terms of the eclipse public license (?:v\.? ?)?2\.0"),
    ("epl", "recipient's acceptance of this agreement", r"any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement"),
    ("cpl-1.0", "common public license", r"provided under the terms of this common public license"),
    ("cddl-1.0", "common development and distribution license", r"subject to the terms of the common development and distribution license \(the \"license\"\)"),
    ("cddl-1.0", "covered software", r"you may not use this file except in compliance with .{1,30}? cddl"),
    ("eupl-1.2", "european union public", r"licensed under the eupl,? (?:version|v\.?) ?1\.2"),
    ("eupl-1.1", "eupl", r"licensed under the eupl,? (?:version|v\.?) ?1\.1"),
    ("artistic-1.0", "artistic control", r"copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", "artistic control", r"copyright holder maintains some artistic control over the development of that package"),
    ("perl", "same terms as perl", r"under the same terms as perl itself"),
    ("ruby", "same terms as ruby", r"under the same terms as ruby"),
    ("zlib", "altered source versions must be plainly marked", r"altered source versions must be plainly marked as such"),
    ("zlib", "origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("libpng", "png reference library", r"the png reference library is supplied \"as is\""),
    ("bsl-1.0", "boost software license", r"distributed under the boost software license,? version 1\.0"),
    ("bsl-1.0", "machine-executable object code", r"solely in the form of machine-executable object code generated by a source language processor"),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy, modify", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", "what the fuck you want to", r"you just do what the fuck you want to"),
    ("cc0-1.0", "affirmer", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("cc0-1.0", "waived all copyright", r"waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "no copyright", r"no rights reserved .{0,40}?cc0"),
    ("cc-by", "attribution license", r"creative commons public licenses? .{1,60}? attribution licen[sc]e"),
    ("cc-legal-code", "exercising the licensed rights", r"by exercising the licensed rights \(defined below\), you accept and agree to be bound"),
    ("cc-legal-code", "this creative commons public license", r"terms of this creative commons public license"),
    ("cc-share-alike", "under the same license as the original", r"you must distribute your contributions under the same license as the original"),
    ("cc-non-commercial", "for commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-no-derivatives", "distribute the modified material", r"if you remix, transform, or build upon the material, you may not distribute the modified material"),
    ("cc-deed", "free to share", r"you are free to share .{1,60}? copy and redistribute the material in any medium"),
    ("cc-some-rights", "some rights reserved", r"some rights reserved"),
    ("ofl-1.1", "reserved font name", r"no modified version of the font software may use the reserved font name"),
    ("ofl-1.1", "sil open font license", r"this font software is licensed under the sil open font license,? version 1\.1"),
    ("bitstream-vera", "bitstream vera", r"bitstream vera is a trademark of bitstream"),
    ("ubuntu-font", "ubuntu font licen", r"ubuntu font licen[sc]e"),
    ("psf-2.0", "python software foundation license", r"python software foundation license version 2"),
    ("psf", "beopen python", r"beopen python open source license agreement"),
    ("python-cnri", "cnri", r"cnri license agreement"),
    ("php-3.01", "this product includes php", r"this product includes php software, freely available from"),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("curl", "shall not be used in advertising", r"the name of a copyright holder shall not be used in advertising or otherwise to promote the sale"),
    ("icu", "unicode, inc", r"permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files"),
    ("unicode", "unicode data files", r"copyright .{1,40}? unicode, inc\."),
    ("ncsa", "university of illinois", r"redistributions of source code must retain .{1,120}? university of illinois"),
    ("postgresql", "the university of california", r"in no event shall the university of california be liable to any party for direct, indirect, special"),
    ("tcl", "regents of the university of california, sun", r"copyrighted by the regents of the university of california, sun microsystems"),
    ("sleepycat", "accompany the db software", r"complete source code for the db software and any accompanying software that uses the db software"),
    ("afl-3.0", "academic free license", r"licensed under the academic free license version 3\.0"),
    ("osl-3.0", "open software license", r"licensed under the open software license version 3\.0"),
    ("qpl-1.0", "q public license", r"may be distributed under the terms of the q public license"),
    ("lppl-1.3c", "latex project public license", r"conditions of the latex project public license, either version 1\.3c?"),
    ("ms-pl", "if you use the software, you accept this license", r"this license governs use of the accompanying software\. if you use the software, you accept this license"),
    ("upl-1.0", "larger works", r"the \"larger works\"\), without restriction, including without limitation"),
    ("json", "used for good, not evil", r"the software shall be used for good, not evil"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("ftl", "freetype project", r"portions of this software are copyright .{1,40}? the freetype project"),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("info-zip", "info-zip", r"info-zip (?:copyright and )?licen[sc]e"),
    ("bzip2", "bzip2", r"bzip2(?:/libbzip2)? licen[sc]e"),
    ("blessing", "may you do good and not evil", r"may you do good and not evil"),
    ("odc-by-1.0", "open data commons", r"made available under the open data commons attribution license"),
    ("odbl-1.0", "open database license", r"made available under the open database license"),
    ("odbl-contents", "database contents license", r"database contents licen[sc]e"),
    ("pddl-1.0", "public domain dedication", r"open data commons public domain dedication and licen[sc]e"),
    ("cdla-permissive", "community data license", r"community data license agreement .{0,3}permissive"),
    ("ogl-uk", "open government licence", r"contains public sector information licensed under the open government licen[sc]e"),
    ("etalab", "licence ouverte", r"licence ouverte"),
    ("dl-de", "datenlizenz deutschland", r"datenlizenz deutschland"),
    ("crown-copyright", "crown copyright", r"crown copyright"),
    ("us-government-work", "work of the united states government", r"work of the united states government"),
    ("busl-1.1", "change license", r"on the change date, .{1,120}? change license"),
    ("busl-1.1", "additional use grant", r"additional use grant"),
    ("sspl-1.0", "service source code", r"make the service source code available via network download"),
    ("elastic-2.0", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause", r"commons clause.{0,20}? licen[sc]e condition"),
    ("confluent", "confluent community", r"confluent community licen[sc]e"),
    ("polyform-noncommercial", "polyform noncommercial", r"polyform noncommercial licen[sc]e"),
    ("polyform-small-business", "polyform small business", r"polyform small business licen[sc]e"),
    ("parity", "parity public", r"parity public licen[sc]e"),
    ("prosperity", "prosperity public", r"prosperity public licen[sc]e"),
    ("fair-source", "fair source", r"fair source licen[sc]e"),
    ("hippocratic", "hippocratic licen", r"hippocratic licen[sc]e"),
    ("anti-996", "anti 996", r"anti[- ]996 licen[sc]e"),
    ("responsible-ai", "use-based restrictions", r"use-based restrictions"),
    ("bigscience-rail", "bigscience", r"bigscience (?:bloom )?rail"),
    ("creativeml-openrail-m", "creativeml", r"creativeml open rail-?m"),
    ("llama", "llama materials", r"non-exclusive, worldwide, non-transferable and royalty-free limited license .{1,120}? llama materials"),
    ("gemma", "gemma terms of use", r"gemma terms of use"),
    ("evaluation", "evaluation purposes only", r"for evaluation purposes only"),
    ("evaluation", "trial licen", r"trial licen[sc]e"),
    ("eula", "end user licen", r"end[- ]user licen[sc]e agreement"),
    ("eula", "licensed, not sold", r"the software is licensed, not sold"),
    ("shareware", "shareware", r"this (?:program|software) is shareware"),
    ("freeware", "freeware", r"this (?:program|software) is freeware"),
    ("non-commercial", "non-commercial use only", r"(?:for )?non-commercial use only"),
    ("academic-only", "academic and research", r"for academic and research (?:use|purposes) only"),
    ("personal-only", "personal use only", r"for personal use only"),
    ("proprietary", "confidential and proprietary", r"confidential and proprietary"),
    ("proprietary", "unauthorized copying of this file", r"unauthorized copying of this file, via any medium,? is strictly prohibited"),
    ("proprietary", "without the prior written permission", r"no part of this (?:publication|document|book|software) may be reproduced .{1,160}? without the prior written permission"),
    ("proprietary", "without prior written consent", r"without (?:the )?prior written consent"),
    ("patent-grant", "patent license", r"perpetual, worldwide, non-exclusive, .{1,60}? patent license"),
    ("trademark", "registered trademark", r"(?:is a|are) registered trademarks? of"),
    ("warranty-disclaimer", "without warranty of any kind", r"provided \"?as is\"?, without warranty of any kind"),
    ("warranty-disclaimer", "implied warranty of merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("warranty-disclaimer", "warranties of merchantability", r"implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("liability-disclaimer", "in no event shall", r"in no event shall the (?:authors?|copyright (?:holders?|owners?)|regents)(?: or (?:copyright holders|contributors))? be liable"),
    ("contributor-agreement", "contributor licen", r"contributor licen[sc]e agreement"),
    ("dco", "developer certificate of origin", r"developer certificate of origin"),
    ("dual", "dual licen", r"dual[- ]licen[sc]ed"),
    ("dual", "alternatively, this", r"alternatively, this (?:file|software|program) may be (?:used|distributed) under the terms"),
    ("multi", "at your option", r"licensed under either of .{1,80}? at your option"),
    ("copyleft", "copyleft", r"\bcopyleft\b"),
    ("permissive", "permissive licen", r"\bpermissive licen[sc]e"),
    ("copyright-notice", "copyright (c)", r"copyright \(c\) (?:19|20)\d\d"),
    ("rights-notice", "all wrongs reserved", r"all wrongs reserved"),
    ("see-licence-file", "see the license file", r"see the licen[sc]e file"),
    ("see-licence-file", "see license.txt", r"see licen[sc]e\.(?:txt|md)"),
    ("see-licence-file", "in the root directory of this source tree", r"licen[sc]e found in the licen[sc]e file in the root directory of this source tree"),
]
#: Notices that say nothing of the terms are hints; passages of a licence's own text are evidence.
NOTICES = {"trademark", "warranty-disclaimer", "liability-disclaimer", "contributor-agreement", "dco", "dual", "multi", "copyleft", "permissive", "copyright-notice", "rights-notice", "see-licence-file", "patent-grant"}
#: Literals by which rules are gated together before each is by its own keyword.
STEMS = (
    "licen", "spdx", "creative", "cc0", "public", "reserved", "permission", "redistribut", "gpl", "copyright", "software", "apache", "bsd", "warrant", "eupl",
    "prior writ", "share", "free", "either version", "source", "font", "data", ".org",
)
#: Of a group with a short keyword, a pattern that all its rules need.
GATES = {"cc": "cc[- ]by"}


def stem(keyword: str) -> str:
    return next((s for s in STEMS if s in keyword), keyword)


def _version(v: str) -> str:
    """2.0 as 2 or 2.0, not followed by more of a number."""
    whole = v.removesuffix(".0").replace(".", r"\.")
    return whole + (r"(?:\.0)?" if v.endswith(".0") else "") + r"(?![.\d]*\d)"


def rules() -> list[Rule]:
    """All rules, most specific first within a licence."""
    out: list[Rule] = []
    for x in LICENCES:
        stem = x.stem.replace(".", r"\.")
        for v in x.versions:
            label, number = f"{x.stem}-{v}", _version(v)
            out.append(Rule(label, "spdx", rf"spdx-license-identifier:\s*{stem}-{number}(?:-only|-or-later|\+)?", TAG))
            out.append(Rule(label, "licen", rf"licen[sc]ed? (?:under|as|:) ?(?:the )?(?:terms of )?(?:the )?{stem}[- ]?v?{number}", SHORT))
            out.append(Rule(label, x.keyword, rf"(?:{x.name}){GAP}(?:v\.?|version)?[\s.]*{number}", LONG))
            if x.site:
                out.append(Rule(label, ".org/", x.site.replace("{v}", v.replace(".", r"\.")), SITE))
        if not x.versions:
            out.append(Rule(x.stem, "spdx", rf"spdx-license-identifier:\s*{stem}\b", TAG))
            if x.site:
                out.append(Rule(x.stem, ".org", x.site, SITE))
        out.append(Rule(x.stem, x.keyword, x.name, NAME))
    for label, short, long in COMMONS:
        for v in COMMONS_VERSIONS:
            number = _version(v)
            out.append(Rule(f"{label}-{v}", "spdx", rf"spdx-license-identifier:\s*{label}-{number}", TAG))
            out.append(Rule(f"{label}-{v}", "cc", rf"\bcc[- ]{short}[- ]{number}", LONG))
            out.append(Rule(f"{label}-{v}", "creative commons", rf"creative commons {long}{GAP}(?:v\.?|version|international|unported|licen[sc]e|\s)*{number}", LONG))
            out.append(Rule(f"{label}-{v}", "creativecommons.org", rf"creativecommons\.org/licenses/{short}/{v.replace('.', chr(92) + '.')}", SITE))
        out.append(Rule(label, "cc", rf"\bcc[- ]{short}\b", NAME))
        out.append(Rule(label, "creative commons", rf"creative commons {long}", NAME))
    texts = [Rule(label, keyword, pattern.replace(" ", r"\s+"), HINT if label in NOTICES else TEXT) for label, keyword, pattern in PASSAGES]
    return texts + out + OTHERS
