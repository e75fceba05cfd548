"""The ordered signature rules of the license scan, each written by hand.

A rule is a regular expression over the lower-cased words of a text joined by single blanks
("GPL-2.0" is "gpl 2 0"), a label, a keyword that any match contains, a priority and a weight.
A rule of higher priority wins over what lies inside its span: SPDX tags (40), names with a version (30),
sentences of a license or a grant (20), bare names (10), hints (5).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int
    weight: float


#: Phrases whose places are counted as they are: phrase, label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label, priority, weight, keyword, pattern
WRITTEN = (
    # GNU
    ("gpl-1.0", 40, 0.99, "spdx", "spdx licen[cs]e identifier gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", 40, 0.99, "spdx", "spdx licen[cs]e identifier gpl 2 0(?: only| or later)?(?: with classpath exception 2 0| with linux syscall note)?"),
    ("gpl-3.0", 40, 0.99, "spdx", "spdx licen[cs]e identifier gpl 3 0(?: only| or later)?(?: with gcc exception 3 1)?"),
    ("lgpl-2.0", 40, 0.99, "spdx", "spdx licen[cs]e identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", 40, 0.99, "spdx", "spdx licen[cs]e identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", 40, 0.99, "spdx", "spdx licen[cs]e identifier lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", 40, 0.99, "spdx", "spdx licen[cs]e identifier agpl 3 0(?: only| or later)?"),
    ("gfdl-1.3", 40, 0.99, "spdx", "spdx licen[cs]e identifier gfdl 1 3(?: only| or later)?"),
    ("gpl-1.0", 30, 0.85, "general public", "gnu general public licen[cs]e (?:version |v )?v?1(?: 0)?(?! [0-9])"),
    ("gpl-2.0", 30, 0.9, "general public", "gnu general public licen[cs]e (?:as published by the free software foundation )?(?:gpl )?(?:version |v |ver )?v?2(?: 0)?(?! [0-9])"),
    ("gpl-3.0", 30, 0.9, "general public", "gnu general public licen[cs]e (?:as published by the free software foundation )?(?:gpl )?(?:version |v |ver )?v?3(?: 0)?(?! [0-9])"),
    ("gpl-2.0", 30, 0.85, "gpl", "(?:gnu )?gpl (?:version |v )?v?2(?: 0)?(?! [0-9])"),
    ("gpl-3.0", 30, 0.85, "gpl", "(?:gnu )?gpl (?:version |v )?v?3(?: 0)?(?! [0-9])"),
    ("gpl-2.0", 30, 0.85, "gplv2", "gplv2"),
    ("gpl-3.0", 30, 0.85, "gplv3", "gplv3"),
    ("gpl", 20, 0.9, "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", 20, 0.8, "free software", "(?:is|are) free software you can redistribute (?:it|them) and or modify (?:it|them)"),
    ("gpl", 20, 0.8, "later version", "either version (?:2|3) of the licen[cs]e or at your option any later version"),
    ("gpl", 20, 0.7, "merchantability", "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu"),
    ("gpl", 20, 0.8, "copy of the gnu", "you should have received a copy of the gnu general public licen[cs]e along with this (?:program|library|software|file)"),
    ("gpl", 20, 0.7, "franklin street", "free software foundation inc 51 franklin street"),
    ("gpl", 20, 0.7, "temple place", "free software foundation inc 59 temple place"),
    ("gpl", 20, 0.8, "gpl", "(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl"),
    ("gpl", 10, 0.6, "general public", "gnu general public licen[cs]e"),
    ("gpl", 10, 0.6, "gpl", "gnu gpl|gpl"),
    ("gpl-exception", 20, 0.7, "exception", "as a special exception you may use this file as part of a free software library without restriction"),
    ("gpl-classpath", 20, 0.8, "classpath", "gpl with (?:the )?classpath exception|gnu classpath exception"),
    ("gpl-linking", 20, 0.7, "exception", "(?:gcc runtime library|openssl|font|bison) exception"),
    ("lgpl-2.0", 30, 0.9, "library general public", "gnu library general public licen[cs]e (?:version |v )?v?2(?: 0)?(?! [0-9])"),
    ("lgpl-2.1", 30, 0.9, "lesser general public", "gnu lesser general public licen[cs]e (?:as published by the free software foundation )?(?:version |v )?v?2 1"),
    ("lgpl-3.0", 30, 0.9, "lesser general public", "gnu lesser general public licen[cs]e (?:as published by the free software foundation )?(?:version |v )?v?3(?: 0)?(?! [0-9])"),
    ("lgpl-2.1", 30, 0.85, "lgpl", "(?:gnu )?lgpl (?:version |v )?v?2 1"),
    ("lgpl-3.0", 30, 0.85, "lgpl", "(?:gnu )?lgpl (?:version |v )?v?3(?: 0)?(?! [0-9])"),
    ("lgpl", 20, 0.85, "copy of the gnu", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", 20, 0.8, "lgpl", "(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl"),
    ("lgpl", 15, 0.65, "lesser general public", "(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", 15, 0.65, "library general public", "(?:gnu )?library general public licen[cs]e"),
    ("lgpl", 10, 0.6, "lgpl", "gnu lgpl|lgpl"),
    ("agpl-3.0", 30, 0.9, "affero", "gnu affero general public licen[cs]e (?:version |v )?v?3(?: 0)?(?! [0-9])"),
    ("agpl-3.0", 30, 0.85, "agpl", "(?:gnu )?agpl (?:version |v )?v?3(?: 0)?(?! [0-9])"),
    ("agpl-1.0", 30, 0.85, "affero", "affero general public licen[cs]e (?:version |v )?v?1(?: 0)?(?! [0-9])"),
    ("agpl-3.0", 30, 0.85, "agplv3", "agplv3"),
    ("agpl", 15, 0.65, "affero", "(?:gnu )?affero general public licen[cs]e"),
    ("agpl", 10, 0.6, "agpl", "agpl"),
    ("gfdl-1.1", 30, 0.9, "free documentation", "gnu free documentation licen[cs]e version 1 1"),
    ("gfdl-1.2", 30, 0.9, "free documentation", "gnu free documentation licen[cs]e version 1 2"),
    ("gfdl-1.3", 30, 0.9, "free documentation", "gnu free documentation licen[cs]e version 1 3"),
    ("gfdl", 20, 0.8, "invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", 10, 0.6, "free documentation", "(?:gnu )?free documentation licen[cs]e"),
    # Apache
    ("apache-1.0", 40, 0.99, "spdx", "spdx licen[cs]e identifier apache 1 0"),
    ("apache-1.1", 40, 0.99, "spdx", "spdx licen[cs]e identifier apache 1 1"),
    ("apache-2.0", 40, 0.99, "spdx", "spdx licen[cs]e identifier apache 2 0(?: with llvm exception)?"),
    ("apache-1.0", 30, 0.85, "apache", "apache (?:software )?licen[cs]e (?:version |v )?v?1 0"),
    ("apache-1.1", 30, 0.85, "apache", "apache (?:software )?licen[cs]e (?:version |v )?v?1 1"),
    ("apache-2.0", 30, 0.9, "apache", "(?:licen[cs]ed under the )?apache (?:software )?licen[cs]e (?:version |v |ver )?v?2(?: 0)?(?! [0-9])"),
    ("apache-2.0", 30, 0.8, "apache", "apache 2 0(?: licen[cs]ed?)?"),
    ("apache-2.0", 30, 0.8, "apache2", "apache2 licen[cs]ed?"),
    ("apache-2.0", 30, 0.9, "apache", "www apache org licen[cs]es licen[cs]e 2 0"),
    ("apache-2.0", 20, 0.9, "you may not use this file", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", 20, 0.85, "as is basis", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", 20, 0.85, "apache", "licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache", 20, 0.8, "apache", "this product includes software developed (?:by|at) the apache software foundation"),
    ("apache", 10, 0.6, "apache", "apache (?:software )?licen[cs]e"),
    # MIT and X11
    ("mit", 40, 0.99, "spdx", "spdx licen[cs]e identifier mit"),
    ("mit-0", 40, 0.99, "spdx", "spdx licen[cs]e identifier mit 0"),
    ("mit", 20, 0.95, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 20, 0.9, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 20, 0.8, "above copyright notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 20, 0.7, "as is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", 20, 0.75, "mit", "(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mit(?: licen[cs]e)?"),
    ("mit", 10, 0.6, "mit", "(?:the )?mit licen[cs]e"),
    ("mit", 10, 0.6, "expat", "expat licen[cs]e"),
    ("x11", 10, 0.6, "x11", "x11 licen[cs]e|mit x11(?: licen[cs]e)?"),
    ("x11", 20, 0.7, "x consortium", "the name of the x consortium shall not be used in advertising"),
    # BSD
    ("0bsd", 40, 0.99, "spdx", "spdx licen[cs]e identifier 0bsd"),
    ("bsd-2-clause", 40, 0.99, "spdx", "spdx licen[cs]e identifier bsd 2 clause(?: patent| views)?"),
    ("bsd-3-clause", 40, 0.99, "spdx", "spdx licen[cs]e identifier bsd 3 clause(?: clear| lbnl)?"),
    ("bsd-4-clause", 40, 0.99, "spdx", "spdx licen[cs]e identifier bsd 4 clause(?: uc)?"),
    ("bsd-2-clause", 30, 0.85, "bsd", "bsd 2 clause(?: licen[cs]e)?|2 clause bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", 30, 0.85, "bsd", "bsd 3 clause(?: licen[cs]e)?|3 clause bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", 30, 0.85, "bsd", "bsd 4 clause(?: licen[cs]e)?|4 clause bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", 20, 0.75, "bsd", "simplified bsd licen[cs]e|freebsd licen[cs]e"),
    ("bsd-3-clause", 20, 0.75, "bsd", "(?:new|modified|revised) bsd licen[cs]e"),
    ("bsd-4-clause", 20, 0.75, "bsd", "(?:original|old) bsd licen[cs]e"),
    ("bsd", 20, 0.9, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", 20, 0.75, "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 20, 0.75, "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 20, 0.8, "endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 20, 0.85, "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", 10, 0.6, "bsd", "bsd(?: style| like)? licen[cs]ed?"),
    ("isc", 40, 0.99, "spdx", "spdx licen[cs]e identifier isc"),
    ("isc", 20, 0.95, "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 10, 0.6, "isc", "isc licen[cs]e"),
    ("hpnd", 20, 0.85, "permission to use copy modify", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    # Mozilla, Eclipse, CDDL and other weak copyleft
    ("mpl-1.1", 40, 0.99, "spdx", "spdx licen[cs]e identifier mpl 1 1"),
    ("mpl-2.0", 40, 0.99, "spdx", "spdx licen[cs]e identifier mpl 2 0(?: no copyleft exception)?"),
    ("mpl-1.0", 30, 0.85, "mozilla public", "mozilla public licen[cs]e (?:version |v )?v?1 0"),
    ("mpl-1.1", 30, 0.85, "mozilla public", "mozilla public licen[cs]e (?:version |v )?v?1 1"),
    ("mpl-2.0", 30, 0.9, "mozilla public", "mozilla public licen[cs]e (?:version |v )?v?2(?: 0)?(?! [0-9])"),
    ("mpl-1.1", 30, 0.8, "mpl", "mpl (?:version |v )?v?1 1"),
    ("mpl-2.0", 30, 0.8, "mpl", "mpl (?:version |v )?v?2(?: 0)?(?! [0-9])"),
    ("mpl-2.0", 35, 0.95, "source code form", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl", 20, 0.9, "source code form", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", 10, 0.6, "mozilla public", "mozilla public licen[cs]e"),
    ("mpl", 10, 0.5, "mpl", "mpl licen[cs]ed?"),
    ("epl-1.0", 40, 0.99, "spdx", "spdx licen[cs]e identifier epl 1 0"),
    ("epl-2.0", 40, 0.99, "spdx", "spdx licen[cs]e identifier epl 2 0"),
    ("epl-1.0", 30, 0.85, "eclipse public", "eclipse public licen[cs]e (?:version |v )?v?1 0"),
    ("epl-2.0", 30, 0.85, "eclipse public", "eclipse public licen[cs]e (?:version |v )?v?2(?: 0)?(?! [0-9])"),
    ("epl", 20, 0.85, "eclipse public", "made available under the terms of the eclipse public licen[cs]e"),
    ("epl", 10, 0.6, "eclipse public", "eclipse public licen[cs]e"),
    ("edl-1.0", 30, 0.85, "eclipse distribution", "eclipse distribution licen[cs]e (?:version |v )?v?1 0"),
    ("cddl-1.0", 30, 0.85, "common development", "common development and distribution licen[cs]e (?:cddl )?(?:version |v )?v?1 0"),
    ("cddl-1.1", 30, 0.85, "common development", "common development and distribution licen[cs]e (?:cddl )?(?:version |v )?v?1 1"),
    ("cddl", 10, 0.6, "common development", "common development and distribution licen[cs]e"),
    ("cddl", 10, 0.5, "cddl", "cddl"),
    ("cpl-1.0", 30, 0.85, "common public", "common public licen[cs]e (?:version |v )?v?1 0"),
    ("cpl", 10, 0.6, "common public", "common public licen[cs]e"),
    ("ipl-1.0", 10, 0.6, "ibm public", "ibm public licen[cs]e(?: (?:version |v )?1 0)?"),
    ("eupl-1.1", 30, 0.85, "european union public", "european union public licen[cs]e (?:version |v )?v?1 1"),
    ("eupl-1.2", 30, 0.85, "european union public", "european union public licen[cs]e (?:version |v )?v?1 2"),
    ("eupl-1.2", 30, 0.8, "eupl", "eupl (?:version |v )?v?1 2"),
    ("eupl", 10, 0.6, "european union public", "european union public licen[cs]e"),
    ("osl-3.0", 30, 0.85, "open software", "open software licen[cs]e (?:version |v )?v?3 0"),
    ("osl", 10, 0.55, "open software", "open software licen[cs]e"),
    ("afl-3.0", 30, 0.85, "academic free", "academic free licen[cs]e (?:version |v )?v?3 0"),
    ("afl", 10, 0.6, "academic free", "academic free licen[cs]e"),
    ("artistic-1.0", 30, 0.85, "artistic", "artistic licen[cs]e (?:version |v )?v?1(?: 0)?(?! [0-9])"),
    ("artistic-2.0", 30, 0.85, "artistic", "artistic licen[cs]e (?:version |v )?v?2(?: 0)?(?! [0-9])"),
    ("artistic", 10, 0.6, "artistic", "(?:the )?artistic licen[cs]e"),
    ("perl", 20, 0.75, "perl", "under the same terms as perl(?: itself)?"),
    ("lppl-1.3c", 30, 0.85, "latex project", "latex project public licen[cs]e (?:version |v )?1 3c"),
    ("lppl", 10, 0.6, "latex project", "latex project public licen[cs]e"),
    ("cecill-2.1", 30, 0.85, "cecill", "cecill (?:free software )?(?:licen[cs]e )?(?:version |v )?v?2 1"),
    ("cecill-b", 30, 0.8, "cecill", "cecill b(?: licen[cs]e)?"),
    ("cecill-c", 30, 0.8, "cecill", "cecill c(?: licen[cs]e)?"),
    ("cecill", 10, 0.6, "cecill", "cecill(?: licen[cs]e)?"),
    ("qpl-1.0", 10, 0.6, "q public", "q public licen[cs]e(?: (?:version |v )?1 0)?"),
    ("sleepycat", 10, 0.6, "sleepycat", "sleepycat licen[cs]e"),
    ("ms-pl", 10, 0.7, "microsoft public", "microsoft public licen[cs]e"),
    ("ms-rl", 10, 0.7, "microsoft reciprocal", "microsoft reciprocal licen[cs]e"),
    ("nasa-1.3", 10, 0.6, "nasa open source", "nasa open source agreement(?: (?:version |v )?1 3)?"),
    # permissive
    ("bsl-1.0", 40, 0.99, "spdx", "spdx licen[cs]e identifier bsl 1 0"),
    ("bsl-1.0", 30, 0.9, "boost software", "(?:distributed under the )?boost software licen[cs]e (?:version |v )?v?1 0"),
    ("bsl", 10, 0.6, "boost software", "boost software licen[cs]e"),
    ("zlib", 40, 0.99, "spdx", "spdx licen[cs]e identifier zlib"),
    ("zlib", 20, 0.8, "provided as is", "this software is provided as is without any express or implied warranty"),
    ("zlib", 20, 0.8, "origin of this software", "the origin of this software must not be misrepresented"),
    ("zlib", 20, 0.75, "altered source", "altered source versions must be plainly marked as such"),
    ("zlib", 10, 0.6, "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("libpng", 10, 0.6, "libpng", "libpng licen[cs]e"),
    ("unlicense", 40, 0.99, "spdx", "spdx licen[cs]e identifier unlicen[cs]e"),
    ("unlicense", 20, 0.9, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 10, 0.6, "the unlicen", "(?:under )?the unlicen[cs]e"),
    ("wtfpl-2.0", 30, 0.85, "wtfpl", "wtfpl (?:version |v )?v?2(?: 0)?(?! [0-9])"),
    ("wtfpl", 20, 0.85, "what the fuck", "do what the fuck you want to(?: public licen[cs]e)?"),
    ("wtfpl", 10, 0.6, "wtfpl", "wtfpl"),
    ("beerware", 20, 0.8, "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("beerware", 10, 0.6, "beer", "beer ?ware licen[cs]e"),
    ("python-2", 30, 0.85, "python", "python software foundation licen[cs]e (?:version |v )?v?2(?: 0)?(?! [0-9])"),
    ("python-2", 30, 0.85, "psf", "psf licen[cs]e (?:version |v )?v?2(?: 0)?(?! [0-9])"),
    ("python", 10, 0.6, "python", "python software foundation licen[cs]e"),
    ("python", 10, 0.6, "psf", "psf licen[cs]e"),
    ("php-3.01", 30, 0.85, "php", "php licen[cs]e (?:version |v )?v?3 01"),
    ("php", 20, 0.8, "php", "this source file is subject to version 3 0?1? ?of the php licen[cs]e"),
    ("php", 10, 0.6, "php", "php licen[cs]e"),
    ("ruby", 10, 0.6, "ruby", "ruby licen[cs]e|ruby s licen[cs]e"),
    ("postgresql", 10, 0.6, "postgresql", "postgresql licen[cs]e"),
    ("openssl", 20, 0.8, "openssl", "this product includes software developed by the openssl project"),
    ("openssl", 10, 0.6, "openssl", "openssl licen[cs]e"),
    ("ncsa", 10, 0.6, "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e"),
    ("upl-1.0", 10, 0.7, "universal permissive", "universal permissive licen[cs]e(?: (?:version |v )?1 0)?"),
    ("ecl-2.0", 10, 0.7, "educational community", "educational community licen[cs]e(?: (?:version |v )?2 0)?"),
    ("w3c", 10, 0.6, "w3c", "w3c (?:software notice and )?(?:document )?licen[cs]e"),
    ("unicode", 10, 0.6, "unicode", "unicode (?:inc )?licen[cs]e agreement"),
    ("curl", 10, 0.6, "curl", "curl licen[cs]e"),
    ("ijg", 20, 0.75, "independent jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("vim", 10, 0.6, "vim", "vim licen[cs]e"),
    ("freetype", 20, 0.75, "freetype", "portions of this software are copyright the freetype project|freetype (?:project )?licen[cs]e"),
    ("jquery", 20, 0.6, "jquery", "jquery org licen[cs]e"),
    ("ofl-1.1", 40, 0.99, "spdx", "spdx licen[cs]e identifier ofl 1 1(?: rfn| no rfn)?"),
    ("ofl-1.1", 30, 0.9, "open font", "sil open font licen[cs]e (?:version |v )?v?1 1"),
    ("ofl", 20, 0.8, "reserved font name", "with reserved font names?"),
    ("ofl", 10, 0.6, "open font", "(?:sil )?open font licen[cs]e"),
    # data and content
    ("cc0-1.0", 40, 0.99, "spdx", "spdx licen[cs]e identifier cc0 1 0"),
    ("cc0-1.0", 30, 0.9, "cc0", "cc0 1 0(?: universal)?"),
    ("cc0", 20, 0.8, "dedicated the work", "the person who associated a work with this deed has dedicated the work"),
    ("cc0", 10, 0.7, "cc0", "(?:creative commons )?cc0"),
    ("cc0", 10, 0.7, "creative commons zero", "creative commons zero"),
    ("cc-by-2.0", 30, 0.9, "cc by", "cc by 2 0"),
    ("cc-by-2.5", 30, 0.9, "cc by", "cc by 2 5"),
    ("cc-by-3.0", 30, 0.9, "cc by", "cc by 3 0"),
    ("cc-by-4.0", 30, 0.9, "cc by", "cc by 4 0"),
    ("cc-by-sa-2.0", 30, 0.9, "cc by sa", "cc by sa 2 0"),
    ("cc-by-sa-2.5", 30, 0.9, "cc by sa", "cc by sa 2 5"),
    ("cc-by-sa-3.0", 30, 0.9, "cc by sa", "cc by sa 3 0"),
    ("cc-by-sa-4.0", 30, 0.9, "cc by sa", "cc by sa 4 0"),
    ("cc-by-nc-3.0", 30, 0.9, "cc by nc", "cc by nc 3 0"),
    ("cc-by-nc-4.0", 30, 0.9, "cc by nc", "cc by nc 4 0"),
    ("cc-by-nd-3.0", 30, 0.9, "cc by nd", "cc by nd 3 0"),
    ("cc-by-nd-4.0", 30, 0.9, "cc by nd", "cc by nd 4 0"),
    ("cc-by-nc-sa-3.0", 30, 0.9, "cc by nc sa", "cc by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", 30, 0.9, "cc by nc sa", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-3.0", 30, 0.9, "cc by nc nd", "cc by nc nd 3 0"),
    ("cc-by-nc-nd-4.0", 30, 0.9, "cc by nc nd", "cc by nc nd 4 0"),
    ("cc-by-nc-sa", 25, 0.8, "cc by nc sa", "cc by nc sa"),
    ("cc-by-nc-nd", 25, 0.8, "cc by nc nd", "cc by nc nd"),
    ("cc-by-sa", 20, 0.8, "cc by sa", "cc by sa"),
    ("cc-by-nc", 20, 0.8, "cc by nc", "cc by nc"),
    ("cc-by-nd", 20, 0.8, "cc by nd", "cc by nd"),
    ("cc-by", 10, 0.7, "cc by", "cc by"),
    ("cc-by-3.0", 30, 0.9, "creative commons attribution", "creative commons attribution (?:version )?3 0(?: unported| international)?(?: licen[cs]e)?"),
    ("cc-by-4.0", 30, 0.9, "creative commons attribution", "creative commons attribution (?:version )?4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-sa-3.0", 30, 0.9, "creative commons attribution", "creative commons attribution share ?alike (?:version )?3 0(?: unported)?(?: licen[cs]e)?"),
    ("cc-by-sa-4.0", 30, 0.9, "creative commons attribution", "creative commons attribution share ?alike (?:version )?4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-4.0", 30, 0.9, "creative commons attribution", "creative commons attribution non ?commercial (?:version )?4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nd-4.0", 30, 0.9, "creative commons attribution", "creative commons attribution no ?deriv(?:ative)?s? (?:version )?4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa-4.0", 30, 0.9, "creative commons attribution", "creative commons attribution non ?commercial share ?alike (?:version )?4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-nd-4.0", 30, 0.9, "creative commons attribution", "creative commons attribution non ?commercial no ?deriv(?:ative)?s? (?:version )?4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", 25, 0.8, "creative commons attribution", "creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?"),
    ("cc-by-nc-nd", 25, 0.8, "creative commons attribution", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: licen[cs]e)?"),
    ("cc-by-sa", 20, 0.8, "creative commons attribution", "creative commons attribution share ?alike(?: licen[cs]e)?"),
    ("cc-by-nc", 20, 0.8, "creative commons attribution", "creative commons attribution non ?commercial(?: licen[cs]e)?"),
    ("cc-by-nd", 20, 0.8, "creative commons attribution", "creative commons attribution no ?deriv(?:ative)?s?(?: licen[cs]e)?"),
    ("cc-by", 10, 0.7, "creative commons attribution", "creative commons attribution(?: licen[cs]e)?"),
    ("cc", 20, 0.7, "creative commons", "(?:licen[cs]ed|released|published) under a creative commons licen[cs]e"),
    ("cc", 20, 0.8, "creativecommons", "creativecommons org (?:licen[cs]es|publicdomain)"),
    ("cc", 5, 0.5, "creative commons", "creative commons"),
    ("odbl-1.0", 30, 0.9, "open database", "open database licen[cs]e (?:odbl )?(?:version |v )?v?1 0"),
    ("odbl", 10, 0.6, "open database", "open database licen[cs]e"),
    ("odbl", 10, 0.6, "odbl", "odbl"),
    ("odc-by-1.0", 10, 0.7, "open data commons attribution", "open data commons attribution licen[cs]e(?: (?:version |v )?1 0)?"),
    ("pddl-1.0", 15, 0.75, "open data commons public", "open data commons public domain dedication and licen[cs]e"),
    ("cdla-permissive", 10, 0.7, "community data", "community data licen[cs]e agreement permissive"),
    ("cdla-sharing", 10, 0.7, "community data", "community data licen[cs]e agreement sharing"),
    ("ogl-3.0", 30, 0.85, "open government", "open government licen[cs]e (?:version |v )?v?3(?: 0)?(?! [0-9])"),
    ("ogl", 10, 0.6, "open government", "open government licen[cs]e"),
    # source available and restricted
    ("busl-1.1", 30, 0.85, "business source", "business source licen[cs]e (?:version |v )?v?1 1"),
    ("busl", 10, 0.6, "business source", "business source licen[cs]e"),
    ("sspl-1", 30, 0.85, "server side public", "server side public licen[cs]e (?:version |v )?v?1(?: 0)?(?! [0-9])"),
    ("sspl", 10, 0.6, "server side public", "server side public licen[cs]e"),
    ("elastic-2.0", 30, 0.85, "elastic", "elastic licen[cs]e (?:version |v )?v?2(?: 0)?(?! [0-9])"),
    ("elastic", 10, 0.6, "elastic", "elastic licen[cs]e"),
    ("commons-clause", 10, 0.7, "commons clause", "commons clause(?: licen[cs]e condition)?"),
    ("polyform", 10, 0.7, "polyform", "polyform (?:noncommercial|small business|shield|strict) licen[cs]e"),
    ("openrail", 10, 0.7, "openrail", "openrail(?: m)?(?: licen[cs]e)?"),
    ("eula", 10, 0.6, "end user licen", "end user licen[cs]e agreement"),
    ("noncommercial", 20, 0.6, "commercial", "for (?:personal and )?non ?commercial use only"),
    ("noncommercial", 20, 0.6, "commercial", "not (?:be )?used? for commercial purposes"),
    ("educational", 20, 0.5, "educational", "for educational (?:and research )?(?:use|purposes) only"),
    ("proprietary", 20, 0.8, "confidential", "proprietary and confidential|confidential and proprietary"),
    ("proprietary", 20, 0.7, "permission", "may not (?:be )?(?:copied|reproduced?)(?: or distributed?)? without (?:the )?(?:prior |express )?(?:written )?permission"),
    ("proprietary", 20, 0.7, "prohibited", "unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:of this (?:file|document|material) )?(?:via any medium )?is strictly prohibited"),
    ("proprietary", 20, 0.7, "trade secret", "contains (?:proprietary information and )?trade secrets of"),
    ("proprietary", 20, 0.6, "no part of this", "no part of this (?:publication|book|document|work) may be reproduced"),
    # notices
    ("public-domain", 20, 0.8, "public domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("public-domain", 20, 0.7, "public domain", "this (?:work|file|code|text) is in the public domain"),
    ("public-domain", 20, 0.7, "public domain", "public domain dedication"),
    ("public-domain", 5, 0.5, "public domain", "in the public domain"),
    ("public-domain", 20, 0.7, "government", "work of the (?:united states|u s) government"),
    ("copyright", 10, 0.5, "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("copyright", 10, 0.5, "copyright", "(?:19|20)[0-9]{2} copyright"),
    ("copyright", 10, 0.4, "copr", "copr (?:19|20)[0-9]{2}"),
    ("copyright", 5, 0.3, "copyright", "copyright (?:holder|owner|notice)s?"),
    ("copyright", 5, 0.3, "copyright", "protected by copyright(?: law)?"),
    ("copyright", 5, 0.4, "copyright", "subject to copyright"),
    ("reserved", 15, 0.5, "reserved", "(?:all|some|no) rights? reserved"),
    ("reserved", 15, 0.5, "droits réservés", "tous droits réservés"),
    ("reserved", 15, 0.5, "rechte vorbehalten", "alle rechte vorbehalten"),
    ("reserved", 15, 0.5, "derechos reservados", "todos los derechos reservados"),
    ("reserved", 15, 0.5, "diritti riservati", "tutti i diritti riservati"),
    ("no-warranty", 10, 0.4, "warrant", "without (?:any )?warranty of any kind"),
    ("no-warranty", 10, 0.4, "warranty", "without any warranty"),
    ("no-warranty", 10, 0.4, "warranty", "as is without warranty"),
    ("no-warranty", 10, 0.4, "no warranty", "(?:there is|comes with) (?:absolutely )?no warranty"),
    ("no-liability", 10, 0.4, "liable", "in no event shall (?:the )?(?:authors?|copyright holders?|contributors) (?:or (?:authors?|copyright holders?|contributors) )?be liable"),
    ("terms", 5, 0.2, "terms of use", "terms of use"),
    ("terms", 5, 0.2, "terms of service", "terms of service"),
    ("terms", 5, 0.3, "permission", "(?:used|reprinted|reproduced) (?:here )?(?:with|by) (?:kind )?permission"),
    ("spdx", 5, 0.5, "spdx", "spdx licen[cs]e identifier"),
)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    return tuple(sorted((Rule(label, pattern, keyword, priority, weight) for label, priority, weight, keyword, pattern in WRITTEN), key=lambda r: -r.priority))
