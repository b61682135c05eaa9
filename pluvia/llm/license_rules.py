"""Fixed values of the license scan: families of names with their forms, identifiers, and hand-written signatures.

Patterns match lower-cased words that stand between single spaces. Each match of a rule holds one of the rule's keywords as
a whole word."""

BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: fixed values: words after "license" that show that no license of a work is meant
OTHER = "plates?|offices?|fees?|holders?|numbers?|renewals?|exams?|tests?|bureau|departments?|servers?|keys?|dongles?|managers?|applications?|suspension|photos?"
VER = r"(?: (?:version |v ?)?[0-9]+(?: [0-9]+)?)?"
#: fixed values: pattern round a family's name, the strongest and longest first
FORMS = [r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?{}(?: public)?(?: licen[sc]e)?(?: version)?" + VER,
         r"spdx license identifier {}" + VER, r"this work is licensed under (?:the )?{}(?: licen[sc]e)?" + VER,
         r"{} licen[sc]e(?! (?:" + OTHER + r") )(?: version)?" + VER, r"{} (?:version |v)[0-9]+(?: [0-9]+)?"]
#: fixed values: SQL of the priority of the form that a family's match, x.v, has
FORM_PRIORITY = (r"CASE WHEN x.v RLIKE r'^(?:licensed|released|distributed|available) under |^spdx ' THEN 4 WHEN startswith(x.v, 'this work is ') THEN 3 "
                 r"WHEN x.v RLIKE r' licen[sc]e' THEN 2 ELSE 1 END")
#: fixed values: label, keywords, name
FAMILIES = [
    ("apache", "apache", r"apache(?: software)?"), ("mit", "mit", r"mit"), ("bsd", "bsd", r"(?:new |simplified |modified )?bsd(?: [234] clause)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"), ("lgpl", "lgpl", r"(?:gnu )?lgpl"), ("agpl", "agpl", r"(?:gnu )?agpl"), ("gnu-gpl", "general", r"gnu general public"),
    ("lgpl", "lesser library", r"gnu (?:lesser|library) general public"), ("agpl", "affero", r"(?:gnu )?affero general public"),
    ("fdl", "documentation", r"gnu free documentation"), ("mpl", "mozilla", r"mozilla public"), ("epl", "eclipse", r"eclipse public"),
    ("cddl", "cddl", r"cddl"), ("cc", "creative", r"creative commons(?: attribution)?"), ("cc-by", "cc", r"cc by(?: (?:nc|sa|nd))*"),
    ("cc0", "cc0", r"cc0"), ("isc", "isc", r"isc"), ("zlib", "zlib", r"zlib"), ("boost", "boost", r"boost software"), ("artistic", "artistic", r"artistic"),
    ("ofl", "ofl font", r"(?:sil )?(?:open font|ofl)"), ("eupl", "eupl", r"eupl"), ("wtfpl", "wtfpl", r"wtfpl"), ("unlicense", "unlicense", r"unlicense"),
    ("python", "python", r"python(?: software foundation)?"), ("php", "php", r"php"), ("ruby", "ruby", r"ruby"), ("perl", "perl", r"perl"), ("openssl", "openssl", r"openssl"),
    ("postgresql", "postgresql", r"postgresql"), ("ncsa", "ncsa", r"(?:university of illinois )?ncsa"), ("odbl", "database", r"open database"), ("ms-pl", "microsoft", r"microsoft public"),
    ("ibm", "ibm", r"ibm public"), ("qpl", "qpl", r"qpl"), ("zope", "zope", r"zope public"), ("w3c", "w3c", r"w3c(?: software)?"), ("x11", "x11", r"x11"), ("upl", "upl", r"upl"),
    ("vim", "vim", r"vim"), ("beerware", "beerware", r"beerware"), ("afl", "academic", r"academic free"), ("osl", "software", r"open software"), ("cecill", "cecill", r"cecill"),
]
#: fixed values: identifiers that are words of other meanings as well; they count in an identifier expression only
WORDS = {"mit": "mit", "isc": "isc", "zlib": "zlib", "ruby": "ruby", "php": "php(?: 3 0[01]?)?", "python": "(?:python|psf) 2 0", "vim": "vim", "x11": "x11", "ncsa": "ncsa", "curl": "curl", "openssl": "openssl",
         "postgresql": "postgresql", "unlicense": "unlicense", "apache": "apache [12] [01]", "boost": "bsl 1 0", "cc0": "cc0 1 0", "bsd": "0bsd", "json": "json", "intel": "intel", "fair": "fair", "naist": "naist 2003"}
#: fixed values: what may stand before an identifier in its expression
TOKENS = ("or|and|with|only|later|clause|exception|classpath|linux|syscall|note|gcc|llvm|font|[0-9]{1,4}|v[0-9]|a?l?gpl|apache|mpl|epl|cddl|bsd|0bsd|bsl|cc0|psf|"
          "mit|isc|zlib|ruby|php|python|vim|x11|ncsa|curl|openssl|postgresql|unlicense|json|intel|fair|naist")
#: up to 14 of them between the tag and an identifier; a repeated choice has no bounded length to look behind, single ones do
EXPRESSION = "(?:{0})(?<=spdx license identifier " + f"(?:(?:{TOKENS}) )?".replace("{", "{{").replace("}", "}}") * 14 + "(?:{0}))"
#: fixed values: label, priority, keywords, pattern
SIGNATURES = [
    # identifiers and short names
    ("gpl", 3, "gpl", r"(?:gnu )?gpl v?[123](?: 0)?(?: only| or later)?"),
    ("gpl", 3, "gplv1 gplv2 gplv3", r"(?:gnu )?gplv[123](?: 0)?(?: only| or later)?"),
    ("gpl", 2, "gpl", r"gnu gpl"),
    ("lgpl", 2, "lgpl", r"(?:gnu )?lgpl(?: v?[23](?: [01])?)?(?: only| or later)?"),
    ("lgpl", 3, "lgplv2 lgplv3", r"(?:gnu )?lgplv[23](?: [01])?(?: only| or later)?"),
    ("agpl", 2, "agpl", r"(?:gnu )?agpl(?: v?[13](?: 0)?)?(?: only| or later)?"),
    ("agpl", 3, "agplv1 agplv3", r"(?:gnu )?agplv[13](?: 0)?(?: only| or later)?"),
    ("fdl", 3, "gfdl", r"(?:gnu )?gfdl(?: 1 [123])?(?: only| or later| no invariants(?: only| or later))?"),
    ("apache", 3, "apache", r"apache 2 0"),
    ("apache", 3, "apache2", r"apache2(?: 0)?(?: licen[sc]ed?)?"),
    ("apache", 3, "asl", r"asl 2 0"),
    ("bsd", 3, "bsd", r"bsd [0234] clause(?: (?:patent|clear|attribution|lbnl|views|shortened))?"),
    ("bsd", 3, "clause", r"(?:two|three|four) clause bsd(?: licen[sc]e)?"),
    ("bsd", 2, "bsd", r"(?:berkeley|freebsd|netbsd) bsd(?: style)? licen[sc]e"),
    ("bsd", 2, "style", r"bsd style licen[sc]ed?"),
    ("mit", 2, "style", r"mit style licen[sc]ed?"),
    ("mit", 3, "expat", r"expat licen[sc]e"),
    ("mit", 3, "mit", r"mit 0(?= (?:licen[sc]e|or|and) )"),
    ("mit", 2, "mit", r"mit licen[sc]ed"),
    ("mit", 2, "mit", r"licen[sc]e mit(?= )(?! (?:office|student|press))"),
    ("mpl", 3, "mpl", r"mpl v?[12] [01](?: no copyleft exception)?"),
    ("mpl", 3, "mplv1 mplv2", r"mplv[12](?: [01])?"),
    ("epl", 3, "epl", r"epl [12] 0"),
    ("cddl", 3, "cddl", r"cddl 1 [01]"),
    ("eupl", 3, "eupl", r"eupl v?1 [012]"),
    ("artistic", 3, "artistic", r"artistic [12] 0(?: (?:perl|cl8))?"),
    ("boost", 3, "bsl", r"bsl 1 0"),
    ("business-source", 3, "bsl busl", r"(?:bsl|busl) 1 1"),
    ("ofl", 3, "ofl", r"ofl 1 [01](?: (?:no )?rfn)?"),
    ("cc0", 3, "cc0", r"cc0 1 0(?: universal)?"),
    ("cc-by", 3, "cc", r"cc by [1234] [05]"),
    ("cc-sa", 3, "cc", r"cc by(?: nc)? sa(?: [1234] [05])?"),
    ("cc-nc", 3, "cc", r"cc by nc(?: [1234] [05])?"),
    ("cc-nd", 3, "cc", r"cc by(?: nc)? nd(?: [1234] [05])?"),
    ("osl", 3, "osl", r"osl [123] [01]"),
    ("afl", 3, "afl", r"afl [123] [012]"),
    ("ms-pl", 3, "pl", r"ms pl"),
    ("ms-rl", 3, "rl", r"ms rl"),
    ("odbl", 3, "odbl", r"odbl(?: v)?(?: 1 0)?"),
    ("pddl", 3, "pddl", r"pddl(?: 1 0)?"),
    ("odc-by", 3, "odc", r"odc by(?: 1 0)?"),
    ("sspl", 3, "sspl", r"sspl(?: v?1(?: 0)?)?"),
    ("zpl", 3, "zpl", r"zpl [12] [01]"),
    ("cpl", 3, "cpl", r"cpl 1 0"),
    ("apsl", 3, "apsl", r"apsl [12] [012]"),
    ("rpl", 3, "rpl", r"rpl 1 [15]"),
    ("lppl", 3, "lppl", r"lppl(?: 1 [0123][ac]?)?"),
    ("mulan", 3, "mulanpsl", r"mulanpsl [12] 0"),
    ("blueoak", 3, "blueoak", r"blueoak 1 0 0"),
    # permissive bodies
    ("mit", 4, "granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 3, "merge", r"without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", 3, "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 3, "noninfringement", r"fitness for a particular purpose and noninfringement"),
    ("mit", 3, "dealings", r"arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit-modern", 3, "stillborn", r"permission is hereby granted without stillborn conditions"),
    ("boost", 4, "granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("boost", 3, "machine", r"in the form of machine executable object code generated by a source language processor"),
    ("isc", 4, "granted", r"permission to use copy modify (?:and or|and) distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 3, "disclaims", r"the author disclaims all warranties with regard to this software"),
    ("isc", 2, "tortious", r"whether in an action of contract negligence or other tortious action"),
    ("bsd", 4, "redistribution", r"redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?"),
    ("bsd", 3, "nor", r"neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|their|the) contributors"),
    ("bsd", 3, "retain", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", 3, "reproduce", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd", 3, "endorse", r"(?:may not be|must not be) used to endorse or promote products derived from this software"),
    ("bsd-original", 4, "mentioning", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", 2, "procurement", r"procurement of substitute goods or services"),
    ("bsd", 2, "exemplary", r"direct indirect incidental special exemplary or consequential damages"),
    ("bsd", 3, "regents", r"copyright (?:c )?(?:[0-9]{4} )*(?:by )?the regents of the university of california"),
    ("bsd", 3, "holders", r"provided by the copyright holders and contributors as is"),
    ("apache", 4, "compliance", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache", 4, "apache", r"licensed to the apache software foundation(?: asf)? under one or more contributor license agreements"),
    ("apache", 3, "basis", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("apache", 3, "governing", r"see the license for the specific language governing permissions and limitations"),
    ("apache", 3, "licenses", r"(?:https? )?www apache org licenses(?: license 2 0)?"),
    ("apache", 2, "prominent readable", r"carry prominent notices stating that you changed the files|derivative works a readable copy of the attribution notices contained within such notice file"),
    ("apache-1.1", 4, "includes", r"this product includes software developed by the apache software foundation"),
    ("zlib", 4, "held", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 3, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 3, "altered", r"altered source versions must be plainly marked as such"),
    ("libpng", 3, "png", r"png reference library"),
    ("ncsa", 4, "illinois", r"university of illinois ncsa open source license"),
    ("ncsa", 3, "deal", r"to deal with the software without restriction"),
    ("x11", 3, "consortium", r"except as contained in this notice the name of the x consortium shall not be used"),
    ("x11", 3, "consortium", r"x window system is a trademark of (?:the )?x consortium"),
    ("ntp", 4, "suitability", r"makes no representations about the suitability (?:of )?this software for any purpose"),
    ("hpnd", 3, "publicity", r"not be used in advertising or publicity pertaining to distribution of the software"),
    ("hpnd", 3, "historical", r"historical permission notice and disclaimer"),
    ("curl", 3, "stenberg", r"copyright (?:c )?(?:[0-9]{4} )*daniel stenberg"),
    ("postgresql", 4, "hereby", r"without a written agreement is hereby granted provided that the above copyright notice"),
    ("python", 4, "psf", r"(?:psf license agreement|this license agreement is between the python software foundation psf)"),
    ("python", 3, "cnri", r"cnri (?:open source )?license agreement"),
    ("php", 4, "php", r"this product includes php software"),
    ("php", 3, "php", r"this source file is subject to version 3 0[01]? of the php license"),
    ("openssl", 4, "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", 4, "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("ruby", 4, "ruby", r"ruby is copyrighted free software by yukihiro matsumoto"),
    ("perl", 4, "perl", r"(?:under|on) the same terms as perl(?: itself)?"),
    ("vim", 4, "vim", r"vim is charityware"),
    ("beerware", 4, "beer", r"(?:you can|you may) buy me a beer in return"),
    ("beerware", 4, "beerware beer", r"the beer ?ware license"),
    ("wtfpl", 4, "fuck", r"do what the fuck you want to(?: public license)?"),
    ("unlicense", 4, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 3, "unlicense", r"(?:https? )?unlicense org"),
    ("fair", 4, "usage", r"usage of the works is permitted provided that this instrument is retained"),
    ("json", 4, "evil", r"the software shall be used for good not evil"),
    ("ftl", 4, "freetype", r"(?:the )?freetype (?:project )?licen[sc]e"),
    ("ijg", 4, "jpeg", r"based in part on the work of the independent jpeg group"),
    ("icu", 3, "icu", r"icu licen[sc]e"),
    ("unicode", 4, "unicode", r"unicode (?:inc )?license agreement(?: data files and software)?"),
    ("unicode", 3, "unicode", r"unicode data files or software"),
    ("w3c", 4, "w3c", r"w3c software (?:and document )?notice and license"),
    ("sleepycat", 4, "sleepycat", r"sleepycat (?:software )?(?:licen[sc]e|public)"),
    ("tcl", 3, "tcl", r"tcl tk licen[sc]e"),
    ("upl", 4, "universal", r"universal permissive license"),
    ("blueoak", 4, "oak", r"blue oak model license"),
    ("mulan", 4, "mulan", r"mulan (?:permissive|public) (?:software )?license"),
    ("0bsd", 4, "zero", r"zero clause bsd"),
    ("mit-0", 4, "attribution", r"mit no attribution"),
    # copyleft bodies
    ("gpl", 4, "redistribute", r"(?:this|the) (?:program|library|file|software) is free software you can redistribute it and or modify it"),
    ("gpl", 3, "either", r"either version [0-9]+(?: [0-9]+)? of the license or at your option any later version"),
    ("gpl", 4, "copylefted", r"is copylefted (?:libre )?software"),
    ("gpl", 3, "received", r"you should have received a copy of the gnu general public license"),
    ("gpl", 3, "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", 3, "guarantee", r"intended to guarantee your freedom to share and change"),
    ("gpl", 3, "comes", r"comes with absolutely no warranty for details type show w"),
    ("gpl", 3, "conveying", r"conveying verbatim copies|conveying modified source versions"),
    ("gpl", 3, "gpl", r"under the terms of the (?:gnu )?gpl"),
    ("gpl-exception", 4, "classpath", r"classpath exception"),
    ("gpl-exception", 4, "exception", r"as a special exception (?:[^ ]+ ){0,8}(?:link|permission to link)"),
    ("gpl-exception", 4, "runtime", r"gcc runtime library exception"),
    ("gpl-exception", 4, "syscall", r"linux syscall note"),
    ("lgpl", 4, "lesser", r"(?:gnu )?lesser (?:gnu )?general public licen[sc]e"),
    ("lgpl", 4, "library", r"(?:gnu )?library general public licen[sc]e"),
    ("lgpl", 3, "uses", r"work that uses the library"),
    ("agpl", 4, "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("agpl", 3, "remotely", r"users interacting with it remotely through a computer network"),
    ("fdl", 4, "invariant", r"with no invariant sections"),
    ("fdl", 4, "documentation", r"free documentation licen[sc]e"),
    ("mpl", 4, "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", 4, "mozilla", r"the contents of this file are subject to the mozilla public license"),
    ("mpl", 3, "incompatible", r"incompatible with secondary licenses"),
    ("mpl", 3, "mozilla", r"mozilla org mpl"),
    ("npl", 4, "netscape", r"netscape public licen[sc]e"),
    ("epl", 4, "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", 3, "eclipse", r"(?:www )?eclipse org legal epl(?: v[12]0| 2 0)?"),
    ("edl", 4, "eclipse", r"eclipse distribution licen[sc]e"),
    ("cpl", 4, "common", r"common public licen[sc]e"),
    ("ibm", 4, "ibm", r"ibm public licen[sc]e"),
    ("cddl", 4, "development", r"(?:subject to the terms of the )?common development and distribution license"),
    ("eupl", 4, "european", r"european union public licen[sc]e"),
    ("osl", 4, "licensed", r"licensed under the open software license"),
    ("afl", 4, "academic", r"academic free licen[sc]e"),
    ("qpl", 4, "q", r"q public licen[sc]e"),
    ("apsl", 4, "apple", r"apple public source licen[sc]e"),
    ("rpl", 4, "reciprocal", r"reciprocal public licen[sc]e"),
    ("ms-pl", 4, "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", 4, "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("nokia", 4, "nokia", r"nokia open source licen[sc]e"),
    ("sun", 4, "sun", r"sun (?:industry standards source|public) licen[sc]e"),
    ("cecill", 4, "cecill", r"governed by the cecill(?: [abc])? licen[sc]e"),
    ("zope", 4, "zope", r"zope public licen[sc]e"),
    ("lppl", 4, "latex", r"latex project public licen[sc]e"),
    ("artistic", 3, "artistic", r"(?:the )?(?:perl )?artistic license"),
    ("artistic", 3, "package", r"package refers to the collection of files distributed by the copyright holder"),
    ("sspl", 4, "side", r"server side public licen[sc]e"),
    ("elastic", 4, "elastic", r"elastic licen[sc]e(?: (?:version )?2(?: 0)?)?"),
    ("business-source", 4, "business", r"business source licen[sc]e"),
    ("commons-clause", 4, "clause", r"commons clause(?: licen[sc]e)?(?: condition)?"),
    ("polyform", 4, "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial)(?: licen[sc]e)?"),
    ("rail", 4, "rail", r"(?:open|responsible ai|creativeml open|bigscience) rail(?: [ms])?(?: licen[sc]e)?"),
    ("rail", 3, "openrail", r"openrail(?: m)?"),
    ("rail", 3, "responsible", r"responsible ai licen[sc]es?"),
    # content and data
    ("cc0", 4, "waived", r"to the extent possible under law (?:[^ ]+ ){1,12}waived all copyright"),
    ("cc0", 4, "zero", r"creative commons zero"),
    ("cc", 3, "creative", r"licensed under a creative commons(?: [^ ]+){0,6} (?:licen[sc]e|unported|international)"),
    ("cc", 3, "creativecommons", r"creativecommons org licenses by(?: (?:nc|sa|nd))*"),
    ("cc0", 3, "creativecommons", r"creativecommons org publicdomain zero"),
    ("public-domain", 3, "creativecommons", r"creativecommons org publicdomain mark"),
    ("cc-sa", 4, "sharealike", r"(?:creative commons )?attribution (?:noncommercial )?sharealike"),
    ("cc-sa", 4, "alike", r"(?:creative commons )?attribution (?:non ?commercial )?share alike"),
    ("cc-nc", 4, "noncommercial", r"(?:creative commons )?attribution noncommercial"),
    ("cc-nd", 4, "noderiv noderivs noderivative noderivatives", r"(?:creative commons )?attribution (?:noncommercial )?noderiv(?:s|ative|atives)?"),
    ("cc-sampling", 4, "sampling", r"creative commons sampling(?: plus)?"),
    ("ofl", 4, "reserved", r"with reserved font name"),
    ("ofl", 4, "font", r"sil open font licen[sc]e"),
    ("ubuntu-font", 4, "ubuntu", r"ubuntu font licen[sc]e"),
    ("ogl", 4, "government", r"open government licen[sc]e"),
    ("odbl", 3, "commons", r"open data commons open database"),
    ("odc-by", 3, "commons", r"open data commons attribution"),
    ("pddl", 3, "commons", r"open data commons public domain dedication"),
    ("odbl", 3, "openstreetmap", r"openstreetmap contributors"),
    ("cdla", 4, "community", r"community data license agreement(?: (?:permissive|sharing))?"),
    ("free-art", 4, "art", r"(?:free art licen[sc]e|licence art libre)"),
    ("dsl", 4, "design", r"design science licen[sc]e"),
    ("opl", 4, "publication", r"open publication licen[sc]e"),
    ("ogl-game", 4, "gaming", r"open gaming licen[sc]e"),
    ("gutenberg", 4, "gutenberg", r"(?:full )?project gutenberg (?:tm )?licen[sc]e"),
    ("public-domain", 4, "domain", r"(?:is|are|placed|been placed|remains?) in the public domain"),
    ("public-domain", 4, "domain", r"(?:dedicated|released|contributed) to the public domain"),
    ("public-domain", 4, "domain", r"(?:released|placed|put) into the public domain"),
    ("public-domain", 4, "domain", r"public domain (?:mark|dedication)"),
    ("public-domain", 3, "known", r"no known copyright restrictions"),
    ("public-domain", 3, "government", r"(?:work|works) of the (?:united states|u s|us) (?:federal )?government"),
    # reservations, agreements and statements
    ("no-warranty", 2, "warranty", r"without warranty of any kind(?: express or implied)?"),
    ("no-warranty", 2, "warranty", r"without any warranty without even the implied warranty"),
    ("no-warranty", 2, "merchantability", r"implied warranties of merchantability(?: and fitness for a particular purpose)?"),
    ("proprietary", 4, "proprietary", r"(?:is )?proprietary and confidential"),
    ("proprietary", 4, "confidential", r"confidential and proprietary"),
    ("proprietary", 4, "prohibited", r"(?:unauthorized|unauthorised) (?:copying|use|reproduction|distribution)(?: [^ ]+){0,8} is strictly prohibited"),
    ("proprietary", 4, "reproduced", r"no part of this (?:publication|document|book|work|site) may be reproduced"),
    ("proprietary", 3, "permission", r"without (?:the )?(?:prior |express )?(?:prior |express )?written permission"),
    ("proprietary", 3, "retrieval", r"stored in a retrieval system or transmitted"),
    ("proprietary", 3, "rewritten", r"may not be published broadcast rewritten or redistributed"),
    ("proprietary", 3, "unpublished", r"unpublished (?:proprietary )?(?:source code|work)"),
    ("proprietary", 3, "trade", r"contains trade secrets"),
    ("proprietary", 3, "reverse", r"(?:not|may not) reverse engineer decompile or disassemble"),
    ("eula", 4, "user", r"end user license agreement"),
    ("eula", 3, "bound", r"you agree to be bound by the terms of this (?:agreement|eula|licen[sc]e)"),
    ("non-commercial", 3, "commercial", r"(?:for )?non commercial use only"),
    ("non-commercial", 3, "noncommercial", r"(?:for )?noncommercial use only"),
    ("non-commercial", 3, "personal", r"for (?:your )?personal use only"),
    ("non-commercial", 3, "evaluation", r"for evaluation purposes only"),
    ("research", 3, "research", r"for (?:academic )?research (?:use|purposes) only"),
    ("research", 3, "educational", r"for educational (?:use|purposes) only"),
    ("shareware", 3, "shareware", r"this (?:program|software) is shareware"),
    ("freeware", 3, "freeware", r"(?:this (?:program|software) is|released as) freeware"),
    ("copyright", 1, "copyright", r"copyright (?:c )?(?:1[89][0-9][0-9]|20[0-9][0-9])"),
    ("copyright", 1, "copyrighted", r"copyrighted (?:material|work|content|by)"),
    ("some-rights", 3, "rights", r"some rights reserved"),
    ("dual", 3, "dual", r"dual licensed under"),
    ("dual", 3, "alternatively", r"alternatively this (?:software|file|work) may be (?:used|distributed) under the terms of"),
    ("dual", 3, "option", r"at your option under (?:either )?(?:of )?the"),
]
