"""Signatures of license texts, written by hand: sentences of the texts, notices, file headers, addresses, identifiers, exceptions.

They are expressions over normalised words (A-Z lower-cased, one space between words), so ``LICENSE-2.0`` reads
``license 2 0``. A priority says which of two nested detections stays: 95 a sentence that only one license has, 90 an
identifier, 85 a notice or an address, 60 a sentence that several share, 30 and less a hint. Fixed values: the wordings are those of
the licenses.
"""

#: label: (score, priority, expressions).
SIGNATURES: dict[str, list[tuple[float, int, list[str]]]] = {
    "mit": [
        (1.0, 95, [
            r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?",
            r"permission is hereby granted free of charge to any person obtaining a copy",
            r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies",
            r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software",
        ]),
        (0.9, 85, [r"opensource org licenses? mit", r"(?:under|see) the mit licen[cs]e(?: see)?", r"mit licen[cs]e (?:see|in) (?:the )?licen[cs]e(?: file| md| txt)?", r"choosealicense com licenses mit"]),
        (0.8, 60, [r"the software is provided as is without warranty of any kind express or implied", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"]),
    ],
    "apache": [
        (1.0, 95, [
            r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
            r"apache license version 2 0 january 2004",
            r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
            r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license",
            r"this product includes software developed by the apache software foundation",
        ]),
        (0.9, 85, [r"(?:https? )?(?:www )?apache org licenses license 2 0(?: html| txt)?", r"opensource org licenses? apache(?: 2 0)?", r"you may not use this file except in compliance with the license", r"see the license for the specific language governing permissions and limitations under the license", r"licensed to the apache software foundation asf under one or more contributor license agreements"]),
        (0.6, 60, [r"redistributions? in any form must retain the apache notices?", r"apache 2 0 licensed"]),
    ],
    "gpl": [
        (1.0, 95, [
            r"gnu general public license version [123](?: \d+)? (?:june|29 june|february) (?:1989|1991|2007)",
            r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
            r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change",
            r"you should have received a copy of the gnu general public license along with (?:this program|[^ ]+)",
            r"either version [123](?: \d+)? of the license or at your option any later version",
        ]),
        (0.9, 85, [r"this program is free software you can redistribute it and or modify it", r"(?:https? )?(?:www )?gnu org (?:licenses|copyleft) (?:old licenses )?gpl(?: [123] \d+| en)?(?: en)?(?: html| txt)?", r"opensource org licenses? gpl (?:2 0|3 0|license)", r"gnu general public license v[123](?: \d+)?(?: only| or later)?", r"under the gpl(?:v[123])?", r"gpl compatible"]),
        (0.8, 60, [r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", r"everyone is permitted to copy and distribute verbatim copies", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", r"free software foundation inc (?:51 franklin st(?:reet)?|59 temple place|675 mass ave)"]),
    ],
    "lgpl": [
        (1.0, 95, [
            r"gnu (?:lesser|library) general public license version [23](?: [01])? (?:february|june|29 june) (?:1991|1999|2007)",
            r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license",
            r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)",
            r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license",
        ]),
        (0.9, 85, [r"this library is free software you can redistribute it and or modify it", r"(?:https? )?(?:www )?gnu org (?:licenses|copyleft) (?:old licenses )?(?:lgpl|lesser)(?: [23] \d+)?(?: en)?(?: html| txt)?", r"opensource org licenses? lgpl (?:2 1|3 0|license)", r"under the lgpl(?:v[23])?"]),
    ],
    "agpl": [
        (1.0, 95, [
            r"gnu affero general public license version 3 19 november 2007",
            r"under the terms of the gnu affero general public license as published by the free software foundation",
            r"you should have received a copy of the gnu affero general public license along with (?:this program|[^ ]+)",
            r"if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network",
        ]),
        (0.9, 85, [r"(?:https? )?(?:www )?gnu org licenses agpl(?: 3 0)?(?: en)?(?: html| txt)?", r"opensource org licenses? agpl (?:v3|3 0)", r"under the agpl(?:v3)?"]),
    ],
    "bsd": [
        (1.0, 95, [
            r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?",
            r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
            r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ]),
        (0.9, 85, [r"n?or the names of (?:its|the|any|other|specific) contributors may be used to endorse or promote products", r"may be used to endorse or promote products derived from this software without specific prior written permission", r"opensource org licenses? bsd (?:2|3) clause", r"opensource org licenses? bsd license(?: php)?", r"use of this source code is governed by a bsd style license(?: that can be found in the license file)?", r"under (?:the |a )?(?:2|3|two|three) clause bsd", r"under the terms of the bsd license"]),
        (0.8, 60, [r"this software is provided by the (?:copyright holders and contributors|author|regents and contributors|author and contributors) as is", r"however caused and on any theory of liability whether in contract strict liability or tort"]),
    ],
    "bsd-4-clause": [
        (1.0, 95, [r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", r"this product includes software developed by the university of california berkeley and its contributors"]),
    ],
    "isc": [
        (1.0, 95, [r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee"]),
        (0.9, 85, [r"opensource org licenses? isc", r"the software is provided as is and the author disclaims all warranties with regard to this software"]),
    ],
    "mpl": [
        (1.0, 95, [
            r"this source code form is subject to the terms of the mozilla public license v 2 0",
            r"this source code form is subject to the terms of the mozilla public license",
            r"if a copy of the mpl was not distributed with this file you can obtain one at",
            r"the contents of this file are subject to the mozilla public license version 1 [01]",
            r"mozilla public license version 2 0 1 definitions",
        ]),
        (0.9, 85, [r"(?:https? )?(?:www )?mozilla org mpl(?: 2 0| 1 1)?", r"opensource org licenses? mpl 2 0", r"incompatible with secondary licenses as defined by the mozilla public license"]),
    ],
    "epl": [
        (1.0, 95, [r"eclipse public license v(?:ersion)? ?[12] 0", r"the accompanying program is provided under the terms of this eclipse public license", r"this program and the accompanying materials are made available under the terms of the eclipse public license"]),
        (0.9, 85, [r"(?:www )?eclipse org (?:legal|org documents) epl(?: v10| v20| 2 0)?(?: html)?", r"opensource org licenses? epl (?:1|2) 0", r"this program and the accompanying materials are made available under the terms"]),
    ],
    "edl": [(1.0, 95, [r"eclipse distribution license v ?1 0", r"(?:www )?eclipse org org documents edl v10"])],
    "cddl": [
        (1.0, 95, [r"common development and distribution license cddl version 1 [01]", r"the contents of this file are subject to the terms of (?:either the gnu general public license version 2 only gpl or )?the common development and distribution license"]),
        (0.9, 85, [r"opensource org licenses? cddl 1 0", r"glassfish (?:dev )?java net (?:public )?cddl gpl(?: 1 1)?(?: html)?"]),
    ],
    "cpl": [(1.0, 95, [r"common public license v(?:ersion)? ?1 0", r"the accompanying program is provided under the terms of this common public license"]), (0.9, 85, [r"opensource org licenses? cpl(?:1 0)?"])],
    "ipl": [(1.0, 95, [r"ibm public license version 1 0", r"the accompanying program is provided under the terms of this ibm public license"])],
    "apsl": [(1.0, 95, [r"apple public source license(?: ver(?:sion)?)? ?2 0", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"])],
    "zlib": [
        (1.0, 95, [r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"]),
        (0.9, 85, [r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", r"opensource org licenses? zlib"]),
    ],
    "libpng": [(1.0, 95, [r"png reference library license version 2", r"the png reference library is supplied as is"])],
    "artistic": [
        (1.0, 95, [r"the artistic license(?: 2 0)? preamble", r"this library is free software you can redistribute it and or modify it under the same terms as perl itself", r"under the same terms as (?:the )?perl(?: 5)?(?: programming language system)? itself"]),
        (0.9, 85, [r"opensource org licenses? artistic(?: license)? ?2 0", r"(?:www )?perlfoundation org artistic license 2 0"]),
    ],
    "boost": [(1.0, 95, [r"boost software license version 1 0 17 august 2003", r"boost software license version 1 0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"]), (0.9, 85, [r"(?:www )?boost org license 1 0 txt", r"see accompanying file license 1 0 txt or copy at"])],
    "unlicense": [(1.0, 95, [r"this is free and unencumbered software released into the public domain", r"anyone is free to copy modify publish use compile sell or distribute this software", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest"]), (0.9, 85, [r"unlicense org"])],
    "wtfpl": [(1.0, 95, [r"do what the fuck you want to public license", r"you just do what the fuck you want to"]), (0.9, 85, [r"sam zoy org wtfpl", r"www wtfpl net"])],
    "beerware": [(1.0, 95, [r"the beer ?ware license revision 42", r"if we meet some day and you think this stuff is worth it you can buy me a beer"])],
    "0bsd": [(1.0, 95, [r"zero clause bsd(?: license)?", r"bsd zero clause(?: license)?"]), (0.9, 90, [r"spdx license identifier 0bsd"])],
    "cc0": [
        (1.0, 95, [r"cc0 1 0 universal", r"creative commons legal code cc0", r"has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"]),
        (0.9, 85, [r"creativecommons org publicdomain zero 1 0", r"has waived all copyright and related or neighboring rights", r"cc0 public domain dedication"]),
    ],
    "cc-by": [
        (1.0, 95, [r"creative commons attribution [1234] [05] (?:international|generic|unported)(?: public)? license", r"this work is licensed under (?:a|the) creative commons attribution [1234] [05]"]),
        (0.9, 85, [r"creativecommons org licenses by [1234] [05]", r"licensed under cc by [1234] [05]"]),
    ],
    "cc-by-sa": [
        (1.0, 95, [r"creative commons attribution share ?alike [1234] [05] (?:international|generic|unported)(?: public)? license", r"this work is licensed under (?:a|the) creative commons attribution share ?alike", r"text is available under the creative commons attribution share ?alike license"]),
        (0.9, 85, [r"creativecommons org licenses by sa [1234] [05]", r"licensed under cc by sa [1234] [05]"]),
    ],
    "cc-by-nc": [
        (1.0, 95, [r"creative commons attribution non ?commercial [1234] [05] (?:international|generic|unported)(?: public)? license", r"this work is licensed under (?:a|the) creative commons attribution non ?commercial"]),
        (0.9, 85, [r"creativecommons org licenses by nc [1234] [05]", r"licensed under cc by nc [1234] [05]"]),
    ],
    "cc-by-nd": [(1.0, 95, [r"creative commons attribution no ?deriv(?:ative)?s [1234] [05]"]), (0.9, 85, [r"creativecommons org licenses by nd [1234] [05]"])],
    "cc-by-nc-sa": [(1.0, 95, [r"creative commons attribution non ?commercial share ?alike(?: [1234] [05])?"]), (0.9, 90, [r"creativecommons org licenses by nc sa [1234] [05]", r"cc by nc sa(?: [1234] [05])?"])],
    "cc-by-nc-nd": [(1.0, 95, [r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?"]), (0.9, 90, [r"creativecommons org licenses by nc nd [1234] [05]", r"cc by nc nd(?: [1234] [05])?"])],
    "cc-pd": [(0.9, 85, [r"creativecommons org (?:publicdomain mark|licenses publicdomain)", r"public domain mark 1 0"])],
    "gfdl": [
        (1.0, 95, [r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", r"gnu free documentation license version 1 [123]"]),
        (0.9, 85, [r"(?:www )?gnu org (?:licenses|copyleft) (?:old licenses )?fdl(?: 1 [123])?(?: html| txt)?", r"with no invariant sections no front cover texts and no back cover texts"]),
    ],
    "ofl": [(1.0, 95, [r"sil open font license version 1 [01]", r"this font software is licensed under the sil open font license", r"permission is hereby granted free of charge to any person obtaining a copy of the font software"]), (0.9, 85, [r"scripts sil org ofl", r"openfontlicense org"])],
    "psf": [(1.0, 95, [r"python software foundation license version 2", r"this license agreement is between the python software foundation psf and the individual or organization licensee", r"psf hereby grants licensee a nonexclusive royalty free world wide license"]), (0.9, 85, [r"opensource org licenses? python(?: 2 0)?"])],
    "ruby": [(1.0, 95, [r"you can redistribute it and or modify it under either the terms of the 2 clause bsdl", r"under the (?:same )?terms (?:of|as) ruby(?: s)? license", r"distributes under the same terms as ruby"])],
    "php": [(1.0, 95, [r"the php license version [23] \d+", r"this source file is subject to version [23] \d+ of the php license", r"this product includes php software freely available from"]), (0.9, 85, [r"(?:www )?php net license [23] \d+(?: txt)?"])],
    "postgresql": [(1.0, 95, [r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"]), (0.9, 85, [r"(?:www )?postgresql org about licence", r"opensource org licenses? postgresql"])],
    "openssl": [(1.0, 95, [r"this product includes software developed by the openssl project for use in the openssl toolkit", r"this product includes cryptographic software written by eric young"]), (0.9, 85, [r"openssl toolkit must not be used to endorse or promote products"])],
    "curl": [(0.9, 85, [r"this software is licensed as described in the file copying which you should have received as part of this distribution", r"curl haxx se docs copyright html", r"curl se docs copyright html"])],
    "ntp": [(0.9, 85, [r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"])],
    "hpnd": [(0.9, 85, [r"historical permission notice and disclaimer", r"not be used in advertising or publicity pertaining to distribution of the software"])],
    "x11": [(0.9, 85, [r"except as contained in this notice the name of the (?:x consortium|above copyright holders?|authors?) shall not be used in advertising", r"x window system is a trademark of x consortium inc"])],
    "eupl": [(1.0, 95, [r"european union public licen[cs]e v ?1 [0123]", r"licensed under the eupl(?: version)? 1 [0123]"]), (0.9, 85, [r"joinup ec europa eu (?:software page|collection) eupl"])],
    "cecill": [(1.0, 95, [r"this software is governed by the cecill(?: b| c)? license under french law", r"cecill free software license agreement"]), (0.9, 85, [r"(?:www )?cecill info"])],
    "osl": [(1.0, 95, [r"licensed under the open software license version [123] 0", r"this open software license the license applies to any original work of authorship"])],
    "afl": [(1.0, 95, [r"licensed under the academic free license version [123] [0-9]", r"this academic free license the license applies to any original work of authorship"])],
    "ms-pl": [(1.0, 95, [r"microsoft public license ms pl", r"this license governs use of the accompanying software if you use the software you accept this license"]), (0.9, 85, [r"opensource org licenses? ms pl"])],
    "ms-rl": [(1.0, 95, [r"microsoft reciprocal license ms rl"]), (0.9, 85, [r"opensource org licenses? ms rl"])],
    "upl": [(1.0, 95, [r"the universal permissive license upl version 1 0", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software"]), (0.9, 85, [r"oss oracle com licenses upl"])],
    "ncsa": [(1.0, 95, [r"university of illinois(?: at urbana champaign)?(?: slash)? ncsa open source license", r"to deal with the software without restriction including without limitation the rights"])],
    "odbl": [(1.0, 95, [r"open database license odbl", r"is made available under the open database license"]), (0.9, 85, [r"opendatacommons org licenses odbl(?: 1 0)?"])],
    "odc-by": [(1.0, 95, [r"open data commons attribution license"]), (0.9, 85, [r"opendatacommons org licenses by(?: 1 0)?"])],
    "pddl": [(1.0, 95, [r"open data commons public domain dedication and licen[cs]e"]), (0.9, 85, [r"opendatacommons org licenses pddl(?: 1 0)?"])],
    "sspl": [(1.0, 95, [r"server side public license version 1 october 16 2018", r"if you make the functionality of the program or a modified version available to third parties as a service"]), (0.9, 85, [r"(?:www )?mongodb com licensing server side public license"])],
    "busl": [(1.0, 95, [r"business source license 1 1", r"the business source license this document or the license is not an open source license", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"]), (0.9, 85, [r"mariadb com bsl11"])],
    "elastic": [(1.0, 95, [r"elastic license 2 0", r"you may not provide the software to third parties as a hosted or managed service"]), (0.9, 85, [r"(?:www )?elastic co licensing elastic license"])],
    "confluent": [(1.0, 95, [r"confluent community license(?: agreement)?(?: version 1 0)?", r"excluded purpose means making available any software as a service"])],
    "commons-clause": [(1.0, 95, [r"commons clause license condition v1 0", r"without limiting other conditions in the license the grant of rights under the license will not include(?: and the license does not grant to you)? the right to sell the software"])],
    "polyform": [(1.0, 95, [r"polyform (?:noncommercial|strict|shield|perimeter|internal use|small business|free trial) license 1 0 0"]), (0.9, 85, [r"polyformproject org licenses"])],
    "hippocratic": [(1.0, 95, [r"hippocratic license(?: version)? ?[123] [01]"]), (0.9, 85, [r"firstdonoharm dev"])],
    "openrail": [(1.0, 95, [r"creativeml open rail(?: |\+)?m(?: license)?", r"bigscience (?:open )?rail (?:m )?license", r"bigcode open ?rail m"]), (0.8, 60, [r"attachment a use restrictions you agree not to use the model or derivatives of the model"])],
    "llama": [(1.0, 95, [r"llama [23](?: [0-9])? community license agreement", r"built with (?:meta )?llama(?: [23])?"]), (0.9, 85, [r"if you use the llama materials to create train fine tune"])],
    "vim": [(1.0, 95, [r"there are no restrictions on distributing unmodified copies of vim except that they must include this license text"])],
    "tcl": [(1.0, 95, [r"the following terms apply to all files associated with the software unless explicitly disclaimed in individual files"])],
    "icu": [(1.0, 95, [r"icu license icu 1 8 1 and later", r"unicode data files or software without restriction including without limitation the rights"]), (0.9, 85, [r"(?:www )?unicode org (?:copyright|license) (?:html|txt)"])],
    "w3c": [(1.0, 95, [r"w3c software (?:and document )?notice and license", r"this work is (?:being )?provided by the copyright holders under the following license"]), (0.9, 85, [r"(?:www )?w3 org consortium legal"])],
    "json": [(1.0, 95, [r"the software shall be used for good not evil"])],
    "ijg": [(1.0, 95, [r"this software is based in part on the work of the independent jpeg group"])],
    "freetype": [(1.0, 95, [r"the freetype project license", r"the freetype project (?:www freetype org )?all rights reserved"])],
    "gsoap": [(1.0, 95, [r"gsoap public license version 1 3"])],
    "qpl": [(1.0, 95, [r"the q public license version 1 0", r"q public license"])],
    "nasa": [(1.0, 95, [r"nasa open source agreement version 1 3"])],
    "sgi": [(1.0, 95, [r"sgi free software license b version 2 0"])],
    "vovida": [(1.0, 95, [r"vovida software license v ?1 0"])],
    "zpl": [(1.0, 95, [r"zope public license zpl(?: version)? ?2 [01]"])],
    "mulan": [(1.0, 95, [r"mulan (?:psl|permissive software license) ?v(?:ersion )?[12]"]), (0.9, 85, [r"license coscl org cn mulanpsl2"])],
    "blueoak": [(1.0, 95, [r"blue oak model license(?: version)? ?1 0 0"])],
    "parity": [(1.0, 95, [r"the parity public license [67] 0 0"])],
    "etalab": [(1.0, 95, [r"licence ouverte(?: open licence)?(?: version)? ?[12] 0"]), (0.9, 85, [r"(?:www )?etalab gouv fr licence ouverte"])],
    "ogl-uk": [(1.0, 95, [r"open government licence v[123] 0"]), (0.9, 85, [r"nationalarchives gov uk doc open government licence"])],
    "osm": [(0.9, 85, [r"openstreetmap contributors"])],
    "gpl-exception": [
        (0.9, 90, [
            r"classpath exception(?: to the gpl| 2 0)?",
            r"linking this library statically or dynamically with other modules is making a combined work based on this library",
            r"gcc runtime library exception(?: version 3 1)?",
            r"as a special exception (?:if you link|the copyright holders|to the gnu general public license|the free software foundation)",
            r"with the special exception that linking with openssl is allowed",
            r"font embedding exception",
            r"llvm exception(?:s)?",
            r"autoconf exception(?: 3 0)?",
            r"bison exception(?: 2 2)?",
            r"linux syscall note",
            r"universal foss exception version 1 0",
            r"qt gpl exception 1 0",
        ]),
    ],
    "dual": [(0.5, 25, [r"dual licensed(?: under)?", r"under (?:either|any) of the following licenses", r"at your option under either of", r"you may choose (?:either|one of) the(?:se| following)? licenses?"])],
    "all-rights-reserved": [(0.3, 10, [r"all rights reserved", r"alle rechte vorbehalten", r"tous droits réservés", r"todos los derechos reservados"])],
    "public-domain": [(0.6, 30, [r"(?:dedicated to|released into|placed (?:in|into)|donated to|in) the public domain", r"this (?:file|code|software|work) is (?:in the )?public domain", r"no copyright is claimed"])],
    "proprietary": [(0.7, 30, [r"proprietary and confidential", r"this software is the confidential and proprietary information of", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited", r"end user license agreement", r"you may not reverse engineer decompile or disassemble the software", r"licensed not sold", r"may not be reproduced (?:or distributed )?without (?:the )?(?:prior )?written permission", r"trade secrets? of"])],
    "source-available": [(0.5, 30, [r"source available license", r"for non commercial use only", r"for academic (?:and research )?use only", r"for evaluation purposes only", r"for internal use only"])],
    "copyleft": [(0.4, 20, [r"copyleft", r"share alike", r"viral license"])],
}

#: Identifiers as they follow ``SPDX-License-Identifier:``, in normalised words, by label.
SPDX = {
    "mit": ["mit", "mit 0", "mit modern variant"], "apache": ["apache 1 0", "apache 1 1", "apache 2 0"], "gpl": ["gpl 1 0", "gpl 2 0", "gpl 3 0"], "lgpl": ["lgpl 2 0", "lgpl 2 1", "lgpl 3 0"], "agpl": ["agpl 1 0", "agpl 3 0"],
    "bsd": ["bsd 1 clause", "bsd 2 clause", "bsd 2 clause patent", "bsd 3 clause", "bsd 3 clause clear", "bsd source code"], "bsd-4-clause": ["bsd 4 clause", "bsd 4 clause uc"], "isc": ["isc"], "mpl": ["mpl 1 0", "mpl 1 1", "mpl 2 0"],
    "epl": ["epl 1 0", "epl 2 0"], "cddl": ["cddl 1 0", "cddl 1 1"], "zlib": ["zlib"], "artistic": ["artistic 1 0", "artistic 2 0"], "boost": ["bsl 1 0"], "unlicense": ["unlicense"], "wtfpl": ["wtfpl"], "cc0": ["cc0 1 0"],
    "cc-by": ["cc by 3 0", "cc by 4 0"], "cc-by-sa": ["cc by sa 3 0", "cc by sa 4 0"], "cc-by-nc": ["cc by nc 4 0"], "cc-by-nd": ["cc by nd 4 0"], "ofl": ["ofl 1 1"], "psf": ["psf 2 0", "python 2 0"], "ruby": ["ruby"], "php": ["php 3 01"],
    "postgresql": ["postgresql"], "openssl": ["openssl"], "eupl": ["eupl 1 1", "eupl 1 2"], "osl": ["osl 3 0"], "afl": ["afl 3 0"], "ms-pl": ["ms pl"], "ms-rl": ["ms rl"], "upl": ["upl 1 0"], "ncsa": ["ncsa"], "odbl": ["odbl 1 0"],
    "sspl": ["sspl 1 0"], "busl": ["busl 1 1"], "elastic": ["elastic 2 0"], "cecill": ["cecill 2 1", "cecill b", "cecill c"], "blueoak": ["blueoak 1 0 0"], "mulan": ["mulanpsl 2 0"], "0bsd": ["0bsd"], "x11": ["x11"], "hpnd": ["hpnd"], "ntp": ["ntp"],
    "curl": ["curl"], "vim": ["vim"], "icu": ["icu", "unicode 3 0"], "w3c": ["w3c"], "json": ["json"],
}
