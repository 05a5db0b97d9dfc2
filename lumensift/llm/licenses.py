"""License scans: ordered signature rules behind a keyword prefilter.

A text's words, lower-cased, are joined by single spaces; hundreds of ordered rules, each a regular expression with a
keyword of its own, run over that string. A rule is tried only if its keyword occurs (one Aho-Corasick pass finds all
keywords). Where detections overlap, one that lies wholly inside another of the same or a better priority is dropped;
the base phrases are never dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from lumensift.llm.common import only, per_row
from lumensift.llm.token_counts import _arrow

#: Bytes that separate words, after A-Z are lowered: all ASCII but digits and a-z.
_SEPARATE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Rule:
    """Rules of a lower priority number win. strength is how sure a detection is, 0 to 1."""

    label: str
    pattern: str
    keyword: str
    priority: int
    strength: float


_LICENSE = r"licen[sc]e"
_LICENSED = r"licen[sc]ed"
_V = r"(?: version| v| ver)?"
# label, names as regexes, keyword. A version must not be followed by another number that would change it.
_NAMED: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("mit", ("mit", "mit x11", "x11 mit", "expat"), "mit"),
    ("mit-0", ("mit 0", "mit no attribution"), "mit"),
    ("x11", ("x11",), "x11"),
    ("apache-2", (rf"apache(?: software)?(?: {_LICENSE})?{_V} 2(?: 0)?", "apache 2", r"apache 2 0", "asl 2 0"), "a"),
    ("apache-1.1", (rf"apache(?: software)?(?: {_LICENSE})?{_V} 1 1",), "apache"),
    ("apache-1.0", (rf"apache(?: software)?(?: {_LICENSE})?{_V} 1 0",), "apache"),
    ("bsd-2", ("bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd"), "bsd"),
    ("bsd-3", ("bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd"), "bsd"),
    ("bsd-4", ("bsd 4 clause", "4 clause bsd", "original bsd", "old bsd"), "bsd"),
    ("bsd-0", ("0bsd", "zero clause bsd", "bsd zero clause"), "bsd"),
    ("isc", ("isc", "internet systems consortium"), "is"),
    ("gpl-1", (rf"gnu (?:general public {_LICENSE}|gpl){_V} 1", rf"gpl{_V} ?1"), "g"),
    ("gpl-2", (rf"gnu (?:general public {_LICENSE}|gpl){_V} 2", rf"gpl{_V} ?2"), "g"),
    ("gpl-3", (rf"gnu (?:general public {_LICENSE}|gpl){_V} 3", rf"gpl{_V} ?3"), "g"),
    ("lgpl-2", (rf"gnu (?:library|lesser) general public {_LICENSE}{_V} 2(?! 1)", rf"lgpl{_V} ?2(?! 1)"), "g"),
    ("lgpl-2.1", (rf"gnu (?:library|lesser) general public {_LICENSE}{_V} 2 1", rf"lgpl{_V} ?2 1"), "g"),
    ("lgpl-3", (rf"gnu (?:library|lesser) general public {_LICENSE}{_V} 3", rf"lgpl{_V} ?3"), "g"),
    ("agpl-3", (rf"gnu affero general public {_LICENSE}{_V} 3", rf"agpl{_V} ?3", "affero gpl 3"), "g"),
    ("mpl-1.0", (rf"mozilla public {_LICENSE}{_V} 1 0", rf"mpl{_V} 1 0"), "m"),
    ("mpl-1.1", (rf"mozilla public {_LICENSE}{_V} 1 1", rf"mpl{_V} 1 1"), "m"),
    ("mpl-2", (rf"mozilla public {_LICENSE}{_V} 2(?: 0)?", rf"mpl{_V} 2(?: 0)?"), "m"),
    ("epl-1", (rf"eclipse public {_LICENSE}{_V} 1(?: 0)?", rf"epl{_V} 1(?: 0)?"), "e"),
    ("epl-2", (rf"eclipse public {_LICENSE}{_V} 2(?: 0)?", rf"epl{_V} 2(?: 0)?"), "e"),
    ("eupl-1.2", (rf"european union public {_LICENSE}{_V} 1 2", rf"eupl{_V} 1 2"), "eu"),
    ("eupl-1.1", (rf"european union public {_LICENSE}{_V} 1 1", rf"eupl{_V} 1 1"), "eu"),
    ("cddl-1.0", (rf"common development and distribution {_LICENSE}{_V} 1 0", rf"cddl{_V} 1 0"), "c"),
    ("cddl-1.1", (rf"common development and distribution {_LICENSE}{_V} 1 1", rf"cddl{_V} 1 1"), "c"),
    ("cpl-1", (rf"common public {_LICENSE}{_V} 1(?: 0)?", rf"cpl{_V} 1(?: 0)?"), "c"),
    ("ms-pl", (rf"microsoft public {_LICENSE}", "ms pl"), "m"),
    ("ms-rl", (rf"microsoft reciprocal {_LICENSE}", "ms rl"), "m"),
    ("boost-1", (rf"boost software {_LICENSE}{_V}(?: 1(?: 0)?)?", "bsl 1 0"), "b"),
    ("zlib", ("zlib", "zlib libpng"), "zlib"),
    ("libpng", ("libpng",), "libpng"),
    ("artistic-1", (rf"artistic {_LICENSE}{_V} 1(?: 0)?",), "artistic"),
    ("artistic-2", (rf"artistic {_LICENSE}{_V} 2(?: 0)?",), "artistic"),
    ("unlicense", ("unlicense", "the unlicense"), "unlicense"),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public"), "w"),
    ("postgresql", (rf"postgresql(?: database)? {_LICENSE}",), "postgresql"),
    ("python-2", (rf"python software foundation {_LICENSE}{_V}(?: 2)?", rf"psf {_LICENSE}"), "p"),
    ("php-3", (rf"php {_LICENSE}{_V} 3(?: 0| 01)?",), "php"),
    ("ruby", (rf"ruby {_LICENSE}",), "ruby"),
    ("perl", ("same terms as perl itself", rf"perl {_LICENSE}"), "perl"),
    ("openssl", (rf"openssl {_LICENSE}",), "openssl"),
    ("curl", (rf"curl {_LICENSE}",), "curl"),
    ("ofl-1.1", (rf"(?:sil )?open font {_LICENSE}{_V}(?: 1 1)?", "ofl 1 1"), "o"),
    ("odbl-1", (rf"open (?:data commons open )?database {_LICENSE}{_V}(?: 1(?: 0)?)?", rf"odbl{_V}(?: 1(?: 0)?)?"), "o"),
    ("odc-by", (rf"open data commons attribution {_LICENSE}", "odc by"), "od"),
    ("pddl", (rf"public domain dedication and {_LICENSE}", "pddl"), "p"),
    ("ogl-uk-3", (rf"open government {_LICENSE}{_V} 3(?: 0)?",), "government"),
    ("ogl-uk", (rf"open government {_LICENSE}",), "government"),
    ("ecl-2", (rf"educational community {_LICENSE}{_V} 2(?: 0)?",), "educational"),
    ("afl-3", (rf"academic free {_LICENSE}{_V} 3(?: 0)?",), "academic"),
    ("osl-3", (rf"open software {_LICENSE}{_V} 3(?: 0)?",), "software"),
    ("nposl-3", (rf"non profit open software {_LICENSE}{_V} 3(?: 0)?",), "profit"),
    ("upl-1", (rf"universal permissive {_LICENSE}",), "permissive"),
    ("ncsa", (rf"university of illinois ncsa open source {_LICENSE}", rf"ncsa {_LICENSE}"), "ncsa"),
    ("bsl-1.1", (rf"business source {_LICENSE}{_V}(?: 1 1)?",), "business"),
    ("sspl-1", (rf"server side public {_LICENSE}", "sspl"), "s"),
    ("elastic-2", (rf"elastic {_LICENSE}{_V}(?: 2(?: 0)?)?",), "elastic"),
    ("gfdl-1.3", (rf"gnu free documentation {_LICENSE}{_V} 1 3", "gfdl 1 3"), "g"),
    ("gfdl-1.2", (rf"gnu free documentation {_LICENSE}{_V} 1 2", "gfdl 1 2"), "g"),
    ("llama", (r"llama \d(?: \d)? community",), "llama"),
    ("openrail", ("openrail", "open rail m", "creativeml open rail m", "creativeml openrail"), "rail"),
    ("mulan-2", (rf"mulan (?:psl|permissive software {_LICENSE}){_V} ?2",), "mulan"),
    ("vim", (rf"vim {_LICENSE}",), "vim"),
    ("beerware", (rf"beer ?ware(?: {_LICENSE})?",), "beer"),
    ("jsonlicense", (rf"json {_LICENSE}", "shall be used for good not evil"), "s"),
)
_GENERIC: tuple[tuple[str, str, str], ...] = (
    ("gpl", rf"gnu general public {_LICENSE}", "gnu"),
    ("gpl", r"gnu gpl", "gnu"),
    ("lgpl", rf"gnu (?:library|lesser) general public {_LICENSE}", "gnu"),
    ("agpl", rf"gnu affero general public {_LICENSE}", "gnu"),
    ("mpl", rf"mozilla public {_LICENSE}", "mozilla"),
    ("epl", rf"eclipse public {_LICENSE}", "eclipse"),
    ("cddl", rf"common development and distribution {_LICENSE}", "common"),
    ("apache", rf"apache (?:software )?{_LICENSE}", "apache"),
    ("bsd", rf"bsd (?:style )?{_LICENSE}", "bsd"),
    ("gfdl", rf"gnu free documentation {_LICENSE}", "gnu"),
    ("artistic", rf"artistic {_LICENSE}", "artistic"),
    ("creative-commons", rf"creative commons(?: \w+){{0,4}} {_LICENSE}", "creative"),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", "public domain"),
    ("public-domain", r"no copyright restrictions", "copyright"),
    ("all-rights-reserved", r"all rights reserved", "rights reserved"),
    ("all-rights-reserved", r"alle rechte vorbehalten", "rechte vorbehalten"),
    ("all-rights-reserved", r"tous droits réservés", "droits réservés"),
    ("all-rights-reserved", r"todos los derechos reservados", "derechos reservados"),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright"),
    ("proprietary", r"proprietary and confidential", "proprietary"),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|distribution)", "unauthori"),
    ("non-commercial", r"(?:for )?non ?commercial (?:use|purposes) only", "commercial"),
    ("no-derivatives", r"no derivative works", "derivative"),
)
_SIGNATURES: tuple[tuple[str, str, str], ...] = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("bsd-3", r"neither the name of (?:\w+ ){1,12}nor the names of its contributors", "neither the name"),
    ("bsd-4", r"all advertising materials mentioning features or use of this software", "advertising materials"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors", "in no event will the authors"),
    ("apache-2", r"www apache org licenses license 2 0", "apache org"),
    ("gpl", r"www gnu org licenses gpl", "gnu org"),
    ("gpl", r"free software you can redistribute it and or modify it under the terms of the gnu general public", "redistribute it and or modify"),
    ("lgpl", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public", "redistribute it and or modify"),
    ("agpl", r"redistribute it and or modify it under the terms of the gnu affero general public", "redistribute it and or modify"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public", "source code form"),
    ("boost-1", r"www boost org license 1 0", "boost org"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", "creativecommons"),
    ("ofl-1.1", r"scripts sil org ofl", "sil org"),
    ("mit", r"above copyright notice and this permission notice shall be included in all copies or substantial portions", "substantial portions"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "claim damages or other liability"),
    ("x11", r"the name of the x consortium shall not be used in advertising", "x consortium"),
    ("x11", r"except as contained in this notice the names? of (?:\w+ ){1,10}shall not be used in advertising", "contained in this notice"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", "and its documentation"),
    ("isc", r"the software is provided as is and the author disclaims all warranties", "author disclaims all warranties"),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of source"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary"),
    ("bsd", r"this software is provided by (?:the )?(?:\w+ ){1,6}as is and any express or implied warranties", "and any express or implied"),
    ("bsd-3", r"used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote"),
    ("bsd-patent", r"each copyright holder and contributor hereby grants to those receiving rights under this license", "each copyright holder and"),
    ("apache-2", r"you may not use this file except in compliance with the license", "except in compliance"),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license", "agreed to in writing"),
    ("apache-2", r"grant of patent license subject to the terms and conditions of this license each contributor", "grant of patent license"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "developed by the apache"),
    ("apache-1.1", r"products derived from this software may not be called apache", "may not be called apache"),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", "in the hope that it"),
    ("gpl", r"you should have received a copy of the gnu general public", "should have received"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public", "should have received"),
    ("agpl", r"you should have received a copy of the gnu affero general public", "should have received"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document", "verbatim copies"),
    ("gpl-3", r"the gnu general public license is a free copyleft license for software and other kinds of works", "free copyleft"),
    ("gpl-2", r"the licenses for most software are designed to take away your freedom to share and change it", "your freedom to share"),
    ("agpl-3", r"remote network interaction use with the gnu general public license", "remote network interaction"),
    ("lgpl-2.1", r"the lesser general public license applies to some specially designated software", "specially designated"),
    ("gpl-2", r"gpl 2 0 (?:only|or later)", "gpl 2 0"),
    ("gpl-3", r"gpl 3 0 (?:only|or later)", "gpl 3 0"),
    ("lgpl-2.1", r"lgpl 2 1 (?:only|or later)", "lgpl 2 1"),
    ("lgpl-3", r"lgpl 3 0 (?:only|or later)", "lgpl 3 0"),
    ("agpl-3", r"agpl 3 0 (?:only|or later)", "agpl 3 0"),
    ("classpath-exception", r"linking this (?:library|software) statically or dynamically with other modules is making a combined work", "statically or dynamically"),
    ("gcc-exception", r"gcc runtime library exception", "gcc runtime"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation", "modify this document"),
    ("mpl-2", r"if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "contents of this file"),
    ("mpl-2", r"this source code form is incompatible with secondary licenses", "incompatible with secondary"),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license", "contents of this file"),
    ("epl-1", r"the accompanying program is provided under the terms of this eclipse public license", "accompanying program"),
    ("epl-1", r"accompanying materials are made available under the terms of the eclipse public license v 1 0", "accompanying materials"),
    ("epl-2", r"accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0", "accompanying materials"),
    ("cpl-1", r"the accompanying program is provided under the terms of this common public license", "accompanying program"),
    ("ipl-1", r"the accompanying program is provided under the terms of this ibm public license", "ibm public"),
    ("eupl-1.2", r"this european union public licence the eupl applies to the work", "european union public"),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license", "governs use of"),
    ("artistic-2", r"this license establishes the terms under which a given free software package may be copied", "given free software"),
    ("artistic-1", r"the intent of this document is to state the conditions under which a package may be copied", "intent of this document"),
    ("perl", r"redistribute it and or modify it under the same terms as perl", "same terms as perl"),
    ("boost-1", r"any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "person or organization"),
    ("zlib", r"the origin of this software must not be misrepresented", "must not be misrepresented"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source versions"),
    ("libpng", r"the png reference library is supplied as is", "png reference library"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim or modified"),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain", "with this deed"),
    ("cc0-1.0", r"waived all copyright and related or neighbou?ring rights", "related or neighbo"),
    ("public-domain", r"this (?:work|file|code|program|software|document) is in the public domain", "public domain"),
    ("public-domain", r"the author disclaims copyright to this source code", "disclaims copyright"),
    ("public-domain", r"i hereby (?:release|dedicate|place) this (?:\w+ ){1,6}(?:in|into|to) the public domain", "i hereby"),
    ("blessing", r"may you do good and not evil may you find forgiveness for yourself and forgive others", "good and not evil"),
    ("php-3", r"this product includes php software freely available from", "php software"),
    ("python-2", r"psf is making python available to licensee on an as is basis", "making python available"),
    ("postgresql", r"this software and its documentation for any purpose without fee and without a written agreement", "without a written agreement"),
    ("openssl", r"this product includes software developed by the openssl project", "openssl project"),
    ("ssleay", r"this product includes cryptographic software written by", "cryptographic software"),
    ("curl", r"modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "with or without fee"),
    ("ofl-1.1", r"this font software is licensed under the sil open font", "font software"),
    ("ofl-1.1", r"copyright (?:\w+ ){1,20}with reserved font name", "reserved font name"),
    ("odbl-1", r"this (?:\w+ ){1,6}is made available under the open database license", "open database"),
    ("ncsa", r"neither the names? of (?:\w+ ){1,16}nor the names of its contributors may be used to endorse or promote products derived from this software", "neither the name"),
    ("icu", r"copyright (?:c )?(?:\d{4} )+international business machines corporation and others", "international business"),
    ("unicode", r"any person obtaining a copy of the unicode data files and any associated documentation", "unicode data files"),
    ("unicode", r"see the terms of use at www unicode org copyright", "unicode org"),
    ("w3c", r"w3c software (?:notice and|and document(?: notice and)?) license", "w3c software"),
    ("w3c", r"by obtaining using and or copying this work you the licensee agree", "copying this work"),
    ("elastic-2", r"you may not provide the software to third parties as a hosted or managed service", "hosted or managed"),
    ("bsl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "non production use"),
    ("bsl-1.1", r"change date (?:\w+ ){1,6}change license", "change license"),
    ("sspl-1", r"make the functionality of the program or a modified version available to third parties as a service", "functionality of the program"),
    ("llama", r"is licensed under the llama \d(?: \d)? community license", "llama"),
    ("openrail", r"use based restrictions as referenced in paragraph 5", "use based restrictions"),
    ("openrail", r"bigscience (?:rail|open ?rail m) license", "bigscience"),
    ("openrail", r"responsible ai license", "responsible ai"),
    ("gemma", r"gemma is provided under and subject to the gemma terms of use", "gemma terms"),
    ("commons-clause", r"the license does not grant to you the right to sell the software", "right to sell"),
    ("commons-clause", r"commons clause license condition", "commons clause"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial) license", "polyform"),
    ("prosperity", r"prosperity public license", "prosperity"),
    ("parity", r"parity public license", "parity"),
    ("hippocratic", r"hippocratic license", "hippocratic"),
    ("anti-996", r"anti 996 license", "anti 996"),
    ("cecill", r"(?:cecill(?: [abc])?|cea cnrs inria logiciel libre) (?:free software )?licen[sc]e", "licen"),
    ("apsl-2", r"apple public source license", "apple public"),
    ("rpl", r"reciprocal public license", "reciprocal public"),
    ("qpl", r"(?:the q|trolltech q) public license", "q public"),
    ("sissl", r"sun industry standards source license", "sun industry"),
    ("oracle-bcl", r"binary code license agreement", "binary code"),
    ("watcom", r"open watcom public license", "watcom"),
    ("naumen", r"naumen public license", "naumen"),
    ("zpl", r"zope public license", "zope"),
    ("xfree86", r"xfree86 (?:project )?license", "xfree86"),
    ("fair", r"usage of the works is permitted provided that this instrument is retained with the works", "usage of the works"),
    ("etalab-2", r"licence ouverte(?: open licence)?(?: version| v)? 2 0", "licence ouverte"),
    ("dl-de-by-2", r"datenlizenz deutschland namensnennung(?: version)? 2 0", "datenlizenz"),
    ("dl-de-zero-2", r"datenlizenz deutschland zero(?: version)? 2 0", "datenlizenz"),
    ("nlod", r"norwegian licence for open government data", "norwegian licence"),
    ("cdla-permissive", r"community data license agreement permissive", "community data"),
    ("cdla-sharing", r"community data license agreement sharing", "community data"),
    ("cc-by", r"lizenziert unter (?:einer |der )?creative commons namensnennung", "lizenziert unter"),
    ("creative-commons", r"(?:mis à disposition selon les termes de la|bajo una) licen(?:ce|cia) (?:de )?creative commons", "creative commons"),
)
_CC = tuple(("by" + "".join(f"-{x}" for x in parts), parts) for parts in ((), ("sa",), ("nd",), ("nc",), ("nc", "sa"), ("nc", "nd")))
_CC_WORDS = {"sa": r"share ?alike", "nd": r"no ?deriv(?:ative)?s?(?: works)?", "nc": r"non ?commercial"}
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


def _rules() -> tuple[Rule, ...]:
    """In order of priority: full-text signatures, exact versions, licenses by name in a licensing phrase, generic names."""
    out = [Rule(label, p, k, 0, 1.0) for label, p, k in _SIGNATURES]
    for label, parts in _CC:
        short = " ".join(("by", *parts))
        words = " ".join(("attribution", *(_CC_WORDS[x] for x in parts)))
        path = " ".join(("licenses", "by", *parts))
        more = "" if len(parts) == 2 or parts in (("sa",), ("nd",)) else r"(?! (?:sa|nd|nc|share|no ?deriv|non))"
        for v in _CC_VERSIONS:
            name = f"cc-{label}-{v.replace(' ', '.')}"
            out += [
                Rule(name, rf"\b(?:cc|creative commons) {short} {v}\b", f"{short} {v}", 1, 1.0),
                Rule(name, rf"\bcreative commons {words} (?:international |unported )?{v}\b", "creative", 1, 1.0),
                Rule(name, rf"\bcreativecommons org {path} {v}\b", "creativecommons", 1, 1.0),
            ]
        out += [
            Rule(f"cc-{label}", rf"\b(?:cc|creative commons) {short}\b{more}", f" {short}", 3, 0.8),
            Rule(f"cc-{label}", rf"\bcreative commons {words}\b{more}", "creative", 3, 0.8),
        ]
    out += [Rule("cc0-1.0", r"\bcc0(?: 1 0)?\b", "cc0", 1, 1.0), Rule("cc0-1.0", r"\bcreative commons zero\b", "creative", 1, 1.0)]
    for label, names, keyword in _NAMED:
        # An SPDX tag, "licensed under the X", "under the X license", "X license" and "license: X".
        for name in (n.replace(_V + " ?", "@").replace(_V + " ", _V + " v?").replace("@", _V + " ?v?") for n in names):
            key = max(re.findall(r"[a-z0-9]{3,}", re.sub(r"\(\?[:!][^()]*\)\??|\[[^]]*\]|\\.", " ", name)) or [keyword], key=len)
            out += [
                Rule(label, rf"\bspdx license identifier {name}\b", "spdx", 1, 1.0),
                Rule(label, rf"\b(?:{_LICENSED}|released|distributed|available|covered|provided)(?: to you)? (?:under|by)(?: the)?(?: terms of the)? {name}\b(?: {_LICENSE})?", key, 1, 1.0),
                Rule(label, rf"\bunder(?: the)?(?: terms of the)? {name}(?: {_LICENSE})?\b" if _LICENSE in name else rf"\bunder(?: the)?(?: terms of the)? {name} {_LICENSE}\b", key, 2, 0.9),
                Rule(label, rf"\b{name}\b" if _LICENSE in name else rf"\b{name} {_LICENSE}\b", key, 2, 0.9),
                Rule(label, rf"\b{_LICENSE}(?: is)? {name}\b", key, 3, 0.7),
            ]
    out += [Rule(label, rf"\b{p}\b", k, 4, 0.5) for label, p, k in _GENERIC]
    return tuple(out)


RULES = _rules()


def scanner(rules: tuple[Rule, ...] = RULES, base: tuple[tuple[str, str], ...] = BASE) -> Callable[[str | None], tuple]:
    """text -> (n_words, n_base, first_word, last_word, base_labels, labels, score, [(label, first word, word after the last)])."""
    import ahocorasick

    by_keyword: dict[str, list[tuple[int, Rule, re.Pattern]]] = {}
    for k, r in enumerate(rules):
        by_keyword.setdefault(r.keyword, []).append((k, r, re.compile(r.pattern)))
    gate = ahocorasick.Automaton()
    for keyword in by_keyword:
        gate.add_word(keyword, keyword)
    gate.make_automaton()
    # Cheap gate before the automaton: every keyword of the rules is met only in texts with one of these stems.
    phrases = [(b" " + p.encode() + b" ", label) for p, label in base]

    def scan(text: str | None) -> tuple:
        words = (text or "").encode("utf-8", "replace").translate(_SEPARATE).split()
        line = b" ".join([b"", *words, b""])
        starts: list[int] = []
        labels: set[str] = set()
        for phrase, label in phrases:
            at, before, number = line.find(phrase), 0, 0
            while at >= 0:
                number += line.count(b" ", before, at)
                starts.append(number)
                labels.add(label)
                before, at = at, line.find(phrase, at + 1)
        found, score = _detect(line), 1.0 if starts else 0.0
        all_labels = labels | {label for label, *_ in found}
        score = max([score, *(s for *_, s in found)])
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(all_labels)), score,
            [(label, a, b) for label, a, b, _ in found],
        )

    def _detect(line: bytes) -> list[tuple[str, int, int, float]]:
        if not any(stem in line for stem in STEMS):
            return []
        s = line.decode()
        hits = []
        for keyword in {k for _, k in gate.iter(s)}:
            for k, r, pattern in by_keyword[keyword]:
                hits += [(r.priority, k, m.start(), m.end(), r) for m in pattern.finditer(s)]
        if not hits:
            return []
        # Longer first: a detection inside one that stays, of its priority or better, goes. Sweep with the furthest end per priority.
        hits.sort(key=lambda h: (h[2], -h[3], h[0], h[1]))
        kept, reach = [], [-1] * (1 + max(h[0] for h in hits))
        for p, _, a, b, r in hits:
            if max(reach[: p + 1]) >= b:
                continue
            kept.append((r.label, a, b, r.strength))
            reach[p] = max(reach[p], b)
        # One pass over the line gives the number of spaces before each offset.
        spaces, number, before = {}, 0, 0
        for at in sorted({x for _, a, b, _ in kept for x in (a + (s[a] == " "), b)}):
            number += s.count(" ", before, at)
            spaces[at] = number
            before = at
        return [(label, spaces[a + (s[a] == " ")] - 1, spaces[b], strength) for label, a, b, strength in kept]

    return scan


#: No rule can match a text without one of these.
STEMS = tuple(
    x.encode()
    for x in (
        "licen", "spdx", "permission", "redistrib", "neither the name", "advertising", "software", "apache", "gnu ", "source code", "boost", "unencumbered", "creative",
        "sil org", "cc", "public domain", "copyright", "rights reserved", "rechte vorbehalten", "droits réservés", "derechos reservados", "proprietary",
        "unauthori", "commercial", "derivative", "released", "distributed", "available", "covered", "provided", "gpl", "mpl", "epl", "eupl", "cddl", "cpl",
        "ms pl", "ms rl", "bsl", "wtfpl", "do what the", "perl", "ofl", "odbl", "odc", "pddl", "sspl", "gfdl", "llama", "rail", "mulan", "beer", "not evil",
        "asl 2", "university of", "ncsa", "intent of this", "png reference", "unicode data", "use based", "datenlizenz", "combined work",
    )
)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of the base phrases, first_word and last_word are their smallest and largest start (null if
    none); labels holds the base labels and those of the rules; score is the strength of the surest detection, 1 for a
    base phrase, 0 for none; spans lists the rules' detections as (label, first word, word after the last). A null text
    counts as empty. Texts are scanned whole. Ids may be null or repeat; other columns play no part.
    """
    id_type = df.schema[id_col].dataType
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([
        ("i", _arrow(id_type)), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span)),
    ])
    ddl = (
        f"__id {id_type.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first:bigint,end:bigint>>"
    )

    def make() -> Callable:
        scan = scanner()

        def row(i, text):
            *out, spans = scan(text)
            return (i, *out, [{"label": a, "first": b, "end": c} for a, b, c in spans])

        return row

    return per_row(only(df, __id=id_col, __text=text_col), ["__id", "__text"], schema, ddl, make).withColumnRenamed("__id", id_col)
