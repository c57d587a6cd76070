"""License scans by ordered signature rules. DataFrame functions only.

Texts become words (A-Z lower-cased), joined by single spaces. Each rule has a keyword, one or more whole words
that all its matches hold: a text without a rule's keyword is not searched for it, and a text that holds none
of the keywords' rarest words is not looked at. Every match is an interval with a priority; one inside another
of no lower priority is suppressed, so "apache license version 2 0" leaves one label, not two. All of it is
one expression per row: no shuffle and no join, and hot sources cost nothing extra. The cost is linear in a
text's matches but for their sort: places come from sums over blocks of matches, suppression from one sweep.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Label; keyword; name as a regex over words; versions.
FAMILIES = (
    ("agpl", "affero", "(?:gnu )?affero (?:general )?public licen[cs]e", ("1", "2", "3")),
    ("agpl", "agpl", "(?:gnu )?agpl", ("1", "2", "3")),
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e", ("1", "2", "3")),
    ("gpl", "gpl", "(?:gnu )?gpl", ("1", "2", "3")),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public licen[cs]e", ("2", "2 1", "3")),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ("2", "2 1", "3")),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
    ("gfdl", "gfdl", "(?:gnu )?gfdl", ("1 1", "1 2", "1 3")),
    ("apache", "apache", "apache(?: software)? licen[cs]e", ("1 0", "1 1", "2 0")),
    ("apache", "asl", "asl", ("1 1", "2 0")),
    ("mit", "mit license", "(?:the )?mit license", ()),
    ("mit", "expat", "expat licen[cs]e", ()),
    ("mit", "x11", "(?:mit )?x11 licen[cs]e", ()),
    ("mit-0", "no attribution", "mit no attribution(?: licen[cs]e)?", ()),
    ("bsd-2-clause", "simplified bsd", "simplified bsd(?: licen[cs]e)?", ()),
    ("bsd-2-clause", "freebsd", "freebsd(?: licen[cs]e)?", ()),
    ("bsd-2-clause", "bsd 2", "bsd 2 clause(?: licen[cs]e)?", ()),
    ("bsd-2-clause", "clause bsd", "(?:2|two) clause bsd(?: licen[cs]e)?", ()),
    ("bsd-3-clause", "new bsd", "new bsd(?: licen[cs]e)?", ()),
    ("bsd-3-clause", "modified bsd", "modified bsd(?: licen[cs]e)?", ()),
    ("bsd-3-clause", "revised bsd", "revised bsd(?: licen[cs]e)?", ()),
    ("bsd-3-clause", "bsd 3", "bsd 3 clause(?: licen[cs]e)?", ()),
    ("bsd-3-clause", "clause bsd", "(?:3|three) clause bsd(?: licen[cs]e)?", ()),
    ("bsd-4-clause", "original bsd", "original bsd licen[cs]e", ()),
    ("bsd-4-clause", "clause bsd", "(?:4|four) clause bsd(?: licen[cs]e)?", ()),
    ("0bsd", "0bsd", "0bsd", ()),
    ("0bsd", "zero clause", "zero clause bsd(?: licen[cs]e)?", ()),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", ()),
    ("mpl", "mozilla public", "mozilla public licen[cs]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 1", "2 0")),
    ("npl", "netscape public", "netscape public licen[cs]e", ("1 0", "1 1")),
    ("epl", "eclipse public", "eclipse public licen[cs]e", ("1 0", "2 0")),
    ("epl", "epl", "epl", ("1 0", "2 0")),
    ("edl", "eclipse distribution", "eclipse distribution licen[cs]e", ("1 0",)),
    ("cpl", "common public", "common public licen[cs]e", ("1 0",)),
    ("ipl", "ibm public", "ibm public licen[cs]e", ("1 0",)),
    ("cddl", "distribution license", "common development and distribution license", ("1 0", "1 1")),
    ("cddl", "cddl", "cddl", ("1 0", "1 1")),
    ("cecill", "cecill", "cecill(?: b| c)?(?: licen[cs]e)?", ("2 0", "2 1")),
    ("eupl", "european union", "european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", "eupl", ("1 1", "1 2")),
    ("isc", "isc license", "isc license", ()),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", ()),
    ("libpng", "libpng", "libpng licen[cs]e", ()),
    ("libtiff", "libtiff", "libtiff licen[cs]e", ()),
    ("ijg", "jpeg group", "independent jpeg group licen[cs]e", ()),
    ("curl", "curl license", "curl license", ()),
    ("boost", "boost software", "boost software licen[cs]e", ("1 0",)),
    ("boost", "bsl", "bsl", ("1 0",)),
    ("busl", "business source", "business source licen[cs]e", ("1 0", "1 1")),
    ("sspl", "server side", "server side public licen[cs]e", ("1",)),
    ("elastic", "elastic license", "elastic license", ("1 0", "2 0")),
    ("commons-clause", "commons clause", "commons clause(?: licen[cs]e condition)?", ("1 0",)),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|internal use)(?: licen[cs]e)?", ("1 0 0",)),
    ("artistic", "artistic", "artistic licen[cs]e", ("1 0", "2 0")),
    ("clarified-artistic", "clarified artistic", "clarified artistic licen[cs]e", ()),
    ("unlicense", "unlicense", "(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("2",)),
    ("wtfpl", "fuck", "do what the fuck you want to public licen[cs]e", ("2",)),
    ("beerware", "beerware", "beerware(?: licen[cs]e)?", ()),
    ("beerware", "beer ware", "beer ware licen[cs]e", ()),
    ("python", "python software", "python software foundation licen[cs]e", ("2",)),
    ("php", "php license", "php license", ("3 0", "3 01")),
    ("ruby", "ruby license", "ruby license", ()),
    ("perl", "as perl", "(?:same terms|same licen[cs]e) as perl(?: itself)?", ()),
    ("vim", "vim license", "vim license", ()),
    ("tcl", "tcl", "tcl tk licen[cs]e", ()),
    ("zpl", "zope public", "zope public licen[cs]e", ("1 1", "2 0", "2 1")),
    ("postgresql", "postgresql", "postgresql licen[cs]e", ()),
    ("openssl", "openssl", "openssl licen[cs]e", ()),
    ("ssleay", "ssleay", "ssleay licen[cs]e", ()),
    ("openldap", "openldap", "openldap public licen[cs]e", ("2 7", "2 8")),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e", ()),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", ()),
    ("upl", "universal permissive", "universal permissive licen[cs]e", ("1 0",)),
    ("afl", "academic free", "academic free licen[cs]e", ("1 1", "2 0", "2 1", "3 0")),
    ("osl", "open software", "open software licen[cs]e", ("1 0", "2 0", "2 1", "3 0")),
    ("rpl", "reciprocal public", "reciprocal public licen[cs]e", ("1 1", "1 5")),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e", ()),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e", ()),
    ("apsl", "apple public", "apple public source licen[cs]e", ("1 0", "1 1", "1 2", "2 0")),
    ("intel", "intel open", "intel open source licen[cs]e", ()),
    ("lppl", "project public", "latex project public licen[cs]e", ("1 0", "1 2", "1 3", "1 3c")),
    ("lppl", "lppl", "lppl", ("1 2", "1 3", "1 3c")),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e", ("1 0", "1 1")),
    ("ofl", "sil ofl", "sil ofl", ("1 0", "1 1")),
    ("ubuntu-font", "ubuntu font", "ubuntu font licen[cs]e", ("1 0",)),
    ("bitstream-vera", "bitstream vera", "bitstream vera(?: fonts?)? (?:copyright|licen[cs]e)", ()),
    ("w3c", "w3c", "w3c software(?: and document)?(?: notice and)? licen[cs]e", ()),
    ("unicode", "unicode license", "unicode license", ("3",)),
    ("icu", "icu license", "icu license", ()),
    ("json", "json license", "json license", ()),
    ("mulan", "mulan", "mulan (?:permissive software|psl|public)(?: licen[cs]e)?", ("1", "2")),
    ("blueoak", "blue oak", "blue oak model licen[cs]e", ("1 0 0",)),
    ("hippocratic", "hippocratic", "hippocratic licen[cs]e", ("1 2", "2 1", "3 0")),
    ("parity", "parity public", "parity public licen[cs]e", ("6 0 0", "7 0 0")),
    ("cern-ohl", "open hardware", "cern open hardware licen[cs]e", ("1 1", "1 2", "2")),
    ("solderpad", "solderpad", "solderpad hardware licen[cs]e", ("0 5", "0 51", "2 0", "2 1")),
    ("tapr", "tapr", "tapr open hardware licen[cs]e", ("1 0",)),
    ("cc0", "cc0", "cc0(?: universal)?", ("1 0",)),
    ("cc0", "cc zero", "cc zero", ("1 0",)),
    ("cc-pdm", "domain mark", "public domain mark", ("1 0",)),
    ("cc-by-nc-nd", "cc by", "cc by nc nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc attribution", "cc attribution non ?commercial no ?deriv(?:ative)?s", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "creative commons", "creative commons (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc by", "cc by nc sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "creative commons", "creative commons (?:by nc sa|attribution non ?commercial share ?alike)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc by", "cc by nc", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "creative commons", "creative commons (?:by nc|attribution non ?commercial)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc by", "cc by nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "creative commons", "creative commons (?:by nd|attribution no ?deriv(?:ative)?s)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc by", "cc by sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "creative commons", "creative commons (?:by sa|attribution share ?alike)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc by", "cc by", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "creative commons", "creative commons (?:by|attribution)", ("2 0", "2 5", "3 0", "4 0")),
    ("odbl", "open database", "(?:open data commons )?open database licen[cs]e", ("1 0",)),
    ("odc-by", "data commons", "open data commons attribution licen[cs]e", ("1 0",)),
    ("pddl", "domain dedication", "public domain dedication and licen[cs]e", ("1 0",)),
    ("cdla-permissive", "community data", "community data licen[cs]e agreement permissive", ("1 0", "2 0")),
    ("cdla-sharing", "community data", "community data licen[cs]e agreement sharing", ("1 0",)),
    ("ogl-uk", "open government", "open government licen[cs]e", ("1 0", "2 0", "3 0")),
    ("etalab", "licence ouverte", "licence ouverte(?: etalab)?", ("1 0", "2 0")),
    ("dl-de", "datenlizenz deutschland", "datenlizenz deutschland(?: namensnennung| zero)?", ("1 0", "2 0")),
    ("llama", "llama", "llama [0-9 ]*community licen[cs]e", ()),
    ("gemma", "gemma terms", "gemma terms of use", ()),
    ("openrail", "openrail", "(?:creativeml )?openrail(?: m)?(?: licen[cs]e)?", ()),
    ("bigscience-rail", "bigscience", "bigscience (?:open)?rail(?: m)?(?: licen[cs]e)?", ("1 0",)),
    ("bigcode-openrail", "bigcode", "bigcode openrail m(?: licen[cs]e)?", ("1",)),
    ("ai2-impact", "ai2 impact", "ai2 impact licen[cs]e", ()),
)

#: Sentences of license texts and notices, and addresses: label; keyword; regex over words.
SIGNATURES = (
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial portions", "shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", "merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "opensource", "opensource org licenses? mit"),
    ("x11", "shall not", "shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("isc", "author disclaims", "the author disclaims all warranties with regard to this software"),
    ("isc", "opensource", "opensource org licenses? isc"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "copyright holders", "this software is provided by the copyright holders and contributors as is"),
    ("bsd", "opensource", "opensource org licenses? bsd license"),
    ("bsd-2-clause", "opensource", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource", "opensource org licenses? bsd 3 clause"),
    ("bsd-3-clause", "endorse", "neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("zlib", "as is without", "this software is provided as is without any express or implied warranty"),
    ("zlib", "not be misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such"),
    ("gpl", "free software", "is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "useful but", "in the hope that it will be useful but without any warranty"),
    ("gpl", "along with", "should have received a copy of the gnu general public license along with"),
    ("gpl", "gnu org", "(?:www )?gnu org licenses(?: gpl)?"),
    ("gpl", "gnu org", "(?:www )?gnu org copyleft(?: gpl)?"),
    ("gpl-2.0", "gnu org", "(?:www )?gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu org", "(?:www )?gnu org licenses gpl 3 0"),
    ("lgpl", "free software", "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "gnu org", "(?:www )?gnu org licenses lgpl"),
    ("lgpl-2.1", "gnu org", "(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu org", "(?:www )?gnu org licenses lgpl 3 0"),
    ("agpl", "free software", "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3.0", "gnu org", "(?:www )?gnu org licenses agpl 3 0"),
    ("gfdl", "document under", "copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "gnu org", "(?:www )?gnu org licenses fdl"),
    ("gpl-classpath-exception", "classpath exception", "classpath exception"),
    ("gcc-exception", "runtime library", "gcc runtime library exception"),
    ("apache-2.0", "in compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "as is basis", "distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "apache", "(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", "contributor license", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "opensource", "opensource org licenses? apache 2 0"),
    ("mpl-2.0", "mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla org", "mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla public", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", "mozilla org", "mozilla org mpl mpl 1 1"),
    ("epl-2.0", "eclipse org", "eclipse org legal epl 2 0"),
    ("epl-1.0", "eclipse org", "eclipse org legal epl v10"),
    ("edl-1.0", "eclipse org", "eclipse org org documents edl v10"),
    ("cddl", "sun com", "sun com cddl"),
    ("cecill", "cecill info", "(?:www )?cecill info"),
    ("eupl", "joinup", "joinup ec europa eu (?:community|collection) eupl"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("wtfpl", "wtfpl net", "(?:www )?wtfpl net"),
    ("beerware", "buy me", "you can buy me a beer in return"),
    ("boost-1.0", "boost software", "distributed under the boost software license version 1 0"),
    ("boost-1.0", "boost org", "(?:www )?boost org license 1 0 txt"),
    ("python", "python org", "(?:docs )?python org (?:[0-9] )?license"),
    ("php", "php net", "(?:www )?php net license"),
    ("openssl", "openssl toolkit", "developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "eric young", "cryptographic software written by eric young"),
    ("ofl", "reserved font", "with reserved font name"),
    ("ofl", "scripts sil", "scripts sil org ofl"),
    ("cc", "creativecommons", "creativecommons org licenses [a-z ]+[0-9] [0-9]"),
    ("cc-by-4.0", "creativecommons", "creativecommons org licenses by 4 0"),
    ("cc-by-sa-4.0", "creativecommons", "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons", "creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", "creativecommons", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons", "creativecommons org licenses by nc nd 4 0"),
    ("cc-by-nd-4.0", "creativecommons", "creativecommons org licenses by nd 4 0"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc-pdm-1.0", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("cc0-1.0", "waived all", "waived all copyright and related or neighboring rights"),
    ("odbl-1.0", "opendatacommons", "opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by-1.0", "opendatacommons", "opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1.0", "opendatacommons", "opendatacommons org licenses pddl(?: 1 0)?"),
    ("ogl-uk", "nationalarchives", "nationalarchives gov uk doc open government licence"),
    ("public-domain", "public domain", "(?:released|dedicated|placed) (?:in)?to the public domain"),
    ("public-domain", "public domain", "(?:is|are) in the public domain"),
    ("public-domain", "domaine public", "dans le domaine public"),
    ("public-domain", "dominio", "en el dominio p\u00fablico"),
    ("public-domain", "gemeinfrei", "(?:ist|sind) gemeinfrei"),
    ("proprietary", "rights reserved", "all rights reserved"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "trade secrets", "contains (?:confidential information and )?trade secrets of"),
    ("proprietary", "strictly prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "reproduced or", "no part of this (?:publication|book|work|document) may be reproduced or"),
    ("proprietary", "droits", "tous droits r\u00e9serv\u00e9s"),
    ("proprietary", "derechos", "todos los derechos reservados"),
    ("proprietary", "vorbehalten", "alle rechte vorbehalten"),
    ("non-commercial", "commercial use", "(?:for )?non commercial use only"),
    ("non-commercial", "noncommercial use", "(?:for )?noncommercial use only"),
    ("non-commercial", "commercial use", "not (?:for|be used for) commercial use"),
    ("research-only", "research purposes", "for (?:non ?commercial )?research purposes only"),
    ("evaluation-only", "evaluation purposes", "for evaluation purposes only"),
    ("eula", "end user", "end user licen[cs]e agreement"),
)

UNDER = "(?:licensed|released|distributed|published|available|provided) under (?:the terms of )?(?:the |an? )?"
#: By kind of rule: priority and how sure it is.
KINDS = {"spdx": (4, 1.0), "signature": (4, 0.95), "grant": (3, 0.9), "version": (2, 0.85), "name": (1, 0.7), "base": (0, 0.7)}
HIGHEST = max(priority for priority, _ in KINDS.values())
BLOCK = 256


def rules() -> list[tuple[str, str, str, int, float]]:
    """(keyword, regex over words, label, priority, weight): each signature and name, and the forms a name is written in."""
    out = []

    def add(kind: str, keyword: str, regex: str, label: str) -> None:
        out.append((keyword, f"(?<= ){regex}(?= )", label, *KINDS[kind]))

    for label, keyword, regex in SIGNATURES:
        add("signature", keyword, regex, label)
    for label, keyword, name, versions in FAMILIES:
        add("name", keyword, name, label)
        add("grant", keyword, UNDER + name, label)
        add("spdx", "spdx", f"spdx license identifier {label.replace('-', ' ')}(?: only| or later)?", label)
        for version in versions:
            shown = f"{label}-{version.replace(' ', '.')}"
            number = f"(?: (?:version|v))? v?{version}"
            add("version", keyword, name + number, shown)
            add("grant", keyword, UNDER + name + number, shown)
            add("spdx", "spdx", f"spdx license identifier {label.replace('-', ' ')} {version}(?: only| or later)?", shown)
    return list(dict.fromkeys(out))


#: Words too common to tell a text that may name a license.
COMMON = {"license", "public", "software", "source", "open", "free", "general", "new", "original", "clause", "in", "or", "along", "with", "use", "end", "all", "as", "is", "to", "of", "the", "me", "it", "not", "be", "but", "2", "3"}


def gate_words(keywords: list[str]) -> list[str]:
    """For each keyword a word of it: its longest that is not common."""
    return sorted({max(k.split(), key=lambda w: (w not in COMMON, len(w), w)) for k in keywords})


def rule_array(table: list[tuple]) -> Column:
    """The rules as one constant: parsed when the plan is made, not spelled out in it."""
    names = ("keyword", "regex", "label", "priority", "weight")
    schema = "array<struct<keyword:string,regex:string,label:string,priority:int,weight:double>>"
    return F.from_json(F.lit(json.dumps([dict(zip(names, rule)) for rule in table])), schema)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used: inside lambdas nothing else shares it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def intervals(norm: Column, rule: Column) -> Column:
    """All matches of a rule as structs (start, less, below, label, weight), which sort as the sweep wants them:
    by start, then longer and of higher priority first."""
    empty, none = F.array().cast(FOUND), F.array().cast("array<int>")
    length = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["match"])

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        found = F.struct(start.alias("start"), (-start - x["match"]).alias("less"), (-rule["priority"]).alias("below"), rule["label"].alias("label"), rule["weight"].alias("weight"))
        return F.struct((start + x["match"]).alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    def placed(blocks: Column) -> Column:
        ahead = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda s, b: F.struct((s["at"] + length(b)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(blocks, ahead, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("found")), step)["found"]))

    def blocks(pairs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        return F.transform(starts, lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))

    def of(matches: Column) -> Column:
        gaps = F.split(norm, rule["regex"], -1)
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("match")))
        return F.when(F.size(matches) == 0, empty).otherwise(let(let(pairs, blocks), placed))

    return let(F.regexp_extract_all(norm, rule["regex"], F.lit(0)), of)


#: The type of what intervals() finds.
FOUND = "array<struct<start:int,less:int,below:int,label:string,weight:double>>"


def kept(found: Column) -> Column:
    """The labels and the greatest weight of the detections that no other suppresses, by one sweep in order of start.

    furthest[p] is how far detections of priority p and more have reached; a detection that ends no further than
    those of its priority lies inside one of them. Detections of one place and priority share their fate.
    """
    none = F.struct(*[F.lit(v).cast("int").alias(c) for c, v in (("start", -1), ("less", 0), ("below", 1))], F.lit(False).alias("stays"))
    start = F.struct(
        F.array_repeat(F.lit(0), HIGHEST + 1).alias("furthest"), none.alias("last"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("weight")
    )

    def step(s: Column, d: Column) -> Column:
        last, stop = s["last"], -d["less"]
        same = (last["start"] == d["start"]) & (last["less"] == d["less"]) & (last["below"] == d["below"])
        settled = F.when(same, last["stays"]).otherwise(F.get(s["furthest"], -d["below"]) < stop)
        furthest = F.transform(s["furthest"], lambda x, p: F.when(p <= -d["below"], F.greatest(x, stop)).otherwise(x))

        def after(stays: Column) -> Column:
            labels = F.when(stays & ~F.array_contains(s["labels"], d["label"]), F.concat(s["labels"], F.array(d["label"]))).otherwise(s["labels"])
            return F.struct(
                furthest.alias("furthest"), F.struct(d["start"].alias("start"), d["less"].alias("less"), d["below"].alias("below"), stays.alias("stays")).alias("last"),
                labels.alias("labels"), F.when(stays, F.greatest(s["weight"], d["weight"])).otherwise(s["weight"]).alias("weight"),
            )

        return let(settled, after)

    return F.aggregate(F.array_sort(found), start, step)


def base_places(words: Column) -> Column:
    """Structs (at, label) for every place of a base phrase, in order of place."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))

    def here(i: Column, phrase: str) -> Column:
        parts = phrase.split()
        found = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return found

    label = lambda i: F.coalesce(*[F.when(here(i, phrase), F.lit(name)) for phrase, name in BASE])
    return F.filter(F.transform(at, lambda i: F.struct(i.alias("at"), label(i).alias("label"))), lambda x: x["label"].isNotNull())


def scan(docs: DataFrame, table: list[tuple] | None = None) -> DataFrame:
    """documents -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per row.

    Null and empty texts have no words, no labels and score 0. score is the weight of the surest rule that
    is kept. Repeated rows are each returned; an empty table gives no rows. Columns other than doc_id and
    text are not read.
    """
    table = rules() if table is None else table
    known = sorted({r[0] for r in table})
    keywords = F.array(*map(F.lit, known))
    gate = F.array(*map(F.lit, gate_words([*known, *(phrase for phrase, _ in BASE)])))
    # lower() also folds other letters, which changes no word boundary and makes no ASCII word but by "K"
    # (Kelvin), which no base phrase holds; unlike translate() it does not look up every character
    rows = docs.select("doc_id", F.array_remove(F.split(F.lower(text_or_empty()), NOT_WORD), "").alias("words"))
    rows = rows.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), F.arrays_overlap("words", gate).alias("gate"))
    rows = rows.withColumn("norm", F.when(F.col("gate"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
    rows = rows.withColumn("base", F.when(F.col("gate"), base_places(F.col("words"))))
    held = F.filter(keywords, lambda k: F.contains("norm", F.concat(F.lit(" "), k, F.lit(" "))))
    rows = rows.select("doc_id", "n_words", "norm", "base", F.when(F.col("gate"), held).alias("keywords"))
    run = F.filter(rule_array(table), lambda r: F.array_contains("keywords", r["keyword"]))
    found = F.when(F.size("keywords") > 0, F.flatten(F.transform(run, lambda r: intervals(F.col("norm"), r))))
    rows = rows.select("doc_id", "n_words", "base", kept(found).alias("kept"))
    base_labels = F.coalesce(F.transform("base", lambda x: x["label"]), F.array().cast("array<string>"))
    own_labels = F.coalesce("kept.labels", F.array().cast("array<string>"))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    n_base = F.coalesce(F.size("base"), F.lit(0))
    return rows.select(
        "doc_id",
        "n_words",
        F.greatest(n_base, F.lit(0)).cast("long").alias("n_base"),
        F.get("base", F.lit(0))["at"].cast("long").alias("first_word"),
        F.get("base", F.greatest(n_base, F.lit(1)) - 1)["at"].cast("long").alias("last_word"),
        join(base_labels).alias("base_labels"),
        join(F.concat(base_labels, own_labels)).alias("labels"),
        F.greatest(F.coalesce("kept.weight", F.lit(0.0)), F.when(n_base > 0, F.lit(KINDS["base"][1])).otherwise(0.0)).alias("score"),
    )


def words_of(text: str | None) -> list[str]:
    """The words of one text, in plain Python (for tests)."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
