"""License scans by **ordered signature rules**, in DataFrame operations only.

A rule is a regular expression over the words of a text (ASCII letters lowered, one
blank between words), a label, a priority (1 is strongest), a confidence, and two
keywords that every match contains. Detection runs in three steps:

1. Prefilter: one pass over the raw texts looks for the keywords of all rules; a
   text without any is done. Only the others are turned into words.
2. Gate: a rule is tried on a text only if its keywords occur there; a literal table
   of rules is filtered per text, and every (text, rule) that is left is one row.
3. Resolution: matches are intervals of words. One that lies inside a match of an
   equal or stronger priority is suppressed (of equal intervals with equal priority
   the earlier rule stays), by running maxima of the ends over the text's matches in
   order of their starts: no pairs of matches are formed. Then a match of a family's
   general label (gpl) is suppressed where it meets one of the family's versions
   (gpl-3.0), by running extremes of the versions' ends and starts.

The rules are written by hand: sentences of license texts and notices, names of single
licenses, and one line per common license that templates expand (tag, notice, address,
name, short name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import freeze

WORD_RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that are always reported.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Rule:
    pattern: str
    label: str
    priority: int
    confidence: float
    keywords: tuple[str, str]
    base: bool = False


#: Label; keyword; words of the tag; of the name; of the version if any; of the address if any; short name if any.
LICENSES = (
    ("mit", "mit", "mit", r"mit(?: expat)?", "", "opensource org licenses mit(?: license)?", ""),
    ("mit-0", "mit", "mit 0", "mit no attribution", "", "opensource org licenses mit 0", ""),
    ("x11", "x11", "x11", "(?:mit )?x11", "", "", ""),
    ("isc", "isc", "isc", r"isc", "", "opensource org licenses isc(?: license)?", ""),
    ("0bsd", "bsd", "0bsd", "(?:zero clause|0 clause) bsd", "", "opensource org licenses 0bsd", "0bsd"),
    ("bsd-2-clause", "bsd", "bsd 2 clause(?: simplified)?", "(?:simplified|freebsd|2 clause|two clause) bsd", "", "opensource org licenses bsd 2 clause", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "bsd 3 clause(?: new)?", "(?:new|modified|revised|3 clause|three clause) bsd", "", "opensource org licenses bsd 3 clause", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", "(?:original|old|4 clause|four clause) bsd", "", "", "bsd 4 clause"),
    ("bsd", "bsd", "bsd", r"bsd(?: style)?", "", "opensource org licenses bsd license php", ""),
    ("apache-1.1", "apache", "apache 1 1", "apache software", "1 1", "apache org licenses license 1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache 2 0", r"apache(?: software)?", "2(?: 0)?", "apache org licenses license 2 0", "apache 2(?: 0)?"),
    ("apache", "apache", "apache", "apache(?: software)?", "", "apache org licenses", ""),
    ("gpl-1.0", "gnu", "gpl 1 0(?: only| or later)?", "gnu general public", "1(?: 0)?", "", "gnu gpl(?:v1| (?:version |v ?)?1(?: 0)?)"),
    ("gpl-2.0", "gnu", "gpl 2 0(?: only| or later)?", "gnu general public", "2(?: 0)?", "gnu org licenses (?:old licenses )?gpl 2 0", "gnu gpl(?:v2| (?:version |v ?)?2(?: 0)?)"),
    ("gpl-3.0", "gnu", "gpl 3 0(?: only| or later)?", "gnu general public", "3(?: 0)?", "gnu org licenses gpl 3 0", "gnu gpl(?:v3| (?:version |v ?)?3(?: 0)?)"),
    ("gpl", "gnu", "gpl", r"gnu (?:general public|gpl)", "", "gnu org licenses gpl", "gnu gpl"),
    ("lgpl-2.0", "gnu", "lgpl 2 0(?: only| or later)?", "gnu (?:library|lesser) general public", "2(?: 0)?", "gnu org licenses (?:old licenses )?lgpl 2 0", "gnu lgpl(?:v2| (?:version |v ?)?2(?: 0)?)"),
    ("lgpl-2.1", "gnu", "lgpl 2 1(?: only| or later)?", "gnu lesser general public", "2 1", "gnu org licenses (?:old licenses )?lgpl 2 1", "gnu lgpl(?:v2| (?:version |v ?)?2) 1"),
    ("lgpl-3.0", "gnu", "lgpl 3 0(?: only| or later)?", "gnu lesser general public", "3(?: 0)?", "gnu org licenses lgpl 3 0", "gnu lgpl(?:v3| (?:version |v ?)?3(?: 0)?)"),
    ("agpl-3.0", "gnu", "agpl 3 0(?: only| or later)?", "gnu affero general public", "3(?: 0)?", "gnu org licenses agpl 3 0", "gnu agpl(?:v3| (?:version |v ?)?3(?: 0)?)"),
    ("gfdl-1.3", "gnu", "gfdl 1 3(?: only| or later)?", "gnu free documentation", "1 3", "gnu org licenses fdl 1 3", "gnu fdl 1 3"),
    ("lgpl", "gnu", "lgpl", "gnu (?:library|lesser)(?: general)? public", "", "gnu org licenses lgpl", "gnu lgpl"),
    ("agpl", "gnu", "agpl", "gnu affero general public", "", "gnu org licenses agpl", "gnu agpl"),
    ("gfdl", "gnu", "gfdl", "gnu free documentation", "", "gnu org licenses fdl", ""),
    ("mpl-1.1", "mozilla", "mpl 1 1", "mozilla public", "1 1", "mozilla org mpl 1 1", "mozilla mpl 1 1"),
    ("mpl-2.0", "mozilla", "mpl 2 0", "mozilla public", "2(?: 0)?", "mozilla org mpl 2 0", "mozilla mpl 2 0"),
    ("epl-1.0", "eclipse", "epl 1 0", "eclipse public", "1(?: 0)?", "eclipse org legal epl v10", "eclipse epl 1 0"),
    ("epl-2.0", "eclipse", "epl 2 0", "eclipse public", "2(?: 0)?", "eclipse org legal epl 2 0", "eclipse epl 2 0"),
    ("mpl", "mozilla", "mpl", "mozilla public", "", "mozilla org mpl", "mozilla mpl"),
    ("epl", "eclipse", "epl", "eclipse public", "", "", "eclipse epl"),
    ("edl-1.0", "eclipse", "edl 1 0", "eclipse distribution", "1(?: 0)?", "eclipse org org documents edl v10", ""),
    ("cddl-1.0", "development", "cddl 1 0", "common development and distribution", "1(?: 0)?", "opensource org licenses cddl1", ""),
    ("cddl-1.1", "development", "cddl 1 1", "common development and distribution", "1 1", "", ""),
    ("cddl", "development", "cddl", "common development and distribution", "", "", ""),
    ("cpl-1.0", "common", "cpl 1 0", "common public", "1(?: 0)?", "opensource org licenses cpl1 0", ""),
    ("artistic-1.0", "artistic", "artistic 1 0", r"artistic", "1(?: 0)?", "opensource org licenses artistic license 1 0", ""),
    ("artistic-2.0", "artistic", "artistic 2 0", r"artistic", "2(?: 0)?", "opensource org licenses artistic license 2 0", ""),
    ("artistic", "artistic", "artistic", "artistic", "", "opensource org licenses artistic license", ""),
    ("bsl-1.0", "boost", "bsl 1 0", "boost software", "1(?: 0)?", "boost org license 1 0 txt", "boost 1 0"),
    ("zlib", "zlib", "zlib", r"zlib(?: libpng)?", "", "opensource org licenses zlib(?: license)?", ""),
    ("unlicense", "unlicense", "unlicense", "unlicense", "", "unlicense org", ""),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl", "2?", "wtfpl net", ""),
    ("cc0-1.0", "cc0", "cc0 1 0", "(?:creative commons )?cc0", "1(?: 0)?", "", "cc0"),
    ("cc-by-3.0", "creative", "cc by 3 0", "creative commons attribution", "3 0(?: unported)?", "creativecommons org licenses by 3 0", "cc by 3 0"),
    ("cc-by-4.0", "creative", "cc by 4 0", "creative commons attribution", "4 0(?: international)?", "creativecommons org licenses by 4 0", "cc by 4 0"),
    ("cc-by-sa-3.0", "creative", "cc by sa 3 0", "creative commons attribution sharealike", "3 0(?: unported)?", "creativecommons org licenses by sa 3 0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "creative", "cc by sa 4 0", "creative commons attribution sharealike", "4 0(?: international)?", "creativecommons org licenses by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-3.0", "creative", "cc by nc 3 0", "creative commons attribution noncommercial", "3 0(?: unported)?", "creativecommons org licenses by nc 3 0", "cc by nc 3 0"),
    ("cc-by-nc-4.0", "creative", "cc by nc 4 0", "creative commons attribution noncommercial", "4 0(?: international)?", "creativecommons org licenses by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "creative", "cc by nd 4 0", "creative commons attribution noderivatives", "4 0(?: international)?", "creativecommons org licenses by nd 4 0", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creative", "cc by nc sa 4 0", "creative commons attribution noncommercial sharealike", "4 0(?: international)?", "creativecommons org licenses by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creative", "cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives", "4 0(?: international)?", "creativecommons org licenses by nc nd 4 0", "cc by nc nd 4 0"),
    ("odbl-1.0", "database", "odbl 1 0", "open (?:data commons open )?database", "1(?: 0)?", "opendatacommons org licenses odbl", ""),
    ("pddl-1.0", "domain", "pddl 1 0", "(?:open data commons )?public domain dedication", "1(?: 0)?", "opendatacommons org licenses pddl", ""),
    ("ofl-1.1", "font", "ofl 1 1", "sil open font", "1 1", "scripts sil org ofl", "sil ofl"),
    ("psf-2.0", "python", "psf 2 0", "python software foundation", "2?", "python org psf license", ""),
    ("postgresql", "postgresql", "postgresql", r"postgresql", "", "opensource org licenses postgresql", ""),
    ("upl-1.0", "universal", "upl 1 0", "universal permissive", "1(?: 0)?", "", ""),
    ("eupl-1.2", "european", "eupl 1 2", "european union public", "1 2", "", ""),
    ("ms-pl", "microsoft", "ms pl", "microsoft public", "", "opensource org licenses ms pl", ""),
    ("ms-rl", "microsoft", "ms rl", "microsoft reciprocal", "", "opensource org licenses ms rl", ""),
    ("osl-3.0", "open", "osl 3 0", "open software", "3(?: 0)?", "opensource org licenses osl 3 0", ""),
    ("afl-3.0", "academic", "afl 3 0", "academic free", "3(?: 0)?", "opensource org licenses afl 3 0", ""),
    ("ecl-2.0", "educational", "ecl 2 0", "educational community", "2(?: 0)?", "opensource org licenses ecl 2 0", ""),
    ("ncsa", "ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", "", "opensource org licenses ncsa", ""),
    ("bsl-1.1", "business", "busl 1 1", "business source", "1 1", "", ""),
    ("sspl-1.0", "server", "sspl 1 0", "server side public", "1(?: 0)?", "", ""),
    ("elastic-2.0", "elastic", "elastic 2 0", "elastic", "2(?: 0)?", "elastic co licensing elastic license", ""),
)

#: Sentences of license texts and notices: pattern, label, keywords.
SENTENCES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", ("hereby", "granted")),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc", ("permission", "distribute")),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ("redistribution", "binary")),
    ("neither the name of .{1,80}? nor the names of its contributors may be used to endorse", "bsd-3-clause", ("neither", "endorse")),
    ("this is free and unencumbered software released into the public domain", "unlicense", ("unencumbered", "domain")),
    ("boost software license version 1 0 august 17th 2003", "bsl-1.0", ("boost", "license")),
    ("this software is provided as is without any express or implied warranty in no event will the authors", "zlib", ("warranty", "authors")),
    ("do what the fuck you want to public license", "wtfpl", ("want", "license")),
    ("free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", ("gnu", "redistribute")),
    ("unless required by applicable law or agreed to in writing software distributed under the license", "apache-2.0", ("applicable", "license")),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0", ("mozilla", "subject")),
    ("the person who associated a work with this deed has dedicated the work to the public domain", "cc0-1.0", ("deed", "domain")),
    ("all rights reserved", "proprietary", ("rights", "reserved")),
    ("(?:dedicated to|placed in|released into) the public domain", "public-domain", ("public", "domain")),
    ("proprietary (?:and confidential|license|software)", "proprietary", ("proprietary", "")),
    ("confidential (?:and proprietary|information)", "proprietary", ("confidential", "")),
)

#: More sentences, of texts and of notices.
NOTICES = (
    ("the above copyright notice and this permission notice shall be included in all copies", "mit", ("permission", "copies")),
    ("use of this source code is governed by an mit style license", "mit", ("governed", "license")),
    ("this source code is licensed under the mit license found in the license file", "mit", ("mit", "found")),
    ("use of this source code is governed by a bsd style license", "bsd", ("governed", "license")),
    ("this software may be modified and distributed under the terms of the bsd license", "bsd", ("bsd", "modified")),
    ("as long as you retain this notice you can do whatever you want .{0,200}? beer ?ware license", "beerware", ("retain", "license")),
    ("(?:the )?beer ?ware license", "beerware", ("beer", "license")),
    ("you may not use this file except in compliance with the license", "apache-2.0", ("compliance", "license")),
    ("you may obtain a copy of the license at", "apache-2.0", ("obtain", "license")),
    ("see the license for the specific language governing permissions and limitations under the license", "apache-2.0", ("governing", "limitations")),
    ("licensed to the apache software foundation(?: asf)? under one or more contributor license agreements", "apache-2.0", ("apache", "contributor")),
    ("this product includes software developed by the apache software foundation", "apache-1.1", ("apache", "developed")),
    ("distributed in the hope that it will be useful but without any warranty", "gpl", ("hope", "warranty")),
    ("without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", "gpl", ("merchantability", "gnu")),
    ("you should have received a copy of the gnu general public license", "gpl", ("received", "gnu")),
    ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "gpl", ("verbatim", "license")),
    ("linking this library statically or dynamically with other modules is making a combined work .{0,120}? gnu general public license", "gpl", ("linking", "gnu")),
    ("you should have received a copy of the gnu (?:library|lesser) general public license", "lgpl", ("received", "gnu")),
    ("you should have received a copy of the gnu affero general public license", "agpl", ("received", "affero")),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl", ("granted", "gnu")),
    ("the contents of this file are subject to the mozilla public license", "mpl", ("contents", "mozilla")),
    ("mozilla public license v 2 0 if a copy of the mpl was not distributed with this file", "mpl-2.0", ("mozilla", "distributed")),
    ("the accompanying materials are made available under the terms of the eclipse public license v(?:ersion )? ?1 0", "epl-1.0", ("accompanying", "eclipse")),
    ("the accompanying materials are made available under the terms of the eclipse public license 2 0", "epl-2.0", ("accompanying", "eclipse")),
    ("the contents of this file are subject to the terms of the common development and distribution license", "cddl", ("contents", "license")),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "bsl-1.0", ("hereby", "organization")),
    ("distributed under the boost software license version 1 0 see accompanying file", "bsl-1.0", ("accompanying", "boost")),
    ("permission is granted to anyone to use this software for any purpose including commercial applications", "zlib", ("granted", "commercial")),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document", "wtfpl", ("verbatim", "license")),
    ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "postgresql", ("permission", "agreement")),
    ("permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted", "hpnd", ("hereby", "sell")),
    ("making python available to licensee on an as is basis", "psf-2.0", ("python", "licensee")),
    ("this font software is licensed under the sil open font license", "ofl-1.1", ("font", "license")),
    ("to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights to .{1,120}? creative commons", "cc0-1.0", ("waived", "creative")),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0", ("work", "creative")),
    ("this work is licensed under a creative commons attribution share ?alike 4 0 international license", "cc-by-sa-4.0", ("work", "creative")),
    ("this work is licensed under a creative commons attribution non ?commercial 4 0 international license", "cc-by-nc-4.0", ("work", "creative")),
    ("this work is licensed under a creative commons attribution no ?deriv(?:ative)?s 4 0 international license", "cc-by-nd-4.0", ("work", "creative")),
    ("this work is licensed under a creative commons attribution non ?commercial share ?alike 4 0 international license", "cc-by-nc-sa-4.0", ("work", "creative")),
    ("text is available under the creative commons attribution share ?alike license", "cc-by-sa", ("text", "creative")),
    ("made available under the open database license", "odbl-1.0", ("available", "license")),
    ("individual contents of the database are licensed under the database contents license", "dbcl-1.0", ("contents", "license")),
    ("you may not move change disable or circumvent the license key functionality", "elastic-2.0", ("circumvent", "license")),
    ("the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "bsl-1.1", ("licensor", "production")),
    ("if you use the software you accept this license if you do not accept the license do not use the software", "ms-pl", ("accept", "license")),
    ("you can redistribute it and or modify it under the same terms as perl itself", "perl", ("redistribute", "perl")),
    ("you can redistribute it and or modify it under either the terms of the 2 clause bsdl", "ruby", ("redistribute", "bsdl")),
    ("no part of this .{1,40}? may be reproduced .{1,200}? without the prior written permission", "proprietary", ("reproduced", "permission")),
    ("may not be used .{0,80}? without (?:the )?(?:express|prior) written permission of the copyright (?:holder|owner)", "proprietary", ("written", "permission")),
    ("this license does not grant you the right to use any trademark", "proprietary", ("license", "trademark")),
    ("for non ?commercial use only .{0,60}? commercial licen[cs]e", "non-commercial", ("commercial", "licen")),
    ("free for personal use .{0,60}? commercial licen[cs]e", "non-commercial", ("personal", "licen")),
)

#: Names of licenses that are not in the table above: pattern and label; each holds the word license.
NAMES = (
    ("academy of motion picture arts and sciences bsd license", "ampas"), ("adaptive public license", "apl-1.0"),
    ("aladdin free public license", "aladdin"), ("apple public source license", "apsl"), ("attribution assurance license", "aal"),
    ("blue oak model license(?: 1 0 0)?", "blueoak-1.0.0"), ("cecill(?: free software)? licen[cs]e", "cecill"),
    ("commons clause license condition", "commons-clause"), ("community data license agreement permissive", "cdla-permissive"),
    ("community data license agreement sharing", "cdla-sharing"), ("computer associates trusted open source license", "catosl-1.1"),
    ("creativeml open ?rail m license", "openrail-m"), ("cryptix general license", "cryptix"), ("cua office public license", "cua-opl-1.0"),
    ("curl license", "curl"), ("design science license", "dsl"), ("eiffel forum license", "efl"), ("entessa public license", "entessa"),
    ("eu datagrid software license", "eudatagrid"), ("fair license", "fair"), ("frameworx open license", "frameworx-1.0"),
    ("free art license", "free-art"), ("freetype(?: project)? license", "ftl"), ("hippocratic license", "hippocratic"),
    ("ibm public license", "ipl-1.0"), ("imagemagick license", "imagemagick"), ("independent jpeg group license", "ijg"),
    ("info zip license", "info-zip"), ("intel open source license", "intel"), ("jabber open source license", "josl"),
    ("latex project public license", "lppl"), ("libpng license", "libpng"), ("llama 2 community license", "llama2"),
    ("llama 3 community license", "llama3"), ("lucent public license", "lpl-1.02"), ("miros licen[cs]e", "miros"),
    ("motosoto license", "motosoto"), ("mulan permissive software license", "mulan-psl"), ("mulan public license", "mulan-publ"),
    ("naumen public license", "naumen"), ("net ?snmp license", "net-snmp"), ("netscape public license", "npl"),
    ("nokia open source license", "nokia"), ("non profit open software license", "nposl-3.0"), ("nethack general public license", "ngpl"),
    ("oclc research public license", "oclc-2.0"), ("open ?ldap public license", "openldap"), ("openssl license", "openssl"),
    ("open government licen[cs]e", "ogl"), ("open publication license", "opl"), ("parity public license", "parity"),
    ("peer production license", "ppl"), ("php license", "php"), ("polyform noncommercial license", "polyform-noncommercial"),
    ("polyform small business license", "polyform-small-business"), ("prosperity public license", "prosperity"),
    ("q public license", "qpl"), ("reciprocal public license", "rpl"), ("ricoh source code public license", "rscpl"),
    ("ruby license", "ruby"), ("sax public domain license", "sax"), ("simple public license", "simpl"), ("sleepycat license", "sleepycat"),
    ("solderpad hardware license", "shl"), ("cern open hardware licen[cs]e", "cern-ohl"), ("sugarcrm public license", "sugarcrm"),
    ("sun industry standards source license", "sissl"), ("sun public license", "spl"), ("sybase open watcom public license", "watcom"),
    ("tcl license", "tcl"), ("unicode license", "unicode"), ("vim license", "vim"), ("vovida software license", "vsl"),
    ("w3c software (?:notice and )?license", "w3c"), ("wx ?windows library licen[cs]e", "wxwindows"), ("xerox license", "xerox"),
    ("xfree86 license", "xfree86"), ("yahoo public license", "ypl"), ("zope public license", "zpl"), ("zend license", "zend"),
)

NOTICE = "(?:licen[sc]ed|released|distributed|provided|published|available|redistribute it|use is granted) under(?: the)?(?: terms of)?(?: the)? "


#: Keywords too common to stand for a license without the word itself.
COMMON = {"mit", "x11", "isc", "zlib", "artistic", "open", "common", "development", "database", "domain", "font",
          "python", "universal", "european", "server", "business", "academic", "educational", "microsoft", "elastic", "postgresql", "ncsa"}


def rules() -> list[Rule]:
    """All rules in order; the order decides between equal matches of one priority."""
    out = [Rule(p, label, 0, 0.9, (p.split()[-1], p.split()[0]), True) for p, label in BASE]
    for label, kw, tag, name, version, address, short in LICENSES:
        loose = version == "2?"  # a license of one version, named with it or not
        number = "(?:(?: version)? (?:v ?)?2)?" if loose else f"(?: version)? (?:v ?)?{version}" if version else ""
        out.append(Rule(f"spdx license identifier {tag}", label, 1, 1.0, ("spdx", "identifier")))
        said = kw not in COMMON and (version or kw in ("unlicense", "wtfpl", "gnu"))
        out.append(Rule(f"{NOTICE}{name}(?: licen[cs]e)?{number}(?: licen[cs]e)?" if said else
                        f"{NOTICE}{name}(?: licen[cs]e{number}|{number} licen[cs]e)", label, 2, 0.95, (kw, "under")))
        if address:
            out.append(Rule(address, label, 2, 0.9, (address.split()[0], "")))
        out.append(Rule(f"{name} licen[cs]e{number}", label, 3, 0.8, (kw, "licen")))
        if version:
            out.append(Rule(f"{name}{number} licen[cs]e", label, 3, 0.8, (kw, "licen")))
        if short:
            out.append(Rule(f"{short}(?: licen[cs]e)?", label, 4, 0.5, (short.split()[0], "")))
    out += [Rule(p, label, 2, 0.9, kws) for p, label, kws in (*SENTENCES, *NOTICES)]
    out += [Rule(p, label, 3, 0.8, (p.split("(")[0].split()[0], "licen")) for p, label in NAMES]
    return out


def families(all_rules: list[Rule]) -> dict[str, str]:
    """Label -> the general label of its family: gpl for gpl and every gpl-..., by the rules' labels."""
    labels = {r.label for r in all_rules if not r.base}
    general = {g for g in labels if any(x.startswith(f"{g}-") for x in labels)}
    return {x: max((g for g in general if x == g or x.startswith(f"{g}-")), key=len) for x in labels
            if any(x == g or x.startswith(f"{g}-") for g in general)}


_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Every match of a rule contains one of these in the raw text; a test generates matches of all rules against it.
PREFILTER = (r"(?i)licen[cs]|spdx|apache|creative|opensource|opendatacommons|gnu|mozilla|eclipse|boost|wtfpl|cc0|hereby|redistribut|"
             rf"permission|endorse|warranty|unencumbered|proprietary|confidential|bsd|ofl|the{_GAP}public{_GAP}domain|"
             rf"rights{_GAP}reserved|cc{_GAP}by")


def _words(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _rule_table(all_rules: list[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(f" {r.keywords[0]}").alias("k1"), F.lit(r.keywords[1]).alias("k2"),
                              F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"), F.lit(r.label).alias("label"),
                              F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence")) for k, r in enumerate(all_rules)])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(uid, id, n_words, words)``; ``words`` is null where the prefilter finds nothing."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.regexp_replace(F.translate("t", upper, upper.lower()), NOT_WORD, " ")
    d = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
    return freeze(d.select(
        F.monotonically_increasing_id().alias("uid"), "id", F.regexp_count("t", F.lit(WORD_RAW)).cast("long").alias("n_words"),
        F.when(F.col("t").rlike(PREFILTER), F.concat(F.lit(" "), F.trim(plain), F.lit(" "))).alias("words")))


def _matches(texts: DataFrame, all_rules: list[Rule]) -> DataFrame:
    """``(uid, rule, label, priority, confidence, first, last)``: matches as word intervals, ends inclusive."""
    table = _rule_table(all_rules)
    gated = texts.where("words IS NOT NULL").select("uid", "words", F.inline(F.filter(
        table, lambda r: F.contains("words", r["k1"]) & F.contains("words", r["k2"]))))
    found = gated.withColumn("m", F.regexp_extract_all("words", F.col("pattern"), F.lit(0))).where("size(m) > 0")
    parts = found.withColumn("p", F.split("words", F.col("pattern"), -1))
    each = parts.select("uid", "rule", "label", "priority", "confidence", F.posexplode(F.arrays_zip("m", "p")).alias("k", "x"))
    each = each.where("x.m IS NOT NULL").select("uid", "rule", "label", "priority", "confidence", "k",
                                                (_words(F.col("x.p")) - 1).alias("skip"), (_words(F.col("x.m")) + 1).alias("size"))
    each = each.repartition("uid")
    before = Window.partitionBy("uid", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.sum(F.col("skip") + F.col("size")).over(before) - F.col("size")
    return each.select("uid", "rule", "label", "priority", "confidence", first.alias("first"),
                       (first + F.col("size") - 1).alias("last"))


def _resolve(matches: DataFrame, priorities: int = 4) -> DataFrame:
    """Matches not contained in one of equal or stronger priority that comes before in
    (start, longest, priority, rule) order, and of a family's general label only those
    that meet no version; base matches stay and suppress nothing."""
    order = Window.partitionBy("uid").orderBy("first", F.col("last").desc(), "priority", "rule") \
        .rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for p in range(1, priorities + 1):
        reach = F.max(F.when(F.col("priority") == p, F.col("last"))).over(order)
        inside = inside | ((F.col("priority") >= p) & F.coalesce(reach >= F.col("last"), F.lit(False)))
    whole = matches.withColumn("inside", inside).where("priority = 0 OR NOT inside").drop("inside")

    family = F.create_map(*[F.lit(x) for pair in families(rules()).items() for x in pair])
    version = (F.col("priority") > 0) & (F.col("label") != F.col("family"))
    # versions that begin at or before a match and reach it; versions that begin after it, inside it
    upward = Window.partitionBy("uid", "family").orderBy("first", F.col("version").desc()).rowsBetween(Window.unboundedPreceding, -1)
    downward = Window.partitionBy("uid", "family").orderBy(F.col("first").desc()).rowsBetween(Window.unboundedPreceding, -1)
    meets = (F.coalesce(F.max(F.when(F.col("version"), F.col("last"))).over(upward) >= F.col("first"), F.lit(False))
             | F.coalesce(F.min(F.when(F.col("version"), F.col("first"))).over(downward) <= F.col("last"), F.lit(False)))
    known = whole.withColumn("family", F.coalesce(F.try_element_at(family, "label"), F.col("label"))).withColumn("version", version)
    return known.withColumn("meets", meets).where("priority = 0 OR version OR NOT meets").drop("family", "version", "meets")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(uid, id, n_words, rule, label, priority, confidence, first, last)``: every match
    that survives, in words from 0, ends inclusive; texts without one have no row."""
    texts = _texts(docs, id_col, text_col)
    return _resolve(_matches(texts, rules())).join(texts.select("uid", "id", "n_words"), "uid")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, n_spans``.

    ``score`` is the largest confidence of a surviving match, 0 without one. Null
    texts count as empty; repeated rows and ids have a row each; an empty table gives
    an empty result; other columns are not read.
    """
    texts = _texts(docs, id_col, text_col)
    spans = _resolve(_matches(texts, rules()))
    base = F.col("priority") == 0

    def labels(c: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(c)), ",")  # at most the rules' labels

    per = spans.groupBy("uid").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"), labels(F.when(base, F.col("label"))).alias("base_labels"),
        labels(F.col("label")).alias("labels"), F.max("confidence").alias("score"), F.count(F.lit(1)).alias("n_spans"))
    out = texts.select("uid", "id", "n_words").join(per, "uid", "left")
    return out.select("id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.col("first_word").cast("long"),
                      F.col("last_word").cast("long"), F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                      F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
                      F.coalesce("n_spans", F.lit(0)).alias("n_spans"))
