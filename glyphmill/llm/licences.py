"""Licences in texts, by known sentences and ordered rules over them.

A text is cut into sentences; each, in a normal form (words of a-z, 0-9 with one
blank between, whatever the holder's name), is looked up among known licence sentences.  What is found is a
sequence of identifiers with places.  A rule is an ordered list of identifiers:
it matches where its identifiers follow one another in that order, with no more
than GAP other sentences between two of them.  Longer rules come first, and
sentences that a rule has used are free for no other rule.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .secret_scan import points
from .shared import with_key
from .textscan import ASCII_LOWER, slabs, tidied

GAP = 6

# Sentences of published licences and usual references to them.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-title": "MIT License",
    "mit-the-title": "The MIT License",
    "mit-reference": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "isc-title": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-reference": "Licensed under the Apache License, Version 2.0.",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl3-reference": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-reference": "Licensed under CC BY-NC 4.0.",
    "cc-by-reference": "Licensed under CC BY 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-reference": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-reference": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-reference": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-reference": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc0-laws": "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an owner) of an original work of authorship and/or a database (each, a Work).",
    "cc0-owners": "Certain owners wish to permanently relinquish those rights to a Work for the purpose of contributing to a commons of creative, cultural and scientific works (Commons) that the public can reliably and without fear of later claims of infringement build upon, modify, incorporate in other works, reuse and redistribute as freely as possible in any form whatsoever and for any purposes, including without limitation commercial purposes.",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-without": "This software is distributed without any warranty.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-copy-secure": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl2-contribution": "Contribution means Covered Software of a particular Contributor.",
    "mpl2-covered": "Covered Software means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof.",
    "mpl1-commercial": "Commercial Use means distribution or otherwise making the Covered Code available to a third party.",
    "mpl1-contributor": "Contributor means each entity that creates or contributes to the creation of Modifications.",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "x11-name": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-plain-grant": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-event": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-name": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-event": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "boost-reference": "Distributed under the Boost Software License, Version 1.0.",
    "postgres-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "python-title": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "python-between": "This LICENSE AGREEMENT is between the Python Software Foundation (PSF), and the Individual or Organization (Licensee) accessing and otherwise using this software (Python) in source or binary form and its associated documentation.",
    "epl1-title": "Eclipse Public License - v 1.0",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl-use": "ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    "epl2-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "artistic-package": "Package refers to the collection of files distributed by the Copyright Holder, and derivatives of that collection of files created through textual modification.",
    "artistic-standard": "Standard Version refers to such a Package if it has not been modified, or has been modified in accordance with the wishes of the Copyright Holder as specified below.",
    "artistic2-title": "The Artistic License 2.0",
    "artistic2-terms": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
    "wtfpl-copies": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "ofl-font": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "apache-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-licensor": "Licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    "gpl-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl1-title": "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
    "gpl1-mercy": "The license agreements of most software companies try to keep users at the mercy of those companies.",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl2-applies": "This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it.",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl3-copyleft": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "agpl-copyleft": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "lgpl2-title": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl2-first": "This is the first released version of the library GPL.",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl21-first": "This is the first released version of the Lesser GPL.",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl3-incorporates": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "lgpl2-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "lgpl2-details": "See the GNU Library General Public License for more details.",
    "gfdl12-title": "GNU Free Documentation License Version 1.2, November 2002",
    "gfdl13-title": "GNU Free Documentation License Version 1.3, 3 November 2008",
    "gfdl13-grant": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
}

# Licence, sentences in order.
RULES = (
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-disclaimer")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaimer")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("X11", ("mit-grant", "mit-notice", "mit-warranty", "x11-name")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-details")),
    ("AGPL-3.0-only", ("agpl-title", "gpl-verbatim", "agpl-copyleft")),
    ("Apache-2.0", ("apache-grant", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-title", "apache-terms", "apache-licensor")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-only", ("gpl3-title", "gpl-verbatim", "gpl3-copyleft")),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-hope", "gpl-details")),
    ("ISC", ("isc-grant", "isc-warranty", "isc-event")),
    ("ISC", ("isc-plain-grant", "isc-warranty", "isc-event")),
    ("0BSD", ("0bsd-grant", "isc-warranty", "isc-event")),
    ("LGPL-2.0-or-later", ("lgpl2-free", "lgpl-hope", "lgpl2-details")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope", "lgpl-details")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("Zlib", ("zlib-as-is", "zlib-event", "zlib-grant")),
    ("Apache-2.0", ("apache-grant", "apache-copy")),
    ("Apache-2.0", ("apache-terms", "apache-licensor")),
    ("Artistic-1.0", ("artistic-package", "artistic-standard")),
    ("Artistic-2.0", ("artistic2-title", "artistic2-terms")),
    ("BSL-1.0", ("boost-title", "boost-grant")),
    ("CC0-1.0", ("cc0-dedicated", "cc0-without")),
    ("CC0-1.0", ("cc0-laws", "cc0-owners")),
    ("EPL-1.0", ("epl1-title", "epl-use")),
    ("EPL-2.0", ("epl2-title", "epl-use")),
    ("GFDL-1.2-only", ("gfdl12-title", "gpl-verbatim")),
    ("GFDL-1.3-only", ("gfdl13-title", "gpl-verbatim")),
    ("GPL-1.0-only", ("gpl1-title", "gpl1-mercy")),
    ("GPL-2.0-only", ("gpl2-title", "gpl2-applies")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-plain-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("LGPL-2.0-only", ("lgpl2-title", "lgpl2-first")),
    ("LGPL-2.1-only", ("lgpl21-title", "lgpl21-first")),
    ("LGPL-3.0-only", ("lgpl3-title", "lgpl3-incorporates")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT-0", ("mit0-grant", "mit-warranty")),
    ("MPL-1.1", ("mpl1-commercial", "mpl1-contributor")),
    ("MPL-2.0", ("mpl-form", "mpl-copy")),
    ("MPL-2.0", ("mpl-form", "mpl-copy-secure")),
    ("MPL-2.0", ("mpl2-contribution", "mpl2-covered")),
    ("Python-2.0", ("python-title", "python-between")),
    ("Unlicense", ("unlicense-domain", "unlicense-anyone")),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("Apache-2.0", ("apache-reference",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-reference",)),
    ("CC-BY-4.0", ("cc-by-reference",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-reference",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-reference",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-work",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-reference",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-reference",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-reference",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("EPL-2.0", ("epl2-header",)),
    ("GFDL-1.3-or-later", ("gfdl13-grant",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0-only", ("gpl3-reference",)),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("ISC", ("isc-title",)),
    ("LGPL-2.0-or-later", ("lgpl2-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-reference",)),
    ("MIT", ("mit-the-title",)),
    ("MIT", ("mit-title",)),
    ("MPL-2.0", ("mpl-form",)),
    ("OFL-1.1", ("ofl-font",)),
    ("PostgreSQL", ("postgres-grant",)),
    ("Unlicense", ("unlicense-domain",)),
    ("WTFPL", ("wtfpl-copies",)),
)
# A tag for each licence; shorter rules come last.
SENTENCES |= {f"spdx-{name}": f"SPDX-License-Identifier: {name}" for name, _ in RULES}
RULES += tuple((name, (f"spdx-{name}",)) for name in sorted({name for name, _ in RULES}))

#: Every rule has a sentence with one of these; texts without them match none.
SIGNS = re.compile(rb"licen|copyright|permission|warrant|public domain|distribut|covered (?:code|software)")

_WORDS = re.compile(rb"[a-z0-9]+")
#: A sentence ends at a mark before white space, at a colon that ends a line, at an empty line, or at the end.
_END = re.compile(rb"(?<!\x20v)(?<!\x20[Ii]nc)(?<!\x20[Ll]td)(?<!\x20[Cc]orp)(?<!\x20[Cc]o)[.!?](?=[\x20\x09-\x0D])|:(?=[\x20\x09\x0D]*\n)|[.!?:;]?\Z|\n[\x20\x09\x0D]*\n")


# Where licences name their holder; in the normal form all holders are one.
HOLDERS = (
    (re.compile(rb"^this software is provided by .{1,150}? as is and any"), b"this software is provided by holder as is and any"),
    (re.compile(rb"^neither the names? of .{1,150}? may be used to endorse"), b"neither the name of holder may be used to endorse"),
    (re.compile(rb"^the names? of .{1,150}? may not be used to endorse"), b"the name of holder may not be used to endorse"),
    (re.compile(rb"^except as contained in this notice the names? of .{1,150}? shall not be used"), b"except as contained in this notice the name of holder shall not be used"),
    (re.compile(rb"prior written authorization from .{1,150}$"), b"prior written authorization from holder"),
    (re.compile(rb"^the software is provided as is and .{1,150}? disclaims? all warranties"), b"the software is provided as is and holder disclaims all warranties"),
    (re.compile(rb"^in no event shall .{1,250}? be liable"), b"in no event shall holder be liable"),
)
_MARK = re.compile(rb"^(?:[0-9]{1,2}|[a-z]|i{2,3}|iv)\x20")


def normal(sentence: bytes) -> bytes:
    """Words in small letters, one blank between, without a first word that may number an item, any holder's name being one."""
    out = _MARK.sub(b"", b" ".join(_WORDS.findall(sentence.translate(ASCII_LOWER))))
    if out.startswith((b"this soft", b"neither ", b"the ", b"except ", b"in no ")):
        for pattern, one in HOLDERS:
            out = pattern.sub(one, out)
    return out


def _known() -> dict[bytes, str]:
    return {normal(s.encode()): k for k, s in SENTENCES.items()}


KNOWN = _known()
LONGEST = max(len(k.split()) for k in KNOWN)


def sentences(text: bytes):
    """(start, end) of sentences, in order."""
    at = 0
    for m in _END.finditer(text):
        if m.end() > at:
            yield at, m.end()
            at = m.end()


def identified(text: bytes) -> list[tuple[int, int, int, str]]:
    """(number of the sentence, start, end, identifier) of known sentences, in order.

    A sentence is tried whole and, when it has line breaks and is not known, by
    every stretch of successive lines that ends with it or is one line, as titles
    above a sentence have no mark of their own.
    """
    out = []
    for number, (s, e) in enumerate(sentences(text)):
        whole = text[s:e]
        known = KNOWN.get(normal(whole))
        if known:
            out.append((number, s, e, known))
            continue
        if b"\n" not in whole:
            continue
        cut, at = [], s
        for line in whole.split(b"\n"):
            cut.append((at, at + len(line)))
            at += len(line) + 1
        tail, words = None, []
        for k in range(len(cut) - 1, 0, -1):
            words = normal(text[cut[k][0] : cut[k][1]]).split() + words
            if len(words) > LONGEST:
                break
            known = KNOWN.get(b" ".join(words))
            if known:
                tail = (number, cut[k][0], e, known)
                cut = cut[:k]
                break
        for a, b in cut:
            known = KNOWN.get(normal(text[a:b]))
            if known:
                out.append((number, a, b, known))
        if tail:
            out.append(tail)
    return out


def matched(ids: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, licence) of rules over a sequence of identifiers, in order."""
    used = [False] * len(ids)
    out = []
    for licence, rule in RULES:
        for first in range(len(ids)):
            if used[first] or ids[first][3] != rule[0]:
                continue
            taken = [first]
            for want in rule[1:]:
                k = taken[-1] + 1
                while k < len(ids) and ids[k][0] - ids[taken[-1]][0] <= GAP + 1 and (used[k] or ids[k][3] != want):
                    k += 1
                if k == len(ids) or ids[k][0] - ids[taken[-1]][0] > GAP + 1:
                    break
                taken.append(k)
            if len(taken) == len(rule):
                for k in taken:
                    used[k] = True
                out.append((ids[first][1], ids[taken[-1]][2], licence))
    return sorted(out)


FOUND = "doc_id long, found array<struct<licence:string,start:long,end:long>>"
FOUND_TYPE = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanned(batches):
    for batch in batches:
        for lo, hi, data, offsets in slabs(batch.column("text")):
            at = np.array([m.start() for m in SIGNS.finditer(data.translate(ASCII_LOWER))], np.int64)
            out: list[list[dict]] = [[] for _ in range(hi - lo)]
            for k in np.unique(np.searchsorted(offsets, at, "right") - 1).tolist():
                text = data[offsets[k] : offsets[k + 1]]
                found = matched(identified(text))
                flat = points(text, [x for s, e, _ in found for x in (s, e)])
                out[k] = [{"licence": name, "start": flat[2 * i], "end": flat[2 * i + 1]} for i, (_, _, name) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(out, FOUND_TYPE)], ["doc_id", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found) for every row of docs: licences with places in code points, ends exclusive, in order.

    Null texts are empty; other columns are not looked at; repeated rows repeat.
    """
    return with_key(docs).select("doc_id", "text").mapInArrow(tidied(_scanned), FOUND)


def digest(docs: DataFrame) -> DataFrame:
    """What query op5_licences returns: a row for every row of docs, `licences` sorted, distinct, comma-joined.

    Null and empty texts have none; an empty table gives an empty one.  A whole
    licence that ends with a notice to copy has that notice's licence, too.
    """
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["licence"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["licence"]))), ",")
    return scan(docs).select("doc_id", F.size("found").cast("long").alias("n_found"), names.alias("licences"), spans.alias("spans"))
