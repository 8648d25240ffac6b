"""Licence scan by sentence rules.

A text is cut into sentences (at line ends, and at . ! ? ; : before white space), each normalised to lower-case
words and numbers. Comment leaders are no words. Lines that follow one another, without a blank one between, are joined where
together they are a known sentence, so that wrapped texts are found too. Normalised sentences that are known get their identifier; the identifiers of a text, in
order, are its licence sequence. Ordered rules, each a sequence of identifiers, are matched against it: a rule
fits where its identifiers follow one another in the sequence, with at most GAP others between two, and the first rule of each licence that fits
names the evidence.

Defined cases: a null or empty text has no sentences and no licence; a sentence that occurs twice counts twice;
equal rows get equal rows; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import per_text

_CUT = re.compile(r"(?<!\bv)(?<!spdx-license-identifier)[.!?;:](?=[ \t\r\n])|[.!?;:]$")
_LEADER = re.compile(r"(?m)^[^\S\n]*(?:(?:rem|dnl)\b|[^\w\s]+)")
_WORD = re.compile(r"[a-z0-9]+")

# Public licences' sentences, as normalised words. identifier -> sentence
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-2.0-licensed": "licensed under the apache license version 2 0",
    "apache-2.0-licensed-short": "licensed under the apache license 2 0",
    "apache-2.0-compliance": "you may not use this file except in compliance with the license",
    "apache-2.0-copy": "you may obtain a copy of the license at",
    "apache-2.0-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "gpl-3.0-work": "this work is licensed under the gnu general public license version 3",
    "gpl-2.0-work": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software",
    "lgpl-free": "this library is free software",
    "gpl-3.0-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2.0-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-3.0-only-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
    "gpl-2.0-only-terms": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl-3.0-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-2.1-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl-3.0-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "later-2.0": "either version 2 of the license or at your option any later version",
    "later-2.1": "either version 2 1 of the license or at your option any later version",
    "later-3.0": "either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorsement": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-licensed": "licensed under the bsd license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2.0-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-grant": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0-dedicated": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "boost-1.0": "distributed under the boost software license version 1 0",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "wtfpl-title": "do what the fuck you want to public license",
}
# The attribution licences' elements and versions, and the identifiers that SPDX tags name.
CC_ELEMENTS = {"by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderivatives", "by-nc": "attribution noncommercial", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
CC_VERSIONS = {"3.0": "3 0 unported", "4.0": "4 0 international"}
SPDX_IDS = (
    "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC 0BSD GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later "
    "AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 BSL-1.0 Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0"
).split()
#: Known sentences that an identifier sequence may have between two of a rule's.
GAP = 2
#: (rule, licence, identifiers); earlier rules of a licence are the stronger evidence.
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit-full", "MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("mit-terms", "MIT", ("mit-grant", "mit-condition")),
    ("mit-notice", "MIT", ("mit-released",)),
    ("mit-notice-licensed", "MIT", ("mit-licensed",)),
    ("mit-spdx", "MIT", ("spdx-mit",)),
    ("mit-title", "MIT", ("mit-title",)),
    ("apache-full", "Apache-2.0", ("apache-2.0-licensed", "apache-2.0-compliance", "apache-2.0-copy", "apache-2.0-as-is")),
    ("apache-notice", "Apache-2.0", ("apache-2.0-licensed",)),
    ("apache-notice-short", "Apache-2.0", ("apache-2.0-licensed-short",)),
    ("apache-spdx", "Apache-2.0", ("spdx-apache-2.0",)),
    ("isc-full", "ISC", ("isc-grant", "isc-warranty")),
    ("isc-terms", "ISC", ("isc-grant",)),
    ("0bsd-full", "0BSD", ("0bsd-grant", "isc-warranty")),
    ("gpl3-full", "GPL-3.0", ("gpl-free", "gpl-3.0-terms")),
    ("gpl3-notice", "GPL-3.0", ("gpl-3.0-work",)),
    ("gpl3-terms", "GPL-3.0", ("gpl-3.0-terms",)),
    ("gpl3-only", "GPL-3.0", ("gpl-3.0-only-terms",)),
    ("gpl2-full", "GPL-2.0", ("gpl-free", "gpl-2.0-terms")),
    ("gpl2-notice", "GPL-2.0", ("gpl-2.0-work",)),
    ("gpl2-terms", "GPL-2.0", ("gpl-2.0-terms",)),
    ("gpl2-only", "GPL-2.0", ("gpl-2.0-only-terms",)),
    ("gpl3-parts", "GPL-3.0", ("gpl-terms", "later-3.0")),
    ("gpl2-parts", "GPL-2.0", ("gpl-terms", "later-2.0")),
    ("lgpl3-terms", "LGPL-3.0", ("lgpl-3.0-terms",)),
    ("lgpl3-parts", "LGPL-3.0", ("lgpl-terms", "later-3.0")),
    ("lgpl21-terms", "LGPL-2.1", ("lgpl-2.1-terms",)),
    ("lgpl21-parts", "LGPL-2.1", ("lgpl-terms", "later-2.1")),
    ("agpl3-terms", "AGPL-3.0", ("agpl-3.0-terms",)),
    ("agpl3-parts", "AGPL-3.0", ("agpl-terms", "later-3.0")),
    ("cc-by", "CC-BY-4.0", ("cc-by-4.0",)),
    ("cc-by-work", "CC-BY-4.0", ("cc-by-4.0-work",)),
    ("cc-by-sa", "CC-BY-SA-4.0", ("cc-by-sa-4.0",)),
    ("cc-by-nc", "CC-BY-NC-4.0", ("cc-by-nc-4.0",)),
    ("cc-by-nc-work", "CC-BY-NC-4.0", ("cc-by-nc-4.0-work",)),
    ("bsd4-terms", "BSD-4-Clause", ("bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorsement")),
    ("bsd3-terms", "BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-endorsement")),
    ("bsd2-terms", "BSD-2-Clause", ("bsd-source", "bsd-binary", "bsd-warranty")),
    ("bsd-terms", "BSD", ("bsd-redistribution",)),
    ("bsd-notice", "BSD", ("bsd-licensed",)),
    ("mpl2-notice", "MPL-2.0", ("mpl-2.0",)),
    ("unlicense-full", "Unlicense", ("unlicense-domain", "unlicense-grant")),
    ("unlicense-notice", "Unlicense", ("unlicense-domain",)),
    ("cc0-dedication", "CC0-1.0", ("cc0-dedicated",)),
    ("boost-notice", "BSL-1.0", ("boost-1.0",)),
    ("zlib-full", "Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("wtfpl", "WTFPL", ("wtfpl-title",)),
]
for _e, _words in CC_ELEMENTS.items():
    for _v, _version in CC_VERSIONS.items():
        SENTENCES[f"cc-{_e}-{_v}-work"] = f"this work is licensed under a creative commons {_words} {_version} license"
        SENTENCES[f"cc-{_e}-{_v}"] = f"licensed under cc {_e} {_v}".translate(str.maketrans("-.", "  "))
        RULES += [(f"cc-{_e}-{_v}{x}", f"CC-{_e.upper()}-{_v}", (f"cc-{_e}-{_v}{x}",)) for x in ("-work", "")]
for _i in SPDX_IDS:
    SENTENCES[f"spdx-{_i.lower()}"] = f"spdx license identifier {_i.lower()}".translate(str.maketrans("-.", "  "))
    RULES.append((f"spdx-{_i.lower()}", _i, (f"spdx-{_i.lower()}",)))
#: Other wordings of known sentences: wording -> identifier.
VARIANTS = {
    "licensed under the apache license version 2 0 the license": "apache-2.0-licensed",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2.0-copy",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": "gpl-2.0-only-terms",
    "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedicated",
    "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorsement",
    "this software is provided as is without any express or implied warranties": "zlib-warranty",
}
#: Every known sentence has one of these; a text without any is not cut up.
ANCHORS = ("licen", "permission", "warrant", "redistribut", "free software", "copyright", "public domain", "liable", "acknowledgement", "endorse", "mpl was", "free to copy")


def normalised(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence))


class SentenceRules:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, str, tuple[str, ...]]] = RULES):
        self.known = {s: i for i, s in sentences.items()} | {s: i for s, i in VARIANTS.items() if i in sentences}
        self.begun = {" ".join(w[:n]) for s in self.known for w in [s.split()] for n in range(1, len(w))}
        self.rules = rules
        self.anchors = ANCHORS if all(any(a in s for a in ANCHORS) for s in self.known) else ("",)

    def sentence_ids(self, text: str) -> list[str]:
        text = text.lower()
        if not any(a in text for a in self.anchors):
            return []
        ids = []
        for sentence in _CUT.split(_LEADER.sub("", text)):
            lines = [normalised(line) for line in sentence.split("\n")]
            at = 0
            while at < len(lines):
                joined, end, found = lines[at], at + 1, None
                after = end
                while joined:
                    if joined in self.known:
                        found, after = self.known[joined], end
                    if joined not in self.begun or end == len(lines) or not lines[end]:
                        break
                    joined, end = f"{joined} {lines[end]}", end + 1
                if found:
                    ids.append(found)
                at = after
        return ids

    def matches(self, ids: list[str]) -> list[tuple[str, str]]:
        """(licence, rule) of the first fitting rule of each licence, sorted by licence."""
        found: dict[str, str] = {}
        have = set(ids)
        for rule, licence, wanted in self.rules:
            if licence not in found and have.issuperset(wanted) and follows(ids, wanted):
                found[licence] = rule
        return sorted(found.items())


def follows(ids: list[str], wanted: tuple[str, ...], gap: int = GAP) -> bool:
    """Whether the wanted identifiers stand in ids in their order, with at most gap others between two of them."""
    ends = [k for k, i in enumerate(ids) if i == wanted[0]]
    for w in wanted[1:]:
        ends = sorted({k for e in ends for k in range(e + 1, min(e + 2 + gap, len(ids))) if ids[k] == w})
    return bool(ends)


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, number of known sentences, their identifiers in order, licences and evidence (comma-joined, by licence)."""

    def make() -> Callable[[str], tuple]:
        scan = SentenceRules()

        def fn(t: str) -> tuple:
            ids = scan.sentence_ids(t)
            found = scan.matches(ids)
            return len(ids), ",".join(ids), ",".join(x for x, _ in found), ",".join(r for _, r in found)

        return fn

    fields = [T.StructField("n_sentences", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("sentence_ids", "licenses", "rules")]
    return per_text(docs, [doc_id], text, fields, make)
