"""Licences named in texts, recognised sentence by sentence.

Built-in functions only. A text is cut into sentences, each is normalised and looked up in a map of known
licence sentences; a sentence that names licences has the names looked up, singly or joined by ``and`` or ``or``. The sequence of the
identifiers is matched with ordered rules. The rules are tried from the longest to the shortest, and what a rule has used no
later rule can use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.columns import let

#: A sentence without any of these word beginnings is no licence sentence.
TRIGGERS = ("licen", "copyright", "permission", "warrant", "redistribut", "as is", "public domain")

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheRef",
    "licensed under the apache license version 2 0 the license": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheWarranty",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheLimits",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this software is released under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplWarranty",
    "see the gnu general public license for more details": "GplSee",
    "licensed under cc by nc 4 0": "CcByNc4Ref",
    "licensed under cc by 4 0": "CcBy4Ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4Ref",
    "licensed under the bsd 3 clause license": "Bsd3Ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdNames",
    "all rights reserved": "Reserved",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Form",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "Lgpl21Later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplWarranty",
    "see the gnu lesser general public license for more details": "LgplSee",
}

#: Licences that are referred to by name: identifier, licence, names, versions.
FAMILIES = (
    ("ApacheRef", "Apache-2.0", ("apache", "apache license", "apache software license"), ("2 0", "2")),
    ("MitRef", "MIT", ("mit", "expat", "mit expat"), ("",)),
    ("Gpl3Ref", "GPL-3.0-only", ("gpl", "gnu gpl", "gnu general public license"), ("3 0", "3")),
    ("Gpl2Ref", "GPL-2.0-only", ("gpl", "gnu gpl", "gnu general public license"), ("2 0", "2")),
    ("Lgpl3Ref", "LGPL-3.0-only", ("lgpl", "gnu lgpl", "gnu lesser general public license"), ("3 0", "3")),
    ("Lgpl21Ref", "LGPL-2.1-only", ("lgpl", "gnu lgpl", "gnu lesser general public license"), ("2 1",)),
    ("Agpl3Ref", "AGPL-3.0-only", ("agpl", "gnu agpl", "gnu affero general public license"), ("3 0", "3")),
    ("Mpl2Ref", "MPL-2.0", ("mpl", "mozilla public license"), ("2 0", "2")),
    ("Epl2Ref", "EPL-2.0", ("epl", "eclipse public license"), ("2 0", "2")),
    ("Bsd3Ref", "BSD-3-Clause", ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"), ("",)),
    ("Bsd2Ref", "BSD-2-Clause", ("bsd 2 clause", "2 clause bsd", "simplified bsd"), ("",)),
    ("IscRef", "ISC", ("isc",), ("",)),
    ("ZlibRef", "Zlib", ("zlib",), ("",)),
    ("BoostRef", "BSL-1.0", ("boost software license", "boost software", "bsl"), ("1 0",)),
    ("UnlicenseRef", "Unlicense", ("unlicense",), ("",)),
    ("Cc0Ref", "CC0-1.0", ("cc0", "creative commons zero"), ("", "1 0", "1 0 universal")),
    ("CcBy4Ref", "CC-BY-4.0", ("cc by", "creative commons attribution"), ("4 0", "4 0 international")),
    ("CcBySa4Ref", "CC-BY-SA-4.0", ("cc by sa", "creative commons attribution sharealike"), ("4 0", "4 0 international")),
    ("CcByNc4Ref", "CC-BY-NC-4.0", ("cc by nc", "creative commons attribution noncommercial"), ("4 0", "4 0 international")),
)
#: What may follow the name of a licence that can be had in a later version too.
LATER = (" or later", " or any later version", " or newer")


def _names() -> dict[str, str]:
    """Normalised names of licences and their identifiers; ``license`` at the end is not part of a name."""
    found = {}
    for name, license_name, bases, versions in FAMILIES:
        ways = {" ".join(f"{base} {v}{version}".split()) for base in bases for version in versions for v in ("", "v", "version ", "v ") if version or not v}
        ways |= {f"{base}v{version}" for base in bases for version in versions if version}
        found |= {way: name for way in ways}
        if license_name.endswith("-only"):
            found |= {f"{way} only": name for way in ways}
            found |= {way + later: name.removesuffix("Ref") + "LaterRef" for way in ways for later in LATER}
    return found


#: How a sentence begins that names licences. ``License:`` and its like are sentences of two parts.
SUBJECT = (
    "^(?:(?:this|the) (?:project|work|software|program|file|code|library|package|repository|document) is )?(?:dual )?"
    "(?:licensed|released|distributed|available) under (?:either )?(?:of )?(?:the )?(?:terms of )?(?:the )?"
    "|^spdx license identifier |^(?:project )?license "
)

#: Sentences that line wraps, comment marks, semicolons or colons have cut are put together again from at most so many parts.
PARTS = 14


#: Ordered rules, the longer before the shorter.
RULES = (
    (("ApacheRef", "ApacheUse", "ApacheCopy", "ApacheWarranty", "ApacheLimits"), "Apache-2.0"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdNames"), "BSD-3-Clause"),
    (("MitGrant", "MitNotice", "MitWarranty"), "MIT"),
    (("Gpl3Later", "GplWarranty", "GplSee"), "GPL-3.0-or-later"),
    (("Gpl2Later", "GplWarranty", "GplSee"), "GPL-2.0-or-later"),
    (("Lgpl21Later", "GplWarranty", "LgplSee"), "LGPL-2.1-or-later"),
    (("BsdGrant", "BsdSource", "BsdBinary"), "BSD-2-Clause"),
    (("Gpl3Later",), "GPL-3.0-or-later"),
    (("Gpl2Later",), "GPL-2.0-or-later"),
    (("Lgpl21Later",), "LGPL-2.1-or-later"),
    (("MitGrant", "MitNotice"), "MIT"),
    (("ApacheRef",), "Apache-2.0"),
    (("MitRef",), "MIT"),
    (("Gpl3Ref",), "GPL-3.0-only"),
    (("CcByNc4Ref",), "CC-BY-NC-4.0"),
    (("CcBy4Ref",), "CC-BY-4.0"),
    (("Bsd3Ref",), "BSD-3-Clause"),
    (("Bsd2Ref",), "BSD-2-Clause"),
    (("Gpl2Ref",), "GPL-2.0-only"),
    (("Lgpl3Ref",), "LGPL-3.0-only"),
    (("Lgpl21Ref",), "LGPL-2.1-only"),
    (("IscGrant",), "ISC"),
    (("IscRef",), "ISC"),
    (("Mpl2Form",), "MPL-2.0"),
    (("Mpl2Ref",), "MPL-2.0"),
    (("Cc0Ref",), "CC0-1.0"),
    *[((name.removesuffix("Ref") + "LaterRef",), lic.removesuffix("-only") + "-or-later") for name, lic, _, _ in FAMILIES if lic.endswith("-only")],
    (("Agpl3Ref",), "AGPL-3.0-only"),
    (("Epl2Ref",), "EPL-2.0"),
    (("ZlibRef",), "Zlib"),
    (("BoostRef",), "BSL-1.0"),
    (("UnlicenseRef",), "Unlicense"),
    (("CcBySa4Ref",), "CC-BY-SA-4.0"),
)

#: Identifiers of sentences that are not in the list: a line of copyright, or anything else with a trigger.
COPYRIGHT, UNKNOWN = "Copyright", "Unknown"


def _table(entries: dict[str, str]) -> Column:
    """A constant map."""
    return F.map_from_arrays(F.array(*map(F.lit, entries)), F.array(*map(F.lit, entries.values())))


def cut(text: Column) -> Column:
    """The sentences of a text, normalised: words in lower case, one blank between them."""
    # A line of an address is apart from the sentence before it.
    marked = F.regexp_replace(text, "\\n[^\\p{L}\\p{N}\\n]*((?i:https?://)[^ \\t\\r\\n]*)", "\u0001$1\u0001")
    marked = F.regexp_replace(marked, "([.!?;:])[ \\t\\r\\n]+", "$1\u0001")
    # A line break ends a sentence unless the next line goes on in lower case.
    marked = F.regexp_replace(marked, "[ \\t\\r]*\\n[ \\t\\r\\n]*([^a-z \\t\\r\\n])", "\u0001$1")
    plain = F.transform(F.split(marked, "\u0001"), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^\\p{L}\\p{N}]+", " ")))
    return F.filter(plain, lambda s: s != "")


def _referred(sentence: Column, names: Column) -> Column:
    """The identifiers of the licences that a sentence names, joined by ``and`` or ``or``; null unless all are known."""
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, "^the ", ""), " licen[cs]es?$", "")

    def looked_up(rest: Column) -> Column:
        whole = F.element_at(names, bare(rest))
        parts = F.transform(F.split(rest, " (?:and|or) "), lambda p: F.element_at(names, bare(p)))
        all_known = F.when(~F.exists(parts, lambda p: p.isNull()), parts)
        return F.when(sentence != rest, F.coalesce(F.when(whole.isNotNull(), F.array(whole)), all_known))

    return let(F.regexp_replace(sentence, SUBJECT, ""), looked_up)


def sentences(text: Column) -> Column:
    """The identifiers of the sentences of a text that speak of licences, in order."""
    known, names = _table(SENTENCES), _table(_names())
    begins = F.array(*[F.lit(b) for b in sorted({" ".join(s.split()[:2]) for s in SENTENCES})])
    first_words = lambda s: F.substring_index(s, " ", 2)

    def recognised(parts: Column) -> Column:
        def joined(i: Column, n: int) -> Column:
            return F.array_join(F.slice(parts, i + 1, n), " ")

        def named_in(i: Column, n: int) -> Column:
            found = lambda x: F.when(x.isNotNull(), F.struct(F.lit(n).alias("n"), x.alias("ids")))
            return let(_referred(joined(i, n), names), found)

        def at(s: Column, i: Column) -> Column:
            """The longest sentence that begins with a part: how many parts it has, and its identifiers."""
            listed = [
                F.when(F.size(parts) >= i + n, F.element_at(known, joined(i, n))) for n in range(PARTS, 0, -1)
            ]
            found = [
                F.when(x.isNotNull(), F.struct(F.lit(n).alias("n"), F.array(x).alias("ids"))) for n, x in zip(range(PARTS, 0, -1), listed)
            ]
            named = [named_in(i, n) for n in (1, 2, 3)]
            of_name = F.when(joined(i, 3).rlike(SUBJECT), F.coalesce(*named))
            # Few sentences begin like a listed one, so few are looked up at all.
            return F.coalesce(F.when(F.array_contains(begins, first_words(s)), F.coalesce(*found)), of_name)

        def other(s: Column) -> Column:
            name = F.when(s.startswith("copyright "), COPYRIGHT).otherwise(UNKNOWN)
            return F.when(s.rlike("|".join(TRIGGERS)), F.array(name)).otherwise(F.array().cast("array<string>"))

        def walked(hits: Column) -> Column:
            """From left to right: a recognised sentence uses its parts up."""
            start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("ids"))

            def step(state: Column, i: Column) -> Column:
                hit = F.get(hits, i)
                taken = F.struct((i + hit["n"]).alias("free"), F.concat(state["ids"], hit["ids"]).alias("ids"))
                plain = F.struct((i + 1).alias("free"), F.concat(state["ids"], other(F.get(parts, i))).alias("ids"))
                return F.when(i < state["free"], state).when(hit.isNotNull(), taken).otherwise(plain)

            places = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(places, start, step, lambda state: state["ids"])

        return let(F.transform(parts, at), walked)

    return let(cut(text), recognised)


#: References may have no trigger either.
_NAMED = "(?:released|distributed|available)[^\\p{L}\\p{N}]+under[^\\p{L}\\p{N}]"

#: Known sentences in which no trigger stands.
_WITHOUT_TRIGGER = tuple(s for s in SENTENCES if not any(t in s for t in TRIGGERS) and s != "all rights reserved")


def scan(
    docs: DataFrame,
    text_col: str = "text",
    sentences_col: str = "license_sentences",
    licenses_col: str = "licenses",
    unknown_col: str = "n_unknown",
) -> DataFrame:
    """``docs`` with the identifiers of licence sentences in order, the licences found, and unknown sentences counted.

    A licence is listed once, in the order of the rules. A text without licence sentences, an empty and a null text
    have empty lists and no unknown sentence. All rows and other columns stay; the three new columns
    replace columns of the same names. Texts are scanned whole; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Texts without any trigger are not cut at all; they cannot hold a listed sentence.
    apart = [t.replace(" ", "[^\\p{L}\\p{N}]+") for t in (*TRIGGERS, "all rights reserved", *_WITHOUT_TRIGGER)]
    found = F.when(F.lower(text).rlike("|".join([*apart, _NAMED])), sentences(text))
    out = docs.withColumn(sentences_col, F.coalesce(found, F.array().cast("array<string>")))
    # What rules match on: identifiers between semicolons, without those that stand between a licence's own.
    rest = F.concat(F.lit(";"), F.array_join(F.filter(sentences_col, lambda x: ~x.isin(COPYRIGHT, "Reserved", UNKNOWN)), ";"), F.lit(";"))
    names = []
    for rule, license_name in RULES:
        wanted = ";" + ";".join(rule) + ";"
        names.append(F.when(F.contains(rest, F.lit(wanted)), F.lit(license_name)))
        rest = F.replace(rest, F.lit(wanted), F.lit(";;"))
    licenses = F.array_distinct(F.array_compact(F.array(*names)))
    unknown = F.size(F.filter(sentences_col, lambda x: x == UNKNOWN)).cast("long")
    return out.withColumn(licenses_col, F.when(F.size(sentences_col) > 0, licenses).otherwise(F.array().cast("array<string>"))).withColumn(
        unknown_col, unknown
    )
