"""The licence scan against a plain version, over odd texts and the whole table, and licences by name."""

import duckdb
import pytest
import regex
from test_license_notices import APACHE, GPL, ISC

import __spark_entry__ as entry
from runloom.llm import licenses

NAMES = licenses._names()
TRIGGER = regex.compile("|".join(licenses.TRIGGERS))


def parts_of(text):
    text = regex.sub(r"\n[^\p{L}\p{N}\n]*((?:[hH][tT][tT][pP][sS]?)://[^ \t\r\n]*)", "\x01\\1\x01", text)
    text = regex.sub(r"([.!?;:])[ \t\r\n]+", "\\1\x01", text)
    text = regex.sub(r"[ \t\r]*\n[ \t\r\n]*([^a-z \t\r\n])", "\x01\\1", text)
    plain = (regex.sub(r"[^\p{L}\p{N}]+", " ", s.lower()).strip(" ") for s in text.split("\x01"))
    return [s for s in plain if s]


def referred(sentence):
    rest = regex.sub(licenses.SUBJECT, "", sentence)
    if rest == sentence:
        return None
    bare = lambda s: NAMES.get(regex.sub(" licen[cs]es?$", "", regex.sub("^the ", "", s)))
    if bare(rest):
        return [bare(rest)]
    found = [bare(p) for p in regex.split(" (?:and|or) ", rest)]
    return found if all(found) else None


def scanned(text):
    parts, ids, i = parts_of(text or ""), [], 0
    while i < len(parts):
        for n in range(licenses.PARTS, 0, -1):
            if i + n <= len(parts) and " ".join(parts[i : i + n]) in licenses.SENTENCES:
                found = [licenses.SENTENCES[" ".join(parts[i : i + n])]]
                break
        else:
            for n in (1, 2, 3):
                found = referred(" ".join(parts[i : i + n]))
                if found:
                    n = min(n, len(parts) - i)
                    break
            else:
                n, found = 1, []
                if TRIGGER.search(parts[i]):
                    found = [licenses.COPYRIGHT if parts[i].startswith("copyright ") else licenses.UNKNOWN]
        ids += found
        i += n
    rest = ";" + ";".join(x for x in ids if x not in (licenses.COPYRIGHT, "Reserved", licenses.UNKNOWN)) + ";"
    names = []
    for rule, name in licenses.RULES:
        wanted = ";" + ";".join(rule) + ";"
        if wanted in rest:
            names += [name] if name not in names else []
            rest = rest.replace(wanted, ";;")
    return ids, names if ids else [], sum(x == licenses.UNKNOWN for x in ids)


BY_NAME = {
    "SPDX-License-Identifier: MIT": ["MIT"],
    "License: MIT\n": ["MIT"],
    "Released under GPL-3.0-or-later.": ["GPL-3.0-or-later"],
    "Distributed under the AGPL v3": ["AGPL-3.0-only"],
    "This project is licensed under the MIT license and the Apache License 2.0.": ["Apache-2.0", "MIT"],
    "Dual licensed under MIT or Apache-2.0": ["Apache-2.0", "MIT"],
    "This work is licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0"],
    "Released under The Unlicense.": ["Unlicense"],
    "Licensed under the Boost Software License 1.0": ["BSL-1.0"],
    "SPDX-License-Identifier: GPL-2.0-only": ["GPL-2.0-only"],
    "Licensed under the Mozilla Public License, v. 2.0.": ["MPL-2.0"],
    "Licensed under the Made Up License 7": [],
}


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(3)
    return {r.doc_id: (list(r.license_sentences), list(r.licenses), r.n_unknown) for r in licenses.scan(df).collect()}


def test_licences_by_name(spark):
    got = scan(spark, list(BY_NAME))
    for n, (text, wanted) in enumerate(BY_NAME.items()):
        assert sorted(got[n][1]) == wanted, (text, got[n])


def test_scan_equals_the_plain_version(spark):
    gpl = GPL.format(what="program", name="General Public License", version="3")
    texts = [
        None, "", " \n", APACHE, gpl, ISC, APACHE + "\n\n" + gpl, "\n".join("// " + x for x in (gpl + "\n" + APACHE).split("\n")),
        "Copyright 2020 me. All rights reserved.", "copyright", "licensed under", "License:", "License: MIT. License: MIT", "é licence ñ",
        gpl.split("\n")[0], "word. " * 5_000 + APACHE, *BY_NAME, "MIT License\nPermission is granted to nobody.",
    ]
    got = scan(spark, texts)
    for n, text in enumerate(texts):
        assert got[n] == scanned(text), text


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([("MIT", "Licensed under the MIT License", 3)], "licenses STRING, text STRING, n_unknown INT")
    row = licenses.scan(df).first()
    assert (list(row.licenses), row.n_unknown) == (["MIT"], 0)
    assert licenses.scan(df.limit(0)).collect() == []


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_the_plain_version(spark, sf_dir, folder):
    sf_dir = sf_dir.replace("sf0.001", folder)
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    expected = {}
    for i, text in rows:
        ids, names, unknown = scanned(text)
        expected[i] = (";".join(ids), ";".join(names), unknown)
    got = {r.doc_id: tuple(r)[1:] for r in entry.queries()["op2_license_sentences"](spark, sf_dir).collect()}
    assert got == expected
