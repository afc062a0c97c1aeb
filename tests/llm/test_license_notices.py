"""Licences in their canonical notices, wrapped and commented."""

from runloom.llm import licenses

GPL = """This {what} is free software: you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name} for more details."""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""

WANTED = [
    (GPL.format(what="program", name="General Public License", version="3"), "GPL-3.0-or-later", 3),
    (GPL.format(what="program", name="General Public License", version="2"), "GPL-2.0-or-later", 3),
    (GPL.format(what="library", name="Lesser General Public License", version="2.1"), "LGPL-2.1-or-later", 3),
    (APACHE, "Apache-2.0", 5),
    (ISC, "ISC", 1),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy is lost, stop.", "MPL-2.0", 1),
    ("This project is licensed under the MIT License.", "MIT", 1),
    ("Licensed under the\nMIT License", "MIT", 1),
    ("This work is released under CC0 1.0 Universal.", "CC0-1.0", 1),
    ("Licensed under the GPL v2.", "GPL-2.0-only", 1),
]


def test_canonical_notices(spark):
    rows = [(2 * n, t) for n, (t, _, _) in enumerate(WANTED)]
    rows += [(2 * n + 1, "\n".join(f" # {x}" for x in t.split("\n"))) for n, (t, _, _) in enumerate(WANTED)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    for n, (text, name, known) in enumerate(WANTED):
        for r in (got[2 * n], got[2 * n + 1]):
            assert list(r.licenses) == [name], (text, r.license_sentences)
            assert sum(x != "Unknown" for x in r.license_sentences) == known, (text, r.license_sentences)


def test_sentences_about_licences_stay_unknown(spark):
    rows = [(1, "He wrote that it is licensed under the MIT License and left.")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id LONG, text STRING")).first()
    assert (list(got.licenses), got.n_unknown) == ([], 1)
