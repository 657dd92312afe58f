"""Licences as they stand in files: wrapped, in comments, on one line, with holders' names."""

import re
import textwrap

import pytest

from tastemill.llm import licenses
from tastemill.llm.licenses import HINT, known_sentences, licence_scan, words_of

AS_IS = 'EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.'
BSD_2 = [
    "Copyright (c) 2019, Ada Example\nAll rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    f'THIS SOFTWARE IS PROVIDED BY ADA EXAMPLE AND CONTRIBUTORS "AS IS" AND ANY {AS_IS}',
]
BSD_3 = [*BSD_2[:4], "3. Neither the name of Example Works, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", BSD_2[4]]
MIT = [
    "MIT License", "Copyright (c) 2021 Ada Example",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.',
]


def gpl(name, version, end="either version {} of the License, or (at your option) any later version.", program="This program", thing="program"):
    return [
        "Copyright (C) 2020 Ada Example",
        f"{program} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {end.format(version)}",
        f"{program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.",
        f"You should have received a copy of the {name} along with this {thing}. If not, see <https://www.gnu.org/licenses/>.",
    ]


GPL, LGPL, AGPL = ("GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License")
TEXTS = {
    "MIT": MIT,
    "MIT without warranty": MIT[:4],
    "ISC": [
        "ISC License", "Copyright (c) 2018 Ada Example <ada@example.org>",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.',
    ],
    "BSD-2-Clause": BSD_2,
    "BSD-3-Clause": BSD_3,
    "Apache-2.0 header": [
        "Copyright 2022 Ada Example",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "    http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "Apache-2.0 text": [
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "1. Definitions.",
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
        "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "GPL-3.0-or-later": gpl(GPL, "3"),
    "GPL-3.0-or-later with a name": gpl(GPL, "3", program="Wordmill"),
    "GPL-2.0-or-later": gpl(GPL, "2", "either version {} of the License, or (at your option) any later version."),
    "GPL-2.0-only": gpl(GPL, "2", "version {} of the License."),
    "LGPL-2.1-or-later": gpl(LGPL, "2.1", program="This library", thing="library"),
    "LGPL-3.0-or-later": gpl(LGPL, "3", program="This library", thing="library"),
    "AGPL-3.0-or-later": gpl(AGPL, "3"),
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, Ada Example has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Apache-2.0 notice": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."],
}


def wrapped(parts):
    return "\n\n".join("\n".join(textwrap.fill(line, 72) for line in p.split("\n")) for p in parts)


FORMS = {
    "wrapped": wrapped,
    "windows": lambda p: wrapped(p).replace("\n", "\r\n"),
    "block comment": lambda p: "/*\n" + "\n".join(f" * {line}".rstrip() for line in wrapped(p).split("\n")) + "\n */\nint main() {}\n",
    "hash comment": lambda p: "#!/bin/sh\n#\n" + "\n".join(f"# {line}".rstrip() for line in wrapped(p).split("\n")) + "\necho\n",
    "slash comment": lambda p: "\n".join(f"// {line}" for line in wrapped(p).split("\n")),
    "one line": lambda p: " ".join(" ".join(p).split()),
    "in a text": lambda p: f"Some words before. More of them.\n\n{wrapped(p)}\n\nAnd a text that goes on.",
}
ABOUT = [
    "The MIT License is a short permissive licence. It says that permission is hereby granted to use the software.", "We moved from the GPL to the Apache License, Version 2.0 last year.",
    "Is this work licensed under a Creative Commons Attribution 4.0 International License or not?", "Copyright law in many countries grants all rights reserved by default.",
    "Redistribution and use of the data is a question of its licence; see the BSD-2-Clause text.", "The Software is furnished to persons. Licence: unknown", "",
]


def test_published_texts_in_all_forms(spark, make_docs):
    cases = [(name, form) for name in TEXTS for form in FORMS]
    rows = {r["doc_id"]: r for r in licence_scan(make_docs(*[(i, FORMS[f](TEXTS[n])) for i, (n, f) in enumerate(cases)])).collect()}
    wrong = {c: rows[i]["licences"] for i, c in enumerate(cases) if rows[i]["licences"] != [c[0].split(" ")[0]]}
    assert not wrong


def test_texts_about_licences_have_none(spark, make_docs):
    assert [r["licences"] for r in licence_scan(make_docs(*enumerate(ABOUT))).collect()] == [[]] * len(ABOUT)


def test_several_licences_and_their_order(spark, make_docs):
    both = wrapped(BSD_3) + "\n\n" + wrapped(MIT) + "\n\n" + wrapped(BSD_2)
    row = licence_scan(make_docs((1, both))).first()
    assert row["licences"] == ["BSD-3-Clause", "MIT", "BSD-2-Clause"]
    assert row["licence_sentences"][:6] == ["all-rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]


def test_thousands_of_sentences_between_two_of_a_licence(spark, make_docs):
    apart = "A sentence of another matter stands here. " * 20_000
    texts = [apart.join(p + "\n\n" for p in BSD_3[:-1]), apart.join(p + "\n\n" for p in gpl(GPL, "3")), f"{wrapped(BSD_2[:3])}\n\n{apart}"]
    rows = licence_scan(make_docs(*enumerate(texts))).orderBy("doc_id").collect()
    assert [r["licences"] for r in rows] == [["BSD-3-Clause"], ["GPL-3.0-or-later"], []]
    assert rows[2]["n_sentences"] > 20_000 and rows[2]["licence_sentences"] == ["all-rights", "bsd-grant", "bsd-source"]


def test_rules_of_ones_own_may_let_their_own_sentences_stand_between(spark, make_docs):
    rules = (licenses.LicenceRule("own", ("bsd-grant", "all-rights"), ("all-rights", "never met")), licenses.LicenceRule("rest", ("all-rights",)))
    text = "All rights reserved.\n\n" + BSD_2[1] + "\n\nWords.\n\nAll rights reserved.\n\nMore words.\n\nAll rights reserved."
    assert licence_scan(make_docs((1, text)), rules=rules).first()["licences"] == ["rest", "own"]


def test_plan_has_no_python(spark, make_docs):
    plan = licence_scan(make_docs((1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_tables_agree_with_themselves():
    known = known_sentences()
    assert all(re.search(HINT, words) for words in known) and all(words_of(words) == words for words in known)
    named = {s for r in licenses.RULES for s in (*r.sentences, *r.between)}
    assert named <= set(known.values())


@pytest.mark.parametrize("text, number", [("One. Two!  Three?\nand the rest", 4), ("a line\nof one sentence\n\nand another", 2), ("- one\n- two\n- three", 3), ("1. 2. 3.", 0)])
def test_sentences(spark, make_docs, text, number):
    assert licence_scan(make_docs((1, text))).first()["n_sentences"] == number
