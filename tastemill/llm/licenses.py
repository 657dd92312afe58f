"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences as licences are laid out: comment marks at line starts go, wrapped
lines belong together, and a sentence ends at a full stop, colon, question or exclamation mark,
before a blank line or before a list mark; a line that is a known sentence by itself stands alone.
Each sentence is reduced to its words, names in known places (holders, programs, addresses) are
levelled, and the rest is looked up whole among the known licence sentences. The identifiers met, in
order, are matched against ordered rules: a rule names the identifiers that must follow each other
and those that may stand between; unknown sentences may too. Rules are tried in their order and use
up what they match, so a text with more sentences comes before the one that it contains.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.frames import spare_name

# Sentences of published licences, each under its identifier.
SENTENCES = {
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "mit-condition": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "isc-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    ),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    "bsd-endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    ),
    "apache2-header": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",),
    "apache2-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "apache2-basis": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    "apache2-text": (
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ),
    "gpl-details": ("See the GNU General Public License for more details", "See the GNU Lesser General Public License for more details", "See the GNU Affero General Public License for more details"),
    "gpl-copy": (
        "You should have received a copy of the GNU General Public License along with this program",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "You should have received a copy of the GNU Affero General Public License along with this program",
    ),
    "mpl2-header": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "mpl2-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",),
    "cc0-waiver": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ),
    "all-rights": ("All rights reserved",),
}

# Names under which notices of one sentence give a licence, and the openings of such notices.
NOTICE_NAMES = {
    "MIT": ("the MIT License", "the MIT license", "MIT License"),
    "ISC": ("the ISC License",),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"),
    "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0"),
    "GPL-2.0-only": ("the GNU General Public License, version 2", "the GNU GPL, version 2"),
    "GPL-3.0-only": ("the GNU General Public License, version 3", "the GNU GPL, version 3"),
    "LGPL-3.0-only": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0-only": ("the GNU Affero General Public License, version 3",),
}
OPENINGS = ("Released under", "Licensed under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under")
# Parts of the grant sentences of one licence family, by short name.
FAMILIES = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
FREE = "This program is free software; you can redistribute it and/or modify it under the terms of the"
CREATIVE_COMMONS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
CC_KINDS = (("BY",), ("BY", "SA"), ("BY", "NC"), ("BY", "ND"), ("BY", "NC", "SA"), ("BY", "NC", "ND"))


@dataclass(frozen=True)
class LicenceRule:
    """`sentences` in order; those in `between`, and unknown ones, may stand before the next of them."""

    licence: str
    sentences: tuple[str, ...]
    between: tuple[str, ...] = ()


def _notices() -> dict[str, list[str]]:
    """Sentences that follow from a family, a version or a name: identifiers are 'says <licence>'."""
    found = {f"says {licence}": [f"{o} {n}" for o in OPENINGS for n in names] for licence, names in NOTICE_NAMES.items()}
    for family, name in FAMILIES.items():
        for version in VERSIONS[family]:
            licence = f"{family}-{version if '.' in version else version + '.0'}"
            later = [f"either version {version} of the License, or (at your option) any later version", f"version {version} of the License, or (at your option) any later version", f"either version {version}, or (at your option) any later version"]
            found[f"says {licence}-or-later"] = [f"{FREE} {name} as published by the Free Software Foundation, {end}" for end in later]
            only = [f"{FREE} {name} version {version} as published by the Free Software Foundation", f"{FREE} {name} as published by the Free Software Foundation, version {version}", f"{FREE} {name} as published by the Free Software Foundation, version {version} of the License"]
            found.setdefault(f"says {licence}-only", []).extend(only)
    for kind in CC_KINDS:
        name, code = "-".join(CREATIVE_COMMONS[k] for k in kind), "-".join(kind)
        texts = [f"{o} {a} Creative Commons {name} 4.0 International License" for o in OPENINGS for a in ("a", "the")]
        found[f"says CC-{code}-4.0"] = [*texts, *(f"{o} CC {code} 4.0" for o in OPENINGS)]
    return found


# The rules in the order in which they are tried.
RULES = (
    LicenceRule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), ("all-rights",)),
    LicenceRule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), ("all-rights",)),
    LicenceRule("MIT", ("mit-grant", "mit-condition"), ("all-rights",)),
    LicenceRule("MIT", ("mit-grant",)),
    LicenceRule("ISC", ("isc-grant",)),
    LicenceRule("Apache-2.0", ("apache2-header", "apache2-copy", "apache2-basis")),
    LicenceRule("Apache-2.0", ("apache2-header",)),
    LicenceRule("Apache-2.0", ("apache2-text",)),
    LicenceRule("MPL-2.0", ("mpl2-header",)),
    LicenceRule("CC0-1.0", ("cc0-waiver",)),
    LicenceRule("Unlicense", ("unlicense",)),
    *(LicenceRule(i.removeprefix("says "), (i, "gpl-warranty", "gpl-copy"), ("gpl-details",)) for i in _notices() if "GPL" in i),
    *(LicenceRule(i.removeprefix("says "), (i,)) for i in _notices()),
)

# Marks of comments at the start and end of lines.
COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|>+|%+|<!--+)[ \t]*|[ \t]*(?:\*+/|--+>)[ \t\r]*$"
SENTENCE_END = r"[.!?:]+[\"')\]]*(?:[ \t\r\n\f]+|$)|\n[ \t\r]*\n[ \t\r\n]*|\n[ \t]*(?:[0-9]{1,2}[.)]|\([0-9a-z]{1,2}\)|[a-z][.)]|[-])[ \t]+"
# Short forms whose stop ends no sentence, and the colon of the grants of free software.
SHORT_FORM = r"\b(Inc|Ltd|Corp|Co|[vV])\.|(free[ \t\r\n]+software):"
# Every known sentence has one of these words; texts without them are not looked at further.
HINT = r"(?i)licen[cs]e|permission|permitted|redistribut|warrant|copyright|public domain|reserved|mozilla|mpl|gnu |free software|anyone is free|cc by"
# What is levelled in a sentence's words: (pattern, replacement).
SLOTS = (
    (r"^(?:[a-z0-9 ]{0,40}licen[cs]e )?(?:copyright .{0,300}? )?(?:all rights reserved )?(permission (?:is hereby granted|to use copy)|redistribution and use|licensed under the apache|this source code form)", "$1"),
    (r"^copyright .{0,300}? all rights reserved$", "all rights reserved"),
    (r"^(?:[0-9]{1,2}|[a-z]) (redistributions|neither)", "$1"),
    (r"^neither the names? of .{1,200} nor the names of (?:its|their|any) contributors", "neither the name of its contributors"),
    (r"^this software is provided by .{1,200} as is and", "this software is provided by as is and"),
    (r"^.{0,200}\bfree software you can redistribute", "free software you can redistribute"),
    (r"^.{1,200} is distributed in the hope", "distributed in the hope"),
    (r"(license) along with .{1,400}$", "$1 along"),
    (r"^(you may obtain a copy of the license at) .*?( unless required by .*)?$", "$1"),
    (r"(you can obtain one at) .*$", "$1"),
    (r"^to the extent possible under law .{1,300} (?:has|have) waived", "to the extent possible under law has waived"),
)


def words_of(sentence: str) -> str:
    """The same for a constant."""
    text = re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip(" ")
    for pattern, put in SLOTS:
        text = re.sub(pattern, put.replace("$1", r"\1"), text)
    return text


def known_sentences() -> dict[str, str]:
    """Identifier of each known sentence by its words."""
    return {words_of(text): name for name, texts in {**SENTENCES, **_notices()}.items() for text in texts}


def normalised(sentence: Column) -> Column:
    text = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    for pattern, put in SLOTS:
        text = F.regexp_replace(text, pattern, put)
    return text


def _known() -> Column:
    return F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])


def sentences(text: Column) -> Column:
    """The sentences of a text; a line that is a known sentence by itself is one."""
    plain = F.regexp_replace(F.regexp_replace(text, COMMENT, ""), SHORT_FORM, "$1$2")
    apart = F.transform(F.split(plain, "\n"), lambda s: F.when(_known()[normalised(s)].isNotNull(), F.concat(F.lit("\n\n"), s, F.lit("\n\n"))).otherwise(s))
    laid_out = F.when(text.rlike(HINT), F.array_join(apart, "\n")).otherwise(plain)
    return F.filter(F.split(laid_out, SENTENCE_END), lambda s: s.rlike("[A-Za-z]"))


def _letters(rules: tuple[LicenceRule, ...]) -> dict[str, str]:
    """One private character for each identifier; unknown sentences are full stops."""
    named = {*known_sentences().values(), *(i for r in rules for i in (*r.sentences, *r.between))}
    return {name: chr(0xE000 + at) for at, name in enumerate(sorted(named))}


def _tokens(ids: Column, letters: dict[str, str]) -> Column:
    """The sequence as one string, a character for each sentence."""
    letter = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    return F.array_join(F.transform(ids, lambda i: F.coalesce(letter[i], F.lit("."))), "")


def _letter_pattern(rule: LicenceRule, letters: dict[str, str]) -> str:
    """What may stand between is one class of characters: Java's regexes walk it in a loop, but a
    repeated group by recursion, which overflows a task's stack in texts of many sentences."""
    between = "[." + "".join(letters[b] for b in rule.between) + "]*"
    return between.join(letters[s] for s in rule.sentences)


def _pattern(rule: LicenceRule) -> str:
    """The same on sequences with known identifiers as ' <id>' and unknown sentences as ' .', for the SQL."""
    between = "(?: \\." + "".join(f"| <{b}>" for b in rule.between) + ")*"
    return between.join(f" <{s}>" for s in rule.sentences).replace("-", "[-]")


def licence_scan(docs: DataFrame, text_col: str = "text", rules: tuple[LicenceRule, ...] = RULES) -> DataFrame:
    """`docs` with `licences` (distinct, in the order of their first place), `licence_sentences`
    (identifiers met, in order) and `n_sentences`.

    Whole texts are read. A null or empty text has no sentences and empty arrays. All rows and
    columns stay, repeated rows included; a new column whose name is taken gets underscores. A text
    about licences that has none of their sentences gives no licence.
    """
    parts, ids_name, tokens, licences, found, count = (spare_name(docs, n) for n in ("parts", "ids", "tokens", "licences", "licence_sentences", "n_sentences"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(parts, sentences(text))
    looked_up = F.transform(parts, lambda s: F.coalesce(_known()[normalised(s)], F.lit("")))
    rows = rows.withColumn(ids_name, F.when(text.rlike(HINT), looked_up).otherwise(F.array().cast("array<string>")))
    known = F.filter(ids_name, lambda i: i != "")
    letters = _letters(rules)
    rows = rows.withColumn(tokens, F.when(F.size(known) > 0, _tokens(F.col(ids_name), letters)).otherwise(F.lit("")))
    # Each match is replaced by the rule's number, so a sentence serves the first rule only.
    text = F.col(tokens)
    for number, rule in enumerate(rules):
        text = F.regexp_replace(text, _letter_pattern(rule, letters), f"[{number}]")
    numbers = F.when(F.col(tokens) != "", F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    names = F.array(*[F.lit(r.licence) for r in rules])
    out = rows.withColumn(licences, F.array_distinct(F.transform(numbers, lambda n: F.get(names, n.cast("int")))))
    return out.withColumn(found, known).withColumn(count, F.size(parts)).drop(parts, ids_name, tokens)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_words(sentence: str) -> str:
    out = f"trim(regexp_replace(lower({sentence}), '[^a-z0-9]+', ' ', 'g'), ' ')"
    for pattern, put in SLOTS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(put.replace('$1', chr(92) + '1'))}, 'g')"
    return out


def sql(rules: tuple[LicenceRule, ...] = RULES) -> str:
    """The scan of `documents` as DuckDB SQL: sentences are joined with a table of the known ones."""
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in known_sentences().items())
    replaced = "tokens"
    for number, rule in enumerate(rules):
        replaced = f"regexp_replace({replaced}, {_quoted(_pattern(rule))}, ' [{number}]', 'g')"
    names = "[" + ", ".join(_quoted(r.licence) for r in rules) + "]"
    return f"""
    WITH known(words, id) AS (VALUES {known}),
    d AS (SELECT row_number() OVER () AS n, doc_id, regexp_replace(regexp_replace(coalesce(text, ''), {_quoted(COMMENT)}, '', 'g'), {_quoted(SHORT_FORM)}, '\\1\\2', 'g') AS plain, regexp_matches(coalesce(text, ''), {_quoted(HINT)}) AS hint FROM documents),
    lines AS (SELECT n, i, line, {_sql_words('line')} AS words FROM (SELECT n, unnest(string_split(plain, chr(10))) AS line, unnest(range(1, len(string_split(plain, chr(10))) + 1)) AS i FROM d WHERE hint)),
    laid AS (SELECT n, string_agg(CASE WHEN id IS NULL THEN line ELSE chr(10) || chr(10) || line || chr(10) || chr(10) END, chr(10) ORDER BY i) AS laid_out FROM lines LEFT JOIN known USING (words) GROUP BY n),
    parts AS (
      SELECT n, doc_id, hint, list_filter(string_split_regex(coalesce(laid_out, plain), {_quoted(SENTENCE_END)}), lambda s: regexp_matches(s, '[A-Za-z]')) AS parts FROM d LEFT JOIN laid USING (n)),
    each AS (SELECT n, i, {_sql_words('s')} AS words FROM (SELECT n, unnest(parts) AS s, unnest(range(1, len(parts) + 1)) AS i FROM parts WHERE hint)),
    ids AS (SELECT n, list(coalesce(id, '') ORDER BY i) AS ids FROM each LEFT JOIN known USING (words) GROUP BY n),
    tokens AS (
      SELECT doc_id, len(parts) AS parts, coalesce(ids, []) AS ids, array_to_string(list_transform(ids, lambda i: CASE WHEN i = '' THEN ' .' ELSE ' <' || i || '>' END), '') AS tokens FROM parts LEFT JOIN ids USING (n)),
    numbers AS (
      SELECT *, list_transform(regexp_extract_all({replaced}, '\\[(\\d+)\\]', 1), lambda n: {names}[n::INT + 1]) AS names FROM tokens)
    SELECT doc_id, parts::INT AS n_sentences, array_to_string(list_filter(ids, lambda i: i <> ''), ' ') AS licence_sentences,
      coalesce(array_to_string(list_filter(names, lambda n, k: k = list_position(names, n)), ' '), '') AS licences
    FROM numbers"""
