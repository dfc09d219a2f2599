"""License scans by sentence rules: known sentences get identifiers, ordered rules match their sequence. DataFrame functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

# Sentences of public licence notices and texts, as normalise() leaves them, with their identifiers.
SENTENCES = {
    "apache-ref": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-ref": "released under the mit license",
    "mit-ref-2": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-2": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl3-ref-2": "licensed under the gnu general public license version 3",
    "gpl2-ref": "licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "ccbync-ref": "licensed under cc by nc 4 0",
    "ccby-ref": "licensed under cc by 4 0",
    "ccbysa-ref": "licensed under cc by sa 4 0",
    "cc0-ref": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved": "all rights reserved",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "boost-dist": "distributed under the boost software license version 1 0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "epl2-made": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "bsd-ref": "licensed under the bsd license",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liable": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "copyright": "copyright holder",
}

# Sentences that name a holder or a year, as normalise() leaves them, and what they are read as.
TEMPLATES = (
    ("^neither the name of .{1,120} nor the names of its contributors", "neither the name of the copyright holder nor the names of its contributors"),
    ("^copyright (c )?[0-9]{4}.*$", "copyright holder"),
    ("^in no event shall .{1,120} be liable for any direct indirect incidental", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental"),
    ("^this software is provided by .{1,120} as is and any express or implied warranties", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
)

# The licence that an ordered sequence of sentences stands for.
RULES = (
    ("Apache-2.0", ("apache-grant", "apache-comply", "apache-asis", "apache-see")),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("apache-grant", "apache-comply")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-2",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-3.0", ("gpl3-ref-2",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0", ("gpl2-ref",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("CC-BY-NC-4.0", ("ccbync-ref",)),
    ("CC-BY-4.0", ("ccby-ref",)),
    ("CC-BY-SA-4.0", ("ccbysa-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope", "lgpl-see")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-see")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("BSL-1.0", ("boost-title", "boost-grant")),
    ("BSL-1.0", ("boost-dist",)),
    ("EPL-2.0", ("epl2-made",)),
    ("BSD", ("bsd-ref",)),
    ("all-rights-reserved", ("reserved",)),
)

#: Sentences of a rule may stand this many known sentences apart.
GAP = 1
#: A sentence ends at a line's end, or at one of these marks before white space; sentences of a licence text wrap lines.
_END = r"(?<=[.!?:;])[\x20\x09-\x0D]+|\n"
_WRAPPED_END = r"(?<=[.!?:;])[\x20\x09-\x0D]+|\n[\x20\x09\x0B-\x0D]*\n"

#: Known sentences run across these marks in the notices: the words before the mark, and those after it.
JOINTS = (
    ("this program is free software", "you can redistribute"),
    ("this library is free software", "you can redistribute"),
    ("published by the free software foundation", "either version"),
    ("but without any warranty", "without even the implied"),
    ("the mozilla public license v", "2 0"),
    ("inc", "nor the names of its"),
    ("ltd", "nor the names of its"),
)


def _joint() -> str:
    """The regular expression of the joints with their marks; its group is what stays."""
    words = lambda s: s.replace(" ", "[^A-Za-z0-9]+")
    return "(?i)(?:" + "|".join(rf"(?<j{n}>{words(a)})[.:;](?=[\x20\x09-\x0D][^A-Za-z0-9]*{words(b)})" for n, (a, b) in enumerate(JOINTS)) + ")"


def normalise(sentence: str) -> str:
    """Lower-case ASCII letters and digits, with one space for anything between them."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _sentences(text: Column, end: str) -> Column:
    def of_template(s: Column) -> Column:
        return reduce(lambda out, t: F.regexp_replace(out, t[0], t[1]), TEMPLATES, s)

    return F.transform(F.split(text, end), lambda s: of_template(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))))


def _ids(text: Column, end: str) -> Column:
    """Numbers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for n, s in enumerate(SENTENCES.values()) for x in (s, n + 1)])
    return F.filter(F.transform(_sentences(text, end), lambda s: F.try_element_at(known, s)), lambda n: n.isNotNull())


def _sequence(ids: Column) -> Column:
    """|n;|n;...: what the rules match."""
    return F.when(F.size(ids) > 0, F.concat(F.lit("|"), F.array_join(ids.cast("array<string>"), ";|"), F.lit(";"))).otherwise("")


def rule_pattern(sentences: tuple[str, ...]) -> str:
    """The regular expression of an ordered rule over |n;|n;..."""
    names = list(SENTENCES)
    return rf"(\|[0-9]+;){{0,{GAP}}}".join(rf"\|{names.index(s) + 1};" for s in sentences)


def longer(name: str, sentences: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Rules of other licences that go on where this one ends; this one counts if it matches more often than they do in either reading."""
    return [rule for other, rule in RULES if other != name and len(rule) > len(sentences) and rule[: len(sentences)] == sentences]


#: Every known sentence holds one of these words, so a text without them holds none.
HINT = "(?i)licen[sc]e|rights|permission|copyright|warrant|redistribut|liable|contributors|public domain|commercial"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, sentences) of each row of docs.

    licenses: the licences whose rules match, by name; sentences: identifiers of the known sentences in order.
    A text is read line by line and, for licences with wrapped lines, by paragraphs; the rules are matched on
    both readings, and the licences of either count. The sentences are those of the reading with more of them,
    by lines if equal. Known sentences go on over the marks that stand within them (JOINTS). Rows stay where they are: nothing is shuffled.

    Null and empty texts, and texts without known sentences, have empty arrays. Repeated rows repeat. Other
    columns are ignored; an empty table gives an empty result.
    """
    assert all(re.search(HINT, s) for s in SENTENCES.values())
    none = F.array().cast("array<int>")
    text = F.when(F.col("text").rlike(HINT), F.regexp_replace("text", _joint(), "".join(f"${{j{n}}}" for n in range(len(JOINTS)))))
    read = docs.select("doc_id", text.alias("text"))
    read = read.select("doc_id", F.coalesce(_ids(F.col("text"), _END), none).alias("lines"), F.coalesce(_ids(F.col("text"), _WRAPPED_END), none).alias("wrapped"))
    names = F.array(*[F.lit(n) for n in SENTENCES])
    ids = F.when(F.size("wrapped") > F.size("lines"), F.col("wrapped")).otherwise(F.col("lines"))
    sequence = read.select("doc_id", ids.alias("ids"), _sequence(F.col("lines")).alias("seq"), _sequence(F.col("wrapped")).alias("seq2"))

    def most(rule: tuple[str, ...]) -> Column:
        times = lambda seq: F.size(F.regexp_extract_all(seq, F.lit(rule_pattern(rule)), F.lit(0)))
        return F.greatest(times("seq"), times("seq2"))

    def met(name: str, rule: tuple[str, ...]) -> Column:
        once = F.col("seq").rlike(rule_pattern(rule)) | F.col("seq2").rlike(rule_pattern(rule))
        others = longer(name, rule)
        return once & (most(rule) > reduce(lambda x, y: x + y, map(most, others))) if others else once

    matched = F.array_compact(F.array(*[F.when(met(name, rule), F.lit(name)) for name, rule in RULES]))
    return sequence.select("doc_id", F.array_sort(F.array_distinct(matched)).alias("licenses"), F.transform("ids", lambda n: F.element_at(names, n)).alias("sentences"))


def oracle() -> str:
    """The same in DuckDB's SQL, with licences and sentences comma-joined."""
    known = "map {" + ", ".join(f"'{s}': {n + 1}" for n, s in enumerate(SENTENCES.values())) + "}"
    space = SPACE.replace(r"\x20", " ")

    def joined(text: str) -> str:
        """The text without the marks of the joints. RE2 has no lookahead: what follows the mark is put back."""
        words = lambda s: s.replace(" ", "[^A-Za-z0-9]+")
        for a, b in JOINTS:
            text = rf"regexp_replace({text}, '(?i)({words(a)})[.:;]([ \x09-\x0D][^A-Za-z0-9]*{words(b)})', '\1\2', 'g')"
        return text

    def ids(pattern: str) -> str:
        pieces = rf"string_split_regex(regexp_replace(t, '([.!?:;]){space}', '\1' || chr(1), 'g'), '{pattern}')"
        clean = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
        for template, read in TEMPLATES:
            clean = f"regexp_replace({clean}, '{template}', '{read}')"
        return f"list_filter(list_transform(list_transform({pieces}, lambda s: {clean}), lambda s: {known}[s]), lambda n: n is not null)"

    def most(rule: tuple[str, ...]) -> str:
        return f"greatest(len(regexp_extract_all(seq, '{rule_pattern(rule)}')), len(regexp_extract_all(seq2, '{rule_pattern(rule)}')))"

    def met(name: str, rule: tuple[str, ...]) -> str:
        return f"{most(rule)} > {' + '.join(map(most, longer(name, rule))) or '0'}"

    rules = ", ".join(f"case when {met(name, rule)} then '{name}' end" for name, rule in RULES)
    names = "[" + ", ".join(f"'{n}'" for n in SENTENCES) + "]"
    sequence = lambda x: f"case when len({x}) > 0 then '|' || array_to_string({x}, ';|') || ';' else '' end"
    return rf"""
with texts as (
  select doc_id, case when regexp_matches(text, '{HINT}') then {joined("text")} else '' end as t from documents
), readings as (
  select doc_id, {ids(r"\x01|\n")} as lines, {ids(r"\x01|\n[ \x09\x0B-\x0D]*\n")} as wrapped from texts
), laid as (
  select doc_id, case when len(wrapped) > len(lines) then wrapped else lines end as ids, {sequence("lines")} as seq, {sequence("wrapped")} as seq2 from readings
)
select doc_id, array_to_string(list_sort(list_distinct(list_filter([{rules}], lambda x: x is not null))), ',') as licenses,
  array_to_string(list_transform(ids, lambda n: {names}[n]), ',') as sentences from laid
"""
