"""Licence recognition by sentence rules.

Texts are cut into sentences (at blank lines and after ``.``, ``!``, ``?`` or ``;`` before white space; a
line without letters or digits, such as a bare comment mark, is blank) and normalised (lower case,
everything but letters and digits a space), so lines that a sentence is wrapped over are joined and
comment marks go. Known licence sentences are found as runs of whole words within a sentence, from left
to right, the longest first; so an entry may be the beginning of a longer real sentence. What is found is
mapped to identifiers. A document's identifiers, in order of place, are matched against ordered rules: a
rule holds where its identifiers follow each other in that sequence. A licence counts once a document,
through any of its rules.

Notices and titles that a sentence denies have no identifier: after a negation with at most
``LINK_REACH`` words between, all of them linking ones (``is not, and never was, licensed under``, ``no
longer released under``), or after ``neither`` within ``NEITHER_REACH`` words. Grants and conditions are
taken as they stand, for they hold such words themselves. Of an SPDX expression the first identifier counts, and its ``+`` isn't read.

Built-in functions only, no shuffle: the known sentences (below) are one regular expression, grouped by
first word. The SQL twin looks up one-line sentences by equality; the two agree where licences are
one-line notices.

Defined results: null and empty texts have no sentences; texts without known sentences get an empty
list; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Known licence sentences, normalised, by identifier.
SENTENCES = {
    "mit.notice": "released under the mit license",
    "mit.notice2": "licensed under the mit license",
    "mit.title": "the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                 "documentation files the software to deal in the software without restriction",
    "mit.condition": "the above copyright notice and this permission notice shall be included in all copies or substantial "
                     "portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied",
    "apache2.notice": "licensed under the apache license version 2 0",
    "apache2.title": "apache license version 2 0",
    "apache2.use": "you may not use this file except in compliance with the license",
    "apache2.copy": "you may obtain a copy of the license at",
    "gpl3.notice": "this work is licensed under the gnu general public license version 3",
    "gpl3.notice2": "licensed under the gnu general public license version 3",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                "public license as published by the free software foundation either version 3 of the license or at your "
                "option any later version",
    "gpl.warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl.copy": "you should have received a copy of the gnu general public license along with this program",
    "ccbync4.notice": "licensed under cc by nc 4 0",
    "ccby4.notice": "licensed under cc by 4 0",
    "ccbysa4.notice": "licensed under cc by sa 4 0",
    "cc0.notice": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "bsd.title": "bsd 3 clause license",
    "bsd2.title": "bsd 2 clause license",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that "
                 "the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following "
                  "disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                  "following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.disclaimer": "this software is provided by the copyright holders and contributors as is",
    "0bsd.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
                 "provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "mpl2.form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2.copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "mpl2.notice": "licensed under the mozilla public license version 2 0",
    "reserved": "all rights reserved",
}

# The GNU licences whose grant sentence differs by name and version alone.
GNU = [("GPL", "general public license", "2"), ("GPL", "general public license", "3"),
       ("LGPL", "lesser general public license", "2 1"), ("LGPL", "lesser general public license", "3"),
       ("AGPL", "affero general public license", "3")]
# SPDX identifiers that are read after their tag.
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0",
        "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0",
        "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only",
        "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA",
        "OFL-1.1", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "X11", "Zlib"]


def _gnu(name: str, version: str) -> tuple[str, str]:
    """Sentence identifier and licence."""
    number = version.replace(" ", ".")
    return f"{name}{number}.free".lower(), f"{name}-{number if '.' in number else number + '.0'}-or-later"


SENTENCES |= {_gnu(name, version)[0]: f"you can redistribute it and or modify it under the terms of the gnu {title} as published by the "
                                      f"free software foundation either version {version} of the license or at your option any later version"
              for name, title, version in GNU}
SENTENCES |= {f"spdx.{name}": "spdx license identifier " + name.lower().replace("-", " ").replace(".", " ") for name in SPDX}

# Licences with their rules, each an ordered run of sentence identifiers.
RULES = [
    ("MIT", ["mit.notice"]),
    ("MIT", ["mit.notice2"]),
    ("MIT", ["mit.grant", "mit.condition", "mit.warranty"]),
    ("MIT", ["mit.title", "mit.grant"]),
    ("Apache-2.0", ["apache2.notice"]),
    ("Apache-2.0", ["apache2.notice", "apache2.use", "apache2.copy"]),
    ("Apache-2.0", ["apache2.title", "apache2.use"]),
    ("GPL-3.0", ["gpl3.notice"]),
    ("GPL-3.0", ["gpl3.notice2"]),
    ("GPL-3.0-or-later", ["gpl.free", "gpl.warranty", "gpl.copy"]),
    ("CC-BY-NC-4.0", ["ccbync4.notice"]),
    ("CC-BY-4.0", ["ccby4.notice"]),
    ("CC-BY-SA-4.0", ["ccbysa4.notice"]),
    ("CC0-1.0", ["cc0.notice"]),
    ("BSD-3-Clause", ["bsd.title", "bsd.grant"]),
    ("BSD-3-Clause", ["bsd.title", "reserved", "bsd.grant"]),
    ("BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("BSD-2-Clause", ["bsd2.title", "bsd.grant"]),
    ("BSD-2-Clause", ["bsd2.title", "reserved", "bsd.grant"]),
    ("BSD-2-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.disclaimer"]),
    ("0BSD", ["0bsd.grant"]),
    ("ISC", ["isc.grant"]),
    ("Unlicense", ["unlicense.free"]),
    ("MPL-2.0", ["mpl2.form", "mpl2.copy"]),
    ("MPL-2.0", ["mpl2.notice"]),
    *((licence, [sentence]) for sentence, licence in (_gnu(name, version) for name, _, version in GNU)),
    *((name, [f"spdx.{name}"]) for name in SPDX),
]

# Negations, and the words that may stand between one and the notice that it denies.
NEGATIONS = ["not", "never", "nor", "cannot", "no longer",
             *(f"{verb}n t" for verb in ("is", "are", "was", "were", "has", "have", "do", "does", "did", "ca", "could", "should", "wo"))]
LINKS = ["and", "or", "never", "ever", "yet", "now", "currently", "also", "is", "are", "was", "were", "be", "been", "being", "distributed",
         "released", "offered", "published", "under"]
LINK_REACH = 8
NEITHER_REACH = 40

# in lower-cased text; the marker is a capital, which lower case doesn't hold
BREAKS = r"(?<=[.!?;])\s+|(?>\r\n?|\n)(?:[^\p{L}\p{N}\r\n]*(?>\r\n?|\n))+"
MARK = "B"


def normalised(text: F.Column) -> F.Column:
    """Words of a text, one space apart, with ``MARK`` between sentences."""
    cut = F.regexp_replace(F.lower(text), BREAKS, f" {MARK} ")
    return F.regexp_replace(cut, f"[^a-z0-9{MARK}]+", " ")


def _runs(sentences: Iterable[str]) -> str:
    """One of the sentences, of those that start at one place the longest; grouped by their first word."""
    by_word: dict[str, set[str]] = {}
    for sentence in sentences:
        word, space, rest = sentence.partition(" ")
        by_word.setdefault(word, set()).add(space + rest)
    return "|".join(f"{word}(?:{'|'.join(sorted(rests, key=lambda r: (-len(r), r)))})" for word, rests in sorted(by_word.items()))


def pattern(known: dict[str, str]) -> str:
    """Known sentences as whole words, and denied notices and titles together with their negation."""
    if not known:
        return "(?!)"
    denied = _runs(s for i, s in known.items() if ".notice" in i or ".title" in i)
    before = rf"(?:{'|'.join(NEGATIONS)})(?: (?:{'|'.join(LINKS)})){{0,{LINK_REACH}}}? |neither (?:[a-z0-9]++ ){{0,{NEITHER_REACH}}}?"
    return rf"\b(?:{_runs(known.values())}" + (rf"|(?:{before})(?:{denied})" if denied else "") + r")\b"


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """doc_id, licences (sorted, joined by commas), n_sentences (known ones), sentence_ids (in order)."""
    names = F.create_map(*(F.lit(x) for i, s in known.items() for x in (s, i))) if known else F.lit(None).cast("map<string,string>")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(
        normalised(F.coalesce("text", F.lit(""))), F.lit(pattern(known)), F.lit(0)).alias("found"))
    found = found.select("doc_id", F.array_compact(F.transform("found", lambda s: F.element_at(names, s))).alias("found"))
    ids = F.array_join("found", " ")
    bounded = F.concat(F.lit(" "), F.col("sentence_ids"), F.lit(" "))
    held = [F.when(F.contains(bounded, F.lit(" " + " ".join(run) + " ")), F.lit(name)) for name, run in rules]
    return found.select("doc_id", F.size("found").cast("long").alias("n_sentences"), ids.alias("sentence_ids")) \
        .select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*held)))), ",").alias("licences"),
                "n_sentences", "sentence_ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    known = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES.items())
    held = ", ".join(f"case when contains(' ' || sentence_ids || ' ', ' {' '.join(run)} ') then '{name}' end" for name, run in RULES)
    return rf"""
with known(name, sentence) as (values {known}),
cut as (select doc_id, regexp_split_to_array(
          regexp_replace(coalesce(text, ''), '([.!?;])[ \t]+', '\1' || chr(10), 'g'), '[\n\r]+') as s from documents),
placed as (select doc_id, unnest(s) as raw, generate_subscripts(s, 1) as place from cut),
normal as (select doc_id, place, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) as sentence from placed),
found as (select n.doc_id, count(k.name) as n_sentences,
                 coalesce(string_agg(k.name, ' ' order by place), '') as sentence_ids
          from normal n left join known k using (sentence) group by n.doc_id),
held as (select *, unnest([{held}]) as licence from found)
select doc_id, coalesce(string_agg(distinct licence, ',' order by licence), '') as licences, n_sentences, sentence_ids
from held group by doc_id, n_sentences, sentence_ids
"""


SQL = _sql()
