"""Licence recognition by sentences: known sentences become identifiers, identifier sequences match ordered rules.

A text is cut into sentences, each is normalised, and a normalised sentence that is known becomes its
identifier; a run of others becomes one "?". Sentences end at punctuation and at line ends, but lines (without their comment
marks) that together make a known sentence are one sentence, and a list mark before it is no sentence. Rules are identifier sequences in order of precedence. A rule that
matches takes its identifiers, so a later, shorter rule can't claim them again.

All of it is built-in functions on a row of its own: nothing is shuffled or collected, and the tables are
fixed lists in the plan. Long texts cost in proportion to their length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where a sentence ends, and what separates words within one (after lower-casing A-Z).
STOP, OTHER = r"[.!?;:]+(?:[ \t\r\n\f]+|$)", r"[^a-z0-9.+/\n-]+"
END = rf"{STOP}|\n"
#: Comment marks and list marks that END takes for punctuation. In a normalised text, where single line ends are line breaks, double
#: ones end a sentence and L ends a list mark: what may stand between the words of a wrapped sentence, before it (comment
#: mark, list mark) and after it.
MARK = "(?:[0-9]{1,2}|[a-z]|i{2,3}|iv|vi{1,3}|ix)"
ITEM = rf"((?:\A|\n)[^a-z0-9\n]*{MARK})\.[ \t]+(?=[^ \t\r\n\f])"
REMARK = r"\n[ \t]*[;!]+[ \t]+"
BREAK = r" ?\n ?(?:[/+-]+ ?)?"
BEFORE, AFTER = rf"(?:\A|\n) ?(?:[/+-]+ ?)?(?:{MARK}[L ] ?)?", r" ?(?:(?:/|--+) ?)?(?=\n|\z)"

#: Sentences of public licence notices, by identifier.
SENTENCES = {
    "mit-named": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "mit-as-is": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "bsd-named": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "apache-2": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    "apache-comply": ("you may not use this file except in compliance with the License.",),
    "apache-copy": ("You may obtain a copy of the License at",),
    "gpl-3-named": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."),
    "gpl-3-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl-2-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "lgpl-3-named": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "mpl-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "cc-by-4": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4": ("Licensed under CC BY-SA 4.0.",),
    "cc-by-nc-4": ("Licensed under CC BY-NC 4.0.",),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "reserved": ("All rights reserved.",),
}
#: Fixed values: (licence, identifiers in sequence), in order of precedence.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-or-later", ("gpl-3-later", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("GPL-2.0-or-later", ("gpl-2-later", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl-2-later",)),
    ("GPL-3.0-only", ("gpl-3-named",)),
    ("LGPL-3.0-only", ("lgpl-3-named",)),
    ("Apache-2.0", ("apache-2", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-2",)),
    ("MPL-2.0", ("mpl-2", "mpl-copy")),
    ("MPL-2.0", ("mpl-2",)),
    ("MIT", ("mit-named",)),
    ("BSD-style", ("bsd-named",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("reserved",)),
)


def normal_parts(text: str) -> list[str]:
    """The normalised sentences of one of the fixed texts above."""
    low = text.translate(str.maketrans(UPPER, SMALL))
    return [s for s in (p.strip(" ") for p in re.sub(OTHER, " ", re.sub(END, "\n", low)).split("\n")) if s]


def known() -> dict[str, str]:
    """Normalised sentence -> identifier. A notice that holds several sentences is known by them in sequence."""
    out: dict[str, str] = {}
    for name, texts in SENTENCES.items():
        for text in texts:
            parts = normal_parts(text)
            for k, part in enumerate(parts):
                out.setdefault(part, name if k == 0 else f"{name}+{k}")
    return out


def sequence(names: tuple[str, ...]) -> str:
    """A rule's identifiers as they appear in a text: every part of each notice, blank-separated."""
    out = []
    for name in names:
        parts = [known()[p] for p in normal_parts(SENTENCES[name][0])]
        out += parts if parts[0] == name else [name]
    return " " + "".join(f"{n} " for n in out)


def wrapped() -> str:
    """A pattern for a known sentence on whole lines, broken anywhere between its words; its group is the sentence."""
    several = sorted((p for p in known() if " " in p), key=lambda p: (-len(p), p))
    return f"{BEFORE}({'|'.join(f'(?: |{BREAK})'.join(map(re.escape, p.split(' '))) for p in several)}){AFTER}"


def normal(text: Column) -> Column:
    """A text in normalised words; a line end is a line break, two are the end of a sentence, L is the end of a list mark."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL)
    low = F.regexp_replace(F.regexp_replace(low, REMARK, "\n"), ITEM, "$1L ")
    return F.regexp_replace(F.regexp_replace(low, STOP, "\n\n"), OTHER.replace("^", "^L"), " ")


def sentences(flat: Column) -> Column:
    """Sentences of a normalised text, empty ones left out: known ones whole, what lies between them by lines."""
    lines = lambda t: F.filter(F.transform(F.split(t, "[\nL]"), lambda s: F.btrim(s)), lambda s: s != "")
    whole = F.lit(wrapped())
    found = F.transform(F.regexp_extract_all(flat, whole, F.lit(1)), lambda s: F.array(F.regexp_replace(s, BREAK, " ")))
    none = F.array().cast("array<string>")
    # comment marks alone are no sentence between known ones
    between = lambda t: F.when(F.regexp_like(t, F.lit("[a-z0-9]")), lines(t)).otherwise(none)
    parts = F.zip_with(F.split(flat, wrapped()), found, lambda t, s: F.concat(between(t), F.coalesce(s, none)))
    return F.when(F.regexp_like(flat, whole), F.flatten(parts)).otherwise(lines(flat))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, n_known, sentence_ids, licenses, n_unmatched) for every row of df.

    sentence_ids: identifiers in order, blank-separated, "?" for a run of unknown sentences; licenses: those of the matching
    rules, each once, by precedence, joined by "|" (empty: none); n_unmatched: known sentences that no rule took. Null and
    empty texts have no sentences. Repeated rows and null ids come out as they came in; an empty table gives an empty
    result; other columns of df are not looked at. A wrapped known sentence counts once in n_sentences, unknown text by lines.
    """
    table = known()
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    names = F.create_map(*pairs)
    at = df.select(F.col(id_col).alias("_id"), normal(F.col(text_col)).alias("_t")).select("_id", sentences(F.col("_t")).alias("_s"))
    # most texts hold no known sentence: membership is a hash lookup, and only the others are spelled out
    marks = F.transform("_s", lambda s: F.when(s.isin(list(table)), names[s]).otherwise(F.lit("?")))
    at = at.select("_id", F.size("_s").cast("long").alias("n_sentences"), marks.alias("_m"))
    at = at.withColumn("n_known", F.size(F.filter("_m", lambda m: m != "?")).cast("long"))
    seq = F.when(F.col("n_known") > 0, F.regexp_replace(F.concat(F.lit(" "), F.array_join("_m", " "), F.lit(" ")), r" \?( \?)+ ", " ? ")).otherwise(
        F.when(F.col("n_sentences") > 0, F.lit(" ? ")).otherwise(F.lit(" "))
    )
    at = at.select("_id", "n_sentences", "n_known", seq.alias("_seq"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(sequence(ids)).alias("ids")) for name, ids in RULES])
    # neighbours share a blank, so a match is replaced by a mark that keeps one at each side
    take = lambda left, ids: F.replace(F.replace(left, ids, F.lit(" * ")), ids, F.lit(" * "))
    start = F.struct(F.col("_seq").alias("left"), F.array().cast("array<string>").alias("names"))
    step = lambda a, r: F.struct(
        take(a["left"], r["ids"]).alias("left"), F.when(F.contains(a["left"], r["ids"]), F.array_append(a["names"], r["name"])).otherwise(a["names"]).alias("names")
    )
    at = at.withColumn("_f", F.when(F.col("n_known") > 0, F.aggregate(rules, start, step)).otherwise(start))
    rest = F.size(F.filter(F.split(F.btrim("_f.left"), " "), lambda m: ~m.isin("?", "*", "")))
    return at.select(
        F.col("_id").alias(id_col),
        "n_sentences",
        "n_known",
        F.btrim("_seq").alias("sentence_ids"),
        F.array_join(F.array_distinct("_f.names"), "|").alias("licenses"),
        rest.cast("long").alias("n_unmatched"),
    )


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    steps, last = [], "n"
    for k, (_, ids) in enumerate(RULES):
        f = q(sequence(ids))
        steps.append(f"s{k} AS (SELECT *, contains(rest{k}, {f}) AS r{k}, replace(replace(rest{k}, {f}, ' * '), {f}, ' * ') AS rest{k + 1} FROM {last})")
        last = f"s{k}"
    hits = ", ".join(f"CASE WHEN r{k} THEN {q(name)} END" for k, (name, _) in enumerate(RULES))
    values = ", ".join(f"({q(s)}, {q(i)})" for s, i in known().items())
    order = ", ".join(q(n) for n in dict.fromkeys(name for name, _ in RULES))
    return f"""
WITH k(s, i) AS (VALUES {values}),
d AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(
           translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '{END}', chr(10), 'g'), '{OTHER}', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s
  FROM documents
), e AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS place FROM d),
m AS (
  SELECT doc_id, count(*)::BIGINT AS n_sentences, count(i)::BIGINT AS n_known, string_agg(coalesce(i, '?'), ' ' ORDER BY place) AS seq
  FROM e LEFT JOIN k USING (s) GROUP BY doc_id
), n AS (
  SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_known, 0)::BIGINT AS n_known,
         regexp_replace(' ' || coalesce(seq || ' ', ''), ' \\?( \\?)+ ', ' ? ', 'g') AS rest0
  FROM d LEFT JOIN m USING (doc_id)
), {", ".join(steps)}
SELECT doc_id, n_sentences, n_known, trim(rest0) AS sentence_ids,
       coalesce(array_to_string(list_filter([{order}], lambda x: list_contains([{hits}], x)), '|'), '') AS licenses,
       len(list_filter(string_split(trim(rest{len(RULES)}), ' '), lambda x: x NOT IN ('?', '*', '')))::BIGINT AS n_unmatched
FROM {last}
"""


ORACLE = _oracle()
