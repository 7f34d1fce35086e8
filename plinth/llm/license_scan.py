r"""License scans by sentence-rule recognition.

A text is cut into sentences, each is normalised, and those that are known
licence sentences are replaced by their identifiers. The identifier sequence is then
matched against the rules in their order; a rule consumes the run of
identifiers it fits, so the long rules come first and what is left over is matched
by shorter ones. Runs that no rule fits are reported as leftover.

Sentences are taken twice: with every line end as a sentence end, and with single
line ends as spaces, for sentences that wrap. Known sentences of both readings count, in the order
of their places, but for those of the first that lie within one of the second. A sentence ends at ``.``, ``!``, ``?`` or
``;`` before a blank or the end, or at an empty line. It is normalised by
lower-casing A-Z and turning all else but letters and digits into single blanks.
A known sentence that is itself cut (after ``v.`` in ``v. 2.0``) counts where all its pieces follow
each other, at its last.

Only texts with one of the words of ``CUES`` are cut up; each known
sentence holds one of them (``known_runs`` checks it).

Defined cases: a null or empty text has no sentences and no licences; a licence
found twice is named twice, in order of rules, then position; equal rows come back as
often; an empty table gives an empty result; other columns of docs are kept, those
named like the result's are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import holds, lower_ascii, packed, running_sums, spread, table

CUES = ("licen", "warrant", "permission", "redistribut", "spdx", "copyright", "public domain", "conditions")

#: Known licence sentences, fixed values: identifier and text.
SENTENCES = (
    ("ApacheBy", "Licensed under the Apache License, Version 2.0"),
    ("ApacheHead", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("ApacheNot", "you may not use this file except in compliance with the License"),
    ("ApacheCopy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheAsIs", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License"),
    ("ApacheSpdx", "SPDX-License-Identifier: Apache-2.0"),
    ("MitBy", "Released under the MIT License"),
    ("MitBy", "Licensed under the MIT License"),
    ("MitName", "The MIT License"),
    ("MitName", "The MIT License (MIT)"),
    ("MitGrant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MitNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MitSpdx", "SPDX-License-Identifier: MIT"),
    ("Gpl3By", "This work is licensed under the GNU General Public License, version 3"),
    ("Gpl2By", "This work is licensed under the GNU General Public License, version 2"),
    ("GplLater", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("Gpl2Later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GplNoWarranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("GplImplied", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("GplDetails", "See the GNU General Public License for more details"),
    ("Gpl3Spdx", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("Gpl3OnlySpdx", "SPDX-License-Identifier: GPL-3.0-only"),
    ("Gpl2Spdx", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("Gpl2OnlySpdx", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BsdGrant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BsdSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BsdBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BsdNoEndorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("Bsd3Spdx", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Bsd2Spdx", "SPDX-License-Identifier: BSD-2-Clause"),
    ("IscGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MplBy", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MplSpdx", "SPDX-License-Identifier: MPL-2.0"),
    ("CcByNcBy", "Licensed under CC BY-NC 4.0"),
    ("CcByBy", "Licensed under CC BY 4.0"),
    ("CcBySaBy", "Licensed under CC BY-SA 4.0"),
    ("CcByLong", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CcByNcLong", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CcBySaLong", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Rules in order: licence and the identifiers that follow each other.
RULES = (
    ("Apache-2.0", ("ApacheHead", "ApacheNot", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("GPL-3.0-or-later", ("GplLater", "GplNoWarranty", "GplImplied", "GplDetails")),
    ("GPL-2.0-or-later", ("Gpl2Later", "GplNoWarranty", "GplImplied", "GplDetails")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNoEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("MIT", ("MitName", "MitGrant", "MitNotice")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("Apache-2.0", ("ApacheHead", "ApacheNot")),
    ("Apache-2.0", ("ApacheBy",)),
    ("Apache-2.0", ("ApacheSpdx",)),
    ("MIT", ("MitBy",)),
    ("MIT", ("MitSpdx",)),
    ("GPL-3.0-or-later", ("GplLater",)),
    ("GPL-3.0-or-later", ("Gpl3Spdx",)),
    ("GPL-3.0-only", ("Gpl3OnlySpdx",)),
    ("GPL-3.0-only", ("Gpl3By",)),
    ("GPL-2.0-or-later", ("Gpl2Spdx",)),
    ("GPL-2.0-only", ("Gpl2OnlySpdx",)),
    ("GPL-2.0-only", ("Gpl2By",)),
    ("BSD-3-Clause", ("Bsd3Spdx",)),
    ("BSD-2-Clause", ("Bsd2Spdx",)),
    ("ISC", ("IscGrant",)),
    ("MPL-2.0", ("MplBy",)),
    ("MPL-2.0", ("MplSpdx",)),
    ("CC-BY-NC-4.0", ("CcByNcBy",)),
    ("CC-BY-NC-4.0", ("CcByNcLong",)),
    ("CC-BY-4.0", ("CcByBy",)),
    ("CC-BY-4.0", ("CcByLong",)),
    ("CC-BY-SA-4.0", ("CcBySaBy",)),
    ("CC-BY-SA-4.0", ("CcBySaLong",)),
    ("Unlicense", ("Unlicense",)),
)

_SENTENCE_END = r"[.!?;]+(?:[\x20\x09-\x0D]+|$)"
_BY_LINE = _SENTENCE_END + r"|[\x0A\x0D]+"
_BY_PARAGRAPH = _SENTENCE_END + r"|\x0A[\x20\x09\x0D]*\x0A"
_ODD = "[^a-z0-9]+"


def normal(sentence: str) -> str:
    return re.sub(_ODD, " ", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)).strip()


def known_runs() -> dict[tuple[str, ...], str]:
    """Identifiers by the normalised pieces that a known sentence is cut into; each sentence holds a cue."""
    for _, sentence in SENTENCES:
        if not any(c in sentence.lower() for c in CUES):
            raise ValueError(f"no cue in {sentence!r}")
    return {tuple(p for p in map(normal, re.split(_BY_LINE, sentence)) if p): name for name, sentence in SENTENCES}


def _known(text: Column, ends: str, known: dict[tuple[str, ...], str]) -> Column:
    """array of struct(s, e, name): the known sentences and where they lie in the text."""
    sizes = sorted({len(run) for run in known}, reverse=True)
    names = {k: F.create_map(*[F.lit(x) for run, name in known.items() if len(run) == k for x in ("|".join(run), name)]) for k in sizes}
    parts = F.struct(F.split(text, ends, -1).alias("p"), F.regexp_extract_all(text, F.lit(ends), F.lit(0)).alias("g"))

    def placed(x: Column) -> Column:
        own = F.transform(x["p"], lambda p: F.btrim(F.regexp_replace(p, _ODD, " ")))
        after = running_sums(F.transform(x["p"], lambda p, i: F.length(p) + F.coalesce(F.length(F.get(x["g"], i)), F.lit(0))))
        sizes_ = F.transform(x["p"], lambda p: F.length(p))
        return F.transform(F.array(F.struct(own.alias("t"), after.alias("after"), sizes_.alias("n"))), every)[0]

    def every(y: Column) -> Column:
        found = F.transform(y["t"], lambda _, i: F.coalesce(*[of(y, i, k) for k in sizes]))
        return F.filter(found, lambda f: f.isNotNull())

    def of(y: Column, i: Column, k: int) -> Column:
        name = F.element_at(names[k], F.concat_ws("|", *[F.get(y["t"], i - at) for at in range(k - 1, -1, -1)]))
        start = F.coalesce(F.get(y["after"], i - k), F.lit(0))
        end = F.coalesce(F.get(y["after"], i - 1), F.lit(0)) + F.get(y["n"], i)
        return F.when(name.isNotNull(), F.struct(start.alias("s"), end.alias("e"), name.alias("name")))

    return F.transform(F.array(parts), placed)[0]


def _both(lines: Column, paragraphs: Column) -> Column:
    """The names of both readings' sentences in their order."""
    two = F.struct(lines.alias("a"), paragraphs.alias("b"))
    united = F.transform(F.array(two), lambda x: F.array_sort(F.concat(x["b"], F.filter(x["a"], lambda f: ~holds(x["b"], f)))))[0]
    return F.transform(united, lambda f: f["name"])


def scan_licenses(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with sentence_ids, licenses and leftover, arrays of strings."""
    known = known_runs()
    row, columns = packed(docs, "sentence_ids", "licenses", "leftover")
    text = F.coalesce("text", F.lit(""))
    cue = F.rlike(text, F.lit("(?i)" + "|".join(CUES)))
    low = lower_ascii(text)
    ids = _both(_known(low, _BY_LINE, known), _known(low, _BY_PARAGRAPH, known))
    none = F.array().cast("array<string>")
    found = docs.select(row, "text", F.when(cue, ids).otherwise(none).alias("sentence_ids"))
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(seq) + ",").alias("run")) for name, seq in rules])

    def step(acc: Column, rule: Column) -> Column:
        rest = F.replace(acc["seq"], rule["run"], F.lit("#"))
        times = ((F.length(acc["seq"]) - F.length(rest)) / (F.length(rule["run"]) - 1)).cast("int")
        return F.struct(rest.alias("seq"), F.concat(acc["names"], F.array_repeat(rule["name"], times)).alias("names"))

    sequence = F.concat(F.lit(","), F.array_join("sentence_ids", ",,"), F.lit(","))
    state = F.struct(sequence.alias("seq"), none.alias("names"))
    result = found.withColumn("_found", F.when(F.size("sentence_ids") > 0, F.aggregate(listed, state, step)))
    left = F.filter(F.split(F.col("_found.seq"), "[,#]+", -1), lambda x: x != "")
    return result.select(*columns, "sentence_ids", F.coalesce("_found.names", none).alias("licenses"), F.coalesce(left, none).alias("leftover"))


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return scanned.select(
        "doc_id",
        F.size("sentence_ids").cast("bigint").alias("n_known"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join("leftover", ",").alias("leftover"),
    )


def _sql() -> str:
    known = known_runs()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    sizes = sorted({len(run) for run in known}, reverse=True)
    names = ", ".join("map {" + ", ".join(f"{quote('|'.join(run))}: {quote(v)}" for run, v in known.items() if len(run) == k) + f"}} as n{k}" for k in sizes)
    # \$ ends in DuckDB's regular expressions as in Java's but for a last line feed.
    length = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    cut = lambda ends: f"regexp_split_to_array(t, {quote(ends)}) as p, regexp_extract_all(t, {quote(ends)}) as g"
    name = lambda k: f"n{k}[array_to_string(w[i - {k - 1}:i], '|')]"
    start = lambda k: f"{length(f'p[1:i - {k}]')} + {length(f'g[1:i - {k}]')}"
    found = " ".join(f"when {name(k)} is not null then struct_pack(s := {start(k)}, e := {start(1)} + length(p[i]), name := {name(k)})" for k in sizes)
    ids = f"list_filter(list_transform(range(1, len(p) + 1), lambda i: case {found} end), lambda x: x is not null)"
    read = lambda q, ends: f"{q}0 as (select doc_id, {cut(ends)} from l where regexp_matches(t, '{'|'.join(CUES)}')), {q}1 as (select *, list_transform(p, lambda s: trim(regexp_replace(s, '{_ODD}', ' ', 'g'))) as w from {q}0), {q} as (select doc_id, {ids} as x from {q}1, k), "
    steps, at = [], "s0"
    for i, (licence, seq) in enumerate(RULES, 1):
        run = "," + ",,".join(seq) + ","
        steps.append(
            f"s{i} as (select doc_id, ids, replace(seq, '{run}', '#') as seq, "
            f"names || repeat('{licence},', cast((length(seq) - length(replace(seq, '{run}', '#'))) / {len(run) - 1} as integer)) as names from {at})"
        )
        at = f"s{i}"
    return (
        f"with k as (select {names}), "
        "l as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents), "
        + read("a", _BY_LINE)
        + read("b", _BY_PARAGRAPH)
        + "u as (select a.doc_id, list_sort(list_concat(b.x, list_filter(a.x, lambda f: len(list_filter(b.x, lambda h: h.s <= f.s and h.e >= f.e)) = 0))) as x from a join b on a.doc_id is not distinct from b.doc_id), "
        "i as (select doc_id, list_transform(x, lambda f: f.name) as ids from u), "
        "s0 as (select doc_id, ids, ',' || array_to_string(ids, ',,') || ',' as seq, '' as names from i where len(ids) > 0), "
        + ", ".join(steps)
        + f" select d.doc_id, cast(coalesce(len(f.ids), 0) as bigint) as n_known, coalesce(array_to_string(f.ids, ','), '') as sentence_ids, "
        "coalesce(rtrim(f.names, ','), '') as licenses, coalesce(trim(regexp_replace(f.seq, '[,#]+', ',', 'g'), ','), '') as leftover "
        f"from documents d left join {at} f on d.doc_id is not distinct from f.doc_id"
    )


OP7_SQL = _sql()
