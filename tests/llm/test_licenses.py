from __future__ import annotations

import random

from plinth.llm import license_scan as L

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in L.scan_licenses(df).collect()}


def test_rules(spark):
    apache = " ".join(t + "." for n, t in L.SENTENCES if n in ("ApacheHead", "ApacheNot", "ApacheCopy", "ApacheAsIs", "ApacheSee"))
    bsd = "\n".join(t + "." for n, t in L.SENTENCES if n.startswith("Bsd") and not n.endswith("Spdx"))
    got = scan(
        spark,
        [
            "Prose here.\nReleased under the MIT License.\nMore prose, no licence.",
            MIT,
            apache,
            bsd,
            bsd.rsplit("\n", 1)[0],
            "Licensed under CC BY-NC 4.0.\nx\nLicensed under CC BY-NC 4.0. SPDX-License-Identifier: MIT",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "unlicensed words about licenses",
            "LICENSED UNDER the apache   license, version 2.0",
        ],
    )
    names = {d: list(r["licenses"]) for d, r in got.items()}
    assert names == {0: ["MIT"], 1: ["MIT"], 2: ["Apache-2.0"], 3: ["BSD-3-Clause"], 4: ["BSD-2-Clause"], 5: ["MIT", "CC-BY-NC-4.0", "CC-BY-NC-4.0"], 6: [], 7: [], 8: ["Apache-2.0"]}
    assert list(got[6]["leftover"]) == ["MitNotice"] and list(got[1]["sentence_ids"]) == ["MitGrant", "MitNotice"]


def test_a_cut_sentence_needs_all_its_pieces(spark):
    mpl = next(t for n, t in L.SENTENCES if n == "MplBy")
    wrapped = mpl.replace("Mozilla Public", "Mozilla Public\n *")
    got = scan(spark, ["Licensed under the Apache License, v. 2.0.", "No licence. 2.0.", "2.0. License", mpl, f"/* {wrapped}. If a copy was not distributed, see below. */", f"{mpl}.\n{mpl}."])
    assert [list(got[i]["licenses"]) for i in range(6)] == [[], [], [], ["MPL-2.0"], ["MPL-2.0"], ["MPL-2.0"] * 2]
    assert all(not got[i]["leftover"] and not got[i]["sentence_ids"] for i in range(3))


def test_every_rule_is_reachable(spark):
    text = {n: t for n, t in L.SENTENCES}
    texts = ["\n".join(text[i] + "." for i in seq) for _, seq in L.RULES]
    got = scan(spark, texts)
    assert [list(got[i]["licenses"]) for i in range(len(texts))] == [[name] for name, _ in L.RULES]


def test_both_readings_count(spark):
    """One-line notices in front of wrapped sentences: the first are lost by paragraph, the others by line."""
    bsd = [s for n, s in L.SENTENCES if n in ("BsdGrant", "BsdSource", "BsdBinary")]
    wrapped = "\n\n".join(s.replace(" conditions", "\n# conditions").replace("documentation", "\n documentation") + "." for s in bsd)
    # No blank line parts the first wrapped sentence from the notices, so it is not known.
    text = "SPDX-License-Identifier: Apache-2.0\nLicensed under the MIT License\n" + wrapped + "\n\nReleased under the MIT License."
    got = scan(spark, [text, wrapped, text.split("\n\n")[0]])
    assert list(got[0]["sentence_ids"]) == ["ApacheSpdx", "MitBy", "BsdSource", "BsdBinary", "MitBy"]
    assert list(got[1]["licenses"]) == ["BSD-2-Clause"]
    # A sentence that both readings find is named once.
    assert list(scan(spark, ["Released under the MIT License.\n\nx\n\nReleased under the MIT License"])[0]["sentence_ids"]) == ["MitBy", "MitBy"]


def plain_licenses(ids):
    """The rules in their order, each taking what the ones before have left, in plain lists."""
    parts, names = [list(ids)], []
    for name, run in L.RULES:
        after = []
        for part in parts:
            at, i = 0, 0
            while i + len(run) <= len(part):
                if tuple(part[i : i + len(run)]) == run:
                    after.append(part[at:i])
                    names.append(name)
                    at = i = i + len(run)
                else:
                    i += 1
            after.append(part[at:])
        parts = after
    return names, [x for part in parts for x in part]


def test_against_brute_force(spark, vocabulary):
    """Sentences in any order, one a line between prose, marks and capitals; what is expected comes from the order alone."""
    rnd = random.Random(6)
    texts, want = [], []
    for _ in range(150):
        lines, ids = [], []
        for _ in range(rnd.randint(0, 12)):
            if rnd.random() < 0.3:
                lines.append(" ".join(rnd.choice(vocabulary) for _ in range(5)) + ".")
                continue
            run = rnd.choice(L.RULES)[1] if rnd.random() < 0.4 else [rnd.choice(L.SENTENCES)[0]]
            for name in run:
                sentence = rnd.choice([s for n, s in L.SENTENCES if n == name])
                sentence = rnd.choice([sentence, sentence.upper(), "  * " + sentence, sentence.replace(" ", "  ")])
                lines.append(sentence + rnd.choice([".", "", "!", ";"]))
                ids.append(name)
        texts.append("\n".join(lines))
        want.append(ids)
    got = scan(spark, texts)
    for i, ids in enumerate(want):
        names, left = plain_licenses(ids)
        assert (list(got[i]["sentence_ids"]), list(got[i]["licenses"]), list(got[i]["leftover"])) == (ids, names, left), texts[i]


def test_sql_needs_all_pieces_too(spark, tmp_path):
    import duckdb

    mpl = next(t for n, t in L.SENTENCES if n == "MplBy")
    texts = ["Licensed under the Apache License, v. 2.0.", "No licence. 2.0.", mpl, f"{mpl}.\n{mpl}.", MIT, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    own = sorted(tuple(r) for r in L.op7_licenses(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(L.OP7_SQL).fetchall()) == own and [r[3] for r in own[:4]] == ["", "", "MPL-2.0", "MPL-2.0,MPL-2.0"]


def test_odd_rows(spark, odd_docs, no_docs, clashing):
    assert all(not r["licenses"] for r in L.scan_licenses(odd_docs).collect())
    assert L.scan_licenses(no_docs).count() == 0
    assert L.scan_licenses(clashing).count() == clashing.count()
