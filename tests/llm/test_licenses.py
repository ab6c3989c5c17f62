"""License scan: rules keep their prefilters, places equal a plain walk, overlaps resolve by priority."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from candlewick.llm import license_rules, licenses

RULES = license_rules.rules()


def flat(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, "".join(f" {w} " for w in words)


def plain(text):
    words, line = flat(text)
    hits = []
    for i, r in enumerate(RULES):
        for m in re.finditer(licenses.compiled(r), line):
            a = line[: m.start()].count(" ") // 2
            hits.append((a, a + m.group().count(" ") // 2, r.form.priority, -i, r))
    kept = [
        h for h in hits
        if not any(o is not h and o[0] <= h[0] and o[1] >= h[1] and (o[2], o[1] - o[0], o[3]) > (h[2], h[1] - h[0], h[3]) for o in hits)
    ]
    base = [h for h in hits if h[4].form.name == "base"]
    names = {h[4].label for h in base}
    return (
        len(words), len(base), min((h[0] for h in base), default=None), max((h[0] for h in base), default=None),
        ",".join(sorted(names)), ",".join(sorted(names | {h[4].label for h in kept})),
        max((h[4].form.confidence for h in kept), default=0.0),
    )


TEXTS = [
    None, "", " \n", "no word of it here", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.",
    "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: Apache-2.0", "MIT license mit license MIT LICENSE",
    "the GNU Lesser General Public License v2.1 and GNU Affero General Public License", "cc by cc by-sa",
    "Redistribution and use in source and binary forms, with or without modification, are permitted ©",
    "licence apache license über mit licensed cc byte", "GPLv3 GPL-2.0-or-later LGPL 2.1", "mit license " * 3000,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/ \x00 x", "published by the apache license",
]


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r.label}-{r.form.name}")
def test_every_match_holds_anchor_and_key(rule):
    ascii_words = st.from_regex(re.compile(licenses.compiled(rule), re.ASCII), fullmatch=True)

    @settings(max_examples=8, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(ascii_words)
    def holds(text):
        assert rule.anchor in text and licenses.spaced(rule.key) in text

    assert rule.anchor in license_rules.ANCHORS
    holds()


def test_labels_places_and_overlaps_equal_a_plain_walk(docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.report(docs(TEXTS)).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [plain(t) for t in TEXTS]
    assert got[4][5] == "gpl,gpl-3.0" and got[8][5] == "cc-by,cc-by-nc-4.0" and got[10][1] == 3


def test_awkward_rows_and_clashing_columns(docs, awkward):
    wide = docs(awkward).selectExpr("*", "1 AS row", "2 AS flat", "3 AS found", "4 AS labels")
    rows = licenses.report(wide).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = [(i, *plain(t)) for i, t in awkward]
    assert sorted((tuple(r) for r in rows), key=key) == sorted(want, key=key)
    assert licenses.report(docs(awkward).limit(0)).collect() == []


def test_no_python_in_the_plan(docs):
    for df in (licenses.scan(docs(TEXTS), RULES), licenses.report(docs(TEXTS))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_query_matches_sql(spark, data_dir):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data_dir}/documents.parquet'")
    cursor = con.execute(entry.oracle_sql()["op12_license_scan"])
    names = [c[0] for c in cursor.description]
    got = entry.queries()["op12_license_scan"](spark, data_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())
