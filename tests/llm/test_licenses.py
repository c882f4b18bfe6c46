import re
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vitrine.llm import licenses, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = licenses.rules()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text):
    w, out = words(text), []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    return sorted(out)


def brute(text):
    """Matches of all rules without prefilter or gates, containment resolved over all pairs."""
    w = words(text)
    line = " " + " ".join(w) + " "
    found = []
    for k, r in enumerate(RULES):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
            first = line[:m.start()].count(" ") - 1
            found.append((r.priority, first, first + m[0].count(" "), k, r.label, r.confidence))

    def covered(x):
        return x[0] > 0 and any(y[0] > 0 and y[0] <= x[0] and y[1] <= x[1] and y[2] >= x[2]
                                and (y[1], -y[2], y[0], y[3]) < (x[1], -x[2], x[0], x[3]) for y in found)

    keep = [x for x in found if not covered(x)]
    family = licenses.families(RULES)
    versions = [x for x in keep if x[0] > 0 and family.get(x[4], x[4]) != x[4]]
    keep = [x for x in keep if x[0] == 0 or x in versions or family.get(x[4]) != x[4]
            or not any(family[v[4]] == x[4] and v[1] <= x[2] and v[2] >= x[1] for v in versions)]
    return len(w), sorted({x[4] for x in keep}), max([x[5] for x in keep], default=0.0), len(keep)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        b = base(texts[r.id])
        n, labels, score, spans = brute(texts[r.id])
        assert (r.n_words, r.n_base, r.n_spans, r.score) == (n, len(b), spans, score), texts[r.id]
        assert r.labels == ",".join(labels) and r.base_labels == ",".join(sorted({x for _, x in b}))
        assert (r.first_word, r.last_word) == ((b[0][0], b[-1][0]) if b else (None, None))


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(licenses.scan(docs).collect(), texts)
    assert {r.doc_id for r in queries.op3_license_scan(spark, SF_SMALL).collect()} == set(texts)


def test_hundreds_of_rules_with_keywords():
    assert len(RULES) >= 250 and len({(r.pattern, r.label) for r in RULES}) == len(RULES)
    assert len(licenses.SENTENCES) + len(licenses.NOTICES) + len(licenses.NAMES) >= 130  # not from templates


with warnings.catch_warnings():
    warnings.simplefilter("ignore")

    @settings(max_examples=12, deadline=None)
    @given(st.data())
    @pytest.mark.parametrize("k", range(0, 24))
    def test_prefilter_and_gates_lose_no_match(k, data):
        gate = re.compile(licenses.PREFILTER)
        for r in RULES[k::24]:
            text = data.draw(st.from_regex(re.compile(r.pattern, re.A), fullmatch=True))
            assert gate.search(text), (r, text)
            assert f" {r.keywords[0]}" in f" {text}" and r.keywords[1] in text, (r, text)


def test_edges_and_resolution(spark):
    texts = {
        1: None, 2: "", 3: "... ---", 4: "Under the MIT License, under the MIT license. CC-BY NC cc by nc",
        5: "Licensed under the Apache License, Version 2.0 and the GNU General Public License v3",
        6: "word " * 30_000 + "SPDX-License-Identifier: GPL-3.0-or-later", 7: "über the mit license é",
        8: "apache license version 2 " * 300, 9: "under the Kelvin mitK license", 10: "cc by\tnc 4.0 license"}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, rule int, label string")
    check(licenses.scan(df).collect(), texts)
    got = {r.id: r for r in licenses.scan(df).collect()}
    assert got[6].labels == "gpl-3.0" and got[6].score == 1.0
    assert got[5].labels == "apache-2,apache-2.0,gpl-3.0"
    assert got[8].n_base == 300
    assert licenses.scan(df.limit(0)).collect() == []
    twice = df.where("doc_id = 4").unionAll(df.where("doc_id = 4"))
    assert [r.n_base for r in licenses.scan(twice).collect()] == [4, 4]
    spans = licenses.detect(df.where("doc_id = 5")).where(F.col("priority") > 0).collect()
    assert all(s.last >= s.first for s in spans)


def test_versions_suppress_their_family(spark):
    """Every family with a general and a versioned label, with and without the article."""
    family = licenses.families(RULES)
    assert {"gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "cddl", "bsd", "apache", "artistic"} <= set(family.values())
    texts, want = {}, {}
    for label, kw, _, name, version, _, _ in licenses.LICENSES:
        if family.get(label, label) == label or not version or "(" in version.replace("(?: 0)?", ""):
            continue
        name = re.sub(r"\(\?:([^|)]*)[^)]*\)\??", lambda m: m[1], name)
        plain = re.sub(r" +", " ", f"{name} license, version {version.replace('(?: 0)?', '.0')}").strip()
        for k, text in enumerate((f"Released under the {plain} today", f"We use {plain} here", f"The {plain}")):
            texts[len(texts)] = text
            want[len(want)] = label
    for text, label in (("the GNU General Public License v3", "gpl-3.0"), ("GNU General Public License v3", "gpl-3.0"), ("the GNU GPL version 2", "gpl-2.0"),
                        ("the GNU GPL", "gpl"), ("GNU Lesser General Public License", "lgpl"), ("the new BSD license", "bsd-3-clause"), ("the BSD license", "bsd"),
                        ("free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2", "gpl-2.0"),
                        ("the Apache License", "apache"), ("the Apache Software License, Version 1.1", "apache-1.1")):
        texts[len(texts)] = text
        want[len(want)] = label
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = licenses.scan(df).collect()
    check(rows, texts)
    for r in rows:
        assert set(r.labels.split(",")) - {"apache-2"} == {want[r.id]}, (texts[r.id], r.labels)
    assert len(texts) >= 30
