"""Cases of the second review, each of which failed before."""

from __future__ import annotations

import random
import re._parser as regex

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rosterfold.llm import decontaminate, licenses, quality, suffix_dedup, toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("held_out", [True, False])
def test_toxic_documents_are_found_in_each_language(spark, held_out):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    markers = toxicity.fit(docs, labels.where(~other)) if held_out else None
    tested = docs.join(labels.where(other), "doc_id").where("quality = 1")
    passed = quality.passing(tested, "web_v3", markers) if held_out else corpus_pipeline.quality_rules(spark, docs, SF).join(labels.where(other), "doc_id")
    before = {(r.lang, r.toxic): r["count"] for r in quality.passing(tested, "base_v1").groupBy("lang", "toxic").count().collect()}
    after = {(r.lang, r.toxic): r["count"] for r in passed.where("quality = 1").groupBy("lang", "toxic").count().collect()}
    assert {lang for lang, toxic in before if toxic} == {"en", "fr", "de", "es"}
    for (lang, toxic), n in before.items():
        if toxic:
            assert after.get((lang, 1), 0) <= 0.15 * n, (lang, n, after)
        else:
            assert after[lang, 0] >= 0.9 * n, (lang, n, after)


def test_ledger_has_a_bit_for_toxic_words(spark):
    clean = " ".join(f"mot{k}x" for k in range(80))
    rows = [(k, f"{clean} gromelu truc{'e' * (k % 7)}") for k in range(6)] + [(k, clean) for k in range(6, 90)] + [(None, None), (90, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < 6)) for k in range(90)] + [(None, 1), (7, None), (5000, 1)], "doc_id bigint, toxic int")
    markers = toxicity.fit(docs, labels)
    found = quality.ledger(docs, markers).cache()
    bit = 1 << len(quality.RULES)
    assert {r.doc_id for r in found.collect() if r.failed & bit} == set(range(6))
    assert {r.doc_id for r in found.where(quality.kept("web_v3")).collect()} == set(range(6, 90))
    assert next(r.n_failed for r in quality.ablation(found).collect() if (r.policy, r.rule) == ("web_v3", "toxic")) == 6
    assert len(toxicity.fit(docs, labels.where("toxic = 0"))) == 0
    with pytest.raises(ValueError):
        quality.passing(docs, "web_v3")
    assert toxicity.count_toxic([b"gromelu GROMELU", b""], np.zeros(0, np.uint64)).tolist() == [0, 0]
    assert toxicity.count_toxic([b"gromelu GROMELU", b""], markers).tolist() == [2, 0]


def test_copies_of_dense_short_and_re_cased_items_are_found():
    dense = "Solve 12 + 30 = 42, 14 + 16 = 30 and 7 + 8 = 15 now"
    plain = "each of the small boxes on that table holds exactly seven red marbles and one blue marble"
    title = plain.title()
    half = "the price of 17 19 23 29 31 37 41 43 47 53 59 61 67 71 73 79"
    items = [dense, title, plain.upper(), "Ada Lovelace 1843", "Paris", "sum 4 and 5 6", half]
    bench = decontaminate.Benchmark(list(range(len(items))), [t.encode() for t in items])

    def found(text):
        return {i: (n, total, exact) for _, (i, n, total, _, exact, _, _) in decontaminate.search(bench, [text.encode()], decontaminate.SHARE)}

    assert bench.n_windows.tolist() == [5, 10, 10, 1, 1, 1, 12]
    assert found(f"Well. {dense} Right.") == {0: (5, 5, True)}
    for text in (plain, title, plain.upper()):
        assert found(f"so {text} then") == {1: (10, 10, True), 2: (10, 10, True)}
    assert found("by ADA LOVELACE 1843 and in paris") == {3: (1, 1, True), 4: (1, 1, True)}
    assert found("the Sum 4 and 5 6 is") == {5: (1, 1, True)}
    # one window of twelve is not the item, and numbers filled anew beside nothing else are no hit
    assert found("the price of 17 19 23 29 31 is high") == {}
    assert found("Solve 13 + 31 = 44, 15 + 17 = 32 and 8 + 9 = 17 now") == {}
    assert found("sum 8 and 9 7") == {}


def test_dense_windows_beside_a_hit_count_for_items_filled_anew():
    item = "so the boxes on the long table hold 3 4 5 6 7 8 red ones"
    bench = decontaminate.Benchmark([1], [item.encode()])

    def found(text, queries=bench):
        return [(n, total, exact) for _, (_, n, total, _, exact, _, _) in decontaminate.search(queries, [text.encode()], decontaminate.SHARE)]

    assert found("so the boxes on the long table hold 9 1 2 3 5 6 red ones") == [(9, 9, False)]
    # one value stands for two: the windows with both do not count
    twice = decontaminate.Benchmark([1], [b"so the boxes on the long table hold 3 3 red and 5 6 7 8 ones"])
    assert found("so the boxes on the long table hold 1 2 red and 5 6 7 8 ones", twice) == []
    # eight tokens of twenty-four are not the item, however few of its windows have literal words
    names = " ".join(f"Ab{k} Cd{k} Ef{k}" for k in range(6))
    few = decontaminate.Benchmark([1], [f"and then all of us went by {names}".encode()])
    assert found("and then all of us went by Xy", few) == []


def test_passage_beyond_16_mib_of_a_text_is_cut(spark):
    rnd = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    long = letters[rnd.integers(0, 27, (1 << 24) + 100_000)].tobytes()
    at = (1 << 24) + 40_000
    passage = long[at : at + 700]
    short = b"0" * 150 + passage + b"1" * 150
    whole, piece = (set(suffix_dedup.anchors([t]).tolist()) for t in (long, passage))
    assert piece <= whole
    docs = spark.createDataFrame([(1, long.decode()), (2, short.decode())], "doc_id bigint, text string")
    got = {r.doc_id: r for r in suffix_dedup.digest(suffix_dedup.dedup_substrings(docs)).collect()}
    assert {k: (r.n_bytes, r.n_removed, r.n_spans) for k, r in got.items()} == {1: (len(long), 700, 1), 2: (1000, 700, 1)}


def test_least_places_do_not_depend_on_pieces():
    hashes = np.random.default_rng(6).integers(0, 1 << 63, 5000).astype(np.uint64)
    hashes[::3] = hashes[7]
    expected = [min(range(k, k + 40), key=lambda j: (int(hashes[j]) >> 24, j)) for k in range(4961)]
    for piece in (1 << 24, 64, 41, 40):
        assert suffix_dedup._least(hashes, 40, piece).tolist() == expected


def forms(parsed) -> list[str]:
    """The shortest text of a regex, and others so that each branch and option stands in one."""
    parts = []
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            parts.append([chr(arg)])
        elif kind == "IN":
            parts.append([chr(a if str(o) == "LITERAL" else a[0]) for o, a in arg])
        elif kind == "SUBPATTERN":
            parts.append(forms(arg[3]))
        elif kind == "BRANCH":
            parts.append([t for branch in arg[1] for t in forms(branch)])
        else:
            assert kind == "MAX_REPEAT"
            parts.append(list(dict.fromkeys(t * n for n in sorted({arg[0], arg[1]}) for t in forms(arg[2]))))
    shortest = [min(p, key=len) for p in parts]
    return list(dict.fromkeys(["".join(shortest)] + ["".join([*shortest[:k], t, *shortest[k + 1 :]]) for k, p in enumerate(parts) for t in p]))


def test_each_license_rule_fires_on_its_own_forms_alone(spark):
    texts = list(dict.fromkeys(t.strip() for _, _, rule, _ in licenses.rules() for t in forms(regex.parse(rule))))
    assert "released under mpl" in texts and "for noncommercial use only" in texts
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    missed = [
        texts[r.doc_id] for r in licenses.scan(docs).collect()
        if not r.labels or not any(d.start == 0 and d.past == r.n_words for d in r.detections)
    ]
    assert len(missed) == 0, missed[:40]


def test_license_texts_without_a_common_gate(spark):
    texts = {
        "Distributed under MPL 2.0": "mpl-2.0", "EPL-2.0": "epl-2.0", "GFDL 1.3": "gfdl-1.3", "OFL 1.1": "ofl-1.1",
        "MS-PL": "ms-pl", "MPLv2.0": "mpl-2.0", "GPLv3": "gpl-3", "Released under the MIT": "mit", "for noncommercial use only": "noncommercial",
        "for non-commercial use only": "noncommercial", "Copyright \u00a9 2020": "copyright", "copyright \u00a92021": "copyright",
        "Copyright (c) 2020": "copyright", "the simple example, mit dem understatement": "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.labels for r in licenses.scan(docs).orderBy("doc_id").collect()] == list(texts.values())


def test_license_windows_find_what_the_whole_text_holds(spark, monkeypatch):
    rnd = random.Random(1)
    lines = [
        "Licensed under the Apache License, Version 2.0.", "CC BY-SA 4.0", "all rights reserved", "released under the MIT license",
        "GPL v3 or later", "copyright 2020", "for noncommercial use only", "creative commons attribution non commercial 4.0 license",
    ]
    rows = [(k, " ".join(rnd.choice(lines) if rnd.random() < 0.3 else f"w{rnd.randrange(50)}" for _ in range(rnd.choice([5, 300, 900])))) for k in range(20)]
    docs = spark.createDataFrame([*rows, (100, None), (101, ""), (102, "...")], "doc_id bigint, text string")
    monkeypatch.setattr(licenses, "CORE", 1 << 20)
    whole = sorted(licenses.scan(docs).collect())
    monkeypatch.setattr(licenses, "CORE", 100)
    assert sorted(licenses.scan(docs).collect()) == whole and sum(len(r.detections) for r in whole) > 500


def test_license_scan_of_a_long_text(spark):
    text = "Licensed under the MIT License. " * 8000
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert len(found.detections) == 8000 and found.labels == "mit" and found.n_words == 40_000
