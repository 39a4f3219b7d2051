"""The registered queries and the pipeline over the smallest tables."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rosterfold.llm import decontaminate, quality
from rosterfold.llm.queries import ORACLE, QUERIES
from tests.llm import cases
from tests.llm.test_operators import WORDS, library_ids
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == []


def test_language_query_is_right_on_held_out_documents(spark):
    got = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    langs = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect())
    assert sum(r.lang_pred == langs[r.doc_id] for r in got) >= 0.98 * len(got) > 0


def test_pipeline_matches_a_brute_force_version(spark):
    """Every stage by plain Python, from the documents to the pieces that are packed."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = quality.measure([(t or "").encode() for _, t in docs])
    keep = np.ones(len(docs), bool)
    for rule in quality.POLICIES["web_v2"]:
        keep &= ~eval(quality.RULES[rule], {}, found)
    for (_, text), k in zip(docs, range(len(docs)), strict=True):
        assert tuple(int(found[m][k]) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == cases.measures(text)
    docs = [d for d, good in zip(docs, keep, strict=True) if good]
    stays = {d for d, _, c in cases.components(docs) if d == c}
    docs = [d for d in docs if d[0] in stays]

    data = [t.encode() for _, t in docs]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    cut = []
    for (doc_id, _), b in zip(docs, data, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        cut.append((doc_id, bytes(np.frombuffer(b, np.uint8)[~gone]).decode(errors="ignore")))
    docs = [(d, t) for d, t in cut if cases.words(t)]

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    shared = decontaminate.Benchmark([i for i, _ in items], [t.encode() for _, t in items])
    dirty = {d for d, _ in decontaminate.search(shared, [t.encode() for _, t in docs], decontaminate.SHARE)}
    docs = [d for k, d in enumerate(docs) if k not in dirty]

    expected: Counter = Counter()
    for (doc_id, _), ids in zip(docs, library_ids(WORDS, [t for _, t in docs]), strict=True):
        ids = [*ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected[doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 2048) + 1
