"""The pipeline against a brute-force version, stage by stage, and its edge cases."""

import numpy as np
import pytest
from test_llm import brute_contamination, brute_join, check_pieces, words
from pyspark.sql import functions as F

import corpus_pipeline as P
from lattica.llm import toxicity
from lattica.llm.common import table

SMALL = "/root/testdata/sf0.001"


def brute_cut(docs, width=100):
    """(doc_id, text without repeated bytes) in order of ids."""
    seen, out = {}, {}
    for doc, text in sorted(docs):
        b = text.encode()
        m = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            if seen.setdefault(b[s : s + width], (doc, s)) != (doc, s):
                m[s : s + width] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([True], m, [True])).astype(np.int8)))
        out[doc] = "".join(b[i:j].decode(errors="ignore") for i, j in zip(edge[::2], edge[1::2], strict=True))
    return out


def test_whole_pipeline(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    text = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, table(spark, SMALL, "labels").select("doc_id", "toxic"))
    grammar = toxicity.Grammar()
    kept = {i: t for i, t in text.items() if model.score(*toxicity.features(t, model.lexicon, grammar)[:3]) < 0.5}
    classes = brute_join(sorted(kept.items()))
    kept = {i: t for i, t in kept.items() if classes[i][0] == i}
    kept = brute_cut(list(kept.items()))
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    hit = {d for d, _, n, _ in brute_contamination(list(kept.items()), items) if n}
    kept = {i: t for i, t in kept.items() if i not in hit}
    rows = P.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(kept)
    check_pieces(rows, list(kept.items()))


@pytest.mark.parametrize("name, stage", P.STAGES[:-1])
def test_stage_edges(spark, edge_docs, no_docs, name, stage):
    got = stage(spark, edge_docs, SMALL)
    assert got.columns == edge_docs.columns and got.schema.fieldNames() == edge_docs.schema.fieldNames()
    ids = sorted(r.doc_id for r in got.where("doc_id is not null").collect())
    assert {4, 5, 6, 12, 13} <= set(ids)
    if name == "jaccard_join":
        assert ids == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13]
    if name == "suffix_dedup":
        rows = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
        assert rows[2].text == "" and rows[2].n_chars == 0 and rows[4].text is None and rows[1].text
    assert stage(spark, no_docs, SMALL).count() == 0


def test_texts_that_share_an_id_stay(spark):
    docs = spark.createDataFrame([(1, words(80, 1)), (1, words(80, 2)), (2, words(80, 1)), (3, words(80, 2)), (1, words(80, 1))], "doc_id long, text string")
    kept = P.drop_near_copies(spark, docs, SMALL)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, words(80, 1)), (1, words(80, 2))])
    cut = P.cut_repeats(spark, kept, SMALL)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, kept.collect()))


def test_last_stage_edges(spark, edge_docs, no_docs):
    assert P.pack(spark, edge_docs, SMALL).agg(F.sum("length")).first()[0] > 0
    assert P.pack(spark, no_docs, SMALL).count() == 0


def test_stages_are_as_agreed():
    assert [n for n, _ in P.STAGES] == ["toxicity", "jaccard_join", "suffix_dedup", "decontamination", "packing"]
