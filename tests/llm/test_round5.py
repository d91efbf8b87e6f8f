"""Words met in several forms are learned once; what is left out of a join is not shuffled first."""

import itertools

from pyspark.sql import functions as F

from test_llm import words

from lattica.llm import chosenpath, compactwindows, packing, queries


def test_forms_of_a_word_are_learned_once():
    path = queries.word_tokenizer()
    packing.forget(path)
    packing.tokenize(["Word, word. WORD word, wOrd. end", "word, Word. end"], path, 2)
    assert set(packing._tokenizer(path)[2][0]) == {"word", ",", ".", "end"}


def test_marks_that_touch_stay_together():
    path = queries.word_tokenizer()
    tokenizer = packing._tokenizer(path)[0]
    before = ["x", "&&&", "\u00ab", "\u00d7", "\u00bd", "\u00aa", "_", "\x1c", "\x85", "\xa0", "\x7f", "9", "'s", "'", ",", ".", " ", "\n", "<|endoftext|>", "<|ENDOFTEXT|>", "\u00c9", "\u0130"]
    texts = [f"a{x}{y}{m} B'S{m}" for x, y, m in itertools.product(before, before, [",", ". ", ", , ", ",. ", "\n,\n"])]
    packing.forget(path)
    for t, got in zip(texts, packing.tokenize(texts, path, 2), strict=True):
        assert got.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2], t


def test_nodes_and_texts_are_not_shuffled_to_be_left_out(spark, monkeypatch):
    """Large nodes leave the others, and texts without candidates the join, before any shuffle; with many of either the rows are the same."""
    plans, map_batches = [], chosenpath.map_batches
    monkeypatch.setattr(chosenpath, "map_batches", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or map_batches(df, *a))
    base = words(120, 7).split()
    texts = [" ".join([*base[:i], "new", *base[i + 1 :]]) for i in range(0, 60, 2)] + [words(100, 100 + i) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(tuple(r) for r in chosenpath.near_duplicates(docs).collect())
    candidates = chosenpath.candidates
    monkeypatch.setattr(chosenpath, "candidates", lambda c, threshold, target: candidates(c, threshold, target, bucket=8))
    for sent in (chosenpath.SENT, 0):
        plans.clear()
        monkeypatch.setattr(chosenpath, "SENT", sent)
        assert sorted(tuple(r) for r in chosenpath.near_duplicates(docs).collect()) == want
        lines = [line for p in plans for line in p.splitlines()]
        if sent:
            assert all(any("BroadcastHashJoin" in x and kind in x for x in lines) for kind in ("LeftAnti", "LeftSemi"))
            assert not any("SortMergeJoin" in x and "LeftAnti" in x for x in lines)
        else:
            assert not any("LeftSemi" in x for x in lines)


def test_a_text_that_holds_an_interval_at_many_places_joins_once(spark):
    tokens = bytes(range(138))
    rows = [(9, d, 50 + 7 * i, -20, tokens) for d in (1, 2) for i in range(500)]
    each = spark.createDataFrame(rows, "key long, doc long, at int, low int, tokens binary").withColumn("name", F.xxhash64("key", "low", "tokens"))
    crowded = compactwindows._crowded(each, 50, 5, 0.8)
    found = crowded.collect()
    assert sorted((r.a, r.start, r.end) for r in found if r.kind == 1) == sorted((d, at - 20, at + 30) for _, d, at, *_ in rows)
    assert sorted(r.a for r in found if r.kind == 0) == [1, 2] and len({r.b for r in found if r.kind == 0}) == 1
    assert "collect_set(at" in crowded._jdf.queryExecution().optimizedPlan().toString()


def test_places_of_an_interval_in_a_text_stay_in_a_list(spark, monkeypatch):
    """Two texts repeat a line 300 times: what is found for a crowd takes a row for each text and interval, not for each place, and nothing is exploded by place."""
    stored, store = [], compactwindows.store

    def counted(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        out = store(df, name)
        stored.append((name, out[0].count(), "Generate explode" in plan))
        return out

    monkeypatch.setattr(compactwindows, "store", counted)
    line = words(10, 51) + " "
    docs = [(i, f"{words(60, 60 + i)} {line * 300}{words(60, 70 + i)}") for i in range(2)] + [(2, words(60, 80)), (3, f"{words(55, 60)} other")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {}
    for crowd in (8192, 16):
        stored.clear()
        monkeypatch.setattr(compactwindows, "CROWD", crowd)
        got = compactwindows.substring_duplicates(frame).withColumn("n", compactwindows.covered_words(F.col("spans"))).collect()
        found[crowd] = sorted((r.doc_id, r.class_id, r.n_links, r.n, [tuple(s) for s in r.spans]) for r in got)
    assert found[16] == found[8192]
    assert [x[:3] for x in found[16]] == [(0, 0, 2), (1, 0, 2), (2, 2, 0), (3, 0, 2)] and all(len(x[4]) > 250 and x[3] >= 3000 for x in found[16][:2])
    assert {name for name, *_ in stored} >= {"windows", "crowds"}
    assert all(count < 100 and not made for name, count, made in stored if name not in ("windows", "crowds"))
