"""Corpus pipeline: each stage against a brute-force version on its own input."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from textlab.llm import common, decontam, pii

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the output of each stage."""
    docs, out = common.read_documents(spark, SF), []
    for name, stage in cp.STAGES:
        result = common.materialize(stage(spark, docs, SF), "test-stage")
        out.append((name, docs, result))
        docs = result
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "personal data", "packing"]
    assert all(out.columns == COLUMNS for _, _, out in stages[:-1])


def test_quality_keeps_clean_documents(spark, stages):
    _, before, after = stages[0]
    label = {r.doc_id: r.quality for r in common.read_table(spark, SF, "labels").collect()}
    kept = set(rows(after))
    good = [d for d in rows(before) if label.get(d) == 1]
    bad = [d for d in rows(before) if label.get(d) == 0]
    assert np.mean([d in kept for d in good]) > 0.95 and np.mean([d in kept for d in bad]) < 0.35
    assert all(rows(before)[d] == r for d, r in rows(after).items())


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    docs = rows(before)
    sets = {}
    for d, r in docs.items():
        w = r.text.encode().lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {d: d for d in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if a < b and sets[a] and low[a] != low[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    m, old = min(low[a], low[b]), max(low[a], low[b])
                    low = {d: m if v == old else v for d, v in low.items()}
                    changed = True
    assert set(rows(after)) == set(low.values()) and len(rows(after)) < len(docs)


def test_leaks_go(spark, stages):
    _, before, after = stages[2]
    items = [decontam.normalise(r.text) for r in common.read_table(spark, SF, "benchmark").collect()]
    leaky = {d for d, r in rows(before).items() if any(i in decontam.normalise(r.text) for i in items)}
    assert leaky and not leaky & set(rows(after))
    assert len(rows(before)) - len(rows(after)) <= len(leaky) + 1


def test_personal_data_is_masked(stages):
    _, before, after = stages[3]
    a, b = rows(before), rows(after)
    assert set(a) == set(b)
    changed = 0
    for d, r in a.items():
        spans = pii.base_spans(r.text)
        if spans:
            changed += 1
            assert not any(r.text[s:e] in b[d].text for _, s, e in spans)
        elif not pii._EVIDENCE.search(r.text):
            assert b[d].text == r.text
        assert b[d].n_chars == len(b[d].text)
    assert changed


def test_packing_holds_every_token(stages):
    _, before, after = stages[4]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in after.collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(rows(before))
    for d, r in rows(before).items():
        ids, at = np.array(tok.encode(r.text, add_special_tokens=False).ids + [2], "<u4"), 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert p.start == at and zlib.crc32(ids[at:at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)


def test_run_and_edge_cases(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(80)) + ".\nAnd another line, with words."
    data = [(1, good, "en", "s", 5), (2, None, "en", None, None), (3, "", None, "s", 0), (4, good, "en", "s", 5), (4, good, "en", "s", 5), (None, good + " x", "en", "s", 1), (7, "long " * 20000, "en", "s", 9)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this stands in any of the texts above"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()}
    assert {1, 2, 3, 7} <= got and 4 not in got


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_other_texts_of_a_copied_id_stay(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    data = [(1, a), (2, a + " more"), (2, b), (2, b), (3, None), (None, a), (None, "own text"), (5, b + " x"), (5, "short")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, None), (None, a), (None, "own text"), (5, "short")], key=str)


def test_further_columns_keep_their_values(spark):
    a = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a, 7, "x"), (2, a, 8, "y"), (3, "short", 9, None)], "doc_id long, text string, text_hash long, text_hash_ string")
    got = cp.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, a, 7, "x"), (3, "short", 9, None)]
