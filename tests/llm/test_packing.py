"""Packing: every id once, against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textlab.llm import packing
from textlab.session import materialize

FILE = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(FILE)


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check(rows, texts):
    """Every document is rebuilt from its pieces; offsets have no gaps; padding counts."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids, at = np.array(ids_of(text), dtype="<u4"), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_documents(spark):
    texts = {1: "Hello, World!  It's 3.5 km.", 2: None, 3: "", 4: "x y " * 9000, 5: "a\x0bb c d\r\n\te",
             6: "<|endoftext|> said <|ENDOFTEXT|> ΣΑΣ İx", 7: "Hello, World!  It's 3.5 km.", 8: "é" * 500, 9: "日本語 テキスト"}
    df = spark.createDataFrame([(k, v, 9) for k, v in texts.items()], "doc_id long, text string, length int")
    rows = packing.pack_documents(df, FILE).collect()
    assert check(rows, texts) == 0


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two")] * 3 + [(None, "three")], "doc_id long, text string")
    rows = packing.pack_documents(df, FILE).collect()
    assert sum(r.length for r in rows) == 3 * 3 + len(ids_of("three"))
    assert packing.pack_documents(df.limit(0), FILE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([16, 64]))
def test_pack_every_token_once_without_padding(lengths, capacity):
    seen = [np.zeros(n, int) for n in lengths]
    for seq in packing.pack(lengths, capacity):
        total = sum(n for _, _, n in seq)
        assert total <= capacity and total & (total - 1) == 0
        for i, start, n in seq:
            seen[i][start:start + n] += 1
    assert all((s == 1).all() for s in seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=40))
def test_tournament_tree_is_first_fit(sizes):
    tree, free = packing.TournamentTree(len(sizes), 20), [20] * len(sizes)
    for n in sizes:
        want = next(i for i, f in enumerate(free) if f >= n)
        assert tree.place(n) == want
        free[want] -= n


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\rAbÉé'sΣσİ1.,<|>́  "), st.characters(codec="utf-8")), max_size=40))
def test_word_table_equals_tokenizer(text):
    got = np.frombuffer(packing.encode(packing.word_ids(FILE), [text])[0], "<u4").tolist()
    assert got == TOK.encode(text, add_special_tokens=False).ids


def test_small_table_gives_the_same_ids(monkeypatch):
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'.' * (i % 3)}" for i in range(j, j + 40)) for j in range(0, 400, 7)]
    want = [TOK.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(packing, "TABLE_LIMIT", 50)
    monkeypatch.setattr(packing, "TOGETHER", 3)
    monkeypatch.setattr(packing, "MARKED_LIMIT", 5)
    got = packing.encode(packing.WordIds(FILE), texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_every_character_alone_before_a_mark_and_inside_a_word():
    chars = [chr(c) for c in range(0x20000) if not (0xD800 <= c < 0xE000 or 0x4E00 <= c < 0x9F00 or 0xAC00 <= c < 0xD700)]
    for lo in range(0, len(chars), 4096):
        part = chars[lo:lo + 4096]
        words = [w for c in part for w in (c, f"a{c}.,", f"a{c}b")]
        want = [e.ids for e in TOK.encode_batch(words, add_special_tokens=False)]
        got = packing.encode(packing.word_ids(FILE), words)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want, hex(ord(part[0]))


def test_repeated_rows_spread_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 64 << 10)
    df = spark.createDataFrame([(1, None)] * 2000, "doc_id long, text string").repartition(3)
    rows = packing.pack_documents(materialize(df), FILE).collect()
    groups = {r.sequence_id >> 32 for r in rows}
    assert len(rows) == 2000 and len(groups) == -(-2000 * packing.ROW_BYTES // (64 << 10))


def test_workers_keep_no_words_after_packing(spark, monkeypatch):
    """The workers that encoded the texts are reused by later stages, which need their memory."""
    monkeypatch.setattr(packing, "GROUP_BYTES", 1 << 10)
    docs = materialize(spark.createDataFrame([(i, f"some words of text{i}") for i in range(800)], "doc_id long, text string").repartition(8))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert packing.pack_documents(docs, FILE, table_words=10_000).select("doc_id").distinct().count() == 800
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

    def tables(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [packing.word_ids.cache_info().currsize]})

    assert sum(r.n for r in spark.range(0, 64, 1, 64).mapInArrow(tables, "n long").collect()) == 0


def test_words_kept_can_be_bounded_by_the_caller(spark):
    texts = [" ".join(f"w{chr(97 + i)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for i in range(20)) for j in range(600)]
    want, table = packing.encode(packing.WordIds(FILE), texts), packing.WordIds(FILE)
    for lo in range(0, len(texts), packing.TOGETHER):  # at most the bound and the words of the last texts
        assert packing.encode(table, texts[lo:lo + packing.TOGETHER], 100) == want[lo:lo + packing.TOGETHER]
        assert len(table) <= 100 + 1 + 20 * packing.TOGETHER
    docs = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(packing.pack_documents(docs, FILE, table_words=100).collect()) == sorted(packing.pack_documents(docs, FILE).collect())
