"""The kernels give what the column functions give, and the texts pass through them once."""

from __future__ import annotations

import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from textlab.functions import rules as R
from textlab.functions import text as T
from textlab.operators import segment as S
from textlab.operators import stats as A
from textlab.operators import token_kernel as K
from textlab.plans import corpus_report as CR

PIECES = ["a", "Mr", "cannot", "'tis", "d'ye", "more'n", "dog", "'s", "'", '"', ".", "..", "...", ",", ":", "3", "14", "--", "-", "(", ")", "]", "»", "“", "”", "’",
          "[", "<", ">", "}", "!", "?", R.SENT_MARK, R.ABBR_MARK, R.ESCAPE, "n't", "'ll", " ", " ", " ", "  ", "\n", "\n\n", "\t", " ", "　", "é", "œ", "İ",
          "ß", "ΑΣ", "$", "x", "gimme", "1.", "ca.", " ", "\x85", "𝒳", "😀"]


def _texts(n):
    rnd = random.Random(11)
    return [None, "", " \n ", ".''", "x. .''", "x! .''", "a\n\n.''\n\n.''\n\n.", ". .'' .'' .) .''"] + ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_kernel_equals_the_rules(spark):
    rows = [(i, ("en", "de", "fr", None)[i % 4], t) for i, t in enumerate(_texts(4000))]
    m = spark.createDataFrame(rows, "i int, lang string, t string").repartition(4).select("lang", "t", T.mark_sentences("t", "lang").alias("m"))
    x = m.select("*", K.measured("m").alias("k"), K.sentence_tokens("m").alias("nested"), T.token_array("m").alias("toks"), T.sentence_array("m").alias("sents"))
    x = x.select("*", T.flesch("toks", F.size("sents"), "lang").alias("want_fre"), F.transform("sents", T.sentence_tokens).alias("want_nested"),
                 T.flesch_score("k.words", "k.syllables", "k.n_sents", "lang").alias("fre"))
    for r in x.collect():
        if r.t is None:
            assert r.k is None and r.nested is None
            continue
        assert r.k.toks == r.toks and r.nested == r.want_nested and r.fre == r.want_fre, r.t
        assert (r.k.n_sents, r.k.n_tokens, r.k.sum_token_len) == (len(r.sents), len(r.toks), sum(map(len, r.toks))), r.t


def test_full_tables_change_nothing(monkeypatch):
    texts = [t.strip() for t in _texts(300) if t]
    full = [K.Words().sentences(t) for t in texts]
    monkeypatch.setattr(K, "TABLE_LIMIT", 0)
    assert [K.Words().sentences(t) for t in texts] == full


def test_pairs_equal_the_columns(spark):
    words = spark.createDataFrame([("en", "was", "be"), ("en", "dogs", "dog"), ("en", "a", "--"), ("en", "b", "")], "lang string, token string, lemma string")
    texts = _texts(60) + ["He was here. The dogs was a b."]
    pairs = [("test", i, s, texts[-1 - i]) for i, s in enumerate(texts)]
    got = CR.pair_table(spark.createDataFrame(pairs, "split string, pair_id bigint, source string, target string"), words)
    for r in got.collect():
        s, t = ([] if None in pairs[r.pair_id][2:] else x for x in _cleaned(spark, pairs[r.pair_id][2:]))
        assert (r.s_raw, r.t_raw) == tuple(list(dict.fromkeys(c for c, _ in x)) for x in (s, t))
        s, t = ([c for _, c in x] for x in (s, t))
        assert (r.s_lem, r.t_lem) == (list(dict.fromkeys(s)), list(dict.fromkeys(t)))
        for n in (1, 2, 3):
            a, b = ({tuple(x[i:i + n]) for i in range(len(x) - n + 1)} for x in (s, t))
            assert r[f"nov_{n}"] == (len(b - a) / len(b) if b else 0.0)


def _cleaned(spark, texts):
    lemmas = {"was": "be", "dogs": "dog", "b": ""}
    clean = lambda t: R.SPECIAL_TOKEN if len(t) != 1 and not t.strip(R.SPECIAL_CHARS) else t
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.token_array(T.mark_sentences("t", F.lit("en"))).alias("x")).collect()
    return [[(clean(t), clean(lemmas.get(t, t))) for t in r.x or []] for r in rows]


def test_tokens_are_made_by_the_kernel(spark):
    docs = spark.createDataFrame([(1, "en", "One, two. Three!")], "doc_id bigint, lang string, text string")
    for df in (S.tokens(docs), A.doc_table(docs), CR.pair_table(docs.selectExpr("'a' split", "doc_id pair_id", "text source", "text target"))):
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain()
        assert "ArrowEvalPython" in out.getvalue() and "regexp_extract_all" not in out.getvalue()


WORDS = [("en", "was", "be"), ("en", "dogs", "dog"), ("en", "a", "--"), ("en", "b", ""), ("de", "was", "x"), ("en", "1", "one"), ("en", "?", "??")]


def _pairs(spark):
    texts = _texts(60) + ["He was here. The dogs was a b.", "a\u0001b a b\u0001a was.", "was a was a. a was", "1 ? 1 ?"]
    return spark.createDataFrame([("test", i, ("en", "de", None)[i % 3], s, texts[-1 - i]) for i, s in enumerate(texts)],
                                 "split string, pair_id bigint, lang string, source string, target string")


def _words(spark, joined):
    """As values, which the plan knows to be small; or as rows of unknown size, which are joined."""
    d = spark.createDataFrame(WORDS, "lang string, token string, lemma string")
    return d if joined else spark.sql("SELECT * FROM VALUES " + ", ".join(str(w) for w in WORDS) + " AS w(lang, token, lemma)")


def test_pairs_with_a_table_equal_the_join(spark):
    assert S.lemma_table(_words(spark, True)) is None and S.lemma_table(_words(spark, False))["en"]["dogs"] == "dog"
    pairs = _pairs(spark)
    one, two = (CR.pair_table(pairs, _words(spark, joined)) for joined in (True, False))
    assert sorted(one.columns) == sorted(two.columns)
    one, two = ({r.pair_id: r for r in x.select(sorted(x.columns)).collect()} for x in (one, two))
    assert one == two and len(one) == pairs.count()
    reports = [sorted(CR.corpus_report(pairs, d).collect()) for d in (_words(spark, True), _words(spark, False))]
    for a, b in zip(*reports):
        assert a[:2] == b[:2] and all(x == y or abs(x - y) < 1e-9 for x, y in zip(a[2:], b[2:])), (a, b)
    both = [CR.corpus_novelty(pairs, _words(spark, joined)).first() for joined in (True, False)]
    assert both[0].novelty == both[1].novelty and abs(both[0].nov_2 - both[1].nov_2) < 1e-9


def test_tokens_of_pairs_do_not_leave_the_kernel(spark):
    """One kernel for both texts; no tokens as rows, and no shuffle of pairs."""
    out = io.StringIO()
    with redirect_stdout(out):
        CR.corpus_report(_pairs(spark), _words(spark, False)).explain()
    plan = out.getvalue()
    assert plan.count("ArrowEvalPython ") == 1 and "posexplode" not in plan and "hashpartitioning(split" not in plan


def test_emptied_tables_of_pairs_change_nothing(monkeypatch):
    rows = [("en", s, t) for s, t in zip(_texts(200), reversed(_texts(200)))]
    table = {"en": {t: m for lang, t, m in WORDS if lang == "en" and m != "--"}}

    def all_of(once):
        pairs, types, out = K.Pairs(table, once), {}, []
        for r in rows:
            x = pairs.row(*r)
            for t, k in zip(x.pop("types", []), x.pop("kinds", [])):
                types[t] = types.get(t, 0) | k
            out.append(x)
        return out, types

    want, once = all_of(False), all_of(True)
    monkeypatch.setattr(K, "TABLE_LIMIT", 40)
    assert all_of(False) == want and all_of(True) == once
    for bit, column in ((1, "s_raw"), (2, "s_lem"), (4, "t_raw"), (8, "t_lem")):
        assert {t for t, k in once[1].items() if k & bit} == {t for r in want[0] for t in r[column]}


def test_ngrams_of_large_numbers():
    rnd = random.Random(5)
    for base in (1 << 10, 1 << 20, 1 << 30):
        some = [rnd.randrange(base) for _ in range(4)] + [0, base - 1]
        a, b = ([rnd.choice(some) for _ in range(n)] for n in (90, 70))
        for n, x in enumerate(K.number_grams(K.np.array(a), K.np.array(b), base), 1):
            one, two = (set(zip(*[t[k:] for k in range(n)])) for t in (a, b))
            assert K.overlap(*x) == (len(one), len(two), len(two - one))
    assert K.overlap(*(K.np.zeros(0, int),) * 2) == (0, 0, 0)


def test_two_pairs_with_one_key_are_an_error(spark):
    for key in (3, None):
        pairs = spark.createDataFrame([("val", key, "A b.", "A."), ("val", key, "A b.", "A."), ("val", 4, "C", "D")], "split string, pair_id bigint, source string, target string")
        for joined in (True, False):
            for result in (CR.corpus_report, CR.corpus_novelty, CR.pair_table):
                try:
                    result(pairs, _words(spark, joined)).collect()
                except Exception as e:  # noqa: BLE001
                    assert "two rows share a key: split, pair_id" in str(e)
                else:
                    raise AssertionError(f"{result.__name__}, {key}, {joined}: no error")


def test_texts_without_whitespace_at_marks_need_no_collapse(spark):
    texts = _texts(3000)
    marked = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_replace("t", "\\.", R.SENT_MARK).alias("t"))
    messy = F.col("t").rlike(R.java_pattern(R.TO_COLLAPSE))
    rows = marked.select("t", messy.alias("messy"), T.apply_rule("t", R.COLLAPSE_RULE).alias("want")).collect()
    assert all(r.t == r.want for r in rows if not r.messy) and sum(bool(r.messy) for r in rows) > 100
    assert all(r.t != r.want for r in rows if r.messy and (R.SENT_MARK * 2 in r.t or R.SENT_MARK + " " in r.t or " " + R.SENT_MARK in r.t))


def test_marks_equal_the_rules_in_their_order(spark):
    rnd = random.Random(7)
    pieces = [".", "!", "?", "1", "23", "\u0663", "\"", "'", ")", "]", " ", " ", "\n", "\n\n", "\u2009", "a", "B", "ca", ",", "<ENUM5>", "<ENUM", "1.", "7. ", "8.. ", "9.! ", "3.) ", R.SENT_MARK, R.ABBR_MARK]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14))) for _ in range(6000)]
    rows = spark.createDataFrame([(("en", "de")[i % 2], t) for i, t in enumerate(texts)], "lang string, t string")

    def in_order(paragraphs=True):
        x = T.enum_mask(T.mask_abbreviations(T.escape_markers("t"), "lang"))
        x = T.replace_literal(x, *R.PARAGRAPH_RULE) if paragraphs else x
        x = F.btrim(T.apply_rules(x, [R.BOUNDARY_RULE, R.COLLAPSE_RULE]), F.lit(R.WS_CHARS + R.SENT_MARK))
        return T.replace_literal(T.enum_unmask(x), R.ABBR_MARK, ".")

    x = rows.select("t", T.mark_sentences("t", "lang").alias("got"), in_order().alias("want"),
                    T.mark_sentences("t", "lang", paragraphs=False).alias("got_2"), in_order(False).alias("want_2"))
    for r in x.collect():
        assert r.got == r.want and r.got_2 == r.want_2, r.t
    out = io.StringIO()
    with redirect_stdout(out):
        x.select("got").explain()
    assert "(?<![0-9]" in out.getvalue()
