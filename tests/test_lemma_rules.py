"""Suffix rules for words outside the dictionary, against a plain version, held-out entries and edge cases."""

from collections import Counter, defaultdict

from textlab.operators import lemma_rules as LR
from textlab.operators import segment as S

STEMS = ["walk", "jump", "talk", "paint", "climb", "count", "print", "match", "clean", "start", "need", "hunt", "load", "fold", "boil", "sort"]
ENTRIES = [("en", s + e, s) for s in STEMS for e in ("ed", "ing", "s", "")] + [("en", s + "ies", s + "y") for s in ("cit", "bab", "part", "stor", "bod", "cop")]
ENTRIES += [("en", "was", "be"), ("en", ".", "--"), ("en", "x1", "x"), ("en", "", "a"), ("en", "ab", ""), ("en", None, "a"), ("en", "a", None), (None, "walked", "walk")]


def plain_rules(entries, support):
    votes = defaultdict(Counter)
    for lang, token, lemma in set(entries):
        if not (lang and token and lemma and lemma != "--" and token.isalpha()):
            continue
        common = 0
        while common < min(len(token), len(lemma)) and token[common] == lemma[common]:
            common += 1
        edit = len(token) - common
        for cut in range(max(1, edit), min(len(token) - 1, LR.LONGEST, edit + LR.CONTEXT) + 1) if common else ():
            votes[lang, token[-cut:]][lemma[len(token) - cut:]] += 1
    best = {k: max((n, r) for r, n in c.items()) for k, c in votes.items()}
    return {k: r for k, (n, r) in best.items() if n >= support and 2 * n > sum(votes[k].values())}


def plain_guess(rules, lang, token):
    for cut in range(min(LR.LONGEST, len(token) - LR.STEM), 0, -1):
        if (lang, token[-cut:]) in rules:
            return token[:-cut] + rules[lang, token[-cut:]]
    return None


def frame(spark, entries):
    return spark.createDataFrame(entries, "lang string, token string, lemma string")


def test_rules_and_guesses(spark):
    for support in (1, 2, 4):
        rules = LR.learn(frame(spark, ENTRIES + ENTRIES[:5]), support)
        want = plain_rules(ENTRIES, support)
        assert {(r.lang, r.suffix): r.replacement for r in rules.collect()} == want
        words = ["planted", "planting", "plants", "ladies", "ed", "s", "sings", "Übungs", "q7ed", "", None, "tables" * 40]
        got = {r.token: r.lemma for r in LR.guess(frame(spark, [("en", w, None) for w in words]), rules).collect()}
        assert got == {w: g for w in words if w and w.isalpha() and (g := plain_guess(want, "en", w)) is not None}


def test_held_out_entries(spark):
    """Rules of three quarters of the stems give the lemmas of the others."""
    train = [e for e in ENTRIES if e[2] not in STEMS[::4]]
    held = [e for e in ENTRIES if e[2] in STEMS[::4] and e[0]]
    got = {r.token: r.lemma for r in LR.extended(frame(spark, held), frame(spark, train)).where("lang = 'en'").collect()}
    assert sum(got.get(t, t) == lemma for _, t, lemma in held) >= 0.9 * len(held)


def test_extended_dictionary(spark):
    docs = spark.createDataFrame([(1, "en", "She painted walls. He planted trees."), (2, "xx", "Planted."), (3, "en", None), (4, "en", "")], "doc_id long, lang string, text string")
    entries = frame(spark, ENTRIES)
    types = S.tokens(docs, keep=("doc_id", "lang"))
    got = {(r.doc_id, r.token): r.lemma for r in S.lemmas(docs, LR.extended(types, entries)).collect()}
    assert got[1, "planted"] == "plant" and got[1, "painted"] == "paint" and got[2, "Planted"] == "Planted"
    assert LR.learn(entries.limit(0)).count() == 0 and LR.extended(types, entries.limit(0)).count() == 0
