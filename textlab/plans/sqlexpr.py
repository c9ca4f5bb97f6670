"""DuckDB SQL text for the oracle, built from the same rule tables as the
Spark expressions in :mod:`textlab.functions.text`.

Each function takes SQL expression text and returns SQL expression text.
"""

from __future__ import annotations

from ..functions import rules as R


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx(expr: str, rule: tuple[str, str]) -> str:
    pattern, repl = rule
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def rxs(expr: str, rules) -> str:
    for rule in rules:
        expr = rx(expr, rule)
    return expr


def rep(expr: str, a: str, b: str) -> str:
    return f"replace({expr}, {q(a)}, {q(b)})"


def strip(expr: str) -> str:
    return f"trim({expr}, {q(R.WS_CHARS)})"


def clean_token(e: str) -> str:
    return f"(CASE WHEN length({e}) <> 1 AND regexp_matches({e}, {q(R.SPECIAL_ONLY)}) THEN {q(R.SPECIAL_TOKEN)} ELSE {e} END)"


def clean_tokens(arr: str, var: str = "ct") -> str:
    return f"list_transform({arr}, lambda {var}: {clean_token(var)})"


def cleanup(expr: str) -> str:
    for a, b in R.CLEANUP_REPLACEMENTS:
        expr = rep(expr, a, b)
    return rx(expr, R.GERMAN_DECIMALS)


def escape_markers(expr: str) -> str:
    for a, b in R.ESCAPED:
        expr = rep(expr, a, b)
    return expr


def restore_markers(expr: str) -> str:
    for a, b in reversed(R.ESCAPED):
        expr = rep(expr, b, a)
    return expr


def restored(items: str, marked: str) -> str:
    return f"(CASE WHEN contains({marked}, {q(R.ESCAPE)}) THEN list_transform({items}, lambda rm: {restore_markers('rm')}) ELSE {items} END)"


def enum_mask(expr: str) -> str:
    return rx(expr, R.ENUM_MASK)


def enum_unmask(expr: str) -> str:
    return rx(expr, R.ENUM_UNMASK)


def mask_abbreviations(text: str, lang: str | None) -> str:
    if lang is None:
        return text
    whens = []
    for code, words in R.EXTRA_ABBREVIATIONS.items():
        whens.append(f"WHEN {lang} = {q(code)} THEN {rx(text, R.abbreviation_rule(list(words)))}")
    return "(CASE " + " ".join(whens) + f" ELSE {text} END)"


def mark_sentences(text: str, lang: str | None = None, enums: bool = True, paragraphs: bool = True, learned: str | None = None) -> str:
    t = mask_abbreviations(escape_markers(text), lang)
    if learned:
        t = f"(CASE WHEN {learned} IS NULL THEN {t} ELSE regexp_replace({t}, {learned}, {q(chr(92) + '1' + chr(92) + '2' + R.ABBR_MARK)}, 'g') END)"
    if enums:
        t = enum_mask(t)
    if paragraphs:
        t = rep(t, *R.PARAGRAPH_RULE)
    t = rx(t, R.BOUNDARY_RULE)
    t = rx(t, R.COLLAPSE_RULE)
    t = f"trim({t}, {q(R.WS_CHARS + R.SENT_MARK)})"
    if enums:
        t = enum_unmask(t)
    if lang is not None:
        t = rep(t, R.ABBR_MARK, ".")
    return t


def plain_marked(text: str) -> str:
    return mark_sentences(text, None, enums=False, paragraphs=False)


def split_nonempty(expr: str, pattern: str) -> str:
    return f"(CASE WHEN {expr} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({expr}, {q(pattern)}) END)"


def sentence_array(marked: str) -> str:
    return restored(split_nonempty(marked, R.SENT_MARK), marked)


def token_string(marked: str) -> str:
    t = rxs(marked, R.TOKEN_RULES)
    t = f"(' ' || {t} || ' ')"
    t = rxs(t, R.JOINED_WORD_RULES)
    return rxs(t, R.CONTRACTION_RULES)


def token_array(marked: str) -> str:
    trimmed = f"trim({token_string(marked)}, {q(R.WS_CHARS + R.SENT_MARK)})"
    return restored(split_nonempty(trimmed, R.SEP + "+"), marked)


def sentence_tokens(sentence: str) -> str:
    return token_array(escape_markers(sentence))


def rouge_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {q(R.ROUGE_TOKEN)})"


def tokens_13a(expr: str, lowercase: bool = False) -> str:
    t = f"lower({expr})" if lowercase else expr
    t = rep(t, "<skipped>", "")
    t = rep(t, "-\n", "")
    t = rep(t, "\n", " ")
    for a, b in R.HTML_ENTITIES:
        t = rep(t, a, b)
    t = f"(' ' || {t} || ' ')"
    t = rxs(t, R.TOKEN_13A_RULES)
    return split_nonempty(f"trim({t}, {q(R.WS_CHARS)})", R.WS + "+")


def ngrams(arr: str, n: int, var: str = "gi") -> str:
    if n == 1:
        return arr
    return (f"list_transform(range(1, len({arr}) - {n} + 2), "
            f"lambda {var}: array_to_string({arr}[{var}:{var} + {n - 1}], {q(R.GRAM_SEP)}))")


def novelty(a: str, b: str, n: int, clean: bool = True) -> str:
    if clean:
        a, b = clean_tokens(a, "ca"), clean_tokens(b, "cb")
    bg = f"list_distinct({ngrams(b, n, 'gb')})"
    ag = ngrams(a, n, "ga")
    total = f"len({bg})"
    novel = f"({total} - len(list_intersect({bg}, {ag})))"
    return f"(CASE WHEN {total} = 0 THEN 0.0 ELSE {novel}::DOUBLE / {total} END)"


def flesch(toks: str, n_sents: str, lang: str) -> str:
    words = f"list_filter({toks}, lambda fw: regexp_matches(fw, '\\p{{L}}'))"
    w = f"len({words})"
    vowels = "[" + R.VOWELS + "]"
    y = (f"(len(regexp_extract_all(lower(array_to_string({words}, ' ')), {q(vowels + '+')}))"
         f" + len(list_filter({words}, lambda fx: NOT regexp_matches(lower(fx), {q(vowels)}))))")

    def pick(i: int) -> str:
        cases = " ".join(f"WHEN {lang} = {q(c)} THEN {v[i]!r}::DOUBLE" for c, v in R.FLESCH_CONSTANTS.items() if c != "en")
        return f"(CASE {cases} ELSE {R.FLESCH_CONSTANTS['en'][i]!r}::DOUBLE END)"

    wps = f"({w}::DOUBLE / nullif({n_sents}, 0)::DOUBLE)"
    spw = f"({y}::DOUBLE / nullif({w}, 0)::DOUBLE)"
    return f"(CASE WHEN {w} > 0 THEN {pick(0)} - {pick(1)} * {wps} - {pick(2)} * {spw} END)"


def ratio(num: str, den: str) -> str:
    return f"({num})::DOUBLE / nullif(({den}), 0)::DOUBLE"


def r6(expr: str) -> str:
    return f"round({expr}, 6)"
