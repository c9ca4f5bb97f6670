"""Column -> Column text functions (all JVM-side Spark SQL expressions).

The same rule tables (:mod:`textlab.functions.rules`) drive the SQL oracle in
:mod:`textlab.plans.oracle`, so both engines compute identical values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def apply_rule(col: ColumnOrName, rule: tuple[str, str]) -> Column:
    pattern, repl = rule
    return F.regexp_replace(_c(col), R.java_pattern(pattern), R.java_repl(repl))


def apply_rules(col: ColumnOrName, rules: Sequence[tuple[str, str]]) -> Column:
    out = _c(col)
    for rule in rules:
        out = apply_rule(out, rule)
    return out


def replace_literal(col: ColumnOrName, search: str, repl: str) -> Column:
    return F.replace(_c(col), F.lit(search), F.lit(repl))


def _holds_marker(col: Column) -> Column:
    return F.contains(col, F.lit(R.SENT_MARK)) | F.contains(col, F.lit(R.ABBR_MARK)) | F.contains(col, F.lit(R.ESCAPE))


def escape_markers(col: ColumnOrName) -> Column:
    """Marker characters of the text itself -> escape sequences (only where there are any)."""
    t = out = _c(col)
    for a, b in R.ESCAPED:
        out = replace_literal(out, a, b)
    return F.when(_holds_marker(t), out).otherwise(t)


def restore_markers(col: ColumnOrName) -> Column:
    out = _c(col)
    for a, b in reversed(R.ESCAPED):
        out = replace_literal(out, b, a)
    return out


def let(value: ColumnOrName, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(_c(value)), use), F.lit(0))


def _restored(items: Column, marked: Column) -> Column:
    return F.when(F.contains(marked, F.lit(R.ESCAPE)), F.transform(items, restore_markers)).otherwise(items)


# --------------------------------------------------------------------------
# Scalar clean-up
# --------------------------------------------------------------------------


def strip(col: ColumnOrName) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.btrim(_c(col), F.lit(R.WS_CHARS))


def clean_token(col: ColumnOrName) -> Column:
    """Tokens of 0 or 2+ chars made only of ASCII punctuation/digits -> <SPECIAL>.

    Trimming these characters leaves nothing exactly when there are no others.
    """
    t = _c(col)
    return F.when((F.btrim(t, F.lit(R.SPECIAL_CHARS)) == "") & (F.length(t) != 1), F.lit(R.SPECIAL_TOKEN)).otherwise(t)


def cleanup_punctuation(col: ColumnOrName) -> Column:
    """Nine literal replacements in fixed order."""
    out = _c(col)
    for a, b in R.CLEANUP_REPLACEMENTS:
        out = replace_literal(out, a, b)
    return out


def german_decimals(col: ColumnOrName) -> Column:
    """N3: "4, 5" -> "4,5" (non-overlapping)."""
    return apply_rule(col, R.GERMAN_DECIMALS)


def tokenization_cleanup(col: ColumnOrName) -> Column:
    """N4 then N3."""
    return german_decimals(cleanup_punctuation(col))


def run_name(path: ColumnOrName) -> Column:
    """Name of the parent directory of a file path."""
    return F.element_at(F.split(_c(path), "/"), -2)


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """y/x as double; NULL when x is 0 or NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


# --------------------------------------------------------------------------
# segmentation
# --------------------------------------------------------------------------


def enum_mask(col: ColumnOrName) -> Column:
    """Every ``<digits>.`` -> ``<ENUM<digits>>``."""
    return apply_rule(col, R.ENUM_MASK)


def enum_unmask(col: ColumnOrName) -> Column:
    """``<ENUM<digits>>`` -> ``<digits>.``."""
    return apply_rule(col, R.ENUM_UNMASK)


def mask_abbreviations(
    text: ColumnOrName,
    lang: ColumnOrName | None,
    abbreviations: Mapping[str, Sequence[str]] | None = None,
) -> Column:
    """T5: protect the full stop after per-language abbreviations."""
    abbreviations = R.EXTRA_ABBREVIATIONS if abbreviations is None else abbreviations
    t = _c(text)
    if lang is None or not abbreviations:
        return t
    out = None
    for code, words in abbreviations.items():
        if not words:
            continue
        masked = apply_rule(t, R.abbreviation_rule(list(words)))
        out = F.when(_c(lang) == code, masked) if out is None else out.when(_c(lang) == code, masked)
    return t if out is None else out.otherwise(t)


def mark_sentences(
    text: ColumnOrName,
    lang: ColumnOrName | None = None,
    *,
    enums: bool = True,
    paragraphs: bool = True,
    abbreviations: Mapping[str, Sequence[str]] | None = None,
    learned: Column | None = None,
) -> Column:
    """The document with sentences separated by ``SENT_MARK``.

    Mask abbreviations and enumerations, mark paragraph breaks and sentence
    ends, collapse whitespace around markers, trim, unmask.  The result has
    no empty sentence unless the whole text is blank.  Marker characters of
    the text stay escaped until :func:`sentence_array` or :func:`token_array`.
    ``learned``: a regular expression per row (or NULL) whose two groups are what precedes an
    abbreviation and the abbreviation itself; needs ``lang``.
    """
    t = escape_markers(text)
    t = mask_abbreviations(t, lang, abbreviations) if lang is not None else t
    if learned is not None:
        t = F.coalesce(F.regexp_replace(t, learned, F.lit("$1$2" + R.ABBR_MARK)), t)

    def marked(x: Column, boundary: tuple[str, str]) -> Column:
        if paragraphs:
            x = replace_literal(x, *R.PARAGRAPH_RULE)
        x = apply_rule(x, boundary)
        x = let(x, lambda y: F.when(y.rlike(R.java_pattern(R.TO_COLLAPSE)), apply_rule(y, R.COLLAPSE_RULE)).otherwise(y))
        return F.btrim(x, F.lit(R.WS_CHARS + R.SENT_MARK))

    if enums:  # masks are written and read only where a text holds one of its own, which is unmasked too
        def masked(x: Column) -> Column:
            return enum_unmask(marked(enum_mask(x), R.BOUNDARY_RULE))

        t = let(t, lambda x: F.when(F.contains(x, F.lit("<ENUM")), masked(x)).otherwise(marked(x, R.ENUM_BOUNDARY_RULE)))
    else:
        t = marked(t, R.BOUNDARY_RULE)
    if lang is not None:
        t = replace_literal(t, R.ABBR_MARK, ".")
    return t


def plain_marked_sentences(text: ColumnOrName) -> Column:
    """Default-language split without enumeration/paragraph rules."""
    return mark_sentences(text, None, enums=False, paragraphs=False)


def split_nonempty(col: ColumnOrName, pattern: str) -> Column:
    """``split`` that maps a blank string to an empty array.

    Inputs are trimmed and separators collapsed, so the only empty piece is
    the one of a blank string; ``array_remove`` drops it without evaluating
    the (expensive) input twice, as a CASE would.
    """
    return F.array_remove(F.split(_c(col), R.java_pattern(pattern)), "")


def explode_rows(df, arr: ColumnOrName, value: str, pos: str | None = None, keep: tuple = ()):
    """Explode an array into rows (with its 0-based position when ``pos``).

    ``explode_outer`` + a null filter instead of ``explode``: the optimizer
    infers ``size(arr) > 0`` for a plain explode and pushes that filter, with
    the whole expression that builds ``arr``, below the exchange.
    """
    keep = list(keep)
    if pos is None:
        out = df.select(*keep, F.explode_outer(_c(arr)).alias(value))
    else:
        out = df.select(*keep, F.posexplode_outer(_c(arr)).alias(pos, value))
    return out.where(F.col(value).isNotNull())


def sentence_array(marked: ColumnOrName) -> Column:
    """Sentences of a marked document (already trimmed, none empty)."""
    return let(marked, lambda m: _restored(split_nonempty(m, R.SENT_MARK), m))


def token_string(marked: ColumnOrName) -> Column:
    """Apply the tokenisation rules to an escaped sentence or a marked document."""
    # most texts hold no straight double quote or no apostrophe: they skip the rules that need one
    quoted = apply_rules(marked, R.TOKEN_RULES[:2])
    t = apply_rules(F.when(F.contains(_c(marked), F.lit('"')), quoted).otherwise(_c(marked)), R.TOKEN_RULES[2:])
    t = F.concat(F.lit(" "), t, F.lit(" "))
    # few texts hold a joined word: the others skip these rules
    joined = _c(marked).rlike(R.ANY_JOINED_WORD)
    t = F.when(joined, apply_rules(t, R.JOINED_WORD_RULES)).otherwise(t)
    return let(t, lambda x: F.when(F.contains(x, F.lit("'")), apply_rules(x, R.CONTRACTION_RULES)).otherwise(x))


def token_array(marked: ColumnOrName) -> Column:
    """Word tokens of a whole marked document (as :func:`mark_sentences` returns it)."""
    def tokens(m: Column) -> Column:
        trimmed = F.btrim(token_string(m), F.lit(R.WS_CHARS + R.SENT_MARK))
        return _restored(split_nonempty(trimmed, R.SEP + "+"), m)

    return let(marked, tokens)


def sentence_tokens(sentence: ColumnOrName) -> Column:
    """Word tokens of one plain sentence."""
    return token_array(escape_markers(sentence))


def nested_tokens(marked: ColumnOrName) -> Column:
    """The tokens of each sentence of a marked document; the rules run once over the document."""
    def nested(m: Column) -> Column:
        trimmed = F.btrim(token_string(m), F.lit(R.WS_CHARS + R.SENT_MARK))
        parts = F.transform(split_nonempty(trimmed, R.SENT_MARK),
                            lambda s: split_nonempty(F.btrim(s, F.lit(R.WS_CHARS)), R.WS + "+"))
        return F.when(F.contains(m, F.lit(R.ESCAPE)), F.transform(parts, lambda p: F.transform(p, restore_markers))).otherwise(parts)

    return let(marked, nested)


def running_starts(sizes: ColumnOrName) -> Column:
    """For an array of sizes the array of start offsets (0, s0, s0 + s1, ...), one more than sizes."""
    zero = F.array(F.lit(0))
    return F.aggregate(_c(sizes), zero, lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))


def round_exact(col: ColumnOrName, digits: int) -> Column:
    """Round a double as Python does: half to even, on its exact binary value
    (2.675 is below the tie and gives 2.67).  NULL stays NULL.

    The fraction is cut into two 30-bit integers, so all digits that decide are
    exact integers.
    """
    def rounded(x: Column) -> Column:
        whole = F.floor(F.abs(x))
        high = (F.abs(x) - whole) * float(1 << 30)
        low = (high - F.floor(high)) * float(1 << 30)
        unit = F.lit(1 << 60).cast("decimal(20,0)")
        parts = (F.floor(high).cast("decimal(20,0)") * F.lit(1 << 30).cast("decimal(11,0)") + F.floor(low).cast("decimal(20,0)")).cast("decimal(20,0)")

        def place(n: Column) -> Column:
            q = F.floor(n / unit).cast("decimal(20,0)")
            # decimal division rounds: correct the quotient by its exact remainder
            q = F.when(q * unit > n, q - 1).otherwise(q).cast("decimal(20,0)")
            twice = (n - q * unit) * 2
            odd = F.pmod(q + (whole.cast("decimal(20,0)") if digits == 0 else F.lit(0)), F.lit(2)) == 1
            up = (twice > unit) | ((twice == unit) & odd)
            return (whole.cast("double") * float(10 ** digits) + q.cast("double") + F.when(up, 1.0).otherwise(0.0)) / float(10 ** digits) * F.signum(x)

        return let((parts * F.lit(10 ** digits).cast("decimal(6,0)")).cast("decimal(30,0)"), place)

    return F.when(_c(col).isNotNull(), let(_c(col).cast("double"), rounded))


def rouge_tokens(col: ColumnOrName) -> Column:
    """ROUGE tokens: lower-case ``[a-z0-9]+`` runs (no stemming)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(R.ROUGE_TOKEN), 0)


def tokens_13a(col: ColumnOrName, lowercase: bool = False) -> Column:
    """13a tokens used by BLEU (cased) and SARI (lower-cased)."""
    t = _c(col)
    if lowercase:
        t = F.lower(t)
    t = replace_literal(t, "<skipped>", "")
    t = replace_literal(t, "-\n", "")
    t = replace_literal(t, "\n", " ")
    for a, b in R.HTML_ENTITIES:
        t = replace_literal(t, a, b)
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = apply_rules(t, R.TOKEN_13A_RULES)
    return split_nonempty(F.btrim(t, F.lit(R.WS_CHARS)), R.WS + "+")


# --------------------------------------------------------------------------
# N-grams and novelty
# --------------------------------------------------------------------------


def ngrams(tokens: ColumnOrName, n: int) -> Column:
    """N-grams of a token array, tokens joined by ``GRAM_SEP``.

    Built from ``arrays_zip`` of the array and its shifted slices, so the
    lambda only touches one zipped element: linear in the array length (a
    lambda that slices the array itself re-evaluates it per position).
    """
    t = _c(tokens)
    if n == 1:
        return t
    size = F.size(t)
    shifted = [t] + [F.slice(t, k + 1, F.greatest(size, F.lit(1))) for k in range(1, n)]
    fields = ", ".join(f"g{k}: string" for k in range(n))
    zipped = F.arrays_zip(*shifted).cast(f"array<struct<{fields}>>")
    grams = F.transform(zipped, lambda s: F.concat_ws(R.GRAM_SEP, *[s[f"g{k}"] for k in range(n)]))
    return F.slice(grams, 1, F.greatest(size - n + 1, F.lit(0)))


def clean_tokens(tokens: ColumnOrName) -> Column:
    return F.transform(_c(tokens), clean_token)


def novelty(a: ColumnOrName, b: ColumnOrName, n: int, clean: bool = True) -> Column:
    """Share of distinct n-grams of b that do not occur in a; 0 if none.

    For several n on the same arrays use :func:`textlab.operators.stats.with_novelty`,
    which cleans each array once.
    """
    a_t, b_t = _c(a), _c(b)
    if clean:
        a_t, b_t = clean_tokens(a_t), clean_tokens(b_t)
    b_grams = F.array_distinct(ngrams(b_t, n))
    novel = F.size(F.array_except(b_grams, ngrams(a_t, n)))
    total = F.size(b_grams)
    return F.when(total == 0, F.lit(0.0)).otherwise(novel / total)


# --------------------------------------------------------------------------
# readability
# --------------------------------------------------------------------------


def flesch(tokens: ColumnOrName, n_sents: ColumnOrName, lang: ColumnOrName) -> Column:
    """Flesch reading ease from tokens; words are tokens with a letter.

    Syllables of a word = number of vowel runs, at least one.  Counted with
    three regex scans over the space-joined tokens (tokens hold no spaces)
    instead of per-token filters.
    """
    t = _c(tokens)
    vowels = "[" + R.VOWELS + "]"
    one = F.array_join(t, " ")
    two = F.concat(F.lit("  "), F.array_join(t, "  "), F.lit("  "))   # every token in its own spaces
    # the matches are only counted: the empty group spares their texts
    w = F.size(F.regexp_extract_all(one, F.lit(r"\p{L}[^ ]*+()"), 1))
    vowel_runs = F.size(F.regexp_extract_all(F.lower(one), F.lit(vowels + "++()"), 1))
    consonant = r"[^\P{L} " + R.VOWELS + "]"                          # a letter that is not a vowel
    no_vowel = F.size(F.regexp_extract_all(
        F.lower(two), F.lit(r" [^\p{L} ]*+" + consonant + "[^ " + R.VOWELS + "]*+ ()"), 1))
    return flesch_score(w, vowel_runs + no_vowel, n_sents, lang)


def flesch_score(words: ColumnOrName, syllables: ColumnOrName, n_sents: ColumnOrName, lang: ColumnOrName) -> Column:
    """A7 from the counts; NULL without words."""
    w, y = _c(words), _c(syllables)
    en = R.FLESCH_CONSTANTS["en"]
    base, a, b = (F.lit(en[0]), F.lit(en[1]), F.lit(en[2]))
    lang_c = _c(lang)
    for code, (cb, ca, cy) in R.FLESCH_CONSTANTS.items():
        if code == "en":
            continue
        base = F.when(lang_c == code, F.lit(cb)).otherwise(base)
        a = F.when(lang_c == code, F.lit(ca)).otherwise(a)
        b = F.when(lang_c == code, F.lit(cy)).otherwise(b)
    wps = F.try_divide(w.cast("double"), _c(n_sents).cast("double"))
    spw = F.try_divide(y.cast("double"), w.cast("double"))
    return F.when(w > 0, base - a * wps - b * spw)
