"""Fixed rule tables shared by the Spark expressions and the SQL oracle.

Every pattern here is written so that Java regex (Spark) and RE2 (DuckDB)
give the same matches: no look-around, no back-references, no ``\\s``/``\\w``
(their ASCII/Unicode meaning differs), no ``(?i)`` (RE2 folds Unicode case),
code points spelled ``\\x{..}``.  Replacements use ``\\1`` group syntax and
are converted to ``$1`` for Java by :func:`java_repl`.
"""

from __future__ import annotations

import re

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# Private-use code points used as in-text markers: the sentence marker
# separates sentences inside one document string, the abbreviation marker
# stands for a protected full stop.  Texts that hold one of them (or the
# escape character) are escaped on the way in and restored on the way out.
SENT_MARK = "\ue000"
ABBR_MARK = "\ue001"
ESCAPE = "\ue002"
ESCAPED = [(ESCAPE, ESCAPE + "\ue003"), (SENT_MARK, ESCAPE + "\ue004"), (ABBR_MARK, ESCAPE + "\ue005")]
GRAM_SEP = "\u0001"          # joins the tokens of one n-gram

# Python's str.isspace() set (what str.strip / str.split use).
WHITESPACE_CODEPOINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# Extra German abbreviations after which a full stop does not end a sentence.
EXTRA_ABBREVIATIONS = {
    "de": ["bspw", "ca", "sog", "ugs", "v.a", "s.o"],
}

# clean_token: ASCII punctuation and ASCII digits (string.punctuation + digits).
SPECIAL_TOKEN = "<SPECIAL>"

# Enumeration markers ("1." -> "<ENUM1>").
ENUM_MASK = (r"([0-9]+)\.", r"<ENUM\1>")
ENUM_UNMASK = (r"<ENUM([0-9]+)>", r"\1.")

# Post-generation clean-up: literal replacements in this order, then the
# German decimal rule.
CLEANUP_REPLACEMENTS = [
    (" - ", "-"),
    ("( ", "("),
    (" )", ")"),
    (" %", "%"),
    (" ;", ";"),
    (" :", ":"),
    (" / ", "/"),
    ("e. g.", "e.g."),
    ("i. e.", "i.e."),
]
GERMAN_DECIMALS = (r"([0-9]), ([0-9])", r"\1,\2")

# Flesch reading ease constants (base, words-per-sentence, syllables-per-word):
# English (Flesch 1948), German (Amstad 1978), French (Kandel & Moles 1958),
# Spanish (Fernandez Huerta 1959).  Other languages use English constants.
FLESCH_CONSTANTS = {
    "en": (206.835, 1.015, 84.6),
    "de": (180.0, 1.0, 58.5),
    "fr": (207.0, 1.015, 73.6),
    "es": (206.84, 1.02, 60.0),
}
# Vowel letters whose maximal runs count as syllables (after lower-casing).
VOWELS = "aeiouyäöüàâæçéèêëîïôœùûüáíóúñýÿ"

# The 19 evaluation metrics, in report order.
ALL_METRICS = [
    "R-1", "R-1_p", "R-1_r",
    "R-2", "R-2_p", "R-2_r",
    "R-L", "R-L_p", "R-L_r",
    "BLEU", "SARI",
    "|x|_w", "|x|_s",
    "|y|_w", "|y|_s",
    "CMP_w", "CMP_s",
    "Nov. (n=1)", "Nov. (n=2)",
]

# Corpus report rows, in order, with their display format (P7) and the
# statistic behind them.
CORPUS_REPORT_ROWS = [
    ("Docs", "int", "docs"),
    ("Tokens", "int", "tokens"),
    ("Sentences", "int", "sentences"),
    ("Types (raw)", "int", "types_raw"),
    ("Types (lemmas)", "int", "types_lemmas"),
    ("Avg. text length (words)", "int", "avg_words"),
    ("Avg. text length (sents)", "int", "avg_sents"),
    ("Avg. TTR", "float", "avg_ttr"),
    ("Avg. Flesch-Reading Ease", "float", "avg_fre"),
    ("Avg. word length", "float", "avg_word_len"),
    ("Avg. sent length", "int", "avg_sent_len"),
]

# ---------------------------------------------------------------------------
# Rules derived from the values above
# ---------------------------------------------------------------------------


def _cp(c: int) -> str:
    return "\\x{%x}" % c


WS_CLASS_BODY = "".join(_cp(c) for c in WHITESPACE_CODEPOINTS)
WS = "[" + WS_CLASS_BODY + "]"
WS_CHARS = "".join(chr(c) for c in WHITESPACE_CODEPOINTS)
NOT_WS = "[^" + WS_CLASS_BODY + "]"
# whitespace or sentence marker
SEP = "[" + WS_CLASS_BODY + _cp(ord(SENT_MARK)) + "]"

# ASCII punctuation + ASCII digits, as a class body (0x21-0x40, 0x5B-0x60, 0x7B-0x7E)
SPECIAL_CLASS_BODY = "!-@\\[-`{-~"
SPECIAL_CHARS = "".join(chr(c) for c in [*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
SPECIAL_ONLY = "^[" + SPECIAL_CLASS_BODY + "]*$"


def _case_insensitive(word: str) -> str:
    out = []
    for ch in word:
        if ch.isalpha() and ch.lower() != ch.upper():
            out.append("[" + ch.lower() + ch.upper() + "]")
        else:
            out.append(re.escape(ch))
    return "".join(out)


def abbreviation_rule(words: list[str]) -> tuple[str, str]:
    """Protect the full stop after each abbreviation (any letter case)."""
    alternation = "|".join(_case_insensitive(w) for w in sorted(words, key=len, reverse=True))
    return (r"(^|[^\p{L}])(" + alternation + r")\.", r"\1\2" + ABBR_MARK)


# Sentence boundary: terminal punctuation, optional closing quotes/brackets,
# then whitespace.
PARAGRAPH_RULE = ("\n\n", SENT_MARK)
BOUNDARY_RULE = ("([.!?]+[\"')\\]]*)" + WS + "+", "\\1" + SENT_MARK)
# Java only: the boundaries of a text whose enumerations are masked, in the text itself.  The full stop that a mask takes
# is the one behind a digit, and it can only be the first of its run.
ENUM_BOUNDARY_RULE = ("([.!?](?<![0-9]\\.)[.!?]*[\"')\\]]*)" + WS + "+", BOUNDARY_RULE[1])
# Collapse whitespace around (runs of) markers into one marker.
COLLAPSE_RULE = (WS + "*" + SENT_MARK + SEP + "*", SENT_MARK)
# Java only: whether the rule changes a text.  It looks at markers alone, the rule itself at each character.
TO_COLLAPSE = SENT_MARK + "(?:" + SEP + "|(?<=" + WS + SENT_MARK + "))"

# Word tokenisation (Treebank-like), applied to one sentence or to a document
# whose sentences are separated by SENT_MARK; "(MARK|$)" stands for the end of
# a sentence.  Applied in order.
END = "(" + SENT_MARK + "|$)"
TOKEN_RULES = [
    # straight double quotes become `` (opening) or '' (closing)
    ("(^|[" + WS_CLASS_BODY + _cp(ord(SENT_MARK)) + "(\\[{<])\"", r"\1 `` "),
    ('"', " '' "),
    # punctuation, brackets and other quotes become tokens of their own
    ("([;@#$%&?!*\\]\\[(){}<>«»‹›„“”‚‘’])", r" \1 "),
    (r"([:,])([^0-9])", r" \1 \2"),
    (r"([:,])" + END, r" \1 \2"),
    (r"(\.\.+)", r" \1 "),
    (r"(--)", r" \1 "),
    (r"([^.])(\.)([\])}>\"'»›“”’ ]*)" + WS + "*" + END, r"\1 \2 \3\4"),
]
# Applied after padding the text with one space on each side.
CONTRACTION_RULES = [
    (r"([^' ])('[sSmMdD]|')([ " + SENT_MARK + "])", r"\1 \2 \3"),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T)([ " + SENT_MARK + "])", r"\1 \2 \3"),
]

# Words that are split in two (fixed values), in any letter case.
JOINED_WORDS = [("can", "not"), ("gon", "na"), ("got", "ta"), ("wan", "na"), ("gim", "me"), ("lem", "me"), ("d", "'ye"), ("more", "'n"), ("'t", "is"), ("'t", "was")]
# the look-ahead only spares the alternatives at letters that begin no joined word
ANY_JOINED_WORD = "(?=[" + "".join(sorted({c for a, _ in JOINED_WORDS for c in (a[0].lower(), a[0].upper())})) + "])(?:" + "|".join(_case_insensitive(a + b) for a, b in JOINED_WORDS) + ")"


def _joined_word_rules() -> list[tuple[str, str]]:
    """Three words per rule (replacements have nine groups); each rule twice, because neighbours share a space."""
    rules = []
    for i in range(0, len(JOINED_WORDS), 3):
        part = JOINED_WORDS[i:i + 3]
        words = "|".join(f"({_case_insensitive(a)})({_case_insensitive(b)})" for a, b in part)
        first, second = ("".join(f"\\{2 + 2 * k + j}" for k in range(len(part))) for j in (0, 1))
        rules.append(("([ " + SENT_MARK + "])(?:" + words + ")([ " + SENT_MARK + "])", f"\\1{first} {second}\\{2 + 2 * len(part)}"))
    return rules * 2


JOINED_WORD_RULES = _joined_word_rules()

# 13a tokenisation (BLEU / SARI), after newline handling and entity unescape.
TOKEN_13A_RULES = [
    (r"([{-~\[-` -&(-+:-@/])", r" \1 "),
    (r"([^0-9])([.,])", r"\1 \2 "),
    (r"([.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]
HTML_ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]

# ROUGE tokens: lower-case ASCII letters and digits.
ROUGE_TOKEN = "[a-z0-9]+"

# Title pattern for section segmentation on the driver's documents: a short
# line without full stops ending in "." or ":" on a line of its own.
DEFAULT_TITLE_PATTERN = "(?:^|\n)([^\n.]{1,80}[.:])\n"
UNNAMED_TITLE = "[UNNAMED]"


# The same whitespace as ranges: Java tests one range after the other, so fewer are faster.
WS_RANGES = "\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def java_pattern(pattern: str) -> str:
    """``pattern`` with the whitespace set written as ranges (same matches)."""
    return pattern.replace(WS_CLASS_BODY, WS_RANGES)


def java_repl(repl: str) -> str:
    """``\\1`` group references -> Java's ``$1``; escape literal ``$``."""
    out = repl.replace("$", "\\$")
    return re.sub(r"\\([0-9])", r"$\1", out)
