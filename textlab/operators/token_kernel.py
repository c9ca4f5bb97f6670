"""T6, A3-A7 and A12 by Arrow kernels: the rules run only on words that hold a character which a rule names.

The token rules (:data:`textlab.functions.rules.TOKEN_RULES` and what follows them) look at most one character beyond
a stretch without whitespace, except at the end of a sentence, where closing quotes and brackets may follow the full
stop.  So the last words of a sentence, back to the first that is not made of closing characters alone, go through the
rules together, and every other word alone between spaces; a sentence without such characters is split at its spaces.
The results equal those of :func:`textlab.functions.text.token_array`.  Tables of words are bounded; when full they
keep what came first, results do not change.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules as R

TOGETHER = 256        # rows of one Arrow array that a kernel returns
TABLE_LIMIT = 200_000  # words of a table
LONGEST = 64           # letters of a word that is kept
CLOSING = "])}>\"'»›“”’ "
NAMED = ";@#$%&?!*][(){}<>«»‹›„“”‚‘’\"':."   # what the rules name, but for ``,`` and ``--``
KINDS = bytes(ord("a" if chr(c) in R.VOWELS else " " if c == 32 else "b") for c in range(256))
JOINED = {(a + b).lower() for a, b in R.JOINED_WORDS}


def _compiled(pattern: str) -> re.Pattern:
    """A rule of the tables for Python: code points spelled out, ``$`` only at the very end."""
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern).replace("|$)", r"|\Z)"))


class Table(dict):
    """``make(key)`` of the keys asked for so far."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        value = self.make(key)
        if len(self) < TABLE_LIMIT and len(key) <= LONGEST:
            self[key] = value
        return value


class Words:
    """Tokens of marked documents, and what is known of a token."""

    def __init__(self):
        self.rules = [(_compiled(p), r) for p, r in R.TOKEN_RULES]
        self.joined = [(_compiled(p), r) for p, r in R.JOINED_WORD_RULES]
        self.contractions = [(_compiled(p), r) for p, r in R.CONTRACTION_RULES]
        self.sep, self.word = _compiled(R.SEP + "+"), _compiled(R.NOT_WS + "+")
        self.other_ws = re.compile("[" + re.escape(R.WS_CHARS.replace(" ", "")) + "]")
        self.any_joined = _compiled(R.ANY_JOINED_WORD)
        self.plain = re.compile("[^" + re.escape(NAMED + R.WS_CHARS.replace(" ", "")) + "]*")
        self.plain_word = re.compile("[^" + re.escape(NAMED + R.WS_CHARS + ",-") + "]+")
        self.inner = Table(self.word_between_spaces)
        self.last = Table(self.last_words)

    def split(self, text: str) -> tuple[str, ...]:
        """The rules in their order, as in ``token_string``."""
        joined = self.any_joined.search(text)
        for p, r in self.rules:
            text = p.sub(r, text)
        text = " " + text + " "
        for p, r in (self.joined if joined else []) + self.contractions:
            text = p.sub(r, text)
        return tuple(t for t in self.sep.split(text) if t)

    def takes_mark(self, sentence: str) -> bool:
        """Whether the rule for the last full stop matches, up to the mark behind the sentence."""
        for p, r in self.rules[:-1]:
            sentence = p.sub(r, sentence)
        return bool(self.rules[-1][0].search(sentence))

    def between(self, text: str) -> tuple[str, ...]:
        """Tokens of a word with the characters around it; the sentence goes on."""
        return self.split(text + "x")[:-1]

    def word_between_spaces(self, w: str) -> tuple[str, ...]:
        stem = w[:-1] if w[-1:] in (",", ";", ":", "!", "?") else w
        if self.plain_word.fullmatch(stem) and stem.lower() not in JOINED:
            return (w,) if stem is w else (stem, w[-1])
        return self.between(" " + w + " ")

    def last_words(self, text: str) -> tuple[str, ...]:
        stem = text[1:-1] if text[0] == " " else ""
        if text[-1] in ".!?" and self.plain_word.fullmatch(stem) and stem.lower() not in JOINED:
            return stem, text[-1]
        return self.split(text)

    def sentence(self, s: str, before: str, joined: bool) -> list[str]:
        """``before``: empty at the beginning of the text; ``joined``: there may be a joined word."""
        body, end = (s[:-1], [s[-1]]) if s[-1] in ".!?" else (s, [])
        if not joined and self.plain.fullmatch(body) and "--" not in body:
            commas = body.count(",")
            if not commas:
                return [t for t in body.split(" ") if t] + end
            if commas == body.count(", "):
                return [t for t in body.replace(",", " , ").split(" ") if t] + end
        if self.other_ws.search(s):
            found = [(m.start(), m.end()) for m in self.word.finditer(s)]
            k = len(found) - 1
            while k > 0 and not s[found[k][0]:found[k][1]].strip(CLOSING):
                k -= 1
            if k < 0:
                return []
            out = list(chain.from_iterable(self.between((s[a - 1] if a else " ") + s[a:b + 1]) for a, b in found[:k]))
            at = found[k][0]
            return out + list(self.split((s[at - 1] if at else before) + s[at:].rstrip(R.WS_CHARS)))
        words = s.split(" ")
        k = len(words) - 1
        while k > 0 and not words[k].strip(CLOSING):
            k -= 1
        out = list(chain.from_iterable(map(self.inner.__getitem__, words[:k])))
        out += self.last[(" " if k else before) + " ".join(words[k:])]
        return out

    def sentences(self, marked: str, alone: bool = False) -> list[list[str]]:
        """``alone``: each sentence is a text of its own."""
        joined = holds_joined(marked)
        parts = [s for s in marked.split(R.SENT_MARK) if s]
        out, before, last = [], "", ""
        for i, s in enumerate(parts):
            if i and not alone:  # the mark precedes the sentence, unless the last full stop took it
                before = "" if s[0] == "." and self.takes_mark(before + last) else " "
            out.append(self.sentence(s, before, joined))
            last = s
        return [[restored(t) for t in s] for s in out] if R.ESCAPE in marked else out

    def syllables_each(self, tokens: list[str]) -> list[tuple[int, int]]:
        """The same for each token."""
        lower = " ".join(tokens).lower()
        codes = lower.replace("œ", "o").encode("latin-1", "replace").translate(KINDS).split(b" ")
        runs = [c.startswith(b"a") + c.count(b"ba") for c in codes]
        return [(1, r) if r else (1, 1) if any(map(str.isalpha, t)) else (0, 0) for t, r in zip(lower.split(" "), runs)]

    def syllables(self, line: str) -> tuple[int, int]:
        """Of tokens joined by spaces: how many have a letter, and the vowel runs of these, at least one each."""
        lower = line.lower()
        # a byte per character: all vowels but one are in Latin-1, what is outside of it is no vowel
        kinds = lower.replace("œ", "o").encode("latin-1", "replace").translate(KINDS)
        tokens, codes = lower.split(" "), kinds.split(b" ")
        silent = [t for t, c in zip(tokens, codes) if b"a" not in c]
        mute = sum(any(map(str.isalpha, t)) for t in silent)
        return len(tokens) - len(silent) + mute, kinds.startswith(b"a") + kinds.count(b"ba") + kinds.count(b" a") + mute


@cache
def worker_words() -> Words:
    """One for all tasks of a Python worker."""
    return Words()


def holds_joined(text: str) -> bool:
    lower = text.lower()
    return any(w in lower for w in JOINED)


def restored(token: str) -> str:
    for a, b in reversed(R.ESCAPED):
        token = token.replace(b, a)
    return token


def clean(token: str) -> str:
    """N2, as :func:`textlab.functions.text.clean_token`."""
    return R.SPECIAL_TOKEN if len(token) != 1 and not token.strip(R.SPECIAL_CHARS) else token


def novelty(a: list[str], b: list[str], n: int) -> float:
    """A12, as :func:`textlab.functions.text.novelty` on cleaned arrays."""
    def grams(t):
        return set(t) if n == 1 else set(map(R.GRAM_SEP.join, zip(*[t[k:] for k in range(n)])))

    mine = grams(b)
    return len(mine - grams(a)) / len(mine) if mine else 0.0


def _per_row(kind: str, prepare: Callable[[], Callable]):
    """An Arrow UDF of one column; the function that ``prepare`` gives sees each value that is not null."""
    @F.arrow_udf(kind)
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        row, out = prepare(), None
        for batch in batches:
            out = out or pa.array([], _arrow(kind)).type
            for low in range(0, len(batch), TOGETHER):
                yield pa.array([None if x is None else row(x) for x in batch.slice(low, TOGETHER).to_pylist()], out)

    return kernel


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}


def _arrow(kind: str) -> pa.DataType:
    if not kind.startswith("struct<"):
        return _ARROW[kind]
    return pa.struct([(name, _ARROW[t]) for name, t in (f.split(":") for f in kind[7:-1].split(","))])


def measured(marked: str, distinct: bool = False) -> Column:
    """Of a marked document: n_sents, n_tokens, sum_token_len, words, syllables and the tokens (``distinct``: each once) ``toks``."""
    def prepare():
        w = worker_words()

        def row(text):
            sents = w.sentences(text)
            toks = list(chain.from_iterable(sents))
            line = " ".join(toks)
            words, syllables = w.syllables(line)
            return {"n_sents": len(sents), "n_tokens": len(toks), "sum_token_len": len(line) - max(len(toks) - 1, 0), "words": words, "syllables": syllables,
                    "toks": list(dict.fromkeys(toks)) if distinct else toks}

        return row

    return _per_row("struct<n_sents:bigint,n_tokens:bigint,sum_token_len:bigint,words:bigint,syllables:bigint,toks:array<string>>", prepare)(marked)


def sentence_tokens(marked: str) -> Column:
    """The tokens of each sentence of a marked document, each sentence as a text of its own."""
    return _per_row("array<array<string>>", lambda: lambda text: worker_words().sentences(text, alone=True))(marked)


class Tokens(dict):
    """Numbers of the tokens of a language; what is new is appended to ``met``, a list of (token, cleaned lemma)."""

    def __init__(self, entries: dict[str, str], met: list[tuple[str, str]]):
        super().__init__()
        self.entries, self.met = entries, met

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self.met)
        self.met.append((token, clean(self.entries.get(token, token))))
        return n


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How many elements ``a`` has, ``b`` has, and only ``b`` has, each counted once; elements are below 2 ** 62."""
    both = np.sort(np.concatenate([a * 2, b * 2 + 1]))
    if not len(both):
        return 0, 0, 0
    of_b = (both & 1).astype(bool)
    other = both[1:] >> 1 != both[:-1] >> 1
    first, last = np.append(True, other), np.append(other, True)  # of equal elements those of a come first
    new = int(np.count_nonzero(first & of_b))
    return int(np.count_nonzero(first)) - new, int(np.count_nonzero(last & of_b)), new


def number_grams(a: np.ndarray, b: np.ndarray, base: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words, the bigrams and the trigrams of two texts of numbers below ``base``, as numbers."""
    yield a, b
    a2, b2 = (x[:-1] * base + x[1:] for x in (a, b))
    yield a2, b2
    if base >= 1 << 20:  # three of them are too large
        a2, b2 = np.split(np.unique(np.concatenate([a2, b2]), return_inverse=True)[1], [len(a2)])
    yield tuple(x2[:-1] * base + x[2:] for x2, x in ((a2, a), (b2, b)))


class Pairs:
    """A3-A7 and A12 of pairs of marked texts, with the lemmas of a table {lang: {token: lemma}}.

    What follows from a token alone is kept by its number.  Between pairs a full table is emptied.  ``once``: types
    come only with tokens that the table does not know from that side; after it was emptied they come again.
    """

    def __init__(self, table: dict[str, dict[str, str]], once: bool):
        self.table, self.once, self.words = table, once, worker_words()
        self.joined = any(R.GRAM_SEP in lemma for entries in table.values() for lemma in entries.values())
        self.empty()

    def empty(self) -> None:
        self.tokens, self.met, self.lemmas = {}, [], {}   # by language; (token, lemma) by number; numbers of lemmas
        self.known = 0                                    # tokens whose facts are known
        self.facts = np.zeros((1 << 12, 4), np.int32)     # by number: lemma, whether it is a word, syllables, length
        self.given = np.zeros(1 << 12, np.uint8)          # by number: 1 source, 2 target

    def learn(self) -> None:
        """The facts of the tokens that are new."""
        n = len(self.met)
        if n > len(self.given):
            more = max(n, 2 * len(self.given)) - len(self.given)
            self.facts, self.given = np.pad(self.facts, ((0, more), (0, 0))), np.pad(self.given, (0, more))
        new = self.met[self.known:]
        counts = self.words.syllables_each([token for token, _ in new])
        self.facts[self.known:n] = [(self.lemmas.setdefault(lemma, len(self.lemmas)), words, syllables, len(token))
                                    for (token, lemma), (words, syllables) in zip(new, counts)]
        self.known = n

    def measure(self, lang: str | None, text: str | None) -> tuple[np.ndarray | None, np.ndarray | None, tuple]:
        """The numbers of the tokens, those of their lemmas, and the MEASURES."""
        if text is None:
            return None, None, (None,) * 5
        lang = lang if lang in self.table else None
        if lang not in self.tokens:
            self.tokens[lang] = Tokens(self.table.get(lang, {}), self.met)
        sents = self.words.sentences(text)
        toks = np.fromiter(map(self.tokens[lang].__getitem__, chain.from_iterable(sents)), np.int64)
        if len(self.met) > self.known:
            self.learn()
        facts = np.take(self.facts, toks, axis=0).T.copy()
        words, syllables, length = facts[1:].sum(axis=1, dtype=np.int64).tolist()
        return toks, facts[0].astype(np.int64), (len(sents), len(toks), length, words, syllables)

    def new_types(self, a: np.ndarray, b: np.ndarray) -> tuple[list[str], list[int]]:
        """Cleaned tokens and lemmas, and for each the sum of RAW and LEMMA, times 1 for the source and 4 for the target."""
        out: dict[str, int] = {}
        for side, toks in ((1, a), (2, b)):
            new = toks[self.given[toks] & side == 0]
            self.given[new] |= side
            for i in set(new.tolist()):
                token, lemma = self.met[i]
                for t, bit in ((clean(token), RAW), (lemma, LEMMA)):
                    out[t] = out.get(t, 0) | bit * side * side
        return list(out), list(out.values())

    def row(self, lang: str | None, s: str | None, t: str | None) -> dict:
        if len(self.met) >= TABLE_LIMIT:
            self.empty()
        (a, a_lemmas, of_s), (b, b_lemmas, of_t) = self.measure(lang, s), self.measure(lang, t)
        out = {f"{x}_{name}": v for x, values in (("s", of_s), ("t", of_t)) for name, v in zip(MEASURES, values)}
        if a is None or b is None:  # what needs both
            a = b = a_lemmas = b_lemmas = np.zeros(0, np.int64)
        counts = [overlap(*x) for x in number_grams(a_lemmas, b_lemmas, len(self.lemmas) + 1)]
        shares = [new / all_b if all_b else 0.0 for _, all_b, new in counts]
        out["s_n_types"], out["t_n_types"], _ = counts[0]
        if len(a) + len(b) and (self.joined or R.GRAM_SEP in s or R.GRAM_SEP in t):  # words can hold what joins n-grams
            shares = [novelty(*([self.met[i][1] for i in x.tolist()] for x in (a, b)), n) for n in (1, 2, 3)]
        if self.once:
            out["types"], out["kinds"] = self.new_types(a, b)
        else:
            for x, toks in (("s", a), ("t", b)):
                met = [self.met[i] for i in toks.tolist()]
                out[f"{x}_raw"], out[f"{x}_lem"] = list(dict.fromkeys(clean(w) for w, _ in met)), list(dict.fromkeys(m for _, m in met))
        return out | {f"nov_{n}": v for n, v in zip((1, 2, 3), shares)}


MEASURES = ("n_sents", "n_tokens", "sum_token_len", "words", "syllables")
RAW, LEMMA = 1, 2


def paired(lang: str, s: str, t: str, table, once: bool = False) -> Column:
    """Of the marked texts of a pair: for both sides (s_, t_) the MEASURES and n_types (distinct cleaned lemmas), and novelty
    nov_1..nov_3 of the lemmas; raw and lem of both sides (distinct cleaned tokens and lemmas), or with ``once`` the types that
    the task has not given yet: see :meth:`Pairs.new_types`.  What needs both texts is empty where one is NULL.

    ``table``: a broadcast of :func:`textlab.operators.segment.lemma_table`.
    """
    def prepare():
        pairs = Pairs(table.value, once)
        return lambda x: pairs.row(x["lang"], x["s"], x["t"])

    kind = [f"{x}_{c}:bigint" for x in "st" for c in (*MEASURES, "n_types")] + [f"nov_{n}:double" for n in (1, 2, 3)]
    kind += ["types:array<string>", "kinds:array<bigint>"] if once else [f"{x}_{c}:array<string>" for x in "st" for c in ("raw", "lem")]
    return _per_row(f"struct<{','.join(kind)}>", prepare)(F.struct(F.col(lang).alias("lang"), F.col(s).alias("s"), F.col(t).alias("t")))


def compared(s_toks: str, t_toks: str, found: str) -> Column:
    """Of a pair's tokens and the lemmas ``found`` (token t, lemma l): distinct cleaned tokens and lemmas of
    both sides, novelty of the target's lemmas for n = 1, 2, 3.  All is empty where one side is NULL."""
    def row(x):
        lemma = {f["t"]: f["l"] for f in x["f"] or []}
        known = Table(clean)
        sides = [] if x["s"] is None or x["t"] is None else [x["s"], x["t"]]
        raw = [list(dict.fromkeys(map(known.__getitem__, side))) for side in sides] or [[], []]
        lem = [[known[lemma.get(t, t)] for t in side] for side in sides] or [[], []]
        return {"s_raw": raw[0], "t_raw": raw[1], "s_lem": list(dict.fromkeys(lem[0])), "t_lem": list(dict.fromkeys(lem[1])),
                **{f"nov_{n}": novelty(*lem, n) for n in (1, 2, 3)}}

    kind = ",".join([f"{side}_{c}:array<string>" for c in ("raw", "lem") for side in "st"] + [f"nov_{n}:double" for n in (1, 2, 3)])
    return _per_row(f"struct<{kind}>", lambda: row)(F.struct(F.col(s_toks).alias("s"), F.col(t_toks).alias("t"), F.col(found).alias("f")))
