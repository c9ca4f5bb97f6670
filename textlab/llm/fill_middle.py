"""Fill-in-the-middle transformation with cuts at unit boundaries.

A unit is a run of ASCII letters or any other single character.  The texts of a
group of rows become one sequence of character classes in a wavelet matrix.  A unit
starts at every character that does not continue a run of letters, so the
number of units that start before a position is the sum of the ranks of the
other classes there, and a cut after k units lies where that number first
exceeds k: bisection on ranks finds it, for all cuts of a group at once.

The output is ``<P>prefix<S>suffix<M>middle`` (psm), ``<S>suffix<P>prefix<M>middle``
(spm) or the text itself (plain); a text that holds one of the marks stays plain, so
the exact text can be rebuilt from output and form (:func:`restored`).

Edge cases: null and empty texts have no units and stay plain; a null id counts as
empty text in the hash; a very long text is a group of its own (13 bytes a
character); repeated rows give repeated rows; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
GROUP = 1 << 22  # characters that share a wavelet matrix (one longer text has its own)

INNER, FIRST, DIGIT, SPACE, OTHER = range(5)  # classes: letter inside a run, first letter of a run, ...
LEVELS = 3

_LETTER = np.zeros(128, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CLASS = np.full(128, OTHER, np.uint8)
_CLASS[48:58] = DIGIT
_CLASS[[*range(9, 14), 32]] = SPACE


class WaveletMatrix:
    """Rank over a sequence of small symbols: one bit vector a level, zeros before ones from level to level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.rows = len(symbols), []
        for level in reversed(range(levels)):
            bit = (symbols >> level) & 1
            words = np.zeros(self.n // 64 * 8 + 8, np.uint8)
            packed = np.packbits(bit, bitorder="little")
            words[:len(packed)] = packed
            words = words.view("<u8")
            counts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            on = bit.astype(bool)
            self.rows.append((level, words, counts, self.n - int(counts[-1])))
            symbols = np.concatenate((symbols[~on], symbols[on]))

    @staticmethod
    def _ones(words: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        w, b = at >> 6, (at & 63).astype(np.uint64)
        return counts[w] + np.bitwise_count(words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before each position."""
        low, high = np.zeros_like(at), at
        for level, words, counts, zeros in self.rows:
            a, b = self._ones(words, counts, low), self._ones(words, counts, high)
            low, high = (zeros + a, zeros + b) if symbol >> level & 1 else (low - a, high - b)
        return high - low


def classes(chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of every code point; a text begins at each of ``starts``."""
    ascii_ = chars < 128
    index = np.where(ascii_, chars, 0).astype(np.intp)
    letter = _LETTER[index] & ascii_
    out = np.where(ascii_, _CLASS[index], OTHER).astype(np.uint8)
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    inner[starts[starts < len(chars)]] = False
    out[letter] = FIRST
    out[inner] = INNER
    return out


class Units:
    """Units of several texts, counted and located by ranks."""

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        self.matrix = WaveletMatrix(classes(chars, self.begin), LEVELS)
        self.before = self.starts(self.begin)
        self.n = self.starts(self.end) - self.before

    def starts(self, at: np.ndarray) -> np.ndarray:
        """Units that start before each position of the joined texts."""
        return sum(self.matrix.rank(c, at) for c in (FIRST, DIGIT, SPACE, OTHER))

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Characters of each text's first ``k`` units."""
        goal = self.before + k
        low, high = self.begin.copy(), self.end.copy()  # the greatest position with at most goal starts before it
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            fits = self.starts(mid) <= goal
            low, high = np.where(open_ & fits, mid, low), np.where(open_ & ~fits, mid - 1, high)
        return low - self.begin


def _groups(texts: list[str]) -> Iterator[slice]:
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > GROUP:
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    yield slice(first, len(texts))


def _transform(texts: list[str], h1, h2, plain, spm) -> pd.DataFrame:
    units = Units(texts)
    n = units.n
    a, b = h1 % (n + 1), h2 % (n + 1)
    cut_a, cut_b = units.cut(np.minimum(a, b)), units.cut(np.maximum(a, b))
    rows = []
    for text, count, x, y, is_plain, is_spm in zip(texts, n.tolist(), cut_a.tolist(), cut_b.tolist(), plain, spm):
        if is_plain or not text or PREFIX in text or SUFFIX in text or MIDDLE in text:
            rows.append((count, "plain", None, None, text))
        elif is_spm:
            rows.append((count, "spm", x, y - x, f"{SUFFIX}{text[y:]}{PREFIX}{text[:x]}{MIDDLE}{text[x:y]}"))
        else:
            rows.append((count, "psm", x, y - x, f"{PREFIX}{text[:x]}{SUFFIX}{text[y:]}{MIDDLE}{text[x:y]}"))
    out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
    return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for every row.

    All draws come from the sha256 of ``seed:id``, so a row has the same cuts wherever it stands.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draw = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def transform(text: pd.Series, h1: pd.Series, h2: pd.Series, plain: pd.Series, spm: pd.Series) -> pd.DataFrame:
        texts = text.tolist()
        if not texts:
            return _transform([], *[np.zeros(0, np.int64)] * 4)
        h1, h2, plain, spm = h1.to_numpy(), h2.to_numpy(), plain.to_numpy(), spm.to_numpy()
        return pd.concat([_transform(texts[s], h1[s], h2[s], plain[s], spm[s]) for s in _groups(texts)], ignore_index=True)

    made = transform(F.coalesce(F.col(text_col), F.lit("")), draw[0], draw[1], draw[2] % 100 >= 100 - plain_percent, draw[3] % 100 < spm_percent)
    return docs.select(F.col(id_col).alias("doc_id"), made.alias("made")).select("doc_id", "made.*")


def restored(output: Column, form: Column) -> Column:
    """The exact text: no mark can occur or arise inside a part, so the first of each mark is the mark."""
    def part(begin: str, end: str | None = None) -> Column:
        rest = F.substring_index(output, begin, 1)
        start = F.length(rest) + len(begin) + 1
        if end is None:
            return F.substr(output, start)
        return F.substr(output, start, F.length(F.substring_index(output, end, 1)) - F.length(rest) - len(begin))

    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE), part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE), part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
