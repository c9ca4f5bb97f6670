"""Periodic runs of words, by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends, at least LEAST words and FACTOR periods long.

The automaton's states form a tree by their suffix links; the path from the
state of a prefix to the root holds the sets of the prefix's suffixes.  The
prefixes are visited in order: an access in a link-cut tree gives the path of
the new prefix one colour, the position of its last word, and on its way meets
the older colours from the long suffixes to the short ones.  A colour e met at a state of length L means that the
longest suffix last seen at e has L words, so the words from e-L+1 to e
stand again at distance d = i-e: a stretch of period d that starts at e-L+1 and reaches to i.  With L >= d it is a square; it is part of a
run if L+d words are enough for one, d is then the run's smallest period (a smaller one would be a later colour), L its
exact reach to the left, and the last i with the same start and period its end.

A word inside a run of FACTOR periods occurs in it at least FACTOR times, so no run crosses
a word that is rarer in its text, nor in the stretch between two such words: the
automaton reads only stretches that this rule cannot split further.

Edge cases: null and empty texts have no words and no runs; a very long text takes memory for its words and for the automaton of its
longest stretch; repeated rows give repeated rows; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, FACTOR = 6, 4   # words and periods of the shortest run
SPLITS = 16            # times that a stretch is split by its rare words, at most

Run = tuple[int, int, int]  # start, length, period


class SuffixAutomaton:
    """States 0 (empty), 1, ...: transitions, suffix link, length of the longest string; ``ends``: the state of every prefix."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], []
        last = 0
        for symbol in symbols:
            last = self._append(last, symbol)
            self.ends.append(last)

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _append(self, last: int, symbol: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        state = self._new(length[last] + 1, 0, {})
        p = last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = state
            p = link[p]
        if p < 0:
            return state
        q = nxt[p][symbol]
        if length[q] == length[p] + 1:
            link[state] = q
            return state
        copy = self._new(length[p] + 1, link[q], nxt[q].copy())
        link[q] = link[state] = copy
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = copy
            p = link[p]
        return state


class ColouredPaths:
    """Link-cut tree over a fixed tree; every preferred path has the colour of the last access through it.

    A splay tree holds a path by depth; the root of the splay tree keeps the path's
    colour, and its parent is the tree's parent of the path's top.
    """

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up = list(parent)
        self.left, self.right = [-1] * n, [-1] * n
        self.colour = [-1] * n

    def _splay(self, v: int) -> None:
        up, left, right = self.up, self.left, self.right
        while (p := up[v]) >= 0 and (left[p] == v or right[p] == v):
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                self.colour[v] = self.colour[g]  # counts if g is the root
                self._rotate(p if (left[g] == p) == (left[p] == v) else v)
            else:
                self.colour[v] = self.colour[p]
            self._rotate(v)

    def _rotate(self, v: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[v]
        g = up[p]
        if left[p] == v:
            inner = left[p] = right[v]
            right[v] = p
        else:
            inner = right[p] = left[v]
            left[v] = p
        if inner >= 0:
            up[inner] = p
        up[p], up[v] = v, g
        if g >= 0:
            if left[g] == p:
                left[g] = v
            elif right[g] == p:
                right[g] = v

    def access(self, v: int, colour: int) -> list[tuple[int, int]]:
        """Colours the path from ``v`` to the root; (older colour, deepest state on the path that had it), deep first."""
        met, below, at = [], -1, v
        while at >= 0:
            self._splay(at)
            old = self.colour[at]
            if old >= 0:
                met.append((old, at))
            cut = self.right[at]
            if cut >= 0:
                self.colour[cut] = old
            self.right[at] = below
            below, at = at, self.up[at]
        self._splay(v)
        self.colour[v] = colour
        return met


def stretch_runs(symbols: list[int]) -> list[Run]:
    """All runs of a sequence, sorted."""
    automaton = SuffixAutomaton(symbols)
    length, paths = automaton.length, ColouredPaths(automaton.link)
    ends: dict[tuple[int, int], int] = {}
    for i, state in enumerate(automaton.ends):
        for e, at in paths.access(state, i):
            d, reach = i - e, length[at]
            if reach >= (FACTOR - 1) * d and reach + d >= LEAST:
                ends[e - reach + 1, d] = i
    return sorted((start, end - start + 1, d) for (start, d), end in ends.items())


def stretches(words: list) -> Iterator[tuple[int, int]]:
    """(begin, end) of the stretches that may hold runs."""
    todo = [(0, len(words), 0)]
    while todo:
        begin, end, depth = todo.pop()
        if end - begin < LEAST:
            continue
        part = words[begin:end] if end - begin < len(words) else words
        counts = Counter(part)
        if depth == SPLITS or min(counts.values()) >= FACTOR:
            yield begin, end
            continue
        start = begin
        for i, word in enumerate(part, begin):
            if counts[word] < FACTOR:
                if i - start >= LEAST:
                    todo.append((start, i, depth + 1))
                start = i + 1
        if end - start >= LEAST:
            todo.append((start, end, depth + 1))


def word_runs(words: list[bytes]) -> list[Run]:
    """All runs of a text's words, sorted by start, then period."""
    runs: list[Run] = []
    for begin, end in stretches(words):
        ids: dict[bytes, int] = {}
        found = stretch_runs([ids.setdefault(w, len(ids)) for w in words[begin:end]])
        runs += [(begin + start, length, period) for start, length, period in found]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    keep, upto = [], 0
    for begin, end in sorted((start + period, start + length) for start, length, period in runs):
        keep += words[upto:begin]
        upto = max(upto, end)
    return keep + words[upto:]


def greatest(runs: list[Run]) -> Run | None:
    """The run with the most periods, compared exactly; ties by start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("best", _RUN), ("collapsed", pa.string())])


def _named(r: Run) -> dict:
    return {"start": r[0], "length": r[1], "period": r[2]}


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rewrite: Callable[[str, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), best (the run with the most periods or null) and collapsed (the kept
    words joined by spaces) for every row.  ``rewrite(id, words)`` may change a text's words first; it gets the id as text
    (null: empty)."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode().split()
                if rewrite:
                    words = rewrite(key, words)
                runs = word_runs(words)
                best = greatest(runs)
                out.append({"n_words": len(words), "runs": [_named(r) for r in runs], "best": best and _named(best),
                            "collapsed": b" ".join(kept_words(words, runs)).decode()})
            found = pa.RecordBatch.from_pylist(out, _FOUND)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=["doc_id", *_FOUND.names])

    key = F.col(id_col).alias("doc_id")
    rows = docs.select(key, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    run = "struct<start:long,length:long,period:long>"
    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(find, f"doc_id {id_type}, n_words long, runs array<{run}>, best {run}, collapsed string")


def runs_digest(runs: F.Column) -> F.Column:
    """Hex sha256 of every run's ``start,length,period`` and a line feed."""
    return F.sha2(F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "").cast("binary"), 256)
