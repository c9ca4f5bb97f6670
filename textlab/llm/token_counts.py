"""Token counts by a compiled finite-state transducer.

The tokenizer (a sentencepiece BPE model with identity normalisation) is
compiled into a deterministic transducer (:class:`.bpe_machine.CountMachine`) that reads
characters and whose transitions carry the number of tokens they emit; states are determinised when
a text first needs them.  No piece of the vocabulary holds a word-begin mark after
another character, and none holds a line feed (both are checked when the
model is compiled), so the machine is back in its start state before each
run of spaces and around each line feed.  The paths between two visits of
that state are kept path-compressed: one entry per segment, filled by
running the machine over it.

A text is read in chunks.  The state map of a chunk is ``(head, count,
tail)``: what it reads before its first sure boundary and after its last one
depends on the neighbours and stays symbolic, all between is a number.  Maps
compose associatively (``tail + head`` closes the seam), so chunks are counted
independently and combined by a prefix scan of logarithmic depth.

Edge cases: null and empty texts have 0 tokens and 0 bytes; very long texts
are many chunks; a segment table is emptied when it holds ``TABLE_LIMIT``
segments (a memory bound; results do not change); extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_machine import CountMachine

CHUNK = 1 << 16        # code points per chunk
TABLE_LIMIT = 500_000  # segments kept per table and worker process
LONGEST_KEPT = 64      # characters of a segment that is kept
_FIRST_CUT = re.compile(r"[^ ](?= )|.(?=\n)|\n", re.S)
MARK = "▁"        # sentencepiece's word-begin mark, the same symbol as a space


class ChunkMap(NamedTuple):
    """State map of a chunk; ``closed`` is False while no boundary was seen (then all is in head)."""

    closed: bool
    head: str
    count: int
    tail: str


class _Paths(dict):
    """Paths of the machine from its start state back to it: segment -> emitted tokens."""

    def __init__(self, machine: CountMachine, lead: str):
        super().__init__()
        self.machine, self.lead = machine, lead

    def __missing__(self, word: str) -> int:
        n = self.machine.count((self.lead + word).replace(" ", MARK))
        if len(word) <= LONGEST_KEPT:
            if len(self) >= TABLE_LIMIT:
                self.clear()
            self[word] = n
        return n


class CountTransducer:
    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in normal]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("the vocabulary has pieces across word boundaries")
        # the best score merges first; a character outside the vocabulary falls back to its bytes
        by_score = sorted(normal, key=sp.get_score, reverse=True)
        machine = CountMachine({sp.id_to_piece(i): r for r, i in enumerate(by_score)}, lambda c: len(c.encode()))
        self.line_feed = machine.count("\n")
        self.one_space = machine.count(MARK)
        self.after_space = _Paths(machine, MARK)     # one space, then the word
        self.after_feed = _Paths(machine, "")        # the word alone
        self.spaces = _Paths(machine, MARK)          # key: what follows the first of several spaces

    def count(self, s: str) -> int:
        """Tokens of ``s`` read from the boundary state to the boundary state."""
        lines = s.split("\n")
        n = (len(lines) - 1) * self.line_feed
        get, first = self.after_space.__getitem__, self.after_feed
        for line in lines:
            words = line.split(" ")
            if "" in words[1:]:
                n += self._spaced(line)
            else:
                if words[0]:
                    n += first[words[0]]
                n += sum(map(get, words[1:]))
        return n

    def _spaced(self, line: str) -> int:
        """A line with runs of spaces: each run belongs to the word after it."""
        n = 0
        for seg in re.findall(" *[^ ]+| +", line):
            if seg[0] != " ":
                n += self.after_feed[seg]
            elif seg == " ":
                n += self.one_space
            else:
                n += self.spaces[seg[1:]]
        return n

    def chunk_map(self, s: str) -> ChunkMap:
        """Sure boundaries: around a line feed, and between a non-space and a space."""
        first = _FIRST_CUT.search(s)
        if not first:
            return ChunkMap(False, s, 0, "")
        run = s.rfind(" ")
        while run > 0 and s[run - 1] == " ":
            run -= 1
        a, b = first.end(), max(run, s.rfind("\n") + 1)
        return ChunkMap(True, s[:a], self.count(s[a:b]) if b > a else 0, s[max(a, b):])

    def compose(self, x: ChunkMap, y: ChunkMap) -> ChunkMap:
        if not x.closed:
            if not y.closed:
                return self.chunk_map(x.head + y.head)
            seam = self.chunk_map(x.head + y.head)
            if not seam.closed:
                return ChunkMap(True, seam.head, y.count, y.tail)
            return ChunkMap(True, seam.head, seam.count + self.count(seam.tail) + y.count, y.tail)
        if not y.closed:
            seam = self.chunk_map(x.tail + y.head)
            if not seam.closed:
                return ChunkMap(True, x.head, x.count, seam.head)
            return ChunkMap(True, x.head, x.count + self.count(seam.head) + seam.count, seam.tail)
        return ChunkMap(True, x.head, x.count + self.count(x.tail + y.head) + y.count, y.tail)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan with doubling steps (each step could run in parallel)."""
        out, step = list(maps), 1
        while step < len(out):
            out = [self.compose(out[i - step], out[i]) if i >= step else out[i] for i in range(len(out))]
            step *= 2
        return out

    def fold(self, maps: list[ChunkMap]) -> ChunkMap:
        """The scan's last element alone, as a balanced tree."""
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def tokens(self, text: str | None, chunk: int = CHUNK) -> int:
        """The start state reads the tokenizer's leading space."""
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        if len(text) <= chunk:
            return self.count(" " + text)
        m = self.fold([self.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)])
        return self.count(" " + m.head) + m.count + self.count(m.tail)


@lru_cache(maxsize=4)
def transducer(model_file: str) -> CountTransducer:
    return CountTransducer(model_file)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(model_file)
        for batch in texts:
            yield pd.Series([t.tokens(x) for x in batch], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return x.withColumn("over_limit", F.col("n_tokens") > limit)
