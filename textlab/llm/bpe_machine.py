"""Lazily determinised transducers for byte-pair encoding.

Byte-pair encoding (merge the adjacent pair whose joined string has the least
rank, leftmost first, until none is left) is a local matter: the encoding of a
text without its last token is the encoding of the shorter text, and two tokens may
stand side by side exactly if the pair of them alone encodes to itself.  So the last
token of a prefix follows from the last tokens of shorter prefixes no
further back than the longest token, and a machine can read the text from left to right.

A state holds, for every start from which the text read so far is still the
beginning of some token: the node of the vocabulary's trie, the last token
before that start, and what the machine owes there (tokens that are decided for this
start, not yet for the others).  What all starts owe alike is emitted, so
a token leaves the machine at the latest after as many symbols as the longest token has.  States and
transitions are made when a text first needs them; when the table is full, further ones
serve their text and are dropped (a memory bound, results do not change).

Two kinds of output: the tokens themselves (:class:`TokenMachine`) or only their number
(:class:`CountMachine`, whose transitions carry emitted-token counts).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

STATES = 200_000  # states kept per machine
PAIRS = 200_000   # answers kept per machine: may two tokens stand side by side


class Node(dict):
    """Node of the vocabulary's trie: symbol -> node; the token that ends here, if any, and what it adds to the output."""

    __slots__ = ("token", "output")
    __hash__ = object.__hash__

    def __init__(self):
        self.token = self.output = None

    def __eq__(self, other):
        return self is other


class State(dict):
    """Transitions symbol -> (state, output), made on first use; ``end`` is owed if the text ends here."""

    __slots__ = ("machine", "starts", "end", "kept")

    def __init__(self, machine: Machine, starts: tuple, end, kept: bool):
        self.machine, self.starts, self.end, self.kept = machine, starts, end, kept

    def __missing__(self, symbol):
        to = self.machine.step(self, symbol)
        if self.kept and to[0].kept:
            self[symbol] = to
        return to


class Machine:
    """``ranks``: token (a sequence of symbols, str or bytes) -> rank, the key by which pairs are joined.

    A single symbol that is no token stands alone.  ``whole``: a text that is a token as a whole
    encodes to it even if no merges lead there.
    """

    nothing: object  # owed at the start

    def __init__(self, ranks: Mapping, whole: bool = False):
        self.ranks, self.whole = ranks, whole
        self.root = Node()
        for t in ranks:
            node = self.root
            for symbol in t:
                to = node.get(symbol)
                if to is None:
                    to = node[symbol] = Node()
                node = to
            node.token, node.output = t, self.output(t)
        self.pairs: dict = {}
        self.split: dict = {}
        self.states: dict[tuple, State] = {}
        self.start = self._state(((self.root, None, self.nothing),), self.nothing)

    def _state(self, starts: tuple, end) -> State:
        s = self.states.get((starts, end))
        if s is None:
            kept = len(self.states) < STATES
            s = State(self, starts, end, kept)
            if kept:
                self.states[starts, end] = s
        return s

    def merged(self, text, parts_left: int = 1) -> list:
        """The encoding by its definition (or the parts just before the merge that leaves fewer than ``parts_left``)."""
        parts, get = [text[i:i + 1] for i in range(len(text))], self.ranks.get
        while len(parts) > parts_left:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token):
        """What the last merge of ``token`` joins; () for a single symbol, None if no merges lead to it."""
        h = self.split.get(token, 0)
        if h == 0:
            parts = self.merged(token, 2) if len(token) > 1 else ()
            h = self.split[token] = tuple(parts) if len(parts) in (0, 2) and (not parts or token in self.ranks) else None
            if h and any(len(t) > 1 and self.ranks[t] > self.ranks[token] for t in h):
                raise ValueError(f"{token!r} comes before a part of it: not a vocabulary of merges")
        return h

    def fits(self, last, token) -> bool:
        """May ``token`` follow ``last`` (None: begin the text; empty: a symbol outside the vocabulary)?

        Undo the merges next to the seam, the later one first: the two parts at the seam must at
        no time have a merge of their own that comes before the one just undone (of equal
        ones the left comes first).
        """
        if self.halves(token) is None:
            return False
        if not last:
            return True
        ok = self.pairs.get((last, token))
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[last, token] = self._seam_holds(last, token)
        return ok

    def _seam_holds(self, a, b) -> bool:
        limit, get = float("inf"), self.ranks.get
        while True:
            joined = get(a + b)
            if joined is not None and joined < limit:
                return False
            left = self.ranks[a] if len(a) > 1 else -1
            right = self.ranks[b] if len(b) > 1 else -1
            if left < 0 and right < 0:
                return True
            if left > right:
                limit, a = left, self.halves(a)[1]
            else:
                limit, b = right + 1, self.halves(b)[0]

    def step(self, state: State, symbol) -> tuple[State, object]:
        starts, found, all_of_it, known = [], None, None, self.pairs.get
        for node, last, owed in state.starts:
            to = node.get(symbol)
            if to is None:
                continue
            token = to.token
            if token is not None:
                if found is None:
                    fits = known((last, token))
                    if fits or fits is None and self.fits(last, token):
                        found = token, owed + to.output
                if last is None and self.whole:
                    all_of_it = to.output
            if to:
                starts.append((to, last, owed))
        if found is None:  # a symbol outside the vocabulary
            single = symbol if isinstance(symbol, str) else bytes((symbol,))
            found = single[:0], state.starts[-1][2] + self.output(single)
        starts.append((self.root, *found))
        out, end = self.nothing, found[1]
        if all_of_it is not None:
            end = all_of_it
        elif starts[0][2]:  # a start that owes nothing keeps back all output
            out = self.common([owed for _, _, owed in starts])
            if out:
                starts = [(node, last, self.minus(owed, out)) for node, last, owed in starts]
                end = self.minus(end, out)
        return self._state(tuple(starts), end), out

    def output(self, token):
        raise NotImplementedError

    def minus(self, owed, out):
        raise NotImplementedError

    def common(self, owed: list):
        raise NotImplementedError


class TokenMachine(Machine):
    """Emits token ids (the ranks)."""

    nothing = ()

    def output(self, token):
        return (self.ranks[token],)

    def minus(self, owed, out):
        return owed[len(out):]

    def common(self, owed):
        low, high = min(owed), max(owed)
        n = 0
        while n < len(low) and low[n] == high[n]:
            n += 1
        return low[:n]

    def encode(self, text: Iterable, into: list) -> None:
        """Appends the ids of ``text`` to ``into`` as they are decided."""
        state = self.start
        for symbol in text:
            state, out = state[symbol]
            if out:
                into += out
        into += state.end


class CountMachine(Machine):
    """Emits numbers of tokens; ``alone`` gives the number for a symbol outside the vocabulary."""

    nothing = 0

    def __init__(self, ranks: Mapping, alone, whole: bool = False):
        self.alone = alone
        super().__init__(ranks, whole)

    def output(self, token):
        return 1 if token in self.ranks else self.alone(token)

    def minus(self, owed, out):
        return owed - out

    def common(self, owed):
        return min(owed)

    def count(self, text: Iterable) -> int:
        state, n = self.start, 0
        for symbol in text:
            state, out = state[symbol]
            n += out
        return n + state.end
