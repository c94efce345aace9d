"""Least edits of a string of symbols into a language, by composing three finite-state machines.

The input is an acceptor of one string.  The edit transducer maps it to other strings:
keeping, relabelling, deleting and inserting symbols, each for a cost and with a letter.
The grammar accepts the strings that are wanted.  States of the composed machine are pairs
(place in the input, grammar state) and are made only as the search reaches them; the edit
transducer has one state.

Weights are pairs (cost, letters of the edits so far to the end), compared in that order;
letters are put in front, so that the lesser of two weights stays the lesser whatever
precedes them, which isn't so for letters behind.  The composed machine is acyclic but for
insertions, and an insertion that comes back to a grammar state at the same place costs
more than nothing, so relaxing states place by place from the end, with insertions as
often as there are grammar states, is a shortest path in topological order.

Places with the same symbol, and the same differences of costs and order of letters behind
them, have the same choices, so each kind of place is expanded once.  A place takes four
numbers, whatever the length of the input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

KEEP, RELABEL, DELETE, INSERT = "K", "R", "D", "I"


@dataclass(frozen=True)
class Grammar:
    """A deterministic acceptor: moves[state][symbol] is the next state; state 0 begins."""

    moves: Sequence[Mapping[str, int]]
    final: frozenset[int]


@dataclass(frozen=True)
class Edits:
    """The edit transducer of one input symbol: what each edit costs, and None where it isn't allowed.

    ``targets`` are the symbols that relabelling and inserting may give.
    """

    relabel: int = 1
    delete: int = 2
    insert: int = 5
    #: Added to any edit but deletion.
    fault: int = 5
    targets: tuple[str, ...] = ("u", "a")


@dataclass(frozen=True)
class Symbol:
    """A symbol of the input, and whether it has to go or costs more if it stays."""

    label: str
    must_go: bool = False
    faulty: bool = False


#: Of a state at a place: difference of cost from the least of the place, and rank of its letters among those of the place.
_Layer = tuple[tuple[int | None, int], ...]


@dataclass
class Composition:
    """The lazily composed machine of any input, an edit transducer and a grammar."""

    grammar: Grammar
    edits: Edits = Edits()
    _kinds: dict = field(default_factory=dict)

    def _arcs(self, symbol: Symbol, state: int):
        """(letter, cost, next state, symbol given) of the edits that consume the symbol."""
        if not symbol.must_go:
            extra = self.edits.fault if symbol.faulty else 0
            to = self.grammar.moves[state].get(symbol.label)
            if to is not None:
                yield KEEP, extra, to, symbol.label
            for target in self.edits.targets:
                if target in self.grammar.moves[state]:
                    yield RELABEL, self.edits.relabel + extra, self.grammar.moves[state][target], target
        yield DELETE, self.edits.delete, state, None

    def _relaxed(self, best: list) -> tuple[_Layer, int, tuple]:
        """A place's states once insertions are allowed: best[state] is (cost, letter and rank, move) or None."""
        for _ in range(len(best)):
            for state, moves in enumerate(self.grammar.moves):
                for target in self.edits.targets:
                    if target in moves and best[moves[target]] is not None:
                        cost, letters, _ = best[moves[target]]
                        found = (cost + self.edits.insert, ((INSERT, -1), *letters), (INSERT, moves[target], target))
                        if best[state] is None or found[:2] < best[state][:2]:
                            best[state] = found
        least = min((b[0] for b in best if b is not None), default=0)
        ranks = {letters: i for i, letters in enumerate(sorted({b[1] for b in best if b is not None}))}
        layer = tuple((None, 0) if b is None else (b[0] - least, ranks[b[1]]) for b in best)
        return layer, least, tuple(b and b[2] for b in best)

    def _before(self, symbol: Symbol, layer: _Layer) -> tuple[_Layer, int, tuple]:
        """The place before a symbol, from the place behind it: its states, the cost they share, and their moves."""
        kind = (symbol, layer)
        if kind not in self._kinds:
            best: list = [None] * len(self.grammar.moves)
            for state in range(len(best)):
                for letter, cost, to, given in self._arcs(symbol, state):
                    if layer[to][0] is not None:
                        found = (cost + layer[to][0], ((letter, layer[to][1]),), (letter, to, given))
                        if best[state] is None or found[:2] < best[state][:2]:
                            best[state] = found
            self._kinds[kind] = self._relaxed(best)
        return self._kinds[kind]

    def _end(self) -> tuple[_Layer, int, tuple]:
        # the empty string is less than any letters
        return self._relaxed([(0, (), None) if s in self.grammar.final else None for s in range(len(self.grammar.moves))])

    def shortest(self, symbols: Sequence[Symbol]) -> tuple[int, str]:
        """The cost and the letters of the least path through the composed machine."""
        layer, total, moves = self._end()
        places = [moves]
        for symbol in reversed(symbols):
            layer, more, moves = self._before(symbol, layer)
            places.append(moves)
            total += more
        if layer[0][0] is None:
            raise ValueError("no edits give a string of the grammar")
        letters, state, at = [], 0, len(symbols)
        while (move := places[at][state]) is not None:
            letters.append(move[0])
            at -= move[0] != INSERT
            state = move[1]
        return total + layer[0][0], "".join(letters)


@dataclass
class Follower:
    """Applies letters to symbols in order: what each edit gives."""

    grammar: Grammar
    targets: tuple[str, ...] = Edits.targets
    state: int = 0

    def give(self, letter: str, label: str | None = None) -> str | None:
        """The symbol that an edit of ``label`` gives at this state; None for a deletion."""
        if letter == DELETE:
            return None
        given = label if letter == KEEP else next(t for t in self.targets if t in self.grammar.moves[self.state])
        self.state = self.grammar.moves[self.state][given]
        return given
