"""Transition tables over the symbols of texts, from automata over tokens.

An automaton over tokens says which token may follow which. Spelling its arcs out
symbol by symbol (bytes or code points) gives an automaton that reads text, but may
be inside several arcs at a time. Its subsets are the states here: a state holds,
for each place an arc may have begun at, the trie node read since and the token
before that place. Every prefix of a text has one accepted path, so of the arcs that
end at a symbol one alone fits; it is the label of the transition, and the change in
the number of tokens of the accepted path is its count.

States are numbered and transitions tabled when first met; a table that is full is
forgotten, but for the states that are in use. Words are driven in step, one table
look-up for all of them a symbol, and none is ever gone back on: a word's path is
read off the labels, from the last symbol to the first.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Sequence

import numpy as np

NONE = -1
SYMBOL_BITS = 21  # a code point
_ODD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = -1
_ZERO = 1 << 15  # of a count kept in 16 bits


class Machine:
    """A deterministic transducer from symbols to labels and counts, compiled as it is driven."""

    def __init__(self, pieces: Iterable[tuple[Sequence[int], int]], follows: Callable[[int, int], bool], foreign: Callable[[int], int] | None = None, counted: bool = False, most: int = 1 << 19):
        """pieces: symbols and number of each token; ``follows``: whether the second token may follow the first.

        ``foreign`` counts the tokens of a symbol that begins no token; nothing joins
        across it. ``counted``: states keep counts, so that transitions have them.
        ``most``: transitions to hold, and a fourth as many answers of ``follows``.
        """
        self.follows, self.foreign, self.counted, self.most = follows, foreign, counted, most
        self.children: dict[int, int] = {}
        self.ends = [NONE]
        self.inner = bytearray(1)
        for symbols, token in pieces:
            node = 0
            for c in symbols:
                key = node << SYMBOL_BITS | c
                child = self.children.get(key)
                if child is None:
                    child = self.children[key] = len(self.ends)
                    self.inner[node] = 1
                    self.ends.append(NONE)
                    self.inner.append(0)
                node = child
            self.ends[node] = token
        self.arcs: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: list[bytes] = []
        self.numbers: dict[bytes, int] = {}
        self.used = 0
        self._size(1 << 16)
        self.start = self.state([(0, NONE, 0)])

    def _size(self, slots: int) -> None:
        self.slots = slots
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.keys = np.full(slots, _EMPTY, np.int64)
        self.next = np.zeros(slots, np.int32)
        self.label = np.zeros(slots, np.int32)
        self.count = np.zeros(slots if self.counted else 1, np.int16)

    def state(self, items: list[tuple[int, int, int]]) -> int:
        """The number of a state: (trie node, token before it, tokens there beyond those of the whole prefix)."""
        return self.numbered(array("q", [node << 40 | (last + 1) << 16 | (less + _ZERO) for node, last, less in items]).tobytes())

    def numbered(self, key: bytes) -> int:
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        return number

    def _follows(self, last: int, token: int) -> bool:
        if last == NONE:
            return True
        found = self.arcs.get((last, token))
        if found is None:
            if len(self.arcs) >= self.most // 4:
                self.arcs.clear()
            found = self.arcs[last, token] = self.follows(last, token)
        return found

    def step(self, state: int, symbol: int) -> tuple[int, int, int]:
        """The state behind a symbol, the token that ends there and the change in the number of tokens."""
        going, label, gain = [], NONE, 0
        children, ends, inner = self.children, self.ends, self.inner
        for code in array("q", self.states[state]):
            child = children.get((code >> 40) << SYMBOL_BITS | symbol)
            if child is None:
                continue
            last = (code >> 16 & 0xFFFFFF) - 1
            token = ends[child]
            if label == NONE and token != NONE and self._follows(last, token):
                label, gain = token, (code & 0xFFFF) - _ZERO + 1
            if inner[child]:
                going.append((child, code))
        if label == NONE:
            if self.foreign is None:
                raise ValueError("a symbol is not in the vocabulary")
            gain = self.foreign(symbol)
        less = gain if self.counted else 0
        codes = [(child << 40) | (code & 0xFFFFFFFFFF) - less for child, code in going]
        codes.append((label + 1) << 16 | _ZERO)
        return self.numbered(array("q", codes).tobytes()), label, gain

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or of the free slot where its search ends."""
        mask = self.slots - 1
        slot = ((keys.view(np.uint64) * _ODD) >> self.shift).astype(np.int64)
        held = self.keys[slot]
        off = np.flatnonzero((held != keys) & (held != _EMPTY))
        while len(off):
            slot[off] = (slot[off] + 1) & mask
            held = self.keys[slot[off]]
            off = off[(held != keys[off]) & (held != _EMPTY)]
        return slot

    def _put(self, keys: np.ndarray, nexts: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> None:
        """Tables new transitions, all different."""
        if 2 * (self.used + len(keys)) > self.slots:
            old = self.keys != _EMPTY
            had = self.keys[old], self.next[old], self.label[old], self.count[old] if self.counted else self.count
            size = self.slots
            while 2 * (self.used + len(keys)) > size:
                size *= 2
            self._size(size)
            self.used = 0
            self._put(*had)
        left = np.arange(len(keys))
        while len(left):
            slot = self._places(keys[left])
            first = np.unique(slot, return_index=True)[1]  # those that want one slot take turns
            at, now = slot[first], left[first]
            self.keys[at], self.next[at], self.label[at] = keys[now], nexts[now], labels[now]
            if self.counted:
                self.count[at] = counts[now]
            left = np.delete(left, first)
        self.used += len(keys)

    def _look(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Slots of the transitions of states on symbols; numbers of states hold until the next call, which may forget them."""
        keys = state << SYMBOL_BITS | symbols
        slot = self._places(keys)
        new = self.keys[slot] != keys
        if new.any():
            if self.used >= self.most:
                live, of = np.unique(state, return_inverse=True)
                held = [self.states[s] for s in live.tolist()]
                self._forget()
                state = np.array([self.numbered(h) for h in held], np.int64)[of]
                keys = state << SYMBOL_BITS | symbols
                new[:] = True
            fresh = np.unique(keys[new])
            mask = (1 << SYMBOL_BITS) - 1
            made = np.array([self.step(k >> SYMBOL_BITS, k & mask) for k in fresh.tolist()], np.int64)
            self._put(fresh, made[:, 0], made[:, 1], made[:, 2])
            slot = self._places(keys)
        return slot

    def labels(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The label at every symbol of words that do not overlap, each from the start state."""
        out = np.full(len(symbols), NONE, np.int32)
        self._drive(symbols, starts, lengths, None, out)
        return out

    def counts(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of every word from the start state."""
        return self._drive(symbols, starts, lengths, None, None)[0]

    def maps(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begin: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Tokens that every word adds behind the state it begins in, and the state behind it; states as their items in bytes."""
        return self._drive(symbols, starts, lengths, begin, None)

    def _drive(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begin: list[bytes] | None, labels: np.ndarray | None) -> tuple[np.ndarray, list]:
        """Drives words, all at a time, a symbol a step."""
        order = np.argsort(-lengths, kind="stable")
        at, size = starts[order], lengths[order]
        total = np.zeros(len(starts), np.int64)
        state = np.full(len(starts), self.start, np.int64) if begin is None else np.array([self.numbered(b) for b in begin], np.int64)[order]
        final = [b""] * (0 if begin is None else len(starts))
        live = len(order)
        ending = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right").tolist()  # words of k symbols and more
        for k, n in enumerate(ending):
            if n < live:
                if begin is not None:
                    for i in range(n, live):
                        final[order[i]] = self.states[state[i]]
                live, state = n, state[:n]
            place = at[:live] + k
            slot = self._look(state, symbols[place].astype(np.int64))
            state = self.next[slot].astype(np.int64)
            if labels is not None:
                labels[place] = self.label[slot]
            if self.counted:
                total[:live] += self.count[slot]
        if begin is not None:
            for i in range(live):
                final[order[i]] = self.states[state[i]]
        sums = np.empty_like(total)
        sums[order] = total
        return sums, final


def trace(labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where tokens of the accepted paths end: True at their last symbols. ``sizes`` has the symbols of each token."""
    ends = np.zeros(len(labels), bool)
    at, first = starts + lengths - 1, starts
    some = lengths > 0
    at, first = at[some], first[some]
    while len(at):
        ends[at] = True
        at = at - sizes[labels[at]]
        more = at >= first
        at, first = at[more], first[more]
    return ends
