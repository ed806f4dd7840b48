"""Byte-pair encodings compiled into deterministic finite-state transducers.

A sequence of tokens is the encoding of its text exactly if each token encodes itself and each two
neighbours encode themselves: were a merge to cross a border of the sequence, it would cross it in the
encoding of the two neighbours alone, too. So the last token at each position is decided by what is
left of it, and a finite automaton can keep track: its state is the set of open hypotheses (a place
in the trie of tokens, the token before it, and how many tokens ago that was), all of which start
within one token's length. Transitions are annotated with the number of tokens they emit, relative to
the hypothesis that ends here. The automaton is compiled lazily, state by state, as texts need it, into
an open-addressing table, which runs over all words of a batch in lockstep.

Long texts are cut into chunks; see ``giant``: each chunk gives the max-plus transfer matrix between the boundary
states of its cuts, and an associative scan combines them.
"""

from __future__ import annotations

import numpy as np

SYMBOL_BITS = 21
STATES = 400_000
#: Words cut in a place, with their matrices, that are kept.
SEGMENTED = 100_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Stands for no token ago; a hypothesis that begins after more tokens than end here is negative.
ZERO = 512


class Transducer:
    """tokens: symbols (a tuple of ints) to id. encode: the reference algorithm for short sequences,
    symbols to ids. A symbol that is no token alone gets the id `unknown` + symbol."""

    def __init__(self, tokens: dict, encode, unknown: int):
        self.encode, self.unknown = encode, unknown
        self.symbols_of = {i: s for s, i in tokens.items()}
        self.child: dict[int, int] = {}
        self.term = [-1]
        for symbols, token in tokens.items():
            node = 0
            for c in symbols:
                key = node << SYMBOL_BITS | c
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.term)
                    self.term.append(-1)
                node = nxt
            self.term[node] = token
        self.open = bytearray(len(self.term))
        for key in self.child:
            self.open[key >> SYMBOL_BITS] = 1
        self.longest = max(map(len, tokens))
        self.segmented: dict = {}
        #: Texts that went through the scan over chunks.
        self.scans = 0
        self._reset()

    def _reset(self) -> None:
        start = (ZERO,)  # at the root, after no token
        self.states, self.lists = {start: 0}, [start]
        self.pairs: dict[int, bool] = {}
        self.last = np.full(1 << 14, -1, np.int32)
        self._size(1 << 16)
        self.used = 0

    def _size(self, size: int) -> None:
        self.keys, self.values = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1

    def symbols(self, token: int) -> tuple:
        return self.symbols_of[token] if token < self.unknown else (token - self.unknown,)

    def fit(self, before: int, token: int) -> bool:
        """Whether token can follow the token `before` (-1: begin a word)."""
        key = (before + 1) << 32 | token
        found = self.pairs.get(key)
        if found is None:
            if before < 0:
                found = self.encode(self.symbols(token)) == [token]
            else:
                found = self.encode((*self.symbols(before), *self.symbols(token))) == [before, token]
            self.pairs[key] = found
        return found

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and the tokens emitted, which is negative where a longer token takes the
        place of shorter ones."""
        out, new = [], None
        for x in self.lists[state]:
            node, before, ago = x >> 32, (x >> 10 & 0x3FFFFF) - 1, (x & 1023) - ZERO
            nxt = self.child.get(node << SYMBOL_BITS | symbol)
            token = self.term[nxt] if nxt is not None else -1
            if nxt is not None and self.open[nxt]:
                out.append((nxt, before, ago))
            if node == 0 and token < 0:
                token = self.unknown + symbol
            if new is None and token >= 0 and self.fit(-1, token) and self.fit(before, token):
                new = token, 1 - ago
        # In a word's own run a hypothesis always ends here; after a boundary state that proves wrong, none may.
        token, emitted = new or (-2, 0)
        key = tuple(n << 32 | (b + 1) << 10 | a + emitted + ZERO for n, b, a in out)
        if new:
            key = (*key, (token + 1) << 10 | ZERO)
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.lists)
            self.lists.append(key)
            if number >= len(self.last):
                self.last = np.concatenate([self.last, np.full(len(self.last), -1, np.int32)])
            self.last[number] = token
        return number, emitted

    def _insert(self, key: int, value: int) -> None:
        at = (key * int(_MULTIPLY) & (1 << 64) - 1) >> int(self.shift)
        while self.keys[at]:
            at = at + 1 & self.mask
        self.keys[at], self.values[at] = key, value

    def _add(self, keys: np.ndarray) -> None:
        for key in keys.tolist():
            number, emitted = self.step((key >> SYMBOL_BITS) - 1, key & (1 << SYMBOL_BITS) - 1)
            if 2 * self.used >= len(self.keys):
                old, values = self.keys, self.values
                self._size(2 * len(old))
                for k in np.flatnonzero(old):
                    self._insert(int(old[k]), int(values[k]))
            self._insert(key, number << 11 | emitted + 1024)
            self.used += 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = (keys.view(np.uint64) * _MULTIPLY >> self.shift).view(np.int64)
        there = self.keys[at]
        out = self.values[at]
        todo = np.flatnonzero(there != keys)
        missing = []
        while len(todo):
            held = there[todo]
            empty = held == 0
            if empty.any():
                missing.append(todo[empty])
                todo = todo[~empty]
            at[todo] = at[todo] + 1 & self.mask
            there[todo] = self.keys[at[todo]]
            out[todo] = self.values[at[todo]]
            todo = todo[there[todo] != keys[todo]]
        if missing:
            missing = np.concatenate(missing)
            self._add(np.unique(keys[missing]))
            out[missing] = self._find(keys[missing])
        return out

    def run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
        """Tokens of each word; if last is given, it gets the last token at each symbol."""
        if len(self.lists) > STATES:
            self._reset()
        counts = np.zeros(len(starts), np.int64)
        order = np.argsort(-lengths, kind="stable")
        sorted_lengths = -lengths[order]
        at = starts[order]
        state = np.zeros(len(at), np.int64)
        emitted = np.zeros(len(at), np.int64)
        for j in range(int(-sorted_lengths[0]) if len(at) else 0):
            n = int(np.searchsorted(sorted_lengths, -j, "left"))
            here = at[:n] + j
            found = self._find((state[:n] + 1 << SYMBOL_BITS) | symbols[here])
            state[:n] = found >> 11
            emitted[:n] += (found & 2047) - 1024
            if last is not None:
                last[here] = self.last[found >> 11]
        counts[order] = emitted
        return counts

    # Long words: max-plus over boundary states.

    def crossing(self, symbols: list[int], cut: int) -> list[tuple[int, int]]:
        """The boundary states of a cut: (start, token) of all tokens that may cover the symbol before it."""
        if cut == 0:
            return [(0, -1)]
        out = []
        for start in range(max(0, cut - self.longest), cut):
            node = 0
            for k in range(start, min(len(symbols), start + self.longest)):
                node = self.child.get(node << SYMBOL_BITS | symbols[k])
                if node is None:
                    break
                if k + 1 >= cut and self.term[node] >= 0 and self.fit(-1, self.term[node]):
                    out.append((start, self.term[node]))
        if not any(s == cut - 1 and len(self.symbols(t)) == 1 for s, t in out):
            out.append((cut - 1, self.unknown + symbols[cut - 1]))
        return out

    def chunk(self, symbols: list[int], entry: tuple[int, int], exits: list[tuple[int, int]]):
        """The row of a transfer matrix: for each exit, the tokens emitted after the entry up to and
        with the exit's (-inf where no encoding has both), and the last token at each position."""
        begin = entry[0] + (len(self.symbols(entry[1])) if entry[1] >= 0 else 0)
        key = ((entry[1] + 1) << 10 | ZERO,)
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = len(self.lists)
            self.lists.append(key)
            if state >= len(self.last):
                self.last = np.concatenate([self.last, np.full(len(self.last), -1, np.int32)])
            self.last[state] = entry[1]
        end = max([begin, *(s for s, _ in exits)])
        last, count, total = {begin: entry[1]}, {begin: 0}, 0
        memo: dict[int, tuple[int, int]] = {}
        for k in range(begin, end):
            key = state << SYMBOL_BITS | symbols[k]
            found = memo.get(key)
            if found is None:
                found = memo[key] = self.step(state, symbols[k])
            state = found[0]
            total += found[1]
            if self.last[state] >= 0:
                count[k + 1], last[k + 1] = total, int(self.last[state])
        row = np.full(len(exits), -np.inf)
        for j, (s, t) in enumerate(exits):
            if (s, t) == entry:
                row[j] = 0  # one token covers the chunk
            elif s in last and self.fit(-1, t) and self.fit(last[s], t):
                row[j] = count[s] + 1
        return row, last

    def segments(self, word: tuple, cuts: tuple):
        """The states at the cuts of a word (its begin and end included), and of each segment between two of them the
        transfer matrix and a trace for each entry."""
        key = word, cuts
        found = self.segmented.get(key)
        if found is None:
            symbols, n = list(word), len(word)
            states = [self.crossing(symbols, c) for c in (0, *cuts, n)]
            states[-1] = [(s, t) for s, t in states[-1] if s + len(self.symbols(t)) == n]
            parts = []
            for left, right in zip(states, states[1:]):
                rows = [self.chunk(symbols, e, right) for e in left]
                parts.append((np.stack([r for r, _ in rows]), [t for _, t in rows]))
            if len(self.segmented) >= SEGMENTED:
                self.segmented.clear()
            found = self.segmented[key] = states, parts
        return found

    def _ids(self, word: tuple, cuts: tuple, way: list[int]) -> list[int]:
        """Token ids of a word, traced back segment by segment; way: the state taken at each cut, begin and end included."""
        states, parts = self.segments(word, cuts)
        out: list[int] = []
        for k, (_, traces) in enumerate(parts):
            entry, (s, t) = states[k][way[k]], states[k + 1][way[k + 1]]
            if (s, t) == entry:
                continue
            own, begin, last = [t], entry[0] + (len(self.symbols(entry[1])) if entry[1] >= 0 else 0), traces[way[k]]
            while s > begin:
                own.append(last[s])
                s -= len(self.symbols(last[s]))
            out += reversed(own)
        return out

    def giant(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray, cuts: np.ndarray, ids: bool):
        """Number of tokens of a text, and the ids of the words that its cuts run through (a dict, empty unless ids is set).

        starts, lengths, counts: of all its words in order; counts (those of words without a cut are used) come from the
        lockstep run. A chunk's matrix leads from the boundary states of its left cut to those of its right one: the rest of the word
        that the left one runs through, the whole words in between, and the begin of the word that the right one runs through.
        An associative scan multiplies the matrices; then the one finite way gives the state at each cut, and every chunk is
        traced back by itself.
        """
        self.scans += 1
        at = np.searchsorted(starts, cuts, "right") - 1
        held: dict[int, list[int]] = {}
        bounds: list[tuple[int, int] | None] = [None]
        for w, c in zip(at.tolist(), cuts.tolist()):
            c -= int(starts[w])
            if c:
                own = held.setdefault(w, [])
                bounds.append((w, len(own)))
                own.append(c)
            else:
                bounds.append(None)
        bounds.append(None)
        words = {w: (tuple(symbols[starts[w] : starts[w] + lengths[w]].tolist()), tuple(c)) for w, c in held.items()}
        parts = {w: self.segments(*x)[1] for w, x in words.items()}
        whole = counts.copy()
        whole[list(held)] = 0
        sums = np.concatenate([[0], np.cumsum(whole)])
        edge = [0, *np.searchsorted(starts, cuts).tolist(), len(starts)]  # the first word that begins behind each cut
        none = np.zeros((1, 1))
        matrices = []
        for j, (left, right) in enumerate(zip(bounds, bounds[1:])):
            if left and right and left[0] == right[0]:
                matrices.append(parts[right[0]][right[1]][0])
                continue
            head = parts[left[0]][left[1] + 1][0].max(axis=1)[:, None] if left else none
            tail = parts[right[0]][0][0][:1] if right else none
            matrices.append(head + (sums[edge[j + 1]] - sums[edge[j]]) + tail)
        prefix = scan(matrices)
        total = int(prefix[-1][0].max())
        if not ids:
            return total, {}
        state = [0] * len(bounds)
        for k in range(len(matrices) - 1, 0, -1):
            state[k] = int(np.argmax(prefix[k - 1][0] + matrices[k][:, state[k + 1]]))
        taken = {w: [0] for w in held}
        for b, x in zip(bounds, state):
            if b:
                taken[b[0]].append(x)
        out = {}
        for w, way in taken.items():
            way.append(int(np.argmax(parts[w][-1][0][way[-1]])))
            out[w] = self._ids(*words[w], way)
        return total, out

    def long_word(self, symbols: list[int], size: int = 4096) -> list[int]:
        """Token ids of one word of any length, by the same scan over chunks of `size` symbols."""
        n = len(symbols)
        if n == 0:
            return []
        word = np.array(symbols)
        _, found = self.giant(word, np.zeros(1, np.int64), np.array([n]), np.zeros(1, np.int64), np.arange(size, n, size), True)
        return found[0] if found else self._ids(tuple(symbols), (), [0, int(np.argmax(self.segments(tuple(symbols), ())[1][0][0][0]))])


def cuts_of(starts: np.ndarray, lengths: np.ndarray, begin: int, end: int, chunk: int, long: int) -> np.ndarray:
    """Where a text from begin to end is cut: every `chunk` symbols, and every `long` ones inside a word longer than that."""
    every = np.arange(begin + chunk, end, chunk)
    wide = np.flatnonzero(lengths > long)
    return np.unique(np.concatenate([every, *(np.arange(starts[w] + long, starts[w] + lengths[w], long) for w in wide)]))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products of an associative operation, in pairs, as a parallel machine would."""
    if len(matrices) == 1:
        return matrices[:]
    pairs = [times(matrices[k], matrices[k + 1]) for k in range(0, len(matrices) - 1, 2)]
    half = scan(pairs)
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(half[k // 2] if k % 2 else times(half[k // 2 - 1], matrices[k]))
    return out
