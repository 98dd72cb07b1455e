"""A bidirectional index over delimited words, and search schemes of two halves with one error.

The text is ``#w1#w2#...#wk#`` with the words in code-point order.  Suffix ranks of the text and of its reverse are kept
as Burrows-Wheeler columns; a match is an interval of ranks in both, and a step to either side narrows both.  Words are
distinct, so the interval of ``#w#`` is one rank, and that rank is the word's place in the order.
"""

from __future__ import annotations

import numpy as np

END, DELIMITER = 0, 1
# Widest interval whose column is read through instead of counted by symbol, and states expanded at once.
READ, STATES = 48, 1 << 14


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling from eight symbols; the last symbol is unique and the smallest."""
    n = len(text)
    bits = int(text.max()).bit_length() or 1
    span = max(1, 62 // bits)
    padded = np.concatenate([text.astype(np.int64), np.zeros(span, np.int64)])
    packed = np.zeros(n, np.int64)
    for k in range(span):
        packed = packed << bits | padded[k:k + n]
    while True:
        order = np.argsort(packed, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(packed[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        later[:max(0, n - span)] = rank[span:] + 1
        packed, span = rank * (n + 1) + later, 2 * span


class Direction:
    """Steps in one direction: the column before each suffix and where its symbols stand among the suffixes."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_array(text)
        self.n, self.symbols = len(text), symbols
        self.column = text[order - 1]
        by_symbol = np.argsort(self.column, kind="stable")
        # The number of keys below (symbol, place) is the rank to which an interval that starts at that place moves.
        self.keys = self.column[by_symbol].astype(np.int64) * (self.n + 1) + by_symbol
        self.moved = np.empty(self.n, np.int64)
        self.moved[by_symbol] = np.arange(self.n)

    def to(self, symbol, place) -> np.ndarray:
        return np.searchsorted(self.keys, symbol * (self.n + 1) + place)

    def every(self, low, other, size):
        """All steps from the intervals: (state, symbol, low, other, size)."""
        narrow = np.flatnonzero(size <= READ)
        wide = np.flatnonzero(size > READ)
        state, places = spread(low[narrow], size[narrow])
        order = np.argsort(state * self.symbols + self.column[places], kind="stable")
        state, places = state[order], places[order]
        symbol = self.column[places]
        first = np.flatnonzero(np.concatenate([[True], (state[1:] != state[:-1]) | (symbol[1:] != symbol[:-1])])) if len(state) else state
        begin = np.cumsum(size[narrow]) - size[narrow]
        found = [(narrow[state[first]], symbol[first], self.moved[places[first]],
                  other[narrow[state[first]]] + first - begin[state[first]], np.diff(np.append(first, len(state))))]
        for part in np.array_split(wide, max(1, len(wide) * self.symbols >> 20)):
            symbols = np.arange(self.symbols)
            start = self.to(symbols, low[part, None])
            count = self.to(symbols, (low + size)[part, None]) - start
            before = np.cumsum(count, axis=1) - count
            s, c = np.nonzero(count)
            found.append((part[s], c, start[s, c], other[part[s]] + before[s, c], count[s, c]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def one(self, symbol, low, other, size):
        """The step with ``symbol`` from each interval that has it: (state, low, other, size)."""
        narrow = np.flatnonzero(size <= READ)
        wide = np.flatnonzero(size > READ)
        begin = np.cumsum(size[narrow]) - size[narrow]
        state, places = spread(low[narrow], size[narrow])
        here, wanted = self.column[places], symbol[narrow][state]
        count = np.add.reduceat(here == wanted, begin, dtype=np.int64) if len(narrow) else begin
        before = np.add.reduceat(here < wanted, begin, dtype=np.int64) if len(narrow) else begin
        has = np.flatnonzero(count)
        at = narrow[has]
        found = [(at, self.to(symbol[at], low[at]), other[at] + before[has], count[has])]
        for part in np.array_split(wide, max(1, len(wide) * self.symbols >> 20)):
            steps = self.every(low[part], other[part], size[part])
            mine = steps[1] == symbol[part][steps[0]]
            found.append((part[steps[0][mine]], *(x[mine] for x in steps[2:])))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def spread(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval its number, and all its places, one after another."""
    state = np.repeat(np.arange(len(low)), size)
    return state, np.arange(len(state)) - np.repeat(np.cumsum(size) - size - low, size)


class WordIndex:
    """Bidirectional index of distinct words in code-point order; a direction is built when it is first used."""

    def __init__(self, words: list[str]):
        points = code_points(words)
        self.alphabet = np.unique(points)
        self.symbols = len(self.alphabet) + 3
        ends = np.cumsum([len(w) for w in words])
        self.text = np.append(np.insert(self.codes(points), np.concatenate([[0], ends]), DELIMITER), END)
        self.built: dict[bool, Direction] = {}

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Dense symbols from 2 on; a point outside the alphabet gets the last symbol, which occurs nowhere."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 2, self.symbols - 1)

    def direction(self, rightward: bool) -> Direction:
        if rightward not in self.built:
            text = np.append(self.text[:-1][::-1], END) if rightward else self.text
            self.built[rightward] = Direction(text, self.symbols)
        return self.built[rightward]

    def near(self, words: list[str], rightward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, rank of an indexed word) that differ by one inserted, deleted or replaced symbol.

        ``rightward``: the first half stands exactly and the error is in the second; else the other way round.
        """
        found = [self._near(words[i:i + STATES], rightward, i) for i in range(0, len(words), STATES)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def _near(self, words, rightward, first):
        index = self.direction(rightward)
        length = np.array([len(w) for w in words])
        exact = (length // 2 if rightward else length - length // 2) + 1
        start = np.cumsum(length + 2) - length - 2
        pattern = np.full(int((length + 2).sum()), DELIMITER)
        read = words if rightward else [w[::-1] for w in words]
        pattern[np.delete(np.arange(len(pattern)), np.concatenate([start, start + length + 1]))] = self.codes(code_points(read))

        # Halves that several words share are matched once.
        halves: dict[str, int] = {}
        which = np.array([halves.setdefault(w[:e - 1], len(halves)) for w, e in zip(read, exact.tolist(), strict=True)])
        model = np.unique(which, return_index=True)[1]
        k = len(model)
        low, other, size = np.zeros(k, np.int64), np.zeros(k, np.int64), np.full(k, index.n)
        alive = np.arange(k)
        for j in range(int(exact.max())):
            go = alive[exact[model[alive]] > j]
            kept, *after = index.one(pattern[start[model[go]] + j], low[go], other[go], size[go])
            size[go] = 0
            low[go[kept]], other[go[kept]], size[go[kept]] = after
            alive = np.flatnonzero(size)
        q = np.flatnonzero(size[which] > 0)
        state = (q, exact[q], low[which[q]], other[which[q]], size[which[q]], np.zeros(len(q), bool))

        done = []
        while len(state[0]):
            q, j, low, other, size, erred = state
            more = np.flatnonzero(~erred & (j <= length[q]))
            state = [np.concatenate([x, x[more]]) for x in state]
            state[1][len(q):] += 1
            state[5][len(q):] = True
            q, j, low, other, size, erred = state
            need = pattern[start[q] + j]
            free, bound = np.flatnonzero(~erred), np.flatnonzero(erred)
            s, *after = index.one(need[bound], low[bound], other[bound], size[bound])
            s = bound[s]
            steps = [(q[s], j[s] + 1, *after, np.ones(len(s), bool))]
            s, c, *after = index.every(low[free], other[free], size[free])
            s = free[s]
            match, letter = c == need[s], c > DELIMITER
            for take, ahead, error in ((match, 1, False), (~match & letter & (need[s] > DELIMITER), 1, True), (letter, 0, True)):
                steps.append((q[s][take], j[s][take] + ahead, *(x[take] for x in after), np.full(int(take.sum()), error)))
            state = [np.concatenate(x) for x in zip(*steps, strict=True)]
            ended = state[1] == length[state[0]] + 2
            hit = ended & state[5]
            rank = state[3] if rightward else state[2]
            done.append(np.stack([state[0][hit] + first, rank[hit] - 2]))
            state = [x[~ended] for x in state]
        pairs = np.unique(np.concatenate(done, axis=1), axis=1) if done else np.zeros((2, 0), np.int64)
        return pairs[0], pairs[1]


def code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
