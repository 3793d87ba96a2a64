"""Regular expressions to one minimal deterministic automaton over bytes, and its vectorised run.

A small regex dialect (literals, classes, groups, |, ?, *, +, {m,n}, per-rule case folding) is parsed,
turned into a Thompson automaton, determinised by subset construction over byte classes and minimised by
partition refinement. The result is a transition array and, for each state, the bit mask of the rules
that accept there, so that one pass over the bytes serves all rules.
"""

from __future__ import annotations

import numpy as np

ANY = frozenset(range(256))


class _Parser:
    """Recursive descent; nodes: ("set", bytes), ("cat", [..]), ("alt", [..]), ("rep", node, least, most)."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def parse(self):
        node = self.alt()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return node

    def alt(self):
        parts = [self.cat()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def peek(self):
        return self.p[self.i] if self.i < len(self.p) else ""

    def cat(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat(self.atom()))
        return ("cat", parts)

    def repeat(self, node):
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, _, high = self.p[self.i : end].partition(",")
                least = int(low)
                most = least if "," not in self.p[self.i : end] else int(high) if high else None
                self.i = end + 1
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, least, most)
        return node

    def byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        e = self.p[self.i]
        self.i += 1
        if e == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(e, ord(e))

    def folded(self, chars: set[int]) -> frozenset[int]:
        if self.fold:
            for c in list(chars):
                if 65 <= c <= 90 or 97 <= c <= 122:
                    chars.add(c ^ 32)
        return frozenset(chars)

    def atom(self):
        c = self.peek()
        if c == "(":
            self.i += 3 if self.p.startswith("(?:", self.i) else 1
            node = self.alt()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.p!r}")
            self.i += 1
            return node
        if c == ".":
            self.i += 1
            return ("set", ANY - {10})
        if c == "[":
            self.i += 1
            negate = self.peek() == "^"
            self.i += negate
            chars: set[int] = set()
            while self.peek() != "]":
                low = self.byte()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    chars |= set(range(low, self.byte() + 1))
                else:
                    chars.add(low)
            self.i += 1
            got = self.folded(chars)
            return ("set", ANY - got if negate else got)
        return ("set", self.folded({self.byte()}))


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Builds node from start; returns its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.step[start] = (node[1], end)
            return end
        if kind == "cat":
            for part in node[1]:
                fresh = self.state()
                self.empty[start].append(fresh)
                start = self.add(part, fresh)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                fresh = self.state()
                self.empty[start].append(fresh)
                self.empty[self.add(part, fresh)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            fresh = self.state()
            self.empty[start].append(fresh)
            start = self.add(inner, fresh)
        end = self.state()
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            fresh = self.state()
            self.empty[loop] += [fresh, end]
            self.empty[self.add(inner, fresh)].append(loop)
        else:
            for _ in range(most - least):
                fresh = self.state()
                self.empty[start] += [fresh, end]
                start = self.add(inner, fresh)
            self.empty[start].append(end)
        return end


class Automaton:
    """next: states x classes, cls: byte to class, accept: rule mask of each state, start: its number.

    search: the automaton may begin a match at every byte (an unanchored scan); else only at the first.
    State 0 is the one without hope in an anchored automaton, and the start in a searching one.
    """

    def __init__(self, rules: list[tuple[str, bool]], search: bool, reverse: bool = False):
        nfa, first, ends = _Nfa(), [], {}
        for rule, (pattern, fold) in enumerate(rules):
            node = _Parser(pattern, fold).parse()
            begin = nfa.state()
            first.append(begin)
            ends[nfa.add(_turned(node) if reverse else node, begin)] = rule
        self._classes(nfa)
        self._determinise(nfa, first, ends, search)
        self._minimise()
        #: Bytes after which every state is the start: a text can be cut there and scanned in parts.
        back = (self.next == self.start).all(axis=0) if search else np.zeros(self.next.shape[1], bool)
        self.resets = back[self.cls]

    def _classes(self, nfa: _Nfa) -> None:
        sets = {s for s in (x[0] for x in nfa.step if x)}
        keys = [tuple(b in s for s in sets) for b in range(256)]
        number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        self.cls = np.array([number[k] for k in keys], np.uint8)
        self._sample = [keys.index(k) for k in number]

    def _determinise(self, nfa: _Nfa, first: list[int], ends: dict[int, int], search: bool) -> None:
        def closed(states) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(s for s in seen if nfa.step[s] or s in ends)

        begin = closed(first)
        number, todo, rows = {begin: 0}, [begin], []
        while todo:
            now = todo.pop(0)
            row = []
            for byte in self._sample:
                to = {nfa.step[s][1] for s in now if nfa.step[s] and byte in nfa.step[s][0]}
                after = closed(to | set(first)) if search else closed(to)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row.append(number[after])
            rows.append(row)
        self.next = np.array(rows, np.int32)
        self.accept = np.array([sum(1 << r for r in {ends[s] for s in states if s in ends}) for states in number], np.int64)
        self.start = 0

    def _minimise(self) -> None:
        """Moore's refinement: states stay together while they accept alike and step into the same groups."""
        group = np.unique(self.accept, return_inverse=True)[1].reshape(-1)
        while True:
            mark = np.column_stack([group, group[self.next]])
            new = np.unique(mark, axis=0, return_inverse=True)[1].reshape(-1)
            if new.max() == group.max():
                break
            group = new
        _, keep = np.unique(group, return_index=True)
        self.next, self.accept, self.start = group[self.next[keep]].astype(np.int32), self.accept[keep], int(group[self.start])

    def longest(self, data: bytes, at: int, end: int | None = None) -> int:
        """End of the longest match of an anchored automaton at that place, before end; -1: none."""
        table, cls, accept, state, found = self.lists(), self._cls_bytes, self._accept_list, self.start, -1
        if accept[state]:
            found = at
        for i in range(at, len(data) if end is None else end):
            state = table[state][cls[data[i]]]
            if accept[state]:
                found = i + 1
            elif state == self._dead:
                break
        return found

    def leftmost(self, data: bytes, end: int, low: int) -> int:
        """Of an anchored automaton of turned rules: the first place from low on at which a match begins that ends there; -1: none."""
        table, cls, accept, state, found = self.lists(), self._cls_bytes, self._accept_list, self.start, -1
        for i in range(end - 1, low - 1, -1):
            state = table[state][cls[data[i]]]
            if accept[state]:
                found = i
            elif state == self._dead:
                break
        return found

    def lists(self):
        """The transition array as nested lists, which Python's own loop reads faster."""
        if not hasattr(self, "_lists"):
            self._lists, self._cls_bytes, self._accept_list = self.next.tolist(), self.cls.tobytes(), self.accept.tolist()
            dead = np.flatnonzero((self.next == np.arange(len(self.next))[:, None]).all(axis=1) & (self.accept == 0))
            self._dead = int(dead[0]) if len(dead) else -1
        return self._lists

    def masks(self, data: np.ndarray, offsets: np.ndarray, piece: int = 1024) -> np.ndarray:
        """For each text data[offsets[i]:offsets[i+1]], the rules that accept somewhere in it."""
        out = np.zeros(len(offsets) - 1, np.int64)
        ends, masks = self.hits(data, offsets, piece)
        np.bitwise_or.at(out, np.searchsorted(offsets, ends, "left") - 1, masks)
        return out

    def hits(self, data: np.ndarray, offsets: np.ndarray, piece: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Where rules accept (the place after the last byte, ascending) in texts data[offsets[i]:offsets[i+1]], and which, in one pass.

        Texts are cut at bytes that lead every state back to the start, into parts of about piece bytes
        (longer where there is no such byte), and all parts step through the array together.
        """
        none = np.zeros(0, np.int64)
        if len(offsets) < 2 or offsets[-1] == offsets[0]:
            return none, none
        begin, end = self._parts(data, offsets, piece)
        order = np.argsort(begin - end, kind="stable")
        begin, end = begin[order], end[order]
        width = self.next.shape[1]
        flat = np.ascontiguousarray(self.next * width).ravel().astype(np.int32)
        accepts = np.zeros(flat.size, np.int64)
        accepts[::width] = self.accept
        any_accept = accepts != 0
        state = np.full(len(begin), self.start * width, np.int32)
        classes, lengths, at = self.cls[data], end - begin, begin.copy()
        alive, places, masks = len(begin), [none], [none]
        for t in range(int(lengths[0])):
            while lengths[alive - 1] <= t:
                alive -= 1
            state[:alive] = flat[state[:alive] + classes[at[:alive]]]
            at[:alive] += 1
            hit = any_accept[state[:alive]]
            if hit.any():
                i = np.flatnonzero(hit)
                places.append(at[i])
                masks.append(accepts[state[i]])
        places, masks = np.concatenate(places), np.concatenate(masks)
        order = np.argsort(places, kind="stable")
        return places[order], masks[order]

    def _parts(self, data, offsets, piece):
        begin, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        long = (end - begin) > 2 * piece
        cuts = np.flatnonzero(self.resets[data]) + 1 if long.any() else None
        b, e = [begin[~long]], [end[~long]]
        for i in np.flatnonzero(long):
            wanted = np.arange(begin[i] + piece, end[i], piece)
            at = np.searchsorted(cuts, wanted)
            at = np.unique(cuts[at[at < len(cuts)]])
            at = at[at < end[i]]
            b.append(np.concatenate([[begin[i]], at]))
            e.append(np.concatenate([at, [end[i]]]))
        b, e = np.concatenate(b), np.concatenate(e)
        return b[e > b], e[e > b]


def _turned(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", [_turned(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [_turned(x) for x in node[1]])
    if kind == "rep":
        return ("rep", _turned(node[1]), *node[2:])
    return node
