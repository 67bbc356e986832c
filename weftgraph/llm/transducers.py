"""Weighted finite-state transducers: made, composed, and read by their best path.

An arc reads one symbol, writes one symbol, has a weight and leads to a state. Weights add up along a path
and the heaviest path counts (the max-plus semiring). There are no empty symbols, so composition matches
what the first writes with what the second reads.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Transducer:
    start: object = 0
    arcs: dict = field(default_factory=dict)  # state -> symbol read -> [(symbol written, weight, state)]
    final: set = field(default_factory=set)

    def arc(self, state, read, write, weight, to) -> None:
        self.arcs.setdefault(state, {}).setdefault(read, []).append((write, weight, to))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What b makes of what a writes: the states that both reach together, and of these only
    the ones from which a final state can be reached."""
    full = Transducer((a.start, b.start))
    todo, seen = [full.start], {full.start}
    while todo:
        here = todo.pop()
        for read, ways in a.arcs.get(here[0], {}).items():
            for middle, w1, s1 in ways:
                for write, w2, s2 in b.arcs.get(here[1], {}).get(middle, ()):
                    there = (s1, s2)
                    full.arc(here, read, write, w1 + w2, there)
                    if there not in seen:
                        seen.add(there)
                        todo.append(there)
    full.final = {s for s in seen if s[0] in a.final and s[1] in b.final}
    back: dict = {}
    for s, by in full.arcs.items():
        for ways in by.values():
            for _, _, to in ways:
                back.setdefault(to, set()).add(s)
    live, todo = set(full.final), list(full.final)
    while todo:
        for s in back.get(todo.pop(), ()):
            if s not in live:
                live.add(s)
                todo.append(s)
    number = {s: k for k, s in enumerate([full.start, *sorted((s for s in live if s != full.start), key=repr)])}
    out = Transducer(0, final={number[s] for s in full.final})
    for s, by in full.arcs.items():
        for read, ways in by.items():
            for write, weight, to in ways:
                if s in number and to in live:
                    out.arc(number[s], read, write, weight, number[to])
    return out


def best(t: Transducer, symbols: list) -> tuple[float, list] | None:
    """Weight and output of the heaviest path over symbols that ends in a final state (of equal ones the
    first by its output); None if there is none."""
    at = {t.start: (0.0, None)}  # state -> weight, linked output
    for x in symbols:
        new: dict = {}
        for state, (weight, trail) in at.items():
            for write, w, to in t.arcs.get(state, {}).get(x, ()):
                old = new.get(to)
                if old is None or weight + w > old[0]:
                    new[to] = (weight + w, (trail, write))
        at = new
    ends = [v for s, v in at.items() if s in t.final]
    if not ends:
        return None
    weight, trail = max(ends, key=lambda v: v[0])
    out = []
    while trail is not None:
        trail, x = trail
        out.append(x)
    return weight, out[::-1]


def paths(t: Transducer, symbols: list) -> list[tuple[float, list]]:
    """Weight and output of every path over symbols that ends in a final state."""
    found = [(0.0, [], t.start)]
    for x in symbols:
        found = [(w + v, [*out, write], to) for w, out, s in found for write, v, to in t.arcs.get(s, {}).get(x, ())]
    return [(w, out) for w, out, s in found if s in t.final]


class Trie:
    """A finite-state reader of words by their letters: entries that a word begins with (stems) or is (words)."""

    def __init__(self, stems: dict[str, str], words: dict[str, str]):
        self.root: dict = {}
        for table, mark in ((stems, "stem"), (words, "word")):
            for text, symbol in table.items():
                node = self.root
                for c in text:
                    node = node.setdefault(c, {})
                node[mark] = symbol

    def read(self, word: str, other: str) -> str:
        """The symbol of a whole word, else of the longest stem that it begins with, else other."""
        node, found = self.root, other
        for c in word:
            node = node.get(c)
            if node is None:
                return found
            found = node.get("stem", found)
        return node.get("word", found)
