"""A lexicon trie intersected with Levenshtein automata: one deterministic automaton for all entries.

A state is the set of (trie node, edits) that a word's beginning can have led to, with the fewest edits for each
node. Substitution, insertion and omission of one character are edits, and so is the exchange of two
neighbours, for which a state also holds the character that must come next. A stem is found as soon as a
word's beginning matches it; any ending may follow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Entries shorter than this must match to the letter: one edit of a short word is often another word.
FUZZY_FROM = 4
#: The same for stems, whose ends are open.
FUZZY_STEM_FROM = 6
#: Edits allowed in longer entries.
EDITS = 1


@dataclass(frozen=True)
class Entry:
    text: str
    stem: bool

    @property
    def edits(self) -> int:
        return EDITS if len(self.text) >= (FUZZY_STEM_FROM if self.stem else FUZZY_FROM) else 0


class LexiconAutomaton:
    """``run`` gives for each word 2 * entry + edits of its best match, or -1."""

    def __init__(self, entries: list[Entry]):
        self.entries = entries
        children: list[dict[str, int]] = [{}]
        ends: list[int] = [-1]
        roots = {}
        for number, entry in enumerate(entries):
            node = roots.setdefault((entry.edits, entry.stem), None)
            if node is None:
                roots[entry.edits, entry.stem] = node = len(children)
                children.append({})
                ends.append(-1)
            for c in entry.text:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            if ends[node] < 0:
                ends[node] = number
        budget = [0] * len(children)
        stem = [False] * len(children)
        for (edits, is_stem), root in roots.items():
            todo = [root]
            while todo:
                node = todo.pop()
                budget[node], stem[node] = edits, is_stem
                todo += children[node].values()

        def closed(states: dict[tuple[int, str], int]) -> dict[tuple[int, str], int]:
            """Omissions cost no character."""
            todo = [(node, e) for (node, due), e in states.items() if not due]
            while todo:
                node, e = todo.pop()
                if e < budget[node]:
                    for child in children[node].values():
                        if states.get((child, ""), 9) > e + 1:
                            states[child, ""] = e + 1
                            todo.append((child, e + 1))
            return states

        def step(states: dict[tuple[int, str], int], c: str | None) -> dict[tuple[int, str], int]:
            """After one more character, None for one that no entry has; ``due`` is what an exchange still needs."""
            after: dict[tuple[int, str], int] = {}

            def reach(node: int, due: str, e: int) -> None:
                if after.get((node, due), 9) > e:
                    after[node, due] = e

            for (node, due), e in states.items():
                if due:
                    if due == c:
                        reach(node, "", e)
                    continue
                if c in children[node]:
                    reach(children[node][c], "", e)
                if e < budget[node]:
                    reach(node, "", e + 1)
                    for first, child in children[node].items():
                        reach(child, "", e + 1)
                        if first != c and c in children[child]:
                            reach(children[child][c], first, e + 1)
            return closed(after)

        def best(states: dict[tuple[int, str], int], stems: bool) -> int:
            found = [(e, ends[node]) for (node, due), e in states.items() if not due and ends[node] >= 0 and stem[node] == stems]
            return 2 * min(found)[1] + min(found)[0] if found else -1

        def better(a: int, b: int) -> int:
            return b if a < 0 else a if b < 0 else min(a, b, key=lambda v: (v & 1, v))

        letters = sorted({c for entry in entries for c in entry.text})
        place = {c: k + 1 for k, c in enumerate(letters)}
        self.classes = np.zeros(0x110000, np.int16)
        for c, k in place.items():
            self.classes[ord(c)] = k
        start = closed({(root, ""): 0 for root in roots.values()})
        key = lambda states, kept: (tuple(sorted(states.items())), kept)
        numbers = {key({}, -1): 0}  # state 0: nothing can match any more
        rows = [[0] * (len(letters) + 1)]
        results = [-1]
        queue = []

        def number_of(states: dict[tuple[int, str], int], kept: int) -> int:
            kept = better(kept, best(states, True))
            if kept >= 0 and not kept & 1:
                states = {}  # a stem to the letter: nothing better can come
            k = key(states, kept)
            if k not in numbers:
                numbers[k] = len(rows)
                rows.append([numbers[k] if not states else 0] * (len(letters) + 1))
                results.append(better(kept, best(states, False)))
                if states:
                    queue.append((states, kept, numbers[k]))
            return numbers[k]

        self.start = number_of(start, -1)
        while queue:
            states, kept, number = queue.pop()
            other = number_of(step(states, None), kept)
            row = rows[number] = [other] * (len(letters) + 1)
            near = {due for _, due in states if due}
            for (node, due), e in states.items():
                if not due:
                    near.update(children[node])
                    if e < budget[node]:
                        for child in children[node].values():
                            near.update(children[child])
            for c in near:
                row[place[c]] = number_of(step(states, c), kept)
        self.table = np.array(rows, np.int32)
        self.results = np.array(results, np.int32)

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """All words at once, a character at a time; words that can't match any more drop out, most after a few."""
        out = np.full(len(starts), -1, np.int32)
        word, at, stop = np.arange(len(starts)), starts.copy(), ends
        state = np.full(len(starts), self.start, np.int32)
        while len(word):
            state = self.table[state, self.classes[codes[at]]]
            at = at + 1
            over = at == stop
            out[word[over]] = self.results[state[over]]
            on = ~over & (state > 0)
            word, at, stop, state = word[on], at[on], stop[on], state[on]
        return out
