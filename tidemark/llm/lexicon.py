"""A minimal acyclic transducer from words to token ids, kept as flat arrays that are memory-mapped for lookups."""

from __future__ import annotations

import tempfile

import numpy as np


class _State:
    __slots__ = ("arcs", "final", "number", "below")

    def __init__(self):
        self.arcs, self.final, self.number, self.below = {}, False, -1, 0

    def key(self):
        return self.final, tuple((b, id(s)) for b, s in self.arcs.items())


def compiled(words: list[bytes], ids: list[bytes]) -> bytes:
    """The transducer of distinct words, each with its ids as little-endian unsigned 32-bit bytes, as one block of bytes.

    Words are added in order; a state whose arcs can no longer change is merged with an equal one, so suffixes are shared. An arc
    carries how many words come before it among its state's words: the sum along a path is the word's place in the table of ids.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict = {}
    root = _State()
    path: list[tuple[_State, int, _State]] = []

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, label, child = path.pop()
            parent.arcs[label] = register.setdefault(child.key(), child)

    last = b""
    for i in order:
        word = words[i]
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle(same)
        state = path[-1][2] if path else root
        for label in word[same:]:
            state.arcs[label] = new = _State()
            path.append((state, label, new))
            state = new
        state.final, last = True, word
    settle(0)

    states: list[_State] = []
    stack = [(root, False)]
    while stack:  # children before parents, so that the words below each are known
        s, ready = stack.pop()
        if ready:
            if s.number < 0:
                s.number, s.below = len(states), s.final + sum(c.below for c in s.arcs.values())
                states.append(s)
        elif s.number < 0:
            stack.append((s, True))
            stack += [(c, False) for c in s.arcs.values() if c.number < 0]
    keys, targets, outputs = [], [], []
    for s in states:
        before = int(s.final)
        for label, c in s.arcs.items():
            keys.append(s.number << 8 | label)
            targets.append(c.number)
            outputs.append(before)
            before += c.below
    by_key = np.argsort(np.array(keys, np.int64), kind="stable")
    pool = b"".join(ids[i] for i in order)
    ends = np.cumsum([0, *(len(ids[i]) // 4 for i in order)])
    parts = [np.array(keys, "<i8")[by_key], np.array(targets, "<i8")[by_key], np.array(outputs, "<i8")[by_key], np.array([s.final for s in states], "<i8"), ends.astype("<i8")]
    head = np.array([root.number, *map(len, parts)], "<i8")
    return b"".join([*(x.tobytes() for x in (head, *parts)), pool])


class Lexicon:
    """Lookups in what compiled() made. The block goes to an unnamed file of the executor and is mapped from there."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            data = np.asarray(np.memmap(f, np.uint8, "r"))  # views of it are still mapped
        self.root, *sizes = data[:48].view("<i8").tolist()
        at, parts = 48, []
        for n in sizes:
            parts.append(data[at : at + 8 * n].view("<i8"))
            at += 8 * n
        self.keys, self.targets, self.outputs, self.final, self.ends = parts
        self.raw = memoryview(data[at:])
        self.states = len(self.final)

    def find(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian unsigned 32-bit) of those of the words that the lexicon has; all words walk in step."""
        if not words or not len(self.keys):
            return {}
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        live = np.arange(len(words))
        state, place = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        hits, depth = [], 0
        while live.size:
            over = size[live] == depth
            done = live[over]
            hits.append(done[self.final[state[done]] > 0])
            live = live[~over]
            if not live.size:
                break
            key = state[live] << 8 | flat[start[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[arc] == key
            live, arc = live[known], arc[known]
            state[live] = self.targets[arc]
            place[live] += self.outputs[arc]
            depth += 1
        found = np.concatenate(hits)
        starts, ends = (4 * self.ends[place[found]]).tolist(), (4 * self.ends[place[found] + 1]).tolist()
        return {words[i]: bytes(self.raw[a:z]) for i, a, z in zip(found.tolist(), starts, ends, strict=True)}
