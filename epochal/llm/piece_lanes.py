"""The pass of piece_automaton over many words at once, one lane a word.

A batch's texts are cut where a space follows another character and at newlines, where the encoding always has a
boundary, and each different word is encoded once. The words' lanes then read one character a step together: a
trie with failure links gives the longest piece that ends there, and from the longest to the shortest the first one
compatible with the piece before it survives. The survivors are the back pointers, followed from the words' ends.
Lanes that run together share ``CELLS`` back pointers, so memory is bounded; a word so long that fewer than ``FEW``
run beside it goes to the automaton's own pass, which needs bounded memory for words of any length. A run of spaces
goes to the word after it as far as the library's rule for runs says.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .piece_automaton import MARK, PieceAutomaton

#: Back pointers of lanes that run together, lanes below which numpy doesn't pay, and bytes of text cut into words at once.
CELLS, FEW, BLOCK = 1 << 20, 25, 1 << 24


class PieceLanes:
    def __init__(self, a: PieceAutomaton):
        self.a, self.unknown, self.none = a, a.size, a.size + 1
        n = self.none + 1
        self.length, self.rank, self.real = np.ones(n, "i4"), np.full(n, -1.0), np.zeros(n, bool)
        self.left, self.right, self.chain = np.zeros(n, "i4"), np.zeros(n, "i4"), np.full(n, -1, "i4")
        chars = [p for p in a.ids if len(p) == 1]
        self.classes = np.zeros(0x110000, "i4")
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.classes[ord(" ")] = self.classes[ord(MARK)]
        self.kinds = len(chars) + 1
        usable, joins = {}, {}
        for p, i in a.ids.items():
            self.length[i], self.rank[i] = len(p), a._rank(p)
            joins |= {a.ids[p[:k]] * n + a.ids[p[k:]]: i for k in range(1, len(p)) if p[:k] in a.ids and p[k:] in a.ids}
            if (halves := a.halves(p)) != ("", "") and all(c in a.ids for c in p):
                usable[p], self.real[i] = i, True
                if halves[0]:
                    self.left[i], self.right[i] = a.ids[halves[0]], a.ids[halves[1]]
        nodes = {"": 0}
        for p in usable:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
            self.chain[usable[p]] = next((usable[p[k:]] for k in range(1, len(p)) if p[k:] in usable), -1)
        self.fail, self.out = np.zeros(len(nodes), "i4"), np.full(len(nodes), -1, "i4")
        for s, v in nodes.items():
            self.fail[v] = next((nodes[s[k:]] for k in range(1, len(s)) if s[k:] in nodes), 0)
            self.out[v] = next((usable[s[k:]] for k in range(len(s)) if s[k:] in usable), -1)
        self.edges = _sorted({nodes[s[:-1]] * self.kinds + int(self.classes[ord(s[-1])]): v for s, v in nodes.items() if s})
        self.joins = _sorted(joins)
        self.step, self.fits = _Kept(self._step, 20), _Kept(self._fits, 20)
        #: By code point: the id of an ASCII character's byte; others are spelt out in bytes at the end.
        self.ascii = np.array([a.byte_ids[b] for b in range(128)], "i4")
        self.bytes = np.array([a.byte_ids[b] for b in range(256)], "i4")
        spelt = {i: p if isinstance(p, bytes) else p.replace(MARK, " ").encode("utf-8", "surrogatepass") for i, p in a.pieces.items()}
        self.spelt = pa.array([spelt.get(i, b"") for i in range(a.size)], pa.large_binary())

    def _step(self, key: np.ndarray) -> np.ndarray:
        """The trie's node after a node and a character: the longest suffix read so far that begins a piece."""
        node, kind = np.divmod(key, self.kinds)
        to, todo = np.zeros(len(key), "i8"), np.flatnonzero(kind)
        while len(todo):
            found = _look(self.edges, node[todo] * self.kinds + kind[todo])
            to[todo] = np.maximum(found, 0)
            todo = todo[(found < 0) & (node[todo] > 0)]
            node[todo] = self.fail[node[todo]]
        return to

    def _fits(self, key: np.ndarray) -> np.ndarray:
        """PieceAutomaton.compatible, for many pairs."""
        a, b = np.divmod(key, self.none + 1)
        fits, limit = np.ones(len(key), "i8"), np.full(len(key), np.inf)
        todo = np.flatnonzero(self.real[a])
        while len(todo):
            joined = _look(self.joins, a[todo] * (self.none + 1) + b[todo])
            early = (joined >= 0) & (self.rank[joined] < limit[todo])
            fits[todo[early]] = 0
            ra, rb = self.rank[a[todo]], self.rank[b[todo]]
            on = ~early & ((ra >= 0) | (rb >= 0))
            todo, ra, rb = todo[on], ra[on], rb[on]
            x, y = todo[ra > rb], todo[ra <= rb]
            limit[x], a[x] = ra[ra > rb], self.right[a[x]]
            limit[y], b[y] = rb[ra <= rb] + 0.5, self.left[b[y]]
        return fits

    def _lanes(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has; words come from the longest to the shortest."""
        n, width = len(size), int(size[0])
        live = n - np.searchsorted(size[::-1], np.arange(width), "right")
        last = np.full((width + 1, n), self.none, "i4")
        flat = last.reshape(-1)
        node = np.zeros(n, "i8")
        for t in range(width):
            m = live[t]
            point = points[start[:m] + t]
            kind = self.classes[point]
            node = self.step(node[:m] * self.kinds + kind)
            last[t + 1, :m] = np.where(point < 128, self.ascii[np.minimum(point, 127)], self.unknown)
            todo = np.flatnonzero(kind)
            piece = self.out[node[todo]]
            while len(todo):
                if piece.min() < 0:
                    raise ValueError("no piece can end here")
                before = flat[(t + 1 - self.length[piece]).astype("i8") * n + todo]
                fits = self.fits(before.astype("i8") * (self.none + 1) + piece) > 0
                last[t + 1, todo[fits]] = piece[fits]
                todo, piece = todo[~fits], self.chain[piece[~fits]]
        back, at, count, lanes = np.empty((width, n), "i4"), size.astype("i8"), np.zeros(n, "i8"), np.arange(n)
        for k in range(width):
            piece = last[at[lanes], lanes]
            back[k, lanes] = np.where(piece == self.unknown, -1 - points[start[lanes] + at[lanes] - 1].astype("i8"), piece)
            at[lanes] -= self.length[piece]
            count[lanes] += 1
            lanes = lanes[at[lanes] > 0]
            if not len(lanes):
                break
        lane = np.repeat(np.arange(n), count)
        ids = back[np.cumsum(count)[lane] - 1 - np.arange(len(lane)), lane]
        if (odd := ids < 0).any():
            spelt = "".join(map(chr, -1 - ids[odd]))
            times = np.ones(len(ids), "i8")
            times[odd] = [len(c.encode()) for c in spelt]
            ids, odd = np.repeat(ids, times), np.repeat(odd, times)
            ids[odd] = self.bytes[np.frombuffer(spelt.encode(), "u1")]
            count = np.bincount(lane, times, n).astype("i8")
        return ids, count

    def _alone(self, word: str) -> list[int]:
        """Ids of a word that has no lane, with the space or the newline before it."""
        return [self.a.byte_ids[10], *self.a._ids(word[1:])] if word[0] == "\n" else self.a._ids(MARK + word[1:])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words, and where each word's begin and how many they are."""
        data, ends = _buffers(words)
        points = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), "u4")
        ends = np.concatenate([[0], np.cumsum((np.frombuffer(data, "u1") & 0xC0) != 0x80)])[ends]
        # All spaces of a word are at its front; a lane begins at the last of them.
        spaces = np.add.reduceat(points == 32, ends[:-1], dtype="i8")
        start = ends[:-1] + np.maximum(spaces - 1, 0)
        size = ends[1:] - start
        order = np.argsort(-size, kind="stable")
        parts, count, k = [], np.zeros(len(words), "i8"), 0
        while k < len(order):
            some = order[k : k + max(1, CELLS // int(size[order[k]]))]
            if size[some].sum() < FEW * size[some[0]] and size[some[0]] > FEW:
                some = some[:1]
                ids = np.array(self._alone(_text(points, start[some[0]], size[some[0]])), "i4")
                count[some] = len(ids)
            else:
                ids, count[some] = self._lanes(points, start[some], size[some])
            parts.append(ids)
            k += len(some)
        at = np.empty(len(words), "i8")
        at[order] = np.cumsum(count[order]) - count[order]
        ids = np.concatenate(parts)
        return self._with_runs(ids, at, count, spaces, size) if (spaces > 1).any() else (ids, at, count)

    def _with_runs(self, ids: np.ndarray, at: np.ndarray, count: np.ndarray, spaces: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same with the spaces before a word's last one. A word whose first piece is the space alone leaves that
        space to the run, as does a run with no word after it."""
        many = np.flatnonzero(spaces > 1)
        leaves = (size[many] == 1) | (ids[at[many]] == self.a.ids[MARK])
        length = spaces[many] - ~leaves
        runs = {k: np.array(self.a._run_ids(k), "i4") for k in np.unique(length).tolist()}
        parts, end = [ids], len(ids)
        for k, n, leave in zip(many.tolist(), length.tolist(), leaves.tolist(), strict=True):
            parts += [runs[n], ids[at[k] + leave : at[k] + count[k]]]
            at[k], count[k] = end, len(parts[-2]) + len(parts[-1])
            end += int(count[k])
        return np.concatenate(parts), at, count

    @staticmethod
    def marked(texts: pa.Array) -> pa.Array:
        """The texts as they are encoded: null is empty, marks are spaces, and a space is prefixed unless they are empty."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
        space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        return pc.if_else(pc.equal(texts, nothing), nothing, pc.binary_join_element_wise(space, texts, nothing))

    def batch(self, texts: pa.Array, decodes: bool = False) -> tuple[pa.Array, np.ndarray | None]:
        """Each text's list of ids and, if wanted, whether decoding them gives the text back; a block of texts at a time."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype="i8") // BLOCK)) + 1).tolist(), len(texts)]
        parts, counts, same = [np.zeros(0, "i4")], [np.zeros(0, "i8")], [np.zeros(0, bool)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            marked = self.marked(texts.slice(lo, hi - lo))
            ids, offsets = self.encode(marked)
            parts.append(ids)
            counts.append(np.diff(offsets))
            if decodes:
                same.append(self.same(ids, offsets, marked))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return pa.ListArray.from_arrays(offsets.astype("i4"), np.concatenate(parts)), np.concatenate(same) if decodes else None

    def encode(self, marked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where those of each begin (and the last end)."""
        data, ends = _buffers(marked)
        letters = np.frombuffer(data, "u1")
        edge = letters == 32
        edge[1:] &= letters[:-1] != 32
        if "\n" not in self.a.score:
            edge |= letters == 10
        edge[ends[:-1][np.diff(ends) > 0]] = True
        begins = np.flatnonzero(edge)
        bounds = np.append(begins, len(letters))
        cuts = np.searchsorted(begins, np.arange(0, len(letters), BLOCK)).tolist() + [len(begins)]
        parts, counts = [np.zeros(0, "i4")], [np.zeros(0, "i8")]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            words = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(bounds[lo : hi + 1].astype("i8")), data]).dictionary_encode()
            ids, at, count = self._words(words.dictionary)
            which = words.indices.to_numpy()
            times = count[which]
            parts.append(ids[np.repeat(at[which] - np.cumsum(times) + times, times) + np.arange(times.sum())])
            counts.append(times)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(parts), offsets[np.searchsorted(begins, ends)]

    def same(self, ids: np.ndarray, offsets: np.ndarray, marked: pa.Array) -> np.ndarray:
        """Whether decoding each text's ids gives the text back."""
        got, to = _buffers(self.spelt.take(pa.array(ids)))
        want, ends = _buffers(marked)
        got, want, to = np.frombuffer(got, "u1"), np.frombuffer(want, "u1"), to[offsets]
        if np.array_equal(to, ends) and np.array_equal(got, want):
            return np.ones(len(marked), bool)
        # Bytes that are no UTF-8 decode to U+FFFD, so texts that differ in bytes are decoded and compared again.
        return np.array([
            np.array_equal(got[to[k] : to[k + 1]], want[ends[k] : ends[k + 1]]) or self.a.decode(ids[offsets[k] : offsets[k + 1]].tolist()) == marked[k].as_py()[1:]
            for k in range(len(marked))
        ], bool)


class _Kept:
    """Values of a function of whole numbers, each kept in a slot of a fixed table until another takes it."""

    def __init__(self, f, bits: int):
        self.f, self.shift = f, np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, "i8")

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = (key.astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype("i8")
        held = self.slots[at]
        if len(miss := np.flatnonzero(held >> 24 != key)):
            held[miss] = self.slots[at[miss]] = key[miss] << 24 | self.f(key[miss])
        return held & 0xFFFFFF


def _text(points: np.ndarray, start: int, size: int) -> str:
    return points[start : start + size].tobytes().decode("utf-32-le")


def _sorted(table: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(list(table), "i8")
    order = np.argsort(keys)
    return keys[order], np.array(list(table.values()), "i8")[order]


def _look(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
    """A sorted table's values of keys, -1 for those that it lacks."""
    at = np.minimum(np.searchsorted(table[0], key), len(table[0]) - 1)
    return np.where(table[0][at] == key, table[1][at], -1)


def _buffers(column: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of a column of large strings or binaries, and where each value begins (and the last ends)."""
    if not len(column):
        return pa.py_buffer(b""), np.zeros(1, "i8")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, "i8")[column.offset : column.offset + len(column) + 1]
    return (data or pa.py_buffer(b"")).slice(int(ends[0]), int(ends[-1] - ends[0])), ends - ends[0]
