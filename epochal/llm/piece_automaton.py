"""A pair-merging piece vocabulary compiled, as it is used, into a deterministic transducer.

Reading a text from the left, the encoding of every prefix ends in exactly one piece that is compatible with the
piece that the shorter prefix ends in (two pieces are compatible if encoding their concatenation gives them
back). The boundaries at which a longer piece may still have begun, each with the piece before it, decide the
next one: they are the state. A transition reads a code point and is annotated with the change in the number of
emitted pieces. Characters outside the vocabulary fall back to bytes and set the automaton back to its start.
"""

from __future__ import annotations

from itertools import chain

import sentencepiece

MARK = "▁"
#: States and words kept by one task; beyond it they are forgotten and compiled again when met.
KEEP = 200_000


class PieceAutomaton:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.ids, self.score, self.byte_ids, self.special = {}, {}, {}, set()
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.special.add(i)
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
        self.pieces = {i: p for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        #: By id; a byte that is no character by itself has no entry.
        self.plain = {i: p if isinstance(p, str) else p.decode() for i, p in self.pieces.items() if isinstance(p, str) or p < b"\x80"}
        self.width = max(map(len, self.ids))
        self.stems = {p[:i] for p in self.ids for i in range(1, len(p))}
        self.run = max((len(p) for p in self.ids if set(p) == {MARK}), default=1)
        if len(self.byte_ids) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids) or any(p.startswith(2 * MARK) and p.strip(MARK) for p in self.ids):
            raise ValueError("the vocabulary must have all bytes, and spaces only at the start of pieces or in runs")
        self.fits: dict[tuple[str, str], bool] = {}
        self.made: dict[str, tuple[str, str]] = {}
        self.rests: dict[int, list[str]] = {}
        self._forget()
        self.words, self.inner = _Memo(lambda w: self.count(MARK + w)), _Memo(self.count)
        self.word_ids, self.inner_ids = _Memo(lambda w: self._ids(MARK + w)), _Memo(self._ids)
        self.opening = _Memo(lambda w: self.split(MARK + w)[0] != MARK)

    def _forget(self) -> None:
        self.windows: list[tuple] = [(("", "", 0),)]
        self.names: dict[tuple, int] = {self.windows[0]: 0}
        self.arcs: list[dict[str, tuple[int, int, str]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """The encoding by its definition: the best scored pair is merged first, of equals the leftmost."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def halves(self, piece: str) -> tuple[str, str]:
        """The two pieces whose merge made this one, as far as it is made by merges."""
        if (known := self.made.get(piece)) is None:
            parts = list(piece)
            known = ("", piece)
            while len(parts) > 1:
                best = max(((self.score[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.score), default=None)
                if best is None:
                    known = ("", "")
                    break
                i = -best[1]
                known = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.made[piece] = known
        return known

    def _rank(self, piece: str) -> float:
        return -self.score[piece] if len(piece) > 1 else -1

    def compatible(self, a: str, b: str) -> bool:
        """Whether encoding ``a + b`` gives the two back. Their merges are undone from the latest to the earliest;
        a merge across the boundary that would have come before an undone one shows that it doesn't."""
        if self.halves(b) == ("", "") or (a and self.halves(a) == ("", "")):
            return False
        if not a:
            return True
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) > 4 * KEEP:
                self.fits.clear()
            known = self.fits[a, b] = self._undone(a, b)
        return known

    def _undone(self, a: str, b: str) -> bool:
        limit = float("inf")
        while True:
            if (joined := a + b) in self.score and self._rank(joined) < limit:
                return False
            ra, rb = self._rank(a), self._rank(b)
            if ra < 0 and rb < 0:
                return True
            # Equal ranks: the left one was merged first, so the right one is undone first, and a merge across
            # the boundary that ties with it came before it.
            if ra > rb:
                limit, a = ra, self.halves(a)[1]
            else:
                limit, b = rb + 0.5, self.halves(b)[0]

    def _next(self, window: tuple, char: str) -> tuple[tuple, str, int]:
        """From the open boundaries after one more character: the next ones, the piece in which the encoding now
        ends, and how many more pieces it has."""
        for text, before, n in window:
            if (piece := text + char) in self.score and self.compatible(before, piece):
                more = n + 1
                after = [(t, p, m - more) for old, p, m in window if (t := old + char) in self.stems]
                return (*after, ("", piece, 0)), piece, more
        raise ValueError(f"no piece can end at {char!r}")

    def _compile(self, state: int, char: str) -> tuple[int, int, str]:
        """The transition: the next state, the change in the number of pieces and the last piece."""
        if char not in self.score:
            arc = (0, len(char.encode("utf-8", "surrogatepass")), char)
        else:
            after, piece, more = self._next(self.windows[state], char)
            to = self.names.setdefault(after, len(self.windows))
            if to == len(self.windows):
                self.windows.append(after)
                self.arcs.append({})
            arc = (to, more, piece)
        self.arcs[state][char] = arc
        return arc

    def count(self, text: str) -> int:
        """How many pieces a text without a space inside has (it may begin with one)."""
        if len(self.windows) > KEEP:
            self._forget()
        state, total, arcs = 0, 0, self.arcs
        for char in text:
            arc = arcs[state].get(char) or self._compile(state, char)
            state = arc[0]
            total += arc[1]
        return total

    def split(self, text: str) -> list[str]:
        """The pieces of such a text: a streaming Viterbi pass that keeps one surviving piece for each of the
        last positions and commits what lies before the boundary on which all of them converge."""
        if len(self.windows) > KEEP:
            self._forget()
        done: list[str] = []
        pending: list[str] = []
        state, arcs = 0, self.arcs
        for char in text:
            state, _, piece = arcs[state].get(char) or self._compile(state, char)
            pending.append(piece)
            if len(pending) >= 64 * self.width:
                keep = self._converged(pending)
                done += self._trace(pending[:keep])
                pending = pending[keep:]
        return done + self._trace(pending)

    def _trace(self, last: list[str]) -> list[str]:
        found, at = [], len(last)
        while at:
            found.append(last[at - 1])
            at -= len(found[-1])
        return found[::-1]

    def _converged(self, last: list[str]) -> int:
        """The last boundary on the backward paths from every position that a coming piece may follow."""
        heads = set(range(max(0, len(last) - self.width) + 1, len(last) + 1))
        while len(heads) > 1:
            far = max(heads)
            heads.remove(far)
            heads.add(far - len(last[far - 1]))
        return heads.pop()

    def spaces(self, k: int) -> int:
        return k // self.run + len(self._rest(k % self.run))

    def _rest(self, k: int) -> list[str]:
        """The pieces of a run of spaces shorter than the longest; longer runs begin with the longest pieces."""
        if (known := self.rests.get(k)) is None:
            known = self.rests[k] = self.merged(MARK * k)
        return known

    def count_text(self, text: str) -> int:
        """The number of pieces of a whole text, to which a space is prefixed."""
        return self._count(text.replace(MARK, " "), True) if text else 0

    def _count(self, text: str, prefixed: bool) -> int:
        total = 0
        lines = text.split("\n") if "\n" not in self.score else [text]
        for i, line in enumerate(lines):
            words = line.split(" ")
            if i or not prefixed:
                total += bool(i) + (self.inner[words[0]] if words[0] else 0)
                words = words[1:]
            if "" not in words:
                total += sum(map(self.words.__getitem__, words))
                continue
            k = 0
            for w in words:
                k += 1
                if w:
                    total += self.words[w] + (0 if k == 1 else self.spaces(k - 1) if self.opening[w] else self.spaces(k) - 1)
                    k = 0
            total += self.spaces(k)
        return total

    # A chunk's map from the state before it to the count and the state after it. Whatever came before, the state
    # is known at a space that follows another character, so the map is (head, count, tail): the text up to the
    # first such space, the pieces between, the text from the last one; tail is None while there is none.
    def chunk_map(self, piece: str) -> tuple[str, int, str | None]:
        piece = piece.replace(MARK, " ")
        first = self._edge(piece, False)
        if first is None:
            return piece, 0, None
        last = self._edge(piece, True)
        return piece[:first], (self._count(piece[first + 1 : last], True) if last > first else 0), piece[last:]

    @staticmethod
    def _edge(piece: str, backward: bool) -> int | None:
        """Where a space follows another character."""
        if backward:
            at = piece.rfind(" ")
            while at > 0 and piece[at - 1] == " ":
                at -= 1
            return at if at > 0 else None
        lead = len(piece) - len(piece.lstrip(" "))
        at = piece.find(" ", lead)
        return at if at > 0 else None

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks; associative."""
        if a[2] is None and b[2] is None:
            return self.chunk_map(a[0] + b[0])
        if a[2] is None:
            m = self.chunk_map(a[0] + b[0])
            return (m[0], m[1] + self._between(m[2], b[1]), b[2]) if m[2] is not None else self._shifted(m[0], b)
        if b[2] is None:
            m = self.chunk_map(a[2] + b[0])
            return a[0], a[1] + (self._open(m[0]) + m[1] if m[2] is not None else 0), m[2] if m[2] is not None else m[0]
        return a[0], a[1] + self._open(a[2] + b[0]) + b[1], b[2]

    def _open(self, text: str) -> int:
        return self._count(text[1:], True) if text else 0

    def _between(self, tail: str, count: int) -> int:
        return self._open(tail) + count

    def _shifted(self, head: str, b: tuple) -> tuple:
        return head, b[1], b[2]

    def finish(self, m: tuple) -> int:
        """The count of a whole text from its map, a space prefixed."""
        head, count, tail = m
        total = self._count(head, True) if head or tail else 0
        return total + count + (self._open(tail) if tail else 0)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, to which a space is prefixed."""
        out: list[int] = []
        if not text:
            return out
        lines = text.replace(MARK, " ").split("\n") if "\n" not in self.score else [text.replace(MARK, " ")]
        for i, line in enumerate(lines):
            words = line.split(" ")
            if i:
                out.append(self.byte_ids[10])
                if words[0]:
                    out += self.inner_ids[words[0]]
                words = words[1:]
            if "" not in words:
                out += chain.from_iterable(map(self.word_ids.__getitem__, words))
                continue
            k = 0
            for w in words:
                k += 1
                if w:
                    absorbs = k == 1 or self.opening[w]
                    out += self._run_ids(k - 1 if absorbs else k)
                    out += self.word_ids[w] if absorbs else self.word_ids[w][1:]
                    k = 0
            out += self._run_ids(k)
        return out

    def _run_ids(self, k: int) -> list[int]:
        full, rest = divmod(k, self.run)
        return [self.ids[MARK * self.run]] * full + [self.ids[p] for p in self._rest(rest)]

    def _ids(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.split(text):
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each, the first space goes."""
        try:
            text = "".join(map(self.plain.__getitem__, ids))
        except (TypeError, KeyError):
            joined = b"".join(p if isinstance(p := self.pieces.get(i, ""), bytes) else p.encode() for i in ids)
            text = joined.decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


class _Memo(dict):
    """Computes a value when it is first asked for."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, key):
        if len(self) > KEEP:
            self.clear()
        value = self.f(key)
        if len(key) <= 64:
            self[key] = value
        return value
