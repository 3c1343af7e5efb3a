"""Vectorised structural indexing of JSON texts: bitmaps, prefix sums and spans instead of a parser.

All texts of a batch lie in one byte buffer. Quote, bracket and delimiter bitmaps are built for the whole buffer at once, the parity of the
quotes before a byte tells whether it lies in a string, and the running sum of brackets gives its depth. What remains are tokens; their
containers, places and grammar follow from sorts and shifts of the token arrays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

#: Token kinds: brackets and delimiters by their character, ``s`` a string, ``v`` a number or literal.
OPEN_OBJECT, CLOSE_OBJECT, OPEN_LIST, CLOSE_LIST, COLON, COMMA, STRING, SCALAR = b"{}[]:,sv"

_SCALAR = re.compile(rb"(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)\Z")
_KIND = np.zeros(256, np.uint8)
for _c in b"{}[]:,":
    _KIND[_c] = _c
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r")] = True
_ESCAPE = np.zeros(256, bool)
_ESCAPE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True


class StructuralIndex:
    """The tokens of a batch of JSON texts.

    ``data`` is the buffer, ``offsets`` the n + 1 bounds of its texts. ``valid[i]`` tells whether text i is complete JSON; the token arrays
    ``kind, start, end, text`` hold the tokens of all texts in order, ``container`` the index of the bracket that a token lies in (-1 at the top) and
    ``key`` the index of its key token (-1 if none).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        self.offsets = offsets.astype(np.int64)
        n = len(self.offsets) - 1
        self.valid = np.ones(n, bool)
        size = len(data)
        lengths = np.diff(self.offsets)
        text_of = np.repeat(np.arange(n), lengths)

        # quotes that no odd run of backslashes escapes; the runs are cut at text bounds
        slash = data == 92
        at = np.flatnonzero(slash)
        escaped = np.zeros(size + 1, bool)
        if len(at):
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] != at[:-1] + 1) | (text_of[at[1:]] != text_of[at[:-1]])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            odd = (np.arange(len(at)) - run) % 2 == 0  # the 1st, 3rd ... backslash of a run escapes what follows
            escaped[at[odd] + 1] = True
            escaped[self.offsets[:-1][lengths > 0]] = False
        quote = (data == 34) & ~escaped[:size]
        quotes = np.zeros(size + 1, np.int64)
        np.cumsum(quote, out=quotes[1:])
        base = quotes[self.offsets[:-1]]
        inside = ((quotes[1:] - base[text_of]) & 1).astype(bool)  # from an opening quote up to the byte before the closing one
        self.valid &= (quotes[self.offsets[1:]] - base) % 2 == 0

        # bytes in strings: no control characters, only known escapes, four hex digits after \u
        body = inside & ~quote
        self._bad(text_of, body & (data < 32))
        esc = escaped[:size] & body
        self._bad(text_of, esc & ~_ESCAPE[data])
        at = np.flatnonzero(esc & (data == 117))
        for k in range(1, 5):
            p = np.minimum(at + k, max(size - 1, 0))
            ok = (at + k < size) & body[p] & _HEX[data[p]] & (text_of[p] == text_of[at])
            self.valid[text_of[at[~ok]]] = False

        # tokens
        outside = ~inside & ~quote
        structural = np.where(outside, _KIND[data], 0)
        scalar = outside & (structural == 0) & ~_SPACE[data]
        first = scalar.copy()
        first[1:] &= ~(scalar[:-1] & (text_of[1:] == text_of[:-1]))
        last = scalar.copy()
        last[:-1] &= ~(scalar[1:] & (text_of[1:] == text_of[:-1]))
        opening = quote & inside
        closing = quote & ~inside
        begins = np.flatnonzero((structural > 0) | first | opening)
        kind = structural[begins]
        kind[first[begins]] = SCALAR
        kind[opening[begins]] = STRING
        end = begins + 1
        is_string, is_scalar = kind == STRING, kind == SCALAR
        closes = np.flatnonzero(closing)
        starts = begins[is_string]
        if len(closes) == len(starts):
            end[is_string] = closes + 1
        else:  # a text that ends within a string: its last opening quote has no closing one
            where = np.searchsorted(closes, starts)
            end[is_string] = np.where(where < len(closes), closes[np.minimum(where, max(len(closes) - 1, 0))] if len(closes) else 0, starts) + 1
        end[is_scalar] = np.flatnonzero(last) + 1
        self.kind, self.start, self.end, self.text = kind, begins, end, text_of[begins]
        self._scalars(is_scalar)
        self._nest()
        self._grammar()

    def _bad(self, text_of: np.ndarray, mask: np.ndarray) -> None:
        self.valid[text_of[mask]] = False

    def _bad_at(self, texts: np.ndarray, mask: np.ndarray) -> None:
        self.valid[texts[mask]] = False

    def _scalars(self, is_scalar: np.ndarray) -> None:
        seen: dict[bytes, bool] = {}
        raw = self.data.tobytes()
        for i in np.flatnonzero(is_scalar).tolist():
            word = raw[self.start[i] : self.end[i]]
            ok = seen.get(word)
            if ok is None:
                ok = seen[word] = _SCALAR.match(word) is not None
            if not ok:
                self.valid[self.text[i]] = False
        self.raw = raw

    def _nest(self) -> None:
        """Depths by prefix sums; the container of a token is the last bracket opened one level above it."""
        kind, text, m = self.kind, self.text, len(self.kind)
        opens = (kind == OPEN_OBJECT) | (kind == OPEN_LIST)
        shuts = (kind == CLOSE_OBJECT) | (kind == CLOSE_LIST)
        depth = np.cumsum(opens.astype(np.int64) - shuts)  # after the token
        first = np.ones(m, bool)
        first[1:] = text[1:] != text[:-1]
        base = np.where(first, depth - opens + shuts, 0)
        starts = np.flatnonzero(first)
        if m:
            depth = depth - np.repeat(base[starts], np.diff(np.append(starts, m)))
        self._bad_at(text, depth < 0)
        tail = np.append(starts[1:], m) - 1 if m else starts
        if m:
            self._bad_at(text[tail], depth[tail] != 0)
        has = np.zeros(len(self.valid), bool)
        has[text] = True
        self.valid &= has
        level = np.maximum(np.where(opens, depth, depth + shuts), 0)  # an opening and its closing bracket have the depth inside them
        # per text and level in order: opening brackets set what later tokens of that level lie in
        inner = np.where(opens | shuts, level - 1, level)  # the level a token stands at, from outside
        order = np.lexsort((np.concatenate([np.zeros(int(opens.sum()), np.int8), np.ones(m, np.int8)]), np.concatenate([np.flatnonzero(opens), np.arange(m)]), np.concatenate([level[opens], inner]), np.concatenate([text[opens], text])))
        ids = np.concatenate([np.flatnonzero(opens), np.arange(m)])[order]
        setter = np.concatenate([np.ones(int(opens.sum()), bool), np.zeros(m, bool)])[order]
        lev = np.concatenate([level[opens], inner])[order]
        pos = np.where(setter, np.arange(len(ids)), -1)
        last = np.maximum.accumulate(pos) if len(pos) else pos
        holder = np.where(last >= 0, ids[np.maximum(last, 0)], -1) if len(ids) else ids
        same = holder >= 0
        if len(ids):
            same &= (lev[np.maximum(last, 0)] == lev) & (text[np.maximum(holder, 0)] == text[ids])
        holder = np.where(same & (lev > 0), holder, -1)
        self.container = np.full(m, -1, np.int64)
        self.container[ids[~setter]] = holder[~setter]
        # a closing bracket must be of the kind of the one it closes; in texts that are balanced the two alternate at each level
        self.mate = np.full(m, -1, np.int64)
        pairs = np.lexsort((np.arange(m), level, text))
        pairs = pairs[(opens | shuts)[pairs] & self.valid[text[pairs]]]
        a, b = pairs[::2], pairs[1::2]
        self._bad_at(text[a], kind[b] != kind[a] + 2)
        self.mate[a] = b

    def _grammar(self) -> None:
        """Which token may follow which, given the container's kind."""
        kind, text, m = self.kind, self.text, len(self.kind)
        self.key = np.full(m, -1, np.int64)
        if not m:
            return
        nxt = np.zeros(m, np.uint8)
        same = np.zeros(m, bool)
        same[:-1] = text[1:] == text[:-1]
        nxt[:-1][same[:-1]] = kind[1:][same[:-1]]
        prv = np.zeros(m, np.uint8)
        prv[1:][same[:-1]] = kind[:-1][same[:-1]]
        opens = (kind == OPEN_OBJECT) | (kind == OPEN_LIST)
        shuts = (kind == CLOSE_OBJECT) | (kind == CLOSE_LIST)
        in_object = (self.container >= 0) & (kind[np.maximum(self.container, 0)] == OPEN_OBJECT)
        in_list = (self.container >= 0) & ~in_object
        is_key = (kind == STRING) & in_object & ((prv == OPEN_OBJECT) | (prv == COMMA))
        value = opens | (kind == SCALAR) | ((kind == STRING) & ~is_key)
        bad = np.zeros(m, bool)
        bad |= is_key & (nxt != COLON)
        bad |= (kind == COLON) & (~in_object | (prv != STRING))
        colon_ok = np.zeros(m, bool)
        colon_ok[1:] = is_key[:-1] & same[:-1]
        bad |= (kind == COLON) & ~colon_ok
        bad |= (kind == COMMA) & ((self.container < 0) | (prv == 0) | (prv == COMMA) | (prv == COLON) | (prv == OPEN_OBJECT) | (prv == OPEN_LIST))
        bad |= (kind == COMMA) & ((nxt == COMMA) | (nxt == COLON) | (nxt == CLOSE_OBJECT) | (nxt == CLOSE_LIST) | (nxt == 0))
        bad |= shuts & ((prv == COMMA) | (prv == COLON))
        bad |= value & in_object & (prv != COLON)
        bad |= value & in_list & (prv != OPEN_LIST) & (prv != COMMA)
        bad |= value & (self.container < 0) & (prv != 0)
        self._bad_at(text, bad)
        keyed = value & (prv == COLON)
        self.key[keyed] = np.flatnonzero(keyed) - 2
        self.value = value

    def check_utf8(self) -> None:
        """Texts that aren't UTF-8 aren't JSON."""
        high = np.zeros(len(self.valid), bool)
        if len(self.data):
            high[np.unique(np.repeat(np.arange(len(self.valid)), np.diff(self.offsets))[self.data >= 128])] = True
        for t in np.flatnonzero(high & self.valid).tolist():
            try:
                self.raw[self.offsets[t] : self.offsets[t + 1]].decode()
            except UnicodeDecodeError:
                self.valid[t] = False

    def string(self, token: int) -> str:
        """The text of a string token; a lone surrogate, which UTF-8 can't hold, comes out as the replacement character."""
        raw = self.raw[self._starts[token] : self._ends[token]]
        if b"\\" not in raw:
            return raw[1:-1].decode()
        return json.loads(raw).encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def documents(self) -> Iterator[tuple[int, "Node"]]:
        """``(text, root)`` of every valid text."""
        values = np.flatnonzero(self.value) if len(self.kind) else np.zeros(0, np.int64)
        order = values[np.lexsort((values, self.container[values]))]
        holder = self.container[order]
        self._child = order.tolist()
        lo = np.searchsorted(holder, np.arange(len(self.kind)), "left")
        hi = np.searchsorted(holder, np.arange(len(self.kind)), "right")
        self._lo, self._hi = lo, hi
        self._kinds, self._starts, self._ends, self._keys = self.kind.tolist(), self.start.tolist(), self.end.tolist(), self.key.tolist()
        for i in order[holder < 0].tolist():
            if self.valid[self.text[i]]:
                yield int(self.text[i]), Node(self, i)


class Node:
    """A value of an indexed text. Only the spans that are asked for are cut out and decoded."""

    __slots__ = ("at", "index")

    def __init__(self, index: StructuralIndex, at: int) -> None:
        self.index, self.at = index, at

    @property
    def is_object(self) -> bool:
        return self.index._kinds[self.at] == OPEN_OBJECT

    @property
    def is_list(self) -> bool:
        return self.index._kinds[self.at] == OPEN_LIST

    @property
    def is_null(self) -> bool:
        ix = self.index
        return ix._kinds[self.at] == SCALAR and ix.raw[ix._starts[self.at] : ix._ends[self.at]] == b"null"

    def children(self) -> Iterator["Node"]:
        ix = self.index
        for p in range(ix._lo[self.at], ix._hi[self.at]):
            yield Node(ix, ix._child[p])

    def name(self) -> str | None:
        """The key under which the value stands, if any."""
        k = self.index._keys[self.at]
        return None if k < 0 else self.index.string(k)

    def get(self, *names: str) -> "Node | None":
        """The member of an object with one of the names; of a repeated name the last counts, of several names the first that is there."""
        if not self.is_object:
            return None
        found = {c.name(): c for c in self.children()}
        return next((found[n] for n in names if n in found), None)

    def members(self) -> list[tuple[str, "Node"]]:
        """An object's members in order, a repeated name once: in its first place, with its last value."""
        return list({c.name() or "": c for c in self.children()}.items())

    def text(self) -> str | None:
        """A string's text; of other values their JSON spelling, null for a null."""
        ix = self.index
        if ix._kinds[self.at] == STRING:
            return ix.string(self.at)
        if self.is_null:
            return None
        end = ix._ends[self.at]
        if self.is_object or self.is_list:
            end = int(ix.end[ix.mate[self.at]])
        return ix.raw[ix._starts[self.at] : end].decode()

    def number(self) -> float | None:
        ix = self.index
        if ix._kinds[self.at] != SCALAR:
            return None
        word = ix.raw[ix._starts[self.at] : ix._ends[self.at]]
        return None if word in (b"null", b"true", b"false") else float(word)

