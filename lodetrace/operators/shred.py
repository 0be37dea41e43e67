"""Nested JSON text to related flat rows by vectorised structural indexing.

A batch of texts is laid out as one byte buffer. Bitmaps mark quotes that are not escaped,
brackets and delimiters; a running parity of the quotes masks what stands inside strings; a
prefix sum over the brackets gives the nesting depth. Sorting the structural tokens by
(depth, position) puts every value next to the bracket that holds it, which yields the
parent of each value, its place and key, and also a complete syntax check, without walking
any document. Only spans that a requested path matches are cut out of the buffer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text indexed at once; a longer single text is indexed alone.
CHUNK_BYTES = 4 << 20

OPEN_OBJ, OPEN_ARR, CLOSE_OBJ, CLOSE_ARR, COLON, COMMA, STRING, LITERAL = range(1, 9)
KINDS = {OPEN_OBJ: "object", OPEN_ARR: "array", STRING: "string", LITERAL: "literal"}
_CODE = np.zeros(256, np.int8)
for _ch, _c in (("{", OPEN_OBJ), ("[", OPEN_ARR), ("}", CLOSE_OBJ), ("]", CLOSE_ARR), (":", COLON), (",", COMMA)):
    _CODE[ord(_ch)] = _c
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_AFTER_ESCAPE = np.zeros(256, bool)
_AFTER_ESCAPE[[ord(c) for c in '"\\/bfnrtu']] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_NUMBER = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_NAMED = (b"true", b"false", b"null")


class StructuralIndex:
    """Tokens of several JSON texts with their parents, places and keys.

    `valid[i]` tells whether text i is one well-formed JSON value; tokens of other texts
    are dropped.
    """

    def __init__(self, texts: Sequence[bytes]):
        self.n = len(texts)
        # a newline after each text ends literals there; it is blank in JSON
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.starts = np.cumsum([0] + [len(t) + 1 for t in texts])[: self.n].astype(np.int64)
        self.valid = np.ones(self.n, bool)
        self._tokens()
        self._nest()
        self._check()

    def _doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, pos, "right") - 1

    def _bad(self, docs: np.ndarray) -> None:
        self.valid[docs] = False

    def _tokens(self) -> None:
        b = self.buf
        n = len(b)
        quote = b == 34
        slash = b == 92
        self.slashes = np.concatenate([[0], np.cumsum(slash)]) if slash.any() else None
        if self.slashes is not None:
            # length of the run of backslashes that ends before each byte; odd: escaped
            at = np.arange(n)
            last_other = np.maximum.accumulate(np.where(slash, -1, at))
            run_before = np.empty(n, np.int64)
            run_before[0] = 0
            run_before[1:] = at[:-1] - last_other[:-1]
            escaped = (run_before & 1).astype(bool)
            quote &= ~escaped
        else:
            escaped = None
        count = np.cumsum(quote)
        before = np.concatenate([[0], count])[self.starts]
        lengths = np.diff(np.append(self.starts, n))
        parity = ((count - np.repeat(before, lengths)) & 1).astype(bool)
        ends = np.append(self.starts[1:], n) - 1
        self._bad(np.flatnonzero(parity[ends]))  # an open string
        self._bad(self._doc_of(np.flatnonzero(parity & (b < 32))))
        if escaped is not None:
            self._bad(self._doc_of(np.flatnonzero(escaped & ~_AFTER_ESCAPE[b])))
            self._bad(self._doc_of(np.flatnonzero(slash & ~parity)))
            codes = np.flatnonzero(escaped & (b == 117))  # \\u wants four hex digits
            for k in range(1, 5):
                self._bad(self._doc_of(codes[~_HEX[b[np.minimum(codes + k, n - 1)]]]))
        code = np.where(parity, 0, _CODE[b]).astype(np.int8)
        opens = quote & parity
        plain = ~parity & ~quote & ~_SPACE[b] & (code == 0)
        first = plain.copy()
        first[1:] &= ~plain[:-1]
        kind = code
        kind[opens] = STRING
        kind[first] = LITERAL
        self.pos = np.flatnonzero(kind)
        self.kind = kind[self.pos]
        self.doc = self._doc_of(self.pos)
        closes = np.flatnonzero(quote & ~parity)
        stops = np.flatnonzero(plain & ~np.append(plain[1:], False)) + 1
        self.end = self.pos + 1
        strings = np.flatnonzero(self.kind == STRING)
        at = np.searchsorted(closes, self.pos[strings])
        ok = at < len(closes)
        self.end[strings[ok]] = closes[at[ok]] + 1
        literals = np.flatnonzero(self.kind == LITERAL)
        self.end[literals] = stops[np.searchsorted(stops, self.pos[literals], "right")]

    def _nest(self) -> None:
        k = self.kind
        step = np.where((k == OPEN_OBJ) | (k == OPEN_ARR), 1, np.where((k == CLOSE_OBJ) | (k == CLOSE_ARR), -1, 0))
        run = np.cumsum(step)
        first = np.searchsorted(self.doc, np.arange(self.n))
        base = np.concatenate([[0], run])[first]
        inside = run - base[self.doc] if len(k) else run
        # a bracket stands on the level of the value it opens or closes
        self.level = np.where(step == 1, inside - 1, inside)
        last = np.searchsorted(self.doc, np.arange(self.n), "right") - 1
        empty = last < first
        self.valid[empty] = False
        self.valid[~empty] &= inside[last[~empty]] == 0
        self._bad(self.doc[self.level < 0])
        keep = self.valid[self.doc]
        for name in ("pos", "kind", "doc", "end", "level"):
            setattr(self, name, getattr(self, name)[keep])

    def _check(self) -> None:
        k, n = self.kind, len(self.kind)
        opener = (k == OPEN_OBJ) | (k == OPEN_ARR)
        closer = (k == CLOSE_OBJ) | (k == CLOSE_ARR)
        self.parent = np.full(n, -1, np.int64)
        self.slot = np.zeros(n, np.int64)
        if not n:
            return
        # tokens of a level in order: a closer directly follows its opener
        order = np.lexsort((self.pos, self.level, self.doc))
        prev = np.concatenate([[-1], order[:-1]])
        ends = np.flatnonzero(closer[order])
        match = prev[ends]
        fits = (match >= 0) & (k[match] == k[order[ends]] - 2) & (self.level[match] == self.level[order[ends]]) & (self.doc[match] == self.doc[order[ends]])
        self._bad(self.doc[order[ends[~fits]]])
        self.end[match[fits]] = self.end[order[ends[fits]]]  # an opened value reaches to its closer
        # openers also stand, as heads, before the tokens one level below them
        idx_open, idx_rest = np.flatnonzero(opener), np.flatnonzero(~closer)
        doc = np.concatenate([self.doc[idx_open], self.doc[idx_rest]])
        level = np.concatenate([self.level[idx_open] + 1, self.level[idx_rest]])
        pos = np.concatenate([self.pos[idx_open], self.pos[idx_rest]])
        token = np.concatenate([idx_open, idx_rest])
        head = np.concatenate([np.ones(len(idx_open), bool), np.zeros(len(idx_rest), bool)])
        o = np.lexsort((pos, level, doc))
        doc, level, token, head = doc[o], level[o], token[o], head[o]
        new = np.ones(len(o), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (level[1:] != level[:-1])
        starts = head | (new & (level == 0))
        at = np.maximum.accumulate(np.where(starts, np.arange(len(o)), 0))
        body = ~head
        self.parent[token[body]] = np.where(head[at[body]], token[at[body]], -1)
        self.slot[token[body]] = (np.arange(len(o)) - at - head[at])[body]
        # the grammar of a container is periodic in the slot number
        t = token[body]
        par, slot, kind = self.parent[t], self.slot[t], k[t]
        value = (kind == STRING) | (kind == LITERAL) | (kind == OPEN_OBJ) | (kind == OPEN_ARR)
        top = par < 0
        in_obj = ~top & (k[par] == OPEN_OBJ)
        s4 = slot & 3
        good = np.where(
            top,
            value & (slot == 0),
            np.where(
                in_obj,
                ((s4 == 0) & (kind == STRING)) | ((s4 == 1) & (kind == COLON)) | ((s4 == 2) & value) | ((s4 == 3) & (kind == COMMA)),
                np.where((slot & 1) == 0, value, kind == COMMA),
            ),
        )
        self._bad(self.doc[t[~good]])
        size = np.bincount(par[~top], minlength=n)
        odd = np.where(k == OPEN_OBJ, (size > 0) & ((size & 3) != 3), (size > 0) & ((size & 1) == 0)) & opener
        self._bad(self.doc[odd])
        self.raw = self.buf.tobytes()
        lit = np.flatnonzero(k == LITERAL)
        named = np.zeros(len(lit), bool)
        for word in _NAMED:
            named |= self.equals(self.pos[lit], self.end[lit], word)
        self.null = np.zeros(n, bool)
        self.null[lit] = self.equals(self.pos[lit], self.end[lit], b"null")
        wrong = [i for i in lit[~named].tolist() if not _NUMBER.fullmatch(self.raw, self.pos[i], self.end[i])]
        self._bad(self.doc[np.asarray(wrong, np.int64)])

    def equals(self, start: np.ndarray, end: np.ndarray, word: bytes) -> np.ndarray:
        """Which of the spans hold exactly `word`."""
        same = end - start == len(word)
        at = start[same]
        fits = np.ones(len(at), bool)
        for i, c in enumerate(word):
            fits &= self.buf[at + i] == c
        same[same] = fits
        return same

    def text(self, token: int) -> bytes:
        return self.raw[self.pos[token] : self.end[token]]

    def values(self) -> np.ndarray:
        """Tokens that are values (not keys) of valid texts."""
        k = self.kind
        value = (k == STRING) | (k == LITERAL) | (k == OPEN_OBJ) | (k == OPEN_ARR)
        par = self.parent
        key = (par >= 0) & (k[par] == OPEN_OBJ) & ((self.slot & 3) == 0)
        return np.flatnonzero(value & ~key & self.valid[self.doc]) if len(k) else np.zeros(0, np.int64)


def _unquote(raw: bytes) -> str:
    return json.loads(raw).encode("utf-8", "replace").decode() if b"\\" in raw else raw[1:-1].decode("utf-8", "replace")


class Level(NamedTuple):
    """Values of one depth that paths lead to."""

    token: np.ndarray
    above: np.ndarray  # place of each one's parent in the level above
    mask: np.ndarray  # the paths it lies on, one bit each
    segment: np.ndarray  # its key, place or name
    place: np.ndarray


def _keys_equal(ix: StructuralIndex, keys: np.ndarray, word: str) -> np.ndarray:
    same = ix.equals(ix.pos[keys] + 1, ix.end[keys] - 1, word.encode())
    odd = np.flatnonzero(ix.slashes[ix.end[keys]] > ix.slashes[ix.pos[keys]]) if ix.slashes is not None else ()
    for i in odd:  # written with escapes
        same[i] = _unquote(ix.text(keys[i])) == word
    return same


def match_paths(index: StructuralIndex, paths: Mapping[str, Sequence[str]], named_by: Mapping[str, str]) -> list[Level]:
    """The levels below the roots, as far as the longest of `paths` reaches (`*` any key or
    place); bit q of a mask stands for path q. All of a level is compared at once."""
    ix, pats = index, [tuple(p) for p in paths.values()]
    vals = ix.values()
    at = ix.level[vals]
    deepest = max(map(len, pats), default=0)
    roots = vals[at == 0]
    levels = [Level(roots, np.zeros(len(roots), np.int64), np.full(len(roots), (1 << len(pats)) - 1), np.full(len(roots), "", object), np.zeros(len(roots), np.int64))]
    tags = {tuple(k.split(".")): v for k, v in named_by.items()}
    where = np.full(len(ix.kind), -1, np.int64)
    for lv in range(1, deepest + 1):
        above = levels[-1]
        where[above.token] = np.arange(len(above.token))
        t = vals[at == lv]
        up = where[ix.parent[t]]
        t, up = t[up >= 0], up[up >= 0]
        in_obj = ix.kind[ix.parent[t]] == OPEN_OBJ
        was, mask = above.mask[up], np.zeros(len(t), np.int64)
        segment = np.full(len(t), None, object)
        for word in {p[lv - 1] for p in pats if len(p) >= lv}:
            bits = sum(1 << q for q, p in enumerate(pats) if len(p) >= lv and p[lv - 1] == word)
            if word == "*":
                mask |= was & bits
                continue
            asked = np.flatnonzero(in_obj & (was & bits > 0))
            hit = asked[_keys_equal(ix, t[asked] - 2, word)]  # key, colon, value follow each other
            mask[hit] |= was[hit] & bits
            segment[hit] = word
        keep = mask > 0
        t, up, mask, segment, in_obj = t[keep], up[keep], mask[keep], segment[keep], in_obj[keep]
        place = ix.slot[t] // np.where(in_obj, 4, 2)
        listed = np.flatnonzero(~in_obj)
        if len(listed):
            names = np.array([str(i) for i in range(int(place[listed].max()) + 1)], object)
            segment[listed] = names[place[listed]]
        rest = np.flatnonzero(np.equal(segment, None))
        if len(rest):
            segment[rest] = [_unquote(ix.text(k)) for k in (t[rest] - 2).tolist()]
        for tag, member in tags.items():
            if len(tag) == lv - 1:
                inside, back = np.ones(len(t), bool), up
                for lower in range(lv - 1, 0, -1):
                    inside &= levels[lower].segment[back] == tag[lower - 1]
                    back = levels[lower].above[back]
                for i in np.flatnonzero(inside & ~in_obj & (ix.kind[t] == OPEN_OBJ)).tolist():
                    segment[i] = _member(ix, int(t[i]), member, segment[i])
        levels.append(Level(t, up, mask, segment, place))
    return levels


def _member(ix: StructuralIndex, obj: int, want: str, default: str) -> str:
    """The last string member `want` of an object, else `default`."""
    stop = int(np.searchsorted(ix.pos, ix.end[obj]))
    keys = obj + 1 + np.flatnonzero((ix.parent[obj + 1 : stop] == obj) & ((ix.slot[obj + 1 : stop] & 3) == 0) & (ix.kind[obj + 1 : stop] == STRING))
    found = default
    for key in keys.tolist():
        if ix.kind[key + 2] == STRING and _unquote(ix.text(key)) == want:
            found = _unquote(ix.text(key + 2))
    return found


def shred(df: DataFrame, record: str, text: str, paths: Mapping[str, Sequence[str]], named_by: Mapping[str, str] | None = None) -> DataFrame:
    """Flat rows of the parts of JSON texts, each with its parent and its place.

    `record` names a long column that identifies the text in column `text`; `paths` maps a
    table name to the path of its parts (`*` any key or place); `named_by` maps the dotted
    path of an array to the member that names its elements in place of their number.

    Result: record, child (table name), node and parent (numbers unique within a text,
    parent null for the root's members' parent being the root), path (array of keys and
    places from the root), place (number within the parent), kind (object, array, string,
    literal, null), parent_kind, value (text of strings and literals).

    Defined cases: null, empty and malformed texts give no rows; JSON nulls come out with
    kind `null`; repeated records give repeated rows; of a key repeated within an object
    every member comes out. No shuffle: one pass per partition, `CHUNK_BYTES` at a time.
    """
    tags = dict(named_by or {})
    wanted = {k: tuple(v) for k, v in paths.items()}
    schema = f"`{record}` bigint, child string, node int, parent int, path array<string>, place int, kind string, parent_kind string, value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for rid, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if texts and size + len(raw) > CHUNK_BYTES:
                    yield from _rows(ids, texts, wanted, tags, record)
                    ids, texts, size = [], [], 0
                ids.append(rid)
                texts.append(raw)
                size += len(raw)
            if texts:
                yield from _rows(ids, texts, wanted, tags, record)

    src = df.where(F.col(text).isNotNull() & F.col(record).isNotNull()).select(F.col(record).cast("bigint").alias(record), F.col(text).alias(text))
    return src.mapInArrow(run, schema)


def _rows(ids: list[int], texts: list[bytes], wanted: dict, tags: dict, record: str) -> Iterator[pa.RecordBatch]:
    ix = StructuralIndex(texts)
    if not len(ix.kind):
        return
    first = np.searchsorted(ix.doc, np.arange(len(texts)))
    ids = np.asarray(ids, np.int64)
    levels = match_paths(ix, wanted, tags)
    kinds = np.array([KINDS.get(k, "") for k in range(9)], object)
    for q, (name, path) in enumerate(wanted.items()):
        here = np.flatnonzero(levels[len(path)].mask >> q & 1) if len(path) < len(levels) else ()
        if not len(here):
            continue
        t = levels[len(path)].token[here]
        doc, par = ix.doc[t], ix.parent[t]
        segments, back = [], here
        for lv in range(len(path), 0, -1):
            segments.append(levels[lv].segment[back])
            back = levels[lv].above[back]
        flat = np.stack(segments[::-1], axis=1).ravel()
        kind = kinds[ix.kind[t]]
        kind[ix.null[t]] = "null"
        value = np.full(len(t), None, object)
        for i in np.flatnonzero((ix.kind[t] == STRING) | (ix.kind[t] == LITERAL)).tolist():
            raw = ix.text(t[i])
            value[i] = _unquote(raw) if ix.kind[t[i]] == STRING else raw.decode("utf-8", "replace")
        columns = [
            pa.array(ids[doc]), pa.array([name] * len(t), pa.string()), pa.array((t - first[doc]).astype(np.int32)), pa.array((par - first[doc]).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(path), dtype=np.int32)), pa.array(flat, pa.string())), pa.array(levels[len(path)].place[here].astype(np.int32)),
            pa.array(kind, pa.string()), pa.array(kinds[ix.kind[par]], pa.string()), pa.array(value, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[record, "child", "node", "parent", "path", "place", "kind", "parent_kind", "value"])
