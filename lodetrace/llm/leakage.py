"""Evaluation passages leaking into training text, found with one Aho-Corasick automaton.

The automaton holds, for every test item, the words that are the item's own (names, versions,
numbers: words with a digit, or found in few items) and every window of three words of its
passage, and its whole answer. A document is normalised (letter case, punctuation, markup
and layout removed) and scanned once; the matches give, per item, pairs of a word of the
document and a word of the passage. A chain of such pairs that moves forward in both, passes
over no own word and only over a few others, is a leaked stretch; it is reported with its
place in the original text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread, table

#: A word in at most this many items (or with a digit) is an item's own and must be kept.
OWN_ITEMS = 2
#: Words of the document or the passage that may be passed over between two common words.
GAP = 3
#: Least share of a stretch's words that must be common; the others are replaced or missing.
COMMON = 0.7
#: Least length of a stretch: words, and share of the passage.
LEAST_WORDS, LEAST_SHARE = 12, 1 / 3
#: Characters of passages and answers that one automaton may hold; it bounds what is broadcast.
#: Only beyond it are there several automata, one pass each, with the same rows.
MOST_CHARS = 100_000_000

#: A tag of markup: a name, then attributes with or without values.
_TAG = re.compile(r"</?[A-Za-z][\w:-]*+(?:\s++[\w:.@-]++(?:\s*+=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'=<>`]++))?+)*+\s*+/?>")


class _Letters(dict):
    def __missing__(self, code: int):
        ch = chr(code)
        self[code] = got = ch if ch.isalnum() or ch.isspace() else None
        return got


_LETTERS = _Letters()


def words(text: str) -> list[str]:
    """The text's words: split at white space, lower case, letters and digits only."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " * len(m[0]), text)
    return text.translate(_LETTERS).lower().split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end in `text` of each of `words(text)`."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " * len(m[0]), text)
    return [m.span() for m in re.finditer(r"\S+", text) if m[0].translate(_LETTERS).lower().split()]


class Hit(NamedTuple):
    kind: str  # passage, or answer for an answer that stands without its passage
    item: int
    first: int
    last: int
    common: int
    span: int


class LeakScanner:
    """Scans texts for stretches of items given as (item id, passage, answer)."""

    def __init__(self, items: list[tuple[int, str, str]], rare: set[str] | None = None, named: set[str] | None = None):
        """`rare`: words without a digit found in the passages of few of all items, `named`: in
        their answers; counted here if not given."""
        import ahocorasick

        answers: dict[tuple[int, str], set[str]] = defaultdict(set)
        for i, p, a in items:
            answers[i, p or ""].add(a or "")
        passages = sorted(answers)
        self.items = [(i, words(p)) for i, p in passages]
        few = lambda pairs: {w for w, n in Counter(w for w, _ in pairs).items() if n <= OWN_ITEMS}
        if rare is None:
            rare = few({(w, i) for i, ws in self.items for w in ws})
        if named is None:
            named = few({(w, i) for i, _, a in items for w in words(a or "")})
        self.own = rare | {w for _, ws in self.items for w in ws if any(c.isdigit() for c in w)}
        patterns: dict[str, set[int]] = defaultdict(set)  # places in `items`, of answers as ~place
        for k, (_, ws) in enumerate(self.items):
            for w in ws:
                if w in self.own:
                    patterns[f" {w} "].add(k)
            for n in range(len(ws) - 2):
                patterns[" " + " ".join(ws[n : n + 3]) + " "].add(k)
            for a in answers[passages[k]]:
                if aw := words(a):
                    patterns[" " + " ".join(aw) + " "].add(k)
                    if any(w in named or any(c.isdigit() for c in w) for w in aw):
                        patterns[" " + " ".join(aw) + " "].add(~k)
        self.automaton = ahocorasick.Automaton()
        for p, ids in patterns.items():
            self.automaton.add_word(p, (len(p.split()), tuple(sorted(ids))))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, text: str) -> list[Hit]:
        """Leaked stretches, the longest of each item; of items without one, the first answer."""
        if self.empty or not text:
            return []
        ws = words(text)
        seen: dict[int, list[int]] = defaultdict(list)
        said: dict[int, tuple[int, int]] = {}
        for end, (size, ids) in self.automaton.iter(" " + " ".join(ws) + " "):
            for i in ids:
                if i < 0:
                    said.setdefault(~i, (end, size))
                else:
                    seen[i].append(end)
        if not seen:
            return []
        starts, at = [], 0
        for w in ws:
            starts.append(at)
            at += len(w) + 1
        best: dict[int, Hit] = {}
        for k, ends in sorted(seen.items()):
            i, passage = self.items[k]
            need = max(LEAST_WORDS, -int(-len(passage) * LEAST_SHARE // 1))
            if len(passage) < need or len(ws) < need * COMMON:
                continue
            for lo, hi in self._regions(ends, starts, len(ws), len(passage)):
                got = self._stretch(passage, ws, lo, hi, need)
                if got and (i not in best or got[3] > best[i].span):
                    best[i] = Hit("passage", i, *got)
        for k, (end, size) in sorted(said.items()):
            i = self.items[k][0]
            if i not in best:
                last = bisect_left(starts, end) - 1
                best[i] = Hit("answer", i, last - size + 1, last, size, size)
        return list(best.values())

    @staticmethod
    def _regions(ends: list[int], starts: list[int], n: int, reach: int) -> Iterator[tuple[int, int]]:
        """Ranges of words around matches that lie within a passage's length of each other."""
        lo = hi = None
        for e in ends:
            w = bisect_left(starts, e) - 1
            if hi is not None and w - reach <= hi:
                hi = min(n, w + reach)
            else:
                if hi is not None:
                    yield lo, hi
                lo, hi = max(0, w - reach), min(n, w + reach)
        if hi is not None:
            yield lo, hi

    def _stretch(self, passage: list[str], ws: list[str], lo: int, hi: int, need: int) -> tuple[int, int, int, int] | None:
        """(first, last, common, span) of the longest stretch of the passage in these words."""
        here = set(ws[lo:hi])
        own = [w in self.own for w in passage]
        # a stretch keeps its own words, so it lies between those that are missing here
        runs, start = [], 0
        for i, w in enumerate([*passage, None]):
            if i == len(passage) or own[i] and w not in here:
                if i - start >= need and sum(passage[j] in here for j in range(start, i)) >= COMMON * need and (any(own[start:i]) or not any(own)):
                    runs.append((start, i))
                start = i + 1
        if not runs:
            return None
        where: dict[str, list[int]] = defaultdict(list)
        for j in range(lo, hi):
            where[ws[j]].append(j)
        best = None
        for a, b in runs:
            got = self._chain(passage, own, a, b, ws, where, need)
            if got and (best is None or got[3] > best[3]):
                best = got
        return best

    def _chain(self, passage: list[str], own: list[bool], start: int, stop: int, ws: list[str], where: dict[str, list[int]], need: int) -> tuple[int, int, int, int] | None:
        chains: list[dict[int, tuple[float, int, int, int]]] = []  # per passage word: document word -> score, first i, first j, common
        best = None
        owned = [0]
        for o in own:
            owned.append(owned[-1] + o)
        for i in range(start, stop):
            here: dict[int, tuple[float, int, int, int]] = {}
            for j in where.get(passage[i], ()):
                top = (1.0, i, j, 1)
                for a in range(GAP + 1):
                    k = i - 1 - a
                    if k < start:
                        break
                    back = chains[k - start]
                    for b in range(GAP + 1):
                        prev = back.get(j - 1 - b)
                        if prev and (score := prev[0] + 1 - 0.6 * max(a, b)) > top[0] and not self._foreign(ws, j - b, j):
                            top = (score, prev[1], prev[2], prev[3] + 1)
                    if own[k]:
                        break  # an own word of the item may not be passed over
                here[j] = top
                span = i - top[1] + 1
                # words that many items share prove nothing without one of the item's own
                named = not owned[-1] or owned[i + 1] > owned[top[1]]
                if span >= need and named and top[3] >= COMMON * span and (best is None or span > best[3]):
                    best = (top[2], j, top[3], span)
            chains.append(here)
        return best

    def _foreign(self, ws: list[str], a: int, b: int) -> bool:
        """Whether a word passed over in the document is some item's own, or a number."""
        return any(ws[j] in self.own or any(c.isdigit() for c in ws[j]) for j in range(a, b))


def rare_words(items: DataFrame) -> tuple[set[str], set[str]]:
    """Words without a digit found in at most `OWN_ITEMS` of all items: of their passages, and
    of their answers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(i, c, w) for c in ("passage", "answer") for i, t in zip(pdf["item_id"], pdf[c]) for w in set(words(t or "")) if not any(x.isdigit() for x in w)]
            yield pd.DataFrame(got, columns=["item_id", "c", "w"])

    pairs = items.select(F.col("item_id").cast("bigint").alias("item_id"), "passage", "answer").mapInPandas(run, "item_id bigint, c string, w string").distinct()
    few = pairs.groupBy("c", "w").count().where(F.col("count") <= OWN_ITEMS).select("c", "w").collect()
    return {r.w for r in few if r.c == "passage"}, {r.w for r in few if r.c == "answer"}


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", most_chars: int = MOST_CHARS) -> DataFrame:
    """(doc_id, item_id, kind, start, end, common, span): the longest leaked stretch of each item
    in each document (kind `passage`); of items of which only the answer stands there, with a
    word in it that few answers have, the answer (kind `answer`). `start` and `end` are offsets in
    the original text.

    `items` has item_id, passage and answer. Words are counted over all of them, so that rows
    do not depend on how many automata `most_chars` makes of them; it is the bound of what a
    worker holds. An item of several passages leaks by any of them.
    Defined cases: null and empty texts or passages have no leaks, passages shorter than
    `LEAST_WORDS` cannot leak, repeated documents are reported each. Texts are scanned
    whole. No shuffle beyond spreading an input of few files.
    """
    spark = docs.sparkSession
    schema = f"`{doc_id}` bigint, item_id bigint, kind string, start int, end int, common int, span int"
    src = spread(docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).cast("bigint").alias(doc_id), F.col(text).alias(text)))
    rows = items.where("item_id is not null").select("item_id", "passage", "answer").distinct()
    chars = rows.agg(F.sum(F.length(F.concat_ws("", "passage", "answer")))).first()[0] or 0
    blocks = max(1, -(-chars // most_chars))
    rare = spark.sparkContext.broadcast(rare_words(rows))
    out = None
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast([(r.item_id, r.passage, r.answer) for r in part.collect()])

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            scanner = LeakScanner(held.value, *rare.value)
            for pdf in batches:
                got = []
                for d, t in zip(pdf[doc_id], pdf[text]):
                    hits = scanner.scan(t)
                    if hits:
                        spans = word_spans(t)
                        got += [(d, h.item, h.kind, spans[h.first][0], spans[h.last][1], h.common, h.span) for h in hits]
                yield pd.DataFrame(got, columns=[doc_id, "item_id", "kind", "start", "end", "common", "span"])

        found = src.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, item_id) of each document with each item a stretch of which it contains."""
    return find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).where("kind = 'passage'").select("doc_id", "item_id").distinct()


def p7_leaked_items(spark: SparkSession, root: str) -> DataFrame:
    """(item_id, documents, longest, answer_documents): how many documents leak each item, the
    longest stretch, and how many more documents hold its answer only."""
    leaks = find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))
    passage, answer = F.col("kind") == "passage", F.col("kind") == "answer"
    return leaks.groupBy("item_id").agg(F.countDistinct(F.when(passage, F.col("doc_id"))).alias("documents"), F.max(F.when(passage, F.col("span"))).alias("longest"), F.countDistinct(F.when(answer, F.col("doc_id"))).alias("answer_documents"))
