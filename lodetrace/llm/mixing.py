"""Mixing sources to target shares of tokens, by subset-sum budget fitting.

Every document is measured with a public tokenizer. A source's budget is its share of all
tokens. What whole repeats of the source cover is taken whole; the rest, smaller than one
repeat, is filled with single further uses: first, in bulk, documents in a seeded order up to
a bounded distance from the budget, then a bounded knapsack over how many unused documents
there are of each exact length fits what is left as closely as a subset sum can. Documents of a length
are exchangeable, so the chosen count of each length is taken in the seeded order.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut, spread, table

#: Tokens the knapsack may have to fill; the bulk goes by stretches of the seeded order.
KNAPSACK_TOKENS = 200_000
#: Places of the seeded order, and the pieces a stretch of it is measured in at a time.
SPACE, PIECES = 1 << 60, 4096
#: File of the public vocabulary the lengths are counted with.
VOCABULARY = os.environ.get("LODETRACE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the public vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` without `text`, with `n_tokens`; a null text has none. Texts are read whole."""
    keep = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text) + ", n_tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        enc = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pdf[keep].assign(n_tokens=[0 if t is None else len(enc.encode_ordinary(t)) for t in pdf[text]])

    return spread(docs).mapInPandas(run, schema)


def fit_budget(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take (at most lengths[n]) so that their total is
    the greatest not above `budget`: bounded knapsack over the reachable totals.

    Each length's count is split into powers of two; reachable totals are one bit each of a
    big integer, so a step is a shift and an or. Of each total only the step that first
    reached it is kept, from which the choice is read back.
    """
    if budget <= 0:
        return {}
    full = (1 << (budget + 1)) - 1
    first = np.full(budget + 1, -1, np.int32)
    items, now = [], 1
    for n, c in sorted(lengths.items(), reverse=True):
        c, k = min(c, budget // n) if n > 0 else 0, 1
        while c > 0 and not now >> budget & 1:
            t = min(k, c)
            new = (now << (n * t)) & full & ~now
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")[: budget + 1]
                first[np.flatnonzero(bits)] = len(items)
                items.append((n, t))
                now |= new
            c -= t
            k *= 2
    total = now.bit_length() - 1
    take: dict[int, int] = {}
    while total:
        n, t = items[first[total]]
        take[n] = take.get(n, 0) + t
        total -= n * t
    return take


def plan_repeats(stats: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], total: int) -> dict[str, tuple[int, int]]:
    """source -> (whole repeats, tokens left to fill) from stats source -> (documents, tokens)."""
    plan = {}
    for source, share, cap in targets:
        size = stats.get(source, (0, 0))[1]
        cap = max(0, cap or 0)
        want = int(round((share or 0.0) * total))
        if size <= 0:
            plan[source] = (0, 0)
            continue
        whole = min(cap, want // size)
        plan[source] = (whole, want - whole * size if whole < cap else 0)
    return plan


def _pieces(mine: DataFrame, span: dict[str, tuple[int, int]], cap: dict[str, int]) -> Iterator[tuple[str, int, int, int, dict[int, int]]]:
    """(source, lo, hi, width, tokens by piece) of each span, of documents of at most `cap` tokens."""
    rows = [(s, lo, hi, max(1, -(-(hi - lo) // PIECES)), cap[s]) for s, (lo, hi) in sorted(span.items())]
    now = F.broadcast(mine.sparkSession.createDataFrame(rows, "source string, lo bigint, hi bigint, width bigint, cap bigint"))
    # whole numbers: places are beyond what a double tells apart
    piece = F.expr("cast((o - lo) div width as int)")
    tokens: dict[str, dict[int, int]] = {}
    for r in mine.join(now, "source").where("o >= lo and o < hi and n_tokens <= cap").groupBy("source", piece.alias("piece")).agg(F.sum("n_tokens").alias("t")).collect():
        tokens.setdefault(r.source, {})[r.piece] = r.t
    for s, lo, hi, width, _ in rows:
        yield s, lo, hi, width, tokens.get(s, {})


def _bulk(mine: DataFrame, rest: dict[str, int], knapsack_tokens: int) -> tuple[list[tuple[str, int, int, int]], dict[str, int]]:
    """Stretches (source, from, to, cap) whose documents of at most `cap` tokens are used once
    more, and the tokens left per source.

    A stretch is measured in `PIECES` pieces; pieces that fit by more than the knapsack's
    bound are taken, and a piece too large to be drawn on is measured again, finer. A single
    place that does not fit is passed over, with all later documents longer than what is left.
    """
    left, cap = dict(rest), dict(rest)
    span = {s: (0, SPACE) for s, r in rest.items() if r >= knapsack_tokens}
    begin = dict.fromkeys(span, 0)
    taken = []
    while span:
        for s, lo, hi, width, got in list(_pieces(mine, span, cap)):
            at = 0
            edge = lambda k: min(hi, lo + k * width)
            while edge(at) < hi and left[s] - got.get(at, 0) >= knapsack_tokens:
                left[s] -= got.get(at, 0)
                at += 1
            here, after, t = edge(at), edge(at + 1), got.get(at, 0)
            if here == hi < SPACE:
                span[s] = (hi, SPACE)
                continue
            if here < hi and t > 4 * knapsack_tokens and width > 1:
                span[s] = (here, after)
                continue
            fits = here < hi and 4 * knapsack_tokens < t <= left[s]
            if fits:
                left[s] -= t
                here = after
            if begin[s] < here:
                taken.append((s, begin[s], here, cap[s]))
            if not fits and t > 4 * knapsack_tokens and after < SPACE:
                begin[s], cap[s], span[s] = after, left[s], (after, SPACE)
                continue
            del span[s]
    return taken, left


def _picked(rest: DataFrame, chosen: list[tuple[str, int, int, int]]) -> DataFrame:
    """Of each (source, length) of chosen(source, length, documents there are, documents to take)
    the first documents of the seeded order, ranked among few more than are taken: places are
    even, so a stretch of the order holds enough of them; where it does not, all are ranked."""
    spark = rest.sparkSession
    room = lambda have, take: SPACE if (want := take + 6 * math.isqrt(take) + 50) >= have else SPACE * want // have
    upto = {(s, n): room(have, take) for s, n, have, take in chosen}
    while True:
        rows = [(s, n, take, upto[s, n]) for s, n, _, take in chosen]
        picks = F.broadcast(spark.createDataFrame(rows, "source string, n_tokens bigint, take bigint, upto bigint"))
        near = rest.join(picks, ["source", "n_tokens"]).where("o < upto")
        got = {(r.source, r.n_tokens): r["count"] for r in near.groupBy("source", "n_tokens").count().collect()}
        short = [(s, n) for s, n, _, take in chosen if got.get((s, n), 0) < take]
        if not short:
            break
        upto.update(dict.fromkeys(short, SPACE))
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy("o", "doc_id"))
    return near.withColumn("rank", rank).where("rank <= take").select("doc_id", F.lit(1).alias("once"))


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 1, knapsack_tokens: int = KNAPSACK_TOKENS) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): the documents used, and how often each.

    `docs` has doc_id, source and n_tokens; `targets` source, target_share and max_repeats.
    Sources without documents and documents of sources without target contribute nothing;
    documents without tokens are never used. A source too small for its share is used whole
    `max_repeats` times. Rows of one doc_id count as one document, the least of them; rows
    without doc_id are never used but count in the total. The driver holds, per source of `targets`, `PIECES` sums and
    one count per token length of what may still be used.
    """
    spark = docs.sparkSession
    order = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SPACE))
    one = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d"))
    d = cut(one.select("doc_id", "d.source", "d.n_tokens", order.alias("o")))
    goals = [(r.source, r.target_share, r.max_repeats) for r in targets.where("source is not null").dropDuplicates(["source"]).collect()]
    total = sum(x.agg(F.sum("n_tokens")).first()[0] or 0 for x in (d, docs.where("doc_id is null")))
    named = spark.createDataFrame([(g[0],) for g in goals], "source string")
    mine = d.where("n_tokens > 0").join(F.broadcast(named), "source", "left_semi")
    # partial sums before the shuffle are as few as the sources, however hot one of them is
    stats = {r.source: (r.n, r.t) for r in mine.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    plan = plan_repeats(stats, goals, total)
    taken, left = _bulk(mine, {s: rest for s, (_, rest) in plan.items()}, knapsack_tokens)
    bounds = spark.createDataFrame([(s, plan[s][0], left[s]) for s in plan], "source string, whole int, left bigint")
    stretches = spark.createDataFrame(taken, "source string, lo bigint, hi bigint, cap bigint")
    mine = mine.join(F.broadcast(bounds), "source").alias("m").join(F.broadcast(stretches.alias("b")), F.expr("m.source = b.source and o >= lo and o < hi and n_tokens <= cap"), "left")
    mine = mine.select("m.*", F.col("lo").isNotNull().alias("bulk"))
    rest = mine.where("not bulk and n_tokens <= left").select("doc_id", "source", "n_tokens", "o")
    # lengths are exact and no longer than what is left: as many at most as it has tokens
    lengths: dict[str, dict[int, int]] = {}
    for r in rest.groupBy("source", "n_tokens").count().collect():
        lengths.setdefault(r.source, {})[r.n_tokens] = r["count"]
    chosen = [(s, n, lengths[s][n], c) for s in lengths for n, c in fit_budget(lengths[s], left[s]).items()]
    out = mine.join(_picked(rest, chosen), "doc_id", "left")
    repeats = F.col("whole") + F.when(F.col("bulk"), 1).otherwise(F.coalesce("once", F.lit(0)))
    return out.select("doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")


def mix_shares(docs: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """(source, target_share, documents, tokens, reached_share) of every target source;
    shares are of all tokens of `docs`."""
    total = docs.agg(F.sum("n_tokens").alias("all_tokens"))
    used = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    t = targets.select("source", "target_share").join(used, "source", "left").crossJoin(F.broadcast(total))  # one row
    tokens = F.coalesce("tokens", F.lit(0))
    return t.select("source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), tokens.alias("tokens"), (tokens / F.col("all_tokens")).alias("reached_share"))


def _counted(spark: SparkSession, root: str) -> DataFrame:
    return cut(count_tokens(table(spark, root, "documents").select("doc_id", "source", "text")))


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the mixture that `mix_targets` asks for."""
    return mix_sources(_counted(spark, root), table(spark, root, "mix_targets"))


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """The share of all tokens each source of `mix_targets` reached."""
    docs, targets = _counted(spark, root), table(spark, root, "mix_targets")
    return mix_shares(docs, targets, mix_sources(docs, targets))
