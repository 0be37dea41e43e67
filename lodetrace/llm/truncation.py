"""Texts cut off before their end, found by hashed logistic regression on how they stop.

Intact texts, cut artificially at chance places and given the marks cut texts carry, are the
positives; the same texts as they are, the negatives. Features are closing characters,
punctuation, the kind and shape of the last line, the last words (with names, numbers and
paths as classes), whether the last piece of a word is one that other texts hold whole, and
how the length stands to the lengths at which many texts stop. Some texts of the sample are
themselves cut: those that end in an open line of prose are not taken as intact, and the
others are first scored in folds, each by a model fitted on the other folds; what looks cut
is left out, and the model is fitted again. Every record is scored.

Bounds: the model is fitted on at most `TRAIN_DOCS` texts; everything else, the scores, the
counts of lengths and the vocabulary of word pieces, covers all of them.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, spread, table

#: Texts the model is fitted on.
TRAIN_DOCS = 20_000
#: Hash buckets of the features.
BUCKETS = 1 << 16
#: Score from which a text counts as cut.
THRESHOLD = 0.5
#: A feature seen in fewer rows of the sample has no weight.
LEAST_SEEN = 4
#: Weight of all cut texts together in the fit: cuts are rarer than whole texts.
CUT_WEIGHT = 0.2
FOLDS = 3
#: Greatest step of a logarithm in a feature; commonest outstanding lengths the fit draws on.
TOP_STEP, PEAKS = 6, 200
#: Copies of a joined value, so that the rows of one frequent length or piece are spread.
SALT = 16

# Marks that follow a break.
MARKS = ("", "", "", "", "", "", "…", " […", " [", "[", "...", " ...", "\r\n", "\n", "�", " [truncated]", " (", " <")

_TOKEN = re.compile(r"[^\W_]+(?:[-_./@][^\W_]+)*|[^\w\s]")
_MARK = re.compile(r"[\s�]+$|\s*(?:…|\.{3}|\[…\]?|\[\.{3}\]?|\[truncated\]?|\[|\(|<)$")
_BULLET = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_TRAILER = re.compile(r"[A-Z][A-Za-z-]{2,30}: \S+$")
_END = re.compile(r"[.!?…:;](?=\s)")
_DIGIT, _MIXED = re.compile(r"\d"), re.compile(r"[a-z][A-Z]")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_FENCE = re.compile(r"^[^\S\n]*```", re.M)
_ITEM = re.compile(r"^[^\S\n]*(?:[-*+•]|\d{1,3}[.)])[^\S\n]+[^\n]*", re.M)


def strip_marks(text: str) -> tuple[str, str]:
    """The text without blanks and marks of a break at its end, and which marks those are."""
    marks, end = [], len(text)
    while m := _MARK.search(tail := text[max(0, end - 40) : end]):
        marks.append(m[0].strip() or ("�" if "�" in m[0] else "\n" if "\n" in m[0] else " "))
        end -= len(tail) - m.start()
    return text[:end], "".join(marks)


def _klass(tok: str) -> str:
    if tok.isdigit():
        return "<n>"
    if _DIGIT.search(tok):
        return "<v>" if tok[0].isdigit() else "<x>"
    if "/" in tok or "." in tok:
        return "<p>"
    if "_" in tok or "-" in tok or _MIXED.search(tok):
        return "<i>"
    return tok.lower()


def presumed_intact(text: str) -> bool:
    """Whether a text may serve as intact in the fit: it ends with a closing character, or in
    a line that needs none (list entry, heading, trailer, code, short closing remark)."""
    body, marks = strip_marks(text)
    if not marks.strip() and body[-1:] in ".!?`})":
        return True
    line = body[body.rfind("\n") + 1 :]
    return len(line) <= 24 or bool(_BULLET.match(line) or _TRAILER.match(line) or line.startswith(("#", "```")))


class Ending(NamedTuple):
    """How a text ends: features the text alone decides, and what the others hang on."""

    piece: str  # last piece of a word, '' if the text ends otherwise
    names: list[str]
    open_word: bool  # whether the text ends in a lower-case letter
    open_end: bool  # whether no closing character ends it
    tail: str  # kind of line and class of its last token, '' where they say nothing


def ending(text: str) -> Ending:
    body, marks = strip_marks(text)
    at = end = len(body)
    while at and body[at - 1].isalpha():
        at -= 1
    piece = _CAMEL.split(body[at:])[-1].lower() if at < end else ""
    at = body.rfind("\n") + 1
    line, head = body[at:], body[:at].rstrip()
    before = head[head.rfind("\n") + 1 :]
    fence = "```" in body and len(_FENCE.findall(body)) & 1
    bullet = _BULLET.match(line)
    content = line[bullet.end() :] if bullet else line
    kind = (
        "fence" if fence else "close" if line.startswith("```") else "head" if line.startswith("#") else "trail" if _TRAILER.match(line)
        else "bullet" if bullet else "quote" if line[:1] == ">" else "comment" if line[:2] == "//" else "text"
    )
    last = body[-1:] or "empty"
    shut = last if not last.isalnum() else "A" if last.isupper() else "9" if last.isdigit() else "a"
    if bullet:
        sib = _ITEM.findall(body, 0, at)
        stops = sum(x.rstrip()[-1:] in ".!?" for x in sib)
        style = "none" if not sib else "all" if stops == len(sib) else "no" if not stops else "some"
    else:
        style = "-"
    cuts = [m.end() for m in _END.finditer(content)]
    sentence = content[cuts[-1] :] if cuts else content
    toks = _TOKEN.findall(sentence)
    first, tail = [_klass(t) for t in toks[:2]], [_klass(t) for t in toks[-4:]]
    word = body[-400:].rsplit(None, 1)[-1] if body else ""
    f = [f"shut={shut}", f"kind={kind}", f"ks={kind}|{shut}", f"mark={marks}", f"km={kind}|{marks}|{shut in '.!?'}", f"style={style}|{shut in '.!?'}"]
    hangs = ""
    if kind in ("bullet", "text", "quote", "comment") and shut not in ".!?":
        hangs = f"{kind}|{tail[-1] if tail and tail[-1][0] == '<' else 'w'}"
        for n in (1, 2, 3, 4):
            f.append(f"{n}g={'none' if len(tail) < n else ' '.join(tail[-n:])}")
        f.append(f"open={' '.join(first)}|{len(toks)}")
        f.append(f"oe={' '.join(first)}|{tail[-1] if tail else ''}")
        f.append(f"words={min(len(toks), 20)}|{kind}")
    if len(line) <= 40:
        f.append(f"line={line}|{before[:12] if before.startswith('#') else ''}")
    f.append(f"under={before.startswith('#')}|{kind}|{shut == 'a'}")
    if kind == "trail" or "://" in word:
        f.append(f"value={line.split(':')[0][:20]}|{len(re.search(r'[^/ ]*$', body[-400:])[0])}")
    if fence or kind == "close":
        f.append(f"fence={line[:3]}|{int(fence)}")
    return Ending(piece, f, shut == "a", shut not in ".!?`}", hangs)


def known_names(e: Ending, step: int) -> list[str]:
    """Features of how many texts hold the last piece whole (`step`: its logarithm)."""
    return [f"know={step}|{e.open_word}", *([f"kk={e.tail}|{step}"] if e.tail else [])]


def limit_name(open_end: bool, step: int) -> str:
    """The feature of how much the length stands out among its neighbours."""
    return f"limit={step}|{not open_end}"


def hashed(names: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names], np.int64)


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = 12, rate: float = 0.3, ridge: float = 1e-5) -> np.ndarray:
    """Weights of a logistic regression over hashed features, the last being the bias
    (Adagrad over batches in a fixed order). All positives together weigh `CUT_WEIGHT`."""
    w = np.zeros(BUCKETS + 1)
    if not len(rows) or y.min() == y.max():
        return w
    share = np.where(y == 1, CUT_WEIGHT / y.mean(), (1 - CUT_WEIGHT) / (1 - y.mean()))
    seen = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    often = np.flatnonzero(seen >= min(LEAST_SEEN, max(1, len(rows) // 50)))
    # only buckets that have a weight are kept while fitting, numbered without gaps
    number = np.full(BUCKETS, -1)
    number[often] = np.arange(len(often))
    rows = [n[n >= 0] for n in (number[r] for r in rows)]
    full, w, g2 = w, np.zeros(len(often) + 1), np.full(len(often) + 1, 1e-8)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), 256):
            b = order[s : s + 256]
            size = np.array([len(rows[i]) for i in b])
            idx = np.concatenate([rows[i] for i in b])
            owner = np.repeat(np.arange(len(b)), size)
            z = np.bincount(owner, w[idx], len(b)) + w[-1]
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) * share[b] / len(b)
            grad = np.bincount(idx, e[owner], len(w))
            grad[-1] = e.sum()
            hit = np.flatnonzero(grad)
            g = grad[hit] + ridge * w[hit]
            g2[hit] += g * g
            w[hit] -= rate * g / np.sqrt(g2[hit])
    full[often], full[-1] = w[:-1], w[-1]
    return full


def score(w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = np.array([w[r].sum() for r in rows]) + w[-1] if rows else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_cleaned(neg: list[np.ndarray], pos: list[np.ndarray], owner: list[int]) -> np.ndarray:
    """Weights from intact rows `neg` and cut rows `pos` (row k made from intact row
    owner[k]), without the intact rows that models fitted on the other folds call cut."""
    if not pos:
        return np.zeros(BUCKETS + 1)
    fold = np.arange(len(neg)) % FOLDS
    fine = np.ones(len(neg), bool)
    for _ in range(2):  # what the first round leaves out no longer misleads the second
        looks = np.zeros(len(neg))
        for k in range(FOLDS):
            n = [i for i in range(len(neg)) if fold[i] != k and fine[i]]
            p = [j for j, i in enumerate(owner) if fold[i] != k and fine[i]]
            if n and p:
                w = fit([neg[i] for i in n] + [pos[j] for j in p], np.concatenate([np.zeros(len(n)), np.ones(len(p))]), epochs=6)
                mine = np.flatnonzero(fold == k)
                looks[mine] = score(w, [neg[i] for i in mine])
        fine = looks < THRESHOLD
    n = [neg[i] for i in np.flatnonzero(fine)]
    p = [pos[j] for j, i in enumerate(owner) if fine[i]]
    if not n or not p:
        n, p = neg, pos
    return fit(n + p, np.concatenate([np.zeros(len(n)), np.ones(len(p))]))


def artificial_cuts(text: str, seed: int, n: int = 3) -> list[str]:
    """`n` versions of the text that stop early, none of them after a whole sentence or line."""
    rng = random.Random(seed)
    out = []
    size = len(text)
    for i in range(n):
        for _ in range(6):
            at = rng.randrange(size // 4, size) if i or size < 80 else rng.randrange(size - 60, size)
            head, rest = text[:at], text[at:]
            bare = head.rstrip()
            if len(bare) < 12 or not rest.strip() or bare[-1] in ".!?`}" or "\n" in head[len(bare) :] or rest[0] in "\r\n" or re.match(r"[.!?](\s|$)", rest):
                continue
            out.append((bare if rng.random() < 0.5 else head) + rng.choice(MARKS))
            break
    return out


#: Tail of a text in which its last word and the marks after it are looked for.
TAIL = 240
_JVM_TAIL = r"\p{L}*(?:[\s\x{FFFD}]+|…|\.{3}|\[…\]?|\[\.{3}\]?|\[truncated\]?|\[|\(|<)*$"


def whole_pieces(text: Column) -> Column:
    """Distinct pieces of words (runs of letters, split where a capital follows a small
    letter), in lower case, that a text holds before its last word."""
    body = F.concat(F.substring(text, F.lit(1), F.greatest(F.length(text) - TAIL, F.lit(0))), F.regexp_replace(F.right(text, F.lit(TAIL)), _JVM_TAIL, ""))
    return F.array_remove(F.array_distinct(F.split(F.lower(F.regexp_replace(body, "([a-z])([A-Z])", "$1 $2")), r"\P{L}+")), "")


def _step(c: Column) -> Column:
    """The whole part of log2(c + 1), 6 at most; 0 for null and negative values."""
    return F.least(F.floor(F.log2(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) + 1)), F.lit(TOP_STEP)).cast("int")


def _survey(base: DataFrame, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """In one scan: vocabulary(piece, known), texts that hold each piece whole; lengths(size,
    here), different texts of each length; and (doc_id, text) of the documents that a fixed share
    by hash takes for the fit.

    All three are counted as strings, which tell themselves apart: pieces begin with a letter,
    lengths with 0, texts of the sample with 1.
    """
    taken = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)
    length = F.concat(F.lit("0"), F.length("text").cast("string"), F.lit(":"), F.xxhash64("text").cast("string"))
    sample = F.when(taken, F.array(F.concat(F.lit("1"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")))).otherwise(F.array().cast("array<string>"))
    facts = cut(base.select(F.explode(F.concat(whole_pieces(F.col("text")), F.array(length), sample)).alias("s")).groupBy("s").agg(F.count("*").alias("n")))
    kind, first = F.left("s", F.lit(1)), F.substring_index(F.substring("s", 2, 40), ":", 1)
    vocabulary = facts.where(~kind.isin("0", "1")).select(F.col("s").alias("piece"), F.col("n").alias("known"))
    lengths = facts.where(kind == "0").groupBy(first.cast("int").alias("size")).agg(F.count("*").alias("here"))
    texts = facts.where(kind == "1").select(F.when(first != "", first.cast("bigint")).alias("doc_id"), F.expr("substring(s, locate(':', s) + 1)").alias("text"))
    return vocabulary, lengths, texts


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows for the fit: the ends of texts presumed intact (cut 0) and of their artificial cuts."""
    for pdf in batches:
        got = []
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            if presumed_intact(text):
                doc = 0 if pd.isna(doc) else int(doc)
                for k, t in enumerate([text, *artificial_cuts(text, doc & 0x7FFFFFFF)]):
                    e = ending(t)
                    got.append((doc, zlib.crc32(text.encode("utf-8", "surrogatepass")), k, len(text) if not k else -1, e.piece, hashed(e.names).tolist(), e.open_word, e.open_end, e.tail))
        yield pd.DataFrame(got, columns=["doc", "of", "k", "size", "piece", "ids", "open_word", "open_end", "tail"])


EXAMPLE = "doc bigint, of bigint, k int, size int, piece string, ids array<int>, open_word boolean, open_end boolean, tail string"


def _with_known(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """`rows` with `known`, the step of each row's piece. Pieces are made distinct before the
    vocabulary is asked, and the rows of one frequent piece are spread by a salt."""
    asked = rows.where("piece <> ''").select("piece").distinct().join(vocabulary, "piece", "left").select("piece", _step(F.col("known")).alias("known"))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    spelt = rows.where("piece <> ''").withColumn("salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c not in ("piece", "ids", "steps")]), F.lit(SALT)).cast("int"))
    return spelt.join(asked, ["piece", "salt"]).drop("salt").unionByName(rows.where("piece = ''").withColumn("known", F.lit(TOP_STEP)))


def _with_limit(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """`rows` with `limit`, the step of how much each row's size stands out."""
    out = limits.select("size", _step(F.col("at_limit")).alias("limit")).where("limit > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c not in ("size", "ids", "steps")]), F.lit(SALT)).cast("int"))
    return salted.join(out, ["size", "salt"], "left").drop("salt").withColumn("limit", F.coalesce("limit", F.lit(0)))


def _fitted(examples: DataFrame, limits: DataFrame) -> np.ndarray:
    """The model's weights; the driver holds hashed features of the sample, no texts."""
    t = examples.toArrow().sort_by([(c, "ascending") for c in ("doc", "of", "k")])
    ids = t["ids"].combine_chunks()
    at, flat = np.asarray(ids.offsets), np.asarray(ids.values)
    columns = zip(*(t[c].to_pylist() for c in ("k", "piece", "open_word", "open_end", "tail", "known", "limit")))
    # lengths that stand out, the commonest ones
    peaks = limits.where("here >= 4 and at_limit >= 3").orderBy(F.desc("here"), "size").limit(PEAKS).select("here", _step(F.col("at_limit")).alias("limit")).collect()
    rng = random.Random(3)
    neg, pos, owner = [], [], []
    for i, (k, piece, open_word, open_end, tail, known, own) in enumerate(columns):
        e = Ending(piece, [], open_word, open_end, tail)
        # half of the cuts stand at a length at which many texts stop, if there are such
        limit = own if not k else rng.choices(peaks, [p.here for p in peaks])[0].limit if peaks and rng.random() < 0.5 else 0
        row = np.concatenate([flat[at[i] : at[i + 1]], hashed([*known_names(e, known), limit_name(e.open_end, limit)])])
        if not k:
            neg.append(row)
        else:
            pos.append(row)
            owner.append(len(neg) - 1)
    return fit_cleaned(neg, pos, owner)


def truncation_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep.., score): how likely each text was cut before its end.

    The texts are read twice: once for the vocabulary, the lengths and the sample, once for the
    scores. What is shuffled are counts and short rows: the part of the score that the text
    decides, and what it still hangs on, its length and its last piece of a word.

    Defined cases: null, empty and blank texts are left out (nothing stands that could have been
    cut); repeated documents are scored each; with an empty table or one whose texts are
    too short to cut, scores are 0.5 or there are no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    kept = [f"keep_{k}" for k in keep]
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *[F.col(k).alias(c) for k, c in zip(keep, kept)])
    base = spread(base).where(F.col("text").rlike(r"\S"))
    total = docs.count()  # from the files' own counts
    vocabulary, lengths, texts = _survey(base.select("doc_id", "text"), min(1.0, 1.1 * train_docs / max(total, 1)))
    around = lengths.select(F.explode(F.sequence(F.col("size") - 20, F.col("size") + 20)).alias("size"), "here").groupBy("size").agg(F.sum("here").alias("near"))
    limits = cut(lengths.join(around, "size").select("size", "here", (F.col("here") / ((F.col("near") - F.col("here")) / 40.0 + 1.0)).alias("at_limit")))
    sample = texts.orderBy(F.xxhash64("doc_id", F.lit(11)), "text").limit(train_docs)
    examples = cut(sample.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_examples, EXAMPLE))
    w = _fitted(_with_limit(_with_known(examples, vocabulary), limits), limits)
    held = spark.sparkContext.broadcast(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = held.value
        for pdf in batches:
            got = []
            for t in pdf["text"]:
                e = ending(t)
                steps = [float(w[hashed(known_names(e, s))].sum()) for s in ((TOP_STEP,) if not e.piece else range(TOP_STEP + 1))]
                z = float(w[hashed(e.names)].sum() + w[-1])
                got.append((len(t), e.piece, z if e.piece else z + steps[0], steps if e.piece else None, e.open_end))
            yield pd.concat([pdf[["doc_id", *kept]].reset_index(drop=True), pd.DataFrame(got, columns=["size", "piece", "z", "steps", "open_end"])], axis=1)

    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in kept)
    ends = cut(base.mapInPandas(run, f"doc_id bigint{fields}, size int, piece string, z double, steps array<double>, open_end boolean"))
    limit_weights = [F.array(*[F.lit(float(w[hashed([limit_name(o, s)])[0]])) for s in range(TOP_STEP + 1)]) for o in (False, True)]
    z = F.col("z") + F.coalesce(F.try_element_at("steps", F.col("known") + 1), F.lit(0.0))
    z = z + F.element_at(F.when(F.col("open_end"), limit_weights[1]).otherwise(limit_weights[0]), F.col("limit") + 1)
    scored = _with_limit(_with_known(ends, vocabulary), limits)
    return scored.select(F.col("doc_id").alias(doc_id), *[F.col(c).alias(k) for k, c in zip(keep, kept)], (1 / (1 + F.exp(-z))).alias("score"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id) of every document whose text was cut before its end."""
    return truncation_scores(table(spark, root, "documents")).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p9_share_by_source(spark: SparkSession, root: str) -> DataFrame:
    """(source, documents, cut, share): how often each source truncates."""
    scored = truncation_scores(table(spark, root, "documents"), keep=("source",))
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= THRESHOLD).alias("cut")).withColumn("share", F.col("cut") / F.col("documents"))
