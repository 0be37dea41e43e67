"""Versions as sortable keys: comparing, classifying and choosing among them.

npm versions that are semantic versions compare as such; all others compare by their numbers
(split at . - _ +, a part counting by the digits it begins with, absent ones as 0), and of
equal numbers the one with letters comes first. Both kinds of key have one shape, so that
any versions of an ecosystem can be ordered.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ID = r"(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)"
#: A semantic version, with or without a leading v.
SEMANTIC = rf"^\s*v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-({_ID}(?:\.{_ID})*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?\s*$"
_NONE = "array<struct<word:boolean,number:bigint,text:string>>"


def numbers(v: Column) -> Column:
    """The numbers of a version in order, without zeros at the end."""
    parts = F.transform(F.split(F.regexp_replace(v, "^v", ""), r"[.\-_+]"), lambda x: F.regexp_extract(x, r"^\s*(\d+)", 1))
    found = F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.coalesce(x.try_cast("bigint"), F.lit((1 << 63) - 1)))
    return _let(found, lambda n: F.slice(n, F.lit(1), F.coalesce(F.array_max(F.transform(n, lambda x, i: F.when(x != 0, i + 1).otherwise(0))), F.lit(0))))


def _let(value: Column, then) -> Column:
    """`then(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def semantic(v: Column, ecosystem: Column) -> Column:
    """Whether a version is compared as a semantic version."""
    return (F.lower(ecosystem) == "npm") & v.rlike(SEMANTIC)


def is_prerelease(v: Column, ecosystem: Column) -> Column:
    """A semantic version with identifiers after its numbers; of others any with a letter."""
    return F.when(semantic(v, ecosystem), F.regexp_extract(v, SEMANTIC, 4) != "").otherwise(F.regexp_replace(v, "^v", "").rlike("[A-Za-z]"))


def _numeric_key(v: Column) -> Column:
    return F.struct(numbers(v).alias("numbers"), (~v.rlike("[A-Za-z]")).alias("final"), F.array().cast(_NONE).alias("ids"))


def _semantic_key(v: Column) -> Column:
    core = F.array(*[F.regexp_extract(v, SEMANTIC, g) for g in (1, 2, 3)])
    ids = F.filter(F.split(F.regexp_extract(v, SEMANTIC, 4), r"\."), lambda x: x != "")
    ranked = F.transform(ids, lambda x: F.struct(x.rlike(r"\D").alias("word"), F.coalesce(x.try_cast("bigint"), F.lit(0)).alias("number"), x.alias("text")))
    return F.struct(numbers(F.array_join(core, ".")).alias("numbers"), (F.regexp_extract(v, SEMANTIC, 4) == "").alias("final"), ranked.alias("ids"))


def sort_key(v: Column, ecosystem: Column) -> Column:
    """A struct that orders the versions of an ecosystem; null if `v` holds no number."""
    return F.when(v.rlike(r"\d"), F.when(semantic(v, ecosystem), _semantic_key(v)).otherwise(_numeric_key(v)))


def compare(a: Column, b: Column, ecosystem: Column) -> Column:
    """-1, 0 or 1: as semantic versions if both are, else by numbers; null for a null version."""
    both = semantic(a, ecosystem) & semantic(b, ecosystem)
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1).when(x == y, 0)
    return F.when(a.isNull() | b.isNull(), None).when(both, order(_semantic_key(a), _semantic_key(b))).otherwise(order(_numeric_key(a), _numeric_key(b)))


def bump(current: Column, target: Column) -> Column:
    """major, minor or patch: the first number in which two versions differ, others counting
    as patch."""
    nth = lambda v, i: F.coalesce(F.try_element_at(numbers(v), F.lit(i)), F.lit(0))
    return F.when(current.isNull() | target.isNull(), None).when(nth(current, 1) != nth(target, 1), "major").when(nth(current, 2) != nth(target, 2), "minor").otherwise("patch")


def _ranked(versions: Column, ecosystem: Column) -> Column:
    return F.transform(F.filter(versions, lambda v: sort_key(v, ecosystem).isNotNull()), lambda v: F.struct(sort_key(v, ecosystem).alias("k"), v.alias("v")))


def ordered(versions: Column, ecosystem: Column) -> Column:
    """An array's versions from the lowest to the highest; those without a number are left out."""
    return F.transform(F.array_sort(_ranked(versions, ecosystem)), lambda x: x["v"])


def lowest(versions: Column, ecosystem: Column) -> Column:
    """The lowest version of an array."""
    return F.array_min(_ranked(versions, ecosystem))["v"]


def highest(versions: Column, ecosystem: Column) -> Column:
    """The highest version of an array."""
    return F.array_max(_ranked(versions, ecosystem))["v"]


def lowest_listed(versions: Column, ecosystem: Column) -> Column:
    """The version an upgrade note names: the lowest if all are semantic versions, else the
    first in the order of characters."""
    return F.when(F.forall(versions, lambda v: semantic(v, ecosystem)), lowest(versions, ecosystem)).otherwise(F.array_min(versions))


def event_keys(events: Column, ecosystem: Column) -> Column:
    """Range events (maps with introduced, fixed, last_affected) as array of struct(kind,
    open, key): 1 opens at `key` (or from the start), 0 closes before it, -1 closes after it.
    Null events and those of other kinds are left out; null events give no entries."""
    get = lambda e, k: F.try_element_at(e, F.lit(k))
    kind = lambda e: F.when(get(e, "introduced").isNotNull(), 1).when(get(e, "fixed").isNotNull(), 0).when(get(e, "last_affected").isNotNull(), -1)
    value = lambda e: F.coalesce(get(e, "introduced"), get(e, "fixed"), get(e, "last_affected"))
    known = F.filter(F.coalesce(events, F.array().cast("array<map<string,string>>")), lambda e: e.isNotNull() & kind(e).isNotNull())
    return F.transform(known, lambda e: F.struct(kind(e).alias("kind"), ((kind(e) == 1) & (value(e) == "0")).alias("open"), sort_key(value(e), ecosystem).alias("key")))


def within_keys(key: Column, events: Column) -> Column:
    """Whether a version's sort key lies in a range of `event_keys`, read in their order."""

    def step(inside: Column, e: Column) -> Column:
        return (
            F.when((e["kind"] == 1) & (e["open"] | (e["key"] <= key)), F.lit(True))
            .when((e["kind"] == 0) & (e["key"] <= key), F.lit(False))
            .when((e["kind"] == -1) & (e["key"] < key), F.lit(False))
            .otherwise(inside)
        )

    return F.coalesce(F.aggregate(events, F.lit(False), step), F.lit(False))


def within(v: Column, events: Column, ecosystem: Column) -> Column:
    """Whether a version lies in a range of events, which are read in order: an `introduced`
    opens, a `fixed` or `last_affected` closes. No events match nothing."""
    return within_keys(sort_key(v, ecosystem), event_keys(events, ecosystem))


#: Beyond every place of `place`.
END = "~"


def key_text(key: Column) -> Column:
    """A sort key as text that orders as the keys do and never begins another key's; null for null."""
    nth = lambda x: F.concat(F.char(F.length(x.cast("string")) + 97), x.cast("string"))
    wide = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    ids = lambda x: F.concat(x["word"].cast("int").cast("string"), wide(x["number"]), x["text"], F.lit(" "))
    return _let(key, lambda k: F.concat(F.lit("k"), F.array_join(F.transform(k["numbers"], nth), ""), F.lit(" "), k["final"].cast("int").cast("string"), F.array_join(F.transform(k["ids"], ids), ""), F.lit(" ")))


def place(v: Column, ecosystem: Column) -> Column:
    """Text that orders the versions of an ecosystem as their sort keys do, equal keys by the
    version as written; versions without a number come first."""
    return F.concat(F.coalesce(key_text(sort_key(v, ecosystem)), F.lit("a")), F.lit(" "), v)


def event_spans(events: Column, ecosystem: Column) -> Column:
    """The places that `within` is true of, as disjoint array of struct(lo, hi), without hi.

    Every event ends what is open at its place, an `introduced` opens the rest again."""
    at = lambda e: F.when(e["open"], F.lit("")).when(e["kind"] == -1, F.concat(key_text(e["key"]), F.lit("!"))).otherwise(key_text(e["key"]))
    cuts = F.filter(F.transform(event_keys(events, ecosystem), lambda e: F.struct((e["kind"] == 1).alias("opens"), at(e).alias("at"))), lambda c: c["at"].isNotNull())
    none = F.array().cast("array<struct<lo:string,hi:string>>")

    def step(spans: Column, c: Column) -> Column:
        before = F.transform(F.filter(spans, lambda s: s["lo"] < c["at"]), lambda s: F.struct(s["lo"].alias("lo"), F.least(s["hi"], c["at"]).alias("hi")))
        return F.concat(before, F.when(c["opens"], F.array(F.struct(c["at"].alias("lo"), F.lit(END).alias("hi")))).otherwise(none))

    return F.aggregate(cuts, none, step)
