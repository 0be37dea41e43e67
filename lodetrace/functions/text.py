"""Column expressions over text: entropy, scripts, places of matches, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Matches whose lengths are summed together.
RUN = 64


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def entropy(c: Column) -> Column:
    """Shannon entropy in bits a character; 0 for the empty string, null for null.

    The number of times a character occurs is what its removal shortens the string by, so the
    whole is one expression inside code generation.
    """
    n = F.length(c).cast("double")
    counts = F.transform(F.array_distinct(F.split(c, "")), lambda ch: (n - F.length(F.replace(c, ch, F.lit("")))) / n)
    bits = F.aggregate(F.filter(counts, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(c.isNull(), None).when(F.length(c) == 0, F.lit(0.0)).otherwise(bits)


# Scripts a name may mix, as Unicode names them.
SCRIPTS = ["Latin", "Cyrillic", "Greek", "Armenian", "Hebrew", "Arabic"]


def scripts(name: Column) -> Column:
    """The scripts a name is written in, in the order in which they first appear."""
    at = F.array(*[F.struct(F.regexp_instr(name, F.lit(rf"\p{{Is{s}}}")).alias("at"), F.lit(s).alias("script")) for s in SCRIPTS])
    return F.transform(F.sort_array(F.filter(at, lambda x: x.at > 0)), lambda x: x.script)


def homoglyph(name: Column) -> Column:
    """struct(suspicious, reason): mixed scripts, else characters beyond ASCII, else neither."""
    mixed, beyond = F.size(scripts(name)) > 1, name.rlike(r"[^\x00-\x7F]")
    reason = F.when(mixed, "mixed-scripts").when(beyond, "non-ascii")
    return F.struct((mixed | beyond).alias("suspicious"), reason.alias("reason"))


def bounded_levenshtein(a: Column, b: Column, most: int) -> Column:
    """Edit distance, `most` + 1 where it is greater; of an empty string the other's length."""
    d = F.levenshtein(a, b, most)
    return F.when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).when(d < 0, most + 1).otherwise(d)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.lit(1) + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def match_positions(text: Column, pattern: str, group: int = 0) -> Column:
    """array of struct(offset, match, value): every match with its 0-based offset.

    The text between matches is what a split by the pattern leaves, so the offsets are running
    sums of the lengths of pieces and matches. Sums are made over runs of `RUN` matches first and
    then within each, so that a text of n matches takes some n * sqrt(n) steps, not n * n.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    value = F.regexp_extract_all(text, F.lit(pattern), group)
    pieces = F.split(text, pattern, -1)
    one = F.struct(whole.alias("m"), value.alias("v"), F.arrays_zip(pieces.alias("p"), whole.alias("w")).alias("z"))
    step = lambda z: F.transform(z, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["w"]), F.lit(0)))
    add = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + x)

    def placed(x: Column) -> Column:
        n = F.size(x["m"])
        runs = F.transform(F.sequence(F.lit(0), F.floor(n / RUN).cast("int")), lambda r: add(F.slice(x["s"], r * RUN + 1, F.lit(RUN))))
        y = F.struct(x["m"].alias("m"), x["v"].alias("v"), x["z"].alias("z"), x["s"].alias("s"), runs.alias("r"))
        at = lambda y, i: add(F.slice(y["r"], F.lit(1), F.floor(i / RUN).cast("int"))) + add(F.slice(y["s"], F.floor(i / RUN).cast("int") * RUN + 1, i % RUN)) + F.length(F.get(y["z"], i)["p"])
        row = lambda y: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(y, i).alias("offset"), F.get(y["m"], i).alias("match"), F.get(y["v"], i).alias("value")))
        return F.when(n == 0, F.array().cast("array<struct<offset:int,match:string,value:string>>")).otherwise(F.element_at(F.transform(F.array(y), row), 1))

    summed = F.transform(F.array(one), lambda x: F.struct(x["m"].alias("m"), x["v"].alias("v"), x["z"].alias("z"), step(x["z"]).alias("s")))
    return F.element_at(F.transform(summed, placed), 1)


def tokens_over(line: Column, least: int, bits: float) -> Column:
    """Tokens of a line (split at blanks, quotes and brackets) of at least `least` characters
    and at least `bits` of entropy."""
    return F.filter(F.split(line, r"[\s\"'`()\[\]{}<>,;]+"), lambda t: (F.length(t) >= least) & (entropy(t) >= bits))
