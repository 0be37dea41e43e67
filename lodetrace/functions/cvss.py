"""CVSS base scores as column expressions over a vector's metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the metrics in the public CVSS v2 and v3.1 specifications.
V3 = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
V3_PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
V2 = {
    "AV": {"L": 0.395, "A": 0.646, "N": 1.0},
    "AC": {"H": 0.35, "M": 0.61, "L": 0.71},
    "Au": {"M": 0.45, "S": 0.56, "N": 0.704},
    "C": {"N": 0.0, "P": 0.275, "C": 0.66},
    "I": {"N": 0.0, "P": 0.275, "C": 0.66},
    "A": {"N": 0.0, "P": 0.275, "C": 0.66},
}


def metric(vector: Column, name: str) -> Column:
    """A metric's value; null if the vector has none."""
    v = F.regexp_extract(vector, rf"(?:^|/){name}:([A-Za-z]+)(?:/|$)", 1)
    return F.when(v != "", v)


def version(vector: Column) -> Column:
    """4.0, 3.1, 3.0 or 2.0; without a prefix 2.0 if there is an Au metric, else 3.1."""
    named = F.regexp_extract(vector, r"^CVSS:(\d\.\d)", 1)
    return F.when(vector.isNull(), None).when(named != "", named).when(vector.contains("Au:"), "2.0").otherwise("3.1")


def _weight(value: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, w in table.items():
        out = F.when(value == k, F.lit(w)).otherwise(out)
    return out


def round_up(x: Column) -> Column:
    """The smallest tenth not below `x`, free of floating-point residue."""
    return _let(F.floor(x * 100000 + 0.5), lambda i: F.when(i % 10000 == 0, i / 100000.0).otherwise((F.floor(i / 10000) + 1) / 10.0))


def _let(value: Column, then) -> Column:
    """`then(value)` with the value computed once; keeps the expression tree small."""
    return F.element_at(F.transform(F.array(value), then), 1)


def base_v3(vector: Column) -> Column:
    """The v3.x base score; null if a metric is missing or unknown."""
    scope = metric(vector, "S")
    weights = F.struct(
        *[_weight(metric(vector, m), t).alias(m) for m, t in V3.items()],
        F.when(scope == "C", _weight(metric(vector, "PR"), V3_PRIVILEGES["C"])).when(scope == "U", _weight(metric(vector, "PR"), V3_PRIVILEGES["U"])).alias("PR"),
        (scope == "C").alias("changed"),
    )
    parts = lambda w: F.struct((1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])).alias("iss"), (8.22 * w["AV"] * w["AC"] * w["PR"] * w["UI"]).alias("reach"), w["changed"].alias("changed"))
    impact = lambda p: F.struct(
        F.when(p["changed"], 7.52 * (p["iss"] - 0.029) - 3.25 * F.pow(p["iss"] - 0.02, F.lit(15.0))).otherwise(6.42 * p["iss"]).alias("impact"), p["reach"].alias("reach"), p["changed"].alias("changed")
    )
    total = lambda p: F.struct(F.when(p["changed"], 1.08 * (p["impact"] + p["reach"])).otherwise(p["impact"] + p["reach"]).alias("total"), p["impact"].alias("impact"))
    score = lambda t: F.when(t["total"].isNull(), None).when(t["impact"] <= 0, F.lit(0.0)).when(t["total"] >= 10, F.lit(10.0)).otherwise(round_up(t["total"]))
    return _let(_let(_let(_let(weights, parts), impact), total), score)


def base_v2(vector: Column) -> Column:
    """The v2 base score; null if a metric is missing or unknown."""
    weights = F.struct(*[_weight(metric(vector, m), t).alias(m) for m, t in V2.items()])
    parts = lambda w: F.struct((10.41 * (1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"]))).alias("impact"), (20 * w["AV"] * w["AC"] * w["Au"]).alias("reach"))
    score = lambda p: F.floor((0.6 * p["impact"] + 0.4 * p["reach"] - 1.5) * F.when(p["impact"] == 0, F.lit(0.0)).otherwise(F.lit(1.176)) * 10 + 0.5) / 10
    return _let(_let(weights, parts), score)


def base_score(vector: Column) -> Column:
    """The base score of a v2 or v3 vector; null for others and incomplete ones."""
    v = version(vector)
    return F.when(v == "2.0", base_v2(vector)).when(v.isin("3.0", "3.1"), base_v3(vector))


def severity(score: Column) -> Column:
    """critical, high, medium, low or none."""
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").when(score == 0, "none")


def severity_label(label: Column) -> Column:
    """The bucket a written label means; unknown for any other."""
    u = F.upper(label)
    return F.when(u.isin("CRITICAL", "HIGH", "LOW"), F.lower(u)).when(u.isin("MODERATE", "MEDIUM"), "medium").otherwise("unknown")


def best(vectors: Column) -> Column:
    """struct(score, vector) of the highest-scoring vector of an array, the first on a tie."""
    scored = F.transform(vectors, lambda v, i: F.struct(base_score(v).alias("score"), (-i).alias("first"), v.alias("vector")))
    top = F.array_max(F.filter(scored, lambda s: s.score.isNotNull()))
    return F.when(top.isNotNull(), F.struct(top.score.alias("score"), top.vector.alias("vector")))
