"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling; SQL expressions only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsward.llm.common import SPACE, read

REST = "*"


def _even(names: list[str]) -> dict[str, float]:
    return dict.fromkeys(names, 1 / len(names))


@dataclass(frozen=True)
class Targets:
    """Shares of the tokens that each value of a dimension shall have; they need not sum to one.

    Values without a target, and null, form the value "*"; where "*" has no target of its own it keeps its share.
    """

    source: Mapping[str, float] = field(default_factory=lambda: _even([f"src{i}" for i in range(20)]))
    lang: Mapping[str, float] = field(default_factory=lambda: {"en": 0.64, "de": 0.12, "fr": 0.12, "es": 0.12})
    topic: Mapping[str, float] = field(default_factory=lambda: {"short": 0.04, "medium": 0.46, "long": 0.35, "vast": 0.15})

    def dimensions(self) -> dict[str, Mapping[str, float]]:
        return {"source": self.source, "lang": self.lang, "topic": self.topic}


#: Share of all tokens to sample at most, sweeps over the three marginals, halvings of the interval of the sampling rate.
BUDGET, SWEEPS, HALVINGS = 0.7, 25, 60
#: Share of the wanted tokens that may be missing because cells are taken whole: no reached share of a value is further
#: from its target than that.  Where the targets and the budget can't both be met, the budget gives way.
MISSING = 0.01


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def topic_by_length(n_tokens: Column) -> Column:
    """A stand-in where documents have no topic of their own."""
    return F.when(n_tokens < 100, "short").when(n_tokens < 600, "medium").when(n_tokens < 2500, "long").otherwise("vast")


def _names(targets: Mapping[str, float]) -> list[str]:
    return [*(k for k in targets if k != REST), REST]


def _array(values: list[str]) -> str:
    return f"ARRAY({', '.join(values)})"


def cell_probabilities(cells: DataFrame, targets: Targets, budget: float) -> DataFrame:
    """c0, c1, c2, probability for cells c0, c1, c2 (numbers of the values) with their tokens w.

    There are at most as many cells as combinations of configured values, so they fit in one row; the fit is one
    expression over it.  A sweep's step multiplies the factor of each value of one dimension by target over current
    sum.  A value without tokens keeps its factor; the targets are taken relative to those that have tokens.
    """
    dims = list(targets.dimensions().values())
    one = cells.where("w > 0").agg(F.sort_array(F.collect_list(F.struct("c0", "c1", "c2", F.col("w").cast("double").alias("w")))).alias("cells"))
    one = one.withColumn("total", F.expr("AGGREGATE(cells, 0D, (s, c) -> s + c.w)"))
    for d, wanted in enumerate(dims):
        names = _names(wanted)
        listed = _array([f"{float(wanted[n])}D" if n in wanted else "NULL" for n in names])
        one = one.withColumn(f"have{d}", F.expr(f"TRANSFORM(SEQUENCE(0, {len(names) - 1}), i -> IF(total > 0, AGGREGATE(FILTER(cells, c -> c.c{d} = i), 0D, (s, c) -> s + c.w) / total, 0D))"))
        rest = f"have{d}[{len(names) - 1}]"
        one = one.withColumn(f"sum{d}", F.expr(f"AGGREGATE(ZIP_WITH({listed}, have{d}, (t, h) -> IF(h > 0, t, 0D)), 0D, (s, t) -> s + COALESCE(t, 0D))"))
        scale = "1D" if REST in wanted else f"(1D - {rest})"
        one = one.withColumn(f"target{d}", F.expr(f"ZIP_WITH({listed}, have{d}, (t, h) -> IF(h > 0, IF(t IS NULL, h, try_divide(t * {scale}, sum{d})), 0D))"))
    ones = [_array(["1D"] * len(_names(w))) for w in dims]
    weight = "c.w / total * f[0][c.c0] * f[1][c.c1] * f[2][c.c2]"
    sums = "TRANSFORM(SEQUENCE(0, SIZE(g) - 1), i -> AGGREGATE(FILTER(cells, c -> CASE k % 3 WHEN 0 THEN c.c0 WHEN 1 THEN c.c1 ELSE c.c2 END = i), 0D, (s, c) -> s + {}))".format(weight)
    target = "CASE k % 3 WHEN 0 THEN target0 WHEN 1 THEN target1 ELSE target2 END"
    step = f"TRANSFORM(f, (g, d) -> IF(d = k % 3, ZIP_WITH(g, ZIP_WITH({target}, {sums}, (t, s) -> IF(s > 0, t / s, 1D)), (a, b) -> a * b), g))"
    one = one.withColumn("f", F.expr(f"AGGREGATE(SEQUENCE(0, {3 * SWEEPS - 1}), {_array(ones)}, (f, k) -> {step})"))
    one = one.withColumn("want", F.expr(f"TRANSFORM(cells, c -> {weight})"))
    # the highest rate at which the expected tokens, no document drawn more than once, are within the budget and lack little
    expected = "AGGREGATE(ZIP_WITH(cells, want, (c, x) -> LEAST(c.w, (r.lo + r.hi) / 2 * total * x)), 0D, (s, x) -> s + x)"
    top = "AGGREGATE(ZIP_WITH(cells, want, (c, x) -> IF(x > 0, c.w / (total * x), 0D)), 0D, (s, x) -> GREATEST(s, x))"
    one = one.withColumn("top", F.expr(top)).withColumn("rate", F.expr(
        f"AGGREGATE(SEQUENCE(1, {HALVINGS}), NAMED_STRUCT('lo', 0D, 'hi', top), (r, k) -> IF({expected} < {float(budget)}D * total AND {expected} >= (1 - {MISSING}D) * (r.lo + r.hi) / 2 * total, NAMED_STRUCT('lo', (r.lo + r.hi) / 2, 'hi', r.hi), NAMED_STRUCT('lo', r.lo, 'hi', (r.lo + r.hi) / 2)), r -> r.hi)"
    ))
    each = one.select(F.expr("INLINE(ZIP_WITH(cells, want, (c, x) -> NAMED_STRUCT('c0', c.c0, 'c1', c.c1, 'c2', c.c2, 'probability', LEAST(1D, rate * total * x / c.w))))"))
    return each


def drawn(doc_id: Column, text: Column, seed: int) -> Column:
    """Uniform in [0, 1) from the id, or from the text where there is none: rows that are equal are drawn alike."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mixed(docs: DataFrame, targets: Targets | None = None, budget: float = BUDGET, seed: int = 5) -> DataFrame:
    """_row (struct of all columns of docs), _tokens, _topic, _probability, _drawn for every row of docs.

    Tokens are words.  Token weights of the cells source, language, topic are raked to the three target marginals; a
    cell's sampling probability is its raked weight over its own at a common rate, at most 1: the highest rate at which
    the expected sample is `budget` of all tokens and the cells that would need more than 1 lack at most MISSING of it, so
    that every marginal is reached within MISSING of what raking gave.  Documents without tokens (null and empty texts)
    have probability 1: they carry no weight.  Columns source, lang or topic that docs lack count as null (topic: by
    length).  Rows equal in id are drawn alike; null ids by their text.  An empty table gives no rows; texts of any length
    count whole; columns of docs may have any names.
    """
    targets = targets or Targets()
    has = set(docs.columns)
    wide = docs.select(F.struct("*").alias("_row"), tokens(F.col("text")).alias("_tokens"))
    topic = F.col("_row.topic").cast("string") if "topic" in has else topic_by_length(F.col("_tokens"))
    values = [F.col(f"_row.{c}").cast("string") if c in has else F.lit(None).cast("string") for c in ("source", "lang")] + [topic]
    wide = wide.withColumn("_topic", topic)
    for d, (value, wanted) in enumerate(zip(values, targets.dimensions().values(), strict=True)):
        names = _names(wanted)
        number = F.array_position(F.array(*[F.lit(n) for n in names]), value)
        wide = wide.withColumn(f"c{d}", F.when(F.coalesce(number, F.lit(0)) == 0, len(names) - 1).otherwise(number - 1).cast("int"))
    cells = wide.groupBy("c0", "c1", "c2").agg(F.sum("_tokens").alias("w"))
    chances = F.broadcast(cell_probabilities(cells, targets, budget))  # one row for each combination of configured values at most
    joined = wide.join(chances, ["c0", "c1", "c2"], "left")
    chance = F.when(F.col("_tokens") == 0, 1.0).otherwise(F.coalesce("probability", F.lit(1.0)))
    return joined.select("_row", "_tokens", "_topic", chance.alias("_probability"), drawn(F.col("_row.doc_id"), F.col("_row.text"), seed).alias("_drawn"))


def reached(mixture: DataFrame, targets: Targets | None = None) -> DataFrame:
    """dimension, value, wanted, available, expected: for each configured value with tokens, its target (relative to
    those that have tokens; null for the rest "*"), its share of all tokens and of those the sample is expected to hold.

    mixture: as mixed() gives it.
    """
    targets = targets or Targets()
    has = set(mixture.schema["_row"].dataType.names)
    found = []
    for name, wanted in targets.dimensions().items():
        value = F.col("_topic") if name == "topic" else F.col(f"_row.{name}").cast("string") if name in has else F.lit(None).cast("string")
        known = F.when(value.isin([k for k in wanted if k != REST]), value).otherwise(REST)
        goal = F.try_element_at(F.create_map(*[F.lit(x) for k, w in wanted.items() for x in (k, float(w))]), F.col("value"))
        sums = [F.sum("_tokens").alias("all"), F.sum(F.col("_tokens") * F.col("_probability")).alias("kept")]
        found.append(mixture.groupBy(known.alias("value")).agg(*sums).select(F.lit(name).alias("dimension"), "*", goal.alias("goal")))
    every = found[0].unionByName(found[1]).unionByName(found[2]).where("all > 0")
    whole = Window.partitionBy("dimension")
    joined = every.withColumns({"available": F.col("all") / F.sum("all").over(whole), "expected": F.col("kept") / F.sum("kept").over(whole)})
    free = F.coalesce(F.sum(F.when(F.col("goal").isNull(), F.col("available"))).over(whole), F.lit(0.0))
    return joined.select("dimension", "value", (F.col("goal") * (1 - free) / F.sum("goal").over(whole)).alias("wanted"), "available", "expected")


def sample(docs: DataFrame, targets: Targets | None = None, budget: float = BUDGET, seed: int = 5) -> DataFrame:
    """The sampled rows of docs, all columns."""
    return mixed(docs, targets, budget, seed).where("_drawn < _probability").select("_row.*")


def op5_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the default targets sample, with their probability."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixed(docs).where("_drawn < _probability").select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), F.col("_row.lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_probability", 6).alias("probability"))


#: The same fit and draw with the default targets; sweeps and halvings as recursions.
OP5_SQL = r"""
WITH RECURSIVE n AS (SELECT doc_id, text, source, lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_tokens FROM documents),
d AS (SELECT *, CASE WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 600 THEN 'medium' WHEN n_tokens < 2500 THEN 'long' ELSE 'vast' END AS topic FROM n),
w(dim, name, want) AS (SELECT 0, 'src' || i, CAST(0.05 AS DOUBLE) FROM range(20) r(i)
  UNION ALL SELECT * FROM (VALUES (1, 'en', 0.64e0), (1, 'de', 0.12e0), (1, 'fr', 0.12e0), (1, 'es', 0.12e0), (2, 'short', 0.04e0), (2, 'medium', 0.46e0), (2, 'long', 0.35e0), (2, 'vast', 0.15e0))),
b AS (SELECT d.*, coalesce(a.name, '*') AS c0, coalesce(e.name, '*') AS c1, topic AS c2 FROM d LEFT JOIN w a ON a.dim = 0 AND a.name = source LEFT JOIN w e ON e.dim = 1 AND e.name = lang),
c AS (SELECT c0, c1, c2, CAST(sum(n_tokens) AS DOUBLE) AS w FROM b GROUP BY ALL HAVING sum(n_tokens) > 0),
t AS (SELECT sum(w) AS total FROM c),
h AS (SELECT 0 AS dim, c0 AS name, sum(w) / any_value(total) AS have FROM c, t GROUP BY c0 UNION ALL SELECT 1, c1, sum(w) / any_value(total) FROM c, t GROUP BY c1 UNION ALL SELECT 2, c2, sum(w) / any_value(total) FROM c, t GROUP BY c2),
g AS (SELECT h.dim, h.name, CASE WHEN h.name = '*' THEN have
    ELSE want * (1 - coalesce(sum(CASE WHEN h.name = '*' THEN have END) OVER (PARTITION BY h.dim), 0)) / sum(want) OVER (PARTITION BY h.dim) END AS target
  FROM h LEFT JOIN w ON w.dim = h.dim AND w.name = h.name),
f AS (SELECT 0 AS k, c0, c1, c2, w, w / total AS x FROM c, t
  UNION ALL SELECT k + 1, c0, c1, c2, w, x * CASE k % 3 WHEN 0 THEN g0.target / sum(x) OVER (PARTITION BY c0) WHEN 1 THEN g1.target / sum(x) OVER (PARTITION BY c1) ELSE g2.target / sum(x) OVER (PARTITION BY c2) END
  FROM f JOIN g g0 ON g0.dim = 0 AND g0.name = c0 JOIN g g1 ON g1.dim = 1 AND g1.name = c1 JOIN g g2 ON g2.dim = 2 AND g2.name = c2 WHERE k < 75),
x AS (SELECT c0, c1, c2, w, x FROM f WHERE k = 75),
a AS (SELECT list({'w': w, 'x': x}) AS cells, max(w / (total * x)) AS top, any_value(total) AS total FROM x, t),
r AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS lo, top AS hi FROM a
  UNION ALL SELECT k + 1, CASE WHEN low THEN (lo + hi) / 2 ELSE lo END, CASE WHEN low THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT *, have < 0.7e0 * total AND have >= (1 - 0.01e0) * (lo + hi) / 2 * total AS low
    FROM (SELECT r.*, total, list_sum(list_transform(cells, lambda c: least(c.w, (lo + hi) / 2 * total * c.x))) AS have FROM r, a WHERE k < 60))),
p AS (SELECT c0, c1, c2, least(1, hi * total * x / w) AS probability FROM x, t, (SELECT hi FROM r WHERE k = 60))
SELECT doc_id, source, lang, topic, n_tokens, round(CASE WHEN n_tokens = 0 THEN 1 ELSE probability END, 6) AS probability
FROM b LEFT JOIN p ON p.c0 = b.c0 AND p.c1 = b.c1 AND p.c2 = b.c2
WHERE CAST('0x' || substr(md5('5:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 12) AS BIGINT) / 281474976710656e0 < CASE WHEN n_tokens = 0 THEN 1 ELSE probability END
"""
