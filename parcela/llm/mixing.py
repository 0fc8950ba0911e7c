"""Mixing of sources to target weights by Poisson replication.

Each source gets a repetition rate (target rows / rows it has). A document
appears k times, k being the inverse of the Poisson distribution with that mean
at a number in [0, 1) hashed from the seed and the document's key. So the choice
needs no shared state, and re-running a lost task repeats it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import small_or_stored
from .names import set_apart

SEED = 7
# exp(-rate) stays far from underflow up to here; larger rates are sums of parts.
RATE_PART = 256
# Sources are evened out by this power of their size.
TEMPERATURE = 0.7


def tempered_weights(docs: DataFrame, source: str = "source", power: float = TEMPERATURE) -> DataFrame:
    """Target weight of each source: its number of rows to the given power."""
    return docs.groupBy(source).agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def repetition_rates(docs: DataFrame, weights: DataFrame, source: str = "source", rows: int | None = None) -> DataFrame:
    """Rate per source of ``docs`` (``_source``, ``rate``). ``rows`` is the size
    aimed at, that of ``docs`` by default. A source without a weight, or with one
    that isn't positive and finite, has rate 0; the null source is a source."""
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("n"))
    usable = (F.col("weight") > 0) & (F.col("weight") < float("inf"))
    wanted = weights.filter(usable).groupBy(F.col(source).alias("_wanted")).agg(F.sum("weight").alias("weight"))
    both = counts.join(wanted, F.col("_source").eqNullSafe(F.col("_wanted")), "left").select(
        "_source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight")
    )
    both = small_or_stored(both)
    total, weight = both.agg(F.sum("n"), F.sum("weight")).first()
    aim = float(total or 0) if rows is None else float(rows)
    rate = F.lit(aim) * F.col("weight") / F.lit(float(weight or 0) or 1.0) / F.col("n")
    return small_or_stored(both.select("_source", rate.alias("rate")))


def _unit(*parts: Column) -> Column:
    """Uniform in [0, 1) from the 52 first bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _inverse(u: Column, rate: Column) -> Column:
    """Least k whose cumulated Poisson probability exceeds ``u``. Beyond the
    listed k the tail is below the resolution of ``u``."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))

    def step(a: Column, j: Column) -> Column:
        p = a["p"] * rate / j
        return F.struct((a["k"] + (u >= a["c"]).cast("int")).alias("k"), p.alias("p"), (a["c"] + p).alias("c"))

    most = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["k"])


def copies(rate: Column, key: Column, seed: int = SEED) -> Column:
    """How often a document appears."""
    parts = F.greatest(F.ceil(rate / RATE_PART), F.lit(1)).cast("int")
    drawn = F.transform(
        F.sequence(F.lit(1), parts), lambda i: _inverse(_unit(F.lit(seed), key, i), rate / parts)
    )
    return F.aggregate(drawn, F.lit(0), lambda a, x: a + x)


def poisson_mix(docs: DataFrame, weights: DataFrame, source: str = "source", key: str = "doc_id",
                seed: int = SEED, rows: int | None = None) -> DataFrame:
    """``docs``, each row repeated by its Poisson count, in random order, with
    ``copy`` (from 1).

    Rows of one key draw the same count. Rows without a key draw by their
    content, so that only equal ones of them draw the same. An empty table gives
    no rows. A column ``copy`` in ``docs`` is replaced.
    """
    rates = repetition_rates(docs, weights, source, rows)
    docs, named = set_apart(docs.drop("copy"), ["_source", "rate", "_k", "_key", "_place"], [source, key])
    content = F.concat(F.lit("null|"), F.xxhash64(*docs.columns).cast("string"))
    known = docs.join(rates, F.col(source).eqNullSafe(F.col("_source")), "inner")
    known = known.withColumn("_key", F.coalesce(F.col(key).cast("string"), content))
    times = known.withColumn("_k", copies(F.col("rate"), F.col("_key"), seed)).filter("_k > 0")
    repeated = times.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    place = F.xxhash64(F.lit(seed), F.lit("place"), F.col("_key"), F.col("copy"))
    mixed = repeated.withColumn("_place", place).repartition("_place").sortWithinPartitions("_place")
    return named(mixed.select(*docs.columns, "copy"))


MIX_SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*)::DOUBLE AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n) * w / (SELECT sum(w) FROM n) / n AS rate FROM n),
cdf AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
  WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
u AS (SELECT *, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|1'), 1, 13))::BIGINT
  / pow(2, 52) AS u FROM documents),
k AS (SELECT doc_id, text, lang, u.source, n_chars, count(cdf.k) AS copies FROM u LEFT JOIN cdf
  ON cdf.source IS NOT DISTINCT FROM u.source AND cdf.c <= u.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INT AS copy FROM k"""
