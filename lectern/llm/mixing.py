"""Mixing sources to target weights by Poisson replication.

Each row of source s is repeated K times, K drawn from a Poisson distribution whose mean is the source's target repetition
rate: K inverts the distribution at a uniform number that a hash of the row's id and the seed gives, so a row's count
depends on nothing but itself and its source's size.  The copies are dealt out by another hash and sorted by it within
partitions: a global shuffle in one exchange, without sampling.

Defined cases: a null source is a source like another; a null id hashes as the word null; rows that repeat an id get equal
counts and keys, and are yet dealt to several partitions unless they are equal throughout; a source without target weight
goes; null, empty and very long texts are rows like others; an empty table gives an empty one; columns of the input that are
named mix_copy or mix_key are replaced, all others pass unchanged.  Rates beyond 500 are drawn as the sum of several smaller
Poisson numbers, exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many sources are sent to all executors at most; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
STEP = 500.0


def uniform(*parts: Column | str) -> Column:
    """[0, 1) in steps of 2**-52 from the MD5 of the parts joined by '|'."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str, targets: dict[str, float] | None, power: float, total: float | None) -> DataFrame:
    """Source, its rate, and the Poisson distribution function up to where it is 1.

    The target weight of a source is targets[source], or else its number of rows to `power`.
    """
    n = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("__s")).agg(F.count("*").alias("__n"))
    if targets is None:
        n = n.withColumn("__w", F.pow(F.col("__n").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in targets.items()], "__t string, __w double")  # a parameter
        n = n.join(F.broadcast(given), F.col("__s").eqNullSafe(F.col("__t"))).drop("__t")
    sums = n.agg(F.sum("__w").alias("__sw"), F.sum("__n").alias("__sn"))
    want = F.lit(float(total)) if total is not None else F.col("__sn").cast("double")
    rate = n.crossJoin(F.broadcast(sums)).where("__w > 0").withColumn("__rate", want * F.col("__w") / F.col("__sw") / F.col("__n"))  # one row is crossed
    parts = rate.withColumn("__m", F.greatest(F.lit(1), F.ceil(F.col("__rate") / STEP)).cast("int")).withColumn("__r", F.col("__rate") / F.col("__m"))
    last = F.ceil(F.col("__r") + 12 * F.sqrt("__r") + 20).cast("int")
    p0 = F.exp(-F.col("__r"))
    grown = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("all")),
        lambda a, k: F.struct((a["p"] * F.col("__r") / k).alias("p"), (a["c"] + a["p"] * F.col("__r") / k).alias("c"), F.concat(a["all"], F.array(a["c"] + a["p"] * F.col("__r") / k)).alias("all")),
        lambda a: a["all"],
    )
    return parts.select("__s", "__m", grown.alias("__cdf"))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, power: float = 0.5, total: float | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows, each as often as drawn, in a global random order, with mix_copy (0, 1, ...) and mix_key (the order).

    targets: weight by source; without, each source weighs as its number of rows to `power`.  total: expected rows out;
    without, as many as come in.
    """
    docs = docs.drop("mix_copy", "mix_key")
    by = rates(docs, source_col, targets, power, total)
    if by.count() <= BROADCAST_SOURCES:
        by = F.broadcast(by)
    row = lambda c: F.col("row").getField(c)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    ident = F.coalesce(row(id_col).cast("string"), F.lit("null"))
    draws = F.transform(F.sequence(F.lit(0), F.col("__m") - 1), lambda j: uniform(ident, F.lit(str(seed)), j.cast("string")))
    count = F.aggregate(draws, F.lit(0), lambda a, u: a + F.size(F.filter("__cdf", lambda c: c <= u)))
    out = out.join(by, row(source_col).cast("string").eqNullSafe(F.col("__s"))).select("row", count.alias("times")).where("times > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("mix_copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("order"), ident, F.lit(str(seed)), F.col("mix_copy"))), 1, 13), 16, 10).cast("long")
    out = out.withColumn("mix_key", key)
    hashed = [row(f.name) for f in docs.schema.fields if not {"map", "variant"} & set(re.findall(r"\w+", f.dataType.simpleString()))]
    return out.repartition("mix_key", F.xxhash64(*hashed)).sortWithinPartitions("mix_key").select("row.*", "mix_copy", "mix_key")
