"""Names against a list of names by similarity of matching blocks, without comparing all with all.

A ratio of t between names of together s characters has m >= t * s / 2 characters in matching blocks. Blocks are parted by at least
one character that does not match, so there are at most 1 + s - 2m of them, and the names share at least 3m - s - 1 pairs of
neighbouring characters, repeats counted. With both names' pairs in one order, rare pairs first, names that share that many
have one in common among the first of each: those few pairs are the join key (prefix filter). Counts of shared pairs and of shared
characters thin the candidates out in built-in functions; only what is left is compared block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions.validate import PAYEE_RATIO, similarity


def numbered(parts: Column) -> Column:
    """The members of an array, each with how often it came before, so that arrays intersect as multisets."""
    return F.transform(parts, lambda g, i: F.concat(g, F.size(F.filter(F.slice(parts, F.lit(1), i), lambda x: x == g)).cast("string")))


def pairs_of(name: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(name) - 1)
    return F.when(F.length(name) > 1, F.transform(at, lambda i: F.substr(name, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def least_shared(length: Column, ratio: float) -> Column:
    """Pairs that names of ``length`` characters in all share at least at the ratio."""
    return F.ceil((1.5 * ratio - 1) * length - 1 - 1e-9)


def keyed(names: DataFrame, name: str, ratio: float, frequency: DataFrame) -> DataFrame:
    """Each name once for each of its first pairs: key, name, its numbered pairs and characters."""
    rows = names.select(name).distinct().withColumns({"grams": numbered(pairs_of(F.col(name))), "letters": numbered(F.filter(F.split(name, ""), lambda c: c != ""))})
    shortest = F.length(name) + F.ceil(F.length(name) * ratio / (2 - ratio))
    many = F.greatest(F.lit(0), F.size("grams") - F.greatest(least_shared(shortest, ratio), F.lit(1)) + 1).cast("int")
    ranked = rows.select(name, many.alias("many"), F.explode("grams").alias("gram")).join(frequency, "gram", "left").groupBy(name, "many").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
    heads = ranked.select(name, F.explode(F.slice("g", F.lit(1), F.col("many"))["gram"]).alias("key"))
    return heads.join(rows, name)


def best_matches(names: DataFrame, master: DataFrame, ratio: float = PAYEE_RATIO) -> DataFrame:
    """payee, master, ratio for the payees that match: the most similar of the list, the first on ties. names: payee; master:
    master, master_pos. Names of one character match nothing."""
    listed = master.select("master").distinct()
    frequency = listed.select(F.explode(numbered(pairs_of(F.col("master")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    a, b = keyed(names, "payee", ratio, frequency), keyed(listed, "master", ratio, frequency)
    b = b.withColumnsRenamed({"grams": "their_grams", "letters": "their_letters"})
    total = F.length("payee") + F.length("master")
    shared = lambda x, y: F.size(F.array_intersect(x, y))
    near = a.join(b, "key").filter((2 * F.least(F.length("payee"), F.length("master")) >= ratio * total) & (shared("grams", "their_grams") >= least_shared(total, ratio)) & (2 * shared("letters", "their_letters") >= ratio * total))
    scored = near.select("payee", "master").distinct().withColumn("ratio", F.round(similarity(F.col("payee"), F.col("master")), 6)).filter(F.col("ratio") >= ratio)
    first = scored.join(master, "master").groupBy("payee").agg(F.max_by(F.struct("master", "ratio"), F.struct("ratio", (-F.col("master_pos")).alias("p"))).alias("b"))
    return first.select("payee", "b.master", "b.ratio")
