"""Full-text, fuzzy and near-duplicate search over text columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.rows import col
from graphloom.plans.shared import materialise

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass
class TextIndex:
    """An inverted index written once: postings (term, key, tf, n) sorted by term, and the corpus' counts.

    A search reads the row groups of its terms only.
    """

    key: str
    postings: DataFrame
    texts: int
    words: int

    def bm25(self, terms: list[str]) -> DataFrame:
        """(key, score) of texts holding a term; idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
        terms = sorted({t.lower() for t in terms})
        found = self.postings.filter(F.col("term").isin(terms))
        held = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}  # as many rows as the query has words
        if not held:
            return found.select(self.key, F.lit(0.0).alias("score"))
        idf = F.lit(0.0)
        for term, n in held.items():
            idf = F.when(F.col("term") == term, math.log(1 + (self.texts - n + 0.5) / (n + 0.5))).otherwise(idf)
        mean = self.words / self.texts if self.words else 1.0
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / mean))
        # In the order of the terms, so that sums come out the same to the last digit.
        parts = F.array_sort(F.collect_list(F.struct("term", part.alias("part"))))
        return found.groupBy(self.key).agg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["part"]).alias("score"))


def text_index(df: DataFrame, key: str, text: str) -> TextIndex:
    """The index of a text column; null texts are empty, keys are taken to be unique."""
    words = df.select(col(key).alias(key), tokens(col(text)).alias("__t"))
    words = materialise(words.select(key, F.size("__t").alias("n"), "__t"), "words")
    counts = words.agg(F.count("*").alias("texts"), F.sum("n").alias("words")).first()
    one = words.select(key, "n", F.explode("__t").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    # A term that a third of the texts hold spreads over the partitions of its range by key.
    return TextIndex(key, materialise(one.repartitionByRange("term", key).sortWithinPartitions("term"), "postings"), counts["texts"], counts["words"] or 0)


def bm25(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, score) of the texts of a table that is searched once."""
    return text_index(df, key, text).bm25(terms)


def fuzzy(df: DataFrame, key: str, weights: dict[str, float], query: str, threshold: float = 0.4) -> DataFrame:
    """(key, score): 0 is a perfect match; the best query word counts, each field by its weight.

    A word's distance to a field is the least edit distance to one of the
    field's words, as a share of the longer; an approximation of bitap scoring.
    """
    words = query.lower().split()
    total = sum(weights.values())
    score = F.lit(0.0)
    for name, weight in weights.items():
        distance = lambda w: F.coalesce(F.array_min(F.transform(tokens(col(name)), lambda t: F.levenshtein(t, F.lit(w)) / F.greatest(F.length(t), F.lit(len(w))))), F.lit(1.0))
        score = score + F.least(*(distance(w) for w in words), F.lit(1.0)) * (weight / total)
    return df.select(col(key).alias(key), score.alias("score")).filter(F.col("score") <= threshold)


def shingle_hashes(text: Column, width: int) -> Column:
    """Distinct hashes of all runs of ``width`` words.

    The words are bound to a lambda's variable, so they are split once per text
    and not once per run.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")
    runs = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - (width - 1)), lambda i: F.xxhash64(F.array_join(F.slice(ws, i, width), " ")))
    bound = F.transform(F.array(words), lambda ws: F.when(F.size(ws) >= width, F.array_distinct(runs(ws))))
    return F.coalesce(F.element_at(bound, 1), F.array().cast("array<bigint>"))


def similar_classes(df: DataFrame, key: str, text: str, *, threshold: float = 0.85, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, links): classes of equal texts (key, class_id), and pairs of classes (a, b, jaccard) at least ``threshold`` alike.

    Exact prefix-filtered join: shingles are ordered rarest first, and two sets
    can only be alike if the first |x| - ceil(threshold |x|) + 1 of each meet.
    Nothing is sampled or capped.  Null texts have no shingles and no class
    partner but equal nulls' own rows.
    """
    rows = df.select(col(key).alias("id"), F.coalesce(col(text), F.lit("")).alias("text")).filter("id is not null").dropDuplicates(["id"])
    hashed = rows.select("id", F.md5("text").alias("m"))
    reps = hashed.groupBy("m").agg(F.min("id").alias("class_id"))
    members = hashed.join(reps, "m").select(F.col("id").alias(key), "class_id")
    sets = rows.join(reps.select(F.col("class_id").alias("id")), "id", "left_semi")
    sets = materialise(sets.select("id", shingle_hashes(F.col("text"), width).alias("s")), "shingles").filter("size(s) > 0")
    df_counts = sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    ranked = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("h")).join(df_counts, "h")
    order = Window.partitionBy("id").orderBy("df", "h")
    prefix = ranked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).filter("df > 1").select("id", "n", "h")
    a, b = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "h"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "h")
    pairs = a.join(b, "h").filter((F.col("a") < F.col("b")) & (F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na"))).select("a", "b").distinct()
    sa, sb = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(sa, "a").join(sb, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    j = F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))
    return members, both.select("a", "b", j.alias("jaccard")).filter(F.col("jaccard") >= threshold)
