"""Residue sequences: composition, positions, k-mers, enrichment, class shifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.functions.names import CLASSES, RESIDUES, class_string, max_run, residue_class


def letters(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """keys, pos (from 1), aa of every residue."""
    return df.select(*keys, F.posexplode(F.split(F.col(sequence), "")).alias("_p", "aa")).where(F.col("aa").isin(*RESIDUES)).select(*keys, (F.col("_p") + 1).alias("pos"), "aa")


def composition(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """keys, aa, n, pct over the 20 residues, zeros included. Counted by text length, so no row is exploded per residue."""
    counts = F.array(*[F.struct(F.lit(a).alias("aa"), (F.length(sequence) - F.length(F.replace(F.col(sequence), F.lit(a)))).alias("n")) for a in RESIDUES])
    summed = df.where(F.col(sequence).isNotNull()).select(*keys, F.inline(counts)).groupBy(*keys, "aa").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    return summed.withColumn("pct", F.when(total > 0, 100.0 * F.col("n") / total).otherwise(0.0))


def enrichment(selected: DataFrame, background: DataFrame, pseudo: float = 0.05) -> DataFrame:
    """aa, delta_pp, fold, log2: two compositions compared, pseudo percent added to both for the fold."""
    j = selected.select("aa", F.col("pct").alias("s")).join(background.select("aa", F.col("pct").alias("b")), "aa")
    fold = (F.col("s") + pseudo) / (F.col("b") + pseudo)
    return j.select("aa", (F.col("s") - F.col("b")).alias("delta_pp"), fold.alias("fold"), F.log2(fold).alias("log2"))


def position_frequencies(df: DataFrame, sequence: str, most: int | None = None) -> DataFrame:
    """pos, aa, n, share: the share of each residue among the sequences that reach the position."""
    at = letters(df, [], sequence)
    if most is not None:
        at = at.where(F.col("pos") <= most)
    return at.groupBy("pos", "aa").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("pos")))


def grammar(selected: DataFrame, background: DataFrame) -> DataFrame:
    """pos, residue with the largest absolute difference of shares, its delta, and the total variation of the position."""
    s, b = selected.select("pos", "aa", F.col("share").alias("s")), background.select("pos", "aa", F.col("share").alias("b"))
    delta = F.coalesce("s", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    j = s.join(b, ["pos", "aa"], "full").withColumn("d", delta)
    best = F.max(F.struct(F.round(F.abs("d"), 9).alias("k"), F.col("aa"), F.col("d")))
    return j.groupBy("pos").agg(best.alias("m"), (F.sum(F.abs("d")) / 2).alias("variation")).select("pos", F.col("m.aa").alias("aa"), F.col("m.d").alias("delta"), "variation")


def kmers(df: DataFrame, keys: Sequence[str], sequence: Column, k: int) -> DataFrame:
    """keys, kmer, n: how often each stands in the sequences of a key; sequences shorter than k hold none."""
    text = df.select(*keys, sequence.alias("_s")).where(F.length("_s") >= k)
    parts = F.explode(F.transform(F.sequence(F.lit(1), F.length("_s") - k + 1), lambda i: F.substring(F.col("_s"), i, F.lit(k))))
    return text.select(*keys, parts.alias("kmer")).groupBy(*keys, "kmer").agg(F.count("*").alias("n"))


def top_kmers(df: DataFrame, sequence: str, sizes: Sequence[int] = (2, 3, 4), most: int = 256, classes: bool = False) -> DataFrame:
    """k, kmer, n: the most frequent, by count and then by text, of each size."""
    text = class_string(F.col(sequence)) if classes else F.col(sequence)
    found = None
    for k in sizes:
        one = kmers(df, [], text, k).withColumn("k", F.lit(k)).orderBy(F.desc("n"), "kmer").limit(most)
        found = one if found is None else found.unionByName(one)
    return found.select("k", "kmer", "n")


def enriched_motifs(df: DataFrame, cluster: str, sequence: str, k: int, top: int = 5) -> DataFrame:
    """cluster, kmer, n, fold, place: motifs by their share in the cluster over that in all others, 0.5 added to counts."""
    own = kmers(df, [cluster], F.col(sequence), k)
    every = own.groupBy("kmer").agg(F.sum("n").alias("_all"))
    size = own.groupBy(cluster).agg(F.sum("n").alias("_size"))
    total = own.agg(F.sum("n").alias("_total"))
    j = own.join(every, "kmer").join(size, cluster).join(F.broadcast(total))
    fold = ((F.col("n") + 0.5) / (F.col("_size") + 0.5)) / ((F.col("_all") - F.col("n") + 0.5) / (F.col("_total") - F.col("_size") + 0.5))
    w = Window.partitionBy(cluster).orderBy(F.round("fold", 9).desc(), F.desc("n"), "kmer")
    return j.withColumn("fold", fold).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(cluster, "kmer", "n", "fold", "place")


def class_shift(df: DataFrame, cluster: str, sequence: str, top: int = 4) -> DataFrame:
    """cluster, residue_class, delta_pp, place: the largest shifts of class shares against all sequences."""
    at = letters(df, [cluster], sequence).withColumn("residue_class", residue_class(F.col("aa")))
    n = at.groupBy(cluster, "residue_class").agg(F.count("*").alias("n"))
    grid = n.select(cluster).distinct().select(cluster, F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("residue_class"))
    full = grid.join(n, [cluster, "residue_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    back = F.sum("n").over(Window.partitionBy("residue_class")) / F.sum("n").over(Window.partitionBy(F.lit(1)))
    delta = 100.0 * (F.col("n") / F.sum("n").over(Window.partitionBy(cluster)) - back)
    w = Window.partitionBy(cluster).orderBy(F.round(F.abs("delta_pp"), 9).desc(), "residue_class")
    return full.withColumn("delta_pp", delta).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(cluster, "residue_class", "delta_pp", "place")


def sequence_features(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """keys and features of each sequence: length, share of each residue (aa_) and class (frac_), the class of either end as 0 or 1
    (n_term_, c_term_), net and absolute charge per residue, and the share and longest run of hydrophobic or aromatic residues
    and the longest run of G and P, over the length. One projection; an empty sequence has 0 everywhere, a null one nulls."""
    s = F.col(sequence)
    n = F.length(s)
    count = lambda chars: n - F.length(F.translate(s, chars, ""))
    over = lambda c: F.when(n > 0, c / n).when(n == 0, F.lit(0.0))
    end = lambda at, chars: (F.length(F.translate(F.substring(s, at, 1), chars, "")) < F.length(F.substring(s, at, 1))).cast("int")
    greasy = CLASSES["hydrophobic"] + CLASSES["aromatic"]
    return df.select(
        *keys, n.alias("length"), *[over(count(a)).alias(f"aa_{a}") for a in RESIDUES], *[over(count(c)).alias(f"frac_{name}") for name, c in CLASSES.items()],
        *[end(1, c).alias(f"n_term_{name}") for name, c in CLASSES.items()], *[end(-1, c).alias(f"c_term_{name}") for name, c in CLASSES.items()],
        over(count("KR") - count("DE")).alias("net_charge"), over(count("KRDE")).alias("charge_density"), over(count(greasy)).alias("hydrophobic_frac"),
        over(max_run(s, greasy)).alias("hydrophobic_run_frac"), over(max_run(s, "GP")).alias("gp_run_frac"),
    )


def one_hot(df: DataFrame, keys: Sequence[str], sequence: str, most: int | None = 64) -> DataFrame:
    """keys, column, value: long form of position x residue and position x class indicators that are 1, up to position `most`
    (None: all)."""
    at = letters(df, keys, sequence)
    if most is not None:
        at = at.where(F.col("pos") <= most)
    place = F.concat(F.lit("pos"), F.col("pos").cast("string"), F.lit("_"))
    names = F.array(F.concat(place, F.col("aa")), F.concat(place, F.lit("class_"), residue_class(F.col("aa"))))
    return at.select(*keys, F.explode(names).alias("column"), F.lit(1).alias("value"))
