"""Clusters of mutually similar sequences, with their sizes and most typical members.

Method: power-iteration spectral clustering. Sequences within MOST_EDITS edits of each other get an affinity; the sparse
affinity matrix is normalised by rows; VECTORS random vectors are multiplied by it again and again, which flattens them
inside each cluster and keeps clusters apart, bridges between them notwithstanding; k-means on this embedding, seeded by
the best connected sequence of each neighbourhood, gives the clusters; and members are ranked by their affinity to the rest.

As the members of a group must all be near one another, an exact check follows: a cluster that isn't mutual is split into
mutual parts, best connected members first, and mutual parts whose members are all near one another are joined again, so
that a member cut off by a split finds its group. It leaves mutual clusters as k-means made them.

Similar pairs come from an exact segment join: of five even segments of the shorter sequence at least one is untouched
by four edits. A segment that very many sequences share (a common tag, say) is refined by the segments of what remains,
again and again, which loses no pair and keeps hot segments from meeting in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.session import cut, spread

MOST_EDITS = 4
HOT, DEPTH = 500, 5  # a key more sequences hold is refined, at most so often (by then five untouched segments are the same)
VECTORS, POWERS, LLOYD = 4, 4, 2


def sequence_of(name: Column) -> Column:
    """The longest run of letters of a name in upper case, the first of equally long ones; null without a letter."""
    runs = F.regexp_extract_all(name, F.lit(r"([\p{L}]+)"), 1)
    longest = F.array_max(F.transform(runs, F.length))
    return F.upper(F.try_element_at(F.filter(runs, lambda r: F.length(r) == longest), F.lit(1)))


def _segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of edits + 1 even segments."""
    base, extra = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        n = base + (i >= edits + 1 - extra)
        out.append((at, n))
        at += n
    return out


def _places(n: int, edits: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """(length, segment, start, size) of the keys a sequence of length n holds, and of those it asks for."""
    held = [(n, i, at, size) for i, (at, size) in enumerate(_segments(n, edits))]
    asked = []
    for m in range(max(0, n - edits), n + 1):
        gap = n - m
        for i, (at, size) in enumerate(_segments(m, edits)):
            first = max(0, at - i, at + gap - (edits - i))
            last = min(n - size, at + i, at + gap + (edits - i))
            asked += [(m, i, q, size) for q in range(first, last + 1)]
    return held, asked


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def segment_keys(texts: list[str], edits: int = MOST_EDITS) -> list[tuple[np.ndarray, np.ndarray, list, list]]:
    """(held, asked, places of held, places of asked) of each text: the hashes of its own segments, and of those it may share
    with shorter or equally long ones.

    Two sequences within edits of each other share a key which the shorter holds and the other asks for; of equally long
    ones each does. Equal hashes of different segments only cost a comparison. Texts of one length are hashed together.
    """
    by_length: dict[int, list[int]] = {}
    for at, text in enumerate(texts):
        by_length.setdefault(len(text), []).append(at)
    out: list = [None] * len(texts)
    base = np.uint64(0x100000001B3)
    with np.errstate(over="ignore"):
        for n, members in by_length.items():
            points = np.frombuffer("".join(texts[m] for m in members).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(members), n).astype(np.uint64)
            prefix, power = np.zeros((len(members), n + 1), np.uint64), np.ones(n + 1, np.uint64)
            for k in range(n):
                prefix[:, k + 1] = prefix[:, k] * base + points[:, k] + np.uint64(1)
                power[k + 1] = power[k] * base
            made = []
            for places in _places(n, edits):
                m, i, at, size = (np.array(x, np.int64) for x in zip(*places))
                window = prefix[:, at + size] - prefix[:, at] * power[size]
                made.append(_mixed(window + _mixed((m * 16 + i).astype(np.uint64) + np.uint64(1))[None, :]).view(np.int64))
            held, asked = _places(n, edits)
            for row, member in enumerate(members):
                out[member] = (made[0][row], made[1][row], held, asked)
    return out


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(r) for r in rows])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            made = segment_keys(part.column("seq").to_pylist())
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "held": _lists([m[0] for m in made]), "asked": _lists([m[1] for m in made])})


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of hot keys under a key more: a segment of what remains beside the first."""
    for batch in batches:
        for at in range(0, len(batch), 500):
            rows = batch.slice(at, 500).to_pylist()
            rests = []
            for row, made in zip(rows, segment_keys([r["rest"] for r in rows])):
                keys, places = (made[0], made[2]) if row["held"] else (made[1], made[3])
                rests += [(row, row["rest"][:q] + row["rest"][q + size :]) for k, (_, _, q, size) in zip(keys.tolist(), places) if k == row["own"]]
            out: dict[str, list] = {"id": [], "held": [], "key": [], "own": [], "rest": []}
            for (row, rest), made in zip(rests, segment_keys([r for _, r in rests])):
                own = made[0] if row["held"] else made[1]
                with np.errstate(over="ignore"):
                    both = _mixed(own.view(np.uint64) + np.array(row["key"]).astype(np.int64).view(np.uint64)).view(np.int64)
                for key, k in {*zip(both.tolist(), own.tolist())}:
                    for c, v in zip(out, (row["id"], row["held"], key, k, rest)):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("id", pa.int64()), ("held", pa.bool_()), ("key", pa.int64()), ("own", pa.int64()), ("rest", pa.string())]))


def similar_pairs(nodes: DataFrame) -> DataFrame:
    """a < b (ids), edits: all pairs of nodes (id, seq) within MOST_EDITS edits of each other.

    A key's pairs are those who hold it times those who ask for it; one held by up to HOT sequences makes work in
    proportion to the askers, whom the planner may split; one held by more is refined.
    """
    keyed = cut(spread(nodes.select("id", "seq")).mapInArrow(_keys, "id bigint, held array<bigint>, asked array<bigint>"), "keys")
    held, asked = keyed.select("id", F.explode("held").alias("key")), keyed.select("id", F.explode("asked").alias("key"))
    hot_of = lambda rows: cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"), "hot")
    meet = lambda h, a: h.select(F.col("id").alias("x"), "key").join(a.select(F.col("id").alias("y"), "key"), "key").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    hot, depth, met = hot_of(held), 1, None
    if hot.isEmpty():
        met = meet(held, asked)
    else:
        met = meet(held.join(hot, "key", "left_anti"), asked)
        warm = held.withColumn("held", F.lit(True)).unionByName(asked.withColumn("held", F.lit(False))).join(hot, "key")
        rows = warm.join(nodes.select("id", F.col("seq").alias("rest")), "id").withColumn("own", F.col("key"))
        while True:
            fine = cut(spread(rows).mapInArrow(_finer, "id bigint, held boolean, key bigint, own bigint, rest string"), "finer")
            depth += 1
            hot = hot_of(fine.where("held"))
            if depth >= DEPTH or hot.isEmpty():
                met = met.unionByName(meet(fine.where("held"), fine.where("NOT held")))
                break
            met = met.unionByName(meet(fine.where("held").join(hot, "key", "left_anti"), fine.where("NOT held")))
            rows = fine.join(hot, "key")
    seq = lambda side: nodes.select(F.col("id").alias(side), F.col("seq").alias("s" + side))
    known = met.distinct().join(seq("a"), "a").join(seq("b"), "b")
    return known.withColumn("edits", F.levenshtein("sa", "sb", MOST_EDITS)).where("edits >= 0").select("a", "b", "edits")


def similar_sequences(sequences: DataFrame) -> DataFrame:
    """a, b, edits: all pairs of distinct sequences within MOST_EDITS of each other; a is shorter, or equal and smaller."""
    nodes = sequences.select(F.xxhash64("seq").alias("id"), "seq")
    seq = lambda side: nodes.select(F.col("id").alias(side), F.col("seq").alias("s" + side))
    named = similar_pairs(nodes).join(seq("a"), "a").join(seq("b"), "b")
    first = (F.length("sa") < F.length("sb")) | ((F.length("sa") == F.length("sb")) & (F.col("sa") < F.col("sb")))
    return named.select(F.when(first, F.col("sa")).otherwise(F.col("sb")).alias("a"), F.when(first, F.col("sb")).otherwise(F.col("sa")).alias("b"), "edits")


def embed(edges: DataFrame) -> DataFrame:
    """node, seed, v0, v1, ...: the spectral embedding of the nodes of edges (src, dst, w, with loops), and the best connected
    node of each one's neighbourhood (ties: the smaller id).

    In every step a node takes the weighted mean of its neighbours' vectors, which is the product with the row-normalised
    affinities. edges are exchanged by dst once for all steps; a step costs one exchange of the means.
    """
    vs = [f"v{i}" for i in range(VECTORS)]
    start = lambda i: F.xxhash64("dst", F.lit(i)) / F.lit(2.0**63)
    mean = lambda v: (F.sum(F.col("w") * v) / F.sum("w"))
    now = edges.groupBy("src").agg(F.sum("w").alias("degree"), *[(mean(start(i)) if POWERS else F.max(F.when(F.col("src") == F.col("dst"), start(i)))).alias(v) for i, v in enumerate(vs)])
    for n in range(1, max(POWERS, 2)):
        node = now.select(F.col("src").alias("node"), F.col("degree").alias("d"), *[F.col(v).alias("of_" + v) for v in vs])
        moved = [(mean(F.col("of_" + v)) if n < POWERS else F.max(F.when(F.col("src") == F.col("dst"), F.col("of_" + v)))).alias(v) for v in vs]
        seed = F.max(F.struct(F.round("d", 9).alias("d"), (-F.col("dst")).alias("i"))).alias("s")
        now = edges.join(node, F.col("dst") == F.col("node")).groupBy("src").agg(F.sum("w").alias("degree"), seed, *moved)
    return now.select(F.col("src").alias("node"), (-F.col("s.i")).alias("seed"), *vs)


def k_means(edges: DataFrame, embedding: DataFrame) -> DataFrame:
    """node, label: the cluster of each node, after LLOYD rounds. A node may join the clusters its neighbours are in, whose
    centre lies nearest (ties: the smaller label)."""
    vs = [f"v{i}" for i in range(VECTORS)]
    placed = embedding.withColumnRenamed("seed", "label")
    for _ in range(LLOYD):
        centres = placed.groupBy("label").agg(F.array(*[F.round(F.avg(v), 9) for v in vs]).alias("c"))
        of = placed.join(centres, "label").select(F.col("node").alias("n"), F.struct("label", "c").alias("offer"))
        offers = edges.join(of, F.col("dst") == F.col("n")).groupBy(F.col("src").alias("node")).agg(F.collect_set("offer").alias("offers"))
        apart = lambda o: sum(((F.col(v) - o["c"][i]) * (F.col(v) - o["c"][i]) for i, v in enumerate(vs)), F.lit(0.0))
        best = F.array_min(F.transform("offers", lambda o: F.struct(F.round(apart(o), 9).alias("d"), o["label"].alias("label"))))
        placed = cut(offers.join(embedding.drop("seed"), "node").select("node", best["label"].alias("label"), *vs), "labels")
    return placed.select("node", "label")


def _with_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges with own and other, the labels of src and dst; edges with an end that has none are left out."""
    mine, theirs = labels.select(F.col("node").alias("src"), F.col("label").alias("own")), labels.select(F.col("node").alias("dst"), F.col("label").alias("other"))
    return edges.join(theirs, "dst").join(mine, "src")


def _mutual(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels, after every cluster that isn't mutual was split and parts that are near one another were joined."""
    both = cut(_with_labels(edges, labels), "both")
    near = both.where("own = other").groupBy("own", "src").agg(F.count("*").alias("near"))
    sizes = labels.groupBy(F.col("label").alias("own")).agg(F.count("*").alias("size"))
    split = cut(near.join(sizes, "own").groupBy("own").agg(F.min("near").alias("least"), F.first("size").alias("size")).where("least < size").select("own"), "split")
    if not split.isEmpty():
        open_ = labels.join(split, labels["label"] == split["own"], "left_semi")
        done = [labels.join(split, labels["label"] == split["own"], "left_anti")]
        inner = cut(both.where("own = other").join(split, "own", "left_semi").select("src", "dst", "w"), "inner")
        while True:
            here = _with_labels(inner, open_).where("own = other")
            weight = here.groupBy(F.col("src").alias("node"), F.col("own").alias("label")).agg(F.round(F.sum("w"), 9).alias("a"))
            ranked = cut(weight.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("a"), "node"))), "ranked")
            mine, theirs = ranked.select(F.col("node").alias("src"), "label", "rank"), ranked.select(F.col("node").alias("dst"), F.col("label").alias("other"), F.col("rank").alias("r"))
            better = inner.join(mine, "src").join(theirs, "dst").where("label = other AND r <= rank").groupBy("src", "label", "rank").agg(F.count("*").alias("n"))
            stays = F.col("n") == F.col("rank")  # near all better ones: those who stay are near one another
            parted = cut(better.withColumn("stays", stays), "parted")
            heads = parted.where("rank = 1").select("label", F.col("src").alias("head"))
            done.append(parted.where("stays").join(heads, "label").select(F.col("src").alias("node"), F.col("head").alias("label")))
            open_ = parted.where("NOT stays").select(F.col("src").alias("node"), "label")
            if open_.isEmpty():
                break
        labels = done[0]
        for part in done[1:]:
            labels = labels.unionByName(part)
        labels = cut(labels, "labels")
        both = cut(_with_labels(edges, labels), "both")
    while True:
        crossing = both.where("own <> other").groupBy("own", "other").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
        size = labels.groupBy("label").agg(F.count("*").alias("size"))
        full = crossing.join(size.select(F.col("label").alias("own"), F.col("size").alias("m")), "own").join(size.select(F.col("label").alias("other"), F.col("size").alias("o")), "other").where("n = m * o")
        order = F.struct((-F.round(F.col("w") / F.col("n"), 9)).alias("w"), F.least("own", "other").alias("l"), F.greatest("own", "other").alias("g"))
        wanted = cut(full.groupBy("own").agg(F.min_by("other", order).alias("other")), "wanted")
        if wanted.isEmpty():
            return labels
        # The best pair of all is each other's best, so every round joins some.
        back = wanted.select(F.col("own").alias("other"), F.col("other").alias("own"))
        joined = wanted.join(back, ["own", "other"]).where("own > other").select(F.col("own").alias("label"), F.col("other").alias("to"))
        labels = cut(labels.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        both = cut(_with_labels(edges, labels), "both")


def cluster(variants: DataFrame) -> DataFrame:
    """variant, cluster_key, size, affinity, place: every variant of a cluster of two or more, ranked by affinity.

    variants: a column variant; repeated names count once, null names and names without letters not at all. Variants of
    one sequence are always together, at distance 0. cluster_key is the smallest variant. affinity is the sum of the
    affinities exp(-edits / MOST_EDITS) to the other variants of the cluster; ties rank by name. Empty input: no rows.
    """
    distinct = variants.select("variant").where(F.col("variant").isNotNull()).distinct().withColumn("seq", sequence_of(F.col("variant"))).where(F.col("seq").isNotNull())
    names = cut(distinct.withColumn("id", F.xxhash64("seq")), "names")
    nodes = names.groupBy("id").agg(F.min("seq").alias("seq"), F.max("seq").alias("last"), F.count("*").alias("copies"))
    if not nodes.where("seq <> last").isEmpty():
        raise ValueError("two sequences have one 64-bit hash")
    weight = F.exp(-F.col("edits") / MOST_EDITS).alias("w")
    pairs = cut(similar_pairs(nodes), "pairs").select("a", "b", weight)
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    edges = cut(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w")).unionByName(loops), "edges")
    labels = _mutual(edges, k_means(edges, cut(embed(edges), "embedding")))

    # Sizes, keys and the rank of each member by its affinity to the other variants of the group.
    copies = labels.join(nodes.select(F.col("id").alias("node"), "copies"), "node")
    theirs = copies.select(F.col("node").alias("dst"), F.col("label").alias("other"), "copies")
    mine = labels.select(F.col("node").alias("src"), F.col("label").alias("group"))
    affinity = edges.join(theirs, "dst").join(mine, "src").where("group = other").groupBy(F.col("src").alias("id"), "group").agg((F.sum(F.col("w") * F.col("copies")) - 1).alias("affinity"))
    members = cut(names.join(affinity, "id").select("variant", "group", F.round("affinity", 9).alias("affinity")), "members")
    sizes = members.groupBy("group").agg(F.min("variant").alias("cluster_key"), F.count("*").alias("size")).where("size > 1")
    place = F.expr("row_number() over (partition by group order by affinity desc, variant)")
    return members.join(sizes, "group").withColumn("place", place).select("variant", "cluster_key", "size", "affinity", "place")


def typical_members(clustered: DataFrame, n: int = 3) -> DataFrame:
    """cluster_key, size, typical: each cluster's size and its n members of highest affinity, best first."""
    top = clustered.where(F.col("place") <= n).groupBy("cluster_key", "size").agg(F.array_sort(F.collect_list(F.struct("place", "variant"))).alias("t"))
    return top.select("cluster_key", "size", F.transform("t", lambda t: t["variant"]).alias("typical"))
