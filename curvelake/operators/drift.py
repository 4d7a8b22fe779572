"""Schemas that drift between files: one consistent table, and every change of a file against the file before it.

Method: similarity flooding. Each file's schema and that of the file before it become graphs (fields, their JSON types,
the form of their values, their nested names); scores of node pairs start from the names and flow along equal edges until
they settle; then fields are paired off, best first, each once, where the pair is consistent with the whole corpus: two
names that stand together in any file are two quantities'. Known words of names help at the start but aren't needed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.session import cut, spread


@dataclass(frozen=True)
class Quantity:
    """A column of the consistent table: its usual JSON type, the words that name it (with weights) and its nested parts."""

    name: str
    sql_type: str
    json_type: str
    words: dict[str, float]


# The quantities of a curve point and the words that occur in their names.
CURVE_POINT = (
    Quantity("variant", "string", "string", {"variant": 3, "peptide": 2, "name": 1}),
    Quantity("metric", "string", "string", {"metric": 3, "observable": 3, "cv": 2}),
    Quantity("x", "double", "number", {"x": 3, "coord": 2, "coordinate": 3, "position": 2, "center": 2, "centre": 2}),
    Quantity("P", "double", "number", {"p": 3, "prob": 3, "probability": 3, "density": 3, "mass": 2, "norm": 2, "pnorm": 3, "weight": 1, "pmf": 0.5}),
    Quantity("F_kJ_mol", "double", "number", {"f": 3, "fe": 3, "free": 2, "energy": 2, "dg": 3, "g": 2, "kj": 1, "mol": 1, "kjmol": 1, "pmf": 0.5}),
    Quantity("F_ci_lo_kJ_mol", "double", "number", {"lo": 5, "low": 5, "lower": 5, "lb": 5, "ci": 3, "f": 1, "kj": 0.5, "mol": 0.5, "kjmol": 0.5}),
    Quantity("F_ci_hi_kJ_mol", "double", "number", {"hi": 5, "high": 5, "upper": 5, "ub": 5, "ci": 3, "f": 1, "kj": 0.5, "mol": 0.5, "kjmol": 0.5}),
    Quantity("replica", "bigint", "number", {"replica": 4, "rep": 4, "repl": 4, "replicate": 4}),
    Quantity("n_frames", "bigint", "number", {"frames": 4, "nframes": 4, "frame": 3, "n": 1.5, "count": 2, "samples": 2, "used": 0.5}),
    Quantity("temperature_k", "double", "number", {"t": 3, "temp": 4, "temperature": 4, "kelvin": 3, "k": 1, "pmf": 0.5}),
    Quantity("note", "string", "string", {"note": 4, "notes": 4, "comment": 4, "remark": 3}),
)

KINDS = {"number": 1, "string": 2, "boolean": 4, "array": 8, "object": 16}  # a field's JSON types as bits
EPS, LEAST = 0.05, 0.25  # the start of a pair whose names share nothing; the score a correspondence must reach, 1 being that of two equal fields
SPREAD = 0.8  # decades by which the mean size of one quantity's numbers varies between files
ROUNDS, SETTLED = 60, 1e-4


def words_of(name: str) -> list[str]:
    """The lower-case words of a field name: 'F_ci_loKJ' gives f, ci, lo, kj."""
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[a-z]+|\d+", name)
    joined = [p.lower() for p in parts]
    out: list[str] = []
    for token in re.split(r"[^A-Za-z0-9]+", name):
        if token and token.lower() not in joined:
            out.append(token.lower())
    return joined + out


def name_score(field: str, quantity: Quantity) -> float:
    """Between 0 and 1: the share of the field's words that name the quantity, weighed, and a bonus for the same name."""
    if field.lower() == quantity.name.lower():
        return 1.0
    words = words_of(field)
    if not quantity.words:
        return 0.0
    hit = sum(quantity.words.get(w, 0.0) for w in set(words))
    miss = sum(1.0 for w in set(words) if w not in quantity.words)
    best = max(quantity.words.values())
    return 0.0 if hit <= 0.5 else 0.95 * hit / (hit + miss + 0.3 * best)


def letters_score(a: str, b: str) -> float:
    """Between 0 and 1: the share of letter pairs two names have in common, letter case aside."""
    if a.lower() == b.lower():
        return 1.0
    pairs = [Counter(x[i : i + 2] for i in range(len(x) - 1)) for x in (f"^{a.lower()}$", f"^{b.lower()}$")]
    return 2 * sum((pairs[0] & pairs[1]).values()) / sum(sum(p.values()) for p in pairs)


def listed(name: str, quantities: tuple[Quantity, ...], least: float = 0.2) -> tuple[str | None, float]:
    """The quantity whose words name a field best, and its score; none below least. Ties go to the first quantity."""
    scores = [name_score(name, q) for q in quantities]
    best = int(np.argmax(scores)) if scores else 0
    return (quantities[best].name, scores[best]) if scores and scores[best] >= least else (None, 0.0)


@dataclass(frozen=True)
class Field:
    """A node of a schema graph: a field's name, JSON types (bits of KINDS), nested names (bits of a 63-bit mask), and the form
    of its values: mean decimal logarithm of their numbers (of their lengths, where text), share of whole numbers, whether text."""

    name: str
    kinds: int = 0
    nest: int = 0
    size: float | None = None
    whole: float = 0.0
    text: bool = False


def _form_score(a: Field, b: Field) -> float:
    """How alike the values of two fields are; 0 where one has none."""
    if a.size is None or b.size is None or a.text != b.text:
        return 0.0
    return float(np.exp(-((a.size - b.size) ** 2) / (2 * (3 * SPREAD if a.text else SPREAD) ** 2)) * (1 - abs(a.whole - b.whole)))


def flood(pairs: list[tuple[list[Field], list[Field]]], names: np.ndarray, rounds: int = ROUNDS, eps: float = SETTLED) -> np.ndarray:
    """Scores of all field pairs of each pair of schemas (before, now), by similarity flooding, relative to the best of the two.

    names: the start, pairs x fields x fields, padded by 0. The pairwise connectivity graph has nodes for pairs of fields,
    of their JSON types, of the forms of their values and of their nested names; a field pair passes its score on to the
    type, form and nest pair it stands at, and takes an equal share of theirs (a form counts half, a type and a nest a quarter). In every round a node's score is its start
    plus its own plus what flows in, over the largest of its kind of node. All pairs of schemas flood at once.
    """
    n, width = len(pairs), names.shape[1]
    kind, form, nest, there = (np.zeros((n, width, width)) for _ in range(4))
    types = np.zeros((n, 2, width), np.int64)
    for i, (old, new) in enumerate(pairs):
        types[i, 0, : len(old)], types[i, 1, : len(new)] = [f.kinds for f in old], [f.kinds for f in new]
        there[i, : len(old), : len(new)] = 1
        for j, f in enumerate(old):
            for k, g in enumerate(new):
                form[i, j, k] = _form_score(f, g)
                either = bin(f.nest | g.nest).count("1")
                nest[i, j, k] = bin(f.nest & g.nest).count("1") / either if either else 0.0
    bits = np.arange(len(KINDS))
    of = [((t[:, :, None] >> bits) & 1).astype(float) for t in (types[:, 0], types[:, 1])]  # pairs x fields x types
    kind_start = np.broadcast_to(np.where(np.eye(len(KINDS)) > 0, 1.0, 0.1), (n, len(KINDS), len(KINDS)))
    shares = np.maximum(of[0].sum(1)[:, :, None] * of[1].sum(1)[:, None, :], 1.0)
    top = lambda x: x / np.maximum(x.max((1, 2), keepdims=True), 1e-12)
    field_start = np.where(there > 0, np.maximum(names, EPS), 0.0)
    field, kind, form_now, nest_now = field_start, kind_start, form, nest
    if not rounds:
        return top(field)
    for _ in range(rounds):
        sent = field_start + field
        flow = 0.25 * (of[0] @ ((kind_start + kind) / shares) @ of[1].transpose(0, 2, 1)) + 0.5 * (form + form_now) + 0.25 * (nest + nest_now)
        new = top(there * (sent + flow))
        kind = top(kind_start + kind + of[0].transpose(0, 2, 1) @ sent @ of[1] / shares)
        form_now = top(form + form_now + np.where(form > 0, sent, 0.0))
        nest_now = top(nest + nest_now + np.where(nest > 0, sent, 0.0))
        moved = np.abs(new - field).max(initial=0.0)
        field = new
        if moved < eps:
            break
    return field


def correspondences(pairs: list[tuple[list[Field], list[Field]]], apart: list[set[tuple[str, str]]], quantities: tuple[Quantity, ...] = CURVE_POINT, rounds: int = ROUNDS, known: dict | None = None) -> list[list[tuple[str, str]]]:
    """(name before, name now) of the fields that go on under another name, for each pair of schemas.

    Names give the start: equal names 1, names listed under one quantity more than a half, else their letters. Consistent
    are pairs whose names never stand in one file (apart), aren't listed under two quantities, and reach LEAST; of those
    the best are taken first, each field once. Equal names always belong together. Ties go to the smaller names.
    """
    known = {} if known is None else known
    if not pairs:
        return []
    width = max(max(len(a), len(b)) for a, b in pairs)
    names, barred = np.zeros((len(pairs), width, width)), np.zeros((len(pairs), width, width), bool)
    for i, (old, new) in enumerate(pairs):
        for j, f in enumerate(old):
            for k, g in enumerate(new):
                key = (f.name, g.name)
                if key not in known:
                    (qa, sa), (qb, sb) = (known.get(x) or known.setdefault(x, listed(x, quantities)) for x in key)
                    start = 1.0 if f.name == g.name else 0.6 + 0.4 * min(sa, sb) if qa and qa == qb else 0.6 * letters_score(*key)
                    known[key] = (start, bool(qa and qb and qa != qb))
                names[i, j, k], barred[i, j, k] = known[key]
                barred[i, j, k] |= (min(key), max(key)) in apart[i]
    scores = flood(pairs, np.where(barred, 0.0, names), rounds)
    out = []
    for i, (old, new) in enumerate(pairs):
        both = {f.name for f in old} & {f.name for f in new}
        free = [(-scores[i, j, k], f.name, g.name) for j, f in enumerate(old) for k, g in enumerate(new) if f.name not in both and g.name not in both and not barred[i, j, k] and scores[i, j, k] >= LEAST]
        used: set[tuple[int, str]] = set()
        found = []
        for _, f, g in sorted(free):
            if (0, f) not in used and (1, g) not in used:
                used |= {(0, f), (1, g)}
                found.append((f, g))
        out.append(found)
    return out


_FIELD = "struct<name: string, kinds: int, nest: bigint, size: double, whole: double, text: boolean>"

_EXPLODED = """
SELECT l.file_id, l.stream, l.file_seq, e.key AS name, schema_of_variant(e.value) AS shape, e.value AS value
FROM {lines} l, LATERAL variant_explode(l.whole) AS e
WHERE e.key IS NOT NULL
"""


def file_schemas(lines: DataFrame) -> DataFrame:
    """One row per file that has a complete line with a field: file_id, stream, file_seq and its fields, sorted by name.

    lines: file_id, stream, file_seq, line; further columns are ignored. A line counts if it is one whole JSON object;
    null, empty and cut lines don't. Values fold map-side to one row per file and field before anything is shuffled.
    """
    whole = F.when(F.rtrim("line").endswith("}"), F.expr("try_parse_json(line)"))
    taken = lines.where(F.col("file_id").isNotNull()).select("file_id", "stream", "file_seq", whole.alias("whole"))
    tall = lines.sparkSession.sql(_EXPLODED, lines=taken)
    shape = F.col("shape")
    kind = F.when(shape.startswith("OBJECT"), 16).when(shape.startswith("ARRAY"), 8).when(shape == "STRING", 2).when(shape == "BOOLEAN", 4).when(shape == "VOID", 0).otherwise(1).alias("kind")
    numbers = F.transform(F.expr(r"regexp_extract_all(text, '([-+]?[0-9]+([.,][0-9]+)?([eE][-+]?[0-9]+)?)', 1)"), lambda t: F.abs(F.regexp_replace(t, ",", ".").try_cast("double")))
    leads = F.regexp_extract("text", r"^\s*[-+]?[0-9]+([.,][0-9]+)?([eE][-+]?[0-9]+)?\s*([A-Za-z/%]*)\s*$", 0) != ""
    nested = F.regexp_extract_all(shape, F.lit(r"[<,] ?`?([^:<>`,]+)`?: "), 1)
    mask = F.when(F.col("kind") == 16, F.aggregate(nested, F.lit(0).cast("bigint"), lambda m, n: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(n), F.lit(63)).cast("int")))))
    each = (
        tall.select("file_id", "stream", "file_seq", "name", kind, shape, "value")
        .withColumn("text", F.when(F.col("kind").isin(2, 8, 16), F.expr("CASE WHEN kind = 2 THEN variant_get(value, '$', 'string') ELSE to_json(value) END")))
        .withColumn("number", F.when(F.col("kind") == 1, F.abs(F.expr("try_variant_get(value, '$', 'double')"))).when((F.col("kind") > 2) | leads, F.array_max(numbers)))
        .select("file_id", "stream", "file_seq", "name", "kind", F.coalesce(mask, F.lit(0).cast("bigint")).alias("nest"), "number", F.length("text").alias("length"))
    )
    counted = F.col("number") > 0
    fields = each.groupBy("file_id", "stream", "file_seq", "name").agg(
        F.bit_or("kind").cast("int").alias("kinds"),
        F.bit_or("nest").alias("nest"),
        F.avg(F.when(counted, F.log10("number"))).alias("size"),
        F.coalesce(F.avg(F.when(counted, (F.col("number") == F.floor("number")).cast("double"))), F.lit(0.0)).alias("whole"),
        F.avg(F.when(F.col("number").isNull() & (F.col("length") > 0), F.log10("length"))).alias("length"),
    )
    text = F.col("size").isNull() & F.col("length").isNotNull()
    entry = F.struct("name", "kinds", "nest", F.coalesce("size", "length").alias("size"), "whole", text.alias("text"))
    return cut(fields.groupBy("file_id", "stream", "file_seq").agg(F.array_sort(F.collect_list(entry)).alias("fields")), "files")


def previous_in_stream(files: DataFrame, value: str, block: int = 256) -> DataFrame:
    """files with before: the value of the stream's file before it by file_seq, then file_id; null for the first.

    Streams are cut into blocks of file_seq, so that a stream with a third of all files isn't one task; only the last
    value of each block is looked up across blocks. A null file_seq orders first.
    """
    order = [F.col("file_seq").asc_nulls_first(), F.col("file_id")]
    blocked = files.withColumn("_block", F.coalesce(F.floor(F.col("file_seq") / block), F.lit(-1)))
    inside = blocked.withColumn("_inner", F.lag(F.struct(value)).over(Window.partitionBy("stream", "_block").orderBy(*order)))
    last = blocked.groupBy("stream", "_block").agg(F.max_by(F.struct(value), F.struct("file_seq", "file_id")).alias("_last"))
    across = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy("stream").orderBy("_block"))).select(F.col("stream").alias("_s"), F.col("_block").alias("_b"), "_carry")
    joined = inside.join(across, inside["stream"].eqNullSafe(across["_s"]) & (inside["_block"] == across["_b"]), "left")
    return joined.withColumn("before", F.coalesce(F.col("_inner"), F.col("_carry"))[value]).drop("_block", "_inner", "_carry", "_s", "_b")


def names_apart(files: DataFrame) -> DataFrame:
    """a < b: names that stand together in a file; as a quantity has at most one name in a file, they are two quantities'."""
    sets = files.select(F.transform("fields", lambda f: f["name"]).alias("n")).distinct()
    pairs = sets.select("n", F.explode("n").alias("a")).select("a", F.explode("n").alias("b")).where("a < b")
    return pairs.distinct()


def successions(files: DataFrame, quantities: tuple[Quantity, ...] = CURVE_POINT) -> DataFrame:
    """file_id, fields, before and renames (array of old, new) of every file that has one before it in its stream."""
    name = lambda column: F.transform(column, lambda f: f["name"])
    both = previous_in_stream(files, "fields").where(F.col("before").isNotNull()).select("file_id", "fields", "before")
    both = both.withColumn("gone", F.array_except(name("before"), name("fields"))).withColumn("come", F.array_except(name("fields"), name("before")))
    both = cut(both, "successions")
    open_ = both.where((F.size("gone") > 0) & (F.size("come") > 0))
    met = open_.select("file_id", F.explode("gone").alias("g"), "come").select("file_id", "g", F.explode("come").alias("c"))
    met = met.select("file_id", F.least("g", "c").alias("a"), F.greatest("g", "c").alias("b"))
    apart = met.join(names_apart(files), ["a", "b"]).groupBy("file_id").agg(F.collect_list(F.struct("a", "b")).alias("apart"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        node = lambda rows: [Field(**f) for f in rows]
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = batch.slice(at, 512).to_pylist()
                pairs = [(node(r["before"]), node(r["fields"])) for r in rows]
                found = correspondences(pairs, [{(p["a"], p["b"]) for p in r["apart"] or ()} for r in rows], quantities, known=known)
                yield pa.RecordBatch.from_pydict(
                    {"file_id": [r["file_id"] for r in rows], "renames": [[{"old": f, "new": g} for f, g in m] for m in found]},
                    pa.schema([("file_id", pa.int64()), ("renames", pa.list_(pa.struct([("old", pa.string()), ("new", pa.string())])))]),
                )

    asked = spread(open_.select("file_id", "fields", "before").join(apart, "file_id", "left"))
    matched = asked.mapInArrow(run, "file_id bigint, renames array<struct<old: string, new: string>>")
    closed = both.where((F.size("gone") == 0) | (F.size("come") == 0)).withColumn("renames", F.expr("CAST(array() AS array<struct<old: string, new: string>>)"))
    return open_.join(matched, "file_id").unionByName(closed).drop("gone", "come")


def schema_changes(lines: DataFrame, quantities: tuple[Quantity, ...] = CURVE_POINT) -> DataFrame:
    """file_id, field, change_kind: each change of a file against the file before it in its stream.

    added, removed, renamed and retyped as in TESTDATA.md. A field whose values are all null has no type and is never
    retyped. The first file of a stream has no change. Files without a complete line have no schema and are passed over.
    quantities: words that may occur in names; names outside these lists are matched by their letters, types, nesting
    and values. No lines: no rows.
    """
    made = successions(file_schemas(lines), quantities)
    entry = "struct<field: string, change_kind: string>"
    changes = F.expr(
        f"""flatten(array(
          transform(filter(fields, f -> NOT exists(before, b -> b.name = f.name) AND NOT exists(renames, r -> r.new = f.name)), f -> CAST((f.name, 'added') AS {entry})),
          transform(filter(before, f -> NOT exists(fields, n -> n.name = f.name) AND NOT exists(renames, r -> r.old = f.name)), f -> CAST((f.name, 'removed') AS {entry})),
          transform(renames, r -> CAST((r.new, 'renamed') AS {entry})),
          transform(filter(transform(fields, f -> (f.name AS name, f.kinds AS kinds, get(filter(renames, r -> r.new = f.name), 0).old AS old)),
            f -> f.kinds <> 0 AND exists(before, b -> b.name = coalesce(f.old, f.name) AND b.kinds <> 0 AND b.kinds <> f.kinds)), f -> CAST((f.name, 'retyped') AS {entry}))))"""
    )
    return made.select("file_id", F.explode(changes).alias("c")).select("file_id", "c.field", "c.change_kind")


def name_quantities(files: DataFrame, quantities: tuple[Quantity, ...] = CURVE_POINT) -> DataFrame:
    """name, quantity, score: which quantity each field name stands for.

    A name takes the quantity whose words name it; one outside all lists that of the names it was matched with as a rename,
    the most frequent first, on and on until no further name is reached. Names never reached are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("name").to_pylist()
            found = [listed(n, quantities) for n in names]
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "quantity": pa.array([q for q, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())})

    names = files.select(F.explode("fields.name").alias("name")).distinct()
    every = cut(names.mapInArrow(run, "name string, quantity string, score double"), "names")
    known = every.where("quantity IS NOT NULL")
    if every.where("quantity IS NULL").isEmpty():
        return known
    renames = successions(files, quantities).select(F.explode("renames").alias("r"))
    links = renames.select(F.col("r.old").alias("name"), F.col("r.new").alias("other")).unionByName(renames.select(F.col("r.new").alias("name"), F.col("r.old").alias("other")))
    links = cut(links.groupBy("name", "other").agg(F.count("*").alias("n")), "links")
    while True:
        of = known.select(F.col("name").alias("other"), "quantity")
        offers = links.join(known, "name", "left_anti").join(of, "other").groupBy("name", "quantity").agg(F.sum("n").alias("n"))
        new = cut(offers.groupBy("name").agg(F.min_by("quantity", F.struct(-F.col("n"), "quantity")).alias("quantity")).withColumn("score", F.lit(0.0)), "reached")
        if new.isEmpty():
            return known
        known = known.unionByName(new)


def number_in(text: Column) -> Column:
    """The first number of a raw JSON value: 1.5, "12,3 kJ/mol", [1.5, 0.1] and {"value": 1.5} all give one; else null."""
    value = F.when(text.startswith("{"), F.get_json_object(text, "$.value")).when(text.startswith("["), F.get_json_object(text, "$[0]")).otherwise(text)
    return F.regexp_replace(F.regexp_extract(value, r"^\s*([-+]?(?:\d+[.,]?\d*|[.,]\d+)(?:[eE][-+]?\d+)?)", 1), ",", ".").try_cast("double")


def consistent_points(lines: DataFrame, quantities: tuple[Quantity, ...] = CURVE_POINT) -> DataFrame:
    """All points in one table: file_id, line_no and one typed column per quantity; repeated lines of a file once.

    Lines that aren't whole objects are left out. Of two fields of a file that stand for one quantity the better named is taken. Values that can't be read as the column's type become null.
    """
    files = file_schemas(lines)
    held = files.select(F.col("file_id").alias("_f"), F.explode("fields.name").alias("name")).join(name_quantities(files, quantities), "name")
    best = held.groupBy("_f", "quantity").agg(F.min_by("name", F.struct(-F.col("score"), "name")).alias("name"))
    names = best.groupBy("_f").agg(F.map_from_entries(F.collect_list(F.struct("quantity", "name"))).alias("_names"))
    whole = lines.where(F.rtrim("line").endswith("}") & F.expr("try_parse_json(line)").isNotNull()).groupBy("file_id", "line").agg(F.min("line_no").alias("line_no"))
    raw = whole.withColumn("_raw", F.from_json("line", "map<string,string>")).join(names, F.col("file_id") == F.col("_f"))
    columns = []
    for q in quantities:
        text = F.try_element_at("_raw", F.try_element_at("_names", F.lit(q.name)))
        if q.sql_type == "double":
            value = number_in(text)
        elif q.sql_type == "bigint":
            value = number_in(text).cast("bigint")
        else:
            value = text
        columns.append(value.alias(q.name))
    return raw.select("file_id", "line_no", *columns)
