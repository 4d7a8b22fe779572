"""Queries of the general training-data operators over the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curvelake.operators import compact, drift, grid, wide
from curvelake.session import table

TARGET_BYTES = 1 << 20  # the chunks of the test tables are tiny; production writes 128 MB


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "export_lines"))


def p1_points(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_points(table(spark, d, "export_lines"))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.widen(table(spark, d, "summary"), table(spark, d, "attribute_catalog"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.filled(_wide(spark, d))


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    made = _wide(spark, d)
    return made.select(*[f"`{c}`" for c in made.columns if not c.endswith("__row_id")])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    made = grid.regular_grid(table(spark, d, "pmf"), table(spark, d, "metric_grid"), ("F_kJ_mol",))
    return made.where("F_kJ_mol_filled").select("curve_id", "cell")


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(table(spark, d, "pmf"), table(spark, d, "metric_grid"))


def _consolidated(spark: SparkSession, d: str) -> DataFrame:
    return compact.consolidate(table(spark, d, "chunk_files"), table(spark, d, "chunk_rows"), TARGET_BYTES)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _consolidated(spark, d).where("repeats").select("file_id", "row_no")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """The records of the large files, each once."""
    return _consolidated(spark, d).where("NOT repeats").drop("repeats")


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    return compact.plan_groups(table(spark, d, "chunk_files"), TARGET_BYTES)


def p7_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return compact.reconcile(table(spark, d, "chunk_files"), _consolidated(spark, d), TARGET_BYTES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_points, p5_found, p5_wide, p6_found, p6_grid, p7_found, p7_kept, p7_plan, p7_reconcile)
}

_READ = r"""
  SELECT s.variant, c.metric, c.value_type, s.row_id, s.recorded_at,
    CASE c.value_type
      WHEN 'double' THEN CASE WHEN isfinite(try_cast(replace(regexp_extract(bare, '^([-+]?(\d+([.,]\d*)?|[.,]\d+)([eE][-+]?\d+)?)$', 1), ',', '.') AS DOUBLE)) THEN bare END
      WHEN 'bigint' THEN CASE WHEN regexp_full_match(val, '[-+]?\d+([.,]0*)?') THEN val END
      WHEN 'boolean' THEN CASE WHEN lower(val) IN ('true', 'false', 'yes', 'no', '1', '0') THEN val END
      ELSE nullif(val, '') END AS value
  FROM (SELECT * REPLACE (trim(val) AS val) FROM summary) s
  JOIN attribute_catalog c ON lower(regexp_replace(s.metric, '[^a-zA-Z0-9]', '', 'g')) = lower(regexp_replace(c.metric, '[^a-zA-Z0-9]', '', 'g')),
  LATERAL (SELECT CASE WHEN c.unit IS NOT NULL AND ends_with(s.val, c.unit) THEN rtrim(left(s.val, length(s.val) - length(c.unit))) ELSE s.val END AS bare)
"""

# The attributes of the catalog, as the columns of the wide table.
_WIDE = {
    "rg__mean": "DOUBLE", "rg__std": "DOUBLE", "rg__median": "DOUBLE", "e2e__mean": "DOUBLE", "e2e__std": "DOUBLE", "sasa__mean": "DOUBLE", "sasa__iqr": "DOUBLE",
    "rmsd__mean": "DOUBLE", "rmsd__skew": "DOUBLE", "phi_res4__circular_mean_deg": "DOUBLE", "psi_res4__circular_mean_deg": "DOUBLE", "phi_res9__circular_std_deg": "DOUBLE",
    "rg__effective_support_frac": "DOUBLE", "rg__global_basin_escape_barrier_kt": "DOUBLE", "rg__local_ruggedness_kt": "DOUBLE",
    "rg__n_basins_persist_2kt": "BIGINT", "e2e__n_basins_persist_2kt": "BIGINT", "rg__n": "BIGINT", "e2e__n": "BIGINT", "pmf_n_bins": "BIGINT",
    "rg__pmf_is_multimodal": "BOOLEAN", "e2e__global_basin_touches_boundary": "BOOLEAN", "pmf_input_type": "VARCHAR", "seq_parse_method": "VARCHAR",
}
_TYPED = {
    "DOUBLE": "TRY_CAST(replace(value, ',', '.') AS DOUBLE)",
    "BIGINT": r"TRY_CAST(regexp_extract(value, '^([-+]?\d+)', 1) AS BIGINT)",
    "BOOLEAN": "lower(value) IN ('true', 'yes', '1')",
    "VARCHAR": "value",
}
_BEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, metric ORDER BY recorded_at DESC NULLS LAST, row_id) AS n FROM ({_READ}) WHERE value IS NOT NULL AND variant IS NOT NULL) WHERE n = 1)"
_FOLDER = "coalesce(regexp_replace(path, '/[^/]*$', ''), '')"
_PLAN = f"""(SELECT file_id, path, n_rows, n_bytes, offset_bytes, offset_bytes // {TARGET_BYTES} AS group_no FROM (
  SELECT file_id, path, coalesce(n_rows, 0) AS n_rows, coalesce(n_bytes, 0) AS n_bytes,
    CAST(coalesce(sum(coalesce(n_bytes, 0)) OVER (ORDER BY CAST('0x' || substr(md5({_FOLDER}), 1, 3) AS INTEGER), {_FOLDER}, file_id, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_bytes
  FROM chunk_files WHERE file_id IS NOT NULL))"""
_MARKED = """(SELECT *, row_number() OVER (
    PARTITION BY lower(trim(variant)), lower(trim(metric)), replica, round(x, 6) + 0.0, round(P, 6) + 0.0, round(F_kJ_mol, 6) + 0.0 ORDER BY file_id, row_no) > 1 AS repeats
  FROM chunk_rows)"""

# The names the quantities have in the test table. The operator doesn't know them; the SQL must.
_NAMES = {
    "P": ("P", "p", "prob", "prob_mass", "probability", "density", "Pnorm", "P_mass"),
    "F_kJ_mol": ("F_kJ_mol", "F", "fe", "dG_kJ", "free_energy", "F_kJmol", "pmf_F_kJmol", "f_kj_mol"),
    "F_ci_lo_kJ_mol": ("F_ci_lo_kJ_mol", "F_ci_lo_kJmol"), "F_ci_hi_kJ_mol": ("F_ci_hi_kJ_mol", "F_ci_hi_kJmol"),
    "n_frames": ("n_frames", "nframes", "frames_used"), "temperature_k": ("pmf_temperature_K", "T_K", "temp"), "replica": ("replica", "rep"),
}
_QUANTITY = "CASE field " + " ".join(f"WHEN '{n}' THEN '{q}'" for q, names in _NAMES.items() for n in names) + " ELSE field END"
_SCHEMAS = f"""
l AS (SELECT file_id, stream, file_seq, line FROM export_lines WHERE json_valid(line) AND line LIKE '{{%}}'),
k AS (SELECT file_id, stream, file_seq, line, unnest(json_keys(line)) AS field FROM l),
t AS (SELECT *, CASE json_type(line, '$."' || field || '"') WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind FROM k),
s AS (SELECT file_id, stream, file_seq, field, {_QUANTITY} AS quantity, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds FROM t GROUP BY 1, 2, 3, 4),
f AS (SELECT file_id, lag(file_id) OVER (PARTITION BY stream ORDER BY file_seq, file_id) AS before FROM (SELECT DISTINCT file_id, stream, file_seq FROM s)),
n AS (SELECT f.file_id, quantity, field, kinds FROM f JOIN s ON f.file_id = s.file_id WHERE before IS NOT NULL), o AS (SELECT f.file_id, quantity, field, kinds FROM f JOIN s ON f.before = s.file_id),
c AS (SELECT file_id, quantity, n.field AS f1, o.field AS f0, n.kinds AS k1, o.kinds AS k0 FROM n FULL JOIN o USING (file_id, quantity))"""

SQL: dict[str, str] = {
    "p1_found": f"""WITH {_SCHEMAS}
SELECT file_id, f1 AS field, 'added' AS change_kind FROM c WHERE f0 IS NULL UNION ALL SELECT file_id, f0, 'removed' FROM c WHERE f1 IS NULL
UNION ALL SELECT file_id, f1, 'renamed' FROM c WHERE f0 <> f1 UNION ALL SELECT file_id, f1, 'retyped' FROM c WHERE k0 <> k1""",
    "p5_found": f"SELECT variant, metric, row_id FROM {_BEST}",
    "p5_wide": "SELECT variant, " + ", ".join(f"max({_TYPED[t]}) FILTER (metric = '{c}') AS \"{c}\"" for c, t in _WIDE.items()) + f" FROM {_BEST} GROUP BY variant",
    "p6_found": """
WITH c AS (SELECT DISTINCT curve_id, metric FROM pmf WHERE curve_id IS NOT NULL AND metric IS NOT NULL),
r AS (
  SELECT DISTINCT curve_id, metric, CAST(floor((w - x_start) / x_step) AS INTEGER) AS cell FROM (
    SELECT p.*, g.x_start, g.x_step, CASE WHEN g.is_periodic THEN p.x - 360 * floor((p.x - g.x_start) / 360) ELSE p.x END AS w
    FROM pmf p JOIN metric_grid g ON p.metric = g.metric WHERE isfinite(p.F_kJ_mol) AND isfinite(p.x))
)
SELECT a.curve_id, a.cell FROM (SELECT c.curve_id, c.metric, CAST(unnest(range(g.n_cells)) AS INTEGER) AS cell FROM c JOIN metric_grid g ON c.metric = g.metric) a
ANTI JOIN r ON a.curve_id = r.curve_id AND a.metric = r.metric AND a.cell = r.cell""",
    "p7_found": f"SELECT file_id, row_no FROM {_MARKED} WHERE repeats",
    "p7_kept": f"SELECT r.* EXCLUDE (repeats), coalesce(p.group_no, -1) AS group_no FROM {_MARKED} r LEFT JOIN (SELECT file_id, min(group_no) AS group_no FROM {_PLAN} GROUP BY file_id) p ON r.file_id = p.file_id WHERE NOT repeats",
    "p7_plan": f"SELECT * FROM {_PLAN}",
    "p7_reconcile": f"""
SELECT file_id, coalesce(group_no, -1) AS group_no, listed_rows, coalesce(kept_rows, 0) AS kept_rows, coalesce(repeated_rows, 0) AS repeated_rows,
  coalesce(listed_rows = coalesce(kept_rows, 0) + coalesce(repeated_rows, 0), false) AS whole
FROM (SELECT file_id, min(group_no) AS group_no, CAST(sum(n_rows) AS BIGINT) AS listed_rows FROM {_PLAN} GROUP BY file_id)
FULL JOIN (SELECT file_id, count(*) FILTER (NOT repeats) AS kept_rows, count(*) FILTER (repeats) AS repeated_rows FROM {_MARKED} GROUP BY file_id) USING (file_id)""",
}
