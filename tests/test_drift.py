import json
from dataclasses import replace

import numpy as np

from curvelake.operators import drift

COLUMNS = "file_id bigint, stream string, file_seq int, line_no int, line string, sig string"


def lines(spark, files):
    rows = []
    for fid, seq, objects in files:
        for n, o in enumerate(objects, 1):
            rows.append((fid, "s", seq, n, o if isinstance(o, str) or o is None else json.dumps(o), "clash"))
    return spark.createDataFrame(rows, COLUMNS)


def changes(spark, files):
    return sorted(tuple(r) for r in drift.schema_changes(lines(spark, files)).collect())


BASE = {"variant": "A", "metric": "rg", "x": 1.0, "P": 0.1, "F_kJ_mol": 3.0}


def test_kinds_of_change(spark):
    second = {"variant": "A", "metric": "rg", "x": 1.0, "prob_mass": "0.1", "dG_kJ": [3.0, 0.1], "note": "ok"}
    got = changes(spark, [(2, 2, [second]), (1, 1, [BASE]), (3, 3, [{k: v for k, v in second.items() if k != "note"}])])
    assert got == [(2, "dG_kJ", "renamed"), (2, "dG_kJ", "retyped"), (2, "note", "added"), (2, "prob_mass", "renamed"), (2, "prob_mass", "retyped"), (3, "note", "removed")]


def test_letter_case_counts_as_renaming(spark):
    assert changes(spark, [(1, 1, [BASE]), (2, 2, [{**{k: v for k, v in BASE.items() if k != "P"}, "p": 0.2}])]) == [(2, "p", "renamed")]


def test_broken_null_empty_and_repeated_lines_do_not_count(spark):
    bad = ["# comment", '{"variant": "A", "zzz": 1', "", None, '{"a": 1} tail', "[1]"]
    assert changes(spark, [(1, 1, [BASE, BASE, *bad]), (2, 2, [*bad, BASE])]) == []


def test_null_values_belong_but_have_no_type(spark):
    got = changes(spark, [(1, 1, [BASE]), (2, 2, [{**BASE, "P": None}]), (3, 3, [{**BASE, "P": "0.1"}])])
    assert got == []


def test_empty_table(spark):
    assert drift.schema_changes(spark.createDataFrame([], COLUMNS)).collect() == []


def test_long_stream_crosses_blocks(spark):
    files = [(i, i, [BASE if i % 2 else {**BASE, "note": "x"}]) for i in range(1, 9)]
    files = lines(spark, files)
    schemas = drift.previous_in_stream(drift.file_schemas(files), "fields", block=3)
    assert {r["file_id"]: r["before"] is not None for r in schemas.collect()} == {i: i > 1 for i in range(1, 9)}


def test_points_are_consistent(spark):
    odd = {"variant": "A", "metric": "rg", "x": "1,5", "Pnorm": {"value": 0.25, "err": 1}, "F": "12.5 kJ/mol", "rep": [3, 1], "temp": None}
    rows = drift.consistent_points(lines(spark, [(1, 1, [BASE, BASE]), (2, 2, [odd, "{"])])).orderBy("file_id").collect()
    assert len(rows) == 2
    assert (rows[1]["x"], rows[1]["P"], rows[1]["F_kJ_mol"], rows[1]["replica"], rows[1]["temperature_k"]) == (1.5, 0.25, 12.5, 3, None)


def test_words_know_all_usual_names():
    names = {"P": ["p", "prob", "probability", "density", "P_mass", "Pnorm", "prob_mass"], "F_kJ_mol": ["F", "fe", "dG_kJ", "free_energy", "f_kj_mol", "pmf_F_kJmol"], "temperature_k": ["T_K", "temp", "pmf_temperature_K"], "replica": ["rep"], "n_frames": ["nframes", "frames_used"], "F_ci_lo_kJ_mol": ["F_ci_lo_kJmol"]}
    for quantity, others in names.items():
        for other in [*others, quantity]:
            assert drift.listed(other, drift.CURVE_POINT)[0] == quantity, other
    assert drift.listed("colour", drift.CURVE_POINT) == (None, 0.0)


# Names that stand in no list: Polish for probability, free energy and temperature.
POLISH = {"variant": "A", "metric": "rg", "x": 1.0, "prawdopodobienstwo": 0.1, "energia": 3.2}
NO_WORDS = tuple(replace(q, words={}) for q in drift.CURVE_POINT)


def test_unlisted_names_are_matched_by_structure(spark):
    files = [(1, 1, [{**BASE, "F_kJ_mol": 3.3}]), (2, 2, [POLISH]), (3, 3, [{**POLISH, "temperatura": 300}]), (4, 4, [{**{k: v for k, v in POLISH.items() if k != "energia"}, "temperatura": 300, "dG": {"value": 3.1, "err": 0.1}}])]
    want = [(2, "energia", "renamed"), (2, "prawdopodobienstwo", "renamed"), (3, "temperatura", "added"), (4, "dG", "renamed"), (4, "dG", "retyped")]
    for quantities in (drift.CURVE_POINT, NO_WORDS):
        assert sorted(tuple(r) for r in drift.schema_changes(lines(spark, files), quantities).collect()) == want
    rows = drift.consistent_points(lines(spark, files)).orderBy("file_id").collect()
    assert [(r["P"], r["F_kJ_mol"]) for r in rows] == [(0.1, 3.3), (0.1, 3.2), (0.1, 3.2), (0.1, 3.1)]


def test_names_of_one_file_are_never_a_rename(spark):
    """lo goes as hi comes, alike in every respect; but another file holds both."""
    low, high = {**BASE, "F_lo": 2.5}, {**BASE, "F_hi": 2.6}
    alone = [(1, 1, [low]), (2, 2, [high])]
    assert sorted(tuple(r) for r in drift.schema_changes(lines(spark, alone), NO_WORDS).collect()) == [(2, "F_hi", "renamed")]
    assert sorted(tuple(r) for r in drift.schema_changes(lines(spark, [*alone, (3, 3, [{**low, **high}])]), NO_WORDS).collect()) == [(2, "F_hi", "added"), (2, "F_lo", "removed"), (3, "F_lo", "added")]


def test_flooding_decides_what_names_leave_open():
    number = lambda name, size, whole=0.0: drift.Field(name, 1, 0, size, whole)
    old = [number("x", 0.1), number("P", -2.0), number("F", 1.0), number("T", 2.5, 1.0)]
    new = [number("x", 0.1), number("mass", -1.8), number("zeta", 1.1), number("kelvin", 2.5, 1.0)]
    assert set(drift.correspondences([(old, new)], [set()], NO_WORDS)[0]) == {("P", "mass"), ("F", "zeta"), ("T", "kelvin")}
    assert drift.correspondences([(old, new)], [set()], NO_WORDS, rounds=0) == [[]]
    other = [number("x", 0.1), number("frames", 4.8, 1.0)]
    assert drift.correspondences([(old[:2], other)], [set()], NO_WORDS) == [[]]
    assert drift.correspondences([], []) == []
    # More rounds change nothing: the scores have settled.
    names = np.eye(4)[None]
    assert np.abs(drift.flood([(old, new)], names, 60) - drift.flood([(old, new)], names, 400)).max() < 1e-3


def test_fields_without_values_and_odd_names(spark):
    first = {**BASE, "a`: b": None, "näme": True}
    second = {**BASE, "c,<d>": None, "näme": {"x, y": 1, "z": None}}
    got = changes(spark, [(1, 1, [first]), (2, 2, [second])])
    assert got == [(2, "a`: b", "removed"), (2, "c,<d>", "added"), (2, "näme", "retyped")]
