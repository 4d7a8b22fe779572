from pyspark.sql import functions as F

from curvelake.functions import names as N
from curvelake.functions import physics as P


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_column_roles():
    assert N.is_technical("rg__tau_int_frames") and N.is_technical("mbar_x") and not N.is_technical("rg__mean") and not N.is_technical("my_hopscotch")
    assert N.is_technical_pca("rg__ESS") and not N.is_technical_pca("rg__essence") and not N.is_technical_pca("variant")
    assert N.has_technical_prefix("psd_1") and not N.has_technical_prefix("x_psd_1")
    assert N.numeric_features([("variant", "string"), ("a", "double"), ("b", "decimal(3,1)"), ("mbar_c", "int"), ("d", "boolean")]) == ["a", "b"]
    assert N.preset("pmf_intrinsic", ["rg__local_ruggedness_kT", "variant"])[0] == ["local_ruggedness_kT"]
    assert N.is_core("rg__local_ruggedness_kT") and N.is_annotation("rg__x_eqpop") and N.statistic("plain") is None
    assert N.for_embedding(["a", "rg__x_eqpop"], 2, ["nm"]) == ["a"] and N.for_embedding(["a", "rg__x_eqpop"], 1, ["nm", None]) == ["a", "rg__x_eqpop"]
    assert N.spread_column("rg__median", ["rg__iqr"]) == ("rg__iqr", 0.5) and N.spread_column("p__circular_mean_deg", ["p__circular_std_deg"])[0] == "p__circular_std_deg" and N.spread_column("x", []) is None
    assert N.replica_column(["x", "Rep_ID"]) == "Rep_ID" and N.replica_column(["x", "replica_xyz"]) == "replica_xyz" and N.replica_column(["report"]) is None
    assert N.first_name(["p", "F"], N.F_NAMES) == "F" and N.family("rg|x=1") == "rg" and N.family("rg__mean") == "rg" and N.family("z") == "misc"
    assert [N.decimals(x) for x in (2.0, 0.02, 0.5, 0, None, float("nan"))] == [0, 4, 3, 6, 6, 6]
    assert N.shorten("abcdef", 4) == "abc…" and N.shorten("abc", 4) == "abc"


def test_torsions(spark):
    t = lambda s: one(spark, N.torsion(F.lit(s)))
    for name in ("phi_res12_ALA", "PHI-12-ala", "phi_ALA12"):
        assert tuple(t(name)) == ("phi", 12, "ALA"), name
    assert tuple(t("psi7")) == ("psi", 7, None) and t("rg") is None and t("phi_mean") is None
    assert one(spark, N.label(F.lit("phi_res2"), F.lit("ACD"))) == "φ C2" and one(spark, N.label(F.lit("rg"), F.lit("ACD"))) == "rg"


def test_sequences(spark):
    r = lambda s: one(spark, N.residues_in(F.lit(s)))
    assert r("pep001_ACDEFG-nh2") == "ACDEFG" and r("xx") == "" and r("aa_cc") == "AA"
    assert one(spark, N.sequence_or_name(F.lit(None), F.lit("ref_ACDE"))) == "ACDE" and one(spark, N.sequence_or_name(F.lit("ac-d"), F.lit("x"))) == "ACD"
    assert one(spark, N.max_run(F.lit("KAVLKAV"), "AVL")) == 3 and one(spark, N.max_run(F.lit(""), "A")) == 0
    assert one(spark, N.class_string(F.lit("AFSKDG"))) == "hap+-s"


def test_series_names():
    assert N.parse_series_name("X__phi_repl61_5", "VAR") == ("VAR", "phi_res5", 61)
    assert N.parse_series_name("rg_rep_2", "VAR") == ("VAR", "rg", 2) and N.parse_series_name("rg_3", None) == ("unknown", "rg", 3) and N.parse_series_name("sasa", "V") == ("V", "sasa", None)
    assert N.parse_series_tokens("rg_SAFEX_2", "dir") == ("SAFEX", "rg", 2) and N.parse_series_tokens("rg_2", "dir") == ("dir", "rg", 2) and N.parse_series_tokens("rg", None) == ("rg", "rg", None)
    assert N.parse_series_tokens("S__psi_ALA_repl143_9", "dir") == ("dir", "psi_ALA9", 143)


def test_energies_and_p_values(spark):
    assert abs(one(spark, P.kt(F.lit(300.0))) - 2.4943387854) < 1e-9 and one(spark, P.kt(F.lit(5.0), "kT")) == 1.0 and one(spark, P.kt(F.lit(0.1))) == P.R and one(spark, P.kt(F.lit(1.0), override=2.0)) == 2.0
    assert [one(spark, P.wrap180(F.lit(x))) for x in (180.0, -180.0, 190.0, 540.0)] == [-180.0, -180.0, -170.0, -180.0]
    # Known values of the t distribution: t = 2.228 at 10 degrees of freedom has p = 0.05.
    t = 2.2281388519
    assert abs(P.p_of_r(t / (t * t + 10) ** 0.5, 12) - 0.05) < 1e-8
    assert P.p_of_r(1.0, 5) == 0.0 and P.p_of_r(None, 5) is None and abs(P.p_of_r(0.0, 10) - 1) < 1e-12


def test_modes_and_choices():
    assert N.sequence_columns(["seq_aa_C_frac", "seq_aa_A_frac", "seq_frac_x", "seq_length", "other"]) == ["seq_length", "seq_aa_A_frac", "seq_aa_C_frac", "seq_frac_x"]
    assert N.sequence_columns(["L", "x"]) == ["L"] and "seq_unique_aa_count" not in N.sequence_columns(["seq_unique_aa_count", "seq_dipep_AC_frac"], pca=True)
    assert N.is_sequence_column("KD_mean") and not N.is_sequence_column("rg")
    assert [N.input_mode(x) for x in ("PMFs", "aa", "thermo", None, "zz")] == ["pmf", "sequence", "thermodynamic", "basic", "basic"] and N.method_label("phate") == "PHATE" and N.method_label("x") == "x"
    assert N.chosen(["c", "a"], ["a", "b", "c"]) == ["a", "c"] and N.chosen(["z"], ["a", "b"], 1) == ["a"] and N.chosen(None, ["a"]) == ["a"]
    assert N.map_columns(["UMAP1", "q", "UMAP2"]) == ("UMAP1", "UMAP2") and N.map_columns(["q"]) is None
    assert N.weight_columns([("z", "double"), ("weight", "int"), ("s", "string")]) == ["weight", "z"]
    assert N.error_columns(["n", "rms_x", "JS"]) == ["JS", "rms_x", "n"]
    assert N.pretty("phi_res2__mean", "ACD") == "φ C2 — mean" and N.pretty("rg__mean") == "rg__mean" and N.pretty("psi_res7") == "ψ 7"
