import random

from curvelake.llm import leakage as L

RNG = random.Random(5)
WORDS = ["w" + "".join(RNG.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
ITEM = " ".join(WORDS[:60])
OTHER = " ".join(WORDS[100:150])
NOISE = " ".join(WORDS[200:260])


def found(spark, texts, items=((1, ITEM), (2, OTHER), (3, None), (4, "too short"), (1, ITEM))):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string, n_words int")
    tests = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]) for r in L.leaked_spans(docs, tests).collect()}


def swapped(words, at):
    return [("zz%d" % i if i in at else w) for i, w in enumerate(words)]


def test_forms_of_leaks(spark):
    run = WORDS[10:34]
    wrapped = " ".join(run[:12]) + "-\n// " + " ".join(run[12:])
    cut = " ".join(run)
    cut = cut[:30] + "-\n" + cut[30:] if cut[29].isalpha() and cut[30].isalpha() else cut[:31] + "-\n" + cut[31:]
    texts = [
        NOISE + " " + " ".join(run) + " " + NOISE, " ".join(run).upper(), "> " + "\n> ".join(run), " ".join(run), " ".join(f"<b>{w}</b>," for w in run), cut,
        " ".join(swapped(run, {3, 12})), ITEM + NOISE + OTHER, "&nbsp; ".join(run), "\n".join(run), "- " + ";  ".join(run), " ".join(run[:20]),
    ]
    got = found(spark, texts)
    assert got == {(i, 1) for i in range(len(texts))} | {(7, 2)}
    assert wrapped  # a word that ends a line with its own hyphen stays two words
    assert found(spark, [wrapped]) == {(0, 1)}


def test_what_is_no_leak(spark):
    run = WORDS[10:34]
    texts = [None, "", "   ", NOISE * 500, " ".join(run[:17]), " ".join(swapped(run[:20], {2, 9, 15})), " ".join(run[:10] + ["new"] + run[10:18]), " ".join(WORDS[10:19] + WORDS[30:41]), " ".join(reversed(run))]
    assert found(spark, texts) == set()


def test_long_text_repeats_and_removal(spark):
    docs = spark.createDataFrame([(1, NOISE * 2000 + " " + ITEM + " " + ITEM), (1, ITEM), (2, NOISE), (None, NOISE)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    spans = L.leaked_spans(docs, items).collect()
    assert len(spans) == 1 and spans[0]["n_words"] == 60
    assert sorted(str(r["doc_id"]) for r in L.without_leaks(docs, items).collect()) == ["2", "None"]


def test_large_test_sets_are_searched_in_slices(spark, monkeypatch):
    monkeypatch.setattr(L, "SLICE_WORDS", 40)
    assert found(spark, [ITEM, OTHER, NOISE]) == {(0, 1), (1, 2)}


def test_spans_are_cut_and_the_rest_stays(spark):
    run = WORDS[10:40]
    item = " ".join(run)
    odd = "Ünïcode İ ﬁne &amp; <i>x</i> before "
    texts = [
        f"{odd}{item.upper()}, {NOISE}", f"{NOISE}\n> " + "\n> ".join(run) + f"\n{NOISE}", NOISE, None, "", f"<p>{item}</p>", f"{item} and then {OTHER}! {NOISE} {item}",
        f"{odd}" + " ".join(run[:12]) + "-\n// " + " ".join(run[12:]) + " tail",
    ]
    docs = spark.createDataFrame([(i, t, "clash", float("nan")) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string, n_words double")
    tests = spark.createDataFrame([(1, item), (2, OTHER)], "item_id bigint, text string")
    rows = {r["doc_id"]: r for r in L.without_spans(docs, tests).collect()}
    got = {i: r["text"] for i, r in rows.items()}
    assert len(rows) == len(texts) and all(r["item_id"] == "clash" for r in rows.values())
    assert got[0] == f"{odd} , {NOISE}" and got[1] == f"{NOISE}\n>  \n{NOISE}" and [got[i] for i in (2, 3, 4)] == [NOISE, None, ""]
    assert got[5] == "<p> </p>" and got[6] == f"  and then  ! {NOISE}  " and got[7] == f"{odd}  tail"
    assert L.leaked_spans(spark.createDataFrame([(i, t) for i, t in got.items()], "doc_id bigint, text string"), tests).count() == 0


def test_words_are_located_where_they_are_numbered():
    known = L.Items([(1, ITEM)])
    rng = random.Random(9)
    bits = [*WORDS[:30], "-\n", "\r\n", " ", "<b>", "</b>", "&amp;", "&#x41;", "é", "e\u0301", "ﬁ", "İ", "\u00ad", "-", "1) ", "> ", "²", "<", "&"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 60)))
        places = L.located(text, known)
        assert len(places) == len(known.number(text)) and all(0 <= a < b <= len(text) for a, b in places)
        assert all(p[0] <= q[0] for p, q in zip(places, places[1:]))


def test_a_slice_takes_what_its_words_bound():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20000)]
    known = L.Items([(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(1000)])
    n = len(known.words)
    assert n == 200_000 and known.bytes() <= 20 * n + 12 * 2 * len(known.item_ids) + 150 * len(set(words))


def test_against_brute_force(spark):
    rng = random.Random(2)
    items = [(i, [rng.choice(WORDS[:40]) for _ in range(45)]) for i in range(6)]
    texts = []
    for _ in range(60):
        i, w = rng.choice(items)
        a, n = rng.randrange(0, 15), rng.randrange(15, 30)
        texts.append(" ".join([rng.choice(WORDS[:40]) for _ in range(8)] + swapped(w[a : a + n], set(rng.sample(range(n), rng.randrange(0, 4)))) + [rng.choice(WORDS[:40]) for _ in range(8)]))
    want = set()
    for d, t in enumerate(texts):
        x = t.split()
        for i, w in items:
            if any(sum(x[p + k] == w[q + k] for k in range(20)) >= 18 for p in range(len(x) - 19) for q in range(len(w) - 19)):
                want.add((d, i))
    assert found(spark, texts, [(i, " ".join(w)) for i, w in items]) == want


def test_empty(spark):
    assert found(spark, []) == set() and found(spark, [ITEM], []) == set()
