import random

import numpy as np

from curvelake.llm import reading as R

LEVELS = {n: ["".join(chr(97 + (n * 7 + i * 3 + j * 5) % 26) for j in range(4 + n)) + "abcd"[n - 1] for i in range(30)] for n in (1, 2, 3, 4)}


def text(rng, level, sentences=12, mix=0.15):
    out = []
    for _ in range(sentences):
        own = level if rng.random() > mix else min(4, max(1, level + rng.choice((-1, 1))))
        out.append("The " + " ".join(rng.choice(LEVELS[own]) for _ in range(8)) + " of every one.")
    return " ".join(out)


def tables(spark, docs, labels):
    return (
        spark.createDataFrame([(i, t, "en", 1.0, "clash") for i, t in docs], "doc_id bigint, text string, lang string, grade double, slots string"),
        spark.createDataFrame([(*r, "clash") for r in labels], "doc_id bigint, grader string, reading_level int, text string"),
    )


def corpus(rng, n=200):
    truth = {i: rng.choice((1, 2, 3, 4)) for i in range(n)}
    docs = [(i, text(rng, t)) for i, t in truth.items()]
    labels = [(i, g, truth[i]) for i in range(0, n, 4) for g in "ab"] + [(0, "c", min(4, truth[0] + 1)), (4, "c", None), (8, "c", 9), (8, "a", truth[8]), (None, "a", 2), (9999, "a", 3)]
    return truth, docs, labels


def test_levels_of_unlabelled_documents(spark):
    truth, docs, labels = corpus(random.Random(0))
    got = {r["doc_id"]: r["reading_level"] for r in R.reading_levels(*tables(spark, docs, labels)).collect()}
    held = [i for i in truth if i % 4]
    assert set(got) == set(truth)
    assert sum(got[i] == truth[i] for i in held) / len(held) >= 0.95


def test_other_languages_logs_and_short_texts_have_no_level(spark):
    rng = random.Random(1)
    truth, docs, labels = corpus(rng, 120)
    odd = {
        1000: "Die Gruppen begrenzen die Proben und die neuen Muster zeigen die Winkel. " * 20, 1001: None, 1002: "", 1003: "   \n ", 1004: "[0001] replica=3 exchange=rej U=-1.5\n" * 80,
        1005: text(rng, 2, 2), 1006: "1.0 2.0 3.0\n" * 200, 1007: "# Note 5: general\n" * 60, 1008: "(A, C, D, E)\n" * 50,
    }
    long = text(rng, 3, 3000)
    rows = R.reading_levels(*tables(spark, docs + list(odd.items()) + [(2000, long), (2000, long), (None, long)], labels)).collect()
    assert not {r["doc_id"] for r in rows} & set(odd)
    assert [r["reading_level"] for r in rows if r["doc_id"] == 2000] == [3, 3]


def test_footers_do_not_count(spark):
    rng = random.Random(2)
    _, docs, labels = corpus(rng, 100)
    footer = "\nThe shared notebook is not controlled.\n"
    docs = [(i, t + footer * 3) for i, t in docs] + [(500, text(rng, 1, 3) + footer * 20)]
    assert 500 not in {r["doc_id"] for r in R.reading_levels(*tables(spark, docs, labels)).collect()}


def test_a_text_copied_into_a_third_of_the_rows_keeps_its_lines(spark):
    rng = random.Random(4)
    truth, docs, labels = corpus(rng, 200)
    hot = text(rng, 1, 12, 0)
    near = [hot.replace(w, w + "x", 1) for w in LEVELS[1]]
    footer = "\nThe shared notebook is not controlled.\n"
    docs = [(i, t + footer) for i, t in docs] + [(1000 + i, hot + footer) for i in range(100)] + [(2000 + i, near[i % len(near)]) for i in range(100)]
    short = [(5000, " ".join(hot.split(". ")[0] + "." for _ in range(9))), (5001, text(rng, 1, 3) + footer * 20)]
    got = {r["doc_id"]: r["reading_level"] for r in R.reading_levels(*tables(spark, docs + short, labels)).collect()}
    assert [got.get(i) for i in (*range(1000, 1100), *range(2000, 2100))] == [1] * 200
    assert got.get(5000) == 1 and 5001 not in got and set(truth) <= set(got)


def test_sentences():
    got = R.sentences("<p>This dimen-\n// sional frame. (K, E, K)\n# Note 1: X\n[01] a=b c=d\n1.0 2.0\nIt's a well-known one!&nbsp;OK then</p>")
    assert got == [["this", "dimensional", "frame"], ["it's", "a", "well-known", "one"], ["ok", "then"]]


def test_empty(spark):
    docs, labels = tables(spark, [], [])
    assert R.reading_levels(docs, labels).count() == 0
    _, some, marks = corpus(random.Random(3), 20)
    docs, labels = tables(spark, some, [])
    assert R.reading_levels(docs, labels).count() == 0
    docs, labels = tables(spark, [], marks)
    assert R.reading_levels(docs, labels).columns == ["doc_id", "reading_level", "score"]
    assert R.reading_levels(docs, labels).count() == 0


def chained(rng):
    """Graded documents use words of one kind, others mix them with a second kind, the last use the second kind only."""
    second = {n: [w[::-1] + "q" for w in words] for n, words in LEVELS.items()}

    def mixed(level, kinds, n=14):
        word = lambda: rng.choice(kinds[len(kinds) > 1 and rng.random() < 0.3][level if rng.random() > 0.15 else min(4, max(1, level + rng.choice((-1, 1))))])
        return " ".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(n))

    docs, labels, last = [], [], {}
    for i in range(240):
        level = 1 + i % 4
        if i < 80:
            docs.append((i, mixed(level, [LEVELS])))
            labels.append((i, "a", level))
        elif i < 200:
            docs.append((i, mixed(level, [LEVELS, second])))
        else:
            docs.append((i, mixed(level, [second])))
            last[i] = level
    return docs, labels, last


def test_propagation_reaches_documents_whose_words_no_graded_one_uses(spark, monkeypatch):
    docs, labels, last = chained(random.Random(11))
    got = {r["doc_id"]: r["reading_level"] for r in R.reading_levels(*tables(spark, docs, labels)).collect()}
    assert sum(got.get(i) == level for i, level in last.items()) >= 0.95 * len(last)
    monkeypatch.setattr(R, "ROUNDS", 1)
    once = {r["doc_id"]: r["reading_level"] for r in R.reading_levels(*tables(spark, docs, labels)).collect()}
    assert sum(once.get(i) != got.get(i) for i in last) >= 0.9 * len(last)


def test_rounds_end_at_the_harmonic_fixed_point(spark):
    docs, labels, _ = chained(random.Random(12))
    docs_df, labels_df = tables(spark, docs, labels)
    corpus = R.cut(R.parsed(docs_df).join(R.grades(labels_df), "doc_id", "left"), "corpus")
    score, known = R.propagate(corpus, np.array([], np.int64))
    # The same graph as one dense system: words' values solve x = A x + b.
    rows = corpus.collect()
    slots = sorted({s for r in rows for s in r["slots"]})
    at = {s: k for k, s in enumerate(slots)}
    edge = np.zeros((len(rows), len(slots)))
    for i, r in enumerate(rows):
        sentence = np.repeat(np.arange(len(r["lengths"])), r["lengths"])
        for s, k in zip(r["slots"], sentence):
            edge[i, at[s]] += 1 / r["lengths"][k]
    grade = np.array([np.nan if r["grade"] is None else r["grade"] for r in rows])
    of_word, of_doc = edge / edge.sum(0), edge / edge.sum(1, keepdims=True)
    free = np.isnan(grade)
    exact = np.linalg.solve(np.eye(len(slots)) - of_word[free].T @ of_doc[free], of_word[~free].T @ grade[~free])
    assert np.abs(score[slots] - exact).max() < 0.02 and known[slots].all()
