import random

from curvelake.llm import clusters as C

AA = "ACDEFGHIKLMNPQRSTVWY"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def changed(rng, s, n):
    s = list(s)
    for _ in range(n):
        at, what = rng.randrange(len(s)), rng.choice("rid")
        if what == "r":
            s[at] = rng.choice(AA)
        elif what == "i":
            s.insert(at, rng.choice(AA))
        elif len(s) > 3:
            del s[at]
    return "".join(s)


def frame(spark, names):
    return spark.createDataFrame([(n, "clash", "clash", 1) for n in names], "variant string, seq string, label string, size int")


def test_all_near_pairs_are_found(spark):
    rng = random.Random(0)
    base = ["".join(rng.choice(AA) for _ in range(rng.randrange(6, 40))) for _ in range(60)]
    seqs = sorted({changed(rng, b, rng.randrange(0, 6)) for b in base for _ in range(4)} | set(base) | {"A", "AC", "ACDEF"})
    got = {(r["a"], r["b"]): r["edits"] for r in C.similar_sequences(spark.createDataFrame([(s,) for s in seqs], "seq string")).collect()}
    want = {}
    for i, a in enumerate(seqs):
        for b in seqs[i + 1 :]:
            if abs(len(a) - len(b)) <= 4 and (d := edits(a, b)) <= 4:
                want[(a, b) if (len(a), a) < (len(b), b) else (b, a)] = d
    assert got == want


def test_hot_segments_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT", 20)
    rng = random.Random(1)
    core = ["".join(rng.choice(AA) for _ in range(20)) for _ in range(80)]
    names = ["MGSSHHHHHHSSG" + c for c in core] + ["MGSSHHHHHHSSG" + changed(rng, c, 2) for c in core[:30]]
    got = {(r["variant"], r["cluster_key"]) for r in C.cluster(frame(spark, names)).collect()}
    want = {(v, min(a, b)) for a, b in zip(names[:30], names[80:]) if a != b for v in (a, b)}
    assert got == want


def test_groups_keys_ranks_and_dirt(spark):
    a, b = "DHAGASLAYRILPRWLNYLRLLKGV", "QKRRDYELWDTEQPIELFKLSAAQNTRHS"
    names = [a, a.lower() + "-nh2", "pep001_" + a, a[:-1] + "W", a[:5] + "W" + a[5:], b, "ace-" + b + "-nme", "ref_LONELYLONELYLONELY", None, "", "123", a, "é" * 30]
    rows = C.cluster(frame(spark, names)).collect()
    assert {r["variant"]: r["cluster_key"] for r in rows} == {**{n: a for n in names[:5]}, b: b, "ace-" + b + "-nme": b}
    assert {r["size"] for r in rows if r["cluster_key"] == a} == {5}
    ranked = sorted((r["place"], r["variant"]) for r in rows if r["cluster_key"] == a)
    assert [p for p, _ in ranked] == [1, 2, 3, 4, 5] and ranked[0][1] == a
    assert C.typical_members(C.cluster(frame(spark, names)), 2).where(f"cluster_key = '{b}'").first()["typical"] == [b, "ace-" + b + "-nme"]


def test_chain_is_split_into_groups_each_near_each(spark):
    start = "ACDEFGHIKLMNPQRSTVWYACDEFGHIKL"
    chain = [start]
    for i in range(4):
        s = list(chain[-1])
        for j in range(3):
            s[i * 6 + j] = "W"
        chain.append("".join(s))
    rows = C.cluster(frame(spark, chain)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["cluster_key"], []).append(r["variant"])
    assert all(edits(x, y) <= 4 for g in groups.values() for x in g for y in g)


def bridged(seed):
    """Two families whose bases differ at six places, each near each inside; members that lean to the other base are near some of the other family."""
    rng = random.Random(seed)
    other_than = lambda c: rng.choice([x for x in AA if x != c])
    base = [rng.choice(AA) for _ in range(40)]
    places = rng.sample(range(40), 18)
    apart, own = places[:6], places[6:]
    far = [other_than(c) if i in apart else c for i, c in enumerate(base)]
    put = lambda s, at, c: "".join(c if i == at else x for i, x in enumerate(s))
    lean = lambda s, to, at: "".join(to[i] if i in at else x for i, x in enumerate(s))
    a = ["".join(base), lean(base, far, apart[:2])] + [put(base, at, other_than(base[at])) for at in own[: rng.randrange(3, 7)]]
    b = ["".join(far), lean(far, base, apart[2:4])] + [put(far, at, other_than(far[at])) for at in own[6 : 6 + rng.randrange(3, 7)]]
    assert all(edits(x, y) <= 4 for f in (a, b) for x in f for y in f)
    return a, b, sum(edits(x, y) <= 4 for x in a for y in b)


def grouped(spark, names):
    groups = {}
    for r in C.cluster(frame(spark, names)).collect():
        groups.setdefault(r["cluster_key"], set()).add(r["variant"])
    return groups


def test_bridged_families_are_told_apart_by_the_embedding(spark, monkeypatch):
    cases, names, want = [c for c in map(bridged, range(12)) if c[2]], [], {}
    assert len(cases) >= 5
    for a, b, _ in cases:
        names += a + b
        want |= {min(a): set(a), min(b): set(b)}
    assert grouped(spark, names) == want
    monkeypatch.setattr(C, "POWERS", 0)
    assert grouped(spark, names) != want


def test_no_member_of_a_bridged_group_is_lost(spark):
    rng = random.Random(5)
    start = "".join(rng.choice(AA) for _ in range(40))
    chain = [start]
    for i in range(9):
        s = list(chain[-1])
        for j in range(2):
            s[i * 4 + j] = rng.choice([c for c in AA if c != s[i * 4 + j]])
        chain.append("".join(s))
    groups = grouped(spark, chain)
    assert all(edits(x, y) <= 4 for g in groups.values() for x in g for y in g)
    alone = set(chain) - {x for g in groups.values() for x in g}
    # Whoever is left alone is near all members of no group, and of no other left alone.
    assert not any(all(edits(x, y) <= 4 for y in g) for x in alone for g in groups.values())
    assert not any(edits(x, y) <= 4 for x in alone for y in alone if x != y)


def test_segments_hot_again_after_refining(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT", 3)
    rng = random.Random(3)
    core = ["".join(rng.choice("AC") for _ in range(12)) for _ in range(40)]
    seqs = sorted({"MGSSHHHHHHSSG" + c for c in core} | {"", "A", "CA"})[1:]
    got = {frozenset((r["a"], r["b"])) for r in C.similar_sequences(spark.createDataFrame([(s,) for s in seqs], "seq string")).collect()}
    assert got == {frozenset((x, y)) for x in seqs for y in seqs if x < y and edits(x, y) <= 4}


def test_empty(spark):
    assert C.cluster(frame(spark, [])).count() == 0
