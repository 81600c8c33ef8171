import random

import pytest

from nestq.llm import near_dedup as nd


def brute(rows, shingle, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(prose, seed):
    rnd = random.Random(seed)
    rows, i = [], 0
    for g in range(25):
        base = prose(seed * 1000 + g, rnd.choice([4, 12, 60, 200])).split()
        chain = base
        for _ in range(rnd.choice([1, 2, 8])):
            words = list(rnd.choice([base, chain]))
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 4])):
                words[rnd.randrange(len(words))] = "new%d" % rnd.randrange(10**6)
            chain = words
            rows.append((i, rnd.choice([" ", "\n"]).join(words)))
            i += 1
    rnd.shuffle(rows)
    return rows + [(9000, ""), (9001, None), (9002, "one two"), (9003, "One\ttwo"), (9004, " \n ")]


@pytest.mark.parametrize(("shingle", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_equals_brute_force(spark, prose, monkeypatch, shingle, percent, seed):
    monkeypatch.setattr(nd, "BLOCK_ROWS", 3)
    rows = corpus(prose, seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.link(df, shingle=shingle, threshold_percent=percent).collect()}
    assert got == brute(rows, shingle, percent)


def test_chain_without_a_common_neighbour(spark, prose):
    words = prose(77, 300).split()
    rows = []
    for i in range(12):
        rows.append((100 - i, " ".join(words)))
        for k in range(5):
            words[(i * 23 + k * 7) % 300] = f"w{i}x{k}"
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.link(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, threshold_percent=85).collect()}
    assert got == brute(rows, 3, 85)


def test_empty_table_and_null_ids(spark):
    assert nd.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in nd.link(df).collect()) == [(0, 3, False), (0, 3, False), (3, 3, True)]


def test_bayesian_bound():
    least = nd.least_matches(0.85)
    assert least[0] == 0 and least[nd.SIGNATURE] < 0.85 * nd.SIGNATURE and all(a <= b for a, b in zip(least, least[1:]))


def test_deduplicate_keeps_one_row_of_each_component(spark, prose):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(5, a, "x"), (3, a + " more", "y"), (3, a + " more", "y"), (7, b, "z"), (None, b, "n"), (8, "", "e"), (9, None, "e"), (None, prose(4, 50), "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r.doc_id or 0, r.kept) for r in nd.deduplicate(df).collect())
    assert got == [(0, "n"), (3, "y"), (7, "z"), (8, "e"), (9, "e")]


def test_clashing_columns_and_ids_of_any_type(spark, prose):
    a, b = prose(1, 60), prose(2, 60)
    names = ["c", "sig", "lowest", "root", "bucket", "place", "component_id", "n_shingles", "a.b"]
    rows = [("x1", a, *names), ("x2", a, *names), ("x0", a + " end", *names), ("y", b, *names), (None, None, *[None] * len(names))]
    df = spark.createDataFrame(rows, "doc_id string, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = {r.doc_id: r for r in nd.link(df).collect()}
    assert {k: r.component_id for k, r in got.items()} == {"x0": "x0", "x1": "x0", "x2": "x0", "y": "y", None: None}
    assert got["x1"].sig == "sig" and got["y"]["a.b"] == "a.b" and got[None].n_shingles == 0
    kept = nd.deduplicate(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {"x0", "y", None}


def test_a_very_long_text(spark, prose):
    long = prose(3, 120_000)
    rows = [(1, long), (2, long.replace(" ", "\n") + " more"), (3, prose(4, 50))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, nd.SHINGLE, nd.THRESHOLD_PERCENT)


def test_components_are_written_once_a_round(spark, monkeypatch):
    rnd = random.Random(5)
    pairs = {(i, i + 1) for i in range(40)} | {(100, 100 + i) for i in range(1, 60)} | {tuple(sorted(rnd.sample(range(300, 420), 2))) for _ in range(70)}
    root = {i: i for p in pairs for i in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    written, rounds = [], []
    cut, stars = nd.cut, nd.are_stars
    monkeypatch.setattr(nd, "cut", lambda df, name: written.append(name) or cut(df, name))
    monkeypatch.setattr(nd, "are_stars", lambda edges: rounds.append(stars(edges)) or rounds[-1])
    made = spark.createDataFrame([((0, a), (0, b)) for a, b in pairs], f"a {nd.CLASS}, b {nd.CLASS}")
    got = [(r.c._nd_c2, r.root._nd_c2) for r in nd.components(made, 500).collect()]
    assert sorted(got) == sorted(root.items()) and len(written) == len(rounds)
    written.clear()
    star = made.where("a._nd_c2 = 100")
    assert {r.root._nd_c2 for r in nd.components(star, 500).collect()} == {100} and written == ["edges"]
    assert nd.components(made.limit(0), 0).count() == 0


def test_small_steps_are_few_files(spark, prose, monkeypatch):
    rows, files = corpus(prose, 7), []
    cut = nd.cut
    monkeypatch.setattr(nd, "cut", lambda df, name: [made := cut(df, name), name == "near-features" or files.append(len(made.inputFiles()))][0])
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("40", "false"), strict=True):
            spark.conf.set(n, v)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.link(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, threshold_percent=85).collect()}
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert got == brute(rows, 3, 85) and len(files) > 5 and max(files) <= spark.sparkContext.defaultParallelism
