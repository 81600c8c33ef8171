import hashlib
import random

import numpy as np
import pytest

from nestq.llm import substring_dedup as sd


def brute(rows, least):
    """rows: (id, text) in order of id. -> {id: (bytes, removed, spans, kept)}"""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - least + 1):
            w = b[s : s + least]
            if w in seen:
                gone[s : s + least] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def corpus(prose, seed=0):
    rnd = random.Random(seed)
    base = [prose(i, rnd.randrange(1, 120)) for i in range(60)]
    passage = prose(999, 40)
    rows = []
    for i in range(160):
        t = rnd.choice(base)
        if rnd.random() < 0.4:
            k = rnd.randrange(len(t) + 1)
            t = t[:k] + " é漢 " + passage[rnd.randrange(30) : rnd.randrange(60, len(passage))] + t[k:]
        if rnd.random() < 0.3:
            k = rnd.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        rows.append((i, t))
    rows += [(200, "a" * 500), (201, "ab" * 150 + "a" * 120), (202, ""), (203, None), (204, "a" * 100), (205, "a" * 99), (206, passage * 4), (None, passage)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"group_rows": 3}, {"group_rows": 1}])
def test_equals_brute_force(spark, prose, sizes):
    rows = corpus(prose)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.dedup_substrings(df, **sizes).collect()}
    assert got == brute(rows, 100)


def test_other_length_and_many_partitions(spark, prose):
    rows = corpus(prose, 5)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup_substrings(df, min_bytes=70, digest=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {k: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for k, v in brute(rows, 70).items()}


def test_empty_and_repeated_rows(spark, prose):
    assert sd.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = prose(1, 100)
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in sd.dedup_substrings(df).collect())
    assert got == [(1, 0), (1, 0), (2, len(t))]


def test_window_classes_match_sorting():
    rnd = random.Random(3)
    for alphabet in (2, 4, 30):
        text = [1 + rnd.randrange(alphabet) for _ in range(700)]
        text[300:500] = text[100:300]
        symbols = np.array(text + [0] * 61, np.int16)
        order, classes = sd.window_classes(symbols, 60)
        windows = [tuple(symbols[i : i + 60]) for i in range(700 - 60)]
        found = {}
        for i, c in zip(order.tolist(), classes.tolist()):
            if i < 640:
                found.setdefault(c, set()).add(windows[i])
        assert all(len(v) == 1 for v in found.values()) and len(found) == len(set(windows))


@pytest.mark.parametrize("limit", [150, 333])
def test_stretches_of_long_texts_change_nothing(spark, prose, monkeypatch, limit):
    """The same result whatever the length from which a text is walked in stretches."""
    rows = corpus(prose, 5)
    docs = [(i, t) for i, t in rows if i is not None][:60] + [(500, prose(77, 200)), (501, "x" + prose(77, 200)[150:900] + "y"), (502, "ab" * 400)]
    texts = [(t or "").encode() for _, t in docs]
    monkeypatch.setattr(sd, "LONG_BYTES", limit)
    windows = {}
    for text in texts:
        for offset, part in sd.stretches([text], 100):
            _, _, _, at, left, right = sd.anchors(part, 100)
            for a, b in zip((left + offset).tolist(), (right + offset).tolist(), strict=True):
                windows.setdefault(text, set()).update(range(a, b - 99))
    for text in texts:
        assert windows.get(text, set()) == set(range(max(0, len(text) - 99)))


def test_ids_must_be_integers_and_names_may_clash(spark, prose):
    rows = [("a1", prose(1, 40), "n", "k")]
    df = spark.createDataFrame(rows, "doc_id string, text string, n_bytes string, kept string")
    with pytest.raises(ValueError, match="integer"):
        sd.dedup_substrings(df)
    got = sd.dedup_substrings(df.selectExpr("cast(1 as int) as doc_id", "text", "n_bytes", "kept", "'o' as n_other")).first()
    assert got.n_other == "o" and got.n_bytes == len(rows[0][1].encode()) and bytes(got.kept) == rows[0][1].encode()
