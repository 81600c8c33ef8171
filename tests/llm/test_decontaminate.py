import pytest

from nestq.llm import decontaminate as dc

ITEM = "A train leaves Berlin at 9 and travels 120 km to Hamburg at 60 km per hour. When does the train from Berlin reach Hamburg station today?"


def found(spark, texts, items=((1, ITEM),), **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.id, r.item): r for r in dc.contaminated(docs, bench, **options).collect()}


def test_verbatim_and_reparameterised(spark, prose):
    other = ITEM.replace("120", "300").replace("60", "75").replace("Berlin", "Madrid").replace("Hamburg", "Lisbon")
    torn = other.replace("from Madrid", "from Oslo")  # Berlin stands for two names
    got = found(spark, [(1, prose(1, 30) + ". " + ITEM.upper().lower().join(["", ""]) + ITEM + " " + prose(2, 20)), (2, other), (3, torn), (4, prose(3, 200)), (5, None), (6, ""), (None, ITEM)])
    assert set(got) == {(1, 1), (2, 1), (None, 1)}
    assert got[1, 1].verbatim and not got[2, 1].verbatim and got[2, 1].n_slots > 3


def test_partial_copies(spark):
    words = ITEM.split()
    got = found(spark, [(1, " ".join(words[:20])), (2, " ".join(words[:9])), (3, ITEM.replace(" ", "\n"))])
    assert set(got) == {(1, 1), (3, 1)}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_joins_without_broadcast_agree(spark, prose, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", limit)
    monkeypatch.setattr(dc, "BROADCAST_KEYS", limit)
    items = [(i, prose(100 + i, 20)) for i in range(30)] + [(99, "too short"), (98, None), (97, "")]
    texts = [(i, prose(i, 40) + " " + (items[i % 30][1] if i % 3 == 0 else "")) for i in range(60)] * 2
    got = found(spark, texts, items)
    assert set(got) == {(i, i % 30) for i in range(0, 60, 3)}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = dc.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in range(60) if i % 3 for _ in range(2))


def test_empty_tables(spark):
    assert found(spark, []) == {} and found(spark, [(1, ITEM)], [(None, None)]) == {}


def test_native_only(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    plan = dc.contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_values_of_other_shape_and_inserted_words(spark):
    item = "A shop in the old town sells 450 boxes of green tea each month and pays 12 workers from Lisbon who pack them by hand until the evening comes to close the day."
    texts = [item.replace("450", v) for v in ("300", "1,450", "45.5", "-7", "1 450")]
    texts += [item.replace("Lisbon", "New York City"), item.replace("and pays", "and gladly pays"), item.replace("and pays 12 workers from", "and workers from")]
    other = " ".join(reversed(item.split()))
    got = found(spark, [*enumerate(texts), (90, other), (91, " ".join(item.split()[:15]))], ((1, item),))
    assert set(got) == {(i, 1) for i in range(len(texts))}
    assert [got[i, 1].n_covered for i in range(4)] == [got[0, 1].n_tokens] * 4


def test_item_whose_template_repeats(spark):
    item = " ".join(f"The red box in the hall holds {n} pears and {m} figs for you." for n, m in ((12, 7), (31, 5), (44, 9)))
    other = item.replace("31", "58").replace("44", "63")
    one = " ".join(item.split()[:13])
    got = found(spark, [(1, item), (2, other), (3, one)], ((1, item),))
    assert set(got) == {(1, 1), (2, 1)}
    assert got[1, 1].n_covered == got[1, 1].n_tokens and got[1, 1].verbatim and not got[2, 1].verbatim


def test_short_items_and_items_of_values(spark, prose):
    short, numbers = "What is the capital of France today?", "Sum of 12 45 7 31 9 66 88 5 62."
    items = ((1, short), (2, numbers), (3, "3.5 kg"))
    texts = [(1, prose(5, 30) + " asked What is the capital of France today? " + prose(6, 20)), (2, prose(7, 20) + ". " + numbers), (3, short.replace("France", "Spain"))]
    texts += [(4, numbers.translate(str.maketrans("123456789", "234567891"))), (5, "it weighs 3.5 kg now"), (6, "it weighs 4.5 kg now")]
    assert set(found(spark, texts, items)) == {(1, 1), (2, 2), (5, 3)}


def test_values_in_words_and_names_that_open_sentences(spark):
    item = "Carol has seven red apples in the old basket. She gives 3 of them to Bob before lunch, then buys twenty five more at the shop. How many apples does Carol have now in the basket?"
    same = [
        item.replace("Carol has", "Peter has").replace("does Carol", "does Peter").replace("Bob", "Ada"),
        item.replace("seven", "9").replace("twenty five", "forty"),
        item.replace("seven", "twelve").replace("3 of", "two hundred and six of").replace("twenty five", "25"),
        item.replace("She", "He"),
    ]
    other = [item.replace("seven", "ripe"), "Peter sells seven green pears."]
    got = found(spark, [*enumerate(same), *((50 + i, t) for i, t in enumerate(other))], ((1, item),))
    assert {k for k, _ in got if k < 50} == set(range(len(same))) and (51, 1) not in got


def test_recall_of_generated_variants(spark, prose):
    """Items with names, numbers and units; each copy gets other values of another shape inside other text."""
    import random

    rnd = random.Random(17)
    names = ["Ada", "Brook", "Carol", "Dmitri", "Elif", "New York City", "Lisbon", "Oslo"]

    def number():
        return rnd.choice([str(rnd.randrange(2, 99)), f"{rnd.randrange(1, 9)},{rnd.randrange(100, 999)}", f"{rnd.randrange(1, 50)}.{rnd.randrange(1, 99)}", rnd.choice(["seven", "twelve", "forty two", "three hundred"])])

    def made(shape):
        return " ".join(rnd.choice(names) if w == "N" else number() if w == "V" else w for w in shape)

    shapes = []
    for i in range(40):
        words = prose(900 + i, 34).split()
        for at, slot in zip(rnd.sample(range(1, 34), 5), "NVVNV", strict=True):
            words[at] = slot
        shapes.append(words)
    items = [(i, made(s)) for i, s in enumerate(shapes)]
    texts = [(i, f"{prose(2000 + i, 25)}. {made(s)} {prose(3000 + i, 25)}") for i, s in enumerate(shapes)]
    got = set(found(spark, [*texts, *((500 + i, prose(5000 + i, 120)) for i in range(40))], items))
    assert all(k == item for k, item in got)
    assert len(got) >= 0.9 * len(shapes)


@pytest.mark.parametrize("key", ["doc_id", "name"])
def test_ids_of_any_type_and_clashing_columns(spark, key):
    docs = spark.createDataFrame([(1, "a1", ITEM, "c", "c"), (2, "a2", "clean words only here", "c", "c"), (None, None, None, None, None)], "doc_id long, name string, text string, w string, item string")
    kept = dc.decontaminate(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"), key=key)
    assert kept.columns == docs.columns and {r.name for r in kept.collect()} == {"a2", None}


def test_a_very_long_text(spark, prose):
    long = prose(11, 60_000) + " " + ITEM + " " + prose(12, 60_000)
    assert set(found(spark, [(1, long)])) == {(1, 1)}
