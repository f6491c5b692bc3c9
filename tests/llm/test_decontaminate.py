"""Passages with word edits against a distance matrix computed in full."""

import random

import pytest

from stayline.llm import decontaminate as D


def plain_distance(item, text):
    """Fewest edits between ``item`` and any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        last, row = row, [i]
        for j, other in enumerate(text, 1):
            row.append(min(last[j - 1] + (word != other), last[j] + 1, row[j - 1] + 1))
    return min(row)


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        at = draw.randrange(len(words))
        kind = draw.randrange(3)
        if kind == 0:
            words[at] = f"new{draw.randrange(99)}"
        elif kind == 1:
            words.insert(at, f"extra{draw.randrange(99)}")
        elif len(words) > 1:
            del words[at]
    return words


def test_myers_equals_the_matrix():
    draw = random.Random(5)
    for _ in range(300):
        item = [draw.choice("abcd") for _ in range(draw.randrange(1, 90))]
        text = [draw.choice("abcde") for _ in range(draw.randrange(0, 120))]
        assert D.least_distance(item, text)[0] == plain_distance(item, text)


def test_pieces_cover_the_item():
    words = [str(i) for i in range(23)]
    for budget in range(8):
        cut = D.pieces(words, budget)
        assert len(cut) == budget + 1 and [w for _, p in cut for w in p] == words and all(words[a] == p[0] for a, p in cut)


@pytest.mark.parametrize("pass_bytes", [4 << 20, 600])
def test_altered_passages(spark, pass_bytes):
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [[draw.choice(vocabulary) for _ in range(draw.randrange(6, 60))] for _ in range(25)]
    items[3] = items[4]
    texts = []
    for k in range(160):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(0, 200))]
        for _ in range(draw.randrange(3)):
            item = draw.choice(items)
            at = draw.randrange(len(words) + 1)
            words[at:at] = edited(draw, item, draw.randrange(0, 3 + len(item) // 4))
        texts.append(draw.choice([" ", ", ", " \n"]).join(w.upper() if draw.random() < 0.2 else w for w in words))
    texts += [None, "", "  \n"]
    docs = spark.createDataFrame([(k % 170, t, "x", 5) for k, t in enumerate(texts)], "doc_id long, text string, _text string, row int").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, ""), (92, "short one")], "item_id long, text string")
    settings = D.Settings(pass_bytes=pass_bytes)
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.find_leaks(docs, bench, settings).collect()}
    want = {}
    for k, text in enumerate(texts):
        for i, item in enumerate(items):
            distance = plain_distance(item, D.words_of(text))
            if distance <= (len(item) // 5 if len(item) >= settings.altered_words else 0):
                want[k, i] = distance
    assert found == want and len({d for d in want.values()}) > 3
    kept = D.without_leaks(docs, bench, settings)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(texts))) - {k for k, _ in want})


def test_long_text_and_empty_tables(spark):
    item = " ".join(f"b{i}" for i in range(30))
    text = " ".join(f"filler{i % 800}" for i in range(200_000)) + " " + item + " tail" + " b0 b1 b2" * 5000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    (row,) = D.find_leaks(docs, bench).collect()
    assert (row["item_id"], row["distance"], row["budget"], row["end_word"]) == (7, 0, 6, 200_030)
    none, no_items = docs.where("false"), bench.where("false")
    assert D.find_leaks(none, bench).count() == D.find_leaks(docs, no_items).count() == D.without_leaks(none, bench).count() == 0
    assert D.without_leaks(docs, no_items).count() == 1


def test_short_items_and_scripts_without_blanks(spark):
    chinese, japanese, thai = "法国的首都是哪座城市请回答问题", "日本の首都はどこですか", "เมืองหลวงของฝรั่งเศสคืออะไร"
    items = [(1, "What is the capital of France?"), (2, chinese), (3, japanese), (4, thai), (5, "Paris"), (6, "..."), (7, None)]
    texts = {
        1: "So: what is, the capital of FRANCE - he asked", 2: "what is the big capital of France", 3: f"前文{chinese}后文", 4: f"x {chinese[:5]}新{chinese[5:]} y",
        5: f"「{japanese}」", 6: f"a{thai}b", 7: "parisian", 8: "in Paris.", 9: chinese[:12], 10: "",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["distance"], r["budget"]) for r in D.find_leaks(docs, bench).collect()}
    assert found == {(1, 1): (0, 0), (3, 2): (0, 3), (4, 2): (1, 3), (9, 2): (3, 3), (5, 3): (0, 2), (6, 4): (0, 5), (8, 5): (0, 0)}
    longer = D.find_leaks(docs, bench, D.Settings(least_words=2))
    assert {r["item_id"] for r in longer.collect()} == {1, 2, 3, 4}
    assert D.words_of("Ab中文cd_1 é") == ["ab", "中", "文", "cd_1", "é"]
