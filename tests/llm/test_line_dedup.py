"""Repeated and altered lines against a comparison of all pairs."""

import random
import time

from stayline.llm import line_dedup as L


def plain(rows, least=L.LEAST_WORDS):
    """{(doc_id, line): (kept doc_id, kept line, distance)} for rows (doc_id, text) with unique ids in order."""
    seen, out = [], {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for number, line in enumerate((text or "").split("\n")):
            words = line.encode().lower().split()
            if len(words) < least:
                continue
            equal = next((s for s in seen if s[2] == words), None)
            near = equal or next((s for s in seen if L.within_one_edit(s[2], words)), None)
            if near:
                out[doc_id, number] = (near[0], near[1], 0 if equal else 1)
            seen.append((doc_id, number, words))
    return out


def found(df):
    return {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"], r["distance"]) for r in df.collect()}


def test_within_one_edit():
    def matrix(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
        return row[-1]

    draw = random.Random(3)
    for _ in range(3000):
        a, b = ([draw.choice("ab") for _ in range(draw.randrange(7))] for _ in range(2))
        assert L.within_one_edit(a, b) == (matrix(a, b) <= 1)


def test_random_lines(spark):
    draw = random.Random(8)
    rows = []
    for k in range(120):
        lines = []
        for _ in range(draw.randrange(12)):
            words = [draw.choice("ab") for _ in range(draw.randrange(3, 9))]
            lines.append(" ".join(words).upper() if draw.random() < 0.2 else "\t ".join(words))
        rows.append((k, "\n".join(lines)))
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, h1 int, line string").repartition(4)
    want = plain(rows)
    assert found(L.repeated_lines(docs)) == want and {v[2] for v in want.values()} == {0, 1}
    cleaned = L.without_repeats(docs)
    assert cleaned.columns == docs.columns
    gone = {i: {n for d, n in want if d == i} for i, _ in rows}
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == {
        i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in rows
    }


def test_variants_meet_exactly_within_one_edit():
    draw = random.Random(4)
    lines = [[draw.choice([b"a", b"b", b"cc"]) for _ in range(draw.randrange(1, 8))] for _ in range(150)]
    rows, kinds, k1, k2 = L._variant_keys(lines)
    held = [{(kind, a, b) for r, kind, a, b in zip(rows, kinds, k1, k2) if r == i} for i in range(len(lines))]
    # whole lines are met by lines of one word more, replacements by lines of the same length
    kept = [({(a, b) for k, a, b in h if k == L.WHOLE}, {(a, b) for k, a, b in h if k == L.LONGER}, {(a, b) for k, a, b in h if k == L.REPLACED}) for h in held]
    for i, a in enumerate(lines):
        for j in range(i):
            meets = bool(kept[i][0] & kept[j][0] or kept[i][0] & kept[j][1] or kept[i][1] & kept[j][0] or kept[i][2] & kept[j][2])
            assert meets == L.within_one_edit(a, lines[j]), (a, lines[j])


def test_long_lines_are_linear(spark):
    words = [f"w{k % 977}" for k in range(200_000)]
    changed = [*words[:99_000], "new", *words[99_001:]]
    longer = [*words[:150_000], "more", *words[150_000:]]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((words, changed, longer, words[::-1]))], "doc_id long, text string")
    began = time.time()
    assert found(L.repeated_lines(docs)) == {(1, 0): (0, 0, 1), (2, 0): (0, 0, 1)}
    assert time.time() - began < 60


def test_a_line_in_many_versions(spark):
    """Each version is met with the earliest only."""
    rows = [(k, f"page {k} of the long report ends here") for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(L.repeated_lines(docs)) == {(k, 0): (0, 0, 1) for k in range(1, 700)}


def test_odd_rows(spark):
    rows = [(None, "one two three four five"), (2, None), (3, ""), (4, "\n\n"), (5, "one two three four five six"), (6, "yes"), (7, "yes"), (8, "ONE  two three four five\r"), (9, "w " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(L.repeated_lines(docs)) == plain(rows)
    twice = spark.createDataFrame([(1, "a b c d e f\na b c d e f"), (1, "a b c d e f\na b c d e f"), (0, "z z z z z z")], "doc_id long, text string")
    got = found(L.repeated_lines(twice))
    assert got == {(1, 1): (1, 0, 0)}
    assert sorted(r["text"] for r in L.without_repeats(twice).collect()) == ["a b c d e f", "a b c d e f", "z z z z z z"]
    assert L.repeated_lines(docs.where("false")).count() == L.without_repeats(docs.where("false")).count() == 0


def test_short_lines_repeat_if_equal(spark, tmp_path):
    rows = [(1, "Yes.\nNo.\n\nall rights reserved"), (2, "yes.\nAll  rights reserved\nall rights kept"), (3, "a b c d e f"), (4, "a b c d e g\nNo.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from stayline.llm.queries import queries

    assert found(queries()["op10_line_dedup"](spark, str(tmp_path))) == {
        (2, 0): (1, 0, 0), (2, 1): (1, 3, 0), (4, 0): (3, 0, 1), (4, 1): (1, 1, 0),
    }
