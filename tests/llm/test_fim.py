"""Fill-in-middle against a version that slices lists of units."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stayline.llm import fim
from stayline.llm.queries import queries

MARKS = (b"<P>", b"<S>", b"<M>")


def plain_version(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if not text or any(m.decode() in text for m in MARKS) or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
    return n, form, *sizes, out, hashlib.sha256(out.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(
    st.text(st.sampled_from("aZ é<>PSM中\n\0😀") | st.characters(codec="utf-8")),
    st.sampled_from(["plain", "psm", "spm"]),
    st.integers(0, 1 << 32),
    st.integers(0, 1 << 32),
)
def test_pieces_restore_what_they_hold(text, drawn, a, b):
    data = text.encode()
    n, form, table = fim.rearranged(data, drawn, (a, b), MARKS)
    assert n == len(re.findall("[A-Za-z]+|[^A-Za-z]", text))
    assert form == ("plain" if not text or any(m in data for m in MARKS) else drawn)
    output = table.content()
    assert hashlib.sha256(output).hexdigest() == table.digest()
    if form != "plain":
        assert table.restored(fim.ARRANGEMENTS[form]).first(3).content() == data
    assert fim.restored(output, form, MARKS).content() == data


def test_cut_splits_descriptors():
    table = fim.whole(b"abcdef").cut([0, 2, 2, 6])
    assert [bytes(v) for v in table.views()] == [b"", b"ab", b"", b"cdef", b""]
    assert [bytes(v) for v in table.cut([1, 3]).views()] == [b"", b"a", b"b", b"", b"c", b"def", b""]


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("<P>", "<<>", "<M>"), ("<P>", "[S]", "<M>"), ("<", "<S>", "<M>")])
def test_ambiguous_sentinels_are_refused(marks):
    with pytest.raises(ValueError):
        fim.Settings(sentinels=marks)


def test_odd_rows(spark):
    """Nulls, empty and very long texts, sentinels in a text, repeated rows and clashing names."""
    texts = [None, "", "a", "<P>", "x<S>y", "  ", "é中😀", "a<P", "S>b", "word " * 200_000, "中" * 300_000, "\r\n\0 a-b"]
    rows = [(i * 7 + k, text, 5, "old") for i, text in enumerate(texts) for k in range(7)] + [(None, "no key here", 5, "old")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, output string").repartition(3)
    made = fim.rearrange(docs)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"]
    got = fim.restore(made).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256) == plain_version(r.doc_id, r.text)
        assert r.restored == (r.text or "") and r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        buffers = ((r.text or "").encode(), b"<P><S><M>")
        assert b"".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces).decode() == r.output
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.rearrange(docs)).count() == 0


def test_registered_query(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries()["op12_fill_in_middle"](spark, folder)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, prefix, middle, _, digest = plain_version(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, prefix, middle, digest, hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
