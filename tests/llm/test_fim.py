from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorspark.llm import fim


def brute(doc_id, text):
    """The contract, plainly."""
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = min(h1 % (len(text) + 1), h2 % (len(text) + 1)), max(h1 % (len(text) + 1), h2 % (len(text) + 1))
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, len(text), "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, len(text), "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, len(text), "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


ROWS = [(i, f"text {i} with ñ, 漢字 and 🙂 " * (i % 7)) for i in range(120)]
ROWS += [(1, None), (2, ""), (None, "no id"), (None, None), (None, "no id"), (5, "a<P>b"), (6, "<S>"), (7, "x<M>"), (8, "<P" * 50), (9, "<" * 200), (10, "S>" * 40), (-4, "minus"), (3, "x")]
ROWS += [(500 + i, ("word é " * 4000)[: 20_000 + i]) for i in range(30)] + [(9, "<" * 200)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 64, fim.CHUNK])
def test_digests_and_outputs_equal_brute_force(spark, chunk):
    rows = [r for r in ROWS if chunk > 3 or len(r[1] or "") < 1000]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n long, key string").repartition(3)
    want = [brute(*r) for r in rows]
    got = [tuple(r) for r in fim.digests(docs, chunk=chunk).collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted([(*w[:5], sha(w[5]), sha(t)) for w, (_, t) in zip(want, rows, strict=True)], key=key)
    texts = [tuple(r) for r in fim.fill_in_middle(docs, chunk=chunk).collect()]
    assert sorted(texts, key=key) == sorted(want, key=key)


def test_forms_all_occur():
    forms = [brute(i, "some words")[2] for i in range(500)]
    assert {f: forms.count(f) > 20 for f in ("plain", "psm", "spm")} == {"plain": True, "psm": True, "spm": True}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digests(docs).collect() == [] and fim.fill_in_middle(docs).collect() == []


def test_one_exchange_and_sorts_in_place(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    text = fim.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>PSMa\n🙂", max_size=40), st.data())
def test_reader_restores_any_text_from_any_cut(text, data):
    if any(m in text for m in fim.PLACE):
        return
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    for form in fim.LAYOUT:
        output = "".join(fim.cut(text, form, a, b, 5))
        cuts = sorted(data.draw(st.lists(st.integers(0, len(output)), max_size=6)))
        reader, got = fim.Reader(form), []
        for begin, end in zip([0, *cuts], [*cuts, len(output)], strict=True):
            got += reader.read(output[begin:end])
        got += reader.read("", last=True)
        assert "".join(p for _, p in sorted(got, key=lambda x: x[0])) == text
