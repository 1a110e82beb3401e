from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorspark.llm import pii


def plain_base(text):
    """The contract's patterns, run as they stand."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(alphabet="a1@.+- é(", max_size=60), st.text(alphabet="0123456789.+ -@x", max_size=60), st.lists(st.sampled_from(["a.b@c.de", "@", "1.2.3.4", "256", ".", "4242 4242 4242 4242", "+1 (980) 555-2833", " ", "7", "-", "٣", "_"]), max_size=12).map("".join)))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_spans_of_long_runs_take_no_long_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "1 " * 200_000, "+1" + "(" * 300_000, "a@b." * 100_000, "9" * 5000 + ".1.1.1"):
        pii.base_spans(text)
        pii.all_spans(text[:60_000], np.zeros(pii.WEIGHTS))


def chains(lat):
    """All sets of candidates that do not overlap."""
    n = len(lat.begin)
    for k in range(n + 1):
        for some in itertools.combinations(range(n), k):
            rows = sorted((lat.begin[c], lat.end[c]) for c in some)
            if all(a[1] <= b[0] for a, b in zip(rows, rows[1:], strict=False)):
                yield some


@pytest.mark.parametrize("seed", range(12))
def test_dynamic_programming_against_every_segmentation(seed):
    rng = random.Random(seed)
    lat = pii.Lattice()
    for _ in range(rng.randint(1, 9)):
        b = rng.randint(0, 12)
        lat.add(b, b + rng.randint(1, 5), rng.randrange(4), [f"f{rng.randint(0, 6)}", f"g{rng.randint(0, 3)}"])
    weights = np.random.default_rng(seed).normal(size=pii.WEIGHTS)
    scores = lat.scores(weights)
    every = [(sum(scores[list(s)]), s) for s in chains(lat)]
    z = math.log(sum(math.exp(x) for x, _ in every))
    got, p = pii.marginals(lat, scores)
    assert got == pytest.approx(z)
    for c in range(len(scores)):
        assert p[c] == pytest.approx(sum(math.exp(x - z) for x, s in every if c in s))
    assert sum(scores[pii.best(lat, scores)]) == pytest.approx(max(x for x, _ in every))
    gold = max(every)[1]
    like, numbers, values = pii.gradient(lat, gold, weights)
    assert like == pytest.approx(max(every)[0] - z)
    for f in set(numbers.tolist()):
        up, down = weights.copy(), weights.copy()
        up[f] += 1e-5
        down[f] -= 1e-5
        slope = (pii.gradient(lat, gold, up)[0] - pii.gradient(lat, gold, down)[0]) / 2e-5
        assert values[numbers == f].sum() == pytest.approx(slope, abs=1e-6)


@pytest.fixture(scope="module")
def weights():
    writer = pii.Writer([], 5)
    return pii.fit([writer.window() for _ in range(3000)])


def test_held_out_windows(weights):
    writer, hit, wrong, missed = pii.Writer([], 77), 0, 0, 0
    for _ in range(800):
        text, gold = writer.window()
        got = {s[:3] for s in pii.decoded(text, weights) if s[3] >= pii.SURE}
        hit, wrong, missed = hit + len(got & set(gold)), wrong + len(got - set(gold)), missed + len(set(gold) - got)
    assert hit / (hit + missed) > 0.9 and hit / (hit + wrong) > 0.97


def test_spans_that_patterns_miss(weights):
    for text, kind, span in [
        ("write to maria.lopez [at] example [dot] org today", "email", "maria.lopez [at] example [dot] org"),
        ("you may call 555-832-4471 before noon", "phone", "555-832-4471"),
        ("the host 192[.]168[.]7[.]21 was down", "ip", "192[.]168[.]7[.]21"),
        ("paid with 4242.4242.4242.4242 yesterday", "card", "4242.4242.4242.4242"),
    ]:
        assert pii.base_spans(text) == []
        assert [(pii.KINDS[k], text[a:b], base) for k, a, b, base in pii.all_spans(text, weights)] == [(kind, span, False)]


def test_clean_texts_stay_clean(weights):
    for text in ["", "we met at noon. dot the i, please", "on 2024-05-17 at 12:30:45 it was 3.1415926", "chapter 1.2.3, pages 100-200, 1,234,567 rows", 'token = "bc0a5302762f37969011b69180d661037b374f6e"', "order 7844238401328226 shipped", "ISBN 978-3-16-148410-0", "look at home @ nine or write @someone"]:
        assert pii.all_spans(text, weights) == []


def test_masked(weights):
    text = "mail a.b@mail.example.com or +1 (980) 555-2833, é 10.0.0.1"
    assert pii.masked(text, pii.all_spans(text, weights)) == "mail <EMAIL> or <PHONE>, é <IP>"


def test_query_rows(spark, weights):
    long = "word " * 40_000 + "x.y@z.org " + "7" * 50_000
    rows = [(1, "mail a.b@mail.example.com or +1 (980) 555-2833"), (1, None), (None, ""), (2, "4242 4242 4242 4242 and 10.0.0.1 🙂 a@b.cd"), (2, "4242 4242 4242 4242 and 10.0.0.1 🙂 a@b.cd"), (3, long), (4, "nothing")]
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, spans string, end int").repartition(2)
    got = pii.find_personal(docs, weights, keep=("doc_id", "spans", "end")).collect()
    assert sorted((str(r["doc_id"]), r["end"], [tuple(s) for s in r["spans"]]) for r in got) == sorted(
        (str(i), 3, [(pii.KINDS[k], a, b, base) for k, a, b, base in pii.all_spans(t or "", weights)]) for i, t in rows
    )
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal(empty, weights).collect() == []


def test_training_repeats_and_takes_any_table(spark):
    small = pii.Settings(documents=50, windows=20, contexts=10, written=60)
    rows = [(i, f"word {i} mail u{i}@mail.example.com end") for i in range(80)] + [(None, None), (5, ""), (7, "no data here " * 20)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = pii.train(docs, small)
    assert np.array_equal(one, pii.train(docs.repartition(5), small)) and np.abs(one).sum() > 0
    found, contexts = pii.sample_windows(docs, small)
    assert 0 < len(found) <= 20 and len(contexts) <= 10
    for text, spans in found:
        assert [text[a:b].endswith("example.com") for _, a, b in spans] == [True] * len(spans) != []
    assert pii.train(docs.limit(0), small).shape == (pii.WEIGHTS,)


def test_query_against_plain_patterns(spark):
    from sensorspark.llm.common import table
    from sensorspark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"] or "") for r in table(spark, sf, "documents").collect()]
    want = []
    for i, t in texts:
        spans = plain_base(t)
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want.append((i, *(sum(s[0] == k for s in spans) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest()))
    got = QUERIES["op11_semi_markov_pii"](spark, sf).collect()
    assert sorted((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == sorted(want)
    for r in got:
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert all(kinds.count(k) >= r[f"n_{k}"] for k in pii.KINDS)
