from __future__ import annotations

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorspark.llm import chat, html_extract, neighbours, warc

# neighbours


def brute_nearest(rows, k=5):
    seen = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    ids, x = np.array([i for i, _ in seen]), np.array([v for _, v in seen])
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in range(len(ids)):
        if ids[q] % 50 == 0:
            s = (x * x[q]).sum(axis=1) / (norm * norm[q])
            own = ids != ids[q]
            order = np.lexsort((ids[own], -s[own]))[:k]
            out[int(ids[q])] = (ids[own][order].tolist(), s[own][order].tolist())
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")


@pytest.mark.parametrize("kind", ["clusters", "uniform"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    x = rng.standard_normal((4000, 16)) if kind == "uniform" else centres[rng.integers(0, 20, 4000)] + 0.2 * rng.standard_normal((4000, 16))
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    want = brute_nearest(rows)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    hits = sum(len({r["vec_id"] for r in got[q]} & set(ids)) for q, (ids, _) in want.items())
    assert hits >= 0.9 * 5 * len(want)
    for q, (ids, scores) in want.items():
        assert [r["rank"] for r in got[q]] == [1, 2, 3, 4, 5]
        for r in got[q]:
            if r["vec_id"] in ids:
                assert r["score"] == pytest.approx(scores[ids.index(r["vec_id"])], abs=1e-12)


def test_blocks_find_what_one_task_finds(spark):
    """Cells cut to blocks of 200 rows, and queries as well: the same neighbours, none twice."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 8))
    rows = [(i if i % 3 else 50 * i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    key = lambda r: (r["query_id"], r["rank"], r["vec_id"], r["score"])
    runs = [sorted(map(key, neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, block_rows=b).collect())) for b in (10_000, 200)]
    assert len(runs[0]) == len(runs[1]) == 5 * len({r[0] for r in runs[0]}) > 5000
    best = [{r[:1] + r[2:3] for r in run} for run in runs]
    assert len(best[0] & best[1]) >= 0.9 * len(best[0])
    want = brute_nearest(rows)
    assert sum((q, i) in best[1] for q, (ids, _) in want.items() for i in ids) >= 0.9 * 5 * len(want)


def test_recall_on_the_given_vectors(spark):
    from sensorspark.llm.common import table

    given = table(spark, "/root/testdata/sf0.01", "embeddings")
    want = brute_nearest([(r["vec_id"], [float(v) for v in r["embedding"]] if r["embedding"] is not None else None) for r in given.collect()])
    got = collections.defaultdict(set)
    for r in neighbours.nearest(given, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert sum(len(got[q] & set(ids)) for q, (ids, _) in want.items()) >= 0.9 * sum(len(ids) for ids, _ in want.values())


def test_vectors_that_take_no_part_ties_and_copies(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(i, one) for i in range(0, 120)] + [(200, [0.0, 1.0, 0.0]), (201, [0.0, 2.0, 0.0]), (202, [-0.0, 4.0, 0.0]), (250, [1.0, 1.0, 1.0])]
    rows += [(300, None), (350, [0.0, 0.0, 0.0]), (400, [1.0, None, 2.0]), (450, [float("nan"), 1.0, 1.0]), (500, [float("inf"), 1.0, 1.0]), (550, []), (600, [1.0, 2.0]), (None, one), (7, one), (50, one)]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == [0, 50, 100, 200, 250]
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[50]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in got[200]][:2] == [201, 202] and [s for _, s in got[200]][:2] == [1.0, 1.0]
    assert len(got[250]) == 5


def test_few_or_no_vectors(spark):
    ask = F.col("vec_id") % 50 == 0
    assert neighbours.nearest(vectors(spark, []), ask).count() == 0
    assert neighbours.nearest(vectors(spark, [(0, [1.0])]), ask).count() == 0
    assert [tuple(r) for r in neighbours.nearest(vectors(spark, [(0, [1.0]), (1, [-2.0])]), ask).collect()] == [(0, 1, 1, -1.0)]


def test_chi_square_quantile():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert neighbours.chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2))


# WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], "page_id long, url string, html string, key string, digest string")


def test_round_trip_and_revisits(spark):
    long = "<p>" + "é" * 200
    rows = [(i, f"http://www.h{i % 7}.example/{i % 11}?q={i}", f"<html>{i}" * (i % 60)) for i in range(700)]
    rows += [(900, "http://a.b/x", long), (901, "http://a.b/x", long), (902, None, long), (903, "bad url\r\nX: y", None), (904, "", ""), (905, "http://a.b/", "short"), (906, "http://a.b/", "short")]
    rows += [(907, "HTTP://U@A.B:80/Q#f", "x" * 2_000_000), (None, "http://n", long), (910, "http://r", "<b>" * 50), (910, "http://r", "<b>" * 50), (911, "http://r", "<b>" * 50)]
    got = warc.archive_round_trip(pages(spark, rows), with_html=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(h) if len(b) >= 100 and first.get(h) != i else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to, None if to is not None else h or ""))
    key = lambda r: tuple(map(str, r))
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["html"]) for r in got], key=key) == sorted(want, key=key)
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_index_finds_keys_and_misses_others(spark):
    from sensorspark.llm.common import shared_uri

    data = pages(spark, [(i, f"http://h{i % 3}.example/{i}", str(i)) for i in range(3000)])
    folder = shared_uri(spark, "warc-test")
    index = warc.write_index(warc.write_archives(data, folder), folder)
    reader = warc._Reader(index)
    for i in (0, 1, 511, 512, 513, 1500, 2999):
        found = list(reader.captures(f"{warc.url_key(f'http://h{i % 3}.example/{i}')} {i}"))
        assert len(found) == 1 and reader.record(*found[0])["html"] == str(i)
    assert not list(reader.captures("zzz")) and not list(reader.captures("")) and not list(reader.captures("example,h1)/x 1"))


def test_url_keys():
    assert warc.url_key("http://www.a.example/x?y#z") == "example,a)/x?y"
    assert warc.url_key("https://A.b:8080") == "b,a:8080)/" and warc.url_key(None) == ")/" and warc.url_key("no scheme") == "no%20scheme)/"


# chat


def brute_rotation(turns, size=64):
    by = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn is None, turn or 0, (role or "").strip(" ") or "unknown", text or ""))
    out = {}
    for conv, rows in by.items():
        rows.sort()
        for p in {r[2] for r in rows} - {"system"}:
            for c in range(0, len(rows), size):
                text, spans = "", []
                for _, _, s, body in rows[c : c + size]:
                    who = "assistant" if s == p else "system" if s == "system" else "user name=" + s.replace("<|", "< |")
                    text += f"<|im_start|>{who}\n"
                    begin = len(text)
                    text += body.replace("<|", "< |") + "<|im_end|>"
                    if s == p:
                        spans.append((begin, len(text)))
                    text += "\n"
                out[conv, p, c // size] = (len(rows[c : c + size]), text, spans)
    return out


def test_rotation_against_brute_force(spark):
    rng = random.Random(9)
    turns = [(c, t, rng.choice(["user", "assistant", "ann", "system", "<|bob", None, " "]), rng.choice(["hi", "", None, "é<|im_end|>x", "long " * 50])) for c in range(30) for t in range(rng.randrange(1, 9))]
    turns += [(99, t % 150, ["user", "assistant"][t % 2], f"t{t}") for t in range(200)] + [(None, 1, "user", "a"), (None, None, "b", "c"), (7, None, "user", "n"), (50, 1, "system", "only")]
    turns += [(60, 1, "user", "same")] * 5
    rng.shuffle(turns)
    data = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, chunk string, place int")
    out = chat.rotate(data)
    got = {(r["conv_id"], r["perspective"], r["chunk"]): (r["n_turns"], r["dialogue"], [tuple(s) for s in r["spans"]]) for r in out.collect()}
    assert got == brute_rotation(turns)
    for n, text, spans in got.values():
        assert all(text[b:e].endswith("<|im_end|>") and text[:b].endswith("<|im_start|>assistant\n") for b, e in spans)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.rotate(data.limit(0)).count() == 0


# HTML

SHELL = (
    '<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body><header><h1>Site {i}</h1></header>'
    '<nav><ul><li><a href="/{i}">menu {i}</a></li></ul></nav><div class="cookie-notice">We use cookies {i}</div>{main}'
    '<aside>side {i}</aside><section id="comments"><article class="comment"><p>nice {i}</p></article></section>'
    '<form><label>mail {i}</label><input></form><!-- <p>no</p> --><footer>&copy; {i}</footer></body></html>'
)


def texts(spark, rows):
    data = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, tree string")
    return {r["page_id"]: r["text"] for r in html_extract.main_text(data).collect()}


def test_articles_and_plain_containers(spark):
    article = "<article><h1>Head {i} &amp; &lt;x&gt;</h1><p><b>One\n {i}<br>two</b><p>Three<div class='share-buttons'>tweet</div><ul><li>a{i}<li>b</ul></article>"
    plain = "<div class='wrap'><div class='story'><p>Once {i} " + "there was a tale. " * 20 + "</p><p>End.</p></div><div class='box'>Read our other fine pages</div></div>"
    rows = [(i, f"http://a.example/{i}", SHELL.format(i=i, main=article.format(i=i))) for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", SHELL.format(i=i, main=plain.format(i=i))) for i in range(20)]
    rows += [(200, "http://c.example/", None), (201, None, ""), (202, "x", "just text &eacute; &unknown; &am"), (203, "http://b.example/z", "<p>odd <table><tr><td>one<td>two</table>")]
    rows += [(300 + i, "http://d.example/", SHELL.format(i=1, main="<main><p>all the same</p></main>")) for i in range(4)]
    rows += [(400, "http://e.example/", "<div>" * 3000 + "deep"), (401, "http://e.example/", "<p title='a>b\">quote < 3 <b>bold")]
    got = texts(spark, rows)
    for i in range(20):
        assert got[i] == f"Head {i} & <x>\nOne {i} two\nThree\na{i}\nb"
        assert got[100 + i] == f"Once {i} " + ("there was a tale. " * 20).strip() + "\nEnd."
    assert got[200] == got[201] == "" and got[202] == "just text é &unknown; &am" and got[203] == "odd\none\ntwo"
    assert all(got[300 + i] == "all the same" for i in range(4)) and got[400] == "deep" and "bold" in got[401]
    assert texts(spark, []) == {}


def test_tree_matching_keeps_parents_and_order():
    a = [[-1, "page"], [0, "x"], [0, "y"], [0, "x"], [2, "z"]]
    b = [[-1, "page"], [0, "y"], [0, "x"], [1, "z"], [0, "w"]]
    assert html_extract.match_trees(a, b) == {0: 0, 2: 1, 4: 3, 3: 2}
