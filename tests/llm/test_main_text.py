from __future__ import annotations

import random

import pytest

from sensorspark.llm import html_extract

STORY = "<article><h1>Head</h1><p>First words of the story.</p><p>Last words.</p></article>"
TEXT = "Head\nFirst words of the story.\nLast words."


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=utf-8><body>" + STORY,
        "<html><head><title>T</title><style>p{}</style>" + STORY,
        "<html><head><template><div>no</div></template><title>T</title></head><body>" + STORY,
        "<body><select><option>a<option>b" + STORY,
        "<body><button>Press" + STORY + "<button>B</button>",
        "<body><object data=x><p>no</p></object><object data=y>" + STORY,
        "<body><button><div>no</div><p>no</p></button><svg><p>no</p></svg><svg viewBox=0 />" + STORY,
    ],
)
def test_elements_without_end_tag_hide_no_article(page):
    assert html_extract.extract(page, None) == TEXT


def test_text_ends_an_open_head():
    assert html_extract.extract("<head><title>T</title>\n Just text <b>here</b>", None) == "Just text here"


@pytest.mark.parametrize("body", ["<body class='has-sidebar'>{}", "<html class=login><body id=search>{}", "<body><main id='search-results'>{}</main>", "<body><div class='content login-page'>{}</div>", "<body><div class='content login'>{}</div>", "<body><form id=aspnetForm>{}</form>"])
def test_names_take_nothing_that_holds_the_text(body):
    assert html_extract.extract(body.format(STORY), None) == TEXT
    plain = STORY.replace("article", "div")
    assert html_extract.extract(body.format(plain), None) == TEXT


def test_names_are_hints():
    named = STORY.replace("<article>", "<article class='post comments-open'>").replace("<p>First", "<p title='the hidden lake' data-x=hidden>First")
    around = "<div class='ad'>buy</div><div class=share-this><a href=x>tweet it</a> or <a href=y>post it</a></div><p hidden>no</p>"
    talk = "<section id='comments'><article class='comment'><p>" + "I say a lot more than the story does. " * 9 + "</p></article></section>"
    assert html_extract.extract(named.replace("</article>", around + "</article>") + talk, None) == TEXT
    assert html_extract.extract(STORY.replace("<p>First", "<div class=notice><p>First").replace("story.</p>", "story.</p></div>"), None) == TEXT


def texts(spark, pages):
    data = spark.createDataFrame([(i, f"http://{host}/{i}", html) for i, (host, html) in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html_extract.main_text(data).orderBy("page_id").collect()]


def words(*key, n=60):
    return " ".join(f"w{hash((*key, j)) % 100003}" for j in range(n))  # numbers' hashes don't change


def test_small_parts_of_the_main_text_stay(spark):
    pages, expected = [], []
    for i in range(12):
        lead, story, box, more = (words(i, k, n=n) for k, n in enumerate((6, 90, 5, 80 if i == 7 else 3)))
        links = "<div class=x>" + "".join(f"<a href=/{j}>{words(i, j, n=3)}</a> " for j in range(3)) + "</div>"
        page = f"<body><div class=top>Our site</div>{links}<div class=wrap><div class=lead>{lead}</div><div class=story><p>{story}</p></div>" + (f"<div class=extra>{box}</div>" if i == 3 else "") + "</div></body>"
        pages.append(("plain.example", page))
        expected.append("\n".join([lead, story] + ([box] if i == 3 else [])))
        teasers = "".join(f"<article class=t><a href=/{j}>{words(i, j, n=2)}</a> {words(j, i, n=2)}</article>" for j in range(3))
        pages.append(("marked.example", f"<body><article class=big>{story}</article><article class=note>{more}</article><div>{teasers}</div></body>"))
        expected.append(f"{story}\n{more}")
    assert texts(spark, pages) == expected
    assert [html_extract.extract(p, None) for h, p in pages if h == "marked.example"] == expected[1::2]


def test_copies_are_no_evidence_for_a_template(spark):
    table = "<table><tr><td>one</td><td>two</td></table><section>" + words(99, n=20) + "</section>"
    copy, tail = words(98, n=60), "one\ntwo\n" + words(99, n=20)
    pages, expected = [], []
    for i in range(9):
        other = words(i, n=60)
        # Exact copies and copies of another advert beside other pages; a box that all repeat is template.
        for host, hit in (("e.example", "ad"), ("f.example", f"ad {i}")):
            pages += [(host, f"<body><div class=box>{hit}</div><article>{copy}{table}</article>"), (host, f"<body><div class=box>{hit}</div><article>{other}</article>")]
            expected += [f"{copy}\n{tail}", other]
        # Nothing but copies, with a counter or one changed word each, marked or not.
        pages += [("g.example", f"<body><div class=seen>seen {i}</div><article>{copy}{table}</article>"), ("h.example", f"<body><article>{copy} {i}{table}</article>")]
        expected += [f"{copy}\n{tail}", f"{copy} {i}\n{tail}"]
        pages += [("i.example", f"<body><div class=story>{copy}</div><div class=seen>{i}</div>")]
        expected += [f"{copy}\n{i}"]
        # Different stories with the same box inside and out.
        pages += [("j.example", f"<body><article>{other}<div class=x>Like it</div></article>"), ("k.example", f"<body><div class=s>{other}</div><div class=x>{words(97, n=200)}</div>")]
        expected += [other, other]
    assert texts(spark, pages) == expected


def plain_matching(a, b, x=0, y=0):
    """Simple tree matching by its recursion: the number of pairs below two nodes of one label."""
    if a[x][1] != b[y][1]:
        return 0
    m, n = [i for i, v in enumerate(a) if v[0] == x], [j for j, v in enumerate(b) if v[0] == y]
    best = [[0] * (len(n) + 1) for _ in range(len(m) + 1)]
    for i in range(len(m)):
        for j in range(len(n)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_matching(a, b, m[i], n[j]))
    return best[-1][-1] + 1


def random_tree(rng, n):
    return [[-1, "r"]] + [[rng.randrange(max(0, i - 4), i), rng.choice("abc")] for i in range(1, n)]


def check_matching(a, b, got):
    """Equal labels, parents with parents, siblings in order, each node once."""
    assert got[0] == 0 and len(set(got.values())) == len(got)
    for x, y in got.items():
        assert a[x][1] == b[y][1] and (x == 0 or got[a[x][0]] == b[y][0])
        assert all((x < v) == (y < w) for v, w in got.items() if a[v][0] == a[x][0] and v != x)


@pytest.mark.parametrize("seed", range(30))
def test_matching_equals_its_recursion(seed):
    rng = random.Random(seed)
    a, b = random_tree(rng, rng.randrange(1, 25)), random_tree(rng, rng.randrange(1, 25))
    got = html_extract.match_trees(a, b)
    check_matching(a, b, got)
    assert len(got) == plain_matching(a, b)
    for limits in ({"cells": 0}, {"cells": 4}, {"pairs": 2}):
        few = html_extract.match_trees(a, b, **limits)
        check_matching(a, b, few)
        assert len(few) <= len(got)
    assert html_extract.match_trees(a, a, cells=0) == {i: i for i in range(len(a))}


def wide_tree(rng, n, kinds="ab"):
    """``n`` siblings of one or two labels, each with a few nodes below."""
    tree = [[-1, "r"]]
    for _ in range(n):
        tree.append([0, rng.choice("xxxy")])
        top = len(tree) - 1
        for _ in range(rng.randrange(4)):
            tree.append([rng.randrange(top, len(tree)), rng.choice(kinds)])
    return tree


@pytest.mark.parametrize("seed", range(8))
def test_matching_of_wide_trees_is_the_largest(seed):
    rng = random.Random(seed)
    a, b = wide_tree(rng, 45), wide_tree(rng, 40)
    got = html_extract.match_trees(a, b)
    check_matching(a, b, got)
    assert len(got) == plain_matching(a, b)


@pytest.mark.parametrize("seed", range(20))
def test_bounds_of_memory_leave_the_matching_as_it_is(seed):
    rng = random.Random(seed)
    a, b = (wide_tree(rng, rng.randrange(60), "abc") for _ in "ab")
    got = html_extract.match_trees(a, b)
    for limits in ({"cells": 0}, {"cells": 50}, {"pairs": 0}, {"cells": 9, "pairs": 3}):
        assert html_extract.match_trees(a, b, **limits) == got


@pytest.mark.parametrize("n", [5, 31, 40])
def test_a_notice_after_a_list_of_any_length_is_template(spark, n):
    pages, expected = [], []
    for i in range(12):
        own = [words(n, i, k, n=8) for k in range(n + i % 3 // 2)]
        pages.append(("list.example", "<body>" + "".join(f"<div class=x>{t}</div>" for t in own) + "<div class=x>Read on<div class=y>Our site is yours.</div></div><div class=z>" + words(n, i, n=9) + "</div>"))
        expected.append("\n".join([*own, words(n, i, n=9)]))
        if i % 2:
            # The last list item has a box below too, so that nothing at the end is of one shape.
            pages[-1] = (pages[-1][0], pages[-1][1].replace("</div><div class=z>", "<div class=w>" + words(i, n, n=7) + "</div></div><div class=z>"))
            expected[-1] = "\n".join([*own, words(i, n, n=7), words(n, i, n=9)])
    assert texts(spark, pages) == expected


@pytest.mark.parametrize("inner", ["<p>{}</p>", "<div class=y><span>{}</span><div class=z>{}</div></div>"])
def test_wide_pages_in_bounded_time_and_memory(inner):
    import time
    import tracemalloc

    body = "".join("<div class=x>" + inner.replace("{}", f"word {i}") + "</div>" for i in range(20_000))
    page = html_extract.Page("<body><article>" + body + "</article>")
    other = html_extract.Page("<body><div class=menu>a</div><article>" + body[: len(body) // 2] + "</article>")
    a, b = page.tree(), other.tree()
    tracemalloc.start()
    begin = time.perf_counter()
    got = html_extract.match_trees(a, b)
    took = time.perf_counter() - begin
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) > 0.45 * len(a) and took < 30 and peak < 200 << 20
    assert html_extract.extract("<body><article>" + body + "</article>", None).count("\n") + 1 >= 20_000


def test_wrappers_of_many_hosts_in_bounded_memory():
    import json
    import tracemalloc

    one = json.dumps([[[-1, "page", 0, 0, 0, 0], *([0, "div.h", 0, 10, i << 30, 0] for i in range(5_000))], {"mark": "", "slots": [0]}])
    known: dict = {}
    tracemalloc.start()
    for host in [*range(60), 3, 59, 3]:
        nodes, chosen = html_extract.parsed(one.replace("div.h", f"div.h{host}"), known)
        assert len(nodes) == 5_001 and nodes[-1][1] == f"div.h{host}" and chosen["slots"] == [0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    # Small ones stay, a large one stands alone, no host has none.
    known.clear()
    small = ["[[], {}]", "[[0], {}]", "[[1], {}]"]
    assert [html_extract.parsed(x, known, 20) for x in small] == [([], {}), ([0], {}), ([1], {})] and list(known) == small[2:]
    assert html_extract.parsed("[[1, 2, 3, 4, 5, 6], {}]", known, 20) == ([1, 2, 3, 4, 5, 6], {}) and len(known) == 1
    assert html_extract.parsed(None, known) is None


@pytest.mark.parametrize("tag", ["b", "p", "a href=x", "object", "li", "div", "select"])
def test_unclosed_tags_in_linear_time(tag):
    import time

    begin = time.perf_counter()
    page = html_extract.Page("<body><article>" + "".join(f"<{tag}>w{i} " for i in range(100_000)))
    assert time.perf_counter() - begin < 25 and len(page.nodes) >= 2
