from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorspark.llm import decontaminate, jaccard, lines, mixing, quality, sharding
from sensorspark.llm.common import components, labels_of, shingle_sets, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, size string, shard string"


def documents(spark, texts, ids=None, sources=None):
    """Documents with other columns, some of whose names operators use."""
    rows = [
        (ids[i] if ids else i, t, "en", sources[i] if sources else f"src{i % 3}", None if t is None else len(t), -i, "x", None)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, names=2000):
    return " ".join(f"w{rng.randrange(names)}" for _ in range(n))


# words and sets


def test_word_hashes_cross_slices_and_follow_words():
    rng = random.Random(1)
    texts = ["", None, "  a\tb ", words(rng, 90_000), "É é", "b a", "x" * 300_000 + " b"]
    h, at = word_hashes(pa.array(texts))
    seen = {}
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        split = (text or "").lower().split()
        assert len(split) == b - a
        for w, x in zip(split, h[a:b].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_shingles_of_short_texts():
    sets = shingle_sets(*word_hashes(pa.array(["a b", "a b", "b a", "", "a b c d e f", "a b c d e"])))
    assert [len(s) for s in sets] == [1, 1, 1, 0, 2, 1]
    assert sets[0] == sets[1] != sets[2] and sets[5][0] in sets[4]


def test_components_of_hubs_and_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(1000, x) for x in range(900, 960)] + [(7, 7)] + [(5, 4)] * 3
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(41)} | {x: 900 for x in [*range(900, 960), 1000]}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# quality


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(2)
    texts = [words(rng, 60) if i % 3 else words(rng, 60).upper().replace(" ", "!! ") for i in range(300)] + [None, "", "é" * 5000]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5000, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    settings = quality.Settings(epochs=6)
    got = quality.scored(docs, labels, settings).withColumn("held", ~quality.learns()).collect()
    assert len(got) == len(texts) and all(0 <= r["quality_score"] <= 1 for r in got)
    held = [r for r in got if r["held"] and r["doc_id"] < 300]
    assert held and all((r["quality_score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in held)
    assert quality.scored(docs, labels, settings).select("doc_id", "quality_score").orderBy("doc_id").collect() == sorted(
        [(r["doc_id"], r["quality_score"]) for r in got]
    )
    kept = quality.accepted(docs, labels, settings=settings)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect() if r["doc_id"] < 300} >= {r["doc_id"] for r in held if r["doc_id"] % 3}


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, ["a b", None])
    assert [r["quality_score"] for r in quality.scored(docs, none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(i, 1, 0) for i in range(10)], none.schema)
    assert all(r["quality_score"] > 0.9 for r in quality.scored(docs, one).collect())
    assert quality.scored(docs.limit(0), one).count() == 0


def test_quality_reads_text_only(spark):
    docs = documents(spark, ["a b c"] * 4, ids=[1, 1, None, 7])
    labels = spark.createDataFrame([(1, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert len({r["quality_score"] for r in quality.scored(docs, labels, quality.Settings(epochs=1)).collect()}) == 1


# similarity join


def brute_links(texts, threshold=0.8):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    near = collections.defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                near[i].add(j)
                near[j].add(i)
    return near


def near_copies(rng, n):
    base = words(rng, 120).split()
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_join_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(1, 150)) for _ in range(150)] + near_copies(rng, 60) + near_copies(rng, 5)
    texts += texts[:20] + [texts[160]] * 30 + ["", None, " \n", "a b", "A  B", "a b", words(rng, 20_000)]
    # A passage that many texts share doesn't make them alike.
    passage = words(rng, 40)
    texts += [f"{passage} {words(rng, 60)}" for _ in range(80)]
    near = brute_links(texts)
    got = {r["doc_id"]: r for r in jaccard.jaccard_join(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(texts))]
        if new == root:
            break
        root = new
    for i in range(len(texts)):
        assert (got[i]["n_links"], got[i]["class_id"]) == (len(near[i]), root[i]), texts[i]
    kept = jaccard.representatives(documents(spark, texts))
    assert kept.columns == documents(spark, [""]).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in range(len(texts)) if root[i] == i)


def test_join_splits_large_groups(spark, monkeypatch):
    """A group far above the block's side is met block by block, and counts stay right."""
    rng = random.Random(4)
    texts = near_copies(rng, 700) + [words(rng, 80) for _ in range(30)]
    near = brute_links(texts)
    got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_join(documents(spark, texts)).collect()}
    assert got == {i: len(near[i]) for i in range(len(texts))}


@pytest.mark.parametrize("blocks, most, most_bytes", [(16, 8192, 16 << 20), (3, 40, 1 << 40), (1, 8192, 30_000), (1, 8192, 2_000), (1, 1 << 20, 1 << 40)])
def test_blocks_of_any_size_count_the_same(spark, monkeypatch, blocks, most, most_bytes):
    """Many small blocks, few large ones, blocks by bytes (some of them empty) and one block, each compared
    by strips."""
    for name, value in {"LIMIT": 16, "BLOCKS": blocks, "MOST": most, "MOST_BYTES": most_bytes}.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(8)
    texts = near_copies(rng, 180) + near_copies(rng, 70) + [words(rng, 60) for _ in range(30)]
    texts += texts[:15] + [" ".join(["same"] * 9)] * 3
    near = brute_links(texts)
    docs = documents(spark, texts)
    if most < 100:
        got = docs.limit(1).select(jaccard.block_count(F.lit(1000))).first()[0], docs.limit(1).select(jaccard.block_count(F.lit(90))).first()[0]
        assert got == (25, 3)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard.jaccard_join(docs).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: len(near[i]) for i in range(len(texts))}
    assert all(got[i][1] == got[j][1] for i in near for j in near[i])
    assert all(got[i][1] == i for i in range(len(texts)) if not near[i])


def test_parts_connect_what_the_links_connect():
    """Edges of a meeting and of its two blocks' own meetings connect what all links do."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        side, two = np.sort(rng.integers(0, 2, n)).astype(bool), bool(rng.integers(0, 2))
        side &= two
        a, b = rng.integers(0, n, (2, int(rng.integers(0, n))))
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        meeting = jaccard._Parts(side, np.full(n, two))
        meeting.link(a, b)
        assert not meeting.open(a, b).any()
        inside = (side[a] == side[b]) & two
        x, y = meeting.edges()
        got = labels_of(n, np.concatenate([x, a[inside]]), np.concatenate([y, b[inside]]))
        assert (got == labels_of(n, a, b)).all()


def test_join_null_and_repeated_ids(spark):
    texts = ["a b c d e f g"] * 3 + ["x y z"] * 2 + ["q r s t u v"]
    docs = documents(spark, texts, ids=[5, None, 5, None, None, 5])
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_copies"], r["n_links"]) for r in jaccard.jaccard_join(docs).collect() if r["doc_id"])
    assert got == [(False, 5, 1, 0), (False, 5, 3, 2), (False, 5, 3, 2)]
    kept = sorted(r["text"] for r in jaccard.representatives(docs).collect())
    assert kept == ["a b c d e f g", "q r s t u v", "x y z"]
    assert jaccard.jaccard_join(docs.limit(0)).count() == 0 and jaccard.representatives(docs.limit(0)).count() == 0


def test_runs_reach_the_target():
    assert jaccard.runs_for(0.99) >= 9 and jaccard.runs_for(0.5) < jaccard.runs_for(0.9)
    assert 70 < jaccard.closest_tokens(0.8) < 90


# decontamination


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_leaks(text, item, share=0.2):
    t = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    w = "".join(c if c.isalnum() else " " for c in item.lower()).split()
    k = int(share * len(w) + 1e-9)
    return any(edit_distance(t[s : s + len(w)], w) <= k for s in range(len(t)) if len(t[s : s + len(w)]) >= len(w) - k) if w else False


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    items = [words(rng, rng.randrange(12, 40), 300) for _ in range(12)]
    texts = []
    for i in range(120):
        w = words(rng, rng.randrange(20, 90), 300).split()
        if i % 3 == 0:
            leak = rng.choice(items).split()
            for _ in range(rng.randrange(0, int(0.2 * len(leak)) + 1)):
                at, kind = rng.randrange(len(leak)), rng.randrange(3)
                leak[at : at + (kind != 1)] = [] if kind == 2 else ["New,"]
            w[10:10] = [leak[0].upper(), *leak[1:]]
        texts.append(" ".join(w))
    texts += [items[0], items[1] + ".", "", None, items[2].split(" ", 2)[2], items[3] * 2, words(rng, 30_000, 300)]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (None, "a b"), (3, items[3])], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.flagged(docs, bench).collect()}
    assert len(got) == len(texts)
    want = {i: [k for k, item in enumerate(items) if brute_leaks(t or "", item)] for i, t in enumerate(texts[:-1])}
    found = sum(set(want[i]) <= set(got[i]["items"]) for i in want if want[i])
    assert found >= 0.95 * sum(bool(x) for x in want.values())
    assert all(set(got[i]["items"]) <= set(want[i]) for i in want), "a clean document is flagged"
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i in got if not got[i]["contaminated"]}


def test_decontamination_edge_tables(spark):
    docs = documents(spark, ["a b c d e f g h i j"] * 2 + [None, "other words here"], ids=[1, 1, None, None])
    bench = spark.createDataFrame([(1, "A b, c d e f-g h i j"), (2, "one two three"), (3, "b")], "item_id long, text string")
    got = [(r["doc_id"], r["items"]) for r in decontaminate.flagged(docs, bench).collect()]
    assert sorted(got, key=str) == [(1, [1, 3]), (1, [1, 3]), (None, []), (None, [])]
    assert decontaminate.clean_documents(docs, bench).count() == 2
    assert decontaminate.flagged(docs.limit(0), bench).count() == 0
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == 4


def test_embedding_repetitions_reach_recall():
    for n in (15, 25, 50):
        r = decontaminate.repetitions(n, 0.2, 0.95)
        assert 1 <= r < 64
    a = np.array([[1, 2, 3], [1, 2, 3]], dtype=np.uint64)
    assert decontaminate.edit_distances(a, np.array([3, 2]), np.array([[1, 9, 3], [1, 2, 3]], np.uint64)).tolist() == [1, 1]


# lines


def brute_lines(docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    holders = collections.defaultdict(list)
    for i, (doc_id, text) in enumerate(docs):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append((i, -(2**63) if doc_id is None else doc_id))
    out = []
    for doc_id, text in docs:
        own = -(2**63) if doc_id is None else doc_id
        split = (text or "").split("\n")
        kept = [x for x in split if len(holders[key(x)]) < 3 or max(d for _, d in holders[key(x)]) == own]
        out.append((doc_id, len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark):
    rng = random.Random(6)
    common = [words(rng, 8) for _ in range(10)] + ["  Ünïcödé ünïcödé ünïcödé\t", "short", "ABCDEFGHIJKLMNOPQRST", "abcdefghijklmnopqrst ", "é" * 19, "é" * 20]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.3 else words(rng, 9) for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    texts += ["", None, "\n\n", common[0], common[0], "\n".join([common[1]] * 50), words(rng, 50_000)]
    ids = [*range(len(texts) - 4), 7, 7, None, None]
    docs = documents(spark, texts, ids)
    out = lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    assert sorted([tuple(r) for r in out.collect()], key=str) == brute_lines(list(zip(ids, texts, strict=True)))
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    table = lines.PerfectHash.build(keys)
    assert sorted(table.find(keys).tolist()) == list(range(len(keys)))
    assert len(lines.PerfectHash.build(keys[:0]).find(keys[:3])) == 3


# mixing


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # Weights 5, 2, 1, 5: a stops at 30 and null at 270; 1800 are left for b and c by 2 : 1.
    assert got == pytest.approx({"a": 30.0, None: 270.0, "b": 1200.0, "c": 600.0})


def test_mixing_reaches_targets_and_reruns_agree(spark):
    rng = random.Random(7)
    texts = [words(rng, rng.choice([0, 1, 5, 40, 900])) for _ in range(400)] + [None, "", words(rng, 20_000)]
    sources = [rng.choice(["a", "a", "a", "b", "c", "d", None, ""]) for _ in texts]
    docs = documents(spark, texts, ids=[None if i % 50 == 0 else i // 2 for i in range(len(texts))], sources=sources)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 100)] + [(3, 1, 0), (4, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    run = lambda d: mixing.mix_sources(d, mixing.label_weights(labels))
    rows = run(docs).collect()
    assert len(rows) == len(texts)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    for held in by.values():
        assert sum(r["size"] for r in held) == held[0]["source_size"]
        assert sum(r["taken"] for r in held) == round(held[0]["target"])
        # The whole epochs come first, then the smallest keys; one document is cut at most.
        part = [r for r in sorted(held, key=lambda r: r["sample_key"]) if r["size"]]
        assert sum(0 < r["part"] < r["size"] for r in part) <= 1
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(sum(r["size"] for r in rows))
    again = run(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    mixed = mixing.mixed_documents(docs, mixing.label_weights(labels))
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert run(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_keys_favour_quality(spark):
    docs = documents(spark, ["w"] * 4000, sources=["a"] * 2000 + ["b"] * 2000)
    weights = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.25).alias("weight"))
    got = mixing.mix_sources(docs, weights, weights=(1, 3)).where("source = 'a' and part > 0").groupBy((F.col("doc_id") % 2 == 0).alias("good")).count().collect()
    n = {r["good"]: r["count"] for r in got}
    assert n[True] > 2 * n[False] > 0


# sharding


def test_curve_visits_neighbours():
    side, bits = 8, 3
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    at = sharding.hilbert_index(cells, bits)
    assert sorted(at.tolist()) == list(range(side**3))
    path = cells[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_follow_the_law(spark, law):
    rng = random.Random(8)
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(300)] + ["same"] * 150 + [None, "", None]
    docs = documents(spark, texts)
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    out = sharding.shard(docs, sharding.document_dimensions(), size, [F.col("doc_id")], law=law)
    rows = out.withColumn("bytes", size).collect()
    assert [c for c in out.columns if c not in docs.columns] == ["curve", "slot"] and len(rows) == len(texts)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for held in by.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        sums = [sum(r["bytes"] for r in h) for h in by.values()]
        assert max(sums) - min(sums) <= 2 * max(r["bytes"] for r in rows)
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in rows)
    assert sharding.shard(docs.limit(0), sharding.document_dimensions(), size, [F.col("doc_id")], law=law).count() == 0


def test_fewer_rows_than_shards(spark):
    docs = documents(spark, ["a", "a", None], ids=[1, 1, None])
    out = sharding.shard(docs, sharding.document_dimensions(), F.lit(1), [F.col("doc_id")])
    assert sorted((r["shard"], r["slot"]) for r in out.collect()) == [(0, 0), (2, 0), (5, 0)]
