"""Every stage of the pipeline against brute force on its own input, and the whole on odd tables."""

from __future__ import annotations

import collections
import random

import pytest

import corpus_pipeline
from sensorspark.llm import mixing, quality
from sensorspark.llm.common import via_table
from test_text_operators import DOCS, brute_leaks, brute_links, words

COLUMNS = [c.split()[0] for c in DOCS.split(", ")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [words(rng, 20) for _ in range(4)]
    texts = [words(rng, rng.randrange(30, 90)) for _ in range(150)]
    texts += [words(rng, 40).upper().replace(" ", "!! ") for _ in range(60)]
    texts += [texts[3], texts[3], texts[5] + " one more", " ".join(texts[7].split()[:-1])]
    texts += [f"{words(rng, 20)} {items[k % 4]} {words(rng, 20)}" for k in range(8)]
    texts += ["", None, "only three words", words(rng, 20_000)]
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), None if t is None else len(t), i, "s", "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 150), 0) for i in range(210)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def test_stages(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "mixing", "sharding"]
    stages = dict(corpus_pipeline.STAGES)

    kept = via_table(stages["quality"](spark, docs, path), "t")
    assert kept.columns == COLUMNS
    model = quality.train(docs, labels.where(quality.learns()))
    want = {r["doc_id"] for r in docs.where(quality.score(docs["text"], model) >= quality.THRESHOLD).collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == want and ids >= set(range(150)) and not ids & set(range(150, 210))

    rows = sorted(kept.collect(), key=lambda r: r["doc_id"])
    near = brute_links([r["text"] for r in rows])
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(rows))]
    single = via_table(stages["near_copies"](spark, kept, path), "t")
    assert single.columns == COLUMNS
    assert sorted(r["doc_id"] for r in single.collect()) == [rows[i]["doc_id"] for i in range(len(rows)) if root[i] == i]

    clean = via_table(stages["decontamination"](spark, single, path), "t")
    assert clean.columns == COLUMNS
    want = {r["doc_id"] for r in single.collect() if not any(brute_leaks(r["text"] or "", x) for x in items)}
    assert {r["doc_id"] for r in clean.collect()} == want

    mixed = via_table(stages["mixing"](spark, clean, path), "t")
    assert mixed.columns == COLUMNS
    times = collections.Counter(r["doc_id"] for r in mixed.collect())
    plan = mixing.mix_sources(clean, mixing.label_weights(labels)).collect()
    for r in plan:
        assert times[r["doc_id"]] == r["epochs"] + (0 < r["part"] and 2 * r["part"] >= r["size"])

    final = stages["sharding"](spark, mixed, path).collect()
    by = collections.defaultdict(list)
    for r in final:
        by[r["shard"]].append(r["slot"])
    assert sum(map(len, by.values())) == sum(times.values()) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_run_and_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert set(COLUMNS) - {"shard"} <= set(out.columns) and out.count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_without_labels_and_benchmark(spark, folder, tmp_path):
    """Nothing is rejected; copies still go."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 40")
    docs.union(docs).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        rows = via_table(stage(spark, rows, str(tmp_path)), "t")
    assert rows.count() == docs.count()
