import random
from collections import Counter, defaultdict

import corpus_pipeline
from clicktrail.llm import neighbours, quality, sharding
from clicktrail.llm.queries import ORACLES, QUERIES
from tests.llm.test_pairs import joined, leaked, low_words
from tests.llm.test_sharding_mixing import targets

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, FOLDER).cache()
        after = [tuple(r) for r in docs.collect()]
        assert docs.columns == columns and set(after) <= set(before)
        ids, left = {r[0] for r in before}, {r[0] for r in after}
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            assert sum(labels.get(i) == 1 for i in ids - left) == 0
        elif name == "near duplicates":
            assert left == {i for i, _, c in joined(before) if i == c}
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
            assert ids - left == {x[0] for x in leaked(before, items)}
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert placed.count() == len(after) and set(placed.columns) >= {"doc_id", "shard", "slot"}


def test_stages_on_odd_and_empty_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, FOLDER).count() >= 0


def test_near_duplicates_stage_keeps_a_row_of_each_component_of_texts(spark, odd, odd_rows):
    """Rows are told apart by their texts, not by their ids; texts without words go by id."""
    kept = [tuple(r) for r in corpus_pipeline.STAGES[1][1](spark, odd, FOLDER).collect()]
    of = {i: c for i, _, c in joined([(i, r[1]) for i, r in enumerate(odd_rows)])}
    place = lambda text: next(i for i, r in enumerate(odd_rows) if r[1] == text)
    full = [r for r in kept if low_words(r[1])]
    components = [of[place(r[1])] for r in full]
    assert len(components) == len(set(components)) and set(components) == {of[i] for i, r in enumerate(odd_rows) if low_words(r[1])}
    assert Counter(r[0] for r in kept if not low_words(r[1])) == Counter({r[0] for r in odd_rows if not low_words(r[1])})


def test_mixing_and_sharding_stages(spark, frame):
    """Values: words per source near the targets, and shards that are runs of equal bytes over every row."""
    rng = random.Random(21)
    rows = [(None if i % 3 == 0 else i, f"t{i} " + "w " * rng.randint(20, 60), f"s{i % 3}") for i in range(900)]
    mix = spark.createDataFrame(corpus_pipeline.STAGES[3][1](spark, frame(rows), FOLDER).collect(), frame(rows).schema)
    words = Counter()
    for r in mix.collect():
        words[r["source"]] += len(r["text"].split())
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    for source, target in targets(sizes).items():
        assert abs(words[source] - target) <= 0.02 * target + 120
    placed = corpus_pipeline.STAGES[4][1](spark, mix, FOLDER).collect()
    assert Counter((r["doc_id"], r["size"]) for r in placed) == Counter((r["doc_id"], len(r["text"]) + 16) for r in mix.collect())
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append((r["slot"], r["size"]))
    total = sum(r["size"] for r in placed)
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values())
    assert all(abs(sum(n for _, n in v) - total / sharding.SHARDS) <= max(r["size"] for r in placed) for v in slots.values())


def test_names():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert neighbours.near and quality.judge
