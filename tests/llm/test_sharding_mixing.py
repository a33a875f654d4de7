import random
import zlib
from collections import Counter, defaultdict

from clicktrail.llm import mixing, sharding


def size_of(text):
    return len((text or "").encode()) + 16


def test_shards_are_balanced_contiguous_runs(frame):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(0, 200)) for i in range(700)]
    rng.shuffle(rows)
    got = sorted(sharding.shard(frame(rows), 9).collect(), key=lambda r: r["doc_id"])
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(sizes) == 9 and max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)
    assert all(s == list(range(len(s))) for s in slots.values())
    texts = dict(rows)
    assert all(r["size"] == size_of(texts[r["doc_id"]]) and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


def test_shards_of_odd_rows(odd, odd_rows, none):
    got = sharding.shard(odd, 5).collect()
    assert len(got) == len(odd_rows)
    assert sorted(r["size"] for r in got) == sorted(size_of(r[1]) for r in odd_rows)
    before = 0  # the law, row by row
    total = sum(r["size"] for r in got)
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        assert r["shard"] == min(4, (2 * before + r["size"]) * 5 // (2 * total))
        before += r["size"]
    assert sharding.shard(none).collect() == []


def test_written_shards(spark, frame, tmp_path):
    rows = [(i, "t" * i) for i in range(50)]
    placed = {r["doc_id"]: r["shard"] for r in sharding.write_shards(frame(rows).drop("shard"), str(tmp_path / "out"), 4).collect()}
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["doc_id"]: r["shard"] for r in back} == placed and {r["doc_id"]: r["text"] for r in back} == dict(rows)


def targets(sizes, weights=(1, 2, 3)):
    """Stop, share again, until no target is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = 3 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def held(docs, rows):
    got = mixing.taken(docs).collect()
    sizes, taken, goal = Counter({(r[2]): 0 for r in rows}), Counter(), {}
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    want = targets(sizes)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len((t or "").encode().split())) for i, t, _ in rows)
    by_source = defaultdict(set)
    for r in rows:
        by_source[r[0]].add(r[2])
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        if len(by_source[r["doc_id"]]) == 1:
            source, = by_source[r["doc_id"]]
            taken[source] += r["taken"]
            goal[source] = r["target"]
            assert r["source_size"] == sizes[source]
    return got, want, taken, goal


def test_mix_meets_targets(frame):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 300), "hot" if i % 3 == 0 else f"s{rng.randint(0, 6)}") for i in range(900)]
    rows += [(1000 + i, "w " * 40, None) for i in range(3)]
    got, want, taken, goal = held(frame(rows), rows)
    for source, target in want.items():
        assert abs(goal[source] - target) < 1e-5 and abs(taken[source] - target) <= 2
    assert sorted(map(tuple, mixing.taken(frame(rows[::-1])).collect())) == sorted(map(tuple, got))


def test_mix_of_odd_rows(odd, odd_rows, none):
    held(odd, odd_rows)
    assert mixing.taken(none).collect() == []
    assert mixing.mixed(none).collect() == []
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and {r["text"] for r in out.collect()} <= {r[1] for r in odd_rows}


def test_schedule_is_balanced_at_every_length(frame):
    rows = [(i, "w " * 50, f"s{i % 3}") for i in range(300)]
    slots = sorted(mixing.mix(frame(rows))[0].collect())
    assert [r["slot"] for r in slots] == list(range(2**mixing.BITS))
    counts, rank = Counter(), Counter()
    for k, r in enumerate(slots[:5000], 1):
        assert r["rank"] == rank[r["number"]]
        rank[r["number"]] += 1
        counts[r["number"]] += 1
        assert k < 50 or all(abs(counts[n] / k - n / 6) < 0.1 for n in (1, 2, 3))


def test_sources_below_a_slot_meet_their_targets(frame, monkeypatch):
    """With 2 ** 4 slots a slot has hundreds of words; sources of a few words are taken three times, not left out."""
    monkeypatch.setattr(mixing, "BITS", 4)
    monkeypatch.setattr(mixing, "FEW", 2)
    rows = [(i, "w " * 100, f"s{i % 3}") for i in range(60)] + [(100 + i, "w " * (1 + i % 7), f"t{i:02}") for i in range(40)]
    got, want, taken, goal = held(frame(rows), rows)
    for source, target in want.items():
        assert abs(taken[source] - target) <= (1 if source[0] == "t" else sum(want.values()) / 2**4 + 1)
    assert all(r["taken"] == 3 * r["size"] for r in got if r["doc_id"] >= 100)
    out = Counter(r["doc_id"] for r in mixing.mixed(frame(rows)).collect())
    assert all(out[100 + i] == 3 for i in range(40))
    slots = mixing.mix(frame(rows))[0].collect()
    assert {r["slot"] for r in slots} == set(range(2**4)) and len({r["number"] for r in slots}) == 43
    # many sources that all are below a slot, with targets below three times their size
    rows = [(i, "w " * (5 + i % 5), f"u{i:03}") for i in range(200)]
    _, want, taken, _ = held(frame(rows), rows)
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())


def test_mix_of_rows_without_ids_meets_targets(frame):
    """A third of the rows has no id, others share one; each row has its own count."""
    rng = random.Random(11)
    rows = [(None if i % 3 == 0 else i // 4 * 4 if i % 3 == 1 else i, f"text{i} " + "w " * rng.randint(20, 40), f"s{i % 4}") for i in range(1200)]
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want, got, copies = targets(sizes), Counter(), Counter()
    for r in mixing.mixed(frame(rows)).collect():
        got[r["source"]] += len(r["text"].split())
        copies[r["text"]] += 1
    assert max(copies.values()) <= 3 and set(copies) <= {r[1] for r in rows}
    for source, target in want.items():
        assert abs(got[source] - target) <= 0.02 * target + 80


def test_written_shards_hold_every_row_of_a_mix_once(spark, frame, tmp_path):
    rng = random.Random(13)
    rows = [(None if i % 3 == 0 else i // 2, f"text{i} " + "w " * rng.randint(1, 60), f"s{i % 3}") for i in range(300)]
    mix = spark.createDataFrame(mixing.mixed(frame(rows)).collect(), frame(rows).schema)
    assert mix.count() > mix.select("text").distinct().count()
    placed = sharding.write_shards(mix, str(tmp_path / "out"), 7)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == set(mix.columns)
    kept = [c for c in mix.columns if c != "shard"]
    assert Counter(map(tuple, back.select(kept).collect())) == Counter(map(tuple, mix.select(kept).collect()))
    by_shard = lambda df: Counter((r["shard"], r["doc_id"], r["crc"]) for r in df.collect())
    assert by_shard(back.selectExpr("shard", "doc_id", "crc32(text) crc")) == by_shard(placed.selectExpr("shard", "doc_id", "text_crc32 crc"))
