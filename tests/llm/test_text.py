import hashlib
import random
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from clicktrail.llm import quality, rules, substrings, tokens
from tests.llm.conftest import sentence, words

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def test_token_counts_equal_the_library(odd, odd_rows, frame, none):
    path = public_tokenizers.path(tokens.VOCABULARY)
    library = Tokenizer.from_file(path)
    hard = ["a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "I'm we'll 'S 's'", "e\u0301 \u0301", "日本語 123 ½", "ab\x1ccd\x85e", "İΣ ΑΣ",
            "👩‍👩‍👧!!", "ab" * 3000 + "!?", "\x00a\x7f", "\ufeffhi", "a\u200bb", "ﬁ ŉ", "<<|endoftext|>>"]
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(hard)]
    got = sorted(map(tuple, tokens.token_counts(frame(rows), path).collect()), key=str)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 2048) for r in rows), key=str)
    assert tokens.token_counts(none, path).collect() == []


def test_merging_keeps_the_order_of_ranks():
    ranks = {(1, 2): (0, 4), (4, 3): (2, 5), (2, 3): (1, 6), (1, 1): (3, 7)}
    assert tokens.merges_in([1, 2, 3], dict(ranks)) == 2 and tokens.merges_in([1, 1, 1], dict(ranks)) == 1 and tokens.merges_in([], ranks) == 0


def removed(rows, size):
    lists = [(float("inf") if i is None else i, i, SPLIT.findall((t or "").encode())) for i, t, *_ in rows]
    low = {}
    for order, _, w in lists:
        for k in range(len(w) - size + 1):
            low[tuple(w[k:k + size])] = min(low.get(tuple(w[k:k + size]), order), order)
    out = []
    for order, i, w in lists:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if low[tuple(w[k:k + size])] < order:
                gone[k:k + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_cover_has_every_difference():
    for period in (7, 13, 21, 31):
        cover = substrings.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and len(cover) <= 6


def test_repeated_passages(odd, odd_rows, none):
    assert sorted(map(tuple, substrings.deduplicate(odd).collect()), key=str) == removed(odd_rows, 50)
    assert substrings.deduplicate(none).collect() == []


def test_repeats_of_every_shift_and_length(frame, monkeypatch):
    rng = random.Random(9)
    source = words(rng, 400)
    rows = [(0, " ".join(source))]
    for i in range(1, 90):  # runs just below, at and above the window, at every place modulo the period
        at, n = rng.randrange(300), rng.choice([48, 49, 50, 51, 70])
        rows.append((i, "  ".join(words(rng, i % 37) + source[at:at + n] + words(rng, rng.randint(0, 60)))))
    rng.shuffle(rows)
    assert sorted(map(tuple, substrings.deduplicate(frame(rows)).collect()), key=str) == removed(rows, 50)
    text = substrings.deduplicate(frame(rows), with_text=True).select("doc_id", "kept", "kept_sha256").collect()
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in text)


def base(text):
    w = SPLIT.findall((text or "").encode())
    w = [x.decode() for x in w]
    seen = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    hit = [False] * len(w)
    for k in range(len(w) - 4):
        if seen[tuple(w[k:k + 5])] > 1:
            hit[k:k + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if SPLIT.search(x.encode())]
    n, r = len(w), sum(hit)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def test_base_rules(spark, odd, odd_rows, none, frame):
    more = [(70, "a b\na b\n\na b\r\n \nc"), (71, "a b c d e a b c d e a b c d e f"), (72, "# $ <b> |x| 5% " * 5), (73, "a b c d e f " * 3 + " ".join(map(str, range(100))))]
    rows = odd_rows + more
    got = rules.statistics(frame(rows)).select("doc_id", *rules.COUNTS[:5], rules.base_failed().alias("base_failed")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], *base(r[1])) for r in rows), key=str)
    assert rules.statistics(none).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = rules.judge(odd, labels)[0].collect()
    assert len(kept) == len(odd_rows) and all(r["kept"] != r["base_failed"] for r in kept)


def junk(rng, kind):
    w = words(rng, rng.randint(30, 120))
    if kind == 0:
        return " ".join(x + rng.choice(["###", "$$$", "%%%"]) for x in w)
    if kind == 1:
        return " ".join(x.upper() + "!!" for x in w)
    return " | ".join(w)


def labelled(spark, n=900):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        rows.append((i, junk(rng, i % 3) if bad else " ".join(sentence(rng, 12) for _ in range(rng.randint(2, 12)))))
        if i % 2:
            labels.append((i, int(not bad), 0))
    labels += [(None, 0, 0), (5000, 1, 1), (1, None, None)]
    return rows, labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learned_list_rejects_junk(spark, frame):
    rows, labels, table = labelled(spark)
    verdicts, learned = rules.judge(frame(rows), table)
    truth, got = {i: q for i, q, _ in labels}, {r["doc_id"]: r for r in verdicts.collect()}
    assert 1 <= len(learned.rules) <= 8
    clean = [r for i, r in got.items() if truth.get(i) == 1 and not r["base_failed"]]
    dirty = [r for i, r in got.items() if truth.get(i) == 0]
    assert all(r["kept"] for r in clean) and sum(not r["kept"] for r in dirty) >= 0.95 * len(dirty)


def test_classifier_on_held_out_rows(spark, frame):
    rows, labels, table = labelled(spark)
    got = {r["doc_id"]: r for r in quality.judge(frame(rows), table).collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    truth = {i: q for i, q, _ in labels if q is not None}
    held = [(truth[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in truth]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    again = quality.judge(frame(rows[::-1]), table).collect()
    assert {r["doc_id"]: r["predicted"] for r in again} == {i: r["predicted"] for i, r in got.items()}


def test_classifier_on_odd_rows(spark, odd, odd_rows, none, frame):
    _, _, table = labelled(spark)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.judge(odd, empty).collect()] == [1.0] * len(odd_rows)
    machine = quality.train(frame(labelled(spark)[0]), table)
    scored = quality.score(odd, machine)
    assert scored.select("row.*").columns == odd.columns and scored.count() == len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    assert quality.score(none, machine).collect() == []


def test_sum_of_squares_identity():
    import numpy as np

    rng = np.random.default_rng(1)
    m = quality.Machine(np.zeros(1), np.ones(1), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    index, value = np.array([1, 4, 5, 8]), rng.normal(size=4)
    pairs = sum(m.factor[index[a]] @ m.factor[index[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    assert abs(m.raw(np.zeros(4, int), index, value, 1)[0][0] - (0.3 + m.weight[index] @ value + pairs)) < 1e-5
