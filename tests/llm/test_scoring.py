"""op11 against a trie of Counters with explicit sets of excluded symbols."""

import math
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import pytest

from clicktrail.llm import scoring
from clicktrail.llm.common import WORD

WORDS = re.compile(WORD)


def held(id_):
    return id_ is not None and zlib.crc32(str(id_).encode()) % 5 == 1


def symbols(text):
    return [scoring.BEGIN] * scoring.ORDER + list((text or "").encode()) + [scoring.END]


def trie(texts):
    counts = defaultdict(Counter)
    for text in texts:
        s = symbols(text)
        for i in range(scoring.ORDER, len(s)):
            for k in range(scoring.ORDER + 1):
                counts[tuple(s[i - k:i])][s[i]] += 1
    return counts


def chance(counts, context, symbol):
    """Probability of a symbol after a context, by escapes with method C and exclusion."""
    p, seen = 1.0, set()
    for k in range(len(context), -1, -1):
        here = {s: n for s, n in counts.get(tuple(context[len(context) - k:]), {}).items() if s not in seen}
        if not here:
            continue
        total = sum(here.values()) + len(here)
        if symbol in here:
            return p * here[symbol] / total
        p *= len(here) / total
        seen |= set(here)
    return p / (scoring.SYMBOLS - len(seen))


def brute(rows):
    train = [r for r in rows if not held(r[0])]
    counts = trie(r[1] for r in train)
    tokens = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(t or "")] + [None]
    known = Counter(w for r in train for w in tokens(r[1]))
    n, v = sum(known.values()), len(known)
    memo = {}
    out = []
    for id_, text, *_ in rows:
        s, words = symbols(text), tokens(text)
        score = 0.0
        for i in range(scoring.ORDER, len(s)):
            key = tuple(s[i - scoring.ORDER:i + 1])
            if key not in memo:
                memo[key] = math.log10(chance(counts, key[:-1], key[-1]))
            score += memo[key]
        base = sum(math.log10((known[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out.append((id_, held(id_), len(words), sum(known[w] > 0 for w in words), n, base, score))
    return out


def check(got, expected):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-6)


def test_the_model_is_a_distribution():
    counts = trie(["abracadabra", "a bar", "", "dab"])
    for context in ("abra", "cada", "zzab", "zzzz", " bar"):
        assert sum(chance(counts, list(context.encode()), s) for s in range(256) if s != scoring.BEGIN) == pytest.approx(1)


@pytest.mark.parametrize("most", [0, 40, 1 << 18])
def test_odd_rows_against_brute_force(odd, odd_rows, monkeypatch, most):
    monkeypatch.setattr(scoring, "FREQUENT", most)
    assert any(held(r[0]) for r in odd_rows)
    check(scoring.score(odd).collect(), brute(odd_rows))


def test_held_out_texts_teach_nothing(frame):
    rows = [(i, f"word{i} and {'q' * (i % 7)}") for i in range(60)]
    rows += [(i, "Ünique zebra " * 3) for i in range(60, 200) if held(i)]
    check(scoring.score(frame(rows)).collect(), brute(rows))


def test_counts_sent_in_parts_add_up(odd, odd_rows, monkeypatch):
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"text": [r[1] or "" for r in odd_rows], "held_out": [held(r[0]) for r in odd_rows]})
    whole = pa.Table.from_batches(list(scoring._counts([rows])))
    monkeypatch.setattr(scoring, "MOST_KEYS", 50)
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 2000)
    parts = pa.Table.from_batches(list(scoring._counts([rows])))
    assert len(parts) > len(whole)
    sums = parts.group_by(["gram", "word"]).aggregate([("n", "sum"), ("m", "sum")])
    rows_of = lambda t, n, m: sorted(zip(t["gram"].to_pylist(), t["word"].to_pylist(), t[n].to_pylist(), t[m].to_pylist()), key=lambda r: str(r))
    assert rows_of(sums, "n_sum", "m_sum") == rows_of(whole, "n", "m")


def test_nothing_to_learn_from_and_no_rows(frame, none):
    only = [(i, f"text {i}") for i in range(50) if held(i)]
    got = scoring.score(frame(only)).collect()
    check(got, brute(only))
    for r, (_, text) in zip(sorted(got), only):
        assert r["base_score"] == 0 and r["score"] == pytest.approx(-(len(text) + 1) * math.log10(scoring.SYMBOLS))
    assert scoring.score(none).collect() == []


def test_the_trained_model_tells_like_from_unlike(spark):
    from clicktrail.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r["doc_id"]: r for r in scoring.score(docs).collect()}
    sizes = {r["doc_id"]: len(r["text"].encode()) for r in docs.collect()}
    out = [i for i, r in rows.items() if r["held_out"] and sizes[i] > 200]
    bits = sum(-rows[i]["score"] for i in out) / math.log10(2) / sum(sizes[i] for i in out)
    assert 0.5 < bits < 3.2  # 8 without a model


def test_counting_holds_few_keys():
    """A worker that counts random text, nearly all of whose keys are distinct, stays small."""
    code = """
import random, resource
import pyarrow as pa
from clicktrail.llm import scoring
r = random.Random(1)
texts = lambda: pa.array([" ".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1000)).replace(" ", "", 900) for _ in range(500)])
batches = (pa.RecordBatch.from_arrays([texts(), pa.array([False] * 500)], ["text", "held_out"]) for _ in range(10))
sent = [b.num_rows for b in scoring._counts(batches)]
print(max(sent), sum(sent), pa.default_memory_pool().max_memory())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert int(out[1]) > 1_000_000 and int(out[2]) < 220 << 20, out
