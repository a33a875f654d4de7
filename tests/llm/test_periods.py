"""op12 against a search of all lags and places."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from clicktrail.llm import periods
from clicktrail.llm.common import WORD

WORDS = re.compile(WORD)


def all_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s = w[i:j + q]
            if j > i and len(s) >= max(24, 3 * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                out.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(id_, text, loop=True):
    w = WORDS.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(id_).encode()) if id_ is not None else 1
    if loop and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    dropped = {x for s, length, q in runs for x in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed, left = "".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(x for i, x in enumerate(w) if i not in dropped)
    if not runs:
        return (id_, 0, None, None, None, None, sha(listed), sha(left))
    s, length, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return (id_, len(runs), s, length, q, 1000 * length // q, sha(listed), sha(left))


def loops(rng, letters="abcde"):
    """Words that repeat in blocks, inside each other and side by side, some a word or two short of a run."""
    out = []
    for _ in range(rng.randint(1, 5)):
        q = rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 20, 31, 33])
        u = [rng.choice(letters[:rng.choice([1, 2, 3, 5])]) for _ in range(q)]
        if rng.random() < 0.3:
            u = u + u + [rng.choice(letters)]
        out += (u * 8)[:int(len(u) * rng.choice([1, 2, 2.9, 3, 3.1, 4, 6]))]
    return out


def coded(texts):
    names = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    return np.array([names[w] for t in texts for w in t], np.int32), np.cumsum([0, *map(len, texts)])


def test_runs_of_looping_texts():
    rng, total = random.Random(5), 0
    for _ in range(300):
        texts = [loops(rng), [rng.choice("ab") for _ in range(rng.randint(0, 60))], loops(rng)]
        got = periods.periodic_runs(*coded(texts))
        for i, t in enumerate(texts):
            assert got.get(i, []) == all_runs(t)
            total += len(got.get(i, []))
    assert total > 500


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.integers(1, 12)), min_size=1, max_size=5))
def test_runs_of_any_texts(blocks):
    text = [w for u, n in blocks for w in u * n]
    assert periods.periodic_runs(*coded([text])).get(0, []) == all_runs(text)


def test_long_periods_hold_shorter_runs():
    rng = random.Random(8)
    inner = [str(rng.randrange(10 ** 6)) for _ in range(40)]
    text = (inner * 3 + [str(rng.randrange(10 ** 6)) for _ in range(100)]) * 3
    got = periods.periodic_runs(*coded([text]))[0]
    assert got == all_runs(text) and {q for *_, q in got} == {40, 220}


def test_a_word_a_hundred_thousand_times_has_one_run():
    codes = np.zeros(100_000, np.int32)
    assert periods.periodic_runs(codes, np.array([0, len(codes)])) == {0: [(0, 100_000, 1)]}
    assert sum(len(p) for _, _, p, _ in periods.seeds(codes, np.array([0, len(codes)]))) <= len(codes)


def test_odd_rows_against_brute_force(odd, odd_rows, none):
    rng = random.Random(2)
    rows = [r for r in odd_rows if r[0] not in (60, 61)]
    more = odd.sparkSession.createDataFrame([(100 + i, " ".join(loops(rng))) for i in range(150)] + [(None, "da " * 30), (None, "da " * 30)], "doc_id long, text string")
    for docs, own in ((odd.where("doc_id IS NULL OR doc_id NOT IN (60, 61)"), rows), (more, [tuple(r) for r in more.collect()])):
        key = lambda r: (r[0] is not None, r[0] or 0, r[1:2], r[-1])
        for loop in (True, False):
            got = periods.detect(docs, periods.looped if loop else None).collect()
            assert sorted(map(tuple, got), key=key) == sorted((brute(r[0], r[1], loop) for r in own), key=key)
    spans = sorted(tuple(r) for r in periods.spans(more.where("doc_id IS NOT NULL")).collect())
    assert spans == sorted((r[0], *x) for r in more.where("doc_id IS NOT NULL").collect() for x in all_runs(r[1].split()))
    assert periods.detect(none).collect() == [] and periods.detect(odd, periods.looped).count() == odd.count()
