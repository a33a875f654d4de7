import random
import re
from collections import Counter, defaultdict

import numpy as np

from clicktrail.llm import components as cc
from clicktrail.llm import decontamination, neighbours, secrets, urls
from tests.llm.conftest import words

LOWER = {i: i + 32 for i in range(65, 91)}


def low_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode())


def joined(rows):
    sets, parent = [], {}
    for i, text, *_ in rows:
        w, i = low_words(text), float("inf") if i is None else i
        sets.append((i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    none = lambda x: None if x == float("inf") else x
    return sorted(((none(i), len(s), none(root(i))) for i, s in sets), key=str)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(200)] + [(5, 1000 + i) for i in range(50)] + [(7, 7)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = dict(map(tuple, cc.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: root(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates(odd, odd_rows, none):
    assert sorted(map(tuple, neighbours.near(odd).collect()), key=str) == joined(odd_rows)
    assert neighbours.near(none).collect() == []


def test_near_duplicates_in_large_groups(frame, monkeypatch):
    """Chains of near copies, texts around the threshold, common passages; blocks so small that clusters are split."""
    rng = random.Random(8)
    base, passage = words(rng, 90), words(rng, 60)
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(260, 400):
        rows.append((i, " ".join(words(rng, rng.randint(0, 60)) + passage + [f"n{k}" for k in rng.sample(range(10**6), rng.randint(0, 40))])))
    for i in range(400, 430):
        rows.append((i, rows[i - 400][1]))
    rng.shuffle(rows)
    want = joined(rows)
    assert sorted(map(tuple, neighbours.near(frame(rows)).collect()), key=str) == want
    monkeypatch.setattr(neighbours, "BLOCK_DOCS", 60)
    assert sorted(map(tuple, neighbours.near(frame(rows)).collect()), key=str) == want


def test_null_and_repeated_ids_link_by_text(frame):
    rng = random.Random(12)
    text = [" ".join(words(rng, 60)) for _ in range(9)]
    rows = [(5, text[0]), (9, text[1]), (None, text[0]), (None, text[1] + " more"), (None, text[2]), (None, text[3]), (None, text[3]), (20, text[4]), (20, text[5]), (21, text[5]),
            (30, text[6]), (None, text[7]), (31, text[7]), (31, text[8])]
    want = [(5, 5), (9, 9), (None, 5), (None, 9), (None, None), (None, None), (None, None), (20, 20), (20, 20), (21, 20), (30, 30), (None, 31), (31, 31), (31, 31)]
    got = neighbours.near(frame(rows))
    assert sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=str) == sorted(want, key=str)
    kept = neighbours.different(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(5, text[0]), (9, text[1]), (None, text[2]), (None, text[3]), (20, text[4]), (20, text[5]), (30, text[6]), (31, text[7]), (31, text[8])], key=str)


def test_the_sum_of_partial_counts_decides(spark, frame, monkeypatch):
    """Texts with a few rare n-grams in common, in several fragments: candidates by one of them, but not by the sum."""
    rng = random.Random(31)
    rows, links = [], 0
    for i in range(120):
        w = words(rng, 40)
        rows.append((2 * i, " ".join(w)))
        other = words(rng, 40)
        if i % 3 == 0:  # near copies
            other, links = [*w[:-1], "changed"], links + 1
        else:  # one or two n-grams in common
            other[10:15 + i % 3 - 1] = w[10:15 + i % 3 - 1]
        rows.append((2 * i + 1, " ".join(other)))
    text = frame(rows).select("text")
    one = lambda low: {(r["a"], r["b"]) for r in (monkeypatch.setattr(neighbours, "SHARED", low), neighbours.candidates(text, 240 * 36))[1].collect()}
    few, many = one(3), one(1)
    assert links <= len(few) < len(many) and len(many - few) > 10
    monkeypatch.setattr(neighbours, "SHARED", 3)
    assert sorted(map(tuple, neighbours.near(frame(rows)).collect()), key=str) == joined(rows)


def test_a_hot_ngram_costs_a_row_per_task():
    rng = random.Random(3)
    passage = words(rng, 30)
    texts = [" ".join([*passage, *(f"n{rng.randrange(10**6)}" for _ in range(k % 9))]) for k in range(3000)]
    batch = neighbours.pa.RecordBatch.from_pydict({"text": texts})
    class Sent:
        value = np.zeros(0, np.int64)
    out = neighbours.pa.Table.from_batches(list(neighbours._posting_rows(Sent, 9, 9)([batch])))
    own = out.filter(neighbours.pa.compute.is_valid(out["fragment"]))
    hashes = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in own["hash"]])
    many = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in own["many"]])
    _, counts = np.unique(hashes, return_counts=True)
    assert counts.max() <= neighbours.PAIRED and many.max() > 500
    sent = neighbours.pa.Table.from_batches(list(neighbours._gram_rows(9)([batch])))
    grams = [np.frombuffer(x.as_py(), np.uint32) for x in sent["grams"]]
    assert all(len(np.unique(g)) == len(g) for g in grams) and max(np.frombuffer(x.as_py(), np.uint32).max() for x in sent["counts"]) > 1500


def test_links_of_a_cluster_are_exact():
    rng = np.random.default_rng(3)
    for many in (5, 120):
        base = np.arange(60)
        sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.3, rng.integers(100, 10**6, 60), base)) for _ in range(many)]
        sets += [np.unique(rng.integers(0, 400, rng.integers(5, 80))) for _ in range(many)]
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        hashes = neighbours.mix(np.concatenate(sets).astype(np.uint64) + np.uint64(9))
        x, y = neighbours.linked(of, hashes, np.array([len(s) for s in sets]))
        want = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
        assert want and set(zip(x.tolist(), y.tolist())) == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def leaked(rows, items):
    out = set()
    for i, text, *_ in rows:
        w = low_words(text)
        for k, item in items:
            v = low_words(item)
            most = int(0.2 * len(v))
            known, best = set(v), None
            for p in range(max(1, len(w) - len(v) + 1)):
                x = w[p:p + len(v)]
                if len(x) >= len(v) - most and v and sum(t in known for t in x) >= len(v) - most and (d := edits(v, x)) <= most:
                    best = min(best or (99, 0), (d, p))
            if best:
                out.add((i, k, best[1], best[0]))
    return out


def test_leaks_reach_the_target_recall(spark, frame):
    rng = random.Random(6)
    items = [(k, " ".join(words(rng, rng.randint(12, 50)))) for k in range(25)]
    rows = []
    for i in range(240):
        w = words(rng, rng.randint(0, 80))
        if i % 2:
            v = items[i % 25][1].split()
            for _ in range(rng.randint(0, int(0.2 * len(v)))):
                at = rng.randrange(len(v))
                v[at:at + 1] = rng.choice([[], ["new"], [v[at], "more"]])
            w[len(w) // 2:len(w) // 2] = [x.upper() if rng.random() < 0.2 else x for x in v]
        rows.append((i, " ".join(w)))
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (97, items[3][1])], "item_id long, text string")
    got, want = set(map(tuple, decontamination.leaks(frame(rows), bench).collect())), leaked(rows, [*items, (97, items[3][1])])
    assert {g[:2] for g in got} <= {w[:2] for w in want}
    assert len({g[:2] for g in got}) >= 0.9 * len({w[:2] for w in want})
    exact = {w for w in want if w[3] == 0}
    assert exact and exact <= got
    parts = {tuple(r) for r in decontamination.scan(frame(rows), bench, ["doc_id"], part_bytes=900).selectExpr("row.doc_id", "item_id").collect()}
    assert parts == {g[:2] for g in got}


def edited(rng, item, kind):
    """The item with a fifth of its words replaced, or a tenth removed and a tenth inserted."""
    v = list(item)
    if kind:
        for at in rng.sample(range(len(item)), int(0.2 * len(item))):
            v[at] = "new"
        return v
    for _ in range(int(0.1 * len(item))):
        del v[rng.randrange(len(v))]
    for _ in range(int(0.1 * len(item))):
        v.insert(rng.randrange(len(v)), f"x{rng.randrange(10**6)}")
    return v


def test_keys_alone_find_items_of_every_length():
    """At the full distance; no length is without keys, and whatever is found shares one."""
    rng = random.Random(9)
    for length in (5, 12, 16, 30, 59, 150, 400, 512):
        plan = decontamination.plan(decontamination.planned(length))
        assert plan[0] >= 1 and 1 <= plan[1] <= decontamination.KEYS
        items = [[f"w{rng.randrange(10**6)}" for _ in range(length)] for _ in range(20)]
        texts = [" ".join(["before"] * 3 + edited(rng, item, kind) + ["after"] * 3) for item in items for kind in range(2)]
        hashed = lambda t: decontamination.Words(decontamination.pa.array(t), lower=True)
        own = hashed([" ".join(i) for i in items])
        rows = [own.hash[a:b] for a, b in zip(own.first, own.first[1:])]
        built = decontamination.Items(np.arange(20), rows, {decontamination.planned(length): plan})
        words, n = hashed(texts), len(texts)
        got = {(t, i) for t, i, *_ in built.matches(words.hash, words.first, np.zeros(n, int), np.diff(words.first), np.diff(words.first))}
        want = {(k, k // 2) for k in range(2 * len(items)) if edits(items[k // 2], texts[k].split()[3:3 + length]) <= int(0.2 * length)}
        assert len(want) >= 20 and len(got & want) >= 0.9 * len(want), length


def test_pieces_of_long_texts_lose_no_window(spark, frame, monkeypatch):
    """Items at the ends of pieces, in texts that are cut into many."""
    monkeypatch.setattr(decontamination, "PIECE", 40)
    monkeypatch.setattr(decontamination, "GROUP_BYTES", 4000)
    rng = random.Random(15)
    items = [(k, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(16, 40)))) for k in range(30)]
    texts = []
    for i in range(12):
        order = rng.sample(range(30), 30)
        texts.append((i if i else None, " ".join(items[k][1] for k in order)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontamination.leaks(frame(texts), bench).collect()]
    assert len(got) == len(set(got)) and {g for g in got if g[3] == 0} == {w for w in leaked(texts, items) if w[3] == 0}
    assert len([g for g in got if g[3] == 0]) >= 360


def test_leaks_of_odd_rows(spark, odd, odd_rows, none):
    bench = spark.createDataFrame([(1, odd_rows[2][1]), (2, odd_rows[20][1]), (3, "one two")], "item_id long, text string")
    assert {tuple(r) for r in decontamination.leaks(odd, bench).collect()} >= {(2, 1, 0, 0), (20, 2, 0, 0), (53, 3, 0, 0), (54, 3, 0, 0)}
    clean = decontamination.clean(odd, bench)
    assert clean.columns == odd.columns
    assert clean.count() == len(odd_rows) - len({(r[0], r[1]) for r in odd_rows for x in leaked([r], [(1, odd_rows[2][1]), (2, odd_rows[20][1]), (3, "one two")])})
    assert decontamination.leaks(none, bench).collect() == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(odd, nothing).collect() == [] and decontamination.clean(odd, nothing).count() == len(odd_rows)


def test_urls(spark):
    rows = [(1, "http://A.Example.ORG/es/x?q"), (2, "https://example.org/en/12#f"), (3, "https://x.org/"), (4, "https://badexample.org/es/"), (5, "ftp://a.com/fr/1"),
            (6, "http://a.com/de/1"), (7, "http://a.net"), (8, None), (9, "no scheme"), (10, "http://org?x"), (11, "a://b://c/d"), (3, "https://x.org/"), (None, "http://org/")]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in rows], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted((tuple(r)[:5] for r in urls.judge(pages, labels).collect()), key=str)
    assert got == sorted([
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "x.org", "/", "org/", "allow"),
        (4, "badexample.org", "/es/", "org/", "allow"), (5, "a.com", "/fr/1", "com/fr/", "allow"), (6, "a.com", "/de/1", "com/de/", "block"),
        (7, "a.net", "", None, "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"), (10, "org", "", None, "allow"), (11, "b:", "//c/d", None, "allow"),
        (3, "x.org", "/", "org/", "allow"), (None, "org", "/", "org/", "allow")], key=str)
    assert urls.judge(pages.limit(0), labels).collect() == []


def test_registered_domains(spark):
    hosts = ["a.foo.co.uk", "foo.co.uk", "co.uk", "uk", "a.b.example.com", "example.com", "x.github.io", "", "a.b.c.com.au"]
    domain, suffix = urls.levels(urls.F.col("h"))
    got = [tuple(r) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", domain, suffix).collect()]
    assert got == [("a.foo.co.uk", "foo.co.uk", "co.uk"), ("foo.co.uk", "foo.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("uk", "uk", "uk"),
                   ("a.b.example.com", "example.com", "com"), ("example.com", "example.com", "com"), ("x.github.io", "x.github.io", "github.io"), ("", "", ""),
                   ("a.b.c.com.au", "c.com.au", "com.au")]


def test_reputation_shrinks(spark):
    rng, pages, labels = random.Random(1), [], []
    for i in range(3000):
        host, bad = rng.choice([("bad.spam.net", 0.95), ("x.spam.net", 0.9), ("good.fine.net", 0.05), ("www.fine.net", 0.1)])
        pages.append((i, f"http://{host}/p", ""))
        labels.append((i, int(rng.random() >= bad), 0))
    pages += [(5000, "http://new.spam.net/", ""), (5001, "http://new.fine.net/", ""), (5002, "http://one.fine.net/", ""), (5003, "http://q.other.net/", "")]
    labels.append((5002, 0, 0))
    got = {r["page_id"]: r for r in urls.judge(
        spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    by_host = {r["host"]: r for r in got.values()}
    assert by_host["bad.spam.net"]["verdict"] == "block" and by_host["good.fine.net"]["verdict"] == "allow"
    assert by_host["new.spam.net"]["mean"] > by_host["q.other.net"]["mean"] > by_host["new.fine.net"]["mean"]
    assert by_host["one.fine.net"]["mean"] < 0.9 and by_host["one.fine.net"]["verdict"] == "allow"
    assert all(r["low"] <= r["mean"] <= r["high"] for r in got.values())


def secret_rows():
    rng, rows, truth = random.Random(4), [], defaultdict(set)
    for i in range(400):
        w = words(rng, 40)
        if i % 4 == 0:
            value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            w[20:20] = ["token", "=", f'"{value}"'] if i % 8 else [f"password={value[:18]}a1"]
            truth[i].add(1)
        elif i % 4 == 1:
            w[20:20] = [str(rng.randrange(10**15, 10**16))]
        elif i % 4 == 2:
            w[20:20] = ["".join(words(rng, 9))]
        rows.append((i, " ".join(w)))
    return rows, truth


def test_secrets(frame, odd, none, spark):
    rows, truth = secret_rows()
    got = secrets.scan(frame(rows)).collect()
    assert {r["doc_id"] for r in got if r["secret"]} == set(truth)
    pattern = re.compile(secrets.CANDIDATE)
    want = Counter(i for i, t in rows for v in pattern.findall(t) if re.search("[0-9]", v) or len(v) >= 20)
    short = [(1000 + i, t) for i, t in enumerate(["my password = Tr0ub4dor&3 is it", "api_key=Ab3dE5gH1j, see", 'token: "s!x#ch@rs"', "the key : short", "pass the salt please = thanks"])]
    values = {(r["doc_id"], r["value"]) for r in secrets.candidates(frame(short)).collect()}
    assert values == {(1000, "Tr0ub4dor&3"), (1001, "Ab3dE5gH1j"), (1002, "s!x#ch@rs")}
    assert Counter(r["doc_id"] for r in got) == want
    judged = spark.createDataFrame([(r["value_sha256"], int(r["doc_id"] % 4 == 1)) for r in got], "value_sha256 string, label int")
    turned = secrets.scan(frame(rows), judged).collect()
    assert {r["doc_id"] for r in turned if r["secret"]} == {r["doc_id"] for r in got if r["doc_id"] % 4 == 1}
    assert {r["doc_id"] for r in secrets.scan(odd).collect()} == {61}
    assert secrets.scan(none).collect() == []


def test_frequent_ngrams_tie_nothing_however_many_there_are(frame, monkeypatch):
    """Texts with a few phrases each of a large common stock; an order that knew only the most frequent ones tied nearly all texts."""
    monkeypatch.setattr(neighbours, "HEAVIEST", 8, raising=False)  # what was known of the order before
    rng = random.Random(41)
    stock = [[f"p{k}x{i}" for i in range(5)] for k in range(40)]
    rows = []
    for i in range(160):
        parts = [words(rng, 12) for _ in range(9)]
        rows.append((i, " ".join(w for part in parts for w in [*part, *rng.choice(stock)])))
    rows += [(200 + i, rows[i][1] + " end") for i in range(10)]
    found = neighbours.candidates(frame(rows).select("text"), 170 * 150).collect()
    assert len(found) == 10
    assert sorted(map(tuple, neighbours.near(frame(rows)).collect()), key=str) == joined(rows)


def test_postings_and_texts_that_stay_are_not_written(frame, monkeypatch):
    """Disk is for n-grams on their way and for texts of clusters, not for further copies of them."""
    written, passed, real, one_each = [], [], neighbours.materialize, neighbours._one_each
    monkeypatch.setattr(neighbours, "materialize", lambda df, name="table": written.append(name) or real(df, name))
    monkeypatch.setattr(neighbours, "_one_each", lambda column, wanted=None: passed.append(wanted) or one_each(column, *[wanted] * (wanted is not None)))
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, 50))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)]
    assert sorted(r["doc_id"] for r in neighbours.different(frame(rows)).collect()) == list(range(60))
    assert "gram-postings" not in written
    ids, keys = np.array([r[0] for r in rows]), neighbours.set_keys(*neighbours.grams(neighbours.pa.array([r[1] for r in rows]))[1:])
    members, sure, tried = ([bool(x) for x in wanted(ids, keys)] for wanted in passed)
    assert members == [i < 5 or i >= 100 for i in ids] and sure == [i < 60 for i in ids] and not any(tried)


def test_marks_miss_none(spark):
    rng = np.random.default_rng(2)
    ids, keys = rng.integers(-50, 10**6, 20_000), rng.integers(-2**63, 2**63 - 1, 20_000)
    marks = neighbours.Marks(spark.createDataFrame(list(zip(ids[:1000].tolist(), keys[:1000].tolist())), "id long, key long").repartition(3))
    hit = marks.of(ids, keys)
    assert hit[:1000].all() and hit[1000:].mean() < 0.05
    assert not neighbours.Marks(spark.createDataFrame([], "id long, key long")).of(ids, keys).any()
