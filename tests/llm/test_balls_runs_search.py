"""SimHash balls, word runs and ranked search against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from checks.compare import connect, differences
from emberframe.llm import ranked_search, registry, simhash_balls, word_runs

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " \t\r\n", "!!! ... 123", "a", "x" * 50_000, "Ä é　ü", "same text", "same text", "Same  TEXT", "a b " * 3000, "ΟΔΟΣ İ a\x1cb \x00"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, a missing id, and columns that clash with names used inside."""
    rows = [(i, t, None if i % 3 else "en", "s", 1, i, "x", 5) for i, t in enumerate(ODD)]
    rows += [(7, "same text", "en", "s", 1, 7, "x", 5), (None, "same text now", "en", "s", 1, 8, "x", 5), (7, "other text", None, None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, id int, fp long, term string, block long"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def lowered_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def fingerprint(text, n=3):
    words = lowered_words(text)
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def joined_by_force(fps, radius=3):
    """Each fingerprint's least linked one."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(root)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {f: find(f) for f in names}


def expected_components(rows):
    fps = [fingerprint(t) for _, t in rows]
    roots = joined_by_force(fps)
    least = collections.defaultdict(list)
    for (d, _), f in zip(rows, fps):
        least[roots[f]] += [d] if d is not None else []
    return [(d, f"{f:016x}", min(least[roots[f]], default=None)) for (d, _), f in zip(rows, fps)]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_spark_hashes_shingles_alike(spark):
    (h,) = spark.sql("SELECT xxhash64('ä b c')").first()
    assert h % 2**64 == xxhash.xxh64_intdigest("ä b c".encode(), 42)


@pytest.mark.parametrize("counted", [100_000, 7])
def test_fingerprints_equal_brute_force(monkeypatch, counted):
    monkeypatch.setattr(simhash_balls, "COUNTED", counted)
    random.seed(2)
    texts = [t or "" for t in ODD] + [" ".join(random.choice(["a", "Bé", "c", "dd"]) for _ in range(k)) for k in range(40)]
    assert simhash_balls.fingerprints(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]


def near_fingerprints(seed):
    rng = random.Random(seed)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(6):
            out = base
            for b in rng.sample(range(64), rng.randint(0, 7)):
                out ^= 1 << b
            fps.add(out)
    dense = rng.getrandbits(64)
    fps |= {dense ^ (1 << a | 1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}
    fps |= {0, (1 << 64) - 1, 1 << 63, 7, 1 << 63 | 1 << 31 | 1 << 32}
    return fps


@pytest.mark.parametrize(("per_deal", "most"), [(2000, 4_000_000), (8, 4_000_000), (8, 3000), (100, 1500)])
def test_balls_lose_no_link(spark, monkeypatch, per_deal, most):
    """Few and many low bits, batches cut between deals, and deals divided again up to whole variants."""
    monkeypatch.setattr(simhash_balls, "PER_DEAL", per_deal)
    monkeypatch.setattr(simhash_balls, "MOST_VARIANTS", most)
    fps = near_fingerprints(per_deal + most)
    classes = spark.createDataFrame([(simhash_balls.signed(f),) for f in fps], "fp long")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash_balls.linked(classes).collect()]
    assert all((a ^ b).bit_count() <= 3 * len(fps) for a, b in links)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert {f: find(f) for f in fps} == joined_by_force(fps)


def test_every_pair_within_the_radius_meets():
    """Each way in which up to three bits differ has a common variant that one side reaches by one flip at most."""
    rng = random.Random(4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << bit
        reach = [{x ^ m: m.bit_count() for m in simhash_balls.flips(x.bit_count() % 2 == 0)} for x in (a, b)]
        assert any(min(reach[0][v], reach[1][v]) <= 1 for v in reach[0].keys() & reach[1].keys())


def test_simhash_rows(spark, odd):
    random.seed(8)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = [random.choice(words) for _ in range(random.randint(30, 200))]
        texts += [" ".join(base)] + [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in (3, 17)]
    rows = list(enumerate(texts))
    got = simhash_balls.simhash_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert in_order(map(tuple, got)) == in_order(expected_components(rows))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = simhash_balls.simhash_join(odd).collect()
    assert in_order(map(tuple, got)) == in_order(expected_components(rows))


def test_simhash_of_texts_without_id_and_of_none(spark, empty):
    only = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert [(r["doc_id"], r["component_id"]) for r in simhash_balls.simhash_join(only).collect()] == [(None, None)]
    assert simhash_balls.simhash_join(empty).collect() == []


# --- word runs ----------------------------------------------------------------


def runs_by_force(words):
    out, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in out.items())


def digests(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_by_force(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    collapsed = " ".join(w for i, w in enumerate(words) if i not in dropped)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed)))


def repeated_words(rng):
    words = []
    for _ in range(rng.randint(0, 8)):
        kinds = rng.choice([1, 2, 3, 50])
        block = [rng.randrange(kinds) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30]))]
        some = block * rng.randint(1, 12)
        some = some[: rng.randint(0, len(some))]
        if some and rng.random() < 0.3:
            some[rng.randrange(len(some))] = 99
        words += some
    return words * (rng.randint(1, 4) if rng.random() < 0.3 else 1)


@pytest.mark.parametrize("compared", [4_000_000, 5])
def test_runs_equal_brute_force(monkeypatch, compared):
    monkeypatch.setattr(word_runs, "COMPARED", compared)
    rng = random.Random(1)
    found = 0
    for _ in range(120):
        docs = [repeated_words(rng) for _ in range(rng.randint(1, 6))]
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        got = word_runs.runs_of(np.array([x for d in docs for x in d], np.int64), first)
        want = [(i, *r) for i, d in enumerate(docs) for r in runs_by_force(d)]
        assert list(zip(*[c.tolist() for c in got])) == want
        found += len(want)
    assert found > 500


def test_grammar_spells_the_texts():
    """Every place of a nonterminal holds the same words, and the remaining symbols cover their texts."""
    rng = random.Random(6)
    docs = [d for d in (repeated_words(rng) for _ in range(30)) if d]
    codes, text = np.unique(np.concatenate([np.array(d) + 1000 * i for i, d in enumerate(docs)]), return_inverse=True)[1], np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    rules, places, left = word_runs.grammar(codes, text)
    assert len(places) == rules.shape[1] > 20 and len(set(text[left])) > 5
    for (a, m, b), where in zip(rules.T, places):
        assert a < m < b and len(where) >= word_runs.LEAST_PAIRS
        for p in where:
            assert codes[p : p + b - a].tolist() == codes[a:b].tolist() and text[p] == text[p + b - a - 1]


def test_word_runs_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = word_runs.op12_word_runs(spark, FOLDER).collect()
    want = [digests(r["doc_id"], r["text"]) for r in rows]
    assert in_order(map(tuple, got)) == in_order(want)
    assert sum(w[1] > 0 for w in want) > 10


def test_word_runs_on_odd_rows(spark, odd, empty, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = word_runs.op12_word_runs(spark, str(tmp_path)).collect()
    assert in_order(map(tuple, got)) == in_order(digests(r["doc_id"], r["text"]) for r in odd.collect())
    assert word_runs.find_runs(empty).collect() == []
    (row,) = word_runs.find_runs(odd.filter("doc_id = 10")).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, 6000, 2)] and row["collapsed"] == "a b"


# --- ranked search --------------------------------------------------------------


def ranked_by_force(docs, items, most=10):
    terms = lambda t: re.findall(ranked_search.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(d, collections.Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if d is not None and s > 0:
                scores.append((-s, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:most])]
    return out


ITEMS = [(1, "same TEXT same"), (2, "a b, c"), (3, None), (4, " !? "), (5, "ΟΔΟΣ 123"), (5, "now other"), (None, "text"), (6, "nowhere"), (7, "x" * 50_000)]


@pytest.mark.parametrize(("owners", "bundle", "block"), [(4, 256, 8_000_000), (1, 2, 10), (3, 1, 8_000_000)])
def test_search_equals_brute_force(spark, odd, monkeypatch, owners, bundle, block):
    monkeypatch.setattr(ranked_search, "OWNERS", owners)
    monkeypatch.setattr(ranked_search, "BUNDLE", bundle)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = ranked_search.ranked(odd.repartition(3), items, most=3).collect()
    assert in_order(map(tuple, got)) == in_order(ranked_by_force(docs, ITEMS, 3))


def test_search_without_documents_or_items(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.ranked(empty, items).collect() == []
    assert ranked_search.ranked(odd, items.limit(0)).collect() == []


def test_search_query_equals_sql(spark):
    assert differences(registry.QUERIES["op13_ranked_search"](spark, FOLDER), connect(FOLDER), ranked_search.OP13_SQL) == []
