"""Every operator against a brute-force version, and on odd rows."""

import base64
import collections
import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.compare import differences
from emberframe.llm import bpe, components, decontamination, exact_dedup, language, secrets, set_join, shared, token_files, tool_calls, toxicity, warc

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " \t\r\n", "!!! ... 123", "a", "x" * 50_000, "Ä é　ü", "same text", "same text", "<|endoftext|>x ΟΔΟΣ İ a\x1cb"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns that clash with names used inside."""
    rows = [(i, t, None if i % 3 else "en", "s", 1, "x", i) for i, t in enumerate(ODD)] + [(7, "same text", "en", "s", 1, "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int, digest string, k long")


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def library(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library():
    coder = bpe.word_bpe(bpe.default_vocabulary())
    random.seed(3)
    texts = [t or "" for t in ODD] + ["".join(random.choice("ab 'SsΣς́\x1f Ⅷ０<|>İẞ\U0001f600\n") for _ in range(40)) for _ in range(300)]
    printed, decoded = coder.printed(pa.array(texts))
    for text, line, back in zip(texts, printed.to_pylist(), decoded.to_pylist()):
        ids, want = library(text)
        assert coder.encode(text) == ids and line == " ".join(map(str, ids)) and back == want
    assert coder.merge("x" * 3000) == library("x" * 3000)[0]


def test_bpe_holds_little_memory():
    """Beyond the vocabulary, with more new words than a task remembers."""
    import tracemalloc

    coder = bpe.WordBpe(bpe.default_vocabulary())
    syllables = [a + b for a in "bcdfghjklmnprstvwz" for b in "aeiouéöñ"]
    word = lambda n: "".join(syllables[n // 144**k % 144] for k in range(3))
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        for start in range(0, 360_000, 60_000):
            printed, _ = coder.printed(pa.array([" ".join(map(word, range(start, start + 60_000)))]))
        peak = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert printed[0].as_py().split()[-3:] == " ".join(map(str, library(word(359_999))[0])).split()[-3:]
    assert peak < 75e6


def test_ids_of_whole_texts(odd):
    rows = bpe.encoded(odd.withColumn("ids", F.lit("clash"))).collect()
    assert len(rows) == odd.count() and all(r["ids"] == library(r["text"])[0] for r in rows)



def test_round_trip_rows(odd):
    rows = by_id(bpe.round_trip(odd).collect())
    for i, text in enumerate(ODD):
        ids, back = library(text)
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_token_files(spark, odd):
    path = shared.scratch_folder(spark, "test-ids")
    token_files.write_ids(odd, path)
    rows = token_files.with_checksum(token_files.read_ids(spark, path)).collect()
    assert len(rows) == odd.count()
    start = 0
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = [*library(ODD[r["doc_id"]])[0], token_files.END_ID]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    found = token_files.documents_by_id(spark, path, [5]).collect()
    assert [r["doc_id"] for r in found] == [5]
    assert token_files.read_ids(spark, path).filter("doc_id = 5").inputFiles()


def test_library_gets_shared_pieces_once(tmp_path):
    texts = ["word Word, word. (WORD)", "x<|y <|endoftext|>word", "", "ΟΔΟΣ it's"]
    encoder = token_files.LibraryEncoder(token_files.default_vocabulary())
    want = [[*library(t)[0], token_files.END_ID] for t in texts]
    assert encoder.encode(pa.array(texts)).to_pylist() == want
    assert sorted(encoder.known.numbers) == sorted(["word", ",", ".", "(", ")", "it", "'s", "οδοσ"])
    # A file that takes words apart in another way gets them whole.
    spec = json.loads(encoder.tokenizer.to_str())
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S+"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    other = token_files.LibraryEncoder(str(path))
    assert other.encode(pa.array(texts)).to_pylist() == [[*other.ids_of(t), token_files.END_ID] for t in texts] != want


def test_exact_dedup_and_a_second_batch(spark, odd):
    index = exact_dedup.DigestIndex.create(spark, buckets=3)
    rows = exact_dedup.exact_dedup(odd, index).collect()
    assert len(rows) == odd.count()
    groups = collections.defaultdict(list)
    for r in odd.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"]))
    for r in rows:
        own = groups[re.sub(r"[\x20\x09-\x0D]", "", ODD[r["doc_id"]] or "")]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own)[1], len(own), min(own)[1] == r["doc_id"])
    later = spark.createDataFrame([(100, "s a m e text"), (101, "new")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(later, index).collect()} == {100: 7, 101: 101}
    assert index.rows().count() == len(groups) + 1
    kept = exact_dedup.without_copies(odd, exact_dedup.DigestIndex.create(spark, buckets=3))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g)[1] for g in groups.values())
    assert kept.columns == odd.columns


def test_a_batch_can_be_run_again(spark, odd):
    """Run twice under one name it keeps the same rows, also in a session that opens the index anew."""
    path = shared.scratch_folder(spark, "test-index")
    index = exact_dedup.DigestIndex.create(spark, path, buckets=3)
    once = exact_dedup.exact_dedup(odd, index, batch="monday").collect()
    held = index.rows().count()
    opened = exact_dedup.DigestIndex.open(spark, path, 3)
    assert sorted(exact_dedup.exact_dedup(odd, opened, batch="monday").collect()) == sorted(once)
    assert sorted(exact_dedup.without_copies(odd, opened, batch="monday").select("k").collect()) == sorted((r["doc_id"],) for r in {r["keep_id"]: r for r in once if r["kept"]}.values())
    assert opened.rows().count() == held
    assert not any(r["kept"] for r in exact_dedup.exact_dedup(odd, opened, batch="tuesday").collect())


def test_exact_dedup_without_an_id(spark):
    docs = spark.createDataFrame([(None, "one"), (4, "o n e"), (None, "two")], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(docs, exact_dedup.DigestIndex.create(spark, buckets=2)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["kept"]) for r in rows), key=str) == sorted([(None, 4, False), (4, 4, True), (None, None, True)], key=str)



def grams(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def linked_by_force(rows, n, percent):
    sets, root = {d: grams(t, n) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies():
    random.seed(5)
    words, rows = [f"w{i}" for i in range(25)], []
    for _ in range(30):
        base = [random.choice(words) for _ in range(random.randint(1, 60))]
        for _ in range(8):
            copy = list(base)
            for _ in range(random.randint(0, 2)):
                copy[random.randrange(len(copy))] = random.choice(words)
            rows.append((len(rows), " ".join(copy)))
    return [*rows, (900, None), (901, " \t"), (902, "A b"), (903, "a B")]


@pytest.mark.parametrize(("block", "small"), [(2000, 40), (3, 0), (2000, 18)])
def test_set_join_loses_no_link(spark, monkeypatch, block, small):
    monkeypatch.setattr(set_join, "BLOCK", block)
    monkeypatch.setattr(set_join, "MOST_SMALL", small)
    rows = near_copies()
    got = set_join.join_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked_by_force(rows, 3, 90)


@pytest.mark.parametrize(("block", "small"), [(2000, 40), (3, 0)])
def test_set_join_at_lower_similarity(spark, monkeypatch, block, small):
    monkeypatch.setattr(set_join, "BLOCK", block)
    monkeypatch.setattr(set_join, "MOST_SMALL", small)
    rows = near_copies()
    got = set_join.join_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n=5, percent=80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked_by_force(rows, 5, 80)


def test_set_join_on_odd_rows(odd):
    rows = set_join.join_sets(odd).collect()
    assert len(rows) == odd.count()
    got = by_id(rows)
    assert got[0]["n_shingles"] == 0 and got[0]["component_id"] == 0 and got[8]["component_id"] == 7


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_decontamination(spark):
    items = [(i, " ".join(f"t{i}x{k}" for k in range(20 + i))) for i in range(5)] + [(90, "two words"), (91, None), (92, "")]
    docs = [(1, "before " + items[0][1] + " after"), (2, " ".join(items[1][1].split()[:10])), (3, items[2][1].upper().replace(" ", " , "))]
    near = items[3][1].split()
    near[2] = "other"
    docs += [(4, " ".join(near)), (5, None), (6, ""), (7, "here are two words."), (3, docs[2][1])]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found}
    # One changed word of 23 changes 3 of 19 shingles; the changed ones weigh as much as the item's.
    assert set(got) - {(4, 3)} == {(1, 0), (3, 2), (7, 90)}
    assert all(got[k] == 1.0 for k in [(1, 0), (3, 2), (7, 90)])
    assert ((4, 3) in got) == (16 / 22 >= decontamination.SIMILARITY)


def edited_items(least, most):
    """Items, and documents that hold one with its end changed, with the similarity that leaves; distinct words, so all shingles weigh 1."""
    items, docs, similar = [], [], {}
    for i in range(500):
        n = 13 + 9 * (i % 6)  # 9, 18, ... shingles
        words = [f"i{i}w{k}" for k in range(n)]
        changed = next(e for e in range(1, n) if (n - 4 - e) / (n - 4 + e) <= most)
        if (n - 4 - changed) / (n - 4 + changed) >= least:
            items.append((i, " ".join(words)))
            docs.append((i, " ".join([f"p{i}a", *words[:-changed], *[f"x{i}w{k}" for k in range(changed)], f"p{i}b"])))
            similar[i, i] = (n - 4 - changed) / (n - 4 + changed)
    return items, docs, similar


def test_radius_is_wide_and_the_index_selects(spark):
    """At similarity 0.8 fingerprints stay well within the radius; unrelated ones agree in far fewer blocks than it asks for."""
    items, docs, similar = edited_items(0.8, 0.801)
    place = lambda rows: spark.createDataFrame(rows, "id long, text string").select("id", decontamination.words("text").alias("t"))
    prints = lambda df, cut: df.select("id", decontamination.shingles(cut, 5).alias("h")).select(
        "id", decontamination.simhash(F.col("h"), F.transform("h", lambda x: F.lit(1.0))).alias("blocks")
    )
    ours = prints(place(docs), F.slice("t", F.lit(2), F.size("t") - 2)).toPandas().set_index("id").blocks
    theirs = prints(place(items), F.col("t")).toPandas().set_index("id").blocks
    bits = [sum(int(x ^ y).bit_count() for x, y in zip(ours[i], theirs[i])) for i in ours.index]
    assert 30 < np.mean(bits) < 48 and max(bits) <= decontamination.RADIUS
    assert decontamination.RADIUS > np.mean(bits) + 5 * np.std(bits)
    agree = [sum(x == y for x, y in zip(ours[i], theirs[j])) for i in range(60) for j in range(60) if i != j]
    assert np.mean(np.array(agree) >= decontamination.BLOCKS - decontamination.RADIUS) < 0.01


def test_decontamination_of_odd_rows(spark):
    """Repeated ids with other texts, missing ids, repeated item ids, clashing names, very long texts, empty tables."""
    item = " ".join(f"t{k}" for k in range(25))
    items = spark.createDataFrame([(1, item), (2, "first of two texts here now"), (2, "second of two texts is other"), (3, "x" * 9)], "item_id long, text string")
    rows = [(1, "a " + item + " b", 1), (1, "clean words", 2), (None, item, 3), (None, "clean", 4), (4, "second of two texts is other", 5), (5, "filler " * 40_000 + item, 6), (6, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").withColumns({c: F.lit("x") for c in ("id", "digest", "item", "start", "n", "hash")})
    found = decontamination.contaminated(docs, items).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in found), key=str) == sorted([(1, 1), (None, 1), (4, 2), (5, 1)], key=str)
    assert next(r["start"] for r in found if r["doc_id"] == 5) == 40_000
    kept = decontamination.without_benchmark(docs, items)
    assert sorted(r["row"] for r in kept.collect()) == [2, 4, 7] and kept.columns == docs.columns
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert decontamination.without_benchmark(docs, items.limit(0)).count() == 7


def test_decontamination_weighs_by_the_benchmark(spark):
    """Shingles that several items hold weigh less: compared with SQL on texts that share them."""
    rng = random.Random(12)
    shared_words = [f"s{k}" for k in range(12)]
    items = [(i, " ".join(shared_words[: rng.randint(5, 12)] + [f"i{i}w{k}" for k in range(rng.randint(2, 9))])) for i in range(12)]
    docs = []
    for d in range(60):
        words = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"d{d}"
        docs.append((d, " ".join([f"p{d}"] * rng.randint(0, 3) + words + ["q"] * rng.randint(0, 3))))
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", items.toArrow())
    assert differences(decontamination.contaminated(docs, items), con, decontamination.OP5_SQL) == []


def test_decontamination_misses_no_edited_item(spark):
    items, docs, similar = edited_items(0.8, 0.801)
    assert len(similar) == 500
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in found} == {k: round(v, 9) for k, v in similar.items()}


def test_secrets_by_force(spark):
    texts = {1: "token: abcdef é secret: token = abcdefg", 2: "AKIA" + "Z" * 16 + " AKIAZ", 3: "f" * 24 + " " + "e" * 23, 4: None, 5: 'API_KEY="A1b2C3d4" 😀 password=aaa', 6: "zZ0" * 8}
    docs = spark.createDataFrame([(i, t, f"s{i % 2}", "en") for i, t in texts.items()], "doc_id long, text string, source string, lang string")
    from pyspark.sql import functions as F

    rows = by_id(secrets.find_secrets(docs, "doc_id", "text", F.col("source"), F.col("lang")).collect())
    for i, text in texts.items():
        spans = []
        for n, (kind, pattern, group, least) in enumerate((*secrets.BASE_KINDS[:2], ("hex", "[0-9a-f]+", 0, 24))):
            spans += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern.replace("(?i:(password|passwd|secret|token|api_?key))", "((?i:password|passwd|secret|token|api_?key))"), text or "") if len(m[group]) >= least]
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert rows[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert rows[6]["spans"] == "owned:0:24" and rows[4]["spans"] == ""


def test_secrets_by_owners_and_repositories(spark):
    """A value of one owner counts up to a few repositories; many repositories make it a copied one."""
    value = lambda c: "Zz9" + c * 21
    rows = [(1, "own", "o", "r1")] + [(10 + i, "few", "o", f"r{i}") for i in range(3)] + [(20 + i, "many", "o", f"r{i}") for i in range(6)]
    rows += [(30, "two", "o", "r1"), (31, "two", "p", "r1")] + [(40 + i, "all", f"o{i}", "r") for i in range(3)]
    text = {k: f"{value(c)} and token={value(c.upper())}" for k, c in zip(("own", "few", "many", "two", "all"), "abcde")}
    docs = spark.createDataFrame([(i, text[k], o, r) for i, k, o, r in rows] + [(50, None, None, None), (50, "", None, "r")], "doc_id long, text string, source string, lang string")
    docs = docs.withColumns({c: F.lit("x") for c in ("row", "id", "base", "owner", "digest")})
    got = secrets.find_secrets(docs, "doc_id", "text", F.col("source"), F.col("lang")).collect()
    assert len(got) == docs.count()
    seen = {r["doc_id"]: ("owned" in r["spans"], r["n_live"], r["n_copied"], r["most_owners"], r["most_repositories"]) for r in got}
    assert seen[1] == (True, 1, 0, 1, 1) and seen[10] == (True, 1, 0, 1, 3) and seen[20] == (False, 0, 1, 1, 6)
    assert seen[30] == (False, 0, 0, 2, 2) and seen[40] == (False, 0, 1, 3, 3) and seen[50] == (False, 0, 0, 0, 0)
    empty = secrets.find_secrets(docs.limit(0), "doc_id", "text", F.col("source"), F.col("lang"))
    assert empty.count() == 0


def test_secrets_equal_sql_where_repositories_decide(spark):
    rows = [(i, f"key {'Zz9' + 'k' * 21} secret = {'Aa1' + 'b' * 9}", "s", f"l{i}") for i in range(7)] + [(9, "Zz9" + "q" * 30, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    assert differences(secrets.find_secrets(docs, "doc_id", "text", F.col("source"), repository), con, secrets.OP7_SQL) == []



def test_warc_chains(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    pages = [(1, "u", "x"), (2, None, "x"), (3, "a b\r\nX: y", None), (4, "u", inner), (5, "u", "a" + inner * 3 + "\r\n\r\n"), (6, "u", "WARC/1.1\r\n"), (7, "u", "é\x00"), (8, "", "")]
    path = shared.scratch_folder(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2), path)
    last = {}
    for p, _, h in pages:
        last[h or ""] = max(last.get(h or "", 0), p)
    got = {int(r["id"]): r for r in warc.read_archives(spark, path).collect()}
    assert set(got) == {p for p, _, _ in pages}
    for p, _, h in pages:
        raw, first = (h or "").encode(), last[h or ""]
        r = got[p]
        assert r["type"] == ("response" if first == p else "revisit")
        assert r["stated"] == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if first == p:
            assert (r["payload_bytes"], r["digest"]) == (len(raw), r["stated"][5:])
        else:
            assert (int(r["refers"]), int(r["http_length"])) == (first, len(raw))


def test_warc_of_odd_rows(spark, tmp_path):
    """Missing and repeated ids, clashing names, a long payload, an empty table; compared with SQL."""
    long = "é" * 300_000 + "WARC/1.1\r\n" + "z" * 50_000
    rows = [(None, "u", "same"), (3, "u", "same"), (2, None, "same"), (None, "u", None), (None, "u", ""), (None, "u", "alone"), (5, "u", "twice"), (5, "u", "twice"), (6, "u", long), (7, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "given")
    pages.withColumns({c: F.lit("x") for c in ("sha", "response", "digest", "payload", "n", "bytes")}).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    assert differences(warc.op3_warc(spark, folder), con, warc.OP3_SQL) == []
    none = str(tmp_path / "none")
    pages.limit(0).write.parquet(f"{none}/pages.parquet")
    assert warc.op3_warc(spark, none).count() == 0



def test_tool_calls(spark):
    schema = "conv long, turn long, kind string, role string, call_id string, after string, name string, arguments string, content string"
    rows = [
        (1, 0, "result", "tool", "a", None, None, None, "early"),
        (1, 1, "call", "assistant", "a", None, "ask", '{"words": 2, "text":"x"}', None),
        (1, 2, "call", "assistant", "b", "a", "ask", '{"words": "2", "z": 1}', None),
        (1, 3, "call", "assistant", "a", None, "none", "{}", None),
        (1, 4, "call", "assistant", "c", "d", "ask", "[1]", None),
        (1, 5, "call", "assistant", "d", "c", "ask", None, None),
        (1, 6, "result", "tool", "zz", None, None, None, None),
        (None, 6, "message", "user", None, None, None, None, "loose"),
    ]
    got = tool_calls.format_messages(spark.createDataFrame(rows, schema), tool_calls.SCHEMAS).collect()
    by = {(r["conv"], r["turn"]): r for r in got}
    assert by[1, 0]["status"] == "answer" and (by[1, 0]["order_turn"], by[1, 0]["depth"]) == (1, 1)
    assert (by[1, 2]["order_turn"], by[1, 2]["depth"], by[1, 2]["errors"]) == (2, 2, "text is missing; words is no integer; z is unknown")
    assert by[1, 3]["status"] == "repeated call" and by[1, 3]["errors"] == "unknown tool"
    assert by[1, 4]["status"] == by[1, 5]["status"] == "cyclic" and by[1, 4]["errors"] == "arguments are no object"
    assert by[1, 6]["status"] == "orphan" and by[None, 6]["status"] == "unplaced"
    assert by[1, 1]["json"] == '{"call":{"arguments":{"text":"x","words":2},"name":"ask"},"call_id":"a","role":"assistant"}'


def test_tool_calls_of_odd_rows(spark, tmp_path):
    """Differing and repeated messages of one turn, clashing names, an empty table; compared with SQL."""
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 1, "assistant", None), (1, 2, "user", "word " * 70), (1, 3, "assistant", "")]
    rows += [(1, 3, "system", "s"), (2, 0, "assistant", "early"), (2, 2, "user", None), (2, 4, "user", "z"), (2, 4, "assistant", "both"), (3, 1, None, None), (3, 1, None, "")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    folder = str(tmp_path / "given")
    table.withColumns({c: F.lit("x") for c in ("conv", "place", "key", "kind", "copies", "json")}).write.parquet(f"{folder}/conversations.parquet")
    done = tool_calls.op4_tool_calls(spark, folder)
    con = duckdb.connect()
    con.register("conversations", table.toArrow())
    assert [d for d in differences(done, con, tool_calls.OP4_SQL) if not d.startswith("note")] == []
    calls = [r for r in done.collect() if (r["conv_id"], r["turn"], r["kind"]) == (1, 0, "call")]
    assert sorted((r["status"], r["copies"]) for r in calls) in ([("answered", 1), ("repeated call", 2)], [("answered", 2), ("repeated call", 1)])
    none = str(tmp_path / "none")
    table.limit(0).write.parquet(f"{none}/conversations.parquet")
    assert tool_calls.op4_tool_calls(spark, none).count() == 0


def test_drawn_pieces_come_from_the_whole_text(spark):
    texts = [(1, "short"), (2, "".join(f"<{k:04}>" for k in range(1000))), (3, ""), (4, "x" * 60), (5, "é" * 61)]
    rows = spark.createDataFrame(texts, "i long, t string").select("i", shared.drawn(F.col("t"), F.col("i"), 10, 6).alias("t")).collect()
    got = dict((r["i"], r["t"]) for r in rows)
    assert got[1] == "short" and got[3] == "" and got[4] == "x" * 60 and len(got[5]) in (69, 55 + 9)
    pieces = got[2].split(" ")
    assert len(pieces) == 10 and pieces == sorted(set(pieces)) and all(len(p) == 6 for p in pieces) and pieces[-1] > "<0500>"


def test_language_is_kernel_ridge_regression(spark):
    """With every learning text a landmark, scores equal those of plain kernel ridge regression on sets of n-grams."""
    rng = random.Random(8)
    rows = [(" ".join("".join(rng.choices(x, k=rng.randint(1, 5))) for _ in range(12)), x) for x in ("abcdef", "defghi", "ghiäöü") for _ in range(15)]
    fresh = [" ".join("".join(rng.choices("abcdefghiä", k=4)) for _ in range(9)) for _ in range(6)]
    texts, names = [t for t, _ in rows], sorted({n for _, n in rows})
    model = language.fit(texts, [n for _, n in rows], landmarks=99)

    def plain(text):
        marked = f" {text.lower()} "
        return {marked[i : i + n] for n in (1, 2, 3) for i in range(len(marked) - n + 1)} - {" "}

    # Of the single letters the gap counts as one too, wherever the text has any.
    sets = {t: plain(t) | {" "} for t in [*texts, *fresh]}
    known = set().union(*[sets[t] for t in texts])
    size = lambda t: len(sets[t] & known) ** 0.5
    kernel = lambda xs: np.array([[len(sets[x] & sets[y]) / (size(x) * size(y)) for y in texts] for x in xs])
    k, n = kernel(texts), len(texts)
    assert np.abs(model.kernel(fresh, model.columns())[:, [i for i in range(n)]] - kernel(fresh)).max() < 1e-5
    target = np.array([[1.0 if x == y else -1.0 for y in names] for _, x in rows])
    middle = np.eye(n) - np.ones((n, n)) / n
    solved = np.linalg.solve(middle @ k @ middle + language.RIDGE * n * np.eye(n), target - target.mean(0))
    wanted = (kernel(fresh) - k.mean(0)) @ middle @ solved + target.mean(0)
    assert np.abs(model.score(fresh, model.columns()) - wanted).max() < 2e-3


def test_language_learns_from_late_passages_and_keeps_clashing_columns(spark):
    """The telling letters stand behind a long common beginning; columns named like the added ones stay."""
    common = "abc " * 1500
    docs = spark.createDataFrame([(i, common + ("xyz " if i % 2 else "uvw ") * 400, "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    model = language.train(docs)
    docs = docs.withColumns({"score": F.lit(7.0), "Lang_Pred": F.lit("mine"), "claimed": F.lit("yes")})
    rows = language.predict(docs, model).collect()
    assert all(r["lang_pred_"] == r["lang"] and r["score"] == 7.0 and r["Lang_Pred"] == "mine" and 0.5 < r["score_"] <= 1 for r in rows)
    kept = language.claimed_rows(docs, model)
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())



def test_language(spark, odd):
    docs = shared.documents(spark, "/root/testdata/sf0.01")
    model = language.train(docs)
    from pyspark.sql import functions as F

    rows = language.predict(docs.filter(shared.held_out(F.col("doc_id"))), model).select("lang", "lang_pred").collect()
    assert np.mean([r[0] == r[1] for r in rows]) > 0.97
    predicted = language.predict(odd, model).collect()
    assert {r["lang_pred"] for r in predicted if r["doc_id"] in (0, 1, 2, 3)} == {"und"} and len(predicted) == odd.count()
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}
    text = "Ab c! " * 50
    whole = np.unique(np.concatenate(list(language.gram_codes(text, language.letter_classes("abc")))))
    pieces = np.unique(np.concatenate(list(language.gram_codes(text, language.letter_classes("abc"), piece=7))))
    assert (whole == pieces).all()


UNCLAIMED = {
    -1: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    -2: "xqzvk jwpfg qxkzj vbxqw zzkqj hjxvw qkpzx wvxjq " * 3,
    -3: "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
}


def test_language_stage_leaves_out_what_no_language_claims(spark):
    import corpus_pipeline

    docs = shared.documents(spark, "/root/testdata/sf0.01")
    alien = spark.createDataFrame([(d, t, None, "s", len(t)) for d, t in UNCLAIMED.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.in_a_language(spark, docs.unionByName(alien.select(*docs.columns)), FOLDER).select("doc_id").collect()
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in docs.filter(r"text rlike '\\p{L}'").select("doc_id").collect()}


@pytest.mark.parametrize("languages", [1, 3, 8])
def test_claims_do_not_depend_on_the_number_of_languages(languages):
    rng = random.Random(3)
    letters = ["abcdefg", "hijklmn", "opqrstu", "vwxyzäö", "абвгдеж", "зийклмн", "αβγδεζη", "θικλμνξ"][:languages]
    words = [["".join(rng.choices(x, k=rng.randint(2, 6))) for _ in range(40)] for x in letters]
    rows = [(" ".join(rng.choices(w, k=60)), f"l{k}") for k, w in enumerate(words) for _ in range(60)]
    model = language.fit([t for t, _ in rows], [x for _, x in rows])
    fresh = [" ".join(rng.choices(w, k=60)) for w in words]
    columns = model.columns()
    own = model.score(fresh, columns).argmax(1)
    assert all(model.claims(t, k, columns) for t, k in zip(fresh, own))
    assert not any(model.claims("ჰელო სამყარო " * 20, k, columns) for k in range(languages))


def test_toxicity_network():
    random.seed(2)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts, labels = [], []
    for i in range(300):
        text = [random.choice(words) for _ in range(random.randint(5, 150))]
        if i % 3 == 0:
            for _ in range(2):
                text[random.randrange(len(text))] = random.choice(["idiotic", "idiotism", "moron"])
        texts.append(" ".join(text))
        labels.append(int(i % 3 == 0))
    net = toxicity.train_network(toxicity.sample_of(texts[:200], labels[:200]))
    scores = toxicity.Scorer(net).score(pa.array([*texts[200:], "", "x" * 9000]))
    right = (scores[:100] >= toxicity.THRESHOLD) == (np.array(labels[200:]) == 1)
    assert right.mean() > 0.9 and scores.min() >= 0 and scores.max() <= 1 and scores[100] == 0
    rows = np.random.default_rng(0).integers(0, 3, (50, toxicity.WINDOW))
    present = np.random.default_rng(1).random(rows.shape) < 0.9
    table = net.gates(net.inputs(["moron", "abc", ""])[0])
    full, kept = net.forward(table[rows], present.astype(np.float32))
    assert np.abs(full - toxicity.score_windows(net, table, rows, present)).max() < 1e-4
    grad, _ = net.backward(table[rows], present.astype(np.float32), kept, np.ones(50, np.float32))
    for name in ("loop0", "loop1", "look", "ask", "out"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        sums = []
        for move in (1e-2, -1e-2):
            net.p[name][at] += move
            sums.append(net.forward(table[rows], present.astype(np.float32))[0].sum(dtype=float))
            net.p[name][at] -= move
        assert abs((sums[0] - sums[1]) / 2e-2 - grad[name][at]) < 0.05 * abs(grad[name][at]) + 1e-2


def test_toxicity_by_whole_texts(spark, odd):
    """A passage at the end of long texts is learned and found; texts without words score 0; repeated rows score equally."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = []
    for i in range(240):
        text = rng.choices(words, k=rng.randint(900, 1100))  # over 5,000 characters
        if i % 3 == 0:
            text[-8:-4] = ["idiotic", "moron", "moronic", "idiot"]
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, net).collect()}
    held = {r["doc_id"] for r in docs.filter(shared.held_out(F.col("doc_id"))).collect()}
    right = [(scored[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows if i in held]
    assert len(right) > 30 and np.mean(right) > 0.9
    strange = toxicity.score_documents(odd, net).collect()
    assert len(strange) == odd.count() and all(0 <= r["score"] <= 1 for r in strange)
    assert {r["score"] for r in strange if r["doc_id"] in (0, 1, 2)} == {0.0}
    same = [r["score"] for r in strange if r["doc_id"] in (7, 8)]
    assert len(same) == 3 and max(same) - min(same) < 1e-6


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_empty_texts_are_not_toxic(spark, size):
    folder = f"/root/testdata/{size}"
    net = toxicity.train(shared.documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    assert toxicity.Scorer(net).score(pa.array(["", " ... ", "\t"])).tolist() == [0.0, 0.0, 0.0]


def test_toxicity_tokens_and_windows_by_force(monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 2)
    several = ["one", "", "three", "x" * 40, "é"]
    assert all((a == b).all() for a, b in zip(toxicity.hashed(several), toxicity.hashed_in_blocks(several)))
    texts = ["Ab-c 1d", "", "É_x!", "one"]
    assert toxicity.tokens(pa.array(texts)).to_pylist() == [re.findall(r"[^\W_]+", t.lower()) or [""] for t in texts]
    for n in range(1, 200):
        starts = toxicity.windows(n)
        assert {i for a in starts for i in range(a, min(n, a + toxicity.WINDOW))} == set(range(n))
        assert all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:])) and starts[-1] < n
    together, alone = toxicity.hashed(["moron", "a", ""]), [toxicity.hashed([w]) for w in ("moron", "a", "")]
    ends = np.append(together[2], len(together[1]))
    for k, (word, found, _) in enumerate(alone):
        assert together[0][k] == word[0] and sorted(together[1][ends[k] : ends[k + 1]]) == sorted(found)



def test_toxicity_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(odd, labels) is None
    assert {r["score"] for r in toxicity.score_documents(odd, None).collect()} == {0.0}


def test_pipeline(spark):
    import corpus_pipeline

    docs = shared.documents(spark, FOLDER)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = shared.stored(stage(spark, docs, FOLDER), "test-stage")
        assert kept.columns == docs.columns
        assert kept.count() <= docs.count()
        docs = kept
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    tokens = by_id(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect())
    assert set(tokens) == set(texts) and all(tokens[d]["n_tokens"] == len(library(t)[0]) for d, t in texts.items())
    assert len(set(linked_by_force(list(texts.items()), 3, 90).values())) == len(texts)


def test_near_copies_leave_the_pipeline(spark):
    import corpus_pipeline

    rows = near_copies()
    kept = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()
    by_force = linked_by_force(rows, 5, 80)
    assert {r["doc_id"] for r in kept} == {d for d, (size, root) in by_force.items() if not size or root == d}
    assert len(set(linked_by_force(rows, 3, 90).values())) > len(kept)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_an_empty_table(spark, stage):
    import corpus_pipeline

    docs = shared.documents(spark, FOLDER).limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, FOLDER).count() == 0
