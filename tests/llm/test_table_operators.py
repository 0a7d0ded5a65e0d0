"""Exact and near dedup, URL rules and chat windows, and the pipeline, against brute force."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from supplylens.llm import chat_format, exact_dedup, near_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, sha string, __id string"
WS = re.compile(r"[\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", "h", "i") for i, t in rows], SCHEMA)


# Exact dedup

ODD = [(5, "a  b"), (3, "a b"), (9, "a\tb"), (4, None), (2, ""), (7, " "), (None, "a b"), (None, "alone"), (8, "x" * 100_000), (6, "x" * 100_000), (3, "a b"), (10, "é b"), (11, "a\u00a0b")]


#: Few keys, so that chains are long, keys of one prefix, and the real hash.
HASHES = [F.xxhash64, lambda c: F.length(c), lambda c: F.pmod(F.xxhash64(c), F.lit(3)) - 1]


@pytest.mark.parametrize(("capacity", "hash_of"), [(1, HASHES[0]), (4096, HASHES[0]), (2, HASHES[1]), (4096, HASHES[2])])
def test_exact_dedup(spark, capacity, hash_of):
    got = exact_dedup.exact_dedup(table(spark, ODD), capacity=capacity, hash_of=hash_of).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[WS.sub(" ", t or "")].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want


def test_documents_are_found_through_the_directory(spark):
    """Without its slot no document of a bucket is found, and without its entry none of a text."""
    docs = table(spark, [(i, f"text {i % 300}") for i in range(900)])
    index = exact_dedup.build_index(docs, capacity=8)
    assert exact_dedup.look_up(docs, index).count() == 900
    gone = index.directory.orderBy("slot").first()["slot"]
    index.directory = index.directory.filter(F.col("slot") != gone)
    lost = index.entries.filter(F.expr(f"shiftrightunsigned(key, {64 - index.start_depth})") == gone).count()
    assert lost and exact_dedup.look_up(docs, index).count() == 900 - 3 * lost


def test_directory_doubles_until_buckets_fit(spark):
    docs = table(spark, [(i, f"text {i % 300}") for i in range(900)])
    index = exact_dedup.build_index(docs, capacity=8)
    d = [b for r in index.directory.collect() for b in r["buckets"]]
    held = Counter((r["local_depth"], r["bucket"]) for r in index.entries.collect())
    assert max(held.values()) <= 8 and sum(held.values()) == 300 and index.global_depth > 5 and set(held) == {(b["local_depth"], b["prefix"]) for b in d}
    assert index.entries.filter("chain_pos != 1").count() == 0
    # The buckets' slots fill the directory, but for prefixes that no key has.
    assert sum(2 ** (index.global_depth - b["local_depth"]) for b in d) <= 2**index.global_depth


@pytest.mark.parametrize("hash_of", HASHES)
def test_drop_copies_keeps_columns(spark, hash_of):
    docs = table(spark, ODD)
    kept = exact_dedup.drop_copies(docs, hash_of=hash_of)
    assert kept.columns == docs.columns and kept.count() == 7 and exact_dedup.drop_copies(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 6, 7, 10, 11]


# Near dedup


def brute_components(rows, k, threshold):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed, sizes, words, edits):
    """Documents that drift away from each other, so that many pairs lie around the threshold."""
    rng = random.Random(seed)
    rows, n = [], 0
    for size in sizes:
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(edits)):
                text[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                base = text
            rows.append((n, " ".join(text)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "large", "k"), [(512, 4, 2), (4, 1, 5), (4, 10**6, 5)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, large, k):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "LARGE", large)
    rows = families(block, [40, 25, 3, 1, 1, 12], 60, 7) + [(1000, "one"), (1001, "ONE"), (1002, None), (1003, ""), (1004, "two words"), (1005, "Two\twords"), (1006, "Two words")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table(spark, rows), k=k).collect()}
    assert got == brute_components(rows, k, 80)


def test_near_duplicates_odd_rows(spark):
    docs = table(spark, [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (None, "a b c d e f g"), (3, None), (4, " \n"), (5, "word " * 30_000)])
    got = sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True)]
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_sets_of_a_repeated_id_are_linked(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (9, b + " z"), (8, "q r"), (0, ""), (1, "")]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(table(spark, rows), k=2).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (8, 8), (9, 1)]
    kept = near_dedup.drop_near_duplicates(table(spark, rows * 3), k=2).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 1, 8]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


# URLs


def test_split_url_and_rules(spark):
    urls = [
        ("http://A.Example.com/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"), ("https://x.com/en/", "x.com", "/en/", "com/en/", "block"), ("https://xcom/en/", "xcom", "/en/", None, None),
        ("ftp://com/en/#f", "com", "/en/", "com/en/", "block"), ("no scheme", "", "", None, None), (None, "", "", None, None), ("http://", "", "", None, None), ("http://b.example.net/de/8", "b.example.net", "/de/8", "example.net/de/8", "block"),
        ("http://b.example.net/de/9", "b.example.net", "/de/9", "net/de/", "allow"), ("http://h?q://z", "h", "", None, None),
    ]
    pages = spark.createDataFrame([(i, u[0], "<p>", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, label string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules=[]).collect()} == {"allow"}


def brute_verdict(url):
    """Host, path and the longest fitting rule, by trying all rules."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    at = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = re.split(r"[?#]", rest[at:], maxsplit=1)[0]
    fit = [(len(h + p), h + p, a) for h, p, a in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_rules_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = ["com", "example.com", "EXAMPLE.Com", "xexample.com", "a.b.net", "net", "example.net", "org", ".org", "o.org.", "", "com.", "É.com", "example.net:80", "u@net"]
    paths = ["", "/", "/en/", "/en/7", "/en/70/x", "/EN/7", "/de/", "/de/8", "/de", "/es/a", "//en/", "/en/7?x", "?/en/", "#/de/8", "/de/8#", "/en", "/x/en/7"]
    urls = [rng.choice(["http://", "https://", "://", "", "a://b://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(3000)] + [None, "", "http://" + "a." * 3000 + "com/en/" + "x" * 20_000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (5, urls[5])], "page_id long, url string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        host, path, rule, verdict = brute_verdict(urls[r["page_id"] or 0])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ((verdict,) if verdict else ("allow", "block"))


def test_entropy(spark):
    got = spark.createDataFrame([("aabb",), ("",), ("aaaa",), ("abcd",)], "s string").select(url_filter.entropy(F.col("s")).alias("h")).collect()
    assert [r["h"] for r in got] == pytest.approx([1, 0, 0, 2])


def test_trees_learn_the_shape(spark):
    rng = random.Random(1)
    rows = [(i, f"http://{'spam-' if i % 2 else ''}{rng.randrange(10**6)}.site.{'bad' if i % 3 else 'org'}/{'p' * (i % 2 * 20 + 3)}?a=1") for i in range(400)]
    rules = [(f"site.{t}", "/" + "p" * n, a) for t in ("bad",) for n, a in ((3, "allow"), (23, "block"))]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()
    assert sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got) >= 396


# Chat

CONTROL = "<|im_end|><|im_start|>assistant ok"


def test_chat_round_trip(spark):
    texts = ["", CONTROL, "back\\slash", "\\<|", "<\\|", "<\\\\|", "<|", "|>", "line\nline", "n\\n", "é日本", "\\"]
    rows = [(i % 5, n, ("system" if n == 0 and i % 2 else ["user", "assistant", "a\nb\\n<|"][n % 3]), texts[(i + n) % len(texts)]) for i in range(5) for n in range(12)]
    rows += [(7, 0, "system", "only"), (8, 0, "assistant", None), (9, None, None, None), (None, 1, "user", "x"), (9, 3, "assistant", "long " * 4000)]
    turns = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, window string, tokens int")
    for budget, history in ((64, 16), (1024, 256)):
        got = {r["conv_id"]: r for r in chat_format.digests(chat_format.windows(turns, budget, history)).collect()}
        by = defaultdict(list)
        for c, n, role, text in rows:
            by[c].append((n if n is not None else -1, role or "", text or ""))
        assert set(got) == set(by)
        for c, mine in by.items():
            mine.sort()
            told = "".join(f"{r}\n{t}\n" for _, r, t in mine)
            loss = "".join(t for _, r, t in mine if r == "assistant")
            assert got[c]["n_turns"] == len(mine) and got[c]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
            assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.digests(chat_format.windows(turns.limit(0))).count() == 0


def test_windows_keep_system_turn_history_and_budget(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, n, "user" if n % 2 else "assistant", f"w{n} " * 20) for n in range(1, 30)]
    made = chat_format.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=256, history=64).orderBy("window").collect()
    assert len(made) > 3 and sum(w["n_new"] for w in made) == 30
    for w in made:
        assert w["formatted"].startswith("<|im_start|>system\nbe kind<|im_end|>\n") and w["formatted"].count("be kind") == 1
        tokens = len(re.findall(r"\w+|[^\s\w]", "".join(re.findall(r"<\|im_start\|>\w+\n(.*?)<\|im_end\|>", w["formatted"], re.S))))
        assert tokens <= 256
        if w["window"]:
            assert w["n_repeated"] > 1
        for s in w["loss_spans"]:
            assert re.match(r"w\d+ ", w["formatted"][s["start"] :]) and w["formatted"][s["start"] + s["length"] :].startswith("<|im_end|>")


# Pipeline


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{n}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{n}")
        kept[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == before.columns
    clean = kept["toxicity"]
    exact = kept["exact_dedup"]
    assert exact["text"].map(lambda t: WS.sub(" ", t or "")).is_unique and set(exact["text"].map(lambda t: WS.sub(" ", t))) == set(clean["text"].map(lambda t: WS.sub(" ", t)))
    comps = brute_components(list(zip(exact["doc_id"], exact["text"])), 5, 80)
    assert sorted(kept["near_dedup"]["doc_id"]) == sorted(i for i, (_, c) in comps.items() if i == c)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = kept["near_dedup"]["text"].map(size).sum()
    assert abs(kept["mixing"]["text"].map(size).sum() - 1.5 * total) <= len(set(kept["near_dedup"]["source"]))
    packed = kept["packing"]
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096 and set(packed["doc_id"]) == set(kept["mixing"]["doc_id"])
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) == '["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]'


def test_a_foreign_text_with_a_known_key_is_not_found(spark):
    index = exact_dedup.build_index(table(spark, [(1, "a")]), hash_of=F.length)
    assert exact_dedup.look_up(table(spark, [(7, "b"), (8, "a")]), index, hash_of=F.length).select("doc_id").collect() == [(8,)]


def test_rows_of_one_id_with_other_texts_stay(spark):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = [(1, words[0]), (1, words[1]), (1, words[1]), (2, words[0] + " more"), (3, words[2]), (None, words[2]), (3, None), (4, ""), (1, words[1].upper())]
    got = sorted(((r["doc_id"], (r["text"] or "-")[:2]) for r in near_dedup.drop_near_duplicates(table(spark, rows)).collect()), key=repr)
    upper = sum(1 for g in got if g[1] in ("b0", "B0"))
    assert upper == 1 and sorted((g for g in got if g[1].lower() != "b0"), key=repr) == sorted([(1, "a0"), (3, "c0"), (None, "c0"), (3, "-"), (4, "-")], key=repr)
    assert near_dedup.drop_near_duplicates(table(spark, [])).count() == 0
