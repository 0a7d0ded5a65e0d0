"""Packing, mixing, language, toxicity, media and personal data, each on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from supplylens.llm import flac, language_id, mixing, packing, pii, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, size string, __id string"
#: Null ids, texts and sources, repeated rows, empty and long texts; columns whose names an operator might use itself.
ODD = [
    (1, "hello world", "en", "a", 11, "x", "y", "z"),
    (1, "hello world", "en", "a", 11, "x", "y", "z"),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", "y", "z"),
    (None, "no id here", "de", "b", 10, "x", "y", "z"),
    (4, "word " * 9000, "en", "b", 45000, "x", "y", "z"),
    (5, "ünïcödé 日本語 \x00 <|endoftext|>", "fr", "c", 5, "x", "y", "z"),
    (6, " \t\r\n ", "en", "c", 5, "x", "y", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Packing


def test_word_encoder_matches_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain, ours = Tokenizer.from_file(path), packing.WordEncoder(path)
    monkeypatch.setattr(packing, "KNOWN_WORDS", 3000)
    parts = "a B the _ İ . , ,\n 's ' 'll 1 é É ß ŉ ǅ ǰ ſ Σ ς \u0301 \u0307 日本 ᄀ 가 <| |> <|endoftext|> <|EndOfText|> - \x1c ! ?) 😀 ª ² Ⅷ \x00 _, _. ŀ snake_case_, O'Neill's".split(" ") + [" ", "\n", "\u00a0", "\u2003", "\u0085", "\r\n", "\x0b", ". ", ", "]
    rng = random.Random(1)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(20_000)]
    for lo in range(0, len(texts), 2000):
        some = texts[lo : lo + 2000]
        for t, got, want in zip(some, ours.encode_all(some), plain.encode_batch_fast(some, add_special_tokens=False)):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, t


@pytest.mark.parametrize("seed", range(4))
def test_pack_sizes_fills_bins(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 101, 400)
    bin_of, offset, fill = packing.pack_sizes(sizes, 100)
    for b in np.unique(bin_of):
        own = np.flatnonzero(bin_of == b)
        own = own[np.argsort(offset[own])]
        assert (offset[own] == np.cumsum(sizes[own]) - sizes[own]).all() and sizes[own].sum() == fill[own[0]] <= 100
    # No packing needs fewer bins than the total or the sizes over one half ask for.
    assert len(np.unique(bin_of)) <= max(-(-sizes.sum() // 100), (sizes > 50).sum()) + 8


def test_local_search_empties_a_bin():
    bins = packing.Bins(np.array([6, 6, 5, 3]), 10)
    bins.items, bins.fill = [[0], [1, 3], [2]], [6, 9, 5]
    before = sum(f * f for f in bins.fill)
    bins.improve()
    assert sum(map(bool, bins.items)) == 3 or sum(f * f for f in bins.fill) > before
    swap = packing.Bins(np.array([5, 4, 6, 5]), 10)
    swap.items, swap.fill = [[0, 1], [2], [3]], [9, 6, 5]
    swap.improve()
    assert sorted(len(x) for x in swap.items) == [0, 2, 2]


def test_pack_places_every_token(spark, odd):
    rows = packing.pack(odd, capacity=64, group_tokens=2000).toPandas()
    assert (rows.groupby("sequence_id")["length"].sum() <= 64).all()
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted((d or -1, len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, *_ in ODD)
    got = rows.assign(doc_id=rows["doc_id"].fillna(-1)).groupby("doc_id")["length"].sum()
    assert got[4] == dict(want)[4] and got[1] == 2 * dict(want)[1] and got[2] == 1 and got.sum() == sum(n for _, n in want)
    ids = plain.encode("hello world", add_special_tokens=False).ids + [1]
    assert rows[rows["doc_id"] == 1]["ids_crc32"].tolist() == [zlib.crc32(np.array(ids, "<u4").tobytes())] * 2
    assert packing.pack(odd.limit(0)).count() == 0
    with_ids = packing.pack(odd, capacity=64, with_ids=True).filter("doc_id = 4").orderBy("piece").collect()
    assert b"".join(r["ids"] for r in with_ids) == np.array(plain.encode(ODD[5][1], add_special_tokens=False).ids + [1], "<u4").tobytes()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in with_ids)


def test_copies_of_one_row_are_packed_in_many_groups(spark):
    rows = packing.pack(spark.range(0, 6000, 1, 5).selectExpr("cast(null as long) doc_id", "'same words' text"), capacity=64, group_tokens=2000, release_below=2).toPandas()
    assert len(rows) == 6000 and rows["doc_id"].isna().all() and (rows.groupby("sequence_id")["length"].sum() <= 64).all()
    groups = (rows["sequence_id"] % (1 << 56)) // (1 << 32)
    share = rows.groupby(groups)["length"].sum() / rows["length"].sum()
    assert len(share) == -(-rows["length"].sum() // 2000) and share.max() < 2 * share.mean()
    # Each group may leave one bin unfilled; whole bins hold as many copies as fit.
    fit = 64 // rows["length"].iloc[0]
    assert rows["sequence_id"].nunique() <= -(-6000 // fit) + len(share)


def test_pack_uses_as_few_sequences_as_tokens_allow(docs):
    rows = packing.pack(docs).toPandas()
    assert rows["sequence_id"].nunique() == -(-rows["length"].sum() // 4096)


# Mixing


@pytest.mark.parametrize(
    ("sizes", "weights", "total", "want"),
    [([100, 100], [1, 1], 100, [50, 50]), ([10, 100], [1, 1], 100, [20, 80]), ([10, 10], [5, 1], 100, [20, 20]), ([10, 20, 100], [5, 2, 1], 150, [20, 40, 90]), ([0, 10], [1, 1], 5, [0, 5]), ([], [], 0, [])],
)
def test_water_fill(spark, sizes, weights, total, want):
    assert mixing.water_fill(sizes, weights, total, 2.0) == pytest.approx(want)


def test_source_targets_agree_with_water_fill(spark):
    rng = random.Random(5)
    sizes = [rng.choice([0, 3, 50, 4000]) for _ in range(23)]
    rows = [(None if i == 22 else f"s{i:02d}", s, 1) for i, s in enumerate(sizes)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long, n_docs long"), (5, 2, 1), 1.5, 2.0).collect()
    want = mixing.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(23)], 1.5 * sum(sizes), 2.0)
    assert [r["target"] for r in sorted(got, key=lambda r: (r["source"] is None, r["source"] or ""))] == pytest.approx(want)


def test_plan_meets_targets_and_repeats(spark, docs):
    plan = mixing.plan_mix(docs).toPandas()
    by = plan.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert (by["taken"] - by["target"]).abs().max() <= 1 and (plan["taken"] <= 2 * plan["size"]).all()
    again = mixing.plan_mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert plan[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    mixed = mixing.mix(docs)
    words = mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).toPandas().set_index("source")["n"]
    assert (words - by["taken"]).abs().max() == 0 and mixed.columns == docs.columns


def test_mix_odd_rows(spark, odd):
    plan = mixing.plan_mix(odd).collect()
    assert len(plan) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in plan)
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.filter("doc_id = 1").count() <= 4
    assert mixing.plan_mix(odd.limit(0)).count() == 0 == mixing.mix(odd.limit(0)).count()


# Language


def test_forward_sums_all_segmentations():
    pieces = {"▁a": 0, "▁": 1, "a": 2, "b": 3, "ab": 4, "▁ab": 5}
    prob = np.array([[0.1], [0.2], [0.3], [0.1], [0.2], [0.1], [1e-7]])

    def brute(s):
        if not s:
            return 1.0
        return sum(prob[pieces.get(s[:i], 6), 0] * brute(s[i:]) for i in range(1, len(s) + 1) if s[:i] in pieces or i == 1)

    words = ["ab", "a", "aab", "ba", "ac", "éab", "abababab"]
    table = language_id.PieceTable(pieces)
    want = [np.log(brute("▁" + w)) for w in words]
    assert language_id.Lattice(words, table).log_likelihood(prob)[:, 0] == pytest.approx(want)
    assert [language_id.LongWord(w, table).log_likelihood(prob)[0, 0] for w in words] == pytest.approx(want)
    # Both forms see a word of any length whole.
    count = np.array([2.0])
    for w in ("ab" * 20 + "c", "abac" * 9):
        assert language_id.LongWord(w, table).expected(prob, count) == pytest.approx(language_id.Lattice([w], table).expected(prob, count))
    long_ = "ab" * 5000
    assert -1e5 < language_id.LongWord(long_, table).log_likelihood(prob)[0, 0] < language_id.LongWord(long_[:-2], table).log_likelihood(prob)[0, 0]


def test_pieces_are_found_as_in_a_dictionary():
    rng = random.Random(3)
    pieces = {p: i for i, p in enumerate(sorted({"".join(rng.choice("abé▁") for _ in range(rng.randint(1, 5))) for _ in range(300)}))}
    words = ["".join(rng.choice("abéx") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    lattice = language_id.Lattice(words, language_id.PieceTable(pieces))
    got = sorted(zip(lattice.word.tolist(), lattice.start.tolist(), lattice.end.tolist(), lattice.piece.tolist()))
    marked = ["▁" + w for w in words]
    assert got == sorted((n, i, j, pieces.get(w[i:j], len(pieces))) for n, w in enumerate(marked) for i in range(len(w)) for j in range(i + 1, min(len(w), i + 5) + 1) if w[i:j] in pieces or j == i + 1)


def test_columns_give_each_text_the_sum_of_its_words(monkeypatch):
    monkeypatch.setattr(language_id, "KNOWN_WORDS", 20)
    pieces = {p: i for i, p in enumerate(["▁", "t", "h", "e", "th", "the", "▁the", "é"])}
    prob = np.random.default_rng(1).random((9, 3)) / 9
    model = language_id.LanguageModel(["a", "b", "c"], pieces, prob, np.log(np.array([0.2, 0.3, 0.5])))
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["the", "The,", "été", "x2the", "²", "İt", "12", "he_the", "t" * 80, "".join(rng.choice("the") for _ in range(4))]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    for t, (lang, score) in zip(texts, model.predict(pa.array(texts))):
        words = [w for w in language_id.words_of(t) if any(map(str.isalpha, w))]
        log_prob = model.prior + sum((language_id.LongWord(w, model.table).log_likelihood(prob)[0] for w in words), np.zeros(3))
        p = np.exp(log_prob - log_prob.max())
        assert (lang, score) == (("und", 0.0) if not words else ("abc"[int(log_prob.argmax())], pytest.approx(p.max() / p.sum())))


def test_em_raises_likelihood():
    pieces = {p: i for i, p in enumerate(["▁", "t", "h", "e", "th", "the", "▁the", "he"])}
    words = {"the": 10.0, "he": 3.0, "hehe": 1.0, "the" * 30: 1.0}

    def total(rounds):
        prob = language_id.fit_pieces(words, pieces, rounds)[:, None]
        return sum(n * language_id.LongWord(w, language_id.PieceTable(pieces)).log_likelihood(prob)[0, 0] for w, n in words.items())

    assert total(1) < total(3) < total(8)


def test_language_held_out(spark, docs):
    held = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 and length(text) > 30")
    got = language_id.predict(docs, language_id.fit(docs, max_docs=60, rounds=2)).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 40 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark, odd):
    got = language_id.predict(odd, language_id.fit(odd, rounds=1)).collect()
    assert len(got) == len(ODD) and {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 6)} == {"und"}
    empty = language_id.fit(odd.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(odd, empty).collect()} == {"und"} and language_id.predict(odd.limit(0), empty).count() == 0


# Toxicity


@pytest.mark.parametrize(("block", "n_terms"), [(16, 40), (7, 400), (64, 5)])
def test_block_max_search_is_exact(block, n_terms):
    rng = np.random.default_rng(block)
    dense = np.where(rng.random((300, n_terms)) < 3 / n_terms, rng.random((300, n_terms)) ** 6 + 1e-3, 0.0)
    dense /= np.maximum(np.sqrt((dense * dense).sum(axis=1, keepdims=True)), 1e-12)
    example, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(example, term, dense[example, term], 300, n_terms, block=block)
    for i in range(0, 300, 7):
        t = np.flatnonzero(dense[i])
        for skip in (i, -1):
            ids, cosine = next(index.search_all(np.array([0, len(t)]), t, dense[i, t], 10, np.array([skip])))
            want = dense @ dense[i]
            want[skip if skip >= 0 else []] = 0
            top = np.lexsort((np.arange(300), -np.round(want, 12)))[:10]
            top = top[want[top] > 0]
            assert ids.tolist() == top.tolist() and cosine == pytest.approx(want[top])


def test_known_counts_are_those_of_whole_texts():
    texts = ["Vile VILE words, vileness! x_y 12 snake_Case \"Été\" İstanbul ab2cdefgh", "", "naïve ΑΣ word\u00a0word\n\tword", "x" * 1000]
    known = toxicity.Vocabulary(pa.array(sorted({t for x in texts for t in toxicity.terms_of(x)} - {"words"})))
    name = known.words.to_pylist() + ["^" + s for s in known.stems.to_pylist()]
    row, term, count = toxicity.known_counts(pa.array(texts), known)
    got = {(int(r), name[t]): int(n) for r, t, n in zip(row, term, count)}
    want = Counter((r, t) for r, x in enumerate(texts) for t in toxicity.terms_of(x) if t in name)
    assert got == dict(want) and toxicity.known_counts(pa.array([], pa.string()), known)[0].tolist() == []


def test_isotonic_never_falls():
    x, p = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1.0]), 0.5)
    assert (np.diff(p) >= 0).all() and len(x) == len(p)


def test_toxic_examples_are_found(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 5 == 0:
            words[3:3] = rng.sample(["vile", "awful", "nasty"], 2)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert all((r["predicted"] == 1) == (r["doc_id"] % 5 == 0) for r in got) and any(r["evidence"] for r in got)
    assert toxicity.drop_toxic(docs, model).count() == 320


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (4, 0, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.fit(odd, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.0} and toxicity.score(odd.limit(0), none).count() == 0
    assert toxicity.drop_toxic(odd, none).columns == odd.columns


# Media


def test_flac_round_trips():
    rng = np.random.default_rng(1)
    wave = (np.sin(np.arange(192 * 20) / 9) * 100 + 128).astype(np.uint8).tobytes()
    payloads = [bytes(192), rng.integers(0, 256, 192 * 31, dtype=np.uint8).tobytes(), bytes([7]) * 192 * 9, wave, rng.choice([0, 255], 192 * 5).astype(np.uint8).tobytes()]
    streams = flac.encode(payloads)
    assert [(x.view(np.uint8) ^ 0x80).tobytes() for x in flac.decode(streams)] == payloads
    assert len(streams[3]) < 0.5 * len(wave) and streams[0][:4] == b"fLaC"
    assert [s == flac.encode([p])[0] for s, p in zip(streams, payloads)] == [True] * 5


@pytest.mark.parametrize("at", [-1, -30, -100, 30])
def test_flac_damage_is_noticed(at):
    data = bytearray(flac.encode([bytes(range(192)) * 8])[0])
    data[at] ^= 0x10
    with pytest.raises(flac.CorruptStream):
        flac.decode([bytes(data)])


def test_rice_partitions_and_fixed_orders_decode():
    """Streams of other writers: two partitions, one of them escaped, and a third-order predictor."""
    bits = []
    put = lambda v, n: bits.extend((v >> (n - 1 - i)) & 1 for i in range(n))
    x = np.array([i * i % 50 - 25 for i in range(192)])
    put(0b001011 << 1, 8)
    for v in x[:3]:
        put(int(v) & 255, 8)
    put(0, 2), put(1, 4)
    res = np.diff(x, 3)
    put(6, 4)
    for r in res[:93].tolist():
        u = 2 * r if r >= 0 else -2 * r - 1
        put(1, (u >> 6) + 1), put(u & 63, 6)
    put(15, 4), put(10, 5)
    for r in res[93:].tolist():
        put(r & 1023, 10)
    got, _ = flac._subframes(flac._Bits(np.packbits(np.array(bits, dtype=np.uint8))), np.array([0]))
    assert got[0].tolist() == x.tolist()


def test_media_table(spark, odd):
    stored = flac.store_pcm(flac.write_media(odd))
    got = flac.read_pcm(stored).toPandas()
    for doc, text in [(r[0], r[1] or "") for r in ODD]:
        b = text.encode()
        p = b + b" " * (192 * max(1, -(-len(b) // 192)) - len(b))
        row = got[got["doc_id"] == doc].iloc[0] if doc is not None else got[got["doc_id"].isna()].iloc[0]
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        media = bytes(x ^ 0x80 for x in p)
        assert (row["media_bytes"], row["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    rows = stored.filter("doc_id = 4").orderBy("stream", "sample_offset").collect()
    assert [r["sample_offset"] for r in rows] == list(range(0, 45120, 64 * 192)) and {r["n_samples"] for r in rows} == {45120}
    want = bytes(x ^ 0x80 for x in ODD[5][1].encode() + b" " * 120)
    for first, n in ((0, 10), (12_280, 20), (12_288, 1), (12_287, 1), (100, 30_000), (45_000, 500), (50_000, 5)):
        found = flac.seek(stored.filter("doc_id = 4"), first, n).collect()
        assert [bytes(r["pcm"]) for r in found] == ([want[first : first + n]] if first < 45120 else [])
    assert flac.seek(stored, 0, 10).count() == len(ODD)
    assert flac.read_pcm(flac.store_pcm(flac.write_media(odd.limit(0)))).count() == 0


def test_repeated_rows_are_streams_of_their_own(spark):
    docs = spark.createDataFrame([(None, "a" * 30_000), (None, "a" * 30_000), (5, "b"), (5, "c"), (5, "b")], "doc_id long, text string")
    stored = flac.store_pcm(flac.write_media(docs.withColumn("stream", F.lit("clash")).withColumn("pcm", F.lit(1))))
    assert sorted((r["n_bytes"], r["payload_bytes"]) for r in flac.read_pcm(stored).collect()) == [(1, 192)] * 3 + [(30_000, 30_144)] * 2
    assert sorted(bytes(r["pcm"]) for r in flac.seek(stored, 12_288, 1).collect()) == [bytes([ord("a") ^ 0x80])] * 2


def test_seek_reaches_the_scan(spark, odd):
    stored = flac.store_pcm(flac.write_media(odd))
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = flac.seek(stored.filter("doc_id = 4"), 13_000, 5)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert all(want in pushed for want in ("EqualTo(doc_id,4)", "GreaterThan(sample_offset,712)", "LessThan(sample_offset,13005)"))


def test_digests_come_from_the_stored_blocks(spark, odd):
    stored = flac.store_pcm(flac.write_media(odd))
    for kept in ("sample_offset > 0", "sample_offset <> 12288", "sample_offset < 36864"):
        with pytest.raises(Exception, match="PCM blocks are missing"):
            flac.read_pcm(stored.filter(f"doc_id <> 4 or {kept}")).collect()


# Personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = [True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15][kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_formats():
    rng = random.Random(1)
    parts = ["@", ".", "a", "b.", "1", "23", "255", "4.", "+", "-", " ", "(", ")", "0", "4111111111111111", "é", "%"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_base_spans_are_linear_on_hostile_texts():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "@" * 200_000):
        pii.base_spans(text)


def test_em_finds_the_reliable_labeler():
    rng = random.Random(2)
    counts = {}
    for _ in range(3000):
        true = rng.random() < 0.5
        v = [(1 if true else -1) if rng.random() < p else (-1 if true else 1) for p in (0.95, 0.9, 0.85, 0.6, 0.9, 0.8)]
        shape = ",".join(map(str, (5, *v, 3, 2)))
        counts[shape] = counts.get(shape, 0) + 1
    model = pii.train(counts)
    kind = model.reliability[pii.KINDS[5]]
    assert kind["format"][0] > kind["cue"][0]
    assert model.accepts("5,1,1,1,1,1,1,3,2") and not model.accepts("5,-1,-1,-1,-1,-1,-1,3,2")


def test_pii_table(spark, odd):
    rows = [(i, f"call me at 555-123-{1000 + i} or mail bob{i}@mail.host.com, password=7602ad27cf{i}") for i in range(30)] + [(100, None), (101, "clean words only"), (101, "clean words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs, pii.fit(docs))).collect()}
    assert got[3]["n_email"] == 1 and "secret:" in got[3]["spans"] and got[101]["spans"] == "" == got[100]["spans"]
    assert got[101]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find(odd, pii.fit(odd)).count() == len(ODD) and pii.find(odd.limit(0), pii.fit(odd.limit(0))).count() == 0
