"""The operators' methods against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from beamloom.llm import exact_dedup, gear, language, learn, media, mixing, near_dedup, packing, quality, registry, spelling, substrings, token_files, tokens, toxicity, vector_packing, word_tokens
from beamloom.llm._shared import Scratch, documents, release
from beamloom.llm.learn import remainder


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in documents(spark, sf_dir).collect()}


@pytest.mark.parametrize("name", ["op8_mixing", "op10_exact_dedup", "op12_spelling_variants"])
def test_sql(spark, sf_dir, name):
    query, sql = registry.QUERIES[name]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(sql)
    got = query(spark, sf_dir).select(*sorted(want.columns))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.select(*[duckdb.ColumnExpression(c) for c in sorted(want.columns)]).fetchall()))


def test_block_names_do_not_trust_the_digest(spark):
    rows = [(i, t) for i, t in enumerate(["", "a", "b", "aaaa", "aaab", "aaaaa", "aaaab", "aaaa", "b" * 33, "b" * 32 + "a", "b" * 33, "ab" * 20, "ba" * 20])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    weak = lambda block: F.unhex(F.substring(F.md5(block), 1, 1))  # noqa: E731  four bits
    got = exact_dedup.exact_dedup(docs, block_bytes=4, digest=weak).collect()
    for x in got:
        for y in got:
            same = rows[x["doc_id"]][1] == rows[y["doc_id"]][1]
            assert ((x["text_level"], x["text_name"]) == (y["text_level"], y["text_name"])) == same and (x["keep_id"] == y["keep_id"]) == same


def test_gear_hash_and_cuts():
    data = np.random.default_rng(1).integers(0, 256, 400).astype(np.uint8)
    h, x = gear.hashes(data), 0
    for i, b in enumerate(data):
        x = (x << 1) + int(gear.TABLE[b]) & 0xFFFFFFFF
        assert x == h[i]
    cuts = [i for i in range(8, 392) if all(h[i] < h[j] or (h[i] == h[j] and i <= j) for j in range(i - 8, i + 9))]
    assert gear.lowest_cuts(data, 8).tolist() == cuts
    ends = gear.masked_cuts(np.tile(data, 100), 256, 8, 1024)
    sizes = np.diff([0, *ends])
    assert ends[-1] == 40_000 and (sizes[:-1] >= 256).all() and sizes.max() <= 1024


def test_bag_minhash_estimates_the_overlap():
    random.seed(3)
    words = [random.choice([f"w{i}" for i in range(300)]) for _ in range(120)]
    for a, b in ((words, words[:100] + ["x"] * 15), (words, words * 2), (words * 2, words + words[:60]), (["a"] * 50, ["a"] * 40)):
        x, y = near_dedup.bag(a), near_dedup.bag(b)
        ca, cb = (Counter(tuple(s[i : i + 5]) for i in range(len(s) - 4)) for s in (a, b))
        true = sum((ca & cb).values()) / sum((ca | cb).values())
        assert near_dedup.overlap(x, y) == pytest.approx(true)
        s = near_dedup.signatures([x, y], 4096)
        assert (s[0] == s[1]).mean() == pytest.approx(true, abs=0.04)
        assert (near_dedup.signatures([y], 4096)[0] == s[1]).all()


def _components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def test_near_classes_equal_brute_force(spark):
    random.seed(5)
    base = [[f"v{random.randrange(400)}" for _ in range(80)] for _ in range(6)]
    docs = []
    for k, b in enumerate(base):
        for _ in range(12):  # variants of a centre that are further from one another than from it, and chains
            w = list(b if k < 4 else docs[-1] if docs and k == 5 else b)
            for _ in range(random.randrange(1, 3)):
                w[random.randrange(len(w))] = f"new{random.randrange(10**6)}"
            docs.append(w)
        docs.append(b)
    bags = [near_dedup.bag(near_dedup.words_of(" ".join(d))) for d in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if near_dedup.overlap(bags[i], bags[j]) >= 0.8]
    got = near_dedup.near_classes(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string"))
    assert [r["class_id"] for r in got.orderBy("doc_id").collect()] == _components(len(docs), links)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(50, 60)] + [(71, 70)]
    scratch = Scratch(spark)
    got = {r["v"]: r["root"] for r in near_dedup.components(spark.createDataFrame(links, "a bigint, b bigint"), scratch).collect()}
    want = _components(101, links)
    assert got == {v: want[v] for pair in links for v in pair}
    scratch.close()


def test_passages_equal_brute_force(spark, sf_dir, texts):
    found = defaultdict(set)
    for i, t in texts.items():
        w = t.split()
        for k in range(len(w) - 49):
            found[tuple(w[k : k + 50])].add(i)
    want, got = {True: defaultdict(set), False: defaultdict(set)}, {True: defaultdict(set), False: defaultdict(set)}
    for i, t in texts.items():
        w = t.split()
        for k in range(len(w) - 49):
            if len(s := found[tuple(w[k : k + 50])]) > 1:
                want[min(s) == i][i].update(range(k, k + 50))
    for r in substrings.op6_substrings(spark, sf_dir).collect():
        got[r["kept"]][r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert got == want and want[False]


def test_words_before_marks_are_encoded_once():
    coder, seen = tokens.Encoder(tokens.default_vocabulary()), Counter()
    whole, encode = coder.plain("dog dog, dog.\ndog, (dog) dog;"), coder.tokenize
    coder.tokenize = lambda text: seen.update([text]) or encode(text)
    assert coder.ids("dog dog, dog.\ndog, (dog) dog;") == whole and seen["\u0120dog"] == 1


def test_pairs_are_sorted_alike_with_room_for_places_and_without():
    left, right = np.random.default_rng(3).integers(0, 9, (2, 300)).astype(np.int32)
    small, large = token_files._runs(left, right, 9), token_files._runs(left, right, 1 << 30)
    assert all(np.array_equal(a, b) for a, b in zip(small, large, strict=True))
    assert list(zip(left[small[0][small[1]]], right[small[0][small[1]]], strict=True)) == list(zip(small[2], small[3], strict=True)) == sorted(set(zip(left, right, strict=True)))


def test_encoder_equals_the_library(texts):
    coder = tokens.Encoder(tokens.default_vocabulary())
    odd = ["", " ", "  ", "a  b", "a\n b", "a \nb", " x", " \n\t x y", "it's we'll don't", "日本語 テキスト です", "naïve café 123 4,5", "tab\tsep end ", "a  b", "<|endoftext|> hi <|endoftext|>", "Ǆ x ǆ", "end. Stop! 'tis 'll"]
    for t in [*texts.values(), *odd]:
        assert coder.ids(t) == coder.plain(t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 6), max_size=40), min_size=1, max_size=8))
def test_shards_round_trip(docs):
    docs = [[*d, 0] for d in docs]
    shard = token_files.Shard(token_files.write_shard(list(range(len(docs))), [len(d) for d in docs], np.array(sum(docs, []), "<u4"), 7))
    assert shard.ids().tolist() == sum(docs, [])
    for i, d in enumerate(docs):
        assert shard.document(i) == d and shard.document(i, 1, 5) == d[1:5]
    left = Counter()
    for a, b in zip(shard.index["first"], [*shard.index["first"][1:], len(shard.symbols)], strict=True):
        last = None
        for k in range(int(a), int(b) - 1):
            pair = (int(shard.symbols[k]), int(shard.symbols[k + 1]))
            if pair[0] == pair[1] and last == (pair, k - 1):
                continue
            left[pair] += 1
            last = (pair, k)
    assert not left or max(left.values()) == 1  # no pair occurs twice


def test_repeats_become_rules():
    for ids, most in ((np.tile(np.arange(1, 2001), 11), 8), (np.ones(65_536, np.int64), 4), (np.array([5, 6, 1, 5, 6, 2, 5, 6, 3]), 6)):
        symbols, _, rules, _ = token_files.compress(ids, np.array([0]))
        assert len(symbols) <= most and len(rules)


def test_token_files_equal_the_library(spark, sf_dir, texts, tmp_path):
    from tokenizers import Tokenizer

    plain, start, want = Tokenizer.from_file(tokens.default_vocabulary()), 0, []
    for i in sorted(texts):
        ids = np.array([*plain.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.op9_token_files(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == want
    release(got)
    shards = token_files.write_token_shards(documents(spark, sf_dir), str(tmp_path / "shards"), shard_tokens=5000)
    assert sorted(map(tuple, token_files.read_token_shards(shards).collect())) == want and shards.count() > 5


def test_shards_are_smaller(texts):
    coder = tokens.encoder(tokens.default_vocabulary())
    ids = [np.frombuffer(coder.ids(t) + bytes(4), "<u4") for t in texts.values()]
    image = token_files.write_shard(list(texts), [len(x) for x in ids], np.concatenate(ids))
    assert len(image) < 2.2 * sum(map(len, ids))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30)))
def test_plan_places_every_piece_once(counts):
    rows, bins = packing.plan(counts, 64)
    content, placed = defaultdict(list), Counter()
    for size, rank, n, start, offset, each in rows:
        assert placed[size] == rank
        placed[size] += n
        for i in range(n):
            content[start + i // each].append((offset + i % each * size, size))
    assert placed == Counter(counts) and len(content) == bins
    for pieces in content.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= 64 and sum(3 * s > 64 for _, s in pieces) <= 2
    assert bins <= 1.34 * -(-sum(s * n for s, n in counts.items()) // 64) + max([0, *(n for s, n in counts.items() if 2 * s > 64)]) + 1


def test_poisson_counts(spark):
    for mean in (0.3, 2.0, 150.0):
        docs = spark.range(3000).selectExpr("id doc_id", "'x' text", "'a' source")
        got = [r["count"] for r in mixing.poisson_mix(docs, {"a": 1.0}, ratio=mean).groupBy("doc_id").count().collect()]
        got += [0] * (3000 - len(got))
        assert np.mean(got) == pytest.approx(mean, rel=0.06) and np.var(got) == pytest.approx(mean, rel=0.12)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    docs = [(i, int(i % 3 == 0), {f"w{t}": int(rng.integers(1, 5)) for t in rng.choice(40, rng.integers(0, 7), replace=False)}) for i in range(400)]
    index = toxicity.build(docs, {0: 0.5, 1: 1.0})
    full = np.zeros((len(docs), len(index.terms)))
    for e, i in enumerate(index.ids):
        where, w = toxicity.weigh({index.place[t]: n for t, n in docs[i][2].items()}, index.idf)
        full[e, where] = w
    for e in range(0, len(docs), 7):
        where, w = np.flatnonzero(full[e]), full[e][full[e] > 0]
        cosine = np.round(full @ full[e], 12)
        found, c = index.nearest(where, w) if len(where) else (np.zeros(0, int), np.zeros(0))
        order = sorted((i for i in range(len(docs)) if cosine[i] > 0), key=lambda i: (-cosine[i], index.ids[i]))[: toxicity.NEIGHBOURS]
        assert found.tolist() == order and np.allclose(c, cosine[order])


def test_toxicity_equals_all_cosines(spark, sf_dir, texts):
    """The whole query against cosines of all pairs of a text and a labelled one, in plain numpy."""
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    known = sorted(i for i in truth if zlib.crc32(str(i).encode()) % 5)
    share = {y: min(1.0, toxicity.PER_CLASS / sum(truth[i] == y for i in known)) for y in (0, 1)}
    assert share == {0: 1.0, 1: 1.0}  # at this size the sample is all
    counts = {i: toxicity.terms(t) for i, t in texts.items()}
    names = sorted(set().union(*[counts[i] for i in known]))
    df = {y: Counter(t for i in known if truth[i] == y for t in counts[i]) for y in (0, 1)}
    weight = {t: np.log(1 + len(known) / (df[0][t] + df[1][t])) * np.log2(2 + df[1][t] / max(df[0][t], 1)) ** 2 for t in names}

    def vector(i):
        v = np.array([(1 + np.log(counts[i][t])) * weight[t] if t in counts[i] else 0.0 for t in names])
        return v / max(np.linalg.norm(v), 1e-300)

    examples, toxic = np.array([vector(i) for i in known]), np.array([truth[i] for i in known])

    def vote(i, without):
        c = np.round(examples @ vector(i), 12)
        order = sorted((e for e in range(len(known)) if c[e] > 0 and known[e] != without), key=lambda e: (-c[e], known[e]))[: toxicity.NEIGHBOURS]
        w = c[order] ** toxicity.SHARPNESS
        return w @ toxic[order] / w.sum() if order else None

    rows = [(1.0, v, y) for i, y in zip(known, toxic, strict=True) if (v := vote(i, i)) is not None]
    curve = toxicity._logistic(np.array(rows)[:, :2], np.array(rows)[:, 2], np.ones(len(rows)))
    covered = 0
    for r in toxicity.op4_toxicity(spark, sf_dir).collect():
        v = vote(r["doc_id"], None)
        covered += v is not None
        assert r["score"] == pytest.approx(toxic.mean() if v is None else 1 / (1 + np.exp(-(curve @ [1.0, v]))), abs=1e-6)
    assert covered > 0.97 * len(texts)


def test_quality_equals_all_cosines(spark, sf_dir, texts):
    """Scores against one document at a time: all cosines sorted in Python."""
    model = quality.fit_labels(spark, documents(spark, sf_dir), sf_dir)
    assert np.allclose(model.axes.T @ model.axes, np.eye(model.axes.shape[1]))
    for r in quality.op5_quality(spark, sf_dir).collect():
        v = model.project([quality.features(texts[r["doc_id"]])])[0]
        c = [round(float(x), 10) for x in model.vectors @ v]
        near = sorted(range(len(c)), key=lambda e: (-c[e], e))[: quality.NEIGHBOURS]
        w = [max(c[e], 1e-6) ** quality.SHARPNESS * model.vote[e] for e in near]
        assert r["score"] == pytest.approx(sum(x * model.good[e] for x, e in zip(w, near, strict=True)) / sum(w), abs=1e-7)


def test_main_axes():
    rng = np.random.default_rng(3)
    m = rng.standard_normal((80, 20)) @ np.diag(0.7 ** np.arange(20)) @ rng.standard_normal((20, 60))
    _, _, vt = np.linalg.svd(m)
    assert np.allclose(np.abs(quality.main_axes(m, 5).T @ vt[:5].T), np.eye(5), atol=1e-4)


def test_equal_examples_are_taken_by_id():
    docs = [(i, i % 2, {"a": 1, "b": 1 + i % 3}) for i in range(90)]
    index = toxicity.build(docs, {0: 1.0, 1: 1.0})
    found, c = index.nearest(*index.vector("a b b"))
    same = [i for i in range(90) if i % 3 == 1]
    assert index.ids[found].tolist()[: len(same)] == same and len(set(c[: len(same)])) == 1
    rows = [(i, i % 2, *quality.features("one two three" if i % 3 else "four five")) for i in range(90)]
    model = quality.train(rows, {0: 1.0, 1: 1.0})
    first = [i for i in range(90) if i % 3][: quality.NEIGHBOURS]
    assert model.scores(["one two three"])[0] == pytest.approx(np.mean([i % 2 for i in first]))


def test_languages_are_not_cut():
    rng = np.random.default_rng(4)
    names = [f"l{i:03}" for i in range(250)]
    rows = [(k, n, *language.features(f"{n}x{n} " * 20)) for k, n in enumerate(names * 4)]
    model = language.train(rows)
    assert model.labels == names and model.top is not None and model.table.shape[1] == language.DIM
    small = language.train([(k, "ab"[k % 2], *language.features("aaa bab " if k % 2 else "xyz zzy ")) for k in range(rng.integers(30, 40))])
    assert small.top is None
    p = small.probabilities(small.logits(["aaa bab ", "xyz zzy "]))
    assert p.argmax(axis=1).tolist() == [1, 0]


def test_every_language_is_sampled(spark):
    """Many languages, a rare one, and one whose first rows by hash have texts that are too long to be learned from."""
    many = spark.range(27_000).select("id", F.concat(F.lit("l"), F.col("id") % 9_000).alias("label"))
    assert learn.first_by_hash(many, 500).groupBy("label").count().agg(F.count("*"), F.max("count")).first() == (9_000, 1)
    few = spark.range(3_000).select("id", F.when(F.col("id") == 5, "rare").otherwise("common").alias("label"))
    assert {r["label"]: r["count"] for r in learn.first_by_hash(few, 500).groupBy("label").count().collect()} == {"rare": 1, "common": 500}
    mostly_long = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "aa").otherwise("bb").alias("lang"))
    text = F.when((F.col("lang") == "aa") & (F.col("doc_id") > 4), F.repeat(F.lit("long "), 20_000)).when(F.col("lang") == "aa", "short one").otherwise("brief other")
    model = language.fit(mostly_long.withColumn("text", text), per_class=10)
    assert model.labels == ["aa", "bb"]


def test_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² ① Ⅷ 12 _"), (2, "é"), (3, "日"), (4, "ab cd")], "doc_id bigint, text string")
    model = language.train([(k, "en", *language.features("ab cd")) for k in range(9)])
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert got == {1: "und", 2: "en", 3: "en", 4: "en"}


def test_media_equals_a_plain_version(spark, sf_dir, texts):
    import zstandard

    got = {r["doc_id"]: r for r in media.op2_media(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        n, data = media.payload(t)
        parts = media.chunks(data)
        frames = [zstandard.ZstdCompressor(level=media.LEVEL).compress(p) for p in parts]
        form = media.stored_form(frames, [len(p) for p in parts], [hashlib.sha256(p).digest() for p in parts])
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t.encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(form), hashlib.sha256(form).hexdigest(), media.feature(data)) and len(form) < len(data) + 1000
        assert n == r["n_bytes"] and len(data) % 576 == 0 and b"".join(parts) == data


def test_near_classes_recall(spark, sf_dir):
    """Against all pairs of a table of 1000 documents whose sizes allow a similarity of 0.8."""
    sf = sf_dir.replace("0.001", "0.01")
    rows = {r["doc_id"]: near_dedup.bag(near_dedup.words_of(r["text"])) for r in documents(spark, sf).collect()}
    sized = sorted((int(n.sum()), i) for i, (_, n) in rows.items() if len(n))
    links = []
    for k, (n, i) in enumerate(sized):
        for m, j in sized[k + 1 :]:
            if n < 0.8 * m:
                break
            if near_dedup.overlap(rows[i], rows[j]) >= 0.8:
                links.append((i, j))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op1_near_dedup(spark, sf).collect()}
    found = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 50 and found >= 0.99 * len(links)
    root = _components(max(rows) + 1, links)
    groups = {(root[a], got[a]) for a in rows if len(rows[a][0])}
    assert len(groups) <= 1.02 * len({g for _, g in groups})


def test_remove_passages(spark):
    p = " ".join(f"w{i * i % 977}" for i in range(60))
    docs = [(1, f"a b {p} c"), (2, f"x\n {p}  y {p} z"), (3, p), (4, None), (5, "short text"), (6, f"a b {p} c")]
    frame = spark.createDataFrame([(i, t, t, i) for i, t in docs], "doc_id bigint, text string, spans string, key bigint")
    got = substrings.remove_passages(frame)
    assert got.columns == frame.columns
    out = {r["doc_id"]: r for r in got.collect()}
    assert {i: (r["text"] or "").split() for i, r in out.items()} == {1: docs[0][1].split(), 2: ["x", "y", "z"], 3: [], 4: [], 5: ["short", "text"], 6: []}
    assert out[4]["text"] is None and all(r["spans"] == dict(docs)[i] for i, r in out.items())
    assert substrings.remove_passages(frame.limit(0)).count() == 0


def test_clashing_names(spark):
    rows = [(1, "one text", "src0", -1), (2, "one text", "src1", -2), (3, "another", "src0", -3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, key bigint")
    assert sorted(map(tuple, exact_dedup.drop_exact_copies(docs).collect())) == rows[1:]
    assert sorted(map(tuple, near_dedup.drop_near_copies(docs).collect())) == [rows[0], rows[2]]
    named = docs.withColumnsRenamed({"key": "rate"}).selectExpr("*", "1 as n", "2 as rest", "3 as parts")
    got = mixing.poisson_mix(named, {"src0": 0.5}, other=0.5, ratio=60.0)
    assert got.columns == [*named.columns, "copy", "shuffle_key"] and {r["rate"] for r in got.collect()} == {-1, -2, -3}


def test_stages_on_odd_tables(spark, sf_dir):
    from test_edge_cases import ROWS, SCHEMA

    odd, none = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([], SCHEMA)
    for table, least in ((odd, 1), (none, 0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, sf_dir)
            if name != "sequences":
                assert made.columns == odd.columns
                docs = spark.createDataFrame(made.collect(), made.schema)
            n = made.count()
            release(made)
            assert n >= least if table is odd else n == 0


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs, truth = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    lang = language.op3_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (lang["lang"] == lang["lang_pred"]).mean() > 0.97
    good = quality.op5_quality(spark, sf).join(truth, "doc_id").filter("held_out").toPandas()
    assert (good["predicted"] == good["quality"]).mean() > 0.95
    toxic = toxicity.op4_toxicity(spark, sf).join(truth, "doc_id").toPandas()
    assert (toxic["predicted"] == toxic["toxic"]).mean() > 0.93
    assert (remainder_of(toxic) == toxic["held_out"]).all()


def remainder_of(frame):
    return frame["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)


def test_pipeline_equals_a_plain_version(spark, sf_dir, texts):
    docs = documents(spark, sf_dir)
    model = quality.fit_labels(spark, docs, sf_dir)
    rows = {r["doc_id"]: r for r in docs.collect()}
    stay = [i for i in sorted(texts) if model.scores([texts[i]])[0] >= quality.KEEP]
    last = {texts[i]: i for i in stay}
    stay = sorted(last.values())
    bags = [near_dedup.bag(near_dedup.words_of(texts[i])) for i in stay]
    links = [(a, b) for a in range(len(stay)) for b in range(a) if near_dedup.overlap(bags[a], bags[b]) >= 0.8]
    stay = [stay[k] for k in sorted(set(_components(len(stay), links)))]
    chars, shares = Counter(), dict(mixing.WEIGHTS) | {None: mixing.OTHER}
    group = {i: rows[i]["source"] if rows[i]["source"] in mixing.WEIGHTS else None for i in stay}
    for i in stay:
        chars[group[i]] += len(texts[i])
    whole = sum(shares[g] for g in chars)
    copies = Counter()
    for i in stay:
        mean = sum(chars.values()) * shares[group[i]] / whole / chars[group[i]]
        u = int(__import__("hashlib").md5(f"{mixing.SEED}|n|{i}|1".encode()).hexdigest()[:13], 16) / 2**52
        copies[i] = sum(c <= u for c in mixing.poisson_cdf(mean))
    coder = tokens.encoder(tokens.default_vocabulary())
    want = Counter()
    for i, n in copies.items():
        ids = coder.ids(texts[i]) + bytes(4)
        for k, (s, m) in enumerate(packing.cut(len(ids) // 4, 2048)):
            want[i, k, s, m, zlib.crc32(ids[4 * s : 4 * (s + m)])] += n
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == +want
    got = got.sort_values(["sequence_id", "offset"])
    assert (got["offset"] == got.groupby("sequence_id")["length"].cumsum() - got["length"]).all()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_copies", "near_copies", "mixture", "sequences"]


def _examples(rng, n, tokens, parts):
    out = []
    for i in range(n):
        runs, at = [], 0
        for k in range(rng.randint(1, parts)):
            at += rng.randint(0, tokens)
            runs.append((at, bool(k % 2) or parts == 1))
        out.append(vector_packing.Example(i, bytes(4 * (at + 1)), [*runs, (at + 1, runs[-1][1])]))
    return out


@pytest.mark.parametrize(("tokens", "segments", "loss"), [(4096, 128, 4096), (4096, 16, 700), (100, 2, 7), (64, 1, 64), (1, 1, 1)])
def test_sequences_hold_every_token_within_the_limits(tokens, segments, loss):
    rng = random.Random(tokens + segments)
    examples, bears = _examples(rng, 60 if tokens < 4096 else 1500, 300, 5), {}
    for e in examples:
        bears[e.id] = [e.before(p) for p in range(e.n + 1)]
        assert all(0 <= b - a <= 1 for a, b in zip(bears[e.id], bears[e.id][1:], strict=False)) and bears[e.id][1] == 0
        for start in range(0, e.n, 41):
            reach = e.reach(start, 5)
            assert bears[e.id][reach] - bears[e.id][start] <= 5 and (reach == e.n or bears[e.id][reach + 1] - bears[e.id][start] > 5)
    pieces = defaultdict(list)
    for made in vector_packing.sequences(iter(examples), tokens, segments, loss):
        used = sum(end - start for _, start, end in made)
        assert 0 < used <= tokens and len(made) <= segments and sum(bears[e.id][end] - bears[e.id][start] for e, start, end in made) <= loss
        assert used == tokens or used & (used - 1) == 0  # no padding
        for e, start, end in made:
            pieces[e.id].append((start, end))
    for e in examples:
        ends = sorted(pieces[e.id])
        assert [s for s, _ in ends] == [0, *(t for _, t in ends[:-1])] and ends[-1][1] == e.n


def test_the_largest_dot_product_goes_first():
    """Of what fits in all dimensions: with little room for loss, the piece that needs more of what is left."""
    packer = vector_packing.Packer(100, 9, 10)
    for i, (n, bears) in enumerate([(60, 9), (50, 2), (40, 8), (30, 0)]):
        list(packer.add(vector_packing.Example(i, bytes(4 * n), [(n - bears, False), (n, True)])))
    size, loss = packer.size[:4].copy(), packer.loss[:4].copy()
    first = packer.fill()[0]
    score = [s / 100 * size.sum() / 100 + x / 10 * loss.sum() / 10 for s, x in zip(size, loss, strict=True)]
    assert first[0].id == score.index(max(score))


def test_vector_packing_equals_the_library(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(word_tokens.default_word_vocabulary())
    ids = {d: np.array([*coder.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    got = registry.QUERIES["op11_vector_packing"][0](spark, sf_dir).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        by_doc[r["doc_id"]].append((r["start"], r["start"] + r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    assert set(by_doc) == set(ids)
    for d, ends in by_doc.items():
        ends.sort()
        assert [s for s, _ in ends] == [0, *(t for _, t in ends[:-1])] and ends[-1][1] == len(ids[d])
    padding = 0
    for ends in by_sequence.values():
        ends.sort()
        assert [s for s, _ in ends] == [0, *(t for _, t in ends[:-1])]
        used = ends[-1][1]
        padding += 0 if used & (used - 1) == 0 else 4096 - used
    assert padding == 0 and len(by_sequence) <= sum(map(len, ids.values())) / 4096 + 13


def test_word_encoder_equals_the_library(texts):
    coder = word_tokens.WordEncoder(word_tokens.default_word_vocabulary())
    odd = ["It's  a\tTest ÅÄÖ ǅ İstanbul ΑΣ ΟΔΟΣ. don't", "a\x1cb", "x ́y é", "<|endoftext|> a<|startoftext|>b", "ﬁ ª º µ ß ẞ", "　wide　x", "123 4.5 ½x", "\r\n\r\n a ", "A\u0085B", "é.", "I'm we'LL 'S", "﻿BOM", "한국어", "a ̸= b"]
    for t in [*texts.values(), *odd]:
        assert coder.ids(t) == coder.plain(t)


def _spelling(rows):
    """Words by plain counting; near words by all strings with one letter deleted or masked."""
    n, lower = Counter(), {c: c + 32 for c in range(65, 91)}
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= 3}
    masked, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            masked[w[:i], w[i + 1 :]].add(w)
            if (v := w[:i] + w[i + 1 :]) in n:
                near[w].add(v)
                near[v].add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: best[w] if w in best and n[best[w]] >= 2 * k else None for w, k in n.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), k, len(near[w]), n[form[w]] if form[w] else None) for w, k in n.items()}


def test_spelling_variants_equal_brute_force(spark, sf_dir, texts):
    got = registry.QUERIES["op12_spelling_variants"][0](spark, sf_dir).collect()
    want = _spelling(texts.items())
    assert set(map(tuple, got)) == want and len(got) == len(want)


@pytest.mark.parametrize("most_letters", [10, 300, 60_000])
def test_hot_tries_are_split(spark, most_letters):
    """A family of words of two letters with one beginning and one end, as far as repeats within a word make pairs ambiguous."""
    rng, words = random.Random(3), set()
    while len(words) < 600:
        words.add("aaaa" * rng.randint(1, 2) + "".join(rng.choices("ab", k=rng.randint(1, 9))) + "ß" * rng.randint(0, 2))
    rows = [(i, " ".join(rng.choices(sorted(words), k=20))) for i in range(400)]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string"), most_letters=most_letters).collect()
    want = _spelling(rows)
    assert set(map(tuple, got)) == want and len(got) == len(want) and sum(r["n_near"] for r in got) > 1000


def test_roots_follow_chains(spark):
    """Each word is more than twice as frequent as the next, one letter apart."""
    chain = {"helloo": 800, "halloo": 300, "hallao": 110, "hillao": 40, "hillaa": 15}
    rows = [(i, w) for i, w in enumerate([w for w, n in chain.items() for _ in range(n)])]
    got = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(map(tuple, got.values())) == _spelling(rows) and got["hillaa"]["root"] == "helloo"


def test_filter_comes_to_the_driver_by_arrow(spark, monkeypatch):
    """Whatever Arrow's setting is: pandas without Arrow makes an object of each row."""
    from beamloom.llm import bloom

    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    monkeypatch.setattr(type(keys), "toPandas", lambda self: pytest.fail("rows became objects"))
    bits = bloom.build(keys, F.col("h"))
    inside = np.array([r["h"] for r in keys.collect()], np.int64).view(np.uint64)
    assert bloom.hits(bits, inside).all()
    assert bloom.hits(bits, inside ^ np.uint64(0x5555555555555555)).mean() < 0.1
