"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns and an empty table."""

import hashlib
import zlib

import pytest

from beamloom.llm import exact_dedup, language, media, mixing, near_dedup, packing, quality, spelling, substrings, token_files, toxicity, vector_packing
from beamloom.llm._shared import Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, kept string, copy string, score string, class_id int, id string"
WORDS = [f"w{i * i % 977}" for i in range(70)]
LONG = " ".join(f"word{i % 1700}" for i in range(30_000))
ROWS = [
    (1, "the same text", "en", "src0", 13, 1, "a", "b", "c", 1, "x"),
    (1, "the same text", "en", "src0", 13, 1, "a", "b", "c", 1, "x"),
    (2, "the same text", None, None, None, None, None, None, None, None, None),
    (None, None, None, None, None, None, None, None, None, None, None),
    (None, "no id", "en", "src3", 5, None, None, None, None, None, None),
    (3, "", "fr", "src1", 0, None, None, None, None, None, None),
    (4, None, "fr", "src1", 0, None, None, None, None, None, None),
    (5, LONG, "de", "src2", len(LONG), None, None, None, None, None, None),
    (6, LONG, "de", "src2", len(LONG), None, None, None, None, None, None),
    (7, "start " + " ".join(WORDS) + " end", "en", "other", 1, None, None, None, None, None, None),
    (8, "another begin " + " ".join(WORDS), "en", "other", 1, None, None, None, None, None, None),
    (9, "!!! ... \n\n ???  ", "en", "src0", 1, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(odd, none):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    assert {h: len(v) for h, v in by.items()} == {hashlib.sha256(t.encode()).hexdigest(): n for t, n in (("the same text", 3), ("", 3), ("no id", 1), (LONG, 2), (ROWS[9][1], 1), (ROWS[10][1], 1), (ROWS[11][1], 1))}
    assert all(sum(r["kept"] for r in v) == 1 and all(r["group_size"] == len(v) for r in v) for v in by.values())
    assert [r["keep_id"] for r in by[hashlib.sha256(b"the same text").hexdigest()]] == [2, 2, 2]
    assert {r["keep_id"] for r in by[hashlib.sha256(b"").hexdigest()]} == {4}
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0


def test_near_dedup(odd, none):
    got = near_dedup.near_classes(odd)
    assert got.count() == len(ROWS)
    rows = got.filter("doc_id = 7 or doc_id = 8").collect()
    assert {r["class_id"] for r in rows} == {7} and sum(r["kept"] for r in rows) == 1
    assert {r["class_id"] for r in got.filter("doc_id in (5, 6)").collect()} == {5}
    assert got.filter("kept").count() == got.select("class_id", "class_size").distinct().count() == 6
    assert near_dedup.drop_near_copies(odd).columns == odd.columns
    assert near_dedup.near_classes(none).count() == 0


def test_substrings(odd, none):
    got = substrings.repeated_passages(odd).collect()
    by = {(r["doc_id"], r["kept"]): (r["start_word"], r["end_word"], r["first_doc_id"]) for r in got}
    assert by[7, True] == (1, 71, 7) and by[8, False] == (2, 72, 7)
    assert by[6, False] == (0, 30_000, 5) and {d for d, _ in by} == {5, 6, 7, 8}
    assert substrings.repeated_passages(none).count() == 0


def test_mixing(odd, none):
    got = mixing.poisson_mix(odd, {"src0": 0.5, "src9": 0.1}, other=0.4, ratio=3.0)
    assert got.columns[: len(odd.columns)] == [c if c != "copy" else "copy_input" for c in odd.columns]
    n = got.groupBy("doc_id", "text").count().collect()
    assert sum(r["count"] for r in n) > len(ROWS) and all(r["count"] >= 1 for r in n)
    assert mixing.poisson_mix(none, {"src0": 0.5}, other=0.5).count() == 0
    assert mixing.mix_documents(odd).columns == odd.columns


def test_packing(odd, none):
    got = packing.pack(odd).toPandas()
    assert len(got[got["piece"] == 0]) == len(ROWS)
    got = got.sort_values(["sequence_id", "offset"])
    groups = got.groupby("sequence_id")
    assert (got["offset"] == groups["length"].cumsum() - got["length"]).all() and groups["length"].sum().max() <= 2048
    long = got[got["doc_id"] == 5].sort_values("piece")
    assert (long["start"] == long["length"].cumsum() - long["length"]).all() and (long["length"].iloc[1:] == 2048).all()
    assert (got[got["doc_id"].isin([3, 4])]["ids_crc32"] == zlib.crc32(bytes(4))).all()
    assert packing.pack(none).count() == 0


def test_token_files(odd, none, spark):
    scratch = Scratch(spark)
    shards = token_files.write_token_shards(odd, scratch, shard_tokens=1000)
    got = token_files.read_token_shards(shards).toPandas().sort_values("start")
    assert len(got) == len(ROWS) and (got["start"] == got["n_tokens"].cumsum() - got["n_tokens"]).all()
    ids = got["doc_id"].fillna(-1).tolist()
    assert ids == sorted(ids)
    assert token_files.read_token_shards(token_files.write_token_shards(none, scratch)).count() == 0
    scratch.close()


def test_media(odd, none, spark):
    scratch = Scratch(spark)
    store = media.write_media(odd, scratch)
    owned = store.selectExpr("explode(chunks) c").filter("c.data is not null").select("c.digest")
    assert owned.count() == owned.distinct().count() == store.selectExpr("explode(chunks) c").select("c.digest").distinct().count()
    got = media.read_media(store).collect()
    texts = sorted(hashlib.sha256(media.payload(r[1])[1]).hexdigest() for r in ROWS)
    assert sorted(r["payload_sha256"] for r in got) == texts
    assert all(r["payload_bytes"] % 576 == 0 and r["payload_bytes"] > 0 for r in got)
    assert media.read_media(media.write_media(none, scratch)).count() == 0
    scratch.close()


def test_language(odd, none):
    model = language.fit(odd)
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict(odd, model).collect()}
    assert (None, "und") in got and (3, "und") in got and (4, "und") in got and (9, "und") in got
    assert language.predict(none, model).count() == 0
    assert language.predict(odd, language.fit(none)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_classifiers(odd, none, spark):
    truth = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, None), (None, 1), (2, 0), (77, 1)], "id bigint, label int")
    empty = spark.createDataFrame([], "id bigint, label int")
    for t in (truth, empty):
        a, b = toxicity.score(odd, toxicity.fit(odd, t)), quality.score(odd, quality.fit(odd, t))
        for got in (a, b):
            scores = [r["score"] for r in got.collect()]
            assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(none, toxicity.fit(odd, truth)).count() == 0
    assert quality.score(none, quality.fit(none, truth)).count() == 0
    assert quality.keep_good(odd, quality.fit(odd, truth)).columns == odd.columns


def test_vector_packing(odd, none, spark):
    got = vector_packing.pack_vectors(odd, vector_packing.one_part()).collect()
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0) and sum(r["start"] == 0 for r in got) == len(ROWS)
    assert [r["length"] for r in by[4, 1]] == [1] and by[4, 1][0]["ids_crc32"] == zlib.crc32((2).to_bytes(4, "little")) and by[4, 1][0]["loss_tokens"] == 0
    assert {r["doc_tokens"] for r in got if r["doc_id"] in (5, 6)} == {max(r["doc_tokens"] for r in got)} and sum(r["start"] == 0 for r in by[1, 4]) == 2
    assert sum(r["doc_id"] is None for r in got) == 2
    assert vector_packing.pack_vectors(none, vector_packing.one_part()).count() == 0
    parts = "array<struct<text:string,loss:boolean>>"
    turns = spark.createDataFrame([(1, [("what is it", False), ("it is this", True), (None, None), ("and that", True)]), (2, None), (3, []), (4, [None])], f"conv_id bigint, parts {parts}")
    rows = vector_packing.pack_vectors(turns, turns["parts"], "conv_id").collect()
    loss = lambda i: (sum(r["length"] for r in rows if r["conv_id"] == i), sum(r["loss_tokens"] for r in rows if r["conv_id"] == i))
    assert [loss(i) for i in (1, 2, 3, 4)] == [(9, 6), (1, 0), (1, 0), (1, 0)]
    with pytest.raises(ValueError):
        vector_packing.pack_vectors(turns, turns["parts"], "conv_id", segments=0)


def test_spelling_variants(odd, none, spark):
    got = {r["word"]: r for r in spelling.spelling_variants(odd).collect()}
    assert "word1234" not in got and got == {}  # no run of five letters occurs three times
    long = "z" * 20_000
    rows = [(None, "Straße"), (7, "Straße " * 3 + "Strasse Strase"), (7, long), (8, long + "y"), (9, long), (10, long + "y"), (11, long), (12, long + "y"), (13, None), (14, ""), (15, long), (15, long), (16, long)]
    rows += [(i, f"{long[:9]}{'é' * (i % 2)}") for i in range(100, 112)]
    found = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string"), most_letters=50).collect()}
    assert found[long]["n_near"] == 1 and found[long + "y"]["n_near"] == 1 and found[long + "y"]["form"] == long
    assert found[long[:9]]["form"] is None and found[long[:9]]["n_near"] == 1 and found[long[:9]]["form_n"] is None
    assert spelling.spelling_variants(none).count() == 0
