"""All queries and stages on odd tables: nulls everywhere, empty and repeated rows, clashing columns, no rows."""

import pytest

import corpus_pipeline
from reviewloom.llm import near_dup, queries

TOXIC = "you are an idiot and a moron, said the clown. "
PLAIN = "the quick brown fox jumps over the lazy dog while a river runs past the old mill near some hills and trees "
ODD = [
    (1, PLAIN * 3, "s"), (1, PLAIN * 3, "s"), (2, PLAIN * 3, None), (None, PLAIN * 3, "s"), (None, None, None), (3, None, "s"), (4, "", "s"), (4, "", "s"),
    (5, " \n\t ", ""), (6, "é", "é"), (7, TOXIC, "s"), (8, PLAIN * 800, "s"), (9, "x" * 300_000, "t"), (10, "\x00\x01￿ 🙂", "s"), (-1, "a\r\nb\x0bc", "s"),
]


#: names that operators use inside
CLASHING = ["_kept", "_rid", "rid", "_metadata", "_id", "_th", "_full", "_n", "_piece", "_pieces", "th", "v", "component", "size", "draw", "draws", "target", "h", "b", "size_", "_b", "_y"]
BAD = [7, *range(20, 30)]
ODD += [(i, f"{TOXIC} number{i} of many", "s") for i in BAD[1:]] + [(i, f"a calm and friendly text number{i} about gardens", "s") for i in range(40, 50)]


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(request, spark, tmp_path_factory):
    top = tmp_path_factory.mktemp(request.param)
    rows = ODD if request.param == "odd" else []
    extra = lambda n: (*n, "r", 5, "k", "i", 0.5, "sh", "sl", *[3] * len(CLASHING), "de" if n[0] == 6 else "en" if n[0] else None)
    names = "doc_id long, text string, source string, row string, id int, key string, items string, score double, shard string, slot string, " + ", ".join(f"{c} int" for c in CLASHING) + ", lang string"
    spark.createDataFrame([extra(r) for r in rows], names).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), *((i, 0, 1) for i in BAD), *((i, 1, 0) for i in range(40, 50)), (None, 1, 1), (8, None, None), (99, 0, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog while a river"), (2, None), (None, "x"), (3, ""), (1, "clown")] if rows else [], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    pages = [(1, "http://a.com/", "<p>" + PLAIN * 20), (1, "http://a.com/", "<p>" + PLAIN * 20), (2, None, None), (None, "x", "<article><p>Hi"), (3, "", ""), (4, "http://B.net/fr/x", "<p>" + PLAIN * 20), (5, "://", "<div" * 2000)]
    spark.createDataFrame([(*p, "c", 1) for p in pages] if rows else [], "page_id long, url string, html string, row string, host int").write.parquet(f"{top}/pages.parquet")
    vectors = [(i, [float((i * k) % 7) for k in range(1, 6)], 0) for i in range(30)] + [(3, [3.0, 6.0, 2.0, 5.0, 1.0], 0), (None, [0.5] * 5, None), (31, None, 1), (32, [], 1), (33, [1.0, None, 1.0, 1.0, 1.0], 1), (34, [float("nan")] * 5, 1), (35, [1.0], 1)]
    spark.createDataFrame([(*v, 1, 2, "r") for v in vectors] if rows else [], "vec_id long, embedding array<float>, label int, x int, part int, row string").write.parquet(f"{top}/embeddings.parquet")
    return str(top), len(rows), len(pages) if rows else 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_row_for_each(name, spark, folder):
    path, n_docs, n_pages = folder
    got = queries.QUERIES[name](spark, path).collect()
    if name == "op11_embedding_whitening":
        assert len(got) == (4 * 32 if n_docs else 0) and all(r.n == 8 and r.identity_error < 1e-9 for r in got)
        return
    if name == "op12_phrase_collocations":
        assert {r.lang for r in got} == ({"en"} if n_docs else set()) and sorted(r.rank for r in got) == list(range(1, len(got) + 1))
        assert not n_docs or any("brown fox" in r.phrase for r in got)
        return
    if name == "op13_language_id" and got:
        assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"} and all(r.lang_pred in ("de", "en", "und") and 0 <= r.score <= 1 for r in got)
    assert len(got) == (n_pages if name.split("_")[0] in ("op2", "op5", "op8") else n_docs)
    if name == "op10_minhash_near_dedup" and got:
        comp = {(r.doc_id, r.n_shingles > 0): r.component_id for r in got}
        assert comp[2, True] == 1 and comp[4, False] == 4 and comp[None, False] is None
    if name == "op3_decontamination" and got:
        hit = {r.doc_id for r in got if r.contaminated}
        assert hit == {1, 2, None, 8, *BAD}
    if name == "op9_sharding" and got:
        assert sorted(r.slot for r in got) == [0] * 24 + [1] * (len(got) - 24)


def test_stages(spark, folder):
    path, n, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, path), name)
        seen.append([r.doc_id for r in docs.collect()])
        if i < 4:
            assert docs.columns == names
    assert set(names) < set(docs.columns) and "shard_" in docs.columns
    if not n:
        assert seen == [[]] * 5
        return
    toxic, near, clean, mixed, last = seen
    assert not set(BAD) & set(toxic) and len(toxic) == n - len(BAD)
    assert near.count(1) == 1 and 2 not in near and 8 not in near and {3, 4, 5, 6, 9, 10, -1} <= set(near) and near.count(None) == 2  # 8 repeats the windows of 1
    assert clean.count(None) == 1 and not {1, 8} & set(clean) and {3, 4, 5, 6, 9, 10, -1} <= set(clean)
    assert len(last) == len(mixed)


def test_one_id_on_unrelated_texts(spark):
    """Rows that share an id are told apart by their texts: only near-duplicates go; columns of inner names pass unchanged."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(5, a, 1), (5, b, 2), (3, a + " end", 3), (9, b, 4), (9, b, 4), (7, c, 5), (7, c + " more", 6), (5, a, 7)]
    docs = spark.createDataFrame([(i, t, "s", k, k) for i, t, k in rows], "doc_id long, text string, source string, _kept int, _id int")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted((r.doc_id, r.text[0], r._kept, r["_id"]) for r in got.collect())
    assert [k[:2] for k in kept] == [(3, "a"), (5, "b"), (7, "c")] and kept[0][2:] == (3, 3) and kept[1][2:] == (2, 2)
    found = sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect())
    assert found == [(3, 3), (5, 3), (5, 3), (5, 5), (7, 7), (7, 7), (9, 5), (9, 5)]


def test_sharding_keeps_columns_of_inner_names(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i // 2}", i, i * 2, "m") for i in range(50)], "doc_id long, text string, _rid long, rid long, _metadata string").write.parquet(f"{tmp_path}/d")
    got = corpus_pipeline.shard(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()
    assert sorted((r.doc_id, r["_rid"], r.rid, r["_metadata"]) for r in got) == [(i, i, i * 2, "m") for i in range(50)]
