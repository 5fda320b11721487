"""The pipeline's stages on a small corpus that has every kind of document they act on."""

import random
import zlib

import corpus_pipeline as cp
from histograin.llm import token_ids as ti


def corpus(n=400):
    rng = random.Random(9)
    parts = {"aa": "ba be bi bo bu na ne".split(), "bb": "tro kel min dos vur gar pol".split()}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3)))
    text = lambda lang, k: " ".join(word(lang) for _ in range(k))
    rows, bench = [], text("aa", 30)
    for i in range(n):
        lang = "aa" if i % 3 else "bb"
        rows.append((i, text(lang, rng.randint(30, 90)), lang, f"s{i % 4 if i % 2 else 0}"))
    copy, near = rows[10], rows[11]
    words = near[1].split()
    rows += [(n, copy[1], copy[2], "s1"), (n + 1, " ".join([*words, "extra"]), near[2], "s2"), (n + 2, f"{text('bb', 40)} {bench} {text('bb', 40)}", "bb", "s1")]
    rows += [(n + 3, None, "aa", "s1"), (n + 4, "", None, None), (n + 5, "123 456", "aa", "s1"), (5, rows[5][1], rows[5][2], rows[5][3]), (None, text("aa", 40), None, "s3")]
    return rows, bench


def test_stages(spark, tmp_path):
    rows, bench = corpus()
    schema = "doc_id bigint, text string, lang string, source string"
    spark.createDataFrame([(*r, "own", "own") for r in rows], f"{schema}, slot string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in cp.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "token_ids":
            assert docs.columns == columns and all(r.slot == "own" and r.score == "own" for r in seen[name])
    n = 400
    ids = {name: [r.doc_id for r in own] for name, own in seen.items()}
    assert set(range(n + 3)) | {None} == set(ids["language_id"]) and len(ids["language_id"]) == n + 5
    assert all(r.lang for r in seen["language_id"])
    assert sorted(map(str, ids["jaccard_join"])) == sorted(map(str, [*range(n), n + 2, None]))
    assert sorted(map(str, ids["decontamination"])) == sorted(map(str, [*range(n), None]))
    assert set(ids["mixing"]) == set(ids["decontamination"])
    assert sorted(map(str, ids["token_ids"])) == sorted(map(str, ids["mixing"]))
    texts = {r.doc_id: r.text for r in seen["mixing"]}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(ti.tokenizer_path())
    for r in seen["token_ids"]:
        own = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.n_tokens, r.ids_crc32) == (len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)))
    ordered = sorted(seen["token_ids"], key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == ids["mixing"]  # the mixture's order


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_near_copies_of_the_dedup_stage(spark):
    rng = random.Random(4)
    words = lambda k: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(k)]
    a, b, c = words(200), words(200), words(200)
    rows = [(1, a), (2, a[:164]), (3, b), (4, [*b[:80], *words(17), *b[97:]]), (5, c), (6, c[:150])]  # 18 % cut off, 8.5 % replaced, 25 % cut off
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in cp.dedup_stage(spark, docs, "").collect()) == [1, 3, 5, 6]
