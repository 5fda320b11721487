"""The registered queries on small tables that have every odd kind of row: against their SQL, and against their contracts."""

import hashlib
import json
import random
import zlib

import pytest

from histograin.llm import queries as Q
from histograin.llm import token_counts as tc
from histograin.llm import token_ids as ti

COLUMNS = {
    "op1": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2": "doc_id n_words log_score mean_log_score",
    "op3": "doc_id held_out lang_pred score",
    "op4": "doc_id size text_crc32 law shard slot grown_shard",
    "op5": "doc_id n_pretokens n_tokens",
    "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7": "doc_id n_shingles component_id",
    "op8": "doc_id source slot place block epoch",
    "op9": "page_id payload_bytes payload_digest record_type refers_to",
    "op10": "doc_id start n_tokens ids_crc32",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, corpus, odd_rows):
    """Documents with ids of their own, null, empty, blank, long and equal texts, null sources and langs, and columns that clash."""
    rng, root = random.Random(17), str(tmp_path_factory.mktemp("tables"))
    texts = [t for _, t in corpus] + [t for _, t, *_ in odd_rows]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), f"own{i}") for i, t in enumerate(texts)]
    items = [(i, " ".join(rng.choice(texts[:40]).split()[:30])) for i in range(12)] + [(90, None), (91, "  "), (92, "Three; four")]
    pages = [(i, f"http://x/{i}", rng.choice(["<p>" + "long " * 300, "<p>short", None, "<p>" + "y" * 999, f"<p>{i}" + "z" * 1200])) for i in range(60)]
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/{name}.parquet")
    save("documents", rows, "doc_id bigint, text string, lang string, source string, n_words string")
    save("benchmark", items, "item_id bigint, text string")
    save("labels", [(i, int(i % 7 > 0), 0) for i in range(0, 60, 2)] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    save("pages", pages, "page_id bigint, url string, html string")
    return root, rows


def told(rows):
    clean = lambda x: None if x is None or x != x else round(x, 6) if isinstance(x, float) else x
    return sorted(str([clean(x) for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, tables, name):
    root, rows = tables
    out = Q.queries()[name](spark, root)
    assert out.columns[: len(own)] == own if (own := COLUMNS[name.split("_")[0]].split()) else True
    got = out.collect()
    if name in Q.oracle_sql():
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in ("documents", "benchmark", "labels", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet/*.parquet')")
        result = con.execute(f"SELECT {', '.join(out.columns)} FROM ({Q.oracle_sql()[name]})").fetchall()
        assert told(got) == told(result)
    else:
        assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    if name.startswith("op5"):
        lex = tc.Lexicon.load(tc.vocabulary_path())
        count = lambda w: lex.counts([tc.BEGIN + w])[0]
        texts = {d: t.split() if t else [] for d, t, *_ in rows}
        assert all((r.n_pretokens, r.n_tokens) == (len(w := [x for x in texts[r.doc_id] if x]), sum(map(count, w))) for r in got if len(texts[r.doc_id]) < 1000)
    if name.startswith("op10"):
        from tokenizers import Tokenizer

        library, before = Tokenizer.from_file(ti.tokenizer_path()), 0
        for (d, t, *_), r in zip(rows, sorted(got, key=lambda r: r.doc_id), strict=True):
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, before, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
            before += len(ids)


def test_contract_of_decontamination(spark, tables):
    """The items of a document, as strings in their order, make the digest."""
    root, rows = tables
    got = {r.doc_id: r for r in Q.queries()["op1_decontamination"](spark, root).collect()}
    clean = [r for r in got.values() if not r.contaminated]
    assert clean and all((r.n_hit, r.n_items, r.items_sha256) == (0, 0, hashlib.sha256(b"").hexdigest()) for r in clean)
    assert any(r.n_items > 1 for r in got.values()) and json.dumps(sorted(got)) == json.dumps([r[0] for r in rows])
