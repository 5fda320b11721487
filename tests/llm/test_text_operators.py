"""Operators 1, 2, 3, 5 and 6 against plain versions."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from histograin.llm import decontaminate as dec
from histograin.llm import language_id as lid
from histograin.llm import lm_score as lm
from histograin.llm import quality as q
from histograin.llm import token_counts as tc
from histograin.llm.common import fresh_path

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain_decontaminate(rows, items, window):
    grams = {}
    for item, text in items:
        w = bench_words(text)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[at : at + window]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = bench_words(text), set(), set()
        for n in {len(g) for g in grams}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in grams:
                    hit |= set(range(at, at + n))
                    found |= {str(i) for i in grams[tuple(w[at : at + n])] if i is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_decontaminate_like_plain(spark, corpus, odd_rows, odd, block_bytes):
    rng = random.Random(3)
    items = [(None, "nobody owns this"), (900, ""), (901, None), (902, "!!! ...")]
    for i in range(40):
        w = rng.choice(corpus)[1].split()
        at = rng.randrange(len(w))
        items.append((i, " ".join(w[at : at + rng.choice([2, 9, 10, 25])]).upper()))
    items += [(50, "one two three four one two"), (51, corpus[0][1]), (51, corpus[0][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for rows, docs in ((corpus, spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(3)), ([r[:2] for r in odd_rows], odd)):
        got = dec.decontaminate(docs, benchmark, block_bytes=block_bytes).collect()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(plain_decontaminate(rows, items, 10), key=key)
        assert all(sum(s.end - s.begin for s in r.spans) == r.n_hit for r in got)
        clean = dec.decontaminate(docs, benchmark, clean=True)
        assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in got)


def test_decontaminate_empty(spark, odd, none):
    benchmark = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert dec.decontaminate(none, benchmark).count() == 0
    assert {r.n_hit for r in dec.decontaminate(odd, benchmark.limit(0)).collect()} == {0}


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 3000)
    text[rng.choice(3000, 40, replace=False)] = 0
    text[-1] = 0
    index = dec.FMIndex(text.copy(), 4)
    for n in (1, 3, 7):
        windows = np.unique(rng.integers(1, 4, (60, n)), axis=0)
        lo, hi = index.search(windows)
        rows, of = dec.ranges(lo, hi)
        found = {(int(k), int(p)) for k, p in zip(of, index.locate(rows), strict=True)}
        assert found == {(k, p) for k, w in enumerate(windows) for p in range(len(text) - n + 1) if (text[p : p + n] == w).all()}


def plain_scores(rows, order, min_count, backoff, by=None):
    split = lambda rows: [SPACE.findall((t or "").translate(LOW)) for _, t in rows]
    texts, known = split(rows), split(by or rows)
    counts = Counter(tuple(w[i : i + n]) for w in known for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, known))
    out = []
    for (doc, _), w in zip(rows, texts, strict=True):
        s = 0.0
        for i in range(len(w)):
            n = min(order, i + 1)
            penalty = 0.0
            while n > 1 and counts[tuple(w[i - n + 1 : i + 1])] < min_count:
                n, penalty = n - 1, penalty + math.log(backoff)
            g = tuple(w[i - n + 1 : i + 1])
            s += penalty + math.log(max(counts[g], 1) / (counts[g[:-1]] if n > 1 else total))
        out.append((doc, len(w), round(s, 6)))
    return out


@pytest.mark.parametrize(("order", "min_count", "fan"), [(1, 1, 1024), (2, 2, 1024), (3, 1, 1024), (3, 2, 3), (4, 1, 2)])
def test_lm_scores_like_plain(spark, corpus, odd_rows, odd, order, min_count, fan):
    """A small fan-out makes rows pass two exchanges each way."""
    key = lambda r: tuple(str(x) for x in r)
    for rows, docs in ((corpus, spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(3)), ([r[:2] for r in odd_rows], odd)):
        got = lm.score(docs, order=order, min_count=min_count, run_bytes=2000, partition_bytes=5000, fan=fan).collect()
        assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got), key=key) == sorted(plain_scores(rows, order, min_count, 0.4), key=key)


def test_lm_query_like_plain(spark, corpus, odd_rows, tmp_path):
    rows = [*corpus, *[r[:2] for r in odd_rows]]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: tuple(str(x) for x in r)
    got = lm.op2_lm_scoring(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 5)) for r in got), key=key) == sorted(((d, n, round(s, 5)) for d, n, s in plain_scores(rows, 3, 1, 0.4)), key=key)


@pytest.mark.parametrize("fan", [1024, 2])
def test_lm_scores_by_another_corpus(spark, corpus, odd_rows, odd, fan):
    """Count tables are written partitioned by hash, and other documents joined to them back off."""
    key, at = lambda r: tuple(str(x) for x in r), fresh_path(spark, "test-tables")
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(3)
    own = lm.score(docs, run_bytes=2000, partition_bytes=5000, fan=fan, tables=at).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in own), key=key) == sorted(plain_scores(corpus, 3, 1, 0.4), key=key)
    table = spark.read.parquet(f"{at}/order=2").collect()
    words = [SPACE.findall(t.translate(LOW)) for _, t in corpus]
    assert sum(int(lm.unpack(r.totals).sum()) for r in table) == sum(max(0, len(w) - 1) for w in words)
    hashes = {r.part: lm.unpack_sorted(r.hashes) for r in table}
    assert len(hashes) > 5 and all((lm.partition_of(h, 1 + max(hashes)) == p).all() for p, h in hashes.items()) and len({int(x) for h in hashes.values() for x in h}) == len({g for w in words for g in zip(w, w[1:], strict=False)})
    got = lm.score(odd, run_bytes=2000, fan=fan, by=at).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got), key=key) == sorted(plain_scores([r[:2] for r in odd_rows], 3, 1, 0.4, corpus), key=key)


def test_lm_packing_keeps_64_bits():
    rng = np.random.default_rng(3)
    for x in (np.array([], dtype=np.int64), np.array([0]), np.array([5_000_000_000, 1, 0, 1 << 62]), rng.integers(0, 1 << 40, 1000)):
        assert (lm.unpack(lm.pack(x)).view(np.int64) == x).all()
    hashes = np.unique(rng.integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert (lm.unpack_sorted(lm.pack_sorted(hashes)) == hashes).all()
    two = np.concatenate([hashes, hashes])  # sections of a bundle begin anew
    assert (lm.unpack_sorted(lm.pack_sorted(two)) == two).all()


def test_lm_scores_empty(none):
    assert lm.score(none).count() == 0


def test_language_spans_and_held_out(spark):
    rng = random.Random(2)
    parts = {"aa": "ba be bi bo bu".split(), "bb": "tro kel min dos vur".split(), "cc": "жу ка ло ми".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(list(parts) * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = lid.fit(docs.where(~lid.held_out()))
    got = {r.doc_id: r for r in lid.identify(docs, model, spans=True).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and all(0 <= r.score <= 1 for r in got.values())
    a, b, c = text("aa", 30), text("bb", 25), text("cc", 20)
    mixed = lid.identify(spark.createDataFrame([(1, f"{a}, {b}. {c}")], "doc_id bigint, text string"), model, spans=True).first()
    assert [s.lang for s in mixed.lang_spans] == ["aa", "bb", "cc"]
    assert [(s.begin, s.end) for s in mixed.lang_spans] == [(0, len(a)), (len(a) + 2, len(a) + len(b) + 2), (len(a) + len(b) + 4, len(a) + len(b) + len(c) + 4)]


def plain_language(model, text):
    """Word by word in plain Python: scripts, trigram scores, and the best path by dynamic programming."""
    words, own = [], []
    for c in text or "":
        if unicodedata.category(c)[0] in "LM":
            own.append(c)
        elif own:
            words.append("".join(own))
            own = []
    words += ["".join(own)] if own else []
    letters = [sum(unicodedata.category(c)[0] == "L" for c in w) for w in words]
    if not sum(letters):
        return "und", 0.0
    kind, _ = lid._tables()
    low = lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c)
    best, back = None, []
    for w in words:
        at = [32, *map(low, w), 32]
        scores = np.zeros(len(model.langs), dtype=np.float32)
        for x, y, z in zip(at, at[1:], at[2:], strict=False):
            h = (y * 0xC2B2AE3D + x * 0x9E3779B1 + z * 0x165667B1) % (1 << 32)
            h = (h ^ (h >> 15)) * 0x85EBCA77 % (1 << 32)
            scores += model.log[:, h >> 16]
        able = model.uses[kind[ord(w[0])]]
        scores = np.where(able | (not able.any()), scores, scores - 1e4)
        if best is None:
            best = scores.astype(float)
            continue
        top = int(best.argmax())
        from_ = [k if best[k] >= best[top] - lid.SWITCH else top for k in range(len(best))]
        back.append(from_)
        best = np.array([max(best[k], best[top] - lid.SWITCH) for k in range(len(best))]) + scores
    path = [int(best.argmax())]
    for from_ in reversed(back):
        path.append(from_[path[-1]])
    sums = np.zeros(len(model.langs))
    for k, n in zip(reversed(path), letters, strict=True):
        sums[k] += n
    return model.langs[int(sums.argmax())], sums.max() / sums.sum()


def test_language_query_like_plain(spark, tmp_path, odd_rows):
    """The query against a plain predictor, on learnt, mixed, odd and letterless texts; lang and doc_id of a row don't matter to it."""
    rng = random.Random(12)
    parts = {"aa": "ba be bi bo bu ga".split(), "bb": "tro kel min dos vur ba".split(), "cc": "жу ка ло ми ба".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(1, 60)), lang) for i, lang in enumerate(list(parts) * 60)]
    rows += [(1000 + i, ". ".join(text(rng.choice(list(parts)), rng.randint(1, 12)) for _ in range(6)), None) for i in range(60)]
    rows += [(2000, "\u0301\u0302", None), (2001, "12 \u0301", None), (2002, chr(0x32001) * 3, None), (2003, "\u0301a", None), (2004, None, "aa"), (2005, "", "aa")]
    rows += [(None if d is None else 3000 + d, t, None) for d, t, *_ in odd_rows]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = lid.op3_language_id(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = lid.fit(docs.where(docs.doc_id.isNotNull() & ~lid.held_out()))
    key = lambda r: tuple(map(str, r))
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    want = [(d, held(d), *plain_language(model, t)) for d, t, _ in rows]
    assert sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in got), key=key) == sorted(((d, h, x, round(s, 6)) for d, h, x, s in want), key=key)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (2000, 2001, 2004, 2005)] == ["und"] * 4 and by[2002].lang_pred != "und" and by[2003].lang_pred != "und"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    scores = (rng.normal(size=(18, 3)) * 15).astype(np.float32)
    bounds = np.array([0, 5, 5, 11, 12, 18])
    got = lid._viterbi(scores, bounds)
    value = lambda s, p: sum(float(s[i, k]) for i, k in enumerate(p)) - lid.SWITCH * sum(x != y for x, y in zip(p, p[1:], strict=False))
    import itertools

    for a, b in zip(bounds, bounds[1:], strict=False):
        best = max((value(scores[a:b], p) for p in itertools.product(range(3), repeat=int(b - a))), default=0)
        assert value(scores[a:b], got[a:b].tolist()) == pytest.approx(best)


def test_language_of_odd_rows(odd, none, odd_rows):
    model = lid.fit(odd)
    got = lid.identify(odd, model).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(got) == len(odd_rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert lid.fit(none) is None
    assert {r.lang_pred for r in lid.identify(odd, None).collect()} == {"und"} and lid.identify(none, model).count() == 0


def plain_tokens(lex, word):
    best = {0: (0.0, 0)}
    for j in range(1, len(word) + 1):
        n = len(word[j - 1].encode())
        options = [(best[j - 1][0] + n * lex.byte, -(best[j - 1][1] + n))]
        options += [(best[i][0] + lex.scores[word[i:j]], -(best[i][1] + 1)) for i in range(max(0, j - 64), j) if word[i:j] in lex.scores]
        s, c = max(options)
        best[j] = (s, -c)
    return best[len(word)][1]


def test_token_counts_like_plain(spark, odd_rows, odd, none, corpus):
    lex = tc.Lexicon.load(tc.vocabulary_path())
    rows = [r[:2] for r in odd_rows] + corpus
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = sorted((str(d), len(w), sum(plain_tokens(lex, tc.BEGIN + x) for x in w)) for d, t in rows for w in [SPACE.findall(t or "")])
    assert sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in tc.count_tokens(docs, tc.vocabulary_path()).collect()) == expected
    assert tc.count_tokens(odd, tc.vocabulary_path()).count() == len(odd_rows) and tc.count_tokens(none, tc.vocabulary_path()).count() == 0


def plain_statistics(text):
    text = text or ""
    w = SPACE.findall(text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    inside = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def test_quality_base_like_plain(spark, odd_rows, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, 0), (5, None, None), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    rng = random.Random(8)
    made = [(i, "\n".join(rng.choice(["a b c d e f g h", "# $ one", "x <y> |", "", "é ü 12"]) for _ in range(rng.randint(0, 40))), None, None) for i in range(20, 60)]
    for rows, docs in ((odd_rows, odd), (made, spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string"))):
        got = q.judge(docs, labels).collect()
        plain = sorted((str(r[0]), *plain_statistics(r[1])) for r in rows)
        assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == plain
        assert not any(r.kept for r in got if r.base_failed)
    assert q.judge(none, labels).count() == 0
    assert all(r.kept != r.base_failed for r in q.judge(odd, labels.limit(0)).collect())


def plain_rates(text):
    w = SPACE.findall(text)
    chars, lines = sum(map(len, w)), sum(bool(SPACE.search(x)) for x in text.split("\n"))
    n, c = max(len(w), 1), max(chars, 1)
    share = lambda kind: sum(map(kind, text)) / c
    punct = lambda x: x.isascii() and x.isprintable() and not x.isalnum() and x != " "
    return (chars / n, sum(x in "#*$%&|<>" for x in text) / n, share(lambda x: "A" <= x <= "Z"), share(lambda x: "0" <= x <= "9"), share(punct), min(len(w) / max(lines, 1), 400), len(set(w)) / n / n**-0.12)


def plain_score(forest, x):
    """Mean path length of one row, tree by tree and node by node."""
    total = 0.0
    for feature, value, left, right, length in forest.trees:
        node = 0
        while feature[node] >= 0:
            node = left[node] if x[feature[node]] < value[node] else right[node]
        total += length[node]
    n = forest.rows
    return 2.0 ** (-(total / len(forest.trees)) / (2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n))


def test_quality_verdicts_like_plain(spark, tmp_path):
    """kept, of the query: base rules, then the forest's score against the threshold that labelled rows give, all in plain Python."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    prose = lambda: "\n".join(" ".join(word() for _ in range(rng.randint(8, 14))).capitalize() + "." for _ in range(rng.randint(3, 9)))
    junk = lambda: " ".join(rng.choice(["$$$", "BUY", "4821", "<<>>", "NOW!!!", "77%", word()]) for _ in range(rng.randint(25, 80)))
    rows = [(i, junk() if i % 11 == 0 else prose()) for i in range(330)] + [(400, None), (401, "too short"), (402, "a b c d e f g h i j " * 9), (None, prose()), (0, junk())]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0 if i % 11 == 0 else 1, 0) for i in range(0, 330, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = q.op6_quality_rules(spark, str(tmp_path)).collect()
    x = {k: np.array(plain_rates(t or "")) for k, (_, t) in enumerate(rows)}
    passed = [k for k, (_, t) in enumerate(rows) if not plain_statistics(t)[-1]]
    sample = np.array([x[k] for k in passed])
    forest = q.IsolationForest(sample[np.lexsort(sample.T)])
    score = {k: plain_score(forest, x[k]) for k in passed}
    quality = {i: v for i, v, _ in labels}
    good, bad = ([score[k] for k in passed if quality.get(rows[k][0]) == v] for v in (1, 0))
    at = sorted({*good, *bad})
    cost = {t: sum(g > t for g in good) / len(good) + sum(b <= t for b in bad) / len(bad) for t in at if sum(g > t for g in good) / len(good) <= q.LOST_GOOD}
    best = max(t for t in cost if cost[t] == min(cost.values()))
    threshold = (best + at[at.index(best) + 1]) / 2 if best != at[-1] else best
    expected = sorted((str(d), k in score and score[k] <= threshold) for k, (d, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.kept) for r in got) == expected
    assert sum(not v for d, v in expected if d.isdigit() and int(d) % 11 == 0) > 25 and sum(v for _, v in expected) > 290


def test_forest_and_threshold_of_all_rows(spark):
    """More rows than a sample of 20,000 held: trees draw from all of them, all labelled rows make the threshold."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(30_000, len(q.RATES))), 2)
    stats = spark.createDataFrame(pd.DataFrame(x, columns=q.RATES)).repartition(7)
    forest, plain = q.grown(stats), q.IsolationForest(x[np.lexsort(x.T)])
    assert all(np.array_equal(a, b) for own, other in zip(forest.trees, plain.trees, strict=True) for a, b in zip(own, other, strict=True))
    for size, share in ((30_000, 0.3), (30_000, 0.0), (30_000, 1.0), (0, 0.0)):
        score, bad = np.round(rng.normal(size=size), 3), rng.random(size) < share
        score[bad] += 2
        frame = spark.createDataFrame(pd.DataFrame({"quality": np.where(bad, 0, 1), "anomaly": score}), "quality int, anomaly double").repartition(5)
        assert q.threshold_of(frame) == q.calibrate(score, ~bad)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(2000, 3)), rng.normal(size=(20, 3)) + 8])
    score = q.IsolationForest(x).score(x)
    assert score[2000:].min() > np.quantile(score[:2000], 0.98)
    assert q.calibrate(score, np.arange(len(x)) < 2000) < score[2000:].min()
    assert q.calibrate(score, np.zeros(len(x), dtype=bool)) == np.inf
