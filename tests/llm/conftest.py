import random

import pytest

SYLLABLES = "an be con de er fi go ha in jo ka lo mi no ou pa qui re sa ti".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    base = " ".join(words(rng, 120))
    long = " ".join(words(rng, 60_000))
    return [
        (1, base, "en", "a"),
        (1, base, "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n ", "en", "b"),
        (5, long, "fr", "a"),
        (6, "One TWO three; four.\nOne TWO three; four.\n", "en", "b"),
        (7, base + " extra", "fr", "b"),
        (None, base, None, "a"),
        (None, None, None, None),
        (8, "12 34 !! ??", "en", "c"),
        (9, "übung Größe naïve Жук 中文 <|endoftext|> it's", "de", "c"),
        (10, "x" * 3000, "en", "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with further columns that have the operators' own names."""
    names = "score slot place block epoch bucket shard lang_pred lang_spans n_words component_id key run part tie rep d1 digest payload row_of_text__ spans".split()
    rows = [(*r, None if r[1] is None else len(r[1]), *[f"own{i}" for i in range(len(names))]) for r in odd_rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): random texts, exact and near copies, shared passages."""
    rng = random.Random(11)
    passage = words(rng, 60)
    out = []
    for _ in range(60):
        own = words(rng, rng.randint(3, 150))
        if rng.random() < 0.4:
            at = rng.randint(0, len(own))
            own = own[:at] + passage + own[at:]
        out.append(own)
        for _ in range(rng.choice([0, 0, 1, 4])):
            near = list(own)
            for _ in range(rng.randint(0, 1 + len(near) // 40)):
                near[rng.randrange(len(near))] = rng.choice(SYLLABLES)
            out.append(near)
    rng.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)]
