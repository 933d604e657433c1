"""Small corpora with the awkward cases every operator has to survive."""

import random

import duckdb

WORDS = [a + b for a in "ka lo mi tu re sa ne vo pi du".split() for b in "ran tel min sor dak lit".split()]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def lined(words, per=12):
    return "\n".join(" ".join(words[i : i + per]) for i in range(0, len(words), per))


def near_copies(seed=1, families=12, singles=30):
    """Texts with exact and near copies, a shared passage and short ones."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = [None, "", "   \n", "one", "one", "one two", "ONE two", "a b c d e", "a b c d e f"]
    for f in range(families):
        base = prose(rng, rng.choice([5, 7, 9, 14, 30, 80, 200, 400]))
        for _ in range(rng.choice([1, 2, 6])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, len(t) // 60])):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            texts.append(lined(t))
    for _ in range(singles):
        texts.append(lined(passage + prose(rng, 60)))
        texts.append(lined(prose(rng, rng.choice([3, 6, 20, 90]))))
    rng.shuffle(texts)
    return texts


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[k], t, "en", "src", k) for k, (i, t) in enumerate(enumerate(texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def table(sf, name):
    return duckdb.sql(f"select * from '{sf}/{name}.parquet'").fetchall()
