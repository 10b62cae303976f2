"""Documents with all that is odd: nulls, blanks, copies, near copies, shared passages, repeats, a long text."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(9999)}"
    return " ".join(words)


def texts(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("al", "Be", "cÿ", "do", "em", "fö") for b in ("ra", "si", "tu", "von", "x", "")]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, line = " ".join(some(60)), " ".join(some(9))
    out = [None, "", " \t\n", "one", "ONE", "one two", "one two.", "one\ttwo", "a b c", "a b c d e f g h i", "a b c d e f g h i j", "a b c d e f g h i j k"]
    for n in (12, 25, 40, 90, 200, 400):
        base = some(n)
        out += [" ".join(base), " ".join(base), "\n".join(base).upper()]
        out += [near(rng, base, k) for k in (1, 1, 1, 2, 3, n // 40, n // 25, n // 20, n // 10)]
    out += [f"{' '.join(some(rng.randrange(5, 150)))} {passage} {' '.join(some(rng.randrange(0, 150)))}" for _ in range(25)]
    out += [f"{line} {line} {line} {line} {line}", " ".join(["Ha"] * 70), f"{passage} {passage}", " ".join(some(9000)), " ".join(some(3000)) + passage, " nbsp is no blank \x1f here\x0b\x0c there"]
    rng.shuffle(out)
    return out


def documents(seed=0):
    """{doc_id: text}; ids aren't in the order of rows."""
    t = texts(seed)
    ids = list(range(len(t)))
    random.Random(seed + 1).shuffle(ids)
    return dict(zip(ids, t, strict=True))


def frame(spark, docs):
    return spark.createDataFrame([(d, t, None, None, None if t is None else len(t)) for d, t in docs.items()], SCHEMA).repartition(3)


CLASHING = ("row", "n_words", "n_hit", "items", "matches", "ids", "decoded", "n_tokens", "digest", "mark", "n", "kept_text", "n_removed", "score", "hits", "words", "density", "repeats", "__row", "__text", "__id", "__mark", "__n", "key", "block", "a", "b")


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING})
