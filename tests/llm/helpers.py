"""Small document tables for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that other operators use inside; they must not get in the way.
CLASHING = ", row string, chunk string, word string, mask string, maybe string, sha string, fp string, key string, block string, score string"


def docs(spark, texts, clashing=False, sources=None):
    """Documents numbered from 1; `texts` may hold (id, text) pairs."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts, 1)]
    data = [(i, t, "en", (sources or {}).get(i, "s1"), len(t or "")) for i, t in pairs]
    if clashing:
        return spark.createDataFrame([(*d, *["x"] * 10) for d in data], DOCS + CLASHING)
    return spark.createDataFrame(data, DOCS)


#: Texts with every odd case: null, empty, white space, repeats, a very long one, one word, letters of several scripts.
ODD = [
    None, "", " \t\n", "one", "one", "The same line twice. The same line twice.", "The same line twice. The same line twice.", "é, É ß 日本 😀",
    "a\x1cb\x00c", " ".join(f"w{i % 997}" for i in range(30_000)), "x" * 5000, "!!! ??? ...", "ab cd",
]


def random_texts(n, seed=1, vocabulary=400, length=(0, 120)):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiourstlnmd") for _ in range(rng.randint(1, 9))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(*length))) for _ in range(n)]
