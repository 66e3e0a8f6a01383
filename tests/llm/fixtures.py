"""Small tables with the awkward rows that every operator has to bear."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, n string, score double, t1 string, kept string, unit int, bucket int, node string"


def awkward(spark, seed=3):
    """Nulls, empty, blank, very long, repeated, near and exact copies, shared passages, columns with clashing names."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    passage = " ".join(word() for _ in range(80))
    base = [" ".join(word() for _ in range(r.choice([3, 4, 5, 6, 40, 120]))) for _ in range(30)]
    texts = [*base, *base[:6], None, None, "", "", "   \n", "É" * 7, "a", "\U0001f600 x"]
    for i in range(8):
        words = base[0].split() + (" ".join(word() for _ in range(150))).split()
        texts.append(" ".join(words))
        near = list(words)
        near[r.randrange(len(near))] = word()
        texts.append(" ".join(near))
        texts.append(" ".join(word() for _ in range(20)) + " " + passage + " " + word())
    texts.append(" ".join(word() for _ in range(30_000)))
    texts.append("xyz " * 500)
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "k", "n", 0.1, "t", "kept", 1, 2, "node") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[45]]
    r.shuffle(rows)
    return spark.createDataFrame(rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)
