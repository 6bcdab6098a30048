"""A small corpus with planted copies, passages, lines, benchmark windows and odd rows."""

import random


def words(r: random.Random, n: int) -> list[str]:
    # blanks inside: capital letters, accents, characters beyond the first plane
    return ["".join(r.choice(["an", "er", "The", "on", "é", "ü", "𝄞", "st", "qu"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def documents(seed: int = 1, n: int = 90) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars)"""
    r = random.Random(seed)
    texts: list[str | None] = [" ".join(words(r, r.randint(1, 260))) for _ in range(n)]
    passage, common = " ".join(words(r, 60)), " ".join(words(r, 12))
    for i in range(10, 20):
        texts[i] = texts[9]  # exact copies
    base = words(r, 200)
    for i in range(20, 34):  # near copies of one text
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(200)] = "X" + str(i)
        texts[i] = " ".join(own)
    for i in range(34, 50):
        texts[i] = f"{' '.join(words(r, 30))} {passage} {' '.join(words(r, r.randint(0, 40)))}"
    for i in range(50, 60):
        texts[i] = "\n".join([" ".join(words(r, 9)), common, " ".join(words(r, 9)), common[:-1], "", common])
    texts[60:68] = [None, "", " \t\n ", "a", "a b c d", "a b c d e", "the the " * 400, "the the " * 300]
    texts[68] = texts[69] = " one two three\x85four five six"
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "c", None, ""][i % 5] if i % 4 else "a", len(t or "")) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


#: Lower-casing that leaves all but A-Z alone, as the operators do.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
