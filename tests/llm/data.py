"""Small made-up documents."""

import random

SYLLABLES = ["an", "the", "er", "ou", "st", "in", "ré", "que", "ß", "tion"]


def word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))


def text(r: random.Random, words: int, line: int = 12) -> str:
    return " ".join(word(r) + ("\n" if k % line == line - 1 else "") for k in range(words)).replace("\n ", "\n")


def documents(seed: int = 1, n: int = 40) -> list[tuple]:
    """(doc_id, text): random texts, copies, edited copies, and odd ones."""
    r = random.Random(seed)
    base = [text(r, r.randint(20, 90)) for _ in range(n // 2)]
    out = [(k * 3 - 9, t) for k, t in enumerate(base)]
    for k in range(n // 2):
        t = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            t[r.randrange(len(t))] = word(r)
        out.append((1000 + k, " ".join(t)))
    return [*out, (2000, None), (2001, ""), (2002, " \t\n "), (2003, "one"), (2004, "one two three"), (2005, "one two three"), (2006, text(r, 20_000, 400)), (2007, "x" * 50_000), (-5, base[0])]


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
