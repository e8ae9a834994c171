"""Small documents with every awkward case, and clashing extra columns."""
from __future__ import annotations

import random

WORDS = "the of and river stone light water green house walk sing small bright quiet never always".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


def documents(spark, extra: list[tuple] = (), seed: int = 1):
    """doc_id, text, lang, source, n_chars and columns whose names the operators use inside."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    shared = prose(rng, 60)
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(rng, 80)), (5, None), (6, ""), (7, "one two"), (8, "one two"),
        (9, prose(rng, 40) + " " + shared + " " + prose(rng, 40)), (10, shared + "\n" + prose(rng, 30)), (None, prose(rng, 50)),
        (None, None), (11, base), (11, base), (12, " \n\t "), (13, "é日本 " * 50 + "x" * 3000), (14, "ab" * 400), *extra,
    ]
    full = [(i, t, "en" if (i or 0) % 2 else None, "src" if (i or 0) % 3 else None, len(t or ""), 7, "k", 1.5, [1]) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, digest int, kept string, rid double, spans array<int>")


def nothing(spark):
    return documents(spark).limit(0)
