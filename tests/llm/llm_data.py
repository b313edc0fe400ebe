"""Small documents with every awkward case."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, h int, bin int, key array<string>, label string, id string"


def prose(draw, n):
    return " ".join(draw.choice(["the", "of", "Tion", "anre", "été", "straße", "日本", "in x", "It's", "12", "a.b,"]) + draw.choice(["", "er", "st", "ing"]) for _ in range(n))


def documents(seed=1):
    """[(doc_id, text, lang, source)] with nulls, empty and long texts, copies, near copies,
    shared passages and lines, repeated rows and ids."""
    draw = random.Random(seed)
    passage, line = prose(draw, 60), "A line that Many documents share, over forty characters"
    base = [prose(draw, draw.randint(1, 200)) for _ in range(30)]
    rows = [(i, t, draw.choice(["en", "de", None]), draw.choice(["a", "b", "Z", "é", None])) for i, t in enumerate(base)]
    n = len(rows)
    rows += [(n + i, base[i % 3], "en", "a") for i in range(12)]  # exact copies
    rows += [(50 + i, base[4] + f" x{i}", "de", "b") for i in range(8)]  # near copies
    rows += [(70 + i, prose(draw, 30) + " " + passage + "\n" + prose(draw, 20), "en", "b") for i in range(6)]
    rows += [(80 + i, prose(draw, 15) + "\n  " + (line if i % 2 else line.upper()) + "\t\nend\n", "en", None) for i in range(7)]
    rows += [(90, None, None, None), (91, "", "en", "a"), (92, " \n\t\r\n", "en", "a"), (93, "one", "en", "a"), (94, "two words", "de", "Z")]
    rows += [(95, prose(draw, 5000) + "\n" + line, "en", "b"), (96, "x" * 9000, "en", "b"), (97, "ab cd ef " * 400, "en", "b"), (98, line, None, "a")]
    rows += [(None, base[5], "en", "a"), (None, passage, None, None), (None, None, None, None)]
    rows += [(3, base[3], "en", "a"), (3, base[3], "en", "a"), (7, base[8] + " other", "en", "b"), (-5, "\x1c odd \x85 <|endoftext|> | # & marks\x00", "en", "a")]
    return rows


def frame(spark, rows=None):
    """With columns whose names operators use themselves."""
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), 7, "f", 1, 2, ["k"], "l", "i") for d, t, lang, s in rows], SCHEMA).repartition(3)
