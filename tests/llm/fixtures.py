"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, fp long, row int, spans string, length int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["lorem", "ipsum", "Dolor", "sit", "amet,", "über", "naïve", "x1", "the", "of"]) + r.choice(["", "a", "be", "co"]) for _ in range(n))


def rows():
    passage = words(120, 99)
    texts = [
        None, "", " ", "a", words(30, 1), words(30, 1), words(400, 2), words(400, 2) + " tail", words(200, 3) + "\n" + passage + "\n" + words(90, 4), passage, "x " + passage + words(50, 5),
        "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "cc by cc by cc, by", "This work is licensed under the GNU General Public License, version 3.", words(4000, 6), "ab" * 700, "z" * 900,
        "  two  spaces\t\ttabs\n\n\nlines  ", "😀 emoji é \x00 nul ▁ mark <|endoftext|> </s>", "\u200b\u3000 unusual\u2003spaces ½ ² ꯍ",
    ]
    out = [(k, t, "en", "s", None if t is None else len(t), 1, 2, 3, "x", 4) for k, t in enumerate(texts)]
    out.append((4, texts[4], "en", "s", 1, 1, 2, 3, "x", 4))  # a repeated row
    out.append((None, "no id here", None, None, None, None, None, None, None, None))
    return out


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)
