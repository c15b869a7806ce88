"""Documents that operators have to bear: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, sig string, component_id string, _sw_hits string, h long, seed string"
WORDS = "the of and river stone quiet lamp gpl license apache mit cc by gnu general public écran élan straße 123 x1 moon tide".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ".", ",", "\n", "!!"]) for _ in range(n))


def documents(spark, n=40, seed=5):
    rnd = random.Random(seed)
    base = prose(rnd, 120)
    texts = [None, "", " \n\t ", "one", "One", "  a  b\n\nc ", "é́ ß ﬁ 漢字 中文   \x1c\x0b \xa0x", "a" * 3000, "<|endoftext|> <|im_end|> \\ \\| <|", "Permission 'tis don't we'll", base, base, base.upper(), prose(rnd, 20000), base + " " + prose(rnd, 60), "x " + base]
    texts += [prose(rnd, rnd.randrange(1, 200)) for _ in range(n)]
    rows = [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["s0", "s1", None]), None if t is None else len(t), True, "q", "z", "w", 1, "s") for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, base, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
