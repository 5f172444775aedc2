"""Small tables with every awkward row, and plain versions of the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Doc_ID string, TEXT string"


def documents(spark):
    """Nulls, empty and blank texts, repeated rows, exact and near copies, a very long text, and clashing column names."""
    rnd = random.Random(7)
    vocab = ["alpha", "Beta", "gamma,", "delta", "über", "ñandú", "the", "of", "x1", "zeta!"] + [f"w{i}" for i in range(200)]
    base = [" ".join(rnd.choice(vocab) for _ in range(n)) for n in (3, 5, 12, 13, 40, 60, 120, 200)]
    texts = [None, "", "   \n\t ", "one", "one", "One two", *base, base[4], base[5].upper()]
    for _ in range(6):
        words = base[7].split()
        for _ in range(2):
            words[rnd.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts.append(" ".join(texts[10].split()[5:35] + ["tail"] * 3 + base[6].split()[10:30]))
    texts.append("long " * 3 + " ".join(rnd.choice(vocab) for _ in range(30_000)))
    texts += ["a" * 5000 + " mail: bob.a@ex-1.org, +1 (212) 555-0100; 10.0.0.255 4111 1111 1111 1111", "x\x0by\x0cz\r\n w"]
    rows = [(i * 3, t, None, None, None, "clash", "other") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r[0], r[1]) for r in df.collect()]
