"""Small document tables with nulls, ties, repeats, long texts and extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, ids string, n int, rank double"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n))


def rows():
    rng = random.Random(5)
    base = [words(rng, n) for n in (3, 4, 5, 6, 40, 80, 200, 3000)]
    texts = [None, "", " ", "\n\n", "a", "A  b\t c ", "x " * 50, "  lead", "tail  ", "a   b\u00a0 \x1c c\u2003 d", "0" * 400 + " +1 2"]
    texts += base
    texts += [base[5], base[5] + " tail", base[5].upper(), base[6].replace("a", "b", 3), base[4] + "\n" + base[5], base[4] + "\nother\n" + base[5]]
    texts += ["mail a.b@c.de, a@b@c.d_e@f.g 1.2.3.4 999.1.1.1 4111 1111-1111 1111 +1 (234) 555-0100 +12", "'s don't I'LL 12ab\r\n\u3000x"]
    out = []
    for i, t in enumerate(texts):
        out.append((i * 3, t, ["en", "de", None][i % 3], ["web", "web", "web", "book", None][i % 5], None, "s", "i", i, 0.5))
    out.append(out[12])  # a repeated row
    out.append((None, base[3], None, None, 7, None, None, None, None))
    out.append((None, base[7], "en", "book", 7, None, None, None, None))
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
