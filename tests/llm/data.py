"""Small tables with the odd cases: nulls, empty and long texts, repeated rows and ids, copies, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, `row` int, place int, position string"


def words(rng, n, vocabulary=300):
    return " ".join(f"w{int(rng.paretovariate(0.9)) % vocabulary}{'aeiou'[rng.randrange(5)]}" for _ in range(n))


def texts(seed=7, n=40):
    rng = random.Random(seed)
    shared = words(rng, 70)
    out = []
    for i in range(n):
        body = words(rng, rng.randrange(3, 120))
        if i % 4 == 0:
            body = f"{body}\n{shared}\n{words(rng, 5)}"
        if i % 7 == 0:
            body = f"é ß 漢字 {body} 😀"
        if i % 9 == 0:
            body = "The " * 120 + body
        if i % 5 == 0 and out:
            body = out[-1]
        if i % 11 == 3:
            body = out[-1].replace("w1", "W2", 1)
        out.append(body)
    return out


def rows():
    out = [(i, t, "en", "a" if i % 3 else "b", len(t), "x", 1, 2, "y") for i, t in enumerate(texts())]
    out += [(900, None, None, None, None, None, None, None, None), (901, "", "en", "a", 0, None, 1, 2, "y"), (902, " \n\t ", "en", "c", 4, None, 1, 2, "y"), (903, "x", None, "a", 1, None, 1, 2, "y")]
    out += [(None, "null id " + words(random.Random(1), 60), "en", "a", 5, None, 1, 2, "y"), (None, None, None, None, None, None, None, None, None)]
    out += [out[3], out[3], (3, "another text of the same id", "en", "a", 5, None, 1, 2, "y")]
    out.append((904, words(random.Random(2), 9_000), "en", "b", 5, None, 1, 2, "y"))
    return out


def table(spark, which=None):
    return spark.createDataFrame(rows() if which is None else which, SCHEMA).repartition(3)
