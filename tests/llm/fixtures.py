"""Small tables with the awkward cases that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, _id long, chunk long, target double, host string, bands string"
PAGES = "page_id long, url string, html string, host string, verdict string, _to string"


def text(rnd, n):
    return " ".join("".join(rnd.choices("abcdeéß", k=rnd.randint(1, 7))) for _ in range(n))


def documents(seed=3, n=60):
    rnd = random.Random(seed)
    rows = [(i, text(rnd, rnd.choice((0, 1, 4, 30, 120))), rnd.choice(("en", "fr", None)), rnd.choice(("a", "b", None, "é")), None) for i in range(n)]
    passage = text(rnd, 60)
    rows += [(n + i, rows[i][1], "en", "a", 1) for i in range(0, 20, 3)]
    rows += [(2 * n + i, passage + " " + text(rnd, 3 + i), "fr", "b", 1) for i in range(6)]
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (902, " \n\t", "en", "b", 3), (903, "x" * 5000, "en", "a", 1), (904, "ab " * 3000, "en", "a", 1)]
    rows += [rows[5], rows[5], (None, "no id at all here, only words", "en", "a", 1), (903, "another text under the same id", "en", "a", 1)]
    return [(*r, 7, "k", 1, 2, 0.5, "h", "b") for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def small(rows):
    """Rows (doc_id, text) with all other columns filled in."""
    return [(d, t, "en", "a", 0, 7, "k", 1, 2, 0.5, "h", "b") for d, t in rows]
