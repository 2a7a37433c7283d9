"""Small corpora for the tests of the corpus operators."""

import random

WORDS = {
    "en": "the of and to is that was for are with his they this from have not but what all were when your can said there".split(),
    "de": "der die und den von das mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "e", "en", "s", "ou"]) for _ in range(n)) + "."


def corpus(n, seed=0, langs=("en", "de", "fr")):
    """(doc_id, text, lang, source, n_chars) rows of n documents, from one to 300 words."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(langs)
        text = "\n".join(sentence(rng, lang, rng.randint(1, 60)) for _ in range(rng.randint(1, 5)))
        out.append((i, text, lang, f"src{i % 3}", len(text)))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (900, None, None, None, None),
    (901, "", "en", "src0", 0),
    (902, "   \n\t ", "en", "src0", 6),
    (903, "1234 5678", "en", "src0", 9),
    (904, "x", None, "src0", 1),
    (905, "the of and " * 30_000, "en", "src0", 330_000),
    (906, "é" * 20_000, "fr", "src0", 20_000),
    (907, "the same text twice over", "en", "src0", 24),
    (908, "the same text twice over", "en", "src0", 24),
    (None, "no id at all for this one", "en", "src1", 25),
    (907, "the same text twice over", "en", "src0", 24),
]


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.selectExpr("*", "1 AS score", "'x' AS label", "2.5D AS length", "true AS kept", "7 AS key")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
