import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fingerprint string, start int, f0 string, media string, spans string"


def rows():
    """Texts with copies, near copies, shared passages, and every case that operators must define."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghiklmnoprstuéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(70)
    texts = [prose(rng.randint(1, 400)) for _ in range(40)]
    texts += [prose(20) + ". " + shared + " " + prose(15), shared, prose(40) + "\n" + shared + "\n", shared[40:] + prose(5)]
    texts += [texts[0], texts[1], texts[1], texts[2] + " tail", texts[3].replace(" ", "  ", 1), texts[4].upper()]
    texts += ["", " ", "\n\n", "x", "one two", "one two three", None, "a" * 5000, "ab " * 3000, "é" * 700, "日本 語の テキスト です。 " * 30, "👍🏽 x " * 80]
    texts += ["<|endoftext|> mid <|endoftext|><|startoftext|> end", "a b \t c\r\n d e  f \n\n g", " lead", "trail ", "12 345 ## $$", "Same line\nsame line\nSame line\n\nSame line", "q w e r t " * 30, "I'll we've x's DON'T"]
    texts += [prose(9000), (shared + " ") * 40]
    out = []
    for i, t in enumerate(texts):
        out.append((i * 7 % 1000, t, ["en", "de", None][i % 3], [None, "s1", "s1", "s1", "s2", "Z"][i % 6], len(t or ""), 5, "zz", 1, "f", "m", "s"))
    out += [out[5], out[5], (None, texts[7], "en", "s1", 1, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), (3, "same id other text " * 20, "en", "s1", 1, 1, "", 1, "", "", "")]
    return out


@pytest.fixture(scope="session")
def corpus():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
