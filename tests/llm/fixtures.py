"""Small documents with the cases that every operator must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, of: int = 400) -> str:
    return " ".join(f"w{rng.randrange(of)}x" for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    """Clean texts, exact and near copies, repeated lines and passages, nulls in every column, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    texts = ["\n".join(words(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 5))) for _ in range(25)]
    line = words(rng, 12)
    texts += [texts[0], texts[1], texts[0] + " end", texts[2].replace("w1", "v1", 1)]
    texts += [f"{texts[3]}\n{line}", f"{texts[4]}\n{line}", f"{line} more", line.upper(), f"{line}\n{line}"]
    shared = words(rng, 120)
    texts += [f"{texts[5]}\n{shared}", f"{shared} {texts[6]}", f"x {shared}\ny {shared}"]
    texts += ["", " ", "\n\n", None, "a", "é ü 漢字 🙂 a b c d e f g h i j", "*** ### | $$$ %%% " * 8, "same same same same same same same same same same same", words(rng, 4000, 5000)]
    out = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "s2", None]), None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, texts[7], None, None, None), (None, None, None, None, None), (3, texts[8], "en", "s1", 1)]


def documents(spark, of=None):
    return spark.createDataFrame(rows() if of is None else of, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
