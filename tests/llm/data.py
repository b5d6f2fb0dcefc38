"""Small documents with every odd case, and columns whose names the operators use themselves."""

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "sho", "té") for b in ("na", "ri", "sto", "va", "ß", "lin", "da")]
EXTRA = ["kept", "n_words", "digest", "token", "id", "t", "k0", "row", "component", "score", "tokens", "part", "head", "n"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)


def text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.5 else "") for _ in range(n))


def changed(value, seed, times):
    rng, words = random.Random(seed), value.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = "x" + rng.choice(WORDS)
    return " ".join(words)


def texts():
    base, other = text(1, 150), text(2, 90)
    out = [None, "", " \t\n", "one", "one", "two words", base, base.replace(" ", "  ", 3), base + "\n", other, text(3, 4), text(3, 4), text(4, 5),
           "x " * 70, (text(5, 12) + "\n") * 9, text(6, 30_000), "A" * 50_000, "ÀÉ ʼn 中文 \x00   \U0001f600 é <|endoftext|>", "#*$%&|<> " * 30]
    out += [changed(base, s, 1 + s % 4) for s in range(25)] + [changed(other, 100 + s, 1 + s % 3) for s in range(12)]
    out += [text(50 + s, 60 + s) for s in range(20)]
    return out


def rows():
    out = [(i, t, ("en", "de", None)[i % 3], f"src{i % 5}" if i % 7 else None, None) for i, t in enumerate(texts())]
    out += [out[6], out[6], (None, out[9][1], "en", "src1", 3), (None, None, None, None, None)]
    return [r + tuple("clash" for _ in EXTRA) for r in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
