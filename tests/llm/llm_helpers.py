import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = "alpha beta gamma delta Epsilon zeta Eta theta, iota kappa. Lambda mu nu xi omicron Pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    """``n`` words in lines of about ten."""
    out = []
    for i in range(n):
        out.append(rng.choice(VOCAB) + str(rng.randrange(400)))
        out.append("\n" if rng.random() < 0.1 else " ")
    return "".join(out).strip()


def docs_of(spark, rows):
    """rows of (doc_id, text[, source, lang]) as documents with columns that clash with results."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), True, 1.5) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double")


ODD = [
    (1, None),
    (2, ""),
    (3, "\n\n"),
    (4, " \t "),
    (5, "one"),
    (5, "one"),
    (6, "x" * 5000),
    (7, " nbsp wide \x1c sep <|endoftext|> don't é \U0001f600"),
    (None, "no id here at all"),
]
