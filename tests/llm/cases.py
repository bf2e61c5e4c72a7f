"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, Text_ string, score string, component_id string"


def documents(spark, texts, langs=None):
    """``texts``: (doc_id, text) pairs."""
    rows = [(i, t, (langs or {}).get(i, "en"), "s", "x", "y", "z") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Ça été déjà vu"), (6, "a\x00b \x1c c"), (7, "中文 текст 🙂 Σας"), (8, "x" * 5_000), (9, "Repeat me please now ok"), (9, "Repeat me please now ok"), (10, "<|endoftext|> a"), (11, "a  b   c\n\n d")]
