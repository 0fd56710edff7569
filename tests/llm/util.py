"""Documents with every awkward case, for all operators."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, kept int, _row string, _text int, place int, u int, node int, batch string, key int, part int"


def sentence(seed: int, n: int) -> str:
    state, out = seed * 7919 + 13, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state // 65536 % len(WORDS)])
    return " ".join(out)


def rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    own = [(i, sentence(i, 40 + i)) for i in range(30)]
    own += [(100, sentence(3, 43)), (101, sentence(3, 43)), (101, sentence(3, 43)), (5, "another text under a key that is taken")]
    own += [(None, sentence(4, 44)), (None, None), (200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "Ünïcode ⚖ text 𝄞 with — signs and\x85breaks\x1c.")]
    own += [(300, sentence(9, 60_000)), (301, "x" * 200_000), (302, "\n".join(["same line again"] * 300))]
    return [(k, t, "en", None if i % 7 == 0 else f"src{i % 3}", None, 1, "s", 0, "r", 2, 3, 4, 5, "b", 6, 7) for i, (k, t) in enumerate(own)]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, pairs, extra=()):
    """Plain documents from (doc_id, text)."""
    return spark.createDataFrame([(k, t, "en", "src0", None) for k, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")
