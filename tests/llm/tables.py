"""Small document tables."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, texts, langs=None, sources=None):
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark, extra=()):
    """Nulls in every column, empty and blank texts, a repeated row, a null id, a long text, and columns whose names the
    operators use themselves."""
    long = "the quick brown fox jumps over the lazy dog and runs away from here " * 3000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", None, "a", 4), (4, "one two three", "en", None, 3), (4, "one two three", "en", None, 3), (None, "a row without an id", "en", "b", 1), (5, long, "en", "b", 9), (6, "one two three", "de", "b", 1), (7, "...", "de", "b", 1)]
    names = ["tokens", "rate", "copies", "__digest", "__key", "__node", "__text", "digest", "id", "keys", "Tokens_", *extra]
    full = spark.createDataFrame([(*r, *("x" for _ in names)) for r in rows], SCHEMA + "".join(f", `{n}` string" for n in names))
    return full


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
