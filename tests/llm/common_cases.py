"""Rows that every operator must take."""

CLASH = ["_row", "key", "h1", "part", "rank", "bucket", "_key", "doc", "n"]
HOSTILE = [(1, "a plain text of several words, twice"), (2, None), (None, "without an id, but with a text"), (3, ""), (4, "   "), (5, "--- *** ---"), (1, "a plain text of several words, twice"), (1, "a plain text of several words, twice"), (6, "word " * 9000), (7, "日本語の文章です。"), (2**60 + 1, "large id"), (8, "é" * 200 + " ═════ \x00 ok")]


def documents(spark, rows, id_type="long", extra=()):
    """doc_id, text, lang, source, n_chars, and columns of clashing names."""
    kinds = f"doc_id {id_type}, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
    full = [(i if id_type == "long" or i is None else f"d{i}", t, "en", "src", None if t is None else len(t), *["x"] * len(extra)) for i, t in rows]
    return spark.createDataFrame(full, kinds)
