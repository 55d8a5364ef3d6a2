"""Fixture rows shared by the tests of this folder."""

NASTY = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 3),
    (4, "Don't stop now ́x <|endoftext|> café \U0001f600\U0001f600", "en", "b", 30),
    (5, "same text twice here", "en", "b", 20),
    (6, "same text twice here", "en", "c", 20),
    (7, " line　wide  spaces \n\n end \x1c odd", "de", "c", 20),
    (8, "word " * 6000 + "tail", "en", "a", 30004),
    (9, "x" * 5000, None, None, None),
    (10, "12 345 1'2 ''s we'll They'VE ΣΣ İ", "tr", "a", 3),
]


def documents(spark, rows=NASTY):
    """documents with extra columns whose names clash with working names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, words string"
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)
