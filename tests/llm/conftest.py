import pytest

CLASHING = ["n_tokens", "slot", "row", "removed", "kept", "label", "key", "frag", "z", "pairs", "class", "rid", "part", "first", "text_key", "h", "g", "own",
            "gone_id", "stay_id", "bad_id", "grp", "n", "shard", "spans", "score", "component_id", "item_id", "place", "left", "right"]
LONG = "The quick brown fox jumps over the lazy dog again and again until the evening comes. " * 3000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns whose names clash."""
    near = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 3
    rows = [
        (1, near, "en"), (2, near + "omega", "en"), (3, near, None), (None, near, "en"), (4, None, "en"), (5, "", None), (6, " \n\t\n ", "de"), (7, "12 345 !?", "fr"),
        (8, LONG, "en"), (9, LONG, "en"), (10, "ein zwei drei vier fünf sechs sieben acht neun zehn", "de"), (10, "ein zwei drei vier fünf sechs sieben acht neun zehn", "de"),
        (10, "another text under the same id, which is a little longer than the first one was", "en"), (-5, "x", "en"), (11, "Mail a.b@c.de or 10.0.0.1\nMail a.b@c.de or 10.0.0.1\nshort", "en"),
        (12, "日本語のテキスト 中文 한국어 кириллица", None), (13, "a" * 70000, None), (14, "<|endoftext|> <s> </s>", "en"),
    ]
    docs = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
