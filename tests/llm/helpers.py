"""Odd rows every operator over documents has to take, and small helpers."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("node", T.StringType()),
     T.StructField("_id", T.StringType()), T.StructField("word", T.StringType())]
)

LONG = "the quick brown fox jumps over a lazy dog " * 6000

ODD_TEXTS = [
    None, "", " \n\t ", "word", "two words", "a b c d e f g h", "a b c d e f g h", "A b c d e f g H", "x" * 5000, LONG, LONG + "again",
    "tab\tand\x0bother\x0cspace\r\n", "naïve café 日本語 🤯 <|endoftext|> ▁ it's don't", "the the the the the the", "\x00null\x00", "...!!!", "12345",
]


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns named like the operators' own."""
    rows = [
        (i, text, None if i % 5 == 1 else ("en", "fr")[i % 2], None if i % 7 == 3 else f"s{i % 3}", None if text is None else len(text), "n", "i", "w")
        for i, text in enumerate(ODD_TEXTS)
    ]
    rows += [rows[6], (None, "no id here", "en", "s0", 10, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    """Rows by doc_id; several rows of one id as a sorted list."""
    out = {}
    for row in df.collect():
        out.setdefault(row["doc_id"], []).append(tuple(row))
    return {k: sorted(v) for k, v in out.items()}


def link_groups(ids, linked):
    """Smallest id each id reaches, by brute force."""
    low = {i: i for i in ids}
    while True:
        new = dict(low)
        for a, b in linked:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new
