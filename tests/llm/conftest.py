import public_tokenizers
import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def documents(spark):
    """documents rows from texts or (doc_id, text[, lang]) tuples."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            lang = r[2] if len(r) > 2 else "en"
            full.append((r[0], r[1], lang, "s", len(r[1]) if r[1] is not None else None))
        return spark.createDataFrame(full, DOCUMENTS).repartition(3, "doc_id")

    return make


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder of tables as the queries read them."""

    def make(**frames):
        folder = tmp_path_factory.mktemp("sf")
        for name, frame in frames.items():
            frame.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return make


ODD = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    "a b c d",
    "The same text stands here twice, and once more for good measure.",
    "The same text stands here twice, and once more for good measure.",
    "word " * 30_000,
    "x" * 50_000,
    "Ünïcödé ΑΣ ß 日本語 😀 ́ <|endoftext|> it's  two  spaces \t tab\x1cgs",
    "\x01\x02 token = abcdef123 \x01",
]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    return [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "null id text"), (4, "one"), (4, "one")]
