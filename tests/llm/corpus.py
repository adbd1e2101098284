"""Small tables that hold every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
TEXTS = [
    None,
    "",
    " ",
    "\n\t ",
    "a",
    "Hello, world! It's 1999 <|endoftext|> and <|startoftext|>done.",
    "foo<|endoftext|>bar  baz   \n\n qux  　 x y",
    "Éàü ß ñandú  “quoted” İstanbul ΣΑΣ ́ é ﬁ 你好，世界 🙂🙂 don't we'll",
    "\x00\x01 control\x7f \x85 next line",
    BASE,
    BASE,
    BASE + " extra",
    BASE.upper(),
    "word " * 5000,
    "x" * 30000,
    " ".join(f"w{i}" for i in range(20000)),
    "</s>[INST] ok [/INST] \\ <s> [[INST]] <</SYS>>",
    " leading and trailing ",
]


def rows():
    out = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(TEXTS)]
    return [*out, out[9], (None, "no id", None, None, None), (None, None, None, None, None)]


def docs(spark, empty=False):
    return spark.createDataFrame([] if empty else rows(), SCHEMA)


def clashing(df):
    """Extra columns with the names of results."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("n_tokens", "n_bytes", "media", "size", "key", "start", "score", "h", "rank", "component_id")})


def saved(spark, df, tmp_path, name="documents"):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
