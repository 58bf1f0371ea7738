"""Fixed schemas. Nothing is inferred; validation is data (a ``reasons`` column), not exceptions."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
MAINS = T.ArrayType(T.IntegerType())

PRIZE = T.StructType(
    [
        T.StructField("tier", T.StringType()),
        T.StructField("winners", T.IntegerType()),
        T.StructField("amount", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("original_text", T.StringType()),
        T.StructField("prize_type", T.StringType()),
    ]
)

OBSERVATION = T.StructType(
    [
        T.StructField("game", T.StringType()),
        T.StructField("draw_date", T.DateType()),
        T.StructField("mains", MAINS),
        T.StructField("bonus", T.IntegerType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("jackpot", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("prizes", T.ArrayType(PRIZE)),
    ]
)

OBSERVATION_FILE = T.StructType([T.StructField("observations", T.ArrayType(OBSERVATION))])

DRAW_EXPORT = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("date", "n1", "n2", "n3", "n4", "n5", "n6", "bonus", "jackpot", "currency", "jackpotWinners")
    ]
    + [T.StructField("_bad", T.StringType())]
)

ARTIFACT = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("retrieved_at", T.TimestampType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("body_path", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

ARTIFACT_MANIFEST = T.StructType(
    [T.StructField("version", T.IntegerType()), T.StructField("artifacts", T.ArrayType(ARTIFACT))]
)

RULE = T.StructType(
    [
        T.StructField("game", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("starts_on", T.DateType()),
        T.StructField("ends_on", T.DateType()),
        T.StructField("pool", T.IntegerType()),
        T.StructField("schedule", MAINS),
    ]
)

CURATED = T.StructType(
    [
        T.StructField("artifact_index", T.IntegerType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("record_key", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("payload", T.StringType()),
    ]
)
