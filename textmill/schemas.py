"""Column names and types shared by every operator."""

from pyspark.sql import types as T

CHUNK_FIELDS = [
    T.StructField("text", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("is_tabular", T.BooleanType()),
    T.StructField("table_type", T.StringType()),
    T.StructField("single_row", T.BooleanType()),
    T.StructField("row_split", T.BooleanType()),
    T.StructField("sentence_aware", T.BooleanType()),
    T.StructField("table_columns", T.ArrayType(T.StringType())),
    T.StructField("embedding_model_id", T.StringType()),
    T.StructField("row_data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("extra_metadata", T.MapType(T.StringType(), T.StringType())),
]
CHUNKS = T.StructType(CHUNK_FIELDS)

ERRORS = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)

MODELS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("max_length", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("dimension", T.IntegerType()),
        T.StructField("query_prefix", T.StringType()),
        T.StructField("passage_prefix", T.StringType()),
    ]
)
