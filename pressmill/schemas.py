"""Row shapes that travel between the stages."""

from pyspark.sql import types as T

POSITION = T.StructType(
    [T.StructField("current", T.IntegerType()), T.StructField("total", T.IntegerType())]
)

PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
