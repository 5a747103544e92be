"""Row types. A store is an append-only log of mutations; everything else is a query over it."""

from pyspark.sql import types as T

DELETE, PUT = 0, 1
MAX_SEQUENCE = (1 << 55) - 1
LEVELS = 7

MUTATION = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.ByteType(), False),
    T.StructField("value", T.BinaryType()),
])

FILE_META = T.StructType([
    T.StructField("level", T.IntegerType()),
    T.StructField("number", T.LongType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("smallest_key", T.BinaryType()),
    T.StructField("smallest_seq", T.LongType()),
    T.StructField("largest_key", T.BinaryType()),
    T.StructField("largest_seq", T.LongType()),
    T.StructField("num_entries", T.LongType()),
])
