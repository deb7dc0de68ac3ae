"""Schemas of the stored tables."""

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


DOCUMENTS = _schema(("doc_id", T.LongType()), ("url", T.StringType()), ("title", T.StringType()), ("html", T.StringType()), ("hash", T.StringType()), ("crawled_at", T.TimestampType()), ("page_rank", T.DoubleType()))
LINKS = _schema(("doc_id", T.LongType()), ("link", T.StringType()))
QUEUE = _schema(("seq", T.LongType()), ("url", T.StringType()))
POSTINGS = _schema(("word", T.StringType()), ("doc_id", T.LongType()), ("tf", T.DoubleType()), ("importance", T.DoubleType()), ("positions", T.ArrayType(T.IntegerType())))
VOCAB = _schema(("word", T.StringType()), ("df", T.LongType()), ("idf", T.DoubleType()))
QUERY_LOG = _schema(("query", T.StringType()), ("count", T.LongType()), ("last_added", T.TimestampType()))
MATCHES = _schema(("doc_id", T.LongType()), ("term", T.StringType()), ("tf", T.DoubleType()), ("idf", T.DoubleType()))
EDGES = _schema(("src", T.LongType()), ("dst", T.LongType()))
BLOCK = T.StructType([T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())])
BLOCKS = _schema(("doc_id", T.LongType()), ("blocks", T.ArrayType(BLOCK)))
