"""Explicit schemas of the stored tables, and fixed settings of the engine."""

from pyspark.sql import types as T

# Defaults of the data model.
CHUNK_SIZE, CHUNK_OVERLAP = 500, 100
MAX_RESULTS, MIN_SCORE = 10, 70
TEXT_WEIGHT = VECTOR_WEIGHT = 0.5
DIMENSIONS, EMBED_BATCH = 384, 8
STATUSES = ("pending", "parsing", "chunking", "embedding", "indexed", "error")
PROCESSING = STATUSES[:4]
INTERRUPTED = STATUSES[:2]
TYPES = ("pdf", "docx", "txt", "md")
# Per cent of progress covered by each step of ingestion.
PROGRESS = {"parsing": (0, 10), "chunking": (10, 15), "embedding": (15, 90), "indexing": (90, 100)}
NO_TEXT = "No text could be extracted from document"


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()

LIBRARIES = _table(("id", _S, False), ("name", _S, False), ("description", _S, True), ("created_at", _L, False), ("updated_at", _L, False), ("document_count", _L, False), ("chunk_count", _L, False))
DOCUMENTS = _table(
    ("id", _S, False), ("library_id", _S, False), ("name", _S, False), ("type", _S, False), ("size", _L, False), ("created_at", _L, False), ("updated_at", _L, False),
    ("status", _S, False), ("chunk_count", _L, False), ("processing_progress", _I, True), ("error", _S, True),
)
CONTENTS = _table(("document_id", _S, False), ("library_id", _S, False), ("text", _S, False), ("pages", T.ArrayType(_S), True))
CHUNKS = _table(
    ("id", _S, False), ("library_id", _S, False), ("document_id", _S, False), ("document_name", _S, False), ("chunk_index", _I, False), ("text", _S, False),
    ("embedding", T.ArrayType(T.FloatType()), True), ("page", _I, True),
)
RESULTS = _table(("chunk_id", _S, True), ("document_id", _S, True), ("document_name", _S, True), ("text", _S, True), ("score", T.DoubleType(), True), ("page", _I, True), ("chunk_index", _I, True))
TABLES = {"libraries": LIBRARIES, "documents": DOCUMENTS, "contents": CONTENTS, "chunks": CHUNKS}
