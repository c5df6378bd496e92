"""Schemas of dumps and of the stored tables."""

from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S = StringType()
#: Whole numbers are read as text, so that one bad number doesn't empty the fields after it; `sources.dump` checks them.
REVISION = _struct(id=_S, timestamp=_S, comment=_S, contributor=_struct(username=_S, id=_S, ip=_S), text=_S)
PAGE = _struct(title=_S, ns=_S, id=_S, redirect=_struct(_title=_S), restrictions=_S, revision=ArrayType(REVISION))
DOCUMENT = _struct(owner=_S, category=_S, document_id=LongType(), name=_S, external_id=_S, document=_S)
EMBEDDING = _struct(embedding_id=LongType(), document_id=LongType(), embedding=ArrayType(FloatType()))
CENTROID = _struct(centroid_id=LongType(), centroid=ArrayType(DoubleType()))
SEARCH_RESULT = _struct(name=_S, external_id=_S, document=_S, document_id=LongType(), document_similarity=DoubleType())
