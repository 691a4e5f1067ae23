"""Schemas of the engine's tables and files."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _of(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


STR, INT, LONG, DOUBLE, BOOL = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()

CORPUS = _of(file_id=LONG, filename=STR, repo=STR, language=STR, content=STR)
METADATA = _of(index=LONG, filename=STR, original_path=STR, original_size=LONG, source=STR, license=STR)
RANGES = ArrayType(_of(start=INT, end=INT))
EXACT = _of(pattern=STR, frequency=LONG, token_count=INT, score=LONG, repo_count=LONG)
TEMPLATE = _of(template=STR, frequency=LONG, slot_count=INT, score=DOUBLE, repo_count=LONG)
DICTIONARY = _of(kind=STR, ord=INT, content=STR, macro=STR, slots=INT, category=STR)
DICTIONARY_JSON = _of(patterns=ArrayType(_of(pattern=STR, macro=STR, category=STR)), templates=ArrayType(_of(template=STR, macro=STR, slots=INT, category=STR)))
SCORES = _of(macro=STR, kind=STR, content=STR, category=STR, slots=INT, score=DOUBLE, file_count=LONG, repo_count=LONG)
RECORD = _of(text=STR)
STREAM_RECORD = _of(content=STR, repo_name=STR)
TOKEN_MAP = MapType(STR, INT)
