"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


DOCS = _table(("doc_id", _S), ("text", _S), ("pos", _L))
QUERIES = _table(("qid", _S), ("text", _S), ("seed_doc_ids", T.ArrayType(_S)), ("quality", _I), ("pos", _L))
QRELS = _table(("qid", _S), ("doc_id", _S), ("rel", _I))
HITS = _table(("model", _S), ("qid", _S), ("doc_id", _S), ("score", _D), ("pos", _L))
RANKED = _table(("model", _S), ("qid", _S), ("query", _S), ("doc_ids", T.ArrayType(_S)), ("doc_texts", T.ArrayType(_S)), ("pos", _L))
VERDICTS = _table(
    ("qid", _S), ("query", _S), ("model_a", _S), ("model_b", _S), ("score_a", _D), ("raw", T.ArrayType(_S)),
    ("reasoning", _S), ("parsed_ok", T.ArrayType(_B)), ("task", _S), ("judge", _S), ("query_set", _S),
)
#: Fields a verdict line must have; the others have a default.
VERDICT_REQUIRED = VERDICTS.fieldNames()[:5]
RATINGS = _table(
    ("model", _S), ("revision", _S), ("rating", _D), ("ci_low", _D), ("ci_high", _D), ("wins", _D),
    ("losses", _D), ("ties", _D), ("n", _I), ("ndcg_at_10", _D),
)
