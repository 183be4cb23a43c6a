"""Record schemas of the pipeline's boundaries."""

from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


EMAIL = T.StructType([
    *(T.StructField(n, _S) for n in ("account", "label", "message_id", "thread_id")),
    T.StructField("label_ids", T.ArrayType(_S)),
    T.StructField("gmail_label_ids", T.ArrayType(_S)),
    T.StructField("gmail_label_names", T.ArrayType(_S)),
    *(T.StructField(n, _S) for n in
      ("internal_date", "subject", "from", "to", "cc", "date", "snippet", "text")),
])


def raw_message(depth: int) -> T.StructType:
    """A provider message; MIME parts nested more than ``depth`` levels below the payload stay JSON text."""
    header = T.ArrayType(_struct(name=_S, value=_S))
    part = None
    for _ in range(depth + 1):
        fields = {"mimeType": _S, "body": _struct(data=_S), "parts": _S if part is None else T.ArrayType(part)}
        part = _struct(**fields)
    payload = T.StructType([T.StructField("headers", header), *part.fields])
    return _struct(id=_S, threadId=_S, labelIds=T.ArrayType(_S), internalDate=_S, snippet=_S, payload=payload)


LABEL_RESPONSE = _struct(
    output_text=_S,
    output=T.ArrayType(_struct(content=T.ArrayType(_struct(refusal=_S, text=_S)))),
)
LABEL_ANSWER = _struct(label=_S, confidence=T.DoubleType(), reason=_S)
CANDIDATES = T.ArrayType(_struct(label=_S, confidence=T.DoubleType()))
