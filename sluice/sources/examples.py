"""Records of named features in the protocol-buffer wire format of ``Example`` messages: written and parsed without a library.

A message is a list of fields, each a key (number * 8 + wire type) and a value. An Example holds, in field 1, Features, whose
field 1 repeats entries of a map from names to Feature; a Feature is a list of bytes (1), floats (2) or integers (3).
"""

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, position behind it)."""
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of the fields of a message; a value that is cut off raises an error."""
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        kind = key & 7
        if kind == VARINT:
            value, at = read_varint(data, at)
        else:
            size, at = read_varint(data, at) if kind == BYTES else ({FIXED64: 8, FIXED32: 4}[kind], at)
            if at + size > len(data):
                raise ValueError("a field is cut off")
            value, at = data[at : at + size], at + size
        yield key >> 3, kind, value


def _message(*parts: tuple[int, bytes]) -> bytes:
    return b"".join(varint(number << 3 | BYTES) + varint(len(body)) + body for number, body in parts)


def encode(features: dict[str, list]) -> bytes:
    """An Example of lists of bytes, strings, floats or integers; names in order, numbers packed."""
    entries = []
    for name in sorted(features):
        values = features[name]
        if any(isinstance(v, bytes | str) for v in values):
            feature = _message((1, _message(*[(1, v.encode() if isinstance(v, str) else v) for v in values])))
        elif any(isinstance(v, float) for v in values):
            feature = _message((2, _message((1, struct.pack(f"<{len(values)}f", *values)))))
        else:
            feature = _message((3, _message((1, b"".join(map(varint, values))))))
        entries.append((1, _message((1, name.encode()), (2, feature))))
    return _message((1, _message(*entries)))


def _numbers(kind: int, wire: int, value: int | bytes) -> list:
    if kind == 1:
        return [value]
    if kind == 2:
        return list(struct.unpack(f"<{len(value) // 4}f", value))  # packed, or one of them
    if wire == VARINT:
        found = [value]
    else:
        found, at = [], 0
        while at < len(value):
            n, at = read_varint(value, at)
            found.append(n)
    return [n - (1 << 64) if n >> 63 else n for n in found]


def decode(record: bytes) -> dict[str, list]:
    """The features of an Example; of a name that is repeated the last entry counts."""
    out: dict[str, list] = {}
    for number, _, body in fields(record):
        if number != 1:
            continue
        for number_, _, entry in fields(body):
            if number_ != 1:
                continue
            parts = {n: v for n, _, v in fields(entry)}
            values: list = []
            for kind, _, holder in fields(parts.get(2, b"")):
                values = [x for n, wire, v in fields(holder) if n == 1 for x in _numbers(kind, wire, v)]
            out[parts.get(1, b"").decode()] = values
    return out


def parse_examples(record, schema: str, defaults: dict | None = None) -> Column:
    """A struct of features of a column of records. An array type takes all values of a feature, another type its only one;
    a feature that is missing is its default, or null (an empty list for an array). Null records give null."""
    import pandas as pd

    wanted, defaults = T.StructType.fromDDL(schema), defaults or {}

    def one(kind: T.DataType, name: str, values: list | None):
        if isinstance(kind, T.ArrayType):
            return [_typed(kind.elementType, v) for v in values] if values else defaults.get(name, [])
        if not values:
            return defaults.get(name)
        if len(values) > 1:
            raise ValueError(f"{name} has several values")
        return _typed(kind, values[0])

    @F.pandas_udf(wanted)
    def run(s: pd.Series) -> pd.DataFrame:
        found = [decode(r) if r is not None else {} for r in s]
        return pd.DataFrame({f.name: [one(f.dataType, f.name, x.get(f.name)) for x in found] for f in wanted.fields}, dtype=object)

    c = F.col(record) if isinstance(record, str) else record
    return F.when(c.isNotNull(), run(c))


def _typed(kind: T.DataType, v):
    return v.decode() if isinstance(kind, T.StringType) else v


def encode_examples(df: DataFrame, columns: list[str]) -> Column:
    """An Example of each row; arrays are lists of values, others lists of one, nulls are left out."""
    import pandas as pd

    @F.pandas_udf("binary")
    def run(row: pd.DataFrame) -> pd.Series:
        def of(r) -> bytes:
            own = {}
            for c, v in zip(columns, r):
                if v is None or isinstance(v, float) and v != v:
                    continue
                values = v if isinstance(v, str | bytes) else list(v) if hasattr(v, "__iter__") else v
                values = values if isinstance(values, list) else [values]
                own[c] = [x.item() if hasattr(x, "item") else x for x in values]
            return encode(own)

        return pd.Series([of(r) for r in row.itertuples(index=False, name=None)])

    return run(F.struct(*columns))
