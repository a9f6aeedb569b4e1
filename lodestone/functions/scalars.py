"""Scalar functions of the query language as columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from lodestone.errors import GraphError
from lodestone.sources.graph import TAGGED, as_type, display, is_float, is_int, tagged, tagged_text, unify

ID, IDS = "id", "ids"  # types of element ids (shown as 26 characters) and lists of them
NULL = T.NullType()
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
#: A list of range() has one element more at most.
RANGE_MOST = 1_000_000


@dataclass
class Val:
    """A column with what is known of it: its type, and the value if it is a literal."""

    col: Column
    type: Any
    literal: bool = False
    value: Any = None


def ulid(c: Column) -> Column:
    """An id as 26 characters of Crockford's base 32."""
    return F.lpad(F.translate(F.conv(c.cast("string"), 10, 32), "IJKLMNOPQRSTUV", "JKMNPQRSTVWXYZ"), 26, "0")


def ulid_value(text: str) -> int:
    """The id that :func:`ulid` shows as ``text``; case doesn't matter."""
    alphabet = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    if len(text) != 26 or any(ch not in alphabet for ch in text.upper()):
        raise GraphError(f"not an id: {text!r}")
    n = 0
    for ch in text.upper():
        n = n * 32 + alphabet.index(ch)
    return n


def shown(v: Val) -> Column:
    """The column as a result shows it."""
    if v.type == ID:
        return ulid(v.col)
    if v.type == IDS:
        return F.transform(v.col, ulid)
    if v.type == TAGGED:
        return tagged_text(v.col)
    if isinstance(v.type, T.ArrayType) and v.type.elementType == TAGGED:
        return F.transform(v.col, tagged_text)
    return v.col.cast("string") if v.type == NULL else v.col


def is_string(t) -> bool:
    """Strings, shown ids, and values of several kinds (null unless they are strings)."""
    return isinstance(t, T.StringType) or t == ID or t == TAGGED


def text(v: Val) -> Column:
    return ulid(v.col) if v.type == ID else v.col["s"] if v.type == TAGGED else v.col


def number(v: Val) -> Val:
    """A value of several kinds as a float; null unless it is a number."""
    return Val(F.coalesce(v.col["d"], v.col["i"].cast("double")), T.DoubleType()) if v.type == TAGGED else v


def as_tagged(v: Val) -> Column:
    return tagged(text(v), T.StringType()) if v.type == ID else tagged(v.col, v.type)


def literal(value: Any) -> Val:
    if value is None:
        return Val(F.lit(None), NULL, True, None)
    if isinstance(value, bool):
        return Val(F.lit(value), T.BooleanType(), True, value)
    if isinstance(value, int):
        return Val(F.lit(value).cast("long"), T.LongType(), True, value)
    if isinstance(value, float):
        return Val(F.lit(value), T.DoubleType(), True, value)
    if isinstance(value, str):
        return Val(F.lit(value), T.StringType(), True, value)
    if isinstance(value, (list, tuple)):
        return array([literal(x) for x in value])
    if isinstance(value, dict):
        vals = {k: literal(v) for k, v in value.items()}
        fields = [T.StructField(k, T.StringType() if v.type == NULL else v.type) for k, v in vals.items()]
        return Val(F.struct(*[v.col.alias(k) for k, v in vals.items()]), T.StructType(fields), True, value)
    return literal(str(value))


def array(items: list[Val]) -> Val:
    if not items:
        return Val(F.array().cast("array<string>"), T.ArrayType(NULL))
    if all(v.type == ID for v in items):
        return Val(F.array(*[v.col for v in items]), IDS)
    to = unify([T.StringType() if v.type == ID else v.type for v in items])
    return Val(F.array(*[as_type(text(v), T.StringType() if v.type == ID else v.type, to) for v in items]), T.ArrayType(to))


def numeric_pair(a: Val, b: Val) -> tuple[Val, Val]:
    """A literal takes the type of the column that it stands against."""
    if a.literal and not b.literal and is_int(a.type) and is_float(b.type):
        a = literal(float(a.value))
    if b.literal and not a.literal and is_int(b.type) and is_float(a.type):
        b = literal(float(b.value))
    if a.literal and not b.literal and is_float(a.type) and is_int(b.type) and float(a.value).is_integer():
        a = literal(int(a.value))
    if b.literal and not a.literal and is_float(b.type) and is_int(a.type) and float(b.value).is_integer():
        b = literal(int(b.value))
    return a, b


def family(t) -> str:
    if t == NULL:
        return "null"
    if t == ID:
        return "string"
    if t == IDS or isinstance(t, T.ArrayType):
        return "list"
    if is_int(t):
        return "int"
    if is_float(t):
        return "float"
    if t == TAGGED:
        return "tagged"
    return {"string": "string", "boolean": "bool"}.get(t.simpleString(), t.simpleString())


def equal(a: Val, b: Val) -> Column:
    """Structural equality: null equals null; an integer and a float that are both data never are equal."""
    a, b = numeric_pair(a, b)
    fa, fb = family(a.type), family(b.type)
    if fa == "null" or fb == "null":
        other = b if fa == "null" else a
        return F.lit(True) if fa == fb else other.col.isNull()
    if "tagged" in (fa, fb) and "list" not in (fa, fb):
        return as_tagged(a).eqNullSafe(as_tagged(b))
    if fa != fb:
        mixed = {fa, fb} == {"int", "float"} and (a.literal or b.literal)
        return a.col.cast("double").eqNullSafe(b.col.cast("double")) if mixed else a.col.isNull() & b.col.isNull()
    if a.type == b.type:
        return a.col.eqNullSafe(b.col)
    return text(a).eqNullSafe(text(b))


def compare(op: str, a: Val, b: Val, bare: bool = False) -> Column:
    """False, never null, where one side is null or the types differ; null <= null and null >= null are true.
    ``bare``: for a filter, to which null is as good as false."""
    a, b = numeric_pair(a, b)
    fa, fb = family(a.type), family(b.type)
    both = F.lit(False)
    if op in ("<=", ">="):
        both = a.col.isNull() & b.col.isNull()
    if "tagged" in (fa, fb) and not {"list", "null"} & {fa, fb}:
        x, y = as_tagged(a), as_tagged(b)
        one = F.lit(False)
        for f in "bids":
            own = {"<": x[f] < y[f], "<=": x[f] <= y[f], ">": x[f] > y[f], ">=": x[f] >= y[f]}[op]
            one = one | ((x["t"] == f) & (y["t"] == f) & own)
        return F.coalesce(one, F.lit(False)) | both
    if fa != fb and not ({fa, fb} == {"int", "float"} and (a.literal or b.literal)):
        return both
    if fa == "null":
        return both
    x, y = text(a), text(b)
    c = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    if bare and (op in ("<", ">") or any(v.literal and v.value is not None for v in (a, b))):
        return c
    return F.coalesce(c, F.lit(False)) | both if op in ("<=", ">=") else F.coalesce(c, F.lit(False))


def arithmetic(op: str, a: Val, b: Val, safe: bool) -> Val:
    a, b = number(a), number(b)
    for v in (a, b):
        if family(v.type) not in ("int", "float", "null"):
            raise GraphError(f"'{op}' needs numbers")
    if is_int(a.type) and is_int(b.type):
        x, y = a.col.cast("long"), b.col.cast("long")
        if op in ("/", "%") and safe:
            y = F.when(y != 0, y)
        if op == "/":
            return Val(_div(x, y), T.LongType())
        return Val({"+": x + y, "-": x - y, "*": x * y, "%": x % y}[op], T.LongType())
    x, y = a.col.cast("double"), b.col.cast("double")
    if op == "/" and safe:
        y = F.when(y != 0, y)
    return Val({"+": x + y, "-": x - y, "*": x * y, "/": x / y, "%": F.try_mod(x, y)}[op], T.DoubleType())


def _div(x: Column, y: Column) -> Column:
    """Integer quotient, cut off toward zero; an error for a zero divisor."""
    return ((x - x % y) / y).cast("long")


def _string(v: Val, f) -> Val:
    return Val(f(text(v)), T.StringType()) if is_string(v.type) else Val(F.lit(None).cast("string"), T.StringType())


def _bool(vs: list[Val], f) -> Val:
    ok = all(is_string(v.type) for v in vs)
    return Val(f(*[text(v) for v in vs]) if ok else F.lit(None).cast("boolean"), T.BooleanType())


def _clamp(v: Val) -> Column:
    return F.greatest(F.lit(0), v.col.cast("int"))


def _elem(v: Val, f) -> Val:
    if v.type == IDS:
        return Val(f(v.col), ID)
    if isinstance(v.type, T.ArrayType):
        return Val(f(v.col), v.type.elementType)
    return Val(F.lit(None), NULL)


def _keep_number(v: Val, f) -> Val:
    return Val(f(v.col), v.type) if family(v.type) in ("int", "float") else Val(F.lit(None), NULL)


SPACE = r"(?U)^\s+"
NAMES = {
    "elementid": "id", "to_string": "tostring", "to_integer": "tointeger", "to_float": "tofloat", "lowercase": "tolower",
    "uppercase": "toupper", "ceiling": "ceil", "is_null": "isnull", "length": "size",
}
ARITY = {
    "id": 1, "size": 1, "tostring": 1, "tointeger": 1, "tofloat": 1, "tolower": 1, "toupper": 1, "trim": 1, "ltrim": 1, "rtrim": 1,
    "split": 2, "replace": 3, "substring": 2, "left": 2, "right": 2, "startswith": 2, "endswith": 2, "contains": 2, "coalesce": 1,
    "abs": 1, "ceil": 1, "floor": 1, "round": 1, "sign": 1, "sqrt": 1, "range": 2, "head": 1, "last": 1, "tail": 1, "reverse": 1,
    "exists": 1, "isnull": 1, "not": 1,
}


def scalar(name: str, args: list[Val], safe: bool) -> Val:
    """The function's value; a null or wrongly typed argument gives null, an unknown name is an error."""
    name = NAMES.get(name, name)
    if name not in ARITY:
        raise GraphError(f"unknown function: {name}")
    if len(args) < ARITY[name]:
        raise GraphError(f"{name} needs {ARITY[name]} argument(s)")
    a = args[0]
    string, null = T.StringType(), Val(F.lit(None), NULL)
    cast = (lambda c, t: c.try_cast(t)) if safe else (lambda c, t: c.cast(t))
    if name == "id":
        return a
    if name == "size":
        if is_string(a.type):
            return Val(F.char_length(text(a)).cast("long"), T.LongType())
        lists = a.type == IDS or isinstance(a.type, T.ArrayType)
        return Val(F.when(a.col.isNotNull(), F.size(a.col)).cast("long") if lists else F.lit(None).cast("long"), T.LongType())
    if name == "tostring":
        if a.type == NULL:
            return literal("null")
        own = tagged_text(a.col) if a.type == TAGGED else text(a) if is_string(a.type) else display(a.col, a.type)
        return Val(F.coalesce(own, F.lit("null")), string)
    if name == "tointeger":
        kind = family(a.type)
        if kind == "string":
            return Val(cast(F.regexp_replace(text(a), r"(?U)^\s+|\s+$", ""), "long"), T.LongType())
        return Val(cast(a.col, "long"), T.LongType()) if kind in ("int", "float") else Val(F.lit(None).cast("long"), T.LongType())
    if name == "tofloat":
        kind = family(a.type)
        if kind == "string":
            return Val(cast(text(a), "double"), T.DoubleType())
        return Val(a.col.cast("double") if kind in ("int", "float") else F.lit(None).cast("double"), T.DoubleType())
    if name in ("tolower", "toupper"):
        return _string(a, F.lower if name == "tolower" else F.upper)
    if name in ("trim", "ltrim", "rtrim"):
        pattern = {"trim": r"(?U)^\s+|\s+$", "ltrim": r"(?U)^\s+", "rtrim": r"(?U)\s+$"}[name]
        return _string(a, lambda c: F.regexp_replace(c, pattern, ""))
    if name == "split":
        d = args[1]
        if not (is_string(a.type) and is_string(d.type)):
            return null
        s, sep = text(a), text(d)
        chars = F.concat(F.array(F.lit("")), F.split(s, "(?!^)"))
        return Val(F.when(sep == "", chars).otherwise(F.split(s, F.concat(F.lit(r"\Q"), sep, F.lit(r"\E")), -1)), T.ArrayType(string))
    if name == "replace":
        return Val(F.replace(text(a), text(args[1]), text(args[2])), string) if all(is_string(v.type) for v in args[:3]) else null
    if name == "substring":
        if not is_string(a.type) or not is_int(args[1].type):
            return null
        start = _clamp(args[1])
        count = _clamp(args[2]) if len(args) > 2 else F.char_length(text(a))
        return Val(F.substring(text(a), start + 1, count), string)
    if name in ("left", "right"):
        f = F.left if name == "left" else F.right
        return _string(a, lambda c: f(c, _clamp(args[1]))) if is_int(args[1].type) else null
    if name in ("startswith", "endswith", "contains"):
        return _bool(args[:2], getattr(F, name))
    if name == "coalesce":
        known = [v for v in args if v.type != NULL]
        if not known:
            return null
        if all(v.type == known[0].type for v in known):
            return Val(F.coalesce(*[v.col for v in known]), known[0].type)
        to = unify([string if v.type == ID else v.type for v in known])
        return Val(F.coalesce(*[as_type(text(v), string if v.type == ID else v.type, to) for v in known]), to)
    if name == "abs":
        return _keep_number(a, F.abs)
    if name in ("ceil", "floor", "round"):
        f = {"ceil": F.ceil, "floor": F.floor, "round": F.round}[name]
        return Val(f(a.col).cast("double"), T.DoubleType()) if is_float(a.type) else _keep_number(a, lambda c: c)
    if name == "sign":
        return Val(F.signum(a.col).cast("long"), T.LongType()) if is_int(a.type) else _keep_number(a, F.signum)
    if name == "sqrt":
        return Val(F.sqrt(a.col.cast("double")), T.DoubleType()) if family(a.type) in ("int", "float") else null
    if name == "range":
        x, y = a.col.cast("long"), args[1].col.cast("long")
        step = args[2].col.cast("long") if len(args) > 2 else F.when(x <= y, F.lit(1)).otherwise(F.lit(-1)).cast("long")
        zero = F.lit(None).cast("array<long>") if safe else F.raise_error(F.lit("range() step is zero")).cast("array<long>")
        empty = F.array().cast("array<long>")
        wrong = ((step > 0) & (x > y)) | ((step < 0) & (x < y))
        safe_step = F.when(wrong | (step == 0), F.when(x <= y, F.lit(1)).otherwise(F.lit(-1))).otherwise(step).cast("long")
        last = F.try_add(x, F.try_multiply(safe_step, F.lit(RANGE_MOST)))  # null beyond the longs, where least and greatest pass it over
        y = F.when(safe_step > 0, F.least(y, last)).otherwise(F.greatest(y, last))
        return Val(F.when(step == 0, zero).when(wrong, empty).otherwise(F.sequence(x, F.when(~wrong, y).otherwise(x), safe_step)), T.ArrayType(T.LongType()))
    if name in ("head", "last"):
        return _elem(a, lambda c: F.try_element_at(c, F.lit(1 if name == "head" else -1)))
    if name == "tail":
        return Val(F.slice(a.col, 2, F.greatest(F.size(a.col) - 1, F.lit(0))), a.type) if family(a.type) == "list" else null
    if name == "reverse":
        return Val(F.reverse(text(a)), string if is_string(a.type) else a.type) if is_string(a.type) or family(a.type) == "list" else null
    if name == "exists":
        return Val(a.col.isNotNull(), T.BooleanType())
    if name == "isnull":
        return Val(a.col.isNull(), T.BooleanType())
    return Val(~a.col if family(a.type) == "bool" else F.lit(None).cast("boolean"), T.BooleanType())
