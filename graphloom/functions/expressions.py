"""Expression trees as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.syntax import Bin, Call, Lit, PatternError, Prop, Un

#: A column with the type it has.
Typed = tuple[Column, T.DataType]
Lookup = Callable[[object], "Typed | None"]

COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def family(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return t.typeName()


def literal(value) -> Typed:
    if value is None:
        return F.lit(None), T.NullType()
    kind = T.BooleanType() if isinstance(value, bool) else T.LongType() if isinstance(value, int) else T.DoubleType() if isinstance(value, float) else T.StringType()
    return F.lit(value).cast(kind), kind


def failing(why: str, kind: T.DataType) -> Column:
    return F.raise_error(F.lit(why)).cast(kind)


def value(e, look: Lookup) -> Typed:
    """A column of WHERE, HAVING and FIND.

    ``look`` resolves properties and calls. A comparison with a missing value is false, so that NOT of it is true;
    values of different kinds are unequal; dates and times compare with strings as such.
    """
    if isinstance(e, Lit):
        return literal(e.value)
    if isinstance(e, (Prop, Call)):
        found = look(e)
        if found is None:
            name = e.name if isinstance(e, Call) else ".".join((e.var, *e.names))
            raise PatternError(f"unknown {'function' if isinstance(e, Call) else 'name'} {name}")
        return found
    if isinstance(e, Un):
        a, t = value(e.arg, look)
        if e.op == "not":
            return ~truth(a, t), T.BooleanType()
        return -number(a, t), t if isinstance(t, T.NumericType) else T.DoubleType()
    a, s = value(e.left, look)
    b, t = value(e.right, look)
    if e.op in ("and", "or"):
        a, b = truth(a, s), truth(b, t)
        return (a & b if e.op == "and" else a | b), T.BooleanType()
    if e.op in COMPARE:
        return compared(e.op, a, s, b, t), T.BooleanType()
    a, b = number(a, s), number(b, t)
    whole = isinstance(s, T.IntegralType) and isinstance(t, T.IntegralType)
    if e.op == "/":
        return F.try_divide(a.cast("double"), b.cast("double")), T.DoubleType()
    if e.op == "%":
        return F.try_mod(a, b), T.LongType() if whole else T.DoubleType()
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e.op](a, b), T.LongType() if whole else T.DoubleType()


def condition(e, look: Lookup) -> Column:
    """What a filter keeps. Outside of NOT an unknown comparison counts as false by itself, and a comparison that stands
    as it is can be pushed into the scan."""
    if isinstance(e, Bin) and e.op in ("and", "or"):
        a, b = condition(e.left, look), condition(e.right, look)
        return a & b if e.op == "and" else a | b
    if isinstance(e, Bin) and e.op in COMPARE:
        return compared(e.op, *value(e.left, look), *value(e.right, look), bare=True)
    return truth(*value(e, look))


def compared(op: str, a: Column, s: T.DataType, b: Column, t: T.DataType, bare: bool = False) -> Column:
    """A missing value makes it false (null, if bare); so does the literal null. Numbers compare as numbers."""
    kinds = {family(s), family(t)}
    times = {"timestamp", "date", "timestamp_ntz"}
    if len(kinds) == 1 or (kinds <= times) or (kinds & times and "string" in kinds):
        return COMPARE[op](a, b) if bare else F.coalesce(COMPARE[op](a, b), F.lit(False))
    if op == "!=" and "void" not in kinds:
        return a.isNotNull() & b.isNotNull()
    return F.lit(False)


def truth(a: Column, t: T.DataType) -> Column:
    if not isinstance(t, (T.BooleanType, T.NullType)):
        raise PatternError("a condition must be true or false")
    return F.coalesce(a.cast("boolean"), F.lit(False))


def number(a: Column, t: T.DataType) -> Column:
    if isinstance(t, T.NumericType):
        return a
    if isinstance(t, T.NullType):
        return a.cast("double")
    raise PatternError("arithmetic needs numbers")


# --- path expressions: strict ---------------------------------------------------------------------------------------


def strict(e, look: Lookup) -> Typed:
    """A column of INIT, GATHER, RETURN and path_eval: any missing value, division by zero or mixture of kinds fails."""
    if isinstance(e, Lit):
        if e.value is None:
            raise PatternError("path expressions have no null")
        return literal(e.value)
    if isinstance(e, Prop):
        found = look(e)
        if found is None:
            raise PatternError(f"unknown path variable {'.'.join((e.var, *e.names))}")
        return found
    if isinstance(e, Call):
        raise PatternError("path expressions have no functions")
    if isinstance(e, Un):
        a, t = strict(e.arg, look)
        if e.op == "not":
            if not isinstance(t, T.BooleanType):
                raise PatternError("not needs true or false")
            return ~a, t
        if not isinstance(t, T.NumericType):
            raise PatternError("- needs a number")
        return -a, t
    a, s = strict(e.left, look)
    b, t = strict(e.right, look)
    if e.op in ("and", "or"):
        if not (isinstance(s, T.BooleanType) and isinstance(t, T.BooleanType)):
            raise PatternError(f"{e.op} needs true or false")
        return (a & b if e.op == "and" else a | b), T.BooleanType()
    if e.op in COMPARE:
        if family(s) != family(t):
            raise PatternError(f"{family(s)} and {family(t)} don't compare")
        return COMPARE[e.op](a, b), T.BooleanType()
    if not (isinstance(s, T.NumericType) and isinstance(t, T.NumericType)):
        raise PatternError(f"{e.op} needs numbers")
    whole = isinstance(s, T.IntegralType) and isinstance(t, T.IntegralType)
    if e.op == "/":
        return F.when(b == 0, failing("division by zero in a path", T.DoubleType())).otherwise(F.try_divide(a.cast("double"), b.cast("double"))), T.DoubleType()
    kind = T.LongType() if whole else T.DoubleType()
    a, b = a.cast(kind), b.cast(kind)
    if e.op == "%":
        return F.when(b == 0, failing("division by zero in a path", kind)).otherwise(F.try_mod(a, b)), kind
    return {"+": a + b, "-": a - b, "*": a * b}[e.op], kind


def required(a: Column, t: T.DataType, name: str) -> Column:
    """a, or an error where it is missing."""
    return F.when(a.isNull(), failing(f"a path lacks {name}", t)).otherwise(a)
