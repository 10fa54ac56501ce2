"""Arithmetic on strings from users: a fixed grammar, never ``eval``."""

from __future__ import annotations

import ast
import math
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH = 200
BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
FUNCTIONS = {"abs": abs, "round": round, "min": min, "max": max} | {n: getattr(math, n) for n in ("sqrt", "sin", "cos", "tan", "log", "log10", "log2", "exp", "floor", "ceil")}
CONSTANTS = {"pi": math.pi, "e": math.e}


def value(node: ast.AST) -> float:
    match node:
        case ast.Expression(body=body):
            return value(body)
        case ast.Constant(value=int() | float() as number):
            return number
        case ast.UnaryOp(op=ast.UAdd() | ast.USub() as op, operand=x):
            return -value(x) if isinstance(op, ast.USub) else +value(x)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in BINARY:
            one, two = value(a), value(b)
            if isinstance(op, ast.Pow) and abs(two) * max(1.0, math.log2(abs(one) or 1.0)) > 4096:
                raise OverflowError("power too large")
            return BINARY[type(op)](one, two)
        case ast.Name(id=name) if name in CONSTANTS:
            return CONSTANTS[name]
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
            return FUNCTIONS[name](*map(value, args))
    raise ValueError(f"not allowed: {type(node).__name__}")


def result(text: str | None) -> tuple[float | None, str | None]:
    """(value, None) or (None, why not)."""
    try:
        if not text or not text.strip():
            raise ValueError("empty expression")
        if len(text) > MAX_LENGTH:
            raise ValueError("expression too long")
        return float(value(ast.parse(text.strip(), mode="eval"))), None
    except (SyntaxError, ValueError, ZeroDivisionError, OverflowError, TypeError, RecursionError) as e:
        return None, f"{type(e).__name__}: {e}"


def calculate(text: Column) -> Column:
    """Struct (result, error) of an expression."""

    @F.pandas_udf("struct<result: double, error: string>")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([result(t) for t in x], columns=["result", "error"])

    return run(text)
