"""User formulas over numeric fields, compiled to a Column.

Allowed: + - * /, signs, numeric constants and the numeric fields. A NULL field counts as 0. A division by zero makes
the result NULL, which callers report as a row error.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.schema import NUMERIC_FIELDS, RetailError


def names(formula: str) -> set[str]:
    try:
        tree = ast.parse(formula, mode="eval")
    except SyntaxError as e:
        raise RetailError("ADAPTER_CONFIG_INVALID", f"formula {formula!r}: {e}") from e
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}


def compiled(formula: str) -> Column:
    """DECIMAL(38,10) Column of a formula; RetailError for anything not allowed."""
    try:
        tree = ast.parse(formula, mode="eval")
    except SyntaxError as e:
        raise RetailError("ADAPTER_CONFIG_INVALID", f"formula {formula!r}: {e}") from e

    def of(n: ast.AST) -> Column:
        match n:
            case ast.Expression():
                return of(n.body)
            case ast.Constant(value=bool()):
                pass
            case ast.Constant(value=int() | float()):
                return F.lit(str(n.value)).cast("decimal(28,10)")
            case ast.Name() if n.id in NUMERIC_FIELDS:
                return F.coalesce(F.col(n.id).cast("decimal(28,10)"), F.lit(0).cast("decimal(28,10)"))
            case ast.UnaryOp(op=ast.USub()):
                return -of(n.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return of(n.operand)
            case ast.BinOp(op=ast.Add()):
                return (of(n.left) + of(n.right)).cast("decimal(28,10)")
            case ast.BinOp(op=ast.Sub()):
                return (of(n.left) - of(n.right)).cast("decimal(28,10)")
            case ast.BinOp(op=ast.Mult()):
                return (of(n.left) * of(n.right)).cast("decimal(28,10)")
            case ast.BinOp(op=ast.Div()):
                return F.try_divide(of(n.left), of(n.right)).cast("decimal(28,10)")
        raise RetailError("ADAPTER_CONFIG_INVALID", f"formula {formula!r}: {type(n).__name__} is not allowed")

    return of(tree)
