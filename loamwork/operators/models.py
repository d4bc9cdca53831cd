"""External models behind one interface: a scorer is a picklable function from a list of texts to a list of replies.

Equal texts are scored once.  A failing batch is retried, then halved, and at last its texts get the fallback, so
one bad text costs no others.  Without a model, deterministic functions stand in.
"""

from __future__ import annotations

import ast
import math
import operator
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call(scorer: Callable[[list[str]], list], texts: list[str], fallback=None, tries: int = 2) -> list:
    for _ in range(tries):
        try:
            out = list(scorer(texts))
            if len(out) == len(texts):
                return out
        except Exception:  # noqa: BLE001  any failure of a model counts alike
            continue
    if len(texts) <= 1:
        return [fallback] * len(texts)
    half = len(texts) // 2
    return call(scorer, texts[:half], fallback, tries) + call(scorer, texts[half:], fallback, tries)


def call_distinct(df: DataFrame, column: str, scorer: Callable[[list[str]], list], kind: str, name: str, fallback=None, batch: int = 10) -> DataFrame:
    """df with the scorer's reply for each text: distinct texts are scored and joined back; a null text has null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b[column].tolist()
            replies = [r for k in range(0, len(texts), batch) for r in call(scorer, texts[k : k + batch], fallback)]
            yield pd.DataFrame({column: texts, name: replies})

    scored = df.select(column).filter(F.col(column).isNotNull()).distinct().mapInPandas(run, f"`{column}` string, `{name}` {kind}")
    return df.join(scored, column, "left")


def translate(df: DataFrame, columns: list[str], languages: list[str], translator: Callable[[str, list[str]], list[str]]) -> DataFrame:
    """A row for each record and language; a text that fails stays as it is."""
    rows = df.withColumn("language", F.explode(F.array(*map(F.lit, languages))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            for language in b.language.unique():
                own = b.language == language
                for c in columns:
                    texts = b.loc[own, c].tolist()
                    got = call(lambda t: translator(language, t), texts)  # noqa: B023
                    b.loc[own, c] = [t if g is None else g for t, g in zip(texts, got)]
            yield b

    return rows.mapInPandas(run, rows.schema)


def text_verdict(profanity, relevance, passed, sensitivity: str = "medium"):
    """A text passes unless refused, if its profanity lies under the threshold and its relevance reaches half of it."""
    t = {"high": 0.7, "medium": 0.5, "low": 0.3}[sensitivity]
    return F.coalesce(passed, F.lit(True)) & (profanity < t) & (relevance >= t * 0.5)


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}
_FUNCTIONS = {n: getattr(math, n) for n in ("sqrt", "sin", "cos", "tan", "exp", "ceil", "floor")} | {"abs": abs, "round": round, "ln": math.log, "log": math.log, "pow": pow}


def evaluate(expression: str) -> float | None:
    """The value of an arithmetic expression, rounded to six places; null if it is none."""

    def value(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            left, right = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and (abs(left) > 1e6 or abs(right) > 100):
                raise ValueError("too large")
            return _OPERATORS[type(node.op)](left, right)
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.operand))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS:
            return _FUNCTIONS[node.func.id](*map(value, node.args))
        raise ValueError("not arithmetic")

    try:
        out = value(ast.parse(expression.replace("^", "**").strip(), mode="eval").body)
        return round(float(out), 6)
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError, RecursionError, MemoryError):
        return None


MATH = r"(?:\d+\.?\d*\s*[-+*/^%]\s*)+\d+\.?\d*(?=\s*=\s*\d)|(?:sqrt|sin|cos|tan|log|ln|exp|pow|abs|ceil|floor|round)\s*\([^)]+\)"


def math_expressions(text: str | None) -> list[str]:
    return [m.group().strip() for m in re.finditer(MATH, text or "")]


def math_filter(df: DataFrame, column: str) -> DataFrame:
    """Rows all of whose expressions can be evaluated; whether they are right is not asked."""

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: all(evaluate(e) is not None for e in math_expressions(t))).astype(bool)

    return df.filter(good(column))
