"""Calls in answers that the retrieved text doesn't mention. Code is parsed, never run."""

from __future__ import annotations

import ast
import builtins
import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A block of code in an answer.
FENCE = re.compile(r"```(\w*)\n(.*?)```", re.DOTALL)
#: A name before a parenthesis, and words of C++ that aren't calls of what is documented.
CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
KEYWORDS = frozenset(
    "if else for while do switch case break continue return new delete sizeof static_cast dynamic_cast "
    "reinterpret_cast const_cast typename template namespace using auto printf cout cin endl assert".split()
)
BUILTINS = frozenset(dir(builtins)) | KEYWORDS
#: Answers that are checked at once; a long one may have thousands of calls.
ROWS = 64


def code_blocks(answer: str) -> list[tuple[str, str]]:
    """(language, code) of the fenced blocks; without any, the whole answer if it is Python."""
    found = [(lang.lower(), code) for lang, code in FENCE.findall(answer)]
    return found or ([("python", answer)] if _tree(answer) is not None else [])


def _tree(code: str) -> ast.AST | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def calls(language: str, code: str) -> list[str]:
    """Names of the functions called: by syntax if the block is Python, else names before a parenthesis."""
    tree = _tree(code) if language in ("", "py", "python") else None
    if tree is None:
        return CALL.findall(code)
    named = [(n.lineno, n.col_offset, n.func.id if isinstance(n.func, ast.Name) else n.func.attr) for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))]
    return [name for *_, name in sorted(named)]


def arities(name: str, text: str) -> list[int]:
    """The different numbers of arguments with which ``name(...)`` is written in a text, parentheses inside one argument aside; unbalanced ones are passed over."""
    out: set[int] = set()
    for m in re.finditer(re.escape(name) + r"\s*\(", text):
        depth, commas, at = 1, 0, m.end()
        while at < len(text) and depth:
            depth += (text[at] == "(") - (text[at] == ")")
            commas += text[at] == "," and depth == 1
            at += 1
        if not depth:
            out.add(commas + 1 if text[m.end() : at - 1].strip() else 0)
    return sorted(out)


def check(answer: str, observations: str, known: Callable[[str], bool] | None = None) -> list[tuple[str, str, str]]:
    """(call, kind, reason) for each name, at its first call, that isn't in the observations or is there with several numbers of arguments.

    ``known`` may clear a name that isn't there, as a standard function; without it, or where it fails, nothing is cleared.
    """
    out, seen, low = [], set(BUILTINS), observations.lower()
    for language, code in code_blocks(answer):
        for name in calls(language, code):
            if name in seen:
                continue
            seen.add(name)
            if name.lower() in low:
                if len(n := arities(name, observations)) > 1:
                    out.append((name, "ambiguous_overload", f"written with {', '.join(map(str, n))} arguments"))
            elif not _cleared(known, name):
                out.append((name, "unknown_name", "not in the retrieved text"))
    return out


def _cleared(known: Callable[[str], bool] | None, name: str) -> bool:
    try:
        return bool(known and known(name))
    except Exception:  # the classifier is a model behind a network
        return False


def flags(answers: DataFrame, keys: list[str], known: Callable[[str], bool] | None = None) -> DataFrame:
    """``<keys>, call, kind, reason`` for each flag of ``answers(<keys>, answer, observations)``; a task asks ``known`` once for each name."""
    rows = answers.select(*keys, "answer", "observations")
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = known and functools.lru_cache(maxsize=10_000)(functools.partial(_cleared, known))
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            at, made = [], []
            for i, (answer, seen) in enumerate(zip(b["answer"].to_pylist(), b["observations"].to_pylist(), strict=True)):
                found = check(answer or "", seen or "", once)
                at += [i] * len(found)
                made += found
            taken = [b.column(i).take(pa.array(at, pa.int64())) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array([m[i] for m in made], pa.string()) for i in range(3))], [*keys, "call", "kind", "reason"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(run, f"{kinds}, call string, kind string, reason string")
