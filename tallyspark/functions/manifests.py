"""Dependencies of Python projects: manifests, environment markers, required and optional imports."""

from __future__ import annotations

import ast
import configparser
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups of a manifest that hold what tests need, and requirement files of both kinds.
TEST_GROUPS = ("test", "testing", "tests", "dev")
RUNTIME_FILES = ("requirements.txt",)
TEST_FILES = ("requirements-test.txt", "requirements-tests.txt", "requirements-dev.txt", "requirements_test.txt", "requirements_dev.txt")

#: What a marker may ask of the target, and errors that excuse a missing module.
TARGET = {"sys_platform": "linux", "platform_system": "Linux", "os_name": "posix"}
EXCUSES = frozenset(("ImportError", "ModuleNotFoundError", "Exception", "BaseException"))

_MARKER = re.compile(r"\s*(?:(and|or|not\s+in|in)\b|(===|==|!=|<=|>=|~=|<|>)|([()])|\"([^\"]*)\"|'([^']*)'|([A-Za-z_.]+))")


def _version(text: str) -> tuple[int, ...]:
    if not re.fullmatch(r"\d+(\.\d+)*(\.\*)?", text):
        raise ValueError(text)
    numbers = [int(x) for x in text.removesuffix(".*").split(".")]
    while len(numbers) > 1 and numbers[-1] == 0 and not text.endswith(".*"):
        numbers.pop()
    return tuple(numbers)


def _compare(name: str, left: str, sign: str, right: str) -> bool:
    if sign in ("in", "not in"):
        return (left in right) == (sign == "in")
    if name != "python_version":
        if sign not in ("==", "!=", "==="):
            raise ValueError(sign)
        return (left == right) == (sign != "!=")
    a, b = _version(left), _version(right)
    same = a[: len(b)] == b if right.endswith(".*") else a == b
    if sign == "~=":
        whole = tuple(int(x) for x in right.split("."))
        return a >= b and a[: len(whole) - 1] == whole[:-1]
    return {"==": same, "===": same, "!=": not same, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]


def marker_holds(spec: str, python: str) -> bool:
    """Whether a requirement applies to ``python`` on Linux: `or` over `and` over comparisons and
    parentheses. Without a marker, with one that asks for anything else or that cannot be read, it does."""
    _, _, marker = spec.partition(";")
    at, tokens = 0, []
    marker = marker.strip()
    while at < len(marker):
        m = _MARKER.match(marker, at)
        if not m:
            return True
        word = re.sub(r"\s+", " ", m[1]) if m[1] else None
        tokens.append(("sign", word) if word in ("in", "not in") else (("word", word) if word else ("sign", m[2]) if m[2] else ("paren", m[3]) if m[3] else ("name", m[6]) if m[6] else ("text", m[4] if m[4] is not None else m[5])))
        at = m.end()
    known, place = TARGET | {"python_version": python}, 0

    def take(kind: str, value: str | None = None) -> str | None:
        nonlocal place
        if place < len(tokens) and tokens[place][0] == kind and value in (None, tokens[place][1]):
            place += 1
            return tokens[place - 1][1]
        return None

    def side() -> tuple[str, str]:
        if (name := take("name")) is not None:
            return name, known[name]
        if (text := take("text")) is not None:
            return "", text
        raise ValueError("a value is missing")

    def one() -> bool:
        if take("paren", "("):
            held = either()
            if not take("paren", ")"):
                raise ValueError("not closed")
            return held
        (name, left), sign, (other, right) = side(), take("sign"), side()
        if sign is None or not name and not other:
            raise ValueError("no comparison")
        return _compare(name or other, left, sign, right)

    def both() -> bool:
        held = one()
        while take("word", "and"):
            held = one() and held
        return held

    def either() -> bool:
        held = both()
        while take("word", "or"):
            held = both() or held
        return held

    if not tokens:
        return True
    try:
        held = either()
        return held if place == len(tokens) else True
    except (ValueError, KeyError):
        return True


def dependencies(path: str, text: str) -> Iterator[tuple[str, str]]:
    """(kind, requirement) of one manifest, runtime or test, in its order; of a broken one none."""
    name = path.rpartition("/")[2]
    try:
        if name == "pyproject.toml":
            data = tomllib.loads(text)
            project = data.get("project", {})
            for spec in project.get("dependencies", []):
                yield "runtime", spec
            for groups in (project.get("optional-dependencies", {}), data.get("dependency-groups", {})):
                for group in TEST_GROUPS:
                    yield from (("test", spec) for spec in groups.get(group, []) if isinstance(spec, str))
        elif name == "setup.cfg":
            config = configparser.ConfigParser(interpolation=None)
            config.read_string(text)
            lists = [("runtime", "options", "install_requires"), *(("test", "options.extras_require", g) for g in TEST_GROUPS)]
            for kind, section, option in lists:
                yield from ((kind, x.strip()) for x in config.get(section, option, fallback="").splitlines() if x.strip())
        elif name == "setup.py":
            for kind, option in (("runtime", "install_requires"), ("test", "tests_require")):
                listed = re.search(rf"\b{option}\s*=\s*\[([^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*)\]", text)
                yield from ((kind, x[0] or x[1]) for x in re.findall(r"'([^']+)'|\"([^\"]+)\"", listed[1] if listed else ""))
        elif name in RUNTIME_FILES or name in TEST_FILES:
            kept = (x.strip() for x in text.splitlines())
            yield from (("runtime" if name in RUNTIME_FILES else "test", x) for x in kept if x and x[0] not in "#-")
    except (tomllib.TOMLDecodeError, configparser.Error, AttributeError, TypeError):
        return


def imports(source: str) -> list[tuple[str, bool]]:
    """(module, required) of the top-level modules that a source imports absolutely, at any depth.

    An import whose `try` excuses a missing module is not required. Of a source that does
    not parse all that lines import is required.
    """
    found: dict[str, bool] = {}
    try:
        todo = [(node, True) for node in ast.parse(source).body]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return sorted({(m[1] or m[2], True) for m in re.finditer(r"(?m)^[ \t]*(?:from[ \t]+(\w+)[\w.]*[ \t]+import|import[ \t]+(\w+))", source)})

    def excused(handler: ast.ExceptHandler) -> bool:
        kinds = handler.type.elts if isinstance(handler.type, ast.Tuple) else [handler.type]
        return any(k is None or getattr(k, "id", getattr(k, "attr", "")) in EXCUSES for k in kinds)

    while todo:
        node, required = todo.pop()
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module] if isinstance(node, ast.ImportFrom) and node.module and not node.level else []
        for n in names:
            top = n.partition(".")[0]
            found[top] = found.get(top, False) or required
        tried = set(map(id, node.body)) if isinstance(node, ast.Try) and any(map(excused, node.handlers)) else ()
        todo += [(child, required and id(child) not in tried) for child in ast.iter_child_nodes(node)]
    return sorted(found.items())


def _pairs(first: str, second: str, kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(first, T.StringType()), T.StructField(second, kind)]))


def marker_applies(spec: Column, python: Column) -> Column:
    """``marker_holds`` of each row; without a version it applies, a null requirement gives null."""

    def run(specs: pd.Series, versions: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else v is None or marker_holds(s, v) for s, v in zip(specs, versions)], dtype=object)

    return F.pandas_udf(run, T.BooleanType())(spec, python)


def manifest_dependencies(path: Column, text: Column) -> Column:
    """array<struct<kind, spec>> of a manifest; null gives an empty array."""

    def run(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([list(dependencies(p or "", t or "")) for p, t in zip(paths, texts)], dtype=object)

    return F.pandas_udf(run, _pairs("kind", "spec", T.StringType()))(path, text)


def source_imports(source: Column) -> Column:
    """array<struct<module, required>> of a source; null gives an empty array."""

    def run(sources: pd.Series) -> pd.Series:
        return pd.Series([imports(s or "") for s in sources], dtype=object)

    return F.pandas_udf(run, _pairs("module", "required", T.BooleanType()))(source)
