"""Listings, messages, markers, manifests and imports by cases of their own."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import manifests, messages
from tallyspark.operators import listings


def ids(spark, operator, text, *more):
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc long, text string")
    return [r.test_id for r in operator(df, *more).orderBy("doc", "pos").collect()]


def test_listings(spark):
    assert ids(spark, listings.doctest_list, "[doctest] listing\n=====\n  a b \n\n---\ntest cases: 2\nc\r\n") == ["a b", "c"]
    assert ids(spark, listings.catch2_list, "All available test cases:\n  a: b\n      [tag]\n-----\n2 test cases: x\n") == ["a: b"]
    assert ids(spark, listings.boost_list, "s*\n    a*\n    b\n        c*\n            d *\nt\n    u*\n") == ["s", "a", "b/c", "b/d", "t/u"]
    assert ids(spark, listings.jest_list, '["/w/a.js", "b"]', "/w") == ["a.js", "b"]
    assert ids(spark, listings.jest_list, "[1\n/w/a b.test.ts\nPASS x/y\n/w/c d/e\nq/r\nplain\n", "/w/") == ["a b.test.ts", "q/r"]
    assert ids(spark, listings.vitest_list, 'x [{"name": "n", "file": "/w/f"}, {"name": ""}] y', "/w") == ["f > n"] and ids(spark, listings.vitest_list, "[{", "/w") == []
    assert ids(spark, listings.ctest_list, '{"tests": [{"name": "a"}, {}, {"name": ""}]}') == ["a"] and ids(spark, listings.ctest_list, "broken") == []


def asked(spark, column, body):
    got = spark.createDataFrame([(body,)], "b string").select(column(F.col("b")).alias("x")).first().x
    return json.loads(got) if isinstance(got, str) else got


def test_chat_to_responses(spark):
    chat = {
        "model": "m", "max_tokens": 5, "max_completion_tokens": 7, "stream": True, "temperature": 1, "tools": [{"a": 1}], "tool_choice": "auto", "reasoning": {"effort": "low"},
        "messages": [
            {"role": "system", "content": "be"}, {"role": "developer", "content": [{"type": "text", "text": "kind"}]}, {"role": "system", "content": ""}, {"role": "user", "content": "[not parts]"},
            {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"text": "b"}]}, {"role": "tool", "content": "r"}, {"content": None},
        ],
    }
    got = asked(spark, messages.chat_to_responses, json.dumps(chat))
    item = lambda role, text: {"type": "message", "role": role, "content": [{"type": "output_text" if role == "assistant" else "input_text", "text": text}]}
    assert got == {
        "model": "m", "instructions": "be\n\nkind", "input": [item("user", "[not parts]"), item("assistant", "ab"), item("user", "r"), item("user", "")],
        "max_output_tokens": 7, "stream": True, "tools": [{"a": 1}], "tool_choice": "auto", "reasoning": {"effort": "low"},
    }
    assert asked(spark, messages.chat_to_responses, '{"model": "m", "max_tokens": 3, "stream": false, "tools": []}') == {"model": "m", "input": [], "max_output_tokens": 3}
    assert asked(spark, messages.chat_to_responses, "broken {") is None and asked(spark, messages.chat_to_responses, "[1]") is None and asked(spark, messages.chat_to_responses, None) is None


def test_responses_to_chat(spark):
    build = lambda b: messages.responses_to_chat(b, F.lit("m"), F.lit(3))
    text = {"id": "r1", "status": "incomplete", "output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "a"}, {"type": "refusal", "text": "no"}, {"type": "text", "text": "b"}]}], "usage": {"input_tokens": 4, "output_tokens": 2, "input_tokens_details": {"cached_tokens": 1}}}
    got = asked(spark, build, json.dumps(text))
    assert got["id"] == "r1" and got["choices"] == [{"index": 0, "message": {"role": "assistant", "content": "ab"}, "finish_reason": "length"}]
    assert got["usage"] == {"prompt_tokens": 4, "completion_tokens": 2, "total_tokens": 6, "prompt_tokens_details": {"cached_tokens": 1}} and got["model"] == "m" and got["created"] == 3
    calls = asked(spark, build, json.dumps({"output": [{"type": "function_call", "name": "f", "arguments": "{}"}, {"type": "function_call", "call_id": "c", "id": "d"}]}))
    message = calls["choices"][0]["message"]
    assert "content" not in message and [c["id"] for c in message["tool_calls"]] == ["call_0", "c"] and calls["choices"][0]["finish_reason"] == "tool_calls"
    assert asked(spark, build, "{}")["choices"][0] == {"index": 0, "message": {"role": "assistant", "content": ""}, "finish_reason": "stop"}


def test_marker_truth_table():
    atoms = {'python_version < "3.9"': False, "python_version >= '3.10'": True, 'sys_platform == "win32"': False, "os_name != 'nt'": True, '"3.10" in python_version': True, "platform_system not in 'Windows'": True, "python_version == '3.10.*'": True, "python_version ~= '3.8'": True}
    for (a, x), (b, y), (c, z) in itertools.islice(itertools.product(atoms.items(), repeat=3), 0, 512, 3):
        assert manifests.marker_holds(f"p; {a} and {b} or {c}", "3.10") == (x and y or z)
        assert manifests.marker_holds(f"p ;{a} and ({b} or ({c}))", "3.10") == (x and (y or z))


@pytest.mark.parametrize("spec, holds", [
    ("p", True), ("p;", True), ("p; platform_machine == 'arm'", True), ("p; python_version <", True), ("p; (python_version < '3'", True), ("p; python_version < '3' junk", True),
    ("p; python_version < 'x'", True), ("p; 'a' == 'b'", True), ("p; os_name < 'a'", True), ("p; python_version == '3.10.0'", True), ("p; python_version < '3.9' and extra == 'x'", True), ("p; python_version<'3.9'", False), ("p; '3.9' > python_version", False), ("p; '3.11' > python_version", True),
])
def test_markers_fail_open(spec, holds):
    assert manifests.marker_holds(spec, "3.10") is holds


def test_manifests():
    toml = '[project]\ndependencies = ["a>=1", "b; os_name == \'nt\'"]\n[project.optional-dependencies]\ndev = ["c"]\ndocs = ["no"]\n[dependency-groups]\ntest = ["d", {include-group = "dev"}]\n'
    assert list(manifests.dependencies("x/pyproject.toml", toml)) == [("runtime", "a>=1"), ("runtime", "b; os_name == 'nt'"), ("test", "c"), ("test", "d")]
    cfg = "[options]\ninstall_requires =\n  a\n  b>1\n[options.extras_require]\ntests = c\ndocs = no\n"
    assert list(manifests.dependencies("setup.cfg", cfg)) == [("runtime", "a"), ("runtime", "b>1"), ("test", "c")]
    setup = "setup(install_requires=['a[x]>1', \"b; python_version < '3'\"], tests_require = [\n 'c'])"
    assert list(manifests.dependencies("setup.py", setup)) == [("runtime", "a[x]>1"), ("runtime", "b; python_version < '3'"), ("test", "c")]
    assert list(manifests.dependencies("requirements_dev.txt", "# x\n-r y\n\n a \n")) == [("test", "a")]
    for broken in (("pyproject.toml", "[[["), ("setup.cfg", "x"), ("other.txt", "a"), ("pyproject.toml", "project = 3"), ("setup.py", "")):
        assert list(manifests.dependencies(*broken)) == []


def test_imports():
    code = "import a.b, c\nfrom . import no\nfrom d.e import f\ntry:\n    import g\n    def x():\n        import h\nexcept (KeyError, builtins.ImportError):\n    import i\nelse:\n    import j\ntry:\n    import k\nexcept KeyError:\n    pass\ntry:\n    import c, m\nexcept:\n    pass\n"
    assert manifests.imports(code) == [("a", True), ("c", True), ("d", True), ("g", False), ("h", False), ("i", True), ("j", True), ("k", True), ("m", False)]
    assert manifests.imports("import a\n  from b.c import d\nthis is not python") == [("a", True), ("b", True)] and manifests.imports("") == []
    rng = random.Random(1)
    for _ in range(200):
        manifests.imports("".join(rng.choice(["import a\n", "try:\n", "    import b\n", "except:\n", "\x00", "    pass\n"]) for _ in range(8)))
