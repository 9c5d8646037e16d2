import random
import time

import pytest

from tallyspark.functions.blocks import marked_functions
from tallyspark.operators.stubs import STUB_MARKS, source_stubs


def named(src, language):
    return [(name, line) for name, line, _ in marked_functions(src, language, STUB_MARKS[language])]


CASES = {
    "rust": ("""// fn none() { panic!("STUB: not implemented") }
impl<T: Fn(u8) -> u8> A<T> {
    pub fn first(&self, a: [u8; 4]) -> [u8; 2] { panic!("STUB: not implemented") }
    fn second(&self) -> Vec<u8>
    where T: Clone,
    {
        let f = |x: u8| { panic!("STUB: not implemented") };
        let s = r#"fn inner() { "#; let c = '{';
        panic!("STUB: not implemented")
    }
    fn third() { let s = "panic!(\\"STUB: not implemented\\")"; }
}
mod m { fn outer() { fn inner() { panic!("STUB: not implemented") } } }
""", [("first", 3), ("second", 4), ("inner", 13)]),
    "go": ("""package p
var x = map[string]func(int) int{"a": nil}
func Written(a interface{}) error { s := `func No() { "STUB: not implemented" }`; return nil }
func (s *S) Method(a interface{}, b struct{ c int }) interface{} {
	panic("STUB: not implemented")
}
func Closed() { go func() { panic("STUB: not implemented") }() }
func asm(a int) int
func Last[T any](a T) (x struct{}) { // "STUB: not implemented"
	panic("STUB: not implemented")
}
""", [("Method", 4), ("Closed", 7), ("Last", 9)]),
    "java": ('''class A extends B {
  @Test(expected = X.class) @Deprecated
  public <T> List<T> first(int a) throws IOException {
    throw new UnsupportedOperationException("STUB: not implemented");
  }
  A(int b) { String s = """
     void no() { throw new UnsupportedOperationException("STUB: not implemented"); """; }
  int second(char c) { if (c == '{') { for (;;) { throw new UnsupportedOperationException("STUB: not implemented"); } } return 1; }
  Runnable third() { return new Runnable() { public void run() { throw new UnsupportedOperationException("STUB: not implemented"); } }; }
  void fourth() { list.forEach(x -> { throw new UnsupportedOperationException("STUB: not implemented"); }); }
}
record R(int a) { R { throw new UnsupportedOperationException("STUB: not implemented"); } }
''', [("first", 3), ("second", 8), ("run", 9), ("fourth", 10)]),
    "js": ("""const a = 1
function plain({ b, c }, d = "}") { throw new Error("STUB") }
const arrow = async ({ a }, [b]) => { throw new Error("STUB") }
const one = x => { throw new Error("STUB") }
const value = function () { throw new Error("STUB") }
class K extends mix(B) {
  static async #hidden(a) { throw new Error("STUB") }
  get size() { if (a / 2 > 1) { throw new Error("STUB") } }
  done() { const r = /[/{]"/g; return `${ `{` + (() => { return "}" })() } throw new Error("STUB")` }
}
app.get("/", (req) => { throw new Error("STUB") })
app.get("/", function handler(req) { throw new Error("STUB") })
// function no() { throw new Error("STUB") }
module.exports = { m() { throw new Error("STUB") }, n: () => { throw new Error("STUB") }, o: 'throw new Error("STUB")' }
""", [("plain", 2), ("arrow", 3), ("one", 4), ("value", 5), ("#hidden", 7), ("size", 8), ("handler", 12), ("m", 14), ("n", 14)]),
    "ts": ("""export class A<T> {
  constructor(private x: { y: number }) { throw new Error("STUB"); }
  public pair<U extends T>(a: U): { a: U; b: number } { throw new Error("STUB"); }
  over(a: string): void;
  over(a: any): void { throw new Error("STUB"); }
}
export const f = (a: number): string => { throw new Error("STUB"); };
export const g: F = async <T,>(a: T) => { throw new Error("STUB"); };
interface I { m(): void }
""", [("constructor", 2), ("pair", 3), ("over", 5), ("f", 7), ("g", 8)]),
    "cpp": ("""#define OPEN {
namespace n { template <class T> struct A {
  A(int a) : x_(a), y_{1}, z_{2} { __builtin_trap() /* STUB: not implemented */; }
  bool operator==(const A& o) const noexcept { return {}; }
  int operator()(int a) { __builtin_trap() /* STUB: not implemented */; }
  ~A() { int k = 1'000; auto s = R"x( } " )x"; }
  static constexpr auto k() -> int { return {}; }
}; }
int n::A<int>::far(char c) const { if (c == '}') { return {}; } return B{2}.f(1); }
[[nodiscard]] int last() { auto f = [&](int a) { return {}; }; }
// void no() { return {}; }
""", [("A", 3), ("operator==", 4), ("operator()", 5), ("k", 7), ("n::A::far", 9), ("last", 10)]),
    "c": ("""static int f(int a) {
  STUB_PANIC("f");
}
struct s __attribute__((unused)) g(void (*h)(int), char c)
{ while (1) { STUB_PANIC("g"); } }
int table[] = { 1, 2 }; char *x = "STUB_PANIC";
int h(void) { return f(1) /* STUB_PANIC */; }
""", [("f", 1), ("g", 4)]),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_stubs_by_brackets(language):
    source, want = CASES[language]
    assert named(source, language) == want


@pytest.mark.parametrize("language", sorted(CASES))
def test_no_source_ends_in_an_error_or_takes_long(language):
    rng = random.Random(language)
    signs = list("(){}[];,\"'`/*\\\n =:>") + ["fn f", "func f", "${", "=>", *STUB_MARKS[language]]
    for _ in range(200):
        marked_functions("".join(rng.choice(signs) for _ in range(60)), language, STUB_MARKS[language])
    began = time.time()
    for unit in ("{", "f(", '"', "f({a: 1}, ", "`${", "/*", "a = b / c ", "f(x) {", "[{},"):
        marked_functions(unit * (200_000 // len(unit)) + STUB_MARKS[language][0], language, STUB_MARKS[language])
    assert time.time() - began < 20


def test_stub_rows(spark):
    rows = [(k, source) for k, source in enumerate((CASES["rust"][0], "", None, CASES["rust"][0]))]
    got = source_stubs(spark.createDataFrame(rows, "doc long, text string").selectExpr("*", "1 as name"), "rust").collect()
    assert sorted((r.doc, r.name, r.line) for r in got) == sorted((d, *x) for d in (0, 3) for x in CASES["rust"][1])
    assert {r.signature for r in got if r.name == "second"} == {"fn second(&self) -> Vec<u8> where T: Clone,"}
    own = source_stubs(spark.createDataFrame([(1, "int f() { TODO(); }")], "doc long, text string"), "c", ("TODO(",))
    assert [tuple(r) for r in own.collect()] == [(1, "f", 1, "int f()")]
    assert source_stubs(spark.createDataFrame([], "doc long, text string"), "js").collect() == []


def test_lines_of_many_functions_take_one_pass():
    body = 'function f() {\n' + "\n" * 60 + 'throw new Error("STUB")\n}\n'
    began = time.time()
    found = marked_functions(body * 20_000, "js", STUB_MARKS["js"])
    assert [line for _, line, _ in found] == [63 * k + 1 for k in range(20_000)]
    assert time.time() - began < 10


def test_long_sources_give_all_stubs(spark):
    source = 'function f() { throw new Error("STUB") }\n' * 20_000
    got = source_stubs(spark.createDataFrame([(1, source), (2, None)], "doc long, text string"), "js")
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "string", "int", "string"]
    assert got.agg({"line": "max", "*": "count"}).first()[:] == (20_000, 20_000)
