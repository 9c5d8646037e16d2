"""Stubs in sources made of table rows: four lines a function, with marks in comments, literals and closures."""

from __future__ import annotations

from tallyspark.operators import stubs as S
from tallyspark.plans.registry import query
from tallyspark.plans.rendered import E, numbers, text_of

#: Of each language three heads of functions and one of something else, % being the number of the
#: function; what a body holds: the mark, the mark in a literal, the mark in a closure.
HEADS = {
    "rust": ("fn f%(a: [u8; 2]) -> [u8; 2]", "pub fn f%<T: Fn(u8) -> u8>(&self, t: T)", "unsafe fn f%() -> u8 where u8: Copy,", "mod f%"),
    "cpp": ("int f%(int (*g)(int))", "N::f%(int a) : x_", "constexpr auto f%(int a) const noexcept -> int", "namespace f%"),
    "java": ("public int f%(int a) throws E", "@A(b = 1) <T> List<T> f%(@B(c) T t)", "f%()", "interface f%"),
    "js": ("function f%({ a, b }, c = {})", "f% = async ({ a }) =>", "static async f%(a)", "if (f%)"),
    "ts": ("export function f%<T>(a: T): string", "f%(a: { b: number }): void", "const f% = async (a: string): Promise<void> =>", "class f%"),
}
BODIES = {
    "rust": ("!;", 'let s = r#"{ ! "#;', "let g = |x: u8| { ! };"),
    "cpp": ("!;", 'auto s = R"x({ ! )x";', "auto g = [&](int a) { !; };"),
    "java": ("throw new !;", 'String s = """{ ! """;', "g(x -> { throw new !; });"),
    "js": ("!", "const s = `{ ${ `}` } !`", "g(() => { ! })"),
    "ts": ("!", "const s = `{ ${ `}` } !`", "g((): void => { ! })"),
}
NAMES = {"cpp": "case when k = 1 then 'N::f' else 'f' end"}


def _numbered(head: str) -> str:
    return "concat(" + ", i, ".join(f"'{part}'" for part in head.split("%")) + ")"


def _add(language: str) -> None:
    mark = S.STUB_MARKS[language][0]
    head = "case k " + " ".join(f"when {n} then {_numbered(h)}" for n, h in enumerate(HEADS[language])) + " end"
    body = "case p " + " ".join(f"when {n} then '{b.replace('!', mark)}'" for n, b in enumerate(BODIES[language])) + " end"
    # a member of C++ is set in braces of its own before the body
    opens = "if(k = 1, '{1} {', ' {')" if language == "cpp" else "' {'"
    text = f"concat('// was {{ {mark}', chr(10), {head}, {opens}, chr(10), {body}, chr(10), '}}')"

    @query(f"{language}_stubs", f"with {E}, n as (select *, row_number() over (partition by doc order by pos) as n from e) select doc, concat({NAMES.get(language, repr('f'))}, i) as name, 4 * n - 2 as line, {head} as signature from n where k < 3 and p <> 1")
    def stubs(spark, d):
        """2.9.33."""
        return S.source_stubs(text_of(numbers(spark, d), text), language)


for _language in HEADS:
    _add(_language)
