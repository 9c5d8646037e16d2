"""Operator 10: quality rules as one Spark projection.

A table of thresholds over counts of words, symbols, stop words and lines is
compiled into column expressions; nothing runs outside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.html_extract import STOP_WORDS
from tallyspark.llm.lambdas import let, shingle_hashes, words

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
MARKS = "[!?]"


@dataclass(frozen=True)
class Rule:
    """A document fails where 100 * part <op> percent * whole (whole None: the bare number)."""

    name: str
    part: str
    op: str
    percent: int
    whole: str | None = None
    base: bool = False

    def sql(self) -> str:
        return f"100 * {self.part} {self.op} {self.percent} * {self.whole}" if self.whole else f"{self.part} {self.op} {self.percent}"


#: The threshold table. The base rules are the contract's; the others are wide, so
#: that only texts far from prose fail them.
RULES = (
    Rule("few_words", "n_words", "<", 50, base=True),
    Rule("repeated_words", "n_repeat_words", ">", 50, "n_words", base=True),
    Rule("symbols", "n_symbols", ">", 5, "word_chars"),
    Rule("marks", "n_marks", ">", 10, "word_chars"),
    Rule("repeated_lines", "n_dup_lines", ">", 50, "n_lines"),
    Rule("short_words", "word_chars", "<", 200, "n_words"),
    Rule("long_words", "word_chars", ">", 2500, "n_words"),
    Rule("stop_words", "n_stop_words", "<", 4, "n_words"),
)


def repeated_words(hashes: Column, width: int = 3) -> Column:
    """Words covered by windows whose hash occurs twice or more, from the window hashes in order."""

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k)["x"] == e["x"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"))
        found = F.aggregate(let(by_hash, positions), start, step, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found)

    return let(hashes, covered)


def measures(text: Column) -> dict[str, Column]:
    """Counts of a text (null: none), each a long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    stop = [F.lit(w) for w in sorted(STOP_WORDS)]
    in_words = lambda f: let(words(text), f)
    counts = in_words(
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).alias("n_stop_words"),
            F.when(F.size(w) < 3, F.lit(0)).otherwise(repeated_words(shingle_hashes(w, 3))).alias("n_repeat_words"),
        )
    )
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    without = lambda signs: F.length(text) - F.length(F.regexp_replace(text, signs, ""))
    return {"_w": counts, "_l": line_counts, "_s": F.struct(without(SYMBOLS).alias("n_symbols"), without(MARKS).alias("n_marks"))}


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words and n_marks."""
    part = {"n_words": "_w", "word_chars": "_w", "n_symbols": "_s", "n_dup_lines": "_l", "n_repeat_words": "_w", "n_lines": "_l", "n_stop_words": "_w", "n_marks": "_s"}
    names = list(part)
    others = [c for c in df.columns if c not in names and c not in ("_w", "_l", "_s")]
    m = measures(F.col(f"`{text_col}`"))
    step = df.select(*[F.col(f"`{c}`") for c in others], m["_w"].alias("_w"), m["_l"].alias("_l"), m["_s"].alias("_s"))
    return step.select(*[F.col(f"`{c}`") for c in others], *[F.col(part[c])[c].cast("long").alias(c) for c in names])


def judged(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the measures, base_failed, kept and failed (the names of the failed rules).

    Null and empty texts have zero counts and fail few_words; repeated rows are
    judged alike; columns named like the new ones are replaced.
    """
    out = measured(df, text_col)
    base = " or ".join(f"({r.sql()})" for r in rules if r.base) or "false"
    every = " or ".join(f"({r.sql()})" for r in rules) or "false"
    names = F.array_compact(F.array(*[F.when(F.expr(r.sql()), F.lit(r.name)) for r in rules]))
    return out.withColumns({"base_failed": F.expr(base), "kept": ~F.expr(every), "failed": names})


def document_quality(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = judged(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_marks")


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL."""
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(STOP_WORDS))
    base = " or ".join(f"({r.sql()})" for r in rules if r.base)
    every = " or ".join(f"({r.sql()})" for r in rules)
    return rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) as g from w where len(w) >= 3),
c as (select doc_id, i, count(*) over (partition by doc_id, g) as n from g),
p as (select distinct doc_id, i + j as i from c, (values (0), (1), (2)) as o(j) where n > 1),
r as (select doc_id, count(*) as n from p group by doc_id),
m as (select w.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) as n_symbols, length(t) - length(regexp_replace(t, '{MARKS}', '', 'g')) as n_marks,
        len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, len(l) as n_lines,
        len(list_filter(w, lambda x: lower(x) in ({stop}))) as n_stop_words
      from w left join r on w.doc_id = r.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) as base_failed, not ({every}) as kept, n_lines, n_stop_words, n_marks from m
"""
