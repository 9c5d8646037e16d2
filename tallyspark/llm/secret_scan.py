"""Operator 7: secret scans by character Markov models.

Fixed patterns find the known kinds. For the rest, two character bigram models,
of random strings and of ordinary identifiers, are trained from labelled samples
with Spark aggregations; a long run of key characters is a secret where some
stretch of it has log-likelihood ratios that together favour the random model, so
a name or path in the same run does not hide it. Only DataFrame functions run.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.lambdas import let, running, words

#: The known kinds in their order, and the least length of a match
#: (of the value for ``assign``).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST = 12

#: Runs that the models judge: key characters with a digit or both cases, 16 or more.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"

#: Bounds of the training samples: random strings made, documents whose words are taken.
RANDOM_STRINGS, IDENTIFIER_DOCS = 4_000, 4_000

#: A stretch is random where its log-likelihood ratios, each less PENALTY, sum to more
#: than THRESHOLD. So ordinary names, whose ratios lie about 0, gather nothing however
#: long they are. Chosen on planted strings and on names of words that train no model.
PENALTY, THRESHOLD = 0.7, 18.0

#: Words that are frequent in identifiers, gathered by hand for the ordinary
#: model's samples, and the samples made of them.
CODE_WORDS = """add all api app arg array async auth base batch block bool buffer build byte cache call case check class clean client close code column
command config connect const content context copy core count create current data date debug default delete directory disk document domain download element
enable encode env error event exec export field file filter find flag format frame function get group handle hash head header host image
import index info init input insert int item job json key label last length level library line link list load local lock log main manager map match max memory
menu message meta method min mode model module name network next node null number object offset open option order output owner package page param parse path
point port post process profile project property public query queue random range read record region register remove render report request reset
resource result return root route row run save schema scope search select server service session set size source start state status stop store stream string style
system table tag target task template test text thread time timer title token total type update upload url user util valid value version view width window write xml""".split()
CODE_SAMPLES = 20_000

_CODES = 128
_FEW_SPANS = 64


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratios of character bigrams, random against ordinary; code * 128 + next code."""

    ratios: tuple[float, ...]

    def column(self) -> Column:
        """The table as one constant array."""
        return F.split(F.lit(",".join(f"{r:.5f}" for r in self.ratios)), ",").cast("array<double>")


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled samples of random strings: digests in base64 of both kinds, base32 and hex."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    plain = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    upper = F.upper(F.translate(plain, "0189+/", "ABCDEF"))
    kind = F.col("id") % 4
    text = F.when(kind == 0, F.upper(F.substring(digest, 1, 40))).when(kind == 1, F.substring(upper, 1, 40)).when(kind == 2, F.lower(F.translate(plain, "+/", "-_"))).otherwise(plain)
    return spark.range(n).select(F.lit(True).alias("random"), text.alias("value"))


def joined(words: Column) -> Column:
    """Neighbouring words joined in the ways of identifiers, paths and settings."""

    def at(w: Column, x: Column, i: Column) -> Column:
        second, third = F.coalesce(F.get(w, i + 1), F.lit("")), F.coalesce(F.get(w, i + 2), F.lit(""))
        number = (i % 100).cast("string")
        forms = [
            F.concat(x, F.lit("_"), second), F.concat(x, F.initcap(second), F.initcap(third)), F.upper(F.concat(x, F.lit("_"), second)), F.concat(x, F.lit("/"), second, F.lit("/"), third),
            F.concat(x, F.lit("-"), second, number), F.concat(F.initcap(x), F.initcap(second)), F.concat(x, F.lit("="), second), F.concat(x, number),
        ]
        chosen = forms[-1]
        for k, form in enumerate(forms[:-1]):
            chosen = F.when(i % len(forms) == k, form).otherwise(chosen)
        return chosen

    return let(words, lambda w: F.transform(w, lambda x, i: at(w, x, i)))


def identifiers(docs: DataFrame, text_col: str = "text", most_docs: int = IDENTIFIER_DOCS) -> DataFrame:
    """Labelled samples of ordinary identifiers: words of about ``most_docs`` documents and words
    of programs, neighbours joined as identifiers join them, and numbers and times."""
    spark, count = docs.sparkSession, docs.count()
    share = int(min(1.0, most_docs / max(1, count)) * 1_000_000)
    rows = docs.filter(F.pmod(F.xxhash64(F.col(text_col), F.lit("identifiers")), F.lit(1_000_000)) < share)
    plain = F.filter(words(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[^A-Za-z]+", " ")), lambda w: F.length(w) >= 2)
    table = F.split(F.lit(" ".join(CODE_WORDS)), " ")
    code = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: F.get(table, F.pmod(F.xxhash64("id", j), F.lit(len(CODE_WORDS))).cast("int")))
    digits = lambda salt, n: F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**n)).cast("string"), n, "0")
    time = F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(4_000_000_000))), "yyyy-MM-dd'T'HH-mm")
    made = spark.range(CODE_SAMPLES)
    values = rows.select(F.explode(joined(plain)).alias("value")).unionByName(made.select(F.explode(joined(code)).alias("value")))
    values = values.unionByName(made.select(F.explode(F.array(digits("a", 16), digits("b", 5), time)).alias("value")))
    return values.select(F.lit(False).alias("random"), "value").filter("value is not null")


def train(samples: DataFrame) -> Markov:
    """Bigram models from (random, value), add-one smoothed, as log-likelihood ratios.

    Only the bigram counts, at most 2 * 128 * 128, reach the driver. Null and
    one-letter values count for nothing; without samples every ratio is 0.
    """
    at = F.explode(F.sequence(F.lit(1), F.length("value") - 1))
    pairs = samples.filter(F.length("value") >= 2).select("random", "value", at.alias("i"))
    code = lambda k: F.ascii(F.substring("value", F.col("i") + k, F.lit(1)))
    counts = pairs.select("random", code(0).alias("a"), code(1).alias("b")).filter(f"a < {_CODES} and b < {_CODES}").groupBy("random", "a", "b").count().collect()
    tables = {label: [[0] * _CODES for _ in range(_CODES)] for label in (True, False)}
    for r in counts:
        tables[r["random"]][r["a"]][r["b"]] += r["count"]
    alphabet = [c for c in range(_CODES) if chr(c).isalnum() or chr(c) in "+/_=-."]
    logs = {}
    for label, table in tables.items():
        sums = [sum(row) + len(alphabet) for row in table]
        logs[label] = [math.log((n + 1) / sums[a]) for a, row in enumerate(table) for n in row]
    return Markov(tuple(x - y for x, y in zip(logs[True], logs[False], strict=True)))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def best_stretch(value: Column, model: Markov) -> Column:
    """Largest sum over any stretch of a string's log-likelihood ratios less PENALTY; 0.0 below two characters."""

    def of(pair: Column) -> Column:
        codes, table = pair["c"], pair["t"]
        zero = F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("best"))

        def step(acc: Column, i: Column) -> Column:
            return let(acc["now"] + F.get(table, F.get(codes, i) * _CODES + F.get(codes, i + 1)) - PENALTY, lambda x: F.struct(F.greatest(x, F.lit(0.0)).alias("now"), F.greatest(x, acc["best"]).alias("best")))

        total = F.aggregate(F.sequence(F.lit(0), F.size(codes) - 2), zero, step, lambda acc: acc["best"])
        return F.when(F.size(codes) < 2, F.lit(0.0)).otherwise(total)

    codes = F.transform(characters(value), lambda c: F.ascii(c))
    return let(F.struct(codes.alias("c"), model.column().alias("t")), of)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern: array of (start, end, value) in code points."""
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def of(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        # the end of each match: what stands before it and all matches up to it
        steps = F.zip_with(found, pieces, lambda m, p: F.length(m) + F.length(p))
        ends = running(F.slice(steps, F.lit(1), F.size(found)), lambda a, b: a + b)
        span = lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"))
        return F.when(F.size(found) == 0, nothing).otherwise(F.zip_with(found, ends, span))

    return let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), of)


def is_assign(match: Column) -> Column:
    return F.length(F.regexp_extract(match, "^" + ASSIGN, 2)) >= ASSIGN_LEAST


def blanked(text: Column, pattern: str, which: Callable[[Column], Column]) -> Column:
    """The text with those matches of a pattern that ``which`` takes turned into as many spaces."""
    found, pieces = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)
    one = lambda p, m: F.concat(p, F.when(m.isNull(), "").when(which(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    return F.array_join(F.zip_with(pieces, found, one), "")


def scan(df: DataFrame, model: Markov, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Add ``spans_col``: array of (start, end, kind, rank) of the secrets in each whole text.

    Code points, end exclusive, by start and then kind. The known kinds come from
    the patterns alone; the models add spans that touch none of those. Null and
    empty texts give []; a text may hold overlapping spans of different kinds;
    rows are independent; a column named like the new one is replaced.
    """
    others = [c for c in df.columns if c not in (spans_col, "_t", "_assign", "_access", "_hex")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(*[F.col(f"`{c}`") for c in others], text.alias("_t"))
    t, low = F.col("_t"), F.lower(F.col("_t"))
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key")
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    assign = F.when(named, F.filter(matches(t, ASSIGN), lambda m: is_assign(m["value"]))).otherwise(empty)
    access = F.when(t.contains("AKIA"), matches(t, ACCESS)).otherwise(empty)
    tagged = lambda spans, rank: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))
    rows = rows.select(*[F.col(f"`{c}`") for c in others], "_t", assign.alias("_assign"), access.alias("_access"), matches(t, HEX).alias("_hex"))
    known = F.concat(tagged(F.col("_assign"), 0), tagged(F.col("_access"), 1), tagged(F.col("_hex"), 2))

    def random(m: Column) -> Column:
        v = m["value"]
        varied = v.rlike("[0-9]") | v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[^A-Z_-][A-Z]")
        return varied & (best_stretch(v, model) > THRESHOLD)

    # what is left of a run beside the known kinds is judged by itself
    rest = F.when(F.size("_assign") == 0, t).otherwise(blanked(t, ASSIGN, is_assign))
    rest = F.when(F.size("_access") == 0, rest).otherwise(blanked(rest, ACCESS, lambda m: F.lit(True)))
    rest = F.when(F.size("_hex") == 0, rest).otherwise(blanked(rest, HEX, lambda m: F.lit(True)))
    more = F.filter(matches(rest, CANDIDATE), random)
    every = F.array_sort(F.concat(known, tagged(more, 3)))
    kind = lambda rank: F.element_at(F.array(*[F.lit(k) for k in KINDS]), rank + 1)
    spans = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s["rank"]).alias("kind"), s["rank"].alias("rank")))
    return rows.select(*[F.col(f"`{c}`") for c in others], spans.alias(spans_col))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by ``mark``; null stays null."""

    def of(s: Column) -> Column:
        tops = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

        def join(p: Column) -> Column:
            x, top = p["s"], p["t"]
            before = lambda k: F.when(k == 0, 0).otherwise(F.get(top, k - 1))
            cut = lambda a, n: F.when(F.size(x) > _FEW_SPANS, F.array_join(F.slice(p["c"], a + 1, n), "")).otherwise(F.substring(text, a + 1, n))
            pieces = F.transform(x, lambda m, k: F.when(m["start"] >= before(k), F.concat(cut(before(k), m["start"] - before(k)), F.lit(mark))).otherwise(""))
            return F.concat(F.array_join(pieces, ""), cut(F.element_at(top, -1), F.length(text)))

        # many cuts go by characters, for each substring seeks its place from the start
        chars = F.when(F.size(s) > _FEW_SPANS, characters(text))
        return let(F.struct(s.alias("s"), tops.alias("t"), chars.alias("c")), join)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, of))


def trained(docs: DataFrame, text_col: str = "text") -> Markov:
    """The production model: made random strings against words of the documents."""
    return train(random_strings(docs.sparkSession).unionByName(identifiers(docs, text_col)))


def secrets(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = scan(docs.select("doc_id", "text"), trained(docs)).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(written(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        count("markov").alias("n_markov"),
    )
