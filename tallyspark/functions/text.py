"""Strings: truncation, chunks, prose cleaning, hashes, names and proxies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.arrays import running

#: A control sequence of ECMA-48: its introducer, parameter bytes, intermediate bytes and the final byte.
ANSI = r"\x1b\[[\x30-\x3f]*[\x20-\x2f]*[\x40-\x7e]"

#: Lines of a documentation page that are no prose: whole titles, titles
#: before one name, and lines that begin so.
CRUFT_TITLES = [
    "Search", "Summary", "Read more", "List of all items", "Auto Trait Implementations", "Blanket Implementations", "Trait Implementations", "Implementations",
    "Structs", "Enums", "Traits", "Modules", "Functions", "Type Aliases", "Macros",
]
CRUFT_NAMED, CRUFT_STARTS = ["Crate", "Struct", "Enum", "Trait", "Module"], [r"502 Bad Gateway\b", "error sending request:"]
#: Titles that end the prose of a documentation page.
BOUNDARY_TITLES = [
    "Modules", "Structs", "Enums", "Traits", "Functions", "Macros", "Constants", "Type Aliases", "Re-exports", "Trait Implementations", "Auto Trait Implementations",
    "Blanket Implementations", "Implementations",
]

#: Navigation: such a line, a version number, or nothing but commas and semicolons.
CRUFT = rf"^\s*({'|'.join(CRUFT_TITLES)}|({'|'.join(CRUFT_NAMED)}) \S+|\d+(\.\d+){{1,3}}(\s*\([^)]+\))?\s*·?)\s*$|^\s*({'|'.join(CRUFT_STARTS)})|^[\s,;]+$"
#: Where the listing of an interface begins: such a title, or an item of code.
BOUNDARY = rf"^\s*({'|'.join(BOUNDARY_TITLES)})\s*$|^\s*impl(<.*>)?\s|^\s*pub (fn|const|static|struct|enum|trait|mod)\s"
#: A paragraph that is code: an item, a field, what ends in braces or a semicolon, a comment,
#: an attribute, type parameters, what closes or follows a parameter list.
CODE = r"^\s*(impl|pub|fn|let|use|struct|enum|trait|mod|where|type|const|static|async)\b|[{};]\s*$|^\s*//|^\s*[A-Za-z_]\w*:\s*[A-Z].*[,;]\s*$|<[A-Z][A-Za-z0-9_]*(,\s*[A-Z][A-Za-z0-9_]*)*>|^\s*#\[.*\]\s*$|^\s*\)[^a-zA-Z]*$|^\s*->\s|^\s*[&*]?(mut\s+)?self\b"

SENTENCE_END = r"[.!?][)\]\"'`]?\s*$"


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def strip_prefix(path: Column, root: str) -> Column:
    """A path relative to ``root``, without ./ in front."""
    base = root.rstrip("/") + "/"
    return F.regexp_replace(F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path), r"^\./", "")


def head_tail(text: Column, size: int = 2000, mark: str = "\n...\n") -> Column:
    """The first and last ``size`` characters of a longer text."""
    return F.when(F.length(text) <= 2 * size, text).otherwise(F.concat(F.substring(text, 1, size), F.lit(mark), F.right(text, F.lit(size))))


def chunks(text: Column, size: int) -> Column:
    """Cuts of about ``size`` characters, after the last line end of the last fifth of a cut if there is one.

    The cuts are found on the places of the line ends alone, so a long text is not copied at each.
    """
    keep = size - size // 5
    # the place behind each line end
    ends = running(F.transform(F.split(text, "\n", -1), lambda x: F.length(x) + 1), lambda a, b: a + b)

    def cuts(pair: Column) -> Column:
        n, at = pair["n"], pair["e"]

        def step(acc: Column, _: Column) -> Column:
            here = acc["at"]
            # the last line end up to here + size: ends rise, so a binary search finds it
            upto = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(0).alias("lo"), F.size(at).alias("hi")), lambda s, _: _halved(s, at, here + size), lambda s: s["lo"])
            last = F.when(upto > 0, F.get(at, upto - 1)).otherwise(0)
            end = F.when(n - here <= size, n).when(last - here > keep, last).otherwise(here + size)
            return F.when(here >= n, acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(end)).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor(n / keep).cast("int")), start, step, lambda acc: acc["out"])

    found = F.get(F.transform(F.array(F.struct(F.length(text).alias("n"), ends.alias("e"))), cuts), F.lit(0))
    pieces = lambda c: F.transform(c, lambda end, k: F.substring(text, F.when(k == 0, 0).otherwise(F.get(c, k - 1)) + 1, end - F.when(k == 0, 0).otherwise(F.get(c, k - 1))))
    return F.get(F.transform(F.array(found), pieces), F.lit(0))


def _halved(state: Column, at: Column, top: Column) -> Column:
    """One step of a binary search for the number of elements up to ``top``."""
    mid = F.shiftright(state["lo"] + state["hi"], 1)
    below = (state["lo"] < state["hi"]) & (F.get(at, mid) <= top)
    return F.struct(F.when(below, mid + 1).otherwise(state["lo"]).alias("lo"), F.when(below, state["hi"]).otherwise(mid).alias("hi"))


def clean_prose(text: Column, budget: int, rust: bool = True) -> Column:
    """The prose of a documentation page, cut after the last sentence within ``budget``.

    Navigation lines go. Lines are joined to paragraphs, which end at an empty line or
    after a sentence. ``rust``: the page ends where its interface is listed, navigation
    titles aside; paragraphs of code, of under three words, mostly of paths or signs,
    or that are neither a sentence nor a short heading go.
    Otherwise only paragraphs of one word go.
    """
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r", -1), lambda x: F.rtrim(x)), lambda x: ~x.rlike(CRUFT))
    if rust:
        stop = F.array_position(F.transform(lines, lambda x: x.rlike(BOUNDARY)), True)
        lines = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
    # a blank line or the end of a sentence ends a paragraph
    marked = F.array_join(F.transform(lines, lambda x: F.when(F.trim(x) == "", "\n").otherwise(F.concat(F.trim(x), F.when(x.rlike(SENTENCE_END), "\n").otherwise(" ")))), "")
    paragraphs = F.filter(F.transform(F.split(marked, "\n", -1), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")

    def prose(p: Column) -> Column:
        words = F.split(p, " ", -1)
        if not rust:
            return F.size(words) >= 2
        paths, signs = F.size(F.filter(words, lambda w: F.contains(w, F.lit("::")))), F.size(F.filter(words, lambda w: ~w.rlike(r"\p{L}")))
        whole = p.rlike(SENTENCE_END) | p.rlike(r"^[A-Z][A-Za-z0-9 ,/.&'’\-]{1,80}$") & (F.size(words) <= 6)
        return ~p.rlike(CODE) & (F.size(words) >= 3) & (paths <= F.floor(F.size(words) / 3)) & (signs <= F.floor(F.size(words) / 2)) & whole

    joined = F.array_join(F.filter(paragraphs, prose), "\n\n")
    cut = F.rtrim(F.regexp_extract(F.substring(joined, 1, budget), r"(?s)^.+[.!?]", 0))
    return F.when(F.length(joined) <= budget, joined).otherwise(cut)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 22)


def inventory_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("."), F.lit("-"))


def model_name(model: Column) -> Column:
    """A model's name without routing prefixes and its date."""
    return F.regexp_replace(F.regexp_replace(model, r"^((bedrock|vertex_ai|openai|azure|converse|openrouter)/)+", ""), r"-\d{4}-\d{2}-\d{2}$", "")


def provider(model: Column) -> Column:
    return F.when(model.startswith("bedrock/"), "bedrock").when(model.startswith("vertex_ai/"), "vertex").when(model.rlike("^(openai/)?(gpt|o[0-9])"), "openai").otherwise("other")


def token_proxy(text: Column) -> Column:
    """Words and signs of a text: a stand-in where a model's tokenizer is not at hand."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


def complexity(functions: Column) -> Column:
    """Size class of a code base by its functions."""
    return F.when(functions < 100, "small").when(functions < 500, "medium").when(functions < 2000, "large").otherwise("massive")


def package_name(spec: Column) -> Column:
    """The distribution name of a requirement, in lower case with hyphens."""
    return F.regexp_replace(F.lower(F.regexp_extract(spec, r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)), r"[-_.]+", "-")


def import_name(package: Column) -> Column:
    """The module that a distribution is imported as."""
    #: Distributions whose module has another name.
    known = {"pyyaml": "yaml", "pillow": "PIL", "scikit-learn": "sklearn", "beautifulsoup4": "bs4", "opencv-python": "cv2", "python-dateutil": "dateutil", "attrs": "attr"}
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, package), F.replace(package, F.lit("-"), F.lit("_")))


def elapsed(start: Column, end: Column) -> Column:
    """HH:MM:SS between two timestamps."""
    s = F.unix_timestamp(end) - F.unix_timestamp(start)
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat_ws(":", two(s / 3600), two((s % 3600) / 60), two(s % 60))


def top_imports(source: Column) -> Column:
    """Top-level modules that Python source imports at the start of a line."""
    plain = F.regexp_extract_all(source, F.lit(r"(?m)^import\s+(\w+)"), F.lit(1))
    frm = F.regexp_extract_all(source, F.lit(r"(?m)^from\s+(\w+)[\w.]*\s+import"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(plain, frm)))


def markdown_html(text: Column) -> Column:
    """Headings, bold, code and paragraphs of Markdown as HTML."""
    out = F.regexp_replace(text, r"(?m)^### (.+)$", "<h3>$1</h3>")
    out = F.regexp_replace(out, r"(?m)^## (.+)$", "<h2>$1</h2>")
    out = F.regexp_replace(out, r"(?m)^# (.+)$", "<h1>$1</h1>")
    out = F.regexp_replace(out, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    out = F.regexp_replace(out, "`([^`]+)`", "<code>$1</code>")
    return F.regexp_replace(out, r"(?m)^(?!<h\d>)(\S.*)$", "<p>$1</p>")


def toml_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, escaped in (('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


#: The criteria of every rubric (id, concern, whether anchors can settle it).
BACKBONE = (
    ("bb.intent_fidelity", "L2.INTENT_FIDELITY", True),
    ("bb.reasoning_faithfulness", "L2.REASONING_FAITHFULNESS", False),
    ("bb.stage_legitimacy", "L2.STAGE_LEGITIMACY", False),
    ("bb.oracle_strength", "L2.ORACLE_STRENGTH", True),
)


def backbone_criteria(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BACKBONE, "id string, concern string, anchorable boolean")


def without_answer_key(text: Column) -> Column:
    """A criterion that does not name the file of the answer key."""
    return F.regexp_replace(text, r"(?i)TRUTH\.md", "the behavioral contract")
