"""Validation, block lists, scoring of candidates, paths, predicates and split resolution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that an entry must have.
REQUIRED = ("instance_id", "repo", "original_repo", "base_commit", "reference_commit", "setup", "test", "src_dir")
SHA = "^[0-9a-f]{7,64}$"
NAME = "^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"

#: Files that a patch may not touch: names of scoring, build and
#: configuration files and of tests, folders of tests, roots of tests in a path.
CONFIG_GLOBS = """
conftest.py pytest.ini tox.ini setup.cfg setup.py pyproject.toml .coveragerc noxfile.py sitecustomize.py usercustomize.py *.pth
Makefile GNUmakefile CMakeLists.txt CMakePresets.json configure configure.ac meson.build meson_options.txt
package.json package-lock.json npm-shrinkwrap.json pnpm-lock.yaml yarn.lock jest.config.* vitest.config.* .mocharc.* karma.conf.* babel.config.* .babelrc* .npmrc
go.mod go.sum go.work go.work.sum .golangci.yml .golangci.yaml tools.go
Cargo.toml Cargo.lock build.rs rust-toolchain rust-toolchain.toml
pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts gradle.properties gradlew gradlew.bat mvnw mvnw.cmd
.env .gitattributes .gitmodules
""".split()
TEST_GLOBS = """
test_*.py *_test.py *_test.go *.test.js *.test.mjs *.test.cjs *.test.jsx *.spec.js *.spec.mjs *.spec.cjs *.spec.jsx
*.test.ts *.test.tsx *.spec.ts *.spec.tsx *Test.java *Tests.java *IT.java *Spec.groovy
*_test.c test_*.c test_*.h *_test.cpp test_*.cpp *_test.cc test_*.cc
""".split()
TEST_FOLDERS = ("tests", "test", "__tests__", "testdata", "benches", "__snapshots__")
TEST_ROOTS = ("src/test/", "src/androidtest/", "src/integrationtest/")

#: What a Java candidate needs.
LEAST_TESTS, BUILD_SYSTEMS, JDKS = 50, ("maven", "gradle"), ("11", "17", "21")

#: Topics of a library, its licences, words for and against it.
LIBRARY_TOPICS = "library c-library single-header header-only embedded json yaml toml parser hash crypto compression".split()
FREE_LICENCES = ("MIT", "BSD-2-CLAUSE", "BSD-3-CLAUSE", "APACHE-2.0", "ISC")
LIBRARY_WORDS, SYSTEM_WORDS = "library|json|yaml|toml|parser", "kernel|driver|firmware|bootloader"

#: What pages say that are missing, or that want to see a human.
MISSING_TITLES = ("404", "page not found", "project not found", "not found")
MISSING_PHRASES = (
    "the page you requested was not found", "this page doesn't exist", "nothing to see here", "the project you requested does not exist",
    "the page you are looking for could not be found", "this page could not be found", "we couldn't find the page", "the requested page was not found",
)
MISSING_FIRST_LINES = ("404", "page not found", "not found", "project not found", "404 not found", "404 error", "404 page not found")
CAPTCHA_PHRASES = (
    "This website uses a security service to protect against malicious bots", "This page is displayed while the website verifies you are not a bot",
    "Checking if the site connection is secure", "Enable JavaScript and cookies to continue", "Verify you are human", "Please verify you are a human",
)
CHALLENGE_MARKS = ("cdn-cgi/challenge-platform", "cf-browser-verification", "cf_chl_opt", "Checking your browser", "Attention Required! | Cloudflare", "Just a moment...", "_cf_chl_")


def entry_issues(entry: Column, versions: list[str]) -> Column:
    """Issues of an entry, a map of strings: missing keys, bad commits, unknown version."""
    missing = [F.when(~F.map_contains_key(entry, k), F.lit(f"missing {k}")) for k in REQUIRED]
    commits = [F.when(F.map_contains_key(entry, k) & ~entry[k].rlike(SHA), F.lit(f"bad {k}")) for k in ("base_commit", "reference_commit")]
    version = F.when(F.map_contains_key(entry, "version") & ~entry["version"].isin(*versions), F.lit("unknown version"))
    return F.array_compact(F.array(*missing, *commits, version))


def issues(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in their order; a rule that cannot be decided is not broken."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def candidate_flags(tests: Column, build: Column, jdk: Column, licence: Column) -> dict[str, Column]:
    """What makes a Java repository a candidate; an absent value is no reason to take it."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    return {
        "has_tests": sure(tests >= LEAST_TESTS), "has_build_system": sure(build.isin(*BUILD_SYSTEMS)), "compatible_jdk": sure(jdk.isin(*JDKS)),
        "has_license": sure(licence != ""), "is_active": F.lit(True),
    }


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME), F.lit(False))


def unblocked(candidates: DataFrame, blocked: DataFrame) -> DataFrame:
    """Candidates that are not on the list, nor forks, archived or disabled."""
    return candidates.filter("not (fork or archived or disabled)").join(blocked.select("full_name"), "full_name", "left_anti")


def enriched(candidates: DataFrame, language: str, least: float, doc_topics: list[str]) -> DataFrame:
    """Candidates with enough of a language, and whether they have documentation."""
    total = F.aggregate(F.map_values("languages"), F.lit(0).cast("long"), lambda a, x: a + x)
    pct = F.coalesce(F.round(100 * F.coalesce(F.try_element_at("languages", F.lit(language)), F.lit(0)) / F.nullif(total, F.lit(0)), 1), F.lit(0.0))
    docs = F.coalesce(F.col("homepage") != "", F.lit(False)) | F.arrays_overlap("topics", F.array(*map(F.lit, doc_topics)))
    return candidates.withColumn("pct", pct).withColumn("has_docs", docs).filter(F.col("pct") >= least)


def candidate_score(stars: Column, size_kb: Column, licence: Column, topics: Column, text: Column) -> Column:
    """Piecewise score of a candidate repository: small, freely licensed libraries score high."""
    size = F.when(size_kb < 5000, 10).when(size_kb < 30_000, 5).otherwise(-5)
    named = F.coalesce(licence, F.lit(""))
    lic = F.when(F.upper(named).isin(*FREE_LICENCES), 8).when(named != "", 2).otherwise(-10)
    shared = 3 * F.size(F.array_intersect(topics, F.array(*map(F.lit, LIBRARY_TOPICS))))
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.when(low.rlike(LIBRARY_WORDS), 3).otherwise(0) - F.when(low.rlike(SYSTEM_WORDS), 8).otherwise(0)
    return F.round(F.least(stars / 1000, F.lit(30.0)) + size + lic + shared + words, 4)


def url_facts(url: Column) -> dict[str, Column]:
    """Parts of a URL and whether a crawl takes it: no fragment, no sign-in path, no redirect query."""
    path = F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))
    signs = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ("login", "signin", "signup", "logout", "auth", "account"))))
    query = F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit(""))
    fragment = F.parse_url(url, F.lit("REF")).isNotNull()
    redirect = query.rlike("(^|&)(next|redirect|return_to|continue)=")
    return {"host": F.parse_url(url, F.lit("HOST")), "path": path, "fragment": fragment, "takes": ~(fragment | signs | redirect)}


def contains_any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(text, F.lit(mark))
    return out


def _squeezed(text: Column) -> Column:
    """In lower case, with single blanks between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def page_flags(html: Column, text: Column) -> dict[str, Column]:
    """Soft-404, captcha, challenge and blank pages, from a page's markup and its text."""
    low = F.lower(F.btrim(text, F.lit(" \n\t\r")))
    first = F.regexp_replace(F.btrim(F.get(F.split(low, "\n"), F.lit(0)), F.lit(" \t\r")), r"[.!:;, ]+$", "")
    short = (F.length(low) <= 500) & (contains_any(low, MISSING_PHRASES) | first.isin(*MISSING_FIRST_LINES))
    # a title counts up to the sign that parts it from the name of the site
    titles = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<title\b[^>]*>([^<]*)"), F.lit(1)), lambda t: F.get(F.split(_squeezed(t), " ?[|:\u2014-]"), F.lit(0)))
    headings = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h1\b[^>]*>([^<]*)</h1>"), F.lit(1)), _squeezed)
    return {
        "soft_404": F.arrays_overlap(F.concat(titles, headings), F.array(*map(F.lit, MISSING_TITLES))) | short,
        "captcha": contains_any(F.lower(text), tuple(x.lower() for x in CAPTCHA_PHRASES)),
        "challenge": contains_any(html, CHALLENGE_MARKS),
        "blank": F.length(low) == 0,
    }


def patched_paths(patch: Column) -> Column:
    """Distinct paths that a unified diff touches: those of +++, --- and diff lines, so that
    deleted, renamed and header-only files count; without prefixes, quotes, times and /dev/null."""
    found = lambda pattern, k=1: F.regexp_extract_all(patch, F.lit(pattern), F.lit(k))
    raw = F.concat(found(r"(?m)^\+\+\+ (.+?)\s*$"), found(r"(?m)^--- (.+?)\s*$"), found(r"(?m)^diff --git (.+?) (.+?)\s*$"), found(r"(?m)^diff --git (.+?) (.+?)\s*$", 2))

    def clean(p: Column) -> Column:
        bare = F.regexp_replace(F.trim(F.get(F.split(p, "\t"), F.lit(0))), '^"(.*)"$', "$1")
        return F.when(bare != "/dev/null", F.replace(F.regexp_replace(bare, "^[ab]/", ""), F.lit("\\"), F.lit("/")))

    return F.array_distinct(F.array_remove(F.array_compact(F.transform(raw, clean)), ""))


def _any_glob(globs: list[str]) -> str:
    return "^(" + "|".join(re.escape(g.lower()).replace(r"\*", ".*") for g in globs) + ")$"


def cheat_reason(path: Column) -> Column:
    """Why a patch may not touch a path, null where it may; case does not matter."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.filter(F.split(low, "/"), lambda x: (x != "") & (x != "."))
    base = F.coalesce(F.try_element_at(parts, F.lit(-1)), low)
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    told = lambda what, name: F.concat(F.lit(f"{what} ("), name, F.lit(")"))
    return (
        F.when(base.rlike(_any_glob(CONFIG_GLOBS)), told("scoring/build/config file", base))
        .when(base.rlike(_any_glob(TEST_GLOBS)), told("test file", base))
        .when(F.arrays_overlap(folders, F.array(*map(F.lit, TEST_FOLDERS))), told("file under a test directory", path))
        .when(contains_any(low, TEST_ROOTS), told("file under a test source root", path))
    )


def touches_protected(patch: Column) -> Column:
    """Whether a patch touches a path that ``cheat_reason`` names; null touches none.

    Names without a star are looked up, those with one are tested by their own short expression,
    and the first path that is hit ends the search.
    """
    globs = [g.lower() for g in CONFIG_GLOBS + TEST_GLOBS]
    exact, starred = [g for g in globs if "*" not in g], [g for g in globs if "*" in g]
    inside = f"(^|/)({'|'.join(map(re.escape, TEST_FOLDERS))})/"

    def hit(path: Column) -> Column:
        low = F.regexp_replace(F.lower(path), r"(/\.?)+$", "")
        base = F.substring_index(low, "/", -1)
        return base.isin(*exact) | low.rlike(inside) | contains_any(F.lower(path), TEST_ROOTS) | base.rlike(_any_glob(starred))

    return F.when(F.trim(F.coalesce(patch, F.lit(""))) == "", F.lit(False)).otherwise(F.exists(patched_paths(patch), hit))


def kept_sections(patch: Column, suffix: str, build_dirs: tuple[str, ...] = ("target", "build", "node_modules")) -> Column:
    """A patch without sections of build folders or of files of another suffix; two line ends if nothing stays."""
    sections = F.filter(F.split(patch, r"(?m)(?=^diff --git )"), lambda s: s.startswith("diff --git "))
    head = lambda s: F.regexp_extract(s, r"^diff --git a/(\S+)", 1)
    kept = F.filter(sections, lambda s: head(s).endswith(suffix) & ~head(s).rlike(rf"(^|/)({'|'.join(build_dirs)})/"))
    return F.when(F.size(kept) == 0, F.lit("\n\n")).otherwise(F.array_join(kept, ""))


def lint_kind(line: Column, package: str) -> Column:
    """CODE, ENV or UNKNOWN by the rule at a line's end; an import of the own package is CODE."""
    rule = F.regexp_extract(line, r"\[(\w+)\]\s*$", 1)
    imported = F.regexp_extract(line, r'[Ii]mport "([\w.]+)"', 1)
    own = (imported == package) | imported.startswith(package + ".")
    return F.when(rule.isin("reportMissingImports", "reportMissingModuleSource", "import"), F.when(own, "CODE").otherwise("ENV")).when(rule != "", "CODE").otherwise("UNKNOWN")


def usable_pattern(pattern: str | None) -> bool:
    try:
        re.compile(pattern or "")
    except re.error:
        return False
    return True


def evaluate_predicates(code: DataFrame, predicates: list[dict]) -> DataFrame:
    """(code_id, predicate, passed) for a small list of whitelisted predicates; an unknown kind or
    a pattern that is no regular expression passes."""
    text, checks = F.col("code"), []
    for p in predicates:
        kind, target = p["kind"], p["target"]
        if kind in ("pattern_present", "pattern_absent") and not usable_pattern(target):
            ok = F.lit(True)
        elif kind == "pattern_present":
            ok = text.rlike(target)
        elif kind == "pattern_absent":
            ok = ~text.rlike(target)
        elif kind == "literal_absent":
            ok = ~F.contains(text, F.lit(target))
        elif kind == "symbol_present":
            ok = text.rlike(rf"\b(def|class|fn|func)\s+{re.escape(target)}\b")
        elif kind == "import_present":
            ok = text.rlike(rf"(?m)^\s*(import|from|use)\s+{re.escape(target)}\b")
        else:
            ok = F.lit(True)
        checks.append(F.struct(F.lit(p["id"]).alias("predicate"), F.coalesce(ok, F.lit(False)).alias("passed")))
    return code.select("code_id", F.explode(F.array(*checks)).alias("p")).select("code_id", "p.*")


def resolve_split(name: str, rows: DataFrame, curated: dict[str, list[str]]) -> DataFrame:
    """(basename, pos) of a split in first-seen order: all, a curated list, an alias, or one that
    differs by - and _ only; else none. ``rows``: (pos, instance_id, repo, original_repo)."""
    base = F.element_at(F.split("repo", "/"), -1)
    known = rows.select("pos", base.alias("basename"), "instance_id", "repo", "original_repo")
    alike = lambda c: F.replace(F.col(c), F.lit("_"), F.lit("-")) == name.replace("_", "-")
    if name == "all" or name.startswith("all_"):
        hit = F.lit(True)
    elif name in curated:
        hit = F.col("basename").isin(*curated[name])
    else:
        exact = (F.col("instance_id") == name) | (F.col("repo") == name) | (F.col("original_repo") == name) | (F.col("basename") == name)
        hit = exact | alike("basename")
    return known.filter(hit).groupBy("basename").agg(F.min("pos").alias("pos"))


def pin_status(pins: DataFrame, versions: DataFrame) -> DataFrame:
    """(package, status): gone packages drop, pins that no version meets warn, unknown ones stay."""
    have = versions.groupBy("package").agg(F.collect_set("version").alias("versions"), F.bool_or("gone").alias("gone"))
    rows = pins.join(have, "package", "left")
    met = F.exists("versions", lambda v: v == F.col("pin"))
    return rows.select("package", F.when(F.col("gone"), "dropped").when(F.col("versions").isNull() | F.col("pin").isNull(), "kept").when(met, "kept").otherwise("warned").alias("status"))


def is_test_path(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return path.rlike(r"(^|/)(tests?|testing|__tests__|spec)/") | name.rlike(r"^test_.*\.py$|_test\.(py|go)$|\.(test|spec)\.[jt]sx?$|^conftest\.py$")


def is_source_path(path: Column, suffix: str) -> Column:
    return path.endswith(suffix) & ~is_test_path(path) & ~path.rlike(r"(^|/)(docs?|examples?|build|\.git|node_modules)/") & ~path.rlike(r"(^|/)(setup|noxfile)\.py$")


def command_issues(command: Column) -> Column:
    """Warnings about a test command."""
    return F.array_compact(F.array(
        F.when(F.coalesce(F.trim(command), F.lit("")) == "", F.lit("empty")),
        F.when(command.rlike(r"\bsudo\b"), F.lit("sudo")),
        F.when(~command.rlike(r"\b(ctest|pytest|cargo test|go test|npm test|make (check|test))\b"), F.lit("no runner")),
        F.when(command.rlike(r"&&\s*$|\|\s*$"), F.lit("dangling operator")),
    ))


def upload_decision(status: Column, lenient: Column) -> Column:
    return (status == "ok") | lenient
