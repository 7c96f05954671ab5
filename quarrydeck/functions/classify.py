"""Classification of paths, symbols and scores, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .text import basename, dirname, extension

# Directories that a scan leaves out.
SKIP_DIRS = """.git vendor node_modules __pycache__ .venv build dist target out _app .svelte-kit .next .nuxt .output coverage
.work .tmp tmp .cache .parcel-cache .turbo .angular .idea .vscode .devcontainer testdata .terraform .gradle .mvn
.bundle Pods .dart_tool .pub-cache __generated__ storybook-static""".split()

# File extensions and their languages.
LANGUAGES = {
    ".go": "go", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".py": "python", ".rs": "rust", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".java": "java", ".rb": "ruby", ".php": "php", ".lua": "lua", ".zig": "zig", ".swift": "swift", ".kt": "kotlin",
}
# Languages known by their extension only.
EXTENSION_ONLY = ["lua", "zig", "swift", "kotlin"]

MAX_FILE_SIZE = 50_000

# Kinds of declarations and their weights, for display and for the score.
DISPLAY_WEIGHT = {"struct": 10, "interface": 10, "class": 10, "trait": 9, "type": 8, "enum": 8, "function": 6, "fn": 6, "method": 5, "case": 4, "constant": 3, "const": 3, "variable": 3, "var": 3, "static": 3, "property": 3, "namespace": 0}
SCORE_WEIGHT = {"interface": 3, "type": 3, "struct": 2, "class": 2, "enum": 2}

# Score components and what their evidence is worth.
TIERS = {
    "entry": "structural", "orientation": "structural", "symbols": "structural", "depth": "structural", "imports": "structural", "transitive": "structural", "boundary": "structural",
    "dto": "structural", "test_demote": "structural", "intra_refs": "lexical", "symbol_refs": "lexical", "intent": "contextual", "consumed": "contextual", "callers": "confirmed",
}


def lookup(table: dict, key: Column, default=None) -> Column:
    """A literal map lookup."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key), F.lit(default))


def in_skip_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(dirname(path), "/"), F.array(*[F.lit(d) for d in SKIP_DIRS]))


def is_build_artifact(path: Column) -> Column:
    """Minified, bundled, compiled, generated or content-hashed by its name."""
    return basename(path).rlike(r"\.min\.(js|css)$|\.bundle\.js$|\.chunk\.(js|css)$|_compiled\.js$|\.generated\.|[.\-][0-9a-f]{8,}[.\-]")


def language(path: Column) -> Column:
    return lookup(LANGUAGES, extension(path), "")


def capability(lang: Column) -> Column:
    return F.when(lang.isin(*EXTENSION_ONLY), "extension-only").when(lang.isin(*LANGUAGES.values()), "full").otherwise("unknown")


def is_source(path: Column) -> Column:
    return (language(path) != "") & ~is_build_artifact(path)


def is_test_file(path: Column) -> Column:
    """By the naming rules of each language."""
    base, ext = basename(path), extension(path)
    return (
        F.when(ext == ".go", F.endswith(path, F.lit("_test.go")))
        .when(ext == ".py", base.rlike(r"^test_|_test\.py$"))
        .when(ext == ".rs", F.contains(path, F.lit("/tests/")) | F.endswith(base, F.lit("_test.rs")))
        .when(ext == ".java", base.rlike(r"Tests?\.java$"))
        .when(ext.isin(".ts", ".tsx", ".js", ".jsx"), base.rlike(r"\.(test|spec)\.(tsx?|jsx?)$"))
        .when(ext == ".rb", base.rlike(r"_(test|spec)\.rb$"))
        .when(ext == ".php", F.endswith(base, F.lit("Test.php")))
        .otherwise(F.lit(False))
    )


def is_test_symbol(path: Column, name: Column) -> Column:
    return F.endswith(path, F.lit("_test.go")) & name.rlike("^(Test|Benchmark|Fuzz)")


def display_weight(kind: Column, exported: Column) -> Column:
    return F.when(~exported, 1).otherwise(lookup(DISPLAY_WEIGHT, kind, 2))


def score_weight(kind: Column) -> Column:
    return lookup(SCORE_WEIGHT, kind, 1)


def change_type(path: Column) -> Column:
    """A changed file's type: artifact, deps, test, docs, chore or feat, the first that fits."""
    base = basename(path)
    artifact = base.rlike(r"(?i)^(audit|review|plan|notes|scratch)\.md$|(?i)-output\.md$") | path.rlike(r"\.(log|tmp|bak|swp)$|^(dist|build|coverage|node_modules)/")
    config = F.startswith(base, F.lit(".env")) | extension(path).isin(".md", ".yaml", ".yml", ".json", ".toml", ".cfg", ".ini", ".conf")
    deps = base.isin("go.mod", "go.sum", "package.json", "package-lock.json", "Cargo.toml", "Cargo.lock")
    chore = base.isin("Makefile", "Dockerfile") | path.rlike(r"^(\.github|ci)/") | config
    return F.when(artifact, "artifact").when(deps, "deps").when(is_test_file(path), "test").when(F.endswith(path, F.lit(".md")), "docs").when(chore, "chore").otherwise("feat")


def import_score(n: Column) -> Column:
    """Ten for each importing file up to eight, one for each further."""
    return F.when(n <= 8, n * 10).otherwise(n + 72)


def dto_penalty(exported: Column, data: Column, code: Column) -> Column:
    """Less for a file that exports data types and next to nothing else: all, or four and four fifths, and no code."""
    mostly = (data == exported) | ((data >= 4) & (5 * data >= 4 * exported))
    return F.when((exported >= 1) & (code == 0) & mostly, -12).otherwise(0)


def impact_risk(importers: Column, boundaries: Column, untested_exports: Column) -> Column:
    high = (importers > 10) | ((boundaries > 0) & (importers > 3))
    return F.when(high, "high").when((importers > 3) | (boundaries > 0) | untested_exports, "medium").otherwise("low")


def relevance_tier(score: Column) -> Column:
    return F.when(score >= 16, "high").when(score >= 8, "medium").otherwise("low")


def entry_boost(path: Column) -> Column:
    base = basename(path)
    return F.when(base == "main.go", 50).when(base.isin("main.ts", "index.ts", "index.js", "app.py", "main.py", "main.rs"), 30).otherwise(0)


def depth_penalty(depth: Column) -> Column:
    return F.least(F.lit(0), 2 - depth)


def commit_confidence(types: Column, files: Column, strong: Column) -> Column:
    """A change group's confidence: less for mixed types, many files and weak links, at least 0.3."""
    many = F.when(files > 3, 0.1 * (F.floor((files - 3) / 5) + 1)).otherwise(0.0)
    weak = F.when((files > 1) & ~strong, 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.3), 1.0 - F.when(types > 1, 0.2).otherwise(0.0) - many - weak)


def history_style(share: Column) -> Column:
    return F.when(share >= 0.8, "conventional").when(share >= 0.2, "mixed").otherwise("freeform")


def bump_level(kind: Column, breaking: Column) -> Column:
    return F.when(F.max(breaking.cast("int")) == 1, "major").when(F.max((kind == "feat").cast("int")) == 1, "minor").otherwise("patch")
