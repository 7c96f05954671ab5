"""Line-level pattern scans (surface, effects, routes) and the risk score built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quarrydeck.functions.classify import is_test_file
from quarrydeck.functions.text import basename


@dataclass(frozen=True)
class Pattern:
    """kind, lane and weight of what a regular expression finds; group 0 or 1 is its name, or a fixed name."""

    kind: str
    lane: str
    weight: int
    regex: str
    group: int = 1
    name: str = ""


# What a program shows and takes, and what it does, by line patterns.
SURFACE = (
    Pattern("command", "cli-ux", 8, r'\bUse:\s*"([^"]+)"'),
    Pattern("flag", "cli-ux", 7, r'\.(?:String|StringP|StringVar|StringVarP|Bool|BoolP|BoolVar|BoolVarP|Int|IntP|IntVar|IntVarP|StringSlice|StringSliceVar)\(\s*"([^"]+)"'),
    Pattern("flag", "cli-ux", 7, r'\bflag\.(?:String|Bool|Int|Duration|Float64)\(\s*"([^"]+)"'),
    Pattern("env-var", "config", 7, r'\b(?:os\.)?(?:Getenv|LookupEnv)\(\s*"([^"]+)"'),
    Pattern("config-key", "config", 5, '`[^`]*(?:yaml|toml):"([^" ,]+)[^"`]*"[^`]*`'),
    Pattern("schema-field", "api-contracts", 3, '`[^`]*json:"([^" ,]+)[^"`]*"[^`]*`'),
    Pattern("route", "api-contracts", 8, r'\b(?:http\.)?(?:Handle|HandleFunc)\(\s*"([^"]+)"'),
    Pattern("job", "lifecycle-concurrency", 7, r'\b(?:RegisterHandler|RegisterTask|HandleTask|NewTask|NewPeriodicTask|RegisterJob|AddJob)\(\s*"([^"]+)"'),
    Pattern("model-field", "data-integrity", 4, '`[^`]*(?:gorm|db|bun):"([^" ,]+)[^"`]*"[^`]*`'),
    Pattern("policy", "security", 7, r'\b(?:RegisterPolicy|RegisterMiddleware|AddPolicy|RequirePermission|RequireRole)\(\s*"([^"]+)"'),
    Pattern("output", "cli-ux", 5, r"\b(?:OutOrStdout|OutOrStderr|os\.Stdout|os\.Stderr|fmt\.Fprint|fmt\.Fprintf|json\.NewEncoder|Encoder\()", 0),
)
EFFECTS = (
    Pattern("filesystem-write", "data-integrity", 10, r"\b(?:os\.)?(?:WriteFile|OpenFile|Create|MkdirAll|Rename|Remove|RemoveAll)\(", 0),
    Pattern("filesystem-read", "data-integrity", 4, r"\bos\.(?:ReadFile|Open)\(", 0),
    Pattern("subprocess", "error-handling", 10, r"\bexec\.Command(?:Context)?\(", 0, "exec.Command"),
    Pattern("process-exit", "error-handling", 8, r"\b(?:os\.Exit|log\.Fatal|panic)\(", 0),
    Pattern("http", "api-contracts", 8, r"\b(?:http\.Client|http\.NewRequest|http\.Get|http\.Post|http\.Handle|http\.HandleFunc|ListenAndServe)\b", 0),
    Pattern("database", "data-integrity", 10, r"\b(?:sql\.Open|QueryContext|ExecContext|BeginTx|Commit|Rollback|sqlite|pgx|database/sql)\b", 0),
    Pattern("serialization", "api-contracts", 5, r"\b(?:json|yaml|toml|xml)\.(?:Marshal|Unmarshal|NewEncoder|NewDecoder)\b", 0),
    Pattern("secret", "security", 9, r"(?i)(?:api[_-]?key|apikey|token|secret|password|passwd|credentials?)\s*[:=]\s*[\"']?[A-Za-z0-9_/+.-]{8,}", 0, "secret-like assignment"),
    Pattern("crypto", "security", 8, r"\b(?:crypto/|x/crypto|bcrypt|sha256|sha512|hmac|cipher)\b", 0),
    Pattern("time", "data-integrity", 3, r"\btime\.(?:Now|Since|After|NewTicker|NewTimer)\(", 0),
    Pattern("randomness", "security", 5, r"\b(?:rand\.|crypto/rand)\b", 0),
    Pattern("context-background", "lifecycle-concurrency", 7, r"\bcontext\.Background\(\)", 0, "context.Background"),
    Pattern("goroutine", "lifecycle-concurrency", 8, r"\bgo\s+func\s*\(", 0, "go func"),
    Pattern("unbounded-read", "performance", 9, r"\bio\.ReadAll\s*\(", 0, "io.ReadAll"),
)
# Route registrations; the groups are method (or none), path and handler.
ROUTES = {
    "net/http": r'\b(?:\w+\.)?(?:HandleFunc|Handle)\(\s*"([^"]+)"\s*,\s*([A-Za-z_][\w.]*|\bfunc\b)',
    "chi": r'\b\w+\.(Get|Post|Put|Delete|Patch|Head|Options|Connect|Trace)\(\s*"(/[^"]*)"\s*,\s*([A-Za-z_][\w.]*|\bfunc\b)',
}

# Boundary labels and what each adds to a file's risk.
RISK_BY_BOUNDARY = {"HTTP": (14, "api-contracts"), "gRPC": (14, "api-contracts"), "Postgres": (14, "data-integrity"), "Redis": (14, "data-integrity"), "Kafka": (14, "data-integrity"), "DB": (14, "data-integrity"), "Shell": (12, "error-handling"), "Crypto": (12, "security")}


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """path, line (from 1), text of every line, with ASCII white space trimmed."""
    rows = files.select("path", F.posexplode(F.split(F.col(content), "\n")).alias("i", "raw"))
    return rows.select("path", (F.col("i") + 1).alias("line"), F.regexp_replace("raw", r"^[ \t\r\f]+|[ \t\r\f]+$", "").alias("text"))


def scan(rows: DataFrame, patterns: tuple[Pattern, ...], keep: list[str] | None = None) -> DataFrame:
    """The first match of every pattern in each line: path, line, kind, lane, weight, name.

    All patterns run in one pass over the lines; lines without a match make no rows.
    """

    def hit(i: int, p: Pattern) -> Column:
        name = F.lit(p.name) if p.name else F.regexp_replace(F.regexp_extract("text", p.regex, p.group), r"\($", "")
        found = F.col("text").rlike(p.regex)
        if p.kind == "unbounded-read":
            found = found & ~F.contains(F.col("text"), F.lit("LimitReader"))
        return F.when(found, F.struct(F.lit(i).alias("pattern"), F.lit(p.kind).alias("kind"), F.lit(p.lane).alias("lane"), F.lit(p.weight).alias("weight"), name.alias("name")))

    found = F.array_compact(F.array(*[hit(i, p) for i, p in enumerate(patterns)]))
    keys = keep or ["path", "line"]
    return rows.select(*keys, F.explode(found).alias("h")).select(*keys, "h.pattern", "h.kind", "h.lane", "h.weight", "h.name").where("name <> '-'")


def file_scores(hits: DataFrame, files: DataFrame) -> DataFrame:
    """path, hits, score: the weights of a file's hits and a twentieth of its rank score, at most 10."""
    s = hits.groupBy("path").agg(F.count(F.lit(1)).alias("hits"), F.sum("weight").alias("w"))
    return s.join(files.select("path", "score"), "path", "left").select("path", "hits", (F.col("w") + F.least(F.expr("coalesce(score, 0) div 20"), F.lit(10))).cast("long").alias("score"))


def routes(rows: DataFrame) -> DataFrame:
    """path, line, framework, method (ANY if none), pattern, handler (<inline> for a closure)."""
    net, chi = ROUTES["net/http"], ROUTES["chi"]
    get = lambda rx, k: F.regexp_extract("text", rx, k)
    handler = lambda c: F.when(c == "func", "<inline>").otherwise(c)
    whole = get(net, 1)
    spaced = F.instr(whole, " ") > 0
    a = rows.where(F.col("text").rlike(net)).select("path", "line", F.lit("net/http").alias("framework"), F.when(spaced, F.substring_index(whole, " ", 1)).otherwise("ANY").alias("method"), F.when(spaced, F.trim(F.regexp_replace(whole, "^[^ ]* ", ""))).otherwise(whole).alias("pattern"), handler(get(net, 2)).alias("handler"))
    b = rows.where(F.col("text").rlike(chi)).select("path", "line", F.lit("chi").alias("framework"), F.upper(get(chi, 1)).alias("method"), get(chi, 2).alias("pattern"), handler(get(chi, 3)).alias("handler"))
    return a.unionByName(b)


def risks(ranked: DataFrame) -> DataFrame:
    """path, rule, lane, points of every rule that a file meets.

    ranked: path, imported_by, depends_on, untested, boundaries (array), longest (lines of its
    longest symbol), all_dead, parse_method. Test files meet none.
    """
    rule = lambda name, cond, points, lane: F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(lane).alias("lane"), F.lit(points).alias("points")))
    path = F.col("path")
    fixed = F.array(
        rule("entry", F.startswith(path, F.lit("cmd/")) | (basename(path) == "main.go"), 20, "cli-ux"),
        rule("imported", F.col("imported_by") >= 5, 15, "architecture"),
        rule("depends", F.col("depends_on") >= 4, 10, "coupling"),
        rule("untested", F.col("untested"), 10, "test-risk"),
        rule("large", F.col("longest") >= 80, 8, "large-functions"),
        rule("dead", F.col("all_dead"), 8, "dead-code"),
        rule("parse", ~F.col("parse_method").isin("go_ast", "tree_sitter"), 6, "parse-fidelity"),
    )

    def by_label(label: Column) -> Column:
        points, lane = F.lit(8), F.lit("best-practices")
        for name, (p, ln) in RISK_BY_BOUNDARY.items():
            points, lane = F.when(label == name, p).otherwise(points), F.when(label == name, ln).otherwise(lane)
        return F.struct(F.concat(F.lit("boundary:"), label).alias("rule"), lane.alias("lane"), points.alias("points"))

    every = F.concat(F.array_compact(fixed), F.transform(F.array_distinct("boundaries"), by_label))
    return ranked.where(~is_test_file(path)).select("path", F.explode(every).alias("r")).select("path", "r.rule", "r.lane", "r.points")


def lanes(df: DataFrame, lane: str = "lane", path: str = "path") -> DataFrame:
    """lane, n_files, files: the sorted distinct paths of each lane, joined by commas."""
    own = df.select(lane, path).distinct()
    return own.groupBy(lane).agg(F.count(F.lit(1)).alias("n_files"), F.array_join(F.array_sort(F.collect_list(path)), ",").alias("files"))
