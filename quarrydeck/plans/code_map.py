"""A ranked map of a source-code corpus: features, scores and the edges between files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrydeck.functions import classify, parsing, text as T
from quarrydeck.operators import budget, graph, joins, packets, ranking
from quarrydeck.session import shuffled

# Import prefixes of each language, the boundary they mean and what it adds.
BOUNDARIES = {
    "go": [("HTTP", ["net/http", "github.com/go-chi/chi", "github.com/gin-gonic/gin", "github.com/gorilla/mux"], 5), ("Postgres", ["github.com/jackc/pgx", "database/sql", "github.com/lib/pq"], 5), ("Redis", ["github.com/redis/", "github.com/go-redis/"], 5), ("Kafka", ["github.com/segmentio/kafka-go", "github.com/IBM/sarama", "github.com/Shopify/sarama"], 5), ("gRPC", ["google.golang.org/grpc"], 5), ("Shell", ["os/exec"], 3), ("Crypto", ["crypto/", "golang.org/x/crypto"], 3)],
    "typescript tsx javascript jsx": [("HTTP", ["express", "hono", "fastify", "koa", "next"], 5), ("DB", ["prisma", "knex", "pg", "mongoose", "typeorm"], 5)],
    "python": [("HTTP", ["fastapi", "flask", "django", "starlette"], 5), ("DB", ["sqlalchemy", "psycopg", "tortoise", "peewee"], 5)],
    "rust": [("HTTP", ["actix", "axum", "warp", "rocket"], 5), ("DB", ["sqlx", "diesel", "sea-orm"], 5)],
    "java": [("HTTP", ["spring", "javax.servlet", "jakarta.servlet"], 5), ("DB", ["jdbc", "hibernate", "mybatis"], 5)],
}


#: Bytes of source that a target of a packet shows at most, and those of its start.
SOURCE_BYTES, START_BYTES = 4800, 1600


def boundary_rules(spark: SparkSession) -> DataFrame:
    rows = [(lang, label, p, bump) for langs, rules in BOUNDARIES.items() for lang in langs.split() for label, prefixes, bump in rules for p in prefixes]
    return spark.createDataFrame(rows, "language string, label string, prefix string, bump int")


def normal_path(path: Column) -> Column:
    """A path without . and .. parts."""
    start = F.array().cast("array<string>")
    parts = F.aggregate(F.split(path, "/"), start, lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(parts, "/")


def file_keys(files: DataFrame) -> DataFrame:
    """path, key: what an import of the file may be called."""
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    folder = T.dirname(F.col("path"))
    own = F.when(F.col("import_path") != "", F.array("import_path")).otherwise(F.array().cast("array<string>"))
    index = F.when(T.stem(F.col("path")).isin("index", "__init__", "mod"), F.array(folder)).otherwise(F.array().cast("array<string>"))
    return files.select("path", F.explode(F.array_distinct(F.concat(own, F.array(bare), index))).alias("key"))


def import_keys(imports: DataFrame) -> DataFrame:
    """path, key: the names an import may resolve to; relative ones from the importing file's folder, with and without /index."""
    lang = F.col("language")
    relative = F.col("imp").rlike(r"^\.\.?/")
    base = F.when(relative, normal_path(F.concat_ws("/", T.dirname(F.col("path")), "imp")))
    plain = F.regexp_replace(base, r"\.(tsx?|jsx?)$", "")
    dotted = F.when(lang == "python", F.translate(F.regexp_replace("imp", r"^\.+", ""), ".", "/"))
    options = F.when(relative, F.array(plain, F.concat(plain, F.lit("/index")))).when(lang == "python", F.array(dotted, F.concat_ws("/", T.dirname(F.col("path")), dotted))).otherwise(F.array("imp"))
    return imports.select("path", "imp", F.explode(F.array_distinct(options)).alias("key"))


def derive_import_path(module: str) -> Column:
    """Go: module and folder; Java and PHP: package and type; others none."""
    folder = T.dirname(F.col("path"))
    go = F.when(F.lit(module) == "", F.lit("")).when(folder == ".", F.lit(module)).otherwise(F.concat(F.lit(f"{module}/"), folder))
    named = lambda sep: F.when(F.col("package") != "", F.concat("package", F.lit(sep), T.stem(F.col("path")))).otherwise("")
    return F.when(F.col("language") == "go", go).when(F.col("language") == "java", named(".")).when(F.col("language") == "php", named("\\")).otherwise("")


@dataclass
class CodeMap:
    """files: path, language, content, sha256. All members are DataFrames; ``ranked`` is the file table with its score."""

    files: DataFrame
    parsed: DataFrame
    symbols: DataFrame
    imports: DataFrame
    calls: DataFrame
    edges: DataFrame
    components: DataFrame
    ranked: DataFrame

    @classmethod
    def build(cls, files: DataFrame, module: str = "", include_tests: bool = False) -> CodeMap:
        spark = files.sparkSession
        parsed = parsing.parsed_files(files).withColumn("import_path", derive_import_path(module)).persist()
        symbols, imports, calls = parsing.symbols(parsed), parsing.imports(parsed).join(shuffled(parsed.select("path", "language")), "path"), parsing.calls(parsed)
        wanted = import_keys(imports)
        edges = wanted.join(shuffled(file_keys(parsed).withColumnRenamed("path", "target")), "key").where(F.col("path") != F.col("target")).select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct().persist()
        exported = symbols.where("exported").select("path", "name", "kind")
        n_imports = edges.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("imported_by"))
        n_deps = edges.groupBy(F.col("src").alias("path")).agg(F.countDistinct("dst").alias("depends_on"))
        trans = graph.transitive_scores(edges).select(F.col("key").alias("path"), F.col("score").alias("transitive"))
        kinds = joins.symbol_bonus(symbols).withColumnRenamed("bonus", "symbols")
        rules = F.broadcast(boundary_rules(spark))
        hits = imports.join(rules, (imports.language == rules.language) & F.startswith(imports.imp, rules.prefix)).select("path", "label", "bump").distinct()
        bounds = hits.groupBy("path").agg(F.array_sort(F.collect_set("label")).alias("boundaries"), F.least(F.sum("bump"), F.lit(15)).alias("boundary"))
        words = files.select("path", F.explode(T.identifiers(F.col("content"))).alias("word"))
        names = exported.where(F.length("name") >= 4).select("path", "name")
        refs = joins.reference_bonus(joins.references(words, names, 0.4)).withColumnRenamed("bonus", "intra_refs")
        called = joins.call_site_counts(calls, names.join(shuffled(parsed.where("language <> 'go'").select("path")), "path")).select("path", F.least(4 * F.col("callers"), F.lit(32)).alias("call_sites"))
        data = F.col("kind").isin("struct", "class", "interface", "type", "enum", "constant", "const", "variable", "property", "case")
        shape = exported.groupBy("path").agg(F.count(F.lit(1)).alias("n_exported"), F.sum(data.cast("int")).alias("n_data"), F.sum(F.col("kind").isin("function", "fn", "method").cast("int")).alias("n_code"))
        span = symbols.groupBy("path").agg(F.max(F.col("end_line") - F.col("line") + 1).alias("longest"))
        tested = parsed.where(classify.is_test_file(F.col("path"))).select(T.dirname(F.col("path")).alias("folder")).distinct().withColumn("tested", F.lit(True))

        rows = parsed.select("path", "language", "package", "import_path", "parse_method").withColumn("folder", T.dirname(F.col("path")))
        for part in (n_imports, n_deps, trans, kinds, bounds, refs, called, shape, span):
            rows = rows.join(shuffled(part), "path", "left")
        rows = rows.join(shuffled(tested), "folder", "left").fillna(0, ["imported_by", "depends_on", "transitive", "symbols", "boundary", "intra_refs", "call_sites", "n_exported", "n_data", "n_code", "longest"])
        rows = rows.withColumn("boundaries", F.coalesce("boundaries", F.array().cast("array<string>"))).withColumn("untested", (F.col("n_exported") > 0) & F.col("tested").isNull()).withColumn("all_dead", (F.col("n_exported") > 0) & (F.col("imported_by") == 0)).drop("tested")

        base, stem = T.basename(F.col("path")), T.stem(F.col("path"))
        test = classify.is_test_file(F.col("path"))
        orient = F.when(stem == F.col("package"), 25).otherwise(0) + F.when(base == "types.go", 20).otherwise(0) + F.when((F.col("folder") == ".") & (F.col("language") == "go") & ~test, 8).otherwise(0)
        parts = {
            "entry": classify.entry_boost(F.col("path")),
            "orientation": F.when(base == "main.go", 0).otherwise(F.least(orient, F.lit(35))),
            "symbols": F.col("symbols"),
            "depth": classify.depth_penalty(T.depth(F.col("path"))),
            "imports": classify.import_score(F.col("imported_by")),
            "transitive": F.col("transitive"),
            "boundary": F.col("boundary"),
            "dto": classify.dto_penalty(F.col("n_exported"), F.col("n_data"), F.col("n_code")),
            "intra_refs": F.col("intra_refs"),
            "call_sites": F.col("call_sites"),
            "test_demote": F.when(test & ~F.lit(include_tests), -40).otherwise(0),
        }
        scored = rows.withColumn("score", sum((v for v in parts.values()), F.lit(0)).cast("long")).persist()
        return cls(files, parsed, symbols, imports, calls, edges, ranking.component_rows(rows, "path", parts), scored)

    # focused queries

    def top(self, n: int = 20) -> DataFrame:
        return joins.ranked(self.ranked, [F.desc("score"), "path"], limit=n)

    def for_goal(self, goal: str) -> DataFrame:
        """path, score, intent: the ranked files after a goal in plain words."""
        spark = self.files.sparkSession
        signed = spark.createDataFrame([(goal,)], "g string").select(F.explode(T.signed_tokens(F.col("g"))).alias("t")).select("t.*").collect()
        post = self.postings()
        terms = [r["token"] for r in signed if not r["negated"]]
        scores = ranking.bm25(post, terms)
        against = [r["token"] for r in signed if r["negated"]]
        negated = ranking.matching(post, against) if against else None
        return ranking.with_intent(self.ranked.select("path", "score"), scores, negated)

    def postings(self) -> DataFrame:
        """path, term, tf: names, packages and exported symbols weigh most, then docs, imports and signatures."""

        def of(df: DataFrame, tokens: Column, weight: float) -> DataFrame:
            return df.select("path", F.explode(tokens).alias("term"), F.lit(weight).alias("weight"))

        p, s = self.parsed, self.symbols.where("exported")
        rows = of(p, T.camel_tokens(F.lower(T.stem(F.col("path")))), 3.0).union(of(p, T.camel_tokens(F.col("package")), 3.0)).union(of(s, T.camel_tokens(F.col("name")), 2.0))
        rows = rows.union(of(self.imports, T.camel_tokens(F.substring_index("imp", "/", -1)), 1.0)).union(of(s, T.signature_tokens(F.col("signature")), 1.0)).union(of(s, T.goal_tokens(F.col("doc")), 1.5))
        return ranking.postings(rows)

    def find(self, name: str, kind: str | None = None, path: str | None = None, limit: int = 20) -> DataFrame:
        found = joins.find_ladder(self.symbols, name, kind, path).join(shuffled(self.ranked.select("path", F.col("score").alias("file_score"))), "path", "left")
        return joins.ranked(found.select("path", "name", "kind", "line", "end_line", "signature", "receiver", "match", "file_score"), [F.desc("match"), F.desc("file_score"), "path", "line"], limit=limit)

    def context(self, name: str, most: int = 200) -> DataFrame:
        """The best match of a name with its source lines: path, name, line, text."""
        best = self.find(name, limit=1).select("path", "name", F.col("line").alias("first"), F.least("end_line", F.col("line") + most - 1).alias("last"))
        lines = self.files.join(best, "path").select("path", "name", "first", "last", F.posexplode(F.split("content", "\n")).alias("i", "text"))
        return lines.where((F.col("i") + 1 >= F.col("first")) & (F.col("i") + 1 <= F.col("last"))).select("path", "name", (F.col("i") + 1).alias("line"), F.rtrim("text").alias("text"))

    def impact(self, path: str) -> DataFrame:
        """One row: the file's importers, nearby tests, affected packages and risk."""
        target = self.ranked.where(F.col("path") == path)
        importers = self.edges.where(F.col("dst") == path).select(F.col("src").alias("path")).distinct()
        stem, folder, base = path.rsplit(".", 1)[0], path.rpartition("/")[0] or ".", path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        near = F.startswith(F.col("path"), F.lit(stem)) | ((T.dirname(F.col("path")) == folder) & F.contains(T.basename(F.col("path")), F.lit(base)))
        tests = self.ranked.where(classify.is_test_file(F.col("path")) & near).select("path")
        packages = self.ranked.join(shuffled(importers), "path", "left_semi").select("folder").union(target.select("folder")).distinct()
        sorted_list = lambda df, c, out: df.agg(F.array_sort(F.collect_set(c)).alias(out))
        n = F.size("importers")
        joined = target.select("path", "boundaries", "untested").join(sorted_list(importers, "path", "importers")).join(sorted_list(tests, "path", "tests")).join(sorted_list(packages, "folder", "packages"))
        return joined.select("path", "importers", "tests", "packages", classify.impact_risk(n, F.size("boundaries"), F.col("untested")).alias("risk"))

    def explain(self, path: str) -> DataFrame:
        """component, value, tier of a file's score."""
        return self.components.where(F.col("path") == path).withColumn("tier", classify.lookup(classify.TIERS, F.col("component"), "structural"))

    def orphans(self) -> DataFrame:
        """Exported symbols that no other file mentions; entry files and tests left out."""
        skip = (classify.entry_boost(F.col("path")) > 0) | classify.is_test_file(F.col("path"))
        exported = self.symbols.where("exported").where(~skip)
        words = self.files.select("path", F.explode(T.identifiers(F.col("content"), 1)).alias("word"))
        used = joins.references(words, exported.select("path", "name"))
        return exported.join(shuffled(used.select("path", "name")), ["path", "name"], "left_anti").select("path", "name", "kind", "line")

    def ownership(self, goal: str = "", top: int = 5) -> DataFrame:
        """Folders with two or more files by their files' scores."""
        scores = self.for_goal(goal).select("path", "score") if goal else self.ranked.select("path", "score")
        by = joins.ownership(scores.withColumn("folder", T.dirname(F.col("path"))), "folder", "score")
        return joins.ranked(by, [F.desc("score"), "folder"], limit=top)

    def routes(self) -> DataFrame:
        from quarrydeck.operators import audit

        return audit.routes(audit.lines(self.files.where("language = 'go'").where(~classify.is_test_file(F.col("path")))))

    def endpoint(self, pattern: str) -> DataFrame:
        """Routes of exactly this pattern, or else those that contain it, with where their handlers stand."""
        routes = self.routes()
        exact = routes.where(F.col("pattern") == pattern)
        found = routes.where(F.contains(F.col("pattern"), F.lit(pattern))) if exact.isEmpty() else exact
        handler = self.symbols.select(F.col("path").alias("handler_path"), F.col("name").alias("h"), F.col("line").alias("handler_line"))
        return found.join(handler, F.substring_index("handler", ".", -1) == F.col("h"), "left").drop("h")

    def surface(self) -> DataFrame:
        from quarrydeck.operators import audit

        return audit.scan(audit.lines(self._code()), audit.SURFACE)

    def effects(self) -> DataFrame:
        from quarrydeck.operators import audit

        return audit.scan(audit.lines(self._code()), audit.EFFECTS)

    def _code(self) -> DataFrame:
        return self.files.where(~classify.is_test_file(F.col("path")))

    def risks(self, limit: int = 20) -> DataFrame:
        """The riskiest files: path, points, rules."""
        from quarrydeck.operators import audit

        by = audit.risks(self.ranked).groupBy("path").agg(F.sum("points").alias("points"), F.array_sort(F.collect_set("rule")).alias("rules"))
        return joins.ranked(by, [F.desc("points"), "path"], limit=limit)

    def read_queue(self) -> DataFrame:
        """What to read first (see operators.review.read_queue)."""
        from quarrydeck.operators import audit, review

        surface = self.surface().drop("pattern").unionByName(review.manifest_hits(self.files))
        return review.read_queue(audit.risks(self.ranked), surface, self.effects(), self.ranked.select("path", "score"))

    def review_plan(self) -> DataFrame:
        """The lanes of a review: files, reasons, caveats."""
        from quarrydeck.operators import review

        return review.review_lanes(self.read_queue())

    def effect_hints(self) -> DataFrame:
        from quarrydeck.operators import audit, review

        return review.effect_hints(self.calls, audit.lines(self._code()))

    def inventory(self, boundary: str) -> DataFrame:
        """what, path, detail of a boundary: files that import it, constructors in them, their effects, and tests beside them."""
        inside = self.ranked.where(F.array_contains(F.transform("boundaries", lambda b: F.lower(b)), boundary.lower())).select("path", "folder")
        files = inside.select(F.lit("file").alias("what"), "path", F.lit("").alias("detail"))
        made = self.symbols.where("exported").where(F.col("name").rlike("^(New|Open|Create|Connect|Init)|^__init__$")).join(inside.select("path"), "path", "left_semi").select(F.lit("constructor").alias("what"), "path", F.col("name").alias("detail"))
        does = self.effects().join(inside.select("path"), "path", "left_semi").select(F.lit("effect").alias("what"), "path", F.concat_ws(" ", "kind", "name").alias("detail")).distinct()
        tests = self.ranked.where(classify.is_test_file(F.col("path"))).join(inside.select("folder").distinct(), "folder", "left_semi").select(F.lit("test").alias("what"), "path", F.lit("").alias("detail"))
        return files.union(made).union(does).union(tests)

    def brief(self, files: int = 20) -> DataFrame:
        """what, detail of a short digest: the main language, the number of files and symbols, the first files and the largest folders."""
        count = lambda df, what: df.agg(F.count(F.lit(1)).cast("string").alias("detail")).select(F.lit(what).alias("what"), "detail")
        lang = self.ranked.groupBy("language").count().orderBy(F.desc("count"), "language").limit(1).select(F.lit("language").alias("what"), F.col("language").alias("detail"))
        first = self.top(files).select(F.lit("file").alias("what"), F.col("path").alias("detail"))
        owners = self.ownership().select(F.lit("folder").alias("what"), F.concat_ws(" ", "folder", F.col("score").cast("string")).alias("detail"))
        return lang.union(count(self.ranked, "files")).union(count(self.symbols, "symbols")).union(first).union(owners)

    def levels(self, max_tokens: int) -> DataFrame:
        """path, rank, level: how much of each file fits into a token budget."""
        ranked = joins.ranked(self.ranked.select("path", "score"), [F.desc("score"), "path"])
        costs = budget.enriched_cost(self.symbols)
        kinds = self.symbols.where("exported").groupBy("path").agg(F.countDistinct("kind").alias("kinds"))
        rows = ranked.join(costs, "path", "left").join(kinds, "path", "left").fillna(0, ["cost", "kinds"])
        rows = rows.select("path", "rank", (F.octet_length("path") + 30).cast("long").alias("header"), F.least(30 * F.col("kinds"), F.col("cost")).cast("long").alias("summary"), F.col("cost").cast("long").alias("cost"))
        return budget.detail_levels(rows, max_tokens)

    def task(self, goal: str, targets: int = 6) -> DataFrame:
        """The likeliest owners of a goal: path, relevance, tier, evidence tables as arrays (importers, tests, effects)."""
        spark = self.files.sparkSession
        terms = [r["t"] for r in spark.createDataFrame([(goal,)], "g string").select(F.explode(T.goal_tokens(F.col("g"))).alias("t")).collect()]
        s = self.symbols.groupBy("path").agg(F.concat_ws(" ", F.collect_list("name")).alias("names"), F.concat_ws(" ", F.collect_list("signature")).alias("signatures"), F.concat_ws(" ", F.collect_list("doc")).alias("docs"))
        i = self.imports.groupBy("path").agg(F.concat_ws(" ", F.collect_list("imp")).alias("imps"))
        rows = self.ranked.where(~classify.is_test_file(F.col("path"))).select("path", "package", "score").join(s, "path", "left").join(i, "path", "left").withColumn("_path", F.col("path"))
        found = ranking.task_relevance(rows, "path", {"_path": 8, "names": 8, "package": 5, "signatures": 4, "imps": 3, "docs": 3}, terms)
        if found.isEmpty():
            found = rows.select("path", F.lit(0).cast("long").alias("relevance"))
        best = joins.ranked(found.join(self.ranked.select("path", "score"), "path"), [F.desc("relevance"), F.desc("score"), "path"], limit=targets)
        importers = self.edges.groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("importers"))
        effects = self.effects().groupBy("path").agg(F.array_sort(F.collect_set("kind")).alias("effects"))
        out = best.join(importers, "path", "left").join(effects, "path", "left")
        return out.withColumn("tier", classify.relevance_tier(F.col("relevance"))).orderBy("rank")

    def packets(self, goals: DataFrame, max_tokens: int = 4096, targets: int = 6) -> DataFrame:
        """A packet for each of many goals (goal, text) within a token budget: see operators.packets.packets.

        Files are relevant by the tokens of their paths, names, packages, signatures, imports and
        docs. A target in full has its importers, tests, effects and source; then only the start
        of its source; then no relations; then its identity alone.
        """
        s = self.symbols.groupBy("path").agg(F.concat_ws(" ", F.collect_list("name")).alias("names"), F.concat_ws(" ", F.collect_list("signature")).alias("signatures"), F.concat_ws(" ", F.collect_list("doc")).alias("docs"))
        i = self.imports.groupBy("path").agg(F.concat_ws(" ", F.collect_list("imp")).alias("imps"))
        code = self.ranked.where(~classify.is_test_file(F.col("path")))
        plain = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "([a-z0-9])([A-Z])|[/._]", "$1 $2")
        fields = {"where": 8, "names": 8, "package": 5, "signatures": 4, "imps": 3, "docs": 3}
        rows = code.select("path", F.col("path").alias("where"), "package").join(s, "path", "left").join(i, "path", "left")
        found = packets.relevance(rows.select("path", *[plain(c).alias(c) for c in fields]), packets.goal_terms(goals), fields)
        importers = self.edges.groupBy(F.col("dst").alias("path")).agg(F.sum(F.octet_length("src") + 8).alias("in_bytes"))
        effects = self.effects().groupBy("path").agg(F.sum(F.octet_length("name") + 24).alias("effect_bytes"))
        tests = self.ranked.where(classify.is_test_file(F.col("path"))).groupBy("folder").agg(F.sum(F.octet_length("path") + 8).alias("test_bytes"))
        sized = code.select("path", "package", "folder", "score").join(self.files.select("path", F.octet_length("content").alias("source")), "path").join(importers, "path", "left").join(effects, "path", "left").join(tests, "folder", "left").fillna(0, ["in_bytes", "effect_bytes", "test_bytes"])
        tokens = lambda b: F.ceil(b / 4).cast("long")
        own, rest = F.octet_length("path") + F.octet_length("package") + 160, F.col("in_bytes") + F.col("effect_bytes") + F.col("test_bytes")
        source, start = F.least(F.col("source"), F.lit(SOURCE_BYTES)), F.least(F.col("source"), F.lit(START_BYTES))
        costs = F.array(tokens(own + rest + source), F.when(F.col("source") > START_BYTES, tokens(own + rest + start)), tokens(own + start), F.when(F.col("source") > 0, tokens(own)))
        return packets.packets(found.join(sized.select("path", "score", costs.alias("costs")), "path"), max_tokens, targets=targets)

    def close(self) -> None:
        """Give back what the map holds in memory; its tables are worked out anew if they are asked again."""
        for held in (self.parsed, self.edges, self.ranked):
            held.unpersist()
