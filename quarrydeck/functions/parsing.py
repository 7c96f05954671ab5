"""Line-level parsers of source code: declarations, imports and calls per language.

Each language is a table of line patterns, and each parser walks a file's lines once, keeping
what a line-by-line pattern can't know: open block comments, docstrings, and the class around.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrydeck.session import ship_code

SYMBOL = "struct<name:string,kind:string,signature:string,receiver:string,exported:boolean,line:int,end_line:int,doc:string>"
PARSED = f"path string, language string, package string, parse_method string, symbols array<{SYMBOL}>, imports array<string>, call_sites array<struct<name:string,line:int>>"


@dataclass
class Parsed:
    package: str = ""
    symbols: list[dict] = field(default_factory=list)
    #: Ordered sets of names that are imported, and of calls with their lines.
    needed: dict[str, None] = field(default_factory=dict)
    called: dict[tuple[str, int], None] = field(default_factory=dict)

    @property
    def imports(self) -> list[str]:
        return list(self.needed)

    @property
    def calls(self) -> list[tuple[str, int]]:
        return list(self.called)

    def add(self, name: str, kind: str, line: int, signature: str = "", receiver: str = "", exported: bool = True, doc: str = "") -> None:
        self.symbols.append({"name": name, "kind": kind, "signature": signature, "receiver": receiver, "exported": exported, "line": line, "end_line": line, "doc": doc})

    def need(self, name: str) -> None:
        if name:
            self.needed.setdefault(name)


@dataclass(frozen=True)
class Language:
    """Patterns of declarations (kind, pattern with a group ``name``), imports, blocks and comments."""

    declares: tuple[tuple[str, str], ...]
    imports: tuple[str, ...] = ()
    package: str = ""
    line_comment: str = "//"
    block_comment: tuple[str, str] | None = ("/*", "*/")
    #: Kinds that are around what is declared inside them.
    holders: tuple[str, ...] = ("class", "interface", "trait", "struct", "enum", "impl")
    hidden: str = r"^\s*(?:private|protected)\b"


_ID = r"[A-Za-z_$][A-Za-z0-9_$]*"
_JS = Language(
    declares=(
        ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{_ID})"),
        ("interface", rf"^\s*(?:export\s+)?(?:default\s+)?interface\s+(?P<name>{_ID})"),
        ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<name>{_ID})"),
        ("type", rf"^\s*(?:export\s+)?type\s+(?P<name>{_ID})\s*[=<]"),
        ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_ID})\s*(?P<sig>\([^)]*\))?"),
        ("const", rf"^(?:export\s+)(?:const|let|var)\s+(?P<name>{_ID})"),
        ("method", rf"^\s+(?:public\s+|static\s+|async\s+|get\s+|set\s+)*(?P<name>{_ID})\s*(?P<sig>\([^)]*\))\s*(?::\s*[^{{]+)?{{\s*$"),
    ),
    imports=(r"""^\s*import\s+(?:[^'"]*\s+from\s+)?['"]([^'"]+)['"]""", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""", r"""^\s*export\s+[^'"]*\s+from\s+['"]([^'"]+)['"]"""),
)
_C = Language(
    declares=(
        ("struct", rf"^\s*(?:typedef\s+)?struct\s+(?P<name>{_ID})\s*{{?"),
        ("class", rf"^\s*class\s+(?P<name>{_ID})"),
        ("enum", rf"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<name>{_ID})"),
        ("macro", rf"^\s*#\s*define\s+(?P<name>{_ID})"),
        ("function", rf"^(?!\s*(?:return|if|else|while|for|switch)\b)[A-Za-z_][\w\s*&:<>,]*?[\s*&](?P<name>~?{_ID})\s*(?P<sig>\([^;]*\))\s*(?:const\s*)?{{"),
    ),
    imports=(r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]""",),
)
LANGUAGES: dict[str, Language] = {
    "typescript": _JS, "tsx": _JS, "javascript": _JS, "jsx": _JS, "c": _C, "cpp": _C,
    "go": Language(
        declares=(
            ("method", rf"^func\s+\((?:\w+\s+)?\*?(?P<recv>{_ID})(?:\[[^\]]*\])?\)\s*(?P<name>{_ID})(?P<sig>\(.*?\)\s*[^{{]*)"),
            ("function", rf"^func\s+(?P<name>{_ID})(?:\[[^\]]*\])?(?P<sig>\(.*?\)\s*[^{{]*)"),
            ("struct", rf"^type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+struct\b"),
            ("interface", rf"^type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+interface\b"),
            ("type", rf"^type\s+(?P<name>{_ID})"),
            ("constant", rf"^const\s+(?P<name>{_ID})"),
            ("variable", rf"^var\s+(?P<name>{_ID})"),
        ),
        imports=(r"""^import\s+(?:[\w.]+\s+)?"([^"]+)\"""",),
        package=r"^package\s+(\w+)",
    ),
    "python": Language(
        declares=(
            ("class", rf"^(?P<indent>\s*)class\s+(?P<name>{_ID})"),
            ("function", rf"^(?P<indent>\s*)(?:async\s+)?def\s+(?P<name>{_ID})\s*(?P<sig>\([^)]*\)?)"),
            ("constant", r"^(?P<name>[A-Z][A-Z0-9_]+)\s*(?::[^=]+)?="),
        ),
        imports=(r"^\s*from\s+([\w.]+)\s+import\b", r"^\s*import\s+([\w.]+)"),
        line_comment="#", block_comment=None,
    ),
    "rust": Language(
        declares=(
            ("struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>{_ID})"),
            ("enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>{_ID})"),
            ("trait", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>{_ID})"),
            ("impl", rf"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>{_ID})"),
            ("fn", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(?P<name>{_ID})(?:<[^>]*>)?\s*(?P<sig>\([^{{]*)"),
            ("const", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?const\s+(?P<name>{_ID})"),
        ),
        imports=(r"^\s*(?:pub\s+)?use\s+([\w:]+)",),
    ),
    "java": Language(
        declares=(
            ("class", rf"^\s*(?:public|protected|private|abstract|final|static|\s)*class\s+(?P<name>{_ID})"),
            ("interface", rf"^\s*(?:public|protected|private|\s)*interface\s+(?P<name>{_ID})"),
            ("enum", rf"^\s*(?:public|protected|private|\s)*enum\s+(?P<name>{_ID})"),
            ("method", rf"^(?!\s*(?:return|throw|new|else|case)\b)\s+(?:public|protected|private|static|final|abstract|synchronized|\s)*[\w<>\[\],.?\s]+\s+(?P<name>{_ID})\s*(?P<sig>\([^)]*\))\s*(?:throws\s+[\w,.\s]+)?[{{;]"),
        ),
        imports=(r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;",),
        package=r"^\s*package\s+([\w.]+)\s*;",
    ),
    "ruby": Language(
        declares=(("class", rf"^\s*class\s+(?P<name>{_ID})"), ("module", rf"^\s*module\s+(?P<name>{_ID})"), ("method", r"^\s*def\s+(?:self\.)?(?P<name>[a-z_]\w*[?!=]?)(?P<sig>\([^)]*\))?")),
        imports=(r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""",),
        line_comment="#", block_comment=("=begin", "=end"), holders=("class", "module"),
    ),
    "php": Language(
        declares=(
            ("class", rf"^\s*(?:abstract\s+|final\s+|readonly\s+)*class\s+(?P<name>{_ID})"),
            ("interface", rf"^\s*interface\s+(?P<name>{_ID})"),
            ("trait", rf"^\s*trait\s+(?P<name>{_ID})"),
            ("enum", rf"^\s*enum\s+(?P<name>{_ID})"),
            ("method", rf"^\s+(?:public\s+|protected\s+|private\s+|static\s+|final\s+|abstract\s+)*function\s+&?(?P<name>{_ID})\s*(?P<sig>\([^)]*\))"),
            ("function", rf"^function\s+&?(?P<name>{_ID})\s*(?P<sig>\([^)]*\))"),
            ("const", rf"^\s*(?:public\s+)?const\s+(?:\w+\s+)?(?P<name>{_ID})\s*="),
            ("property", r"^\s+(?:public|var)\s+(?:static\s+|readonly\s+)*(?:[?\w|\\]+\s+)?\$(?P<name>\w+)"),
            ("case", rf"^\s*case\s+(?P<name>{_ID})\s*(?:=[^;:]*)?;"),
        ),
        imports=(r"^use\s+(?:function\s+|const\s+)?([\w\\]+)",),
        package=r"^namespace\s+([\w\\]+)",
    ),
}

_CALL = re.compile(rf"(?<![\w$.])((?:{_ID}\.)*{_ID})\s*\(")
# Words before a parenthesis that call nothing.
_NO_CALL = frozenset("if for while switch catch return function func fn def class elif match new await typeof sizeof and or not in with super".split())


def _compiled(lang: Language):
    return [(k, re.compile(p)) for k, p in lang.declares], [re.compile(p) for p in lang.imports], re.compile(lang.package) if lang.package else None, re.compile(lang.hidden)


_READY = {name: _compiled(lang) for name, lang in LANGUAGES.items()}


def _exported(language: str, name: str, line: str, hidden: re.Pattern) -> bool:
    if language == "go":
        return name[:1].isupper()
    if language in ("python", "ruby"):
        return not name.startswith("_")
    if language == "rust":
        return bool(re.match(r"\s*pub\b", line))
    return not hidden.search(line)


_OPENS = re.compile(r"^\s*(?:[a-z]+\s+)*(?:func|function|def|fn)\b")
_GROUP = re.compile(r"^(const|var|type)\s*\($")
_GROUPS = {"const": "constant", "var": "variable", "type": "type"}
_PROMOTED = re.compile(r"\b(public|protected|private)\s+(?:readonly\s+)?(?:[?\w|\\]+\s+)?\$(\w+)")


_QUOTES = r"""|"(?:\\.|[^"\\\n])*+"?|'(?:\\.|[^'\\\n])*+'?"""
_SLASHES = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)"
_TICKS = r"|`(?:\\.|[^`\\])*+(?:`|\Z)"
#: Comments and strings by language; those of _JS and Java are what other languages have as well.
_HIDES = {
    "go": _SLASHES + r"|`[^`]*(?:`|\Z)" + _QUOTES,
    "rust": _SLASHES + r"""|"(?:\\.|[^"\\])*+"?|'(?:\\.|[^'\\\n])'""",
    "python": r"""#[^\n]*|\"{3}(?s:.*?)(?:\"{3}|\Z)|'{3}(?s:.*?)(?:'{3}|\Z)""" + _QUOTES,
    "ruby": "#[^\n]*" + _QUOTES,
    "php": r"\#(?!\[)[^\n]*|" + _SLASHES + _QUOTES,
    "java": _SLASHES + _QUOTES,
    "": _SLASHES + _TICKS + _QUOTES,
}
_HIDES = {k: re.compile(p) for k, p in _HIDES.items()}
_INNER = re.compile(r"[^\n]")


def code_lines(content: str, language: str, strings: bool = False) -> list[str]:
    """The lines of a file with spaces in place of comments and, unless ``strings`` stay, of what is between quotes; every character keeps its place."""

    def hide(m: re.Match) -> str:
        s = m[0]
        if s[0] not in "\"'`":
            return _INNER.sub(" ", s)
        if strings:
            return s
        return s[0] + _INNER.sub(" ", s[1:-1]) + s[-1] if len(s) > 1 and s[-1] == s[0] else s[0] + _INNER.sub(" ", s[1:])

    return _HIDES.get(language, _HIDES[""]).sub(hide, content).split("\n")


#: A run of empty lines that is told as one, and what every line of Go that is looked at for a declaration begins with.
_EMPTY = re.compile(r"\n{9,}")
_GO_HEADS = frozenset("ftcvip")


def _runs(content: str) -> dict[int, int]:
    """The index of the second line of each long run of empty lines, with that of the line after the run."""
    out, at, before = {}, 0, 0
    for m in _EMPTY.finditer(content):
        before, at = before + content.count("\n", at, m.start()), m.start()
        out[before + 1] = before + m.end() - m.start()
    return out


def _logical(content: str, ls: list[str], codes: list[str], language: str, runs: dict[int, int]) -> Iterator[tuple[int, str, str]]:
    """number, line, code; the parameters of a function of Go or PHP over several lines count as its first line, and a run of empty lines as its first two."""
    number, held, bare, depth, i, opens = 0, [], [], 0, 0, language in ("go", "php")
    plain: list[str] = []
    joined = lambda xs: re.sub(r",\s+\)", ")", re.sub(r"\(\s+", "(", " ".join(xs)))
    while i < len(ls):
        line, code = ls[i], codes[i]
        i += 1
        if not held:
            if not (opens and "f" in code and code.count("(") > code.count(")") and _OPENS.match(code)):
                yield i, line, code
                i = runs.get(i - 1, i)
                continue
            number, plain = i, plain or code_lines(content, language, strings=True)
        told = plain[i - 1]
        held.append(told.strip() if held else told)
        bare.append(code.strip() if bare else code)
        depth += code.count("(") - code.count(")")
        if depth <= 0:
            yield number, joined(held), joined(bare)
            held, bare, depth = [], [], 0
    if held:
        yield number, " ".join(held), " ".join(bare)


def _grouped(out: Parsed, kind: str, bare: str, number: int, doc: str) -> None:
    """The names of one line of a group of declarations in Go."""
    if not (m := re.match(rf"({_ID}(?:\s*,\s*{_ID})*)(.*)", bare)):
        return
    if kind == "type":
        shape = re.match(r"(?:\[[^\]]*\])?\s+(struct|interface)\b", m[2])
        kind = shape[1] if shape else kind
    for name in re.split(r"\s*,\s*", m[1]):
        if name != "_":
            out.add(name, kind, number, "", "", name[:1].isupper(), doc)


def parse(language: str, content: str) -> Parsed | None:
    """The declarations, imports and calls of a file; None for a language without a parser."""
    if language not in LANGUAGES:
        return None
    lang, (declares, imports, package, hidden) = LANGUAGES[language], _READY[language]
    out, doc = Parsed(), []
    inside = quote = ""
    in_imports, depth = False, 0
    holder: list[tuple[str, int]] = []
    group, open_in_group = "", 0
    codes, ls, go = code_lines(content, language), content.split("\n"), language == "go"
    # within a comment each empty line counts
    runs = {} if lang.block_comment and lang.block_comment[0] in content else _runs(content)
    for number, line, code in _logical(content, ls, codes, language, runs):
        bare = line.strip()
        if inside:
            if inside in bare:
                bare, inside = bare.split(inside, 1)[1], ""
            else:
                doc.append(bare.lstrip("* "))
                continue
        if quote:
            quote = "" if quote in bare else quote
            continue
        if language == "python" and (m := re.match(r"""[rRuU]?("{3}|'{3})""", bare)):
            quote = "" if m[1] in bare[m.end() :] else m[1]
            continue
        if lang.block_comment and bare.startswith(lang.block_comment[0]):
            rest = bare[len(lang.block_comment[0]) :]
            if lang.block_comment[1] not in rest:
                inside, doc = lang.block_comment[1], [rest.lstrip("* ")] if rest.strip("* ") else []
                continue
            if not code.strip():
                continue
            line = bare = code.strip()  # what follows the comment
        if bare.startswith(lang.line_comment):
            doc.append(bare[len(lang.line_comment) :].strip())
            continue
        if not bare or (not in_imports and not code.strip(" \t\r'\"`")):
            doc = []
            continue
        if go and bare.startswith("import") and re.match(r"import\s*\(", bare):
            in_imports = True
            continue
        if in_imports:
            if bare.startswith(")"):
                in_imports = False
            elif m := re.search(r'"([^"]+)"', bare):
                out.need(m[1])
            continue
        if go and not group and (m := _GROUP.match(code.rstrip())):
            group, open_in_group, doc = _GROUPS[m[1]], 0, []
            continue
        if group:
            if not open_in_group and bare.startswith(")"):
                group = ""
            elif not open_in_group:
                _grouped(out, group, bare, number, " ".join(doc).strip())
            open_in_group += sum(code.count(c) for c in "({[") - sum(code.count(c) for c in ")}]") if group else 0
            doc = []
            continue
        if go and line[0] not in _GO_HEADS:
            while holder and depth <= holder[-1][1]:
                holder.pop()
            depth += code.count("{") - code.count("}")
            doc = []
            continue
        if package and not out.package and (m := package.search(line)):
            out.package = m[1]
            continue
        found = [m[1] for rx in imports if (m := rx.search(line))]
        for name in found:
            out.need(name)
        indent = len(line) - len(line.lstrip())
        while holder and (indent <= holder[-1][1] if language in ("python", "ruby") else depth <= holder[-1][1]):
            holder.pop()
        for kind, rx in declares:
            m = rx.search(line)
            if not m:
                continue
            groups = m.groupdict()
            name, around = m["name"], groups.get("recv") or (holder[-1][0] if holder else "")
            kind = "method" if kind in ("function", "fn") and around else kind
            if language == "python" and kind == "function" and indent:
                break
            if kind in lang.holders:
                holder.append((name, indent if language in ("python", "ruby") else depth))
            if kind != "impl" and not (kind == "method" and name in _NO_CALL):
                out.add(name, kind, number, (groups.get("sig") or "").strip(), around if kind in ("method", "property", "const", "case") else "", _exported(language, name, line, hidden), " ".join(doc).strip())
                if language == "php" and name == "__construct":
                    for m in _PROMOTED.finditer(line[m.end("name") :]):
                        out.add(m[2], "property", number, "", around, m[1] == "public")
            break
        else:
            if language != "go" and not found:
                for m in _CALL.finditer(code):
                    if m[1] not in _NO_CALL:
                        out.called.setdefault((m[1], number))
        depth += code.count("{") - code.count("}")
        doc = []
    _spans(out, ls, codes, language)
    return out


def _spans(out: Parsed, ls: list[str], codes: list[str], language: str) -> None:
    """The last line of each declaration: where its braces close, or where the indent falls back."""
    for s in out.symbols:
        k = s["line"] - 1
        if language == "python":
            indent = len(ls[k]) - len(ls[k].lstrip())
            end = k
            for j in range(k + 1, len(ls)):
                if ls[j].strip():
                    if len(ls[j]) - len(ls[j].lstrip()) <= indent:
                        break
                    end = j
        else:
            depth, inner, head, end, seen = 0, 0, None, k, False
            for j in range(k, len(ls)):
                if head is None:  # the line on which the parameters end
                    inner += codes[j].count("(") - codes[j].count(")")
                    if inner > 0:
                        continue
                    head = end = j
                depth += codes[j].count("{") - codes[j].count("}")
                seen = seen or "{" in codes[j]
                if seen and depth <= 0:
                    end = j
                    break
                if not seen and j > head:
                    break
        s["end_line"] = end + 1
        if language == "go" and s["kind"] in ("struct", "interface"):
            s["signature"] = _go_shape(ls[k : end + 1], codes[k : end + 1], s["kind"])


def _go_shape(body: list[str], codes: list[str], kind: str) -> str:
    """{Field type, ...} of a struct or {Method, ...} of an interface: the exported names of its outermost level."""
    if len(body) == 1:
        inside = body[0].partition("{")[2].rpartition("}")[0].split(";")
    else:
        inside, depth = [], 1
        for line, code in zip(body[1:-1], codes[1:-1], strict=True):
            if depth == 1 and code.strip():
                inside.append(line)
            depth += code.count("{") - code.count("}")
    out: list[str] = []
    for line in inside:
        bare = re.split(r"`|//", line, maxsplit=1)[0].strip()
        if kind == "interface":
            out += re.findall(r"^([A-Z]\w*)(?=\(|$)", bare)
        elif m := re.match(rf"({_ID}(?:\s*,\s*{_ID})*)\s+(.+)$", bare):
            out += [f"{name} {m[2].rstrip(' {')}" for name in re.split(r"\s*,\s*", m[1]) if name[:1].isupper()]
        else:
            out += re.findall(r"^([A-Z]\w*)$", bare)
    return "{" + ", ".join(out) + "}"


def parsed_files(files: DataFrame) -> DataFrame:
    """One row per file of a language that has a parser: package, symbols, imports and calls. files: path, language, content."""
    ship_code(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, language, content in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                p = parse(language, content or "")
                if p is not None:
                    rows.append({"path": path, "language": language, "package": p.package, "parse_method": "regex", "symbols": p.symbols, "imports": p.imports, "call_sites": [{"name": n, "line": k} for n, k in p.calls]})
            yield pa.RecordBatch.from_pylist(rows, _arrow())

    return files.select("path", "language", "content").mapInArrow(run, PARSED)


def _arrow() -> pa.Schema:
    s, i = pa.string(), pa.int32()
    symbol = pa.struct([("name", s), ("kind", s), ("signature", s), ("receiver", s), ("exported", pa.bool_()), ("line", i), ("end_line", i), ("doc", s)])
    return pa.schema([("path", s), ("language", s), ("package", s), ("parse_method", s), ("symbols", pa.list_(symbol)), ("imports", pa.list_(s)), ("call_sites", pa.list_(pa.struct([("name", s), ("line", i)])))])


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "language", F.explode("symbols").alias("s")).select("path", "language", "s.*")


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("imports").alias("pos", "imp"))


def calls(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("call_sites").alias("c")).select("path", "c.*")


def coverage(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """language, files, parsed, failed."""
    have = parsed.select("path", F.lit(1).alias("ok"))
    return files.join(have, "path", "left").groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("ok"), F.lit(0)).alias("parsed")).withColumn("failed", F.col("files") - F.col("parsed"))
