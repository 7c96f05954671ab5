"""String functions over code and goals, as column expressions."""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, functions as F

# Words that say nothing about a goal.
STOP_WORDS = """func return error string int bool nil var const type struct interface package import if else
for range switch case defer go chan map select break continue fallthrough
the a an is are was were be been being have has had do does did will would could should may might shall can
this that these those it its in on at to of with from by and or but so yet as into about
file files code implement add fix update change make use using get set bug issue handle support
refactor improve cleanup""".split()

# The words that negate the next one.
NEGATIONS = ["not", "without", "except", "no"]


def either(words: list[str]) -> str:
    """A pattern of any of the words (not empty) that goes by their letters, so that few are tried at a place."""
    ends, tails = False, {}
    for w in sorted(set(words)):
        if not w:
            ends = True
        else:
            tails.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + either(rest) for c, rest in tails.items()]
    return "" if not parts else f"(?:{'|'.join(parts)})" + ("?" if ends else "") if len(parts) > 1 or ends else parts[0]


def _token(word: str) -> str:
    """A pattern that takes ``word`` as a whole token: a run of ASCII letters, digits and hyphens, but for hyphens at its ends."""
    return rf"(?<![a-z0-9-])-*+{word}-*+(?![a-z0-9-])"


#: A token that isn't a stop word; group 1 is the token.
TOKEN = rf"(?<![a-z0-9-])-*+(?!{either(STOP_WORDS)}-*+(?![a-z0-9-]))([a-z0-9](?:[a-z0-9-]*[a-z0-9])?)"


def goal_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and inner hyphens, without stop words, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def token_count(text: Column, word: str | None = None) -> Column:
    """How many goal tokens a text has, or how many of them are ``word``; no array of them is made."""
    pattern = TOKEN if word is None else _token(re.escape(word))
    return F.regexp_count(F.lower(text), F.lit(pattern))


def signed_tokens(text: Column) -> Column:
    """The goal tokens as structs (pos, token, negated): a negation word goes, and marks the token after it."""
    tokens = goal_tokens(text)
    marked = F.transform(tokens, lambda t, i: F.struct(i.alias("pos"), t.alias("token"), F.coalesce(F.get(tokens, i - 1).isin(*NEGATIONS), F.lit(False)).alias("negated")))
    return F.filter(marked, lambda s: ~s["token"].isin(*NEGATIONS))


# Characters that upper case makes longer, such as ß, and their one capital: ẞ, the title form, or themselves.
_LONGER = [c for c in map(chr, range(sys.maxunicode + 1)) if len(c.upper()) > 1]
_ALONE = ["ẞ" if c == "ß" else t if len(t := c.title()) == 1 else c for c in _LONGER]


def upper(text: Column) -> Column:
    """Upper case, character by character, so that no text grows longer."""
    kept = "".join(_LONGER)
    parts = F.regexp_extract_all(text, F.lit(f"[{kept}]+|[^{kept}]+"), F.lit(0))
    one = F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^[{kept}]"), F.translate(x, kept, "".join(_ALONE))).otherwise(F.upper(x))), "")
    return F.when(text.rlike(f"[{kept}]"), one).otherwise(F.upper(text))


def lower(text: Column) -> Column:
    """Lower case, character by character: a capital sigma is the same at a word's end, and a dotted capital I is one letter."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def camel_tokens(name: Column) -> Column:
    """An identifier's parts: split at _ and -, between lower and upper case, and before the last capital of an acronym."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.filter(F.split(spaced, "[ _-]+"), lambda t: t != ""), lower)


def signature_tokens(signature: Column) -> Column:
    """Parts of the first word of each comma-separated field, without stop words and single letters."""
    fields = F.split(F.regexp_replace(signature, "[(){}]", " "), ",")
    first = F.transform(fields, lambda f: F.regexp_extract(f, "([A-Za-z_][A-Za-z0-9_]*)", 1))
    return F.filter(F.flatten(F.transform(first, camel_tokens)), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def identifiers(text: Column, least: int = 4) -> Column:
    """The distinct runs of ASCII letters, digits and _ of at least ``least`` bytes."""
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))), lambda t: F.length(t) >= least)


def slug(text: Column) -> Column:
    """Lower case, other runs than letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def xml_escape(text: Column) -> Column:
    """The five predefined entities."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def truncate_at_word(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last space within them if there is one."""
    head = F.substring(text, 1, most)
    at_word = F.regexp_extract(head, r"^(.*\S)\s+\S*$", 1)
    return F.when(F.length(text) <= most, text).when(at_word != "", at_word).otherwise(head)


def first_sentence(doc: Column, name: Column, most: int = 60, least: int = 5) -> Column:
    """A comment's first sentence without the leading symbol name, at most ``most`` characters; empty below ``least`` bytes."""
    rest = F.when(F.startswith(doc, F.concat(name, F.lit(" "))), F.substring(doc, F.length(name) + 2, 1 << 30)).otherwise(doc)
    short = truncate_at_word(F.trim(F.regexp_extract(rest, r"^([^.\n]*)", 1)), most)
    return F.when(F.octet_length(short) < least, F.lit("")).otherwise(short)


def file_handle(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_handle(path: Column, name: Column, kind: Column, line: Column) -> Column:
    return F.concat(F.lit("symbol:"), path, F.lit("::"), name, F.lit("#"), kind, F.lit("@"), line.cast("string"))


def parse_handle(handle: Column) -> Column:
    """path, name, kind and line of a handle; name, kind and line are empty or 0 for a file's, all for any other text."""
    rx = "^symbol:(.+)::(.+)#([^#@]+)@([0-9]+)$"
    part = lambda k: F.regexp_extract(handle, rx, k)
    path = F.when(F.startswith(handle, F.lit("file:")), F.substring(handle, 6, 1 << 30)).otherwise(part(1))
    return F.struct(path.alias("path"), part(2).alias("name"), part(3).alias("kind"), F.coalesce(part(4).try_cast("int"), F.lit(0)).alias("line"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def depth(path: Column) -> Column:
    """Directories above the file."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


# What a placeholder replaces.
HOME_PATH = r"/(?:home|Users)/[A-Za-z0-9._-]+"


def redact(text: Column, placeholder: str = "<redacted>") -> Column:
    """Home folders, and the values of assignments to secret-like names, replaced."""
    hidden = F.regexp_replace(text, HOME_PATH, placeholder)
    return F.regexp_replace(hidden, r"(?i)((?:api[_-]?key|token|secret|password|passwd)[ \t\n\f\r]*[:=][ \t\n\f\r]*[\"']?)[A-Za-z0-9_/+.-]{8,}", f"$1{placeholder}")
