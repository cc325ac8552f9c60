"""Text measures, validity, languages, query words, line windows and paths, all as column expressions."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CHUNK_CAPACITY, LANGUAGES, MAX_AVERAGE_LINE, MAX_DIGITS, MAX_LINE, MAX_LINES, MIN_ALNUM, PROSE


def ascii_lower(text: Column) -> Column:
    """A text with small ASCII letters; others stay, as where patterns are matched without the case of ASCII letters only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def lines(text: Column) -> Column:
    """The lines of a text; a line break at the end makes an empty one."""
    return F.split(text, "\n", -1)


def metrics(text: Column) -> dict[str, Column]:
    """num_lines, max_line, avg_line, alnum_fraction and digit_fraction (ASCII, of all characters with line breaks)."""
    each = lines(text)
    n, chars = F.size(each), F.length(text)
    whole = F.greatest(chars, F.lit(1))
    return {
        "num_lines": n,
        "max_line": F.array_max(F.transform(each, F.length)),
        "avg_line": (chars - (n - 1)) / n,
        "alnum_fraction": F.regexp_count(text, F.lit("[0-9A-Za-z]")) / whole,
        "digit_fraction": F.regexp_count(text, F.lit("[0-9]")) / whole,
    }


def extension(path: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


def is_valid(text: Column, path: Column) -> Column:
    """Whether a text looks written rather than generated; empty texts do, prose may have long lines."""
    m = metrics(text)
    short = (m["max_line"] <= MAX_LINE) & (m["avg_line"] <= MAX_AVERAGE_LINE)
    sound = (m["alnum_fraction"] >= MIN_ALNUM) & (m["num_lines"] <= MAX_LINES) & (m["digit_fraction"] <= MAX_DIGITS)
    return (F.length(text) == 0) | ((extension(path).isin(*PROSE) | short) & sound)


CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def split_camel(text: Column) -> Column:
    """A space between a small and a capital letter, and before the last of several capitals that a small one follows."""
    return F.regexp_replace(text, CAMEL.pattern, " ")


def query_words(query: str) -> list[str]:
    """The words that a query asks for: its runs of ASCII letters and digits, split at humps, in lower case."""
    return [w.lower() for run in re.split(r"[^0-9a-zA-Z]+", query) for w in CAMEL.sub(" ", run).split()]


def line_windows(text: Column, capacity: int = CHUNK_CAPACITY) -> Column:
    """Consecutive lines of together at least ``capacity`` characters with their breaks: an array of (line, body).

    ``line`` counts from 0. A fold over the lines that carries their number, where the window began and how long it is; only
    whole windows are added to the array.
    """
    each = lines(text)
    kind = "struct<done:array<struct<first:int,n:int>>,first:int,size:int,next:int>"
    start = F.from_json(F.lit('{"done":[],"first":0,"size":0,"next":1}'), kind)

    def step(acc: Column, line: Column) -> Column:
        size = acc["size"] + F.length(line) + 1
        whole = size >= capacity
        window = F.array(F.struct(acc["first"].alias("first"), (acc["next"] - acc["first"]).alias("n")))
        return F.struct(
            F.when(whole, F.concat(acc["done"], window)).otherwise(acc["done"]).alias("done"),
            F.when(whole, acc["next"]).otherwise(acc["first"]).alias("first"),
            F.when(whole, F.lit(0)).otherwise(size).alias("size"),
            (acc["next"] + 1).alias("next"),
        )

    n = F.size(each)
    folded = F.aggregate(each, start, step)
    rest = F.when(folded["first"] < n, F.array(F.struct(folded["first"].alias("first"), (n - folded["first"]).alias("n")))).otherwise(F.array().cast("array<struct<first:int,n:int>>"))
    windows = F.concat(folded["done"], rest)
    return F.transform(windows, lambda w: F.struct(w["first"].alias("line"), F.array_join(F.slice(each, w["first"] + 1, w["n"]), "\n").alias("body")))


def ancestors(path: Column) -> Column:
    """Of a path its prefixes, itself last: an array of (path, parent, depth, is_leaf); the root is the empty path."""
    parts = F.split(path, "/")
    n = F.size(parts)
    prefix = lambda k: F.array_join(F.slice(parts, 1, k), "/")
    level = lambda k: F.struct(prefix(k).alias("path"), F.when(k > 0, prefix(k - 1)).alias("parent"), k.alias("depth"), (k == n).alias("is_leaf"))
    return F.transform(F.sequence(F.lit(0), n), level)


def glob_regex(glob: str) -> str:
    """The regular expression of a glob over paths with slashes."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inside = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]", end + 1
        elif glob[i] == "{" and (end := glob.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(glob_regex(g) for g in glob[i + 1 : end].split(",")) + ")", end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def escape_xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def fence(text: Column) -> Column:
    """Backticks, three or as many more as no run in the text has."""
    runs = F.regexp_extract_all(text, F.lit("(`{3,})"), F.lit(1))
    return F.repeat(F.lit("`"), F.coalesce(F.array_max(F.transform(runs, F.length)) + 1, F.lit(3)))


def occurrences(text: Column, word: str) -> Column:
    """How often a word stands in a text, overlapping ones too."""
    return F.regexp_count(text, F.lit(f"(?={re.escape(word)})"))


FENCES = {"typescript": "typescript", "tsx": "typescript", "javascript": "javascript", "jsx": "javascript", "python": "python"}


def fence_language(language: Column) -> Column:
    """What stands behind the first fence of a language's text; nothing for most."""
    known = F.create_map(*(F.lit(x) for pair in FENCES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, language), F.lit(""))


def plain_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")
