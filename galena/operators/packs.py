"""Packs: files rendered at four layers, chosen within a token budget, as one document in XML, Markdown or JSON."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import short_id
from ..functions.text import ancestors, escape_xml, fence, fence_language, glob_regex
from ..functions.tokens import token_count
from ..schema import CONTAINERS, LANGUAGES, LAYERS, TOKEN_BUDGET
from ..session import BATCH_BYTES, bounded, cut, places, small_side
from ..sources.parse import Rows, nested
from .layers import backfilled, importance

NAME = "galena"
PURPOSE = "A snapshot of a code base for language models, in layers of fidelity, made by galena."
LAYER_NOTE = "A file is [full] (its text), [skeleton] (signatures; each body is a `cv:<id>` that can be expanded), [outline] (a list of signatures) or [omit] (only named in the tree)."
INDENTED = ("python",)
COMMENT = {"python": "#"}
EXPAND = [("id", pa.string()), ("path", pa.string()), ("name", pa.string()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32())]
RENDERED = pa.schema([("path", pa.string()), ("language", pa.string()), ("full", pa.string()), ("skeleton", pa.string()), ("outline", pa.string()), ("expand", pa.list_(pa.struct(EXPAND))), ("n_symbols", pa.int32())])
TEXTS = pa.schema([("id", pa.string()), ("path", pa.string()), ("name", pa.string()), ("text", pa.string())])
RENDERED_DDL = "path string, language string, full string, skeleton string, outline string, expand array<struct<id string, path string, name string, start_byte int, end_byte int, start_line int, end_line int>>, n_symbols int"


# layers of one file


def clean_signature(signature: Column, kind: Column, name: Column) -> Column:
    """A signature as a line of its own: without the brace or colon that opens the body; kind and name where it is empty."""
    plain = F.rtrim(F.regexp_replace(F.regexp_replace(F.trim(signature), r"\s*\{\s*$", ""), r":\s*$", ""))
    return F.when(F.length(F.trim(F.coalesce(signature, F.lit("")))) > 0, plain).otherwise(F.concat_ws(" ", kind, name))


def outline(symbols: Column) -> Column:
    """A line for each symbol (start_byte, depth, signature, kind, name) in the order of their starts, two spaces a scope."""
    ordered = F.array_sort(F.transform(symbols, lambda s, i: F.struct(s["start_byte"].alias("start"), i.alias("i"), s.alias("s"))))
    line = lambda o: F.concat(F.repeat(F.lit("  "), o["s"]["depth"]), clean_signature(o["s"]["signature"], o["s"]["kind"], o["s"]["name"]))
    return F.array_join(F.transform(ordered, line), "\n")


def trees_of(symbols: Iterable[dict]) -> Iterator[tuple[dict, list]]:
    """Outermost symbols, one after the other, as nodes and their children: the parent is the nearest one around."""
    stack: list = []
    root = None
    for s in symbols:
        node = (s, [])
        while stack and not (stack[-1][0]["end_byte"] >= s["end_byte"] and stack[-1][0]["start_byte"] <= s["start_byte"]):
            stack.pop()
        if stack:
            stack[-1][1].append(node)
        else:
            if root is not None:
                yield root
            root = node
        stack.append(node)
    if root is not None:
        yield root


def _in_order(symbols: pa.StructArray) -> Iterator[dict]:
    """Symbols by start, of one start the longest first, a few thousand of them as Python objects at once."""
    keys = pa.table({"start": symbols.field("start_byte"), "end": symbols.field("end_byte")})
    order = pc.sort_indices(keys, [("start", "ascending"), ("end", "descending")])
    for k in range(0, len(order), 4096):
        yield from symbols.take(order.slice(k, 4096)).to_pylist()


def skeletons(path: str, source: str, language: str, symbols: Iterable[dict]) -> Iterator[tuple[str, list[dict]]]:
    """The signature of each outermost symbol with a placeholder for its body, members inside of containers, and what the placeholders stand for.

    Symbols come in the order of their starts, of one start the longest first."""
    indented, mark = language in INDENTED, COMMENT.get(language, "//")

    def signature(s: dict) -> str:
        if s["body_start"] is None:
            return s["signature"] or s["name"]
        text = source[s["start_byte"] : s["body_start"]].rstrip()
        if text.endswith("{"):
            text = text[:-1].rstrip()
        return text

    def render(node: tuple[dict, list], indent: str, expand: list[dict]) -> str:
        s, children = node
        head = indent + signature(s)
        if s["kind"] in CONTAINERS and children:
            inner = "\n".join(render(c, indent + "  ", expand) for c in children)
            return f"{head}\n{inner}" if indented else f"{head} {{\n{inner}\n{indent}}}"
        one = short_id(path, s["qualified_name"])
        expand.append({"id": one, "path": path, "name": s["qualified_name"], **{k: s[k] for k in ("start_byte", "end_byte", "start_line", "end_line")}})
        note = f"{mark} … cv:{one}"
        return f"{head}\n{indent}    {note}" if indented else f"{head} {{ {note} }}"

    for root in trees_of(symbols):
        expand: list[dict] = []
        yield render(root, "", expand), expand


def rendered(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """path, language, full, skeleton, outline, expand and n_symbols of parsed files (path, language, symbols) with their content.

    A file in no known language or without symbols is the same in all layers."""
    known = F.col("language").isin(*set(LANGUAGES.values()))
    both = parsed.select("path", "language", "symbols").join(files.select("path", F.coalesce("content", F.lit("")).alias("full")), "path")
    both = both.withColumn("symbols", F.when(known, F.col("symbols")).otherwise(F.slice("symbols", 1, 0)))
    both = both.withColumn("outline", F.when(F.size("symbols") > 0, outline(F.col("symbols"))).otherwise(F.col("full")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                path, language, full, outlined = (b.column(c)[k].as_py() for c in ("path", "language", "full", "outline"))
                symbols = b.column("symbols")[k].values
                texts, expand = [], Rows(EXPAND)
                for text, entries in skeletons(path, full, language, _in_order(symbols)) if symbols is not None else ():
                    texts.append(text)
                    for e in entries:
                        expand.add(e)
                n = 0 if symbols is None else len(symbols)
                row = [path, language, full, "\n\n".join(texts) if n else full, outlined]
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.string()) for x in row), nested(expand.taken()), pa.array([n], pa.int32())], schema=RENDERED)

    return bounded(both.select("path", "language", "full", "outline", "symbols")).mapInArrow(run, RENDERED_DDL)


@dataclass(frozen=True)
class Compressed:
    files: DataFrame  # path, language, layer, content and tokens of every file
    expand: DataFrame  # one row a placeholder of a file in the skeleton layer
    total: int
    budget: int

    @property
    def fits(self) -> bool:
        return self.total <= self.budget


def compress(layers: DataFrame, ranks: DataFrame | None = None, budget: int = TOKEN_BUDGET, strategy: str = "auto", always_full: list[str] | None = None, vocabulary: str | None = None) -> Compressed:
    """Files (``rendered``) each at the layer that the budget leaves it; ranks are path and importance, the largest rank.

    Files that match a glob of ``always_full`` stay full whatever the budget."""
    pinned = F.lit(False)
    for g in always_full or []:
        pinned = pinned | F.col("path").rlike(f"^{glob_regex(g)}$")
    costs = layers.select("path", "n_symbols", *(token_count(F.col(c), vocabulary).alias(f"cost_{c}") for c in LAYERS[:3]), pinned.alias("pinned"))
    if ranks is None:
        costs = costs.withColumn("rank", F.lit(0.0))
    else:
        costs = costs.join(ranks.select("path", F.col("importance").alias("rank")), "path", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    costs = cut(costs.withColumn("importance", importance(F.col("rank"), F.col("n_symbols")).cast("double")))
    chosen = cut(backfilled(costs, budget, strategy))
    total = int(chosen.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0])
    both = layers.join(chosen, "path")
    name = F.element_at(F.array(*map(F.lit, LAYERS)), F.col("layer") + 1)
    content = F.when(F.col("layer") == 0, F.col("full")).when(F.col("layer") == 1, F.col("skeleton")).when(F.col("layer") == 2, F.col("outline")).otherwise("")
    files = both.select("path", "language", name.alias("layer"), content.alias("content"), F.col("cost").alias("tokens"))
    expand = both.where(F.col("layer") == 1).select(F.explode("expand").alias("e")).select("e.*")
    return Compressed(files, expand, total, budget)


def preview(files: DataFrame) -> DataFrame:
    """path, layer and tokens of each file, without the content."""
    return files.select("path", "layer", "tokens")


def layer_counts(files: DataFrame) -> DataFrame:
    """One row: the files of each layer."""
    return files.agg(*(F.count_if(F.col("layer") == name).alias(name) for name in LAYERS))


# the whole document


def tree_lines(files: DataFrame, collation: str | None = None, show_layers: bool = True) -> DataFrame:
    """place and line of the directory tree of files (path, layer): folders before files, each by name, two spaces a level.

    A path that is a file and a folder is a folder. With a collation (``UNICODE``) names go by its order."""
    each = files.select("path", "layer", F.explode(ancestors(F.col("path"))).alias("a")).select("a.path", "a.depth", "a.is_leaf", F.when(F.col("a.is_leaf"), F.col("layer")).alias("layer"))
    nodes = each.where("depth > 0").groupBy("path", "depth").agg(F.min("is_leaf").alias("is_leaf"), F.max("layer").alias("layer"))
    names = F.split("path", "/")
    named = lambda x: F.collate(x, collation) if collation else x
    key = F.transform(names, lambda x, i: F.struct((F.col("is_leaf") & (i == F.size(names) - 1)).alias("file"), named(x).alias("name")))
    mark = F.when(F.lit(show_layers) & F.col("layer").isNotNull(), F.concat(F.lit("  ["), "layer", F.lit("]"))).otherwise("")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.element_at(names, -1), F.when(F.col("is_leaf"), mark).otherwise("/"))
    placed = places(nodes.select(key.alias("key"), "path", line.alias("line")), "place", F.col("key"), F.col("path"))
    return placed.select("place", "line")


def json_string(text: Column) -> Column:
    """A text as a JSON string in quotes."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("c"))), r"(?s)^\{\"c\":(.*)\}$", 1)


def file_parts(files: DataFrame, form: str) -> DataFrame:
    """path and part, the text that stands for a file, of the files that aren't omitted."""
    shown = files.where("layer <> 'omit'")
    if form == "xml":
        tag = [F.lit('<file path="'), escape_xml(F.col("path")), F.lit('" layer="'), F.col("layer"), F.lit('" tokens="'), F.col("tokens").cast("string"), F.lit('">\n')]
        part = F.concat(*tag, escape_xml(F.col("content")), F.lit("\n</file>"))
    elif form == "markdown":
        mark = fence(F.col("content"))
        part = F.concat(F.lit("### "), "path", F.lit("  `["), "layer", F.lit("]`\n\n"), mark, fence_language(F.col("language")), F.lit("\n"), "content", F.lit("\n"), mark)
    elif form == "json":
        lines = [f'"{k}": ' for k in ("path", "language", "layer", "tokens", "content")]
        values = [json_string(F.col(k)) if k != "tokens" else F.col(k).cast("string") for k in ("path", "language", "layer", "tokens", "content")]
        part = F.concat(F.lit("    {\n"), F.concat_ws(",\n", *(F.concat(F.lit(f"      {k}"), v) for k, v in zip(lines, values, strict=True))), F.lit("\n    }"))
    else:
        raise ValueError(f"unknown format {form}")
    return shown.select("path", part.alias("part"))


def frame(form: str, tree: str, tokens: int, expandable: int) -> tuple[str, str, str]:
    """What stands before, between and behind the parts of the files."""
    plain = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    if form == "xml":
        head = f'<{NAME} token_count="{tokens}" expandable="{expandable}">\n<summary>\n{plain(PURPOSE)}\n{plain(LAYER_NOTE)}\n</summary>\n<directory_structure>\n{plain(tree)}\n</directory_structure>\n<files>'
        return head, "\n", f"</files>\n</{NAME}>"
    if form == "markdown":
        return f"# Repository Snapshot ({NAME})\n\n{PURPOSE}\n\n{LAYER_NOTE}\n\n_Total tokens: {tokens} · Expandable symbols: {expandable}_\n\n## Directory Structure\n\n```\n{tree}\n```\n\n## Files", "\n\n", ""
    import json

    head = {"generator": NAME, "tokenCount": tokens, "expandableCount": expandable, "directoryStructure": tree}
    return json.dumps(head, indent=2, ensure_ascii=False)[:-2] + ',\n  "files": [', ",\n", "  ]\n}"


def render(packed: Compressed, form: str = "xml", collation: str | None = "UNICODE") -> str:
    """The pack as one text. It is as large as its budget and pins let it be, plus a line a file for the tree."""
    tree = "\n".join(r.line for r in tree_lines(packed.files, collation).orderBy("place").toLocalIterator())
    order = F.collate("path", collation) if collation else F.col("path")
    parts = [r.part for r in file_parts(packed.files, form).orderBy(order, "path").toLocalIterator()]
    head, between, tail = frame(form, tree, packed.total, packed.expand.count())
    if form == "json":
        return head + ("\n" + between.join(parts) + "\n" if parts else "") + (tail if parts else tail.lstrip())
    return between.join([head, *parts, *([tail] if tail else [])])


# expanding


def expanded(entries: DataFrame, files: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id, path, name and text of placeholders (all, or those of ids): the part of their file's content that they stand for.

    A file's content meets all of its placeholders at once and is cut in one pass, not once for each of them."""
    wanted = entries if ids is None else entries.join(small_side(ids.select("id")), "id", "left_semi")
    each = wanted.groupBy("path").agg(F.collect_list(F.struct("id", "name", "start_byte", "end_byte")).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                path, content, every = b.column("path")[k].as_py(), b.column("content")[k].as_py(), b.column("all")[k].values
                rows, size = [], 0
                for at in range(0, len(every), 4096):
                    for e in every.slice(at, 4096).to_pylist():
                        known = content is not None and e["start_byte"] is not None and e["end_byte"] is not None
                        text = content[e["start_byte"] : e["end_byte"]] if known else None
                        rows.append({"id": e["id"], "path": path, "name": e["name"], "text": text})
                        size += len(text or "")
                        if len(rows) >= 4096 or size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=TEXTS)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=TEXTS)

    return bounded(each.join(files.select("path", "content"), "path").select("path", "content", "all")).mapInArrow(run, "id string, path string, name string, text string")
