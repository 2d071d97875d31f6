"""Problem 4, second stage: clean text by a site style tree.

Every document is brought into one plain form first: whatever its markup, headings become "# ", list items "- " or "1. "
(indented by their depth), table rows "| a | b |" with a line of dashes below a head, code a fence, inline code backticks,
formulas $...$ or $$...$$, all other markup its text.  Its blocks are the leaves of a tree whose inner nodes are the
elements that they stand in, each by its path of names from the root, without mere wrappers (body, section, div and the
like), so that texts of any kind meet.  The trees of a site are merged: documents that have the same path share that node.

Presentation: a node is shown in some way in each page, by the names of its children in order.  Its node importance is the entropy of
these ways over the pages that have it, to the base of their number.  Content: the importance of a leaf is one
less the entropy of its content over those pages; content that every page has is worth 0, content of one page 1.
The composite importance of an inner node of l presentations is (1 - g^l) of its node importance and g^l of the mean importance of
the leaves below it.  A branch all of whose nodes are of low composite importance is removed whole from each page;
elsewhere single leaves of low importance are, unless their place, the path with wrappers and classes, is one where several pages
have other contents and this page alone has this one.

Plan: one pass over the texts writes plain blocks with hashes of their paths and contents to the checkpoint folder.  As a
content that n pages have is spread evenly over them, its entropy is log n, so the merged tree is counts by
(site, node, presentation or content): narrow shuffles of 32-byte rows with map-side combine, and a hot site is spread over
its nodes and contents.  A node's leaves are gathered by their chain of ancestors, not level by level.  Texts move once, for the join with
what is to be removed.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, small_batches, written
from .residue import _COMMENT, _FENCE, _INDENTED, HTML_ELEMENTS, INLINE_ELEMENTS


@dataclass(frozen=True)
class TreeRules:
    #: Leaves of a lower composite importance are removed.
    importance: float = 0.3
    #: Pages that must share a node before any of its leaves can be unimportant, and that must share the leaf.
    least_pages: int = 8
    #: Weight of a node's presentations in the composite importance of its leaves.
    presentation: float = 0.1
    #: g of the composite importance of inner nodes; branches of a lower importance than the second go whole.
    decay: float = 0.9
    branch: float = 0.15
    #: Blocks of fewer letters and digits are no leaves of the tree.
    least_chars: int = 12


_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b([^<>]*)>")
_ATTRIBUTE = re.compile(r"""\b(class|alt|border)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DROP = re.compile(r"<(script|style|noscript|title)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<!DOCTYPE[^<>]*>", re.I | re.S)
_PRE = re.compile(r"<pre\b[^<>]*>(.*?)(?:</pre\s*>|\Z)", re.I | re.S)
#: What is kept as it is; code has a mark of its own.
_KEPT = re.compile("[\x03\x05](\\d+)\x04")


#: Elements that are no nodes of their own: what they hold stands in the element around them.
_TRANSPARENT = frozenset("html head p tbody thead tfoot caption colgroup col dt dd option".split())
#: Elements that are part of a place but not of the path of a node; lists are there by their items.
_WRAPPERS = frozenset("body section main article div center ul ol".split())


def _without_tags(text: str) -> str:
    """HTML structure as plain lines; where an element that holds blocks begins or ends stands a mark with its name."""
    cells, heads = 0, False  # of the table row that is open

    def turn(m: re.Match) -> str:
        nonlocal cells, heads
        end, name, rest = m.group(1), m.group(2).lower(), m.group(3)
        if name not in HTML_ELEMENTS:
            return m.group(0)
        if re.fullmatch(r"h[1-6]", name):
            return "\n\n" if end else "\n\n" + "#" * int(name[1]) + " "
        if name == "li":
            return "\n" if end else "\n- "
        if name == "tr":
            if not end:
                cells, heads = 0, False
                return "\n| "
            return "\n" + "| --- " * cells + "|\n" if heads and cells else "\n"
        if name in ("td", "th"):
            cells, heads = cells + (not end), heads or name == "th"
            return " |" if end else " "
        if name == "br":
            return "\n"
        if name == "hr":
            return "\n\n"
        if name == "img":
            found = {a.group(1).lower(): a.group(2) or a.group(3) or a.group(4) or "" for a in _ATTRIBUTE.finditer(rest)}
            return found.get("alt", "")
        if name == "code":
            return "`"
        if name in INLINE_ELEMENTS:
            return ""
        if name in _TRANSPARENT:
            return "\n\n"
        if end:
            return f"\n\n\x01-{name}\x02"
        kind = next((a.group(2) or a.group(3) or a.group(4) or "" for a in _ATTRIBUTE.finditer(rest) if a.group(1).lower() == "class"), "")
        return "\n\n\x01" + ".".join([f"+{name}", *kind.split()]) + "\x02"

    return _TAG.sub(turn, text)


def _link(m: re.Match) -> str:
    body = m.group(1)
    if re.match(r"(?i)category:", body):
        return ""
    return body.rpartition("|")[2]


def _template(m: re.Match) -> str:
    parts = [p.strip() for p in m.group(1).split("|")]
    named = [p.replace("=", ":", 1) for p in parts[1:] if "=" in p]
    return "\n".join(f"- {p}" for p in named) if named else parts[-1] if len(parts) > 1 else ""


def _wiki_table(m: re.Match) -> str:
    rows: list[list[str]] = [[]]
    heads: set[int] = set()
    for line in m.group(0).split("\n")[1:]:
        if line.startswith("|}"):
            break
        if line.startswith("|-"):
            rows.append([])
        elif line[:1] in "|!" and line:
            rows[-1] += [c.strip() for c in re.split(r"\|\||!!", line.lstrip("|!+"))]
            if line[0] == "!":
                heads.add(len(rows) - 1)
    lines = ["| " + " | ".join(r) + " |" + ("\n" + "| --- " * len(r) + "|" if k in heads else "") for k, r in enumerate(rows) if r]
    return "\n\n" + "\n".join(lines) + "\n\n"


def _heading(level: int) -> str:
    return "\n\n" + "#" * min(level, 6) + " "


# Conversions of foreign markup, applied in this order to what is not code.
_WIKI = [
    (re.compile(r"^\{\|.*?(?:^\|\}|\Z)", re.M | re.S), _wiki_table),
    (re.compile(r"\[\[(?!\s)((?:[^\[\]\n]|\[\[[^\[\]\n]*\]\])+?)(?<!\s)\]\]"), _link),
    (re.compile(r"\{\{(?!\s)([^{}]++)\}\}"), _template),
    (re.compile(r"^[ \t]*(={2,6})[ \t]*(?=[^=\s])([^\n]*?)(?<=[^=\s])[ \t]*\1[ \t]*$", re.M), lambda m: _heading(len(m.group(1))) + m.group(2) + "\n"),
    (re.compile(r"(?<!')('{5}|'{3}|'{2})(?=[^\s'])([^'\n]+(?:'[^'\n]+)*?)(?<=[^\s'])\1(?!')"), lambda m: m.group(2)),
]
# Formulas, what stands around them, their new sign and the group of their body.  No body holds code or a sign of its
# own formula, so that these are linear in the text, however long a formula is.
_FORMULA = [
    (re.compile(r"\\begin\{(equation|align|displaymath|math|gather)\*?\}((?:[^\\\x05]++|\\(?!(?:begin|end)\{\1\*?\}))*+)\\end\{\1\*?\}"), "\n\n", "$$", 2),
    (re.compile(r"(?<!\\)\\\[((?:[^\\\x05]++|(?<=\\)\\(?!\])|\\(?![\[\]]))++)\\\]"), "", "$$", 1),
    (re.compile(r"(?<!\\)\\\(((?:[^\\\n\x05]++|(?<=\\)\\(?!\))|\\(?![()]))++)\\\)"), "", "$", 1),
]
_IS_FORMULA = re.compile(r"\$\$[^$\x05]++\$\$|(?<![\\$\w])\$(?=[^\s$])(?=[^$\n]*[\\^_{}=<>])[^$\n\x05]++(?<=[^\s$\\])\$(?![\w$])")
_LEVEL = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_LATEX = [
    (re.compile(r"\\(part|chapter|(?:sub){0,2}section|paragraph)\*?\{([^{}\n]*)\}(?:\\label\{[^{}]*\})?"), lambda m: _heading(_LEVEL[m.group(1)]) + m.group(2) + "\n"),
    (re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?"), lambda m: "\n"),
    (re.compile(r"^[ \t]*\\item\b[ \t]*", re.M), lambda m: "- "),
    (re.compile(r"~?\\(?:cite|ref|label|footnotemark)[a-z]*\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}"), lambda m: ""),
    (re.compile(r"(?<![\\\w:])\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}"), lambda m: m.group(1)),
]
_MARKDOWN = [
    (re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]+\S+[^\n]*$", re.M), lambda m: ""),
    (re.compile(r"!?\[([^\[\]\n]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"\n]*\")?\)"), lambda m: m.group(1)),
    (re.compile(r"(?<![\w\]])\[([^\[\]\n]+)\]\[[^\[\]\n]*\]"), lambda m: m.group(1)),
    (re.compile(r"^(?=[^\n]*[^\W_])(?![ \t#>|\-])([^\n|]+)\n {0,3}(={3,}|-{3,})[ \t]*$", re.M), lambda m: _heading(1 if m.group(2)[0] == "=" else 2) + m.group(1) + "\n"),
    (re.compile(r"^( {0,3}#{1,6})[ \t]+([^\n]*?)[ \t]+#+[ \t]*$", re.M), lambda m: f"{m.group(1).strip()} {m.group(2)}"),
    (re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", re.M), lambda m: "| --- " * len(re.findall("-+", m.group(0))) + "|"),
    (re.compile(r"~~(?=[^\s~])([^~\n]+?)(?<=[^\s~])~~"), lambda m: m.group(1)),
    (re.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]+?)(?<=[^\s*])\1(?![*\w])"), lambda m: m.group(2)),
    (re.compile(r"(?<![\w\\/.])(_{1,2})(?=[^\s_])([^_\n]+?)(?<=[^\s_])\1(?![\w(/])"), lambda m: m.group(2)),
]

#: What a text must contain for a conversion to find anything.
_MARKDOWN_SIGNS = (
    ("]:", _MARKDOWN[:1]), ("](", _MARKDOWN[1:2]), ("][", _MARKDOWN[2:3]), ("===", _MARKDOWN[3:4]), ("---", _MARKDOWN[3:4]), (" #", _MARKDOWN[4:5]),
    ("--", _MARKDOWN[5:6]), ("~~", _MARKDOWN[6:7]), ("*", _MARKDOWN[7:8]), ("_", _MARKDOWN[8:]),
)


#: Inline code, in backticks; what is in it is no markup.
_INLINE_CODE = re.compile(r"(?<![`\\])`(?=[^`\s])[^`\n\x01-\x05]*(?<=[^`\s])`(?!`)")


def plain_form(kind: str | None, text: str) -> str:
    """The text in the plain form; marks "\\x01+name\\x02" and "\\x01-name\\x02" of elements stay, for the tree."""
    text = text.replace("\r\n", "\n").replace("\x01", " ").replace("\x02", " ").replace("\x03", " ").replace("\x04", " ").replace("\x05", " ")
    kept: list[str] = []

    def keep(body: str, mark: str = "\x03") -> str:
        kept.append(_KEPT.sub(lambda m: kept[int(m.group(1))], body))
        return f"{mark}{len(kept) - 1}\x04"

    def code(body: str) -> str:
        return "\n\n" + keep("```\n" + body.strip("\n") + "\n```", "\x05") + "\n\n"

    def fenced(m: re.Match) -> str:
        lines = m.group(0).split("\n")
        closed = len(lines) > 1 and re.fullmatch(r"\s*[`~]{3,}\s*", lines[-1])
        return code("\n".join(lines[1 : -1 if closed else None]))

    if kind == "pdf":
        text = re.sub(r"(?:^(?: {4}|\t)[^\n\f]*(?:\n|\Z))+", lambda m: code(re.sub(r"(?m)^(?: {4}|\t)", "", m.group(0))), text, flags=re.M) if _INDENTED.search(text) else text
    elif kind != "html":
        text = _FENCE.sub(fenced, text)
        text = _INLINE_CODE.sub(lambda m: keep(m.group(0)), text) if "`" in text else text
    if "<" in text:
        text = _DROP.sub("", _COMMENT.sub("", text))
        text = _PRE.sub(lambda m: code(html.unescape(_TAG.sub("", m.group(1)))), text)
        text = _without_tags(text)
    text = html.unescape(text) if "&" in text else text
    text = _INLINE_CODE.sub(lambda m: keep(m.group(0)), text) if "`" in text else text
    text = text.replace("\f", "\n\n").replace("\n\n---\n\n", "\n\n")
    if "\\" in text:
        for pattern, around, sign, body in _FORMULA:
            text = pattern.sub(lambda m: around + keep(sign + " ".join(m.group(body).split()) + sign) + around, text)
    if "$" in text:
        text = _IS_FORMULA.sub(lambda m: keep(" ".join(m.group(0).split())), text)
    for sign, rules in (("{|", _WIKI[:1]), ("[[", _WIKI[1:2]), ("{{", _WIKI[2:3]), ("==", _WIKI[3:4]), ("''", _WIKI[4:]), ("\\", _LATEX), *_MARKDOWN_SIGNS):
        if sign in text:
            for pattern, turn in rules:
                text = pattern.sub(turn, text)
    return _KEPT.sub(lambda m: kept[int(m.group(1))], text)


_LIST = re.compile(r"[-*+] |\d+[.)] ")
_DASHES = re.compile(r"[|\- ]+")
_MARK = re.compile("\x01([+-])([^\x02]*)\x02")
STYLES = {"h": "h", "li": "l", "row": "r", "rule": "-", "quote": "q", "code": "c", "p": "p"}


def _level(indents: list[int], width: int) -> int:
    """Depth of a list item by its indent, among the items around it that are still open."""
    while indents and indents[-1] >= width:
        indents.pop()
    indents.append(width)
    return len(indents) - 1


def blocks(kind: str | None, text: str) -> list[tuple[tuple[str, ...], tuple[str, ...], str]]:
    """(place, path, block) of the text in reading order: the elements with classes that the block stands in, those of them that are
    nodes, each with the style of the block, and the block.

    List items are indented by two spaces for each list around theirs.  A line that goes on an item, in HTML any, else one that is
    indented, is part of it.
    """
    out: list[tuple[tuple[str, ...], tuple[str, ...], str]] = []
    plain = plain_form(kind, text)
    open_: list[str] = []
    path: tuple[str, ...] = ()
    nested = 0
    for part in re.split(r"(?s)(```\n.*?\n```)|\n\s*\n(?=\S)|\n\s*\n", plain):
        if not part:
            continue
        if part.startswith("```"):
            out.append(((*open_, "code"), (*path, "code"), part))
            continue
        if "\x01" in part:
            for sign, name in _MARK.findall(part):
                if sign == "+":
                    open_.append(name)
                else:  # the end of an element that is not open changes nothing
                    at = next((k for k in range(len(open_) - 1, -1, -1) if open_[k].split(".")[0] == name), None)
                    open_ = open_[:at] if at is not None else open_
            part = _MARK.sub("", part)
            names = [n.split(".")[0] for n in open_]
            path = tuple(n for n in names if n not in _WRAPPERS)
            nested = max(0, sum(n in ("ul", "ol") for n in names) - 1)
        lines: list[tuple[str, str, int]] = []  # style, text, depth
        indents: list[int] = []
        for raw in part.split("\n"):
            line = " ".join(raw.split())
            if not line.strip("#-|> ") and not (line[:1] == "|" and "-" in line and lines and lines[-1][0] == "row"):
                continue
            if line[0] == "#":
                style = "h"
            elif line[0] == "|":
                style = "rule" if _DASHES.fullmatch(line) else "row"
            elif _LIST.match(line):
                style = "li"
            else:
                style = "quote" if line[0] == ">" else "p"
            if style in ("h", "row", "rule"):
                lines.append((style, line, 0))
            elif style == "li":
                width = len(raw.expandtabs(4)) - len(raw.expandtabs(4).lstrip())
                lines.append((style, line, nested + _level(indents, width)))
            elif lines and (lines[-1][0] in ("p", "quote") or lines[-1][0] == "li" and (kind == "html" or raw[:1] in " \t")):
                lines[-1] = (lines[-1][0], f"{lines[-1][1]} {line}", lines[-1][2])
            else:
                lines.append((style, line, 0))
        for style, line, depth in lines:
            if style == "row":
                line = "| " + " | ".join(c.strip() for c in line.strip("| ").split("|")) + " |"
            own = ("li",) * (depth if style == "li" else 0) + (style,)
            out.append(((*open_, *own), (*path, *own), "  " * depth + line))
    return out


def _leaf(block: str) -> str:
    return re.sub(r"[\W_]+", "", block.lower())


PARSED = (
    "key string, text_id binary, is_null boolean, blocks array<string>, styles string, places array<long>, paths array<long>, leaves array<long>, "
    "nodes array<struct<path:long,look:long,chain:array<long>>>"
)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tree(kind: str | None, text: str, rules: TreeRules) -> tuple:
    """The columns of PARSED from blocks on: the leaves of a document and its inner nodes.

    A node is the hash of its path; chain holds its own and those above it, without the root; look is the hash of the
    names of its children in order, equal neighbours taken together, as a list of three items is shown like one of five.
    """
    digest = lambda x: _signed(xxhash.xxh3_64_intdigest("\x00".join(x)))
    tree = blocks(kind, text)
    known: dict[tuple[str, ...], int] = {}
    children: dict[tuple[str, ...], list[str]] = {}
    places, paths, leaves = [], [], []
    last: tuple[str, ...] = ()
    for place, path, block in tree:
        for k in range(1, len(path) + 1):
            if path[:k] not in known:
                known[path[:k]] = digest(path[:k])
        # What is new against the block before is shown in the node where they part.
        part = next((k for k, (x, y) in enumerate(zip(path, last)) if x != y), min(len(path), len(last)))
        for k in range(min(part, len(path) - 1), len(path)):
            shown = children.setdefault(path[:k], [])
            shown += [path[k]] if not shown or shown[-1] != path[k] else []
        last = path
        form = _leaf(block)
        places.append(digest(place))
        paths.append(known[path])
        leaves.append(digest([form]) if len(form) >= rules.least_chars else 0)
    nodes = [{"path": h, "look": digest(children.get(p, ["text"])), "chain": [known[p[:k]] for k in range(len(p), 0, -1)]} for p, h in known.items()]
    return [b for _, _, b in tree], "".join(STYLES[p[-1]] for _, p, _ in tree), places, paths, leaves, nodes


def _parse_batches(rules: TreeRules):
    node = pa.struct([("path", pa.int64()), ("look", pa.int64()), ("chain", pa.list_(pa.int64()))])
    types = [pa.string(), pa.binary(), pa.bool_(), pa.list_(pa.string()), pa.string(), *[pa.list_(pa.int64())] * 3, pa.list_(node)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, kind, text in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "text"))):
                mark = xxhash.xxh3_128_digest(f"{kind}\x00{text}".encode("utf-8", "surrogatepass"))
                rows.append((key, mark, text is None, *_tree(kind, text or "", rules)))
            columns = list(zip(*rows)) if rows else [[]] * len(types)
            names = ["key", "text_id", "is_null", "blocks", "styles", "places", "paths", "leaves", "nodes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def parsed(docs: DataFrame, key: str, kind: str, text: str, rules: TreeRules = TreeRules()) -> DataFrame:
    """PARSED with row, a number of each row: the plain blocks of every document and the nodes of its tree, written once."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).cast("string").alias("key"), F.col(kind).alias("kind"), F.col(text).alias("text"))
    return written(own.mapInArrow(_parse_batches(rules), PARSED).withColumn("row", F.monotonically_increasing_id()), "trees")


def merged(trees: DataFrame, site: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, nodes) of the documents that have a site: (row, at, key, place, path, leaf) of every block, at its number in the
    document, and (key, path, look, chain) of every node of a document once; key, place, path and chain are hashes, with the site
    in those of places and paths."""
    own = trees.where("key IS NOT NULL AND NOT is_null").select("row", "key", "places", "paths", "leaves", "nodes")
    own = own.join(site.where("site IS NOT NULL").select(F.col("slug").alias("key"), F.xxhash64("site").alias("site")), "key")
    own = own.withColumn("key", F.xxhash64("key"))
    each = own.select("row", "site", "key", F.posexplode(F.arrays_zip("places", "paths", "leaves")).alias("at", "b"))
    of = lambda c: F.xxhash64(F.col("site"), c)
    each = each.select("row", "at", "key", of(F.col("b.places")).alias("place"), of(F.col("b.paths")).alias("path"), F.col("b.leaves").alias("leaf"))
    nodes = own.select("site", "key", F.explode("nodes").alias("n"))
    nodes = nodes.select("key", of(F.col("n.path")).alias("path"), "n.look", F.transform("n.chain", of).alias("chain")).distinct()
    return written(each, "blocks"), written(nodes, "nodes")


def importance(each: DataFrame, nodes: DataFrame, rules: TreeRules = TreeRules()) -> tuple[DataFrame, DataFrame]:
    """(leaves, branches) of the merged trees: (path, leaf, importance) of the contents of low importance, and (path) of
    the nodes in branches of which no part is important."""
    contents = each.where("leaf <> 0").select("key", "path", "leaf").distinct()
    pages = nodes.groupBy("path", "look").agg(F.countDistinct("key").alias("s"), F.min("chain").alias("chain"))
    pages = pages.groupBy("path").agg(F.sum("s").alias("m"), F.sum(F.col("s") * F.log("s")).alias("logs"), F.count("*").alias("ways"), F.min("chain").alias("chain"))
    # Entropy of the presentations to the base of the number of pages; a node of one page tells nothing and counts as important.
    look = F.when(F.col("m") < 2, 1.0).otherwise(F.least(F.lit(1.0), (F.log("m") - F.col("logs") / F.col("m")) / F.log("m")))
    pages = checkpointed(pages.select("path", "m", "ways", "chain", look.alias("look")))
    counts = written(contents.groupBy("path", "leaf").agg(F.count("*").alias("n")), "contents")
    worth = F.when(F.col("m") < 2, 1.0).otherwise(1 - F.least(F.lit(1.0), F.log("n") / F.log("m")))
    leaves = counts.join(pages.select("path", "m", "look"), "path").withColumn("worth", worth)
    # Of the leaves of a node only their number and sum are needed above it.
    sums = leaves.groupBy("path").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("worth")).alias("w"))
    below = sums.join(pages.select("path", "chain"), "path").select(F.explode("chain").alias("path"), "n", "w")
    below = below.groupBy("path").agg((F.sum("w") / F.sum("n")).alias("mean"))
    fade = F.pow(F.lit(rules.decay), F.col("ways"))
    inner = checkpointed(pages.join(below, "path").withColumn("importance", (1 - fade) * F.col("look") + fade * F.col("mean")))
    # A branch is as important as its most important part.
    most = inner.select(F.explode("chain").alias("path"), "importance").groupBy("path").agg(F.max("importance").alias("most"))
    heads = inner.join(most, "path").where((F.col("most") < rules.branch) & (F.col("m") >= rules.least_pages)).select(F.col("path").alias("head"))
    branches = pages.select("path", F.explode("chain").alias("head")).join(heads, ["head"]).select("path").distinct()
    own_worth = (1 - rules.presentation) * F.col("worth") + rules.presentation * F.col("look")
    low = leaves.where((F.col("n") >= rules.least_pages) & (F.col("m") >= rules.least_pages)).select("path", "leaf", own_worth.alias("importance"))
    return low.where(F.col("importance") < rules.importance), branches


def unimportant(trees: DataFrame, site: DataFrame, rules: TreeRules = TreeRules()) -> DataFrame:
    """(row, gone): the numbers of the blocks that are to be removed from each document."""
    each, nodes = merged(trees, site)
    low, branches = importance(each, nodes, rules)
    found = each.where("leaf <> 0").join(low.select("path", "leaf"), ["path", "leaf"])
    # Contents that one page alone has in a place where several pages have others are its own.
    several = each.where("leaf <> 0").groupBy("place").agg(F.countDistinct("key").alias("_pages")).where(F.col("_pages") >= rules.least_pages)
    alone = found.groupBy("place", "leaf").agg(F.countDistinct("key").alias("_n")).where("_n = 1")
    proper = alone.join(several, ["place"]).select("place", "leaf")
    gone = found.join(proper, ["place", "leaf"], "left_anti").select("row", "at").unionByName(each.join(branches, "path").select("row", "at"))
    return gone.groupBy("row").agg(F.collect_set("at").alias("gone"))


CLEAN = "key string, text string, headings int, list_items int, table_rows int, code_blocks int, formulas int, removed int"


def _clean_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, null, texts, styles, gone in zip(*(batch.column(c).to_pylist() for c in ("key", "is_null", "blocks", "styles", "gone"))):
            if null:
                rows.append((key, None, 0, 0, 0, 0, 0, 0))
                continue
            drop = set(gone or ())
            left = [(s, b) for k, (s, b) in enumerate(zip(styles, texts)) if k not in drop]
            # A line of dashes stays only below the head that it belongs to.
            left = [x for k, x in enumerate(left) if x[0] != "-" or k and left[k - 1][0] == "r"]
            out = ""
            for k, (s, b) in enumerate(left):
                close = k and s in "lr-" and (left[k - 1][0] == s or {s, left[k - 1][0]} == {"r", "-"})
                out += ("" if not k else "\n" if close else "\n\n") + b
            count = {s: sum(x[0] == s for x in left) for s in "hlrc"}
            formulas = sum(len(_IS_FORMULA.findall(b)) for s, b in left if "$" in b and s != "c")
            rows.append((key, out, count["h"], count["l"], count["r"], count["c"], formulas, len(texts) - len(left)))
        types = [pa.string(), pa.string(), *[pa.int32()] * 6]
        columns = list(zip(*rows)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in CLEAN.split(", ")])


def cleaned(docs: DataFrame, key: str, kind: str, text: str, site: DataFrame, rules: TreeRules = TreeRules()) -> DataFrame:
    """CLEAN: every document once, as clean text, with what structure is left in it and how many blocks were removed.

    NULL texts stay NULL, empty ones empty.  Documents of unknown kind are read as Markdown; documents without a site
    are converted and keep all their blocks; a row given twice counts once.
    """
    trees = parsed(docs, key, kind, text, rules)
    once = trees.groupBy("key", "text_id").agg(F.min("row").alias("row")).select("row")
    what = once.join(unimportant(trees, site, rules), "row", "left")
    return trees.select("row", "key", "is_null", "blocks", "styles").join(what, "row").drop("row").mapInArrow(_clean_batches, CLEAN)
