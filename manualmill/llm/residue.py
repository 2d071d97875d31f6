"""Constructs of HTML, Markdown, MediaWiki and LaTeX markup in a text, outside its code.

Every construct counts for one markup only: the patterns are tried in a fixed
order and what one of them matched is blanked for the rest.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

MARKUPS = ("html", "markdown", "wiki", "latex")

# Names of HTML elements.
HTML_ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas "
    "caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset "
    "figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd "
    "label legend li link main map mark menu meta meter nav nobr noframes noscript object ol optgroup option output p param "
    "picture pre progress q rp rt ruby s samp script search section select small source span strike strong style sub "
    "summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
# Elements that do not interrupt a line of text.
INLINE_ELEMENTS = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n(?:.*?\n)?? {0,3}\1[`~]*[ \t]*(?=\n|\Z)|^ {0,3}(?:`{3,}|~{3,})[^\n]*\n.*\Z", re.M | re.S)
_PRE = re.compile(r"<pre\b[^<>]*>.*?(?:</pre\s*>|\Z)", re.I | re.S)
_INDENTED = re.compile(r"^(?: {4}|\t)[^\n\f]*", re.M)
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_ANY_TAG = re.compile(r"<[/!]?([A-Za-z][A-Za-z0-9]*)\b[^<>]*>|<![^<>]*>")
CODE = {"markdown": _FENCE, "html": _PRE, "pdf": _INDENTED}

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")

_LATEX = [
    re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}"),
    re.compile(r"(?<!\\)\\\[(?:[^\\]++|(?<=\\)\\(?!\])|\\(?![\[\]]))++\\\]|(?<!\\)\\\((?:[^\\\n]++|(?<=\\)\\(?!\))|\\(?![()]))++\\\)"),
    re.compile(r"\$\$[^$]++\$\$|(?<![\\$\w])\$(?=[^\s$])(?=[^$\n]*[\\^_{}=])[^$\n]++(?<=[^\s$\\])\$(?![\w$])"),
    re.compile(r"(?<![\\\w:])\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{"),
    re.compile(r"^[ \t]*\\(?:item|maketitle|tableofcontents|newpage|centering|noindent|hline)\b", re.M),
]
_WIKI = [
    re.compile(r"^\{\|.*?(?:^\|\}|\Z)", re.M | re.S),
    re.compile(r"\[\[(?!\s)(?:[^\[\]\n]|\[\[[^\[\]\n]*\]\])+?(?<!\s)\]\]"),
    re.compile(r"\{\{(?!\s)[^{}\n]+?(?<!\s)\}\}|\{\{(?!\s)[^{}\n|]+\n[ \t]*\|[^{}]*+\}\}"),
    re.compile(r"^[ \t]*(={2,6})[ \t]*(?=[^=\s])[^\n]*?(?<=[^=\s])[ \t]*\1[ \t]*$", re.M),
    re.compile(r"(?<!')('{5}|'{3}|'{2})(?=[^\s'])[^'\n]+(?:'[^'\n]+)*?(?<=[^\s'])\1(?!')"),
    re.compile(r"(?<![\w\[])\[(?:https?|ftp)://[^\s\]]+(?: [^\]\n]*)?\]"),
]
_MARKDOWN = [
    re.compile(r"!?\[[^\[\]\n]*\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"\n]*\")?\)"),
    re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]+\S+", re.M),
    re.compile(r"(?<![\w\]])\[[^\[\]\n]+\]\[[^\[\]\n]*\]"),
    re.compile(r"^ {0,3}#{1,6}[ \t]+\S[^\n]*", re.M),
    re.compile(r"^(?=[^\n]*[^\W_])(?![ \t])[^\n|]+\n {0,3}(?:={3,}|-{3,})[ \t]*$", re.M),
    re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$", re.M),
    re.compile(r"^[ \t]*\|[^\n|]+\|(?:[^\n|]+\|)+[ \t]*$", re.M),
    re.compile(r"~~(?=[^\s~])[^~\n]+?(?<=[^\s~])~~"),
    re.compile(r"(?<![\w*\\])\*\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*\*(?![*\w])|(?<![\w\\/.])__(?=[^\s_])[^_\n]+?(?<=[^\s_])__(?![\w(/])"),
    re.compile(r"(?<![\w*\\/.])\*(?=[^\s*])[^*\n]+?(?<=[^\s*/])\*(?![\w*/.])|(?<![\w\\/.])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w/])"),
]


def _blank(m: re.Match) -> str:
    return "\x00" + "\n" * m.group(0).count("\n")


def is_tag(m: re.Match) -> bool:
    name = m.group(1)
    return name is None or name.lower() in HTML_ELEMENTS


def outside_code(kind: str, text: str) -> str:
    """The text without its code; tags of an html text are gone too, those of blocks as line ends."""
    text = text.replace("\r\n", "\n")
    if kind == "html":
        text = _PRE.sub("\n\n", text) if "<pre" in text or "<PRE" in text else text
        text = _HIDDEN.sub("\n", text)
        text = _ANY_TAG.sub(lambda m: "" if (m.group(1) or "").lower() in INLINE_ELEMENTS else "\n", text)
        return html.unescape(text) if "&" in text else text
    if kind == "pdf":
        return _INDENTED.sub("", text).replace("\f", "\n\n") if "    " in text or "\t" in text else text.replace("\f", "\n\n")
    return _FENCE.sub("", text) if "```" in text or "~~~" in text else text


def count_constructs(kind: str, text: str | None) -> dict[str, int]:
    """How many constructs of each markup foreign to the kind the text holds; markups without any are left out."""
    if not text:
        return {}
    own = kind if kind in MARKUPS else None
    rest = outside_code(kind, text)
    found: dict[str, int] = {}

    def take(markup: str, patterns: list[re.Pattern]) -> None:
        nonlocal rest
        for pattern in patterns:
            rest, n = pattern.subn(_blank, rest)
            if n and markup != own:
                found[markup] = found.get(markup, 0) + n

    if kind != "html":
        n = 0
        if "<" in rest:
            rest, n = _COMMENT.subn(_blank, rest)

            def tag(m: re.Match) -> str:
                nonlocal n
                if not is_tag(m):
                    return m.group(0)
                n += 1
                return "\x00"

            rest = _ANY_TAG.sub(tag, rest)
        if "&" in rest:

            def entity(m: re.Match) -> str:
                nonlocal n
                if m.group(1)[0] != "#" and m.group(1) + ";" not in html5:
                    return m.group(0)
                n += 1
                return "\x00"

            rest = _ENTITY.sub(entity, rest)
        if n:
            found["html"] = n
    if "\\" in rest or "$" in rest:
        take("latex", _LATEX)
    if "[[" in rest or "{" in rest or "''" in rest or "==" in rest or "://" in rest:
        take("wiki", _WIKI)
    if own != "markdown":
        take("markdown", _MARKDOWN)
    return found
