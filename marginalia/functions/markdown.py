"""Markdown of notes as trees of blocks and back, in plain Python. It reads the part of CommonMark that blocks can hold:
headings, paragraphs, lists with nesting and tasks, quotes, callouts, fenced code, tables, rules, display math, images."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import itemgetter

#: Fixed values.
CALLOUT_ICONS = {
    "note": "💡", "abstract": "📋", "summary": "📋", "info": "ℹ️", "todo": "📝", "tip": "💡", "hint": "💡", "important": "❗", "success": "✅", "check": "✅", "done": "✅",
    "question": "❓", "help": "❓", "faq": "❓", "warning": "⚠️", "caution": "⚠️", "attention": "⚠️", "failure": "❌", "fail": "❌", "missing": "❌",
    "danger": "🔴", "error": "🔴", "bug": "🐛", "example": "📖", "quote": "💬", "cite": "💬",
}
DEFAULT_ICON = "💡"
PLAIN_LANGUAGE = "plain text"
SEGMENT = 2000
EMBED_IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp", ".ico")
EMBED_ICONS = ((".pdf", "📄"), (".mp3", "🎵"), (".wav", "🎵"), (".m4a", "🎵"), (".mp4", "🎬"), (".webm", "🎬"), (".mov", "🎬"), (".excalidraw.md", "✏️"))

RUN = ("type", "content", "link", "page_id", "bold", "italic", "strike", "underline", "code", "color")


def run(content: str, kind: str = "text", **style: object) -> dict:
    base = {"type": kind, "content": content, "link": None, "page_id": None, "bold": False, "italic": False, "strike": False, "underline": False, "code": False, "color": None}
    return base | style


@dataclass
class Block:
    type: str
    runs: list[dict] = field(default_factory=list)
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Block] = field(default_factory=list)


# inline

_INLINE = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<query>`=(?P<q>[^`]+)`)|(?P<code>(?P<tick>`+)(?P<c>.+?)(?<!`)(?P=tick)(?!`))|(?P<embed>!\[\[(?P<et>[^\[\]|]+)(?:\|(?P<ea>[^\[\]]+))?\]\])"
    r"|(?P<wiki>\[\[(?P<wt>[^\[\]|]+)(?:\|(?P<wa>[^\[\]]+))?\]\])|(?P<image>!\[(?P<ia>[^\]]*)\]\((?P<iu>[^)\s]+)[^)]*\))|(?P<link>\[(?P<lt>[^\]]+)\]\((?P<lu>[^)\s]+)[^)]*\))"
    r"|(?P<auto><(?P<au>[a-z][a-z0-9+.-]*:[^>\s]+)>)|(?P<math>\$(?P<m>[^$\s](?:[^$\n]*[^$\s])?)\$(?!\d))|(?P<strong>(?P<s>\*\*|__)(?=\S)(?P<st>.+?)(?<=\S)(?P=s))"
    r"|(?P<strike>~~(?=\S)(?P<kt>.+?)(?<=\S)~~)|(?P<high>==(?P<ht>[^=]+)==)|(?P<em>(?:\*|(?<!\w)_)(?=\S)(?P<emt>[^*_]+?)(?<=\S)(?:\*|_(?!\w)))|(?P<break>(?: {2,}|\\)\n)|(?P<soft>\n)",
    re.S,
)
#: Where one of them can begin, but for spaces before a line's end. All are tried there only, as trying them at every letter is most
#: of a note's time.
_START = re.compile(r"[\\`!\[<$*_~=\n]")
_STYLE = itemgetter(*(n for n in RUN if n != "content"))

Resolver = Callable[[str], str | None]


def _wiki(target: str, alias: str | None, resolve: Resolver | None, style: str) -> dict | None:
    page = re.split(r"[#^]", target)[0]
    shown = alias or re.sub(r"\.md$", "", target.rsplit("/", 1)[-1])
    page_id = resolve(page) if resolve else None
    if page_id:
        return run(shown, "mention", page_id=page_id)
    if style == "skip":
        return None
    return run(shown) if style == "text" else run(f"[[{target}]]", color="red")


def _embed(target: str, alias: str | None) -> dict:
    lower = target.lower()
    if lower.endswith(EMBED_IMAGES):
        shown = alias if alias and not re.search(r"[x\d]", alias) else target
        return run(f"[🖼️ {shown}]", color="gray_background")
    icon = next((i for ext, i in EMBED_ICONS if lower.endswith(ext)), "📎")
    return run(f"[{icon} {alias or target}]", color="blue_background")


def _marks(text: str) -> Iterator[re.Match]:
    """What ``_INLINE.finditer`` finds."""
    at = 0
    while start := _START.search(text, at):
        begin = start.start()
        if start[0] == "\n" and text.endswith("  ", at, begin):
            begin = at + len(text[at:begin].rstrip(" "))
        m = _INLINE.match(text, begin)
        if m:
            yield m
        at = m.end() if m else begin + 1


def inline(text: str, resolve: Resolver | None = None, style: str = "placeholder", **outer: object) -> list[dict]:
    """Runs of a text. Adjacent runs of equal style are one."""
    out: list[dict] = []
    base = run("", **outer)
    add = lambda content, **more: out.append({**base, "content": content, **more})
    at = 0
    for m in _marks(text):
        if m.start() > at:
            add(text[at : m.start()])
        at = m.end()
        kind = m.lastgroup if m.lastgroup in ("escape", "break", "soft") else next(k for k in ("escape", "query", "code", "embed", "wiki", "image", "link", "auto", "math", "strong", "strike", "high", "em", "break", "soft") if m[k])
        if kind == "escape":
            add(m[0][1])
        elif kind == "query":
            add(f"[dv: {m['q']}]", code=True, color="purple_background")
        elif kind == "code":
            add(re.sub(r"\A (.*\S.*) \Z", r"\1", m["c"]), code=True)
        elif kind == "embed":
            out.append(_embed(m["et"], m["ea"]))
        elif kind == "wiki":
            found = _wiki(m["wt"], m["wa"], resolve, style)
            if found:
                out.append({**found, **{k: v for k, v in outer.items() if v and found.get(k) in (None, False)}})
        elif kind == "image":
            add(m["ia"] or m["iu"], link=m["iu"])
        elif kind == "link":
            out += inline(m["lt"], resolve, style, **(outer | {"link": m["lu"]}))
        elif kind == "auto":
            add(m["au"], link=m["au"])
        elif kind == "math":
            out.append(run(m["m"], "equation"))
        elif kind == "strong":
            out += inline(m["st"], resolve, style, **(outer | {"bold": True}))
        elif kind == "strike":
            out += inline(m["kt"], resolve, style, **(outer | {"strike": True}))
        elif kind == "high":
            out += inline(m["ht"], resolve, style, **(outer | {"color": "yellow_background"}))
        elif kind == "em":
            out += inline(m["emt"], resolve, style, **(outer | {"italic": True}))
        else:
            add("\n" if kind == "break" else " ")
    if at < len(text):
        add(text[at:])
    merged: list[tuple[dict, list[str]]] = []
    for r in out:
        if merged and r["type"] == "text" and _STYLE(merged[-1][0]) == _STYLE(r):
            merged[-1][1].append(r["content"])
        else:
            merged.append((r, [r["content"]]))
    return [r | {"content": "".join(parts)} for r, parts in merged if any(parts)]


# blocks

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^\s`]*)[^`]*$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^( *)([-*+]|\d{1,9}[.)])(?:[ \t]+(.*)|)$")
_TASK = re.compile(r"^\[([ xX])\][ \t]+(.*)$", re.S)
_CALLOUT = re.compile(r"^\[!(\w+)\]([+-])?(.*)$")
_IMAGE = re.compile(r"^!\[([^\]]*)\]\((\S+?)(?:\s+\"[^\"]*\")?\)$")
_MATH = re.compile(r"^\s*\$\$\s*(.*?)\s*\$\$\s*$", re.S)
_SEPARATOR = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def split_code(code: str, size: int = SEGMENT) -> list[str]:
    """Stretches of at most ``size`` UTF-8 bytes, cut after the last line end in reach, never inside a character."""
    out = []
    data = code.encode()
    while len(data) > size:
        cut = data.rfind(b"\n", 0, size) + 1
        if cut <= 0:
            cut = size
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
        out.append(data[:cut].decode())
        data = data[cut:]
    return [*out, data.decode()]


def _cells(line: str) -> list[str]:
    inner = re.sub(r"^\||(?<!\\)\|$", "", line.strip())
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]


class _Parser:
    def __init__(self, resolve: Resolver | None, style: str, icons: dict[str, str], flatten: bool):
        self.resolve, self.style, self.icons, self.flatten = resolve, style, icons, flatten

    def runs(self, text: str) -> list[dict]:
        return inline(text, self.resolve, self.style)

    def blocks(self, lines: list[str]) -> list[Block]:
        out: list[Block] = []
        i = 0
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                i += 1
            elif m := _FENCE.match(line):
                i = self._fence(lines, i, m, out)
            elif _RULE.match(line):
                out.append(Block("divider"))
                i += 1
            elif m := _HEADING.match(line):
                level = min(len(m[1]), 3)
                out.append(Block(f"heading_{level}", self.runs(m[2] or "")))
                i += 1
            elif line.lstrip().startswith(">") and len(line) - len(line.lstrip()) < 4:
                i = self._quote(lines, i, out)
            elif _ITEM.match(line):
                i = self._list(lines, i, out)
            elif "|" in line and i + 1 < len(lines) and _SEPARATOR.match(lines[i + 1]) and len(_cells(lines[i + 1])) == len(_cells(line)):
                i = self._table(lines, i, out)
            else:
                i = self._paragraph(lines, i, out)
        return out

    def _fence(self, lines: list[str], i: int, m: re.Match, out: list[Block]) -> int:
        close = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
        end = next((k for k in range(i + 1, len(lines)) if close.match(lines[k])), len(lines))
        code, lang = "\n".join(lines[i + 1 : end]), m[2]
        if lang in ("dataview", "dataviewjs"):
            kind = "JS query" if lang.endswith("js") else "Query"
            out.append(Block("callout", [run(kind, bold=True), run("\nThis query runs in the note editor only:\n\n"), run(code, code=True)], {"icon": "📊"}))
        else:
            out.append(Block("code", [run(s) for s in split_code(code)], {"language": lang or PLAIN_LANGUAGE}))
        return end + 1

    def _quote(self, lines: list[str], i: int, out: list[Block]) -> int:
        inner = []
        while i < len(lines) and lines[i].strip() and (lines[i].lstrip().startswith(">") or not (_HEADING.match(lines[i]) or _FENCE.match(lines[i]) or _ITEM.match(lines[i]))):
            inner.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
            i += 1
        if m := _CALLOUT.match(inner[0]):
            title, body = m[3].strip(), self.blocks(inner[1:])
            runs = self.runs(title)
            runs = [r | {"bold": True} for r in runs]
            if body and body[0].type == "paragraph" and not body[0].children:
                first = body.pop(0).runs
                runs += ([run("\n")] if runs and first else []) + first
            out.append(Block("callout", runs, {"icon": self.icons.get(m[1].lower(), DEFAULT_ICON), "callout": m[1].lower()}, body))
            return i
        body = self.blocks(inner)
        first = body.pop(0).runs if body and body[0].type == "paragraph" else []
        out.append(Block("quote", first, {}, body))
        return i

    def _list(self, lines: list[str], i: int, out: list[Block]) -> int:
        indent = len(_ITEM.match(lines[i])[1])
        while i < len(lines):
            m = _ITEM.match(lines[i])
            if not m or len(m[1]) < indent or len(m[1]) > indent + 1:
                break
            content = len(m[1]) + len(m[2]) + 1
            body = [m[3] or ""]
            i += 1
            while i < len(lines):
                line = lines[i]
                lead = len(line) - len(line.lstrip(" \t").replace("\t", "    "))
                lead = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
                if not line.strip():
                    after = next((x for x in lines[i + 1 :] if x.strip()), "")
                    if len(after) - len(after.lstrip()) < min(content, indent + 2):
                        break
                    body.append("")
                elif lead >= min(content, indent + 2):
                    body.append(line.expandtabs(4)[min(content, lead) :])
                elif _ITEM.match(line) or _HEADING.match(line) or _FENCE.match(line) or _RULE.match(line) or line.startswith(">"):
                    break
                else:
                    body.append(line.strip())
                i += 1
            kind = "numbered_list_item" if m[2][0].isdigit() else "bulleted_list_item"
            attrs = {}
            if (task := _TASK.match(body[0])) and kind == "bulleted_list_item":
                kind, attrs, body[0] = "to_do", {"checked": str(task[1] in "xX").lower()}, task[2]
            inner = self.blocks(body)
            runs = inner.pop(0).runs if inner and inner[0].type == "paragraph" else []
            out.append(Block(kind, runs, attrs, inner))
            while i < len(lines) and not lines[i].strip() and i + 1 < len(lines) and _ITEM.match(lines[i + 1]) and len(_ITEM.match(lines[i + 1])[1]) == indent:
                i += 1
        return i

    def _table(self, lines: list[str], i: int, out: list[Block]) -> int:
        header = _cells(lines[i])
        rows = [header]
        i += 2
        while i < len(lines) and lines[i].strip() and "|" in lines[i]:
            cells = _cells(lines[i])[: len(header)]
            rows.append(cells + [""] * (len(header) - len(cells)))
            i += 1
        cells = lambda row: [Block("table_cell", self.runs(c)) for c in row]
        out.append(Block("table", [], {"width": str(len(header)), "has_header": "true"}, [Block("table_row", [], {}, cells(r)) for r in rows]))
        return i

    def _paragraph(self, lines: list[str], i: int, out: list[Block]) -> int:
        text = [lines[i].lstrip()]
        i += 1
        while i < len(lines) and lines[i].strip() and not (_FENCE.match(lines[i]) or _HEADING.match(lines[i]) or _RULE.match(lines[i]) or lines[i].startswith(">") or _ITEM.match(lines[i])):
            text.append(lines[i].lstrip())
            i += 1
        whole = "\n".join(text).rstrip()
        if m := _MATH.match(whole):
            out.append(Block("equation", [], {"expression": m[1]}))
        elif m := _IMAGE.match(whole):
            out.append(self._image(m[1], m[2]))
        else:
            out.append(Block("paragraph", self.runs(whole)))
        return i

    @staticmethod
    def _image(alt: str, url: str) -> Block:
        if is_local(url):
            shown = f"{alt} ({url})" if alt else url
            return Block("callout", [run("Local Image", bold=True), run("\nThis file is only on the note's own machine.\n"), run(shown, code=True)], {"icon": "🖼️", "color": "gray_background"})
        return Block("image", [run(alt)] if alt else [], {"url": url})


def is_local(url: str) -> bool:
    if url.startswith("data:"):
        return False
    return url.startswith("file://") or "://" not in url


def parse(body: str, resolve: Resolver | None = None, style: str = "placeholder", icons: dict[str, str] | None = None, flatten: bool = True) -> list[Block]:
    return _Parser(resolve, style, icons or CALLOUT_ICONS, flatten).blocks(body.replace("\r\n", "\n").replace("\r", "\n").split("\n"))


def flat(blocks: list[Block], path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], Block]]:
    """(ordinals from the root, block) in document order."""
    for i, b in enumerate(blocks):
        yield (*path, i), b
        yield from flat(b.children, (*path, i))


def nest(rows: list[tuple[list[int], Block]]) -> list[Block]:
    """The tree of flat rows in document order."""
    roots: list[Block] = []
    at: dict[tuple[int, ...], Block] = {}
    for path, b in rows:
        b.children = []
        at[tuple(path)] = b
        parent = at.get(tuple(path[:-1]))
        (parent.children if parent else roots).append(b)
    return roots


# back to markdown

_STYLES = (("code", "`", "`"), ("strike", "~~", "~~"), ("underline", "<u>", "</u>"), ("italic", "*", "*"), ("bold", "**", "**"))


def runs_markdown(runs: list[dict], paths: dict[str, str] | None = None) -> str:
    out = []
    for r in runs:
        text = r["content"]
        if r["type"] == "equation":
            out.append(f"${text}$")
        elif r["type"] == "mention":
            out.append(f"[[{(paths or {}).get(r['page_id'] or '', text)}]]")
        elif r["type"] == "user":
            out.append(f"@{text}")
        elif r["type"] == "date":
            out.append(text)
        else:
            if r["color"] == "yellow_background":
                text = f"=={text}=="
            for name, before, after in _STYLES:
                if r[name]:
                    text = before + text + after
            out.append(f"[{text}]({r['link']})" if r["link"] else text)
    return "".join(out)


def callout_type(icon: str, icons: dict[str, str] | None = None) -> str:
    """Of the types with an icon the first by name, ``note`` before all; unknown icons are notes."""
    names = sorted((k for k, v in (icons or CALLOUT_ICONS).items() if v == icon), key=lambda k: (k != "note", k))
    return names[0] if names else "note"


def render(blocks: list[Block], paths: dict[str, str] | None = None, icons: dict[str, str] | None = None, depth: int = 0) -> str:
    return "".join(_render(b, paths, icons, depth) for b in blocks)


def _quoted(indent: str, text: str) -> str:
    return "".join(f"{indent}> {line}\n" for line in text.removesuffix("\n").split("\n")) if text else ""


def _render(b: Block, paths: dict[str, str] | None, icons: dict[str, str] | None, depth: int) -> str:
    indent, text, attrs = "  " * depth, runs_markdown(b.runs, paths), b.attrs
    below = lambda d: render(b.children, paths, icons, d)
    url = attrs.get("url", "")
    match b.type:
        case "heading_1" | "heading_2" | "heading_3":
            return "#" * int(b.type[-1]) + f" {text}\n\n"
        case "paragraph":
            return f"{indent}{text}\n\n{below(depth + 1)}" if text else "\n"
        case "bulleted_list_item" | "toggle":
            return f"{indent}- {text}\n{below(depth + 1)}"
        case "numbered_list_item":
            return f"{indent}1. {text}\n{below(depth + 1)}"
        case "to_do":
            return f"{indent}- [{'x' if attrs.get('checked') == 'true' else ' '}] {text}\n{below(depth + 1)}"
        case "quote":
            return "".join(f"{indent}> {line}\n" for line in text.split("\n")) + _quoted(indent, below(depth)) + "\n"
        case "callout":
            lines = "".join(f"{indent}> {line}\n" for line in text.split("\n") if line)
            return f"{indent}> [!{callout_type(attrs.get('icon', ''), icons)}]\n{lines}{_quoted(indent, below(depth))}\n"
        case "code":
            lang = attrs.get("language", "")
            return f"{indent}```{'' if lang == PLAIN_LANGUAGE else lang}\n{''.join(r['content'] for r in b.runs)}\n```\n\n"
        case "divider":
            return f"{indent}---\n\n"
        case "equation":
            return f"{indent}$$\n{attrs.get('expression', '')}\n$$\n\n"
        case "image":
            return f"{indent}![{text}]({url})\n\n"
        case "table":
            return _table_markdown(b, paths, indent)
        case "table_row" | "table_cell":
            return ""
        case "bookmark":
            return f"{indent}[{text}]({url})\n\n" if text else f"{indent}<{url}>\n\n"
        case "embed":
            return f"{indent}<{url}>\n\n"
        case "video":
            return f"{indent}![video]({url})\n\n"
        case "file":
            return f"{indent}[{text or 'file'}]({url})\n\n"
        case "pdf":
            return f"{indent}[PDF]({url})\n\n"
    return f"{indent}<!-- Unsupported block type: {b.type} -->\n\n"


def _table_markdown(b: Block, paths: dict[str, str] | None, indent: str) -> str:
    if not b.children:
        return ""
    out = []
    for i, row in enumerate(b.children):
        cells = [runs_markdown(c.runs, paths).replace("|", "\\|") for c in row.children]
        out.append(indent + "|" + "".join(f" {c} |" for c in cells) + "\n")
        if i == 0 and b.attrs.get("has_header") == "true":
            out.append(indent + "|" + " --- |" * len(cells) + "\n")
    return "".join(out) + "\n"
