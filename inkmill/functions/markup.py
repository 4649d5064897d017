"""Table functions over HTML, YAML and manual sources, where order and nesting matter."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class _Events(HTMLParser):
    """The blocks of a page in order: (kind, text, centred)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, bool]] = []
        self.open: list[tuple[str, bool, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "pre", *HEADINGS):
            centred = any(k in ("align", "style", "class") and v and "center" in v for k, v in attrs)
            self.open.append((tag, centred, []))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while self.open:
                t, centred, parts = self.open.pop()
                self.events.append((t, "".join(parts), centred))
                if t == tag:
                    break

    def handle_data(self, data):
        if self.open:
            self.open[-1][2].append(data)
        elif data.strip():
            self.events.append(("text", data, False))


def page_blocks(html: str) -> list[dict]:
    """X-12, X-13, X-15: for each ``pre`` block its code, the paragraphs since the last block or heading, the nearest heading before it
    and the last centred paragraph (else "Untitled")."""
    reader = _Events()
    reader.feed(html or "")
    reader.close()
    out, about, heading, title = [], [], "", "Untitled"
    for kind, text, centred in reader.events:
        if kind == "pre":
            if text.strip():
                out.append({"code": text.strip(), "description": " ".join(" ".join(about).split()), "heading": heading, "title": title})
            about = []
        elif kind in HEADINGS:
            heading, about = " ".join(text.split()), []
        elif text.strip():
            about.append(text)
            if centred:
                title = " ".join(text.split())
    return out


_EXAMPLE = re.compile(r"([^\n]*?)\\begin\{codeexample\}(?:\[((?:[^\[\]{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\])?(.*?)\\end\{codeexample\}", re.S)
_SECTION = re.compile(r"\\(?:subsubsection|subsection|section)\*?\{(.*?)\}")
_OPTION = re.compile(r"\s*([A-Za-z ]+?)\s*(?:=\s*(\{(?:[^{}]|\{[^{}]*\})*\}|[^,{}]*))?\s*(?:,|\Z)")


def code_examples(text: str, longest: int = 500) -> list[dict]:
    """X-18, W-05, T-23, F-23: the examples of a manual with their options, the last section before each since the example
    before, and the text below that section, cut to ``longest`` characters. Commented-out blocks are uncommented."""
    out, last = [], 0
    for m in _EXAMPLE.finditer(text or ""):
        lead, options, code = m[1], m[2] or "", m[3]
        if lead.lstrip().startswith("%"):
            code = "\n".join(re.sub(r"^\s*%", "", line) for line in code.split("\n"))
        elif lead:
            code = "\n".join(line.removeprefix(lead) for line in code.split("\n"))
        given = {k.strip(): (v or "").strip() for k, v in _OPTION.findall(options) if k.strip()}
        inner = lambda k: given[k].removeprefix("{").removesuffix("}").strip() if k in given else None
        before = text[last : m.start()]
        sections = list(_SECTION.finditer(before))
        about = " ".join(before[sections[-1].end() :].split())[:longest] if sections else ""
        out.append({"code": code.strip(), "hidden": "hidden" in given, "code_only": "code only" in given, "pre": inner("pre"), "post": inner("post"), "preamble": inner("preamble"), "render_instead": inner("render instead"), "section": sections[-1][1].strip() if sections else "", "description": about})
        last = m.end()
    return out


def yaml_fields(text: str) -> dict:
    """X-20: title and description of a YAML side-car; nulls if it cannot be read."""
    import yaml

    try:
        found = yaml.safe_load(text or "")
    except yaml.YAMLError:
        found = None
    found = found if isinstance(found, dict) else {}
    return {k: None if found.get(k) is None else str(found[k]) for k in ("title", "description")}


def html_blocks(x: Column | str) -> Column:
    return F.udf(page_blocks, "array<struct<code:string,description:string,heading:string,title:string>>", useArrow=True)(x)


def manual_examples(x: Column | str) -> Column:
    return F.udf(code_examples, "array<struct<code:string,hidden:boolean,code_only:boolean,pre:string,post:string,preamble:string,render_instead:string,section:string,description:string>>", useArrow=True)(x)


def yaml_columns(x: Column | str) -> Column:
    return F.udf(yaml_fields, "struct<title:string,description:string>", useArrow=True)(x)
