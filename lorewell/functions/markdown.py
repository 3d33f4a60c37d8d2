"""Text of pages and uploads as Markdown; small parsers that run inside tasks."""

from __future__ import annotations

import csv
import io
import json
import re
from html.parser import HTMLParser

# Elements that carry no text of the page, and those that stand on lines of their own.
DROPPED = ["script", "style", "noscript", "svg", "iframe", "template", "head"]
BLOCKS = ["p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "figure"]
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*"}


def cell(value: str) -> str:
    return re.sub(r"\r\n|\n|\r", " ", value.replace("|", "\\|")).strip()


def table(rows: list[list[str]]) -> str:
    """Rows of any widths as one padded pipe table; the first row is its head."""
    width = max(map(len, rows), default=0)
    line = lambda cells: "| " + " | ".join(cells) + " |"
    full = [[cell(v) for v in r] + [""] * (width - len(r)) for r in rows]
    return "\n".join([line(full[0]), line(["---"] * width), *map(line, full[1:])]) if width else ""


def clean(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n)", "", text)).strip()


class _Page(HTMLParser):
    """Writes into the innermost of a stack of open texts: quotes, links and cells are finished when they close."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, list[str]]] = [("", "", [])]
        self.dropped, self.fenced, self.lists, self.rows = 0, 0, [], []

    def put(self, text: str) -> None:
        self.open[-1][2].append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.dropped += 1
        if self.dropped:
            return
        if re.fullmatch("h[1-6]", tag):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in BLOCKS:
            self.put("\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.put("" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            here = self.lists[-1] if self.lists else ["ul", 0]
            here[1] += 1
            self.put("\n" + "  " * max(len(self.lists) - 1, 0) + ("- " if here[0] == "ul" else f"{here[1]}. "))
        elif tag in ("blockquote", "a", "td", "th"):
            self.open.append((tag, dict(attrs).get("href") or "", []))
        elif tag == "table":
            self.rows.append([])
        elif tag == "tr" and self.rows:
            self.rows[-1].append([])
        elif tag == "pre":
            self.fenced += 1
            self.put("\n\n```\n")
        elif tag in MARKS:
            self.put(MARKS[tag])
        elif tag == "code" and not self.fenced:
            self.put("`")
        elif tag == "br":
            self.put("\n")
        elif tag == "hr":
            self.put("\n\n---\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
            return
        if self.dropped:
            return
        if tag in ("blockquote", "a", "td", "th"):
            if any(name == tag for name, _, _ in self.open):
                while self.close() != tag:
                    pass
        elif re.fullmatch("h[1-6]", tag) or tag in BLOCKS:
            self.put("\n\n")
        elif tag in ("ul", "ol"):
            self.lists = self.lists[:-1]
            self.put("" if self.lists else "\n\n")
        elif tag == "table" and self.rows:
            self.put("\n\n" + table([r for r in self.rows.pop() if r] or [[]]) + "\n\n")
        elif tag == "pre":
            self.fenced = max(0, self.fenced - 1)
            self.put("\n```\n\n")
        elif tag in MARKS:
            self.put(MARKS[tag])
        elif tag == "code" and not self.fenced:
            self.put("`")

    def close(self) -> str:
        """Ends the innermost open text and hands it to the one around it."""
        name, href, parts = self.open.pop()
        text = "".join(parts)
        if name == "blockquote":
            self.put("\n\n" + "\n".join("> " + x for x in clean(text).split("\n")) + "\n\n")
        elif name == "a":
            real = href and not href.startswith("#") and not href.lower().startswith("javascript:")
            self.put(f"[{text.strip()}]({href})" if real and text.strip() else text)
        elif self.rows and self.rows[-1]:
            self.rows[-1][-1].append(text)
        else:
            self.put(text)
        return name

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        if not self.fenced:
            data = re.sub(r"\s+", " ", data)
            before = next((x for x in reversed(self.open[-1][2]) if x), "\n")
            data = data.lstrip() if before.endswith("\n") else data
        self.put(data)


def html_to_markdown(html: str | None) -> str:
    page = _Page()
    page.feed(html or "")
    while len(page.open) > 1:
        page.close()
    return clean("".join(page.open[0][2]))


def json_pretty(text: str) -> str:
    return json.dumps(json.loads(text), indent=2, sort_keys=True, ensure_ascii=False)


def csv_to_markdown(text: str) -> str:
    return table(list(csv.reader(io.StringIO(text, newline=""), skipinitialspace=True)) or [[]])
