"""Markdown to HTML for previews: headings, paragraphs with line breaks, nested lists, tables, quotes, code, rules and inline marks."""

from __future__ import annotations

import re
from html import escape

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code spans, escapes and tags stand for themselves; what is between them gets the marks.
_WHOLE = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)|\\([!-/:-@\[-`{-~])|<((?:https?|mailto):[^\s<>]+)>|(</?[A-Za-z][^<>]*>|<!--.*?-->)")
INLINE = [
    (re.compile(r'!\[([^\]]*)\]\(([^)\s]+)(?: +"([^"]*)")?\)'), lambda m: f'<img src="{m[2]}" alt="{m[1]}"' + (f' title="{m[3]}">' if m[3] else ">")),
    (re.compile(r'\[([^\]]*)\]\(([^)\s]+)(?: +"([^"]*)")?\)'), lambda m: f'<a href="{m[2]}"' + (f' title="{m[3]}">' if m[3] else ">") + f"{m[1]}</a>"),
    (re.compile(r'(?<![\w"=>/])((?:https?://|www\.)[^\s<]*[^\s<?!.,:*_~)])'), lambda m: f'<a href="{"http://" if m[1].startswith("www") else ""}{m[1]}">{m[1]}</a>'),
    (re.compile(r"(?s)(?<!\*)\*\*\*(?![\s*])(.+?)(?<![\s*])\*\*\*(?!\*)"), r"<em><strong>\1</strong></em>"),
    (re.compile(r"(?s)(?<!\*)\*\*(?![\s*])(.+?)(?<![\s*])\*\*(?!\*)|(?<!\w)__(\S(?:.*?\S)?)__(?!\w)"), lambda m: f"<strong>{m[1] or m[2]}</strong>"),
    (re.compile(r"(?s)(?<!\*)\*(?![\s*])(.+?)(?<![\s*])\*(?!\*)|(?<!\w)_(\S(?:.*?\S)?)_(?!\w)"), lambda m: f"<em>{m[1] or m[2]}</em>"),
    (re.compile(r"(?s)(?<!~)~~?(?!~)(\S(?:.*?\S)?)(?<!~)~~?(?!~)"), r"<del>\1</del>"),
]


def _inline(text: str) -> str:
    kept: list[str] = []

    def aside(m: re.Match) -> str:
        if m[1]:
            kept.append(f"<code>{escape(m[2].strip() or m[2], quote=False)}</code>")
        elif m[3]:
            kept.append(escape(m[3], quote=False))
        elif m[4]:
            kept.append(f'<a href="{m[4]}">{escape(m[4], quote=False)}</a>')
        else:
            kept.append(m[5])
        return f"\0{len(kept) - 1}\0"

    text = escape(_WHOLE.sub(aside, text.replace("\0", "\ufffd")), quote=False)
    for pattern, tag in INLINE:
        text = pattern.sub(tag, text)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], text)


def _cells(line: str) -> list[str]:
    return [c.strip().replace(r"\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def to_html(markdown: str) -> str:
    out, lines, at = [], markdown.split("\n"), 0

    def while_(test) -> list[str]:
        nonlocal at
        start = at
        while at < len(lines) and test(lines[at]):
            at += 1
        return lines[start:at]

    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
        elif line.startswith("```"):
            at += 1
            code = while_(lambda x: not x.startswith("```"))
            at += 1
            out.append(f"<pre><code>{escape(chr(10).join(code), quote=False)}\n</code></pre>\n")
        elif re.fullmatch(r" {0,3}([-*_])( *\1){2,} *", line):
            at += 1
            out.append("<hr>\n")
        elif m := re.match(r"(#{1,6}) +(.*)", line):
            at += 1
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>\n")
        elif line.lstrip().startswith("|") and at + 1 < len(lines) and re.fullmatch(r"\s*\|(\s*:?-+:?\s*\|)+\s*", lines[at + 1]):
            head, _, *body = while_(lambda x: x.lstrip().startswith("|"))
            row = lambda cells, tag: "<tr>\n" + "".join(f"<{tag}>{_inline(c)}</{tag}>\n" for c in cells) + "</tr>\n"
            rows = "".join(row(_cells(r), "td") for r in body)
            out.append(f"<table>\n<thead>\n{row(_cells(head), 'th')}</thead>\n" + (f"<tbody>{rows}</tbody>" if rows else "") + "</table>\n")
        elif re.match(r"([-*+] |\d+[.)] )", line):
            ordered = line[0].isdigit()
            own = r"\d+[.)] " if ordered else r"[-*+] "
            items = while_(lambda x: re.match(own, x) or x[:2] == "  " and x.strip())
            parts: list[list[str]] = []  # lines of an item: its own text, then what is indented below it
            for x in items:
                if re.match(own, x):
                    parts.append([re.sub(own, "", x, count=1)])
                else:
                    parts[-1].append(re.sub(r"^ {1,4}", "", x))
            start = int(re.match(r"\d+", line)[0]) if ordered else 1
            below = lambda x: "\n" + to_html("\n".join(x)) if x else ""
            tag = "ol" if ordered else "ul"
            first = f' start="{start}"' if start != 1 else ""
            out.append(f"<{tag}{first}>\n" + "".join(f"<li>{_inline(x[0])}{below(x[1:])}</li>\n" for x in parts) + f"</{tag}>\n")
        elif line.startswith(">"):
            text = _inline("\n".join(x.lstrip("> ") for x in while_(lambda x: x.strip()))).replace("\n", "<br>")
            out.append(f"<blockquote>\n<p>{text}</p>\n</blockquote>\n")
        else:
            text = while_(lambda x: x.strip() and not re.match(r"#{1,6} |```|>|[-*+] |\d+[.)] ", x) or x is line)
            out.append(f"<p>{_inline(chr(10).join(text)).replace(chr(10), '<br>')}</p>\n")
    return "".join(out)


def markdown_to_html(markdown: Column) -> Column:
    from docloom.operators.convert import each_row

    return each_row(lambda m: None if m is None else to_html(m), "string")(markdown)
