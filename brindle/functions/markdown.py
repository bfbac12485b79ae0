"""Markdown as plain chat text: headings, lists, quotes, rules, code, tables, links, emphasis."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of the output, and caps on tables and text.
HEADING, RULE, QUOTE, BULLETS, TASKS = ("【", "】"), "━" * 20, "  ‖ ", ("• ", "◦ ", "▪ "), ("✖ ", "✔ ")
CODE, MAX_COLUMNS, MAX_ROWS, MAX_LINES = ("⦗", "⦘"), 32, 200, 4000


def _alphabet(upper: int, lower: int, digit: int | None) -> dict[int, int]:
    out = {ord("A") + i: upper + i for i in range(26)} | {ord("a") + i: lower + i for i in range(26)}
    return out | ({ord("0") + i: digit + i for i in range(10)} if digit else {})


BOLD, ITALIC = _alphabet(0x1D5D4, 0x1D5EE, 0x1D7EC), _alphabet(0x1D608, 0x1D622, None)
_SUP, _SUB = str.maketrans("0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ"), str.maketrans("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎")


def _inline(text: str) -> str:
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    text = re.sub(r"(`+)(.+?)(?<!`)\1(?!`)", lambda m: keep(CODE[0] + m[2].strip() + CODE[1]), text)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m[1]), text)
    text = re.sub(r"!?\[([^\]]*)\]\(\s*<?([^)\s>]+)>?(?:\s+\"[^\"]*\")?\s*\)", lambda m: keep(f"{m[1]}( {m[2]} )" if m[1] and m[1] != m[2] else m[2]), text)
    text = re.sub(r"https?://[^\s<>]+", lambda m: keep(m[0]), text)
    text = re.sub(r"(?i)<br\s*/?>", "\n", re.sub(r"(?s)<!--.*?-->", "", text))
    text = re.sub(r"(?i)<sup>(.*?)</sup>", lambda m: m[1].translate(_SUP), re.sub(r"(?i)<sub>(.*?)</sub>", lambda m: m[1].translate(_SUB), text))
    text = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", lambda m: m[2].translate(BOLD), text)
    text = re.sub(r"(?<![\w*])\*(?=\S)([^*]+?)(?<=\S)\*(?!\*)|(?<!\w)_(?=\S)([^_]+?)(?<=\S)_(?!\w)", lambda m: (m[1] or m[2]).translate(ITALIC), text)
    text = re.sub(r"(~~?)(?=\S)([^~]+?)(?<=\S)\1", lambda m: "".join(c + "\u0336" for c in m[2]), text)
    text = html.unescape(text)
    for _ in range(3):
        text = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)
    return text


def _cells(line: str) -> list[str]:
    return [c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))][:MAX_COLUMNS]


def render(text: str | None) -> str | None:
    """The text as chat shows it; null stays null."""
    if text is None:
        return None
    out: list[str] = []
    lines, i = text.replace("\r\n", "\n").split("\n")[:MAX_LINES], 0
    while i < len(lines):
        line, bare = lines[i], lines[i].strip()
        if (m := re.match(r"(`{3,}|~{3,})\s*(\S*)", bare)) and (m[1][0] == "~" or "`" not in bare[len(m[1]) :]):
            body, i = [], i + 1
            while i < len(lines) and not re.fullmatch(re.escape(m[1][0]) + "{" + str(len(m[1])) + ",}", lines[i].strip()):
                body.append(lines[i])
                i += 1
            out += ["┌" + "─" * 3 + (f" {m[2]}" if m[2] else ""), *[f"│ {x}" for x in body], "└" + "─" * 3]
        elif "|" in line and i + 1 < len(lines) and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*", lines[i + 1]):
            head, i, n = _cells(line), i + 2, 0
            while i < len(lines) and "|" in lines[i]:
                if n < MAX_ROWS:
                    out += [f"{BULLETS[0] if k == 0 else '  '}{_inline(h)}: {_inline(c)}" for k, (h, c) in enumerate(zip(head, _cells(lines[i])))]
                i, n = i + 1, n + 1
            continue
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", bare):
            out.append(HEADING[0] + _inline(m[2]) + HEADING[1])
        elif re.fullmatch(r"(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,}", bare) and bare:
            out.append(RULE)
        elif bare.startswith(">"):
            out.append(QUOTE + _inline(bare.lstrip("> ")))
        elif m := re.match(r"(\s*)[-*+]\s+(?:\[([ xX])\]\s+)?(.*)", line):
            level = min(len(m[1].expandtabs(4)) // 2, 2)
            out.append("  " * level + (TASKS[m[2] in "xX"] if m[2] is not None else BULLETS[level]) + _inline(m[3]))
        else:
            out.append(_inline(line))
        i += 1
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n|$)", "", "\n".join(out))).strip("\n")


def escape(c: Column) -> Column:
    """Markdown's special characters with a backslash before each."""
    return F.regexp_replace(c, r"([\\`*_{}\[\]()#+\-.!|~>])", r"\\$1")


def rendered(c: Column) -> Column:
    """render as a column, in Arrow batches."""
    import pandas as pd

    def each(s):
        return s.map(render, na_action="ignore")

    each.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, "string")(c)


def code_ranges(text: str | None) -> list[tuple[int, int]]:
    """Start and end of fenced and inline code."""
    out = [(m.start(), m.end()) for m in re.finditer(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", text or "")]
    spans = [(m.start(), m.end()) for m in re.finditer(r"(`+)[^`].*?(?<!`)\1(?!`)", text or "")]
    return sorted(out + [s for s in spans if not any(a <= s[0] < b for a, b in out)])
