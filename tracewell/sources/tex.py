"""TeX files as prose rows, with places that still count the source's lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pysource import decoded

MATH = " [MATH] "
#: Commands that go with their argument, commands whose braces are counted, commands whose argument stays, and plus-minus signs by themselves.
REFERENCES = ("cite", "citet", "citep", "ref", "autoref", "label", "url", "texttt", "codepath", "mask", "mainref")
HEADINGS = ("section", "paragraph", "caption")
KEPT = ("emph", "textbf", "textit")
BARE_PM = r"(?<!\\!)\\pm(?![{!}])"
#: The kinds of tokens, the first that fits. A stretch without any of their first characters is plain.
TOKEN = re.compile(
    r"(?P<comment>(?<!\\)%[^\n]*)|(?P<begin>\\begin\{(?P<name>\*?[a-zA-Z]+\*?)\})|(?P<finish>\\end\{document\})|(?P<math>\\[(\[]|(?<!\\)\$\$?)"
    r"|(?P<command>\\(?P<word>[a-zA-Z@]+)\*?)|(?P<space>\\[.,;:!?]|[{}~^&_=#])|(?P<dashes>-{2,})|(?P<plain>[^\\%${}~^&_=#-]+|.)",
    re.S,
)
CLOSES = {"\\(": r"\\\)", "\\[": r"\\\]", "$$": r"(?<!\\)\$\$", "$": r"\$"}
#: An optional argument, and the start or the whole of one in braces.
_ARGUMENT = {opens: re.compile(rf"(?:\[[^\]]*\])?\{{{rest}") for opens, rest in (("start", ""), ("whole", r"[^}]*\}"))}


def _blank(text: str) -> str:
    """The newlines of a text, so that places count on."""
    return " " + "\n" * text.count("\n")


def _after(text: str, close: str, at: int) -> int:
    """Where the next close from a place on ends, comments apart; -1 if there is none."""
    for m in re.compile(rf"(?<!\\)%[^\n]*|(?P<close>{close})").finditer(text, at):
        if m["close"]:
            return m.end()
    return -1


def _group_end(text: str, at: int) -> int:
    """After the brace that closes the one at this place; the text's end if none does."""
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            return m.end()
    return len(text)


def _command(text: str, m: re.Match, dropped: set[int]) -> tuple[int, str]:
    """Where a command ends with what goes with it, and what stands for it. dropped: braces that are read over."""
    word, end = m["word"], m.end()
    starred = m[0].endswith("*")
    if word in REFERENCES and not starred and (found := _ARGUMENT["whole"].match(text, end)):
        return found.end(), _blank(found[0])
    heading = word.replace("sub", "") if word.endswith("section") else word
    if heading in HEADINGS and (found := _ARGUMENT["start"].match(text, end)) and (found[0] == "{" or heading == "caption"):
        close = _group_end(text, found.end() - 1)
        return close, _blank(text[end:close])
    if word in KEPT and not starred and text[end : end + 1] == "{" and (close := text.find("}", end)) > 0:
        dropped.add(close)
        return end + 1, ""
    return end, " "


def _tokens(text: str, at: int) -> Iterator[str]:
    """What stands for each token: prose, blanks with the newlines of what is left out, or the mark of math."""
    dropped: set[int] = set()
    while at < len(text):
        m = TOKEN.match(text, at)
        kind, end, said = m.lastgroup, m.end(), " "
        if kind == "begin":
            close = _after(text, r"\\end\{" + re.escape(m["name"]) + r"\}", end)
            end, said = (close, _blank(text[at:close])) if close > 0 else (at + len("\\begin"), " ")
        elif kind == "math":
            close = _after(text, CLOSES[m[0]], end)
            if close < 0 and m[0] == "$$":  # two by themselves
                close = end
            if close > 0:
                end, said = close, _blank(text[at:close]) + MATH
            else:
                said = " " if m[0] == "$" else m[0]
        elif kind == "command":
            end, said = _command(text, m, dropped)
        elif kind == "dashes":
            said = " " if end - at == 2 else " EMDASH "
        elif kind == "plain" or at in dropped:
            said = m[0] if kind == "plain" else ""
        yield said
        at = end


def prose(source: str) -> tuple[str, int]:
    """The text without TeX, math as a mark, and the newlines of the source before it. Three hyphens become a word, two a space."""
    start = source.find("\\begin{document}")
    start = 0 if start < 0 else start + len("\\begin{document}")
    text = re.sub(r"[ \t]+", " ", "".join(_tokens(source, start)))
    body = text.lstrip()
    return body.rstrip(), source.count("\n", 0, start) + text.count("\n", 0, len(text) - len(body))


def documents(files: DataFrame) -> DataFrame:
    """(path, source, marked, text, lines_before): marked keeps the marks of math, text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sources = [decoded(c) for c in b["content"]]
            made = [prose(s) for s in sources]
            yield pd.DataFrame({"path": b["path"], "source": sources, "marked": [p for p, _ in made], "text": [p.replace(MATH, " ") for p, _ in made], "lines_before": [n for _, n in made]})

    return files.select("path", "content").mapInPandas(run, "path string, source string, marked string, text string, lines_before int")


def bare_pm(docs: DataFrame) -> DataFrame:
    """(path, line) of plus-minus signs that are neither in braces nor in the tight form, in the source."""
    lines = docs.select("path", F.posexplode(F.split("source", "\n")).alias("i", "line_text"))
    return lines.select("path", (F.col("i") + 1).alias("line"), F.explode(F.regexp_extract_all("line_text", F.lit(BARE_PM), F.lit(0)))).select("path", "line")
