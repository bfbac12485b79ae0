"""Line-first quality rules: lines that break a rule go, then documents that lost too much."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import blocks

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_BOILERPLATE = re.compile(
    r"all rights reserved|terms (?:of|and) (?:use|service|conditions)|privacy policy|cookie|click here|subscribe|sign (?:in|up)|log ?in\b|enable javascript|read more|share this|copyright|©"
    r"|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|impressum|hier klicken|jetzt anmelden|newsletter|weiterlesen"
    r"|todos los derechos reservados|términos de uso|política de privacidad|aviso legal|haga clic aquí|iniciar sesión|suscríbete|leer más"
    r"|tous droits réservés|conditions d.utilisation|politique de confidentialité|mentions légales|cliquez ici|se connecter|abonnez-vous|lire la suite",
    re.IGNORECASE,
)
_NAVIGATION = re.compile(r"(?:^|\s)(?:\||»|›|>|·|•|::)(?=\s|$)")
_SHOUT = re.compile(r"!{2,}|\?{3,}")


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the rules; shares are of a line's words unless said otherwise."""

    navigation: float = 0.2  # separators standing alone
    boilerplate_words: int = 25  # a boilerplate phrase condemns lines up to this long
    shouting: float = 0.25  # words ending in !! or ???
    symbols: float = 0.25  # of a line's characters
    lost: float = 0.5  # of a document's words that may go with its lines
    least_words: int = 50  # base rule: fewer fail
    repeated: float = 0.5  # base rule: more repeated words fail


def line_fault(line: str, words: int, rules: LineRules) -> str | None:
    """The rule that a line with words breaks, or None."""
    if "|" in line or "»" in line or "›" in line or ">" in line or "·" in line or "•" in line or "::" in line:
        marks = len(_NAVIGATION.findall(line))
        if marks >= 3 and marks >= rules.navigation * words:
            return "navigation"
    if words <= rules.boilerplate_words and _BOILERPLATE.search(line):
        return "boilerplate"
    if "!!" in line or "???" in line:
        loud = len(_SHOUT.findall(line))
        if loud >= 3 and loud >= rules.shouting * words:
            return "punctuation"
    odd = sum(map(line.count, _SYMBOLS))
    if odd >= 3 and odd >= rules.symbols * len(line):
        return "symbols"
    return None


def judge(text: str | None, rules: LineRules = LineRules()) -> dict:
    """The measures of one text, its verdict and what is left of it."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    grams = list(zip(words, words[1:], words[2:]))
    counts = Counter(grams)
    repeated = 0
    if len(counts) < len(grams):
        upto = -1  # the last word counted
        for i, g in enumerate(grams):
            if counts[g] > 1:
                repeated += i + 2 - max(upto, i - 1)
                upto = i + 2
    seen: set[str] = set()
    copies = lost = 0
    left = []
    lines = text.split("\n")
    for line in lines:
        if not line.strip(_SPACE):
            left.append(line)
            continue
        size = len(_WORD.findall(line)) if len(lines) > 1 else n
        if line in seen:
            copies += 1
            lost += size
        elif line_fault(line, size, rules):
            lost += size
        else:
            left.append(line)
        seen.add(line)
    failed = n < rules.least_words or repeated > rules.repeated * n
    return {
        "n_words": n, "word_chars": len(text) - sum(map(text.count, _SPACE)), "n_symbols": sum(map(text.count, _SYMBOLS)), "n_dup_lines": copies, "n_repeat_words": repeated,
        "base_failed": failed, "kept": not failed and lost <= rules.lost * n, "n_lost_words": lost, "clean_text": "\n".join(left),
    }


_FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "n_lost_words": "long", "clean_text": "string"}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row a document: doc_id, the measures, base_failed, kept, n_lost_words and clean_text (unless with_text is False).

    A text's lines are judged first: navigation bars, boilerplate phrases, shouting
    punctuation, symbol soup and copies of earlier lines go.  A document is kept if it
    passes the base rules and lost at most half of its words.  Null text has no words and
    so fails; an empty or white text likewise.  Repeated rows are judged each; other columns
    are left aside; an empty table gives an empty result.
    """
    fields = {k: v for k, v in _FIELDS.items() if with_text or k != "clean_text"}
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches):
        for batch in blocks(batches, "text"):
            found = [judge(t, rules) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in found], kinds[v]) for k, v in fields.items()]], names=["doc_id", *fields])

    return wanted.mapInArrow(run, f"doc_id {wanted.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in fields.items()))
