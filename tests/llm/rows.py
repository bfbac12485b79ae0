"""Small tables with all that operators must stand: nulls, blanks, long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random
import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n int, w string, size string, place string, key string, evidence string, score string, class string, dest int, part string"


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def texts(n: int = 60, seed: int = 3) -> list[str | None]:
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "to", "a", *("".join(r.choice("abcdefghijklmnoprstuv") for _ in range(r.randint(3, 12))) for _ in range(300)), "ÉTÉ", "naïve,", "日本語", "x" * 70]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    out: list[str | None] = ["\n".join(line(r.randint(3, 30)) for _ in range(r.randint(1, 12))) for _ in range(n)]
    base = line(80)
    near = base.split(" ")
    for k in range(6):  # near copies
        copy = list(near)
        copy[5 * k + 3] = f"changed{k}"
        out.append(" ".join(copy))
    out += [base, base, base.upper(), base + "\n" + base, None, None, "", " ", "\n\n", "one", "one two", "one two three four", "\t\ttabs\tand\rreturns\x0b\x0c", "nbsp inside　wide", "a" * 5000, line(6000)]
    return out


def rows(n: int = 60, seed: int = 3) -> list[tuple]:
    made = []
    for i, t in enumerate(texts(n, seed)):
        made.append((i * 3 % 101 if i < 40 else i + 200, t, [None, "en", "fr", "de"][i % 4], [None, "b", "a", "a", "a"][i % 5], None, 7, 1, "w", "s", "p", "k", "e", "x", "c", 0, "q"))
    made += made[3:6]  # repeated rows
    made.append((None, "a row without an id that has words", "en", "z", 1, *made[0][5:]))
    return made


def table(spark, n: int = 60, seed: int = 3, without_null_ids: bool = False):
    data = [r for r in rows(n, seed) if not (without_null_ids and r[0] is None)]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
