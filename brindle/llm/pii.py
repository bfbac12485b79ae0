"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

All of it is one projection of SQL expressions, without a shuffle or Python: generators
find overlapping spans in each text, each span's features go through the trees, written as
CASE expressions, and spans above their kind's threshold join those of the base patterns,
which always stay.  The trees are trained on the driver, on labelled spans of texts made
from templates; the features of these are computed by the same expressions.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the generators: those of the base patterns, and assigned secrets, which have none.
ALL = (*KINDS, "secret")
#: The base patterns, in forms that don't backtrack over long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=[0-9 -]{12})[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators of more candidates.
MORE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[a-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}+(?::?[0-9A-Fa-f]{1,4}){1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./-])(?=[0-9./ -]{14})[0-9]{3,4}(?:[./ -]{1,3}[0-9]{2,6}){2,4}+(?![0-9./-])|(?<![0-9])[0-9]{13,19}+(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
}
MORE["secret"] = r"(?i)(?<![a-z0-9])(?:[a-z0-9]{1,16}[_-]){0,2}+(?:api[_ -]?key|access[_ -]?key|auth[_ -]?key|token|secret|password|passwd|pwd|key)[\"']?[ ]{0,3}(?:[:=]|\bis\b)[ ]{0,3}[\"']?[A-Za-z0-9_+/=.-]{6,512}+"
#: Words before a span that speak for its kind.
CUES = {
    "secret": r"(?i)(?:auth|login|credential|export|set|const|env)\W{0,12}\w{0,6}\W{0,4}$",
    "email": r"(?i)(?:e-?mail|contact|write|mailto|address)\W{0,12}\w{0,6}\W{0,4}$",
    "ip": r"(?i)(?:\bip|host|server|address|from|ping)\W{0,12}\w{0,6}\W{0,4}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|payment)\W{0,12}\w{0,8}\W{0,4}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|dial|ring)\W{0,12}\w{0,6}\W{0,4}$",
}
ANTICUES = r"(?i)(?:order|invoice|version|serial|isbn|ref|ticket|part|model|item|sku|build|figure|page|account of|total|id)\W{0,12}\w{0,6}\W{0,4}$"
FEATURES = ("kind", "digits", "length", "seps", "luhn", "cue", "anticue", "parens", "lead", "tail", "first_digit", "groups", "at_word", "hex", "assigned", "longest", "mixed", "domain")
_BLOCK = 256
#: Share of held-out selected spans that must be right.
PRECISION = 0.98


def _array(kind: str) -> Column:
    return F.lit(None).cast(f"array<{kind}>")


def _running(df: DataFrame, name: str) -> DataFrame:
    """Replaces an array of lengths by the sums of those before each, in blocks so that long arrays stay cheap."""
    n = F.size(name)
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(F.col(name), b * _BLOCK + 1, F.lit(_BLOCK))))
    df = df.withColumn("_b", blocks)
    total = F.transform("_b", lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v))
    df = df.withColumn("_t", F.aggregate(total, F.array(F.lit(0).cast("long")), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))))
    inner = F.zip_with("_b", F.slice("_t", F.lit(1), F.size("_b")), lambda x, t: F.slice(F.aggregate(x, F.array(t), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))), F.lit(1), F.size(x)))
    return df.withColumn(name, F.coalesce(F.flatten(inner), _array("bigint"))).drop("_b", "_t")


def _spans(df: DataFrame, text: str, pattern: str, guard: Column, out: str) -> DataFrame:
    """Adds out: array of (start, end, match) of a pattern's matches, in code points; null where there is none."""
    df = df.withColumn("_m", F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn("_m", F.when(F.size("_m") > 0, F.col("_m"))).withColumn("_p", F.when(F.col("_m").isNotNull(), F.split(text, pattern, -1)))
    df = df.withColumn("_n", F.zip_with(F.slice("_p", F.lit(1), F.size("_m")), "_m", lambda a, b: (F.length(a) + F.length(b)).cast("long")))
    df = _running(df, "_n")
    pairs = F.zip_with("_m", F.zip_with("_n", F.slice("_p", F.lit(1), F.size("_m")), lambda n, p: n + F.length(p)), lambda m, s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))
    return df.withColumn(out, pairs).drop("_m", "_p", "_n")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)

    def add(a: Column, i: Column) -> Column:
        v = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, F.lit(2)).otherwise(F.lit(1))
        return a + v - F.when(v > 9, F.lit(9)).otherwise(F.lit(0))

    n = F.length(digits)
    return F.when((n >= 2) & (n <= 40), F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, m: Column) -> Column:
    """The base rule beyond the pattern."""
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|\z)){4}\z")
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _features(kind: str, s: Column, text: Column) -> dict[str, Column]:
    """Format and context of a candidate span as numbers, in the order of FEATURES."""
    m, start, end = s["match"], s["start"], s["end"]
    before = F.substring(text, F.greatest(start - 32, F.lit(0)).cast("int") + 1, F.least(start, F.lit(32)).cast("int"))
    after = F.substring(text, end.cast("int") + 1, F.lit(1))
    num = lambda c: c.cast("double")
    digits = _digits(m)
    return {
        "kind": F.lit(float(ALL.index(kind))), "digits": num(F.length(digits)), "length": num(F.length(m)), "seps": num(F.length(F.regexp_replace(m, "[0-9A-Za-z]", ""))), "luhn": num(luhn(digits)),
        "cue": num(before.rlike(CUES[kind])), "anticue": num(before.rlike(ANTICUES)), "parens": num(m.rlike(r"[()\[\]]")), "lead": num(before.rlike(r"[\p{L}0-9_]\z")), "tail": num(after.rlike(r"[\p{L}0-9_]")),
        "first_digit": F.coalesce(F.try_element_at(F.array(F.substring(digits, 1, 1)), F.lit(1)).try_cast("double"), F.lit(-1.0)), "groups": num(F.size(F.split(m, "[^0-9A-Za-z]+", -1))),
        "at_word": num(m.rlike(r"(?i) at | dot ")), "hex": num(m.rlike(r"(?i)[a-f]")),
        # of the match as it ends: an assignment sign, the length of its last run of letters and digits, and whether that has letters and digits both
        "assigned": num(m.rlike("[:=]")), "longest": num(F.length(F.regexp_extract(m, r"([0-9A-Za-z]*)[^0-9A-Za-z]*\z", 1))), "mixed": num(m.rlike(r"[A-Za-z][0-9A-Za-z]*[0-9][0-9A-Za-z]*[^0-9A-Za-z]*\z|[0-9][0-9A-Za-z]*[A-Za-z][0-9A-Za-z]*[^0-9A-Za-z]*\z")),
        "domain": num(m.rlike(r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)\z")),
    }


# ---- boosted trees


@dataclass
class Boosted:
    """Trees of depth two over FEATURES, Platt's calibration, and a threshold of each kind."""

    trees: list[tuple]  # (feature, cut, (feature, cut, low, high), (feature, cut, low, high))
    slope: float
    shift: float
    threshold: dict[str, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for f, c, low, high in self.trees:
            for side, (g, d, a, b) in ((x[:, f] <= c, low), (x[:, f] > c, high)):
                out[side] += np.where(x[side, g] <= d, a, b)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def column(self, v: dict[str, Column], kind: int) -> Column:
        """The calibrated probability of a span of a kind as an expression; splits by kind are decided here."""

        def side(f: int, cut: float, low, high):
            if f == FEATURES.index("kind"):
                return low if kind <= cut else high
            return F.when(v[FEATURES[f]] <= cut, low).otherwise(high)

        raw = reduce(lambda a, b: a + b, [side(f, c, F.lit(0) + side(*low), F.lit(0) + side(*high)) for f, c, low, high in self.trees], F.lit(0.0))
        return 1 / (1 + F.exp(-(raw * self.slope + self.shift)))


def _stump(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
    """The split with most gain: (gain, feature, cut, value below, value above)."""
    best = (0.0, 0, np.inf, -g.sum() / (h.sum() + 1), 0.0)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for c in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= c
            gl, hl = g[low].sum(), h[low].sum()
            gh, hh = g.sum() - gl, h.sum() - hl
            gain = gl * gl / (hl + 1) + gh * gh / (hh + 1) - whole
            if gain > best[0] + 1e-9:
                best = (gain, f, float(c), -gl / (hl + 1), -gh / (hh + 1))
    return best


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 48, rate: float = 0.3) -> Boosted:
    """Gradient boosting with logistic loss on two thirds of the rows; the rest calibrates."""
    held = np.arange(len(x)) % 3 == 0
    lx, ly = x[~held], y[~held]
    raw, trees = np.zeros(len(lx)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - ly, np.maximum(p * (1 - p), 1e-6)
        _, f, c, *_ = _stump(lx, g, h)
        sides = []
        for side in (lx[:, f] <= c, lx[:, f] > c):
            _, k, d, a, b = _stump(lx[side], g[side], h[side]) if side.any() else (0, 0, 0.0, 0.0, 0.0)
            d = float(min(d, 1e9))
            sides.append((int(k), d, float(rate * a), float(rate * b)))
            raw[side] += np.where(lx[side, k] <= d, rate * a, rate * b)
        trees.append((int(f), float(min(c, 1e9)), *sides))
    out = Boosted(trees, 1.0, 0.0, {})
    z, t = out.raw(x[held]), y[held]
    for _ in range(200):  # Platt: two parameters by gradient descent
        p = 1 / (1 + np.exp(-(out.slope * z + out.shift)))
        out.slope -= 0.1 * float(((p - t) * z).mean())
        out.shift -= 0.1 * float((p - t).mean())
    p = out.probability(x[held])
    for k, kind in enumerate(ALL):
        own = x[held][:, 0] == k
        out.threshold[kind] = _threshold(p[own], t[own])
    return out


def _threshold(p: np.ndarray, t: np.ndarray, precision: float = PRECISION) -> float:
    """The least probability from which the held-out spans above it reach the precision; one half at least, and more than any if none does."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(t[order]) / np.arange(1, len(p) + 1)
    last = np.ones(len(p), bool)
    last[:-1] = p[order][1:] != p[order][:-1]  # spans of one probability are selected together
    good = np.flatnonzero((right >= precision) & last)
    return float(max(0.5, p[order][good[-1]])) if len(good) else 1.1


_FILL = (
    "the report came back with notes on method and results for every site we saw while others said nothing of it der bericht kam mit vielen notizen zum verfahren und wir sahen nichts davon el informe trae notas sobre el proceso y otros no dijeron nada "
    "le rapport donne des notes sur la suite et les autres n ont rien dit de plus"
).split()


def _examples(n: int, seed: int = 5) -> list[tuple[str, str, int]]:
    """(text, kind, label) of texts that hold one span each, made from templates.

    Bad spans look like good ones and stand in the same places: ranges, dates, times,
    versions, sums that don't check, words assigned where a secret would be.
    """
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    coded = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    strong = lambda k: "".join(r.choice("0123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz") for _ in range(k))

    def passing(k: int) -> str:
        body = r.choice("3456") + digits(k - 2)
        total = sum(v if i % 2 else (2 * v - 9 * (v > 4)) for i, v in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def failing(k: int) -> str:
        d = passing(k)
        return d[:-1] + str((int(d[-1]) + r.randint(1, 9)) % 10)

    def grouped(d: str, sep: str, size: int = 4) -> str:
        return sep.join(d[i : i + size] for i in range(0, len(d), size))

    word = lambda: r.choice(_FILL)
    name = lambda: r.choice([f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}_{letters(4)}", f"{letters(1)}.{word()}"])
    at, dot = (lambda: r.choice([" (at) ", "[at]", " [at] ", "(at)", " at "])), (lambda: r.choice([" dot ", "[dot]", " [dot] ", "(dot)", "."]))
    secret_name = lambda: r.choice(["token", "api_key", "api-key", "API key", "secret", "password", "passwd", "access_key", "client_secret", "auth_token", "KEY", "pwd"])
    sign, quote = (lambda: r.choice([" = ", "=", ": ", ":", " : "])), (lambda: r.choice(['"', "'", ""]))

    def secret(value: str) -> str:
        return f"{secret_name()}{sign()}{quote()}{value}"

    good = {
        "email": lambda: f"{name()}{at()}{word()}{dot()}{r.choice(['com', 'org', 'net', 'edu', 'de', 'fr'])}",
        "ip": lambda: r.choice([":".join(f"{r.randrange(1 << 16):x}" for _ in range(8)), "2001:db8:" + ":".join(f"{r.randrange(1 << 16):x}" for _ in range(6)), f"fe80:0:0:0:{coded(4)}:{coded(4)}:{coded(4)}:{coded(4)}"]),
        "card": lambda: grouped(passing(16), r.choice([".", " - ", "/", ". "])),
        "phone": lambda: r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"00{digits(2)} {digits(3)} {digits(3)} {digits(4)}"]),
        "secret": lambda: secret(r.choice([coded(r.choice([32, 40, 64])), strong(r.randint(16, 48)), "sk_" + strong(24), "AKIA" + strong(16).upper(), f"{strong(12)}-{strong(12)}", strong(r.randint(9, 14)) + digits(2)])),
    }
    bad = {
        "email": lambda: r.choice([f"{word()} at {word()}. {word()}", f"{word()} at {word()} dot {word()}", f"{word()} at {word()}.{word()}"]),
        "ip": lambda: r.choice([f"{r.randrange(24)}:{r.randrange(60):02}:{r.randrange(60):02}:{r.randrange(100)}:{r.randrange(100)}", f"{r.randrange(99)}:{r.randrange(99)}:{r.randrange(99)}:{r.randrange(99)}", ":".join(coded(2) for _ in range(6))]),
        "card": lambda: r.choice([failing(16), failing(14), grouped(failing(16), r.choice([".", "/", " - "])), grouped(digits(12), "/"), f"{digits(4)}-{digits(2)}-{digits(2)} {digits(6)}"]),
        "phone": lambda: r.choice([f"{digits(4)} {digits(3)} {digits(4)}", f"{digits(3)}.{digits(4)}.{digits(3)}", f"{digits(2)} {digits(3)} {digits(3)}", f"{digits(4)}-{digits(4)}", f"{digits(4)} {digits(4)}"]),
        "secret": lambda: r.choice([f"{secret_name()}{sign()}{quote()}{word()}{letters(5)}", f"{secret_name()} is {word()}{letters(4)}", f"key{sign()}{letters(9)}.{letters(5)}", f"{secret_name()}{sign()}{letters(4)}_{letters(6)}", f"token: {digits(6)}"]),
    }
    cue = {"email": ["email", "contact", "write to", "e-mail"], "ip": ["IP", "host", "server", "address"], "card": ["card", "visa", "credit card"], "phone": ["phone", "call", "tel.", "mobile", "fax"], "secret": ["auth", "login", "export", "set"]}
    anti = ["order", "invoice", "version", "serial", "ref.", "item", "build", "id", "page", "total"]
    out = []
    for i in range(n):
        kind, label = ALL[i % len(ALL)], int(i // len(ALL) % 2 == 0)
        span = (good if label else bad)[kind]()
        lead = r.choice(cue[kind]) if r.random() < (0.7 if label else 0.15) else r.choice(anti) if r.random() < (0.03 if label else 0.5) else word()
        out.append((f"{' '.join(word() for _ in range(6))} {lead}{r.choice([' ', ': ', ' - ', ' '])}{span}{r.choice([' ', ', ', '. ', ') ', chr(34) + ' '])}{' '.join(word() for _ in range(5))}", kind, label))
    return out


_TRAINED: dict[int, Boosted] = {}


def train(spark: SparkSession, n: int = 2500) -> Boosted:
    """Trees trained on n labelled texts from templates; trained once a process."""
    if n not in _TRAINED:
        _TRAINED[n] = _train(spark, n)
    return _TRAINED[n]


def _train(spark: SparkSession, n: int) -> Boosted:
    made = spark.createDataFrame(_examples(n), "text string, want string, label int")
    xs, ys = [], []
    for kind in ALL:
        df = _spans(made.where(F.col("want") == kind).withColumn("_on", F.lit(True)), "text", MORE[kind], F.col("_on"), "s")
        v = F.transform("s", lambda s: F.array(*_features(kind, s, F.col("text")).values()))
        for r in df.select(v.alias("v"), "label").where("v IS NOT NULL").collect():
            for x in r["v"]:
                xs.append(x)
                ys.append(r["label"])
    order = np.random.default_rng(1).permutation(len(xs))
    return boost(np.array(xs)[order], np.array(ys, float)[order])


# ---- the operator


def find_pii(docs: DataFrame, model: Boosted | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row a document: doc_id, base (array of kind, start, end), more (likewise, with probability), then text if keep_text.

    base holds the leftmost non-overlapping matches of each kind's base pattern that pass its
    rule; more the candidates (of these kinds and secrets) that the trees and thresholds
    select and that meet no base span and no better candidate.  Offsets are in code points, end exclusive.  Null text is
    empty and has none.  Repeated rows are searched each; other columns are left aside; an
    empty table gives an empty result.
    """
    model = model or train(docs.sparkSession)
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("_digit", F.col("text").rlike("[0-9]")).withColumn("_hexes", F.col("text").rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"))
    df = df.withColumn("_ats", F.col("text").rlike(r"(?i)(?:\(at\)|\[at\]| at [a-z0-9-]+(?:\.| ?\(dot\)| ?\[dot\]| dot ))"))
    guards = {"email": F.contains("text", F.lit("@")), "ip": F.col("_digit") & F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("_digit") & F.col("text").rlike(r"[0-9][0-9 -]{10}"), "phone": F.col("_digit") & F.contains("text", F.lit("+"))}
    others = {"email": F.col("_ats"), "ip": F.col("_hexes"), "card": F.col("_digit") & F.col("text").rlike(r"[0-9][0-9./ -]{11}"), "phone": F.col("_digit") & F.col("text").rlike(r"[0-9][ .-][0-9]{3}"), "secret": F.col("text").rlike(r"(?i)(?:key|token|secret|passw|pwd)[\"']?[ ]{0,3}(?:[:=]|is )")}
    base_parts, more_parts = [], []
    for k, kind in enumerate(ALL):
        if kind in BASE:
            df = _spans(df, "text", BASE[kind], guards[kind], f"_base_{kind}")
            good = F.filter(f"_base_{kind}", lambda s: _valid(kind, s["match"]))
            base_parts.append(F.coalesce(F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"))), F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")))
        df = _spans(df, "text", MORE[kind], others[kind], f"_more_{kind}")
        df = df.withColumn(f"_more_{kind}", F.transform(f"_more_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(*_features(kind, s, F.col("text")).values()).alias("v"))))
        scored = F.transform(f"_more_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), model.column({n: s["v"][j] for j, n in enumerate(FEATURES)}, k).alias("p")))
        more_parts.append(F.coalesce(F.filter(scored, lambda s: s["p"] >= model.threshold[kind]), F.array().cast("array<struct<start:bigint,k:int,end:bigint,p:double>>")))
    df = df.withColumn("_base", F.array_sort(F.concat(*base_parts))).withColumn("_more", F.array_sort(F.concat(*more_parts)))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = F.filter("_more", lambda m: ~F.exists("_base", lambda b: meets(m, b)))
    df = df.withColumn("_more", F.when(F.size("_more") > 0, free).otherwise(F.col("_more")))
    best = F.filter("_more", lambda m: ~F.exists("_more", lambda o: meets(m, o) & ((o["p"] > m["p"]) | ((o["p"] == m["p"]) & ((o["start"] < m["start"]) | ((o["start"] == m["start"]) & (o["k"] < m["k"])))))))
    df = df.withColumn("_more", F.when(F.size("_more") > 1, best).otherwise(F.col("_more")))
    return df.select("doc_id", F.col("_base").alias("base"), F.col("_more").alias("more"), *(["text"] if keep_text else []))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, model: Boosted | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_redacted): each text with its spans replaced by [KIND]."""
    found = find_pii(docs, model, id_col, text_col, keep_text=True)
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    spans = found.withColumn("s", F.array_sort(F.concat(plain("base"), plain("more"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL])

    def step(a: Column, s: Column) -> Column:
        # a span inside what is already replaced adds nothing
        fresh = s["start"] >= a["upto"]
        text = F.concat(a["text"], F.substring(F.col("text"), a["upto"].cast("int") + 1, F.greatest(s["start"] - a["upto"], F.lit(0)).cast("int")), F.when(fresh, F.element_at(names, s["k"] + 1)).otherwise(F.lit("")))
        return F.struct(text.alias("text"), F.greatest(a["upto"], s["end"]).alias("upto"))

    done = F.aggregate("s", F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("upto")), step, lambda a: F.concat(a["text"], F.substring(F.col("text"), a["upto"].cast("int") + 1, F.length("text"))))
    return spans.select("doc_id", done.alias("text"), F.size("s").alias("n_redacted"))
