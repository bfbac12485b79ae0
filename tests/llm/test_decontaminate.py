import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import decontaminate as dc
from brindle.llm import words

from .rows import LOWER, empty, table

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens_of(text):
    return W.findall((text or "").translate(LOWER))


def brute(text, items, window=13):
    w = tokens_of(text)
    hit, found = set(), set()
    for name, item in items:
        v = tokens_of(item)
        for k in range(max(1, len(v) - window + 1) if v else 0):
            s = v[k : k + window]
            for a in range(len(w) - len(s) + 1):
                if w[a : a + len(s)] == s:
                    hit |= set(range(a, a + len(s)))
                    found.add("" if name is None else str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def brute_near(text, items):
    """Names of items of which four fifths of the distinct words stand within a span of their length and a quarter."""
    w, found = tokens_of(text), set()
    for name, item in items:
        v = tokens_of(item)
        own, span = set(v), len(v) + len(v) // 4
        need = -(-4 * len(own) // 5)
        if len(own) >= dc.LEAST_TERMS and any(len(own & set(w[a : a + span])) >= need for a in range(max(1, len(w) - span + 1))):
            found.add("" if name is None else str(name))
    return sorted(found)


def items_for(rows):
    r = random.Random(4)
    long = [t for _, t in rows if t and len(tokens_of(t)) > 40]
    pieces = []
    for i in range(12):
        w = tokens_of(r.choice(long))
        a = r.randrange(len(w) - 20)
        pieces.append((i % 10, " ".join(w[a : a + r.choice([3, 13, 14, 20])])))
    return [*pieces, (None, pieces[0][1]), (77, None), (78, "..."), (79, "one"), (80, "the the the the"), (81, "of"), pieces[2]]


def test_against_plain_search(spark):
    df = table(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    items = items_for(rows)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, item int")
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append((*brute(t, items), brute_near(t, items)))
    for settings in ({}, {"block_bytes": 400, "shard_bytes": 20_000}):
        got = dc.decontaminate(df, bench, **settings).collect()
        assert len(got) == len(rows)
        assert all((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"], r["near"]) in want[r["doc_id"]] for r in got)
        assert any(r["contaminated"] for r in got) and not all(r["contaminated"] for r in got) and any(r["n_near"] for r in got)
        assert all(r["n_items"] == len(r["items"]) and r["n_near"] == len(r["near"]) for r in got)
        assert sorted(str(r["text_hash"]) for r in got) == sorted(str(r[0]) for r in df.select(F.xxhash64("text")).collect())


def test_changed_passages(spark):
    """A word changed, put in or left out in each window: no exact hit, but near; scattered words aren't."""
    r = random.Random(8)
    vocabulary = ["of", "the", "and", *("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(400))]
    item = [r.choice(vocabulary) for _ in range(30)]
    other = [r.choice(vocabulary) for _ in range(300)]
    changed = [w if k % 9 != 4 else "zz" for k, w in enumerate(item)]
    longer = [x for k, w in enumerate(item) for x in ([w, "zz"] if k % 10 == 4 else [w])]
    texts = [" ".join([*other[:100], *x, *other[100:]]) for x in (item, changed, longer, item[::-1], item[:18], [y for w in item for y in (w, "zz", "zy")])] + [" ".join(other), None, "", " ".join(changed), " ".join(changed[:15]) + " " + " ".join(changed[15:])]
    items = [(5, " ".join(item)), (6, "the of and"), (7, " ".join(other[40:60]).upper())]
    rows = list(enumerate(texts))
    got = {x["doc_id"]: x for x in dc.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert all(got[i]["near"] == brute_near(t, items) and got[i]["n_hit"] == brute(t, items)[1] for i, t in rows)
    assert "5" in got[1]["near"] and "5" not in got[1]["items"] and "5" in got[2]["near"] and "5" in got[3]["near"] and "5" not in got[4]["near"] and "5" not in got[5]["near"] and got[9]["near"] == ["5"]


def test_any_span(spark):
    """Against all spans, with few words, so that terms repeat and many places come close."""
    r = random.Random(9)
    for k in range(4):
        vocabulary = [f"w{i}" for i in range(14 + 10 * k)]
        rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(60)))) for i in range(60)]
        items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(6, 16)))) for i in range(12)]
        got = dc.decontaminate(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id int, text string"), shard_bytes=2000).collect()
        assert {x["doc_id"]: x["near"] for x in got} == {i: brute_near(t, items) for i, t in rows}


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id int, text string")
    assert dc.decontaminate(empty(spark), bench).count() == 0
    assert {(r["n_hit"], r["contaminated"]) for r in dc.decontaminate(table(spark, 5), bench).collect()} == {(0, False)}


def test_lists():
    import pyarrow as pa

    h, begin = words.hashed_words(pa.array(["a b c a", "c x x a b", ""]), words.ALNUM)
    terms = np.unique(h)
    at = {w: int(np.searchsorted(terms, words.hashed_words(pa.array([w]), words.ALNUM)[0][0])) for w in "abcx"}
    shard = dc.Shard(*dc.postings(h), begin, terms)
    assert shard.positions(at["a"]).tolist() == [0, 3, 7] and shard.positions(at["b"]).tolist() == [1, 8]
    some = dc.Shard(*dc.postings(h), begin, np.append(terms[[at["b"]]], np.uint64(2**64 - 1)))
    assert some.positions(0).tolist() == [1, 8] and some.positions(1).tolist() == []
