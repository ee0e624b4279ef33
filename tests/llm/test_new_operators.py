"""Ranked search, the filter audit and line dedup against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import audit, lines, search
from tessera.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
BIG = (1 << 60) + 1
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string, n_dropped_ string, h1 long, tie long, pos int, mask int, shard long, n long, `a.b` string"


def documents(spark, rows, parts=3):
    """Rows (doc_id, text, source) beside columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6, "y") for r in rows], DOCS).repartition(parts)


# -- ranked search -----------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(ASCII))


def ranked(docs, items, k=20):
    """All scores by the definition."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for (doc, b), n in zip(bags, lengths, strict=True):
            score = 0
            for t in terms(text):
                if b[t]:
                    m = 100 - 25 + 25 * n * n_docs // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_search_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = collected(QUERIES["op11_search"](spark, DATA), "item_id", "rank", "doc_id", "score")
    assert got == sorted(ranked(docs, items), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_search_in_many_shards(spark, monkeypatch, seed):
    """Small slabs, shards, tree and blocks; copies tie at every place; ids beyond 2^53 beside none."""
    monkeypatch.setattr(search, "BLOCK_BYTES", 300)
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)] + ["Ärger", "ärger", "漢字", "o'clock", "x_y"]
    texts = [" ".join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(1, 30))) for _ in range(150)]
    rows = [(i, texts[i]) for i in range(150)] + [(BIG + i, texts[3]) for i in range(100)] + [(None, texts[3]), (None, "t1"), (7, "t2 t3"), (800, None), (801, ""), (802, ". ,")]
    items = [(BIG, texts[3]), (1, "T1 t1 t2,t3"), (1, "T1 t1 t2,t3"), (2, None), (3, "..."), (4, "unheard"), (None, "t5 Ärger"), (5, "ÄRGER x_y O'Clock 漢字"), *((10 + i, texts[i]) for i in range(20))]
    frame = documents(spark, [(i, t, None) for i, t in rows])
    index = search.build(frame, slab_docs=64, shard_docs=8)
    assert index.count() > 32
    assert sorted((str(x) for r in index.collect() for x in r.doc_ids)) == sorted(str(i) for i, _ in rows)
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    got = collected(search.top(index, asked, seeds=2), "item_id", "rank", "doc_id", "score")
    assert got == sorted(ranked(rows, items), key=str)
    assert search.top(index, asked.limit(0)).count() == 0
    assert search.top(search.build(frame.limit(0)), asked).count() == 0


def test_clusters_are_skipped():
    """Documents of one subject lie together, so an item about one visits few of the shards."""
    rng = random.Random(1)
    texts = [f"s{i % 8} " * 5 + " ".join(f"s{i % 8}w{rng.randint(0, 30)}" for _ in range(40)) for i in range(512)]
    held = [(i, sum(b.values()), *search.bag(t.encode())) for i, (t, b) in enumerate((t, search.count_terms(t.encode())) for t in texts)]
    made = list(search.shards(held, 16))
    assert len(made) == 32
    assert max(len({d % 8 for d in s["doc_ids"]}) for s in made) == 1
    asked = search.items_of(["s3 s3w1 s3w2"])
    asked.n_docs, asked.n_terms = 512, 512 * 45
    asked.weights[:] = 1000
    bounds = [int(asked.bounds(s)[0]) for s in made]
    assert sum(b > 0 for b in bounds) == 4
    for s, b in zip(made, bounds, strict=True):
        scores = search.Postings(asked, s).scores(asked, 0)
        assert scores.max() <= b


def test_bisection_lowers_the_cost():
    rng = np.random.default_rng(0)
    n = 256
    doc = np.repeat(np.arange(n), 20)
    term = rng.integers(0, 50, len(doc)) + 50 * rng.permutation(np.arange(n) % 4)[doc]

    def cost(order):
        place = np.empty(n, dtype=int)
        place[order] = np.arange(n)
        total = 0.0
        for t in np.unique(term):
            total += np.log2(np.diff(np.sort(np.unique(place[doc[term == t]])), prepend=-1)).sum()
        return total

    orders = search.bisect(doc, term, n, 4)
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert cost(orders[-1]) < 0.8 * cost(orders[0])


def test_terms_of_long_texts():
    text = ("Wörd, " * 400_000 + "x" * 3_000_000 + " End").encode()
    assert search.count_terms(text) == {"wörd".encode(): 400_000, b"x" * 3_000_000: 1, b"end": 1}
    assert search.count_terms(None) == search.count_terms(b" .,") == {}


# -- filter audit ------------------------------------------------------------------------------------------------------


def audited(docs, labels):
    """Every order run over every document."""
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    fails = []
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        fails.append((source or "", {k for k, v in own.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            whole = list(left)
            for step, letter in enumerate(order, 1):
                removed = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                redundant = sum(letter in f[1] for f in whole) - len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(f[1] == {letter} for f in whole), sum(f[2] for f in removed), sum(f[3] for f in removed)]
                shapley[part, letter] += len(removed)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_query(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(tuple(r[c] for c in AUDIT) for r in QUERIES["op12_filter_audit"](spark, DATA).collect()) == audited(docs, labels)


def test_audit_of_odd_rows(spark):
    rng = random.Random(3)
    varied = " ".join(f"w{i}" for i in range(200))
    texts = [None, "", " ", "\t\n\v\f\r", varied, varied + " W", " " + varied.replace("w", "W") + "\n", "same " * 250, "Ünïcödé ÄÖÜ 漢字", "A", "a|b", "5 % of $ 3", "word no break " * 120, "x y " * 100_000]
    rows = [(rng.choice([None, BIG, BIG + 2, rng.randint(0, 40)]), rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for _ in range(150)]
    labels = [(i % 40, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in range(60)] + [(None, 1, 1), (BIG, 1, 0), (BIG + 1, 1, 1), (BIG + 2, 0, 1)]
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, mask string")
    frame = documents(spark, rows)
    got = sorted(tuple(r[c] for c in AUDIT) for r in audit.interactions(frame, marks).collect())
    assert got == audited(rows, [x for x in labels if x[0] is not None])
    assert audit.interactions(frame.limit(0), marks).count() == 0
    alone = audit.interactions(frame, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(alone) == (0, 0)


# -- line dedup --------------------------------------------------------------------------------------------------------


def key(line):
    return line.strip(" \t\n\v\f\r").translate(ASCII)


def deduped(docs, least=10):
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, t in docs:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first.get(key(x), i), i, key=order)
    out = []
    for i, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < least or first[key(x)] == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def test_lines_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = collected(QUERIES["op13_line_dedup"](spark, DATA), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in deduped(docs)), key=str)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("hot", [2, 10_000])
def test_lines_of_odd_rows(spark, monkeypatch, hot):
    """With every shared line hot, and with none."""
    monkeypatch.setattr(lines, "HOT_ROWS", hot)
    monkeypatch.setattr(lines, "HOT_SHARE", 1 if hot == 2 else 16)
    rng = random.Random(hot)
    pool = ["", " ", "short", "exactly10c", " Exactly10C\t", "\vEXACTLY10C\r", "nine char", "Ärger im Büro", "ÄRGER IM BÜRO", "ärger im büro ", "漢字漢字漢字漢字漢字", "a line that many documents share", " a line that many documents share", "x" * 100_000]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(60)] + [None, "", "\n", "\n\n", "a line that many documents share", "\n".join(f"line number {i % 700}" for i in range(1500)), "\n".join(f"Line Number {i}" for i in range(690, 800))]
    rows = [(n, t) for n, t in enumerate(texts)] + [(BIG, texts[3]), (BIG + 2, texts[3]), (None, texts[3]), (None, texts[4] + "\nonly here in rows without id"), (None, "only here in rows without id"), (5, texts[9]), (5, texts[9]), (5, texts[5])]
    frame = documents(spark, [(i, t, None) for i, t in rows])
    found = lines.dedup(frame)
    assert found.columns == [*frame.columns, "n_lines", "n_dropped"]
    got = collected(found, "doc_id", "n_lines", "n_dropped", "text")
    assert got == sorted(deduped(rows), key=str)
    assert lines.dedup(frame.limit(0)).count() == 0


def test_bitmaps(spark):
    """Bits of dropped lines are 0; words without any are whole; what follows the last dropped line is left out."""
    head = "\n".join(f"shared line {i}" for i in (0, 300))
    body = [f"own line of two {i}" for i in range(500)]
    body[10], body[64], body[400] = "shared line 0", "SHARED LINE 300", " shared line 0 "
    frame = documents(spark, [(1, head, None), (2, "\n".join(body), None)])
    (row,) = lines.keep_bitmaps(frame).collect()
    assert (row.doc_id, row.n_dropped, len(row.keep)) == (2, 3, 400 // 64 + 1)
    bits = [(row.keep[i // 64] >> (i % 64)) & 1 for i in range(len(row.keep) * 64)]
    assert [i for i, b in enumerate(bits) if not b] == [10, 64, 400]


def test_line_dedup_runs_no_python(spark):
    plan = lines.dedup(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
