"""Every corpus operator against a brute-force version, and on odd rows: nulls, empty and very long texts, ties,
repeats, empty tables, and extra columns whose names clash with what the operators use inside."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, common, html_extract, langid, minhash, packing, simhash, toxicity, vectors, warc
from tessera.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "word another, thing " * 20_000 + "x" * 50_000 + " \n" * 3000

ODD = [None, "", " ", "one", "one two", "the same words here again", "the same words here again", "Ünïcödé 漢字 😀 ﷽", "<|endoftext|>", "   spaces  and\n\n\nlines ", LONG]
CLASH = "doc_id long, text string, fp long, node long, cell long, rank long, length long, lang string, `_lang` string, `_toxicity` double, score double, `Source.name` string, bucket int, component_id long, toxic int"


def documents(spark, texts=ODD, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, 1, 2, 3, 4, 5, "en" if n % 2 else None, "x", 0.5, 0.1, "y", 1, 9, 0) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, CLASH)


def odd(spark):
    """All odd texts, one repeated row, and a row without an id."""
    return documents(spark, [*ODD, "one", "one"], [*range(len(ODD)), 3, None])


# -- packing and BPE ---------------------------------------------------------------------------------------------------


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(JSON)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    used = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SIZE
        used += at
    return 1 - used / (len(sequences) * packing.SIZE)


def test_packing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check_packing(QUERIES["op1_packing"](spark, DATA).collect(), texts) < 0.02


def test_packing_odd_rows(spark):
    rows = packing.pack(documents(spark), JSON).collect()
    check_packing(rows, dict(enumerate(ODD)))
    assert packing.pack(odd(spark), JSON).count() == len(rows) + 2
    assert packing.pack(documents(spark).limit(0), JSON).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_covers_every_piece_once(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 64, 2048])
    histogram = {rng.randint(1, size): rng.choice([1, 2, 7, 1000]) for _ in range(rng.randint(1, 60))}
    placements, n = packing.plan_packs(histogram, size)
    fill = {}
    seen = dict.fromkeys(histogram, 0)
    for length, lo, count, first, per, at in placements:
        assert lo == seen[length]
        seen[length] += count
        for k in range(count):
            fill.setdefault(first + k // per, []).append((at + k % per * length, length))
    assert seen == histogram and sorted(fill) == list(range(n))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size


def test_ranks_are_gapless_for_a_hot_key(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5 + 2).alias("k"))
    for k, got in packing.ranked(df, "k", ["id"], 16).groupBy("k").agg(F.sort_array(F.collect_list("rank"))).collect():
        assert got == list(range(len(got))), k


def test_bpe(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.round_trip(odd(spark), RANKS, public_tokenizers.PATTERN).collect():
        text = ("one" if r.doc_id is None else ODD[r.doc_id]) or ""
        ids = own.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(documents(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(documents(spark), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.content).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}


def test_bpe_query(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op2_bpe"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("sign", [" ", "\n", " \n", "\xa0", "a", "7", "!", "漢"])
def test_bpe_of_a_million_signs(sign):
    """Runs that the regex of the library cannot hold; the other library has no such limit."""
    from tokenizers import Tokenizer

    whole, ranks, own = Tokenizer.from_file(JSON), bpe.RankTokenizer.load(RANKS, public_tokenizers.PATTERN), bpe.JsonTokenizer.load(JSON)
    for head, tail in (("", ""), ("é. ", "x")) if sign.isspace() else (("q ", "  y "),):
        text = head + (sign * 1_000_000)[:1_000_000] + tail
        ids = whole.encode(text, add_special_tokens=False).ids
        assert ranks.encode(text).tolist() == ids == own.encode(text).tolist() and ranks.decode(ranks.encode(text)) == text.encode()


def test_added_tokens_and_other_files(tmp_path):
    import json

    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(JSON), bpe.JsonTokenizer.load(JSON)
    for text in ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", "<|endoftext|", "漢 <|endoftext|>漢"]:
        assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        path = tmp_path / f"{next(iter(change))}.json"
        path.write_text(json.dumps(json.loads(open(JSON).read()) | change))
        other = bpe.JsonTokenizer(str(path))
        assert other.encode("Some WORDS, here").tolist() == Tokenizer.from_file(str(path)).encode("Some WORDS, here", add_special_tokens=False).ids != own.encode("Some WORDS, here").tolist()


@pytest.mark.parametrize("seed", range(30))
def test_safe_parts_keep_the_matches(seed):
    import regex

    rng = random.Random(seed)
    text = "".join(rng.choice([" ", "  ", "\n", "\t ", "a", "bc", "'s", "'re", "'", "7", "42", "!", "é", "漢", " ", " ", "😀", "'ll", "x'"]) for _ in range(300))
    pattern = regex.compile(public_tokenizers.PATTERN)
    parts = bpe.safe_parts(text, 20)
    assert "".join(parts) == text
    assert [m for p in parts for m in pattern.findall(p)] == pattern.findall(text)
    own = bpe.JsonTokenizer.load(JSON)
    assert own.encode(text).tolist() == own._full.encode(text, add_special_tokens=False).ids


def test_quick_ids_equal_the_library():
    own = bpe.JsonTokenizer.load(JSON)
    for text in ["it's  two", "a\n\nb ", "we'll 've x'd 12 34!!  ", "Été où ça — “so” …", "\t\ttabs", "end  ", "''s 's'"]:
        assert own.encode(text).tolist() == own._full.encode(text, add_special_tokens=False).ids


# -- near duplicates ---------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints):
    root = dict(zip(ids, ids, strict=True))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for m in range(n):
            if (prints[n] ^ prints[m]).bit_count() <= 3:
                a, b = sorted((top(i), top(ids[m])))
                root[b] = a
    return {i: top(i) for i in ids}


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    ids, prints = [r.doc_id for r in docs], [slow_fingerprint(r.text) for r in docs]
    want = slow_components(ids, prints)
    got = {r.doc_id: r for r in QUERIES["op3_simhash"](spark, DATA).collect()}
    for i, p in zip(ids, prints, strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{p:016x}", want[i])


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD) + 2
    by = {r.doc_id: r.component_id for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[6] == 5 and by[None] == 3
    kept = simhash.keep_one(odd(spark))
    assert kept.columns == documents(spark).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == sorted([(True, 0), *((False, i) for i in (0, 3, 4, 5, 7, 8, 9, 10))])
    assert simhash.near_duplicates(documents(spark).limit(0)).count() == 0
    assert simhash.fingerprint(LONG) == slow_fingerprint(LONG)


def test_simhash_of_ids_with_several_texts(spark):
    """A text whose id another text has too is kept unless it is near a kept one itself."""
    a, b = "the first of all the texts that there are here", "quite another text has nothing of what the other says"
    rows = [(3, b, "z"), (5, a, "y"), (5, b, "x"), (5, a, "w"), (7, a, "v"), (None, a, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    want = [(3, b, "z"), (5, a, "w"), (None, a, "u")]
    for n in (1, 3):
        assert sorted(map(tuple, simhash.keep_one(df.repartition(n)).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("limit", [simhash.CELL_LIMIT, 3])
def test_simhash_loses_no_link(spark, monkeypatch, limit):
    """Chains and a crowded ball; a small limit sends every cell through the words between fingerprints."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 60:
        x = rng.choice(sorted(prints)) if rng.random() < 0.9 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "CELL_LIMIT", limit)
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "node long, fp long")
    got = {i: i for i in range(len(prints))} | {r.node: r.component for r in common.connected_components(simhash.links(nodes)).collect()}
    assert got == slow_components(list(range(len(prints))), prints)


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 1000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1000, dtype=np.uint64))
    counts = [np.stack([np.bitwise_count(x >> np.uint64(2 * s) & np.uint64(3)) for s in range(32)], axis=1).astype(int) for x in (a, b)]
    manhattan = np.abs(counts[0] - counts[1]).sum(axis=1)
    assert (manhattan == np.bitwise_count(simhash._embedded(a) ^ simhash._embedded(b))).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x in got} and all(root[x] == x for x in root.keys() - got.keys())


def slow_vectors(rows):
    links = {r[0]: set() for r in rows}
    usable = [(i, np.array(x, dtype=float), label) for i, x, label in rows if x is not None and label is not None and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    for n, (i, x, a) in enumerate(usable):
        for j, y, b in usable[:n]:
            if a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    component = {i: i for i in links}
    for _ in links:
        for i, others in links.items():
            component[i] = min([component[i], *(component[j] for j in others)])
    return {i: (len(links[i]), component[i], component[i] == i) for i in links}


@pytest.mark.parametrize("cell_rows,chunk", [(512, 2048), (20, 7), (5, 2048)])
def test_vectors(spark, cell_rows, chunk):
    """One cell, and cells that are fitted, in one chunk and in many."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    near = np.vstack([b + rng.normal(scale=s, size=(12, 8)) for b, s in zip(base, [0.05, 0.1, 0.2, 0.4] * 3, strict=True)])
    rows = [(i, [float(v) for v in x], i % 2) for i, x in enumerate(np.vstack([near, rng.normal(size=(60, 8))]))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 8, 1), (n + 2, [1.0, None, *[0.0] * 6], 1), (n + 3, [float("nan")] * 8, 1), (n + 4, rows[0][1], None), (n + 5, rows[0][1], 0), (n + 6, [], 0), (n + 7, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("x", F.lit(1)).withColumn("cell", F.lit(2))
    exact = slow_vectors([(i, [None if v is None else float(np.float32(v)) for v in x] if x is not None else None, label) for i, x, label in rows])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, cell_rows=cell_rows, chunk=chunk).collect()} == exact
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_without_ids_and_with_repeated_ones(spark):
    """Rows are vectors of their own; one without an id connects two that are not linked themselves."""
    a, b, c = ([float(np.cos(t)), float(np.sin(t))] for t in (0.0, 0.15, 0.3))
    df = spark.createDataFrame([(5, a, 1), (None, b, 1), (4, c, 1), (4, [0.0, -1.0], 1), (None, None, 1), (9, [0.0, -1.0], 1), (None, [-1.0, 0.0], 2)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, vectors.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 1, 4, False), (None, 2, 4, False), (4, 1, 4, True), (4, 1, 4, True), (None, 0, None, False), (9, 1, 4, False), (None, 0, None, False)], key=str)


def test_vectors_of_one_large_label(spark):
    """100,000 vectors of one label: hundreds of fitted cells, and no link lost, against all products in blocks."""
    rng = np.random.default_rng(7)
    n, dim = 100_000, 16
    base = rng.normal(size=(n // 4, dim))
    x = np.repeat(base, 4, axis=0) + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.1, 0.3], size=(n, 1))
    x[:2000] = x[0]  # copies
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), dim).cast(pa.list_(pa.float64()))})).withColumn("label", F.lit(1))
    nodes = vectors._usable(df.withColumn("label", F.lit(1).cast("long"))).withColumnRenamed("vec_id", "node")
    assert len(vectors.fit_cells(nodes)[0][2]) > 150
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = np.concatenate([(unit[i : i + 2000] @ unit.T >= 0.98).sum(axis=1) for i in range(0, n, 2000)]) - 1
    got = vectors.near_duplicates(df).toPandas().sort_values("vec_id")
    assert (got["n_links"].to_numpy() == links).all()
    assert got["kept"].sum() == got["component_id"].nunique() and (got["component_id"] <= got["vec_id"]).all()


def slow_minhash(text):
    """The low 32 bits of the least a * h + b modulo 2^64 over all five-word shingles, one number at a time."""
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return [0] * 128
    k = min(5, len(words))
    hashes = {xxhash.xxh3_64_intdigest(" ".join(words[i : i + k]).encode()) for i in range(len(words) - k + 1)}
    return [min((a * h + b) % 2**64 for h in hashes) % 2**32 for a, b in zip(map(int, minhash._A.ravel()), map(int, minhash._B.ravel()), strict=True)]


def check_minhash(rows, texts):
    """Rows against the texts by doc_id."""
    order = sorted(texts, reverse=True)
    own = {i: slow_minhash(texts[i]) for i in order}
    assert sorted(r.doc_id for r in rows) == sorted(order)
    got = {r.doc_id: r for r in rows}
    for i, nxt in zip(order, order[1:] + order[:1], strict=True):
        half = len(texts[i]) // 2
        new = texts[i][: len(texts[i]) - half] + texts[nxt][:half]
        other = slow_minhash(new)
        assert (got[i].n_chars, got[i].edited_sha256) == (len(texts[i]), hashlib.sha256(new.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == tuple("".join(f"{x:08x}" for x in p) for p in (own[i], other))
        assert [round(v * 128) for v in (got[i].near_edited, got[i].near_next)] == [sum(x == y for x, y in zip(own[i], p, strict=True)) for p in (other, own[nxt])]


def test_minhash_query(spark, tmp_path):
    texts = {r.doc_id: (r.text or "")[:4000] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()}
    texts |= {900_000: "", 900_001: "the very same", 900_002: "the very same", 900_003: "İ ẞ\tA\nB\x1cC " * 20}
    spark.createDataFrame([(i, t or None) for i, t in texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    check_minhash(QUERIES["op9_minhash"](spark, str(tmp_path)).collect(), texts)


def test_minhash_odd_rows(spark):
    docs = odd(spark)
    got = minhash.compare_edited(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    short = {i: t or "" for i, t in enumerate(ODD)}
    check_minhash(got, short)
    assert minhash.compare_edited(docs).count() == len(ODD) + 2
    assert minhash.compare_edited(docs.limit(0)).count() == 0
    only = minhash.compare_edited(documents(spark, ["just one document"])).collect()
    assert len(only) == 1 and only[0].near_next == 1


@pytest.mark.parametrize("words", [1_000, 30_000, 300_000, 1_000_000])
def test_minhash_of_unrelated_long_texts(words):
    rng = np.random.default_rng(words)
    a, b = (minhash.minima(np.unique(rng.integers(0, 1 << 63, words, dtype=np.uint64))) for _ in range(2))
    assert minhash.likeness(a, b) < 0.02


def test_byte_cuts(spark):
    """Ranges of about equal bytes, the same however the rows are dealt out; hot windows of ids are split again."""
    rng = random.Random(3)
    for ids in ([*range(5000)], [0, *range(10**12, 10**12 + 4000), 2**62], [-5, -4, 7, 7, 7, 9], [-(2**63), 2**63 - 1], [1]):
        sizes = [rng.randint(1, 2000) for _ in ids]
        df = spark.createDataFrame([*zip(ids, sizes, strict=True), (None, 5)], "id long, size long")
        cuts = common.byte_cuts(df.repartition(2), least=20_000)
        assert cuts == common.byte_cuts(df.repartition(7), least=20_000) == sorted(set(cuts))
        sums = {r.b: r.n for r in df.filter("id is not null").groupBy(common.bucket_of(F.col("id"), cuts).alias("b")).agg(F.sum("size").alias("n")).collect()}
        assert set(sums) == set(range(len(cuts) + 1)) and max(sums.values()) <= 22_000
        assert len(sums) <= 2 * sum(sizes) / 20_000 + 3
    assert common.byte_cuts(df.limit(0)) == []


def test_hubs_are_joined_whole(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 50).alias("k"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    want = sorted(map(tuple, rows.join(facts.drop("n"), "k").select("id", "k", "top").collect()))
    assert want == sorted(map(tuple, common.join_hubs(rows, facts, "k", 1000, hub=30).select("id", "k", "top").collect()))


def test_minhash_estimates_jaccard():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    a = " ".join(rng.choice(words) for _ in range(2000))
    for share in (0.1, 0.3, 0.6):
        b = a.split()
        b[: int(len(b) * share)] = [rng.choice(words) for _ in range(int(len(b) * share))]
        x, y = set(minhash.shingles(a).tolist()), set(minhash.shingles(" ".join(b)).tolist())
        assert abs(minhash.likeness(minhash.signature(a), minhash.signature(" ".join(b))) - len(x & y) / len(x | y)) < 0.15


def slow_groups(texts):
    """Components of all pairs of texts with the same shingles or a Jaccard similarity of 0.8."""
    sets = {}
    for i, t in texts.items():
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate(dict.fromkeys(map(ord, "\t\n\v\f\r"), " ")).split(" ") if w]
        k = min(5, len(words))
        sets[i] = {tuple(words[x : x + k]) for x in range(len(words) - k + 1)} if words else set()
    root = {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) > 0:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def test_minhash_groups_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r.component_id for r in QUERIES["minhash_groups"](spark, DATA).collect()}
    assert got == slow_groups(texts) and len(set(got.values())) < len(got)


@pytest.mark.parametrize("chunk_bytes,at_once", [(minhash.CHUNK_BYTES, minhash.PAIRS), (6000, 2)])
def test_minhash_near_duplicates(spark, chunk_bytes, at_once):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 6) for _ in range(300)]
        texts += [" ".join(words), " ".join([*words[:290], "new", "end"]), " ".join(words[::-1])]
    chain = [rng.choice("abcdefghijklmnop") * rng.randint(1, 6) for _ in range(300)]
    for _ in range(25):  # each like the one before, the first and the last not
        chain[rng.randrange(300)] = f"new{rng.random()}"
        chain[rng.randrange(300)] = f"new{rng.random()}"
        texts.append(" ".join(chain))
    texts += [None, "", texts[0], texts[0]]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts), chunk_bytes=chunk_bytes, pairs_at_once=at_once).collect()}
    sets = [set(minhash.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and both >= 0.8 * len(sets[i] | sets[j])):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert got == dict(enumerate(root))


# -- classifiers -------------------------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, common.fold(F.col("doc_id"), 4) != 2).join(docs.select("doc_id", "lang"), "doc_id").filter(common.fold(F.col("doc_id"), 4) == 2)
    assert got.filter("lang_pred = lang").count() >= 0.98 * got.count()


def test_language_odd_rows(spark):
    docs = documents(spark, ["the cat and the dog", "le chat et le chien", None, "", "123 !?", "the cat", LONG]).withColumn("lang", F.when(F.col("doc_id") == 0, "en").when(F.col("doc_id") == 1, "fr"))
    got = {r.doc_id: r for r in langid.identify(docs, F.lit(True)).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2].score == 0
    kept = langid.keep_identified(docs, F.lit(True))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 5, 6} and kept.first()["_lang"] == "x"
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def slow_ngrams(text):
    """Buckets of all 1- to 3-grams with a letter, one character at a time; what is no letter is a gap."""
    text, out = text.lower(), []
    for i in range(len(text)):
        for order in (1, 2, 3):
            part = text[i : i + order]
            if len(part) == order and "\0" not in part and any(c.isalpha() for c in part):
                h = order * 0x9E3779B1 % 2**32
                for c, prime in zip(part, map(int, langid._PRIMES), strict=False):
                    h = (h ^ (ord(c) if c.isalpha() else 32)) * prime % 2**32
                    h ^= h >> 15
                out.append(h % langid.BUCKETS)
    return out


def test_language_query_is_naive_bayes(spark, tmp_path):
    import math
    from collections import Counter

    rows = [(r.doc_id, r.text and r.text[:1500], r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    rows += [(10**6, None, "en"), (10**6 + 1, "12 !", None), (10**6 + 2, "Ünïcödé ça", None), (10**6 + 3, "ça va", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    counts, docs = {}, Counter()
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(slow_ngrams(text or ""))
            docs[lang] += 1
    size = {lang: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for lang, c in counts.items()}
    got = {r.doc_id: r for r in QUERIES["op6_langid"](spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, text, _ in rows:
        grams = slow_ngrams(text or "")
        logs = {lang: math.log(docs[lang] / sum(docs.values())) + sum(math.log((c[g] + langid.SMOOTHING) / size[lang]) for g in grams) for lang, c in counts.items()}
        best = min(logs, key=lambda lang: (-logs[lang], lang))
        want = (best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())) if grams else ("und", 0.0)
        assert got[i].lang_pred == want[0] and abs(got[i].score - want[1]) < 1e-6
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_ngrams_do_not_depend_on_slices(monkeypatch):
    texts = ["Some words, here.", "", "x", "é" * 50]

    def counts():
        out = np.zeros((len(texts), langid.BUCKETS + 1), dtype=int)
        for owner, bucket in langid.ngrams(texts):
            np.add.at(out, (owner, bucket), 1)
        return out[:, :-1]

    whole = counts()
    monkeypatch.setattr(langid, "_SLICE", 7)
    assert np.array_equal(counts(), whole)


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    part = common.fold(F.col("doc_id"), 3)
    got = toxicity.classify(docs, labels, part != 1).join(labels, "doc_id").filter(part == 1).select("toxic", "predicted").toPandas()
    toxic, clean = got[got.toxic == 1].predicted, got[got.toxic == 0].predicted
    assert toxic.mean() > 0.8 and clean.mean() < 0.01  # some labels are noise


def slow_score(machine, text):
    """The factorization machine by its definition, over pairs."""
    import math
    import re

    hashed = set()
    for word in re.findall(r"\w+", (text or "").lower()):
        hashed |= {zlib.crc32(x.encode()) % 2**18 for x in (word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) >= k))}
    at = sorted(machine.column[h] for h in hashed if h in machine.column)
    raw = float(machine.w0[0]) + sum(machine.w[i] for i in at) + sum(float(machine.v[i] @ machine.v[j]) for n, i in enumerate(at) for j in at[:n])
    return 1 / (1 + math.exp(-raw))


def test_toxicity_query_scores_by_the_definition(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(docs, labels, common.fold(F.col("doc_id"), 3) != 1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = QUERIES["op4_toxicity"](spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert abs(r.score - slow_score(machine, texts[r.doc_id])) < 1e-9
        assert r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_toxicity_learns_from_fifty_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels, F.lit(True)).join(labels, "doc_id").select("score", "toxic").collect()
    toxic, clean = [r.score for r in got if r.toxic == 1], [r.score for r in got if r.toxic == 0]
    assert min(len(toxic), len(clean)) and np.mean(toxic) > np.mean(clean) + 0.3
    machine = toxicity.train(docs, labels, F.lit(True), fewest=0, least_z=1e9)
    assert len(machine.w) == 0


def test_terms_forget_words_beyond_their_bound():
    text = " ".join(f"word{i} other{i}" for i in range(50))
    assert toxicity.Terms(most=10).of(text) == toxicity.Terms().of(text) == toxicity.Terms(most=10).of(text)
    bounded = toxicity.Terms(most=10)
    assert [bounded.of(t) for t in ("a b", text, "a b")] == [toxicity.Terms().of(t) for t in ("a b", text, "a b")] and len(bounded._known) <= 100


def test_machine_learns_an_interaction():
    """Neither term alone is toxic; together they are."""
    rng = np.random.default_rng(0)
    terms = [{1} if k == 0 else {2} if k == 1 else {1, 2} if k == 2 else {3} for k in rng.integers(0, 4, 400)]
    rows, cols = zip(*((i, t - 1) for i, each in enumerate(terms) for t in sorted(each)), strict=True)
    label = np.array([float({1, 2} <= t) for t in terms])
    m = toxicity.Machine(np.array([1, 2, 3])).fit(np.array(rows), np.array(cols), label, steps=2000, rates=(0.05, 0.05, 0.05))
    assert m.score([{0, 1}])[0] > 0.9 and max(m.score([{0}, {1}, {2}, set()])) < 0.3


def test_toxicity_odd_rows(spark):
    texts = ["you idiot", "fine day", "an idiot again", "nice words", None, "", LONG] * 8
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1 if "idiot" in (t or "") else 0) for i, t in enumerate(texts)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels, F.lit(True)).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    assert got[0].predicted == 1 and got[1].predicted == got[4].predicted == got[5].predicted == 0
    kept = toxicity.keep_clean(docs, labels, F.lit(True))
    assert kept.columns == docs.columns and kept.filter("text like '%idiot%'").count() == 0 and kept.first()["_toxicity"] == 0.5
    none = toxicity.classify(docs, labels.limit(0), F.lit(True))
    assert none.filter("score <> 0").count() == 0
    assert toxicity.classify(docs.limit(0), labels, F.lit(True)).count() == 0


# -- pages -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("just text", "just text"), ("<nav><a href='/'>Home</a></nav>", ""),
    ("<article><h1>A &amp; B</h1><p>one\n two<p>three <b>four</b></article><footer>c</footer>", "A & B\none two\nthree four"),
    ("<div class=post><p>one two three</p><div class='ad'>buy now</div><p>four</p></div><div id=comments><p>great read</p></div>", "one two three\nfour"),
    ("<body><div class='cookie-notice'>we use cookies</div><main><p>real text here</p><form><label>mail</label></form></main><aside>more</aside></body>", "real text here"),
    ("<p>a &lt;b&gt; c<script>var x = '<p>no</p>';</script><style>p{}</style><!-- no --> d</p>", "a <b> c d"),
    ("<article><p title='a > b'>kept</p></article><script>unclosed", "kept"),
    ("<article><p>a <svg><text>no</text></svg>b<svg/> c</p><noscript><p>no</p></noscript><p>d <select><option>no</select></p></article>", "a b c\nd"),
    ("<article><p>a</p><template><p>b</p></article>", "a\nb"),
    ("<html><body class='has-sidebar'><nav><a href=/>Home</a></nav><article><h1>T</h1><p>One two three four five.</p></article></body>", "T\nOne two three four five."),
    ("<article class='post comments-open'><h1>T</h1><p>One two three four five.</p></article><div id=comments><p>I think that this is long and wrong, said one reader of many, more than the article has.</p></div>", "T\nOne two three four five."),
    ('<article><p title="a<b>c">kept</p></article>', "kept"), ("<article><p>2 < 3 and <3</p><p data-x=\"unclosed>so</p></article>", "2 < 3 and <3\nso"),
    ("<header><p>My site</p></header><article><header><h1>Head</h1></header><p>Some text that goes on.</p><footer>Shared</footer></article>", "Head\nSome text that goes on."),
    ("<article><p>text <b>goes</b> on</p></article><p class='", "text goes on"), ("<div class=zork><h1>T</h1><p>Some text that goes on, as it does.</p></div><div class=colophon>All rights</div>", "T\nSome text that goes on, as it does."),
    ("<article><h1>T</h1>" + "".join(f"<div class='p{i}q'><p>Part {i} of a text in many boxes.</p></div>" for i in range(9)) + "</article>", "\n".join(["T", *(f"Part {i} of a text in many boxes." for i in range(9))])),
])
def test_html(page, want):
    assert html_extract.extract(page) == want


def wrong_blocks(pages, model):
    """Blocks, and blocks on the wrong side, of boilerplate and of content."""
    out = {False: [0, 0], True: [0, 0]}
    for page, marks in pages:
        for odds, mark in zip(html_extract.log_odds(html_extract.read(page), model), marks, strict=True):
            out[mark][0] += 1
            out[mark][1] += (odds > 0) != mark
    return out


def test_html_weights_separate_the_labelled_pages():
    model = html_extract.learn()
    assert model[2] < 0
    clear = [s for s in html_extract._SHAPES if "site-X-area" not in s]
    (boilerplate, kept), (content, lost) = wrong_blocks(html_extract.labelled_pages(shapes=clear), model).values()
    assert kept <= 0.035 * boilerplate and lost <= 0.003 * content  # content on some of these pages has the same words in its names


@pytest.mark.parametrize("held", range(0, len(html_extract._SHAPES), 3))
def test_html_with_shapes_that_were_not_learned(held):
    """Known names in unknown shapes; words of long names are only known from one shape."""
    out = html_extract._SHAPES[held : held + 2]
    model = html_extract.fit(html_extract.labelled_pages(shapes=[s for s in html_extract._SHAPES if s not in out]))
    (boilerplate, kept), (content, lost) = wrong_blocks(html_extract.labelled_pages(shapes=out, seed=9), model).values()
    assert kept <= (0.1 if held < 6 else 0.25) * boilerplate and lost <= 0.01 * content


def slow_run(words, tags):
    """Over all intervals: the largest sum of words, and of the tags after the first block."""
    every = [(sum(words[a:b]) + sum(tags[a + 1 : b]), a, b) for a in range(len(words)) for b in range(a + 1, len(words) + 1)]
    return max([x for x, _, _ in every], default=0)


@pytest.mark.parametrize("seed", range(30))
def test_best_run_and_maximal_runs(seed):
    rng = random.Random(seed)
    words = [rng.choice([-3, -2, -1, 0, 1, 2, 3]) * rng.randint(0, 5) / 4 for _ in range(rng.randint(0, 25))]
    tags = [-rng.randint(0, 3) / 8 for _ in words]
    a, b = html_extract.best_run(words, tags)
    assert sum(words[a:b]) + sum(tags[a + 1 : b]) == max(0, slow_run(words, tags))
    runs = html_extract.maximal_runs(words)
    # By the recursive definition: the best run, then those of what is left and right of it.
    def split(lo, hi):
        found = [(sum(words[x:y]), x - y, x, y) for x in range(lo, hi) for y in range(x + 1, hi + 1)]
        best = max(found, key=lambda f: (f[0], f[1], -f[2]), default=(0,))
        return [] if best[0] <= 0 else [*split(lo, best[2]), (best[2], best[3]), *split(best[3], hi)]
    assert [r[2] for r in runs] == [sum(words[x:y]) for x, y, _ in runs] and sum(r[2] for r in runs) == sum(sum(words[x:y]) for x, y in split(0, len(words)))
    assert all(x <= c and d <= y for c, d in split(0, len(words)) for x, y, _ in runs if x < d and c < y)


def by_block(page):
    """What a filter of single blocks would keep."""
    model = html_extract.learn()
    tree = html_extract.read(page)
    return "\n".join(" ".join("".join(b.text).split()) for b, o in zip(tree.blocks, html_extract.log_odds(tree, model), strict=True) if o > 0)


SENTENCE = "This is a sentence of the article that goes on for a while and then ends."


def test_the_scan_decides():
    """Pages on which single blocks would be judged otherwise."""
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Some link to a page</a></li>" for i in range(12)) + "</ul>"
    page = f"<h1>Title of it</h1><p>{SENTENCE}</p><p>{SENTENCE}</p><nav>{menu}</nav><p>All text is set in Georgia.</p>"
    assert "Georgia" in by_block(page)
    assert html_extract.extract(page) == f"Title of it\n{SENTENCE}\n{SENTENCE}"


@pytest.mark.parametrize("inside", [f'<p class="comment-on-law">{SENTENCE}</p>', f'<div class="form-and-notice"><p>{SENTENCE}</p><p>{SENTENCE}</p></div>', f'<p id="notes-on-the-search-for-ads">{SENTENCE}</p>'])
def test_content_with_a_word_of_boilerplate_in_its_name(inside):
    got = html_extract.extract(f"<nav><a href=/>Home</a></nav><article><h1>T</h1><p>{SENTENCE}</p>{inside}<p>{SENTENCE}</p></article><footer>All rights</footer>")
    assert got == "\n".join(["T", *[SENTENCE] * (2 + inside.count(SENTENCE))])


@pytest.mark.parametrize("box", ['<div class="user-comments"><p>{}</p></div>', '<div class="post-comments-list"><ul><li>{}</li></ul></div>', '<section id="comments"><p>{}</p><p>{}</p></section>'])
def test_comments_after_the_article_go(box):
    got = html_extract.extract(f"<article><h1>T</h1><p>{SENTENCE}</p><p>{SENTENCE}</p></article>{box.format(SENTENCE, SENTENCE)}")
    assert got == f"T\n{SENTENCE}\n{SENTENCE}"


@pytest.mark.parametrize("fold", range(3))
def test_html_with_names_that_were_not_learned(fold):
    """Content with unknown names around stays, and most boilerplate is told by how it looks."""
    held = html_extract._NAMES[fold::3]
    model = html_extract.fit(html_extract.labelled_pages([n for n in html_extract._NAMES if n not in held]))
    (boilerplate, kept), (content, lost) = wrong_blocks(html_extract.labelled_pages(held, seed=9), model).values()
    assert kept <= 0.45 * boilerplate and lost <= 0.01 * content


@pytest.mark.parametrize("page", [
    "<a " * 80_000, "<a '" * 60_000, '<a x="' * 50_000, "<div>" * 50_000, "<div>" * 20_000 + "</p>" * 20_000, "<b class=x>" * 10_000 + "<div></div>" * 10_000, "<!--" * 100_000, "<script>" * 100_000,
    "</" * 100_000, "".join(f"<div class=c{i}x>" for i in range(20_000)), "<ul><li><ul>" + "<b class=x>" * 5000 + "<li></li>" * 5000, "<p " + "a=b " * 500_000, "<x y" + " " * 3_000_000, "<q " + "=" * 1_000_000, "<a " * 3_400_000,
])
def test_html_takes_linear_time(page):
    import time

    start = time.perf_counter()
    assert html_extract.extract(page + "><p>so much for that.</p>").lstrip(">\n") in ("", "so much for that.")
    assert time.perf_counter() - start < 5


def test_html_query(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = QUERIES["op5_html"](spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
    odd_pages = spark.createDataFrame([(1, None, None, "x", 1), (None, "u", "<p>a</p>" * 50_000, "y", 2), (1, None, None, "x", 3)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted(r.n_chars for r in html_extract.main_text(odd_pages).collect()) == [0, 0, 99_999]
    assert html_extract.main_text(odd_pages.limit(0)).count() == 0


def test_warc(spark):
    rows = [(i, f"http://e.org/{i}?q=é x", f"<p>{i % 7}</p>" * (i % 7 * 100)) for i in range(60)] + [(60, None, None), (61, "u\r\nX: y", ""), (None, "n", "<p>1</p>" * 100), (62, "r", "same"), (62, "r", "same"), (5000, "l", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit(5)).withColumn("bucket", F.lit(6)).withColumn("refers_to", F.lit(7))
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    out = {}
    for n, uri in enumerate(f"{common.shared_dir(spark)}/{x}" for x in ("warc-a", "warc-b")):
        manifest = warc.write(pages.repartition(3 + 4 * n), uri, roll_bytes=2000)
        out[uri] = sorted((r.file, r.records, r.bytes, r.sha1) for r in manifest.collect())
        got = warc.read(spark, uri, html=True).collect()
        assert len(got) == len(rows)
        assert not warc._store(uri)[0].get_file_info(warc._store(uri)[1] + "/_temporary").is_file
        by = {r.page_id: r for r in got}
        for i, _, h in rows:
            payload = (h or "").encode()
            refers = top.get(h or "") if i is not None and top[h or ""] != i else None
            r = by[i]
            assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), refers)
            assert r.record_type == ("response" if refers is None else "revisit")
            assert r.payload is None if refers is not None else bytes(r.payload) == payload
    first, second = out.values()
    assert first == second and len(first) > 5  # the same files whatever the partitions were
    assert warc.round_trip(pages.limit(0), common.shared_dir(spark)).count() == 0


def test_warc_files_do_not_depend_on_partitions(spark, monkeypatch):
    """More ids than any sketch holds exactly; several ranges, one task each."""
    monkeypatch.setattr(warc, "byte_cuts", lambda sized: common.byte_cuts(sized, least=60_000))
    pages = spark.range(30_000).select((F.col("id") * F.col("id") % 1_000_003).alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("html"))
    out = []
    for n in (1, 5):
        manifest = warc.write(pages.repartition(n), f"{common.shared_dir(spark)}/warc-many-{n}")
        out.append(sorted((r.file, r.records, r.sha1) for r in manifest.collect()))
    assert out[0] == out[1] and len(out[0]) > 8 and sum(f[1] for f in out[0]) == 30_000


# -- conversations -----------------------------------------------------------------------------------------------------


def cheapest_repair(roles):
    """The cost of the cheapest legal conversation by the plain costs, as a shortest way: keep 0, merge 1, relabel 4 (an
    unknown role 1), an empty message 3.  Written from the rules, not from the operator's tables."""
    known = {"system": "s", "developer": "s", "user": "u", "human": "u", "prompter": "u", "assistant": "a", "gpt": "a", "bot": "a", "model": "a"}
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    states = {"": 0}
    for role in roles:
        kind, new = known.get((role or "").strip().lower()), {}
        for state, cost in states.items():
            for target in "sua":
                own = cost + (0 if target == kind else 1 if kind is None else 4)
                ways = [own] * (target in follows[state]) + [own + 1] * (target == state) + [own + 3 for x in follows[state] if target in follows[x]]
                if ways:
                    new[target] = min([*ways, new.get(target, 10**9)])
        states = new
    return min(cost + {"": 0, "s": 6, "u": 3, "a": 0}[state] for state, cost in states.items())


def test_chat_query(spark):
    turns = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, {})[(r.turn, r.role, r.text)] = r.role
    got = {}
    for r in QUERIES["op7_chat"](spark, DATA).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert set(got) == set(turns)
    for conv, rows in got.items():
        rows.sort(key=lambda r: (r.turn is not None, r.turn, r.tie))
        assert sorted((r.turn, r.role or "") for r in rows) == sorted((t, role or "") for t, role, _ in turns[conv])
        assert sum(r.cost for r in rows) == cheapest_repair([r.role for r in rows])
        whole = "".join(r.rendered for r in rows)
        roles = [m.split("\n")[0] for m in whole.split("<|im_start|>")[1:]]
        rest = roles[1:] if roles[0] == "system" else roles
        assert rest == ["user", "assistant"] * (len(rest) // 2) and rest


@pytest.mark.parametrize("size", [1, 2, 1024])
def test_chat_costs(spark, size):
    rng = random.Random(1)
    rows, want = [], {}
    for c in range(40):
        roles = [rng.choice(["system", "user", "Assistant ", "weird", None]) for _ in range(rng.randint(1, 4))]
        rows += [(c, i, r, f"t{i}") for i, r in enumerate(roles)]
        want[c] = cheapest_repair(roles)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1)).withColumn("n", F.lit(1))
    got = chat.repair(df, size).groupBy("conv_id").agg(F.sum("cost").alias("c")).collect()
    assert {r.conv_id: r.c for r in got} == want


def test_chat_rendering_is_legal(spark):
    rng = random.Random(2)
    rows = [(c, i // 2, rng.choice(["system", "user", "assistant"]), f"t{c} {i}" if i % 3 else None) for c in range(10) for i in range(30)]
    rows += [(None, None, "user", "<|im_end|>"), (None, 1, "assistant", LONG), (99, 0, "user", "x"), (99, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    outs = []
    for size in (4, 1024):
        got = chat.repair(df, size).orderBy("conv_id", "turn", "tie").collect()
        outs.append([(r.conv_id, r.turn, r.tie, r.new_role, r.rendered) for r in got])
        by = {}
        for r in got:
            by.setdefault(r.conv_id, []).append(r.rendered)
        for parts in by.values():
            whole = "".join(parts)
            messages = whole.split("<|im_start|>")[1:]
            roles = [m.split("\n")[0] for m in messages]
            assert whole.startswith("<|im_start|>") and all(m.endswith("<|im_end|>\n") and m.count("<|") == 1 for m in messages)
            rest = roles[1:] if roles[0] == "system" else roles
            assert rest == ["user", "assistant"] * (len(rest) // 2) and rest
        assert [r.repeats for r in got if r.conv_id == 99] == [2]
    assert chat.repair(df.limit(0)).count() == 0


def test_chat_blocks_of_sparse_turns(spark):
    """Blocks are cut by rank: turn numbers far apart, close together or null make no more of them."""
    df = spark.range(600).select(F.when(F.col("id") < 500, 1).otherwise(F.col("id")).cast("long").alias("conv_id"), (F.col("id") * F.col("id") * 10**9).alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    found = chat.blocked(df, 20)
    assert found.filter("conv_id = 1").select("place", "part").distinct().count() <= 500 / 20 + 2 * 4
    assert found.groupBy("place", "part").count().agg(F.max("count")).first()[0] <= 20
    costs = chat.repair(df, 20).groupBy("conv_id").agg(F.sum("cost").alias("c")).collect()
    assert {r.conv_id: r.c for r in costs} == {1: 499 * chat.COSTS["merge"] + chat.COSTS["insert"]} | dict.fromkeys(range(500, 600), chat.COSTS["insert"])


def test_chat_crowded_turns(spark):
    """Many different turns with one turn number are dealt out and still repaired as one conversation."""
    df = spark.range(60).select(F.lit(1).cast("long").alias("conv_id"), F.lit(3).cast("long").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.repair(df, 2)
    assert got.agg(F.sum("cost")).first()[0] == 59 * chat.COSTS["merge"] + chat.COSTS["insert"]


# -- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.01"  # labels enough to learn from
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, known = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = common.write_shared(stage(spark, docs, data), f"test-{name}")
        after = [r.doc_id for r in docs.collect()]
        assert docs.columns == columns and len(after) == len(set(after)) and set(after) <= before
        if name == "language_id":
            assert len(after) >= 0.98 * len(before)
        if name == "simhash":
            ids = sorted(before)
            assert set(after) == set(slow_components(ids, [slow_fingerprint(known[i]) for i in ids]).values())
        if name == "toxicity":
            assert sum(labels.get(i) == 1 for i in before - set(after)) >= 0.5 * sum(labels.get(i) == 1 for i in before)
    rows = corpus_pipeline.run(spark, data).collect()
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()})


def test_vectors_at_coincident_centroids(spark):
    rng = np.random.default_rng(3)
    c = rng.normal(size=24)
    c /= np.linalg.norm(c)
    near = c + rng.choice([-1, 1], size=24) * 1e-16
    x = rng.normal(size=(200, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    unit = spark.createDataFrame([(i, 1, 0, 24, v.tobytes()) for i, v in enumerate(x)], "node long, n long, label long, dim int, x binary")
    placed = vectors._placed(unit, [(0, 24, np.stack([c, near]))], 0.3).collect()
    assert all(sorted(r["cells"]) == [0, 1] for r in placed)


# -- ids ---------------------------------------------------------------------------------------------------------------

BIG = [(1 << 60) + 1, (1 << 60) + 3, None, (1 << 60) + 5, (1 << 60) + 5, -(1 << 60) - 7]


def same_ids(rows, column="doc_id"):
    return sorted((r[column] for r in rows), key=str) == sorted(BIG, key=str)


def test_ids_beyond_floating_point_stay_beside_a_null(spark):
    """Every operator returns the ids that it got, whatever else is in their batch."""
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "without an id", "the same", "the same", "minus"]
    docs = spark.createDataFrame(list(zip(BIG, texts, strict=True)), "doc_id long, text string").coalesce(1)
    assert same_ids(packing.pack(docs, JSON).collect())
    assert same_ids(bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect())
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert same_ids(encoded.collect()) and same_ids(bpe.decode(encoded.coalesce(1), RANKS, public_tokenizers.PATTERN).collect())
    found = simhash.near_duplicates(docs).collect()
    assert same_ids(found) and {r.component_id for r in found} <= set(BIG)
    assert same_ids(minhash.compare_edited(docs).collect())
    found = minhash.near_duplicates(docs).collect()
    assert same_ids(found) and {r.component_id for r in found} <= set(BIG)
    pages = spark.createDataFrame([(i, f"http://x/{n}", f"<p>{t}</p>") for n, (i, t) in enumerate(zip(BIG, texts, strict=True))], "page_id long, url string, html string").coalesce(1)
    assert same_ids(html_extract.main_text(pages).collect(), "page_id")
    rows = spark.createDataFrame([(i, [1.0, 0.0] if n in (1, 3) else [math.cos(n + 1), math.sin(n + 1)], 1) for n, i in enumerate(BIG)], "vec_id long, embedding array<double>, label int").coalesce(1)
    got = vectors.near_duplicates(rows).collect()
    assert same_ids(got, "vec_id") and sum(r.n_links for r in got if r.vec_id == BIG[1]) >= 1 and BIG[1] in {r.component_id for r in got if r.vec_id == BIG[3]}
    held = [r for r in warc.round_trip(pages, common.shared_dir(spark)).collect()]
    assert same_ids(held, "page_id") and {r.refers_to for r in held} <= set(BIG)
    labels = spark.createDataFrame([(BIG[0], 1), (BIG[1], 0)], "doc_id long, toxic int")
    assert same_ids(toxicity.classify(docs, labels, F.lit(True)).collect())
    assert same_ids(langid.identify(docs.withColumn("lang", F.lit("en")), F.lit(True)).collect())
