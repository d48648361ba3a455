"""Fill-in-the-middle, centroid clustering and chunked BPE against plain Python and the libraries."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from visitlake.llm import capture_fim, chunk_bpe, queries, table_kmeans
from visitlake.llm.oracle import _kmeans
from visitlake.llm.queries import MULTI_RANKS, tokenizer_path

DOC = "doc_id long, text string, lang string, n long, form string, ids string, row string, chunk string"
BITS = ["the ", "l'", "don't ", "we'll", "  ", "\n", "\r\n\t", "é", "日本語", "😀", "12345", "⅔", "á", "'", "''re", "\x1c\x1d", "…", "x" * 40, "՘", "<P>", " ", " "]


def texts(n, seed, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(longest))) for _ in range(n)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "psm", "x", "y", "z") for i, t in rows], DOC).repartition(3)


SOME = [*enumerate(texts(200, 1)), (7, "seven again"), (7, "seven again"), (None, "no id"), (500, None), (501, ""), (502, "word " * 30_000), (503, "a" * 3000), (504, "<S>")]


# fill in the middle

def fim(doc_id, text):
    t = text or ""
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(t), "plain", None, None, t)
    a, b = sorted(x % (len(t) + 1) for x in h[:2])
    p, m, u = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return (doc_id, len(t), "spm", a, b - a, f"<S>{u}<P>{p}<M>{m}")
    return (doc_id, len(t), "psm", a, b - a, f"<P>{p}<S>{u}<M>{m}")


def test_fill_in_middle(spark):
    done = capture_fim.fill_in_middle(documents(spark, SOME)).withColumn("back", capture_fim.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in done.collect()), key=str)
    assert got == sorted(((*fim(i, t), t or "") for i, t in SOME), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_odd_tables(spark):
    assert capture_fim.fill_in_middle(documents(spark, [])).count() == 0
    # marks that nearly arise at the cuts
    near = [(i, t) for i in range(300) for t in ("<P<S<M", ">S>P>M><", "<<<>>>")]
    done = capture_fim.fill_in_middle(documents(spark, near)).select(capture_fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(r[0] for r in done) == sorted(t for _, t in near)
    # another unit: cuts fall behind graphemes
    whole = capture_fim.fill_in_middle(documents(spark, [(i, "é" * 9) for i in range(40)]), unit=r"\X").collect()
    assert all(r.n == 9 and (r.form == "plain" or r.prefix_chars % 2 == r.middle_chars % 2 == 0) for r in whole)
    with pytest.raises(Exception, match="tile"):
        capture_fim.fill_in_middle(documents(spark, [(1, "a1")]), unit="[a-z]").collect()


@pytest.mark.parametrize("unit", [capture_fim.UNIT, r"\X", r"\S+\s*|\s+"])
def test_windows_give_the_ends_of_one_match(unit):
    import regex

    units = regex.compile(f"({unit})*")
    for text in [*texts(60, 5), "e\u0301" * 100, "a" * 500 + " b", " " * 300]:
        for window in (1, 2, 7, 64):
            assert list(capture_fim.unit_ends(units, text, window)) == units.fullmatch(text).ends(1)
    with pytest.raises(ValueError, match="tile"):
        capture_fim.unit_ends(regex.compile("([a-z])*"), "abc1def", 3)


def test_very_long_text():
    import regex

    text = "ab c" * 3_000_000
    ends = capture_fim.unit_ends(regex.compile(f"({capture_fim.UNIT})*"), text)
    assert len(ends) == len(text) and ends[0] == 1 and ends[-1] == len(text)


# centroid clustering

def brute_clusters(rows, k, rounds, dimensions):
    kept = [(i, [math.floor(1024.0 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in first]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cents)]
    out = [(i, near(v)) for i, v in kept]
    per = {}
    for _, (d, j) in out:
        per[j] = per.get(j, 0) + d
    return sorted(((i, j, d, per[j], sum(per.values()), cents[j]) for i, (d, j) in out), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<double>, label int, cluster int").repartition(3)


def planted(n, dimensions, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dimensions))
    rows = [(int(i), (centres[i % 5] + 0.3 * rng.normal(size=dimensions)).tolist()) for i in range(n)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (n, None), (n + 1, []), (n + 2, [1.0] * (dimensions - 1)), (None, rows[0][1]), (n + 3, [0.0] * dimensions)]
    rows += [(n + 4 + j, [x, *rows[j][1][1:]]) for j, x in enumerate((None, math.nan, math.inf, -math.inf))]
    return rows + [(n + 50 + j, rows[1][1]) for j in range(200)]  # a third are the same


@pytest.mark.parametrize("k,rounds,block", [(8, 10, 4096), (8, 3, 7), (1, 2, 64), (700, 1, 64)])
def test_clusters(spark, monkeypatch, k, rounds, block):
    monkeypatch.setattr(table_kmeans, "BLOCK", block)
    rows = planted(300, 6, 4)
    got = table_kmeans.clusters(vectors(spark, rows), k, rounds, dimensions=6).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_clusters(rows, k, rounds, 6)


def test_clusters_odd_tables(spark):
    for rows in ([], [(1, [1.0]), (2, None)]):
        assert table_kmeans.clusters(vectors(spark, rows)).count() == 0
    with pytest.raises(Exception, match="131072"):
        table_kmeans.clusters(vectors(spark, [(1, [1e30] * 64), (2, [0.0] * 64)])).collect()
    far = [(1, [-131071.0] * 64), (2, [131071.0] * 64), (3, [0.0] * 64)]
    got = table_kmeans.clusters(vectors(spark, far), 1, 0).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_clusters(far, 1, 0, 64)


def test_clusters_sql(spark):
    """The query's SQL on a table with ties and odd rows."""
    rows = [r for r in planted(150, 64, 9) if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [[i, v] for i, v in rows])
    digest = hashlib.sha256
    want = [(i, j, d, p, s, digest(",".join(map(str, c)).encode()).hexdigest()) for i, j, d, p, s, c in brute_clusters(rows, 8, 10, 64)]
    assert sorted(con.execute(_kmeans()).fetchall(), key=str) == sorted(want, key=str)


# chunked BPE

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = chunk_bpe.read_ranks(tokenizer_path(MULTI_RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks, public_tokenizers.PATTERN


def test_merges_and_classes(library):
    encoding, ranks, pattern = library
    own = chunk_bpe.Vocabulary(ranks, pattern, *chunk_bpe.class_differences(pattern))
    every = "".join(map(chr, chunk_bpe.chain_points()))
    for text in [every, "'".join(every[:5000]), *texts(2000, 2, 30), "a" * 5000, "ab" * 4000, " " * 999, "\n" * 50 + "x", "hello'", "'s're've", "it'S"]:
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == encoding.encode_ordinary(text)


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 10), (16, 8), (16, 16), (64, 12), (7, 5)])
def test_chunks(spark, library, chunk, overlap):
    """Whatever the chunks, all ids are the library's; small overlaps leave documents apart."""
    encoding, _, pattern = library
    rows = [r for r in SOME if chunk > 1000 or len(r[1] or "") < 4000]
    path = tokenizer_path(MULTI_RANKS)
    encoded = chunk_bpe.encode_texts(documents(spark, rows), path, pattern, chunk, overlap)
    got = chunk_bpe.decode_ids(encoded, path).collect()
    want = [(i, np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode("utf-8")) for i, t in rows]
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got), key=str) == sorted(want, key=str)


def test_chunks_odd_tables(spark, library):
    path, pattern = tokenizer_path(MULTI_RANKS), library[2]
    assert chunk_bpe.decode_ids(chunk_bpe.encode_texts(documents(spark, []), path, pattern), path).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        chunk_bpe.encode_texts(documents(spark, []), path, pattern, 8, 2)
    with pytest.raises(Exception, match="leaves a part"):
        chunk_bpe.encode_texts(documents(spark, [(1, "a b")]), path, r"\p{L}+").collect()


def test_queries(spark):
    """All rows of a whole table against the libraries."""
    import public_tokenizers
    import tiktoken

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=chunk_bpe.read_ranks(tokenizer_path(MULTI_RANKS)), special_tokens={})
    want = []
    for r in docs:
        ids = np.array(encoding.encode_ordinary(r.text or ""), "<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in queries.op13_chunk_bpe(spark, d).collect()) == sorted(want)
