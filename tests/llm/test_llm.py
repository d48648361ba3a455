"""The operators against brute force, and their defined results for odd tables."""

import base64
import collections
import hashlib
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from visitlake.llm import brown_lm, dart_minhash, decontaminate, exact_dedup, line_dedup, prefix_bpe, quality_cnn, sharding, token_frames, warc
from visitlake.llm.common import Ranges, new_file, shared_folder
from visitlake.llm.queries import BYTE_MODEL, PIECE_MODEL, tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string"
LONG = " ".join(f"word{i} and" for i in range(20_000))
BASE = " ".join(f"alpha{i}" for i in range(60))
ROWS = [
    (1, "Hello world again and again", "en", "a", 5, "x", "y"),
    (2, "Hello world again and again", None, "b", None, None, None),
    (2, "Hello world again and again", None, "b", None, None, None),
    (3, None, None, None, None, None, None),
    (4, "", "en", "a", 0, "x", "y"),
    (None, "only text\n\n  spaced \t out ", "en", "c", 3, "x", "y"),
    (5, LONG, "en", "a", 9, "x", "y"),
    (6, BASE, "en", "a", 9, "x", "y"),
    (7, BASE.replace("alpha59", "omega"), "en", "a", 9, "x", "y"),
    (8, "ééé ßß 中文 😀 <|endoftext|> <s> ▁x", "en", "a", 9, "x", "y"),
    (9, "!!! ???", "en", "a", 9, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def saved(spark, df):
    path = shared_folder(spark, "test") + "/documents.parquet"
    df.write.parquet(path)
    return path


def weak(text):
    return F.substring(F.sha2(text, 256), 1, 1)


@pytest.mark.parametrize("digest,batch", [(exact_dedup.sha256, None), (exact_dedup.sha256, 1), (weak, None)])
def test_exact_dedup(spark, docs, digest, batch):
    got = exact_dedup.exact_duplicates(spark, saved(spark, docs), digest, batch).collect()
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(ROWS)
    kept = collections.Counter()
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_exact_dedup_empty(spark, none):
    assert exact_dedup.exact_duplicates(spark, saved(spark, none)).count() == 0


def test_hypergeometric_law():
    rng = np.random.default_rng(3)
    draws = [sharding.hypergeometric(30, 50, 20, u) for u in rng.random(4000)]
    assert abs(np.mean(draws) - 7.5) < 0.15 and abs(np.var(draws) - 20 * 30 * 50 * 60 / (80 * 80 * 79)) < 0.3
    assert sharding.hypergeometric(10**11, 10**12, 10**7, 0.5) == pytest.approx(10**7 / 11, rel=0.01)
    m = np.array(sharding.communication_matrix([5, 0, 17, 3], sharding.shard_sizes(25, 4), 1))
    assert m.sum(0).tolist() == [7, 6, 6, 6] and m.sum(1).tolist() == [5, 0, 17, 3]


@pytest.mark.parametrize("rows,shards", [(0, 4), (3, 7), (1000, 7)])
def test_shards(spark, rows, shards):
    df = spark.range(rows).select((F.col("id") % 3).alias("k"), F.lit("z").alias("shard")).repartition(5)
    got = sharding.hypergeometric_shards(df, shards, [F.col("k")]).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == rows
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((len(s) for s in slots.values()), reverse=True) == [n for n in sharding.shard_sizes(rows, shards) if n]


def test_line_dedup(spark, none):
    rows = [(i, f"own line {i}\nshared\n shared \n\nmine", f"s{i % 12}") for i in range(24)] + [(99, None, "x"), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate_lines(df, 10).collect()}
    assert len(got) == 26 and got[99].text is None and got[None].text == ""
    assert got[0].text == "own line 0\nshared\n\nmine" and got[0].line_dedup.n_removed == 1
    assert got[5].text == "own line 5\n" and got[5].line_dedup.n_removed == 3
    few = line_dedup.drop_boilerplate_lines(df, 13)
    assert few.where("line_dedup.n_removed > 0").count() == 0
    assert line_dedup.drop_boilerplate_lines(none).count() == 0


def test_prefix_table_matches_library(docs, none):
    import random

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    with open(tokenizer_path(PIECE_MODEL), "rb") as f:
        table = prefix_bpe.PrefixTable(f.read())
    rng = random.Random(1)
    parts = ["a", " ", "  ", "\n", "er", "the", "▁", "\t", "é", "中", "😀", "12", "ing", "http://", "\x00", "=="]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)] + [r[1] or "" for r in ROWS]
    for text, want in zip(texts, sp.encode(texts, add_bos=True, add_eos=True), strict=True):
        assert table.encode(text).tolist() == want
    got = {r.doc_id: r for r in prefix_bpe.piece_ids(docs, tokenizer_path(PIECE_MODEL)).collect()}
    assert got[3].n_tokens == got[4].n_tokens == 2
    assert got[5].decoded_sha256 == hashlib.sha256(sp.decode(sp.encode(LONG)).encode()).hexdigest()
    assert prefix_bpe.piece_ids(none, tokenizer_path(PIECE_MODEL)).count() == 0


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(BYTE_MODEL))
    tok.encode_special_tokens = True
    folder = shared_folder(spark, "test-tokens")
    manifest = token_frames.write_token_files(docs, tokenizer_path(BYTE_MODEL), folder, frame_bytes=64)
    got = sorted(token_frames.read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: -1 if i is None else i)
    want = {r[0]: tok.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in ROWS}
    at = 0
    for r in got:
        ids = want[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    some = token_frames.read_token_files(manifest, folder, spark.createDataFrame([(6,)], "doc_id long")).collect()
    assert [r.n_tokens for r in some] == [len(want[6])]
    with new_file(folder, "frames", ".zst") as (name, out):
        writer = token_frames.FrameWriter(out, 2, 64)
        for i in range(50):
            writer.add(i, np.full(i, i, "<u2").tobytes())
        writer.close()
    reader = token_frames.FrameReader(Ranges(folder), name)
    assert len(reader.frames) > 10
    assert [(i, at, ids.tolist()) for i, at, ids in reader.documents([49])] == [(49, sum(range(49)), [49] * 49)] and reader.read_frames == 1
    assert [len(ids) for _, _, ids in reader.documents()] == list(range(50))
    files = Ranges(folder)
    whole = zstandard.ZstdDecompressor().stream_reader(files.read(name, 0, files.size(name)), read_across_frames=True).read()
    assert len(whole) >= int(reader.frames[:, 1].sum())
    assert token_frames.token_files(none, tokenizer_path(BYTE_MODEL)).count() == 0


def test_warc(spark):
    rows = [(i, f"http://host{i % 3}.example.org/p?q={i % 5}", "same" if i % 2 else f"page {i}", "c") for i in range(40)]
    rows += [(100, None, None, None), (101, "not a url [", "", "c"), (101, "not a url [", "", "c"), (None, "http://x/", "same", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, surt string").repartition(3)
    folder = shared_folder(spark, "test-warc")
    captures = warc.write_archives(pages, folder)
    shards = warc.write_index(captures, folder, lines=3)
    found = warc.lookup(pages.select("url"), shards, folder)
    got = warc.read_records(found, folder).collect()
    top = collections.defaultdict(lambda: None)
    for i, _, h, _ in rows:
        top[h or ""] = max((x for x in (i, top[h or ""]) if x is not None), default=None)
    want = [
        (i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if top[h or ""] == i else ("revisit", top[h or ""])))
        for i, _, h, _ in rows
    ]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    one = warc.lookup(spark.createDataFrame([("https://HOST1.example.org/p?q=1#top",)], "url string"), shards, folder).collect()
    assert sorted(r.page_id for r in one) == [i for i in range(40) if i % 3 == 1 and i % 5 == 1]
    assert warc.archived(pages.limit(0)).count() == 0


def test_quality(spark, docs, none):
    rng = np.random.default_rng(0)
    words = ["the", "river", "stone", "walks", "under", "green", "light"]
    good = [(i, " ".join(rng.choice(words, 40))) for i in range(200)]
    bad = [(1000 + i, "!! ".join(x.upper() for x in rng.choice(words, 40))) for i in range(200)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), "x") for i, _ in good + bad] + [(None, 1, "x"), (5000, None, "x")], "doc_id long, quality int, text string")
    got = quality_cnn.quality_scores(df, labels).where(quality_cnn.fold(F.col("doc_id")) == 0).collect()
    assert np.mean([(r.quality_score >= 0.5) == (r.doc_id < 1000) for r in got]) > 0.95
    odd = quality_cnn.quality_scores(docs, labels, df)
    assert odd.columns == [*docs.columns, "quality_score"] and odd.where("quality_score between 0 and 1").count() == len(ROWS)
    assert quality_cnn.quality_scores(none, labels, df).count() == 0
    assert quality_cnn.quality_scores(docs, labels.limit(0)).where("quality_score = 0.5").count() == len(ROWS)


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(
        [(1, BASE[60:400]), (2, None), (3, ""), (4, "Hello, WORLD again and again!"), (5, "no such words are here at all"), (6, "hello world")], "item_id long, text string"
    )
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect()}
    assert got == {(6, 1), (7, 1), (1, 4), (2, 4)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items, block=2).collect()} == got
    assert decontaminate.contained_items(none, items).count() == 0 and decontaminate.contained_items(docs, items.limit(0)).count() == 0
    clean = decontaminate.without_items(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 5


def test_dart_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    u = np.sort(rng.integers(0, 1 << 62, 500).astype(np.uint64))
    for weights in (np.ones(500), rng.uniform(0.2, 9.0, 500)):
        a, b = (u[:450], weights[:450]), (u[50:], weights[50:])
        x, y = (dart_minhash.dart_signature(*s, 2000) for s in (a, b))
        assert (x == y).mean() == pytest.approx(dart_minhash.similarity(a, b), abs=0.05)


def test_near_duplicates(spark, docs, none):
    got = {(r.doc_id, r.text_key): r for r in dart_minhash.near_duplicate_classes(docs).collect()}
    ids = {r.doc_id: r for r in got.values()}
    assert ids[6].class_id == ids[7].class_id == 6 and ids[6].kept and not ids[7].kept
    assert ids[1].class_id == ids[2].class_id == 1 and ids[1].class_size == 3
    assert ids[3].class_id == ids[4].class_id == 3 and ids[9].class_size == 1
    left = dart_minhash.one_of_each_class(docs)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 4
    assert dart_minhash.near_duplicate_classes(none).count() == 0 and dart_minhash.one_of_each_class(none).count() == 0


def test_brown(docs, none):
    got = {r.doc_id: r for r in brown_lm.brown_scores(docs).collect()}
    assert got[3].n_tokens == got[4].n_tokens == 1 and got[5].n_tokens == 40_001
    assert all(r.score < 0 and r.perplexity > 1 for r in got.values())
    assert brown_lm.brown_scores(none).count() == 0
    only = brown_lm.brown_scores(docs.where(brown_lm.held_out(F.col("doc_id"))))
    assert only.where("n_known > 0 or train_tokens > 0").count() == 0


def test_exchange_raises_likelihood():
    matrix = np.zeros((brown_lm.GROUPS, brown_lm.GROUPS))
    matrix[0, 1] = matrix[1, 0] = 100
    left, right = np.zeros(brown_lm.GROUPS), np.zeros(brown_lm.GROUPS)
    left[0], right[0] = 10, 10  # between words of class 0: belongs with class 1
    matrix[2] += right
    matrix[:, 2] += left
    assert brown_lm.best_class(matrix, 2, left, right) == 2  # alone in its class nothing is gained: a tie
    matrix[2, 3] = matrix[3, 2] = 50  # its class also holds words of another context
    assert brown_lm.best_class(matrix, 2, left, right) == 1


def test_pipeline(spark, docs, none):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    for table in (docs, none):
        for _, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, table, d)
            assert out.count() <= table.count()
            assert stage is corpus_pipeline.encoding or out.columns == table.columns
