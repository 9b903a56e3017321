"""Odd rows in every operator and pipeline stage: nulls, long texts, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_ops import prose, shingles

from tessella.llm import bpe_codec, cap_filters, main_text, mixing, near_dedup, order_minhash, repeats, secrets, token_files, toxicity

CLASHES = "size key bucket tie part kind label score name vector filters share row words n_tokens spans id rep signs place host held_out found component".split()
LONG = prose(77, 90_000) + ' password = "q1w2e3r4t5y6u7i8" ' + prose(78, 3000)
ROWS = [
    (None, None, None), (None, "null id", "a"), (None, "null id", "a"), (3, None, None), (4, "", "b"), (5, LONG, "a"), (5, LONG, "a"), (6, LONG + " more", "b"),
    (7, "same text", "a"), (8, "same text", "a"), (9, "  odd \U0001f642 blanks  ", None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in CLASHES)).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def by_text(rows, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in rows)


def test_lengths_of_the_fixture():
    assert len(LONG.encode()) > 600_000  # more than one block


def test_codecs(docs, empty):
    from tokenizers import Tokenizer

    word, byte = (Tokenizer.from_file(m.default_vocabulary()) for m in (bpe_codec, token_files))
    ids = {t: word.encode(t or "", add_special_tokens=False).ids for _, t, _ in ROWS}
    want = collections.Counter((i, len(ids[t]), " ".join(map(str, ids[t])), word.decode(ids[t], skip_special_tokens=False)) for i, t, _ in ROWS)
    assert by_text(bpe_codec.encode(docs).collect(), "doc_id", "n_tokens", "ids", "decoded") == want
    assert bpe_codec.encode(empty).count() == bpe_codec.encode(empty, digests=True).count() == 0
    packed = {t: np.asarray([*byte.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t, _ in ROWS}
    want = collections.Counter((-(2**63) if i is None else i, len(packed[t]), zlib.crc32(packed[t].tobytes())) for i, t, _ in ROWS)
    assert by_text(token_files.round_trip(docs).collect(), "doc_id", "n_tokens", "ids_crc32") == want
    assert token_files.round_trip(empty).count() == 0


def test_fingerprints(docs, empty):
    got = order_minhash.fingerprint_edits(docs).collect()
    assert by_text(got, "doc_id", "n_chars") == collections.Counter((i, len(t or "")) for i, t, _ in ROWS)
    long = [r.fingerprint for r in got if r.doc_id == 5]
    assert len(set(long)) == 1 and len({r.fingerprint for r in got if r.doc_id in (7, 8)}) == 1
    assert order_minhash.fingerprint_edits(empty).count() == 0


def test_repeats(docs, empty):
    first = {}
    rank = lambda i: 2**63 if i is None else i
    for i, t, _ in ROWS:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], 2**64), rank(i))
    want = collections.Counter()
    for i, t, _ in ROWS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < rank(i):
                gone[k : k + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[(i, len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert by_text(repeats.remove_repeats(docs).collect(), "doc_id", "n_bytes", "n_removed", "kept_sha256") == want
    assert repeats.remove_repeats(empty).count() == 0


def test_mixing(docs, empty):
    words = {t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in ROWS}
    got = mixing.mix(docs).collect()
    assert by_text(got, "doc_id", "size") == collections.Counter((i, words[t]) for i, t, _ in ROWS)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    made = mixing.materialize_mix(docs)
    assert made.columns == docs.columns and mixing.materialize_mix(empty).count() == 0
    taken, sizes = collections.Counter(), collections.Counter()
    for r in got:
        taken[r.doc_id] += r.taken
    for r in made.collect():
        sizes[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert +taken == +sizes


def test_near(docs, empty):
    got = near_dedup.near_components(docs).collect()
    assert by_text(got, "doc_id", "n_shingles") == collections.Counter((i, len(shingles(t or ""))) for i, t, _ in ROWS)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id} == {(3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (8, 7), (9, 9)}
    assert near_dedup.near_components(empty).count() == 0


def test_secrets(docs, empty):
    model = secrets.fit(docs)
    got = secrets.scan(docs, model).collect()
    at = re.search(r'password = "\w+', LONG).span()
    assert by_text(got, "doc_id", "n_assign") == collections.Counter((i, int(len(t or "") > 1000)) for i, t, _ in ROWS)
    assert all(f"assign:{at[0]}:{at[1]}" in r.spans.split(",") for r in got if r.doc_id in (5, 6))
    cleaned = secrets.redact(docs, model)
    assert cleaned.columns == docs.columns and not any("q1w2e3r4" in (r.text or "") for r in cleaned.collect())
    assert secrets.scan(empty, secrets.fit(empty)).count() == secrets.redact(empty, model).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, 0, i % 2, "x") for i in (3, 4, 5, 6, 7, 8, 9)] + [(None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert by_text(got, "doc_id") == collections.Counter((i,) for i, _, _ in ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(docs, labels.where("false")).count() == len(ROWS)


def test_pages(spark):
    long = " ".join(f"word{k}" for k in range(120_000))
    rows = [(1, "http://a/", f"<article><p>{long}</p></article>")] * 2 + [(None, None, None), (2, None, "<p>x</p>"), (2, "http://a/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit("x").alias(c) for c in [*CLASHES, "pages", "keys", "places", "n_chars", "text"]))
    got = main_text.main_texts(pages).collect()
    assert by_text(got, "page_id", "text") == collections.Counter([(1, long)] * 2 + [(None, ""), (2, "x"), (2, "")])
    assert main_text.main_texts(pages.where("page_id < 0")).count() == 0


def test_vectors(spark):
    v = np.random.default_rng(0).normal(size=8).tolist()
    rows = [(1, v, 1), (1, v, 1), (2, v, 1), (None, v, 1), (3, v, None), (4, None, 1), (5, v, 2), (6, [-x for x in v], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *(F.lit("x").alias(c) for c in CLASHES if c != "label"))
    got = by_text(cap_filters.near_vectors(table).collect(), "vec_id", "n_links", "component_id", "kept")
    assert got == collections.Counter({(1, 2, 1, True): 2, (2, 2, 1, False): 1, (None, 0, None, True): 1, (3, 0, 3, True): 1, (4, 0, 4, True): 1, (5, 0, 5, True): 1, (6, 0, 6, True): 1})
    assert cap_filters.near_vectors(table.where("vec_id < 0")).count() == 0


def test_pipeline_stages(spark, docs, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, 1, int(i in (4, 7))) for i in (3, 4, 5, 6, 7, 8, 9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.drop(*CLASHES)):
            out = stage(spark, table, str(tmp_path))
            if name != "bpe_codec":
                assert out.columns == list(corpus_pipeline.COLUMNS), name
            assert 0 < out.count() <= 3 * len(ROWS), name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("width", [1, 4, 32])
def test_host_repeats_by_brute_force(spark, width):
    """Runs on two pages of a host go, whatever the number of partitions and chunks."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    passages = [" ".join(rng.choice(words, int(n))) for n in rng.integers(6, 14, 12)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choice(words, int(rng.integers(3, 20)))) for _ in range(3)] + [passages[k] for k in rng.integers(0, 12, 2)]
        rows.append((i, f"http://h{i % 3}.org/", "".join(f"<p>{parts[k]}</p>" for k in rng.permutation(5))))
    want = {}
    for h in range(3):
        pages = {i: [b.split() for b in re.findall(r"<p>(.*?)</p>", html)] for i, u, html in rows if u == f"http://h{h}.org/"}
        flat = {i: [w for b in bs for w in b] for i, bs in pages.items()}
        seen = collections.defaultdict(set)
        for i, ws in flat.items():
            for k in range(len(ws) - 7):
                seen[tuple(ws[k : k + 8])].add(i)
        for i, ws in flat.items():
            gone = [False] * len(ws)
            for k in range(len(ws) - 7):
                if len(seen[tuple(ws[k : k + 8])]) > 1:
                    gone[k : k + 8] = [True] * 8
            want[i] = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(width)
    got = {r.page_id: r.text for r in main_text.main_texts(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want and any(len(want[i]) < len(re.sub("<.*?>", "", h)) for i, _, h in rows)


def test_shared_folders(spark):
    from types import SimpleNamespace as Fake

    from tessella.llm import common

    unset = Fake(isDefined=lambda: False)
    context = Fake(master="spark://host:7077", _jsc=Fake(sc=lambda: Fake(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Fake(conf=Fake(get=lambda key, default: default), sparkContext=context))
    assert common.shared_dir(Fake(conf=Fake(get=lambda key, default: "s3://all/of/us"))) == "s3://all/of/us"
    before = list(common.held_folders(spark))
    one, two = (common.stored(spark.range(n), "test") for n in (3, 4))
    held = [p for p in common.held_folders(spark) if p not in before]
    assert len(held) == 2
    common.release(spark, keep=[*before, held[1]])
    assert two.count() == 4 and common.held_folders(spark) == [*before, held[1]]
    with pytest.raises(Exception, match="(?i)not.*exist|no such file"):
        one.collect()
