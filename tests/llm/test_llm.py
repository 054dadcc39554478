"""The training-data operators against brute force, exact round trips and held-out accuracy; odd inputs."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from docspeak.llm import bpe, common, imatch, language_id, media, ngram_join, packing, quality, queries, substring_dedup, toxicity, warc
from docspeak.llm.textvec import as_bytes, sliding_argmin, span_hashes, word_spans

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, u string"


def words(n, seed, top=400):
    r = random.Random(seed)
    return [f"w{r.randrange(top)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names."""
    shared = " ".join(words(50, 1))
    texts = [None, "", " \n\t ", "a", "It's 12 ½ naïve 中文 🎉\n\n  end ", shared, "x " + shared + " y", " ".join(words(30_000, 2)), "same text here", "same text here", "la " * 200]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", 0, 1.0, "u") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_textvec():
    buf = as_bytes(" ab  c\x0bdé ")
    s, e = word_spans(buf)
    assert [buf.tobytes()[a:b] for a, b in zip(s, e)] == [b"ab", b"c", "dé".encode()]
    x = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    assert sliding_argmin(x, 20).tolist() == [i + int(x[i : i + 20].argmin()) for i in range(181)]
    assert len(set(span_hashes(buf, s, e).tolist())) == 3


def test_bpe(odd, empty):
    ranks = bpe.read_ranks(P.path(queries.RANKS))
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in bpe.round_trip(odd, ranks, P.PATTERN).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    coded = bpe.encode(odd.where("doc_id = 4"), ranks, P.PATTERN)
    assert bytes(bpe.decode(coded, ranks, P.PATTERN).first()["decoded"]) == texts[4].encode()
    assert bpe.round_trip(empty, ranks, P.PATTERN).count() == 0


def test_bpe_long_words(monkeypatch):
    """Words of any length, and the batched steps against single ones."""
    ranks = bpe.read_ranks(P.path(queries.RANKS))
    codec = bpe.Codec(ranks, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(3)
    texts = ["a" * 20_000, "".join(r.choice("etaoinshr") for _ in range(5_000)), "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(300)), " " * 3_000 + "x"]
    short = ["".join(r.choice("theinga"[: r.randrange(2, 8)]) for _ in range(r.randrange(2, 200))) for _ in range(40)]
    for t in texts:
        got = codec.codes([t])
        assert got[0] == " ".join(map(str, enc.encode_ordinary(t))) and codec.decode_runs(*codec.ids(got)) == [t.encode()]
    monkeypatch.setattr(bpe, "LONG_BYTES", 1)
    monkeypatch.setattr(bpe, "QUERY_STATES", 1_000)
    monkeypatch.setattr(bpe, "QUERY_IDS", 7)
    coded = codec.codes([None, short[0], "", "".join(short), "é🎉"])
    assert codec.decode_runs(*codec.ids(coded)) == [b"", short[0].encode(), b"", "".join(short).encode(), "é🎉".encode()]
    assert [codec.encode_words([t.encode()])[0].tolist() for t in short] == [enc.encode_ordinary(t) for t in short]


def held_out(spark, name, column):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.QUERIES[name](spark, SF).where("held_out").join(labels, "doc_id").collect()
    return [(r["predicted"], r[column]) for r in rows]


def test_quality(spark, odd, empty):
    got = held_out(spark, "op2_quality", "quality")
    assert sum(a == b for a, b in got) >= 0.95 * len(got)
    model = quality.train([], {})
    assert {r["score"] for r in quality.score(odd, model).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_toxicity(spark, odd):
    got = held_out(spark, "op8_toxicity", "toxic")
    assert sum(a == b for a, b in got) >= 0.93 * len(got)
    assert toxicity.score(odd, toxicity.train([], {})).count() == 13


def test_toxicity_of_a_sample():
    """Classes cut to equal numbers leave the odds of the whole labels, and weights as they are."""
    rows = [(k, " ".join(["foul"] * (k % 2) + words(20, k, 40)), k % 2) for k in range(200)]
    even, rare = toxicity.train(rows, {0: 100, 1: 100}), toxicity.train(rows, {0: 10_000, 1: 100})
    assert np.isclose(rare.bias, even.bias - np.log(100)) and np.array_equal(rare.weights, even.weights)


def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op4_language(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows if r["lang"]]) >= 0.95
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, language_id.fit(odd)).collect()}
    assert got[0] == got[1] == got[2] == "und"
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0


def test_language_with_little_text(spark):
    """One row of a stray language leaves the other languages their text, and doesn't win their documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    stray = spark.createDataFrame([(10**9 + k, "aa", "this is a text of thirty chars") for k in range(8)], docs.schema.simpleString()[7:-1].replace(":", " "))
    texts = language_id.fit(docs.unionByName(stray.where("crc32(string(doc_id)) % 4 <> 2").limit(1)))
    assert len(texts["aa"]) == 30 and all(len(v) == language_id.FIT_CHARS for k, v in texts.items() if k != "aa")
    rows = docs.where("lang is not null and length(text) > 200 and crc32(string(doc_id)) % 4 = 2").collect()
    got = language_id.Parser(texts).predict([r["text"][:120] for r in rows])[0]
    assert np.mean([g == r["lang"] for g, r in zip(got, rows, strict=True)]) >= 0.95
    short = language_id.Parser({k: v[:500] if k == "de" else v for k, v in texts.items() if k != "aa"})
    assert np.mean([g == r["lang"] for g, r in zip(short.predict([r["text"] for r in rows])[0], rows, strict=True)]) >= 0.95


def test_language_of_long_or_missing_texts(spark, monkeypatch):
    """Rows without usable text aren't numbered, and a long text is used in part."""
    monkeypatch.setattr(language_id, "FIT_ROWS", 2)
    rows = [(k, "aa", t) for k, t in enumerate([None, "", "12 !", "_"] * 10)] + [(k, "aa", "un texte utile") for k in range(100, 104)]
    rows += [(k, "bb", "1 " * 15_000 + "long words " * 3_000) for k in range(200, 204)]
    texts = language_id.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert texts["aa"] == "un texte utile un texte utile" and texts["bb"] == ("long words " * 3_000)[: language_id.FIT_CHARS]


@pytest.mark.parametrize("piece", [1024, 5, 1])
def test_phrases_by_brute_force(monkeypatch, piece):
    """Of a whole text, however it is cut into pieces."""
    monkeypatch.setattr(language_id, "PIECE", piece)
    text = "abracadabra banana bandana banana abracad bandana xyz bananabracadabra"
    parser = language_id.Parser({"a": "banana bandana", "b": "abracadabra"})
    counts, chars = parser.phrases([text])
    for k, lang in enumerate(parser.langs):
        known, i, n = {"a": "banana bandana", "b": "abracadabra"}[lang], 0, 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i : j + 1] in known:
                j += 1
            i, n = j, n + 1
        assert counts[k, 0] == n and chars[0] == len(text)


def brute_windows(texts, window=35):
    split = [[w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    seen = {}
    for ws in split:
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for ws in split:
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup(odd, empty):
    rows = odd.collect()
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.deduplicate(odd).collect())
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *b) for r, b in zip(rows, brute_windows([r["text"] for r in rows])))
    assert got == want
    assert substring_dedup.deduplicate(empty).count() == 0


def test_subtrees_by_brute_force():
    """Order and common prefixes of all suffixes of a group, against sorting word lists."""
    r = random.Random(9)
    rows = [[r.choice("abc") for _ in range(r.randrange(6, 30))] for _ in range(12)]
    groups, counts = np.array([k % 3 for k in range(12)]), np.array([len(w) - 5 for w in rows])
    order, depth = substring_dedup.subtrees(groups, [" ".join(w).encode() for w in rows], counts, 6)
    suffixes = [(g, w[i : i + 6]) for g, w, n in zip(groups.tolist(), rows, counts.tolist()) for i in range(n)]
    assert sorted(order.tolist()) == list(range(len(suffixes))) and depth[0] == 0
    for a, b, d in zip(order[:-1].tolist(), order[1:].tolist(), depth[1:].tolist()):
        (g, x), (h, y) = suffixes[a], suffixes[b]
        assert d == (next((k for k in range(6) if x[k] != y[k]), 6) if g == h else 0)
    got = substring_dedup.repeated(groups, [" ".join(w).encode() for w in rows], counts, 6)
    assert got.tolist() == [suffixes.count(x) > 1 for x in suffixes]


def test_substring_dedup_of_regular_words_and_hot_groups(spark, monkeypatch):
    """Words of regular build are told apart; groups over the memory bound give the same as small ones."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    rest = words(34, 3)
    texts = [" ".join([word, *rest]), " ".join([word.translate(str.maketrans("ab", "ba")), *rest])]
    passage = words(60, 4)
    texts += [" ".join([*words(k % 7, k, 9), *passage, *words(3 + k % 5, k + 50, 9), *(passage[:40] if k % 4 == 0 else [])]) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(k, *b) for k, b in enumerate(brute_windows(texts))]
    assert want[0][2] == want[1][2] == 0 and all(w[2] >= 60 for w in want[2:])
    assert sorted(tuple(r) for r in substring_dedup.deduplicate(df, keep=["doc_id"]).collect()) == want
    spans = substring_dedup.repeats(df, hot=5)
    rows = df.withColumns({"u": F.xxhash64("text"), "u2": F.xxhash64("text", F.lit(1))}).join(spans, ["u", "u2"], "left").collect()
    got = [(r["doc_id"], *substring_dedup.kept_words(r["text"], r["spans"], r["copied"], 35)[:2]) for r in rows]
    assert sorted(got) == [w[:3] for w in want]


def test_packing(spark, odd, empty):
    """No bin over its capacity, whatever ids rows have; every byte of every row is packed once."""
    big = spark.createDataFrame([(1, "x" * 10_000), (1, "x" * 10_000), (None, "y" * 10_000), (None, None), (None, None)], "doc_id long, text string")
    docs = odd.unionByName(big, allowMissingColumns=True)
    rows = packing.pack(docs, F.xxhash64("text"), capacity=4096).collect()
    sources = {r["doc_id"]: r["source"] for r in odd.collect()}
    bins, want = {}, {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        ends = 0
        for r in sorted(own, key=lambda r: (r["bin_offset"], r["n_bytes"])):
            assert r["bin_offset"] == ends
            ends += r["n_bytes"]
        assert ends <= 4096
        named = [sources[r["doc_id"]] for r in own if r["doc_id"] not in (None, 1) and sources[r["doc_id"]]]
        assert len(named) == len(set(named))
    for r in docs.collect():
        n = len((r["text"] or "").encode())
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + n
    assert {i: sum(r["n_bytes"] for r in rows if r["doc_id"] == i) for i in want} == want
    assert sum(r["n_bytes"] == 0 for r in rows) == sum(not r["text"] for r in docs.collect())
    assert packing.pack(empty, F.xxhash64("text")).count() == 0


def test_packing_spreads_repeated_rows(spark):
    """Rows equal in all columns don't meet in one group."""
    rows = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"))
    got = packing.pack(rows, F.xxhash64("text"), group=20).collect()
    sizes = {}
    for r in got:
        sizes[r["bin_id"].split("-")[0]] = sizes.get(r["bin_id"].split("-")[0], 0) + 1
    assert len(got) == 400 and len(sizes) == 20 and max(sizes.values()) < 60 and len({r["bin_id"] for r in got}) == 400


def test_packing_keeps_near_copies_apart(spark, monkeypatch):
    """Near copies, copies up to case and rows without id of one text go to different bins, though their sources differ."""
    base = words(60, 8)
    near = [" ".join([*base[:k], "zz", *base[k + 1 :]]) for k in (0, 59)]
    texts = [" ".join(base), *near, near[0].upper(), " ".join(words(60, 9))]
    rows = [(k, t, f"s{k}") for k, t in enumerate(texts)] + [(None, near[1], "s8"), (None, texts[0], "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(queries, "_table", lambda *_: df)
    got = queries.op5_packing(spark, SF).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_bytes"]) for r in got if r["doc_id"] is not None) == [(False, k, len(t)) for k, t in enumerate(texts)] and len(got) == 7
    bins = [r["bin_id"] for r in got if r["doc_id"] != 4]
    assert len(set(bins)) == 6 and {r["bin_id"] for r in got if r["doc_id"] == 4} < set(bins)


def test_best_fit_by_brute_force():
    r = random.Random(4)
    items = sorted(((r.randrange(1, 50), 1 << r.randrange(9), r.choice([0, 1, 2, 4])) for _ in range(200)), reverse=True)
    bins, want = [], []
    for size, s, c in items:
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and not b[1] & s and not b[2] & c]
        if fits:
            _, i = min(fits)
        else:
            bins.append([100, 0, 0])
            i = len(bins) - 1
        want.append((i, 100 - bins[i][0]))
        bins[i] = [bins[i][0] - size, bins[i][1] | s, bins[i][2] | c]
    assert packing.best_fit(items, 100) == want


def test_warc(spark):
    long = "<p>" + "é" * 200
    pages = [(3, "http://a/b c", long), (1, None, long), (2, "http://x", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (1, None, long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.archive(df).collect()
    assert len(got) == 7
    same = [r for r in got if r["payload_bytes"] == len(long.encode())]
    assert sorted(r["record_type"] for r in same) == ["response", "revisit", "revisit", "revisit"]
    assert {r["refers_to"] for r in same if r["record_type"] == "revisit"} == {1}
    assert {r["payload_digest"] for r in same} == {hashlib.sha256(long.encode()).hexdigest()}
    assert warc.archive(df.where("page_id > 99")).count() == 0
    for version in (1, 2):
        data = warc.arc_start("n", version) + warc.arc_record("http://a b", b"H\r\n\r\nx\n\ny", version, 0, "n")
        assert [(r.uri, r.payload) for r in warc.parse_arc(data)] == [("http://a%20b", b"x\n\ny")]


def test_warc_files(spark):
    """Ids are unique and the same in each run, revisits name a response that there is, each record is a member; long payloads, other columns."""
    long, page = "z" * (5 << 20), "<p>" + "q" * 200
    rows = [(1, "http://a", page, "extra"), (1, "http://a", page, "extra"), (2, "http://b", page, None), (3, "http://c", long, None), (4, "http://d", "after", None), (5, "http://e", long, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string").coalesce(1)
    seen = []
    for _ in range(2):
        arc = warc.write_arc(df)
        path = warc.to_warc(spark, arc, warc.revisits(warc.list_arc(spark, arc)))
        files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
        fields = [f for c in files for f, _ in warc.parse_warc(warc.unpacked(c))]
        ids = [f["warc-record-id"] for f in fields]
        assert len(files) == 2 and len(ids) == len(set(ids)) == 8
        # each record's member, and the empty one that the writer ends a file with
        assert sum(c.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") for c in files) == 8 + 2
        kinds = {f["warc-record-id"]: f["warc-type"] for f in fields}
        refers = [f["warc-refers-to"] for f in fields if f["warc-type"] == "revisit"]
        assert len(refers) == 3 and all(kinds[i] == "response" for i in refers)
        seen.append(sorted(ids))
    assert seen[0] == seen[1]
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive(df).collect())
    n, m = len(page), len(long)
    assert got == [(1, "response", None, n), (1, "revisit", 1, n), (2, "revisit", 1, n), (3, "response", None, m), (4, "response", None, 5), (5, "revisit", 3, m)]


def test_ngram_join(spark, odd, empty):
    base = words(80, 5)
    near = [" ".join([*base[:k], "zz", *base[k + 1 :]]) for k in (0, 79)]
    rows = [(100, " ".join(base)), (101, near[0]), (102, near[1]), (103, " ".join(words(80, 6))), (104, " ".join(base)), (105, None), (106, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(ngram_join.shingles(t).tolist()) for _, t in rows]
    alike = lambda i, j: rows[i][1] == rows[j][1] or (sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) or not (rows[i][1] or rows[j][1])
    want = {d: sum(bool(alike(i, j)) for j in range(len(rows)) if j != i) for i, (d, _) in enumerate(rows)}
    got = {r["doc_id"]: r for r in ngram_join.join(df).collect()}
    assert {d: r["links"] for d, r in got.items()} == want
    assert got[104]["class_id"] == got[101]["class_id"] == 100 and got[103]["class_id"] == 103
    assert ngram_join.join(odd).count() == 13
    assert ngram_join.join(empty).count() == 0


def test_sketches_by_brute_force(monkeypatch):
    """Texts hashed together have the sketches of texts hashed alone, and MinHash agrees as often as sets are alike."""
    texts = [None, "", " ", "one", "a b c", "a b c d e", *(" ".join(words(7 * k, k)) for k in range(1, 40)), " ".join(words(9000, 1, 8000)), "tail of it"]
    for size in (1 << 20, 300):
        monkeypatch.setattr(ngram_join, "TEXT_BYTES", size)
        sigs, keys = ngram_join.sketches(texts)
        for t, sig, key in zip(texts, sigs, keys, strict=True):
            own = ngram_join.shingles(t)
            if not len(own):
                assert sig is None and key is None
                continue
            half = [int(x) >> 32 for x in own]
            order = [min((y := x * int(a) & 0xFFFFFFFF) ^ y >> 15 for x in half) for a in ngram_join._SEEDS]
            values = ngram_join.mix(np.array(order, dtype=np.uint64))
            assert sig == bytes(int(v) & 255 for v in values) and key == ngram_join.bands(values).tolist()[0]
    r = np.random.default_rng(2)
    alike = []
    for _ in range(60):
        a = r.integers(0, 1 << 63, 900).astype(np.uint64)
        b = np.concatenate([a[:800], r.integers(0, 1 << 63, 100).astype(np.uint64)])
        alike.append((ngram_join.minhash(a) == ngram_join.minhash(b)).mean())
    assert abs(np.mean(alike) - 0.8) < 0.02


def test_pipeline_stages(spark, odd, empty):
    """Near duplicates and passages on odd rows: one row of each group, rows without id stay, texts without repeats are unchanged."""
    import corpus_pipeline as pipeline

    shared = " ".join(words(50, 1))
    kept = pipeline.near_duplicate_stage(spark, odd, SF)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 2, 3, 4, 5, 7, 8, 10] and ids.count(None) == 1
    left = {r["doc_id"]: r["text"] for r in pipeline.passage_stage(spark, odd.where("doc_id in (3, 4, 6, 7)"), SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert left == {i: texts[i] for i in (3, 4, 6, 7)}
    two = spark.createDataFrame([(1, shared, None, None, 0, 0.0, ""), (2, "x " + shared + " y", None, None, 0, 0.0, "")], SCHEMA)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.passage_stage(spark, two, SF).collect()} == {1: ("", 0), 2: ("x y", 3)}
    assert pipeline.near_duplicate_stage(spark, empty, SF).count() == pipeline.passage_stage(spark, empty, SF).count() == 0


def test_pipeline_stages_leave_columns_alone(spark, odd, empty):
    """Whatever columns are called, stages but the last return them as they were; all stand odd rows and an empty table."""
    import corpus_pipeline as pipeline

    clash = {"predicted": F.lit(7), "lang_pred": F.lit("xx"), "n_words": F.lit(8), "n_removed": F.lit(9), "kept_text": F.lit("k"), "fits": F.lit("f"), "node": F.lit("n"), "class_id": F.lit(3), "a.b": F.lit(4)}
    docs = odd.withColumns(clash).withColumn("score", F.col("score") + 8)
    rest = [c for c in docs.columns if c not in ("text", "n_chars", "lang")]
    at = lambda r: tuple(r[c] for c in rest)
    every = [at(r) for r in docs.collect()]
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        rows = [at(r) for r in got.collect()]
        assert all(rows.count(r) <= every.count(r) for r in rows), name
        none = stage(spark, empty, SF)
        assert none.columns == empty.columns and none.count() == 0, name
    assert len(rows) == len(every)
    pieces = pipeline.packing_stage(spark, docs, SF).collect()
    assert sum(r["n_bytes"] for r in pieces) == sum(len((r["text"] or "").encode()) for r in odd.collect())
    assert pipeline.packing_stage(spark, empty, SF).count() == 0


def test_scratch_folders(spark):
    """What operators wrote goes when asked, but for what is kept."""
    since = common.mark()
    one, two = (common.saved(spark.range(k), "t") for k in (3, 4))
    common.clean(spark, since, keep=two)
    assert common.mark() == since + 1 and two.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(one.inputFiles()[0])
    common.clean(spark, since)
    assert common.mark() == since


def test_pipeline_language_stage(spark):
    """Texts that fit no learned language go; clean and short ones stay."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(1)
    odd_ones = ["γνώση και λόγος " * 9, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(600)), "123 !", None, "Ok"]
    more = spark.createDataFrame([(10**9 + k, t, None, "s", 0) for k, t in enumerate(odd_ones)], docs.schema)
    kept = {x["doc_id"] for x in pipeline.language_stage(spark, docs.unionByName(more), SF).collect()}
    assert {k for k in kept if k >= 10**9} == {10**9 + 4}
    clean = {x["doc_id"] for x in docs.where("length(text) > 100").select("doc_id").collect()}
    assert len(clean & kept) >= 0.999 * len(clean)


def test_pipeline_near_duplicates_by_class(spark):
    """Different texts of one id both stay; of copies among rows without id, or of rows with ids, one stays."""
    import corpus_pipeline as pipeline

    base, other, third, fourth = (" ".join(words(60, k)) for k in (21, 22, 23, 24))
    near = [" ".join([*t.split()[:-1], "zz"]) for t in (base, third)]
    rows = [(1, base), (1, other), (1, base), (2, near[0]), (None, near[0]), (None, third), (None, third), (None, near[1]), (3, fourth), (3, fourth + " zz"), (None, other)]
    got = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()]
    assert sorted(i for i, _ in got if i is not None) == [1, 1, 3] and len(got) == 4
    assert {t for i, t in got if i == 1} == {base, other} and [t for i, t in got if i is None][0] in (third, near[1])


def test_imatch(spark, odd):
    rows = [(i, " ".join(words(60, i))) for i in range(40)]
    df = spark.createDataFrame([*rows, (40, None), (41, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.compare_edits(df, imatch.lexicon(df)).collect()}
    texts = dict(rows) | {40: "", 41: ""}
    for i, t in texts.items():
        nxt, half = texts[i - 1 if i else 41], len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t) and 0 <= got[i]["near_next"] <= 1
    assert got[40]["fingerprint"] == got[41]["fingerprint"] and got[41]["near_next"] == 1
    assert imatch.compare_edits(odd, imatch.lexicon(odd)).count() == 13


def brute_fingerprints(spark, texts, low=imatch.LOW, high=imatch.HIGH):
    """Fingerprints by counting terms in Python; the term hashes alone are Spark's."""
    import re

    split = [{w for w in re.split(r"[\s!-/:-@\[-`{-~]+", t or "") if w} for t in texts]
    vocabulary = sorted(set().union(*split))
    if not vocabulary:
        return [["_"] * imatch.SUBSETS for _ in texts]
    rows = spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    h = {r["w"]: r["h"] for r in rows}
    times = {w: sum(w in s for s in split) for w in vocabulary}
    band = {w for w, k in times.items() if max(2.0, low * len(texts)) <= k <= max(2.0, high * len(texts))}
    wanted = []
    for s in split:
        terms = sorted(h[w] for w in (s & band or s))
        subsets = [[t for t in terms if not t & ((rate - 1) << ((5 * k + 3 * rate.bit_length()) % 57))] for rate in imatch.RATES for k in range(imatch.EACH)]
        wanted.append([terms if not any(subsets) else x for x in subsets])
    flat = spark.createDataFrame([(i, k, t) for i, x in enumerate(wanted) for k, t in enumerate(x)], "i int, k int, t array<bigint>")
    got = {(r["i"], r["k"]): r["x"] for r in flat.select("i", "k", F.xxhash64("t", "k").alias("x")).collect()}
    return [[f"{got[i, k] & ((1 << 31) - 1):x}" if t else "_" for k, t in enumerate(x)] for i, x in enumerate(wanted)]


def brute_likeness(a, b):
    both = [x == y for x, y in zip(a, b) if (x, y) != ("_", "_")]
    return sum(both) / len(both) if both else 1.0


@pytest.mark.parametrize("most", [imatch.MOST_TERMS, 3])
def test_imatch_by_brute_force(spark, most):
    """Lexicon, fingerprints and likeness, with the lexicon in the plan and joined; ids are spread unevenly."""
    texts = [" ".join(words(3 + 5 * (k % 9), k // 2 if k % 4 else 7, 150)) + (", End." if k % 3 else "") for k in range(90)] + ["", None, "one", "Ünï cödé!"]
    ids = [k if k % 5 else k * 10**15 for k in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.compare_edits(df, imatch.lexicon(df), most, 10).collect()}
    order = sorted(range(len(ids)), key=lambda k: -ids[k])
    plain = [t or "" for t in texts]
    follows = {k: order[(n + 1) % len(order)] for n, k in enumerate(order)}
    edited = [t[: len(t) - len(t) // 2] + plain[follows[k]][: len(t) // 2] for k, t in enumerate(plain)]
    fp = brute_fingerprints(spark, plain)
    for k, i in enumerate(ids):
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(edited[k].encode()).hexdigest()
        assert r["fingerprint"].split("-") == fp[k]
        assert np.isclose(r["near_next"], brute_likeness(fp[k], fp[follows[k]]))
        assert np.isclose(r["near_edited"], brute_likeness(fp[k], r["edited_fingerprint"].split("-")))
        if edited[k] == plain[k]:
            assert r["edited_fingerprint"] == r["fingerprint"]


def test_imatch_of_clustered_and_missing_ids(spark):
    """An outlier, one id a thousand times, and thousands of equal rows without id: no group grows, and the order is that of the table."""
    rows = [(k, f"text {k}") for k in range(1000)] + [(1 << 62, "far"), (-(1 << 63), "low")] + [(500, f"again {k}") for k in range(1000)] + [(None, "same")] * 2000 + [(None, f"other {k}") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = imatch.with_heads(df, 100)
    sizes = [r["count"] for r in got.where("again = 0").groupBy(*imatch.GROUP).count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 350 and len(sizes) > 30
    assert got.where("again = 1").count() == len(sizes)
    key = lambda r: (*(r[c] for c in imatch.GROUP), r["again"], r["doc_id"] is None, -(r["doc_id"] or 0), r["th"])
    line = [r["doc_id"] for r in sorted(got.where("again = 0").collect(), key=key)]
    assert line == sorted((i for i, _ in rows if i is not None), reverse=True) + [None] * 2500
    pairs = [(r["text"], r["n"]) for r in got.select("*", F.lead("text").over(imatch.Window.partitionBy(*imatch.GROUP).orderBy("again", F.col("doc_id").desc_nulls_last(), "th")).alias("n")).where("again = 0").collect()]
    assert all(n is not None for _, n in pairs) and sorted(n for _, n in pairs) == sorted(t for _, t in rows)
    assert ("text 999", "text 998") in pairs and ("far", "text 999") in pairs


def test_imatch_of_an_empty_table(spark, empty):
    assert imatch.compare_edits(empty, imatch.lexicon(empty)).count() == 0
    clash = spark.createDataFrame([(1, "a b", 3, 4), (1, "a b", 3, 4)], "doc_id long, text string, th int, at int")
    got = imatch.compare_edits(clash, imatch.lexicon(clash)).collect()
    assert len(got) == 2 and all(r["near_next"] == 1 for r in got)


def test_imatch_of_few_terms(spark):
    """Different texts of one term are told apart, and from the empty text, though no subset may hold the term."""
    df = spark.createDataFrame([*((k, f"term{k}") for k in range(60)), (60, ""), (61, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.compare_edits(df, imatch.lexicon(df)).collect()}
    assert len({r["fingerprint"] for r in got.values()}) == 61 and got[60]["fingerprint"] == got[61]["fingerprint"]
    assert {k for k, r in got.items() if r["near_next"] > 0} == {61}


def test_media(odd, empty):
    got = {r["doc_id"]: r for r in media.read_media(media.store_texts(odd)).collect()}
    for r in odd.collect():
        data = media.pad((r["text"] or "").encode())
        own = got[r["doc_id"]]
        assert (own["payload_sha256"], own["tail_crc32"], own["payload_bytes"]) == (hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(data))
    assert media.read_media(media.store_texts(empty)).count() == 0
    file = media.store(media.pad(b"some bytes" * 40))
    pic, other = media.read(file), media.read(file)
    other.coefficients = []
    body = file[file.index(b"\xff\xda") + 10 : -2]
    media._any_scan(other, body, [(0, 0)])
    assert np.array_equal(pic.coefficients[0], other.coefficients[0])
