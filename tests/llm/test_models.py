"""Models and the picture reader against plain restatements: loops and dictionaries for what the operators do with arrays."""

import math
import random
import struct

import numpy as np
import pytest

from docspeak.llm import media, quality, toxicity


def sentences(n, seed, top=60):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(top)}" for _ in range(n))


def test_buckets():
    """Words, pairs, skip-pairs and stems, whatever the case; none of an empty text."""
    assert len(toxicity.buckets(None)) == len(toxicity.buckets("")) == len(toxicity.buckets("12 !")) == 0
    one, two = toxicity.buckets("Some longer words here"), toxicity.buckets("some LONGER words HERE")
    # four words, three pairs, two skip-pairs; stems of "longer" (4, 5) and "words" (4)
    assert sorted(one) == sorted(two) and len(one) == 4 + 3 + 2 + 3
    assert len(np.unique(one)) == len(one) and set(toxicity.buckets("a b")) != set(toxicity.buckets("b a"))


def test_ftrl_by_hand(monkeypatch):
    """Weights and bias, coordinate by coordinate."""
    monkeypatch.setattr(toxicity, "L1", 0.3)
    rows = [(k, ("foul " if k % 3 == 0 else "") + sentences(6 + k % 4, k, 20), int(k % 3 == 0)) for k in range(40)]
    totals = {0: 270, 1: 14}
    got = toxicity.train(rows, totals)
    z, n, bias, bias_n = {}, {}, 0.0, 1.0

    def weight(i):
        x = z.get(i, 0.0)
        if abs(x) <= toxicity.L1:
            return 0.0
        return -(x - math.copysign(toxicity.L1, x)) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    rng = np.random.default_rng(5)
    for _ in range(toxicity.EPOCHS):
        for k in rng.permutation(len(rows)):
            features = set(toxicity.buckets(rows[k][1]).tolist())
            now = {i: weight(i) for i in features}
            g = 1 / (1 + math.exp(-sum(now.values()) - bias)) - rows[k][2]
            for i in features:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * now[i]
                n[i] = n.get(i, 0.0) + g * g
            bias_n += g * g
            bias -= 0.1 * g / math.sqrt(bias_n)
    bias += math.log(14 / 14) - math.log(270 / 26)
    want = {i: weight(i) for i in z if weight(i)}
    assert want and set(got.at.tolist()) == set(want) and np.isclose(got.bias, bias)
    assert np.allclose(got.weights, [want[i] for i in got.at.tolist()], rtol=1e-5)


def fitted():
    rows = [(k, sentences(40, k) + (" ! ? ! ?" * 6 if k % 2 else ""), k % 2) for k in range(60)]
    return rows, quality.train(rows, {0: 30, 1: 30})


def test_word_vectors_by_hand():
    """What stands one and two places around each token, counted place by place."""
    texts = [sentences(30, k, 8) for k in range(5)] + ["", "a a 12 a"]
    vocabulary, vectors = quality.word_vectors([quality.tokens(t) for t in texts])
    known = {h: i for i, h in enumerate(vocabulary.tolist())}
    own = vectors[:, quality.DIM :] * np.sqrt(quality.SIGNS)
    assert set(np.unique(own).tolist()) <= set(range(-quality.SIGNS, quality.SIGNS + 1))
    context = np.zeros((len(vectors), quality.DIM))
    for t in texts:
        h, shape = (x.tolist() for x in quality.tokens(t))
        ids = [known[x] if x in known and s % 3 == 0 else len(known) + s for x, s in zip(h, shape)]
        for i in range(len(ids)):
            for d in (1, 2):
                if i >= d:
                    context[ids[i]] += own[ids[i - d]]
                    context[ids[i - d]] += np.concatenate([own[ids[i]][-1:], own[ids[i]][:-1]])
    norm = np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    assert np.allclose(vectors[:, : quality.DIM], context / norm, atol=1e-5)


def test_network_by_hand():
    """Pooling, both layers and the temperature of a fitted model, neuron by neuron."""
    rows, model = fitted()
    w1, b1, w2, b2 = model.layers
    known = {h: i for i, h in enumerate(model.vocabulary.tolist())}
    for text in (rows[0][1], rows[1][1], "", None, "w1", "never seen 12 !"):
        h, shape = (x.tolist() for x in quality.tokens(text))
        pooled = np.zeros(2 * quality.DIM)
        for x, s in zip(h, shape):
            pooled += model.vectors[known[x] if x in known and s % 3 == 0 else len(known) + s] / len(h)
        x = [(v - m) / s for v, m, s in zip(pooled, model.mean, model.scale)]
        hidden = [math.tanh(sum(x[i] * w1[i, j] for i in range(len(x))) + b1[j]) for j in range(quality.HIDDEN)]
        raw = (sum(a * b for a, b in zip(hidden, w2)) + float(b2)) / model.temperature
        assert np.isclose(model.scores([text])[0], 1 / (1 + math.exp(-raw)), atol=1e-5)
    scores = model.scores([r[1] for r in rows])
    assert np.mean((scores >= 0.5) == [r[2] for r in rows]) >= 0.95 and 0.25 <= model.temperature <= 8


def test_fitted_models_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing names through models that look at texts; empty tables."""
    _, one = fitted()
    two = toxicity.train([(k, "foul " * 3 + sentences(9, k) if k % 2 else sentences(9, k), k % 2) for k in range(60)], {0: 30, 1: 30})
    texts = [None, "", " \n\t ", "foul words", "foul words", "la " * 50_000, "é中🎉 12 ½"]
    df = spark.createDataFrame([(k, t, 9.0, 7) for k, t in enumerate(texts)], "doc_id long, text string, score double, predicted int")
    for own, model in ((quality, one), (toxicity, two)):
        got = {r["doc_id"]: r for r in own.score(df, model).collect()}
        assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= own.THRESHOLD) for r in got.values())
        assert got[0]["score"] == got[1]["score"] == got[2]["score"] and got[3]["score"] == got[4]["score"]
        assert own.score(df.where("doc_id > 99"), model).count() == 0
    assert got[3]["score"] > got[0]["score"]


AC = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 9))]


def picture(width, height, parts, blocks, restart=0):
    """A baseline file written symbol by symbol; ``blocks[i][y, x]`` are a part's rows of 64 coefficients."""

    def number(v):
        size = abs(v).bit_length()
        return size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    def coded(row, before):
        size, bits = number(row[0] - before)
        out, run = f"{size:04b}{bits}", 0
        last = max((k for k in range(1, 64) if row[k]), default=0)
        for v in row[1 : last + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                out, run = out + f"{AC.index(0xF0):08b}", run - 16
            size, bits = number(v)
            out, run = out + f"{AC.index(run << 4 | size):08b}{bits}", 0
        return out + ("" if last == 63 else f"{AC.index(0):08b}")

    single = len(parts) == 1
    h_most, v_most = (1, 1) if single else (max(p[1] for p in parts), max(p[2] for p in parts))
    wide, high = -(-width // (8 * h_most)), -(-height // (8 * v_most))
    scan, bits, level = b"", "", [0] * len(parts)

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\0")

    for unit in range(wide * high):
        if restart and unit and unit % restart == 0:
            scan, bits, level = scan + flush(bits) + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8]), "", [0] * len(parts)
        for i, (_, h, v) in enumerate(parts):
            h, v = (1, 1) if single else (h, v)
            for y in range(v):
                for x in range(h):
                    row = blocks[i][unit // wide * v + y, unit % wide * h + x]
                    bits, level[i] = bits + coded(row, level[i]), row[0]
    scan += flush(bits)
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    sof = struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([p, h << 4 | v, 0]) for p, h, v in parts)
    sos = bytes([len(parts)]) + b"".join(bytes([p, 0]) for p, _, _ in parts) + b"\0\x3f\0"
    huffman = b"\0" + bytes([0, 0, 0, 12] + [0] * 12 + list(range(12))) + b"\x10" + bytes([0] * 7 + [len(AC)] + [0] * 8 + AC)
    head = [b"\xff\xd8", segment(0xDB, b"\0" + bytes([16] + [1] * 63)), b"\xff", segment(0xC0, sof), segment(0xC4, huffman)]
    return b"".join([*head, segment(0xDD, struct.pack(">H", restart)) if restart else b"", segment(0xDA, sos), scan, b"\xff\xd9"])


@pytest.mark.parametrize("parts", [[(1, 1, 1)], [(1, 2, 2), (2, 1, 1), (3, 1, 1)], [(1, 2, 1), (2, 1, 1), (3, 1, 1)]])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_pictures_of_other_writers(parts, restart):
    """Grey and colours, sampled or not, with and without restarts, runs of zeros and early ends of blocks."""
    r = random.Random(len(parts) + restart)
    width, height = 90, 50
    h_most, v_most = (1, 1) if len(parts) == 1 else (max(p[1] for p in parts), max(p[2] for p in parts))
    blocks = []
    for _, h, v in parts:
        high, wide = -(-height // (8 * v_most)) * v, -(-width // (8 * h_most)) * h
        blocks.append({(y, x): [r.randrange(-60, 60), *(r.choice([0] * r.choice([1, 30]) + [r.randrange(-255, 256)]) for _ in range(63))] for y in range(high) for x in range(wide)})
    pic = media.read(picture(width, height, parts, blocks, restart))
    assert (pic.width, pic.height, pic.restart) == (width, height, restart)
    for i, (_, h, v) in enumerate(parts):
        wide, high = -(-width * h // (8 * h_most)), -(-height * v // (8 * v_most))
        assert pic.coefficients[i].tolist() == [blocks[i][y, x] for y in range(high) for x in range(wide)]
    want = [[min(255, max(0, math.floor(blocks[0][y, x][0] * 16 / 8 + 128.5))) for x in range(-(-width // 8))] for y in range(-(-height // 8))]
    assert pic.thumbnail().tolist() == want


def test_not_a_picture():
    for data in (b"GIF89a", b"\xff\xd8\xff\xd9", b"\xff\xd8" + struct.pack(">BBH", 0xFF, 0xC2, 8) + b"123456", b"\xff\xd8ab"):
        with pytest.raises(ValueError):
            media.read(data)
