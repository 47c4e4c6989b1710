"""Cases that the operators once did in part only."""

import collections
import re

import numpy as np
import pytest

from motionloom.llm import media, shingles


def word_shingles(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_classes(rows):
    """The class (least row number) of each text, by brute-force Jaccard similarity."""
    from motionloom.llm.graph import forest

    sets = [word_shingles(t) for t in rows]
    close = lambda p, q: len(p & q) >= 0.8 * len(p | q)
    return forest(*np.array([(i, j) for j in range(len(sets)) for i in range(j) if close(sets[i], sets[j])] or np.zeros((0, 2), int)).T, len(sets))


@pytest.mark.parametrize("part", [shingles.PART, 7])
def test_pipeline_near_duplicates(spark, monkeypatch, part):
    from motionloom.llm import pipeline as C

    monkeypatch.setattr(shingles, "PART", part)
    rng = np.random.default_rng(4)
    texts = ["One two  three\tfour\nfive six seven.", None, "", "é à 漢字 x y", "no key here at all", "One two  three\tfour\nfive six seven.", "word " * 3000, " \n "]
    for k in range(12):
        base = [f"w{i}" for i in rng.integers(0, 400, int(rng.integers(3, 200)))]
        texts.append(" ".join(base))
        for _ in range(12):
            w = list(base)
            for i in rng.integers(0, len(w), int(rng.integers(1, 2 + len(w) // 25))):
                w[i] = f"x{rng.integers(99)}"
            texts.append("  ".join(w).upper())
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    want = near_classes(texts)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(r["doc_id"] for r in C.one_of_near_duplicates(spark, docs, "").collect())
    assert got == sorted(set(want.tolist()))
    assert C.one_of_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_pipeline_one_row_of_each_class(spark):
    from motionloom.llm import pipeline as C

    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, one), (1, two), (1, two + " end"), (2, one), (None, one), (None, three), (None, three), (None, three + " end"), (None, None), (None, "")]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kept = [sorted(((r["doc_id"], r["text"]) for r in C.one_of_near_duplicates(spark, spark.createDataFrame(d, schema).repartition(n), "").collect()), key=str) for d, n in ((docs, 1), (docs[::-1], 3))]
    assert kept[0] == kept[1] and len(kept[0]) == 4
    assert (1, one) in kept[0] and {k for k, t in kept[0] if t and t.startswith("b")} == {1} and sum(t.startswith("c") for _, t in kept[0] if t) == 1


def test_pipeline_near_duplicates_by_simhash(spark):
    """Texts with fingerprints at 2 bits or fewer go, also where their sets of shingles differ."""
    from motionloom.llm import pipeline as C
    from motionloom.llm import simhash

    w = [f"w{i}" for i in range(12)]
    # fingerprints count repeats, so many repeats outweigh what differs
    one, two, far = (" ".join(["a b c"] * 60 + tail) for tail in (w[:6], w[6:], w[:1]))
    texts = [one, two, far, " ".join(w), None, ""]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len(word_shingles(one) & word_shingles(two)) < 0.8 * len(word_shingles(one) | word_shingles(two))
    got = {r["doc_id"] for r in C.one_of_near_duplicates(spark, docs.repartition(3), "").collect()}
    assert 0 in want and 1 not in want and got == want


def agreeing(p: np.ndarray, d: np.ndarray, q: np.ndarray, e: np.ndarray) -> int:
    """The most matches of two images' corners that agree on a shift, turn and scale."""
    if not len(p) or not len(q):
        return 0
    dist = np.bitwise_count(d.view(np.uint64)[:, None] ^ e.view(np.uint64)[None]).sum(axis=2, dtype=np.int64)
    i = np.flatnonzero(dist.min(axis=1) <= media.DISTANCE)
    j = dist[i].argmin(axis=1)
    mutual = dist[:, j].argmin(axis=0) == i
    i, j = i[mutual], j[mutual]
    if len(i) < media.INLIERS:
        return 0
    scale, turn = q[j, 2] / p[i, 2], q[j, 3] - p[i, 3]
    z, w = p[i, 0] + 1j * p[i, 1], q[j, 0] + 1j * q[j, 1]
    move = scale * np.exp(1j * turn)
    # a pair of matches gives a finer turn and scale than one corner's angle
    best = 0
    for m in range(len(i)):
        dz, dw = z - z[m], w - w[m]
        far = np.abs(dz) > 4
        rough = move[m]
        for k in [-1, *np.flatnonzero(far)[:8].tolist()]:
            f = rough if k < 0 else dw[k] / dz[k]
            if abs(f) < 0.2 or abs(f) > 5:
                continue
            best = max(best, int((np.abs(f * dz - dw) <= media.NEAR * max(1.0, abs(f))).sum()))
    return best


@pytest.mark.parametrize("part", [4096, 20])
def test_media_links_are_whole(spark, monkeypatch, part):
    """Every two images with enough agreeing matches are linked, however many share a bucket."""
    monkeypatch.setattr(media, "PART", part, raising=False)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").limit(150)
    rows = {r["content"]: r for r in sorted(media.features(media.rendered(vectors)).collect(), key=lambda r: -r["image_id"])}
    own = [(r["image_id"], np.frombuffer(r["points"], "<f4").reshape(-1, 4).astype(float), np.frombuffer(r["bits"], np.uint8).reshape(-1, media.TESTS // 8)) for r in sorted(rows.values(), key=lambda r: r["image_id"])]
    want = collections.Counter()
    for j, (b, q, e) in enumerate(own):
        for a, p, d in own[:j]:
            if agreeing(p, d, q, e) >= media.INLIERS:
                want.update((a, b))
    got = {r["image_id"]: r["n_links"] for r in media.copies(media.rendered(vectors)).collect()}
    assert sum(want.values()) > 0 and {k: got[k] for k, _, _ in own} == {k: want[k] for k, _, _ in own}


def test_blocks_of_ids_are_narrow(spark):
    """Uncoded blocks hold ids under 65,536 in two bytes and carry their counts; larger ones keep four."""
    from motionloom.llm import huffman

    docs = spark.createDataFrame([(k, f"some words {k % 7}, and more of them") for k in range(50)] + [(None, None)], "doc_id long, text string")
    for end, width in ((2, 2), (70_000, 4)):
        blocks = huffman._tokenized(docs, huffman.T.default_path(), end).collect()
        counts = collections.Counter()
        for r in blocks:
            assert len(r["ids"]) == 8 * r["n_docs"] + width * r["n_tokens"]
            counts.update(huffman._ids_of(bytes(r["ids"]), r["n_docs"], r["n_tokens"]).tolist())
        frame = spark.createDataFrame(blocks, huffman.BLOCKS)
        assert counts[end] == 51 and counts == {r["id"]: r["n"] for r in huffman._counted(frame).collect()}


def _same_as_library(e, texts):
    import pyarrow as pa

    ids, lens = e.encode(pa.array(texts, pa.string()))
    want = [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]
    assert lens.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_encoder_keeps_parts_met_again(monkeypatch):
    """A full cache forgets the parts it met once, not those it met again, and ids stay those of the library."""
    from motionloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PARTS", 40)
    e = tokens.PartEncoder(tokens.default_path())
    for k in range(12):
        _same_as_library(e, [f"then often, again éa{k} x{chr(97 + k)}b\nof {' '.join(f'w{chr(97 + k)}{chr(97 + i)}' for i in range(9))} end", ""])
    for _ in range(2):
        _same_as_library(e, ["then often, again"])
    # this fills the cache, and the next text comes without those words
    _same_as_library(e, [" ".join(f"u{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(9))])
    _same_as_library(e, ["none of them"])
    assert b" often," in e.entry and b" uab" not in e.entry and len(e.entry) < 40
    # if most were met again, all go
    for _ in range(3):
        _same_as_library(e, [" ".join(f"v{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9))])
    assert b" often," not in e.entry


def test_plain_parts_are_single_pieces():
    """Parts of a space and letters go to the library without its pattern; others don't, and ids are the same."""
    from motionloom.llm import tokens

    letters = "".join(chr(c) for c in range(0x80, 0x250))
    e = tokens.PartEncoder(tokens.default_path())
    assert tokens.PLAIN(" élan".encode()) and tokens.PLAIN(b" Words")
    assert all(chr(c).isalpha() for c in range(0x80, 0x180) if tokens.PLAIN(f" {chr(c)}".encode()))
    assert not any(tokens.PLAIN(p.encode()) for p in ("", " ", "a", " a1", " it's", "\na", " a b", " ×", " ÷", " ª", " ŀ̀", " 漢"))
    seen = []
    whole = e._library
    e._library = lambda text, plain=False: seen.append((text, plain)) or whole(text, plain)
    _same_as_library(e, ["a " + " ".join(f"x{c}y {c}" for c in letters) + " it's IT'S don't 12a a12   a b  two\n\nend Ġword xĠy <|endoftext|> a", "ŉ Ŀa ĸ ſt, été. naïve; Łódź! á  x", "", " "])
    assert {plain for _, plain in seen} == {True, False} and all(tokens.PLAIN(p) for text, plain in seen if plain for p in [b" " + w for w in text.split(b" ")[1:]])


def test_lm_step_by_definition():
    """A step moves the embeddings along the gradient that rows give one by one, by symbol and place."""
    from motionloom.llm import lm

    rng = np.random.default_rng(5)
    side, n, rate = 3, 300, 0.5
    s, c = rng.integers(0, side**2, n).astype(np.uint16), np.minimum(rng.integers(0, 14, (n, 2 * lm.REACH)), side**2).astype(np.uint16)
    net = lm.Network(np.bincount(s, minlength=side**2).astype(float))
    old = {k: v.astype(float) for k, v in net.copy().p.items()}
    want, scores = old["E"].copy(), np.zeros(n)
    softmax = lambda z: np.exp(z) / np.exp(z).sum()
    for i in range(n):
        h = np.tanh(sum(old["E"][j][c[i, j]] for j in range(c.shape[1])) + old["b"])
        k, m = divmod(int(s[i]), side)
        p, q = softmax(h @ old["G"] + old["g"]), softmax(h @ old["M"][k] + old["m"][k])
        scores[i] = np.log(p[k] * q[m])
        back = (old["G"] @ (np.eye(side)[k] - p) + old["M"][k] @ (np.eye(side)[m] - q)) * (1 - h * h)
        for j in range(c.shape[1]):
            want[j][c[i, j]] += rate * back / max(32, (c[:, j] == c[i, j]).sum())
    assert np.allclose(net.log_probabilities(c, s), scores, atol=1e-4)
    net.learn(c, s, rate)
    assert np.abs(want - old["E"]).max() > 1e-3 and np.allclose(net.p["E"], want, atol=1e-5)


def test_lm_steps_and_found_hashes():
    """Steps take words from all over the rows, each once; hashes are found, many to a slot too."""
    from motionloom.llm import lm

    rng = np.random.default_rng(6)
    side, n = 3, 2 * lm.BATCH + 5
    s, c = rng.integers(0, side**2, n).astype(np.uint16), rng.integers(0, side**2 + 1, (n, 2 * lm.REACH)).astype(np.uint16)
    net = lm.Network(np.bincount(s, minlength=side**2).astype(float))
    one, seen = net.copy(), []
    for i in range(3):
        one._run(c[i::3], s[i::3], 0.5)
    step = net._run
    net._run = lambda c, s, rate: seen.append(len(s)) or step(c, s, rate)
    net.learn(c, s, 0.5)
    assert sum(seen) == n and max(seen) <= lm.BATCH and all((net.p[k] == one.p[k]).all() for k in net.p)
    net.learn(c[:0], s[:0], 0.5)
    for known in ([], [7], [2**64 - 1], [0, 1, 2, 3, 2**63, 2**63 + 1, 2**63 + 5, 2**64 - 2, 2**64 - 1], rng.integers(0, 2**64, 5000, np.uint64).tolist()):
        known = np.sort(np.array(known, np.uint64))
        h = np.concatenate([known, known + np.uint64(1), known - np.uint64(1), rng.integers(0, 2**64, 99, np.uint64)])
        at, there = lm.Sorted(known).find(h)
        assert (there == np.isin(h, known)).all() and (known[at[there]] == h[there]).all()


def _linked(images):
    """(image, least image joined to it, links) that _verified() finds among images (points, descriptors) in one part."""
    import pyarrow as pa

    rows = [{"group": 0, "parts": 1, "part": 0, "image_id": k, "n": len(p), "points": p.astype("<f4").tobytes(), "bits": d.tobytes()} for k, (p, d) in enumerate(images)]
    return {tuple(r.values()) for r in media._verified(pa.Table.from_pylist(rows)).to_pylist()}


def test_media_links_of_crowded_tables():
    """Where tables are so crowded that they spare nothing, two images that meet in no bucket are linked too."""
    rng = np.random.default_rng(3)
    points = lambda n: np.column_stack([rng.random((n, 2)) * 60, np.ones(n), np.zeros(n)])
    d = rng.integers(0, 256, (7, media.TESTS // 8)).astype(np.uint8)
    on = np.unpackbits(d, axis=1)
    on[:, media.TABLE_BITS[:, 0]] ^= 1  # one bit of every table's keys
    p, e = points(7), np.packbits(on, axis=1)
    assert not (media._keys(d) == media._keys(e)).any()
    crowd = np.tile(rng.integers(0, 256, (1, media.TESTS // 8)).astype(np.uint8), (9, 1))
    assert _linked([(p, d), (p + [5, 3, 0, 0], e)] + [(points(9), crowd) for _ in range(4)]) == {(0, 0, 1), (1, 0, 1)}
    assert _linked([(points(7), d), (points(7), e)] + [(points(9), crowd) for _ in range(4)]) == set()


def test_media_near_copies_are_a_row_each():
    """A group of near copies gives a row an image, not one a pair, and all its links are counted."""
    rng = np.random.default_rng(4)
    p, d = np.column_stack([rng.random((7, 2)) * 60, np.ones(7), np.zeros(7)]), rng.integers(0, 256, (7, media.TESTS // 8)).astype(np.uint8)
    other = rng.integers(0, 256, d.shape).astype(np.uint8)
    assert _linked([(p, other)] + [(p + [k, 0, 0, 0], d) for k in range(30)]) == {(k, 1, 29) for k in range(1, 31)}


@pytest.mark.parametrize("size", [3, 9, 24])
def test_media_pairs_by_definition(size):
    """Images of any number of corners, many pairs at once, have the links that each pair has by itself."""
    rng = np.random.default_rng(size)
    images = []
    for k in range(48):
        n = int(rng.integers(0, size + 1))
        z, d, s, t = rng.random(n) * 60 + 60j * rng.random(n), rng.integers(0, 256, (n, media.TESTS // 8)).astype(np.uint8), rng.choice([1.0, 2.0], n), rng.random(n) * 6 - 3
        if k >= 24:
            # a turned, scaled and noisy copy of some corners of another, in another order
            q, e = images[k - 24]
            some = rng.permutation(len(q))
            f = rng.uniform(0.3, 3) * np.exp(1j * rng.uniform(-3, 3))
            z = f * (q[some, 0] + 1j * q[some, 1]) + (rng.normal(0, 1.5, (len(some), 2)) @ [1, 1j])
            d, s, t = e[some] ^ (rng.random((len(some), media.TESTS // 8)) < 0.4), q[some, 2] * abs(f), q[some, 3] + np.angle(f)
        images.append((np.column_stack([z.real, z.imag, s, t]).astype(np.float32).astype(float), np.ascontiguousarray(d.astype(np.uint8))))
    n = np.array([len(p) for p, _ in images])
    words, places = np.zeros((48, n.max(), media.TESTS // 64), np.uint64), np.ones((48, n.max(), 4))
    for k, (p, d) in enumerate(images):
        words[k, : n[k]], places[k, : n[k]] = d.view(np.uint64), p
    a, b = np.triu_indices(48, 1)
    want = [agreeing(*images[i], *images[j]) >= media.INLIERS for i, j in zip(a.tolist(), b.tolist())]
    assert media._agreed(words, places, n, a, b).tolist() == want and (any(want) or size < media.INLIERS)
    assert len(media._agreed(words, places, n, a[:0], b[:0])) == 0
