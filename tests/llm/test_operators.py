"""Operators against brute force, round trips and planted cases, with nulls, ties, empty and long texts."""

import collections
import dataclasses
import hashlib
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest

from motionloom.llm import decontam, html_extract, huffman, license_scan, lm, media, packing, quality, simhash, suffix
from motionloom.llm import tokens as T

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} thing," for i in range(30_000))
ODD = [(1, "One two  three\tfour\nfive six seven."), (2, None), (3, ""), (4, "é à 漢字 　 x y"), (5, LONG), (5, LONG), (None, "no key here at all"), (7, "One two  three\tfour\nfive six seven."), (8, "word " * 3000), (9, " \n ")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns with clashing names are not read
    return spark.createDataFrame([(k, t, "b", 3, "x") for k, t in ODD], SCHEMA + ", fp string, n long, chunk string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.default_path())


def test_part_encoder_is_the_library(library):
    import pyarrow as pa

    texts = [t or "" for _, t in ODD] + ["", " a  b ", "don't <|endoftext|> x, 3rd 12.5%", "a b 　 c d", "\x85 x \x85", "end ", "x'S y's"]
    ids, lens = T.PartEncoder(T.default_path()).encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(lens)])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_masks_catch_two_substitutions():
    for bad in combinations(range(decontam.WINDOW), decontam.WINDOW - decontam.NEEDED):
        assert any(all(o + i not in bad for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for o in range(decontam.WINDOW - len(m) + 1))


def test_decontamination(spark, odd, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron"
    changed = item.replace("delta", "DELTA!").replace("eta theta", "eta thing")
    docs = spark.createDataFrame([(1, "x " * 50 + changed + " y"), (2, None), (None, item), (4, item.split(" ", 9)[-1]), (5, "tiny one"), (6, "a tiny, ONE b")], SCHEMA)
    bench = spark.createDataFrame([(1, item), (2, "tiny one"), (3, None), (4, "")], "item_id long, text string")
    for limit in (0, decontam.MAX_SEEDS):
        got = {(r["doc_id"], r["item_id"], r["equal_tokens"]) for r in decontam.overlaps(docs, bench, max_seeds=limit).collect()}
        assert got == {(1, 1, 14), (None, 1, 15), (5, 2, 2), (6, 2, 2)}
    assert decontam.overlaps(empty, bench).count() == 0 and decontam.overlaps(odd, bench.limit(0)).count() == 0
    assert sorted(r[0] for r in decontam.clean(docs, bench).select("doc_id").collect()) == [2, 4]


def test_decontamination_sql(spark):
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.sql(f"create view {n} as select * from '{SF}/{n}.parquet'")
    got = decontam.overlaps(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).toPandas()
    want = con.sql(decontam.ORACLE_SQL).df()
    rows = lambda d: sorted(d[sorted(d.columns)].astype("int64").values.tolist())
    assert rows(got) == rows(want)


def fingerprint(text):
    import xxhash

    s = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", s)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in sh], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(sh))


def test_simhash(spark, odd, empty):
    got = simhash.near_duplicates(odd).toPandas()
    assert sorted(got["fingerprint"]) == sorted(f"{fingerprint(t):016x}" for _, t in ODD)
    by = {None if pd.isna(k) else int(k): None if pd.isna(c) else int(c) for k, c in zip(got["doc_id"], got["component_id"], strict=True)}
    assert by[7] == 1 and by[3] == by[2] == by[9] == 2 and by[None] is None and by[5] == 5
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [4096, 3])
def test_simhash_links(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(40):
            x = int(b)
            for i in rng.integers(0, 63, 4):
                x ^= 1 << int(i)
            fps.add(x)
    fps = sorted(fps)
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    index = {x: i for i, x in enumerate(fps)}
    from motionloom.llm.graph import components, forest

    pairs = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = forest(*np.array(pairs).T, len(fps))
    have = forest(np.array([index[r["a"]] for r in found]), np.array([index[r["b"]] for r in found]), len(fps))
    assert (want == have).all()
    star = components(spark.createDataFrame(found)).collect()
    assert all(fps[want[index[r["node"]]]] == r["root"] for r in star)


def test_packing(spark, odd, empty, library):
    p = packing.pack_documents(odd).toPandas()
    s = p.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id")["length"].cumsum() - s["length"] == s["offset"]).all()
    total = s.groupby("sequence_id")["length"].sum()
    assert ((total <= 1024) & ((total == 1024) | (total & (total - 1) == 0))).all()
    for k, t in ODD:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = p[p["doc_id"].isna() if k is None else p["doc_id"] == k]
        assert (own["doc_tokens"] == len(ids)).all() and own["length"].sum() == len(ids) * sum(x == k for x, _ in ODD)
        assert all(zlib.crc32(ids[r.start : r.start + r.length]) == r.ids_crc32 for r in own.itertuples())
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize(("segments", "loss"), [(4, None), (8, 700)])
def test_packing_limits_bind(spark, segments, loss):
    rng = np.random.default_rng(2)
    docs = [(int(k), " ".join(f"w{x}" for x in rng.integers(0, 999, int(n)))) for k, n in enumerate([*rng.integers(1, 12, 200), *rng.integers(20, 900, 40)])]
    p = packing.pack_documents(spark.createDataFrame(docs, SCHEMA).coalesce(1), segments=segments, loss=loss).toPandas()
    assert (p.groupby("doc_id")["length"].sum() == p.groupby("doc_id")["doc_tokens"].first()).all()
    g = p.groupby("sequence_id").agg(n=("length", "size"), tokens=("length", "sum"))
    assert g["n"].max() == segments and g["tokens"].max() <= 1024
    assert loss is None or (g["tokens"] - g["n"]).max() <= loss
    room = g["tokens"].where((g["tokens"] & (g["tokens"] - 1)) == 0, 1024)
    assert g["tokens"].sum() / room.sum() > 0.6


def test_packed_conversations(spark, library):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").unionByName(spark.createDataFrame([(10**6, 0, "assistant", None), (10**6, 1, None, "a b"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string"))
    rows = turns.toPandas()
    rows["n"] = [len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in rows["text"]]
    want = rows.assign(loss=rows["n"].where(rows["role"] == "assistant", 0)).groupby("conv_id", dropna=False).agg(tokens=("n", "sum"), segments=("n", "size"), loss_tokens=("loss", "sum"))
    p = packing.pack_conversations(turns).toPandas().merge(want, left_on="example", right_index=True)
    assert len(p) == len(want)
    small = p[~p["oversize"]].groupby("sequence_id")[["tokens", "segments", "loss_tokens"]].sum()
    assert (small <= list(packing.INSTRUCTION_LIMITS)).all().all()
    over = (want > list(packing.INSTRUCTION_LIMITS)).any(axis=1)
    assert p["oversize"].sum() == over.sum()


def test_unknown_vocabulary_goes_whole(tmp_path, library):
    import json

    import pyarrow as pa

    file = json.loads(library.to_str())
    assert T.obeys_the_rule(file)
    file["pre_tokenizer"]["add_prefix_space"] = True
    assert not T.obeys_the_rule(file)
    (tmp_path / "t.json").write_text(json.dumps(file))
    texts = ["one two, three.", "", " x  y"]
    ids, lens = T.PartEncoder(str(tmp_path / "t.json")).encode(pa.array(texts))
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(str(tmp_path / "t.json"))
    assert ids.tolist() == [i for t in texts for i in other.encode(t, add_special_tokens=False).ids] and lens.sum() == len(ids)


def test_packing_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(zip(rng.integers(1, 900, 400), rng.integers(1, 4, 400), rng.integers(0, 500, 400), strict=True))] + [(400, 5000, 1, 1), (401, None, 1, None)]
    df = spark.createDataFrame(rows, "id long, t long, s long, l long")
    p = packing.pack_vectors(df.coalesce(1), "id", ["t", "s", "l"], [1024, 8, 512]).toPandas().merge(df.toPandas().fillna(0), left_on="example", right_on="id")
    assert sorted(p["example"]) == list(range(402)) and p[p["oversize"]]["example"].tolist() == [400]
    g = p[~p["oversize"]].groupby("sequence_id")[["t", "s", "l"]].sum()
    assert (g <= [1024, 8, 512]).all().all() and len(g) <= 1.15 * g.sum().div([1024, 8, 512]).max()


def test_huffman_blocks():
    rng = np.random.default_rng(0)
    for counts in (np.array([0, 5]), np.array([1, 1, 2, 3, 5, 8, 13]), (rng.random(3000) ** 8 * 1e6).astype(int), np.array([1 << i for i in range(40)])):
        ln = huffman.code_lengths(counts)
        used = ln[ln > 0].astype(float)
        assert (ln <= huffman.MAX_BITS).all() and (2.0**-used).sum() <= 1 + 1e-12 and ((ln > 0) == (counts > 0)).all()
        ids = rng.choice(np.flatnonzero(counts), 5000).astype(np.uint32)
        lens = np.array([0, 1, 4999])
        got, back = huffman.decode_block(huffman.encode_block(ids, lens, ln, huffman.canonical(ln)), huffman.decode_table(ln))
        assert (got == ids).all() and (back == lens).all()
    assert huffman.decode_block(huffman.encode_block(ids[:0], np.array([0]), ln, huffman.canonical(ln)), huffman.decode_table(ln))[0].size == 0


def test_huffman(spark, odd, empty, library):
    r = huffman.read_ids(spark, huffman.write_ids(odd)).toPandas().sort_values("start")
    assert (r["n_tokens"].cumsum() - r["n_tokens"] == r["start"]).all()
    keys = [k if k == k else None for k in r["doc_id"].astype(object).where(r["doc_id"].notna(), None)]
    assert keys == sorted((k for k, _ in ODD), key=lambda k: (k is not None, k))
    texts = collections.defaultdict(list)
    for k, t in ODD:
        texts[k].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    for k, c in zip(keys, r["ids_crc32"], strict=True):
        assert c in {zlib.crc32(x) for x in texts[k]}
    assert huffman.read_ids(spark, huffman.write_ids(empty)).count() == 0


def removed(rows):
    """Per row (n_bytes, n_removed, n_spans, sha256), by definition."""
    first, out = {}, {}
    for k, t in rows:
        if k is not None:
            b = (t or "").encode()
            for i in range(len(b) - 49):
                w = b[i : i + 50]
                first[w] = min(k, first.get(w, k))
    for n, (k, t) in enumerate(rows):
        b = (t or "").encode()
        g = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 49 if k is not None else 0):
            if first[b[i : i + 50]] < k:
                g[i] += 1
                g[i + 50] -= 1
        g = np.cumsum(g)[:-1] > 0
        out[n] = (k, len(b), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest())
    return sorted(out.values(), key=str)


def test_suffix(spark, odd, empty):
    rng = np.random.default_rng(5)
    passages = [" ".join(f"p{i}x{rng.integers(99)}" for i in range(40)) for _ in range(5)]
    rows = [(int(k), " ".join(passages[i][int(rng.integers(0, 80)) :] if rng.random() < 0.6 else f"own {rng.integers(1 << 40)} text" for i in rng.integers(0, 5, 6))) for k in rng.permutation(120)]
    rows += [(k, t) for k, t in ODD if t != LONG] + [(5, LONG[:900]), (5, LONG[:900]), (200, LONG[100:700] + "ab" * 100), (201, "ab" * 60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for chunk, hot in ((700, 1), (700, suffix.HOT), (suffix.CHUNK, 1)):
        got = sorted((tuple(None if v != v else int(v) if isinstance(v, float) else v for v in r) for r in suffix.digests(df, chunk_bytes=chunk, hot=hot).toPandas().itertuples(index=False)), key=str)
        assert got == removed(rows)
    assert suffix.digests(empty).count() == 0
    kept = suffix.clean(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 7").count() == 1 and kept.where("doc_id is null").count() == 1


def test_longest_previous_factors():
    text = np.frombuffer(b"abracadabraabracadabra", np.uint8)
    n, depth = 12, 10
    order, lcp = suffix.suffix_order(text, np.arange(n), depth)
    raw = text.tobytes()
    assert [raw[i : i + depth] for i in order] == sorted(raw[i : i + depth] for i in range(n))
    got = np.zeros(n, int)
    got[order] = suffix.previous_factors(order, lcp)
    common = lambda a, b: next((k for k in range(depth) if raw[a + k] != raw[b + k]), depth)
    assert got.tolist() == [max([common(i, j) for j in range(i)], default=0) for i in range(n)]


def test_quality(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.train(docs, labels)
    p = quality.score(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    assert p["score"].between(0, 1).all() and (p["held_out"] == [zlib.crc32(str(k).encode()) % 5 == 0 for k in p["doc_id"]]).all()
    h = p[p["held_out"]]
    assert (h["predicted"] == h["quality"]).mean() > 0.97
    o = quality.score(odd, model).toPandas()
    assert len(o) == len(ODD) and o["score"].between(0, 1).all()
    assert quality.score(empty, model).count() == 0 and quality.train(empty, labels) is None
    assert quality.keep_good(odd, labels.limit(0)).count() == len(ODD)


def test_attention_gradients():
    rng = np.random.default_rng(0)
    m = quality.AttentionModel(5)
    x, doc, y = rng.normal(size=(7, 5)), np.array([0, 0, 1, 2, 2, 2, 3]), np.array([0.0, 1, 1, 0])
    loss = lambda: float(-(y * np.log(q := m.score(x, doc, 4)) + (1 - y) * np.log(1 - q)).mean())
    for k, g in m.gradients(x, doc, y).items():
        i = tuple(rng.integers(0, n) for n in m.p[k].shape)
        was = m.p[k][i]
        m.p[k][i] = was + 1e-6
        up = loss()
        m.p[k][i] = was - 1e-6
        down = loss()
        m.p[k][i] = was
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-8)


def test_html(spark):
    page = '<html><head><title>T</title><script>x</script></head><body><nav><a href=x>Menu</a></nav><div class="ad">Buy &amp; buy</div><article><h1>Head</h1><p><b>One &lt;two&gt;<br><p>Three\n  four</p></article><section id=comments><p>First!</p></section><footer>F</footer>'
    plain = "<body><div>" + "<a href=x>l</a> " * 5 + "</div><p>" + "Long plain words. " * 20 + "</p><p>" + "More of it here. " * 15 + "</p><div class=footer>x</div>"
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", plain), (5, "u", "<p>a" * 500)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert got[1]["text"] == "Head\n\nOne <two>\n\nThree four" and got[2]["text"] == got[3]["text"] == ""
    assert got[4]["text"] == ("Long plain words. " * 20).strip() + "\n\n" + ("More of it here. " * 15).strip()
    assert all(len(r["text"]) == r["n_chars"] for r in got.values())
    assert html_extract.extract(pages.limit(0)).count() == 0
    twice = html_extract.extract(pages.unionByName(pages).withColumnRenamed("url", "URL").withColumn("text", pages["html"]), url="URL").collect()
    assert sorted((r["page_id"], r["text"]) for r in twice) == sorted((k, r["text"]) for k, r in got.items() for _ in range(2))


@pytest.mark.parametrize("name", ["content no-sidebar", "main-content has-sidebar", "entry-header", "post comments-open", "story legal", "page-header"])
def test_html_names_are_no_veto(name):
    body = "".join(f"<p>{'Plain words of an article, number %d. ' % i * 6}</p>" for i in range(6))
    got = html_extract.main_text(f"<body><nav><a href=x>Menu</a></nav><div class='{name}'>{body}</div><div class=footer>f</div></body>")
    assert got.count("number") == 36 and "Menu" not in got and not got.endswith("f")
    got = html_extract.main_text(f"<body><article><p>Teaser of another story.</p></article><div id=x>{body}</div></body>")
    assert got.count("number") == 36
    got = html_extract.main_text(f"<body><article><h1>Title</h1>{body}</article><section id=comments>{body * 3}</section></body>")
    assert got.startswith("Title") and got.count("number") == 36


def test_html_clusters_decide(monkeypatch):
    body = "".join(f"<p>{'Plain words of an article, number %d. ' % i * 6}</p>" for i in range(6))
    page = f"<body><div class=a>{'<span>Ten</span> <b>short</b> <i>words</i>.<br>' * 6}</div><div class=b><h2>Title</h2>{body}</div><div class=c><ul>{'<li><a href=x>one</a>' * 5}</ul></div></body>"
    got = html_extract.main_text(page)
    assert got.startswith("Title") and got.endswith("5.") and "Ten" not in got and "one" not in got
    monkeypatch.setattr(html_extract, "upper_lines", lambda ratio: np.ones(len(ratio), bool))
    assert "Ten" in html_extract.main_text(page)
    deep = "<div>" * 20_000 + "x" + "</span>" * 20_000
    assert html_extract.main_text(deep) == "x"


def test_license(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    s = license_scan.train(docs)
    assert s.held_out_accuracy > 0.6  # of templates that the measured model hasn't seen
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "Licensed under the Apache License, Version 2.0."), (3, "ordinary words of no licence"), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA), s).collect()}
    assert (got[1]["family"], got[1]["confirmed"], got[1]["paragraph"]) == ("mit", True, 1) and got[2]["family"] == "apache"
    assert not got[3]["confirmed"] and got[4]["family"] is None and got[5]["n_paragraphs"] == 0
    assert license_scan.scan(odd, s).count() == len(ODD) and license_scan.scan(empty, s).count() == 0
    license_scan.train(empty)
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software without restriction."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\nconditions are met:"
    gpl = "Released under the GNU GPL version 3."
    rows = [(1, "some words\n" + mit + "\nmore"), (2, bsd), (3, mit + "\n\n" + gpl), (4, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"), (5, "This program and the accompanying materials are made available under the Eclipse Public License"), (6, "any person obtaining\n\na copy of this software")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA), s).collect()}
    assert got[1]["families"] == ["mit"] and got[2]["families"] == ["bsd"] and got[3]["families"] == ["gpl", "mit"]
    assert not got[4]["families"] and not got[5]["families"] and not got[6]["families"] and got[4]["family"] is got[5]["family"] is None


def test_lm(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm.train(docs)
    p = lm.score(docs, model).toPandas()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0d]+", (r["text"] or "").translate(lower)) for r in docs.collect()}
    assert p["n_words"].tolist() == [len(words[k]) for k in p["doc_id"]]
    n = collections.Counter(w for t in words.values() for w in t)
    total = sum(n.values())
    assert model.counts.agg({"n": "sum"}).first()[0] == total and model.counts.count() == len(n)
    # the neighbours tell more than the frequencies, at which the network starts
    plain = dataclasses.replace(model, net=lm.Network(np.exp(model.whole) - np.exp(model.held)))
    assert (p["log_likelihood"].sum() - lm.score(docs, plain).toPandas()["log_likelihood"].sum()) / total > 0.02
    # all words and what is held back for unseen ones make a whole
    net, v = model.net, model.vocabulary
    c = np.full((v.pad, 2 * lm.REACH), v.pad, np.uint16)
    every = np.exp(net.log_probabilities(c, np.arange(v.pad).astype(np.uint16)))
    assert every.sum() == pytest.approx(1, abs=1e-3)
    one = lm.score(spark.createDataFrame(list(enumerate(n)), SCHEMA), model).toPandas()
    back = (every * np.exp(model.held - model.whole))[v.own :].sum()
    assert np.exp(one["log_likelihood"]).sum() + back == pytest.approx(1, abs=1e-3)
    # counts from the join and counts at hand are the same
    far = lm.score(docs, dataclasses.replace(model, near=(model.near[0][:9], model.near[1][:9]))).toPandas()
    assert far["log_likelihood"].to_numpy() == pytest.approx(p["log_likelihood"].to_numpy(), rel=1e-4)
    # unseen words are unlikely, and the more so the longer
    odds = lm.score(spark.createDataFrame([(1, "zqxjv"), (2, "zqxjvzqxjvzqxjv")], SCHEMA), model).toPandas().set_index("doc_id")["log_likelihood"]
    assert odds[2] < odds[1] < one["log_likelihood"].min()
    o = lm.score(odd, model).toPandas()
    assert len(o) == len(ODD) and o[o["n_words"] == 0]["mean_log_likelihood"].isna().all() and (o[o["n_words"] == 0]["log_likelihood"] == 0).all()
    nothing = lm.train(empty)
    assert lm.score(empty, nothing).count() == 0 and lm.score(odd, nothing).count() == len(ODD)


def test_media(spark):
    rng = np.random.default_rng(0)
    image = lambda: np.kron(rng.integers(0, 255, (20, 20)), np.ones((8, 8))).astype(np.uint8)
    a, b = image(), image()
    rows = [(1, a), (2, a[20:140, 30:150]), (3, np.clip(a * 0.7 + 30, 0, 255).astype(np.uint8)), (4, b), (5, a), (6, np.rot90(b).copy()), (7, image()), (8, np.zeros((40, 40), np.uint8))]
    data = [(k, bytearray(x.tobytes()), x.shape[1], x.shape[0]) for k, x in rows] + [(9, None, 1, 1), (10, bytearray(b"abc"), 9, 9), (None, bytearray(a.tobytes()), 160, 160)]
    df = spark.createDataFrame(data, "image_id long, image binary, width int, height int")
    got = {r["image_id"]: r["class_id"] for r in media.copies(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 4, 7: 7, 8: 8, 9: 9, 10: 10, None: 1}
    assert media.copies(df.limit(0)).count() == 0


def test_pipeline(spark):
    from motionloom.llm import pipeline as C

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.01")
        assert docs.columns == C.COLUMNS, name
        from motionloom.llm.common import materialize

        docs = materialize(docs, "test")
        assert 0 < docs.count() <= before.count()
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    assert decontam.overlaps(docs, bench).count() == 0
    near = simhash.near_duplicates(before)
    assert near.count() == before.count()
    assert C.packed(spark, docs, "").select("doc_id").distinct().count() == docs.count()
