"""Corpus operators against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hiddenpath.llm import decontamination, graph, html_extract, lang_id, license_scan, near_dedup, packing, quality, secret_scan, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORDS = [a + b for a in ("ba", "ko", "mi", "re", "stu", "zé") for b in ("la", "n", "rt", "so")]


def texts(seed=1, count=60):
    """Prose with copies, near copies, shared passages, repeats and odd rows."""
    rng = random.Random(seed)
    out = [" ".join(rng.choices(WORDS, k=rng.randint(5, 80))) for _ in range(count)]
    for k in range(12):
        w = rng.choice(out).split()
        w[rng.randrange(len(w))] = "xx"
        out.append(" ".join(w))
        out.append(rng.choice(out[:count]))
        out.append(f"{rng.choice(WORDS)} {rng.choice(out[:count])[:70]}\n{rng.choice(WORDS)} {rng.choice(out[:count])[-70:]}")
    return [None, "", "   \n\t", "one", "one", *out, " ".join(out[:8] * 3), "Ä" * 300, "A b  C\x0bd e"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "src1", i, "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, bucket string").repartition(3)


@pytest.fixture(scope="module")
def by_id():
    return dict(enumerate(texts()))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def components(pairs, ids):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("node_records", [4096, 3])
def test_near_duplicates(docs, by_id, node_records):
    sets = {}
    for i, t in by_id.items():
        w = spaced(t)
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(links, sets)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, 4, 80, node_records=node_records).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 160)]
    ids = {x for p in pairs for x in p if p[0] != p[1]}
    want = components(pairs, {x for p in pairs for x in p})
    got = {r.v: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: want[i] for i in ids}


def test_repeated_substrings(docs, by_id):
    seen, want = set(), {}
    for i, t in sorted(by_id.items()):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        mine = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, s in enumerate(mine):
            if s in seen:
                gone[k : k + 50] = True
        seen |= set(mine)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_substrings(docs).collect()}
    assert got == want and sum(v[1] > 0 for v in want.values()) > 15


def test_packing_round_trip(docs, by_id):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    pieces = packing.pack(docs, TOKENIZER, size=64).collect()
    made, places = {}, {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.piece)):
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * 64
        assert len(made.setdefault(r.doc_id, b"")) == 4 * r.start
        made[r.doc_id] += bytes(r.ids)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in by_id.items():
        want = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert made[i] == want
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in pieces)
    assert len(places) <= 1.15 * total / 64 + 2


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    hit = np.zeros(len(w), bool)
    for k, x in enumerate(windows):
        if windows.count(x) > 1:
            hit[k : k + 8] = True
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), int(hit.sum()), n < 20 or 100 * int(hit.sum()) > 30 * n


def test_quality_base_figures(docs, by_id):
    got = quality.apply_quality_rules(docs).select("doc_id", "n_words", F.col("quality").alias("q"))
    for r in got.collect():
        q = r.q
        assert r.n_words == r.doc_id  # an own column of the same name is left alone
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute_base(by_id[r.doc_id])
        assert not (q.kept and q.base_failed)


def test_quality_verdict_on_gibberish(spark):
    rng = random.Random(2)
    prose = [(i, " ".join(rng.choices(WORDS, k=60)) + ".", "en") for i in range(40)]
    junk = [(100 + i, " ".join("".join(rng.choices("#*$%&|<>0123456789", k=8)) for _ in range(60)), "en") for i in range(4)]
    d = spark.createDataFrame(prose + junk, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.apply_quality_rules(d).where("quality.kept").collect()}
    assert kept == set(range(40))


def test_decontamination(spark, docs, by_id):
    items = [(1, " ".join(by_id[10].split()[:14])), (2, "one"), (3, None), (4, "..."), (5, by_id[20].upper()), (6, "not in any text at all of these")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    for r in decontamination.decontaminate(docs, bench).collect():
        w = words(by_id[r.doc_id])
        hit, ids = set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        names = ",".join(sorted(map(str, ids)))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit))


def test_languages_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and length(text) > 40")
    model = lang_id.train(d.where("doc_id % 4 <> 2"))
    got = lang_id.identify_languages(d.where("doc_id % 4 = 2"), model).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 10
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in lang_id.identify_languages(odd, model).collect()} == {("und", 0.0)}


def test_automaton_phrases():
    model = lang_id.build_model({"a": "the cat sat on the mat", "b": "le chat est sur le tapis"})
    code = model.codes[np.frombuffer("the catle chat".encode("utf-32-le"), np.uint32)]
    got = lang_id.count_phrases(code, np.array([0, 7, 14]), model)
    assert got[0, 0] == 1 < got[1, 0] and got[1, 1] == 1 < got[0, 1]


def test_toxicity_finds_the_sentence(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        s = [" ".join(rng.choices(WORDS, k=6)) + "." for _ in range(5)]
        if i % 2:
            s[rng.randrange(5)] = "you vile gronk."
        rows.append((i, " ".join(s), i % 2))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(d, d.where("doc_id < 150").select("doc_id", "toxic"))
    got = toxicity.score_toxicity(d.where("doc_id >= 150"), model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)
    bad = next(r for r in got if r.predicted)
    assert rows[bad.doc_id][1].encode()[bad.toxic_sentences[0].start : bad.toxic_sentences[0].end].strip() == b"you vile gronk."
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert len({r.score for r in toxicity.score_toxicity(odd, model).collect()}) == 1


def test_main_text_on_unseen_layouts():
    crf = html_extract.train_default(150)
    right = total = 0
    for page, main in html_extract.labelled_pages(40, seed=99):
        blocks = html_extract.leaf_blocks(page)
        labels = crf.decode(html_extract.features(blocks))
        right += sum((b.text in main) == x for b, x in zip(blocks, labels, strict=True))
        total += len(blocks)
    assert right > 0.95 * total
    assert html_extract.main_text("<article><h1>A &amp; B</h1><p>one\n two<!-- x --></p></article><footer>&copy; z</footer>", crf) == "A & B\none two"
    assert html_extract.main_text("", crf) == ""


def test_secrets(spark):
    key = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5"
    rows = [(1, f"config api_key = '{key}' here", "src1"), (2, "the commit sha 0123456789abcdef0123456789abcdef01234567 was good", "src2"), (3, None, None), (4, "", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.row.doc_id: r for r in secret_scan.scan_secrets(d).collect()}
    assert key not in got[1].masked and secret_scan.MASK in got[1].masked
    assert got[2].masked == rows[1][1] and got[3].masked is None and got[4].masked == ""
    held = list(secret_scan.labelled_findings(600, seed=77))
    p = secret_scan.train_default(1500).predict(np.array([secret_scan.features(*r[:4]) for r in held]))
    assert np.mean((p >= 0.5) == np.array([r[4] for r in held])) > 0.9


def test_licences(spark):
    """Paragraphs are counted from 0: lines that end no sentence are joined, and other sentences are no notices."""
    rows = [(1, "Some words.\n\nReleased under the MIT License.\n\nMore words."), (2, "You need a fishing license to use this lake."), (3, None), (4, "Licensed under the Apache License, Version 2.0."), (5, "x\nReleased under the MIT License.\ny")]
    got = {r.doc_id: r for r in license_scan.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].family, got[1].paragraph, got[1].confirmed) == ("MIT", 1, True)
    assert (got[5].family, got[5].paragraph, got[5].confirmed) == ("MIT", 0, True)
    assert (got[4].family, got[4].paragraph) == ("Apache-2.0", 0) and set(got) == {1, 4, 5}


def test_empty_tables(spark, docs):
    none = docs.where("false")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for df in (near_dedup.near_duplicates(none), suffix_dedup.repeated_substrings(none), packing.pack(none, TOKENIZER), quality.apply_quality_rules(none), decontamination.decontaminate(none, bench), secret_scan.scan_secrets(none), license_scan.scan_licences(none)):
        assert df.count() == 0
    assert decontamination.decontaminate(docs, bench.where("false")).where("contaminated").count() == 0


def test_pipeline_stages(spark, docs, by_id):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    now = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert now.columns == docs.columns
    kept = {r.doc_id for r in near_dedup.near_duplicates(docs, 5, 80).where("kept").collect()}
    assert {r.doc_id for r in now.collect()} == kept
    masked = corpus_pipeline.secret_scans(spark, docs, SF)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.select("doc_id").distinct().count() > 20
