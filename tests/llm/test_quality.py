"""Quality rules: references and distances against brute force, and against SQL; odd rows and clashing names."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from hiddenpath.llm import oracles, quality, queries

WORDS = {"en": "the of and to a in stone river garden window".split(), "xx": "za ko lu mi zeta koma luna mira".split()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(240):
        lang = ("en", "xx", None, "rare")[min(3, rng.choice((0, 0, 1, 1, 2, 2) if i > 8 else (3,)))]
        w = rng.choices(WORDS.get(lang, WORDS["en"]), k=rng.choice((5, 30, 60, 120)))
        if i % 13 == 0:
            w = ["#$%&" * 2 + str(rng.randrange(10**6)) for _ in w]
        if i % 17 == 0:
            w = ["".join(rng.choices("qwxyzvbn", k=7)) for _ in w]
        out.append((i, " ".join(w).capitalize() + rng.choice((".", "!\nA line.\nA line.", "")), lang, i))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int").repartition(4)


def classes(text):
    kinds = (r"[A-Z]", r"[0-9]", r"[#*$%&|<>]", r"[!?]", r"""[.,;:'"()-]""", r"[\x20\x09-\x0D]")
    found = [len(re.findall(k, text)) for k in kinds]
    return [*found, len(text) - sum(found)]


def distance(p, q):
    return math.sqrt(max(0.0, sum((a * math.log2(2 * a / (a + b)) if a > 0 else 0) + (b * math.log2(2 * b / (a + b)) if b > 0 else 0) for a, b in zip(p, q, strict=True)) / 2))


def test_verdict_against_brute_force(docs, rows):
    texts = {}
    for _, t, lang, _ in rows:
        texts.setdefault(lang or "", []).append(t)

    def medians(group):
        group = [t for t in group if classes(t)[5] >= 19]
        if len(group) < 20:
            return None
        m = [sorted(10_000 * classes(t)[k] // len(t) for t in group)[(len(group) - 1) // 2] + 0.5 for k in range(7)]
        return [x / sum(m) for x in m]

    pooled, chars, words = medians([t for g in texts.values() for t in g]), {}, {}
    for lang, group in texts.items():
        if m := medians(group):
            chars[lang] = m
            count = Counter(w for t in group for w in re.findall(r"[a-z]+", t.lower()))
            top = sorted(count, key=lambda w: (-count[w], w))[:24]
            shares = [count[w] / count.total() for w in top]
            words[lang] = top, [*shares, max(0.0, 1 - sum(shares))]
    assert set(chars) == {"", "en", "xx"}
    got = {r["doc_id"]: r for r in quality.apply_quality_rules(docs).collect()}
    rejected = 0
    for i, t, lang, own in rows:
        r, q = got[i], got[i]["quality_"]
        assert r["quality"] == own
        n, plain = len(t.split()), re.findall(r"[a-z]+", t.lower())
        cd = distance([c / len(t) for c in classes(t)], chars.get(lang or "", pooled)) if n >= 40 else None
        wd = None
        if n >= 40 and plain and (lang or "") in words:
            top, shares = words[lang or ""]
            p = [plain.count(w) / len(plain) for w in top]
            wd = distance([*p, 1 - sum(p)], shares)
        assert q.char_distance == (None if cd is None else pytest.approx(cd)) and q.word_distance == (None if wd is None else pytest.approx(wd, abs=1e-6))
        good = not q.base_failed and (cd or 0) <= 0.25 and (wd is None or cd + wd <= 0.2 + 3 / math.sqrt(n))
        assert q.kept == good
        rejected += not good and not q.base_failed
    assert rejected > 5


def test_against_sql(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(oracles.ORACLE_SQL["op3_quality_rules"])
    got = queries.op3_quality_rules(spark, str(tmp_path))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_odd_rows(spark):
    long = "The stone of the river and a garden. " * 30_000
    rows = [(None, None, "en", 1), (1, "", None, 1), (2, long, "en", 1), (2, long, "en", 1), (3, "x", None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, N_WORDS int")
    got = quality.apply_quality_rules(d).collect()
    assert len(got) == 5 and all(r.quality.base_failed and not r.quality.kept for r in got)
    assert {r.quality.n_words for r in got} == {0, 1, 240_000}
    assert quality.apply_quality_rules(d.limit(0)).count() == 0


def test_pipeline_stage_with_clashing_names(spark, docs):
    now = corpus_pipeline.quality_rules(spark, docs, "")
    assert now.columns == docs.columns and 0 < now.count() < docs.count()


def test_windows_found_by_probes_at_all_places(spark):
    every, at, width, size = quality.PROBE_EVERY, quality.PROBE_AT, quality.PROBE, quality.WINDOW
    assert {(a - b) % every for a in at for b in at} == set(range(every)) and every - 1 + width <= size
    rows = []
    for first in range(6):
        for gap in range(14):
            for n in (size - 1, size, size + 3):
                again = [f"r{k}" for k in range(n)]
                rows.append((len(rows), " ".join([f"a{k}" for k in range(first)] + again + [f"b{k}" for k in range(gap)] + again), "en"))
        rows += [(len(rows) + k, " ".join(["x", "y", "z"][: k + 1] * 9)[: 18 + 2 * first], "en") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["n"] for r in quality.apply_quality_rules(docs, quality.References({}, {}, {})).select("doc_id", "quality.n_repeat_words").toDF("doc_id", "n").collect()}
    for i, text, _ in rows:
        w = text.split()
        seen = Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
        hit = {k + j for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] > 1 for j in range(size)}
        assert got[i] == len(hit), text
