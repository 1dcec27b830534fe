"""The pipeline as a whole against brute force, rows as its unit, empty tables, the shared folder."""

import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hiddenpath.llm import common, quality, secret_scan

WORDS = "the of and to in is that river stone garden window bridge teacher winter market letter".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality int, row_print string"


def documents():
    rng = random.Random(12)
    out = []

    def add(i, t):
        out.append((i, t, rng.choice(("en", "en", None)), "src1", len(t or ""), 1, "x"))

    texts = [" ".join(rng.choices(WORDS, k=rng.randint(30, 90))).capitalize() + "." for _ in range(60)]
    for i, t in enumerate(texts):
        add(100 - i, t)
    for k in range(10):
        w = texts[k].split()
        w[3] = "changed"
        add(200 + k, " ".join(w))
        add(300 + k, texts[20 + k])
    add(100, texts[0])  # a repeated row
    add(100, texts[1])  # another text of the same doc_id
    add(41, " ".join(texts[2].split()[:25]) + " benchone two three four five six seven eight nine ten eleven")
    add(400, " ".join(rng.choices(WORDS, k=40)) + " api_key = 'aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5' end.")
    add(None, " ".join(rng.choices(WORDS, k=40)))
    add(401, None)
    add(402, "")
    add(403, "# $ % " * 50)
    return out


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_run_against_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "benchone two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # the quality verdict and the masks have brute-force tests of their own
    now = [(r["doc_id"], r["text"]) for r in quality.apply_quality_rules(docs).where("quality_.kept").collect()]
    assert 60 < len(now) < len(rows) - 2
    now = sorted(set(now), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (spaced(t) for _, t in now)]
    top = list(range(len(now)))
    for a in range(len(now)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(top, a), find(top, b)
                top[max(x, y)] = min(x, y)
    kept = [r for k, r in enumerate(now) if find(top, k) == k]
    clean = [(i, t) for i, t in kept if "benchone two three four five six seven eight nine ten" not in t]
    assert len(clean) < len(kept) < len(now)
    masked = {(r.row.doc_id, r.row.text): r.masked for r in secret_scan.scan_secrets(spark.createDataFrame([(i, t, "src1") for i, t in clean], "doc_id long, text string, source string")).collect()}
    assert sum(t != m for (_, t), m in masked.items()) == 1
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((-1 if i is None else i, len(tok.encode(m, add_special_tokens=False).ids) + 1) for (i, _), m in masked.items())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # rows of equal doc_id and text are in any order, and no text here is over one sequence
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.length) for r in out) == want
    assert all(r.piece == 0 and r.start == 0 for r in out)


def find(top, k):
    while top[k] != k:
        k = top[k]
    return k


def test_stages_keep_rows(spark, tmp_path):
    """Rows are removed, not doc_ids; every stage but the last gives the columns of documents."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a, None, None, 0, 1, "x"), (1, a, None, None, 0, 1, "x"), (1, b, None, None, 0, 1, "x"), (2, b, None, None, 0, 1, "x"), (None, a, None, None, 0, 1, "x"), (None, None, None, None, 0, 1, "x")]
    d = spark.createDataFrame(rows, SCHEMA)
    near = corpus_pipeline.near_duplicates(spark, d, "")
    assert near.columns == d.columns
    assert sorted(map(str, (r[:2] for r in near.collect()))) == sorted(map(str, [(1, a), (1, b), (None, None)]))
    spark.createDataFrame([(1, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.benchmark_decontamination(spark, d, str(tmp_path))
    assert clean.columns == d.columns
    assert sorted(map(str, (r[:2] for r in clean.collect()))) == sorted(map(str, [(1, b), (2, b), (None, None)]))
    none = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        common.use_shared_dir(Session())
