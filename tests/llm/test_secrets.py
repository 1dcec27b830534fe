"""Secret scans: key blocks, values without digits, many candidates, odd rows, held-out findings."""

import random
import string
import time

import numpy as np
import pytest

from hiddenpath.llm import secret_scan

MIXED = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def forest():
    return secret_scan.train_default()


@pytest.fixture(scope="module")
def scan(spark, forest):
    def run(texts):
        d = spark.createDataFrame([(i, t, "src1", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, findings string")
        return [r for r in sorted(secret_scan.scan_secrets(d, forest).collect(), key=lambda r: r.row.doc_id)]

    return run


def test_private_keys(scan):
    rng = random.Random(1)
    body = "\n".join("".join(rng.choices(MIXED + "+/", k=64)) for _ in range(12))
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    got = scan([f"a {head}\n{body}\n{end} b", f"a {head}\n{body}\nthe rest stays", f"The header {head} opens a file. More prose.", f"{head} ... {end} is the form."])
    assert [r.masked for r in got] == ["a [SECRET] b", "a [SECRET]\nthe rest stays", f"The header {head} opens a file. More prose.", f"{head} ... {end} is the form."]
    assert [[f.kind for f in r.findings] for r in got] == [["private_key"], ["private_key"], [], ["private_key"]]


def test_values_without_digits(scan):
    value = "QmZxTrWpLkVbNsDfGhJyUiEoAcRtYqMw"
    got = scan([f"the key {value} here", "See ReleaseNotesIndexPage and HomePageImageList here"])
    assert got[0].findings[0].start == 8 and got[0].findings[0].end == 8 + len(value)
    assert not any(f.secret for f in got[1].findings)


def test_masks_are_the_spans(scan):
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        parts = []
        for value, before, after, _, _ in secret_scan.labelled_findings(rng.randint(0, 6), seed=rng.randrange(10**6)):
            parts.append(f"é{before}{value}{after}😀")
        texts.append(" ".join(parts))
    for r, t in zip(scan(texts), texts, strict=True):
        out, at = [], 0
        for f in r.findings:
            assert at <= f.start < f.end <= len(t)
            if f.secret:
                out += [t[at : f.start], secret_scan.MASK]
                at = f.end
        assert r.masked == "".join([*out, t[at:]])


def test_many_candidates_take_linear_time(forest):
    rng = random.Random(5)
    import pyarrow as pa

    def seconds(n):
        text = " ".join("é token=" + "".join(rng.choices(MIXED, k=24)) for _ in range(n)) + "-----BEGIN PRIVATE KEY-----" * n + "token" * n + "/x=1"
        batch = pa.RecordBatch.from_pydict({"row": [1], "scan_text": [text], "scan_path": [""]})
        began = time.perf_counter()
        list(secret_scan._scan(iter([batch]), forest, 0.5))
        return time.perf_counter() - began

    seconds(100)
    assert seconds(8_000) < 3 * max(seconds(4_000), 0.2)


def test_held_out_findings(forest):
    held = list(secret_scan.labelled_findings(1500, seed=78))
    p = forest.predict(np.array([secret_scan.features(*r[:4]) for r in held])) >= 0.5
    y = np.array([r[4] for r in held]) == 1
    assert (p & y).sum() >= 0.93 * y.sum() and (p & y).sum() >= 0.93 * p.sum()


def test_odd_rows(spark, forest):
    long = "plain words here " * 60_000 + "token = 'aB3dE5gH7jK9mN1pQ3sT5vW7'"
    rows = [(1, None, "s"), (None, "", None), (2, long, None), (2, long, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secret_scan.scan_secrets(d, forest).collect()
    assert len(got) == 4 and sum(r.masked is None for r in got) == 1 and sum(r.masked == "" for r in got) == 1
    assert {r.masked[-10:] for r in got if r.row.doc_id == 2} == {"'[SECRET]'"}
    assert {f.score for r in got if r.row.doc_id == 2 for f in r.findings} == {got[-1].findings[0].score}
    tie = got[-1].findings[0].score
    assert all(f.secret for r in secret_scan.scan_secrets(d.where("doc_id = 2"), forest, least_score=tie).collect() for f in r.findings)
    assert secret_scan.scan_secrets(d.limit(0), forest).count() == 0


def test_quotes_blanks_and_last_lines(scan):
    """A value ends at its own quote mark, holds blanks inside quotes, and a key block's short last line belongs to it."""
    rng = random.Random(9)
    long = "".join(rng.choices(MIXED + "!?.", k=30))
    body = "\n".join("".join(rng.choices(MIXED + "+/", k=64)) for _ in range(6))
    head = "-----BEGIN PRIVATE KEY-----"
    texts = [f"secret = \"abcdef'{long}\" end", "password = \"correct horse 7 battery staple Q9\" end", f"a {head}\n{body}\npbpeIeeNsXE=\nmore prose", f"a {head}\n{body}\nx9Tq\n\nmore", f"a {head}\n{body}\nThen it goes on", f'token = "{long}\\"{long}" end', f"token: 'unclosed{long[:8]}1 rest\nnext' line"]
    got = scan(texts)
    assert [r.masked for r in got[:6]] == ['secret = "[SECRET]" end', 'password = "[SECRET]" end', "a [SECRET]\nmore prose", "a [SECRET]\n\nmore", "a [SECRET]\nThen it goes on", 'token = "[SECRET]" end']
    assert texts[6][got[6].findings[0].start : got[6].findings[0].end] == f"unclosed{long[:8]}1"


def plain_assigned(text):
    """Values assigned to credential names, character by character."""
    names = ("token", "secret", "password", "passwd", "pwd", "passphrase", "api_key", "api-key", "apikey", "access_key", "accesskey", "auth", "credential", "private", "login", "bearer")
    out = []
    for k, c in enumerate(text):
        if c not in "=:":
            continue
        left = text[:k].rstrip()
        left = left[:-1] if left[-1:] in ("'", '"') else left
        word = left[len(left.rstrip(string.ascii_letters + string.digits + "_-")) :].lower()
        if not any(n in word for n in names) and not any(p.startswith("key") for p in word.replace("-", "_").split("_")):
            continue
        a = k + 1
        while a < len(text) and text[a] in " \t\n":
            a += 1
        mark = text[a] if a < len(text) and text[a] in "'\"" else ""
        b = a + len(mark)
        while mark and b < len(text) and text[b] != mark and text[b] != "\n":
            b += 1
        if mark and b < len(text) and text[b] == mark:
            if b - a - 1 >= 6:
                out.append((a + 1, b))
            continue
        a = b = a + len(mark)
        while b < len(text) and text[b] not in "\"' \t\n,;":
            b += 1
        if b - a >= 8:
            out.append((a, b))
    return out


def test_candidates_against_a_plain_finder():
    rng = random.Random(21)
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            name = rng.choice(("token", "db_password", "api-key", "login", "colour", "key", "monkey", "size", "my_secret_2", "bearer"))
            value = rng.choice(("a b9c d", "short", "abcdefgh", "it's 9 o'clock", "Q7-x_9", "", "one,two;three", "x" * 30))
            mark = rng.choice(("'", '"', "", "«"))
            parts.append(f"{name}{rng.choice((' = ', '=', ': ', '\": '))}{mark}{value}{rng.choice((mark, mark, ''))}{rng.choice((' ', chr(10), ', '))}")
        text = "".join(parts)
        raw = np.frombuffer(text.encode(), np.uint8)
        got = [(a, b) for _, a, b, _ in secret_scan.candidates(raw, np.array([0, len(raw)]))]
        for a, b in plain_assigned(text):
            a, b = (len(text[:x].encode()) for x in (a, b))
            assert any(x <= a and b <= y for x, y in got), (text, a, b)
