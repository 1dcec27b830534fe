"""Secret scans: candidates by form, judged by a random forest.

Candidates are long runs of token characters that hold a digit or change to capitals several times, values assigned to
credential names, and private key blocks. A random forest on length, character transitions, dictionary coverage, path and neighbouring words,
trained on labelled findings, removes the false positives.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiddenpath.llm.common import blocks, word_spans

TRAINING_FINDINGS, TREES, DEPTH, LEAST_LEAF = 4000, 40, 9, 4
#: Shortest run of token characters, and bytes looked at before and after a candidate.
LEAST_LENGTH, NEAR = 16, 48
#: Changes from small to capital letters that a run of token characters without a digit needs.
LEAST_CAPITALS = 3
MASK = "[SECRET]"

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "_-+/=.")]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER, _SMALL = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _SMALL[97:123] = True
_ASSIGN = np.zeros(256, bool)
_ASSIGN[[ord("="), ord(":")]] = True

#: Bytes that end a value without quotes, and what stands where a quoted one may end: a quote mark, or the line's end.
_BARE_STOP = np.zeros(256, bool)
_BARE_STOP[list(b"\"' \t\n\r\f\v,;")] = True
_QUOTES = {b: np.isin(np.arange(256), [b, 10, 13]) for b in b"\"'"}
#: Shortest values in quotes and without.
LEAST_QUOTED, LEAST_BARE = 6, 8

# Words near credentials, words near other long strings, path parts of files without live secrets, and
# common parts of identifiers and placeholders.
CREDENTIAL = "token secret password passwd pwd apikey api_key api-key access_key accesskey auth authorization bearer credential credentials private client_secret key login".split()
OTHER = "sha sha1 sha256 md5 hash checksum digest commit revision uuid guid id version build integrity etag session order phone card invoice isbn".split()
DUMMY_PATHS = "test tests spec mock fixture fixtures example examples sample docs doc readme tutorial demo".split()
DICTIONARY = (
    "the and for with you your that this here from test example sample demo change changeme placeholder dummy fake foo bar baz name user value string secret "
    "password token key default config service server client production staging local host http https www com org net version release build file path data base "
    "image table index list item page blog post home about contact main node module package import export class function return true false null none todo insert replace enter"
).split()
#: Words of pass phrases, other than the dictionary's.
PHRASES = "correct horse battery staple orange river window seven dragon purple coffee mountain silver rabbit winter garden copper falcon pencil velvet thunder".split()
_WORDS = frozenset(w for w in DICTIONARY if len(w) >= 3)
_NAME = re.compile(rb"(?:token|secret|passw(?:or)?d|pwd|passphrase|api[_-]?key|access[_-]?key|auth|credential|private|login|bearer|(?<![A-Za-z])key)[\w-]*[\"']?\s*$", re.I)
_OPEN = re.compile(rb"\s*([\"']?)")
_KEY = re.compile(rb"-----(BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----")
_KEY_BODY = re.compile(rb"(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})*")
#: A last line of a body that is shorter: padded, or alone on its line and no word.
_KEY_TAIL = re.compile(rb"(?:\s|\\[nr])*(?:[A-Za-z0-9+/]{1,15}={1,2}|(?=[A-Za-z]?[a-z]*[0-9+/A-Z])[A-Za-z0-9+/]{1,15}(?=[ \t]*(?:[\r\n]|\\[nr]|$)))")
_NEAR_WORD = re.compile(r"[a-z0-9_-]+")
_CLASS = {**{c: 0 for c in string.ascii_lowercase}, **{c: 1 for c in string.ascii_uppercase}, **{c: 2 for c in string.digits}}


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at leaves), threshold, left and right child, probability."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                go = rows[np.arange(len(rows)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            total += share[at]
        return total / max(len(self.trees), 1)


def fit_forest(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, seed: int = 5) -> Forest:
    """CART trees on bootstrap samples, each split the best of sqrt(features) features by Gini impurity."""
    rng = np.random.Generator(np.random.Philox(key=seed))
    n, m = rows.shape
    out = []
    for _ in range(trees):
        feature, threshold, left, right, share = [], [], [], [], []

        def grow(idx: np.ndarray, depth: int) -> int:
            at = len(feature)
            p = float(labels[idx].mean())
            for x, v in ((feature, -1), (threshold, 0.0), (left, at), (right, at), (share, p)):
                x.append(v)
            if depth == DEPTH or p in (0.0, 1.0) or len(idx) < 2 * LEAST_LEAF:
                return at
            best = (1e-9, None)
            for f in rng.choice(m, max(1, int(m**0.5) + 1), replace=False):
                order = idx[np.argsort(rows[idx, f], kind="stable")]
                v, y = rows[order, f], np.cumsum(labels[order])
                k = np.arange(1, len(idx))
                ok = (v[1:] > v[:-1]) & (k >= LEAST_LEAF) & (len(idx) - k >= LEAST_LEAF)
                if not ok.any():
                    continue
                a, b = y[:-1] / k, (y[-1] - y[:-1]) / (len(idx) - k)
                gain = p * (1 - p) - (k * a * (1 - a) + (len(idx) - k) * b * (1 - b)) / len(idx)
                gain[~ok] = -1
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (float(gain[j]), (int(f), float((v[j] + v[j + 1]) / 2)))
            if best[1] is not None:
                f, t = best[1]
                go = rows[idx, f] <= t
                if go.all():
                    return at
                feature[at], threshold[at] = f, t
                left[at] = grow(idx[go], depth + 1)
                right[at] = grow(idx[~go], depth + 1)
            return at

        grow(rng.integers(0, n, n), 0)
        out.append((np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(share)))
    return Forest(out)


def features(value: str, before: str, after: str, path: str) -> list[float]:
    n = max(len(value), 1)
    classes = [_CLASS.get(c, 3) for c in value]
    moves = [0.0] * 16
    for a, b in zip(classes, classes[1:]):
        moves[4 * a + b] += 1 / n
    counts = {c: value.count(c) for c in set(value)}
    entropy = -sum(k / n * np.log2(k / n) for k in counts.values())
    low, covered, i = value.lower(), 0, 0
    while i < len(low):
        step = next((k for k in range(min(12, len(low) - i), 2, -1) if low[i : i + k] in _WORDS), 0)
        covered += step
        i += step or 1
    runs = sum(a == b for a, b in zip(value, value[1:])) / n
    near = set(_NEAR_WORD.findall(before.lower()[-NEAR:])) | set(_NEAR_WORD.findall(after.lower()[:NEAR]))
    last = (_NEAR_WORD.findall(before.lower()) or [""])[-1]
    parts = set(re.split(r"[^a-z]+", path.lower()))
    hexa = all(c in "0123456789abcdefABCDEF" for c in value)
    return [
        n, entropy, covered / n, runs, len(counts) / n, *moves, *[classes.count(k) / n for k in range(4)],
        float(hexa), float(bool(near & set(CREDENTIAL))), float(bool(near & set(OTHER))), float(any(w in last for w in CREDENTIAL)), float(last in OTHER),
        float(bool(parts & set(DUMMY_PATHS))), float(before.rstrip()[-1:] in ("=", ":", '"', "'")), float(value[:1] in "$<{%"), float("." in value), float("/" in value),
        float(bool(re.match(r"AKIA|gh[pousr]_|sk_|xox[abp]-|eyJ|-----BEGIN", value))), float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
    ]


def labelled_findings(count: int = TRAINING_FINDINGS, seed: int = 5) -> Iterator[tuple[str, str, str, str, int]]:
    """Generated findings: value, text before, text after, path and label (1: a live secret)."""
    rng = random.Random(seed)
    hexa, mixed = "0123456789abcdef", string.ascii_letters + string.digits

    def some(alphabet: str, n: int) -> str:
        return "".join(rng.choices(alphabet, k=n))

    def prose() -> str:
        return " ".join("".join(rng.choices(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "the", "ing"), k=rng.randint(1, 4))) for _ in range(6))

    def name() -> str:
        return rng.choice(("", "db_", "my_", "aws_", "service_", "GITHUB_", "prod_")) + rng.choice(CREDENTIAL)

    for _ in range(count):
        path = rng.choice(("src1", "src17", "app/config.py", "deploy/prod.env", "lib/main.go", "settings.yml", ""))
        end = rng.choice(('"', "'", "", ";")) + rng.choice((" ", "\n")) + prose()
        assign = f"{prose()} {name()}{rng.choice((' = ', '=', ': ', ' := '))}{rng.choice(('\"', chr(39), ''))}"
        if rng.random() < 0.5:
            value = rng.choice(
                (some(hexa, rng.choice((32, 40, 40, 48, 64))), some(mixed, rng.choice((20, 24, 32, 40, 64))), "AKIA" + some(string.ascii_uppercase + string.digits, 16), "ghp_" + some(mixed, 36),
                 "sk_live_" + some(mixed, 24), f"xoxb-{some(string.digits, 12)}-{some(mixed, 24)}", f"eyJ{some(mixed, 30)}.eyJ{some(mixed, 60)}.{some(mixed + '_-', 43)}", some(mixed + "+/", 40), some(mixed + "!@#%^*", rng.randint(10, 20)))
            )
            plain = value[:4] in ("AKIA", "ghp_", "sk_l", "xoxb") and rng.random() < 0.4
            if rng.random() < 0.06:
                kind = rng.choice(("", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "))
                body = "\n".join(some(mixed + "+/", 64) for _ in range(rng.randint(2, 26)))
                value, plain = f"-----BEGIN {kind}PRIVATE KEY-----\n{body}" + f"\n-----END {kind}PRIVATE KEY-----" * (rng.random() < 0.8), True
            elif rng.random() < 0.1:
                value = some(string.ascii_letters, rng.choice((20, 24, 32, 40)))
            elif rng.random() < 0.07:  # a pass phrase, or a value with quote marks of the other kind
                value = " ".join([*rng.choices(PHRASES, k=rng.randint(2, 5)), *[some(mixed, rng.randint(1, 3)) for _ in range(rng.randint(1, 2))]]) if rng.random() < 0.6 else some(mixed, 6) + "'" + some(mixed + "!?.", rng.randint(10, 24))
                plain = False
            yield value, f"{prose()} " if plain else assign, end, path, 1
            continue
        word = rng.choice(OTHER)
        kind = rng.random()
        if kind < 0.3:  # a digest or an identifier
            value = rng.choice((some(hexa, rng.choice((32, 40, 64))), some(hexa, 8) + "-" + "-".join(some(hexa, 4) for _ in range(3)) + "-" + some(hexa, 12), some(string.digits, rng.randint(16, 22))))
            yield value, f"{prose()} {word}{rng.choice((' ', ': ', '='))}", f" {prose()}", path, 0
        elif kind < 0.5:  # a placeholder
            body = rng.choice((" ... ", " <your key here> ", "\n[...]\n", " and then ", "\nxxxxxxxxxxxxxxxxxxxxxxxx\n"))
            value = rng.choice((f"-----BEGIN {rng.choice(('', 'RSA '))}PRIVATE KEY-----{body}-----END PRIVATE KEY-----", "x" * rng.randint(16, 40), "your_token_here_" + some(string.digits, 2), "changeme" + some(string.digits, 3), "example-secret-key-000000", "${SECRET_TOKEN_1}", "<your-api-key-01>", "0" * rng.randint(16, 40), "1234567890" * rng.randint(2, 4), "test_token_1234567890", "dummy-password-123", "replace_with_token_1"))
            yield value, assign, end, path, 0
        elif kind < 0.65:  # bare numbers and links in prose
            value = rng.choice((some(string.digits, rng.randint(16, 20)), f"www.{some(string.ascii_lowercase, 9)}.com/page/{some(string.digits, 4)}", f"{some(string.ascii_lowercase, 8)}.{some(string.digits, 2)}-{some(string.ascii_lowercase, 7)}.example.com", f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.0-release-{some(string.digits, 6)}", f"{rng.randint(1, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}-{some(string.digits, 6)}"))
            yield value, f"{prose()} ", f" {prose()}", path, 0
        elif kind < 0.8:  # looks live, in a file of examples
            value = rng.choice((some(hexa, 40), some(mixed, 32), "AKIA" + some(string.ascii_uppercase + string.digits, 16)))
            yield value, assign, end, rng.choice(("tests/test_auth.py", "docs/readme.md", "examples/demo.py", "spec/fixtures/key.rb")), 0
        elif kind < 0.85:  # a sentence in quotes
            value = rng.choice((prose(), " ".join(rng.choices(DICTIONARY, k=rng.randint(3, 8))), f"{prose()} {rng.randint(1, 99)}, {prose()}", f"please {' '.join(rng.choices(DICTIONARY, k=4))}", prose().capitalize() + "."))
            yield value, assign, end, path, 0
        else:  # code and words
            value = rng.choice(("_".join(rng.choices(DICTIONARY, k=4)) + some(string.digits, 1), "-".join(rng.choices(DICTIONARY, k=4)) + "-2", "/".join(rng.choices(DICTIONARY, k=4)) + "/1", ".".join(rng.choices(DICTIONARY, k=3)) + "2", "".join(w.capitalize() for w in rng.choices(DICTIONARY, k=rng.randint(4, 6))), "".join(w.capitalize() for w in prose().split())))
            yield value, rng.choice((assign, f"{prose()} ")), end, path, 0


def train_default(count: int = TRAINING_FINDINGS) -> Forest:
    rows = list(labelled_findings(count))
    return fit_forest(np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows], float))


def _value(data: bytes, k: int, end: int, quotes: dict[int, np.ndarray], bare: np.ndarray) -> tuple[int, int] | None:
    """The whole value assigned at ``k``: in quotes up to the same mark on its line, which no backslash escapes, blanks and other
    marks inside; else, or where that mark is missing, up to a blank or another stop."""
    m = _OPEN.match(data, k, end)
    a = m.end()
    if m[1]:
        ends = quotes[m[1][0]]
        j = int(np.searchsorted(ends, a))
        while j < len(ends) and ends[j] < end and data[ends[j]] == m[1][0]:
            b = int(ends[j])
            escapes = b - len(data[a:b].rstrip(b"\\")) - a
            if not escapes % 2:
                return (a, b) if b - a >= LEAST_QUOTED else None
            j += 1
    j = int(np.searchsorted(bare, a))
    b = min(int(bare[j]), end) if j < len(bare) else end
    return (a, b) if b - a >= LEAST_BARE else None


def _private_keys(data: bytes, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Key blocks: to the end mark if no other block begins before it, else as far as the lines of a body go."""
    marks = list(_KEY.finditer(data, lo, hi))
    for m, after in zip(marks, [*marks[1:], None]):
        if m[1] == b"BEGIN":
            if after is not None and after[1] == b"END":
                yield m.start(), after.end()
            elif (body := _KEY_BODY.match(data, m.end(), hi)).end() > m.end():
                tail = _KEY_TAIL.match(data, body.end(), hi)
                yield m.start(), tail.end() if tail else body.end()


def candidates(raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, str]]:
    """Row, start, end (in the block's bytes) and kind, without overlaps, in order; what overlaps is one, of the union of spans."""
    data = raw.tobytes()
    s, e, _ = word_spans(raw, at, _TOKEN)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    rises = np.zeros(len(raw) + 1, np.int64)
    rises[2:] = np.cumsum(_UPPER[raw[1:]] & _SMALL[raw[:-1]])
    # a rise at a run's first byte would need a letter before it, which would belong to the run
    long = np.flatnonzero((e - s >= LEAST_LENGTH) & ((digits[e] > digits[s]) | (rises[e] - rises[s] >= LEAST_CAPITALS)))
    found = []
    for a, b in zip(s[long].tolist(), e[long].tolist(), strict=True):
        k = data.rfind(b"=", a, b - 2)
        name = _NAME.search(data[max(a, k - NEAR) : k]) if k > a else None
        a = k + 1 if name else a  # name=value without blanks
        while b > a and data[b - 1 : b] == b".":
            b -= 1
        if b - a >= LEAST_LENGTH:
            found.append((a, b, "token"))
    quotes, bare = {b: np.flatnonzero(table[raw]) for b, table in _QUOTES.items()}, np.flatnonzero(_BARE_STOP[raw])
    for k in np.flatnonzero(_ASSIGN[raw]).tolist():
        row = int(np.searchsorted(at, k, "right")) - 1
        if _NAME.search(data[max(int(at[row]), k - NEAR) : k]) and (span := _value(data, k + 1, int(at[row + 1]), quotes, bare)):
            found.append((*span, "assigned"))
    if b"PRIVATE KEY-----" in data:
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            found += [(*x, "private_key") for x in _private_keys(data, lo, hi)]
    rank = {"private_key": 0, "assigned": 1, "token": 2}
    taken: list[tuple[int, int, str]] = []
    for x in sorted(found, key=lambda x: (x[0], rank[x[2]])):
        if not taken or x[0] >= taken[-1][1]:
            taken.append(x)
        else:
            a, b, kind = taken[-1]
            taken[-1] = (a, max(b, x[1]), min(kind, x[2], key=rank.__getitem__))
    rows = np.searchsorted(at, [x[0] for x in taken], "right") - 1 if taken else []
    return [(int(r), *x) for r, x in zip(rows, taken, strict=True)]


_FINDING = "array<struct<start: int, end: int, kind: string, score: double, secret: boolean>>"
_FINDING_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64()), ("secret", pa.bool_())]))


def _scan(batches: Iterator[pa.RecordBatch], forest: Forest, least_score: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, paths = batch.column("scan_text"), batch.column("scan_path")
        for lo, hi, raw, at in blocks(texts):
            found = candidates(raw, at)
            per: list[list[dict]] = [[] for _ in range(hi - lo)]
            items, rows = [], []
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]) if found else None
            for r, a, b, kind in found:
                begin, end = int(at[r]), int(at[r + 1])
                value, before, after = (raw[x:y].tobytes().decode("utf-8", "replace") for x, y in ((a, b), (max(begin, a - NEAR), a), (b, min(end, b + NEAR))))
                rows.append(features(value, before, after, paths[lo + r].as_py() or ""))
                items.append({"start": int(chars[a] - chars[begin]), "end": int(chars[b] - chars[begin]), "kind": kind})
                per[r].append(items[-1])
            for item, score in zip(items, forest.predict(np.array(rows)).tolist() if rows else [], strict=True):
                item |= {"score": score, "secret": score >= least_score}
            masked = texts.slice(lo, hi - lo)
            if any(x["secret"] for x in items):
                new = masked.to_pylist()
                for i, p in enumerate(per):
                    if p:
                        spans = [(x["start"], x["end"]) for x in p if x["secret"]]
                        kept = [new[i][a:b] for a, b in zip([0, *[x[1] for x in spans]], [*[x[0] for x in spans], len(new[i])], strict=True)]
                        new[i] = MASK.join(kept)
                masked = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), pa.array(per, _FINDING_TYPE), masked], names=["row", "findings", "masked"])


def scan_secrets(docs: DataFrame, forest: Forest | None = None, path: str | None = "source", least_score: float = 0.5) -> DataFrame:
    """Findings in whole texts: ``row`` (a struct of all columns of ``docs``), ``findings`` and ``masked``, a row per input row.

    ``docs`` has ``text`` and, if named, the column ``path``. A finding has start and end in characters, the
    candidate's kind, the forest's score and whether it is taken for a secret: at ``least_score`` and more. ``masked``
    is the text with every secret replaced by MASK. Null texts have no findings and stay null; null paths
    count as empty; rows that repeat are scanned each; an empty table gives an empty result. Shortest candidates: LEAST_LENGTH
    bytes by form alone, LEAST_QUOTED in quotes and LEAST_BARE without behind a credential's name.
    """
    forest = forest or train_default()
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("scan_text"), where.alias("scan_path"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, findings {_FINDING}, masked string"
    return rows.mapInArrow(partial(_scan, forest=forest, least_score=least_score), schema)
