"""Files of sequences and models: FASTA, block text sets, XML models, profile models, and JSON of our own."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hiddenpath.functions.folds import encode
from hiddenpath.model import Component, ContinuousHmm, DiscreteHmm, Hmm


def read_fasta(spark: SparkSession, path: str, alphabet: tuple) -> DataFrame:
    """``seq_id`` (the header), ``obs``: records whose symbols are all in ``alphabet`` (single characters); others are dropped."""
    records = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    lines = F.split("value", "\r?\n")
    body = F.array_join(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x)), "")
    obs = encode(F.filter(F.split(body, ""), lambda c: c != ""), alphabet)
    return records.select(F.trim(lines[0]).alias("seq_id"), obs.alias("obs")).where(F.forall("obs", lambda i: i.isNotNull()))


def write_fasta(seqs: DataFrame, path: str, alphabet: tuple, width: int = 70) -> None:
    letters = F.array(*[F.lit(str(s)) for s in alphabet])
    text = F.array_join(F.transform("obs", lambda i: F.get(letters, i)), "")
    wrapped = F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")
    seqs.select(F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit("\n"), wrapped).alias("value")).write.text(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Block text sets, ``SEQ = {...}`` of whole numbers or ``SEQD = {...}`` of reals: ``set_id, pos, obs`` (reals), ``label, id, weight``.

    Each row of a block may start with ``<label>``, ``(id)`` and ``|weight|``. ``set_id`` counts the blocks of a file, ``pos`` the rows
    of a block. ``#`` starts a remark. Files are read by lines, and running counts tell the statements: no row holds a whole file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "#.*$", "").alias("v"))
    pieces = lines.select("file", "split", "line", F.posexplode(F.split("v", "(?<=[;{}])")).alias("k", "piece"))
    place = ["split", "line", "k"]
    earlier = Window.partitionBy("file").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.withColumn("part", F.coalesce(F.count_if(F.col("piece").rlike("[;{}]$")).over(earlier), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, "piece"))), lambda p: p["piece"]), " ")
    parts = numbered.groupBy("file", "part").agg(text.alias("text"))
    so_far = Window.partitionBy("file").orderBy("part")
    opened = F.when(F.col("text").endswith("{"), F.regexp_extract("text", r"(\w+)\s*=\s*\{$", 1)).when(F.col("text").endswith("}"), "")
    body = F.trim(F.regexp_replace(F.regexp_replace("text", "[;}]$", ""), r"\s+", " "))
    inside = F.last(opened, ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    sets = F.count_if(F.coalesce(opened == "O", F.lit(False))).over(so_far)
    rows = parts.select("file", "part", body.alias("row"), inside.alias("inside"), (sets - 1).cast("int").alias("set_id"), F.col("text").endswith("{").alias("opens")).where("inside = 'O' and not opens and row <> ''")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("file", "set_id").orderBy("part")) - 1)
    values = F.transform(F.filter(F.split(F.regexp_replace("row", r"<[^>]*>|\([^)]*\)|\|[^|]*\|", " "), r"[\s,]+"), lambda x: x != ""), lambda x: x.cast("double"))

    def head(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("row", pattern, 1), F.lit("")).cast("double")

    return rows.select("set_id", "pos", values.alias("obs"), head(r"<\s*([^>]*?)\s*>").alias("label"), head(r"\(\s*([^)]*?)\s*\)").alias("id"), F.coalesce(head(r"\|\s*([^|]*?)\s*\|"), F.lit(1.0)).alias("weight"))


def _framed(batches: Iterator[pa.RecordBatch], head: str, tail: str) -> Iterator[pa.RecordBatch]:
    empty = True
    for batch in batches:
        if empty and batch.num_rows:
            yield pa.RecordBatch.from_pydict({"value": [head]})
            empty = False
        yield batch
    if not empty:
        yield pa.RecordBatch.from_pydict({"value": [tail]})


def write_blocks(seqs: DataFrame, path: str, reals: bool = False) -> None:
    """One block per output file, a line per sequence; ``label`` and ``id`` are written where ``seqs`` has them."""
    def part(name: str, left: str, right: str) -> Column:
        return F.coalesce(F.concat(F.lit(left), F.col(name).cast("string"), F.lit(right)), F.lit(""))

    marks = [part(name, *ends) for name, ends in (("label", ("<", "> ")), ("id", ("(", ") ")), ("weight", ("|", "| "))) if name in seqs.columns]
    row = F.concat(F.lit("  "), *marks, F.array_join(F.transform("obs", lambda x: x.cast("string")), ", "), F.lit(";"))
    rows = seqs.where("size(obs) > 0").select(row.alias("value"))
    rows.mapInArrow(partial(_framed, head=f"{'SEQD' if reals else 'SEQ'} = {{\n O = {{", tail=" };\n};"), "value string").write.text(path)


def write_sequences_xml(seqs: DataFrame, path: str) -> None:
    """An XML document per output file, with the weight, id and items of each sequence (``weight`` and ``id`` where ``seqs`` has them)."""
    # Element and attribute names of the format
    head, tail = '<Sequences type="int" >\n <DiscretePD>', " </DiscretePD>\n</Sequences>"
    weight = F.round("weight").cast("long") if "weight" in seqs.columns else F.lit(1)
    name = F.coalesce(F.concat(F.lit(' id="seq'), F.col("id").cast("string"), F.lit('"')), F.lit("")) if "id" in seqs.columns else F.lit("")
    items = F.concat(F.lit("<!-- Length: "), F.size("obs"), F.lit(" --> "), F.array_join(F.transform("obs", lambda x: x.cast("string")), " "))
    row = F.concat(F.lit("  "), weight.cast("string"), F.lit(" <Sequence"), name, F.lit(">"), F.when(F.size("obs") > 0, items).otherwise(""), F.lit(" </Sequence>"))
    seqs.where("obs is not null").select(row.alias("value")).mapInArrow(partial(_framed, head=head, tail=tail), "value string").write.text(path)


def _numbers(text: str | None) -> list[float]:
    return [float(x) for x in re.split(r"[\s,]+", (text or "").strip()) if x]


def _one(node: ET.Element, *names: str) -> ET.Element | None:
    return next((x for x in node if x.tag in names), None)


def models_from_xml(text: str) -> list[Hmm]:
    """Models of an XML document: states with discrete tables or densities, classes of transitions, labels, backgrounds."""
    root = ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", text))
    return [_from_xml(x) for x in ([root] if root.tag == "HMM" else root.findall("HMM"))]


def _from_xml(node: ET.Element) -> Hmm:
    kind = node.get("type", "")
    symbols = [s.text or "" for s in (node.find("alphabet") if node.find("alphabet") is not None else [])]
    label_names = {s.get("code"): s.text or "" for s in (node.find("classAlphabet") if node.find("classAlphabet") is not None else [])}
    states = sorted(node.findall("state"), key=lambda s: int(s.get("id")))
    place = {s.get("id"): i for i, s in enumerate(states)}
    n, classes = len(states), int(node.get("transitionClasses", 1) or 1)
    pi, a = np.array([float(s.get("initial", 0)) for s in states]), np.zeros((classes, n, n))
    for t in node.findall("transition"):
        p = _numbers(t.findtext("probability"))
        for c in range(classes):
            a[c, place[t.get("source")], place[t.get("target")]] = p[c if len(p) > 1 else 0]
    labels = None
    if any(s.find("class") is not None for s in states):
        codes = [(s.findtext("class") or "").strip() for s in states]
        labels = [label_names.get(c, c) for c in codes]
    common = {"pi": pi, "a": a, "labels": labels, "name": node.get("name", ""), "prior": float(node.get("prior")) if node.get("prior") else None}
    if "continuous" in kind or any(s.find("mixture") is not None for s in states):
        fixed = frozenset(i for i, s in enumerate(states) if (_one(s, "mixture") is not None and _one(s, "mixture").get("fixed") == "1"))
        return ContinuousHmm(**common, fixed=fixed, components=[[_density(d) for d in s.find("mixture") if _kind(d.tag)] for s in states])
    tables, groups, fixed = [], {}, set()
    for i, s in enumerate(states):
        d = s.find("discrete")
        silent = s.find("silent") is not None or d is None
        tables.append([0.0] * len(symbols) if silent else _numbers(d.text))
        if d is not None and d.get("fixed") == "1":
            fixed.add(i)
        if tie := s.findtext("tiedTo"):
            groups.setdefault(tie.strip(), [place[tie.strip()]]).append(i)
    backgrounds = {b.get("key", str(k)): np.array(_numbers(b.text)) for k, b in enumerate(node.findall("background"))}
    return DiscreteHmm(**common, fixed=frozenset(fixed), b=tables, alphabet=tuple(symbols), ties=list(groups.values()), backgrounds=backgrounds)


def _kind(tag: str) -> str | None:
    return {"normal": "normal", "uniform": "uniform", "multinormal": "multinormal", "normalRightTail": "normal_right", "normalTruncatedRight": "normal_right", "normalLeftTail": "normal_left", "normalTruncatedLeft": "normal_left"}.get(tag)


def _density(d: ET.Element) -> Component:
    kind, number = _kind(d.tag), lambda k: float(d.get(k)) if d.get(k) is not None else None
    out = Component(kind, number("weight") if d.get("weight") else 1.0, fixed=d.get("fixed") == "1")
    if kind == "multinormal":
        out.mean = np.array(_numbers(d.findtext("mean")))
        out.var = np.array(_numbers(d.findtext("variance"))).reshape(len(out.mean), -1)
    else:
        out.mean, out.var, out.lo, out.hi = number("mean") or 0.0, number("variance") or 1.0, number("min"), number("max")
    return out


def models_to_xml(models: list[Hmm]) -> str:
    root = ET.Element("mixture", noComponents=str(len(models)))
    for m in models:
        node = ET.SubElement(root, "HMM", name=m.name, type="discrete" if isinstance(m, DiscreteHmm) else "continuous", transitionClasses=str(len(m.a)))
        if m.prior is not None:
            node.set("prior", repr(m.prior))
        if isinstance(m, DiscreteHmm):
            alphabet = ET.SubElement(node, "alphabet", id="0")
            for k, s in enumerate(m.alphabet):
                ET.SubElement(alphabet, "symbol", code=str(k)).text = str(s)
            for name, b in m.backgrounds.items():
                ET.SubElement(node, "background", key=name).text = ", ".join(map(repr, np.asarray(b, float).tolist()))
        if m.labels:
            names = ET.SubElement(node, "classAlphabet")
            for k, s in enumerate(dict.fromkeys(m.labels)):
                ET.SubElement(names, "symbol", code=str(k)).text = str(s)
        for i in range(m.n):
            s = ET.SubElement(node, "state", id=str(i), initial=repr(float(m.pi[i])))
            if isinstance(m, DiscreteHmm):
                d = ET.SubElement(s, "silent" if i in m.silent else "discrete", fixed="1" if i in m.fixed else "0")
                if i not in m.silent:
                    d.text = ", ".join(map(repr, m.b[i].tolist()))
                for g in m.ties:
                    if i in g[1:]:
                        ET.SubElement(s, "tiedTo").text = str(g[0])
            else:
                mix = ET.SubElement(s, "mixture", fixed="1" if i in m.fixed else "0")
                for c in m.components[i]:
                    tag = {"normal_right": "normalRightTail", "normal_left": "normalLeftTail"}.get(c.kind, c.kind)
                    d = ET.SubElement(mix, tag, weight=repr(float(c.weight)), fixed="1" if c.fixed else "0")
                    if c.kind == "multinormal":
                        ET.SubElement(d, "mean").text = ", ".join(map(repr, np.asarray(c.mean, float).tolist()))
                        ET.SubElement(d, "variance").text = ", ".join(map(repr, np.asarray(c.var, float).reshape(-1).tolist()))
                    else:
                        for k, v in (("mean", c.mean), ("variance", c.var), ("min", c.lo), ("max", c.hi)):
                            if v is not None:
                                d.set(k, repr(float(v)))
            if m.labels:
                ET.SubElement(s, "class").text = str(list(dict.fromkeys(m.labels)).index(m.labels[i]))
        for i, j in zip(*np.nonzero(m.a.any(0)), strict=True):
            t = ET.SubElement(node, "transition", source=str(i), target=str(j))
            ET.SubElement(t, "probability").text = ", ".join(repr(float(x)) for x in m.a[:, i, j])
    return ET.tostring(root, encoding="unicode")


# Columns of the transition lines of profile model files, by node: from and to.
_MOVES = (("M", "M"), ("M", "I"), ("M", "D"), ("I", "M"), ("I", "I"), ("D", "M"), ("D", "D"), ("B", "M"), ("M", "E"))


def models_from_profiles(text: str) -> list[DiscreteHmm]:
    """Profile models of text version 2: states N B E J C T, then match, insert and delete states of each column.

    The last column has no insert state, and its delete state leads to E. Rows of transitions and emissions are scaled to sum 1; T ends.
    """
    return [_profile(part) for part in text.split("//") if "HMM " in part]


def _profile(part: str) -> DiscreteHmm:
    lines = [x for x in part.strip().splitlines() if x.strip()]
    head = {x.split()[0]: x.split()[1:] for x in lines if x[:1].isalpha()}
    length, name = int(head["LENG"][0]), head["NAME"][0]
    letters = tuple("ACDEFGHIKLMNPQRSTVWY" if head["ALPH"][0].lower().startswith("amino") else "ACGT")
    score = lambda s, null=1.0: 0.0 if s == "*" else null * 2 ** (float(s) / 1000)
    null = np.array([score(s, 1 / len(letters)) for s in head["NULE"]])
    names = ["N", "B", "E", "J", "C", "T"]
    for k in range(1, length + 1):
        names += [f"M{k}"] + ([f"I{k}"] if k < length else []) + [f"D{k}"]
    at = {s: i for i, s in enumerate(names)}
    n, m = len(names), len(letters)
    a, b = np.zeros((n, n)), [np.zeros(m) for _ in names]
    xt = [score(s) for s in head["XT"]]
    for (x, y), p in zip((("N", "B"), ("N", "N"), ("E", "C"), ("E", "J"), ("C", "T"), ("C", "C"), ("J", "B"), ("J", "J")), xt, strict=True):
        a[at[x], at[y]] = p
    for s in ("N", "J", "C"):
        b[at[s]] = null.copy()
    body = lines[next(i for i, x in enumerate(lines) if x.startswith("HMM ")) + 2 :]
    if body[0].split()[0] != "1":
        first = body.pop(0).split()
        if len(first) > 2:
            a[at["B"], at["D1"]] = score(first[2])
    for k in range(1, length + 1):
        match, insert, moves = (body.pop(0).split() for _ in range(3))
        b[at[f"M{k}"]] = np.array([score(s, q) for s, q in zip(match[1 : m + 1], null, strict=True)])
        if k < length:
            b[at[f"I{k}"]] = np.array([score(s, q) for s, q in zip(insert[1 : m + 1], null, strict=True)])
        for (x, y), s in zip(_MOVES, moves[1:], strict=True):
            src = x if x == "B" else f"{x}{k}"
            dst = "E" if y == "E" else f"M{k}" if x == "B" else f"{y}{k}" if y == "I" else f"{y}{k + 1}"
            if src in at and dst in at:
                a[at[src], at[dst]] = score(s)
    a[at[f"D{length}"], at["E"]] = 1.0
    return DiscreteHmm(pi=np.eye(n)[0], a=a, b=b, alphabet=letters, name=name).normalised()


def models_from_fields(text: str) -> list[Hmm]:
    """Models of named fields, ``HMM = {...};`` (discrete) and ``SHMM = {...};`` (normals): ``M, N, Pi, A, B`` or ``cos, M, N, density, Pi, A, C, Mue, U``.

    ``A`` serves all ``cos`` classes, or ``Ak_0``, ``Ak_1``, ... one each. Density 0 is normal, 1 normal cut at 0 from below, 2
    normal too. ``multip`` repeats a discrete model, ``fix_state`` names fixed states by 1; ``#`` starts a remark.
    """
    out: list[Hmm] = []
    # Names of models and of their fields in this format
    for kind, body in re.findall(r"\b(S?HMM)\s*=\s*\{((?:[^{}]|\{[^{}]*\})*)\}\s*;", re.sub(r"#.*", "", text)):
        fields = {name: table or one for name, table, one in re.findall(r"(\w+)\s*=\s*(?:(?:vector|matrix)\s*\{([^{}]*)\}|([^;{}]+?))\s*;", body)}
        missing = {"M", "N", "Pi"} - set(fields) | ({"C", "Mue", "U", "density", "cos"} if kind == "SHMM" else {"A", "B"}) - set(fields)
        if missing:
            raise ValueError(f"a model lacks {sorted(missing)}")

        def rows(name: str, f: dict[str, str] = fields) -> list[list[float]]:
            return [_numbers(r) for r in f[name].split(";") if r.strip()]

        classes = int(fields.get("cos", 1))
        a = np.array([rows("A" if "A" in fields else f"Ak_{c}") for c in range(classes)])
        prior = float(fields.get("prior", -1))
        common = {"pi": rows("Pi")[0], "a": a, "prior": prior if prior >= 0 else None, "fixed": frozenset(i for i, x in enumerate(rows("fix_state")[0]) if x) if "fix_state" in fields else frozenset()}
        if kind == "HMM":
            out += [DiscreteHmm(**common, b=rows("B"), alphabet=tuple(range(int(fields["M"])))) for _ in range(max(1, int(fields.get("multip", 1))))]
        else:
            tail = {"kind": "normal_right", "lo": 0.0} if int(fields["density"]) == 1 else {"kind": "normal"}
            states = zip(rows("C"), rows("Mue"), rows("U"), strict=True)
            out.append(ContinuousHmm(**common, components=[[Component(weight=w, mean=m, var=v, **tail) for w, m, v in zip(*s, strict=True)] for s in states]))
    return out


def models_to_json(models: list[Hmm]) -> str:
    def plain(x: object) -> object:
        return x.tolist() if isinstance(x, np.ndarray) else sorted(x) if isinstance(x, frozenset) else x.__dict__ if isinstance(x, Component) else str(x)

    return json.dumps([{"kind": type(m).__name__} | m.__dict__ for m in models], default=plain)


def models_from_json(text: str) -> list[Hmm]:
    out: list[Hmm] = []
    for d in json.loads(text):
        kind = d.pop("kind")
        d["fixed"] = frozenset(d["fixed"])
        if kind == "DiscreteHmm":
            d["alphabet"] = tuple(d["alphabet"])
            d["backgrounds"] = {k: np.array(v) for k, v in d["backgrounds"].items()}
            out.append(DiscreteHmm(**d))
        else:
            d["components"] = [[Component(**c) for c in s] for s in d["components"]]
            out.append(ContinuousHmm(**d))
    return out


def read_models(spark: SparkSession, path: str) -> list[Hmm]:
    """Models of a file (small, read as one row), by its extension: xml, hmm, json, or smo and mo."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    kind = path.rsplit(".", 1)[-1].lower()
    return {"xml": models_from_xml, "hmm": models_from_profiles, "json": models_from_json, "smo": models_from_fields, "mo": models_from_fields}[kind](text)
