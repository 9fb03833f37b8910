"""Secret scans: fixed patterns, and probabilistic automata inferred from what they find.

The fixed patterns label credentials in the corpus. For each kind, a prefix tree of labelled
values (a bounded sample) is folded by merging states whose outgoing frequencies agree within
Hoeffding bounds, which leaves a deterministic probabilistic automaton of the format. Every
long token outside the fixed spans is then scored under all automata; one that is as likely
per character as the labelled values are becomes a `learned` span.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, tune

KINDS = ("assign", "access", "hex", "learned")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Labelled values of each kind that an automaton is fitted on, at most.
SAMPLE = 1000


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the fixed patterns' matches, by start and then kind."""
    out = [(m.start(), m.end(), 0, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Long tokens that touch no fixed span."""
    out, k = [], 0
    spans = sorted((s, e) for s, e, _, _ in base)
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        if not any(a < e and s < z for a, z in spans[k : k + 4]):
            out.append((s, e, m[0]))
    return out


def symbols(value: str, literal: frozenset[str] = frozenset()) -> list[str]:
    """Character classes of a value; a known four-character opening stays as it is."""
    out = []
    for i, c in enumerate(value):
        if i < 4 and value[:4] in literal:
            out.append("=" + c)
        elif c.isdigit():
            out.append("9")
        elif c.islower():
            out.append("a" if c <= "f" else "g")
        elif c.isupper():
            out.append("A" if c <= "F" else "G")
        else:
            out.append("=" + c)
    return out


#: Characters in each class, for the likelihood of a character given its class.
_WIDTH = {"9": 10, "a": 6, "g": 20, "A": 6, "G": 20}
_ALPHABET = 5 + 6


@dataclass
class Automaton:
    """Deterministic states with counts of visits, ends and outgoing symbols."""

    literal: frozenset[str] = frozenset()
    visits: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    out: list[dict[str, list[int]]] = field(default_factory=list)  # symbol -> [target, count]
    threshold: float = 0.0

    def add_state(self) -> int:
        self.visits.append(0)
        self.ends.append(0)
        self.out.append({})
        return len(self.visits) - 1

    def rate(self, value: str) -> float:
        """Log likelihood for each character, the end included; unseen symbols are smoothed."""
        q, total = 0, 0.0
        syms = symbols(value, self.literal)
        for s in syms:
            n = self.visits[q] if q is not None else 0
            hit = self.out[q].get(s) if q is not None else None
            total += math.log(((hit[1] if hit else 0) + 0.02) / (n + 0.02 * (_ALPHABET + 1))) - math.log(_WIDTH.get(s, 1))
            q = hit[0] if hit else None
        n, e = (self.visits[q], self.ends[q]) if q is not None else (0, 0)
        total += math.log((e + 0.02) / (n + 0.02 * (_ALPHABET + 1)))
        return total / (len(syms) + 1)


def prefix_tree(values: list[str], literal: frozenset[str]) -> Automaton:
    a = Automaton(literal)
    a.add_state()
    for v in values:
        q = 0
        a.visits[q] += 1
        for s in symbols(v, literal):
            if s not in a.out[q]:
                a.out[q][s] = [a.add_state(), 0]
            hop = a.out[q][s]
            hop[1] += 1
            q = hop[0]
            a.visits[q] += 1
        a.ends[q] += 1
    return a


def _differ(f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
    return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def _compatible(a: Automaton, p: int, q: int, bound: float) -> bool:
    todo = [(p, q)]
    while todo:
        p, q = todo.pop()
        n1, n2 = a.visits[p], a.visits[q]
        if not n1 or not n2:
            continue
        if _differ(a.ends[p], n1, a.ends[q], n2, bound):
            return False
        for s in a.out[p].keys() | a.out[q].keys():
            x, y = a.out[p].get(s), a.out[q].get(s)
            if _differ(x[1] if x else 0, n1, y[1] if y else 0, n2, bound):
                return False
            if x and y and x[0] != y[0]:
                todo.append((x[0], y[0]))
    return True


def _fold(a: Automaton, p: int, q: int) -> None:
    """Add the tree below q to state p."""
    todo = [(p, q)]
    while todo:
        p, q = todo.pop()
        a.visits[p] += a.visits[q]
        a.ends[p] += a.ends[q]
        for s, (t, n) in sorted(a.out[q].items()):
            if s in a.out[p]:
                a.out[p][s][1] += n
                if a.out[p][s][0] != t:
                    todo.append((a.out[p][s][0], t))
            else:
                a.out[p][s] = [t, n]


def merge_states(a: Automaton, alpha: float = 0.05) -> Automaton:
    """Merge compatible states, nearest the root first; kept states are tried in order."""
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    kept = [0]
    edge = sorted((t, 0, s) for s, (t, _) in a.out[0].items())
    while edge:
        q, parent, s = edge.pop(0)
        for p in kept:
            if _compatible(a, p, q, bound):
                a.out[parent][s][0] = p
                _fold(a, p, q)
                break
        else:
            kept.append(q)
        known = set(kept)
        edge = sorted((t, p, s) for p in kept for s, (t, _) in a.out[p].items() if t not in known)
    place = {q: i for i, q in enumerate(kept)}
    b = Automaton(a.literal)
    for q in kept:
        b.add_state()
        b.visits[-1], b.ends[-1] = a.visits[q], a.ends[q]
        b.out[-1] = {s: [place[t], n] for s, (t, n) in a.out[q].items()}
    return b


def infer(values: list[str], slack: float = 0.05) -> Automaton | None:
    """An automaton of distinct labelled values; two in three fit it, the rest set its threshold."""
    values = sorted(set(values), key=lambda v: hashlib.md5(v.encode()).digest())
    fit, rest = [v for i, v in enumerate(values) if i % 3], values[::3]
    if len(fit) < 4:
        return None
    openings = Counter(v[:4] for v in fit)
    literal = frozenset(k for k, n in openings.items() if n >= max(3, 0.1 * len(fit)))
    a = merge_states(prefix_tree(fit, literal))
    a.threshold = float(np.quantile([a.rate(v) for v in rest], 0.01)) - slack
    return a


def is_learned(automata: list[Automaton], value: str) -> bool:
    return any(a.rate(value) >= a.threshold for a in automata)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.int32()), ("value", pa.string())])
    token = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("value", pa.string())])
    for b in batches:
        found, tokens = [], []
        for t in b.column(1).to_pylist():
            base = base_spans(t or "")
            found.append([dict(zip(("s", "e", "kind", "value"), x)) for x in base])
            tokens.append([dict(zip(("s", "e", "value"), x)) for x in candidates(t or "", base)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(span)), pa.array(tokens, pa.list_(token))], ["id", "base", "tokens"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id_col, base and learned arrays of struct(s, e, kind, value).

    Offsets are code points, ends exclusive; null text counts as empty; repeated rows each
    give a row; an empty table gives none; other columns are ignored, whatever their names.
    Texts are read once; automata are fitted on at most `sample` distinct values of each kind,
    those with the smallest hashes, and every token of the corpus is scored.
    """
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<s int, e int, kind int, value string>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = stage(rows.mapInArrow(_scan, f"id {kind}, base {span}, tokens array<struct<s int, e int, value string>>"), "secrets")
    labelled = found.select(F.explode("base").alias("x")).select("x.kind", "x.value").distinct()
    automata = []
    for k in range(3):  # at most `sample` values each
        top = labelled.filter(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(sample)
        automata.append(infer([r["value"] for r in top.collect()]))
    shared = docs.sparkSession.sparkContext.broadcast([a for a in automata if a])

    @F.arrow_udf("array<boolean>")
    def judge(values: pa.Array) -> pa.Array:
        return pa.array([[is_learned(shared.value, v) for v in x] for x in values.to_pylist()], pa.list_(pa.bool_()))

    judged = found.withColumn("_ok", judge(F.transform("tokens", lambda t: t["value"])))
    learned = F.transform(
        F.filter(F.arrays_zip("tokens", "_ok"), lambda z: z["_ok"]),
        lambda z: F.struct(z["tokens"]["s"].alias("s"), z["tokens"]["e"].alias("e"), F.lit(3).alias("kind"), z["tokens"]["value"].alias("value")),
    )
    return judged.select(F.col("id").alias(id_col), "base", learned.alias("learned"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def span_digests(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, counts of the fixed kinds, SHA-256 of the fixed spans' text, all spans' text."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return spans.select(
        id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "learned")).alias("spans"),
        F.size("learned").cast("long").alias("n_learned"),
    )
