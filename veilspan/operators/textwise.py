"""The rules and the chain text by text, in Arrow workers: what the columns of recognizers and
windows say, for the registry and the rule detector.

The columns are interpreted by Spark, some milliseconds a call; here a text goes through
Python's engine once. A pattern is tried only where it can begin: at the words it is a list of,
or behind a first character, so most of a text is passed over by plain string search.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Sequence
from math import ceil, inf

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import CLOSE, OPEN
from ..session import ship
from .normalize import _WORD, RUN, SEGMENT
from .recognizers import ADDRESS_ENTITIES, AREA, REACH, REGISTRY, SUFFIX, TOKEN

Span = tuple[int, int]
Found = tuple[int, int, str, float]  # start, end, label, score or confidence
Finder = Callable[[str], list[Span]]

#: A batch of texts sent to a worker holds about this many bytes at most.
BATCH_BYTES = 4 << 20
_NO_MARKS = str.maketrans(OPEN + CLOSE, "  ")
CANON_OF_RULE = {x[3]: x[1] for x in X.LABELS}


def plain_finder(pattern: str, needs: Sequence[str] = (), group: int = 0) -> Finder:
    """Matches of a pattern; none where the text holds nothing of what each match needs. In ASCII
    texts the classes of ASCII say the same, faster."""
    every, ascii_only = re.compile(pattern), re.compile(pattern, re.A)

    def spans(text: str) -> list[Span]:
        if needs and not any(x in text for x in needs):
            return []
        return [m.span(group) for m in (ascii_only if text.isascii() else every).finditer(text)]

    return spans


def word_finder(pattern: str, words: Sequence[str]) -> Finder:
    """Matches, in either case, of a pattern that begins with one of the words. Lower-casing
    keeps places in ASCII texts only; others are searched as they are."""
    rx, low_words = re.compile(pattern, re.I), sorted({w.lower() for w in words})

    def spans(text: str) -> list[Span]:
        if not text.isascii():
            return [m.span() for m in rx.finditer(text)]
        low, at = text.lower(), []
        for w in low_words:
            p = low.find(w)
            while p >= 0:
                at.append(p)
                p = low.find(w, p + 1)
        out, last = [], 0
        for p in sorted(at):
            if p >= last and (m := rx.match(text, p)):
                out.append(m.span())
                last = m.end()
        return out

    return spans


def emails(text: str) -> list[Span]:
    """Matches of EMAIL_RULE: none begins before the run of its characters that ends at an @."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        m = _email(text, max(last, len(text[:at].rstrip(_EMAIL_CHARS))))
        if not m:
            break
        out.append(m.span())
        last = m.end()
        at = text.find("@", last)
    return out


_email, _EMAIL_CHARS = re.compile(X.EMAIL_RULE).search, string.ascii_letters + string.digits + "._%+-"
# The patterns of fixed, with the first character before the look-behind, which lets the engine skip to it.
_PHONE = r"[+3689](?<!\d.)(?<!\d[ -].)(?:(?<=\+)65[ -]*[3689]|(?<=6)5[ -]*[3689]|(?<!\+))(?:[ -]*\d){7}(?![ -]*\d)"
_UNIT = r"[#\d](?<![\d:.$].)(?:(?<=#)\s*\d{1,2}|(?<=\d)\d?)\s*-\s*\d{1,4}(?!\s*-\s*\d)"
_PERSON = r"[A-Z](?<=\b[Nn]ame is .|\bthis is .|\bThis is .)[a-z]+(?: [A-Z][a-z]+){1,3}\b"

phones = plain_finder(_PHONE)
accounts = plain_finder(r"\d(?<!\w.)\d{9}\b")
nrics = plain_finder(r"[STFGM](?<!\w.)\d{7}[A-Z]\b")
persons = plain_finder(_PERSON, ["ame is ", "his is "])
postals = plain_finder(r"\d(?<!\w.)\d{5}\b")
units = plain_finder(_UNIT, ["-"])
blocks = word_finder(X.BLOCK, ["blk", "block"])
suffixes = word_finder(SUFFIX, X.SUFFIXES)
areas = word_finder(AREA, X.AREAS)
nrics_boosted = plain_finder(r"[STFG](?<!\w.)\d{7}[A-Za-z]\b")
emails_boosted = plain_finder(X.EMAIL_BOOST.replace(r"(\b[Aa]t", r"([Aa](?<!\w.)t"), [".com", ".net", ".org", ".edu"], 2)
spoken_runs = word_finder(RUN, [*X.DIGIT_WORDS, *X.REPEAT_WORDS])


def _has(pattern: str, ignore_case: bool = False) -> Callable[[str], object]:
    return re.compile(pattern, re.I if ignore_case else 0).search


_singapore, _postal_words = _has(X.SINGAPORE, True), _has(X.POSTAL_WORDS, True)
_unit_excluded, _shop, _hash_before, _numbers = _has(X.UNIT_EXCLUDED, True), _has(r"^7\s*-\s*11$"), _has(r"#\s*$"), re.compile(r"[0-9\- #]*").match
_tokens, _road_number, _is_word = re.compile(TOKEN).finditer, _has(r"^\d{1,4}[A-Za-z]?$"), re.compile(r"\w").match
_nric_full, _nric_prefix, _nric_tail = _has(X.NRIC_FULL), _has(X.NRIC_PREFIX_PIECE, True), _has(X.NRIC_TAIL_PIECE, True)
_email_shape, _company, _money, _letter_digits = _has(X.EMAIL_SHAPE, True), _has(X.COMPANY_DOMAIN, True), _has(X.MONEY), _has(X.LETTER_DIGITS)
_digit, _digits, _gaps = _has(r"\d"), re.compile(r"\d").findall, re.compile(r"[\s\-]")
_address_words, _post_code, _six = _has(X.ADDRESS_CONTEXT, True), _has(X.POSTAL_CONTEXT, True), _has(r"^\d{6}$")
_floor, _unit_rejected, _unit_words, _unit_clean, _block_words = _has(X.FLOOR, True), _has(X.UNIT_REJECTED, True), _has(X.UNIT_CONTEXT, True), _has(X.UNIT_CLEAN), _has(X.BLOCK_CONTEXT, True)
_tag, _toll_free = re.compile(r"<[A-Z_]+(?::[0-9.]+)?>").sub, re.compile(r"(?:\+?65[ -]*)?1?[ -]*800").match
_nric_words, _name_before, _speaker, _said, _not_alnum = _has(X.NRIC_WORDS, True), _has(X.NAME_BEFORE), _has(X.SPEAKER, True), re.compile(_WORD).findall, re.compile("[^A-Za-z0-9]")


def around(text: str, s: int, e: int, reach: int) -> str:
    return text[max(0, s - reach) : e + reach]


# Rules


def _postal_score(text: str, s: int, e: int) -> float:
    w = around(text, s, e, 80)
    return X.POSTAL_HIGH if _singapore(w) or _postal_words(w) or units(w) or blocks(w) or suffixes(w) or areas(w) else X.POSTAL_LOW


def _unit_score(text: str, s: int, e: int) -> float | None:
    head, own = text[:s], text[s:e]
    run = head[len(head.rstrip("0123456789- #")) :] + own + _numbers(text, e)[0]
    if run.count("-") > 1 or _unit_excluded(around(text, s, e, 20)):
        return None
    return None if _shop(own) and not _hash_before(text[max(0, s - 3) : s]) else X.HIGH


def _run(tokens: Sequence[tuple[int, int, str]], most: int, ok: Callable[[str], object]) -> int:
    n = 0
    while n < most and n < len(tokens) and ok(tokens[n][2]):
        n += 1
    return n


def _words(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), m[0]) for m in _tokens(text)]


def streets(text: str) -> list[Found]:
    out = []
    for at, end in suffixes(text):
        for reach in (REACH // 3, REACH, at):  # where there are eight words, seven of them are whole
            base = max(0, at - reach)
            before = _words(text[base:at])[::-1]
            if not base or len(before) > 7:
                break
        open7 = before[: _run(before, 7, _is_word)]
        most = 2 if any(t.lower() in X.STREET_STOPS for _, _, t in open7) else 4
        left = _run(before, most, lambda t: _is_word(t) and t.lower() not in X.STREET_STOPS)
        n, tail = 0, 0
        for m in _tokens(text, end, min(len(text), end + REACH)):
            if not (n < 2 and n == tail and _is_word(m[0])):
                if n - tail >= 64 or not _road_number(m[0]):
                    break
            else:
                tail += 1
            n, stop = n + 1, m.end()
        s = base + before[left - 1][0] if left else at
        e = min(stop if n else end, s + 90)
        if e - s >= 8:
            out.append((s, e, "SG_ADDRESS", X.MODERATE + 0.15 if areas(around(text, s, e, 40)) else X.MODERATE))
    return out


def _scored(label: str, finder: Finder, score: float | Callable[[str, int, int], float | None]) -> Callable[[str], list[Found]]:
    if callable(score):
        return lambda text: [(s, e, label, x) for s, e in finder(text) if (x := score(text, s, e)) is not None]
    return lambda text: [(s, e, label, score) for s, e in finder(text)]


#: The registry's recognizers in its order, each with its label.
RULES: list[tuple[str, Callable[[str], list[Found]]]] = [
    ("SG_PHONE_NUMBER", _scored("SG_PHONE_NUMBER", phones, 1.0)),
    ("ACCOUNT_NUMBER", _scored("ACCOUNT_NUMBER", accounts, 1.0)),
    ("SG_NRIC_FIN", _scored("SG_NRIC_FIN", nrics, 1.0)),
    ("EMAIL_ADDRESS", _scored("EMAIL_ADDRESS", emails, 1.0)),
    ("PERSON", _scored("PERSON", persons, X.HIGH)),
    ("SG_POSTAL_CODE", _scored("SG_POSTAL_CODE", postals, _postal_score)),
    ("SG_UNIT_NUMBER", _scored("SG_UNIT_NUMBER", units, _unit_score)),
    ("SG_ADDRESS_BLOCK_NUMBER", _scored("SG_ADDRESS_BLOCK_NUMBER", blocks, X.HIGH)),
    ("SG_ADDRESS", streets),
    ("SG_ADDRESS", _scored("SG_ADDRESS", areas, X.HIGH)),
]
assert [label for label, _ in RULES] == [r.label for r in REGISTRY]
#: One recognizer of a label that has two.
STREET, AREAS = 8, 9


def resolve_same_type(spans: list[Found]) -> list[Found]:
    kept: list[Found] = []
    for r in sorted(spans, key=lambda m: (m[0], -m[3], m[0] - m[1])):
        at = next((i for i, k in enumerate(kept) if r[0] < k[1] and k[0] < r[1]), None)
        if at is None:
            kept.append(r)
        elif (r[3], r[1] - r[0]) > (kept[at][3], kept[at][1] - kept[at][0]):
            kept[at] = r
    return kept


def rule_spans(text: str, entities: Sequence[str], threshold: float) -> list[Found]:
    every = []
    for label in dict.fromkeys(k for k, _ in RULES if k in entities):
        own = [m for k, rule in RULES if k == label for m in rule(text)]
        every += resolve_same_type(own) if label in ADDRESS_ENTITIES else own
    return sorted((m for m in every if m[3] >= threshold), key=lambda m: m[:2])


# Predicates


def digit_count(text: str) -> int:
    return len(_digits(text))


def phone_ok(text: str) -> bool:
    return not _money(text) and not _letter_digits(text.strip())


def valid(value: str, canon: str) -> bool:
    if canon == "SG_NRIC_FIN":
        v = _gaps.sub("", value)
        return bool(_nric_full(v) or _nric_prefix(v.upper()) or _nric_tail(v.upper()))
    if canon == "EMAIL_ADDRESS":
        return bool(_email_shape(value)) and not _company(value)
    if canon == "SG_PHONE_NUMBER":
        return phone_ok(value) and bool(_digit(value))
    if canon == "SG_POSTAL_CODE":
        return digit_count(value) >= 4
    return canon not in ("SG_ADDRESS_UNIT", "SG_ADDRESS_BLOCK") or bool(_digit(value))


def _near_address(s: int, e: int, addresses: Sequence[Found], reach: int) -> bool:
    return any(abs(a[0] - e) <= reach or abs(s - a[1]) <= reach for a in addresses)


def postal_context_ok(value: str, s: int, e: int, full: str, addresses: Sequence[Found]) -> bool:
    if not _six(_gaps.sub("", value)):
        return False
    w = around(full, s, e, 150)
    return bool(_near_address(s, e, addresses, 150) or _address_words(w) or _post_code(w))


def context_ok(value: str, canon: str, s: int, e: int, full: str, addresses: Sequence[Found]) -> bool:
    if canon == "SG_POSTAL_CODE":
        return postal_context_ok(value, s, e, full, addresses)
    if canon not in ("SG_ADDRESS_BLOCK", "SG_ADDRESS_UNIT"):
        return True
    if canon == "SG_ADDRESS_UNIT" and _unit_clean(value):
        return True
    if canon == "SG_ADDRESS_BLOCK" and ("-" in value or _unit_words(value)):
        return False
    w = around(full, s, e, 60)
    near = (_block_words if canon == "SG_ADDRESS_BLOCK" else _unit_words)(w) or _near_address(s, e, addresses, 60)
    return bool(near) and not _floor(w) and not _unit_rejected(around(full, s, e, 100))


def propagates(value: str, canon: str) -> bool:
    if canon in ("SG_PHONE_NUMBER", "ACCOUNT_NUMBER", "SG_POSTAL_CODE", "SG_NRIC_FIN"):
        return digit_count(value) >= 6
    n_alnum = len(_not_alnum.sub("", value))
    if canon == "EMAIL_ADDRESS":
        return n_alnum >= 6
    if canon == "SG_ADDRESS":
        return len(value.split()) >= 2 and n_alnum >= 6
    return canon == "FULL_NAME" and len(value.split()) >= 2


# The chain


def normalized(text: str) -> tuple[str, list[tuple[int, int, int, int, bool]]]:
    """The text with spoken runs as digits, and (ns, ne, os, oe, number) segments; none where nothing changes."""
    runs = spoken_runs(text)
    if not runs:
        return text, []
    pieces, segments, at, n_at = [], [], 0, 0
    for s, e in runs:
        times, digits = 1, []
        for w in _said(text[s:e].lower()):
            if w in X.DIGIT_WORDS:
                digits.append(X.DIGIT_WORDS[w] * times)
            times = X.REPEAT_WORDS.get(w, 1)
        said = "".join(digits)
        number = len(said) >= 2
        piece = said if number else text[s:e]
        segments.append((n_at, n_at + s - at, at, s, False))
        n_at += s - at
        segments.append((n_at, n_at + len(piece), s, e, number))
        n_at += len(piece)
        pieces += (text[at:s], piece)
        at = e
    segments.append((n_at, n_at + len(text) - at, at, len(text), False))
    return "".join([*pieces, text[at:]]), segments


def to_original(ns: int, ne: int, segments: list[tuple[int, int, int, int, bool]]) -> Span:
    touched = [g for g in segments if g[1] > ns and g[0] < ne]
    if not touched:
        return ns, ne
    low = min(o if number else o + max(ns, n) - n for n, _, o, _, number in touched)
    high = max(oe if number else o + min(ne, m) - n for n, m, o, oe, number in touched)
    return low, high


def filtered(text: str, spans: list[Found], threshold: float) -> list[Found]:
    sound = []
    for m in spans:
        value = text[m[0] : m[1]].strip()
        if m[3] >= X.LABEL_THRESHOLDS.get(m[2], threshold) and value and valid(value, m[2]):
            sound.append((value, m))
    addresses = [m for _, m in sound if m[2] == "SG_ADDRESS"]
    kept = [m for value, m in sound if context_ok(value, m[2], m[0], m[1], text, addresses)]
    free = lambda s, e: not any(k[0] <= s and e <= k[1] for k in kept)
    out = list(kept)
    for s, e in postals(text):
        if free(s, e) and not _digit(text[max(0, s - 3) : s]) and not _digit(text[e : e + 3]):
            w = around(text, s, e, 80)
            if _address_words(w) or _post_code(w):
                out.append((s, e, "SG_POSTAL_CODE", 1.0))
    for s, e in nrics_boosted(text):
        if free(s, e) and (_nric_words(around(text, s, e, 80)) or _name_before(text[max(0, s - 40) : s])):
            out.append((s, e, "SG_NRIC_FIN", 1.0))
    for s, e in emails_boosted(text):
        if free(s, e) and not _company(text[s:e]):
            out.append((s, e, "EMAIL_ADDRESS", 1.0))
    return out


def reconcile(candidates: list[tuple[float, Found]]) -> list[Found]:
    """Candidates (margin, span) accepted best first."""
    kept: list[Found] = []
    for _, c in sorted(candidates, key=lambda x: (-x[0], -x[1][3], x[1][0] - x[1][1], x[1][0], x[1][2])):
        for k in kept:
            shared = min(c[1], k[1]) - max(c[0], k[0])
            if shared > 0 and (c[2] == k[2] or shared * 2 >= max(c[1], k[1]) - min(c[0], k[0])):
                break
        else:
            kept.append(c)
    return kept


def standalone(text: str, value: str) -> list[Span]:
    """Places of the value where no letter or digit of ASCII touches it."""
    out, p, n = [], text.find(value), len(value)
    while p >= 0:
        before, after = text[p - 1 : p] if p else "", text[p + n : p + n + 1]
        if (before.isascii() and before.isalnum()) or (after.isascii() and after.isalnum()):
            p = text.find(value, p + 1)
        else:
            out.append((p, p + n))
            p = text.find(value, p + n)
    return out


def propagated(text: str, accepted: list[Found]) -> list[Found]:
    addresses, new = [a for a in accepted if a[2] == "SG_ADDRESS"], []
    for a in accepted:
        value = text[a[0] : a[1]].strip()
        if not value or not propagates(value, a[2]) or (a[2] == "SG_PHONE_NUMBER" and not phone_ok(value)):
            continue
        for s, e in standalone(text, value):
            if any(s < k[1] and k[0] < e for k in accepted) or any(s < k[1] and k[0] < e for k in new):
                continue
            if a[2] != "SG_POSTAL_CODE" or postal_context_ok(value, s, e, text, addresses):
                new.append((s, e, a[2], 1.0))
    return new


def chain(text: str, entities: Sequence[str], rule_threshold: float, threshold: float, size: int, overlap: int) -> list[tuple[str, str, int, int, float]]:
    """(text, label, s, e, conf) of a text by the rule detector, as windows.chain has them."""
    norm, segments = normalized(text)
    n, step = len(norm), max(1, size - overlap)
    cands = []
    for i in range(max(0, ceil((n - size) / step)) + 1):
        off = i * step
        end = min(off + size, n)
        chunk = norm[off:end]
        detected = [(s, e, CANON_OF_RULE[k], x) for s, e, k, x in rule_spans(chunk, entities, rule_threshold)]
        for s, e, k, x in filtered(chunk, detected, threshold):
            left, right = inf if off == 0 else s, inf if end == n else end - off - e
            cands.append((min(left, right), (s + off, e + off, k, x)))
    accepted = reconcile(cands)
    out = []
    for s, e, k, x in sorted(accepted + propagated(norm, accepted), key=lambda m: m[:2]):
        o, oe = to_original(s, e, segments) if segments else (s, e)
        value = text[o:oe].strip()
        if value:
            out.append((value, k, o, oe, x))
    return out


def predictions(text: str, entities: Sequence[str], threshold: float) -> list[tuple[str, str, int, int, float]]:
    """(text, label, s, e, score): canonical labels, stripped values, no speaker taken for a name."""
    out = []
    for s, e, k, x in rule_spans(text.translate(_NO_MARKS), entities, threshold):
        value, label = text[s:e].strip(), CANON_OF_RULE[k]
        if value and not (label == "FULL_NAME" and _speaker(value)):
            out.append((value, label, s, e, x))
    return out


def standalone_counts(text: str, values: list[str | None] | None) -> list[tuple[str | None, int]] | None:
    """(value, n): places of each distinct value, longest first, outside those that a longer one took."""
    if values is None:
        return None
    taken, out = [], []
    for v in sorted({v for v in values if v is not None}, key=lambda v: (-len(v), v)):
        core = v.rstrip(".,?!- ")
        hits = [m for m in standalone(text, core) if not any(s <= m[0] and m[1] <= e for s, e in taken)] if core else []
        taken += hits
        out.append((v, len(hits)))
    return out


def account_survival(text: str, values: list[str | None] | None, spans: list[dict] | None) -> list[tuple]:
    """(value, digits, total, redacted, labels) of each distinct value that occurs, by plain search."""
    out = []
    for v in dict.fromkeys(values or ()):
        p, total, redacted, labels = text.find(v) if v else -1, 0, 0, []
        while p >= 0:
            e = p + len(v)
            own = {m["label"] for m in spans or () if p < m["e"] and m["s"] < e}
            total, redacted, labels = total + 1, redacted + bool(own), [*labels, *own]
            p = text.find(v, e)
        if total:
            out.append((v, digit_count(v), total, redacted, [(x, labels.count(x)) for x in sorted(set(labels))]))
    return out


def residual_leaks(text: str) -> list[tuple[str, str]]:
    """(type, value) of whole identifiers outside tags."""
    t = _tag(" ", text)
    out = [("Full NRIC", t[s:e]) for s, e in nrics(t)]
    out += [("Full Mobile", t[s:e]) for s, e in phones(t) if not _toll_free(t[s:e])]
    codes = postals(t)
    if codes and (blocks(t) or units(t)) and (suffixes(t) or areas(t)):
        out.append(("Full Address", t[slice(*codes[0])]))
    return out


# Columns


def _column(spark: SparkSession, text: Column, fields: str, of: Callable[..., list[tuple] | None], *others: Column) -> Column:
    """A column of arrays of structs, from a function of one text, and of other columns' values; null text counts as empty.

    It is not deterministic to Spark, which would otherwise copy it to each filter above it.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "map<string|int>": pa.map_(pa.string(), pa.int32())}
    named = [(x.split(":")[0], kinds[x.split(":")[1]]) for x in fields.split(",")]
    fields = fields.replace("|", ",")

    @F.arrow_udf(f"array<struct<{fields}>>")
    def run(texts: pa.Array, *beside: pa.Array) -> pa.Array:
        offsets, flat = [], []
        for t, *values in zip(texts.to_pylist(), *(x.to_pylist() for x in beside)):
            own = of(t or "", *values)
            offsets.append(None if own is None else len(flat))
            flat += own or ()
        offsets.append(len(flat))
        columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*flat) if flat else [[]] * len(named), named)]
        made = pa.StructArray.from_arrays(columns, fields=[pa.field(n, kind) for n, kind in named])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)

    return run.asNondeterministic()(text, *others)


def rule_column(spark: SparkSession, text: Column, entities: Sequence[str], threshold: float) -> Column:
    own = tuple(entities)

    def of(t: str) -> list[tuple]:
        from veilspan.operators import textwise  # the worker's own module, not a copy sent along

        return textwise.rule_spans(t.translate(_NO_MARKS), own, threshold)

    return _column(spark, text, "s:int,e:int,label:string,score:double", of)


def one_rule_column(spark: SparkSession, text: Column, which: int) -> Column:
    """The spans of one recognizer of RULES, as they are found."""

    def of(t: str) -> list[tuple]:
        from veilspan.operators import textwise

        return textwise.RULES[which][1](t.translate(_NO_MARKS))

    return _column(spark, text, "s:int,e:int,label:string,score:double", of)


def prediction_column(spark: SparkSession, text: Column, entities: Sequence[str], threshold: float) -> Column:
    own = tuple(entities)

    def of(t: str) -> list[tuple]:
        from veilspan.operators import textwise

        return textwise.predictions(t, own, threshold)

    return _column(spark, text, "text:string,label:string,s:int,e:int,score:double", of)


def chain_column(spark: SparkSession, text: Column, entities: Sequence[str], rule_threshold: float, threshold: float, size: int, overlap: int) -> Column:
    own = tuple(entities)

    def of(t: str) -> list[tuple]:
        from veilspan.operators import textwise

        return textwise.chain(t.translate(_NO_MARKS), own, rule_threshold, threshold, size, overlap)

    return _column(spark, text, "text:string,label:string,s:int,e:int,conf:double", of)


def propagated_column(spark: SparkSession, text: Column, accepted: Column) -> Column:
    """New spans for other occurrences of accepted spans (s, e, label, conf), which have places and labels."""

    def of(t: str, spans: list[dict]) -> list[tuple]:
        from veilspan.operators import textwise

        return textwise.propagated(t, [(m["s"], m["e"], m["label"], m["conf"]) for m in spans or ()])

    return _column(spark, text, "s:int,e:int,label:string,conf:double", of, accepted)


def standalone_column(spark: SparkSession, text: Column, values: Column) -> Column:
    def of(t: str, own: list[str] | None) -> list[tuple] | None:
        from veilspan.operators import textwise

        return textwise.standalone_counts(t, own)

    return _column(spark, text, "value:string,n:int", of, values)


def leak_column(spark: SparkSession, text: Column) -> Column:
    def of(t: str) -> list[tuple]:
        from veilspan.operators import textwise

        return textwise.residual_leaks(t.translate(_NO_MARKS))

    return _column(spark, text, "type:string,value:string", of)


def survival_column(spark: SparkSession, text: Column, values: Column, spans: Column) -> Column:
    def of(t: str, own: list[str] | None, found: list[dict] | None) -> list[tuple]:
        from veilspan.operators import textwise

        return textwise.account_survival(t, own, found)

    return _column(spark, text, "value:string,digits:int,total:int,redacted:int,labels:map<string|int>", of, values, spans)


def normalized_column(spark: SparkSession, text: Column) -> Column:
    """struct<text,segments> as normalize.normalized has it; null where the text is."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kind = pa.struct([("text", pa.string()), ("segments", pa.list_(pa.struct([("ns", pa.int32()), ("ne", pa.int32()), ("os", pa.int32()), ("oe", pa.int32()), ("is_number", pa.bool_())])))])

    @F.arrow_udf(f"struct<text:string,segments:array<{SEGMENT}>>")
    def run(texts: pa.Array) -> pa.Array:
        from veilspan.operators import textwise

        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            norm, segments = textwise.normalized(t.translate(_NO_MARKS))
            segments = segments or [(0, len(t), 0, len(t), False)]
            out.append({"text": norm, "segments": [dict(zip(("ns", "ne", "os", "oe", "is_number"), g)) for g in segments]})
        return pa.array(out, kind)

    return run.asNondeterministic()(text)
