"""Reports: text tables of scores and HTML cards of leaks and lost accounts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values. Colours of the cards.
STYLE = "body{font-family:sans-serif;max-width:900px;margin:2rem auto}.card{border:1px solid #ddd;border-radius:8px;padding:1rem;margin:1rem 0}.leak,.lost{background:#ffd5cc}.kept{background:#d7f0d7}.tag{background:#e6f0ff}"


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def marked(text: Column, values: Column, css: str) -> Column:
    """Escaped text with every value in a span, longer ones first, tags of redaction marked too."""
    from ..functions.text import quoted

    order = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)
    own = F.array_sort(F.filter(F.array_distinct(F.transform(values, escaped)), lambda v: v != ""), order)
    pattern = F.array_join(F.transform(own, quoted), "|")
    esc = escaped(text)
    with_values = F.when(F.size(own) > 0, F.regexp_replace(esc, pattern, F.lit(f'<span class="{css}">$0</span>'))).otherwise(esc)
    with_tags = F.regexp_replace(with_values, r"&lt;[A-Z_]+(?::[0-9.]+)?&gt;", '<span class="tag">$0</span>')
    return F.replace(with_tags, F.lit("\n"), F.lit("<br>"))


def leak_cards(items: DataFrame, redacted: DataFrame, names: DataFrame) -> DataFrame:
    """line, card: one HTML card for each leaking line; its rank is added by report_ranks."""
    from ..operators.corpus import report_ranks

    df = report_ranks(items).join(redacted.select("line", "redacted"), "line", "left").join(names.select("line", "file"), "line", "left")
    what = F.array_join(F.transform("items", lambda x: F.concat(F.lit("<b>"), escaped(x["type"]), F.lit('</b>: <span class="leak">'), escaped(x["value"]), F.lit("</span>"))), " ")
    head = F.concat(F.lit('<div class="card"><div>#'), F.col("rank").cast("string"), F.lit(" line "), F.col("line").cast("string"), F.lit(" "), escaped(F.col("file")), F.lit("</div><div>"), what, F.lit("</div><div>"))
    return df.select("line", F.concat(head, marked(F.col("redacted"), F.transform("items", lambda x: x["value"]), "leak"), F.lit("</div></div>")).alias("card"))


def account_cards(survival: DataFrame, lost: DataFrame, texts: DataFrame, key: str = "line") -> DataFrame:
    """key, card for each call whose account is lost: what each value went through, and the text."""
    seen = F.when(F.col("total") == 1, "occurrence").otherwise("occurrences")
    labels = F.array_join(F.array_sort(F.map_keys("labels")), ", ")
    line = F.concat(F.col("value"), F.format_string(" (%d digits, %d of %d ", "digits", "redacted", "total"), seen, F.lit(" redacted"), F.when(labels != "", F.concat(F.lit(" as "), labels)).otherwise(""), F.lit(")"))
    own = survival.join(lost.select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("value", line.alias("l")))).alias("v"))
    df = own.join(texts.select(key, "text"), key)
    head = F.concat(F.lit('<div class="card"><div>line '), F.col(key).cast("string"), F.lit("</div><div>account pieces: "), escaped(F.array_join(F.transform("v", lambda x: x["l"]), "  |  ")), F.lit("</div><div>"))
    return df.select(key, F.concat(head, marked(F.col("text"), F.transform("v", lambda x: x["value"]), "lost"), F.lit("</div></div>")).alias("card"))


def write_html(cards: DataFrame, title: str, path: str, key: str = "line", mode: str = "error") -> None:
    """A folder of text parts in order of the key: the page's head, then the cards."""
    head = cards.sparkSession.createDataFrame([(None, f"<!doctype html><meta charset=utf-8><title>{title}</title><style>{STYLE}</style><h2>{title}</h2>")], f"{key} {cards.schema[key].dataType.simpleString()}, card string")
    head.unionByName(cards).sort(F.col(key).asc_nulls_first()).select(F.col("card").alias("value")).write.mode(mode).text(path)


def format_scores(rows: Iterable, title: str = "scores") -> str:
    """A text table of (method, label, precision, recall, f1, f_beta) rows: a report of a few lines."""
    lines = [title, "-" * 78, f"{'method':<12} {'label':<20} {'P':>8} {'R':>8} {'F1':>8} {'F2':>8}"]
    for r in rows:
        lines.append(f"{r['method']:<12} {r['label']:<20} {r['precision']:>8.4f} {r['recall']:>8.4f} {r['f1']:>8.4f} {r['f_beta']:>8.4f}")
    return "\n".join(lines) + "\n"


def format_gate(rows: Iterable, threshold: float = 0.8) -> str:
    rows = list(rows)
    lines = [f"PER-LABEL GATE (P, R and F1 > {threshold:g})", "-" * 78]
    lines += [f"{r['label']:<20} P={r['precision']:.4f} R={r['recall']:.4f} F1={r['f1']:.4f} [{'PASS' if r['passed'] else 'FAIL'}]" for r in rows]
    return "\n".join([*lines, f"ALL {len(rows)} LABELS PASS: {all(r['passed'] for r in rows)}"]) + "\n"


def format_comparison(rows: Iterable, overall: Iterable, protection: Iterable = (), title: str = "comparison") -> str:
    """Arms side by side, a table for each label set: cells are P/R/F1/F-beta, `-` where an arm has none.

    rows: method, labels, label and scores; overall: method, labels and scores; protection:
    method, nric_total, nric_protected. Methods, label sets and labels stand in order of first mention.
    """
    rows, overall = list(rows), list(overall)
    cell = lambda r: "/".join(f"{r[k]:.2f}" for k in ("precision", "recall", "f1", "f_beta")) if r else "-"
    arms, sets = (list(dict.fromkeys(r[k] for r in [*overall, *rows])) for k in ("method", "labels"))
    lines = [title, "=" * 78]
    for s in sets:
        own = {(r["label"], r["method"]): r for r in rows if r["labels"] == s}
        lines += ["", f"BY LABEL, {s} (precision/recall/F1/F-beta)", f"{'label':<20}" + "".join(f"{a:>23}" for a in arms)]
        lines += [f"{k:<20}" + "".join(f"{cell(own.get((k, a))):>23}" for a in arms) for k in dict.fromkeys(k for k, _ in own)]
    total = {(r["method"], r["labels"]): r for r in overall}
    lines += ["", "OVERALL (precision/recall/F1/F-beta)", f"{'method':<20}" + "".join(f"{s:>23}" for s in sets)]
    lines += [f"{a:<20}" + "".join(f"{cell(total.get((a, s))):>23}" for s in sets) for a in arms]
    said = [f"{r['method']:<20}{r['nric_protected']}/{r['nric_total']} safe" + (f" ({r['nric_protected'] / r['nric_total']:.2f})" if r["nric_total"] else " (n/a)") for r in protection]
    return "\n".join([*lines, *(["", "WHOLE NATIONAL IDS (safe: a piece was caught)", *said] if said else [])]) + "\n"
