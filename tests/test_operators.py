"""Spans, predicates and the chain against Python's engine, worked cases, and properties."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions import fixed as X
from veilspan.functions import text as T
from veilspan.operators import corpus, leaks, losses, matching, methods, normalize, predicates, recognizers, redact, textwise, vocab, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


TEXTS = ["", "aé ٣٤ 910045 #05-123 \U0001f600 9123 4567, blk 12a", "7-11 and #7-11 $53-54 01:40-01:41 2 - 3", "Call +65 9123-4567 or 91234567 1", "x" * 50 + " 1234567890 \n 12345 610045."]


@pytest.mark.parametrize("pattern,icase", [(X.PHONE, False), (X.ACCOUNT, False), (X.POSTAL, False), (X.UNIT, False), (X.BLOCK, True), (recognizers.AREA, True), (X.ADDRESS_CONTEXT, True), (r"\w+|[^\w\s]", False), (X.EMAIL_RULE, False)])
def test_spans_are_those_of_python(spark, pattern, icase):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in df.select("t", T.spans_of(F.col("t"), pattern, icase).alias("s")).collect():
        want = [m.span() for m in re.finditer(pattern, r["t"], re.I if icase else 0)]
        assert [(x["s"], x["e"]) for x in r["s"]] == want


def test_predicates(spark):
    L = F.lit
    cases = [
        (predicates.nric_like(L("S117")), True), (predicates.nric_like(L("5842H")), True), (predicates.nric_like(L("840D")), True), (predicates.nric_like(L("hello")), False),
        (predicates.valid_nric(L("s123 4567-a")), True), (predicates.phone_ok(L("22289.53")), False), (predicates.phone_ok(L("$4 plus")), False), (predicates.phone_ok(L("502P")), False), (predicates.phone_ok(L("A746")), False),
        (predicates.email_ok(L("sbgroup at x.com")), False), (predicates.email_ok(L("ht-group.com")), False), (predicates.email_ok(L("me dot com")), True), (predicates.email_ok(L("australian residences")), False),
        (predicates.postal_content(L("119")), False), (predicates.postal_content(L("01208")), True), (predicates.unit_content(L("four")), False),
        (predicates.slice_of_number(L("896 372717 1"), L(4), L(10)), True), (predicates.slice_of_number(L("at 372717 ok"), L(3), L(9)), False),
        (predicates.propagates(L("23"), L("SG_ADDRESS_BLOCK")), False), (predicates.propagates(L("Ah Kow"), L("FULL_NAME")), True), (predicates.propagates(L("Kow"), L("FULL_NAME")), False),
        (predicates.not_speaker(L("Speaker_07"), L("FULL_NAME")), False), (predicates.not_speaker(L("Speaker_07"), L("SG_ADDRESS")), True),
        (predicates.label_literal(L(" Full name"), L("full_name")), True), (predicates.generic_words(L("Home address "), L("SG_ADDRESS")), True), (predicates.implausible(L("1234567"), L("SG_NRIC_FIN")), True),
        (predicates.least_confidence(L("SG_ADDRESS_BLOCK")), 0.97), (predicates.least_confidence(L("FULL_NAME")), 0.35),
    ]
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    assert [row[f"c{i}"] for i in range(len(cases))] == [w for _, w in cases]


def test_context_uses_edges_of_addresses_only(spark):
    inside = F.array(F.struct(F.lit(0).alias("s"), F.lit(1000).alias("e")))
    assert one(spark, predicates.near_address(F.lit(500), F.lit(506), inside, 150)) is False
    assert one(spark, predicates.near_address(F.lit(1100), F.lit(1106), inside, 150)) is True
    none = F.array().cast("array<struct<s:int,e:int>>")
    assert one(spark, predicates.block_context_ok(F.lit("01-54"), F.lit(4), F.lit(9), F.lit("blk 01-54"), none)) is False
    assert one(spark, predicates.unit_context_ok(F.lit("0333"), F.lit(0), F.lit(4), F.lit("0333 outbound unit"), none)) is False


@pytest.mark.parametrize("said,want", [("nine one two three four five six seven", "91234567"), ("double one", "11"), ("one moment", "one moment"), ("triple oh, Two-double", "0002"), ("double double five", "55"), ("", "")])
def test_spoken_numbers(spark, said, want):
    got = one(spark, normalize.normalized(F.lit(said)))
    assert got["text"] == want and got["segments"][-1]["oe"] == len(said)
    assert [g["ns"] for g in got["segments"][1:]] == [g["ne"] for g in got["segments"][:-1]]


@pytest.mark.parametrize("n", [0, 1, 1800, 1801, 3200, 3201, 4600])
def test_windows_cover(spark, n):
    got = one(spark, windows.windows(F.lit("x" * n)))
    want, off = [], 0
    while True:
        want.append((off, min(off + 1800, n)))
        if off + 1800 >= n:
            break
        off += 1400
    assert [(w["off"], w["end"]) for w in got] == want


def test_reconcile_is_free_of_conflicts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        c = []
        for _ in range(rng.randint(0, 12)):
            s = rng.randint(0, 60)
            c.append((s, s + rng.randint(1, 25), rng.choice("ABC"), rng.choice([0.5, 0.7, 1.0]), rng.choice([1.0, 9.0, float("inf")])))
        rows.append((i, c))
    df = spark.createDataFrame(rows, "i int, c array<struct<s:int,e:int,label:string,conf:double,margin:double>>")
    for r in df.select("c", windows.reconcile(F.col("c")).alias("k")).collect():
        kept = []
        for s, e, label, conf, _ in sorted(map(tuple, r["c"]), key=lambda x: (-x[4], -x[3], x[0] - x[1], x[0], x[2])):
            shared = lambda k: min(e, k[1]) - max(s, k[0])  # noqa: B023, E731
            if not any(shared(k) > 0 and (k[2] == label or shared(k) / (max(e, k[1]) - min(s, k[0])) >= 0.5) for k in kept):
                kept.append((s, e, label, conf))
        assert [tuple(k) for k in r["k"]] == kept


def test_same_type_overlaps_compare_with_the_first_only(spark):
    spans = [(0, 10, "A", 0.6), (8, 12, "A", 0.85), (11, 20, "A", 0.6), (30, 40, "A", 0.5)]
    df = spark.createDataFrame([(spans,)], f"c {recognizers.RULE_SPAN.replace(':', ': ')}")
    got = df.select(recognizers.resolve_same_type(F.col("c")).alias("k")).first()["k"]
    assert [tuple(k)[:2] for k in got] == [(8, 12), (30, 40)]


def test_units(spark):
    df = spark.createDataFrame([(t,) for t in ["go to 7-11", "at #7-11", "01:40-01:41", "$53-54", "1-1-5-2-6", "12-34 kwh used", "#02-12 ok"]], "text string")
    got = [[r["text"][s["s"] : s["e"]] for s in r["spans"]] for r in recognizers.with_rule_spans(df, entities=["SG_UNIT_NUMBER"]).collect()]
    assert got == [[], ["#7-11"], [], [], [], [], ["#02-12"]]


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError):
        recognizers.rule_spans(F.lit("x"), ["NOPE"])
    with pytest.raises(ValueError):
        redact.redact(spark.range(1), "pdf")
    with pytest.raises(ValueError):
        methods.method("nope")
    with pytest.raises(Exception, match="unknown model label"):
        spark.range(1).select(vocab.canon_of_model(F.lit("nope"))).collect()


def test_tags_and_outermost(spark):
    df = spark.createDataFrame([("ab Blk 5 Toa Payoh cd", [("Blk 5", "SG_ADDRESS_BLOCK", 3, 8, 0.987), ("Blk 5 Toa Payoh", "SG_ADDRESS", 3, 18, 0.97)])], "text string, spans array<struct<text:string,label:string,s:int,e:int,conf:double>>")
    assert redact.redact(df, "tagged").first()["redacted"] == "ab <SG_ADDRESS> cd"
    assert redact.redact(df, "tagged", with_confidence=True).first()["redacted"] == "ab <SG_ADDRESS:0.97> cd"
    assert redact.redact(df, "blank").first()["redacted"] == "ab  cd"
    assert [tuple(x) for x in redact.redact(df, "spans").first()["redacted"]] == [("Blk 5", "SG_ADDRESS_BLOCK"), ("Blk 5 Toa Payoh", "SG_ADDRESS")]


def test_match_quality(spark):
    q = lambda a, b: one(spark, matching.match_quality(F.lit(a), F.lit(b)))
    assert q("Toa  Payoh.", "toa payoh") == 2.0 and q("1", "610045") == pytest.approx(1 / 6) and q("", "x") == -1.0 and q("ab", "cd") == -1.0


def test_greedy_assignment_prefers_quality(spark):
    pred = spark.createDataFrame([(1, 0, "610", "SG_POSTAL_CODE"), (1, 1, "610045", "SG_ADDRESS")], "doc_id long, i int, text string, label string")
    gold = spark.createDataFrame([(1, 0, "610045", "SG_POSTAL_CODE"), (1, 1, "610045 x", "SG_ADDRESS")], "doc_id long, j int, text string, label string")
    found = matching.outcomes(pred, gold)
    kept = matching.assigned(found)
    assert sorted((r["i"], r["j"]) for r in kept.collect()) == [(0, 1), (1, 0)]
    counts = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in matching.label_counts(found).collect()}
    assert counts == {"SG_POSTAL_CODE": (1, 0, 0), "SG_ADDRESS": (1, 0, 0)}


def test_scores_round_half_even(spark):
    df = spark.createDataFrame([("A", 1, 31, 0), ("B", 0, 0, 0)], "label string, tp long, fp long, fn long")
    a, b = matching.with_scores(df).orderBy("label").collect()
    assert a["precision"] == 0.0312 and a["recall"] == 1.0 and b["f1"] == 0.0 and b["f_beta"] == 0.0


def test_ratios_round_as_python_does(spark):
    pairs = [(a, b) for b in range(1, 401) for a in range(b + 1)]
    df = spark.createDataFrame(pairs, "a int, b int").repartition(4)
    got = df.select("a", "b", matching.rounded(F.col("a") / F.col("b")).alias("r")).collect()
    assert len(got) == len(pairs) and all(r["r"] == round(r["a"] / r["b"], 4) for r in got)


def test_matching_of_odd_calls(spark):
    """Calls on one side only, null texts and labels, and repeated values."""
    pred = spark.createDataFrame([(1, 0, None, "EMAIL_ADDRESS"), (2, 0, "x", "FULL_NAME"), (2, 1, "x", "FULL_NAME"), (None, 0, "x", "FULL_NAME")], "doc_id long, i int, text string, label string")
    gold = spark.createDataFrame([(2, 0, "X", "FULL_NAME"), (3, 0, "y", None), (None, 0, "x", "FULL_NAME")], "doc_id long, j int, text string, label string")
    found = matching.outcomes(pred, gold)
    fp, fn = matching.unmatched(found)
    key = lambda rows: sorted(((r[0], r[1]) for r in rows.collect()), key=str)
    assert key(matching.assigned(found)) == [(2, 0)] and key(fp) == [(1, 0), (2, 1), (None, 0)] and key(fn) == [(3, 0), (None, 0)]


def test_long_series_by_ranges(spark, monkeypatch):
    """Smoothing and trend are the same however small the ranges are."""
    rng = random.Random(2)
    rows = [(k, i, float(rng.randint(0, 99))) for k in "ab" for i in range(0, 900, 3)] + [("c", i, 9.0 - i) for i in range(5)] + [("d", 4, 1.0)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    want = {}
    for name, i, _ in rows:
        own = [x for n, j, x in rows if n == name and j <= i][-7:]
        want[name, i] = sum(own) / len(own)
    monkeypatch.setattr(losses, "smoothing_span", lambda n: 6)
    for size in (1 << 16, 40):
        monkeypatch.setattr(losses, "RANGE", size)
        monkeypatch.setattr(losses, "BLOCK", size)
        got = {(r["k"], r["i"]): r["smooth"] for r in losses.smoothed(df, "i", "v", 300, ["k"]).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
        best = {r["k"]: tuple(r)[1:] for r in losses.best_epoch(df, "i", "v", ["k"]).collect()}
        assert best["c"] == (4, 5.0, "descending") and best["d"] == (4, 1.0, "descending") and best["a"][2] == "oscillating"
        assert best["a"][:2] == min((v, i) for n, i, v in rows if n == "a")[::-1]


def test_street_after_long_words(spark):
    words = " ".join(["w" * 60] * 4)
    spans = lambda t: one(spark, recognizers.REGISTRY[-2].spans(F.lit(t)))
    (m,) = spans(f"go, {words} Street 21")
    assert (m["s"], m["e"]) == (4, 94)


def test_residual_rule_skips_tags_and_toll_free(spark):
    df = spark.createDataFrame([(1, "ok <SG_PHONE_NUMBER> 1-800-6123-4567 S1234567A"), (2, "9123 4567"), (3, None)], "line int, redacted string")
    got = sorted((r["line"], r["type"]) for r in leaks.residual_leaks(df).collect())
    assert (1, "Full NRIC") in got and (2, "Full Mobile") in got and not any(x[0] == 3 for x in got)


def test_replay_and_model_detectors_agree(spark):
    text = "SPEAKER_01: call nine one two three four five six seven or 91234567. " + "Filler words here. " * 120 + "Again 91234567."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")

    def load():
        import re as engine

        class Model:
            def extract(self, texts, labels, threshold):
                return [[("sg_phone_number", m.start(), m.end(), 0.9) for m in engine.finditer(r"\d{8}", t)] for t in texts]

        return Model()

    got = windows.model_spans(df, load, ["sg_phone_number"])
    out = windows.document_spans(df.join(got, "doc_id"), windows.replay_detector(F.col("predictions")))
    rows = {r["doc_id"]: r["spans"] for r in out.collect()}
    assert [x["text"] for x in rows[1]] == ["nine one two three four five six seven", "91234567", "91234567"] and rows[2] == [] == rows[3]


def test_gold_problems(spark):
    df = spark.createDataFrame([(1, "Blk 45, 610045 and 45", {"sg_address_block_number": ["45"], "sg_postal_code": ["610045"], "full_name": ["Blk 45"], "odd": ["zz"]}), (2, None, None)], "doc_id long, input string, entities map<string,array<string>>")
    got = {(r["problem"], r["value"]): (r["listed"], r["occurs"]) for r in corpus.gold_problems(df).collect()}
    assert got == {("count", "zz"): (1, 0), ("label", "odd"): (0, 0)}


def test_calls_are_dealt_to_more_tasks_as_there_are_more(spark, monkeypatch):
    """One row group of orders, a thousand and a half of them: tasks hold as many calls as they may, and no more."""
    from veilspan.plans import calls as C

    monkeypatch.setattr(C, "CALLS_PER_TASK", 100)
    df = C.calls(spark, "/root/testdata/sf0.001")
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 1500 and len(sizes) == 15 and max(sizes) < 110


@pytest.mark.parametrize("name", ["pred_postal_ctx", "pred_unit_ctx", "pred_block_ctx", "split_disjoint"])
def test_texts_are_made_after_calls_are_dealt(spark, name):
    """No filter brings a copy of the text below the exchange that deals keys out."""
    from veilspan.plans.catalogue import QUERIES

    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    dealt = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("Exchange RoundRobinPartitioning")[1:]
    assert dealt and not any("Good morning" in part.split("FileScan")[0] for part in dealt)


def odd_texts(n=400):
    """Pieces that patterns look for, joined in ways that bend them."""
    rng = random.Random(11)
    pieces = [
        "+65 9123-4567", "6591234567", "65 6123 4567", "3 6-9 1234 5678", "9123 4567", "+9", "1234567890", "910045", "#05-123", "7-11", "#7 - 11", "01:40-01:41", "$53-54", "1-1-5-2", "S1234567A", "T7654321b",
        "a.b+c@x-y.com", "@", "a@b.c", "x@y.sg@z.org", "at foo.com.sg", "At sb-group.com", "my name is Ann Lee", "this is Bob Ray Tan", "postal code", "Singapore", "blk 12a", "Block  7", "Toa Payoh", "Marina East",
        "Ang Mo Kio Street 21 5b", "w" * 70, "Jalan Besar Road", "ave", "located at the Big Green Gate 1 2 3 4", "visa", "kwh", "5th floor", "nric", "Tan,", "nine one two three four five six seven", "double oh", "one moment", "phone",
        "unit", "reference number", "é", "٣٤٥٦٧٨", "ſtreet", "\U0001f600", "\u0001", "\n", ",", ".", "-", "#", "  ", "Speaker_01",
    ]
    return ["", *("".join(rng.choice(pieces) + rng.choice(["", " ", " ", " ", ", "]) for _ in range(rng.randint(1, 14))) for _ in range(n)), *(" ".join(rng.choice(pieces) for _ in range(500)) for _ in range(4))]


def test_finders_are_the_patterns():
    """Each finder against Python's engine over the pattern as fixed."""
    pairs = [(textwise.phones, X.PHONE), (textwise.accounts, X.ACCOUNT), (textwise.nrics, X.NRIC_RULE), (textwise.emails, X.EMAIL_RULE), (textwise.persons, X.PERSON_RULE), (textwise.postals, X.POSTAL), (textwise.units, X.UNIT), (textwise.nrics_boosted, X.NRIC_BOOST)]
    either = [(textwise.blocks, X.BLOCK), (textwise.suffixes, recognizers.SUFFIX), (textwise.areas, recognizers.AREA), (textwise.spoken_runs, normalize.RUN)]
    for t in odd_texts(3000):
        for finder, pattern in pairs:
            assert finder(t) == [m.span() for m in re.finditer(pattern, t)], (pattern, t)
        for finder, pattern in either:
            assert finder(t) == [m.span() for m in re.finditer(pattern, t, re.I)], (pattern, t)
        assert textwise.emails_boosted(t) == [m.span(2) for m in re.finditer(X.EMAIL_BOOST, t)], t


def test_rules_and_chain_text_by_text_are_those_of_columns(spark):
    """The workers' rules and chain against the column expressions, on odd texts and null."""
    rows = [(i, t) for i, t in enumerate([*odd_texts(150), None])]
    df = spark.createDataFrame(rows, "i int, text string").repartition(4)
    text = T.clean_marks(F.coalesce("text", F.lit("")))
    detect = windows.rules_detector()
    column = lambda chunk, off, end: detect(chunk, off, end)  # noqa: E731 - without the mark of the rule detector
    both = recognizers.with_rule_spans(df).select("i", "text", F.col("spans").alias("own"), T.let(text, lambda t: recognizers.rule_spans(t)).alias("want"))
    for r in both.collect():
        assert r["own"] == r["want"], r["text"]
    mine = {r["i"]: r["spans"] for r in windows.document_spans(df, detect, size=60, overlap=20).collect()}
    for r in windows.document_spans(df.filter("length(text) < 900 OR text IS NULL"), column, size=60, overlap=20).collect():
        assert [tuple(x) for x in mine[r["i"]]] == [tuple(x) for x in r["spans"]], r["text"]


def test_rule_spans_are_worked_out_once(spark):
    """A filter above the predictions does not bring a second copy of the rules."""
    df = recognizers.rule_predictions(spark.createDataFrame([(1, "call 9123 4567")], "doc_id long, text string")).filter(F.size("predictions") > 0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") <= 1 and plan.count("run(text") == 1
    assert df.first()["predictions"][0]["text"] == "9123 4567"


def test_standalone_counts_of_odd_values(spark):
    """Null, empty and nested values, and texts that are null."""
    rows = [("ab 12 x12 12. é12é a1", ["12", "b 12", "", None, "?!", "12."]), (None, ["a"]), ("x", None)]
    df = spark.createDataFrame(rows, "t string, v array<string>")
    got = [None if r["c"] is None else [tuple(x) for x in r["c"]] for r in df.select(corpus.standalone_counts(F.col("t"), F.col("v")).alias("c")).collect()]
    assert got[0] == [("b 12", 0), ("12.", 3), ("12", 0), ("?!", 0), ("", 0)] and got[1] == [("a", 0)] and got[2] is None
    for t in odd_texts(300):
        for v in ("12", "9123", "@", "Tan", "."):
            assert textwise.standalone(t, v) == [m.span() for m in re.finditer(rf"(?<![A-Za-z0-9]){re.escape(v)}(?![A-Za-z0-9])", t)]


def test_overall_works_counts_out_once(spark):
    found = matching.outcomes(spark.createDataFrame([(1, 0, "x", "FULL_NAME")], "doc_id long, i int, text string, label string"), spark.createDataFrame([(1, 0, "x", "FULL_NAME"), (1, 1, "y", "SG_ADDRESS")], "doc_id long, j int, text string, label string"))
    df = matching.overall(matching.label_counts(found))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join FullOuter") == 1
    assert sorted((r["labels"], r["tp"], r["fp"], r["fn"]) for r in df.collect()) == [("all", 1, 0, 1), ("base", 0, 0, 1)]


def test_normalized_text_by_text_is_that_of_columns(spark):
    df = spark.createDataFrame([(t,) for t in [*odd_texts(100), None]], "t string")
    for r in df.select("t", textwise.normalized_column(spark, F.col("t")).alias("own"), normalize.normalized(T.clean_marks(F.col("t"))).alias("want")).collect():
        assert r["own"] == r["want"], r["t"]


def test_accounts_are_plain_substrings(spark):
    """Values of pattern characters, nested in longer ones, and odd arrays."""
    rows = [(1, r"a\\Eb 1.1 1.1 aaaa", [r"\\E", "1.1", "aa", "zz", "", None, "aa"], [(4, 6, "B"), (6, 9, "A"), (5, 9, "A")]), (2, None, ["x"], None), (3, "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, accounts array<string>, spans array<struct<s:int,e:int,label:string>>")
    got = {r["value"]: (r["digits"], r["total"], r["redacted"], r["labels"]) for r in leaks.account_survival(df).collect()}
    at = rows[0][1].find("1.1")
    labels = {x[2]: 1 for x in rows[0][3] if x[0] < at + 3 and at < x[1]}
    assert got.keys() == {r"\\E", "1.1", "aa"} and got["aa"] == (0, 2, 0, {}) and got["1.1"][:2] == (2, 2) and set(labels) <= set(got["1.1"][3])


def test_outcomes_in_rows_are_those_of_tables(spark):
    """Calls matched from their own rows: the same as from two tables, without a shuffle; null and empty sides, odd values."""
    rng = random.Random(5)
    texts, names = ["610045", "610", "Blk 5, x", "blk 5", "", None, ".,", "x", "X.", "x y"], [*vocab.CANON, "contact", "postal_code", "other", "OTHER", None]
    rows = [(i, [(n, rng.choice(texts), rng.choice(names)) for n in range(rng.randint(0, 7))], [(n, rng.choice(texts), rng.choice(names)) for n in range(rng.randint(0, 7))]) for i in range(200)]
    rows += [(200, None, [(0, "x", "EMAIL")]), (201, [(0, "x", "EMAIL")], None)]
    df = spark.createDataFrame(rows, "doc_id long, p array<struct<i:int,text:string,label:string>>, g array<struct<j:int,text:string,label:string>>")
    own = matching.outcomes_in_rows(df, "p", "g")
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    each = lambda c: df.select("doc_id", F.explode(c).alias("x")).select("doc_id", "x.*")
    kept = lambda out: (out["pairs"], out["hits"], sorted(map(str, out["fp"])), sorted(map(str, out["fn"])))
    want = {r["doc_id"]: kept(r["out"]) for r in matching.outcomes(each("p"), each("g")).collect()}
    got = {r["doc_id"]: kept(r["out"]) for r in own.collect()}
    assert len(got) == 202 and {k: v for k, v in got.items() if k in want} == want and all(v == ([], [], [], []) for k, v in got.items() if k not in want)
    q = lambda a, b: matching.match_quality(F.lit(a), F.lit(b))
    by = {r["doc_id"]: r["out"] for r in own.collect()}
    quality = {(a, b): one(spark, q(a, b)) for a in texts if a is not None for b in texts if b is not None}
    for i, p, g in rows[:200]:
        found = {(m["i"], m["j"]): -m["k"] for m in by[i]["pairs"]}
        groups = lambda x: {**{v[1]: v[4] for v in X.LABELS}, **{n: k for k, v in X.GROUP_SYNONYMS.items() for n in v}}.get(x.upper(), x.upper())
        wanted = {(a[0], b[0]): quality[a[1], b[1]] for a in p for b in g if None not in (*a, *b) and groups(a[2]) == groups(b[2]) and quality[a[1], b[1]] > 0}
        assert found == wanted


@pytest.mark.parametrize("name", ["score_overall", "score_by_label", "gate", "nric_protection"])
def test_scores_of_calls_shuffle_counts_only(spark, name):
    """After calls are dealt, no exchange by call: what shuffles is counts by label, or counts."""
    from veilspan.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan and plan.count("RoundRobinPartitioning") == 1


def odd_sides(n=300):
    """Calls of predictions and gold: null, empty, equal, nested and bent texts, null and repeated numbers, null items and sides."""
    rng = random.Random(17)
    texts = ["610045", "610", "1", "Blk 5, x", "blk 5", "", None, ".,", "x", "X.", "x y", "\u00e9tage 5", "\u00c9TAGE", "\u0391\u03a3", "\u03b1\u03c2", "\u0130", "a\u2003b", "\u2003", "a  b", "\U0001f600 5", "\ua7cb", "\u0264"]
    names = [*vocab.CANON, "contact", "Postal_Code", "other", "OTHER", "", "\u00df", "SS", None]
    item = lambda k: None if rng.random() < 0.03 else (rng.choice([k, k, k, k, 0, None, -1 << 31, (1 << 31) - 1]), rng.choice(texts), rng.choice(names[rng.choice([0, 6]) :]))
    side = lambda: None if rng.random() < 0.05 else [item(k) for k in range(rng.choice([0, 1, 3, 9, 30]))]
    same = [(k, "aaaaaaaaaaaa"[: 1 + k % 12], "OTHER") for k in range(40)]
    return [*((i, side(), side()) for i in range(n)), (n, same, same[::-1]), (n + 1, None, None)]


ODD_SIDES = "doc_id long, p array<struct<i:int,text:string,label:string>>, g array<struct<j:int,text:string,label:string>>"


def test_calls_matched_in_workers_are_those_of_columns(spark):
    """A batch of calls in workers against the columns of one call, which sorts and folds as they stand."""
    df = spark.createDataFrame(odd_sides(), ODD_SIDES).repartition(2)
    items = lambda c, n: F.coalesce(F.transform(c, lambda x: matching._own(x[n], x["text"], x["label"])), F.array().cast(matching.ITEMS))
    want = {r["doc_id"]: r["out"] for r in df.select("doc_id", T.let(items("p", "i"), lambda p: T.let(items("g", "j"), lambda g: matching.settled(p, g))).alias("out")).collect()}
    own = {r["doc_id"]: r["out"] for r in matching.outcomes_in_rows(df, "p", "g").collect()}
    assert own == want and sum(len(r["hits"]) for r in want.values()) > 100
    found = matching.label_counts(spark.createDataFrame([(k, v) for k, v in want.items()], matching.outcomes_in_rows(df, "p", "g").schema))
    wide = df.withColumn("p", F.transform("p", lambda x: F.struct(F.lit("more").alias("more"), x["label"].alias("label"), x["text"].alias("text"), x["i"].cast("long").alias("i"))))
    for calls in (df, wide):
        assert sorted(map(str, matching.label_counts_in_rows(calls, "p", "g").collect())) == sorted(map(str, found.collect()))
    assert matching.label_counts_in_rows(df.limit(0), "p", "g").collect() == []


def test_batches_are_settled_in_parts_as_whole(monkeypatch):
    """Few pairs at once and no round over the whole batch: the same pairs, the same kept."""
    import pyarrow as pa

    from veilspan.operators import matchwise

    kind = lambda n: pa.list_(pa.struct([(n, pa.int32()), ("text", pa.string()), ("label", pa.string())]))
    listed = lambda side, n: pa.array([None if x is None else [y and dict(zip((n, "text", "label"), y)) for y in x] for x in side], kind(n))
    rows = odd_sides()
    p, g = listed([r[1] for r in rows], "i"), listed([r[2] for r in rows], "j")
    want, counts = matchwise.told(matchwise.settle(p, g), len(p)), matchwise.counted(matchwise.settle(p, g))
    for pairs, rounds in ((1, 0), (7, 1), (1 << 20, 0)):
        monkeypatch.setattr(matchwise, "PAIRS_AT_ONCE", pairs)
        monkeypatch.setattr(matchwise, "ROUNDS", rounds)
        assert matchwise.told(matchwise.settle(p, g), len(p)) == want and matchwise.counted(matchwise.settle(p, g)) == counts


def test_cleaning_in_workers_is_that_of_columns(spark):
    """Every code point between letters, ends of words, and bytes that are no text."""
    from veilspan.operators import matchwise

    texts = [f"A{chr(c)}B" for c in range(0x110000) if not 0xD800 <= c < 0xE000] + ["\u0391\u03a3", "\u0391\u03a3 \u0392", " - ", ""]
    bytes_ = spark.createDataFrame([(b"a\xffB",), (b"\xe2\x82 x",)], "b binary").select(F.expr("cast(b AS string)").alias("t"))
    df = spark.createDataFrame([(" ".join(texts[k : k + 997]),) for k in range(0, len(texts), 997)], "t string").unionByName(bytes_)
    got = df.select(F.col("t").cast("binary").alias("t"), matching.cleaned(F.col("t")).alias("c"), F.upper("t").alias("u")).collect()
    import pyarrow as pa

    own = matchwise.cleaned(pa.array([bytes(r["t"]) for r in got], pa.binary()).view(pa.string())).to_pylist()
    assert own == [r["c"] for r in got]
    assert all(matchwise.match_group(bytes(r["t"]).decode()) == r["u"] for r in got[:-2])


def test_labels_that_are_no_text_are_counted(spark):
    """Bytes that are no UTF-8 stay as they are in labels and match their own kind."""
    item = lambda n: f"array(named_struct('{n}', 0, 'text', 'x', 'label', cast(b AS string)))"
    df = spark.createDataFrame([(b"a\xff",), (b"a\xff",), (b"b",)], "b binary").selectExpr(f"{item('i')} AS p", f"{item('j')} AS g")
    got = matching.label_counts_in_rows(df, "p", "g").select(F.col("label").cast("binary").alias("b"), "tp", "fp", "fn").collect()
    assert sorted((bytes(r["b"]), r["tp"], r["fp"], r["fn"]) for r in got) == [(b"a\xff", 2, 0, 0), (b"b", 1, 0, 0)]


@pytest.mark.parametrize("name", ["score_overall", "score_by_label", "gate", "nric_protection"])
def test_scores_of_calls_are_matched_in_batches(spark, name):
    """No fold of columns over pairs, which Spark interprets call by call."""
    from veilspan.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert ("ArrowEvalPython" if name == "nric_protection" else "MapInArrow") in plan and "aggregate(" not in plan


def test_label_report_of_odd_records(spark, monkeypatch):
    """Null and repeated keys, null and empty entities, unknown labels; tasks as there are records."""
    monkeypatch.setattr(corpus, "RECORDS_PER_TASK", 2)
    rows = [(1, {"full_name": ["a", "a", None], "odd": ["x"]}), (1, {"full_name": ["b"], "sg_address": []}), (2, {"full_name": ["a"], "email_address": None}), (None, {"full_name": ["c"], "sg_address": ["d"]}), (None, {"full_name": ["c"]}), (3, None)]
    df = spark.createDataFrame(rows * 4, "doc_id long, entities map<string,array<string>>")
    report = corpus.label_report(df)
    assert "hashpartitioning(_key#" in (plan := report._jdf.queryExecution().executedPlan().toString()) and ", 12), REPARTITION_BY_NUM" in plan
    got = {r["label"]: (r["mentions"], r["files"]) for r in report.collect()}
    assert got.keys() == set(corpus.MODEL_LABELS) and {k: v for k, v in got.items() if v != (0, 0)} == {"full_name": (28, 2), "sg_address": (4, 0)}
    old = corpus.mentions(df).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("f")).collect()
    assert {r["label"]: (r["n"], r["f"]) for r in old if r["label"] != "odd"} == {k: v for k, v in got.items() if v != (0, 0)}
    assert [tuple(r) for r in corpus.label_report(df.limit(0), labels=["full_name"]).collect()] == [("full_name", 0, 0)]
    assert sorted(r["label"] for r in corpus.missing_labels(df).collect()) == sorted(set(corpus.MODEL_LABELS) - {"full_name", "sg_address"})
