"""Exact, SimHash and substring dedup against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspan.llm import bloom, exact_dedup, queries, simhash, spans_dedup
from veilspan.llm.common import attach

LONG = "lorem ipsum dolor sit amet " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, id string, h long, n long"


def table(spark, rows):
    """Rows of (id, text) among columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", 1, 2) for i, t in rows], SCHEMA).repartition(3)


ODD = [(1, None), (2, ""), (3, "Ab c"), (4, "aB C"), (5, "É é"), (6, "é É"), (7, LONG), (8, LONG.upper()), (9, "x"), (9, "x"), (None, "only"), (None, "only"), (11, "only"), (12, "ab c"), (12, "AB C")]
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("cap", [64 << 20, 8])
def test_exact_dedup_brute_force(spark, cap):
    """A filter of a few bytes makes many rounds; the result is the same."""
    rng = random.Random(1)
    rows = ODD + [(100 + i, f"text {rng.randint(0, 60)}") for i in range(150)]
    out = exact_dedup.exact_dedup(table(spark, rows), max_filter_bytes=cap if cap > 8 else 40).collect()
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, kept = hashlib.sha256(t.encode()).hexdigest(), False
        for i in ids:
            want.append((i, keep, len(ids), i == keep and not kept, sha))
            kept |= i == keep
    key = lambda x: (x[4], x[0] is None, x[0] or 0, x[3])
    assert sorted((tuple(r) for r in out), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("cap", [64 << 20, 1])
def test_drop_copies_keeps_rows_whole(spark, cap):
    """A filter of one byte makes many ranges and lets few rows through at once; rows are the same."""
    out = exact_dedup.drop_copies(table(spark, ODD), max_filter_bytes=cap)
    assert out.columns == table(spark, ODD).columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert sorted((i for i, _ in got), key=str) == sorted([2, 6, 5, 8, 9, 11, 12], key=str)
    assert [t for i, t in got if i == 8] == [LONG.upper()] and [t for i, t in got if i == 12][0] in ("ab c", "AB C")


def test_one_filter_is_alive_at_a_time(spark, monkeypatch):
    live, most = [], []
    make, end = bloom.Filter.__init__, bloom.Filter.destroy

    def born(self, *a, **b):
        make(self, *a, **b)
        live.append(self)
        most.append(len(live))

    monkeypatch.setattr(bloom.Filter, "__init__", born)
    monkeypatch.setattr(bloom.Filter, "destroy", lambda self: (live.remove(self), end(self)))
    rows = [(i, f"t{i % 30}") for i in range(90)]
    assert exact_dedup.exact_dedup(table(spark, rows), max_filter_bytes=9).filter("kept").count() == 30
    assert len(most) == 10 and max(most) == 1 and not live


def test_filter_is_built_once(spark):
    """No task of the build runs twice, though its shuffle files go at the end of it."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    for _ in range(20):
        before = seen.value
        df = spark.range(1000, numPartitions=8).mapInArrow(counted, "id long")
        bloom.repeats(df, 1000).destroy()
        assert seen.value == before + 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_empty_tables(spark):
    none = table(spark, [(1, "a")]).limit(0)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert simhash.simhash_groups(none).count() == 0 and simhash.drop_near_copies(none).count() == 0
    assert spans_dedup.dedup_spans(none).count() == 0


def test_filters_pass_all_they_should(spark):
    h = np.random.default_rng(0).integers(-(2**63), 2**63, 5000)
    df = spark.createDataFrame([(int(x),) for x in [*h, *h[:300]]], "h long").repartition(5)
    again = set(h[:300].tolist())
    marked = df.withColumn("m", bloom.repeats(df, 5300).maybe(F.col("h"))).collect()
    assert all(r["m"] for r in marked if r["h"] in again)
    assert sum(r["m"] for r in marked if r["h"] not in again) < 200
    some = spark.createDataFrame([(x,) for x in again], "h long")
    for most in (64 << 20, 40):  # the second has about one bit for each
        marked = df.withColumn("m", bloom.members(some, 300, max_bytes=most).maybe(F.col("h"))).collect()
        assert all(r["m"] for r in marked if r["h"] in again)


def brute_fp(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(FOLD)) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = list(ODD)
    for k in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([40, 400]))]
        for j in range(4):
            own = list(base)
            for _ in range(j):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((200 + 10 * k + j, " ".join(own)))
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(table(spark, rows)).collect()), key=str)
    fps = [brute_fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    want = sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)
    assert got == want


def test_anchors_meet_for_all_links():
    """Any two words of at most two differing bits share an anchor; no anchor is further than 2."""
    rng = np.random.default_rng(7)
    for x in rng.integers(0, 2**64, 20, dtype=np.uint64):
        at, _ = simhash.anchors(np.array([x]))
        low = x & np.uint64(2**63 - 1)
        assert np.bitwise_count(at ^ low).max() <= 2 and len(at) in (1, 32)
        for b in rng.choice(64, (40, 2)):
            y = x ^ np.uint64(1 << int(b[0])) ^ np.uint64(1 << int(b[1]))
            assert set(at.tolist()) & set(simhash.anchors(np.array([y]))[0].tolist())


def test_components_of_chains_and_stars(spark):
    """Chains, stars around their smallest and their largest node, and a comb of both."""
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1040)] + [(5000, 5001), (5001, 5000)]
    edges += [(9200, i) for i in range(9000, 9200)] + [(7000 + i, 7100 - i) for i in range(40)] + [(7100 - i, 7001 + i) for i in range(40)]
    out = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["root"] for r in out}
    assert len(out) == len(got) == len({x for e in edges for x in e})
    for low, high in ((0, 60), (1000, 1039), (5000, 5001), (9000, 9200)):
        assert all(got[i] == low for i in range(low, high + 1))
    assert {got[x] for e in edges for x in e if 7000 <= x <= 7100} == {7000}


@pytest.mark.parametrize("cap", [256 << 20, 0])
def test_drop_near_copies(spark, cap):
    kept = simhash.drop_near_copies(table(spark, ODD), max_filter_bytes=cap)
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert kept.columns == table(spark, ODD).columns and ids.count(9) == 1 and 1 in ids and 2 not in ids and ids.count(None) == 2


def test_near_copies_are_told_by_id_and_text(spark):
    """A row of its own text stays, though another of its id is a near copy."""
    rows = [(1, "a b c d"), (2, "A b c d"), (2, "quite another text here"), (3, "x y z"), (3, "X Y Z"), (3, "last of all these")]
    got = sorted((r["doc_id"], r["text"].lower()) for r in simhash.drop_near_copies(table(spark, rows)).collect())
    assert got == [(1, "a b c d"), (2, "quite another text here"), (3, "last of all these"), (3, "x y z")]


def brute_sentences(text):
    """Pieces of a text as the rules say, word by word; each with its lower-cased words."""
    words, at = re.findall(r"\S+", text), [m.start() for m in re.finditer(r"\S+", text)]
    low, sents = [w.lower() for w in words], []
    for k, w in enumerate(words):
        gap = text[at[k - 1] + len(words[k - 1]) : at[k]] if k else ""
        if not k or "\n" in gap or words[k - 1][-1] in ".!?":
            sents.append([])
        sents[-1].append(k)
    opens = []
    h64 = lambda w: xxhash.xxh3_64_intdigest(w.encode())
    for s in sents:
        opens.append(s[0])
        if len(s) > 17:
            pair = {}
            for k in s[1:]:
                x = (h64(low[k - 1]) * 0x9E3779B97F4A7C15 % 2**64) ^ h64(low[k])
                x = x * 0xBF58476D1CE4E5B9 % 2**64
                pair[k] = x ^ (x >> 31)
            opens += [k for k in s[1:] if all(pair[k] < pair[j] if j > k else pair[k] <= pair[j] for j in range(k - 3, k + 4) if j != k and j in pair)]
    ends = [*opens[1:], len(words)]
    at = [0, *(at[k] for k in opens[1:]), len(text)]
    return [(text[a:b], low[i:j]) for a, b, i, j in zip(at, at[1:], opens, ends)]


def brute_spans(rows):
    """Cleaned texts by comparing all runs' words."""
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0)):
        units = brute_sentences(t) if t.split() else [(t, [])]
        gone = [False] * len(units)
        for a in range(len(units) - 1):
            key = (tuple(units[a][1]), tuple(units[a + 1][1]))
            if key in seen:
                gone[a] = gone[a + 1] = True
            seen.add(key)
        kept, a = "", 0
        while a < len(units):
            b = a + 1
            while b < len(units) and gone[b] == gone[a]:
                b += 1
            if not gone[a] or sum(len(w) for _, w in units[a:b]) < 12:
                kept += "".join(p for p, _ in units[a:b])
            a = b
        out[i, t] = kept
    return out


def test_substring_dedup_brute_force(spark):
    rng = random.Random(9)
    sent = lambda k=12: " ".join(f"t{rng.randint(0, 999)}" for _ in range(rng.randint(2, k))).capitalize() + rng.choice(".!?")
    shared = [" ".join(sent() for _ in range(8)) for _ in range(3)] + [sent(60)[:-1] + " " + sent(60)]
    rows = [(1, None), (2, ""), (3, "\n\n  "), (4, "One. Two. Three."), (5, "One. Two. Three."), (6, LONG)]
    for i in range(60):
        parts = [sent(rng.choice([12, 12, 50])) for _ in range(10)]
        if i % 3 == 0:
            parts.insert(rng.randint(0, 9), rng.choice(shared))
        rows.append((100 + i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows.append((500, rows[10][1] + " " + rows[10][1]))
    got = {(r["doc_id"]): (r["text"], r["n_removed"]) for r in spans_dedup.dedup_spans(table(spark, rows)).collect()}
    want = brute_spans(rows)
    for i, t in rows:
        assert got[i][0] == want[i, t or ""]
    assert got[4][1] == 0 == got[5][1] and got[500][1] > 0 and got[100][1] == 0
    assert spans_dedup.dedup_spans(table(spark, rows), max_filter_bytes=1).exceptAll(spans_dedup.dedup_spans(table(spark, rows))).count() == 0


def test_spans_of_odd_rows(spark):
    """Null and repeated ids: the first by id, then text hash; rows that repeat are one document."""
    p = "One two three four five six. Seven eight nine ten eleven twelve."
    rows = [(None, f"{p} Own end."), (None, f"{p} Own end."), (7, f"Start. {p}"), (7, f"Begin! {p}"), (7, f"Begin! {p}"), (8, p), (9, "Six words are in this one. Six words are in that one.")]
    out = sorted(((r["doc_id"], r["n_removed"], r["text"]) for r in spans_dedup.dedup_spans(table(spark, rows)).collect()), key=str)
    want = [(7, 2, "Begin! "), (7, 2, "Begin! "), (7, 2, "Start. "), (8, 2, ""), (9, 0, rows[-1][1]), (None, 0, f"{p} Own end."), (None, 0, f"{p} Own end.")]
    assert out == sorted(want, key=str)
    without = [r for r in rows if r[0] == 7]
    lost = [(r["text"], r["n_removed"]) for r in spans_dedup.dedup_spans(table(spark, without)).collect()]
    assert sorted(n for _, n in lost) in ([0, 0, 2], [0, 2, 2])  # one text keeps the passage, by text hash


def test_spans_reach_the_end_of_a_repeat(spark, tmp_path):
    """The last sentences of a repeated passage go, though few words remain from them on."""
    many, few = " ".join(f"a{i}" for i in range(12)) + ".", "Five words are in here."
    passage = f"{many} {many.upper()} {few} Bye then."
    rows = [(1, f"Own words first. {passage}"), (2, f"Something else came before. {passage} And this is after it.")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in queries.op2_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("Something else came before. And this is after it.", 4)}


def test_short_repeats_of_twelve_words_go(spark):
    two = "Six words are in this one. Six words are in that one."
    got = {r["doc_id"]: r["text"] for r in spans_dedup.dedup_spans(table(spark, [(1, f"{two} Then some more."), (2, f"{two} Not the same.")])).collect()}
    assert got == {1: f"{two} Then some more.", 2: "Not the same."}


def test_spans_meet_in_prose_without_marks():
    """51 words that repeat amid other words, with no mark to cut at, hold an equal span."""
    rng = random.Random(5)
    some = lambda n: " ".join(f"u{rng.randint(0, 9999)}" for _ in range(n))
    for _ in range(200):
        passage = some(51)
        a, b = (f"{some(rng.randint(0, 60))} {passage} {some(rng.randint(0, 60))}" for _ in range(2))
        for t in (a, b):
            assert "".join(spans_dedup.Cut(t).pieces()) == t
        assert set(spans_dedup.runs(a)) & set(spans_dedup.runs(b))


def test_sentences_cover_the_text():
    for t in ["", "a", " a.  B! c\n\nd , e", "x " * 80 + ", y; " + "z " * 40, "\n\n", "İ STOP. İ! End"]:
        cut = spans_dedup.Cut(t)
        assert "".join(cut.pieces()) == t
        assert [(p, [w.decode() for w in cut.words[i:j]]) for p, i, j in zip(cut.pieces(), cut.bounds, cut.bounds[1:])] == (brute_sentences(t) if t.strip() else [])


def test_attach_splits_hot_keys(spark):
    rows = spark.range(3000).select((F.when(F.col("id") < 1000, 0).otherwise(F.col("id"))).alias("k"), "id")
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    got = attach(rows, stats, ["k"], "n", 3000, share=10)
    assert got.count() == 3000 and got.filter("k = 0 AND n = 1000 AND m = 999").count() == 1000
