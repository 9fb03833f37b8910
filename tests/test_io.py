"""Files in and out, reports, training logs, streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veilspan.operators import corpus, leaks, losses
from veilspan.sources import corpus_files as files
from veilspan.sources import reports
from veilspan.streaming import redaction


def put(path, obj):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(obj if isinstance(obj, str) else json.dumps(obj, ensure_ascii=False))


def test_split_folder(spark, tmp_path):
    put(tmp_path / "a/1.json", {"input": "é one", "output": {"entities": {"full_name": ["é one"]}}})
    put(tmp_path / "2.json", {"input": "x", "output": {"entities": {}}})
    put(tmp_path / "example.json", {"input": "no"})
    put(tmp_path / "3.json", "{broken")
    put(tmp_path / "4.json", {"output": {"entities": {}}})
    records, rejects = files.read_split(spark, str(tmp_path), "train")
    assert sorted(r["file"] for r in records.collect()) == ["1.json", "2.json"]
    assert {r["file"]: r["reason"] for r in rejects.collect()} == {"3.json": "not JSON", "4.json": "no input"}
    files.write_records(records, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert "é one" in text and '"output":{"entities":' in text
    files.write_by_key(records, str(tmp_path / "keyed"), "split")
    assert (tmp_path / "keyed/split=train").is_dir()


def test_gold_lines_and_judged_shards(spark, tmp_path):
    put(tmp_path / "gold.jsonl", json.dumps({"line": 3, "input": "x", "output": {"entities": {"sg_address": ["a", "a"], "full_name": ["b"]}}}))
    rows = files.read_gold(spark, str(tmp_path / "gold.jsonl")).orderBy("gold_ix").collect()
    assert [(r["gold_ix"], r["text"], r["label"]) for r in rows] == [(0, "a", "SG_ADDRESS"), (1, "a", "SG_ADDRESS"), (2, "b", "FULL_NAME")]
    shard = lambda line: {"assessed": 1, "leaked_lines": [line], "details": [{"line": line, "type": "Full NRIC", "value": "S1234567A"}]}
    put(tmp_path / "j/judge_result_0.json", shard(1))
    put(tmp_path / "j/judge_result_baseline_0.json", shard(2))
    assert [r["line"] for r in files.read_judged(spark, str(tmp_path / "j")).collect()] == [1]
    assert [r["line"] for r in files.read_judged(spark, str(tmp_path / "j"), "baseline").collect()] == [2]


def test_account_detail_round_trip_and_shards(spark, tmp_path):
    calls = spark.createDataFrame([(1, "8000000001 and 8000000001", ["8000000001", "zz"], [(0, 10, "ACCOUNT_NUMBER")]), (2, None, [], [])], "line int, text string, accounts array<string>, spans array<struct<s:int,e:int,label:string>>")
    survival = leaks.account_survival(calls, "line")
    files.write_account_detail(survival, str(tmp_path / "d"))
    got = files.read_account_detail(spark, str(tmp_path / "d")).collect()
    assert [(r["line"], r["value"], r["total"], r["redacted"], r["labels"]) for r in got] == [(1, "8000000001", 2, 1, {"ACCOUNT_NUMBER": 1})]
    assert leaks.unrecoverable_rate(calls, survival, "line").first()["n_bad"] == 0
    lines = corpus.shards(spark.range(10).select(F.col("id").cast("int").alias("line")), 10)
    files.write_shards(lines, str(tmp_path / "s"))
    done = spark.read.json(str(tmp_path / "s")).select("shard")
    files.write_shards(lines, str(tmp_path / "s"), done)
    assert spark.read.json(str(tmp_path / "s")).count() == 10
    files.write_redacted(lines.withColumn("redacted", F.lit("é")), str(tmp_path / "r"))
    assert files.read_redacted(spark, str(tmp_path / "r")).count() == 10
    files.write_methods(lines.withColumn("method", F.lit("rulebased")), str(tmp_path / "m"))
    put(tmp_path / "bank.md", "# a\n\nb")
    assert files.read_bank(spark, str(tmp_path / "bank.md")).first()["value"] == "# a\n\nb"


def test_reports(spark, tmp_path):
    found = spark.createDataFrame([(5, 0, "Full NRIC", "S1<"), (9, 0, "Full Mobile", "9123")], "line long, n int, type string, value string")
    texts = spark.createDataFrame([(5, "see S1< & <SG_ADDRESS>\nx"), (9, "9123")], "line long, redacted string")
    names = spark.createDataFrame([(5, "c_1_x"), (9, "(unmatched)")], "line long, file string")
    cards = reports.leak_cards(leaks.leak_items(found), texts, names)
    card = {r["line"]: r["card"] for r in cards.collect()}
    assert '<span class="leak">S1&lt;</span> &amp; <span class="tag">&lt;SG_ADDRESS&gt;</span><br>x' in card[5] and "#2 line 9" in card[9]
    reports.write_html(cards, "Leaks", str(tmp_path / "h"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "h").glob("part*"))).startswith("<!doctype html>")
    survival = spark.createDataFrame([(1, "80", 2, 1, 1, {"X": 1})], "line long, value string, digits int, total int, redacted int, labels map<string,int>")
    out = reports.account_cards(survival, spark.createDataFrame([(1,)], "line long"), spark.createDataFrame([(1, "a 80")], "line long, text string")).first()["card"]
    assert "80 (2 digits, 1 of 1 occurrence redacted as X)" in out
    row = {"method": "m", "label": "A", "precision": 0.5, "recall": 0.5, "f1": 0.5, "f_beta": 0.5, "passed": False}
    assert "0.5000" in reports.format_scores([row]) and "[FAIL]" in reports.format_gate([row])


def test_training_log(spark, tmp_path):
    put(tmp_path / "t.log", "".join(f"loss={5 - i / 10}, lr=1e-5, x epoch={i / 10}\n" for i in range(25)) + "'eval_loss': 3.0\neval_loss: 2.0\n'eval_loss': 2.0\n")
    train, val = losses.read_log(spark, str(tmp_path / "t.log"))
    assert train.count() == 25 and losses.best_epoch(val).first()[:3] == (1, 2.0, "descending")
    assert losses.smoothed(train, "i", "loss", 25).orderBy("i").collect()[-1]["smooth"] == sum(5 - i / 10 for i in range(19, 25)) / 6
    assert losses.smoothing_span(10) is None


def test_conversations_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, 0, "Account 8000000001 please"), (1, 1, "Thanks, 8000000001 it is"), (2, 0, "What of 8000000001"), (2, 1, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = redaction.read_calls(spark, str(tmp_path / "in"), "conv_id long, turn long, text string")
    redaction.run_available(redaction.redact_conversations(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r[0], r[1]): r[2] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1, 0] == "Account <ACCOUNT_NUMBER> please" and got[1, 1] == "Thanks, <ACCOUNT_NUMBER> it is" and got[2, 1] == ""


def test_command_line(spark, tmp_path, capsys):
    from veilspan.__main__ import main

    spark.createDataFrame([(1, "It is 8000000001.", ["8000000001"])], "doc_id long, text string, accounts array<string>").write.parquet(str(tmp_path / "c"))
    main(["redact", str(tmp_path / "c"), str(tmp_path / "r")])
    assert spark.read.parquet(str(tmp_path / "r")).first()["redacted"] == "It is <ACCOUNT_NUMBER>."
    spark.createDataFrame([(1, 0, "a b", "FULL_NAME")], "doc_id long, i int, text string, label string").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(1, 0, "a b", "FULL_NAME")], "doc_id long, j int, text string, label string").write.parquet(str(tmp_path / "g"))
    main(["benchmark", str(tmp_path / "p"), str(tmp_path / "g"), "--gate", "-o", str(tmp_path / "o")])
    assert "FULL_NAME" in capsys.readouterr().out


def test_record_files_names(spark, tmp_path):
    import pytest

    records = lambda *names: spark.createDataFrame([(n, "x", {}) for n in names], "file string, input string, entities map<string,array<string>>")
    assert files.write_record_files(records("a.json", "b +%.json"), str(tmp_path / "f")) == 2
    assert sorted(r["file"] for r in files.read_split(spark, str(tmp_path / "f"))[0].collect()) == ["a.json", "b +%.json"]
    assert files.write_record_files(records(), str(tmp_path / "none")) == 0
    assert json.loads((tmp_path / "f/a.json").read_text()) == {"input": "x", "output": {"entities": {}}}
    for bad in (("a.json", "a.json"), (None,), ("../a.json",), (".a",)):
        with pytest.raises(ValueError):
            files.write_record_files(records(*bad), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_comparison_report():
    row = lambda m, s, p, **k: {"method": m, "labels": s, "precision": p, "recall": p, "f1": p, "f_beta": p, **k}
    rows = [row("a", "all", 0.5, label="X"), row("b", "all", 0.25, label="X"), row("b", "base", 1.0, label="Y")]
    text = reports.format_comparison(rows, [row("a", "all", 0.5), row("b", "all", 0.25), row("b", "base", 1.0)], [{"method": "a", "nric_total": 2, "nric_protected": 1}, {"method": "b", "nric_total": 0, "nric_protected": 0}])
    lines = [x.split() for x in text.splitlines()]
    assert ["X", "0.50/0.50/0.50/0.50", "0.25/0.25/0.25/0.25"] in lines and ["Y", "-", "1.00/1.00/1.00/1.00"] in lines
    assert ["a", "0.50/0.50/0.50/0.50", "-"] in lines and ["a", "1/2", "safe", "(0.50)"] in lines and ["b", "0/0", "safe", "(n/a)"] in lines


def test_command_line_reports(spark, tmp_path, capsys):
    import pytest

    from veilspan.__main__ import main

    for split, text in (("train", "a b"), ("val", "c d")):
        put(tmp_path / f"data/{split}/1.json", {"input": text, "output": {"entities": {"full_name": [text]}}})
    main(["splits", str(tmp_path / "data"), str(tmp_path / "built"), "--names", "train", "val"])
    assert "train has no gold for: account_number" in capsys.readouterr().out
    assert "".join(p.read_text() for p in (tmp_path / "built/val").glob("part*")) == '{"input":"c d","output":{"entities":{"full_name":["c d"]}}}\n'
    put(tmp_path / "data/val/2.json", {"input": "a b", "output": {"entities": {}}})
    with pytest.raises(SystemExit):
        main(["splits", str(tmp_path / "data"), str(tmp_path / "again"), "--names", "train", "val"])
    assert not (tmp_path / "again").exists()

    put(tmp_path / "red.json", "".join(json.dumps({"line": k, "redacted": f"call {k}"}) + "\n" for k in range(10)))
    main(["shards", str(tmp_path / "red.json"), str(tmp_path / "sh"), "--pieces", "3"])
    assert sorted(p.name for p in (tmp_path / "sh").glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]
    put(tmp_path / "j/judge_result_rulebased_0.json", {"assessed": 10, "leaked_lines": [3], "details": [{"line": 3, "type": "Full NRIC", "value": "call"}]})
    spark.createDataFrame([(k, f"f_{k % 2}_x") for k in range(10)], "line int, file string").write.parquet(str(tmp_path / "names"))
    main(["leaks", str(tmp_path / "j"), str(tmp_path / "red.json"), str(tmp_path / "names"), str(tmp_path / "html")])
    assert "'leaked_files': 1" in capsys.readouterr().out
    assert '<span class="leak">call</span> 3' in "".join(p.read_text() for p in (tmp_path / "html").glob("part*"))

    spark.createDataFrame([(1, 0, "a b", "FULL_NAME"), (1, 1, "x@y.sg", "EMAIL_ADDRESS")], "doc_id long, i int, text string, label string").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(1, 0, "a b", "FULL_NAME"), (1, 1, "S1234567A", "SG_NRIC_FIN")], "doc_id long, j int, text string, label string").write.parquet(str(tmp_path / "g"))
    main(["compare", str(tmp_path / "g"), f"one={tmp_path / 'p'}", "-o", str(tmp_path / "cmp")])
    lines = [x.split() for x in capsys.readouterr().out.splitlines()]
    assert ["FULL_NAME", "1.00/1.00/1.00/1.00"] in lines and ["one", "0.50/0.50/0.50/0.50"] in lines and ["one", "0/1", "safe", "(0.00)"] in lines
