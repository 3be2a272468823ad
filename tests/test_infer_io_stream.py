"""Batch inference, judge pipeline, files, workbook source and streaming scoring."""

import os
import sys
import time
import zipfile
from collections import Counter

import pytest
from pyspark import cloudpickle

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lexigen.functions.prompts import SCORE_COLUMNS
from lexigen.operators import infer as I
from lexigen.operators import judge as J
from lexigen.operators.pairs import to_pairs
from lexigen.plans import fixtures as FX
from lexigen.sources import files as IO
from lexigen.sources.workbook import read_workbook


# Generators defined here travel to Python workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Recorder:
    """Generator that reports its batch sizes in the output."""

    cache_key = None

    def __call__(self):
        def gen(prompts):
            return [f"  {len(prompts)}  " for _ in prompts]

        return gen


def test_batch_generate_batches_and_strips(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("p")).coalesce(1)
    out = I.batch_generate(df, "p", "g", Recorder(), batch_size=8).collect()
    assert sorted(int(r["g"]) for r in out) == [4] * 4 + [8] * 16
    assert all(r["g"] == r["g"].strip() for r in out)


def test_predict_keeps_rows(spark):
    pairs = to_pairs(FX.cases(spark, SF_SMALL))
    out = I.predict(pairs, I.EveryNthWord(3), model="base")
    assert out.count() == pairs.count()
    assert set(out.columns) == {"case_id", "prompt", "reference", "generated", "model"}
    r = out.orderBy("case_id").first()
    assert r["generated"] == " ".join(r["prompt"].split()[::3])


class Tally:
    """Generator that writes down every prompt it answers, and stops at ``bad`` while the file ``stop`` is there."""

    cache_key = None

    def __init__(self, folder, bad=()):
        self.folder, self.bad = folder, set(bad)

    def __call__(self):
        import uuid

        def gen(prompts):
            if self.bad & set(prompts) and os.path.exists(f"{self.folder}/stop"):
                while len(os.listdir(self.folder)) < 4:  # the other partitions are under way
                    time.sleep(0.1)
                time.sleep(2)
                raise RuntimeError("broken off")
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(prompts))
            return [p.upper() for p in prompts]

        return gen


def answered(folder):
    return Counter(p for f in os.listdir(folder) if f != "stop" for p in open(f"{folder}/{f}").read().split("\n"))


def test_broken_generation_is_taken_up(spark, tmp_dir):
    """The finished partitions of a run that broke off stay; every prompt is answered once in all."""
    path, folder = f"{tmp_dir}/made", f"{tmp_dir}/calls"
    os.makedirs(folder)
    open(f"{folder}/stop", "w").close()
    df = spark.range(40).select(F.col("id").alias("case_id"), F.concat(F.lit("p"), "id").alias("p")).repartitionByRange(4, "case_id")
    with pytest.raises(Exception, match="broken off"):
        I.generate_missing(df, "p", "g", Tally(folder, ["p5"]), path)
    first = answered(folder)
    assert 0 < len(first) < 40 and set(first.values()) == {1}
    os.remove(f"{folder}/stop")
    out = I.generate_missing(df, "p", "g", Tally(folder, ["p5"]), path)
    assert sorted((r.case_id, r.g) for r in out.collect()) == [(i, f"P{i}") for i in range(40)]
    assert answered(folder) == Counter(f"p{i}" for i in range(40))
    # nothing is missing: no call; a grown table: its new rows alone
    I.generate_missing(df, "p", "g", Tally(folder), path)
    assert answered(folder) == Counter(f"p{i}" for i in range(40))
    more = df.unionByName(spark.createDataFrame([(99, "p99")], df.schema))
    assert I.generate_missing(more, "p", "g", Tally(folder), path).count() == 41
    assert answered(folder) == Counter([f"p{i}" for i in range(40)] + ["p99"])
    for bad in (df.union(df), more.withColumn("case_id", F.lit(None).cast("long")).limit(1)):
        with pytest.raises(ValueError, match="case_id"):
            I.generate_missing(bad, "p", "g", Tally(folder), path)


def test_judge_pipeline(spark):
    cases = FX.cases(spark, SF_SMALL)
    gen = J.generate_impressions(cases, I.ListEcho())
    table = J.judge_table(J.judge(gen, I.RubricEcho()))
    assert table.columns == ["case_id", "generated_impression", "output_impression", *SCORE_COLUMNS]
    rows = table.collect()
    assert len(rows) == cases.count()
    for r in rows:
        for k in SCORE_COLUMNS:
            assert r[k] is None or 0 <= r[k] <= 5


class Counting:
    """Generator that writes down every prompt it sees."""

    cache_key = None

    def __init__(self, path):
        self.path = path

    def __call__(self):
        import uuid

        def gen(prompts, max_new_tokens=None):
            with open(os.path.join(self.path, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(p.split("#")[1] for p in prompts))
            return [f"out {max_new_tokens}"] * len(prompts)

        return gen


def test_report_generates_and_scores_once(spark, tmp_dir):
    from lexigen.operators.evaluate import evaluate

    seen = os.path.join(tmp_dir, "seen")
    os.makedirs(seen)
    pairs = spark.createDataFrame([(str(i), f"text #{i}# end", "out 5") for i in range(20)], "case_id string, prompt string, response string")
    preds = I.predict(pairs, Counting(seen), model="m", max_new_tokens=5)
    detail, _ = evaluate(preds)
    IO.write_report(detail, os.path.join(tmp_dir, "report"), fmt="parquet")
    prompts = [x for f in os.listdir(seen) for x in open(os.path.join(seen, f)).read().split("\n")]
    assert sorted(map(int, prompts)) == list(range(20))
    assert sorted(os.listdir(os.path.join(tmp_dir, "report"))) == ["detail", "summary"]
    summary = spark.read.parquet(os.path.join(tmp_dir, "report", "summary")).first()
    assert (summary["n_samples"], summary["EM"]) == (20, 1.0)


def test_attach_checks_keys_in_its_plan(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "case_id long")
    out = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "n"), (None, "n")], "case_id long, generated string")
    joined = I.attach(a, out)  # no job yet
    with pytest.raises(Exception, match="twice"):
        joined.collect()
    once = I.attach(a, out.filter("generated <> 'y'")).collect()
    assert sorted(((r.case_id, r.generated) for r in once), key=str) == [(1, "x"), (2, None), (None, None)]


def test_csv_and_json_round_trip(spark, tmp_dir):
    rows = [("a, b", 'say "hi"', "line1\nline2"), ("", " ", "NA"), ("é ü", "None", None)]
    df = spark.createDataFrame(rows, "prompt string, reference string, generated string")
    IO.write_predictions(df, os.path.join(tmp_dir, "pred"))
    back = IO.read_predictions(spark, os.path.join(tmp_dir, "pred"), model="m")
    got = sorted((r["prompt"] or "", r["reference"] or "", r["generated"]) for r in back.collect())
    want = sorted((p, r, g) for p, r, g in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    pairs = spark.createDataFrame([("héllo\nthere", "nan"), ("x", None)], "prompt string, response string")
    IO.write_pairs(pairs, os.path.join(tmp_dir, "pairs"))
    back = IO.read_pairs(spark, os.path.join(tmp_dir, "pairs"), multiline=False)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, pairs.collect()), key=str)
    arr = spark.createDataFrame([(1, ["a", "it's"])], "id int, items array<string>")
    IO.write_csv(arr, os.path.join(tmp_dir, "arr"))
    txt = spark.read.option("header", True).option("escape", '"').csv(os.path.join(tmp_dir, "arr")).collect()[0]["items"]
    assert txt == repr(["a", "it's"])


def _file(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_damaged_files_stop_the_read(spark, tmp_dir):
    good = '{"prompt": "a", "response": "b"}'
    bad = {
        "line.jsonl": (False, good + '\n{"prompt": "a", "resp'),
        "array.json": (True, f'[{good}, {{"prompt": "a"'),
        "none.json": (True, '[{"prompt": null, "response": "b"}]'),
        "lack.json": (True, '[{"response": "b"}]'),
    }
    for name, (multiline, text) in bad.items():
        with pytest.raises(Exception):
            IO.read_pairs(spark, _file(tmp_dir, name, text), multiline=multiline).collect()
    fine = IO.read_pairs(spark, _file(tmp_dir, "fine.json", f'[{good}, {{"prompt": "c", "response": NaN}}, {{"prompt": "d"}}]'))
    assert sorted(map(tuple, fine.collect())) == [("a", "b"), ("c", None), ("d", None)]
    head = "prompt,reference,generated\n"
    for name, row in (("long.csv", "a,b,c,d\n"), ("short.csv", "a,b\n")):
        path = _file(tmp_dir, name, head + "x,y,z\n" + row)
        for read in (lambda p: IO.read_predictions(spark, p), lambda p: IO.read_predictions(spark, p).select("prompt")):
            with pytest.raises(Exception):
                read(path).collect()
    with pytest.raises(ValueError, match="generated"):
        IO.read_predictions(spark, _file(tmp_dir, "lack.csv", "prompt,reference\na,b\n"))
    other = IO.read_predictions(spark, _file(tmp_dir, "order.csv", "generated,extra,prompt,reference\ng,e,p,r\n"))
    assert [tuple(r) for r in other.collect()] == [("p", "r", "g")]


def _write_xlsx(path, sheets):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rns = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared = []
    with zipfile.ZipFile(path, "w") as z:
        wb = [f'<workbook xmlns="{ns}" xmlns:r="{rns}"><sheets>']
        rels = ['<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">']
        for i, (name, rows) in enumerate(sheets, 1):
            wb.append(f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>')
            rels.append(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml" Type="ws"/>')
            xml = [f'<worksheet xmlns="{ns}"><sheetData>']
            for ri, row in enumerate(rows, 1):
                xml.append(f'<row r="{ri}">')
                for ci, v in enumerate(row):
                    ref = f"{chr(65 + ci)}{ri}"
                    if v is None:
                        continue
                    if isinstance(v, (int, float)):
                        xml.append(f'<c r="{ref}"><v>{v}</v></c>')
                    elif ci == 2:
                        xml.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
                    else:
                        shared.append(v)
                        xml.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
                xml.append("</row>")
            xml.append("</sheetData></worksheet>")
            z.writestr(f"xl/worksheets/sheet{i}.xml", "".join(xml))
        z.writestr("xl/workbook.xml", "".join(wb) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "".join(rels) + "</Relationships>")
        sst = "".join(f"<si><t>{s}</t></si>" for s in shared)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">{sst}</sst>')


def test_workbook_reader(spark, tmp_dir):
    d = os.path.join(tmp_dir, "books")
    os.makedirs(d)
    head = ["case_id", "input_findings", "output_impression"]
    _write_xlsx(os.path.join(d, "a.xlsx"), [("train", [head, [1, "liver ok", "Normal."], [2, None, "Cyst."]]),
                                             ("2024", [head, [3, "kidney", "Stone."]])])
    # another order of columns, and one more
    _write_xlsx(os.path.join(d, "b.xlsx"), [("train", [["input_findings", "case_id", "note", "output_impression"], ["lung", 4, "n", "Nodule."]]), ("2024", [head])])
    want = [("1", "liver ok", "Normal."), ("2", None, "Cyst."), ("4", "lung", "Nodule.")]
    for path in (d, f"file://{d}"):
        first = read_workbook(spark, path, columns=head)
        assert first.columns == head
        assert sorted(map(tuple, first.collect())) == want
    for sheet in ("2024", 1):
        test = read_workbook(spark, os.path.join(d, "a.xlsx"), head, sheet=sheet).collect()
        assert [tuple(r) for r in test] == [("3", "kidney", "Stone.")]
    with pytest.raises(Exception, match="note"):
        read_workbook(spark, d, ["note"]).collect()
    with pytest.raises(Exception, match="no sheet"):
        read_workbook(spark, d, head, sheet="2025").collect()


def test_streaming_scoring(spark, tmp_dir):
    from lexigen.plans.catalog import predictions
    from lexigen.streaming.scoring import read_prediction_stream, start_scoring

    src = os.path.join(tmp_dir, "in")
    p = predictions(spark, SF_SMALL).select("prompt", "reference", "generated", "model")
    p.write.parquet(src)
    qs = start_scoring(read_prediction_stream(spark, src), os.path.join(tmp_dir, "out"),
                       os.path.join(tmp_dir, "ckpt"), summary_table="stream_summary",
                       summary_path=os.path.join(tmp_dir, "summary"))
    for q in qs:
        q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmp_dir, "out"))
    assert out.count() == p.count()
    summ = {r["model"]: r["n_samples"] for r in spark.sql("select * from stream_summary").collect()}
    assert sum(summ.values()) == p.count()
    stored = {r["model"]: r["n_samples"] for r in spark.read.parquet(os.path.join(tmp_dir, "summary")).collect()}
    assert stored == summ


def test_report_and_materialize(spark, tmp_dir):
    from lexigen.operators.evaluate import evaluate
    from lexigen.plans.catalog import predictions
    from lexigen.session import materialize

    detail, _ = evaluate(predictions(spark, SF_SMALL))
    IO.write_report(detail, os.path.join(tmp_dir, "report"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(
        os.path.join(tmp_dir, "report", "summary"))
    assert {r["model"] for r in back.collect()} == {"baseline", "finetuned"}
    m = materialize(detail.select("model", "case_id"), "detail-ids")
    assert m.count() == detail.count()
