import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import cleaning as cl
from tenderlake.operators import loads as ld
from tenderlake.operators import passages as ps


def test_states_watermark_and_resumable(spark, tmp_path):
    log = ld.LoadLog(spark, str(tmp_path / "log"))
    assert log.states().count() == 0 and log.expire("2024-01-01") == 0
    old = log.start("SAM", "FULL", "2024-01-01 00:00:00", {"date_to": "2023-12-01"})
    log.progress(old, "SAM", "FULL", "2024-01-01 01:00:00", {"date_to": "2023-12-31"}, 5, 4)  # from before there was the flag
    part = log.start("SAM", "FULL", "2024-02-01 00:00:00")
    log.progress(part, "SAM", "FULL", "2024-02-01 01:00:00", {"date_to": "2024-01-31", "complete": False, "pages": 3})
    whole = log.start("FH", "FULL", "2024-02-01 00:00:00", {"date_to": "x"})
    log.progress(whole, "FH", "FULL", "2024-02-01 01:00:00", {"date_from": "a", "date_to": "b", "complete": True})
    log.fail(log.start("FH", "FULL", "2024-03-01 00:00:00"), "FH", "FULL", "2024-03-01 00:01:00", ValueError("broken"))
    log.start("FH", "FULL", "2024-03-01 03:00:00")
    log.start("FH", "FULL", "2024-03-01 05:30:00")
    assert {r.source: r.watermark for r in ld.watermarks(log.states()).collect()} == {"SAM": "2023-12-31", "FH": "b"}
    assert [(r.load_id, r.parameters) for r in ld.resumable(log.states()).collect()] == [(part, json.dumps({"date_to": "2024-01-31", "complete": False, "pages": 3}))]
    assert ld.resumable(log.states(), "a", "b").count() == 0 and ld.resumable(log.states(), None, "2024-01-31").count() == 1
    assert log.expire("2024-03-01 06:00:00") == 1 and log.expire("2024-03-01 06:00:00") == 0
    assert sorted(r.status for r in log.states().where("source = 'FH'").collect()) == ["FAILED", "FAILED", "RUNNING", "SUCCESS"]
    assert log.states().where(F.col("message") == ld.STALE_MESSAGE).count() == 1


def test_a_killed_load_writes_each_file_once(spark, tmp_path):
    folder, target, log = tmp_path / "in", str(tmp_path / "out"), ld.LoadLog(spark, str(tmp_path / "log"))
    folder.mkdir()
    for i in range(5):
        (folder / f"f{i}.csv").write_text(f"v\n{i}\n{i + 100}\n")
    reads = []

    def read(spark, files, die_at=None):
        reads.append(len(files))
        if len(reads) == die_at:
            raise RuntimeError("killed")
        return spark.read.csv(list(files), header=True)

    rows = lambda: sorted(int(r.v) for r in spark.read.parquet(target).collect())
    want = sorted(v for i in range(5) for v in (i, i + 100))
    with pytest.raises(RuntimeError):
        ld.load_files(spark, "S", str(folder), target, log, lambda s, f: read(s, f, 2), "2024-01-01 00:00:00", 2)
    assert len(rows()) == 4
    original, log.progress = log.progress, lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))  # after the write, before the log
    with pytest.raises(RuntimeError):
        ld.load_files(spark, "S", str(folder), target, log, read, "2024-01-01 01:00:00", 3)
    log.progress = original
    got = ld.load_files(spark, "S", str(folder), target, log, read, "2024-01-01 09:00:00", 2)
    assert rows() == want and got == {"files": 3, "batches": 2, "written": 6}
    (folder / "again.csv").write_text("v\n0\n100\n")  # another name, the same content: another mark, since the name counts
    (folder / "f0.csv").rename(folder / "f0.csv.bak")
    assert ld.load_files(spark, "S", str(folder), target, log, read, "2024-01-01 10:00:00", 2)["files"] == 2
    assert log.states().where("status = 'FAILED'").count() == 2


ENTITY = """struct<entityRegistration:struct<cageCode:string,registrationDate:string>,
  coreData:struct<physicalAddress:struct<countryCode:string,zipCode:string,stateOrProvinceCode:string>,entityInformation:struct<submissionDate:string>>,
  assertions:struct<goodsAndServices:struct<naicsList:array<struct<naicsCode:string,certificationEntryDate:string>>>>>"""


def test_nested_records_are_cleaned_and_counted_in_one_pass(spark):
    raw = [
        {"entityRegistration": {"cageCode": "1A2B3, 4C5D6", "registrationDate": "12/31/2023"}, "coreData": {"physicalAddress": {"countryCode": " usa", "zipCode": "123456789", "stateOrProvinceCode": "va"}, "entityInformation": {"submissionDate": "20240102"}},
         "assertions": {"goodsAndServices": {"naicsList": [{"naicsCode": "1", "certificationEntryDate": "01/02/2023"}, None, {"naicsCode": "2", "certificationEntryDate": "soon"}, {"naicsCode": "3"}]}}},
        {"entityRegistration": {"cageCode": "9Z9Z9"}, "coreData": {"physicalAddress": {"countryCode": "CÔD", "zipCode": " K1A 0B1 ", "stateOrProvinceCode": "Ontario"}}},
        {"coreData": {"physicalAddress": {"countryCode": None, "zipCode": "123", "stateOrProvinceCode": "05/03/1963"}}}, {},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in raw], "raw string").select(F.from_json("raw", ENTITY).alias("r")).select("r.*")
    out, counts = cl.apply_rules(df, cl.ENTITY_RULES)
    got = [r.asDict(recursive=True) for r in out.collect()]
    assert out.schema.simpleString() == df.schema.simpleString()
    first = got[0]
    assert first["entityRegistration"] == {"cageCode": "1A2B3", "registrationDate": "2023-12-31"} and first["coreData"]["physicalAddress"] == {"countryCode": "USA", "zipCode": "12345-6789", "stateOrProvinceCode": "VA"}
    assert [x and x["certificationEntryDate"] for x in first["assertions"]["goodsAndServices"]["naicsList"]] == ["2023-01-02", None, None, None]
    assert got[1]["coreData"]["physicalAddress"] == {"countryCode": "COD", "zipCode": "K1A 0B1", "stateOrProvinceCode": "Ontario"}
    assert got[2]["coreData"]["physicalAddress"] == {"countryCode": None, "zipCode": None, "stateOrProvinceCode": None} and not any(got[3].values())
    fired = {k: v for k, v in counts.get.items() if v}
    assert fired == {
        "rows": 4, "cage_code": 1, "entityRegistration.registrationDate": 1, "coreData.physicalAddress.countryCode": 2, "coreData.physicalAddress.zipCode": 3, "coreData.physicalAddress.stateOrProvinceCode": 2,
        "coreData.entityInformation.submissionDate": 1, "assertions.goodsAndServices.naicsList[].certificationEntryDate": 2,
    }


def test_rules_from_json_by_priority(spark):
    rules = [
        {"rule_name": "late", "target_column": "d", "rule_type": "TRANSFORM", "rule_definition": '{"action": "normalize_date"}', "priority": 20},
        {"rule_name": "early", "target_column": "d", "rule_type": "CLEAN", "rule_definition": '{"action": "blank_absent"}', "priority": 10},
        {"rule_name": "long", "target_column": "s", "rule_type": "VALIDATE", "rule_definition": {"action": "warn_length", "max_length": 2}},
        {"rule_name": "off", "target_column": "s", "rule_type": "CLEAN", "rule_definition": {"action": "clean_state"}, "is_active": "N"},
        {"rule_name": "absent", "target_column": "nowhere.at[].all", "rule_type": "CLEAN", "rule_definition": {"action": "clean_zip"}},
    ]
    df = spark.createDataFrame([("n/a", "VAX"), (" 20240102", "VA"), ("when?", None)], "d string, s string")
    out, counts = cl.apply_rules(df, rules, "r")
    assert [tuple(r) for r in out.collect()] == [(None, "VAX"), ("2024-01-02", "VA"), ("when?", None)]
    assert counts.get == {"rows": 3, "early": 2, "late": 1, "long": 1, "absent": 0}
    with pytest.raises(ValueError, match="unknown action"):
        cl.apply_rules(df, [{"rule_name": "x", "target_column": "d", "rule_type": "CLEAN", "rule_definition": {"action": "burn"}}])


def merged(spans, text, gap, border):
    out = []
    for s, e in sorted(spans):
        if out and s - out[-1][-1][1] <= gap:
            out[-1].append((s, e))
        else:
            out.append([(s, e)])
    told = []
    for group in out:
        first, last = max(0, min(s for s, _ in group) - border), min(len(text), max(e for _, e in group) + border)
        last = max(first, last)
        lights = [(max(0, s - first), min(e - first, last - first)) for s, e in group]
        told.append((first, last, text[first:last], tuple(x for x in lights if x[0] < x[1]), len(group)))
    return told


def test_passages_equal_brute_force(spark):
    rng = random.Random(3)
    texts = {i: "".join(rng.choice("abc é\n𝒳") for _ in range(rng.choice([0, 30, 900]))) for i in range(12)} | {99: None}
    spans = [(i, rng.choice("xy"), s, s + rng.randint(0, 30)) for i in texts for s in (rng.randrange(950) for _ in range(9))]
    got = ps.merge_passages(spark.createDataFrame([*spans, (1, "x", None, None), (55, "x", 1, 2)], "doc int, field string, start long, end long"), spark.createDataFrame(list(texts.items()), "doc int, text string"), "doc", ["field"], gap=40, border=15)
    got = sorted((r.doc, r.field, r["first"], r["last"], r.text, tuple((h.start, h.end) for h in r.highlights), r.n) for r in got.collect())
    want = sorted((i, f, *p) for i, t in texts.items() if t for f in "xy" for p in merged([s[2:] for s in spans if s[:2] == (i, f)], t, 40, 15))
    assert got == want


def test_citations_are_found_in_the_text_as_it_stands(spark):
    text = "Offers are due\n on May  5 (noon). A Secret\tclearance is required for all of the staff on site."
    long = "clearance is required for all of the staff on the moon and beyond"
    cases = {"Offers are due": (0, "exact"), "offers ARE": (0, "case"), "due on May 5 (noon).": (11, "space"), "a secret clearance": (34, "space_case"), long: (43, "part"), text[43:85] + "!": (43, "part"), text[43:85].upper() + "!": (43, "part_case"), "nope": (None, None), "": (None, None), None: (None, None)}
    rows = spark.createDataFrame([(text, q) for q in cases] + [(None, "x"), ("", "x")], "text string, quote string")
    got = {r.quote: (r.offset, r.how) for r in ps.cite(rows, "text", "quote").collect() if r.text}
    assert got == cases
    assert re.compile(r"due\s+on").search(text).start() == got["due on May 5 (noon)."][0]
