import random

import pytest

from tenderlake.sources import determinations as det
from tenderlake.sources import files

GOLDEN = '''"REGISTER OF WAGE DETERMINATIONS UNDER THE SERVICE CONTRACT ACT
By direction of the Secretary of Labor
Wage Determination No.: 2015-4001
Revision No.: 32
Date Of Last Revision: 12/22/2024
Note: the Executive Order 14026 minimum wage is $17.20 per hour
States: Maine, New Hampshire
Area: Maine Counties of Penobscot
New Hampshire County of Coos

          **Fringe Benefits Required Follow the Occupational Listing**
OCCUPATION CODE - TITLE                                  FOOTNOTE               RATE
01000 - Administrative Support And Clerical Occupations
  01011 - Accounting Clerk I                                                   16.71
  01012 - Accounting Clerk II -                                            $1,018.76
  31010 - Airplane Pilot                  (see note)
  31020 - Bus Aide    ***  Varies by county
  01011 - Accounting Clerk I                                                   99.99
______________________________________________________________________________
ALL OCCUPATIONS LISTED ABOVE RECEIVE THE FOLLOWING BENEFITS:
HEALTH & WELFARE: $5.36 per hour
VACATION: 2 weeks, or $1.10 per hour
HOLIDAYS: eleven paid
  99000 - Not listed   see note
"'''


def test_a_determination_is_parsed_with_its_rates(spark, tmp_path):
    (tmp_path / "a.txt").write_text(GOLDEN.replace("\n", "\r\n"))
    (tmp_path / "b.txt").write_text("too short")
    out = det.scan_determinations(spark, str(tmp_path))
    got = out.collect()
    assert len(got) == 1
    x = got[0]
    assert (x.wd_number, x.revision, str(x.effective_date), x.state, x.state_code) == ("2015-4001", 32, "2024-12-22", "Maine, New Hampshire", "ME")
    assert x.area_name == "Maine Counties of Penobscot New Hampshire County of Coos" and x.title == f"{x.state} - {x.area_name}"
    assert [float(v) if v is not None else None for v in (x.health_welfare, x.vacation, x.holiday, x.eo_minimum_wage)] == [5.36, 1.10, None, 17.20]
    rates = {(r.occupation_code, r.occupation_title, r.hourly_rate and float(r.hourly_rate)) for r in det.rates_of(out).collect()}
    assert rates == {("01011", "Accounting Clerk I", 16.71), ("01012", "Accounting Clerk II", 1018.76), ("31020", "Bus Aide", None)}


@pytest.mark.parametrize("size", [64, 200, 10**6])
def test_neighbouring_rows_are_merged_across_splits(spark, tmp_path, size):
    rng = random.Random(size)
    for name in ("a.dat", "b.dat"):
        keys = [k for k in (rng.choice("ABC") for _ in range(40)) for _ in range(rng.choice([1, 1, 2, 30]))]
        rows = [f"{k}|c{rng.randrange(9)}|{i}" for i, k in enumerate(keys)]
        (tmp_path / name).write_text("\n".join(["BOF x 5", *rows, "bad", "EOF x 5"]) + "\n")
    want = []
    for name in ("a.dat", "b.dat"):
        last = None
        for line in (tmp_path / name).read_text().split("\n"):
            p = line.split("|")
            if len(p) == 3:
                if p[0] == last:
                    want[-1][3].append(p[1])
                else:
                    want.append((*p, []))
                last = p[0]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = files.scan_extract_runs(spark, str(tmp_path), ["key", "cage", "n"], "key", ["cage"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.key, r.cage, r.n, r.more_cage) for r in got) == sorted(want)
