import random
import re

from tenderlake.operators import changes as ch
from tenderlake.operators import identifiers as ids


def found(spark, texts):
    rows = ids.extract_identifiers(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()
    return {(r.id, r.kind, r.value) for r in rows}, rows


def test_contract_numbers():
    good = ["W91QF24C0012", "70LGLY21CGLB00003", "FA862118F6251"]
    assert all(map(ids.is_contract_number, good))
    assert not any(map(ids.is_contract_number, ["W91QF24C001", "W91QF2XC0012", "123456789012", "ABCDEFGHJKLM", "W91QF24Z0012", ""]))
    assert [ids.contract_kind(x) for x in ("W91QF24R0012", "W91QF24C0012", "FA862118R6251", "W91QF24RC012", "W91QF24X0012")] == ["SOLICITATION", "PIID", "SOLICITATION", "PIID", "PIID"]


def test_words_have_to_stand_near(spark):
    far = "x " * 101
    texts = ["UEI ABCDEFGH1234", "UEI " + far + "ABCDEFGH1234", "ABCDEFGH1234 " + "x " * 95 + "UEI", "CAGE: 1ABC5", "1ABC5", "a DUNS, 123456789", "W91QF-24-C-0012345", "order W91QF-24-C-0012345", "task order W91QF-24-C-0012345 W91QF24C0012345", None, "", "no UEI: ABCDEFGHJKLM 123456789012"]
    got, rows = found(spark, texts)
    assert got == {(0, "UEI", "ABCDEFGH1234"), (2, "UEI", "ABCDEFGH1234"), (3, "CAGE", "1ABC5"), (5, "DUNS", "123456789"), (7, "PIID", "W91QF24C0012345"), (8, "PIID", "W91QF24C0012345")} - {(7, "PIID", "W91QF24C0012345")}
    one = next(r for r in rows if r.id == 8)
    assert (one.raw, one.start, texts[8][one.start : one.end]) == ("W91QF24C0012345", 30, one.raw)


def test_a_catalogue_of_parts_has_no_contract_numbers(spark):
    number = lambda i: f"W91QF24C{i:07d}"
    texts = [" ".join(map(number, range(n))) + " 52.212-4" for n in (100, 101)] + [" ".join([number(1)] * 101)]
    got, _ = found(spark, texts)
    assert sum(1 for x in got if x[0] == 0) == 101 and {x for x in got if x[0] > 0} == {(1, "FAR_CLAUSE", "52.212-4")}


def test_near_words_equal_a_slice(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["CAGE ", "1ABC5 ", "x" * rng.randint(1, 150) + " "]) for _ in range(12)) for _ in range(200)]
    got, _ = found(spark, texts)
    want = {(i, "CAGE", m[1]) for i, t in enumerate(texts) for m in re.finditer(r"\b(\d[A-HJ-NP-Z0-9]{3}\d)\b", t) if any(w.start() >= m.start() - 200 and w.end() <= m.end() + 200 for w in re.finditer(r"\bCAGE\b", t))}
    assert {x for x in got if x[1] == "CAGE"} == want and len(want) > 50


def test_only_changed_rows_are_made_anew(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    fresh = spark.createDataFrame([(2, "B"), (4, "D")], "k int, v string")
    changed = spark.createDataFrame([(2,), (3,), (4,), (2,)], "k int")
    assert sorted(map(tuple, ch.refresh_rows(table, changed, fresh, ["k"]).collect())) == [(1, "a"), (2, "B"), (4, "D")]
