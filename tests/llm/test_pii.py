import random

import pytest

FILLER = "the notice was sent to the office and read there by many people before noon".split()
WIDE = [
    ("phone", "(838) 555-9577"), ("phone", "838-555-9577"), ("phone", "838.555.9577"), ("phone", "1 (838) 555-9577"), ("phone", "001 838 555 9577"), ("phone", "001-838-555-9577"),
    ("email", "jane.doe (at) mail (dot) example (dot) com"), ("email", "jane.doe[at]mail[dot]example[dot]com"), ("email", "jane (at) example.com"), ("email", "jane @ example . com"),
    ("ip", "10[.]20[.]30[.]40"), ("ip", "10(.)20(.)30(.)40"), ("ip", "10.20.30[.]40"), ("ip", "10 . 20 . 30 . 40"),
    ("card", "4111.1111.1111.1111"), ("card", "4111/1111/1111/1111"),
]
OTHER = ["300[.]20[.]30[.]40", "10[.]20[.]30[.]999", "4111.1111.1111.1112", "4111/1111/1111/1113", "5530133646708588", "order id=838-555-9577", "jane (at) 12 (dot) 34"]


@pytest.fixture(scope="module")
def found(spark):
    from tenderlake.llm.pii import find_personal_data, luhn

    rng = random.Random(4)
    words = lambda: " ".join(rng.choice(FILLER) for _ in range(6))
    rows = []
    for i in range(120):
        card = "".join(rng.choice("0123456789") for _ in range(15))
        good = next(card + d for d in "0123456789" if luhn(card + d))
        base = [f"user{i}.x@mail{i % 9}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), good, f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"][i % 4]
        rows.append((i, f"{words()} {base} {words()}"))
    planted = [v for _, v in WIDE] + OTHER
    rows += [(1000 + i, f"{words()} {v} {words()}") for i, v in enumerate(planted)]
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return {v: (rows[120 + i][1], got[1000 + i]) for i, v in enumerate(planted)}


@pytest.mark.parametrize(("kind", "form"), WIDE)
def test_wide_forms_are_added(found, kind, form):
    text, row = found[form]
    at = text.index(form)
    assert row.spans == f"{kind}:{at}:{at + len(form)}"
    assert row.redacted == text.replace(form, f"[{kind.upper()}]")
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (0, 0, 0, 0)  # counts are of base forms


@pytest.mark.parametrize("form", OTHER)
def test_contrary_evidence_adds_nothing(found, form):
    text, row = found[form]
    assert (row.spans, row.redacted) == ("", text)


def test_the_model_learns_from_all_texts(spark, monkeypatch):
    """More texts than it once drew: what it learns from counts every one, and equal examples weigh as if listed one by one."""
    import numpy as np

    from tenderlake.llm import pii

    counts = spark.range(41_000).selectExpr("id AS _doc", "concat('mail a', id % 7, '@mail.example.com now') AS _text")
    each = len(list(pii.examples("mail a1@mail.example.com now")))
    monkeypatch.setattr(pii, "fit", lambda x, y, fold, precision, n: (np.zeros((40, 15, 3)), [float(n.sum())] * 4))
    assert pii.train_model(counts, 0.97)["cuts"][0] == 41_000 * each > 0
    monkeypatch.undo()
    rng = np.random.default_rng(3)
    x, y, fold, n = rng.integers(0, 4, (300, 5)), rng.integers(0, 2, 300).astype(float), np.arange(300) % 4, rng.integers(1, 6, 300)
    (a, b), (c, d) = pii.fit(x, y, fold, 0.5, n.astype(float)), pii.fit(*(np.repeat(v, n, 0) for v in (x, y, fold)), 0.5)
    assert np.allclose(a, c) and np.allclose(b, d)
