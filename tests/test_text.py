from itertools import product

from tenderlake.operators import names as nm
from tenderlake.operators import text as tx


def subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_token_sort_ratio_equals_the_table():
    for a, b in product(["Senior Engineer", "engineer senior", "aab ba", "é x", "x"], repeat=2):
        p, q = (" ".join(sorted(x.split())) for x in (a, b))
        assert nm.token_sort_ratio(a, b) == 200.0 * subsequence(p, q) / (len(p) + len(q))
    assert nm.token_sort_ratio("", "a") == 0.0


def test_match_names(spark):
    raw = spark.createDataFrame([("data analyst",), ("Sr. Engineer",), ("Enginer Senior",), ("Cook",), (None,), ("Cook",)], "name string")
    got = {x.name: (x.canonical, x.method, x.confidence) for x in nm.match_names(raw, "name", ["Data Analyst", "Senior Engineer"], [(r"(?i)\bSr\.?(?=\s)", "Senior")]).collect()}
    assert got == {"data analyst": ("Data Analyst", "EXACT", 100.0), "Sr. Engineer": ("Senior Engineer", "PATTERN", 95.0), "Enginer Senior": ("Senior Engineer", "FUZZY", 96.55), "Cook": (None, "UNMAPPED", 0.0)}


def test_patterns_are_denied_raised_and_consolidated(spark):
    rules = [tx.Rule("clearance", "secret", r"\bsecret\b", "Secret", "medium", ("security",)), tx.Rule("clearance", "fcl", r"\bFCL\b", None, "medium")]
    texts = ["FCL and Secret", "This does not require Secret", "Is Secret needed? No", "# Security\nFCL Secret secret", "a **Secret**", "", None, "Secret is not required"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = tx.scan_patterns(docs, rules)
    assert sorted((x.doc_id, x.matched, x.start, x.denied, x.confidence) for x in found.collect()) == [
        (0, "FCL", 0, False, "medium"), (0, "Secret", 8, False, "medium"), (1, "Secret", 22, True, "medium"), (2, "Secret", 3, True, "medium"), (3, "FCL", 11, False, "medium"),
        (3, "Secret", 15, False, "high"), (3, "secret", 22, False, "high"), (4, "Secret", 4, False, "high"), (7, "Secret", 0, True, "medium"),
    ]
    best = {x.doc_id: (x.value, x.confidence, x.n, x.n_different) for x in tx.consolidate(found).collect()}
    assert best == {0: ("Secret", "medium", 2, 2), 3: ("Secret", "high", 3, 3), 4: ("Secret", "high", 1, 1)}


def test_cross_reference_takes_the_first_target(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "ref string")
    first = spark.createDataFrame([("a", 1), (None, 9)], "key string, target_id int")
    second = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "key string, target_id int")
    got = sorted(tuple(x) for x in tx.cross_reference(ids.na.drop(), "ref", [("x", first), ("y", second)]).collect())
    assert got == [("a", "x", "1"), ("b", "y", "3"), ("c", None, None)]
    assert tx.reverse_search(ids, "ref", "A-").count() == 1


def test_what_denies_and_what_does_not():
    cues = tx.Denial().cues()
    denied = [
        "Bidders do not need a badge", "no requirement for a badge", "there is no badge", "work without a badge", "exempt from the badge", "N/A for badge", "e.g. badge", "badge is not applicable", "badge are waived", "badge: None", "Is a badge held? | No", "it will never require a badge",
    ]
    plain = ["a badge", "e.g., badge", "not a word of it, badge", "badge: Nothing else", "Is a badge held? Not known", "no " + "x" * 90 + " badge", "badge " + "y" * 70 + " not required", "notable badge", "badge? Yes. Other? No"]
    for want, texts in ((True, denied), (False, plain)):
        for text in texts:
            at = text.index("badge")
            assert tx.Marks(text, cues).denies(at, at + 5) == want, text


def test_denial_is_a_parameter(spark):
    docs = spark.createDataFrame([(1, "kein Ausweis"), (2, "ein Ausweis")], "doc_id int, text string")
    rules = [tx.Rule("badge", "badge", "Ausweis")]
    german = tx.Denial(ahead_only=("kein", "ohne"))
    assert {x.doc_id: x.denied for x in tx.scan_patterns(docs, rules, denial=german).collect()} == {1: True, 2: False}
    assert not any(x.denied for x in tx.scan_patterns(docs, rules, denial=None).collect())


def test_scope_of_a_denial():
    cues = tx.Denial().cues()
    denied = ["they don't hold any badge", "work such as badge", "the badge has never been asked for", "neither pass nor badge", "badge | none |"]
    plain = ["no pass but a badge", "it is not cold. The badge", "(no pass) badge", "badge, which is not new", "no\nbadge", "badge | none of these", "the badge will remain"]
    for want, texts in ((True, denied), (False, plain)):
        for text in texts:
            at = text.index("badge")
            assert tx.Marks(text, cues).denies(at, at + 5) == want, text
