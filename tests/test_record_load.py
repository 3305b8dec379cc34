import random
from collections import Counter

import pytest

from tenderlake.operators import record_load as rl


def by_record(table, incoming, kids, fresh):
    """The load record by record, as a loop over a dictionary."""
    rows, children, history, counts = {k: (a, b) for k, a, b in table}, {}, set(), Counter()
    for k, v in kids:
        children.setdefault(k, []).append(v)
    for k, a, b, at in sorted(incoming, key=lambda r: r[3]):
        counts["read"] += 1
        if not (k or "").strip():
            counts["errored"] += 1
            continue
        old = rows.get(k)
        if old == (a, b):
            counts["unchanged"] += 1
            continue
        counts["inserted" if old is None else "updated"] += 1
        if old:
            history |= {(k, at, f, o, n) for f, o, n in (("a", old[0], a), ("b", old[1] and str(old[1]), b and str(b))) if o != n}
        rows[k] = (a, b)
        children[k] = [v for ck, v, cat in fresh if (ck, cat) == (k, at)]
    return rows, {(k, v) for k, vs in children.items() for v in vs}, history, counts


@pytest.mark.parametrize("seed", range(3))
def test_a_load_of_sets_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    some = lambda: (rng.choice(["x", "y", None]), rng.choice([1, 2, None]))
    table = [(f"k{i}", *some()) for i in range(0, 12, 2)]
    incoming = [(rng.choice([f"k{i}" for i in range(12)] + [None, " "]), *some(), at) for at in range(60)]
    kids = [(f"k{i}", f"old{j}") for i in range(0, 12, 2) for j in range(2)]
    fresh = [(k, f"new{at}-{j}", at) for k, _, _, at in incoming if k for j in range(rng.randint(0, 2))]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = rl.load_records(frame(table, "k string, a string, b int"), frame(incoming, "k string, a string, b int, at int"), ["k"], ["a", "b"], "at", "L", {"kid": rl.Children(frame(kids, "k string, v string"), frame(fresh, "k string, v string, at int"))})
    rows, children, history, counts = by_record(table, incoming, kids, fresh)
    assert {r.k: (r.a, r.b) for r in got.table.collect()} == rows and got.table.count() == len(rows)
    assert {(r.k, r.v) for r in got.children["kid"].collect()} == {c for c in children if c[0] in rows}
    assert {(r.k, r.at, r.field, r.old_value, r.new_value) for r in got.history.collect()} == history
    assert {k.removeprefix("records_"): v for k, v in got.counts.first().asDict().items()} == {k: counts[k] for k in ("read", "inserted", "updated", "unchanged", "errored")}
    assert got.errors.count() == counts["errored"]
    again = rl.load_records(got.table, frame(incoming[-1:], "k string, a string, b int, at int"), ["k"], ["a", "b"], "at", "M")
    assert again.counts.first().records_read == 1


def test_a_full_refresh_is_whole_or_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert rl.full_refresh(spark.range(5), path) == 5 and rl.full_refresh(spark.range(7), path) == 7
    with pytest.raises(ValueError, match="at least"):
        rl.full_refresh(spark.range(0), path)
    assert spark.read.parquet(path).count() == 7
    (tmp_path / "t").rename(tmp_path / "t.old")  # killed between the renames
    rl.recover_refresh(spark, path)
    assert spark.read.parquet(path).count() == 7
