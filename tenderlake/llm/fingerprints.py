"""SimHash fingerprints of documents, and the search for near ones, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import Scratch, text_or_empty

#: ASCII white space as a Java pattern.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: The lowest bit of either half of a long: two counters of 32 bits in one sum.
LANES = (1 << 32) + 1


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACE_RUN), "")


def term_hashes(words: str) -> Column:
    """A hash of each pair of neighbouring words; the last word stands alone. ``words`` is the name of a column, so it is made once."""
    return F.transform(F.col(words), lambda w, i: F.xxhash64(w, F.get(F.col(words), i + 1)))


def votes(term: str) -> list[Column]:
    """32 sums: sum k counts bit k of the terms in its low half and bit k + 32 in its high half."""
    return [F.sum(F.shiftrightunsigned(term, k).bitwiseAND(F.lit(LANES))).alias(f"_v{k}") for k in range(32)]


def majority(n: str) -> Column:
    """The 64 bits that more than half of the ``n`` terms have."""
    bits = []
    for k in range(32):
        low, high = F.col(f"_v{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"_v{k}", 32)
        bits += [F.shiftleft((2 * x > F.col(n)).cast("long"), k + at) for x, at in ((low, 0), (high, 32))]
    return F.coalesce(reduce(Column.bitwiseOR, bits), F.lit(0).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def simhash(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` and ``fingerprint``: one row per distinct keys, whose texts are one text together.

    A term weighs as often as it occurs. Terms are summed where the text is,
    so one row of sums per text and task is shuffled, however long the text.
    A text without words has fingerprint 0.
    """
    words = texts.select(*keys, word_list(F.col(text_col)).alias("_words"))
    terms = words.select(*keys, F.explode_outer(term_hashes("_words")).alias("_term"))
    return terms.groupBy(*keys).agg(*votes("_term"), F.count("_term").alias("_n")).select(*keys, majority("_n").alias("fingerprint"))


def range_bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``; looks at every 128th first."""
    if not bounds:
        return F.lit(0)
    everyone = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    coarse = F.array(*map(F.lit, bounds[::128])).cast("array<bigint>")
    group = F.greatest(F.size(F.filter(coarse, lambda x: x <= value)) - 1, F.lit(0))
    own = F.slice(everyone, group * 128 + 1, F.lit(128))
    return F.coalesce(group * 128 + F.size(F.filter(own, lambda x: x <= value)), F.lit(0))


def with_successor(scratch: Scratch, docs: DataFrame, rows_per_bucket: int, most_buckets: int) -> DataFrame:
    """``docs`` (doc, text) dealt by ranges of ``doc``: columns ``bucket, place, ghost, doc, text, next``.

    In a bucket places go down by ``doc`` (nulls last; equal ids by a hash of
    the text). The row after a bucket's last is a copy of the following
    bucket's first, marked ``ghost``, and after the last of all comes the
    first. Texts are shuffled once; only bounds of buckets reach the driver.
    """
    n = docs.count()
    buckets = max(min(64, n), min(most_buckets, n // rows_per_bucket), 1)
    cuts = [k / buckets for k in range(1, buckets)]
    found = docs.agg(F.percentile_approx("doc", cuts, 20 * buckets).alias("b")).first()["b"] if cuts else None
    bucket = range_bucket(F.col("doc"), sorted(set(found or [])))
    placed = docs.withColumn("bucket", bucket.cast("int"))
    tops = sorted((r["bucket"], r["top"]) for r in placed.groupBy("bucket").agg(F.max("doc").alias("top")).collect())
    after = [(b, top, tops[(i + 1) % len(tops)][0]) for i, (b, top) in enumerate(tops)]
    firsts = docs.sparkSession.createDataFrame(after, "_bucket int, _top long, _also int")
    marked = placed.join(F.broadcast(firsts), (F.col("bucket") == F.col("_bucket")) & F.col("doc").eqNullSafe(F.col("_top")), "left")
    homes = F.when(F.col("_bucket").isNull(), F.array("bucket")).otherwise(F.array("bucket", "_also"))
    spread = marked.select("doc", "text", F.posexplode(homes).alias("ghost", "bucket"))
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc"), F.xxhash64("text").desc())
    return spread.select("bucket", F.row_number().over(order).alias("place"), "ghost", "doc", "text", F.coalesce(F.lead("text").over(order), F.lit("")).alias("next"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 20_000, most_buckets: int = 20_000) -> DataFrame:
    """One row per input row: fingerprints of its text and of an edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by as
    many first ones (or all) of the next document in descending id. Columns:
    the id, ``n_chars, edited_sha256, fingerprint, edited_fingerprint`` (hex),
    ``near_edited, near_next`` (0 to 1) and ``simhash`` (long).

    A null text is empty, null ids come last, repeated rows are each a
    document, a single document follows itself; an empty table gives an empty
    table; other columns are not read. A text's terms are made at once, so a
    task needs about 100 bytes for each word of its longest text.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    own = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    rows = with_successor(scratch, own, rows_per_bucket, most_buckets)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    keys = ["bucket", "place", "ghost", "doc", "n_chars", "edited_sha256", "which"]
    both = (
        rows.withColumn("edited", edited).withColumn("n_chars", n.cast("long")).withColumn("edited_sha256", F.sha2("edited", 256))
        .select(*keys[:-1], F.posexplode(F.array("text", "edited")).alias("which", "_text"))
    )
    hashed = simhash(both, keys, "_text").repartition("bucket")
    of = lambda which: F.max(F.when(F.col("which") == which, F.col("fingerprint")))
    rows = hashed.groupBy("bucket", "place", *keys[2:-1]).agg(of(0).alias("own"), of(1).alias("changed"))
    following = F.lead("own").over(Window.partitionBy("bucket").orderBy("place"))
    rows = rows.withColumn("following", following).where("ghost = 0")
    out = rows.select(
        F.col("doc").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"), F.col("own").alias("simhash"),
    )
    return scratch.cut(out)


def block_masks(radius: int, blocks: int) -> list[int]:
    """A mask for each choice of ``blocks - radius`` of the blocks that 64 bits are cut into; signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(single, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_fingerprints(fingerprints: DataFrame, queries: DataFrame, column: str = "simhash", radius: int = 3, blocks: int = 6) -> DataFrame:
    """``(query, found, distance)``: all pairs of distinct values within ``radius`` bits, each once, equal ones included.

    Each table keeps ``blocks - radius`` of the blocks: fingerprints that
    differ in at most ``radius`` bits agree in one table at least, and a pair
    is made by the first table in which it agrees. Values are made distinct
    first, so copies, however many, are one posting a table.
    """
    masks = block_masks(radius, blocks)

    def posted(df: DataFrame, name: str) -> DataFrame:
        values = df.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()
        keys = F.array(*[F.col(name).bitwiseAND(F.lit(m)) for m in masks])
        return values.select(name, F.posexplode(keys).alias("_table", "_key"))

    q, all_ = posted(queries, "query"), posted(fingerprints, "found")
    differs = F.col("query").bitwiseXOR(F.col("found"))
    first = F.coalesce(*[F.when(differs.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    same = (q["_table"] == all_["_table"]) & (q["_key"] == all_["_key"]) & (F.bit_count(differs) <= radius) & (first == q["_table"])
    return q.join(all_, same).select("query", "found", F.bit_count(differs).alias("distance"))


def count_near(fingerprints: DataFrame, is_query: Column, column: str = "simhash", radius: int = 3, blocks: int = 6) -> DataFrame:
    """``fingerprints`` with ``n_near``: for rows that are queries, how many other rows lie within ``radius`` bits; else null."""
    sizes = fingerprints.groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
    pairs = near_fingerprints(fingerprints, fingerprints.where(is_query), column, radius, blocks)
    totals = pairs.join(sizes, pairs["found"] == sizes[column]).groupBy("query").agg((F.sum("_rows") - 1).alias("_near"))
    joined = fingerprints.join(totals, F.col(column) == F.col("query"), "left")
    return joined.withColumn("n_near", F.when(is_query, F.col("_near"))).drop("query", "_near")
