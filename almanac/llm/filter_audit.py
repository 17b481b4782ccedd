"""What each filter removes, in every order of application, and what it shares with the others.

A document is reduced to a mask, a bit for each filter that it fails. Masks are counted per part of
the corpus; such cells are all that the orders need, and there are at most ``2 ** filters`` of them
in a part. A recursive query then extends prefixes of filters by each letter not yet used, joins
the cells, and carries the bits applied so far: each level emits the metrics of its step, from
which cells fail the new filter and whether they had failed an applied one.

Failing conditions of the filters A to E (words are maximal runs of anything but blanks and the
controls 9 to 13; a missing text is empty):

- A: under 100 words;
- B: distinct words are under 80 % of the words;
- C: capitals A to Z are over 10 % of the code points;
- D: holds one of ``#$%&*|``;
- E: the text equals that of a document with a smaller id, in any part, removed or not.

Texts stay where they are: of a document only a digest, a mask and the part move. Copies are counted
by digest, part and label before they meet, so a text that a third of all rows share is a few rows.

Defined results: a row without an id has no smaller id before it and no label, and is before no
other; repeated rows of one id are no copies of each other but each counts; labels of a repeated id
count if any row has them; ids that only ``labels`` has change nothing. Empty tables give no part
and so no row. A text of any length is split once. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import stored

LETTERS = "ABCDE"
#: All orders of so many filters at most: their number is a factorial.
MOST_FILTERS = 7
_GAP = "[ \\t-\\r]+"
_LIMIT = "spark.sql.cteRecursionRowLimit"


def text_conditions(text: Column, words: Column) -> dict[str, Column]:
    """The failing conditions that a text alone decides, by letter."""
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def _masked(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, part, mask, n)``: equal rows counted."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.array_remove(F.split(text, _GAP), "").alias("words"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
    )
    failed = text_conditions(F.col("text"), F.col("words"))
    mask = sum((F.when(c, _bit(k)).otherwise(0) for k, c in failed.items()), F.lit(0))
    return (
        own.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "part", mask.alias("mask"))
        .groupBy("doc_id", "digest", "part", "mask")
        .agg(F.count("*").alias("n"))
    )


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """With ``good`` and ``toxic``, 0 or 1. Rows without an id match nothing; the second key deals
    them out all the same."""
    marks = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(*(
            F.max((F.col(c).eqNullSafe(1)).cast("long")).alias(name)
            for c, name in (("quality", "good"), ("toxic", "toxic"))
        ))
        .withColumn("deal", F.lit(0).cast("long"))
    )
    deal = F.when(F.col("doc_id").isNull(), F.crc32("digest")).otherwise(0)
    joined = rows.withColumn("deal", deal).join(marks, ["doc_id", "deal"], "left")
    return joined.fillna(0, ["good", "toxic"]).drop("deal")


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each part that fail exactly the filters of the
    mask, and those of them that are labelled so."""
    same = (
        _labelled(_masked(docs), labels)
        .groupBy("digest", "part", "mask", "good", "toxic")
        .agg(
            F.sum("n").alias("n"),
            F.min("doc_id").alias("first"),
            F.min_by("n", "doc_id").alias("n_first"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_unnamed"),
        )
    )
    # The first of a text, over the few parts and labels that it occurs with.
    lowest = same.groupBy("digest").agg(
        F.min("first").alias("lowest"),
        F.collect_list(
            F.struct("part", "mask", "good", "toxic", "n", "first", "n_first", "n_unnamed")
        ).alias("own"),
    )
    each = lowest.select("lowest", F.explode("own").alias("x")).select("lowest", "x.*")
    passing = F.col("n_unnamed") + F.when(
        F.col("first") == F.col("lowest"), F.col("n_first")
    ).otherwise(0)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), passing.alias("n")),
        F.struct((F.col("mask") + _bit("E")).alias("mask"), (F.col("n") - passing).alias("n")),
    )
    cells = each.select("part", "good", "toxic", F.explode(both).alias("c"))
    return (
        cells.where("c.n > 0")
        .groupBy("part", F.col("c.mask").alias("mask"))
        .agg(
            F.sum("c.n").alias("n"),
            F.sum(F.col("c.n") * F.col("good")).alias("good"),
            F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"),
        )
    )


def _total(what: str, when: str) -> str:
    return f"aggregate(c.cells, 0L, (s, x) -> s + IF({when}, x.{what}, 0L))"


_REMOVED = "x.mask & f.bit <> 0 AND x.mask & p.applied = 0"
_ORDERS = f"""
WITH RECURSIVE prefixes(part, taken, applied, step, steps) AS (
    SELECT part, '', 0, 0,
           CAST(array() AS ARRAY<STRUCT<kept: BIGINT, removed: BIGINT, redundant: BIGINT,
                unique_fails: BIGINT, good_lost: BIGINT, toxic_lost: BIGINT>>)
    FROM {{cells}}
    UNION ALL
    SELECT p.part, p.taken || f.letter, p.applied | f.bit, p.step + 1,
           p.steps || array(named_struct(
               'kept', {_total("n", "x.mask & (p.applied | f.bit) = 0")},
               'removed', {_total("n", _REMOVED)},
               'redundant', {_total("n", "x.mask & f.bit <> 0 AND x.mask & p.applied <> 0")},
               'unique_fails', {_total("n", "x.mask = f.bit")},
               'good_lost', {_total("good", _REMOVED)},
               'toxic_lost', {_total("toxic", _REMOVED)}))
    FROM prefixes p
    JOIN {{cells}} c ON c.part = p.part
    LATERAL VIEW explode(array({{filters}})) t AS f
    WHERE p.applied & f.bit = 0
), orders AS (
    SELECT part, taken AS filter_order, place + 1 AS step, m.*
    FROM prefixes LATERAL VIEW posexplode(steps) AS place, m
    WHERE prefixes.step = {{most}}
)
SELECT *, sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS shapley
FROM orders
"""


def all_orders(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley)`` for each part, order of the letters and step, from the cells of ``mask_cells`` or
    others like them, where the bit of a letter is given by its place. ``shapley`` is what the filter
    of the step removes, summed over all orders."""
    fine = 0 < len(letters) <= MOST_FILTERS and len(set(letters)) == len(letters)
    if not (fine and letters.isalnum()):
        raise ValueError(f"1 to {MOST_FILTERS} different letters are needed, not {letters!r}")
    spark: SparkSession = cells.sparkSession
    by_part = stored(
        cells.groupBy("part").agg(
            F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")
        ).coalesce(1),
        "mask-cells",
    )
    filters = ", ".join(f"struct('{k}' AS letter, {1 << i} AS bit)" for i, k in enumerate(letters))
    # Spark ends a recursion of too many rows; this one has so many prefixes for each part.
    prefixes, n = 1, 1
    for k in range(len(letters), 0, -1):
        n *= k
        prefixes += n
    before = spark.conf.get(_LIMIT)
    needed = prefixes * by_part.count() + 1
    if 0 <= int(before) < needed:
        spark.conf.set(_LIMIT, str(needed))
    try:
        found = spark.sql(_ORDERS.replace("{filters}", filters), cells=by_part, most=len(letters))
        return stored(found, "filter-orders")
    finally:
        spark.conf.set(_LIMIT, before)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the filters A to E over documents ``(doc_id, text, lang)``, with the losses
    among those that ``labels`` ``(doc_id, quality, toxic)`` marks as good or toxic."""
    return all_orders(mask_cells(docs, labels))
