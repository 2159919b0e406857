"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share all
words; a target stops at ``CAP`` times its source's words and the excess is shared anew by
weight until none is above.

Rounding: a document of a source with ratio r = target / words is wanted r times: floor(r)
copies, and one more with probability f = r - floor(r). Two documents of a source with
fractional probabilities meet; words (size times probability) move from one to the other,
in a random direction whose odds keep both expectations, until one is 0 or 1 and settled.
What is left of a small group is one document at most, which goes up to the next level of
a reduction tree; the root is rounded by itself. So the words taken from a source miss its
target by less than the size of one document. Random numbers are hashes of the rows and a seed,
so reruns and recomputed tasks agree.

A group has 16 rows on average, whatever the size of the source: groups are ranges of the
row's hash, so a source with a third of all rows is spread over as many tasks as its rows ask for.

Defined results: null text and texts without words have size 0, take 0 words and no copies;
a null source is a source, the last one; rows that repeat are numbered and decided one by
one; no documents give an empty result; a table without any word has targets 0. Further
columns pass through ``mix_documents`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.base import query, table
from topicloom.operators.skew import salted_join
from topicloom.operators.views import dense_index
from topicloom.session import materialize

WEIGHTS = (5, 2, 1)
CAP = 3
FAN = 16  # rows that meet in one group of the tree, on average at the leaves, at most above
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def _uniform(*columns: Column) -> Column:
    """A number from [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(s_null, s, n_docs, source_size, weight, target) of ``sizes`` (s_null, s, size), stored.

    Water filling: a few rounds, each an aggregate over the source table that gives the
    driver two numbers.
    """
    spark = sizes.sparkSession
    by_source = sizes.groupBy("s_null", "s").agg(
        F.sum("size").alias("source_size"),
        F.sum((F.col("size") > 0).cast("bigint")).alias("n_docs"),
    )
    ranked = dense_index(materialize(by_source, "sources"), ["s_null", "s"], "rank")
    wheel = F.array(*(F.lit(float(w)) for w in weights))
    sources = materialize(
        ranked.withColumn("weight", F.element_at(wheel, (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank"),
        "sources",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    most = F.col("source_size") * float(cap)
    while total:
        capped = F.col("weight") * F.lit(level) >= most
        row = sources.agg(
            F.sum(F.when(capped, most)).alias("full"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if row["n"] == before or not row["open"]:
            break
        before, level = row["n"], (total - (row["full"] or 0.0)) / row["open"]
    return sources.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))


def _pivot(acc: Column, x: Column, seed: int) -> Column:
    """One meeting: ``acc`` (done, left) with the row ``x``; all structs (h, unit, a, p)."""
    i = acc["left"]
    up_room = F.least(i["a"] * (1 - i["p"]), x["a"] * x["p"])
    down_room = F.least(i["a"] * i["p"], x["a"] * (1 - x["p"]))
    up = F.coalesce(_uniform(i["h"], x["h"], F.lit(seed)) < down_room / F.nullif(up_room + down_room, F.lit(0.0)), F.lit(False))
    i_full = up & (i["a"] * (1 - i["p"]) <= x["a"] * x["p"])
    i_empty = ~up & (i["a"] * i["p"] <= x["a"] * (1 - x["p"]))
    settles_i = i_full | i_empty

    def with_p(row: Column, p: Column) -> Column:
        return F.struct(row["h"].alias("h"), row["unit"].alias("unit"), row["a"].alias("a"), p.alias("p"))

    def clip(p: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))

    settled = F.when(settles_i, with_p(i, F.when(i_full, F.lit(1.0)).otherwise(F.lit(0.0)))).otherwise(
        with_p(x, F.when(up, F.lit(0.0)).otherwise(F.lit(1.0)))
    )
    left = F.when(
        settles_i,
        with_p(x, clip(F.when(up, x["p"] - up_room / x["a"]).otherwise(x["p"] + down_room / x["a"]))),
    ).otherwise(with_p(i, clip(F.when(up, i["p"] + up_room / i["a"]).otherwise(i["p"] - down_room / i["a"]))))
    first = i.isNull()
    return F.struct(
        F.when(first, acc["done"]).otherwise(F.concat(acc["done"], F.array(settled))).alias("done"),
        F.when(first, x).otherwise(left).alias("left"),
    )


def pivotal_round(rows: DataFrame, seed: int = 7) -> DataFrame:
    """(unit, extra): which of ``rows`` (key, n, unit, h, a, p) are rounded up.

    ``key`` names the source and ``n`` how many rows it has, ``unit`` is carried along,
    ``h`` a hash that spreads the rows, ``a`` > 0 the words, 0 < ``p`` < 1 the probability.
    """
    spark = rows.sparkSession
    kind = f"struct<h:bigint,unit:{rows.schema['unit'].dataType.simpleString()},a:double,p:double>"
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / FAN)).cast("bigint")
    place = F.floor(_uniform(F.col("h"), F.lit(seed)) * groups).cast("bigint")
    level = rows.select(
        "key", F.least(place, groups - 1).alias("g"), groups.alias("groups"),
        F.struct("h", "unit", "a", "p").alias("row"),
    )
    out = []
    while True:
        folded = level.groupBy("key", "g", "groups").agg(F.sort_array(F.collect_list("row")).alias("rows")).select(
            "key", "g", "groups",
            F.aggregate(
                "rows",
                F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("done"), F.expr(f"cast(null as {kind})").alias("left")),
                lambda acc, x: _pivot(acc, x, seed),
            ).alias("fold"),
        )
        stored = materialize(folded.select("key", "g", "groups", "fold.done", "fold.left"), "rounded")
        out.append(stored.select(F.explode("done").alias("row")).select("row.unit", F.col("row.p").cast("int").alias("extra")))
        root = F.col("groups") == 1
        last = F.when(_uniform(F.col("left.h"), F.lit(seed + 1)) < F.col("left.p"), 1).otherwise(0)
        out.append(stored.where(root).select("left.unit", last.alias("extra")))
        rest = stored.where(~root)
        if rest.isEmpty():
            break
        level = rest.select(
            "key", F.floor(F.col("g") / FAN).cast("bigint").alias("g"),
            F.ceil(F.col("groups") / FAN).cast("bigint").alias("groups"), F.col("left").alias("row"),
        )
    done = out[0]
    for part in out[1:]:
        done = done.union(part)
    return done


def mixing_plan(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, size, source_size, target, copies), one row per document."""
    source = F.col(source_col).cast("string")
    sizes = materialize(
        docs.select(
            F.col(id_col).alias("id"), source.isNull().alias("s_null"), F.coalesce(source, F.lit("")).alias("s"),
            word_count(F.col(text_col)).alias("size"),
        ),
        "sizes",
    )
    targets = source_targets(sizes, weights, cap)
    # rows that repeat get numbers, without a sort of a group
    numbered = (
        sizes.groupBy("id", "s_null", "s", "size").agg(F.count(F.lit(1)).alias("m"))
        .withColumn("ord", F.explode(F.sequence(F.lit(1), F.col("m"))))
        .drop("m")
    )
    rows = salted_join(numbered, targets, ["s_null", "s"])
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = materialize(
        rows.withColumn("ratio", ratio)
        .withColumn("whole", F.floor(F.col("ratio") + F.lit(1e-9)).cast("int"))
        .withColumn("part", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
        .drop("weight"),
        "wanted",
    )
    fields = ["id", "s_null", "s", "size", "ord", "source_size", "target", "whole"]
    open_rows = F.col("part") > 1e-9
    extra = pivotal_round(
        rows.where(open_rows).select(
            F.struct("s_null", "s").alias("key"), F.col("n_docs").alias("n"), F.struct(*fields).alias("unit"),
            F.xxhash64("id", "s_null", "s", "size", "ord").alias("h"),
            F.col("size").cast("double").alias("a"), F.col("part").alias("p"),
        ),
        seed,
    ).select("unit.*", "extra")
    return rows.where(~open_rows).select(*fields, F.lit(0).alias("extra")).unionByName(extra).select(
        "id", F.when(~F.col("s_null"), F.col("s")).alias("source"), "size", "source_size", "target",
        (F.col("whole") + F.col("extra")).alias("copies"),
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as the plan takes it, with all its columns."""
    plan = mixing_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    # of rows that repeat, the first few (any order, they are alike) get the larger numbers
    took = plan.groupBy(
        F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size")
    ).agg(*(F.count(F.when(F.col("copies") >= k, 1)).alias(f"__c{k}") for k in range(1, options.get("cap", CAP) + 1)))
    sized = docs.withColumn("__n", word_count(F.col(text_col)))
    joined = sized.join(
        took,
        F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
        & (F.col("__n") == F.col("__size")),
    ).where(F.col("__c1") > 0)
    order = Window.partitionBy(id_col, source_col, "__n").orderBy(F.xxhash64(F.col(text_col)))
    ranked = joined.withColumn("__k", F.row_number().over(order))
    copies = sum((F.col("__k") <= F.col(f"__c{k}")).cast("int") for k in range(1, options.get("cap", CAP) + 1))
    return ranked.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


@query("op3_mixing_weights")
def mixing_weights(spark, sf):
    plan = mixing_plan(table(spark, sf, "documents"))
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source"
    )
