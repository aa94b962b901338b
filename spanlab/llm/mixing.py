"""Mixing sources to target weights by pivotal dependent rounding (operator 4).  DataFrame functions only.

A source of S words with target t takes every document t/S times on average.
The whole part is certain; the fractional parts of a source are rounded
together: documents are paired, words' worth of probability moves from one to
the other at random until one is certain, and the other goes on.  Each bucket
of about ``FAN`` documents folds to one undecided document; those fold again,
``FAN`` at a time, so a source of any size is a tree of small tasks.  The
words taken differ from the target by less than one document's size.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

FAN = 64
WORD = r"[^\x20\x09-\x0D]+"
CAP = 3


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once inside a higher-order function."""
    return F.element_at(F.transform(F.array(value), use), 1)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = CAP) -> DataFrame:
    """(source, size) rows -> source, n_docs, source_size, target.

    Sources by code point, null last, weigh ``weights``, repeating, and share
    all words; a target stops at ``cap`` times its source's words and the rest
    is shared again by weight (a water level, found by sorting).
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.select("*", weight.alias("w"), (F.col("source_size") * float(cap)).alias("most"))
    w = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(w.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum("source_size").over(W.partitionBy()) - before) / rest
    # the water level is that of the first source, by room per weight, that doesn't fill up
    per = per.select("*", F.when(F.col("most") / F.col("w") > level, F.struct((F.col("most") / F.col("w")).alias("room"), level.alias("level"))).alias("open"))
    line = F.min("open").over(W.partitionBy())["level"]
    return per.select("source", "n_docs", "source_size", F.least("most", F.coalesce(line * F.col("w"), F.col("most"))).alias("target"))


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size (words; null text: 0) and a content hash that orders repeated ids."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source",
                       F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
                       F.xxhash64(text).alias("h"))


def _unit(a: Column, b: Column, seed: int) -> Column:
    """A number in [0, 1) that follows from the pair."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), a["doc_id"], a["h"], a["r"], b["doc_id"], b["h"], b["r"]), 11) / F.lit(float(1 << 53))


def _step(state: Column, item: Column, seed: int) -> Column:
    """Move words between the undecided document and the next one until one of them is certain."""
    a, b = state["open"], item

    def settled(x: Column, p: Column) -> Column:
        return x.withField("p", p)

    def moved(m: Column) -> Column:
        up = _unit(a, b, seed) * (m["up"] + m["down"]) < m["down"]
        # the smaller room decides who becomes certain; that end is set exactly
        pa = F.when(up, F.when(m["up"] == a["size"] * (1 - a["p"]), F.lit(1.0)).otherwise(a["p"] + m["up"] / a["size"])) \
              .otherwise(F.when(m["down"] == a["size"] * a["p"], F.lit(0.0)).otherwise(a["p"] - m["down"] / a["size"]))
        pb = F.when(up, F.when(m["up"] == b["size"] * b["p"], F.lit(0.0)).otherwise(b["p"] - m["up"] / b["size"])) \
              .otherwise(F.when(m["down"] == b["size"] * (1 - b["p"]), F.lit(1.0)).otherwise(b["p"] + m["down"] / b["size"]))
        return let(F.struct(pa.alias("a"), pb.alias("b")), lambda q: F.when(
            (q["a"] == 0) | (q["a"] == 1),
            F.struct(settled(b, q["b"]).alias("open"), F.concat(state["done"], F.array(settled(a, q["a"]))).alias("done")),
        ).otherwise(F.struct(settled(a, q["a"]).alias("open"), F.concat(state["done"], F.array(settled(b, q["b"]))).alias("done"))))

    room = F.struct(F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"]).alias("up"),
                    F.least(a["size"] * a["p"], b["size"] * (1 - b["p"])).alias("down"))
    return let(room, moved)


def plan(rows: DataFrame, seed: int = 17) -> DataFrame:
    """rows of sizes() -> the same rows plus r, source_size, target, copies (bigint).

    A source without words has target 0 and takes nothing.  Rows that are equal
    in all four columns are numbered by r and decided one by one, in cells of
    their own, so they may get different copies.  A null doc_id is an id like
    any other.  An empty table gives none.
    """
    spark = rows.sparkSession
    per = targets(rows)
    rows = rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("m")).withColumn("r", F.explode(F.expr("sequence(1L, m)"))).drop("m")
    joined = rows.alias("d").join(per.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.*", "n_docs", "source_size", "target", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    joined = joined.withColumns({"base": F.floor("rate"), "p": F.col("rate") - F.floor("rate")})
    cell = F.floor(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h", "r"), F.greatest(F.ceil(F.col("n_docs") / FAN), F.lit(1))))
    head = ["source", "source_size", "target", "base"]
    made = shared.put(joined.withColumn("cell", cell), "mix")
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    largest = made.where(fractional).agg(F.max("cell")).first()[0]
    item = F.struct("doc_id", "h", "r", "size", "p")
    done = [made.where(~fractional).select("doc_id", "h", "r", "size", *head, F.col("p").alias("q"))]
    open_rows = made.where(fractional).select(*head, "cell", item.alias("item"))
    while largest is not None:
        groups = open_rows.groupBy(*head, "cell").agg(F.array_sort(F.collect_list("item")).alias("items"))
        zero = F.struct(F.element_at("items", 1).alias("open"), F.slice("items", 1, 0).alias("done"))
        folded = groups.select(*head, "cell", F.aggregate(F.slice("items", 2, F.size("items")), zero, lambda state, item: _step(state, item, seed)).alias("f"))
        folded = shared.put(folded, "mix")
        done.append(folded.select(*head, F.explode("f.done").alias("x")).select("x.doc_id", "x.h", "x.r", "x.size", *head, F.col("x.p").alias("q")))
        open_rows = folded.select(*head, F.floor(F.col("cell") / FAN).alias("cell"), F.col("f.open").alias("item"))
        if not largest:
            last = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "item.doc_id", "item.h", "item.r"), 11) / F.lit(float(1 << 53))
            done.append(open_rows.select("item.doc_id", "item.h", "item.r", "item.size", *head, (last < F.col("item.p")).cast("double").alias("q")))
            break
        largest //= FAN
    out = functools.reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "source", "size", "h", "r", "source_size", "target", (F.col("base") + F.round("q")).cast("bigint").alias("copies"))


def mix(docs: DataFrame, seed: int = 17, text: str = "text") -> DataFrame:
    """Rows of docs repeated as the mix takes them (0 to 3 times), columns unchanged, whatever their names.

    Rows meet their decision by id, source and content; only rows equal in all
    of these are numbered.  Null ids and sources are values like any other.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), F.col("source").alias("_source"), F.xxhash64(text).alias("_h"))
    decided = shared.put(plan(shared.put(sizes(docs, text), "sizes"), seed), "decided")
    number = F.row_number().over(W.partitionBy("_id", "_h", "_source").orderBy(F.lit(0)))
    rows = whole.withColumn("_r", number)
    d = decided.where("copies > 0").select(F.col("doc_id").alias("d_id"), F.col("h").alias("d_h"), F.col("source").alias("d_source"), F.col("r").alias("d_r"), "copies")
    got = rows.join(d, F.col("_id").eqNullSafe(F.col("d_id")) & (F.col("_h") == F.col("d_h")) & F.col("_source").eqNullSafe(F.col("d_source")) & (F.col("_r") == F.col("d_r")))
    taken = got.select("_row", F.explode(F.expr("sequence(1, cast(copies as int))")))
    return taken.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
