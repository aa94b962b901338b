"""Randomised operators: insertion, synthetic sets, noise, splits.  Every draw is a hash of (seed, key, slot)."""

from __future__ import annotations

from itertools import accumulate

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashrand import between, pick, unit
from ..functions.predicates import drop_links
from .words import bioe, word_tokens

# Separators around an insertion (the blank line has half the weight), noise characters and glitches.
SEPARATORS = ["\n\n", "\n", "\n\n", " "]
NOISE = list("abcdefghijklmnopqrstuvwxyz0123456789") + [" ", "\t", "\n", "\r", "\f", "\v", " ", "-", "_", "/", "\\", ".", ",", ":", ";", "(", ")", "[", "]"]
OVERWRITES = ["\n", "\t", "\r\n", " "]
INSERTS = ["\n\n", "\t", "\r", " \n"]


def _of(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def _numbered(targets: DataFrame, order: str = "text") -> tuple[DataFrame, int]:
    """numbered(), and how many rows there are.

    Equal rows are counted first, so a very frequent one is one row of the sort; ranges are sorted in their own tasks.
    What is numbered is kept: a range's numbers hold only as long as the ranges stay the same.  Only the ranges' sizes reach the driver.
    """
    cols, ranges = targets.columns, int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = targets.groupBy(*cols).agg(F.count("*").alias("_c")).repartitionByRange(ranges, *cols).sortWithinPartitions(*cols)
    rows = each.select(F.col(order).alias("target"), F.explode(F.sequence(F.lit(1), F.col("_c").cast("int"))).alias("_k"))
    kept = rows.select("target", F.monotonically_increasing_id().alias("_i")).persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright("_i", 33).cast("int")
    sizes = {r.p: r.n for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)), initial=0))
    tid = F.get(F.lit(before), part) + F.col("_i").bitwiseAND(2**33 - 1)
    return kept.select(tid.cast("bigint").alias("tid"), "target"), before[-1]


def numbered(targets: DataFrame, order: str = "text") -> DataFrame:
    """tid (0, 1, ...) and text, in order of all columns of targets."""
    return _numbered(targets, order)[0]


def insert_targets(base: DataFrame, targets: DataFrame, seed: int, low: int = 1, high: int = 3) -> DataFrame:
    """base (key, text) -> key, text, spans array<struct<start,end,target>>: low to high targets inserted.

    Places are drawn in the base text and sorted; each target stands between
    two separators.  Without targets texts stay as they are.
    """
    tids, n = _numbered(targets)
    if not n:
        none = F.array().cast("array<struct<start:bigint,end:bigint,target:string>>")
        return base.select("key", "text", none.alias("spans"))
    slots = base.select("key", "text", F.explode(F.sequence(F.lit(0), between(seed, F.col("key"), "n", low, high).cast("int") - 1)).alias("slot"))
    draw = lambda name, m: pick(seed, F.col("key"), F.concat(F.lit(name), F.col("slot").cast("string")), m)
    rows = slots.select("key", "slot", draw("t", n).alias("tid"), draw("p", F.length("text") + 1).alias("place"),
                        _of(SEPARATORS, draw("l", len(SEPARATORS))).alias("left"), _of(SEPARATORS, draw("r", len(SEPARATORS))).alias("right"))
    rows = rows.join(tids, "tid")
    order = W.partitionBy("key").orderBy("place", "slot")
    piece = F.length("left") + F.length("target") + F.length("right")
    start = F.col("place") + F.coalesce(F.sum(piece).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.length("left")
    rows = rows.withColumn("start", start)
    item = F.struct("place", "slot", "left", "target", "right", "start")
    got = rows.groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("items"))
    full = base.join(got, "key")
    places = F.transform("items", lambda x: x["place"].cast("int"))
    ends = F.concat(places, F.array(F.length("text")))
    cut = F.transform("items", lambda x, i: F.concat(
        F.substr("text", F.when(i > 0, F.get(places, i - 1)).otherwise(0) + 1, x["place"].cast("int") - F.when(i > 0, F.get(places, i - 1)).otherwise(0)),
        x["left"], x["target"], x["right"]))
    tail = F.substr("text", F.get(ends, F.size("items") - 1) + 1, F.length("text"))
    spans = F.transform("items", lambda x: F.struct(x["start"].cast("bigint").alias("start"), (x["start"] + F.length(x["target"])).cast("bigint").alias("end"), x["target"].alias("target")))
    return full.select("key", F.concat(F.array_join(cut, ""), tail).alias("text"), spans.alias("spans"))


def synthetic_set(lines: DataFrame, targets: DataFrame, n: int, seed: int, positive: float = 0.7) -> DataFrame:
    """n rows: key, positive, text, spans; each from a drawn line (lid 0.., text), positives with targets inserted."""
    lids, m = _numbered(lines)
    lids = lids.select(F.col("tid").alias("lid"), F.col("target").alias("text"))
    rows = lines.sparkSession.range(n).withColumnRenamed("id", "key").withColumn("lid", pick(seed, F.col("key"), "line", m))
    rows = rows.withColumn("positive", unit(seed, F.col("key"), "pos") < positive).join(lids, "lid").select("key", "positive", "text")
    none = F.array().cast("array<struct<start:bigint,end:bigint,target:string>>")
    yes = insert_targets(rows.where("positive").select("key", "text"), targets, seed).select("key", F.lit(True).alias("positive"), "text", "spans")
    return yes.unionByName(rows.where("not positive").select("key", "positive", "text", none.alias("spans")))


def archive_text(requests: DataFrame, archive: DataFrame, seed: int) -> DataFrame:
    """requests (key, n) and archive (line) -> key, tokens: the first n tokens of drawn lines (each has 8 or more)."""
    lids, m = _numbered(archive.select("line"), "line")
    if not m:
        raise ValueError("the archive holds no lines")
    slots = requests.select("key", "n", F.explode(F.sequence(F.lit(0), F.ceil((F.col("n") + 12) / 8).cast("int"))).alias("slot"))
    rows = slots.withColumn("tid", pick(seed, F.col("key"), F.concat(F.lit("a"), F.col("slot").cast("string")), m)).join(lids, "tid")
    got = rows.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("slot", F.split("target", " ").alias("w")))).alias("x"))
    return got.select("key", F.slice(F.flatten(F.transform("x", lambda s: s["w"])), F.lit(1), F.col("n").cast("int")).alias("tokens"))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def perturb(text: Column, seed: int, key: Column, insert: float = 0.35, delete: float = 0.35, low: float = 0.03, high: float = 0.12) -> Column:
    """Extraction noise: a share of the characters deleted, inserted, or both, then perhaps white-space glitches.

    Every draw is a hash of (seed, key, slot).  Deleted are the characters with
    the smallest draws, all but one at most; insertions draw places in what is
    left and are spliced in at once.  Null or empty text stays; no other text
    becomes empty.
    """
    none, both = max(0.0, 1 - insert - delete), min(insert, delete) / 2
    u = lambda slot: unit(seed, key, slot)
    own = lambda name, i: u(F.concat(F.lit(name), i.cast("string")))
    some = lambda n, slot: F.greatest(F.lit(1), F.bround(n * (low + (high - low) * u(slot)), 0)).cast("int")
    kind = u("kind") * (none + insert + delete + both)
    fewer, more = kind >= none + insert, ((kind >= none) & (kind < none + insert)) | (kind >= none + insert + delete)

    def gone(c: Column) -> Column:
        drawn = F.sort_array(F.transform(c, lambda _, i: F.struct(own("d", i).alias("u"), i.alias("i"))))
        return F.transform(F.slice(drawn, F.lit(1), F.least(some(F.size(c), "deleted"), F.size(c) - 1)), lambda x: x["i"])

    def deleted(c: Column) -> Column:
        return _let(gone(c), lambda g: F.filter(c, lambda _, i: ~F.array_contains(g, i)))

    def spliced(c: Column) -> Column:
        """c as a text, with what is inserted; pieces of c are cut out once, in order of place."""
        added = F.transform(F.sequence(F.lit(1), some(F.size(c), "inserted")), lambda j: F.struct(
            F.floor(own("p", j) * (F.size(c) + 1)).cast("int").alias("at"), j.alias("j"), _of(NOISE, F.floor(own("c", j) * len(NOISE))).alias("x")))

        def put(a: Column) -> Column:
            last = lambda k: F.when(k > 0, F.get(a, k - 1)["at"]).otherwise(0)
            heads = F.transform(a, lambda m, k: F.concat(F.array_join(F.slice(c, last(k) + 1, m["at"] - last(k)), ""), m["x"]))
            return F.concat(F.array_join(heads, ""), F.array_join(F.slice(c, last(F.size(a)) + 1, F.size(c)), ""))

        return _let(F.sort_array(added), put)

    def glitched(t: Column, slot: str, values: list[str], share: float, over: int) -> Column:
        """One of values in the place of ``over`` characters."""
        at = F.floor(u(slot + "at") * (F.length(t) + 1 - over)).cast("int")
        new = F.concat(F.substr(t, F.lit(1), at), _of(values, F.floor(u(slot + "of") * len(values))), F.substr(t, at + 1 + over))
        return F.when(u(slot) < share, new).otherwise(t)

    chars = F.split(text, "")
    rest = _let(chars, lambda c: F.when(fewer & (F.size(c) > 3), deleted(c)).otherwise(c))
    noisy = _let(rest, lambda c: F.when(more, spliced(c)).otherwise(F.array_join(c, "")))
    noisy = _let(noisy, lambda t: glitched(t, "over", OVERWRITES, 0.3, 1))
    noisy = _let(noisy, lambda t: glitched(t, "ins", INSERTS, 0.2, 0))
    return F.when(text != "", noisy).otherwise(text)


def word_examples(keys: DataFrame, archive: DataFrame, citations: DataFrame, seed: int, low: int = 40, high: int = 110, refs: int = 4, noise: float = 0.75) -> DataFrame:
    """keys (key) -> key, tokens, ner_tags: archive words with 1 to refs citations put in one after another, so a later one may split an earlier one."""
    base = archive_text(keys.select("key", between(seed, F.col("key"), "n", low, high).alias("n")), archive, seed)
    tids, m = _numbered(citations)
    slots = keys.select("key", F.explode(F.sequence(F.lit(1), between(seed, F.col("key"), "r", 1, refs).cast("int"))).alias("slot"))
    own = F.concat(F.lit("c"), F.col("slot").cast("string"))
    drawn = slots.withColumn("tid", pick(seed, F.col("key"), own, m)).join(tids, "tid")
    both = F.concat_ws(":", F.col("key").cast("string"), F.col("slot").cast("string"))
    text = F.when(unit(seed, both, "noise") < noise, perturb(F.col("target"), seed, both)).otherwise(F.col("target"))
    got = drawn.withColumn("ref", word_tokens(text)).where(F.size("ref") > 0)
    items = got.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("slot", "ref", bioe(F.col("ref")).alias("tags"), unit(seed, both, "i").alias("u")))).alias("items"))
    zero = F.struct(F.col("tokens").alias("w"), F.transform("tokens", lambda _: F.lit(0)).alias("t"))

    def put(state: Column, x: Column) -> Column:
        at = F.floor(x["u"] * (F.size(state["w"]) + 1)).cast("int")
        mid = lambda a, b: F.concat(F.slice(a, F.lit(1), at), b, F.slice(a, at + 1, F.size(a)))
        return F.struct(mid(state["w"], x["ref"]).alias("w"), mid(state["t"], x["tags"]).alias("t"))

    done = base.join(items, "key", "left").select("key", F.aggregate(F.coalesce("items", F.array().cast(items.schema["items"].dataType)), zero, put).alias("s"))
    return done.select("key", F.col("s.w").alias("tokens"), F.col("s.t").alias("ner_tags"))


def drop_links_sometimes(text: Column, seed: int, key: Column, share: float = 0.5) -> Column:
    return F.when(unit(seed, key, "link") < share, drop_links(text)).otherwise(text)


def split(rows: DataFrame, key: str, seed: int, held: float = 0.15) -> DataFrame:
    """rows plus is_train: round-half-even of the share, in hash order.

    The threshold is found by buckets of the hash, so no task sorts all rows.
    """
    u = unit(seed, F.col(key), "split")
    marked = rows.withColumn("_u", u).withColumn("_b", F.floor(u * 1024).cast("int"))
    sizes = marked.groupBy("_b").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("c").over(W.partitionBy())
    at = sizes.select("_b", before.alias("_before"), F.bround(total * (1 - held), 0).alias("_limit"))
    place = F.row_number().over(W.partitionBy("_b").orderBy("_u", key)) + F.col("_before")
    return marked.join(at, "_b").withColumn("is_train", place <= F.col("_limit")).drop("_u", "_b", "_before", "_limit")


def repeat(rows: DataFrame, times: int) -> DataFrame:
    """Each row ``times`` times, with copy 1, 2, ..."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows in an order drawn by hash of (seed, key); ties by key."""
    return rows.orderBy(unit(seed, F.col(key), "shuffle"), key)
