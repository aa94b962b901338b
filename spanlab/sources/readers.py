"""Text, JSON and model sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import strip
from ..operators.synth import drop_links_sometimes, split

# Keys of supervised items, by priority.
TEXT_KEYS = ["text", "passage", "raw_text", "content"]
SPAN_KEYS = ["boundaries", "spans", "insert_spans", "label_spans", "targets"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: stripped lines that aren't blank."""
    return non_blank(spark.read.text(path).select(F.col("value").alias("line")))


def non_blank(lines: DataFrame) -> DataFrame:
    rest = [c for c in lines.columns if c != "line"]
    return lines.select(*rest, strip(F.col("line")).alias("line")).where("line <> ''")


def read_citations(spark: SparkSession, path: str, seed: int, drop: float = 0.5) -> DataFrame:
    """Citation lines, some without their links; raises if there are none."""
    rows = read_lines(spark, path).select(drop_links_sometimes(F.col("line"), seed, F.col("line"), drop).alias("text")).where("text <> ''")
    if rows.isEmpty():
        raise ValueError(f"no citations in {path}")
    return rows


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archive lines, kept in memory or on disk; raises if there are none."""
    rows = read_lines(spark, path).cache()
    if rows.isEmpty():
        raise ValueError(f"no lines in {path}")
    return rows


def write_archive(lines: DataFrame, path: str) -> None:
    """One line per row; an existing archive stays."""
    lines.select("line").write.mode("ignore").text(path)


def items(raw: DataFrame, column: str = "json") -> DataFrame:
    """Supervised JSON of any layout (one document per row) -> part ('train', 'eval' or 'all'), pos, item (variant).

    Layouts: a list; an object with train or eval; an object with examples, data or items (the first that is a list).
    """
    v = raw.select(F.monotonically_increasing_id().alias("_file"), F.try_parse_json(column).alias("v"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant")).startswith("ARRAY")
    top = F.schema_of_variant("v").startswith("ARRAY")
    split = F.try_variant_get("v", "$.train", "variant").isNotNull() | F.try_variant_get("v", "$.eval", "variant").isNotNull()
    first = F.coalesce(*[F.when(F.coalesce(kind(f"$.{k}"), F.lit(False)), F.lit(k)) for k in ("examples", "data", "items")])
    parts = v.select("_file", "v", F.when(top, F.array(F.struct(F.lit("all").alias("part"), F.col("v").alias("list")))).when(split, F.array(
        F.struct(F.lit("train").alias("part"), F.try_variant_get("v", "$.train", "variant").alias("list")),
        F.struct(F.lit("eval").alias("part"), F.try_variant_get("v", "$.eval", "variant").alias("list")))).otherwise(F.array(F.struct(
            F.lit("all").alias("part"),
            F.coalesce(*[F.when(first == k, F.try_variant_get("v", f"$.{k}", "variant")) for k in ("examples", "data", "items")]).alias("list")))).alias("p"))
    rows = parts.select("_file", F.explode("p").alias("p")).select("_file", "p.part", "p.list").where("list is not null")
    rows.createOrReplaceTempView("_spanlab_items")
    return raw.sparkSession.sql("SELECT i._file, i.part, e.pos, e.value AS item FROM _spanlab_items i, LATERAL variant_explode(i.list) e")


def normalise(rows: DataFrame) -> DataFrame:
    """items() -> _file, part, pos, text, spans array<struct<start,end>>: items without a text go; unusable spans are left out.

    The first text key whose value is a string wins, even if empty; the first span key that is present wins, even if no list.
    """
    def is_string(k: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get("item", f"$.{k}", "variant")) == "STRING", F.lit(False))

    text = F.coalesce(*[F.when(is_string(k), F.try_variant_get("item", f"$.{k}", "string")) for k in TEXT_KEYS])
    is_object = F.schema_of_variant("item").startswith("OBJECT")
    keys = F.try_variant_get("item", "$", "map<string,variant>")
    present = F.coalesce(*[F.when(F.array_contains(F.map_keys(keys), k), F.lit(k)) for k in SPAN_KEYS])
    spans = F.try_variant_get(F.try_element_at(keys, present), "$", "array<variant>")
    pick = lambda x, name, i: F.coalesce(F.try_variant_get(x, f"$.{name}", "bigint"), F.try_variant_get(x, f"$[{i}]", "bigint"))
    both = F.filter(F.transform(F.coalesce(spans, F.array().cast("array<variant>")), lambda x: F.struct(pick(x, "start", 0).alias("start"), pick(x, "end", 1).alias("end"))),
                    lambda s: s["start"].isNotNull() & s["end"].isNotNull())
    return rows.where(is_object).select("_file", "part", "pos", text.alias("text"), both.alias("spans")).where("text <> ''")


def supervised_sets(rows: DataFrame, seed: int = 42, held: float = 0.15) -> DataFrame:
    """normalise() -> key, text, spans, is_train: layouts that are split stay so, the others are split by hash."""
    keyed = rows.select(F.concat_ws("/", "_file", "part", "pos").alias("key"), "part", "text", "spans")
    given = keyed.where("part <> 'all'").withColumn("is_train", F.col("part") == "train")
    return given.unionByName(split(keyed.where("part = 'all'"), "key", seed, held)).drop("part")


def read_supervised(spark: SparkSession, path: str, seed: int = 42, held: float = 0.15) -> DataFrame:
    """JSON files of any supervised layout, a file a document -> key, text, spans, is_train."""
    raw = spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")
    return supervised_sets(normalise(items(raw)), seed, held)


def write_supervised(examples: DataFrame, path: str) -> None:
    """JSON lines of {text, boundaries: [{start, end}]}."""
    examples.select("text", "boundaries").write.mode("overwrite").json(path)
