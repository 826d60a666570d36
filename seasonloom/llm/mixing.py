"""Mixing sources to target weights, by blocks, with DataFrame operations only.

Each source's documents, in an order made by hashes, form one stream of words that is packed into blocks of a fixed
length. A share of the whole is dealt to sources by weight, no more than twice a source's size. Slots of the output
shards draw their source from these shares (multinomial counts per shard); what a source has drawn beyond its share of
blocks is left out, and what it lacks is drawn into a last shard. The j-th slot of a source, counted over shards, takes
block perm(j mod n) of its n blocks, where perm is a keyed pseudorandom permutation of that source's indexes. Slots and
blocks are joined by (source, index), a key without hot values: a source with a third of all rows is spread over all
its blocks, and streams are laid out in two levels of prefix sums (within hashed buckets, then over bucket totals).

Null text has size 0; null source is a source of its own, last. Documents without words take nothing. Repeated rows
and doc_ids are documents of their own. Texts of any length are cut into as many blocks as they need. An empty table gives an empty result. Results depend on the data and the seed
only, not on the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonloom.llm.common import SPACE, stored

#: Fixed by the contract: weights of the sources in order, repeating; share of all words; highest multiple of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK_WORDS, SHARD_SLOTS, BINS, ROUNDS = 64, 4096, 1024, 4


def word_count(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def same(a: str, b: str, key: str) -> Column:
    """Null-safe equality of a column of two aliased frames."""
    return F.col(f"{a}.{key}").eqNullSafe(F.col(f"{b}.{key}"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: shares by weight, those beyond most times the size dealt anew among the others.

    That ends where every share is the least of its limit and one level times its weight, so the level is found from
    the sources in order of limit by weight. One row per source is sorted, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")).withColumn("weight", w)
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("limit", most * F.col("source_size").cast("double"))
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    found = found.withColumn("level", left / open_weight)
    found = found.withColumn("level", F.min(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(every)["level"])
    return found.select("source", "source_size", "n_docs", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), "limit")).alias("target"))


def permuted(df: DataFrame, j: str, n: str, key: list[str], seed: int) -> DataFrame:
    """df with block: j's image under a keyed permutation of 0 .. n - 1.

    A Feistel network permutes the smallest square of cells that holds n; an image outside 0 .. n - 1 is mapped again.
    """
    keep = df.columns

    def rounds(x: Column, y: Column, side: Column, names) -> tuple[Column, Column]:
        for r in range(ROUNDS):
            x, y = y, F.pmod(x + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), *[F.col(k) for k in names], y), side), side)
        return x, y

    df = df.withColumn("side", F.ceil(F.sqrt(F.col(n).cast("double"))).cast("long"))
    df = df.withColumn("side", F.when(F.col("side") * F.col("side") < F.col(n), F.col("side") + 1).otherwise(F.greatest(F.col("side"), F.lit(1))))

    def once(v: Column) -> Column:
        x, y = rounds(F.floor(v / F.col("side")).cast("long"), F.pmod(v, F.col("side")), F.col("side"), key)
        return x * F.col("side") + y

    df = df.withColumn("image", once(F.col(j)))
    # few cells lie outside, about 2 / sqrt(n) of them, and never 200 in a row
    again = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.col("image"), lambda v, _: F.when(v < F.col(n), v).otherwise(once(v)))
    return df.select(*keep, F.when(F.col("image") < F.col(n), F.col("image")).otherwise(again).alias("block"))


def draw_slots(shares: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """shard, source, j, n_blocks: the slots that each output shard draws, j counted per source over all shards."""
    spark = shares.sparkSession
    q = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("source_size") * F.col("n_blocks")), 2.0 * F.col("n_blocks"))).otherwise(0.0).cast("long")
    shares = stored(shares.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long")).withColumn("quota", q), "mix-shares")
    total = shares.agg(F.sum("quota")).first()[0] or 0
    n_shards = -(-total // shard_slots)
    upto = F.sum("quota").over(Window.orderBy(F.col("source").asc_nulls_last()))
    spans = shares.where("quota > 0").withColumn("hi", upto / F.lit(float(max(total, 1)))).withColumn("lo", (upto - F.col("quota")) / F.lit(float(max(total, 1))))
    # a slot's number in 0 .. 1 meets its source over equal bins: an equijoin that suits any number of sources
    spans = spans.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1)))).alias("bin"))
    slots = spark.range(total).select((F.col("id") / shard_slots).cast("long").alias("shard"), (F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("u"))
    slots = slots.withColumn("bin", F.floor(F.col("u") * BINS))
    counts = slots.join(spans, "bin").where("lo <= u and u < hi").groupBy("shard", "source").agg(F.count(F.lit(1)).alias("drawn"))
    counts = stored(counts, "mix-counts")
    lacking = shares.alias("s").join(counts.groupBy("source").agg(F.sum("drawn").alias("drawn")).alias("c"), same("s", "c", "source"), "left")
    lacking = lacking.select(F.lit(n_shards).cast("long").alias("shard"), "s.source", (F.col("quota") - F.coalesce("drawn", F.lit(0))).alias("drawn")).where("drawn > 0")
    counts = counts.select("shard", "source", "drawn").unionByName(lacking)
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("drawn").over(before), F.lit(0)))
    counts = counts.alias("c").join(shares.alias("s"), same("c", "s", "source")).select("shard", "c.source", "start", F.least(F.col("start") + F.col("drawn"), "quota").alias("end"), "n_blocks")
    # a source's counts meet in one task to be added up; its slots are dealt out again
    spread = counts.where("end > start").repartition(max(1, min(4096, total // 200_000 + 1)), "shard", "source")
    return spread.select("shard", "source", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("j"), "n_blocks")


def laid_out(rows: DataFrame, seed: int) -> DataFrame:
    """row, source, size, start: where each row's words begin in its source's stream."""
    n_buckets = max(1, int(rows.count() ** 0.5))
    sizes = rows.select("row", "doc_id", "source", "size", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(n_buckets)).alias("bucket"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("base", F.coalesce(F.sum("words").over(over), F.lit(0))).drop("words")
    within = sizes.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    found = within.alias("d").join(base.alias("b"), same("d", "b", "source") & (F.col("d.bucket") == F.col("b.bucket")))
    return found.select("d.row", "d.source", "d.size", (F.col("start") + F.col("base")).alias("start"))


def mix(rows: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 9) -> dict[str, DataFrame]:
    """Plans a mix of rows (row, doc_id, source, size): tables shares (by source), pieces (row, source, and for each
    block that it crosses block, from_word and words there) and slots (shard, source, j, turn, block): turn counts how
    often the source has been passed through."""
    shares = targets(rows)
    drawn = draw_slots(shares, block_words, shard_slots, seed).withColumn("place", F.pmod("j", "n_blocks")).withColumn("turn", F.floor(F.col("j") / F.col("n_blocks")))
    slots = permuted(drawn, "place", "n_blocks", ["source"], seed).drop("place", "n_blocks")
    whole = laid_out(rows, seed).where("size > 0")
    block = F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))).alias("block")
    pieces = whole.select("row", "source", "size", "start", block)
    first = F.greatest(F.col("start"), F.col("block") * block_words)
    pieces = pieces.withColumn("from_word", first - F.col("start")).withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - first)
    return {"shares": shares, "pieces": pieces.drop("start"), "slots": slots}


def numbered(docs: DataFrame) -> DataFrame:
    """row (a number, fixed by being stored), doc_id, source and size of docs."""
    return stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("row", F.monotonically_increasing_id()), "mix-rows")


def by_block(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """pieces (p) with the slots (t) that take their block.

    Both sides come from exploded ranges, which the planner takes for as small as the stored ranges: without the hint it
    may collect all slots in the driver to broadcast them.
    """
    return pieces.alias("p").join(slots.hint("merge").alias("t"), same("p", "t", "source") & (F.col("p.block") == F.col("t.block")))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document: the words that the mix takes, repeats counted."""
    rows = numbered(docs)
    plan = mix(rows, **options)
    times = plan["slots"].groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    hit = by_block(plan["pieces"], times)
    taken = hit.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    shares = stored(plan["shares"], "mix-targets")
    found = rows.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return found.alias("d").join(shares.alias("s"), same("d", "s", "source")).select("d.doc_id", "d.size", "s.source_size", "s.target", "d.taken")


def fingerprint(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all of a row's columns: rows with the same two are equal."""
    columns = [(F.col(f"`{f.name}`"), f.dataType.simpleString()) for f in df.schema]
    plain = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if "<" in kind else c for c, kind in columns]
    return [F.xxhash64(F.lit(seed), *plain, *[c.isNull() for c, _ in columns]).alias(f"_key{seed}") for seed in (1, 2)]


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs (same columns) as the mix takes them: a document appears once for each turn of its source that takes words of
    it, with these words in order, each with the white space behind it, as text and n_chars; whole texts stay as they are.

    The plan is made of numbers only. Texts are shuffled once, by a hash of their row, to meet what is taken of them;
    equal rows are one row there, and documents of their own in the plan.
    """
    key = ["_key1", "_key2"]
    whole = docs.select(*fingerprint(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = whole.select(*key, "doc.doc_id", "doc.source", word_count(F.col("doc.text")).alias("size"))
    rows = rows.groupBy(*key).agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    # numbers follow from the rows' contents, not from partitions
    rows = stored(rows.select(F.struct(*key, "copy").alias("row"), "doc_id", "source", "size"), "mix-rows")
    plan = mix(rows, **options)
    hit = by_block(plan["pieces"], plan["slots"])
    spans = hit.groupBy("row", "turn").agg(F.array_sort(F.collect_list(F.struct("from_word", "words"))).alias("spans"), F.sum("words").alias("taken"), F.max("size").alias("size"))  # bounded by a document's blocks
    spans = spans.select(*[f"row.{k}" for k in key], "spans", "taken", "size")
    full = whole.dropDuplicates(key).join(spans.hint("merge"), key)
    words = F.regexp_extract_all(F.col("doc.text"), F.lit(f"[^{SPACE}]+[{SPACE}]*"), F.lit(0))
    part = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice("words_", (s["from_word"] + 1).cast("int"), s["words"].cast("int")))), "")
    every = F.col("taken") == F.col("size")
    full = full.withColumn("words_", F.when(~every, words)).withColumn("text_", F.when(every, F.col("doc.text")).otherwise(part))
    made = {"text": F.col("text_"), "n_chars": F.when(every, F.col("doc.n_chars") if "n_chars" in docs.columns else F.lit(0)).otherwise(F.length("text_").cast("long"))}
    return full.select(*[made[c].alias(c) if c in made else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
