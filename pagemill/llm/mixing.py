"""Operator 5: mix sources to target weights, in blocks of a fixed number of words.

1. Sizes: words of every document, by a split of its text. Texts are read once and never shuffled.
2. Targets: sources share the budget by weight. A target stops at ``most`` times its source's size and the excess goes to the
   others by weight, until none is above (rounds over one row per source).
3. Blocks: the documents of a source, in the order of a hash, form one stream of words that is cut into blocks.
   Offsets come from sums over hash chunks, so no task holds a whole source.
4. Draw: a source gets the slots that fill its target. They are thrown into output shards by hash, so the counts of the
   sources per shard are a multinomial draw, given the totals; a shard then owns a run of so many slots of the source.
5. Slots go pass by pass: complete passes over the source's blocks, then part of one. A slot finds its block through a pseudorandom
   permutation of the block indexes (one per source and pass), and blocks are joined by index. A short last block keeps the
   last slot of a pass, and the last slot of a source is cut to the word.

All draws are hashes of the seed, so reruns agree. No document is taken more often than ``most`` times.

Cases: a null source is a source of its own, ordered last; null and empty texts have size 0 and take nothing; a source without words
has target 0; repeated rows are documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import ROW, parts, set_up, unpacked, whole
from pagemill.session import staged

SEPARATORS = "[ \\t\\n\\x0B\\f\\r]+"  # fixed value: what stands between words
BLOCK = 64
CHUNK_DOCUMENTS = 20_000
SLOT_CHUNK = 1 << 15
ROUNDS = 4


def words(text: Column | str) -> Column:
    """The words of a text as an array; null for null."""
    return F.filter(F.split(F.col(text) if isinstance(text, str) else text, SEPARATORS), lambda w: w != "")


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source (``source, source_size, no, target``): the share of the budget after all excess is dealt out.

    ``sizes`` has one row per source. Every round fixes the sources whose share is above their limit; what they leave is shared
    by the others' weights. A round is one aggregate, and the driver sees two sums of it.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("no"), len(weights)) + 1).cast("int"))
    rows = staged(
        sizes.withColumn("no", F.row_number().over(order) - 1).withColumn("_w", weight.cast("double")).withColumn("_limit", F.col("source_size") * float(most)),
        "sources",
    )
    whole = (rows.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, closed = 0.0, -1
    while True:
        above = F.col("_limit") <= F.col("_w") * F.lit(level)
        n, held, open_weight = rows.agg(F.sum(above.cast("long")), F.sum(F.when(above, F.col("_limit"))), F.sum(F.when(~above, F.col("_w")))).first()
        if not open_weight or n == closed:
            break
        closed, level = n, (whole - (held or 0.0)) / open_weight
    return rows.select("source", "source_size", "no", F.least(F.col("_limit"), F.col("_w") * F.lit(level)).alias("target"))


def _hash(*parts: Column | int | str) -> Column:
    return F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def permuted(x: Column, n: Column, key: Column, seed: int) -> Column:
    """Where a keyed permutation of 0 .. n - 1 sends ``x``.

    A shift, then mixing rounds on x = column * high + row over the largest full grid below n (each adds a hash of one
    coordinate to the other, which can be undone), and the few numbers beyond the grid stay; then a shift and the rounds again.
    """
    wide = F.floor(F.sqrt(n.cast("double"))).cast("long")
    high = F.floor(n / wide).cast("long")
    return F.transform(
        F.array(F.struct(x.alias("x"), n.alias("n"), wide.alias("a"), high.alias("b"), key.alias("k"))),
        lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(1)), s["x"], lambda at, again: _grid_rounds(F.pmod(at + F.pmod(_hash(seed, s["k"], again), s["n"]), s["n"]), s, again, seed)),
    )[0]


def _grid_rounds(at: Column, s: Column, again: Column, seed: int) -> Column:
    def step(cell: Column, r: Column) -> Column:
        key = lambda c: _hash(seed + 1, s["k"], again, r, c)
        a = F.when(r % 2 == 0, F.pmod(cell["a"] + F.pmod(key(cell["b"]), s["a"]), s["a"])).otherwise(cell["a"])
        b = F.when(r % 2 == 1, F.pmod(cell["b"] + F.pmod(key(cell["a"]), s["b"]), s["b"])).otherwise(cell["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    first = F.struct(F.floor(at / s["b"]).cast("long").alias("a"), F.pmod(at, s["b"]).alias("b"))
    mixed = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, step, lambda c: c["a"] * s["b"] + c["b"])
    return F.when(at < s["a"] * s["b"], mixed).otherwise(at)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, text_hash`` of every row, staged: texts are read once."""
    set_up(docs.sparkSession)
    text = F.col("text").cast("string")
    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("text_hash")), "sizes")


def _offsets(rows: DataFrame, seed: int) -> DataFrame:
    """Add ``start``, the place of a document in its source's stream.

    Rows that are alike, such as empty ones without an id, are one row with a count until the places are told, so they neither
    meet in one task nor depend on the order in which rows are read.
    """
    n_chunks = max(128, rows.count() // CHUNK_DOCUMENTS)
    alike = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.col("doc_id").isNull(), F.col("text_hash"))
    alike = alike.withColumn("_h", _hash(seed, F.col("doc_id"), F.col("size"), own)).withColumn("_chunk", F.pmod("_h", F.lit(n_chunks)))
    whole_size = F.col("size") * F.col("_n")
    before = Window.partitionBy("no").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = alike.groupBy("no", "_chunk").agg(F.sum(whole_size).alias("_s")).select("no", "_chunk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("no", "_chunk").orderBy("_h", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("_in", F.coalesce(F.sum(whole_size).over(inside), F.lit(0))).join(sums, ["no", "_chunk"])
    spread = placed.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(CHUNK_DOCUMENTS).cast("long"))))
    spread = spread.repartition(parts(rows.sparkSession), "_h", "_from")
    each = spread.withColumn("_k", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK_DOCUMENTS, F.col("_n")) - 1)))
    return each.select(*rows.columns, (F.col("_base") + F.col("_in") + F.col("_k") * F.col("size")).alias("start"))


def draws(sources: DataFrame, block: int = BLOCK, seed: int = 5, shard_words: int = 1 << 20) -> DataFrame:
    """How many slots of each source every output shard gets: ``no, shard, first, n``; its slots are those from ``first`` on.

    The slots that a source's target asks for are thrown into shards, which makes the counts a multinomial draw with a
    known total. Only the counts are kept: which words a shard gets is up to the permutations.
    """
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, round(total / shard_words))
    size, goal = F.col("source_size"), F.round("target").cast("long")
    passes = F.floor((goal - 1) / size)
    n = passes * F.ceil(size / block) + F.ceil((goal - passes * size) / block)
    chunks = sources.where("target >= 0.5").select("no", n.cast("long").alias("n")).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOT_CHUNK).cast("long"))))
    chunks = chunks.repartition(parts(sources.sparkSession), "no", "_from")
    each = chunks.select("no", F.explode(F.sequence("_from", F.least(F.col("_from") + SLOT_CHUNK, F.col("n")) - 1)).alias("_slot"))
    counts = each.groupBy("no", F.pmod(_hash(seed + 2, F.col("no"), F.col("_slot")), F.lit(shards)).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def slots(sources: DataFrame, block: int = BLOCK, seed: int = 5, shard_words: int = 1 << 20) -> DataFrame:
    """All slots: ``no, pass, slot, block, words, shard``; ``words`` is what the slot takes from the start of its block."""
    counts = staged(draws(sources, block, seed, shard_words), "draws")
    size, goal = F.col("source_size"), F.round("target").cast("long")
    per_pass = F.ceil(size / block).cast("long")
    # a shard has some shard_words / block slots, so a row of the draw makes no more than that
    each = counts.repartition(parts(sources.sparkSession), "no", "shard").join(sources.select("no", "source_size", "target"), "no")
    each = each.withColumn("_slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    each = each.withColumn("pass", F.floor(F.col("_slot") / per_pass).cast("int")).withColumn("slot", F.col("_slot") - F.col("pass") * per_pass)
    need = F.least(size, goal - F.col("pass") * size)
    each = each.withColumn("full", F.floor(size / block).cast("long"))
    # the short last block, if a source has one, comes last in every pass
    found = F.when(F.col("slot") < F.col("full"), permuted(F.col("slot"), F.col("full"), _hash(F.col("no"), F.col("pass")), seed)).otherwise(F.col("slot"))
    return each.select("no", "pass", "slot", found.alias("block"), F.least(F.lit(block).cast("long"), need - F.col("slot") * block).alias("words"), "shard")


def _planned(rows: DataFrame, seed: int, **share) -> tuple[DataFrame, DataFrame]:
    """Documents with ``no, start`` and their source's numbers, and the sources."""
    sources = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **share), "targets")
    told = rows.join(F.broadcast(sources) if sources.count() <= 10_000 else sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    return _offsets(told, seed), sources


def _covered(placed: DataFrame, block: int) -> DataFrame:
    """A row per document and block that holds some of its words: word range [low, high) inside the block."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    rows = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    at = F.col("block") * block
    return rows.withColumn("low", F.greatest(F.col("start") - at, F.lit(0))).withColumn("high", F.least(F.col("start") + F.col("size") - at, F.lit(block)))


def mix_sources(docs: DataFrame, seed: int = 5, block: int = BLOCK, tell_shards: bool = False, **share) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``, and with ``tell_shards`` also ``n_shards``: how many output shards its words go to."""
    rows = measured(docs)
    placed, sources = _planned(rows, seed, **share)
    placed = staged(placed.withColumn("_row", F.monotonically_increasing_id()), "placed")
    uses = slots(sources, block, seed).groupBy("no", "block").agg(F.collect_list(F.struct("words", "shard")).alias("_uses"))  # as many as passes
    given = F.filter("_uses", lambda u: u["words"] > F.col("low"))
    part = F.aggregate(given, F.lit(0).cast("long"), lambda n, u: n + F.least(u["words"], F.col("high")) - F.col("low"))
    # Spark takes exploded rows for as few as their sources and would broadcast them, so the joins are named
    met = _covered(placed, block).join(uses.hint("merge"), ["no", "block"]).select("_row", part.alias("_part"), F.transform(given, lambda u: u["shard"]).alias("_shards"))
    taken = met.groupBy("_row").agg(F.sum("_part").alias("taken"), F.size(F.array_distinct(F.flatten(F.collect_list("_shards")))).cast("long").alias("n_shards"))
    out = placed.join(taken.hint("merge"), "_row", "left")
    told = ["taken", "n_shards"] if tell_shards else ["taken"]
    return out.select("doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in told])


def mixed_documents(docs: DataFrame, seed: int = 5, block: int = BLOCK, **share) -> DataFrame:
    """The mix itself: a row per document and pass with the words taken, in all columns of ``docs``.

    A document taken whole keeps its text; of one taken in part the words of its slots are joined by one space. ``n_chars``, if
    there is such a column, follows the text. Rows that take nothing are not part of the mix.
    """
    rows = measured(docs)
    placed, sources = _planned(rows, seed, **share)
    covered = _covered(placed, block).join(slots(sources, block, seed).select("no", "block", "pass", "words").hint("merge"), ["no", "block"])
    piece = F.struct((F.col("block") * block + F.col("low") - F.col("start")).alias("at"), (F.least("words", "high") - F.col("low")).alias("n"))
    plan = covered.where("words > low").groupBy("doc_id", "source", "size", "text_hash", "start", "pass").agg(F.sort_array(F.collect_list(piece)).alias("_pieces"))
    plan = plan.withColumn("_whole", F.aggregate("_pieces", F.lit(0).cast("long"), lambda n, p: n + p["n"]) == F.col("size"))
    # repeated rows are alike in all that the plan sees, so plans and rows of one key are paired by number
    key = ["_id", "_source", "_size", "_hash"]
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("text_hash").alias("_hash"), "start", "pass", "_pieces", "_whole")
    plan = plan.withColumn("_no", F.dense_rank().over(Window.partitionBy(*key).orderBy("start")))
    text, old = F.col("text").cast("string"), F.col(f"{ROW}.text").cast("string")
    source = docs.select(whole(docs), F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("_source"), n_words(text).alias("_size"), F.xxhash64(text).alias("_hash"))
    source = source.where("_size > 0").withColumn("_no", F.row_number().over(Window.partitionBy(*key).orderBy("_hash")))
    both = source.alias("d").join(plan.alias("p").hint("merge"), F.expr("d._id <=> p._id AND d._source <=> p._source AND d._size = p._size AND d._hash = p._hash AND d._no = p._no"))
    cut = F.array_join(F.flatten(F.transform("p._pieces", lambda p: F.slice(words(old), (p["at"] + 1).cast("int"), p["n"].cast("int")))), " ")
    new = F.when(F.col("p._whole"), old).otherwise(cut)
    made = {"text": new} | ({"n_chars": F.length(new).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return both.select(*unpacked(docs, **made))
