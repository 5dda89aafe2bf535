"""Mixing sources to target weights, with DataFrame functions alone.

Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share all words
there are. A target ends at ``most`` times its source's words; the excess is
shared again by weight among the others until none is above.

Documents fall into blocks of their source by hash. An epoch is a permutation of
a source's blocks; draws go through epochs until the source's target is reached,
which the last draw's documents reach together, the last of them in part. How
many of a source's draws go to each output shard is decided down a binary tree
of shards: a node's draws are dealt to its two halves by a multivariate
hypergeometric draw, exact in all sums, and so every shard has its size and every
source its quota. A shard takes the draws that follow one another in the
source's order, hence disjoint blocks, and shuffles its rows locally by hash.

Sources are split in strata of ``STRATUM`` in their order, each with a tree of
its own over the same shards, so that no row holds more quotas than that.

Defined results: null, empty and blank texts have size 0, are taken 0 words, and
count for nothing; a source of them has target 0. Rows equal in id and text are
taken alike, a word short of the target for each at most; other rows of equal or
no id are separate rows. Very long texts are one document of their block. Sources
with equal names are one; ties do not occur. An empty table gives an empty table.
The same rows and seed give the same mix, however they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastewright.llm.common import quoted, stored
from tastewright.operators.lookup import lookup
from tastewright.operators.order import numbered

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK_WORDS = 1 << 18
SHARD_WORDS = 1 << 24
STRATUM = 1000
SEED = 42
#: Primes above any number of blocks: multiplying by one permutes the blocks.
MULTIPLIERS = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549)
#: Blocks whose words are added up in one step where a target ends.
SPAN = 1024
SOURCE = ["no_name", "name"]
QUOTAS = "array<struct<id: long, first: long, n: long>>"
HALVES = "array<struct<id: long, first: long, left: long, right: long>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _uniform(*key) -> Column:
    """A number from 0 to below 1, fixed by the key."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") * F.lit(2.0**-53)


# --- hypergeometric draws -----------------------------------------------------

def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``marked`` ones, from a uniform number.

    By inversion from the mode outwards; what lies over 12 standard deviations
    and 40 away has less probability than a double can tell.
    """
    def from_mode(v):
        n, k, d = v["total"], v["marked"], v["drawn"]
        fraction = k / n
        deviation = F.sqrt(F.greatest(F.lit(0.0), d * fraction * (1 - fraction) * (n - d) / F.greatest(n - 1, F.lit(1))))
        mode = F.floor((d + 1).cast("double") * (k + 1) / (n + 2))
        low, high = F.greatest(F.lit(0), d - (n - k)), F.least(k, d)
        reach = 40 + 12 * F.ceil(deviation)
        return _let(F.struct(
            n.alias("total"), k.alias("marked"), d.alias("drawn"), v["uniform"].alias("uniform"),
            F.greatest(low, F.least(high, mode)).alias("mode"),
            reach.alias("reach"), low.alias("low"), high.alias("high")), chosen)

    def chosen(v):
        n, k, d, mode = v["total"], v["marked"], v["drawn"], v["mode"]
        low, high = F.greatest(v["low"], mode - v["reach"]), F.least(v["high"], mode + v["reach"])
        none = F.array().cast("array<long>")
        up = F.when(high > mode, F.sequence(mode + 1, high)).otherwise(none)
        down = F.when(low < mode, F.sequence(mode - 1, low)).otherwise(none)
        # weight of a number over that of its neighbour nearer to the mode
        rise = lambda x: ((k - x + 1).cast("double") * (d - x + 1)) / (x.cast("double") * (n - k - d + x))
        fall = lambda x: ((x + 1).cast("double") * (n - k - d + x + 1)) / ((k - x).cast("double") * (d - x))

        def weight(places, ratio):
            start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
            return F.aggregate(places, start, lambda a, x: _let(
                a["p"] * ratio(x), lambda p: F.struct(p.alias("p"), (a["sum"] + p).alias("sum"))))["sum"]

        def walk(places, ratio, start):
            return F.aggregate(places, start, lambda a, x: _let(a["p"] * ratio(x), lambda p: F.struct(
                p.alias("p"), (a["left"] - p).alias("left"),
                F.coalesce(a["at"], F.when(a["left"] - p < 0, x)).alias("at"))))

        def state(left, at):
            return F.struct(F.lit(1.0).alias("p"), left.alias("left"), at.alias("at"))

        return _let(v["uniform"] * (1 + weight(up, rise) + weight(down, fall)), lambda x: _let(
            walk(up, rise, state(x - 1, F.when(x < 1, mode))), lambda a: F.coalesce(
                walk(down, fall, state(a["left"], a["at"]))["at"], mode)))

    return _let(F.struct(total.alias("total"), marked.alias("marked"), drawn.alias("drawn"), uniform.alias("uniform")), from_mode)


def _halves(quotas: Column, total: Column, drawn: Column, *key: Column) -> Column:
    """Each source's draws that go left and right, where ``drawn`` of ``total`` go left."""
    start = F.struct(total.alias("total"), drawn.alias("drawn"), F.array().cast(HALVES).alias("out"))

    def one(a, s):
        share = hypergeometric(a["total"], s["n"], a["drawn"], _uniform(*key, s["id"]))
        return _let(F.when(s["n"] == a["total"], a["drawn"]).when(a["drawn"] == 0, F.lit(0)).otherwise(share).cast("long"),
                    lambda left: F.struct(
                        (a["total"] - s["n"]).alias("total"), (a["drawn"] - left).alias("drawn"),
                        F.concat(a["out"], F.array(F.struct(
                            s["id"].alias("id"), s["first"].alias("first"), left.alias("left"),
                            (s["n"] - left).alias("right")))).alias("out")))

    return F.aggregate(quotas, start, one)["out"]


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``(id, shard, first, n)``: draws ``first`` to ``first + n - 1`` of a source go to a shard.

    ``quotas`` is ``(id, n)``, ids from 0 without gaps. Shard s of ``shards`` gets
    from a stratum of Q draws ``floor((s + 1) Q / shards) - floor(s Q / shards)``.
    """
    quota = F.struct("id", F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"))
    nodes = quotas.where("n > 0").groupBy(F.floor(F.col("id") / STRATUM).alias("stratum")).agg(
        F.sum("n").cast("long").alias("total"), F.array_sort(F.collect_list(quota)).cast(QUOTAS).alias("quotas")).select(
        "stratum", "total", F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), "quotas")
    before = lambda shard: F.call_function("div", shard * F.col("total"), F.lit(shards).cast("long"))
    for level in range((shards - 1).bit_length()):
        if level and level % 6 == 0:
            nodes = nodes.repartition("stratum", "low")
        mid = F.shiftright(F.col("low") + F.col("high"), 1)
        size = lambda low, high: before(high) - before(low)
        halves = _halves(F.col("quotas"), size(F.col("low"), F.col("high")), size(F.col("low"), mid),
                         F.lit(seed), F.col("stratum"), F.col("low"), F.col("high"))

        def child(low, high, first, n):
            own = F.transform("halves", lambda h: F.struct(h["id"].alias("id"), first(h).alias("first"), h[n].alias("n")))
            return F.struct(low.alias("low"), high.alias("high"), F.filter(own, lambda q: q["n"] > 0).alias("quotas"))

        left = child(F.col("low"), mid, lambda h: h["first"], "left")
        right = child(mid, F.col("high"), lambda h: h["first"] + h["left"], "right")
        same = F.struct("low", "high", "quotas")
        split = nodes.select("*", F.when(F.col("high") - F.col("low") > 1, halves).alias("halves"))
        children = F.when(F.col("halves").isNotNull(), F.array(left, right)).otherwise(F.array(same))
        nodes = split.select("stratum", "total", F.explode(children).alias("child")).select(
            "stratum", "total", "child.low", "child.high", "child.quotas")
    return nodes.select(F.col("low").alias("shard"), F.inline("quotas")).select("id", "shard", "first", "n")


# --- sources and their targets ------------------------------------------------

def _counted(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    doc_id, text, source = (docs[quoted(c)] for c in (id_col, text_col, source_col))
    text, source = text.cast("string"), source.cast("string")
    return docs.select(
        doc_id.alias("doc_id"), source.isNull().alias("no_name"), F.coalesce(source, F.lit("")).alias("name"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(doc_id.cast("string"), text).alias("hash"), *more)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(no_name, name, id, weight, source_size, target)`` of each source, from rows with ``size``.

    A target is ``level * weight`` or ``most`` times the source's words, the
    smaller; each round of one sum raises the level until no target changes.
    """
    sums = sizes.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    place = F.col("position") - 1
    sources = stored(numbered(sums, *SOURCE).select(
        *SOURCE, place.alias("id"), F.array(*map(F.lit, weights))[(place % len(weights)).cast("int")].cast("long").alias("weight"),
        "source_size"))
    most_of = F.col("source_size") * most
    level, capped = 0.0, -1
    while True:
        over = F.lit(False) if capped < 0 else most_of <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("all"), F.count_if(over).alias("capped"),
            F.sum(F.when(over, most_of)).alias("given"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if row.all is None or row.weight is None or row.capped == capped:
            break
        capped, level = row.capped, (row.all - (row.given or 0)) / row.weight
    return sources.withColumn("target", F.least(most_of.cast("double"), F.lit(level) * F.col("weight")))


# --- the mix ------------------------------------------------------------------

def _position(block: Column, epoch: Column, blocks: Column, seed: int) -> Column:
    """A block's place in its source's permutation of an epoch."""
    times = F.array(*[F.lit(m).cast("long") for m in MULTIPLIERS])[epoch.cast("int")]
    return F.pmod(block * times + F.pmod(F.xxhash64(F.lit(seed), F.col("id"), epoch), blocks), blocks)


class Mix:
    """A mix of all rows of a table: targets, blocks drawn, shards."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
                 block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED,
                 id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        if not 1 <= most < len(MULTIPLIERS):
            raise ValueError(f"most is 1 to {len(MULTIPLIERS) - 1}")
        self.docs, self.columns, self.seed = docs, (id_col, text_col, source_col), seed
        self.sized = stored(_counted(docs, *self.columns))
        sources = source_targets(self.sized, weights, most)
        quota = F.least(F.floor("target"), F.col("source_size") * most)
        full = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0).cast("long")
        self.sources = stored(
            sources.withColumn("quota", quota).withColumn("full", full)
            .withColumn("rest", F.col("quota") - F.col("full") * F.col("source_size"))
            .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")))
        placed = self._placed(self.sized)
        blocks = stored(placed.where("size > 0").groupBy("id", "block", "blocks", "full", "rest").agg(F.sum("size").alias("words")))
        ends = stored(self._ends(blocks))
        self.parts = stored(self._parts(placed, ends))
        draws = self.sources.join(ends.select("id", "position"), "id", "left").select(
            "id", (F.col("full") * F.col("blocks") + F.coalesce(F.col("position") + 1, F.lit(0))).alias("n"))
        words = self.sources.agg(F.sum("quota")).first()[0] or 0
        self.shards = max(1, -(-words // shard_words))
        self.tree = stored(splitting_tree(draws, self.shards, seed))
        self.taken = stored(self._taken(blocks, ends))

    def _placed(self, counted: DataFrame) -> DataFrame:
        """Rows with their source's numbers and their block."""
        return lookup(counted, self.sources, SOURCE).withColumn("block", F.pmod(F.col("hash"), F.col("blocks")))

    def _ends(self, blocks: DataFrame) -> DataFrame:
        """``(id, block, position, words)``: the block in which a source's last epoch ends, and the words it gives.

        Sums of spans of blocks come first, so that no window is longer than a span or the number of spans.
        """
        own = blocks.where("rest > 0").withColumn("position", _position(F.col("block"), F.col("full"), F.col("blocks"), self.seed))
        spanned = own.withColumn("span", F.expr(f"position div {SPAN}"))

        def first_over(rows, order):
            """The row where the running sum passes ``rest``, which becomes what that row still gives."""
            before = F.sum("words").over(Window.partitionBy("id").orderBy(order)) - F.col("words")
            return rows.withColumn("before", before).where("before < rest AND rest <= before + words").withColumn(
                "rest", F.col("rest") - F.col("before")).drop("before")

        spans = first_over(spanned.groupBy("id", "span", "rest").agg(F.sum("words").alias("words")), "span")
        inside = spanned.drop("rest").join(spans.select("id", "span", "rest"), ["id", "span"])
        return first_over(inside, "position").select("id", "block", "position", F.col("rest").alias("words"))

    def _parts(self, placed: DataFrame, ends: DataFrame) -> DataFrame:
        """``(id, hash, size, part)``: words that each document of a last block gives, where any."""
        own = lookup(placed.where("size > 0"), ends.select("id", "block", F.col("words").alias("left")), ["id", "block"])
        same = own.groupBy("id", "hash", "size", "left").agg(F.count("*").alias("rows"))
        words = F.col("size") * F.col("rows")
        before = F.sum(words).over(Window.partitionBy("id").orderBy("hash", "size")) - words
        each = F.floor(F.greatest(F.lit(0), F.least(words, F.col("left") - before)) / F.col("rows"))
        return same.select("id", "hash", "size", each.alias("part")).where("part > 0")

    def _taken(self, blocks: DataFrame, ends: DataFrame) -> DataFrame:
        """``(id, block, draws)``: a block's draws, their shards, and whether the source ends in them."""
        epochs = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "full")))
        place = _position(F.col("block"), F.col("epoch"), F.col("blocks"), self.seed)
        drawn = epochs.withColumn("draw", F.col("epoch") * F.col("blocks") + place).select("id", "block", "draw", "epoch", "full")
        dealt = self.tree.select("id", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("draw"))
        ended = ends.select("id", "block", F.lit(True).alias("ended"))
        found = drawn.join(dealt, ["id", "draw"]).join(ended, ["id", "block"], "left")
        last = F.coalesce("ended", F.lit(False)) & (F.col("epoch") == F.col("full"))
        return found.groupBy("id", "block").agg(
            F.array_sort(F.collect_list(F.struct("draw", "shard", last.alias("last")))).alias("draws"))

    def _drawn(self, counted: DataFrame) -> DataFrame:
        """Rows with ``draws``: draw, shard and the words taken in it; none where nothing is taken."""
        placed = lookup(self._placed(counted), self.taken, ["id", "block"], "left")
        placed = lookup(placed, self.parts, ["id", "hash", "size"], "left")
        words = lambda d: F.when(d["last"], F.coalesce("part", F.lit(0))).otherwise(F.col("size")).cast("long")
        told = F.transform("draws", lambda d: F.struct(d["draw"].alias("draw"), d["shard"].alias("shard"), words(d).alias("words")))
        some = F.filter(told, lambda d: d["words"] > 0)
        return placed.withColumn("draws", F.coalesce(some, F.array().cast("array<struct<draw: long, shard: long, words: long>>")))

    def documents(self) -> DataFrame:
        """``(doc_id, size, source_size, target, taken, draws)`` of every row."""
        taken = F.aggregate("draws", F.lit(0).cast("long"), lambda total, d: total + d["words"])
        return self._drawn(self.sized).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")

    def rows(self) -> DataFrame:
        """``(shard, draw, words, row)``: the mix itself, a partition holding whole shards in shuffled order.

        ``row`` is the input row; of a document taken in part its text ends with
        the last of its ``words``. A shard has about ``shard_words`` words.
        """
        _, text_col, _ = self.columns
        whole = F.struct(*[self.docs[quoted(c)] for c in self.docs.columns]).alias("row")
        drawn = self._drawn(_counted(self.docs, *self.columns, whole)).select("size", "hash", "row", F.inline("draws"))
        kept = F.regexp_extract_all(F.col("row").getField(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
        begun = F.array_join(F.slice(kept, F.lit(1), F.col("words").cast("int")), "")
        text = F.when(F.col("words") < F.col("size"), begun).otherwise(F.col("row").getField(text_col))
        fields = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in self.docs.columns]
        mixed = F.xxhash64(F.lit(self.seed), "shard", "draw", "hash")
        dealt = drawn.select("shard", "draw", "words", mixed.alias("mixed"), F.struct(*fields).alias("row"))
        return dealt.repartition("shard").sortWithinPartitions("shard", "mixed", "draw").drop("mixed")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """What a mix takes of each document; options are those of ``Mix``."""
    return Mix(docs, **options).documents()
