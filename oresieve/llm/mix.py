"""Mixing sources to target weights, in DataFrame operations only.

Documents of a source stand in the order of a key that is random by hash. A source takes whole epochs while they fit its target, and of
the last one the documents before a cut. The order is cut into ranges; prefix sums over their sizes find the range that the budget ends
in, which is sorted and summed in the same way, until a single document is left. Only sums of ranges are ever ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WORD, Scratch, named, sized

#: A source is repeated at most so often.
EPOCHS = 3
#: The weights that sources get in turn, by code point, null last.
WEIGHTS = (1, 2, 3)
#: Changes which documents the last, partial epoch takes.
SEED = 9
#: Bytes of a place in the order: the key, then size and a hash of the row, which tell rows of one doc_id apart.
KEY_BYTES, PLACE_BYTES = 16, 32
#: Equal rows that one task writes at once.
RUN = 4096


def word_count(text: str) -> Column:
    """Words of a text as a long; a null text has none. Each word becomes one character, so that no array of words is made."""
    one = F.regexp_replace(F.col(text), WORD + "+", "x")
    return F.coalesce(F.length(F.translate(one, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def running(rows: DataFrame, scratch: Scratch, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Adds to each row the sums of columns over all rows before it in the order, which must be total.

    Rows are range-sorted; the sums of ranges, one row a range, are summed first, then rows inside a range.
    """
    ranged = scratch.keep(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(*(F.sum(c).alias(f"{s}_part") for s, c in sums.items()))
    parts = parts.select("part", *(F.coalesce(F.sum(f"{s}_part").over(ahead), F.lit(0)).alias(f"{s}_part") for s in sums))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(s) for s, c in sums.items()))
    both = rows.join(F.broadcast(parts), "part")
    return both.select(*rows.drop("part", *sums).columns, *((F.col(s) + F.col(f"{s}_part")).alias(s) for s in sums))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Adds to (source, source_size) each source's target: a share of the sum of all sizes by weight, at most epochs times its size.

    The excess of capped sources goes to the others by weight until none is above its cap. That is one pass in the order of
    cap / weight: the first k sources are capped for the least k at which the level of the rest, what is left divided by
    their weights, caps no further one. Both orders are range-sorted, so that many sources are no single task's work; two numbers
    come to the driver. An empty table gives an empty one.
    """
    scratch = Scratch(sizes.sparkSession)
    by_name = F.col("source").asc_nulls_last()
    turns = running(sizes.withColumn("one", F.lit(1).cast("long")), scratch, [by_name], {"turn": "one"}, "names")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("turn", F.lit(len(weights))) + 1).cast("int"))
    ranked = turns.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(epochs))).alias("cap"))
    ranked = ranked.withColumn("full_at", F.col("cap") / F.col("w"))
    level = scratch.keep(running(ranked, scratch, [F.col("full_at"), by_name], {"cap_before": "cap", "w_before": "w"}, "caps"), "levels")
    total, weight = level.agg(F.sum("source_size").cast("double"), F.sum("w")).first()
    if total is None:
        return sizes.withColumn("target", F.lit(0.0))
    left = (F.lit(total) - F.col("cap_before")) / (F.lit(weight) - F.col("w_before"))
    free = level.withColumn("level", left).where(F.col("cap") >= F.col("level") * F.col("w")).agg(F.min(F.struct("full_at", "level"))).first()[0]
    free = F.lit(None if free is None else free["level"]).cast("double")
    return level.select("source", "source_size", F.coalesce(F.least("cap", free * F.col("w")), F.col("cap")).alias("target"))


def _code(source: str) -> Column:
    """A source as a text that is never null, to join by."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _key(doc_id: str, seed: int) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))))


def _place(docs: DataFrame, doc_id: str, text: str, seed: int) -> Column:
    """Where a row stands in its source's order, as bytes. Rows share a place only if they are equal."""
    plain = [f"`{f.name}`" for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    eight = lambda number: F.unhex(F.lpad(F.hex(number), 16, "0"))
    return F.concat(_key(doc_id, seed), eight(word_count(text)), eight(F.xxhash64(*plain)))


def _sizes(docs: DataFrame, doc_id: str, text: str, source: str, seed: int, scratch: Scratch) -> DataFrame:
    """(doc_id, code, source, size, place) of each row: the one scan of the texts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), _code(source).alias("code"), F.col(source).alias("source"), word_count(text).alias("size"), _place(docs, doc_id, text, seed).alias("place"))
    return scratch.keep(rows, "sizes")


def _plan(rows: DataFrame, scratch: Scratch, weights: tuple, epochs: int) -> DataFrame:
    """(code, source_size, target, whole, cut, take, ties): for each source its epochs, and where the last, partial one ends.

    That epoch takes the rows whose place is below the cut, and `take` of the `ties` rows whose place begins with it.
    """
    sizes = scratch.keep(rows.groupBy("code").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "sources")
    codes = sizes.select("source", "source_size")
    goals = targets(codes, weights, epochs).withColumn("code", _code("source")).drop("source", "source_size").join(sizes.select("code", "source_size"), "code")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = scratch.keep(goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    n, sources = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    first = max(1, min(4, round(math.log(max(n, 2), 256) / 2)))
    todo = goals.select("code", "rest", F.lit(0).cast("long").alias("base"))
    cuts = None
    for bytes_ in (first, KEY_BYTES, KEY_BYTES + 8, KEY_BYTES + 10, PLACE_BYTES):
        cells = rows.groupBy("code", F.substring("place", 1, bytes_).alias("cell")).agg(F.sum("size").alias("cell_size"), F.count(F.lit(1)).alias("ties"))
        ahead = Window.partitionBy("code").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("inside", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)))
        cells = cells.join(sized(todo, sources), "code").withColumn("start", F.col("base") + F.col("inside"))
        ends = cells.where(F.col("start") + F.col("cell_size") > F.col("rest")).groupBy("code")
        ends = scratch.keep(ends.agg(F.min("cell").alias("cut"), *(F.min_by(c, "cell").alias(c) for c in ("start", "cell_size", "ties", "rest"))), "ends")
        split = (F.col("start") < F.col("rest")) & (F.col("ties") > 1) & F.lit(bytes_ < PLACE_BYTES)
        cuts = ends.where(~split) if cuts is None else cuts.unionByName(ends.where(~split))
        more = ends.where(split)
        if bytes_ == PLACE_BYTES or more.isEmpty():
            break
        todo = more.select("code", "rest", F.col("start").alias("base"))
        wanted = more.select(F.col("code").alias("c_code"), "cut")
        inside = rows.join(sized(wanted, sources), (F.col("code") == F.col("c_code")) & F.startswith("place", "cut"))
        rows = scratch.keep(inside.select("code", "size", "place"), "range")
    each = F.col("cell_size") / F.col("ties")
    fit = F.greatest(F.floor((F.col("rest") - F.col("start")) / each), F.lit(0)).cast("long")
    # a document is taken if the budget ends nearer to its end than to its beginning
    near = (F.col("start") + fit * each.cast("long") + each / 2 <= F.col("rest")).cast("long")
    take = F.when(F.col("start") < F.col("rest"), F.least(fit + near, "ties")).otherwise(0)
    cuts = cuts.select(F.col("code"), "cut", take.alias("take"), "ties")
    return scratch.keep(goals.join(sized(cuts, sources), "code", "left").select("code", "source_size", "target", "whole", "cut", "take", "ties"), "plan")


def _split_run(rows: DataFrame, count: str, take: str) -> DataFrame:
    """Each row `count` times, with `part` 1 for the first `take` and 0 for the rest; long runs are dealt to many tasks."""
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / RUN))))
    chunks = chunks.repartition(F.col("chunk"), F.xxhash64("code"))
    end = F.least(F.col(count), (F.col("chunk") + 1) * RUN) - 1
    single = chunks.withColumn("nth", F.explode(F.sequence(F.col("chunk") * RUN, end)))
    return single.withColumn("part", (F.col("nth") < F.col(take)).cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Returns (doc_id, size, source_size, target, copies, taken): for each row, how often the mix takes it whole.

    All documents of a source are taken as often as whole epochs fit its target. For the rest, documents are ordered by a
    key that is random by hash, and taken up to the document's end that is nearest to the budget.
    Texts are scanned once; sizes and places are written, and all else works on these. Sums are combined on the map side, and one
    task orders about as many ranges as the square root of the rows, however large a source is, and whatever rows share a doc_id.
    Equal rows stay apart and keep their number, some with a copy more if the cut falls among them; a null doc_id is a doc_id, a null
    text has size 0, a null source is a source; an empty table gives an empty one. Nothing depends on the partitioning.
    """
    scratch = Scratch(docs.sparkSession)
    rows = _sizes(docs, doc_id, text, source, seed, scratch)
    plan = _plan(rows, scratch, weights, epochs)
    joined = rows.join(sized(plan, plan.count()), "code")
    tied = F.coalesce(F.startswith("place", "cut"), F.lit(False))
    part = F.when(F.col("place") < F.col("cut"), 1).when(tied, F.col("take")).otherwise(0)
    out = joined.where(~tied | (F.col("ties") == 1)).withColumn("part", part.cast("long"))
    columns = ["doc_id", "size", "source_size", "target", "whole", "part"]
    several = plan.where("ties > 1 and take > 0")
    out, rest = out.select(*columns), joined.where(tied & (F.col("ties") > 1))
    if several.isEmpty():
        out = out.unionByName(rest.withColumn("part", F.lit(0).cast("long")).select(*columns))
    else:
        same = ["code", "doc_id", "size", "source_size", "target", "whole", "take"]
        # the union of both is all rows; equal ones are counted, never gathered
        out = out.unionByName(_split_run(rest.groupBy(*same).agg(F.count(F.lit(1)).alias("n")), "n", "take").select(*columns))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("part")).otherwise(F.col("whole"))
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the input's columns.

    Texts are read twice, once for sizes and once to be written; they are not shuffled, as a row's own key tells on which side of its
    source's cut it is. Only where a cut falls among equal rows are these counted and written anew. Edge rows are as in mix().
    """
    scratch = Scratch(docs.sparkSession)
    plan = _plan(_sizes(docs, doc_id, text, source, seed, scratch), scratch, weights, epochs)
    new = {c: named(c, docs.columns) for c in ("code", "whole", "cut", "take", "ties", "copy")}
    plan = plan.select(*(F.col(c).alias(new[c]) for c in ("code", "whole", "cut", "take", "ties")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    code, whole, cut, take, ties = (F.col(new[c]) for c in ("code", "whole", "cut", "take", "ties"))
    joined = docs.withColumn(new["code"], _code(source)).join(sized(plan, plan.count()), new["code"])
    key, place = _key(doc_id, seed), _place(docs, doc_id, text, seed)
    near = F.substring(cut, 1, KEY_BYTES)
    # a row's size is counted anew only where the keys are equal
    at_cut = F.coalesce(F.when(F.startswith(key, near), F.startswith(place, cut)).otherwise(F.lit(False)), F.lit(False))
    below = F.when(F.startswith(key, near), place < cut).otherwise(key < cut)
    part = F.when(~F.coalesce(F.col(text).rlike(WORD), F.lit(False)), 0).when(F.coalesce(below, F.lit(False)), 1).when(at_cut, F.coalesce(take, F.lit(0))).otherwise(0)
    repeat = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int"))).alias(new["copy"])
    several = not plan.where(take.isNotNull() & (ties > 1) & (take > 0)).isEmpty()
    single = joined.where(~(at_cut & (ties > 1))) if several else joined.withColumn(new["take"], F.when(ties == 1, take).otherwise(0))
    copies = whole + part.cast("long")
    out = single.where(copies > 0).select(*columns, repeat(copies)).select(*columns)
    if not several:
        return out
    group = joined.where(at_cut & (ties > 1)).select(F.struct(*columns).alias("row"), code.alias("code"), whole.alias("whole"), take.alias("take"), place.alias("place"))
    group = group.groupBy("code", "whole", "take", "place").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n"))
    group = _split_run(group, "n", "take").withColumn("copies", F.col("whole") + F.when(F.col("row")[text].rlike(WORD), F.col("part")).otherwise(0))
    return out.unionByName(group.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*"))
