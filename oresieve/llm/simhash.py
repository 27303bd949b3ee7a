"""SimHash near-duplicates, found by covering locality-sensitive hashing: no pair inside the radius is missed."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import connected_components
from .shared import Scratch, named, small_batches

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Fingerprints of the largest bucket that is compared pair by pair; a larger one goes the way of one-bit neighbours.
PAIRWISE = 48
#: Text bytes in one numpy pass, and in one run of a longer text's words.
PASS_BYTES = 1_000_000
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """Masks of which, for any `radius` places, one keeps none of them: fingerprints that differ only there agree under it.

    Each bit gets a vector of radius + 1 bits, not null and dealt out in turn; the mask of a vector v keeps the bits whose
    vector has an odd product with v. `radius` vectors span less than the whole space, so some v other than null has an even
    product with all of them. There are 2^(radius + 1) - 1 masks, and each keeps just over half of the bits.
    """
    space = 1 << (radius + 1)
    return [sum(1 << i for i in range(bits) if ((i % (space - 1) + 1) & v).bit_count() % 2) for v in range(1, space)]


def _runs(text: bytes, size: int):
    """A text's words in runs of about `size` bytes, each behind the last words of the run before, so that every shingle is in one run."""
    at, behind = 0, []
    while at < len(text) or not at:
        cut = WHITE.search(text, at + size) if len(text) - at > size else None
        end = cut.start() if cut else len(text)
        words = behind + text[at:end].split()
        yield words
        if not cut:
            return
        at, behind = end, words[1 - SHINGLE :]


def _fingerprint(text: str, size: int = PASS_BYTES) -> int:
    """The 64-bit fingerprint of a text; beside the text, a run's words and shingles are held."""
    ones, n, words = np.zeros(BITS, np.int64), 0, []
    for words in _runs(text.encode().lower(), size):
        if len(words) < SHINGLE:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
        shingles = [joined[a : b - 1] for a, b in zip([0, *ends], ends[SHINGLE - 1 :], strict=False)]
        h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    if not n:
        return xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", name: str = "fp") -> DataFrame:
    """The columns `keep` and each whole text's fingerprint as a long.

    A-Z are lower-cased; words are runs of anything but space and U+0009 to U+000D; a bit is set if it is set in over half of
    the XXH64 values (UTF-8, seed 42) of the 3-word shingles, repeats included. Fewer words: the whole sequence is the one
    shingle; none, or a null text: zero. No shuffle. A long text's words are taken in runs, so that its list of shingles is never whole.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep)).fill_null("")
            fps = np.array([_fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps, pa.int64())], names=[*keep, name])

    schema = docs.select(*keep).schema.add(name, "long", False)
    return docs.select(*keep, F.col(text).alias(named(f"{text}_read", keep))).mapInArrow(run, schema)


def links(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, name: str = "fp") -> DataFrame:
    """Edges (a, b) that join every two different fingerprints with at most `radius` differing bits, directly or through
    steps that are such links themselves.

    fps: distinct fingerprints. Each goes under every mask to a bucket; buckets of one are dropped. In a bucket of up to
    PAIRWISE the pairs are compared. For a larger one, and radius 2, each member gives all values one bit away (65 rows, whatever the
    bucket's size): two fingerprints are within 2 bits just if they share such a value, and at most 65 share one, which
    are then linked to their least. Members of one such set are within 2 bits of each other, so each edge is a true link.
    """
    if radius != 2:
        raise ValueError("large buckets are exact for radius 2")
    f = F.col(name)
    masks = [F.struct(F.lit(k).alias("t"), f.bitwiseAND(F.lit(_signed(m))).alias("k")) for k, m in enumerate(covering_masks(BITS, radius))]
    rows = fps.select(f.alias("f"), F.explode(F.array(*masks)).alias("m")).select("f", "m.t", "m.k")
    sizes = scratch.keep(rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    hit = scratch.keep(rows.join(sizes, ["t", "k"]), "members")
    small = hit.where(F.col("n") <= PAIRWISE)
    x, y = small.alias("x"), small.alias("y")
    near = F.bit_count(F.col("x.f").bitwiseXOR(F.col("y.f"))) <= radius
    pairs = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.f") < F.col("y.f")) & near)
    pairs = pairs.select(F.col("x.f").alias("a"), F.col("y.f").alias("b"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(BITS)))
    large = hit.where(F.col("n") > PAIRWISE).select("f").distinct()
    ball = large.select("f", F.explode(F.transform(flips, lambda d: F.col("f").bitwiseXOR(d))).alias("c"))
    sets = ball.groupBy("c").agg(F.collect_set("f").alias("s")).where(F.size("s") > 1)
    stars = sets.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).where("a != b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns (doc_id, fp, component_id) for each row: the smallest doc_id that links of at most 2 bits reach, itself included.

    Equal fingerprints are one node, so that copies are never paired. Rows of one doc_id share what the smallest reaches by
    each fingerprint. A row without doc_id links with nothing and has no component. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.keep(fingerprints(docs, [doc_id], text), "fingerprints")
    nodes = scratch.keep(fps.where(F.col(doc_id).isNotNull()).groupBy("fp").agg(F.min(doc_id).alias("least")), "nodes")
    found = connected_components(links(nodes, scratch), scratch)
    grouped = scratch.keep(nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "grouped")
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.keep(grouped.join(least, "component").select(F.col("fp").alias("node"), "component_id"), "named")
    group = F.when(F.col(doc_id).isNotNull(), F.col("component_id")).alias("component_id")
    return fps.join(named, fps.fp == named.node, "left").select(doc_id, "fp", group)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest doc_id, with the input's columns.

    Rows that go are fewer than rows that stay, so these are what the documents are joined against; texts are shuffled only if that list is
    too long to broadcast. Rows that share a doc_id are few and go their own way: of those that lead their group one stays in
    each, the least by a hash of all columns. Rows without doc_id all stay, as nothing groups them.
    """
    scratch = Scratch(docs.sparkSession)
    groups = scratch.keep(near_duplicates(docs, doc_id, text), "groups")
    ids = groups.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("lead")).agg(F.count(F.lit(1)).alias("rows"), F.min("component_id").alias("c"))
    marked = scratch.keep(ids.where("rows > 1 or lead <> c").select("lead", (F.col("rows") > 1).alias("several")), "marked")
    kept = docs.join(marked, docs[doc_id] == marked.lead, "left_anti")
    several = marked.where("several").select("lead")
    if several.isEmpty():
        return kept
    fp, group = named("fp", docs.columns), named("component", docs.columns)
    rows = docs.join(several, docs[doc_id] == several.lead, "left_semi")
    rows = fingerprints(rows, docs.columns, text, fp)
    g_fp = named("g_fp", docs.columns)
    leads = groups.where(F.col(doc_id) == F.col("component_id")).select(F.col("fp").alias(g_fp), F.col("component_id").alias(group)).distinct()
    rows = rows.join(leads, (rows[fp] == leads[g_fp]) & (rows[doc_id] == leads[group]))
    one = rows.groupBy(group).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return kept.unionByName(one.select(*docs.columns))
