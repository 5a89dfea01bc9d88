"""N-gram Jaccard join with set-relation skipping.

Sets are the distinct word n-grams of the documents, as 64-bit hashes. Equal
sets are one class with a number and the smallest doc_id as its lead; only
classes are joined, so rows that repeat an id with other texts keep their own
sets.

Index: inverted lists of the sets' prefixes. In one global token order, two sets
with Jaccard similarity t share a token among the first n - ceil(t n) + 1 of
each. The order puts rare tokens first: tokens below a hash bound are counted
over the whole corpus and ordered by that count (tokens of one document first),
the others follow in hash order. Counting goes by blocks of documents: a block
sends every hash range its distinct tokens once and gets their frequencies back. Any fixed order gives the same links; this one leaves most documents
without any shared prefix token.

Index-level skipping: a list entry holds the set's size and the token's position
in it. Entries are grouped into blocks by size class, and a block only meets
blocks of the same and the next class; inside, a pair is skipped if the tokens
left after the two positions cannot make up the needed overlap.

Answer-level skipping: each list block has a pivot, its first set. Overlaps with
the pivot are computed first. For two sets y, z of the block they bound the
overlap of y and z: at most the pivot's overlap with z and what y has beside the
pivot. Pairs below the needed overlap are skipped, and so are pairs whose sets
the links found so far connect already, since components are asked for. Where a
list still holds several groups, other sets of it, drawn by hash, are pivots in
turn, and a set is compared with one pivot of each group that it met. A group of
near copies thus costs a few comparisons a set, not all pairs.

A pair that shares many prefix tokens would be met in as many lists. An entry
holds the tokens just before its own in the set's order, and a pair that has one
of them in common was met, and judged, in that token's list or in an earlier one.

Pairs are also skipped by a small sketch of each set, the parities of its tokens in
hash buckets: linked sets cannot differ in more bits than they may differ in
tokens. Nothing of this loses a link; what is left is compared
exactly on the full sets.

Defined results: null and empty texts and texts without words have an empty
set, which links with nothing; a text with fewer than n words has its whole
sequence as one shingle; a null ``doc_id`` links with nothing and has no
component; rows that repeat an id are one node, which joins the classes of
all its texts; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` of a text's word hashes."""
    if not len(h):
        return h
    m = min(n, len(h))
    runs = len(h) - m + 1
    out = np.full(runs, np.uint64(m), np.uint64)
    for j in range(m):
        out = tk.mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + runs])
    return np.unique(out)


def _signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = tk.mix(s + np.uint64(1)).sum(dtype=np.uint64), tk.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _parities(s: np.ndarray) -> list[int]:
    """Whether each of 512 hash buckets of a set holds an odd number: two sets
    differ in at least as many tokens as their parities differ in bits."""
    odd = np.bincount((s >> np.uint64(20) & np.uint64(64 * _SKETCH - 1)).astype(np.int64), minlength=64 * _SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _sets(batch, table, n: int):
    """Shingle sets of a batch, document by document."""
    buf, off = tk.text_buffer(batch.column("text"))
    h, rows, _ = tk.words_by_row(buf, off, table)
    for i in range(len(rows) - 1):
        yield shingle_set(h[rows[i]:rows[i + 1]], n)


BLOCK = ("block long, doc_ids array<long>, text_hash array<long>, n array<int>, sig_a array<long>, sig_b array<long>, "
         "sketch array<array<long>>, counted binary, offsets binary, tokens binary")
_SKETCH = 8  # words of 64 bits
HEAD = 3  # tokens of a list entry's head
TURNS = 2  # of further pivots


def _blocks(table, n: int, keep: Fraction, bound: int, block_bytes: int):
    """One row for a run of documents: ids, set sizes and signatures, and each
    set's tokens that can matter, in hash order: the counted ones (below
    ``bound``) and as many more as its prefix needs."""

    def run(batches):
        import pyarrow as pa

        cols, size = [], 0

        def row():
            off = np.r_[0, np.cumsum([len(c[5]) for c in cols])]  # c[7]: hash of the text
            one = lambda i, t: pa.array([[c[i] for c in cols]], pa.list_(t))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([0], pa.int64()), "doc_ids": one(0, pa.int64()), "text_hash": one(7, pa.int64()), "n": one(1, pa.int32()),
                "sig_a": one(2, pa.int64()), "sig_b": one(3, pa.int64()), "sketch": one(4, pa.list_(pa.int64())),
                "counted": pa.array([np.array([c[6] for c in cols], np.int32).tobytes()], pa.binary()),
                "offsets": pa.array([off.astype(np.int64).tobytes()], pa.binary()),
                "tokens": pa.array([np.concatenate([c[5] for c in cols]).tobytes()], pa.binary())})

        for batch in batches:
            for part in tk.slices(batch, "text", 1 << 20):
                ids, hashes = part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist()
                for i, t, s in zip(ids, hashes, _sets(part, table, n), strict=True):
                    r = int(np.searchsorted(s, np.uint64(bound)))
                    prefix = len(s) - math.ceil(keep * len(s)) + 1 if len(s) else 0
                    cols.append((i, len(s), *_signature(s), _parities(s), s[:max(r, prefix)], r, t))
                size += tk.text_buffer(part.column("text"))[1][-1]
                if size >= block_bytes:
                    yield row()
                    cols, size = [], 0
        if cols:
            yield row()

    return run


def _frequencies(blocks: DataFrame, keys_per_range: int) -> DataFrame:
    """(block, answers): for every block the corpus document frequency of its
    distinct tokens, by hash range. A block sends each token once."""
    total = blocks.agg(F.sum(F.length("tokens"))).head()[0] or 0
    ranges = max(1, -(-(total // 8) // keys_per_range))

    def deal(batches):
        import pyarrow as pa

        edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                keys, n = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
                cut = np.r_[0, np.searchsorted(keys, edges), len(keys)]
                full = [i for i in range(ranges) if cut[i + 1] > cut[i]]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int64()),
                    "keys": pa.array([keys[cut[i]:cut[i + 1]].tobytes() for i in full], pa.binary()),
                    "n": pa.array([n[cut[i]:cut[i + 1]].astype(np.int32).tobytes() for i in full], pa.binary())})

    def add_up(pdf):
        keys = [np.frombuffer(k, np.uint64) for k in pdf["keys"]]
        n = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["n"]])
        _, group = np.unique(np.concatenate(keys), return_inverse=True)
        df = np.minimum(np.bincount(group, weights=n), 65535).astype(np.uint16)[group]
        out = pdf[["block", "part"]].copy()
        out["df"] = [x.tobytes() for x in np.split(df, np.cumsum([len(k) for k in keys])[:-1])]
        return out

    return (blocks.select("block", "tokens").mapInArrow(deal, "part int, block long, keys binary, n binary")
            .groupBy("part").applyInPandas(add_up, "block long, part int, df binary")
            .groupBy("block").agg(F.collect_list(F.struct("part", "df")).alias("answers")))


def _prefix_entries(keep: Fraction):
    """List entries (token, block, at, n, pos, head) of the shared tokens in the
    prefixes; ``at``: the set's place in its block, ``head``: the set's tokens just
    before, ``HEAD`` at most."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in tk.rows(batch):
                tok = np.frombuffer(row["tokens"], np.uint64)
                counted, off = np.frombuffer(row["counted"], np.int32), np.frombuffer(row["offsets"], np.int64)
                _, back = np.unique(tok, return_inverse=True)
                df = np.concatenate([np.frombuffer(a["df"], np.uint16) for a in sorted(row["answers"], key=lambda a: a["part"])])[back]
                size = np.array(row["n"], np.int64)
                prefix = size - np.array([math.ceil(keep * int(x)) for x in size], np.int64) + 1
                doc = np.repeat(np.arange(len(size)), np.diff(off))
                at = np.arange(len(tok)) - off[doc]
                own = (df > 1) & np.array([x is not None for x in row["doc_ids"]])[doc]
                first = np.flatnonzero(own & (at < counted[doc]))
                # Counted tokens: rare ones first; those that no other document has lead.
                order = first[np.lexsort((tok[first], df[first], doc[first]))]
                shared = np.bincount(doc[first], minlength=len(size))
                start = np.r_[0, np.cumsum(shared)][:-1]
                d = doc[order]
                pos = counted[d] - shared[d] + np.arange(len(order)) - start[d] + 1
                more = np.flatnonzero(own & (at >= counted[doc]))
                entry, pos = np.r_[order, more], np.r_[pos, at[more] + 1]
                ok = pos <= prefix[doc[entry]]
                entry, pos = entry[ok], pos[ok]
                by = np.lexsort((pos, doc[entry]))
                entry, pos = entry[by], pos[by]
                of = doc[entry]
                nth = np.arange(len(entry)) - np.searchsorted(of, of)
                before = np.minimum(nth, HEAD)
                ends = np.r_[0, np.cumsum(before)]
                heads = tok[entry][np.arange(ends[-1]) + np.repeat(np.arange(len(entry)) - before - ends[:-1], before)]
                yield pa.RecordBatch.from_pydict({
                    "token": pa.array(tk.signed(tok[entry])), "block": pa.array(np.full(len(entry), row["block"], np.int64)),
                    "at": pa.array(of.astype(np.int32)),
                    "n": pa.array(size[doc[entry]].astype(np.int32)), "pos": pa.array(pos.astype(np.int32)),
                    "head": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tk.signed(heads)))})

    return run


def _wanted_sets(table, n: int, bits):
    """Sets of the documents whose id passes a filter of fixed size."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(pa.array(tk.in_filter(bits.value, batch.column("slot"))))
            for part in tk.slices(batch, "text", 1 << 20):
                sets = list(_sets(part, table, n))
                yield pa.RecordBatch.from_pydict({
                    "lead": part.column("doc_id"), "sig_a": pa.array([_signature(s)[0] for s in sets], pa.int64()),
                    "set": pa.array([tk.signed(s) for s in sets], pa.list_(pa.int64()))})

    return run


def _verify(pairs: DataFrame, sets: DataFrame, keep: Fraction) -> DataFrame:
    """(a, b, overlap, linked) of candidate pairs, on the full sets. Only sets of
    pairs are shuffled: the written pairs have a known size, so few are broadcast."""
    pairs = tk.cut_lineage(pairs, "pairs")
    one = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")).join(pairs, "a")
    other = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")).join(pairs, "b")
    both = one.join(other, ["a", "b"]).select(
        "a", "b", F.size("set_a").alias("na"), F.size("set_b").alias("nb"),
        F.size(F.array_intersect("set_a", "set_b")).alias("overlap"))
    linked = F.col("overlap") * keep.denominator >= (F.col("na") + F.col("nb") - F.col("overlap")) * keep.numerator
    return both.select("a", "b", "overlap", linked.alias("linked"))


def _groups(docs: DataFrame, n: int, keep: Fraction, table, block_bytes: int, keys_per_range: int, merge_ids: bool
            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with the signature of their class; classes with their lead and group
    ``g``; ids of several classes). ``merge_ids``: the classes of an id are one group."""
    num, den = keep.numerator, keep.denominator
    spark = docs.sparkSession
    src = tk.documents(docs).withColumn("text_hash", F.xxhash64("text"))
    bound = int((1 << 64) * min(Fraction(49, 100), Fraction(3, 2) * (1 - keep)))
    blocks = src.mapInArrow(_blocks(table, n, keep, bound, block_bytes), BLOCK)
    blocks = tk.cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()), "set_blocks")
    with_sketch = (blocks.select("block", F.posexplode(F.arrays_zip("doc_ids", "text_hash", "n", "sig_a", "sig_b", "sketch")).alias("at", "s"))
                .select("block", "at", F.col("s.doc_ids").alias("doc_id"), "s.text_hash", "s.n", "s.sig_a", "s.sig_b", "s.sketch"))
    all_sets = tk.cut_lineage(with_sketch.drop("sketch"), "rows")
    sig = ["sig_a", "sig_b", "n"]
    reps = tk.cut_lineage(with_sketch.where("n > 0 and doc_id is not null").groupBy(*sig).agg(
        F.min(F.struct("doc_id", "block", "at")).alias("first"), F.min("sketch").alias("sketch"))
        .select(*sig, "sketch", F.col("first.doc_id").alias("lead"), "first.block", "first.at", F.monotonically_increasing_id().alias("rep")), "reps")
    # Ids that repeat with different sets, and the classes of those.
    several = (all_sets.where("doc_id is not null").select("doc_id", F.struct(*sig).alias("s")).groupBy("doc_id")
               .agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("doc_id"))
    shared = tk.cut_lineage(all_sets.select("doc_id", *sig).join(several, "doc_id").join(reps.select(*sig, "rep"), sig)
                            .select("doc_id", "rep").distinct(), "shared_ids")
    joined = shared.join(shared.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b"))
    if not merge_ids:
        joined = joined.where("false")
    # Size class: sets whose sizes differ by less than the threshold are in the same or the next class.
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("int")
    # A class enters with the set of its first row, so no entry comes twice.
    entries = (blocks.select("block", "doc_ids", "n", "counted", "offsets", "tokens")
               .join(_frequencies(blocks, keys_per_range), "block")
               .mapInArrow(_prefix_entries(keep), "token long, block long, at int, n int, pos int, head array<long>")
               .join(reps.select("block", "at", "rep"), ["block", "at"]).select("token", "rep", "n", "pos", "head"))
    every = tk.cut_lineage(entries.withColumn("cls", size_class), "entries")
    crowded = every.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    lists = tk.cut_lineage(every.join(crowded, "token", "left_semi"), "lists")
    tk.discard(every)
    tk.discard(blocks)
    involved = tk.cut_lineage(reps.select("rep", "lead", "sig_a", "n").join(lists.select("rep").distinct(), "rep"), "involved")
    bits = spark.sparkContext.broadcast(tk.id_filter(involved.select(F.xxhash64("lead").alias("h"))))
    sets = tk.cut_lineage(
        src.where("doc_id is not null").select("doc_id", "text", tk.slot(F.xxhash64("doc_id")).alias("slot"))
        .mapInArrow(_wanted_sets(table, n, bits), "lead long, sig_a long, set array<long>").withColumn("n", F.size("set"))
        .join(involved, ["lead", "sig_a", "n"]).groupBy("rep").agg(F.first("set").alias("set")), "full_sets")

    def enough(na: str, pa: str, nb: str, pb: str) -> F.Column:
        """Size filter, and the bound from the positions in the two sets."""
        need = f"ceil(({na} + {nb}) * {num} / {num + den}.0D - 1e-9)"
        return F.expr(f"least({na}, {nb}) * {den} >= greatest({na}, {nb}) * {num} "
                      f"and 1 + least({na} - {pa}, {nb} - {pb}) >= {need}")

    # First the pivots: one comparison for every set of a list block.
    pivots = lists.groupBy("token", "cls").agg(F.min_by(F.struct("rep", "n", "pos"), "rep").alias("p"))
    led = lists.join(pivots, ["token", "cls"]).select("token", "cls", "rep", "n", "pos", "head", F.col("p.rep").alias("pivot"),
                                                      F.col("p.n").alias("pn"), F.col("p.pos").alias("pp"))
    first = (led.where((F.col("rep") != F.col("pivot")) & enough("n", "pos", "pn", "pp"))
             .select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    known = tk.cut_lineage(_verify(first, sets, keep), "pivot_pairs")
    groups = tk.connected_components(known.where("linked").select("a", "b").union(joined.where("a <> b")))
    # What two linked sets may differ in, against what their sketches say at least.
    apart = " + ".join(f"bit_count(y_sketch[{i}] ^ z_sketch[{i}])" for i in range(_SKETCH))
    alike = F.expr(f"coalesce(({apart}) * {num + den} <= (y_n + z_n) * {den - num}, true)")
    judged = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Further pivots, for lists of several groups; a size class meets the next one in one of two turns.
    for turn in range(TURNS):
        member = (lists.join(groups.withColumnRenamed("id", "rep"), "rep", "left")
                  .withColumn("group", F.coalesce("component", "rep")).withColumn("band", F.floor((F.col("cls") + turn) / 2)))
        drawn = (member.groupBy("token", "band").agg(
            F.min_by(F.struct("rep", "n", "pos", "group"), F.xxhash64("token", "rep", F.lit(turn))).alias("p"),
            F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi")
            .select("token", "band", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.pos").alias("pp"), F.col("p.group").alias("pg")))
        met = (member.join(drawn, ["token", "band"]).where((F.col("group") != F.col("pg")) & enough("n", "pos", "pn", "pp"))
               .groupBy("rep", "pg").agg(F.min("pivot").alias("pivot")))
        sketches = reps.select("rep", "n", "sketch")
        pairs = (met.join(sketches.toDF("rep", "y_n", "y_sketch"), "rep").join(sketches.toDF("pivot", "z_n", "z_sketch"), "pivot").where(alike)
                 .select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
                 .join(judged, ["a", "b"], "left_anti"))
        tested = tk.cut_lineage(_verify(pairs, sets, keep).select("a", "b", "linked"), "more_pairs")
        judged = judged.union(tested.select("a", "b"))
        groups = tk.connected_components(groups.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
                                         .union(tested.where("linked").select("a", "b")))
    # Then what the pivots leave open: pairs of a list that are not connected yet.
    open_ = (led.join(groups.withColumnRenamed("id", "rep"), "rep", "left")
             .withColumn("group", F.coalesce("component", "rep")).drop("component"))
    mixed = open_.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("token")
    overlaps = known.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), "overlap")
    answers = (open_.join(mixed, "token", "left_semi").join(overlaps, ["pivot", "rep"], "left")
               .withColumn("o", F.when(F.col("rep") == F.col("pivot"), F.col("n")).otherwise(F.col("overlap")))
               .select("token", "cls", "rep", "n", "pos", "head", "pivot", "o", "group")
               .join(reps.select("rep", "sketch"), "rep"))
    answers = tk.cut_lineage(answers, "answers")
    y = answers.select("token", *[F.col(c).alias(f"y_{c}") for c in ("cls", "rep", "n", "pos", "head", "pivot", "o", "group", "sketch")],
                       F.explode(F.array(F.col("cls"), F.col("cls") + 1)).alias("block"))
    z = answers.select("token", F.col("cls").alias("block"),
                       *[F.col(c).alias(f"z_{c}") for c in ("rep", "n", "pos", "head", "pivot", "o", "group", "sketch")])
    need = f"ceil((y_n + z_n) * {num} / {num + den}.0D - 1e-9)"
    bounded = F.expr(f"y_pivot <> z_pivot or coalesce(least(z_o + y_n - y_o, y_o + z_n - z_o) >= {need}, true)")
    once = F.expr("y_cls < block or y_rep < z_rep")
    rest = (y.join(z, ["token", "block"]).where(F.expr("y_group <> z_group and not arrays_overlap(y_head, z_head)") & once & enough("y_n", "y_pos", "z_n", "z_pos") & alike & bounded)
            .select(F.least("y_rep", "z_rep").alias("a"), F.greatest("y_rep", "z_rep").alias("b")).distinct()
            .join(judged, ["a", "b"], "left_anti"))
    late = tk.cut_lineage(_verify(rest, sets, keep).where("linked"), "late_pairs")
    # Join the groups that late links connect.
    named = groups.withColumnRenamed("component", "g")
    over = (late.join(named.withColumnRenamed("id", "a").withColumnRenamed("g", "ga"), "a", "left")
            .join(named.withColumnRenamed("id", "b").withColumnRenamed("g", "gb"), "b", "left")
            .select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")))
    merged = tk.connected_components(over)
    of_rep = (reps.select(*sig, "rep", "lead").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
              .withColumn("g", F.coalesce("component", "rep")).drop("component")
              .join(merged.withColumnRenamed("id", "g"), "g", "left")
              .select(*sig, "rep", "lead", F.coalesce("component", "g").alias("g")))
    of_rep = tk.cut_lineage(of_rep, "grouped")
    return all_sets, of_rep, shared


def jaccard_components(docs: DataFrame, n: int = 3, keep: Fraction = Fraction(9, 10), table=tk.SPACED,
                       block_bytes: int = 4 << 20, keys_per_range: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of
    similarity ``keep`` or more) of every document."""
    all_sets, of_rep, shared = _groups(docs, n, keep, table, block_bytes, keys_per_range, merge_ids=True)
    sig = ["sig_a", "sig_b", "n"]
    of_rep = of_rep.join(of_rep.groupBy("g").agg(F.min("lead").alias("component_id")), "g").select(*sig, "rep", "component_id")
    # A row without words has no class; if its id has one in another row, that counts.
    of_id = shared.join(of_rep.select("rep", "component_id"), "rep").groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
    return (all_sets.select("doc_id", *sig).join(of_rep.drop("rep"), sig, "left").join(of_id, "doc_id", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "of_id", "doc_id")).alias("component_id")))


def first_of_groups(docs: DataFrame, n: int = 5, keep: Fraction = Fraction(4, 5), table=tk.SPACED,
                    block_bytes: int = 4 << 20, keys_per_range: int = 500_000) -> DataFrame:
    """(doc_id, text_hash) of the texts that stay when one of each group of linked
    texts does: the one with the smallest id, of that id's the one with the
    smallest hash (xxhash64). Rows are judged by their own text: where an id
    repeats with several texts, a text goes only if a text like it stays. A text
    without words stays; rows without an id are left out."""
    all_sets, of_rep, _ = _groups(docs, n, keep, table, block_bytes, keys_per_range, merge_ids=False)
    sig = ["sig_a", "sig_b", "n"]
    rows = all_sets.where("doc_id is not null")
    grouped = rows.join(of_rep.select(*sig, "g"), sig)
    first = grouped.groupBy("g").agg(F.min(F.struct("doc_id", "text_hash")).alias("s")).select("s.*")
    return first.unionByName(rows.where("n = 0").select("doc_id", "text_hash")).distinct()
