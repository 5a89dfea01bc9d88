"""Exact nearest neighbours by L2 distance, for whole request tables.

The reference searches one request at a time (filter, ORDER BY distance,
LIMIT k). Here a table of requests is matched against the corpus in one job:

* When the corpus passes an explicit size check (rows x width x 8 bytes under
  ``broadcast_bytes``) it is broadcast once per executor as per-key numpy
  matrices, and requests are scored where they are with ``mapInArrow``. No
  shuffle of requests and no pair rows.
* Beyond the size bound the corpus of a key is cut into tiles of about
  ``TILE_BYTES`` and its requests into slices of half that, and every tile
  meets every slice in a sort-based co-group on (key, tile, slice): a task
  holds one tile and streams the slice's requests through numpy. So a request
  is sent once per tile, not once per block, and a group-by per request merges
  at most k x tiles candidates.

Both score alike (:class:`Tile`). The corpus is walked in blocks of at most
``block_rows`` rows. One matrix product of a block and a batch of requests
gives squared distances up to a rounding error with a known bound; only pairs
that could still be among the k best within that bound are measured exactly,
in double precision. The k best are therefore those of a plain scan, ties by
corpus id, and a task's memory is bounded by the tile and the batch, whatever
the size of the tables. Equal vectors have equal distances, so no more than k
of them per key, those with the lowest ids, are searched. All pairs of a key
are looked at: the work grows with requests x corpus rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_distance
from ..errors import DataQualityError
from ..session import cut_lineage, partitions_for

# Size bound for the broadcast route: vectors x width x 8 bytes.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
DEFAULT_BLOCK_ROWS = 4096
TILE_BYTES = 16 * 1024 * 1024  # vectors of a tile, as doubles
PAIRS = 1 << 20                # pairs of a batch and a block
HUGE = 1e300                   # squared lengths from here on are measured exactly


class Tile:
    """Corpus rows of one key: int64 ``ids``, a float64 matrix, and the Arrow
    array ``rows`` of what a hit returns (id, payload)."""

    def __init__(self, ids, mat, rows):
        import numpy as np

        self.ids, self.mat, self.rows = ids, mat, rows
        with np.errstate(all="ignore"):
            sq = (mat ** 2).sum(axis=1)
        self.plain = np.flatnonzero(sq < HUGE)
        self.odd = np.flatnonzero(~(sq < HUGE))
        # (m, |m|^2) . (-2q, 1) = |q - m|^2 - |q|^2
        self.wide = np.c_[mat[self.plain], sq[self.plain]]
        self.longest = float(sq[self.plain].max()) if len(self.plain) else 0.0

    def nearest(self, q, k: int, block_rows: int) -> Iterator[tuple]:
        """(row of ``q``, rank, position in the tile, distance), a batch of rows at a time."""
        import numpy as np

        step = max(1, min(2048, PAIRS // max(1, min(block_rows, len(self.ids)))))
        with np.errstate(all="ignore"):
            for a in range(0, len(q), step):
                row, rank, at, dist = self._batch(q[a:a + step], k, block_rows)
                yield row + a, rank, at, dist

    def _batch(self, q, k: int, block_rows: int) -> tuple:
        import numpy as np

        n, width = q.shape
        best, at = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        length = (q ** 2).sum(axis=1)
        bound = np.full(n, np.inf)  # of |q - m|^2 - |q|^2, for a pair that may be a hit
        slack = 32 * (width + 8) * np.finfo(np.float64).eps * (length + self.longest) + 1e-300

        def meet(r, c) -> None:
            most = max(1, 8 * PAIRS // max(1, width))
            for i in range(0, len(r), most):
                keep(r[i:i + most], c[i:i + most])

        def keep(r, c) -> None:
            """Measure the pairs (r, c) and keep the k best per row."""
            d = np.sqrt(((q[r] - self.mat[c]) ** 2).sum(axis=1))
            good = ~np.isnan(d)
            r, c, d = r[good], c[good], d[good]
            u = np.unique(r)
            old = at[u] >= 0
            r = np.r_[r, np.repeat(u, k).reshape(-1, k)[old]]
            c, d = np.r_[c, at[u][old]], np.r_[d, best[u][old]]
            order = np.lexsort((self.ids[c], d, r))
            r, c, d = r[order], c[order], d[order]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
            rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
            top = rank < k
            best[r[top], rank[top]], at[r[top], rank[top]] = d[top], c[top]
            bound[u] = best[u, k - 1] ** 2 - length[u] + slack[u]

        usual = np.flatnonzero(length < HUGE)
        turned = np.c_[-2.0 * q[usual], np.ones(len(usual))]
        for a in range(0, len(self.plain) if len(usual) else 0, block_rows):
            s = turned @ self.wide[a:a + block_rows].T
            limit = bound[usual]
            if a == 0 and s.shape[1] > k:
                limit = np.partition(s[:, :max(512, k)], k - 1, axis=1)[:, k - 1] + 2 * slack[usual]
            near = np.flatnonzero(s <= limit[:, None])  # in two dimensions it takes as long as the product
            if len(near):
                meet(usual[near // s.shape[1]], self.plain[a + near % s.shape[1]])
        for rows, cols in ((usual, self.odd), (np.flatnonzero(~(length < HUGE)), np.arange(len(self.ids)))):
            for a in range(0, len(cols) if len(rows) else 0, block_rows):
                part = cols[a:a + block_rows]
                meet(np.repeat(rows, len(part)), np.tile(part, len(rows)))
        row, rank = np.nonzero(at >= 0)
        return row, rank, at[row, rank], best[row, rank]

    def hits(self, ids, vectors, k: int, block_rows: int, schema) -> Iterator:
        """Arrow batches of the hits of requests: ids and list vectors."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), self.mat.shape[1]), False)
        ids = ids.filter(fits)
        for row, rank, at, dist in self.nearest(_matrix(vectors.filter(fits), self.mat.shape[1]), k, block_rows):
            found = self.rows.take(pa.array(at)).flatten()
            columns = [ids.take(pa.array(row)), pa.array((rank + 1).astype(np.int32)), found[0], pa.array(dist), *found[1:]]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _matrix(vectors, width: int):
    """Arrow list vectors of one width as a float64 matrix; a null component is NaN."""
    import pyarrow as pa

    return vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(vectors), width)


def _tile(vectors, rows) -> Tile | None:
    import numpy as np
    import pyarrow.compute as pc

    if not len(rows):
        return None
    ids = pc.fill_null(rows.field("id"), np.iinfo(np.int64).min).to_numpy()
    return Tile(ids, _matrix(vectors, len(vectors[0])), rows)


def _keys_of(batch, keys: Sequence[str]) -> list[tuple]:
    """The keys of an Arrow batch's rows; a NaN equals itself."""
    if not keys:
        return [()] * batch.num_rows
    return [tuple("NaN" if v != v else v for v in row) for row in zip(*[batch.column(c).to_pylist() for c in keys], strict=True)]


def _keyed(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Rows that can meet: with a vector and without a null key."""
    for c in [vector, *keys]:
        df = df.where(F.col(c).isNotNull())
    return df


def _contenders(corpus: DataFrame, keys: Sequence[str], k: int, payload: Sequence[str]) -> DataFrame:
    """keys, ``_v`` and ``_c`` (id, payload) of the corpus rows that can be hits:
    of equal vectors of a key, the k lowest ids."""
    found = F.struct(F.col("id").cast("long").alias("id"), *[F.col(p).alias(f"p{i}") for i, p in enumerate(payload)])
    w = Window.partitionBy(*keys, "_v").orderBy("_c")
    return (_keyed(corpus, keys, "embedding").select(*keys, F.col("embedding").alias("_v"), found.alias("_c"))
            .withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n"))


def _hit_fields(corpus: DataFrame, payload: Sequence[str]) -> str:
    types = dict(corpus.dtypes)
    return "hit_rank INT, corpus_id BIGINT, distance DOUBLE" + "".join(f", `{p}` {types[p]}" for p in payload)


def _arrow_schema(spark, ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def knn_join(requests: DataFrame, corpus: DataFrame, keys: Sequence[str], k: int = 3,
             request_id: str = "request_id", query_vec: str = "query_vec",
             payload: Sequence[str] = ("segment", "recommendation"),
             broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
             block_rows: int = DEFAULT_BLOCK_ROWS, force_blocked: bool = False) -> DataFrame:
    """Top-k corpus rows per request among corpus rows whose ``keys`` equal the
    request's. Output: request_id, hit_rank (1..k), corpus id, distance, payload."""
    keys = list(keys)
    size = F.size("embedding")
    r = corpus.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi")).first()
    if r["lo"] != r["hi"]:
        raise DataQualityError(f"corpus vectors have {r['lo']} to {r['hi']} components; one width is needed")
    width = int(r["hi"] or 0)
    if not force_blocked and r["n"] * width * 8 <= broadcast_bytes:
        return _knn_broadcast(requests, corpus, keys, k, request_id, query_vec, payload, block_rows)
    return _knn_blocked(requests, corpus, keys, k, request_id, query_vec, payload, block_rows, width)


def _knn_blocked(requests: DataFrame, corpus: DataFrame, keys: list[str], k: int, request_id: str,
                 query_vec: str, payload: Sequence[str], block_rows: int, width: int) -> DataFrame:
    """Corpus beyond the broadcast bound: a sort-based co-group.

    The rows of a key are dealt to tiles of the corpus and slices of the
    requests by hash, as many as its counts ask for. Tile rows and request rows
    are hash-partitioned on (key, tile, slice) and sorted so that a tile arrives
    just before its requests. Top-k lists per tile are then merged per request.
    """
    spark = requests.sparkSession
    tile_rows = max(block_rows, TILE_BYTES // (8 * max(1, width)))
    slice_rows = max(1, tile_rows // 2)
    found = cut_lineage(_contenders(corpus, keys, k, payload), "knn-corpus")
    asked = _keyed(requests, keys, query_vec).select(request_id, *keys, query_vec)
    sizes = _meet(found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), keys)
    sizes = cut_lineage(sizes.where("_n > 0 and _m > 0").select(
        *keys, F.ceil(F.col("_n") / tile_rows).alias("_tiles"), F.ceil(F.col("_m") / slice_rows).alias("_slices"),
        (F.col("_n").cast("double") * F.col("_m")).alias("_pairs")), "knn-sizes")
    tasks = int((sizes.agg(F.sum("_pairs")).first()[0] or 0) / (tile_rows * slice_rows)) + 1
    vtype = dict(found.dtypes)["_v"]
    if dict(asked.dtypes)[query_vec] != vtype:
        vtype = "array<double>"
    rid_type, ctype = asked.schema[request_id].dataType, found.schema["_c"].dataType
    tiles = _meet(found, sizes, keys).select(
        *keys, F.pmod(F.xxhash64(F.col("_c.id"), "_v"), F.col("_tiles")).alias("_t"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)).alias("_s"), F.lit(0).alias("_kind"),
        F.lit(None).cast(rid_type).alias("_rid"), F.col("_c"), F.col("_v").cast(vtype).alias("_v"))
    slices = _meet(asked, sizes, keys).select(
        *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)).alias("_t"),
        F.pmod(F.xxhash64(request_id, query_vec), F.col("_slices")).alias("_s"), F.lit(1).alias("_kind"),
        F.col(request_id).alias("_rid"), F.lit(None).cast(ctype).alias("_c"), F.col(query_vec).cast(vtype).alias("_v"))
    unified = tiles.unionByName(slices)
    group = [*keys, "_t", "_s"]
    ordered = unified.repartition(max(2 * tasks, partitions_for(unified)), *group).sortWithinPartitions(*group, "_kind")
    ddl = f"rid {rid_type.simpleString()}, {_hit_fields(corpus, payload)}"
    schema = _arrow_schema(spark, ddl)

    def cogroup(batches):
        import numpy as np
        import pyarrow as pa

        current, parts, tile = None, [], None
        for batch in batches:
            keyed = _keys_of(batch, group)
            starts = [i for i in range(len(keyed)) if i == 0 or keyed[i] != keyed[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(keyed)]):
                if keyed[a] != current:
                    current, parts, tile = keyed[a], [], None
                piece = batch.slice(a, b - a)
                m = int(np.searchsorted(piece.column("_kind").to_numpy(), 1))
                if m:
                    parts.append(piece.slice(0, m).select(["_v", "_c"]))
                if m < b - a and parts:
                    rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    tile, parts = _tile(rows.column("_v"), rows.column("_c")), []
                if m < b - a and tile is not None:
                    piece = piece.slice(m)
                    yield from tile.hits(piece.column("_rid"), piece.column("_v"), k, block_rows, schema)

    partial = ordered.mapInArrow(cogroup, ddl)
    hit = F.struct(F.col("distance"), F.col("corpus_id").alias("id"), *[F.col(p) for p in payload])
    # At most k candidates per (request, tile): bounded per request.
    merged = partial.groupBy("rid").agg(F.slice(F.array_sort(F.collect_list(hit)), 1, k).alias("_t"))
    best = merged.select(F.col("rid").alias(request_id), F.posexplode("_t").alias("_p", "h"))
    return best.select(request_id, (F.col("_p") + 1).cast("int").alias("hit_rank"),
                       F.col("h.id").alias("corpus_id"), F.col("h.distance").alias("distance"),
                       *[F.col(f"h.{p}").alias(p) for p in payload])


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys) if keys else left.crossJoin(right)


def _knn_broadcast(requests: DataFrame, corpus: DataFrame, keys: list[str], k: int, request_id: str,
                   query_vec: str, payload: Sequence[str], block_rows: int) -> DataFrame:
    import pyarrow as pa

    spark = requests.sparkSession
    # Size-checked by the caller: at most ``broadcast_bytes`` of vectors.
    rows = _contenders(corpus, keys, k, payload).toArrow().combine_chunks()
    by_key: dict = {}
    for i, key in enumerate(_keys_of(rows, keys)):
        by_key.setdefault(key, []).append(i)
    tables = {}
    for key, at in by_key.items():
        mine = rows.select(["_v", "_c"]).take(pa.array(at)).combine_chunks().to_batches()[0]
        tables[key] = (mine.column("_v"), mine.column("_c"))
    bc = spark.sparkContext.broadcast(tables)
    ddl = f"`{request_id}` {dict(requests.dtypes)[request_id]}, {_hit_fields(corpus, payload)}"
    schema = _arrow_schema(spark, ddl)

    def top_k(batches):
        import pyarrow as pa

        tiles: dict = {}
        for batch in batches:
            groups: dict = {}
            for i, key in enumerate(_keys_of(batch, keys)):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                if key not in bc.value:
                    continue
                if key not in tiles:
                    tiles[key] = _tile(*bc.value[key])
                part = batch.take(pa.array(at))
                yield from tiles[key].hits(part.column(request_id), part.column(query_vec), k, block_rows, schema)

    return requests.select(request_id, *keys, query_vec).mapInArrow(top_k, ddl)


def find_recommendations(corpus: DataFrame, query_vec: list[float], lang: str,
                         segment: str | None = None, limit: int = 3) -> DataFrame:
    """V1/V2/T3 for one request: optional segment filter, language filter,
    ORDER BY distance, id LIMIT k (planned as TakeOrderedAndProject)."""
    c = corpus.where(F.col("language") == lang)
    if segment:
        c = c.where(F.col("segment") == segment)
    q = F.array(*[F.lit(float(x)) for x in query_vec])
    return (c.select("segment", "recommendation", "embedding",
                     l2_distance(F.col("embedding"), q).alias("distance"), "id")
            .orderBy("distance", "id").limit(limit))


# Prompt wording per language.
PROMPTS = {
    "ru": {
        "asked": "Пользователь запросил рекомендации по бизнесу",
        "found": "Вот предварительные рекомендации из базы",
        "refine": "Уточни и дополни эти рекомендации, чтобы они были максимально полезны и конкретны для бизнеса.",
        "none": "Предложи конкретные и практические рекомендации для улучшения бизнеса.",
        "analysis": "RFM-анализ",
        "dominant": "Доминирующий сегмент",
        "preliminary": "Предварительные рекомендации",
        "dominant_refine": "Уточни и дополни рекомендации для бизнеса масс-маркета. Пиши не очень много",
        "dominant_none": "Предложи рекомендации для бизнеса масс-маркета (пиши не очень много)",
    },
    "en": {
        "asked": "User requested business recommendations",
        "found": "Here are preliminary recommendations from the database",
        "refine": "Refine and enhance these recommendations to be as helpful and specific as possible for the business.",
        "none": "Provide specific and practical recommendations for improving the business.",
        "analysis": "RFM analysis",
        "dominant": "Dominant segment",
        "preliminary": "Preliminary recommendations",
        "dominant_refine": "Refine and provide actionable recommendations for a mass-market retail business.",
        "dominant_none": "Provide actionable recommendations for a mass-market retail business.",
    },
}


def _by_lang(lang: Column, key: str) -> Column:
    return F.when(lang == "en", F.lit(PROMPTS["en"][key])).otherwise(F.lit(PROMPTS["ru"][key]))


def prompt_digest(requests: DataFrame, hits: DataFrame, request_id: str = "request_id",
                  text: str = "query_text", lang: str = "language") -> DataFrame:
    """A7 + V4: per request, hits joined in rank order as ``segment: text`` lines
    and the prompt text; the no-hit template when nothing matched.

    Hits per request are at most k, so the per-request list is bounded.
    """
    digest = (hits.groupBy(request_id)
              .agg(F.array_join(F.transform(
                  F.array_sort(F.collect_list(F.struct("hit_rank", "segment", "recommendation"))),
                  lambda h: F.concat(h["segment"], F.lit(": "), h["recommendation"])), "\n").alias("digest"),
                  F.count(F.lit(1)).alias("n_hits")))
    r = requests.join(digest, request_id, "left")
    lc = F.col(lang)
    head = F.concat(_by_lang(lc, "asked"), F.lit(": '"), F.col(text), F.lit("'.\n"))
    with_hits = F.concat(head, _by_lang(lc, "found"), F.lit(":\n"), F.col("digest"), F.lit("\n"),
                         _by_lang(lc, "refine"))
    without = F.concat(head, _by_lang(lc, "none"))
    return r.select(request_id, F.coalesce(F.col("n_hits"), F.lit(0)).cast("long").alias("n_hits"),
                    F.col("digest"),
                    F.when(F.col("n_hits") > 0, with_hits).otherwise(without).alias("prompt"))


def dominant_prompt(requests: DataFrame, hits: DataFrame, request_id: str = "request_id", segment_name: str = "segment_name",
                    lang: str = "language") -> DataFrame:
    """V4, second family: the prompt about an analysis' dominant segment, with the
    texts found for that segment in rank order, or the template without any.

    Hits per request are at most k, so the per-request list is bounded.
    """
    found = hits.groupBy(request_id).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("hit_rank", "recommendation"))), lambda h: h["recommendation"]), "\n").alias("_found"))
    lc, nl = F.col(lang), F.lit("\n")
    head = F.concat(_by_lang(lc, "analysis"), F.lit(":\n"), _by_lang(lc, "dominant"), F.lit(": "), F.col(segment_name), nl)
    with_hits = F.concat(head, _by_lang(lc, "preliminary"), F.lit(":\n"), F.col("_found"), nl, _by_lang(lc, "dominant_refine"))
    without = F.concat(head, _by_lang(lc, "dominant_none"))
    r = requests.join(found, request_id, "left")
    return r.select(request_id, lang, segment_name, F.when(F.col("_found").isNotNull(), with_hits).otherwise(without).alias("prompt"))
