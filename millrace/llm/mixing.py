"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target (shares by weight, at most ``max_repeats`` times what
it holds).  Every document of a source then has the same expected number of
copies, target / source size; the whole part is taken for sure and the
fraction is rounded dependently: documents with fractions left are paired and
words transferred between them, up or down at random without bias, until one
fraction is 0 or 1, and the other goes on.  Expected copies are kept for each document and
the source's words stay constant but for the last fraction.

Documents are rounded in blocks of bounded size, dealt by id, size and text,
each block leaving one document with a fraction; those residuals meet in a
reduction tree, ``FAN_IN`` at a time, so no task sees a whole source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3.0
#: Documents of a block, and residuals that meet in a node of the tree.
BLOCK, FAN_IN = 512, 64
#: Tasks that blocks are dealt to at most.
MOST_TASKS = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``source, source_size, docs, target`` from ``source, size``, one row per source.

    Sources rank by code point, null last, and weigh ``weights`` in turn.  The
    total is shared by weight; no source gets more than ``max_repeats`` times
    its own size and what it can't take is shared by the others.  That ends in
    target = min(cap, level * weight) with one level for all, found here by
    ranking sources by cap / weight.  The table has a row per source, so its
    windows are small whatever the number of documents.
    """
    s = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranks = F.row_number().over(order) - 1
    w = F.lit(float(weights[-1]))
    for k in range(len(weights) - 2, -1, -1):
        w = F.when(ranks % len(weights) == k, F.lit(float(weights[k]))).otherwise(w)
    s = s.select("source", "source_size", "docs", w.alias("_w"), (F.col("source_size") * F.lit(float(max_repeats))).alias("_cap"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    total = F.sum("source_size").over(Window.partitionBy())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    # the level if all sources before this one are at their caps and no other is
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    s = s.select("*", level.alias("_level"))
    free = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(Window.partitionBy())
    return s.select("source", "source_size", "docs", F.least("_cap", F.coalesce(free["_level"] * F.col("_w"), F.col("_cap"))).cast("double").alias("target"))


def _uniform(seed: int, block: str, n: int) -> np.ndarray:
    import xxhash

    return np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}:{block}")).random(n)


def _settled(p: np.ndarray) -> np.ndarray:
    return np.where(p < 1e-9, 0.0, np.where(p > 1 - 1e-9, 1.0, p))


def _pivot(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> int:
    """Round the fractions ``p`` in place, in the order given (sizes falling); the index of the one that is left, or -1.

    A document is paired with the next one, or with as many of the next as it
    takes to settle it either way; each has the same share of the transfer
    whichever way it goes, so nobody's expectation moves.  Those that nothing
    can settle at one go, the last ones above all, are paired one by one in the
    end.
    """
    n, i = len(p), 0
    while i < n:
        if p[i] <= 0.0 or p[i] >= 1.0:
            i += 1
            continue
        up, down = (1.0 - p[i]) * size[i], p[i] * size[i]
        width = 4
        while True:
            k = slice(i + 1, min(i + 1 + width, n))
            # the share of the transfer that each can take in either direction
            share = np.minimum(p[k] / up, (1.0 - p[k]) / down) * size[k]
            enough = np.flatnonzero(np.cumsum(share) >= 1.0)
            if len(enough) or k.stop >= n:
                break
            width *= 4
        if not len(enough):  # all that follow are too small for it
            i += 1
            continue
        k = slice(i + 1, i + 2 + int(enough[0]))
        share = share[: enough[0] + 1] / share[: enough[0] + 1].sum() / size[k]
        won = u[i] < p[i]
        p[k] = _settled(p[k] - up * share if won else p[k] + down * share)
        p[i] = 1.0 if won else 0.0
        i += 1
    at = -1
    for b in range(n):
        if p[b] <= 0.0 or p[b] >= 1.0:
            continue
        if at < 0:
            at = b
            continue
        a = at
        # words that can go from b to a, and from a to b, until a fraction is 0 or 1
        up = min((1.0 - p[a]) * size[a], p[b] * size[b])
        down = min(p[a] * size[a], (1.0 - p[b]) * size[b])
        give = up if u[b] * (up + down) < down else -down
        p[a] = _settled(p[a] + give / size[a])
        p[b] = _settled(p[b] - give / size[b])
        at = a if 0.0 < p[a] < 1.0 else b if 0.0 < p[b] < 1.0 else -1
    return at


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_repeats: float = MAX_REPEATS, seed: int = 20) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row: the words of it that the mix takes.

    ``taken`` is a whole number of copies times the size, at most
    ceil(``max_repeats``) of them.  Null texts and texts without words have
    size 0 and nothing is taken of them.  A null source is a source of its
    own.  Rows with a null or repeated id are rounded one by one like any
    other.  Blocks are formed from ids, sizes and texts, so reruns agree.  An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("block"))
    sized = written(sized, "mix-sizes")
    targets = source_targets(sized, weights, max_repeats)
    n = sized.groupBy("source").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    blocks = -(-(n["most"] or 0) // BLOCK) or 1
    tasks = max(1, min(-(-(n["all"] or 0) // BLOCK), MOST_TASKS))

    rows = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target", "d.block", F.ceil(F.col("t.docs") / BLOCK).alias("blocks"))
    copies = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumns({"whole": F.floor(copies).cast("long"), "part": copies - F.floor(copies), "block": F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "block"), "blocks")}).drop("blocks")
    schema = f"doc_id {kind}, source string, size long, source_size long, target double, whole long, part double, block long, open boolean"

    def level(frame: DataFrame, step: int) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            # large documents first: small ones then settle what is left of them
            pdf = pdf.sort_values(["size", "doc_id", "part"], ascending=[False, True, True], kind="stable", ignore_index=True)
            p, source = pdf["part"].to_numpy(float).copy(), pdf["source"].iloc[0]
            left = _pivot(p, pdf["size"].to_numpy(float), _uniform(seed, f"{step}:{source}:{pdf['block'].iloc[0]}", len(p)))
            is_open = np.zeros(len(p), bool)
            if left >= 0:
                is_open[left] = True
            done = (p >= 1.0) & ~is_open
            pdf["whole"] += done.astype("int64")
            pdf["part"], pdf["open"] = np.where(is_open, p, 0.0), is_open
            pdf["block"] = pdf["block"] // FAN_IN
            return pdf

        # as many tasks as there are blocks: small rows, but much to do for each
        out = frame.repartition(max(1, tasks // FAN_IN**step), "source", "block").groupBy("source", "block").applyInPandas(run, schema)
        return written(out, f"mix-{step}")

    # what has no fraction needs no rounding
    step, parts = 0, [rows.filter("part = 0").withColumn("open", F.lit(False))]
    now = level(rows.filter("part > 0"), 0)
    while True:
        parts.append(now.filter("not open"))
        if blocks <= 1:
            break
        blocks = -(-blocks // FAN_IN)
        step += 1
        now = level(now.filter("open").drop("open"), step)
    # what is left of a source is rounded once, without bias
    u = (F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "source", "doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52))).cast("double")
    parts.append(now.filter("open").withColumn("whole", F.col("whole") + F.when(u < F.col("part"), 1).otherwise(0)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size")).alias("taken"))
