"""Near-duplicates: MinHash with banding, signature and exact verification, connected components.

1. Each text becomes the set of hashes of its 5-word shingles: a fingerprint of
   the whole set, and the minima of ``HASHES`` universal hash functions.
   Equal sets are one class with one representative, so copies never meet.
2. Representatives that agree on all rows of a band share a bucket.  A bucket
   links its members to its least one, so a bucket of any size gives as many
   pairs as members.
3. A pair whose signatures agree too little is dropped (``SLACK`` is five
   standard deviations below the threshold); the others are confirmed on
   their full shingle sets.
4. Components by large-star and small-star.  Documents of buckets that still
   hold several components are then compared across components wherever their
   rarest shingles meet, so that no link between different texts hangs on which
   member was the least.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import HOT, drop_written, join_by_key, written
from .words import chunks, mix64, rolling, starts_within, words_of

SHINGLE = 5
SIMILAR = 75  # percent
HASHES, ROWS = 128, 4
#: Signatures of linked sets agree on at least this share but for 1 in several million.
SLACK = 0.56
#: Members of a bucket's centre that one task compares with it.
PER_CENTRE = 2000
#: Bytes of text hashed at once.
CHUNK = 1 << 20
#: Ids of candidates that may be broadcast; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 4_000_000

_rng = np.random.default_rng(2)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, one text after the other, and where each text's begin."""
    w = words_of(texts, lower=True)
    n, hashes = w.counts(), w.hashes()
    ok = starts_within(w.first, SHINGLE)
    text = w.texts()
    at = np.flatnonzero(ok)
    values, owner = rolling(hashes, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64), text[at]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):  # the whole sequence is the one shingle
        more = np.empty(len(short), np.uint64)
        for k in range(1, SHINGLE):
            of = short[n[short] == k]
            if len(of):
                begin = w.first[of]
                value = np.zeros(len(of), np.uint64)
                for j in range(k):
                    value = value * np.uint64(0x9E3779B97F4A7C15) + hashes[begin + j]
                more[np.searchsorted(short, of)] = mix64(value ^ np.uint64(k))
        values, owner = np.concatenate([values, more]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    codes = pa.array(values).dictionary_encode()
    key = pa.array(owner.astype(np.int64) << 32 | codes.indices.to_numpy(zero_copy_only=False)).unique().to_numpy(zero_copy_only=False)
    values = codes.dictionary.to_numpy(zero_copy_only=False)[key & 0xFFFFFFFF]
    return values, np.searchsorted(key >> 32, np.arange(len(n) + 1))


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, HASHES) uint32: the minima of each text's set; zeros for an empty one."""
    n = len(first) - 1
    out = np.zeros((n, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        cuts = first[:-1][full]
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(((values * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), cuts)
    return out


def _sums(values: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values ^ np.uint64(salt)), dtype=np.uint64)])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, f1, f2, sig``: size and 128-bit fingerprint of the shingle set, and its signature."""

    def run(batches):
        for b in chunks(batches, "text", CHUNK):
            values, first = shingle_sets(b.column(1))
            n = np.diff(first)
            sig = signatures(values, first).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * HASHES), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(_sums(values, first, 1)), pa.array(_sums(values, first, 2)), lists], names=["id", "n", "f1", "f2", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, f1 long, f2 long, sig array<int>")


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs with a part of their centre's: ``c`` is how many partners the centre may have, and a part has about ``PER_CENTRE``."""
    salts = F.ceil(F.col("c") / PER_CENTRE)
    return pairs.select("u", "v", "c", salts.alias("salts"), F.pmod(F.xxhash64("v"), salts).alias("salt"))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (u, v, c), those whose full sets are similar enough.

    A centre u and a part of its partners go to a task together, the centre
    first; the task keeps one set and streams the others past it.
    """
    salted = _dealt(pairs)
    centres = salted.select("u", "salts", "salt").distinct().join(texts, F.col("u") == F.col("id")).select("u", "salts", "salt", F.lit(None).cast(texts.schema["id"].dataType).alias("v"), "text")
    members = salted.join(texts, F.col("v") == F.col("id")).select("u", "salts", "salt", "v", "text")
    rows = centres.unionByName(members).repartition("u", "salts", "salt").sortWithinPartitions("u", "salts", "salt", F.col("v").isNotNull())

    def similar(centre, mine):
        if not len(centre):
            return False
        at = np.minimum(np.searchsorted(centre, mine), len(centre) - 1)
        both = int((centre[at] == mine).sum())
        return 100 * both >= SIMILAR * (len(centre) + len(mine) - both)

    def run(batches):
        key, centres = None, []  # a centre has as many sets as its id has texts
        for b in chunks(batches, "text", CHUNK):
            values, first = shingle_sets(b.column(4))
            parts, keep = zip(*(b.column(k).to_pylist() for k in range(3))), []
            for k, (part, v) in enumerate(zip(parts, b.column(3).to_pylist())):
                mine = values[first[k] : first[k + 1]]
                if v is None:
                    if key != part:
                        key, centres = part, []
                    centres.append(np.sort(mine))
                elif key == part and len(mine) and any(similar(c, mine) for c in centres):
                    keep.append(k)
            yield b.take(pa.array(keep, pa.int64())).select(["u", "v"])

    kind = texts.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"u {kind}, v {kind}")


def _across(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (u, v, c) of different components that can be similar enough, among the documents of ``placed`` (key, id, comp).

    Two sets of a similarity of 75 % share a shingle among the rarest 25 % of
    each (prefix filtering), whatever their buckets.  What very many documents
    share is the least rare, so a passage common to them makes no pairs.  Of a
    bucket only documents outside its largest component need partners.  The
    pairs are a written table.
    """
    sizes = placed.groupBy("key", "comp").count()
    largest = sizes.groupBy("key").agg(F.max(F.struct("count", "comp"))["comp"].alias("most"), F.sum("count").alias("c"))
    largest = written(largest, "largest")
    odd = join_by_key(placed, largest, ["key"], "c").groupBy("id", "comp").agg(F.max((F.col("comp") != F.col("most")).cast("int")).alias("odd"))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for b in chunks(batches, "text", CHUNK):
            values, first = shingle_sets(b.column(4))
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))], names=["id", "t", "comp", "odd", "n", "set"])

    sets = texts.join(odd, "id").select("id", "t", "comp", "odd", "text").mapInArrow(run, f"id {kind}, t long, comp {kind}, odd int, n long, set array<bigint>")
    sets = written(sets, "sets")
    each = sets.select("id", "t", "comp", "odd", "n", F.explode("set").alias("h"))
    rarity = written(each.groupBy("h").agg(F.count("*").alias("df")), "rarity")
    rarest = join_by_key(each, rarity, ["h"], "df").groupBy("id", "t", "comp", "odd", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("all"))
    prefix = F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * SIMILAR / 100) + 1).cast("int"))
    rows = rarest.select("id", "comp", "odd", "n", F.posexplode(prefix).alias("i", "x")).filter("x.df > 1")
    rows = rows.select("id", "comp", "odd", "n", (F.col("n") - F.col("i")).alias("rest"), "x.h", F.ceil(F.col("x.df") / HOT).alias("salts"))
    rows = written(rows, "prefixes")
    # of a shingle with very many documents each odd one meets all others in as many parts
    p = rows.filter("odd = 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).alias("p")
    q = rows.withColumn("salt", F.pmod(F.xxhash64("id"), "salts")).alias("q")
    # from the rarest shingle that two sets share on, no more than the shorter rest can be shared
    most = F.least("p.rest", "q.rest")
    fits = (F.col("p.comp") != F.col("q.comp")) & ((F.col("q.odd") == 0) | (F.col("p.id") < F.col("q.id"))) & (100 * most >= SIMILAR * (F.col("p.n") + F.col("q.n") - most))
    pairs = p.join(q, (F.col("p.h") == F.col("q.h")) & (F.col("p.salt") == F.col("q.salt")) & fits).select(F.least("p.id", "q.id").alias("u"), F.greatest("p.id", "q.id").alias("v"), (F.col("p.salts") * HOT).alias("c")).groupBy("u", "v").agg(F.max("c").alias("c"))
    pairs = written(pairs, "across")
    drop_written(sets, rarity, rows, largest)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Words are lower-cased (A-Z) and split at ASCII white space.  Null, empty
    and wordless texts have empty sets and link with nothing.  Rows with one
    id are one document, linked by each of its texts; rows with a null id stay
    unlinked, with a null component, and are kept.  Equal texts tie and the
    least id stays.  Other columns are not read.
    """
    sk = written(sketch(docs, id_col, text_col), "sketch")
    named = sk.filter("n > 0 and id is not null")
    reps = named.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    reps = written(reps.select("rep", "n", "f1", "f2", "copies", "sig"), "reps")

    bands = F.array(*(F.xxhash64(F.lit(i), *(F.col("sig")[i * ROWS + j] for j in range(ROWS))) for i in range(HASHES // ROWS)))
    keyed = reps.select(F.col("rep").alias("id"), F.explode(bands).alias("key"))
    shared = written(keyed.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("c")).filter("c > 1"), "shared")
    members = written(join_by_key(keyed, shared, ["key"], "c"), "buckets")
    stars = members.filter("id <> centre").groupBy(F.col("centre").alias("u"), F.col("id").alias("v")).agg(F.max("c").alias("c"))

    ids = written(members.select("id").distinct(), "candidates")
    n = ids.count()
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).filter("text is not null")
    texts = written(plain.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_semi").dropDuplicates(["id", "t"]), "texts") if n else plain.limit(0)
    sigs = reps.select(F.col("rep").alias("id"), "n", "sig").join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_semi")

    def alike(pairs: DataFrame) -> DataFrame:
        a, b = (sigs.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "uv")
        same = F.size(F.filter(F.zip_with("su", "sv", lambda x, y: x == y), lambda x: x))
        near = (100 * F.least("nu", "nv") >= SIMILAR * F.greatest("nu", "nv")) & (same >= int(SLACK * HASHES))
        part = ["u", "salts", "salt"]
        dealt = _dealt(pairs)
        centres = dealt.select(part).distinct().join(a, "u")
        return dealt.join(b, "v").join(centres, part).filter(near).groupBy("u", "v").agg(F.max("c").alias("c"))

    def linked(pairs: DataFrame) -> DataFrame:
        near = written(alike(pairs), "pairs")
        out = written(_confirmed(near, texts), "links")
        drop_written(near)
        return out

    links = linked(stars)
    several = named.groupBy("id").agg(F.min("f1").alias("a"), F.max("f1").alias("b")).filter("a <> b").select("id")
    own = written(named.join(several, "id", "left_semi").join(reps, ["f1", "f2", "n"]).select(F.col("id").alias("u"), F.col("rep").alias("v")), "several")
    comps = connected_components(links.unionByName(own))

    # buckets that hold more than one component: pairs across components that the stars have not tried
    placed = members.join(comps, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("c")).filter("a <> b").select("key", "c")
    mixed = written(mixed, "mixed-keys")
    crowd = written(join_by_key(placed, mixed, ["key"], "c").select("key", "id", "comp"), "mixed")
    across = _across(crowd, texts)
    more = linked(across.join(stars.select("u", "v"), ["u", "v"], "left_anti"))
    if more.head(1):
        first, comps = comps, connected_components(links.unionByName(own).unionByName(more))
        drop_written(first)

    class_of = reps.join(comps, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n", "copies", F.coalesce("component", "rep").alias("comp"))
    class_of = written(class_of, "classes")
    drop_written(shared, members, ids, links, own, placed, mixed, crowd, across, more, comps, reps, *([texts] if n else []))
    rows = join_by_key(named.select("id", "n", "f1", "f2"), class_of, ["f1", "f2", "n"], "copies").select("id", "n", "comp")
    rows = rows.unionByName(sk.filter("not (n > 0 and id is not null)").select("id", "n", F.col("id").alias("comp")))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"))
