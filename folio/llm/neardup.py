"""Near-duplicate records by a sharded vantage-point forest (problem 1).

A record is a *set*: the distinct lower-cased words of a text, or the distinct numbers of a provenance list.
Two records match when ``|A & B| / |A | B| >= threshold``. How the exact answer is reached:

* **Copies.** Records with equal sets are one class; only a class's representative is indexed.
* **Shards by rare element.** Elements have one order, rare ones first. Of two matching sets the first
  ``|A| - ceil(t |A|) + 1`` elements in that order have one in common, so each set goes to a shard for each of these
  elements of its group and meets all its matches there. How many shards a set visits depends on its own size only.
  ``RANKED`` most frequent elements are counted and ordered last; the order decides how large shards are, not what is found.
* **Fingerprint.** Every element toggles one bit of a ``bits``-wide vector (a parity sketch). The Hamming
  distance of two fingerprints never exceeds ``|A ^ B|``, and a matching pair has
  ``|A ^ B| <= (1 - t) / t * min(|A|, |B|)``. So a range search with that radius loses no pair.
* **Tree.** Vantage points are picked on a bounded sample (``TREE_SAMPLE`` fingerprints, only the shape of
  the tree depends on it); every fingerprint is indexed. The root's vantage point is the empty set, which makes
  the first split a split by size. A shard of a frequent element is split by as many levels as it needs to come down to
  ``LEAF`` members: a set goes home to one part and visits every part that the triangle bound
  ``d(q, v) - r <= mu`` / ``d(q, v) + r > mu`` leaves open.
* **Search.** Within a shard, or a part of one, a tree of its own is grown and searched with the same bound. Every
  candidate is then checked on the sets themselves, with integer arithmetic.

Nulls and empty values make no record. Rows repeated under one key are one record (the greatest value counts).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.runtime import cut, read, ship, shuffle_parts

TREE_SAMPLE = 4096
RANKED = 200_000
SALT = 8
LEAF = 4096
THRESHOLD = Fraction(7, 10)
WORD = re.compile(r"\w+")


def word_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct lower-cased words of a text."""
    if not text:
        return np.empty(0, np.int64)
    words = set(WORD.findall(text.lower()))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64))


def number_set(values) -> np.ndarray:
    """Sorted distinct non-null numbers of a list."""
    if values is None:
        return np.empty(0, np.int64)
    return np.unique(np.array([int(v) for v in values if v is not None and v == v], np.int64))


def fingerprint(items: np.ndarray, bits: int) -> bytes:
    """Parity sketch: bit b is set when an odd number of elements fall on b."""
    mixed = (items.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    odd = np.bincount((mixed % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _features(as_words: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [word_set(v) if as_words else number_set(v) for v in pdf["value"]]
            keep = np.array([len(s) > 0 for s in sets], bool)
            pdf = pdf[keep]
            sets = [s for s in sets if len(s)]
            yield pd.DataFrame({
                "record_kind": pdf["record_kind"].to_numpy(),
                "grp": pdf["grp"].to_numpy(),
                "id": pdf["id"].to_numpy(),
                "size": np.array([len(s) for s in sets], np.int32),
                "klass": [xxhash.xxh128_digest(s.tobytes()) for s in sets],
                "items": sets,
            })

    return run


FEATURES = "record_kind string, grp string, id long, size int, klass binary, items array<long>"


def record_sets(spark: SparkSession, gists: DataFrame | None, slots: DataFrame | None) -> DataFrame:
    """One row per record with its set. gists: (id, text); slots: (id, grp, numbers)."""
    ship(spark)
    parts = []
    if gists is not None:
        one = gists.groupBy("id").agg(F.max("text").alias("value")).where("id is not null and value is not null")
        one = one.select(F.lit("gist").alias("record_kind"), F.lit("").alias("grp"), "id", "value")
        parts.append(one.mapInPandas(_features(True), FEATURES))
    if slots is not None:
        one = slots.groupBy("id").agg(F.max(F.struct("grp", "numbers")).alias("m"))
        one = one.where("id is not null and m.grp is not null and m.numbers is not null")
        one = one.select(F.lit("slot").alias("record_kind"), F.col("m.grp").alias("grp"), "id", F.col("m.numbers").alias("value"))
        parts.append(one.mapInPandas(_features(False), FEATURES))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- the tree ------------------------------------------------------------------------------------------------


def _hamming(fps: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ v).sum(axis=1, dtype=np.int32)


def radius(sizes: np.ndarray, t: Fraction) -> np.ndarray:
    """Greatest ``|A ^ B|`` that a match of a set of this size can have."""
    return (sizes.astype(np.int64) * (t.denominator - t.numerator)) // t.numerator


def build_tree(fps: np.ndarray, sizes: np.ndarray, t: Fraction, seed: int = 7) -> dict[int, tuple[np.ndarray, int]]:
    """Heap-numbered nodes (root 1): vantage point and split distance."""
    rng = np.random.default_rng(seed)
    nodes: dict[int, tuple[np.ndarray, int]] = {}

    def grow(node: int, idx: np.ndarray, level: int) -> None:
        if len(idx) < 8:
            return
        best = None
        tries = [np.zeros(fps.shape[1], np.uint64)] if node == 1 else [fps[i] for i in rng.choice(idx, min(12, len(idx)), False)]
        r = radius(sizes[idx], t)
        for v in tries:
            d = _hamming(fps[idx], v)
            mu = int(np.median(d))
            if not 0 < (d <= mu).sum() < len(d):
                continue
            both = float((np.abs(d - mu) <= r).mean())  # share that has to visit both sides
            if best is None or both < best[0]:
                best = (both, v, mu, d)
        if best is None:
            return
        _, v, mu, d = best
        nodes[node] = (v.copy(), mu)
        grow(2 * node, idx[d <= mu], level + 1)
        grow(2 * node + 1, idx[d > mu], level + 1)

    if len(fps):
        grow(1, np.arange(len(fps)), 0)
    return nodes


def route(nodes: dict, fps: np.ndarray, r: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, is home) for every shard a row belongs to or has to visit."""
    rows, shards, homes = [], [], []

    def walk(node: int, level: int, idx: np.ndarray, home: np.ndarray) -> None:
        if not len(idx):
            return
        if node in nodes:
            stop = depth[idx] <= level
        else:
            stop = np.ones(len(idx), bool)
        if stop.any():
            rows.append(idx[stop])
            shards.append(np.full(stop.sum(), node, np.int32))
            homes.append(home[stop])
            idx, home = idx[~stop], home[~stop]
            if not len(idx):
                return
        v, mu = nodes[node]
        d = _hamming(fps[idx], v)
        near = d - r[idx] <= mu
        far = d + r[idx] > mu
        walk(2 * node, level + 1, idx[near], home[near] & (d[near] <= mu))
        walk(2 * node + 1, level + 1, idx[far], home[far] & (d[far] > mu))

    n = len(fps)
    walk(1, 0, np.arange(n), np.ones(n, bool))
    return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


def _as_array(col: pd.Series, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint64).reshape(len(col), words)


def element_keys(items: np.ndarray, group: np.ndarray) -> np.ndarray:
    """One number for each element of a group of records."""
    x = (items.view(np.uint64) ^ group) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _flat(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements' keys, the row each belongs to, sizes) of all sets of a batch."""
    sizes = part["size"].to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(part)), sizes)
    names = {g: np.uint64(xxhash.xxh64_intdigest("\0".join(g))) for g in set(zip(part["record_kind"], part["grp"]))}
    group = np.array([names[g] for g in zip(part["record_kind"], part["grp"])], np.uint64)
    items = np.concatenate([np.asarray(x, np.int64) for x in part["items"]]) if len(part) else np.empty(0, np.int64)
    return element_keys(items, group[owner]), owner, sizes


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Elements of more than one set of the batch with their number. What stands in one set of each batch is rare."""
    for pdf in batches:
        keys, n = np.unique(_flat(pdf)[0], return_counts=True)
        yield pd.DataFrame({"key": keys[n > 1], "n": n[n > 1].astype(np.int64)})


def frequent_elements(reps: DataFrame, most: int = RANKED) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, in how many sets each stands) of at most ``most`` elements, the most frequent ones."""
    n = reps.select("record_kind", "grp", "size", "items").mapInPandas(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = n.orderBy(F.desc("n"), "key").limit(most).toPandas().sort_values("key")
    return rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def prefixes(keys: np.ndarray, owner: np.ndarray, sizes: np.ndarray, known: tuple[np.ndarray, np.ndarray], t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, its number or 0) of the rarest elements of each set, as many as a match must share one of."""
    names, counts = known
    n = np.zeros(len(keys), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        n = np.where(names[at] == keys, counts[at], 0)
    order = np.lexsort((keys, n, owner))
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    length = sizes - -(-sizes * t.numerator // t.denominator) + 1
    take = order[np.arange(len(keys)) - first[owner] < length[owner]]
    return owner[take], keys[take], n[take]


SHARDED = "shard long, part int, role byte, id long, size int, fp binary"
MEMBER, VISITOR, BOTH = 0, 1, 2


def _router(trees: dict[str, dict], known: tuple[np.ndarray, np.ndarray], bits: int, t: Fraction, leaf: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind, part in pdf.groupby("record_kind", sort=False):
                row, shard, n = prefixes(*_flat(part), known, t)
                fp = np.array([fingerprint(np.asarray(x, np.int64), bits) for x in part["items"]], object)
                size, ids = part["size"].to_numpy(), part["id"].to_numpy()
                small = n <= leaf
                r = row[small]
                yield pd.DataFrame({"shard": shard[small], "part": 1, "role": np.int8(BOTH), "id": ids[r], "size": size[r], "fp": fp[r]})
                if small.all():
                    continue
                big, at = row[~small], shard[~small]
                fps = np.frombuffer(b"".join(fp[big]), np.uint64).reshape(len(big), bits // 64)
                depth = np.ceil(np.log2(n[~small] / leaf)).astype(int)
                x, node, home = route(trees.get(kind, {}), fps, radius(size[big], t), depth)
                for role, keep in ((MEMBER, home), (VISITOR, np.ones(len(x), bool))):
                    y = x[keep]
                    yield pd.DataFrame({"shard": at[y], "part": node[keep], "role": np.int8(role), "id": ids[big[y]], "size": size[big[y]], "fp": fp[big[y]]})

    return run


def search(m_fp, m_id, m_r, q_fp, q_id, q_r) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidate (member id, query id) with member id < query id, by a tree grown on the members."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    rng = None

    def brute(m: np.ndarray, q: np.ndarray) -> None:
        step = max(1, (1 << 18) // max(1, len(m)))
        for i in range(0, len(q), step):
            b = q[i : i + step]
            d = np.zeros((len(b), len(m)), np.int32)
            for w in range(m_fp.shape[1]):
                d += np.bitwise_count(q_fp[b, w][:, None] ^ m_fp[m, w][None, :])
            hit = (d <= np.minimum(q_r[b][:, None], m_r[m][None, :])) & (q_id[b][:, None] > m_id[m][None, :])
            x, y = np.nonzero(hit)
            if len(x):
                out.append((m_id[m[y]], q_id[b[x]]))

    todo = [(np.arange(len(m_id)), np.arange(len(q_id)), 0)]
    while todo:
        m, q, level = todo.pop()
        if not len(m) or not len(q):
            continue
        if len(m) <= 96 or level > 24:
            brute(m, q)
            continue
        rng = rng or np.random.default_rng(11)
        v = m_fp[rng.choice(m)]
        dm = _hamming(m_fp[m], v)
        mu = int(np.median(dm))
        inner = dm <= mu
        if inner.all():
            mu -= 1
            inner = dm <= mu
            if not inner.any():
                brute(m, q)
                continue
        dq = _hamming(q_fp[q], v)
        for side in (inner, ~inner):
            lo, hi = dm[side].min(), dm[side].max()
            todo.append((m[side], q[(dq - q_r[q] <= hi) & (dq + q_r[q] >= lo)], level + 1))
    return out


def _shards(bits: int, t: Fraction):
    words = bits // 64

    def columns(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _as_array(p["fp"], words), p["id"].to_numpy(), radius(p["size"].to_numpy(), t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, members = None, [], None

        def close() -> list[tuple[np.ndarray, np.ndarray]]:
            """Matches among the rows of a small shard, which are members and visitors at once."""
            if not held or (len(held) == 1 and len(held[0][1]) < 2):
                return []
            rows = tuple(np.concatenate(x) for x in zip(*held)) if len(held) > 1 else held[0]
            return search(*rows, *rows)

        for pdf in batches:
            if not len(pdf):
                continue
            out: list[tuple[np.ndarray, np.ndarray]] = []
            shard, part = pdf["shard"].to_numpy(), pdf["part"].to_numpy()
            fp, ids, r = columns(pdf)
            role = pdf["role"].to_numpy()
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(pdf)]):
                k = (shard[a], part[a])
                if k != key:
                    out += close()
                    key, held, members = k, [], None
                if role[a] == BOTH:  # all rows of a small shard are
                    held.append((fp[a:b], ids[a:b], r[a:b]))
                    continue
                # Members come before the visitors, so the visitors of a part are never held together.
                m = a + int((role[a:b] == MEMBER).sum())
                if m > a:
                    members = (fp[a:m], ids[a:m], r[a:m]) if members is None else tuple(np.concatenate(x) for x in zip(members, (fp[a:m], ids[a:m], r[a:m])))
                if m < b and members is not None:
                    out += search(*members, fp[m:b], ids[m:b], r[m:b])
            if out:
                yield pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([x for _, x in out])})
        out = close()
        if out:
            yield pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([x for _, x in out])})

    return run


def representative_pairs(sets: DataFrame, t: Fraction = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links): each record with its class's representative; matching pairs of representatives."""
    spark = sets.sparkSession
    sets = cut(sets)
    key = ["record_kind", "grp", "klass"]
    classes = sets.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    members = sets.select(*key, "id").join(classes, key).select("record_kind", "id", "rep", "n")
    reps = sets.join(classes.select("record_kind", F.col("rep").alias("id")), ["record_kind", "id"], "left_semi")
    reps = cut(reps.select("record_kind", "grp", "id", "size", "items"))
    stats = reps.agg(F.percentile_approx("size", 0.95).alias("p"), F.count(F.lit(1)).alias("n")).first()
    bits = 256
    while bits < 4 * (stats["p"] or 1):
        bits *= 2
    trees: dict[str, dict] = {}
    for kind in ("gist", "slot"):
        pick = reps.where(F.col("record_kind") == kind).orderBy(F.xxhash64("id"), "id").limit(TREE_SAMPLE).select("size", "items").collect()
        if pick:
            fps = np.frombuffer(b"".join(fingerprint(np.array(x["items"], np.int64), bits) for x in pick), np.uint64)
            trees[kind] = build_tree(fps.reshape(len(pick), -1), np.array([x["size"] for x in pick]), t)
    routed = reps.mapInPandas(_router(trees, frequent_elements(reps), bits, t, LEAF), SHARDED)
    order = ["shard", "part"]
    candidates = routed.repartition(shuffle_parts(spark), *order).sortWithinPartitions(*order, "role").mapInPandas(_shards(bits, t), "a long, b long").distinct()
    side = lambda c: reps.select("record_kind", "grp", F.col("id").alias(c), F.col("items").alias(f"{c}_items"))
    # ids of two kinds can be equal: what stands in one shard by chance is told apart here
    both = candidates.join(side("a"), "a").join(side("b"), ["record_kind", "grp", "b"])
    shared = F.size(F.array_intersect("a_items", "b_items"))
    union = F.size("a_items") + F.size("b_items") - shared
    links = both.where(shared * t.denominator >= union * t.numerator).select("record_kind", "a", "b")
    return members, links


def near_duplicate_pairs(sets: DataFrame, t: Fraction = THRESHOLD) -> DataFrame:
    """Every matching pair of records: (record_kind, id_a, id_b), id_a < id_b."""
    members, links = representative_pairs(sets, t)
    own = members.where("n > 1").select("record_kind", F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()
    edges = links.unionByName(own)
    left = members.select("record_kind", F.col("rep").alias("a"), F.col("id").alias("x"))
    right = members.select("record_kind", F.col("rep").alias("b"), F.col("id").alias("y"))
    out = edges.join(left, ["record_kind", "a"]).join(right, ["record_kind", "b"]).where("a <> b or x < y")
    return out.select("record_kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(record_kind, id, component) by min-label propagation with pointer jumping; each round is checkpointed."""
    both = cut(edges.select("record_kind", "a", "b").unionByName(edges.select("record_kind", F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.select("record_kind", F.col("a").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(labels.select("record_kind", F.col("id").alias("b"), "component"), ["record_kind", "b"])
        low = near.groupBy("record_kind", F.col("a").alias("id")).agg(F.min("component").alias("low"))
        step = labels.join(low, ["record_kind", "id"]).select("record_kind", "id", F.col("component").alias("was"), F.least("component", "low").alias("now"))
        # a giant component has one label: its rows go to SALT tasks, each with a copy of what the label's own row says
        hop = step.select("record_kind", F.col("id").alias("now"), F.col("now").alias("next"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        new = cut(step.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(hop, ["record_kind", "now", "salt"]).select("record_kind", "id", "was", F.least("now", "next").alias("component")))
        changed = new.where("component <> was").limit(1).count()
        labels = new.select("record_kind", "id", "component")
        if not changed:
            break
    return nodes.join(labels, ["record_kind", "id"], "left").select("record_kind", "id", F.coalesce("component", "id").alias("component"))


def near_duplicate_groups(sets: DataFrame, t: Fraction = THRESHOLD) -> DataFrame:
    """One row per record: its group (least id reachable by matches) and the number of records it matches."""
    members, links = representative_pairs(sets, t)
    members, links = cut(members), cut(links)
    reps = members.select("record_kind", F.col("rep").alias("id"), "n").distinct()
    comp = components(reps.select("record_kind", "id"), links)
    flat = links.unionByName(links.select("record_kind", F.col("b").alias("a"), F.col("a").alias("b")))
    degree = flat.join(reps.select("record_kind", F.col("id").alias("b"), "n"), ["record_kind", "b"]).groupBy("record_kind", F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    out = members.join(comp.select("record_kind", F.col("id").alias("rep"), "component"), ["record_kind", "rep"]).join(degree, ["record_kind", "rep"], "left")
    return out.select("record_kind", F.col("id").alias("record_id"), F.col("component").alias("group_id"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gists = read(spark, sf_dir, "teacher_gists_anticollapse_wiki20_pilot", "gist_id", "text").withColumnRenamed("gist_id", "id")
    slots = read(spark, sf_dir, "memory_slot", "slot_id", "doc_key", "origin_indices").toDF("id", "grp", "numbers")
    return record_sets(spark, gists, slots)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of near-duplicate gists and of near-duplicate provenance lists."""
    return near_duplicate_pairs(_inputs(spark, sf_dir))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that the pairs form."""
    return near_duplicate_groups(_inputs(spark, sf_dir))
