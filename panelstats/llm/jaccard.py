"""Near-copy join on word shingles with Bayesian pruning of candidates.

1. Each document becomes its set of five-word shingles; documents with equal sets are one unit from here on.
2. Units that share a band of their MinHash signature are candidates. With 40 bands of 5 values a pair of similarity 0.8
   shares none with probability 1.3e-7.
3. Units connected by shared bands form clusters; a cluster is cut into blocks of bounded size, and each pair of blocks
   is one group. In a group, signatures are compared a few values at a time; after n values with m matches the
   posterior probability that the similarity reaches the threshold (uniform prior) is a binomial sum, and pairs for
   which it is below `tolerance` are dropped. The rest is verified exactly on the shingle sets.
4. A group returns, for each unit, how many documents it is linked to and its root in the group; pairs never leave it.
   Classes are the connected components of the links.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.llm.common import LOWEST, whole_text
from panelstats.llm.components import components
from panelstats.llm.shingles import WIDTH, MinHash, bands, fingerprint, shingle_set
from panelstats.session import materialise


def least_matches(values: int, step: int, threshold: float, tolerance: float) -> list[int]:
    """For each number of compared values the fewest matches with which a pair goes on."""
    out = []
    for n in range(step, values + 1, step):
        total, m = 0.0, -1
        while total < tolerance:  # P(similarity >= threshold | m of n) under a uniform prior
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def linked(left: np.ndarray, right: np.ndarray, step: int, least: list[int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature tables that survive the incremental comparison; an empty table has none."""
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin in range(0, len(left), 64):
        part = left[begin:begin + 64]
        hits = (part[:, None, :step] == right[None, :, :step]).sum(axis=2)
        i, j = np.nonzero(hits >= least[0])
        i += begin
        if same:
            i, j = i[i < j], j[i < j]
        matches = hits[i - begin, j]
        for k, need in enumerate(least[1:], 1):
            keep = np.zeros(len(i), bool)
            for a in range(0, len(i), 1 << 16):
                cut = slice(a, a + (1 << 16))
                matches[cut] += (left[i[cut], k * step:(k + 1) * step] == right[j[cut], k * step:(k + 1) * step]).sum(axis=1)
            keep = matches >= need
            i, j, matches = i[keep], j[keep], matches[keep]
        found_i.append(i)
        found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets really reach the threshold; i is sorted."""
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    offsets = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(int(flat.max()) + 1, np.int64) if len(flat) else np.zeros(1, np.int64)
    out = np.zeros(len(i), bool)
    head = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
    for a, b in zip(head, np.r_[head[1:], len(i)] if len(i) else []):
        own = flat[offsets[i[a]]:offsets[i[a] + 1]]
        mark[own] = 1
        for c in range(a, b, 512):
            other = j[c:min(b, c + 512)]
            n = sizes[other]
            ends = np.cumsum(n)
            where = np.arange(int(ends[-1])) + np.repeat(offsets[other] - (ends - n), n)
            shared = np.add.reduceat(mark[flat[where]], ends - n)
            out[c:c + len(other)] = shared >= threshold * (len(own) + n - shared) - 1e-9
        mark[own] = 0
    return out


def _roots(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                width: int = WIDTH, band_count: int = 40, band_rows: int = 5, step: int = 20,
                tolerance: float = 1e-6, block: int = 1024, tell_texts: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, n_copies.

    class_id: the smallest doc_id among the documents connected by links; n_links: the other documents with a
    similarity of at least `threshold`; n_copies: of these, those with the same shingle set. A text of fewer than
    `width` words is a single shingle; a text without words, or a missing one, is linked to nothing. A missing doc_id
    sorts below all others. Rows that repeat id and shingles are one document.

    With `tell_texts` also row_key, a hash of the text (of texts with equal id and shingles the smallest), and kept: one
    (doc_id, row_key) of each class, the smallest. Each text without words is then a row and a class of its own.
    """
    values = band_count * band_rows
    data = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST)).alias("doc_id"), whole_text(text_col).alias("text"))
    told = ["row_key"] if tell_texts else []
    texts = data.withColumn("row_key", F.xxhash64("text")) if tell_texts else data

    def features(frames):
        import pandas as pd

        sketch = MinHash(values)
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                found = shingle_set(text, width)
                if len(found):
                    out.append((doc, len(found), fingerprint(found), bands(sketch(found), band_rows)))
                else:
                    out.append((doc, 0, 0, np.zeros(0, np.int64)))
            made = pd.DataFrame(out, columns=["doc_id", "size", "unit", "bands"])
            yield made.assign(row_key=frame["row_key"].to_numpy()) if told else made

    schema = "doc_id long, size long, unit long, bands array<long>" + (", row_key long" if tell_texts else "")
    seen = materialise(texts.mapInPandas(features, schema), "shingles")
    members = seen.where("size > 0").select("doc_id", "unit", *told)
    members = members.groupBy("doc_id", "unit").agg(F.min("row_key").alias("row_key")) if tell_texts else members.distinct()
    keys = seen.select("unit", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("unit").alias("low"), F.max("unit").alias("high")).where("low <> high")
    edges = keys.join(shared.select("band", "low"), "band").where("unit <> low").select(F.col("unit").alias("a"), F.col("low").alias("b"))
    clusters = components(edges)
    sizes = clusters.groupBy("root").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    units = members.groupBy("unit").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    chosen = materialise(
        clusters.join(sizes, "root").join(units, clusters["node"] == units["unit"])
        .select("root", "blocks", "unit", "doc_id", "copies"), "candidates")

    def sketches(frames):
        import pandas as pd

        sketch = MinHash(values)
        for frame in frames:
            out = []
            for root, blocks, unit, copies, text in zip(frame["root"], frame["blocks"], frame["unit"], frame["copies"], frame["text"]):
                found = shingle_set(text, width)
                if len(found) and fingerprint(found) == unit:
                    out.append((root, blocks, unit, copies, sketch(found).tobytes(), found.tobytes()))
            yield pd.DataFrame(out, columns=["root", "blocks", "unit", "copies", "signature", "shingles"])

    sketched = data.join(chosen.hint("merge"), "doc_id").select("root", "blocks", "unit", "copies", "text").mapInPandas(
        sketches, "root long, blocks long, unit long, copies long, signature binary, shingles binary")
    # (the join above is by sorted shuffles at every size: a broadcast of the candidates would depend on their number)
    # a unit of block b meets block c in the group (min, max); alone in the cluster's only block it goes there once
    mine = F.pmod(F.xxhash64("unit"), F.col("blocks"))
    dealt = (
        sketched.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("root", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"), "mine",
                "unit", "copies", "signature", "shingles")
    )
    least = least_matches(values, step, threshold, tolerance)

    def compare(key, frame):
        import pandas as pd

        frame = frame.drop_duplicates("unit").sort_values(["mine", "unit"], ignore_index=True)
        signatures = np.stack([np.frombuffer(s, np.uint32) for s in frame["signature"]])
        sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
        cut = int((frame["mine"] == int(key[1])).sum())
        if int(key[1]) == int(key[2]):
            i, j = linked(signatures, signatures, step, least, True)
        else:
            i, j = linked(signatures[:cut], signatures[cut:], step, least, False)
            j = j + cut
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        ok = verified(sets, i, j, threshold)
        i, j = i[ok], j[ok]
        copies = frame["copies"].to_numpy(np.int64)
        links = np.bincount(i, weights=copies[j], minlength=len(frame)) + np.bincount(j, weights=copies[i], minlength=len(frame))
        unit = frame["unit"].to_numpy(np.int64)
        out = pd.DataFrame({"unit": unit, "links": links.astype(np.int64), "to": unit[_roots(len(frame), i, j)]})
        return out[out["links"] > 0]

    found = materialise(dealt.groupBy("root", "first", "second").applyInPandas(compare, "unit long, links long, to long"), "links")
    near = found.groupBy("unit").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("unit").alias("a"), F.col("to").alias("b")))
    by_unit = units.select("unit", "copies").join(near, "unit", "left").join(roots.withColumnRenamed("node", "unit"), "unit", "left")
    by_unit = by_unit.select("unit", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "unit").alias("root"))
    named = materialise(members.join(by_unit, "unit"), "near")
    first = [F.min(F.struct("doc_id", "row_key")).alias("first")] if tell_texts else []
    classes = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), *first)
    kept = [F.col("row_key"), (F.struct("doc_id", "row_key") == F.col("first")).alias("kept")] if tell_texts else []
    missing = lambda c: F.when(F.col(c) != LOWEST, F.col(c)).alias(c)
    linked_docs = named.join(classes, "root").select(
        missing("doc_id"), missing("class_id"), "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links"),
        (F.col("copies") - 1).alias("n_copies"), *kept)
    single = [F.col("row_key"), F.lit(True).alias("kept")] if tell_texts else []
    alone = seen.where("size = 0").select("doc_id", *told).distinct().select(
        missing("doc_id"), F.when(F.col("doc_id") != LOWEST, F.col("doc_id")).alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"), *single)
    return linked_docs.unionByName(alone)
